"""WARC archives with a two-level capture index (operator 10).

``archive`` writes one record a page, every record a gzip member of its own, one
file a task, in the shared folder.  Of pages with equal payloads the one with
the smallest id is the response and the others are revisits that refer to it.
Payloads are compared by their SHA-1, which the JVM computes; only digests that
occur twice or more are joined back.

The index is sorted by the reversed-host form of the URL (``com,example)/path``)
and the page id.  Its lines are packed into compressed blocks of ``LINES``; each
index file ends with a sparse directory of its blocks' first keys.  One row a
file, at most one a partition, is the top level.  A look-up finds the file and
the block by binary search, reads the block by range, finds the line by binary
search and reads the record by range.

Files are opened through the file system that the folder's URI names.  A task
writes to a name of its own attempt, and index rows carry that name, so a
repeated task never mixes with another's file; the index is written once and
read from there.

Defined cases: a null html is an empty payload, and empty payloads are compared
like any; a null url has an empty key; rows with a null id are responses unless
another row has their payload and an id; repeated rows are records of their own,
responses if their id is the smallest; characters that a header cannot hold are
percent-encoded; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_left, bisect_right
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import cut, shared_dir, ship, shuffles

LINES = 256
MAGIC = b"CDXB0001"
DATE = "2024-01-01T00:00:00Z"
NO_ID = -(1 << 63)
#: Payloads below this many bytes are always responses.
SMALLEST = 0


def clean(url: str) -> str:
    """The URL with everything that a header line cannot hold percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def reversed_host(url: str | None) -> str:
    """``com,example)/path?query`` of a URL; a text that is no URL stands for itself."""
    url = clean(url or "")
    try:
        parts = urlsplit(url)
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    if not host:
        return url
    port = "" if port in (None, 80, 443) else f":{port}"
    return ",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else "")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member holding a response or, with ``refers_to``, a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {clean(url)}")
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Truncated: length"]
    lines.append(f"Content-Length: {len(body)}")
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def headers(block: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in block.decode().split("\r\n")[1:])


def parsed(member: bytes) -> dict:
    """page_id, url, payload (None for a revisit), payload_bytes, payload_digest, record_type and refers_to of a record; checked."""
    head, rest = gzip.decompress(member).split(b"\r\n\r\n", 1)
    h = headers(head)
    body = rest[: int(h["Content-Length"])]
    http, payload = body.split(b"\r\n\r\n", 1)
    size = int(headers(http)["Content-Length"])
    told = h["WARC-Payload-Digest"].removeprefix("sha1:")
    number = lambda s: int(x) if (x := s.removeprefix("<urn:page:").removesuffix(">")) else None
    revisit = h["WARC-Type"] == "revisit"
    if not revisit and (len(payload) != size or digest(payload) != told):
        raise ValueError(f"damaged record {h['WARC-Record-ID']}")
    return {"page_id": number(h["WARC-Record-ID"]), "url": h.get("WARC-Target-URI"), "payload": None if revisit else payload, "payload_bytes": size, "payload_digest": told, "record_type": h["WARC-Type"], "refers_to": number(h["WARC-Refers-To"]) if revisit else None}


def opened(root: str):
    """The file system of a URI and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root)


def writer_name(kind: str) -> str:
    context = TaskContext.get()
    return f"{kind}-{context.partitionId():05d}-{context.taskAttemptId()}"


def archive(pages: DataFrame, root: str) -> DataFrame:
    """Write all records under ``root``; (key, id, file, at, size) of each, id ``NO_ID`` for null."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html.cast("binary")).alias("h"))
    large = F.octet_length("html") >= SMALLEST
    first = rows.where(large).groupBy("h").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null").select("h", "first_id")
    told = rows.join(first, "h", "left").select("page_id", "url", "html", F.when(large & ~F.col("first_id").eqNullSafe(F.col("page_id")), F.col("first_id")).alias("refers_to"))

    def run(batches):
        system, path = opened(root)
        system.create_dir(path, recursive=True)
        name, at, out = writer_name("archive") + ".warc.gz", 0, None
        try:
            for whole in batches:
                for start in range(0, whole.num_rows, 512):
                    b = whole.slice(start, 512)
                    lines = []
                    for page, url, text, refers in zip(*(b.column(i).to_pylist() for i in range(4))):
                        data = record(page, url, text.encode(), refers)
                        if out is None:
                            out = system.open_output_stream(f"{path}/{name}", compression=None)
                        out.write(data)
                        lines.append((reversed_host(url), NO_ID if page is None else page, name, at, len(data)))
                        at += len(data)
                    cols = list(zip(*lines)) or [()] * 5
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))], ["key", "id", "file", "at", "size"])
        finally:
            if out is not None:
                out.close()

    return cut(told.mapInArrow(run, "key string, id long, file string, at long, size long"))


def indexed(captures: DataFrame, root: str) -> list[tuple[str, int, str]]:
    """Write the index of captures; the top level: (first key, first id, file) of each index file, in order."""

    def run(batches):
        system, path = opened(root)
        name, out, at, held, directory, n = writer_name("index") + ".cdx", None, 0, [], [], 0

        def close_block():
            nonlocal at, out
            if out is None:
                system.create_dir(path, recursive=True)
                out = system.open_output_stream(f"{path}/{name}", compression=None)
            data = zlib.compress("".join("\t".join(map(str, x)) + "\n" for x in held).encode())
            out.write(data)
            directory.append([held[0][0], held[0][1], at, len(data)])
            at += len(data)
            held.clear()

        for b in batches:
            for line in zip(*(b.column(i).to_pylist() for i in range(5))):
                held.append(line)
                n += 1
                if len(held) == LINES:
                    close_block()
        if held:
            close_block()
        if out is not None:
            footer = zlib.compress(json.dumps(directory).encode())
            out.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([directory[0][0]]), pa.array([directory[0][1]], pa.int64()), pa.array([name]), pa.array([n], pa.int64())], ["key", "id", "file", "n"])

    dealt = captures.select("key", "id", "file", "at", "size").repartitionByRange(shuffles(captures.sparkSession), "key", "id").sortWithinPartitions("key", "id", "file", "at")
    top = cut(dealt.mapInArrow(run, "key string, id long, file string, n long"))
    return sorted((r["key"], r["id"], r["file"]) for r in top.collect())  # at most one row a shuffle partition


class Index:
    """Reads captures by binary search in both levels; keeps one directory, one block and some open files."""

    def __init__(self, top: list[tuple[str, int, str]], root: str, most_open: int = 32):
        self.top = top
        self.keys = [x[:2] for x in top]
        self.system, self.path = opened(root)
        self.most_open = most_open
        self.files: dict = {}
        self.at_file, self.directory, self.firsts = "", [], []
        self.at_block, self.lines, self.line_keys = None, [], []

    def file(self, name: str):
        if name not in self.files:
            if len(self.files) >= self.most_open:
                self.files.pop(next(iter(self.files))).close()
            self.files[name] = self.system.open_input_file(f"{self.path}/{name}")
        return self.files[name]

    def range(self, name: str, at: int, size: int) -> bytes:
        return self.file(name).read_at(size, at)

    def _block(self, name: str, at: int, size: int) -> None:
        if self.at_block != (name, at):
            rows = [x.split("\t") for x in zlib.decompress(self.range(name, at, size)).decode().split("\n")[:-1]]
            self.lines = [(k, int(i), f, int(a), int(s)) for k, i, f, a, s in rows]
            self.line_keys = [x[:2] for x in self.lines]
            self.at_block = (name, at)

    def find(self, key: str, page: int) -> list[tuple[str, int, str, int, int]]:
        """All index lines of a key and page."""
        out, want = [], (key, page)
        part = max(0, bisect_left(self.keys, want) - 1)
        while part < len(self.top) and self.keys[part] <= want:
            name = self.top[part][2]
            if name != self.at_file:
                length = self.file(name).size()
                size, magic = struct.unpack("<Q8s", self.range(name, length - 16, 16))
                if magic != MAGIC:
                    raise ValueError(f"no index file: {name}")
                self.directory = json.loads(zlib.decompress(self.range(name, length - 16 - size, size)))
                self.firsts = [(k, i) for k, i, _, _ in self.directory]
                self.at_file = name
            block = max(0, bisect_left(self.firsts, want) - 1)
            while block < len(self.directory) and self.firsts[block] <= want:
                self._block(name, *self.directory[block][2:])
                out += self.lines[bisect_left(self.line_keys, want) : bisect_right(self.line_keys, want)]
                block += 1
            part += 1
        return out

    def read(self, line: tuple[str, int, str, int, int]) -> dict:
        return parsed(self.range(*line[2:]))

    def close(self) -> None:
        for f in self.files.values():
            f.close()


READ = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"


def looked_up(wanted: DataFrame, top: list[tuple[str, int, str]], root: str, payload: bool = True) -> DataFrame:
    """The records of all (url, page_id) in ``wanted``; each of several captures of the same pair is returned."""

    def keyed(batches):
        for b in batches:
            ids = [NO_ID if i is None else i for i in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([reversed_host(u) for u in b.column(0).to_pylist()], pa.string()), pa.array(ids, pa.int64())], ["key", "id"])

    kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in READ.split(", ")]

    def run(batches):
        index = None
        for whole in batches:
            index = index or Index(top, root)
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                found = [index.read(line) for k, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for line in index.find(k, i)]
                yield pa.RecordBatch.from_arrays([pa.array([None if n == "payload" and not payload else r[n] for r in found], t) for n, t in zip(names, kinds)], names)
        if index:
            index.close()

    rows = wanted.select(F.col("url").cast("string").alias("url"), F.col("page_id").cast("long").alias("page_id")).mapInArrow(keyed, "key string, id long").distinct()
    dealt = rows.repartitionByRange(shuffles(wanted.sparkSession), "key", "id").sortWithinPartitions("key", "id")
    return dealt.mapInArrow(run, READ)


def archived(pages: DataFrame) -> DataFrame:
    """Write all pages to an archive in the shared folder, index it, and read every record back through the index."""
    root = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    top = indexed(archive(pages, root), root)
    return looked_up(pages, top, root, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ship(__name__)
