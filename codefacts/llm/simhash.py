"""SimHash near-duplicates by pigeonring filtering (operator 4).

Fingerprints are computed per text from XXH64 hashes of word shingles.  Two
fingerprints link when they differ in at most ``DISTANCE`` bits; components of
that relation are classes of near copies.

Finding links.  The 64 bits form a ring of 16 segments of 4 bits.  By the
pigeonring principle two fingerprints within 3 bits have a segment from which
*every* chain of l consecutive segments differs in at most floor(3 l / 16)
bits: none over 5 segments, at most one over 10.  So for some rotation the
first 20 bits agree, and of the next 20 bits, which hold at most one
difference, one half of 10 agrees.  Rows are dealt by (rotation, half, those 30
bits): 32 keys a fingerprint.  Inside a bucket every chain length is checked
against its proportional budget before the full Hamming distance is taken.

Buckets never become pairs in the plan: a bucket of up to ``BUCKET``
fingerprints is compared in blocks inside one task, which returns a spanning
forest (at most one link a member).  Larger buckets are passed on whole to a
second round with C(16, 3) = 560 keys of 52 bits, in which three segments are
left out.  At most 2^12 different fingerprints share such a key, so buckets
there have a proven bound, and any two fingerprints within 3 bits share one.

Components of up to ``LOCAL`` links are found in one task, others by alternating
large-star and small-star steps on the links, each written to the shared folder.

Defined cases: null text is empty; a text without words has fingerprint zero,
linked like any other; a text of fewer words than a shingle is one shingle;
repeated rows give repeated result rows; a null ``doc_id`` counts in no
minimum; a component with null ids only has a null ``component_id``; extra
columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import cut, ship, shuffles

SEED = 42
DISTANCE = 3
SEGMENTS, WIDTH = 16, 4
BUCKET = 2048
#: Shingles hashed at a time, which bounds the memory of a very long text.
CHUNK = 65536
#: Links that one task settles.
LOCAL = 100_000


def fingerprint(text: str | None, width: int) -> int:
    """SimHash of one text: bit i is set if it is set in over half of the shingles' hashes."""
    words = (text or "").encode().lower().split()
    n = len(words) - width + 1
    if not words:
        return 0
    if n < 1:
        n, width = 1, len(words)
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = (ends - sizes + 1)[:n].tolist()
    stops = ends[width - 1 : width - 1 + n].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, CHUNK):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): each document's fingerprint as a signed long with the same bits."""

    def run(batches):
        for b in batches:
            fps = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def _chains(x: np.ndarray, rotation: np.ndarray | int) -> np.ndarray:
    """Whether each difference keeps every chain from this segment within its proportional budget."""
    r = np.asarray(rotation, np.uint64) * np.uint64(WIDTH)
    turned = (x << r) | (x >> ((np.uint64(64) - r) & np.uint64(63))) if np.any(r) else x
    ok = np.ones(x.shape, bool)
    for length in (10, 15):  # just before the budget grows; shorter chains follow from these and the key
        ok &= np.bitwise_count(turned >> np.uint64(64 - WIDTH * length)) <= DISTANCE * length // SEGMENTS
    return ok


def _forest(fps: np.ndarray, rotation: int | None) -> list[tuple[int, int]]:
    """A spanning forest of the links within one bucket, compared row by block."""
    n = len(fps)
    if n == 2:
        return [(0, 1)] if int(fps[0] ^ fps[1]).bit_count() <= DISTANCE else []
    left, links = np.arange(1, n), []
    rest, front = left, [0]
    while True:
        while front and len(rest):
            at = front.pop()
            x = fps[rest] ^ fps[at]
            hit = np.bitwise_count(x) <= DISTANCE if rotation is None else _chains(x, rotation)
            if rotation is not None and hit.any():
                hit[hit] = np.bitwise_count(x[hit]) <= DISTANCE
            if hit.any():
                new = rest[hit]
                links += [(at, int(i)) for i in new]
                front += new.tolist()
                rest = rest[~hit]
        if len(rest) < 2:
            return links
        front, rest = [int(rest[0])], rest[1:]


def _buckets(bound: int, rotation_of):
    """Streams rows sorted by (k1, k2): links within each bucket; a bucket beyond the bound is passed on, member by member."""

    def run(batches):
        held: list[np.ndarray] = []
        key, size, heavy = None, 0, False

        def close(key, parts):
            fps = np.unique(np.concatenate(parts).view(np.uint64))
            pairs = _forest(fps, rotation_of(key[0]))
            if not pairs:
                return [], []
            a, b = np.array(pairs).T
            return fps[a].view(np.int64).tolist(), fps[b].view(np.int64).tolist()

        for pdf in batches:
            a, b, kind = [], [], []
            k1, k2, fp = (pdf[c].to_numpy() for c in ("k1", "k2", "fp"))
            if not len(fp):
                continue
            edges = np.flatnonzero((k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])) + 1
            starts, stops = np.r_[0, edges], np.r_[edges, len(fp)]
            wanted = (stops - starts > 1) | (starts == 0) | (stops == len(fp))
            for s, e in zip(starts[wanted].tolist(), stops[wanted].tolist()):
                now = (int(k1[s]), int(k2[s]))
                if now != key:
                    if size > 1 and not heavy:
                        x, y = close(key, held)
                        a += x
                        b += y
                        kind += [0] * len(x)
                    held, key, size, heavy = [], now, 0, False
                size += e - s
                if heavy:
                    out = fp[s:e]
                elif size > bound:
                    out, held, heavy = np.concatenate([*held, fp[s:e]]), [], True
                else:
                    held.append(fp[s:e].copy())
                    continue
                a += out.tolist()
                b += out.tolist()
                kind += [1] * len(out)
            yield pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64), "kind": np.array(kind, np.int32)})
        if size > 1 and not heavy:
            x, y = close(key, held)
            yield pd.DataFrame({"a": np.array(x, np.int64), "b": np.array(y, np.int64), "kind": np.zeros(len(x), np.int32)})

    return run


def _ring_keys() -> F.Column:
    """The 32 (k1, k2) keys of a fingerprint: k1 the rotation and half, k2 the 30 bits."""
    keys = []
    for r in range(SEGMENTS):
        turned = F.col("fp") if r == 0 else F.shiftleft("fp", WIDTH * r).bitwiseOR(F.shiftrightunsigned("fp", 64 - WIDTH * r))
        head = F.shiftrightunsigned(turned, 44)
        for half, shift in enumerate((34, 24)):
            part = F.shiftrightunsigned(turned, shift).bitwiseAND(F.lit(1023))
            keys.append(F.struct(F.lit(2 * r + half).alias("k1"), F.shiftleft(head, 10).bitwiseOR(part).alias("k2")))
    return F.array(*keys)


def _cube_keys() -> F.Column:
    """The 560 keys that leave out three segments each."""
    keys = []
    for i, left in enumerate(combinations(range(SEGMENTS), 3)):
        mask = (1 << 64) - 1
        for s in left:
            mask &= ~(15 << (WIDTH * s))
        keys.append((i, mask - (1 << 64) if mask >= 1 << 63 else mask))
    table = F.array(*[F.struct(F.lit(i).alias("k1"), F.lit(m).cast("long").alias("m")) for i, m in keys])
    return F.transform(table, lambda x: F.struct(x["k1"].alias("k1"), x["m"].bitwiseAND(F.col("fp")).alias("k2")))


def links(fps: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that span the same components as all pairs of distinct ``fp`` within DISTANCE bits."""
    n = shuffles(fps.sparkSession)

    def dealt(df, keys, bound, rotation_of):
        rows = df.select("fp", F.explode(keys).alias("k")).select("k.k1", "k.k2", "fp")
        return rows.repartition(n, "k1", "k2").sortWithinPartitions("k1", "k2").mapInPandas(_buckets(bound, rotation_of), "a long, b long, kind int")

    first = cut(dealt(fps.select("fp").distinct(), _ring_keys(), bucket, lambda k: k // 2))
    found = first.where("kind = 0").select("a", "b")
    heavy = first.where("kind = 1").select(F.col("a").alias("fp")).distinct()
    if heavy.limit(1).count():
        found = found.unionByName(dealt(heavy, _cube_keys(), 1 << (3 * WIDTH), lambda k: None).where("kind = 0").select("a", "b"))
    return found.distinct()


def _settled(batches):
    """Rows (node, root) of all edges (a, b): each node's smallest, by pointers to smaller ones."""
    a, b = (np.concatenate(x) for x in zip((np.empty(0, np.int64),) * 2, *((y.column(0).to_numpy(), y.column(1).to_numpy()) for y in batches)))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = np.split(at, 2)
    root = np.arange(len(nodes))
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        for end in (root[a], root[b], a, b):
            np.minimum.at(root, end, low)
        while not np.array_equal(root[root], root):
            root = root[root]
        if np.array_equal(root, before):
            break
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], ["node", "root"])


def components(edges: DataFrame, rounds: int = 64, local: int = LOCAL) -> DataFrame:
    """(node, root): the smallest node reachable from each node that has an edge (a, b).

    Up to ``local`` distinct edges are settled in one task, which saves the many
    small shuffles of the rounds.  Beyond it large-star and small-star steps
    alternate until nothing changes, and no component is gathered in one place.
    """

    def star(both: DataFrame, large: bool) -> DataFrame:
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(least, "u")
        return (joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))).where("a != b").distinct()

    now = cut(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if now.count() <= local:
        return cut(now.select(F.col("a").cast("long"), F.col("b").cast("long")).coalesce(1).mapInArrow(_settled, "node long, root long"))
    state = None
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        wide = star(both, True)
        narrow = star(wide.select(F.col("a").alias("u"), F.col("b").alias("v")), False)
        now = cut(narrow)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == state:
            break
        state = seen
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_copies(docs: DataFrame, width: int = 3, bucket: int = BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs`` (doc_id, text)."""
    each = cut(fingerprints(docs, width))
    least = each.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = components(links(each, bucket))
    named = least.join(roots, least["fp"] == roots["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "first_id", F.col("root").isNotNull().alias("linked"))
    of_root = named.where("linked").groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = named.join(of_root, "root", "left").select("fp", F.coalesce("component_id", "first_id").alias("component_id"))
    return each.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


ship(__name__)
