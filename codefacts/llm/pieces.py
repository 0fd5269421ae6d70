"""SentencePiece BPE encoding and decoding by vectorised merge rounds (operator 9).

The model file gives pieces and scores; merging is done here.  No piece has a
space mark after another character and none a line feed, so a text falls into
units (a run of marks with what follows it, or a line feed) that never merge
with each other.  Different units of a batch become one flat array of symbols.
In each round the best pair rank of every unit is found by a segmented minimum,
all its leftmost non-overlapping occurrences are merged at once, and the arrays
are compacted; units without a pair leave, until none remains.

A merge that could create a pair as good as itself or better (the model has
some) is done one leftmost occurrence a round, so the order is exactly the
library's.  Units of over ``LONG`` symbols are merged with a heap instead, in
O(n log n), which gives the same result for texts without any space.

Characters outside the vocabulary become byte pieces.  ``decode`` is the
library's: pieces are joined, marks become spaces, runs of byte pieces become
text and one leading space goes.

Units met before are looked up in a table of at most ``KEPT`` entries, which is
emptied when full.

Defined cases: null text is empty and has no ids; repeated rows give repeated
results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
import types

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import ship

MARK = "▁"
LONG, KEPT, FLAT = 1024, 200_000, 1 << 18
NONE = np.int32(1 << 30)
UNIT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


class Codec:
    """Encoder and decoder for one model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = self.n = model.get_piece_size()
        self.piece = [model.id_to_piece(i) for i in range(n)]
        self.byte = {i: int(self.piece[i][3:5], 16) for i in range(n) if model.is_byte(i)}
        self.of_byte = {b: i for i, b in self.byte.items()}
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        ids = {self.piece[i]: i for i in plain}
        best = sorted({-model.get_score(i) for i in plain})
        rank = {s: r for r, s in enumerate(best)}
        self.char = np.full(0x110000, -1, np.int64)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        free = np.flatnonzero(self.char < 0)
        self.char[free] = n + free
        self.base = n + 0x110000
        single = lambda c: ids.get(c, n + ord(c)) if len(c) == 1 else ids.get(c)
        rows = []
        for p, i in ids.items():
            for at in range(1, len(p)):
                a, b = single(p[:at]), single(p[at:])
                if a is not None and b is not None:
                    rows.append((a * self.base + b, rank[-model.get_score(i)], i, a, b))
        rows.sort()
        self.keys, self.ranks, self.merged = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.int32), np.array([r[2] for r in rows])
        self.pairs = {r[0]: (r[1], r[2]) for r in rows}
        least: dict[int, int] = {}
        for _, r, _, a, b in rows:
            for x in (a, b):
                least[x] = min(r, least.get(x, r))
        self.single = np.zeros(len(best) + 1, bool)  # ranks that are merged one occurrence at a time
        of_rank: dict[int, set] = {}
        for _, r, i, _, _ in rows:
            if i in least and least[i] <= r:
                self.single[r] = True
            of_rank.setdefault(r, set()).add(i)
        for r, made in of_rank.items():
            if len(made) > 1:
                self.single[r] = True
        self.known: dict[str, tuple] = {}

    @classmethod
    def of(cls, path: str) -> Codec:
        """The process's codec for a file: a worker that runs many tasks builds it once and goes on with its table."""
        # this module is sent by value and made anew for every task, so what lasts as long as the worker has a module of its own
        kept = sys.modules.setdefault("codefacts_worker_codecs", types.ModuleType("codefacts_worker_codecs")).__dict__.setdefault("codecs", {})
        if path not in kept:
            kept.clear()
            kept[path] = cls(path)
        return kept[path]

    def _look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a * self.base + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), np.where(hit, self.merged[at], -1)

    def _flat(self, units: list[str]) -> list[list[int]]:
        """Symbols of each unit, merged in rounds."""
        out: list[list[int]] = [[]] * len(units)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        sym = self.char[np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)]
        who = np.repeat(np.arange(len(units)), sizes)
        rank, made = np.full(len(sym), NONE), np.full(len(sym), -1)
        inner = np.flatnonzero(who[1:] == who[:-1])
        rank[inner], made[inner] = self._look(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]])
            lengths = np.diff(np.r_[starts, len(sym)])
            least = np.minimum.reduceat(rank, starts)
            over = least == NONE
            if over.any():
                for s, n in zip(starts[over].tolist(), lengths[over].tolist()):
                    out[who[s]] = sym[s : s + n].tolist()
                stay = np.repeat(~over, lengths)
                sym, who, rank, made = sym[stay], who[stay], rank[stay], made[stay]
                least, lengths = least[~over], lengths[~over]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(least, lengths))
            unit = who[at]
            new = np.r_[True, unit[1:] != unit[:-1]]
            joined = np.r_[False, (at[1:] == at[:-1] + 1)] & ~new
            order = np.arange(len(at))
            run = np.maximum.accumulate(np.where(joined, 0, order))
            take = ((order - run) % 2 == 0) & (new | ~self.single[rank[at]])
            at = at[take]
            sym[at] = made[at]
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            keep = ~gone
            place = np.cumsum(keep) - 1
            at = place[at]
            sym, who, rank, made = sym[keep], who[keep], rank[keep], made[keep]
            touched = np.unique(np.r_[at, at[at > 0] - 1])
            last = touched == len(sym) - 1
            ends = last.copy()
            ends[~last] = who[touched[~last]] != who[touched[~last] + 1]
            rank[touched[ends]], made[touched[ends]] = NONE, -1
            inner = touched[~ends]
            rank[inner], made[inner] = self._look(sym[inner], sym[inner + 1])
        return out

    def _heap(self, unit: str) -> list[int]:
        """Symbols of one long unit, merged one by one in the same order."""
        sym = self.char[np.frombuffer(unit.encode("utf-32-le"), np.uint32)].tolist()
        n = len(sym)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list = []

        def offer(i: int) -> None:
            j = right[i] if i >= 0 else n
            if i >= 0 and j < n and (p := self.pairs.get(sym[i] * self.base + sym[j])):
                heapq.heappush(heap, (p[0], i, sym[i], sym[j], p[1]))

        for i in range(n):
            offer(i)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = right[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = made, -1
            right[i] = right[j]
            if right[j] < n:
                left[right[j]] = i
            offer(left[i])
            offer(i)
        return [s for s in sym if s >= 0]

    def _ids(self, symbols: list[int]) -> list[int]:
        if not symbols or max(symbols) < self.n:
            return symbols
        out: list[int] = []
        for s in symbols:
            out += [s] if s < self.n else [self.of_byte[b] for b in chr(s - self.n).encode()]
        return out

    def spelled(self, ids: list[int]) -> str:
        """Text of some ids, marks as spaces, leading ones kept."""
        out, held = [], bytearray()
        for i in ids:
            if i in self.byte:
                held.append(self.byte[i])
                continue
            if held:
                out.append(held.decode(errors="replace"))
                held.clear()
            out.append(self.piece[i])
        if held:
            out.append(held.decode(errors="replace"))
        return "".join(out).replace(MARK, " ")

    def decode(self, ids: list[int]) -> str:
        return self.spelled(ids).removeprefix(" ")

    def learn(self, units: set[str]) -> None:
        """Put (ids, ids as text, decoded text) of units into the table of known ones."""
        flat: list[str] = []
        size = 0

        def close() -> None:
            for u, s in zip(flat, self._flat(flat)):
                self._put(u, s)

        for u in units:
            if len(u) > LONG:
                self._put(u, self._heap(u))
                continue
            flat.append(u)
            size += len(u)
            if size > FLAT:
                close()
                flat, size = [], 0
        if flat:
            close()

    def _put(self, unit: str, symbols: list[int]) -> None:
        ids = self._ids(symbols)
        self.known[unit] = (len(ids), ",".join(map(str, ids)), self.spelled(ids))

    def units(self, texts: list[str]) -> list[list[str]]:
        """Each text's units, all of them in the table."""
        if len(self.known) > KEPT:
            self.known.clear()
        split = [UNIT.findall(MARK + t.replace(" ", MARK)) if t else [] for t in texts]
        new = {u for x in split for u in x if u not in self.known}
        if new:
            self.learn(new)
        return split

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[int(i) for u in x for i in self.known[u][1].split(",")] for x in self.units(texts)]


def small(batch: pa.RecordBatch, rows: int = 512):
    """Slices of a batch."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def encoded(docs: DataFrame, path: str, ids: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]) of every row; the digests are of the ids and of the text decoded from them."""

    def run(batches):
        codec = Codec.of(path)
        for whole in batches:
            for b in small(whole):
                texts = [t or "" for t in b.column(1).to_pylist()]
                found = [[codec.known[u] for u in x] for x in codec.units(texts)]
                joined = [",".join([k[1] for k in x]) for x in found]
                back = ["".join([k[2] for k in x]).removeprefix(" ") for x in found]
                out = [
                    b.column(0),
                    pa.array([sum([k[0] for k in x]) for x in found], pa.int64()),
                    pa.array([hashlib.sha256(j.encode()).hexdigest() for j in joined], pa.string()),
                    pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()),
                ]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if ids:
                    out.append(pa.array([np.array(j.split(","), np.int32) if j else np.zeros(0, np.int32) for j in joined], pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(out, names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * ids)


ship(__name__)
