"""Exact top-k inner products by exhaustive term-at-a-time accumulation (operator 7).

Vectors become integers floor(scale x).  Candidates are packed into blocks of
``ROWS`` vectors, each an inverted list: for every dimension the rows with a
value other than zero and their values.  Queries are packed into blocks of
``QUERIES`` sparse rows.  Every query block meets every candidate block once, as
two packed rows, and inside that task each query walks its terms, scattering
weight times posting into one dense score array of the block; ``k`` scores
are partitioned off and merged with those the task has from blocks before.  Last,
the best ``k`` of a query's partial lists are ranked.

Both kinds of blocks have a fixed size, so a task holds one of each, the dense
array and ``QUERIES * k`` results.  Nothing is pruned.

Defined cases: vectors that are null or hold null, NaN or infinite components,
or have a null id, take no part; of vectors of different length the missing
components count as zero; ties go to the smaller id; repeated ids are
candidates of their own, other than for a query of the same id, and of different
vectors under one query id the greatest array asks; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codefacts.llm.common import ship

SCALE = 1024
ROWS, QUERIES = 4096, 256


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v array<long>) of the vectors that take part."""
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    fine = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).select("vec_id", v.alias("v"))


def _packed(rows: DataFrame, size: int) -> DataFrame:
    """Rows as blocks: ids, lengths and values in three binary columns."""

    def run(batches):
        ids, vs = [], []

        def close():
            lengths = np.array([len(v) for v in vs], "<i4")
            flat = np.concatenate(vs).astype("<i8") if vs else np.zeros(0, "<i8")
            return pa.RecordBatch.from_arrays([pa.array([np.array(ids, "<i8").tobytes()], pa.binary()), pa.array([lengths.tobytes()], pa.binary()), pa.array([flat.tobytes()], pa.binary())], ["ids", "lengths", "flat"])

        for b in batches:
            column = b.column(1)
            values, bounds = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for i, at, end in zip(b.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                ids.append(i)
                vs.append(values[at:end])
                if len(ids) == size:
                    yield close()
                    ids, vs = [], []
        if ids:
            yield close()

    return rows.mapInArrow(run, "ids binary, lengths binary, flat binary")


def _dense(ids: bytes, lengths: bytes, flat: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = np.frombuffer(lengths, "<i4")
    out = np.zeros((len(n), int(n.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < n[:, None]] = np.frombuffer(flat, "<i8")
    return np.frombuffer(ids, "<i8"), out


def postings(v: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each dimension the rows with a value other than zero, and the values."""
    out = []
    for column in v.T:
        rows = np.flatnonzero(column)
        out.append((slice(None) if len(rows) == len(column) else rows, column[rows]))
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id, in order."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        pick = np.flatnonzero(scores >= least)
        scores, ids = scores[pick], ids[pick]
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def _partial(k: int):
    def run(batches):
        held: dict[bytes, list] = {}
        packed = lists = None
        for b in batches:
            for r in b.to_pylist():
                if r["ids"] != packed:
                    packed = r["ids"]
                    ids, v = _dense(r["ids"], r["lengths"], r["flat"])
                    lists = postings(v)
                q_ids, q = _dense(r["q_ids"], r["q_lengths"], r["q_flat"])
                mine = held.setdefault(r["q_ids"], [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q_ids))
                score = np.empty(len(ids), np.int64)
                for j in range(len(q_ids)):
                    score[:] = 0
                    for t in np.flatnonzero(q[j, : len(lists)]):
                        rows, values = lists[t]
                        score[rows] += q[j, t] * values
                    other = ids != q_ids[j]
                    s, i = (score, ids) if other.all() else (score[other], ids[other])
                    s, i = best(s, i, k)
                    mine[j] = best(np.r_[mine[j][0], s], np.r_[mine[j][1], i], k)
                if len(held) > 64:  # results of a bounded number of query blocks are held
                    yield from _emit(held)
                    held = {}
        yield from _emit(held)

    return run


def _emit(held: dict):
    for packed, mine in held.items():
        q = np.frombuffer(packed, "<i8")
        n = [len(s) for s, _ in mine]
        cols = (np.repeat(np.arange(len(q)), n), np.repeat(q, n), np.concatenate([i for _, i in mine]), np.concatenate([s for s, _ in mine]))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols[1:]], ["query_id", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of every query row."""
    rows = quantised(vectors)
    candidates = _packed(rows, ROWS)
    asked = _packed(rows.where(is_query).groupBy("vec_id").agg(F.max("v").alias("v")), QUERIES).toDF("q_ids", "q_lengths", "q_flat")
    # Both sides are blocks of fixed size, and each pair of blocks is the unit of work of an exhaustive search.  Spark
    # broadcasts the queries' blocks while they are below its own threshold and deals pairs of partitions beyond it.
    partial = candidates.crossJoin(asked).mapInArrow(_partial(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def oracle() -> str:
    """The same search in DuckDB's SQL over ``embeddings``."""
    return f"""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, coalesce(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])), 0)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score FROM s QUALIFY rank <= 10"""


ship(__name__)
