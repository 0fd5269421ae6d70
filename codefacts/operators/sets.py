"""Differences of shapes and snapshots, fingerprints (ST1 to ST10, GR4, GR7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def delta(now: DataFrame, before: DataFrame, kind: str) -> DataFrame:
    """ST1, ST2: rows only on one side, as (kind, change, ...); columns must agree."""
    cols = now.columns
    label = lambda df, change: df.select(F.lit(kind).alias("kind"), F.lit(change).alias("change"), *cols)
    return label(now.distinct().subtract(before.distinct()), "added").unionByName(label(before.distinct().subtract(now.distinct()), "removed"))


def shape_delta(now: dict[str, DataFrame], before: dict[str, DataFrame] | None) -> DataFrame | None:
    """ST1: the changes of all collections as (kind, change, item); None without a former shape."""
    if before is None:
        return None
    out = None
    for kind, rows in now.items():
        item = lambda df: df.select(F.concat_ws(" -> ", *[F.col(c).cast("string") for c in df.columns]).alias("item"))
        found = delta(item(rows), item(before[kind]), kind)
        out = found if out is None else out.unionByName(found)
    return out


def session_map(now: DataFrame, before: DataFrame | None, kind: str = "edges") -> DataFrame:
    """CH28: a session's map (change, item): whole on the first look, what changed on later ones, and no row in silence."""
    item = F.concat_ws(" -> ", *[F.col(c).cast("string") for c in now.columns]).alias("item")
    if before is None:
        return now.select(F.lit("full").alias("change"), item).distinct()
    return shape_delta({kind: now}, {kind: before}).select("change", "item")


def kept_out(now: DataFrame, before: DataFrame, keys: list[str]) -> DataFrame:
    """GR4: rows whose keys the baseline had not."""
    return now.join(before.select(*keys).distinct(), keys, "left_anti")


def together(a: DataFrame, b: DataFrame) -> DataFrame:
    """ST4: distinct rows of both."""
    return a.unionByName(b).distinct()


def shared(a: DataFrame, b: DataFrame) -> DataFrame:
    """ST6, ST7: rows of both."""
    return a.intersect(b)


def fingerprint(parts: list[Column]) -> Column:
    """ST10: 16 hexadecimal digits of the SHA-256 of sorted arrays, joined by a bar."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.array_join(F.array_sort(p), ",") for p in parts]), 256), 1, 16)


def tree_fingerprint(files: DataFrame) -> DataFrame:
    """XT40: one digest of all (path, text), from per-file digests in order of path."""
    each = files.select("path", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return each.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "h"))), lambda x: F.concat(x["path"], F.lit(":"), x["h"])), "\n"), 256).alias("fingerprint"))
