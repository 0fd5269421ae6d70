"""Helpers shared by the corpus operators."""

from __future__ import annotations

import gc
import sys
import tempfile

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space and U+0009 to U+000D, as a Java and Python character class body.
BLANK = r"\x20\x09-\x0D"


def ship(name: str) -> None:
    """Send this module's functions to the executors by value, so that they need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share (``spark.checkpoint.dir``).

    Only where that setting is absent and everything runs in one process, as in
    tests, a local folder is made and set as the checkpoint folder of the
    session's context; on a cluster its absence is an error.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir")
    if not found:
        known = sc._jsc.sc().getCheckpointDir()
        if known.isEmpty() and (not sc.master.startswith("local") or sc.master.startswith("local-cluster")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = known.get() if known.isDefined() else "file://" + tempfile.mkdtemp(prefix="codefacts-checkpoint-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` to the shared folder once and read it from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free(spark: SparkSession) -> None:
    """Have Spark delete the files of shuffles that nothing refers to any more: it does so when the driver collects garbage, which one with memory to spare puts off."""
    gc.collect()
    spark._jvm.System.gc()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffles(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    """Number of words of a text, null counting as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{BLANK}]+")), F.lit(0)).cast("long")


def words_of(text: Column | str) -> Column:
    """Array of a text's words.

    A blank at either end leaves an empty piece, which is dropped by its place;
    trimming by a pattern with ``$`` would also match before a last line
    separator that is no blank here (U+0085, U+2028, U+2029).
    """
    pieces = F.split(text, f"[{BLANK}]+")
    first, last = (F.get(pieces, F.lit(0)) == "").cast("int"), (F.get(pieces, F.size(pieces) - 1) == "").cast("int")
    return F.slice(pieces, first + 1, F.greatest(F.lit(0), F.size(pieces) - first - last))


ship(__name__)
