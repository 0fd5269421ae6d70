"""Append-only JSON lines: the index, ledgers and archive; corrupt lines are skipped, never fatal (SC12 to SC18, SC38)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codefacts.functions.scalars import headline, moment, slug

INDEX = "id string, ts string, type string, message string, project string, where string, path string"
LEDGER = "cmd string, id string, ts string, project string"


def lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines file in order of appending (``seq``); lines that are no object of the schema are left out."""
    rows = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i")).alias("at"))
    kind = T._parse_datatype_string(schema)
    read = F.from_json("value", kind, {"mode": "PERMISSIVE"})
    good = F.try_parse_json("value").isNotNull() & F.trim("value").startswith("{")
    return rows.where(good).select(F.col("at.i").alias("seq"), read.alias("r")).select("seq", "r.*")


def index(spark: SparkSession, path: str) -> DataFrame:
    """SC12: the capture index."""
    return lines(spark, path, INDEX)


def usages(spark: SparkSession, path: str) -> DataFrame:
    """SC14: the usage ledger; rows without a time zone go."""
    return lines(spark, path, LEDGER).select("seq", "cmd", moment("ts").alias("ts")).where("ts is not null and cmd is not null")


def index_rows(records: DataFrame) -> DataFrame:
    """The index line of each record: message cut at 200, place of its user frame."""
    return records.select("id", "ts", F.col("exception.type").alias("type"), F.substring("exception.message", 1, 200).alias("message"), F.col("process.project").alias("project"), headline("frames", "exception.origen").alias("where"))


def archive(records: DataFrame, root: str) -> None:
    """SC16, SC21: append records by project that the archive does not hold yet, and their index lines."""
    rows = records.withColumn("project_slug", slug("process.project")).dropDuplicates(["project_slug", "id"])
    spark = records.sparkSession
    try:
        known = spark.read.parquet(f"{root}/archive").select("project_slug", "id")
        rows = rows.join(known, ["project_slug", "id"], "left_anti")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("append").partitionBy("project_slug").parquet(f"{root}/archive")


def append(rows: DataFrame, path: str) -> None:
    """SC17, SC18: append to a ledger."""
    rows.write.mode("append").json(path)


def snapshot(rows: dict[str, DataFrame], root: str) -> None:
    """SC38: the snapshot's tables; one is whole once its success mark is there."""
    for name, df in rows.items():
        df.write.mode("overwrite").parquet(f"{root}/{name}")


def load_snapshot(spark: SparkSession, root: str, names: list[str]) -> dict[str, DataFrame] | None:
    """SC38: the tables, or None if any is missing or damaged."""
    try:
        return {n: spark.read.parquet(f"{root}/{n}") for n in names}
    except Exception:  # a damaged snapshot counts as none
        return None
