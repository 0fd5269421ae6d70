"""One query per operator over its whole table, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.llm import chat, lm, mixing, pieces, pii, quality, secrets, simhash, topk, warc
from codefacts.llm.common import table

#: The conversation that op3 adds: control strings inside texts.
ADDED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def model_file() -> str:
    """The public SentencePiece model; another path may be passed to the operator."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = quality.judged(docs, labels, F.col("doc_id").cast("long").alias("doc_id"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return rows.select("kept.doc_id", *[f"m.{c}" for c in names], "base_failed", F.col("kept_by_rules").alias("kept"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal(table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chats(turns.unionByName(spark.createDataFrame(ADDED, "conv_id long, turn long, role string, text string")))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_copies(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long")))


def op6_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secrets(table(spark, sf_dir, "documents"), F.col("doc_id").cast("long"))
    return found.select(F.col("kept").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256", secrets.spelled().alias("spans"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(table(spark, sf_dir, "documents"), model_file(), ids=False)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_pii, op3_chat, op4_simhash, op5_mixing, op6_lm, op7_topk, op8_secrets, op9_pieces, op10_warc)}
ORACLES = {
    "op3_chat": chat.oracle("VALUES " + ", ".join(str(r) for r in ADDED)),
    "op5_mixing": mixing.oracle(),
    "op7_topk": topk.oracle(),
}
