"""Ranked look-ups in notes and symbols (GR30, SF42, TK3, TK4, XT1, XT2, XT9, XT10, XT13, XT14)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.functions.scalars import note_score


def recall(notes: DataFrame, query: str, limit: int = 6) -> DataFrame:
    """TK3: (name, score) of the best notes, ties by name; no hit, no row.  ``notes``: name, meta, body."""
    terms = query.lower().split()
    return notes.select("name", note_score("meta", "body", terms).alias("score")).where("score > 0").orderBy(F.desc("score"), "name").limit(limit)


def tokens(text: str | F.Column) -> F.Column:
    """Distinct words of three characters or more."""
    return F.array_distinct(F.regexp_extract_all(F.col(text) if isinstance(text, str) else text, F.lit(r"[A-Za-z_][A-Za-z0-9_]{2,}"), F.lit(0)))


def related(symbols: DataFrame, degree: DataFrame, asked: DataFrame, limit: int = 8) -> DataFrame:
    """GR30, TK4: symbols whose bare name is a word of the asked text, most connected first."""
    words = asked.select(F.explode(tokens("text")).alias("name")).distinct()
    return symbols.join(words, "name", "left_semi").join(degree, symbols["qual"] == degree["node"], "left").select("qual", F.coalesce("degree", F.lit(0)).cast("long").alias("degree")).orderBy(F.desc("degree"), "qual").limit(limit)


def hook_query(payload: DataFrame) -> DataFrame:
    """XT10: the text of a search hook's JSON; nothing where it is odd."""
    v = lambda k: F.get_json_object("value", f"$.tool_input.{k}")
    return payload.select(F.coalesce(v("pattern"), v("query"), v("glob")).alias("text")).where("text is not null")


def session_notes(notes: DataFrame, project: str) -> DataFrame:
    """XT1: all notes; in full if always valid or of this project, marked if of another."""
    own = (F.col("scope") == f"project:{project}") | F.array_contains("tags", project)
    full = (F.col("scope") == "always") | own
    foreign = F.col("scope").startswith("project:") & ~own
    return notes.select("name", "description", F.when(full, F.col("body")).alias("body"), foreign.alias("foreign")).orderBy("name")


def index_lines(notes: DataFrame) -> DataFrame:
    """XT2: one line a note, and a warning for broken ones."""
    line = F.concat(F.lit("- "), F.col("name"), F.lit(": "), F.coalesce("description", F.lit("")))
    return notes.select("name", line.alias("line"), "broken").orderBy("name")


def value_uses(named: DataFrame, qual: str, limit: int = 6) -> DataFrame:
    """XT9: bodies that name a symbol as a value; a module's own body is marked."""
    return named.where(F.col("qual") == qual).select(F.regexp_replace("body", r"\.<modulo>$", "").alias("body"), F.col("body").endswith(".<modulo>").alias("module_level")).orderBy("body").limit(limit)


def by_file(symbols: DataFrame) -> DataFrame:
    """XT13: symbols of each file by line."""
    return symbols.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("line", "qual", "kind"))).alias("symbols"))


def legend(edges: DataFrame) -> DataFrame:
    """XT14: kinds of edges present."""
    return edges.select("etype").distinct().orderBy("etype")
