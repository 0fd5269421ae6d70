"""A project's floor: levels, next step, test command, gates (CH19 to CH22, AG16, XT3 to XT6, XT16 to XT18, SC43, SC44)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Level, order of its phase, and files of which any one meets it.
LEVELS = (
    ("alcance", 0, ("SCOPE.md", "docs/SCOPE.md")),
    ("arquitectura", 1, ("ARCHITECTURE.md", "docs/ARCHITECTURE.md")),
    ("decisiones", 2, ("docs/adr",)),
    ("fronteras", 3, (".boundaries",)),
    ("agentes", 4, ("AGENTS.md", "CLAUDE.md")),
    ("tests", 5, ("tests", "test", "spec")),
    ("puertas", 6, (".pre-commit-config.yaml", ".husky", ".git/hooks/pre-commit")),
    ("ci", 7, (".github/workflows", ".gitlab-ci.yml", "azure-pipelines.yml")),
)
#: Marker, priority and command of a toolchain's tests.
TOOLCHAINS = (
    ("pyproject.toml", 0, "python -m pytest"),
    ("setup.py", 1, "python -m pytest"),
    ("package.json", 2, "npm test"),
    ("go.mod", 3, "go test ./..."),
    ("Cargo.toml", 4, "cargo test"),
    ("pom.xml", 5, "mvn test"),
    ("build.gradle", 6, "gradle test"),
    ("Gemfile", 7, "bundle exec rspec"),
    ("composer.json", 8, "vendor/bin/phpunit"),
)
PENDING = "PENDIENTE"


def levels(listing: DataFrame, rules: tuple = LEVELS) -> DataFrame:
    """CH19, AG16: (level, phase, ok) for a listing (path)."""
    table = listing.sparkSession.createDataFrame([(n, p, f) for n, p, files in rules for f in files], "level string, phase int, file string")
    met = table.join(listing, (F.col("path") == F.col("file")) | F.col("path").startswith(F.concat("file", F.lit("/"))), "left")
    return met.groupBy("level", "phase").agg(F.max(F.col("path").isNotNull()).alias("ok"))


def next_step(found: DataFrame) -> DataFrame:
    """CH19: the first level in order that is not met."""
    return found.where("not ok").orderBy("phase").limit(1).select("level")


def rolled_up(found: DataFrame) -> DataFrame:
    """AG16: met of all."""
    return found.agg(F.concat_ws("/", F.count_if("ok").cast("string"), F.count("*").cast("string")).alias("floor"))


def test_command(listing: DataFrame, table: tuple = TOOLCHAINS) -> DataFrame:
    """CH20, XT22: the command of the first toolchain whose marker is there."""
    t = listing.sparkSession.createDataFrame(list(table), "path string, priority int, command string")
    return t.join(listing.select("path").distinct(), "path", "left_semi").agg(F.min_by("command", "priority").alias("command"))


def runner(files: DataFrame, listing: DataFrame) -> DataFrame:
    """XT22: the command for a list of test files: pytest where all are Python, else that of the toolchain."""
    python = files.agg(F.coalesce(F.every(F.col("path").endswith(".py")), F.lit(False)).alias("python"))
    return python.join(test_command(listing), how="cross").select(F.when(F.col("python"), "python -m pytest").otherwise(F.col("command")).alias("command"))


def first_marker(listing: DataFrame, table: DataFrame) -> DataFrame:
    """XT16: (dir, lang): the language of the first marker (marker, ord, lang) that a folder (dir, name) holds."""
    return listing.join(table, F.col("name") == F.col("marker")).groupBy("dir").agg(F.min_by("lang", "ord").alias("lang"))


def conventions(table: DataFrame) -> DataFrame:
    """XT5: (sort, value) of all languages' suffixes and folders of tests (lang, suffixes, dirs)."""
    return table.select(F.lit("suffix").alias("sort"), F.explode("suffixes").alias("value")).unionByName(table.select(F.lit("dir").alias("sort"), F.explode("dirs").alias("value"))).distinct()


def cascade(selected: DataFrame, expected: DataFrame) -> DataFrame:
    """XT35: (case, ok): as many files selected as expected; running everything passes where no licence to narrow is given."""
    n = selected.groupBy("case").agg(F.count_distinct("file").alias("n"))
    rows = expected.join(n, "case", "left")
    return rows.select("case", ((F.coalesce("n", F.lit(0)) == F.col("size")) | (F.col("run_all") & ~F.col("licensed"))).alias("ok"))


def expected_verdict(runs: DataFrame) -> DataFrame:
    """XT29: (case, verdict): what the steps (array) behind the last ``final`` mark of a recorded run say; the worst of them."""
    back = F.reverse("steps")
    after = F.slice("steps", F.size("steps") - F.array_position(back, "final").cast("int") + 2, F.size("steps"))
    said = F.when(F.array_position(back, "final") > 0, after).otherwise(F.col("steps"))
    return runs.select("case", F.when(F.array_contains(said, "rojo"), "rechazar").when(F.array_contains(said, "duda"), "escalar").when(F.array_contains(said, "verde"), "aceptar").otherwise("sin-objeciones").alias("verdict"))


def gates(listing: DataFrame) -> DataFrame:
    """CH21: decision records and gates that are there."""
    kind = F.when(F.col("path").rlike(r"(^|/)adr/\d+.*\.md$"), "adr").when(F.col("path").rlike(r"(^|/)(\.pre-commit-config\.yaml|\.husky/|hooks/pre-commit$)"), "gate").when(F.col("path").rlike(r"^\.github/workflows/|^\.gitlab-ci\.yml$"), "ci")
    return listing.select("path", kind.alias("kind")).where("kind is not null")


def divergence(documents: DataFrame, detected: DataFrame) -> DataFrame:
    """CH22: test commands that documents (path, text) declare in backquotes but that were not detected."""
    said = documents.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"`((?:python -m pytest|pytest|npm test|go test|cargo test|mvn test|gradle test)[^`]*)`"), F.lit(1))).alias("command"))
    return said.distinct().join(detected.select("command"), "command", "left_anti")


def criterion(documents: DataFrame) -> DataFrame:
    """XT17: the fenced block behind a heading about when a task is done."""
    return documents.select("path", F.regexp_extract("text", r"(?is)#+[^\n]*(?:terminado|done)[^\n]*\n.*?```(?:sh|bash)?\n(.*?)```", 1).alias("command")).where("command != ''")


def pending_sections(documents: DataFrame) -> DataFrame:
    """XT18: documents that still carry the mark."""
    return documents.where(F.col("text").contains(PENDING)).select("path").orderBy("path")


def census(files: DataFrame, read: tuple[str, ...]) -> DataFrame:
    """SC43, XT4: (lang, n) of languages that are there but not read, most first."""
    return files.where(F.col("lang").isNotNull() & ~F.col("lang").isin(*read)).groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang")


def languages_present(files: DataFrame) -> DataFrame:
    """SC44."""
    return files.where("lang is not null").select("lang").distinct()


def limits(present: DataFrame, table: DataFrame) -> DataFrame:
    """XT3: declared limits (lang, ord, limit) of the languages present, each once, as first declared."""
    rows = table.join(present, "lang", "left_semi").groupBy("limit").agg(F.min("ord").alias("ord"))
    return rows.orderBy("ord").select("limit")


def project_root(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """XT6: (path, root): the nearest folder above that is a root."""
    parts = F.split("path", "/")
    up = paths.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("root"))
    order = Window.partitionBy("path").orderBy(F.desc(F.length("root")))
    best = up.join(roots.select("root").distinct(), "root", "left_semi").withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
    return paths.join(best, "path", "left")


def replay(runs: DataFrame) -> DataFrame:
    """AG12, XT30: how many recorded verdicts a replay confirms."""
    return runs.agg(F.count("*").alias("runs"), F.count_if(F.col("expected") == F.col("got")).alias("confirmed"))


def causes(failures: DataFrame) -> DataFrame:
    """XT39: (cause, n, example)."""
    return failures.groupBy("cause").agg(F.count("*").alias("n"), F.min_by("case", "case").alias("example")).orderBy(F.desc("n"), "cause")


def run_statistics(runs: DataFrame) -> DataFrame:
    """SC48: per verdict how many runs and steps."""
    return runs.groupBy("verdict").agg(F.count("*").alias("runs"), F.sum("steps").alias("steps"))


def failure_extract(text: F.Column, lines: int = 15, chars: int = 800) -> F.Column:
    """FX35: the last lines that look like a failure, else the last characters."""
    hit = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"(?i)error|fail|assert|exception|traceback"))
    return F.when(F.size(hit) > 0, F.array_join(F.slice(hit, F.greatest(F.size(hit) - lines + 1, F.lit(1)), lines), "\n")).otherwise(F.substring(text, -chars, chars))
