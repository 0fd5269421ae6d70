"""Source trees and documents as tables (SC1 to SC4, SC7, SC26, SC31 to SC33, SC35, SC36, SC39, SC40, SC46, SC47)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.functions.scalars import language_of, module_of

SKIP = (".git", ".hg", "node_modules", "__pycache__", "venv", ".venv", "build", "dist", "target", "site-packages")
MARKERS = ("pyproject.toml", "setup.py", "package.json", "go.mod", "Cargo.toml", "pom.xml")
LARGEST = 400_000

#: Calls of each language's standard library that start a process, as callers write them; a bare name counts where no dot or word stands before it.
_SHELL = ("exec", "shell_exec", "system", "passthru", "proc_open", "popen")
_NODE = ("child_process.spawn", "child_process.exec", "child_process.execFile", "child_process.fork", "spawn", "spawnSync", "execSync", "execFile", "execFileSync", "fork", "Bun.spawn")
_JVM = ("ProcessBuilder", "Runtime.getRuntime().exec")
_STARTS = {
    ("py",): ("subprocess.run", "subprocess.Popen", "subprocess.call", "subprocess.check_call", "subprocess.check_output", "subprocess.getoutput", "os.system", "os.popen", "os.execv", "os.execvp", "os.spawnv", "asyncio.create_subprocess_exec", "asyncio.create_subprocess_shell"),
    ("js", "mjs", "ts", "tsx"): _NODE,
    ("rb",): ("system", "spawn", "exec", "IO.popen", "Open3.capture2", "Open3.capture3", "Open3.popen3"),
    ("php",): _SHELL,
    ("lua",): ("os.execute", "io.popen"),
    ("java", "kt", "scala"): _JVM,
    ("cs",): ("Process.Start", "ProcessStartInfo"),
    ("c", "h"): ("system", "popen", "execv", "execvp", "execl", "execlp", "posix_spawn", "CreateProcessA", "CreateProcessW"),
    ("go",): ("exec.Command", "exec.CommandContext", "os.StartProcess"),
    ("rs",): ("Command::new",),
    ("dart",): ("Process.run", "Process.runSync", "Process.start"),
}
#: What starts a process, by extension.
LAUNCH = {e: "|".join(r"(?<![.\w])" + c.replace(".", r"\.").replace("(", r"\(").replace(")", r"\)") + r"\s*\(" for c in calls) for extensions, calls in _STARTS.items() for e in extensions}


def tree(spark: SparkSession, root: str, largest: int | None = None) -> DataFrame:
    """(path, text, size, mtime): all files below a folder; sizes are tested on file metadata, before any is read."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if largest is not None:
        rows = rows.where(F.col("length") <= largest)
    # Spark leaves out empty files, which are modules all the same.
    none = spark.createDataFrame([(p, t) for p, t in _empty(spark, root)], "path string, at long").select("path", F.timestamp_millis("at").alias("modificationTime"), F.lit(0).cast("long").alias("length"), F.lit("").cast("binary").alias("content"))
    rows = rows.select("path", "modificationTime", "length", "content").unionByName(none)
    base = F.lit(root.rstrip("/") + "/")
    path = F.regexp_replace("path", "^file:/*", "/")
    return rows.select(F.when(path.startswith(base), F.substring(path, F.length(base) + 1, F.length(path))).otherwise(path).alias("path"), F.col("content").cast("string").alias("text"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"))


def _empty(spark: SparkSession, root: str) -> list[tuple[str, int]]:
    """(path, mtime) of the empty files below a folder, from the driver's listing."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    out = []
    while found.hasNext():
        f = found.next()
        if f.getLen() == 0:
            out.append((f.getPath().toString(), f.getModificationTime()))
    return out


def visible(files: DataFrame, skip: tuple[str, ...] = SKIP) -> DataFrame:
    """SC1: files outside skipped and hidden folders."""
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    return files.where(~F.exists(folders, lambda x: x.isin(*skip) | x.startswith(".")))


def nested_roots(files: DataFrame) -> DataFrame:
    """SC3, SC4: (prefix) folders below the root that hold a project of their own."""
    name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    return files.where(name.isin(*MARKERS)).select(folder.alias("prefix")).where("prefix != ''").distinct()


def without_nested(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files of this project, skipped nested folders)."""
    roots = nested_roots(files)
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    inside = files.select("path", F.explode(above).alias("prefix")).join(roots, "prefix", "left_semi").select("path").distinct()
    return files.join(inside, "path", "left_anti"), roots


def allowed(files: DataFrame, listed: DataFrame) -> DataFrame:
    """SC2, SC7, SC8: only listed files; an empty list means that nothing is known and keeps all."""
    return files.join(listed.select("path").distinct(), "path", "left_semi") if listed.limit(1).count() else files


def source_files(files: DataFrame, style: str = "python", ref: str | None = None) -> DataFrame:
    """``source_files``: module, path, text without a byte order mark, is_pkg, lang, ref."""
    rows = files.withColumn("lang", language_of("path")).where("lang is not null")
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(module_of("path", style).alias("module"), "path", F.regexp_replace("text", "^﻿", "").alias("text"), (name == "__init__.py").alias("is_pkg"), "lang", F.lit(ref).cast("string").alias("ref"))


def fingerprints(files: DataFrame) -> DataFrame:
    """SC39: (path, mtime, size)."""
    return files.select("path", "mtime", "size")


def changed(now: DataFrame, before: DataFrame) -> DataFrame:
    """SM4: paths whose fingerprint differs, came or went."""
    a, b = now.select("path", F.struct("mtime", "size").alias("n")), before.select("path", F.struct("mtime", "size").alias("b"))
    return a.join(b, "path", "full_outer").where(~F.col("n").eqNullSafe(F.col("b"))).select("path")


def rules_files(listing: DataFrame, name: str = ".boundaries", depth: int = 2) -> DataFrame:
    """SC35: the rules file that counts: at the root, else the least deep."""
    level = F.size(F.split("path", "/")) - 1
    return listing.where((F.element_at(F.split("path", "/"), -1) == name) & (level <= depth)).orderBy(level, "path").limit(1).select("path")


def stray_rules(listing: DataFrame, used: str | None, name: str = ".boundaries") -> DataFrame:
    """SC36: rules files that were not consulted."""
    rows = listing.where(F.element_at(F.split("path", "/"), -1) == name).select("path")
    return rows.where(F.col("path") != used) if used else rows


def launch_sites(files: DataFrame) -> DataFrame:
    """SC40: (path, lang, at, line) where a process is started; files above ``LARGEST`` are not read."""
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    rows = files.where(F.length("text") <= LARGEST).select("path", ext.alias("lang"), F.posexplode(F.split("text", "\n")).alias("i", "line"))
    hit = F.lit(False)
    for lang, pattern in LAUNCH.items():
        hit = F.when(F.col("lang") == lang, F.col("line").rlike(pattern)).otherwise(hit)
    return rows.where(hit).select("path", "lang", (F.col("i") + 1).alias("at"), "line")


def embedded(files: DataFrame, limit: int) -> DataFrame:
    """SC46: each file's text up to a limit and whether it was cut."""
    return files.select("path", F.substring("text", 1, limit).alias("text"), (F.length("text") > limit).alias("cut"))


def notes(files: DataFrame) -> DataFrame:
    """SC31, SC32: markdown notes with their front matter; one without a closed head is broken, not lost."""
    name = F.regexp_extract("path", r"([^/]+)\.[mM][dD]$", 1)
    rows = files.where((name != "") & (F.lower(name) != "memory")).withColumn("t", F.regexp_replace(F.regexp_replace("text", "^﻿", ""), "\r\n", "\n"))
    head = F.regexp_extract("t", r"(?s)^---\n(.*?)\n---\n?", 1)
    broken = F.col("t").startswith("---") & (head == "")
    field = lambda k: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^\s*{k}:\s*(.*)$", 1)), F.lit(""))
    tags = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(field("tags"), F.lit("")), r"[\[\]]", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    body = F.trim(F.when(head != "", F.regexp_replace("t", r"(?s)^---\n.*?\n---\n?", "")).otherwise(F.col("t")))
    return rows.select(F.coalesce(field("name"), name).alias("name"), field("description").alias("description"), field("type").alias("type"), field("scope").alias("scope"), tags.alias("tags"), body.alias("body"), F.col("path").alias("file"), broken.alias("broken")).orderBy("name")


def write_index(found: DataFrame, path: str) -> None:
    """SC33: the index of notes, one line each."""
    found.orderBy("name").select(F.concat(F.lit("- ["), F.col("name"), F.lit("]("), F.col("file"), F.lit(") "), F.coalesce("description", F.lit("")))).coalesce(1).write.mode("overwrite").text(path)


def session_crash(records: DataFrame, session: str) -> DataFrame:
    """SC47: what a session's records say."""
    return records.where(F.col("session_id") == session).select("id", "ts", "language", "exception")
