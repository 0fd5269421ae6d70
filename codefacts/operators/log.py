"""The error log: index, ledgers, signatures, life cycle (SC12 to SC15, SC19, AG1 to AG5, CH6 to CH8, WN1 to WN5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codefacts.functions.scalars import ephemeral, exploration, moment, signature_file
from codefacts.operators.spans import innermost
from codefacts.session import cut


def newest(index: DataFrame, limit: int | None = None, project: str | None = None, since: Column | None = None) -> DataFrame:
    """SC12: latest appended first; with ``since``, entries without a readable stamp go too."""
    rows = index
    if project is not None:
        rows = rows.where(F.col("project") == project)
    if since is not None:
        rows = rows.where(moment("ts") >= since)
    rows = rows.orderBy(F.desc("seq"))
    return rows.limit(limit) if limit is not None else rows


def load(index: DataFrame, prefix: str | None = None) -> DataFrame:
    """SC13: the latest record, or the latest whose id begins so."""
    rows = index if prefix is None else index.where(F.col("id").startswith(prefix))
    return rows.orderBy(F.desc("seq")).limit(1)


def signatures(index: DataFrame, more: list[str] = ()) -> DataFrame:
    """AG1, WN1: one row per (type, where), nulls grouped: count, what was last and when it was first, in order of appending."""
    extra = [F.max_by(c, "seq").alias(c) for c in more]
    return index.groupBy("type", "where").agg(
        F.count("*").alias("count"), F.max_by("ts", "seq").alias("last_ts"), F.max_by("id", "seq").alias("last_id"), F.max_by("message", "seq").alias("last_message"), F.min_by("ts", "seq").alias("first_ts"), *extra
    )


def ranked(found: DataFrame) -> DataFrame:
    """TK7: most frequent first, then latest; a missing stamp is the earliest."""
    return found.orderBy(F.desc("count"), F.desc(F.coalesce(F.col("last_ts").cast("string"), F.lit(""))), "type", "where")


def read_stats(captures: DataFrame, reads: DataFrame) -> DataFrame:
    """AG2: distinct captures, distinct ones read, openings of known ones."""
    known = captures.select("id").where("id is not null").distinct()
    opened = reads.join(known, "id", "left_semi").agg(F.count_distinct("id").alias("read"), F.count("*").alias("openings"))
    return known.agg(F.count("*").alias("captures")).join(opened)


def read_ids(reads: DataFrame) -> DataFrame:
    """SC15."""
    return reads.select("id").where("id is not null").distinct()


def usage(ledger: DataFrame, now: Column, days: int) -> DataFrame:
    """AG3: how often each command ran in the last days; ``ts`` is a timestamp, null where unreadable."""
    return ledger.where(F.col("ts") >= now - F.expr(f"interval {days} days")).groupBy("cmd").agg(F.count("*").alias("n"))


def compacted(ledger: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """SC19: what a compaction keeps."""
    return ledger.where(F.col("ts") >= now - F.expr(f"interval {days} days"))


def exploration_split(index: DataFrame, reads: DataFrame) -> DataFrame:
    """AG4: captures and captures read, of the project and of exploration."""
    rows = index.join(read_ids(reads).withColumn("_read", F.lit(True)), "id", "left")
    return rows.groupBy(exploration("where").alias("exploration")).agg(F.count("*").alias("captures"), F.count("_read").alias("read"))


def unread(captures: DataFrame, reads: DataFrame) -> DataFrame:
    """Captures that nobody opened."""
    return captures.join(read_ids(reads), "id", "left_anti")


def last_commits(commits: DataFrame, key: str = "file") -> DataFrame:
    """CH7, WN2: the last commit of each file, in one pass over the log."""
    return commits.groupBy(key).agg(F.max_by("sha", F.struct("ts", "sha")).alias("commit"), F.max("ts").alias("commit_ts"))


def error_cycle(captures: DataFrame, commits: DataFrame, reads: DataFrame, now: Column, keys: list[str] = ("type", "where"), file: str = "file") -> DataFrame:
    """CH6, WN3: each signature's state.

    ``captures``: keys, file, id, ts (timestamp or null), seq; ``commits``: file, commit, commit_ts; ``reads``: id.
    A signature is touched if its file's last commit is later than its first
    occurrence, and silent if nothing came after that commit.
    """
    rows = captures.join(read_ids(reads).withColumn("_read", F.lit(True)), "id", "left").join(commits.select(F.col(file).alias("_f"), "commit", "commit_ts"), F.col(file) == F.col("_f"), "left")
    found = rows.groupBy(*keys).agg(
        F.count("*").alias("count"),
        F.max_by("ts", "seq").alias("last_ts"),
        F.max_by("id", "seq").alias("last_id"),
        F.max(F.coalesce("_read", F.lit(False))).alias("was_read"),
        F.min("ts").alias("first_ts"),
        F.max("commit").alias("commit"),
        F.max("commit_ts").alias("commit_ts"),
        F.count_if(F.col("ts") > F.col("commit_ts")).alias("after"),
    )
    touched = F.coalesce(F.col("commit_ts") > F.col("first_ts"), F.lit(False))
    again = F.when(touched, F.col("after")).otherwise(0).cast("long")
    state = F.when(touched & (again == 0), "en-silencio").when(touched, "intervenida").when(F.col("was_read"), "leida").otherwise("capturada")
    silent = F.when(touched & (again == 0), F.greatest(F.lit(0), F.floor((F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("commit_ts").cast("timestamp"))) / 86400)))
    return found.select(*keys, "count", "last_ts", "last_id", "was_read", F.when(touched, F.col("commit")).alias("commit"), again.alias("reappearances"), state.alias("state"), silent.cast("long").alias("silent_days"))


def funnel(cycle: DataFrame) -> DataFrame:
    """AG5: captured, read, touched, silent."""
    return cycle.agg(F.count("*").alias("captured"), F.count_if("was_read").alias("read"), F.count("commit").alias("touched"), F.count_if(F.col("state") == "en-silencio").alias("silent"))


def pending(cycle: DataFrame, controlled: DataFrame | None = None, keys: list[str] = ("type", "where")) -> DataFrame:
    """The work queue: all signatures but the silent ones; keys are compared with nulls equal."""
    silent = (cycle if controlled is None else controlled).where("state = 'en-silencio'").select(*[F.col(k).alias(f"_{k}") for k in keys]).distinct()
    same = None
    for k in keys:
        one = F.col(k).eqNullSafe(F.col(f"_{k}"))
        same = one if same is None else same & one
    return cycle.join(silent, same, "left_anti")


def node_state(cycle: DataFrame, node: str = "node") -> DataFrame:
    """AG7: per node the least settled state of its signatures."""
    rank = F.when(F.col("state") == "capturada", 0).when(F.col("state") == "leida", 1).when(F.col("state") == "intervenida", 2).otherwise(3)
    return cycle.groupBy(node).agg(F.min(F.struct(rank.alias("r"), "state"))["state"].alias("state"))


def _moved(dirty: DataFrame, commits: DataFrame, rows: DataFrame) -> DataFrame:
    """``rows`` (file, ts, ...) with ``moved``: not committed yet, the later commit, or null."""
    d = dirty.select("file").distinct().withColumn("_dirty", F.lit(True))
    found = rows.join(d, "file", "left").join(commits.select("file", "commit", "commit_ts"), "file", "left")
    return found.select(*rows.columns, F.when(F.col("_dirty"), "sin-commitear").when(F.col("commit_ts") > F.col("ts"), F.col("commit")).alias("moved"))


def moved_after(dirty: DataFrame, commits: DataFrame, captures: DataFrame) -> DataFrame:
    """CH8: per capture (id, file, ts): not committed yet, the later commit, or null."""
    return _moved(dirty, commits, captures).select("id", "file", "moved")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], ts: str, values: list[str], order: list[str] = ()) -> DataFrame:
    """As-of join: each left row with the latest right row of its keys at or before it.

    Both sides go through one sort per key: right rows fill down over left ones,
    so nothing is multiplied.  ``order`` breaks ties on the right.
    """
    a = left.select(*left.columns, F.lit(1).alias("_side"), F.lit(None).cast("long").alias("_seq"), *[F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values])
    b = right.select(*[F.col(c) if c in (*keys, ts) else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns], F.lit(0).alias("_side"), (F.col(order[0]) if order else F.lit(0)).cast("long").alias("_seq"), *[F.col(v).alias(f"_{v}") for v in values])
    over = Window.partitionBy(*keys).orderBy(ts, "_side", "_seq").rowsBetween(Window.unboundedPreceding, 0)
    row = F.last(F.when(F.col("_side") == 0, F.struct(*[f"_{v}" for v in values])), ignorenulls=True).over(over)
    return a.unionByName(b).withColumn("_last", row).where("_side = 1").select(*left.columns, *[F.col(f"_last._{v}").alias(f"last_{v}") for v in values])


def first_per(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """WN4: the first row of each key."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")


def tail(rows: DataFrame, order: list[str], keep: int) -> DataFrame:
    """WN5, WN11, SC41: the last ``keep`` rows by the given columns, in that order, each with how many were cut."""
    n = rows.agg(F.greatest(F.count("*") - keep, F.lit(0)).alias("cut"))
    return rows.orderBy(*[F.desc(c) for c in order]).limit(keep).join(F.broadcast(n), how="cross").orderBy(*order)  # one row


def capped(rows: DataFrame, order: list[str], text: str, keep: int) -> DataFrame:
    """TK8: the first ``keep`` texts in order, and one that says how many more there are."""
    first = rows.orderBy(*order).limit(keep).select(text)
    return first.unionByName(rows.agg(F.count("*").alias("n")).where(F.col("n") > keep).select(F.concat(F.lit("+"), (F.col("n") - keep).cast("string"), F.lit(" more")).alias(text)))


def node_of(file: Column | str, root: Column | str) -> Column:
    """The dotted module that a file of any extension is, below a root; null outside it."""
    f = F.regexp_replace(F.col(file) if isinstance(file, str) else file, r"\\", "/")
    base = F.lit(root) if isinstance(root, str) else root
    rel = F.when(f.startswith("/"), F.when(f.startswith(F.concat(base, F.lit("/"))), F.substring(f, F.length(base) + 2, F.length(f)))).otherwise(f)
    rel = F.regexp_replace(F.when(~rel.startswith(".."), rel), r"^(\./)+|^src/", "")
    rel = F.regexp_replace(F.regexp_replace(rel, r"(^|/)__init__\.py$", ""), r"\.[^./]*$", "")
    return F.nullif(F.regexp_replace(rel, "/", "."), F.lit(""))


def captures_with_node(index: DataFrame, records: DataFrame, modules: DataFrame, reads: DataFrame, project: str, keep: int = 10) -> DataFrame:
    """CH29: (id, ts, type, where, node, read) of a project's latest captures.

    The node is the module of the signature's file, else that of the first own
    frame from the innermost that is a module, else empty.  ``index``: seq, id,
    ts, type, where, project; ``records``: id, frames (file, is_library).
    """
    rows = newest(index.where(~ephemeral("where")), keep, project)
    known = modules.select(F.col("module").alias("_m")).distinct()
    rows = rows.withColumn("_n", node_of(signature_file("where"), project)).join(known, F.col("_n") == F.col("_m"), "left")
    deep = rows.where("_m is null").select("id").join(records.select("id", F.posexplode(F.reverse("frames")).alias("at", "f")), "id").where(~F.coalesce("f.is_library", F.lit(False)))
    deep = deep.withColumn("_n", node_of(F.col("f.file"), project)).join(known, F.col("_n") == F.col("_m")).groupBy("id").agg(F.min_by("_m", "at").alias("_deep"))
    out = rows.join(deep, "id", "left").join(read_ids(reads).withColumn("_read", F.lit(True)), "id", "left")
    return out.select("id", "ts", F.coalesce("type", F.lit("?")).alias("type"), "where", F.coalesce("_m", "_deep", F.lit("")).alias("node"), F.coalesce("_read", F.lit(False)).alias("read"))


def crash_anchor(records: DataFrame, symbols: DataFrame, calls: DataFrame, dirty: DataFrame, commits: DataFrame, project: str) -> DataFrame:
    """GR41: (id, site, node, callers, changed): the symbol that holds a crash's innermost own frame, who calls it, and whether its file changed since.

    ``records``: id, ts, frames (file, line, is_library); ``symbols``: qual, file,
    line, end.  A record is left out without a frame below the project, or if it
    has neither a symbol nor a change.
    """
    own = F.get(F.filter(F.reverse("frames"), lambda f: ~F.coalesce(f["is_library"], F.lit(False)) & f["file"].isNotNull() & f["line"].isNotNull()), F.lit(0))
    base = F.lit(project + "/")
    rows = records.select("id", "ts", own.alias("f")).where(F.col("f.file").startswith(base)).select("id", "ts", F.substring("f.file", len(project) + 2, 100000).alias("path"), F.col("f.line").alias("at"))
    places = cut(rows.select("path", "at").distinct())
    held = cut(innermost(places, symbols.select("qual", "file", "line", "end"), ["path", "at"]).select("path", "at", "line", "end", F.col("qual").alias("node")))
    calls = calls.select(F.col("src").alias("caller"), F.col("dst").alias("node")).join(held.select("node").distinct(), "node", "left_semi")
    into = calls.distinct().groupBy("node").agg(F.array_sort(F.collect_set("caller")).alias("callers"))
    found = F.struct(-F.col("line").cast("long"), "end", "node", F.coalesce("callers", F.array().cast("array<string>")).alias("callers"))
    held = held.join(into, "node", "left").select(F.col("path").alias("_p"), F.col("at").alias("_l"), found.alias("_held"))
    rows = rows.join(held, (F.col("path") == F.col("_p")) & (F.col("at") == F.col("_l")), "left").drop("_p", "_l")
    # the records of an id share the innermost symbol that one of them meets
    first = F.when(F.col("id").isNotNull(), F.min("_held").over(Window.partitionBy("id")))
    out = _moved(dirty, commits, rows.withColumn("_held", first).withColumnRenamed("path", "file")).withColumnRenamed("file", "path")
    out = out.withColumn("node", F.col("_held.node")).withColumn("callers", F.col("_held.callers")).withColumnRenamed("moved", "changed").where("node is not null or changed is not null")
    return out.select("id", F.concat_ws(":", "path", F.col("at").cast("string")).alias("site"), "node", F.coalesce("callers", F.array().cast("array<string>")).alias("callers"), "changed")


def since(index: DataFrame, start: Column, keep: int = 50) -> DataFrame:
    """XT25: the last captures from a moment on; ``ts`` is a timestamp."""
    return index.where(F.col("ts") >= start).orderBy(F.desc("seq")).limit(keep)


def ladder_state(texts: DataFrame, steps: int = 4, width: int = 120) -> DataFrame:
    """SC42: (path, verdict, step, text) of the last steps in a run's state (path, value), texts cut; damaged files have none."""
    kind = "struct<verdict:string,steps:array<struct<name:string,text:string>>>"
    rows = texts.select("path", F.from_json("value", kind).alias("s")).where("s is not null and s.steps is not null")
    last = F.slice("s.steps", F.greatest(F.size("s.steps") - steps + 1, F.lit(1)), steps)
    return rows.select("path", F.col("s.verdict").alias("verdict"), F.posexplode(last).alias("step", "x")).select("path", "verdict", "step", F.col("x.name").alias("name"), F.substring("x.text", 1, width).alias("text"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    """AG6: how many rows of each value."""
    return rows.groupBy(column).agg(F.count("*").alias("n"))


def projects(index: DataFrame) -> DataFrame:
    """XT8: the index of real files only."""
    return index.where(~ephemeral("where"))
