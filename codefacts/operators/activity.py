"""Parallel lines of work: who touches what, in which order, and what is still to be merged (CH9 to CH15, CH18, CH23, SM7)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codefacts.operators.resolve import to_internal

PRESENCE, CHRONOLOGY = 600, 3600


def crossings(touches: DataFrame, kinds: tuple[str, ...] = ("sucio",)) -> DataFrame:
    """CH9: (node, agents) of nodes that two or more agents are changing; only uncommitted work counts."""
    rows = touches.where(F.col("kind").isin(*kinds)) if kinds else touches
    return rows.groupBy("node").agg(F.array_sort(F.collect_set("agent")).alias("agents")).where(F.size("agents") > 1)


def recent(commits: DataFrame, now: Column | int, window: int = PRESENCE) -> DataFrame:
    """CH11: commits (ts in seconds) within the window."""
    return commits.where(F.col("ts") >= (F.lit(now) if isinstance(now, int) else now) - window)


def newborn(files: DataFrame, modules: DataFrame) -> DataFrame:
    """CH12: touched modules that the graph does not know yet."""
    return files.select("module").distinct().join(modules.select("module"), "module", "left_anti")


def events_of(log: DataFrame, nodes: DataFrame) -> DataFrame:
    """SC29, SC30: commits (agent, sha, ts, path) as events with their nodes; a commit without any node is none."""
    rows = log.join(nodes.select("path", "node"), "path")
    return rows.groupBy("agent", F.col("sha").alias("id"), "ts").agg(F.array_sort(F.collect_set("node")).alias("nodes")).withColumn("kind", F.lit("commit"))


def chronology(events: DataFrame, window: int | None = CHRONOLOGY, most: int | None = 200) -> tuple[DataFrame, DataFrame]:
    """CH14: (ordered events with how many were cut, propagations).

    A propagation is the first event of another agent on a node, at any time
    after one agent's.  Events (ts, agent, id, nodes) are exploded to nodes, so
    the join is by node and each side keeps only an agent's first event there:
    its size is nodes times pairs of agents, not events squared.
    """
    last = events.agg(F.max("ts").alias("_max"))
    rows = events.join(F.broadcast(last))  # one row
    if window is not None:
        rows = rows.where(F.col("ts") >= F.col("_max") - window)
    rows = rows.drop("_max")
    if most is not None:
        n = rows.agg(F.greatest(F.count("*") - most, F.lit(0)).alias("cut"))
        rows = rows.orderBy(F.desc("ts"), F.desc("agent"), F.desc("id")).limit(most).join(F.broadcast(n))
    else:
        rows = rows.withColumn("cut", F.lit(0).cast("long"))
    each = rows.select("ts", "agent", "id", F.explode("nodes").alias("node"))
    return rows.orderBy("ts", "agent", "id"), propagation(each)


def propagation(each: DataFrame) -> DataFrame:
    """WN4: (src, dst, node, ts_src, ts_dst): for each pair of agents and node, the first event of one and the first later one of the other."""
    first = each.groupBy("node", "agent").agg(F.min("ts").alias("ts_src"))  # an agent's later events there are no first ones
    a, b = first.withColumnRenamed("agent", "src"), each.select("node", F.col("agent").alias("dst"), F.col("ts").alias("ts_dst")).distinct()
    return a.join(b, "node").where("src != dst and ts_dst > ts_src").groupBy("src", "dst", "node").agg(F.min("ts_src").alias("ts_src"), F.min("ts_dst").alias("ts_dst"))


def inherited(each: DataFrame, ancestry: DataFrame) -> DataFrame:
    """CH14: propagations with ``inherited``: whether the later agent's history holds the commit of the earlier one.

    ``each``: ts, agent, id, node, kind; ``ancestry``: agent, sha, the commits that
    each line of work descends from.  Two agents who touch a node one after the
    other only met there if the second has the first one's commit; an edit that
    was never committed cannot be inherited, which gives null.
    """
    found = propagation(each)
    first = each.groupBy(F.col("node"), F.col("agent").alias("src")).agg(F.min(F.struct("ts", F.when(F.col("kind") == "commit", F.col("id")).alias("sha")))["sha"].alias("sha"))
    seen = ancestry.select(F.col("agent").alias("dst"), "sha").distinct().withColumn("_has", F.lit(True))
    rows = found.join(first, ["node", "src"], "left").join(seen, ["dst", "sha"], "left")
    return rows.select("src", "dst", "node", "ts_src", "ts_dst", F.when(F.col("sha").isNotNull(), F.coalesce("_has", F.lit(False))).alias("inherited"))


def has_work(hunks: DataFrame, untracked: DataFrame, noise: tuple[str, ...] = ("conftest.py",)) -> DataFrame:
    """XT20: (branch, work): a diff, or an untracked Python file that is no noise.  ``hunks``: branch; ``untracked``: branch, path."""
    new = untracked.where(F.col("path").endswith(".py") & ~F.element_at(F.split("path", "/"), -1).isin(*noise))
    any_ = hunks.select("branch").unionByName(new.select("branch")).distinct().withColumn("work", F.lit(True))
    every = hunks.select("branch").unionByName(untracked.select("branch")).distinct()
    return every.join(any_, "branch", "left").select("branch", F.coalesce("work", F.lit(False)).alias("work"))


def newborn_links(imports: DataFrame, born: DataFrame, modules: DataFrame) -> DataFrame:
    """CH12: (src, dst) imports (module, target) of modules being born to known ones or to each other."""
    every = modules.select("module").unionByName(born.select("module")).distinct()
    raw = imports.join(born.select("module").distinct(), "module", "left_semi").select(F.col("module").alias("src"), "target")
    return to_internal(raw, every).where("module is not null and module != src").select("src", F.col("module").alias("dst")).distinct()


def commits_missing(theirs: DataFrame, mine: DataFrame) -> DataFrame:
    """ST9: their commits (sha) that are not among mine."""
    return theirs.join(mine.select("sha").distinct(), "sha", "left_anti")


def debt(theirs: DataFrame, mine: DataFrame, own: DataFrame, near: DataFrame, now: Column) -> DataFrame:
    """CH15, TK5: others' commits (agent, sha, ts, node) still to be merged that touch my nodes or their neighbours.

    The class is ``mismo-nodo`` if any of the commit's nodes is mine, else ``vecino``; mine first, then the youngest.
    """
    n = own.select("node", F.lit(True).alias("_own")).distinct()
    v = near.select("node", F.lit(True).alias("_near")).distinct()
    rows = commits_missing(theirs, mine).join(n, "node", "left").join(v, "node", "left").where("_own or _near")
    found = rows.groupBy("agent", "sha", "ts").agg(F.max(F.coalesce("_own", F.lit(False))).alias("same"), F.array_sort(F.collect_set("node")).alias("nodes"))
    return found.select("agent", "sha", F.when(F.col("same"), "mismo-nodo").otherwise("vecino").alias("class"), "nodes", (now - F.col("ts")).alias("age")).orderBy(F.col("class") != "mismo-nodo", "age", "sha")


def sync_notice(debts: DataFrame, worktrees: int) -> DataFrame:
    """XT11, XT41: how many commits are pending, of them on my nodes; nothing with fewer than two lines of work."""
    out = debts.agg(F.count("*").alias("pending"), F.count_if(F.col("class") == "mismo-nodo").alias("clashes"))
    return out if worktrees >= 2 else out.limit(0)


def differences(before: DataFrame, now: DataFrame) -> DataFrame:
    """CH23: (agent, node, event) between two snapshots (agent, node, writes, born)."""
    a = before.select("agent", "node", F.col("writes").alias("w0"), F.lit(True).alias("was"))
    b = now.select("agent", "node", F.col("writes").alias("w1"), "born", F.lit(True).alias("is"))
    rows = a.join(b, ["agent", "node"], "full_outer")
    event = F.when(F.col("was").isNull(), F.when(F.col("born"), "crea").otherwise("toca")).when(F.col("is").isNull(), "suelta").when(F.col("w1") > F.col("w0"), "escribe")
    moves = rows.select("agent", "node", event.alias("event")).where("event is not null")
    people = before.select("agent").distinct().withColumn("was", F.lit(True)).join(now.select("agent").distinct().withColumn("is", F.lit(True)), "agent", "full_outer")
    come = people.select("agent", F.lit(None).cast("string").alias("node"), F.when(F.col("was").isNull(), "aparece").when(F.col("is").isNull(), "se-va").alias("event")).where("event is not null")
    met = crossings(now.withColumn("kind", F.lit("sucio"))).join(crossings(before.withColumn("kind", F.lit("sucio"))).select("node"), "node", "left_anti")
    return moves.unionByName(come).unionByName(met.select(F.array_join("agents", "+").alias("agent"), "node", F.lit("cruce").alias("event")))


def collisions(new_files: DataFrame) -> DataFrame:
    """CH18: paths that branches add with different bytes."""
    return new_files.groupBy("path").agg(F.count_distinct(F.sha2(F.col("body").cast("binary"), 256)).alias("bodies"), F.count_distinct("branch").alias("branches")).where("bodies > 1")


def verdicts(runs: DataFrame) -> DataFrame:
    """AG14, AG15, CH17, CH25: (branch verdicts, union) to the worst verdict and whether the union rescues or breaks.

    ``runs``: case, branch (null for the union), verdict (0 green, higher is worse).
    """
    alone = F.col("branch").isNotNull()
    rows = runs.groupBy("case").agg(
        F.max("verdict").alias("worst"),
        F.every(F.when(alone, F.col("verdict") == 0)).alias("all_green"),
        F.some(F.when(alone, F.col("verdict") > 0)).alias("any_red"),
        F.max(F.when(~alone, F.col("verdict"))).alias("union"),
    )
    return rows.select("case", "worst", F.coalesce(F.col("any_red") & (F.col("union") == 0), F.lit(False)).alias("rescued"), F.coalesce(F.col("all_green") & (F.col("union") > 0), F.lit(False)).alias("clash"))
