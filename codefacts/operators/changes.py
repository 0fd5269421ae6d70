"""Diffs and what they add or weaken (SC22 to SC24, SC27, CH1 to CH5, AG8, WN6, WN7, WN10, XT23)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codefacts.functions import patterns as P
from codefacts.functions.scalars import breaks_calls, compares, is_test_file, language_of, matches, module_of, nullable


def lines_of(diffs: DataFrame) -> DataFrame:
    """(diff, ord, line) of diff texts (diff, text)."""
    return diffs.select("diff", F.posexplode(F.split("text", "\n")).alias("ord", "line"))


def filled(lines: DataFrame) -> DataFrame:
    """WN6, SC24: each line with the file, hunk and function it stands under.

    A header is told from content by standing before the first hunk of its file.
    """
    by = Window.partitionBy("diff").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    x = F.col("line")
    rows = lines.withColumn("_file", F.sum(F.when(x.startswith("diff --git "), 1).otherwise(0)).over(by))
    part = Window.partitionBy("diff", "_file").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("section", F.sum(F.when(x.rlike(r"^@@ -\d+"), 1).otherwise(0)).over(part))
    head = F.col("section") == 0
    target = lambda mark: F.when(head & x.startswith(mark), F.regexp_replace(F.substring(x, 5, 100000), r"^[ab]/|\t.*$", ""))
    last = lambda c: F.last(c, ignorenulls=True).over(part)
    whole = Window.partitionBy("diff", "_file")
    rows = rows.withColumn("old", F.max(target("--- ")).over(whole)).withColumn("new", F.max(target("+++ ")).over(whole))
    named = F.max(F.when(head & x.startswith("diff --git "), F.regexp_extract(x, r" b/(.*)$", 1))).over(whole)
    source = F.max(F.when(head & x.startswith("rename from "), F.substring(x, 13, 100000))).over(whole)
    goal = F.max(F.when(head & x.startswith("rename to "), F.substring(x, 11, 100000))).over(whole)
    rows = rows.withColumn("rename_from", source).withColumn("rename_to", goal)
    rows = rows.withColumn("path", F.coalesce(F.when(F.col("new") != "/dev/null", F.col("new")), F.when(F.col("old") != "/dev/null", F.col("old")), named))
    rows = rows.withColumn("deleted", (F.col("new") == "/dev/null") | F.coalesce(F.max(F.when(head & x.startswith("deleted file"), True)).over(whole), F.lit(False)))
    rows = rows.withColumn("func", last(F.when(x.rlike(r"^@@ -\d+"), F.regexp_extract(x, r"^@@ -\d+(?:,\d+)? \+\d+(?:,\d+)? @@\s*(.*)$", 1))))
    sign = F.when((F.col("section") > 0) & x.startswith("+"), "+").when((F.col("section") > 0) & x.startswith("-"), "-")
    return rows.withColumn("sign", sign).withColumn("body", F.when(F.col("sign").isNotNull(), F.substring(x, 2, 1000000))).where("_file > 0")


def hunks(diffs: DataFrame) -> DataFrame:
    """SC22: (diff, path, start, stop) of source files; a hunk that only deletes touches its point."""
    rows = filled(lines_of(diffs)).where(F.col("line").rlike(r"^@@ -\d+") & ~F.coalesce(F.col("new") == "/dev/null", F.lit(False)))
    start = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+(\d+)", 1).cast("int")
    n = F.regexp_extract("line", r"^@@ -\d+(?:,\d+)? \+\d+,(\d+)", 1)
    count = F.when(n == "", 1).otherwise(n.try_cast("int"))
    return rows.where(language_of("path").isNotNull()).select("diff", "path", start.alias("start"), F.greatest(start, start + count - 1).alias("stop"), count.alias("n"))


def added_lines(diffs: DataFrame) -> DataFrame:
    """XT23: (diff, path, at) of every added line; none for a hunk that only deletes."""
    return hunks(diffs).where("n > 0").select("diff", "path", F.explode(F.sequence("start", "stop")).alias("at"))


def porcelain(lines: DataFrame) -> DataFrame:
    """SC27, XT21: (path, state) of status lines; deletions go, a rename is its target."""
    state = F.substring("line", 1, 2)
    path = F.regexp_replace(F.element_at(F.split(F.substring("line", 4, 100000), " -> "), -1), '^"|"$', "")
    return lines.where(F.length("line") > 3).select(path.alias("path"), state.alias("state")).where(~F.col("state").contains("D"))


def test_lines(diffs: DataFrame) -> DataFrame:
    """SC23: changed lines of test files (diff, path, section, func, sign, body, ord, deleted, renamed_to)."""
    rows = filled(lines_of(diffs))
    origin = F.coalesce("rename_from", "path")
    out = F.when(F.col("rename_to").isNotNull() & is_test_file("rename_from") & ~is_test_file("rename_to"), F.col("rename_to"))
    path = F.when(out.isNotNull(), F.col("rename_from")).otherwise(F.col("path"))
    return rows.where(is_test_file(origin) | is_test_file("path")).select("diff", path.alias("path"), "section", "func", "sign", "body", "ord", "deleted", out.alias("renamed_to"))


def marked(lines: DataFrame) -> DataFrame:
    """Each changed line with what its code holds, and CH3/WN7: whether an added line follows a new test's definition in its section."""
    rows = (
        lines.withColumn("is_def", matches("body", P.TEST_DEF))
        .withColumn("is_assert", matches("body", P.ASSERTION))
        .withColumn("is_compare", compares("body"))
        .withColumn("is_skip", matches("body", P.SKIP))
        .withColumn("is_weak", matches("body", P.WEAKENER))
    )
    by = Window.partitionBy("diff", "path", "section").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("in_new_test", F.coalesce(F.max(F.when(F.col("sign") == "+", F.col("is_def"))).over(by), F.lit(False)))


def test_signals(lines: DataFrame) -> DataFrame:
    """CH2, AG8: (diff, path, signal, at, n, evidence) from test files' changed lines."""
    rows = marked(lines)
    plus, minus = F.col("sign") == "+", F.col("sign") == "-"
    few = lambda c: F.transform(F.slice(F.array_sort(F.collect_list(F.when(c, F.struct("ord", F.trim("body").alias("b"))))), 1, 3), lambda x: x["b"])
    whole = rows.groupBy("diff", "path").agg(
        F.max("renamed_to").alias("renamed_to"),
        F.max("deleted").alias("deleted"),
        F.count_if(minus & F.col("is_def")).alias("defs_gone"),
        F.count_if(plus & F.col("is_def")).alias("defs_new"),
        F.count_if(plus & F.col("is_skip")).alias("skips"),
        F.count_if(plus & F.col("is_weak")).alias("weak"),
        few(minus & F.col("is_def")).alias("e_defs"),
        few(plus & F.col("is_skip")).alias("e_skips"),
        few(plus & F.col("is_weak")).alias("e_weak"),
    )
    none = F.array().cast("array<string>")
    file = (
        F.when(F.col("renamed_to").isNotNull(), F.struct(F.lit("TEST_FILE_RENAMED_OUT").alias("signal"), F.lit(1).cast("long").alias("n"), none.alias("evidence")))
        .when(F.col("deleted"), F.struct(F.lit("TEST_FILE_DELETED").alias("signal"), F.col("defs_gone").alias("n"), F.col("e_defs").alias("evidence")))
        .when(F.col("defs_gone") > F.col("defs_new"), F.struct(F.lit("TEST_REMOVED").alias("signal"), (F.col("defs_gone") - F.col("defs_new")).alias("n"), F.col("e_defs").alias("evidence")))
    )
    skip = F.when(F.col("skips") > 0, F.struct(F.lit("SKIP_ADDED").alias("signal"), F.col("skips").alias("n"), F.col("e_skips").alias("evidence")))
    weak = F.when(F.col("weak") > 0, F.struct(F.lit("WEAKENER_ADDED").alias("signal"), F.col("weak").alias("n"), F.col("e_weak").alias("evidence")))
    files = whole.select("diff", "path", F.explode(F.array_compact(F.array(file, skip, weak))).alias("s")).select("diff", "path", "s.signal", F.lit("").alias("at"), "s.n", "s.evidence")
    gone, came = minus & F.col("is_assert"), plus & F.col("is_assert") & ~F.col("in_new_test")
    part = rows.where("section > 0 and not deleted").groupBy("diff", "path", "section").agg(
        F.max("func").alias("func"),
        F.count_if(gone).alias("gone"),
        F.count_if(came).alias("came"),
        F.count_if(gone & F.col("is_compare")).alias("gone_cmp"),
        F.count_if(came & F.col("is_compare")).alias("came_cmp"),
        few(gone & F.col("is_compare")).alias("e_cmp"),
        few(gone).alias("e_gone"),
    )
    where = F.when(F.coalesce("func", F.lit("")) == "", "nivel de modulo").otherwise(F.col("func"))
    sort = F.when(F.col("gone") > F.col("came"), F.struct(F.lit("ASSERT_REMOVED").alias("signal"), (F.col("gone") - F.col("came")).alias("n"), F.col("e_gone").alias("evidence"))).when(
        F.col("gone_cmp") > F.col("came_cmp"), F.struct(F.lit("ASSERT_WEAKENED").alias("signal"), (F.col("gone_cmp") - F.col("came_cmp")).alias("n"), F.col("e_cmp").alias("evidence"))
    )
    parts = part.withColumn("s", sort).where("s is not null").select("diff", "path", "s.signal", where.alias("at"), "s.n", "s.evidence")
    return files.unionByName(parts)


def stale_signatures(now: DataFrame, before: DataFrame, calls: DataFrame, touched: DataFrame) -> DataFrame:
    """CH4: (qual, old, new, callers): a signature that breaks calls, of which no caller was touched."""
    changed = now.where("kind in ('function', 'method')").select("qual", F.col("sig").alias("new")).join(before.select("qual", F.col("sig").alias("old")), "qual").where("new != old").where(breaks_calls("old", "new"))
    by = changed.join(calls.select(F.col("dst").alias("qual"), F.col("src").alias("caller")).distinct(), "qual").join(touched.select(F.col("qual").alias("caller"), F.lit(True).alias("hit")), "caller", "left")
    return by.groupBy("qual", "old", "new").agg(F.array_sort(F.collect_set("caller")).alias("callers"), F.max(F.coalesce("hit", F.lit(False))).alias("any_hit")).where("not any_hit").drop("any_hit")


def new_lines(now: DataFrame, before: DataFrame, key: str, text: str, line: str) -> DataFrame:
    """WN10, ST8: rows of ``now`` beyond the number of equal texts in ``before``, by key; of equal ones the later lines are new."""
    had = before.groupBy(F.col(key).alias("_k"), F.col(text).alias("_t")).agg(F.count("*").alias("_n"))
    rows = now.withColumn("_r", F.row_number().over(Window.partitionBy(key, text).orderBy(line)))
    return rows.join(had, F.col(key).eqNullSafe(F.col("_k")) & F.col(text).eqNullSafe(F.col("_t")), "left").where(F.col("_r") > F.coalesce("_n", F.lit(0))).drop("_r", "_n", "_k", "_t")


GROWTH = 30


def fact_delta(now: DataFrame, before: DataFrame, growth: int = GROWTH) -> DataFrame:
    """CH5, AG10: (category, path, name, line, text) that a change added.

    ``now`` and ``before`` are code facts (path, fact, name, line, end, text).
    """
    texts = lambda t, fact: t.where(F.col("fact") == fact).select("path", "name", "line", "end", "text")
    out = None
    for fact in ("silencio", "amplio", "pendiente"):
        found = new_lines(texts(now, fact), texts(before, fact), "path", "text", "line").select(F.lit(fact).alias("category"), "path", "name", "line", "text")
        out = found if out is None else out.unionByName(found)
    gone = new_lines(texts(before, "guarda"), texts(now, "guarda"), "path", "text", "line").join(now.select("path").distinct(), "path", "left_semi").select(F.lit("guarda-quitada").alias("category"), "path", "name", "line", "text")
    size = lambda t: texts(t, "cuerpo").groupBy("path", "name").agg(F.max_by(F.col("end") - F.col("line") + 1, "line").alias("size"), F.max("line").alias("line"))
    a, b = size(now), size(before).select("path", "name", F.col("size").alias("was"))
    grown = a.join(b, ["path", "name"], "left").withColumn("by", F.col("size") - F.coalesce("was", F.lit(0))).where(F.col("by") >= growth).select(F.lit("cuerpo-crecido").alias("category"), "path", "name", "line", F.col("by").cast("string").alias("text"))
    kind = lambda t: texts(t, "retorno").groupBy("path", "name").agg(F.max_by("text", "line").alias("text"), F.max("line").alias("line"))
    r = kind(now).join(kind(before).select("path", "name", F.col("text").alias("was")), ["path", "name"]).where(nullable("text") & ~nullable("was"))
    loose = r.select(F.lit("retorno-nulo").alias("category"), "path", "name", "line", "text")
    return out.unionByName(gone).unionByName(grown).unionByName(loose)


def grown(delta: DataFrame) -> DataFrame:
    """TK6: bodies that grew, most first."""
    return delta.where("category = 'cuerpo-crecido'").select("path", "name", F.col("text").cast("int").alias("by")).orderBy(F.desc("by"), "path", "name")


def touched_modules(status: DataFrame, modules: DataFrame) -> DataFrame:
    """XT12, XT26: modules of the Python files that a status (path) lists, untracked ones included, as far as the graph knows them."""
    own = status.where(F.col("path").endswith(".py")).select(module_of("path").alias("module")).distinct()
    return own.join(modules.select("module").distinct(), "module", "left_semi")


def base_symbols(symbols: DataFrame, paths: DataFrame) -> DataFrame:
    """XT27: symbols (qual, file) that a former state had in some files."""
    return symbols.join(paths.select(F.col("path").alias("file")).distinct(), "file", "left_semi").select("qual", "file")


def signature_changes(now: DataFrame, before: DataFrame, limit: int = 20) -> DataFrame:
    """CH13, XT24: (qual, old, new, sort) of a full outer comparison, in order, cut at ``limit``."""
    rows = now.select("qual", F.col("sig").alias("new")).join(before.select("qual", F.col("sig").alias("old")), "qual", "full_outer").where(~F.col("new").eqNullSafe(F.col("old")))
    sort = F.when(F.col("old").isNull(), "nuevo").when(F.col("new").isNull(), "quitado").otherwise("cambiado")
    return rows.select("qual", "old", "new", sort.alias("sort")).orderBy("qual").limit(limit)


def misfit_calls(calls: DataFrame, added: DataFrame, symbols: DataFrame, fits: Column) -> DataFrame:
    """CH24: calls on added lines that do not fit the only symbol of their name."""
    only = symbols.groupBy("name").agg(F.count("*").alias("n"), F.first("sig").alias("sig"), F.first("kind").alias("kind")).where("n = 1")
    return calls.join(added, ["path", "at"], "left_semi").join(only, "name").where(~fits)


def untouched_callers(callers: DataFrame, touched_paths: DataFrame) -> DataFrame:
    """XT32: callers (qual, file) in files that the diff left alone."""
    return callers.join(touched_paths.select(F.col("path").alias("file")), "file", "left_anti")
