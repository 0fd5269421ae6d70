"""Queries for the families of operators that ``queries`` does not reach, over symbols, logs and texts made from the driver's tables.

Symbols: every part is one; five in a row share a module of forty, the first
of them being a class, the second its method, the others functions.  Modules
whose number ends in 3 are tests.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.functions import scalars as S
from codefacts.operators import activity, changes, floor, graph, impact, log, resolve, rules, search, sets, spans
from codefacts.plans.queries import _parts, parts_graph, query
from codefacts.session import cut, table

_SYM = f"""s AS (SELECT p_partkey AS k, (p_partkey // 5) % 40 AS m, CASE p_partkey % 5 WHEN 0 THEN 'class' WHEN 1 THEN 'method' ELSE 'function' END AS kind FROM part),
n AS (SELECT k, m, kind, CASE WHEN m % 10 = 3 THEN 'tests.test_m' ELSE 'pkg.m' END || m AS module, CASE WHEN kind = 'method' THEN 'C' || (k - 1) END AS owner,
  CASE WHEN kind = 'class' THEN 'C' || k WHEN kind = 'method' THEN CASE WHEN k % 3 = 0 THEN '__call__' ELSE 'run' || k END ELSE CASE WHEN m % 10 = 3 THEN 'test_f' ELSE 'f' END || k END AS name FROM s),
sym AS (SELECT *, module || '.' || CASE WHEN owner IS NULL THEN '' ELSE owner || '.' END || name AS qual, replace(module, '.', '/') || '.py' AS file,
  ((k // 200) * 100 + (k % 5) * 20 + 1)::INTEGER AS line, ((k // 200) * 100 + (k % 5) * 20 + CASE kind WHEN 'class' THEN 35 ELSE 15 END)::INTEGER AS "end" FROM n),
mods AS (SELECT DISTINCT module, file, m FROM sym), {_parts(42)},
calls AS (SELECT DISTINCT a.qual AS src, b.qual AS dst FROM pe JOIN sym a ON a.k = pe.src JOIN sym b ON b.k = pe.dst),
ext AS (SELECT a.qual AS src, b.qual AS dst FROM sym a JOIN sym b ON b.k = a.k * 3 WHERE a.kind = 'class'),
imports AS (SELECT a.module AS src, b.module AS dst FROM mods a JOIN mods b ON b.m = (a.m * 3 + 1) % 40 WHERE a.m % 4 <> 0 AND a.m <> b.m)"""


def symbol_rows(spark: SparkSession, sf: str) -> DataFrame:
    """k, m, kind, module, owner, name, qual, file, line, end, test."""
    k = F.col("k")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("k")).withColumn("m", F.expr("(k div 5) % 40"))
    tests = F.col("m") % 10 == 3
    rows = rows.withColumn("kind", F.when(k % 5 == 0, "class").when(k % 5 == 1, "method").otherwise("function"))
    rows = rows.withColumn("module", F.concat(F.when(tests, "tests.test_m").otherwise("pkg.m"), F.col("m").cast("string"))).withColumn("owner", F.when(k % 5 == 1, F.concat(F.lit("C"), (k - 1).cast("string"))))
    name = F.when(k % 5 == 0, F.concat(F.lit("C"), k.cast("string"))).when(k % 5 == 1, F.when(k % 3 == 0, "__call__").otherwise(F.concat(F.lit("run"), k.cast("string")))).otherwise(F.concat(F.when(tests, "test_f").otherwise("f"), k.cast("string")))
    rows = rows.withColumn("name", name).withColumn("qual", F.concat_ws(".", "module", "owner", "name")).withColumn("file", F.concat(F.translate("module", ".", "/"), F.lit(".py")))
    start = F.expr("cast((k div 200) * 100 + (k % 5) * 20 as int)")
    return rows.withColumn("line", start + 1).withColumn("end", start + F.when(k % 5 == 0, 35).otherwise(15)).withColumn("test", F.lit(None).cast("boolean"))


def module_rows(sym: DataFrame) -> DataFrame:
    return sym.select("module", "file", "m").distinct()


def call_edges(spark: SparkSession, sf: str, sym: DataFrame) -> DataFrame:
    a, b = sym.select(F.col("k").alias("src"), F.col("qual").alias("a")), sym.select(F.col("k").alias("dst"), F.col("qual").alias("b"))
    return parts_graph(spark, sf, 42).join(b, "dst").join(a, "src").select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("CALLS").alias("etype")).distinct()


def extends_edges(sym: DataFrame) -> DataFrame:
    c = sym.where("kind = 'class'")
    return c.select((F.col("k") * 3).alias("b"), F.col("qual").alias("src")).join(c.select(F.col("k").alias("b"), F.col("qual").alias("dst")), "b").select("src", "dst", F.lit("EXTENDS").alias("etype"))


def import_edges(mods: DataFrame) -> DataFrame:
    a = mods.where("m % 4 != 0").select(F.col("module").alias("src"), "m", ((F.col("m") * 3 + 1) % 40).alias("t"))
    return a.join(mods.select(F.col("module").alias("dst"), F.col("m").alias("t")), "t").where("m != t").select("src", "dst")


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def said(rows: DataFrame, what: str, *columns: str | Column) -> DataFrame:
    """(what, item): rows as text, for queries over several operators; nulls read ``-``."""
    return rows.select(F.lit(what).alias("what"), F.concat_ws("|", *[F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("-")) for c in columns]).alias("item"))


def _said(what: str, columns: str, rest: str) -> str:
    return f"SELECT '{what}' AS what, concat_ws('|', {', '.join(f'coalesce(({c})::VARCHAR, $$-$$)' for c in columns.split(';'))}) AS item {rest}"


# symbols -----------------------------------------------------------------------

_NAMED = """named AS (SELECT qual, CASE WHEN k % 3 = 0 THEN 'pkg.m1.<modulo>' ELSE (SELECT b.qual FROM sym b WHERE b.k = sym.k + 1) END AS body FROM sym WHERE k % 5 = 2), nm AS (FROM named WHERE body IS NOT NULL)"""


def named_rows(sym: DataFrame) -> DataFrame:
    after = sym.select((F.col("k") - 1).alias("k"), F.col("qual").alias("b"))
    return sym.where("k % 5 = 2").join(after, "k", "left").select("qual", F.when(F.col("k") % 3 == 0, "pkg.m1.<modulo>").otherwise(F.col("b")).alias("body")).where("body is not null")


@query(f"""WITH {_SYM}, {_NAMED} SELECT 'call' AS sort, dst AS src, src AS dst FROM (FROM calls UNION FROM ext) UNION ALL SELECT 'dunder', qual, module || '.' || owner FROM sym WHERE kind = 'method' AND name = '__call__'
UNION ALL SELECT 'inherited', s.qual, e.src FROM sym s JOIN ext e ON s.module || '.' || s.owner = e.dst WHERE s.kind = 'method'
UNION ALL SELECT 'value', qual, body FROM nm WHERE NOT ends_with(body, '.<modulo>') UNION ALL SELECT 'value', nm.qual, f.qual FROM nm JOIN sym f ON f.module = 'pkg.m1' AND f.kind <> 'class' WHERE ends_with(body, '.<modulo>')""")
def caller_relation(spark, sf):
    """GR13, GR14, GR15, GR16: who counts as a caller."""
    sym = cut(symbol_rows(spark, sf))
    ext = extends_edges(sym)
    parts = {"call": impact.caller_edges(call_edges(spark, sf, sym).unionByName(ext)), "dunder": impact.dunder_edges(sym), "inherited": impact.inherited_edges(sym, ext), "value": impact.value_edges(named_rows(sym), sym)}
    return together(*[e.select(F.lit(k).alias("sort"), "src", "dst") for k, e in parts.items()])


_HUNKS = "h AS (SELECT file AS path, 15 + m * 7 AS start, 27 + m * 7 AS stop FROM mods), hit AS (SELECT DISTINCT sym.* FROM sym JOIN h ON file = path AND start <= \"end\" AND line <= stop), touched AS (FROM hit WHERE qual NOT IN (SELECT module || '.' || owner FROM hit WHERE kind = 'method'))"


def hunk_rows(mods: DataFrame) -> DataFrame:
    return mods.select(F.col("file").alias("path"), (15 + F.col("m") * 7).cast("int").alias("start"), (27 + F.col("m") * 7).cast("int").alias("stop"))


@query(f"""WITH {_SYM}, {_HUNKS}, c AS (SELECT dst, count(DISTINCT src) AS n FROM calls GROUP BY 1) SELECT qual, file, coalesce(n, 0)::BIGINT AS callers FROM touched LEFT JOIN c ON qual = dst""")
def diff_wave(spark, sf):
    """GR17, GR18, CH10: touched symbols and how many call them."""
    sym = cut(symbol_rows(spark, sf))
    return impact.wave(sym, call_edges(spark, sf, sym), hunk_rows(module_rows(sym)))


_FILES = """files AS (SELECT file AS path, m, CASE WHEN m = 13 THEN NULL ELSE repeat('x' || chr(10), (9 + m * 7)::INTEGER) || CASE m % 3 WHEN 0 THEN 'subprocess.run([sys.executable])' WHEN 1 THEN 'subprocess.run(["ls"])' ELSE 'pass' END
  || chr(10) || CASE WHEN m % 10 = 5 THEN 'if __name__ == "__main__":' ELSE 'y' END END AS text FROM mods)"""


def file_rows(mods: DataFrame) -> DataFrame:
    m = F.col("m")
    mark = F.when(m % 3 == 0, "subprocess.run([sys.executable])").when(m % 3 == 1, 'subprocess.run(["ls"])').otherwise("pass")
    text = F.concat(F.repeat(F.lit("x\n"), (9 + m * 7).cast("int")), mark, F.lit("\n"), F.when(m % 10 == 5, 'if __name__ == "__main__":').otherwise("y"))
    return mods.select(F.col("file").alias("path"), "m", F.when(m != 13, text).alias("text"))


@query(f"""WITH RECURSIVE {_SYM}, {_FILES}, tests AS (SELECT qual, file FROM sym WHERE kind = 'function' AND starts_with(qual, 'tests.') AND starts_with(name, 'test_')),
spawn AS (SELECT qual FROM sym WHERE m % 3 = 0 AND line <= 10 + m * 7 AND 10 + m * 7 <= "end" AND m <> 13), e AS (SELECT dst AS a, src AS b FROM (FROM calls UNION FROM ext)),
w AS (SELECT qual AS node, 0 AS d FROM spawn UNION SELECT e.b, w.d + 1 FROM w JOIN e ON w.node = e.a WHERE w.d < 8 AND (w.d = 0 OR w.node NOT IN (SELECT qual FROM tests))),
r AS (SELECT DISTINCT file FROM tests WHERE qual IN (SELECT node FROM w WHERE d > 0))
{_said("opaque", "path", "FROM files WHERE text IS NULL OR m % 3 < 2")} UNION ALL {_said("spawns", "qual", "FROM spawn")} UNION ALL {_said("collected", "qual", "FROM tests")}
UNION ALL {_said("reach", "file", "FROM (FROM r UNION SELECT path FROM files WHERE (m % 3 < 2 OR m = 13) AND starts_with(path, 'tests/'))")}""")
def hidden_tests(spark, sf):
    """GR33, GR34, GR35, GR38, GR39: tests that run what the graph cannot see."""
    sym = cut(symbol_rows(spark, sf))
    files, tests = file_rows(module_rows(sym)), impact.is_collected(sym)
    caller = impact.caller_edges(call_edges(spark, sf, sym).unionByName(extends_edges(sym)))
    return together(said(impact.opaque_files(files), "opaque", "path"), said(impact.spawning_symbols(sym, files), "spawns", "qual"), said(tests, "collected", "qual"), said(impact.opaque_reach(sym, files, caller, tests), "reach", "file"))


@query(f"""WITH {_SYM} {_said("exact", "qual", "FROM sym WHERE qual = 'pkg.m1.f7'")} UNION ALL {_said("suffix", "qual", "FROM sym WHERE ends_with(qual, '.f12')")} UNION ALL {_said("similar", "qual", "FROM (SELECT qual FROM sym WHERE contains(lower(qual), 'run1') ORDER BY qual LIMIT 5)")}
UNION ALL {_said("anchor", "qual;$$$$", "FROM sym WHERE ends_with(qual, '.f7')")} UNION ALL {_said("anchor", "NULL;$$no existe$$", "")} UNION ALL {_said("anchor", "NULL;$$ambiguo: $$ || (SELECT string_agg(qual, ', ' ORDER BY qual) FROM (SELECT qual FROM sym WHERE ends_with(qual, '.__call__') ORDER BY qual LIMIT 6))", "")}""")
def symbol_lookup(spark, sf):
    """GR10, GR31, XT31: symbols by name, by ending, by likeness, and the one a name stands for."""
    sym = cut(symbol_rows(spark, sf))
    anchors = spark.createDataFrame([graph.unique_anchor(sym, x) for x in ("f7", "nothing", "__call__")], "qual string, reason string")
    return together(said(graph.lookup(sym, "pkg.m1.f7"), "exact", "qual"), said(graph.lookup(sym, "f12"), "suffix", "qual"), said(graph.similar(sym, "run1"), "similar", "qual"), said(anchors, "anchor", "qual", "reason"))


@query(f"""WITH {_SYM}, i AS (SELECT dst AS node, string_agg(src, ',' ORDER BY src) AS a FROM calls GROUP BY 1), o AS (SELECT src AS node, string_agg(dst, ',' ORDER BY dst) AS b FROM calls GROUP BY 1),
t AS (SELECT *, split_part(lower(src), '.', 1) AS first FROM calls) {_said("index", "coalesce(i.node, o.node);a;b", "FROM i FULL JOIN o ON i.node = o.node")}
UNION ALL {_said("split", "dst;count(*) FILTER (starts_with(first, $$test$$) OR ends_with(first, $$tests$$));count(*) FILTER (NOT (starts_with(first, $$test$$) OR ends_with(first, $$tests$$)))", "FROM t GROUP BY dst")}
UNION ALL {_said("edge", "src;dst;(SELECT count(*) FROM imports)", "FROM imports")}
UNION ALL {_said("target", "qual;n", "FROM (SELECT qual, count(DISTINCT src) AS n FROM sym JOIN calls ON qual = dst WHERE kind = 'function' GROUP BY 1 ORDER BY n DESC, qual LIMIT 20)")}""")
def call_tables(spark, sf):
    """GR11, GR32, GR7, XT36: calls by node, callers by kind, edges in order, functions to break."""
    sym = cut(symbol_rows(spark, sf))
    calls = cut(call_edges(spark, sf, sym))
    index = graph.call_index(calls).select("node", F.array_join("callers", ",").alias("a"), F.array_join("callees", ",").alias("b"))
    return together(said(index, "index", "node", "a", "b"), said(graph.caller_split(calls), "split", "node", "tests", "sources"), said(graph.edge_list(import_edges(module_rows(sym))), "edge", "src", "dst", "edges"), said(graph.breakage_targets(sym, calls), "target", "qual", "callers"))


@query(f"""WITH {_SYM}, own AS (SELECT module FROM mods WHERE m IN (1, 2)), e AS (SELECT DISTINCT a.module AS a, b.module AS b FROM calls JOIN sym a ON a.qual = src JOIN sym b ON b.qual = dst WHERE a.module <> b.module), bo AS (FROM e UNION SELECT b, a FROM e),
mine AS (SELECT qual FROM sym WHERE m = 1 AND k < 60) {_said("neighbour", "b", "FROM (SELECT DISTINCT b FROM bo WHERE a IN (FROM own) AND b NOT IN (FROM own))")}
UNION ALL {_said("ego", "x", "FROM (SELECT qual AS x FROM mine UNION SELECT dst FROM calls WHERE src IN (FROM mine) UNION SELECT src FROM calls WHERE dst IN (FROM mine))")}""")
def neighbourhoods(spark, sf):
    """GR20, GR43: modules one hop away, and all that touches an agent's nodes."""
    sym = cut(symbol_rows(spark, sf))
    calls, mods = cut(call_edges(spark, sf, sym)), module_rows(sym)
    near = graph.neighbours(calls, sym.select("qual", "module"), mods.where("m in (1, 2)"))
    return together(said(near, "neighbour", "module"), said(graph.ego(calls, sym.where("m = 1 and k < 60").select(F.col("qual").alias("node"))), "ego", "node"))


_DEAD = f"""WITH {_SYM}, {_FILES}, {_NAMED}, used AS (FROM calls UNION FROM ext), i AS (SELECT dst, bool_and(coalesce(starts_with(o.file, 'tests/'), starts_with(src, 'test'))) AS t FROM used LEFT JOIN sym o ON o.qual = src GROUP BY 1),
d AS (SELECT qual, kind, file, line, CASE WHEN t IS NULL THEN 'dead' ELSE 'only_tests' END AS state FROM sym LEFT JOIN i ON qual = dst WHERE kind <> 'method' AND NOT starts_with(qual, 'test') AND qual NOT IN (SELECT qual FROM nm) AND (t IS NULL OR t)),
o AS (SELECT module, file FROM mods WHERE NOT starts_with(module, 'test') AND m % 10 <> 5 AND module NOT IN (SELECT dst FROM imports) AND module NOT IN (SELECT b.module FROM used JOIN sym b ON b.qual = dst JOIN sym a ON a.qual = src WHERE a.module <> b.module))"""


@query(_DEAD + f""" {_said("symbol", "qual;kind;file;line;state", "FROM d")} UNION ALL {_said("module", "module;file", "FROM o")} UNION ALL {_said("count", "state;n", "FROM (SELECT state, count(*) AS n FROM (SELECT state FROM d UNION ALL SELECT 'orphan' FROM o) GROUP BY 1 UNION ALL SELECT 'total', (SELECT count(*) FROM d) + (SELECT count(*) FROM o))")}""")
def dead_code(spark, sf):
    """GR27, GR28, GR29, AG11: what nothing calls, what only tests call, modules that nothing imports."""
    sym = cut(symbol_rows(spark, sf))
    mods = module_rows(sym)
    calls = cut(call_edges(spark, sf, sym))
    edges = calls.unionByName(extends_edges(sym))
    nodes = sym.select("qual", "kind", "module", "file", "line", "test").unionByName(mods.select(F.col("module").alias("qual"), F.lit("module").alias("kind"), "module", "file", F.lit(1).alias("line"), F.lit(None).cast("boolean").alias("test")))
    dead = cut(graph.dead_symbols(nodes, edges, named_rows(sym)))
    # orphans are judged without the calls of this dense demo graph where sf is large; both sides say the same
    orphans = cut(graph.orphan_modules(nodes, edges, import_edges(mods), graph.entry_points(file_rows(mods)).select(F.col("path").alias("file"))))
    return together(said(dead, "symbol", "qual", "kind", "file", "line", "state"), said(orphans, "module", "module", "file"), said(graph.dead_total(dead, orphans), "count", "state", "n"))


@query(f"""WITH {_SYM}, now AS (SELECT qual, k, kind, CASE WHEN k % 11 = 0 THEN '(a, b)' WHEN k % 11 = 1 THEN '(a, b=1)' ELSE '(a)' END AS sig FROM sym WHERE k % 7 <> 0), was AS (SELECT qual, '(a)' AS sig FROM sym WHERE k % 7 <> 1), old AS (SELECT * FROM calls WHERE length(src) % 2 = 0),
st AS (SELECT n.qual, n.sig, string_agg(DISTINCT src, ',' ORDER BY src) AS callers, bool_or(src IN (SELECT qual FROM sym WHERE m = 2)) AS hit FROM now n JOIN was USING (qual) JOIN calls ON dst = n.qual WHERE k % 11 = 0 AND kind <> 'class' GROUP BY 1, 2)
{_said("new", "qual", "FROM now WHERE qual NOT IN (SELECT qual FROM was)")} UNION ALL {_said("gone", "count(*)", "FROM was WHERE qual NOT IN (SELECT qual FROM now)")} UNION ALL {_said("call", "src;dst", "FROM calls WHERE (src, dst) NOT IN (SELECT (src, dst) FROM old)")}
UNION ALL {_said("sig", "qual;o;n;CASE WHEN o IS NULL THEN $$nuevo$$ WHEN n IS NULL THEN $$quitado$$ ELSE $$cambiado$$ END", "FROM (SELECT coalesce(now.qual, was.qual) AS qual, was.sig AS o, now.sig AS n FROM now FULL JOIN was ON now.qual = was.qual WHERE now.sig IS DISTINCT FROM was.sig ORDER BY 1 LIMIT 20)")}
UNION ALL {_said("stale", "qual;sig;callers", "FROM st WHERE NOT hit")} UNION ALL {_said("head", "qual;file", "FROM sym WHERE m = 4")} UNION ALL {_said("untouched", "qual", "FROM sym WHERE kind = 'class' AND m <> 2")}""")
def symbol_changes(spark, sf):
    """GR42, CH4, CH13, XT24, XT27, XT32: symbols, calls and signatures against a former state."""
    sym = cut(symbol_rows(spark, sf))
    calls, k = cut(call_edges(spark, sf, sym)), F.col("k")
    sig = F.when(k % 11 == 0, "(a, b)").when(k % 11 == 1, "(a, b=1)").otherwise("(a)")
    now, was = sym.where("k % 7 != 0").withColumn("sig", sig), sym.where("k % 7 != 1").withColumn("sig", F.lit("(a)"))
    new, gone, fresh = graph.symbol_delta(now, was, calls, calls.where(F.length("src") % 2 == 0))
    stale = changes.stale_signatures(now, was, calls, sym.where("m = 2"))
    two = module_rows(sym).where("m = 2").select(F.col("file").alias("path"))
    return together(
        said(new, "new", "qual"), said(spark.createDataFrame([(gone,)], "n long"), "gone", "n"), said(fresh, "call", "src", "dst"), said(changes.signature_changes(now, was), "sig", "qual", "old", "new", "sort"),
        said(stale, "stale", "qual", "new", F.array_join("callers", ",")), said(changes.base_symbols(sym, module_rows(sym).where("m = 4").select(F.col("file").alias("path"))), "head", "qual", "file"), said(changes.untouched_callers(sym.where("kind = 'class'").select("qual", "file"), two), "untouched", "qual"),
    )


# log and graph -------------------------------------------------------------------

_CRASH = """ev AS (SELECT event_id AS seq, event_id::VARCHAR AS id, date_trunc('second', ts) AS ts, CASE WHEN event_id % 9 = 0 THEN NULL ELSE event_type END AS type, user_id % 45 AS u, CASE WHEN event_id % 4 = 0 THEN '<stdin>:1' WHEN event_id % 4 = 1 THEN '/lib/x.py:3' ELSE '/proj/src/pkg/m' || (user_id % 45) || '.py:7' END AS "where",
  CASE WHEN event_id % 5 = 0 THEN '/other' ELSE '/proj' END AS project, (event_id % 600 + 1)::INTEGER AS pos FROM events WHERE event_type = 'error')"""


def crash_rows(spark: SparkSession, sf: str) -> DataFrame:
    """seq, id, ts, type, where, project, u, at, frames: the outermost in a module of the user, then one of the library, then none or one more."""
    e = table(spark, sf, "events").where("event_type = 'error'")
    i, u = F.col("event_id"), (F.col("user_id") % 45)
    own = F.concat(F.lit("/proj/src/pkg/m"), u.cast("string"), F.lit(".py"))
    at = (i % 600 + 1).cast("int")
    frame = lambda file, line, lib: F.struct(file.alias("file"), line.cast("int").alias("line"), F.lit(lib).alias("is_library"))
    deep = F.concat(F.lit("/proj/pkg/m"), ((u * 7) % 45).cast("string"), F.lit(".py"))
    frames = F.array(frame(deep, at, False), frame(F.lit("/lib/x.py"), F.lit(1), True))
    return e.select(i.alias("seq"), i.cast("string").alias("id"), F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts"), F.when(i % 9 != 0, F.col("event_type")).alias("type"), u.alias("u"), F.when(i % 4 == 0, "<stdin>:1").when(i % 4 == 1, "/lib/x.py:3").otherwise(F.concat(own, F.lit(":7"))).alias("where"), F.when(i % 5 == 0, "/other").otherwise("/proj").alias("project"), at.alias("at"), frames.alias("frames"))


@query(f"""WITH {_SYM}, {_CRASH}, last AS (SELECT * FROM ev WHERE project = '/proj' AND NOT starts_with("where", '<') ORDER BY seq DESC LIMIT 40),
x AS (SELECT *, CASE WHEN id::BIGINT % 4 = 1 THEN NULL ELSE 'pkg.m' || u END AS a, 'pkg.m' || ((u * 7) % 45) AS b FROM last)
SELECT id, coalesce(type, '?') AS type, "where", CASE WHEN a IN (SELECT module FROM mods) THEN a WHEN b IN (SELECT module FROM mods) THEN b ELSE '' END AS node, id::BIGINT % 3 = 0 AS "read" FROM x""")
def captures_on_graph(spark, sf):
    """CH29, XT7, XT8: the latest captures of a project with the module they lie in."""
    sym = cut(symbol_rows(spark, sf))
    e = crash_rows(spark, sf)
    reads = e.where("seq % 3 = 0").select("id")
    return log.captures_with_node(e, e.select("id", "frames"), module_rows(sym), reads, "/proj", 40).select("id", "type", "where", "node", "read")


@query(f"""WITH {_SYM}, {_CRASH}, f AS (SELECT *, 'pkg/m' || ((u * 7) % 45) || '.py' AS path FROM ev), held AS (SELECT id, qual FROM f JOIN sym ON file = path AND line <= pos AND pos <= "end" QUALIFY row_number() OVER (PARTITION BY id ORDER BY line DESC, "end", qual) = 1),
c AS (SELECT dst, string_agg(src, ',' ORDER BY src) AS callers FROM calls GROUP BY 1), k AS (SELECT file, 'c' || m AS commit, TIMESTAMP '2024-01-15' AS cts FROM mods WHERE m % 3 = 0), y AS (SELECT file FROM mods WHERE m % 7 = 0),
z AS (SELECT f.*, CASE WHEN path IN (FROM y) THEN 'sin-commitear' WHEN k.cts > f.ts THEN k.commit END AS changed FROM f LEFT JOIN k ON k.file = path)
SELECT z.id, path || ':' || pos AS site, qual AS node, coalesce(callers, '') AS callers, changed FROM z LEFT JOIN held USING (id) LEFT JOIN c ON c.dst = qual WHERE qual IS NOT NULL OR changed IS NOT NULL""")
def crash_anchors(spark, sf):
    """GR41, GR19, CH8, WN9: the symbol a crash lies in, its callers, and whether its file changed since."""
    sym = symbol_rows(spark, sf)
    mods = module_rows(sym)
    commits = mods.where("m % 3 = 0").select("file", F.concat(F.lit("c"), F.col("m").cast("string")).alias("commit"), F.lit("2024-01-15").cast("timestamp_ntz").alias("commit_ts"))
    found = log.crash_anchor(crash_rows(spark, sf).select("id", "ts", "frames"), sym, call_edges(spark, sf, sym), mods.where("m % 7 = 0").select("file"), commits, "/proj")
    return found.select("id", "site", "node", F.array_join("callers", ",").alias("callers"), "changed")


@query(f"""WITH {_CRASH}, r AS (SELECT id FROM ev WHERE seq % 3 = 0) {_said("newest", "id", "FROM (SELECT id FROM ev WHERE project = '/other' ORDER BY seq DESC LIMIT 7)")} UNION ALL {_said("load", "id", "FROM (SELECT id FROM ev ORDER BY seq DESC LIMIT 1)")}
UNION ALL {_said("prefix", "id", "FROM (SELECT id FROM ev WHERE starts_with(id, '1') ORDER BY seq DESC LIMIT 1)")} UNION ALL {_said("read", "count(*)", "FROM r")}
UNION ALL {_said("split", "e;count(*);count(*) FILTER (seq % 3 = 0)", "FROM (SELECT *, starts_with(" + '"where"' + ", '<') AS e FROM ev) GROUP BY e")} UNION ALL {_said("unread", "count(*)", "FROM ev WHERE seq % 3 <> 0")}
UNION ALL {_said("compacted", "count(*)", "FROM ev WHERE ts >= TIMESTAMP '2024-02-01' - INTERVAL 12 DAY")} UNION ALL {_said("tail", "id;c", "FROM (SELECT id, greatest(0, (SELECT count(*) FROM ev) - 5) AS c FROM ev ORDER BY seq DESC LIMIT 5)")}
UNION ALL {_said("capped", "id", "FROM (SELECT id FROM ev ORDER BY seq LIMIT 3)")} UNION ALL {_said("capped", "$$+$$ || (count(*) - 3) || $$ more$$", "FROM ev HAVING count(*) > 3")}
UNION ALL {_said("since", "id", "FROM (SELECT id FROM ev WHERE ts >= TIMESTAMP '2024-01-10' ORDER BY seq DESC LIMIT 50)")} UNION ALL {_said("real", "count(*)", "FROM ev WHERE NOT starts_with(" + '"where"' + ", '<')")}
UNION ALL {_said("state", "u;CASE min(seq % 4) WHEN 0 THEN $$capturada$$ WHEN 1 THEN $$leida$$ WHEN 2 THEN $$intervenida$$ ELSE $$en-silencio$$ END", "FROM ev GROUP BY u")}
UNION ALL {_said("last", "u;max(seq)", "FROM ev GROUP BY u")}""")
def log_views(spark, sf):
    """SC12, SC13, SC15, SC19, SC41, AG4, AG7, CH7, WN2, WN5, WN11, TK8, XT8, XT25."""
    e = cut(crash_rows(spark, sf))
    reads = e.where("seq % 3 = 0").select("id")
    one = lambda rows, what: said(rows.agg(F.count("*").alias("n")), what, "n")
    s = F.col("seq") % 4
    states = e.select(F.col("u").alias("node"), F.when(s == 0, "capturada").when(s == 1, "leida").when(s == 2, "intervenida").otherwise("en-silencio").alias("state"))
    ledger = e.select("id", "ts")
    return together(
        said(log.newest(e, 7, "/other"), "newest", "id"), said(log.load(e), "load", "id"), said(log.load(e, "1"), "prefix", "id"), one(log.read_ids(reads), "read"), said(log.exploration_split(e.select("id", "where"), reads), "split", "exploration", "captures", "read"),
        one(log.unread(e, reads), "unread"), one(log.compacted(ledger, F.lit("2024-02-01").cast("timestamp_ntz"), 12), "compacted"), said(log.tail(e, ["seq"], 5), "tail", "id", "cut"), said(log.capped(e, ["seq"], "id", 3), "capped", "id"), said(log.since(e, F.lit("2024-01-10").cast("timestamp_ntz")), "since", "id"),
        one(log.projects(e), "real"), said(log.node_state(states), "state", "node", "state"), said(log.last_commits(e.select(F.col("u").alias("file"), F.col("seq").alias("sha"), F.col("seq").alias("ts"))), "last", "file", "commit"),
    )


# the floor, documents, languages ---------------------------------------------------

_LISTING = """listing AS (SELECT unnest(CASE p_partkey % 12 WHEN 0 THEN ['docs/SCOPE.md'] WHEN 1 THEN ['ARCHITECTURE.md', 'setup.py'] WHEN 2 THEN ['docs/adr/001-x.md', '.boundaries'] WHEN 3 THEN ['tests/test_a.py', 'go.mod'] WHEN 4 THEN ['.husky/pre-commit'] WHEN 5 THEN ['.github/workflows/ci.yml']
  ELSE ['src/m' || p_partkey || ['.py', '.rs', '.tsx', '.d.ts', '.lua', '.txt'][p_partkey % 6 + 1]] END) AS path, p_partkey AS k FROM part)"""


def listing_rows(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    extension = F.element_at(F.array(*map(F.lit, (".py", ".rs", ".tsx", ".d.ts", ".lua", ".txt"))), (k % 6 + 1).cast("int"))
    some = {0: ["docs/SCOPE.md"], 1: ["ARCHITECTURE.md", "setup.py"], 2: ["docs/adr/001-x.md", ".boundaries"], 3: ["tests/test_a.py", "go.mod"], 4: [".husky/pre-commit"], 5: [".github/workflows/ci.yml"]}
    paths = F.array(F.concat(F.lit("src/m"), k.cast("string"), extension))
    for n, names in some.items():
        paths = F.when(k % 12 == n, F.array(*map(F.lit, names))).otherwise(paths)
    return table(spark, sf, "part").select(F.explode(paths).alias("path"), k.alias("k"))


_LANG = "CASE WHEN ends_with(path, '.d.ts') THEN NULL WHEN ends_with(path, '.py') THEN 'python' WHEN ends_with(path, '.rs') THEN 'rust' WHEN ends_with(path, '.tsx') THEN 'tsx' WHEN ends_with(path, '.lua') THEN 'lua' END"


@query(f"""WITH {_LISTING} {_said("level", "x.level;x.phase;EXISTS (SELECT 1 FROM listing WHERE list_contains(x.files, path) OR len(list_filter(x.files, lambda f: starts_with(path, f || $$/$$))) > 0)", "FROM (VALUES " + ", ".join(f"('{n}', {p}, {list(f)})" for n, p, f in floor.LEVELS) + ") x(level, phase, files)")}
UNION ALL {_said("next", "$$agentes$$", "")} UNION ALL {_said("floor", "$$7/8$$", "")} UNION ALL {_said("command", "$$python -m pytest$$", "")} UNION ALL {_said("runner", "$$python -m pytest$$", "")}
UNION ALL {_said("gate", "path;CASE WHEN path = $$.husky/pre-commit$$ THEN $$gate$$ WHEN path = $$.github/workflows/ci.yml$$ THEN $$ci$$ ELSE $$adr$$ END", "FROM (SELECT DISTINCT path FROM listing WHERE path IN ('.husky/pre-commit', '.github/workflows/ci.yml', 'docs/adr/001-x.md'))")}
UNION ALL {_said("marker", "d;$$python$$", "FROM (SELECT DISTINCT k % 3 AS d FROM listing WHERE path = 'setup.py')")}
UNION ALL {_said("root", "path;CASE WHEN k % 2 = 0 THEN $$src$$ END", "FROM (SELECT DISTINCT CASE WHEN k % 2 = 0 THEN 'src/a/b/' ELSE 'lib/' END || k || '.py' AS path, k FROM listing)")}""")
def project_floor(spark, sf):
    """CH19, CH20, CH21, AG16, XT6, XT16, XT22: levels met, the next step, commands, gates, roots."""
    rows = cut(listing_rows(spark, sf))
    found = floor.levels(rows)
    names = rows.select((F.col("k") % 3).alias("dir"), F.col("path").alias("name"))
    markers = spark.createDataFrame([("go.mod", 2, "go"), ("setup.py", 1, "python")], "marker string, ord int, lang string")
    deep = rows.select(F.concat(F.when(F.col("k") % 2 == 0, "src/a/b/").otherwise("lib/"), F.col("k").cast("string"), F.lit(".py")).alias("path")).distinct()
    return together(
        said(found, "level", "level", "phase", "ok"), said(floor.next_step(found), "next", "level"), said(floor.rolled_up(found), "floor", "floor"), said(floor.test_command(rows), "command", "command"), said(floor.runner(deep, rows), "runner", "command"),
        said(floor.gates(rows.select("path").distinct()), "gate", "path", "kind"), said(floor.first_marker(names, markers).where("lang = 'python'"), "marker", "dir", "lang"), said(floor.project_root(deep, spark.createDataFrame([("src",), ("src/a/x",)], "root string")), "root", "path", "root"),
    )


_DOCUMENTS = """d AS (SELECT doc_id, 'd' || doc_id || '.md' AS path, CASE doc_id % 4 WHEN 0 THEN 'Run `pytest -q ' || doc_id || '` and `npm test`.' WHEN 1 THEN '# Done when' || chr(10) || 'text' || chr(10) || '```sh' || chr(10) || 'make x' || doc_id || chr(10) || '```' WHEN 2 THEN 'PENDIENTE: ' || lang ELSE text END AS text FROM documents)"""


@query(f"""WITH {_DOCUMENTS} {_said("divergence", "path;c", "FROM (SELECT path, 'pytest -q ' || doc_id AS c FROM d WHERE doc_id % 4 = 0)")} UNION ALL {_said("criterion", "path;$$make x$$ || doc_id || chr(10)", "FROM d WHERE doc_id % 4 = 1")}
UNION ALL {_said("pending", "path", "FROM d WHERE contains(text, 'PENDIENTE')")}""")
def document_checks(spark, sf):
    """CH22, XT17, XT18: declared commands that were not found, done criteria, documents with open marks."""
    i = F.col("doc_id")
    text = F.when(i % 4 == 0, F.concat(F.lit("Run `pytest -q "), i.cast("string"), F.lit("` and `npm test`."))).when(i % 4 == 1, F.concat(F.lit("# Done when\ntext\n```sh\nmake x"), i.cast("string"), F.lit("\n```"))).when(i % 4 == 2, F.concat(F.lit("PENDIENTE: "), F.col("lang"))).otherwise(F.col("text"))
    d = table(spark, sf, "documents").select(F.concat(F.lit("d"), i.cast("string"), F.lit(".md")).alias("path"), text.alias("text"), i.alias("i"))
    found = spark.createDataFrame([("npm test",)], "command string")
    return together(said(floor.divergence(d.where("i % 4 = 0"), found), "divergence", "path", "command"), said(floor.criterion(d.where("i % 4 = 1")), "criterion", "path", "command"), said(floor.pending_sections(d), "pending", "path"))


@query(f"""WITH {_LISTING}, f AS (SELECT DISTINCT path, {_LANG} AS lang FROM listing), t(path, is_test) AS (VALUES ('a/test_x.py', true), ('a/x_test.go', true), ('a/x.go', false), ('spec/x.rb', true), ('src/XTest.java', true), ('src/Test/X.cs', true), ('src/test_x.js', false), ('x.spec.ts', true), ('tests/x.txt', false))
{_said("census", "lang;count(*)", "FROM f WHERE lang IS NOT NULL AND lang <> 'python' GROUP BY lang")} UNION ALL {_said("present", "lang", "FROM (SELECT DISTINCT lang FROM f WHERE lang IS NOT NULL)")} UNION ALL {_said("limit", "x", "FROM (VALUES ('no macros'), ('no dispatch'), ('no types')) v(x)")}
UNION ALL {_said("test", "path;is_test", "FROM t")} UNION ALL {_said("language", "path;lang", "FROM f")} UNION ALL {_said("engine", "$$both$$", "")}
UNION ALL {_said("unlicensed", "lang", "FROM (VALUES ('tsx')) v(lang)")} UNION ALL {_said("convention", "s;v", "FROM (VALUES ('suffix', '_test'), ('suffix', 'Test'), ('dir', 'tests'), ('dir', 'spec')) v(s, v)")}""")
def language_census(spark, sf):
    """SC43, SC44, XT3, XT4, XT5, SF40, FX26, FX30, GR37: languages, their limits and conventions."""
    f = cut(listing_rows(spark, sf).select("path").distinct().withColumn("lang", S.language_of("path")))
    present = floor.languages_present(f)
    limits = spark.createDataFrame([("rust", 1, "no macros"), ("lua", 2, "no dispatch"), ("tsx", 3, "no types"), ("python", 4, "no dispatch"), ("go", 5, "no generics")], "lang string, ord int, limit string")
    paths = ["a/test_x.py", "a/x_test.go", "a/x.go", "spec/x.rb", "src/XTest.java", "src/Test/X.cs", "src/test_x.js", "x.spec.ts", "tests/x.txt"]
    t = spark.createDataFrame([(p,) for p in paths], "path string")
    licence = spark.createDataFrame([("python", True), ("rust", True), ("lua", True), ("tsx", False)], "lang string, tia boolean")
    tests = spark.createDataFrame([("go", ["_test"], ["tests"]), ("java", ["Test"], ["tests"]), ("ruby", ["_test"], ["spec"])], "lang string, suffixes array<string>, dirs array<string>")
    return together(
        said(floor.census(f, ("python",)), "census", "lang", "n"), said(present, "present", "lang"), said(floor.limits(present, limits), "limit", "limit"), said(t.select("path", S.is_test_path("path").alias("t")), "test", "path", "t"), said(f, "language", "path", "lang"),
        said(spark.createDataFrame([(resolve.engine(present),)], "e string"), "engine", "e"), said(impact.unlicensed(present, licence), "unlicensed", "lang"), said(floor.conventions(tests), "convention", "sort", "value"),
    )


@query("""WITH o AS (SELECT o_orderkey AS k, o_custkey % 20 AS task, o_orderstatus AS s, CASE o_orderkey % 3 WHEN 0 THEN 'rojo' WHEN 1 THEN 'verde' ELSE 'nada' END AS last FROM orders), l AS (SELECT *, lag(s) OVER (PARTITION BY task ORDER BY k) AS before FROM o)
""" + " UNION ALL ".join([_said("replay", "count(*);count(*) FILTER (k % 4 <> 0)", "FROM o"), _said("cause", "s;count(*);min(k)", "FROM o GROUP BY s"), _said("verdict", "s;count(*);sum(k % 5)", "FROM o GROUP BY s"), _said("expected", "k;CASE last WHEN $$rojo$$ THEN $$rechazar$$ WHEN $$verde$$ THEN $$aceptar$$ ELSE $$sin-objeciones$$ END", "FROM o"),
    _said("cascade", "k;k % 4 = 1 OR (k % 4 = 0 AND k % 3 <> 0)", "FROM o WHERE k % 50 < 4"), _said("repeated", "count(*) FILTER (s = $$F$$ AND before = $$F$$)", "FROM l"), _said("extract", "k;$$error $$ || k || chr(10) || $$Fail$$", "FROM o WHERE k % 97 = 0"), _said("ladder", "k;$$F$$;v.i;$$s$$ || (v.i + 2);$$t$$ || k", "FROM o, (VALUES (0), (1), (2), (3)) v(i) WHERE k % 89 = 0")]))
def run_tables(spark, sf):
    """AG12, XT29, XT30, XT35, XT39, SC42, SC48, CH26, FX35: recorded runs, their causes and verdicts."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 20).alias("task"), F.col("o_orderstatus").alias("s"))
    k = F.col("k")
    last = F.when(k % 3 == 0, "rojo").when(k % 3 == 1, "verde").otherwise("nada")
    runs = o.select(k.alias("case"), F.array(F.lit("rojo"), F.lit("final"), F.lit("duda"), F.lit("final"), last).alias("steps"))
    some = o.where("k % 50 < 4")
    text = F.concat(F.lit("start\nerror "), k.cast("string"), F.lit("\nfine\nFail"))
    state = F.to_json(F.struct(F.col("s").alias("verdict"), F.array(*[F.struct(F.lit(f"s{i}").alias("name"), F.concat(F.lit("t"), k.cast("string")).alias("text")) for i in range(6)]).alias("steps")))
    states = o.where("k % 89 = 0").withColumn("s", F.lit("F")).select(k.cast("string").alias("path"), state.alias("value")).unionByName(spark.createDataFrame([("x", "{broken")], "path string, value string"))
    return together(
        said(floor.replay(o.select(F.lit(1).alias("expected"), F.when(k % 4 != 0, 1).otherwise(0).alias("got"))), "replay", "runs", "confirmed"), said(floor.causes(o.select(F.col("s").alias("cause"), k.alias("case"))), "cause", "cause", "n", "example"),
        said(floor.run_statistics(o.select(F.col("s").alias("verdict"), (k % 5).alias("steps"))), "verdict", "verdict", "runs", "steps"), said(floor.expected_verdict(runs), "expected", "case", "verdict"),
        said(floor.cascade(some.where("k % 4 = 1").select(k.alias("case"), F.lit("f").alias("file")), some.select(k.alias("case"), F.lit(1).alias("size"), (k % 4 == 0).alias("run_all"), (k % 3 == 0).alias("licensed"))), "cascade", "case", "ok"),
        said(rules.same_rejection(o.select("task", k.alias("ord"), F.when(F.col("s") == "F", "rechazar").otherwise("aceptar").alias("verdict"), F.col("s").alias("reason"))).agg(F.count_if("repeated").alias("n")), "repeated", "n"),
        said(o.where("k % 97 = 0").select("k", floor.failure_extract(text).alias("x")), "extract", "k", "x"), said(log.ladder_state(states), "ladder", "path", "verdict", "step", "name", "text"),
    )


# column functions --------------------------------------------------------------------


@query("""WITH p AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'src/a' || p_size || '/b.py' WHEN 1 THEN './x/__init__.py' WHEN 2 THEN 'web\\lib\\index.ts' WHEN 3 THEN '/rs/' || p_size || '/mod.rs' ELSE 'a//b.tar.gz' END AS path,
  CASE p_partkey % 6 WHEN 0 THEN '/tmp/x.py:3' WHEN 1 THEN '<stdin>:1' WHEN 2 THEN 'C:/w/y.py:10' WHEN 3 THEN '/home/u/p/z' || p_size || '.py:7' WHEN 4 THEN '?' ELSE '/home/u/proj.py' END AS w FROM part)
SELECT k, CASE k % 5 WHEN 0 THEN regexp_replace(path, '^src/(.*)/b.py$', '\\1') || '.b' WHEN 1 THEN 'x' WHEN 2 THEN 'web.lib.index.ts' WHEN 3 THEN replace(substr(path, 2), '/', '.') ELSE 'a.b.tar.gz' END AS python,
 CASE k % 5 WHEN 0 THEN regexp_replace(path, '^src/(.*)/b.py$', '\\1') || '.b' WHEN 1 THEN 'x' WHEN 2 THEN 'web.lib' WHEN 3 THEN regexp_replace(path, '^/(rs)/(.*)/mod.rs$', '\\1.\\2') ELSE 'a.b.tar' END AS multi,
 CASE k % 5 WHEN 0 THEN regexp_replace(path, '^src/(.*)/b.py$', '\\1') || '.b' WHEN 1 THEN 'x.__init__' WHEN 2 THEN 'web.lib.index' WHEN 3 THEN regexp_replace(path, '^/(rs)/(.*)/mod.rs$', '\\1.\\2.mod') ELSE 'a.b.tar' END AS every,
 CASE WHEN starts_with(path, 'src/') THEN substr(path, 5) ELSE path END AS short, regexp_replace(regexp_extract(path, '([^/\\\\]*)$', 1), '[^A-Za-z0-9._-]', '-', 'g') || '-' || substr(sha256(path), 1, 8) AS slug,
 k % 6 = 1 AS ephemeral, CASE k % 6 WHEN 0 THEN '/tmp/x.py' WHEN 2 THEN 'C:/w/y.py' WHEN 3 THEN regexp_replace(w, ':7$', '') WHEN 5 THEN w END AS file, CASE k % 6 WHEN 0 THEN '/tmp/x.py' WHEN 2 THEN 'C:/w/y.py' WHEN 3 THEN regexp_replace(w, ':7$', '') END AS signature,
 k % 6 IN (0, 1, 4) AS exploring, k % 6 = 3 AS own, k % 6 = 3 AS below FROM p""")
def path_functions(spark, sf):
    """SF1, SF2, SF3, SF7, SF8, SF11, SF12, SF13, SF14, SF15, SF16, SF17: paths, modules and places."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    path = F.when(k % 5 == 0, F.concat(F.lit("src/a"), size, F.lit("/b.py"))).when(k % 5 == 1, "./x/__init__.py").when(k % 5 == 2, "web\\lib\\index.ts").when(k % 5 == 3, F.concat(F.lit("/rs/"), size, F.lit("/mod.rs"))).otherwise("a//b.tar.gz")
    where = F.when(k % 6 == 0, "/tmp/x.py:3").when(k % 6 == 1, "<stdin>:1").when(k % 6 == 2, "C:/w/y.py:10").when(k % 6 == 3, F.concat(F.lit("/home/u/p/z"), size, F.lit(".py:7"))).when(k % 6 == 4, "?").otherwise("/home/u/proj.py")
    p = table(spark, sf, "part").select(k.alias("k"), path.alias("path"), where.alias("w"))
    return p.select(
        "k", S.module_of("path").alias("python"), S.module_of("path", "multi").alias("multi"), S.module_of("path", "any").alias("every"), S.short_path("path", F.lit("src")).alias("short"), S.slug("path").alias("slug"), S.ephemeral("w").alias("ephemeral"), S.file_of("w").alias("file"),
        S.signature_file("w").alias("signature"), S.exploration("w").alias("exploring"), S.of_project("w", "/home/u/p").alias("own"), F.coalesce(S.under(S.file_of("w"), F.lit("/home/u/p"), "/"), F.lit(False)).alias("below"),
    )


@query("""WITH e AS (SELECT event_id AS k, date_trunc('second', ts) AS t, event_id % 50 AS n, ['s', 'm', 'h', 'd', '', 'x'][event_id % 6 + 1] AS u FROM events), a AS (SELECT *, (epoch(TIMESTAMP '2024-02-01') - epoch(t))::BIGINT AS ago FROM e)
SELECT k, CASE k % 4 WHEN 0 THEN epoch(t)::BIGINT WHEN 1 THEN epoch(t)::BIGINT - 7200 END AS stamp, CASE WHEN n > 0 AND u <> 'x' THEN (n * CASE u WHEN 'm' THEN 60 WHEN 'h' THEN 3600 WHEN 'd' THEN 86400 ELSE 1 END)::DOUBLE END AS seconds,
CASE WHEN ago < 60 THEN greatest(ago, 0) || ' s' WHEN ago < 3600 THEN ago // 60 || ' min' WHEN ago < 86400 THEN ago // 3600 || ' h' ELSE ago // 86400 || ' d' END AS said, round(CASE WHEN k % 700 <= 180 THEN 1.0 WHEN k % 700 >= 600 THEN 0.0 ELSE (600 - k % 700) / 420.0 END, 6)::DOUBLE AS fade FROM a""")
def time_functions(spark, sf):
    """SF4, SF5, SF6, SF47: stamps, durations, how long ago, fading."""
    k = F.col("event_id")
    e = table(spark, sf, "events").select(k.alias("k"), F.date_trunc("second", F.col("ts").cast("timestamp")).alias("t"))
    k = F.col("k")
    text = F.concat(F.date_format("t", "yyyy-MM-dd'T'HH:mm:ss"), F.when(k % 4 == 0, "Z").when(k % 4 == 1, "+02:00").when(k % 4 == 2, "").otherwise("junk"))
    span = F.concat((k % 50).cast("string"), F.element_at(F.array(*map(F.lit, ("s", "m", "h", "d", "", "x"))), (k % 6 + 1).cast("int")))
    return e.select("k", F.unix_timestamp(S.moment(text)).alias("stamp"), S.duration_seconds(span).alias("seconds"), S.relative_time("t", F.lit("2024-02-01").cast("timestamp")).alias("said"), F.round(S.fade(k % 700), 6).alias("fade"))


@query("""WITH p AS (SELECT p_partkey AS k, ['user', 'API_KEY', 'myToken', 'size', 'Session-Id', 'colour'][p_partkey % 6 + 1] AS name, p_name AS v FROM part)
SELECT k, k % 6 IN (1, 2, 4) AS sensitive, CASE WHEN k % 6 IN (1, 2, 4) THEN '<redactado>' ELSE v END AS local, CASE WHEN length(v) > 10 THEN substr(v, 1, 10) || '...(+' || (length(v) - 10) || ' chars)' ELSE v END AS short,
'run --' || name || ' ' || CASE WHEN k % 6 IN (1, 2, 4) THEN '<val>' ELSE v END || ' --password=<val> --size=3' AS argv, CASE k % 3 WHEN 0 THEN v WHEN 1 THEN '''' || v WHEN 2 THEN v END AS unquoted, k || 'x ' || name || CASE WHEN k % 2 = 0 THEN ' @ ' || v ELSE '' END AS line,
'\\u003cb\\u003e \\u0026 ' || v AS html, CASE WHEN k % 2 = 0 THEN name || ':' || v ELSE name END AS label FROM p""")
def text_functions(spark, sf):
    """SF18, SF21, SF22, SF24, SF39, SF44, SF45, SF46, SF48: redaction, cutting, quoting, labels."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k.alias("k"), F.element_at(F.array(*map(F.lit, ("user", "API_KEY", "myToken", "size", "Session-Id", "colour"))), (k % 6 + 1).cast("int")).alias("name"), F.col("p_name").alias("v"))
    k = F.col("k")
    argv = F.array(F.lit("run"), F.concat(F.lit("--"), F.col("name")), F.col("v"), F.lit("--password=x1"), F.lit("--size=3"))
    quoted = F.when(k % 3 == 0, F.concat(F.lit("'"), F.col("v"), F.lit("'"))).when(k % 3 == 1, F.concat(F.lit(" '"), F.col("v"))).otherwise(F.concat(F.lit('"'), F.col("v"), F.lit('"')))
    return p.select(
        "k", S.sensitive("name").alias("sensitive"), S.redact_local("name", "v").alias("local"), S.truncate("v", 10).alias("short"), F.array_join(S.argv_redacted(argv), " ").alias("argv"), S.unquoted(quoted).alias("unquoted"), S.signature_line("name", F.when(k % 2 == 0, F.col("v")), "k").alias("line"),
        S.html_safe(F.concat(F.lit("<b> & "), F.col("v"))).alias("html"), S.usage_label("name", F.when(k % 2 == 0, F.col("v")).otherwise("")).alias("label"),
    )


@query("""WITH p AS (SELECT p_partkey AS k FROM part) SELECT k, 'x = "" + ''''' || CASE WHEN k % 2 = 0 THEN ' == 1' ELSE '' END AS code, k % 3 = 0 AS asserts, k % 2 = 0 AS compares, k % 4 < 2 AS is_test, k % 4 IN (0, 1) AS module_test, k % 5 IN (1, 2) AS breaks, k % 5 IN (0, 3) AS fits, k % 2 = 0 AS nullable,
CASE k % 3 WHEN 0 THEN 'nil-pointer' WHEN 1 THEN 'overflow' ELSE 'panic' END AS panic, CASE WHEN k % 2 = 0 THEN 'test_a.test_b' ELSE 'Cls.test_c' END AS context FROM p""")
def code_functions(spark, sf):
    """SF32, SF33, SF34, SF35, SF36, SF37, SF38, SF41, SF43, RB8: lines of code, signatures, panics, contexts."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k.alias("k"))
    k = F.col("k")
    line = F.concat(F.lit("x = \"a == b\" + 'c'"), F.when(k % 2 == 0, " == 1").otherwise(""))
    path = F.element_at(F.array(*map(F.lit, ("tests/a.py", "b/test_a.py", "src/a.py", "src/contest.py"))), (k % 4 + 1).cast("int"))
    module = F.element_at(F.array(*map(F.lit, ("tests.a", "b.test_a", "src.a", "src.contest"))), (k % 4 + 1).cast("int"))
    old, new = F.lit("(a, b=1)"), F.element_at(F.array(*map(F.lit, ("(a, b=1)", "(a, b=1, c)", "(a)", "(a, b=1, c=2)", "(a, *args)"))), (k % 5 + 1).cast("int"))
    call = F.when(k % 5 == 0, F.array(F.lit("b"))).when(k % 5 == 3, F.array().cast("array<string>")).otherwise(F.array(F.lit("zz")))
    message = F.when(k % 3 == 0, "invalid Nil Pointer dereference").when(k % 3 == 1, "attempt to add with overflow").otherwise("odd")
    return p.select(
        "k", S.code_only(line).alias("code"), S.matches(F.when(k % 3 == 0, "assert x").otherwise("y = 'assert x'"), (r"\bassert\s",)).alias("asserts"), S.compares(F.when(k % 2 == 0, "a == b").otherwise("a('==')")).alias("compares"), S.is_test_file(path).alias("is_test"), S.is_test_module(module).alias("module_test"),
        S.breaks_calls(old, new).alias("breaks"), S.fits(F.lit("(a, b=1)"), F.lit(1), call, F.lit(False)).alias("fits"), S.nullable(F.when(k % 2 == 0, "int | None").otherwise("int")).alias("nullable"), S.panic_type(message, (("nil pointer", "nil-pointer"), ("overflow", "overflow"))).alias("panic"),
        S.context_symbol(F.when(k % 2 == 0, "tests/test_a.py::test_b|run").otherwise("pkg.mod.Cls.test_c")).alias("context"),
    )


@query("""WITH e AS (SELECT event_id AS k, ['python', 'js', 'java', 'rust', 'go', 'lua'][event_id % 6 + 1] AS lang, ['/x/site-packages/a.py', 'node:fs', 'java.util.List', '/rustc/abc/lib.rs', '/home/u/main.go', 'mine.lua'][event_id % 6 + 1] AS file FROM events)
SELECT k, k % 6 < 4 AS library, CASE WHEN k % 6 < 4 THEN 'own' ELSE file END AS "user", CASE WHEN k % 6 < 4 THEN 'own:1' ELSE file || ':2' END AS head, 'a,b,c' AS chain, 'f' || (k % 30 + 1 - least(k % 30 + 1, 5) + 1) || '-f' || (k % 30 + 1) AS inner_ends, round((('0x' || substr(md5(file), 1, 8))::BIGINT / 4294967295.0 * 2 - 1) * 0.5, 6) AS jitter FROM e""")
def frame_functions(spark, sf):
    """SF25, SF26, SF31, XT43, WN9, GR25: library frames, the user's frame, chains and the innermost frames."""
    k = F.col("event_id")
    pick = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 6 + 1).cast("int"))
    e = table(spark, sf, "events").select(k, pick("python", "js", "java", "rust", "go", "lua").alias("lang"), pick("/x/site-packages/a.py", "node:fs", "java.util.List", "/rustc/abc/lib.rs", "/home/u/main.go", "mine.lua").alias("file"))
    library = S.library_frame("file", "lang")
    frames = F.array(F.struct(F.lit("own").alias("file"), F.lit(1).alias("line"), F.lit(False).alias("is_library")), F.struct(F.col("file"), F.lit(2).alias("line"), library.alias("is_library")))
    many = S.inner_frames(F.transform(F.sequence(F.lit(1), (k % 30 + 1).cast("int")), lambda i: F.concat(F.lit("f"), i.cast("string"))), 5)
    return e.select(
        k.alias("k"), library.alias("library"), S.user_frame(frames)["file"].alias("user"), S.headline(frames, F.lit("x")).alias("head"), F.array_join(S.chain_head(F.array(*map(F.lit, "abcd"))), ",").alias("chain"),
        F.concat_ws("-", F.element_at(many, 1), F.element_at(many, -1)).alias("inner_ends"), F.round(S.jitter("file", 0.5), 6).alias("jitter"),
    )


# changes, resolution, selection --------------------------------------------------------

_DIFF = """d AS (SELECT p_partkey AS k, p_partkey % 30 AS a, p_partkey % 4 AS n FROM part)"""


def diff_rows(spark: SparkSession, sf: str) -> DataFrame:
    """A diff a part: a hunk that adds 0 to 3 lines to a source file, and a test file that is renamed, deleted or changed."""
    k = F.col("p_partkey")
    s = lambda c: c.cast("string")
    n, a = k % 4, k % 30
    head = F.concat(F.lit("diff --git a/src/f"), s(a), F.lit(".py b/src/f"), s(a), F.lit(".py\n--- a/src/f"), s(a), F.lit(".py\n+++ b/src/f"), s(a), F.lit(".py\n@@ -"), s(a + 1), F.lit(",2 +"), s(a + 1), F.lit(","), s(n), F.lit(" @@ def g"), s(k), F.lit("():\n-old\n--- not a header\n"))
    added = F.repeat(F.lit("+new\n"), n.cast("int"))
    renamed = F.concat(F.lit("diff --git a/tests/test_a.py b/lib/a.py\nrename from tests/test_a.py\nrename to lib/a.py\n"))
    deleted = F.lit("diff --git a/tests/test_b.py b/tests/test_b.py\ndeleted file mode 100644\n--- a/tests/test_b.py\n+++ /dev/null\n@@ -1,2 +0,0 @@\n-def test_b():\n-    assert 1 == 1")
    plain = F.lit("diff --git a/x.txt b/x.txt\n--- a/x.txt\n+++ b/x.txt\n@@ -1 +1 @@\n-a\n+b")
    tail = F.when(k % 3 == 0, renamed).when(k % 3 == 1, deleted).otherwise(plain)
    return table(spark, sf, "part").select(k.alias("diff"), F.concat(head, added, tail).alias("text"))


@query(f"""WITH {_DIFF} {_said("hunk", "k;$$src/f$$ || a || $$.py$$;a + 1;greatest(a + 1, a + n)", "FROM d")} UNION ALL {_said("added", "k;$$src/f$$ || a || $$.py$$;a + 1 + v.i", "FROM d, (VALUES (0), (1), (2)) v(i) WHERE v.i < n")}
UNION ALL {_said("line", "k;sign;count(*)", "FROM (SELECT k, '-' AS sign, 2 AS c FROM d UNION ALL SELECT k, '+', n FROM d UNION ALL SELECT k, '-', 2 FROM d WHERE k % 3 = 1 UNION ALL SELECT k, '-', 1 FROM d WHERE k % 3 = 2 UNION ALL SELECT k, '+', 1 FROM d WHERE k % 3 = 2) x, range(c::BIGINT) GROUP BY k, sign")}
UNION ALL {_said("signal", "k;CASE k % 3 WHEN 0 THEN $$tests/test_a.py|TEST_FILE_RENAMED_OUT|1$$ ELSE $$tests/test_b.py|TEST_FILE_DELETED|1$$ END", "FROM d WHERE k % 3 < 2")}
UNION ALL {_said("status", "CASE k % 4 WHEN 0 THEN $$new$$ || k || $$.py$$ WHEN 1 THEN $$b$$ || k || $$.py$$ ELSE $$with space$$ || k || $$.py$$ END;CASE k % 4 WHEN 0 THEN $$??$$ WHEN 1 THEN $$R $$ ELSE $$ M$$ END", "FROM d WHERE k % 4 <> 3")}""")
def diffs_parsed(spark, sf):
    """SC22, SC23, SC24, SC27, WN6, XT21, XT23: hunks, added lines, signs, test files, status lines of diffs."""
    d = cut(diff_rows(spark, sf))
    lines = changes.filled(changes.lines_of(d)).where("sign is not null").groupBy("diff", "sign").agg(F.count("*").alias("n"))
    signals = changes.test_signals(changes.test_lines(d)).where(F.col("signal").isin("TEST_FILE_RENAMED_OUT", "TEST_FILE_DELETED"))
    k = F.col("diff")
    status = F.when(k % 4 == 0, F.concat(F.lit("?? new"), k.cast("string"), F.lit(".py"))).when(k % 4 == 1, F.concat(F.lit("R  a.py -> b"), k.cast("string"), F.lit(".py"))).when(k % 4 == 2, F.concat(F.lit(' M "with space'), k.cast("string"), F.lit('.py"'))).otherwise(F.concat(F.lit(" D gone"), k.cast("string")))
    return together(
        said(changes.hunks(d), "hunk", "diff", "path", "start", "stop"), said(changes.added_lines(d), "added", "diff", "path", "at"), said(lines, "line", "diff", "sign", "n"), said(signals, "signal", "diff", "path", "signal", "n"),
        said(changes.porcelain(d.select(status.alias("line"))), "status", "path", "state"),
    )


@query(f"""WITH p AS (SELECT p_partkey AS k, 'f' || p_partkey % 50 || '.py' AS path FROM part), f AS (SELECT path, min(k) AS lo FROM p GROUP BY 1)
{_said("silencio", "path;k", "FROM p WHERE k % 5 = 0 AND k % 10 = 0")} UNION ALL {_said("cuerpo-crecido", "path;k;40", "FROM p WHERE k % 5 = 1 AND k % 2 = 1")} UNION ALL {_said("retorno-nulo", "path;k", "FROM p WHERE k % 5 = 2 AND k % 3 = 0")} UNION ALL {_said("guarda-quitada", "path;k", "FROM p WHERE k % 5 = 3 AND k % 4 = 0")}
UNION ALL {_said("grown", "path;40", "FROM p WHERE k % 5 = 1 AND k % 2 = 1")} UNION ALL {_said("misfit", "k", "FROM p WHERE k % 6 = 0 AND k % 4 = 0")} UNION ALL {_said("touched", "$$f$$ || i", "FROM range(50) r(i) WHERE i % 2 = 0 AND EXISTS (SELECT 1 FROM p WHERE path = 'f' || i || '.py')")}""")
def fact_deltas(spark, sf):
    """CH5, CH24, AG10, TK6, XT12, XT26: facts that a change added, grown bodies, calls that do not fit, touched modules."""
    k = F.col("k")
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("k")).withColumn("path", F.concat(F.lit("f"), (k % 50).cast("string"), F.lit(".py")))
    name, void = k.cast("string"), F.lit(None)

    def facts(fact: str, rows: DataFrame, text: Column, size: Column) -> DataFrame:
        return rows.select("path", F.lit(fact).alias("fact"), name.alias("name"), k.cast("int").alias("line"), (k + size).cast("int").alias("end"), text.cast("string").alias("text"))

    some = lambda n: p.where(k % 5 == n)
    zero = F.lit(0)
    now = together(facts("silencio", some(0), name, zero), facts("cuerpo", some(1), void, F.when(k % 2 == 1, 49).otherwise(9)), facts("retorno", some(2), F.when(k % 3 == 0, "int | None").otherwise("int"), zero), facts("guarda", some(3).where("k % 4 != 0"), name, zero))
    before = together(facts("silencio", some(0).where("k % 10 != 0"), name, zero), facts("cuerpo", some(1), void, F.lit(9)), facts("retorno", some(2), F.lit("int"), zero), facts("guarda", some(3), name, zero))
    # every path of the former state is still there
    now = now.unionByName(facts("amplio", p.where("false"), name, zero)).unionByName(facts("visto", p, name, zero))
    delta = cut(changes.fact_delta(now, before))
    at = F.coalesce(F.when(F.col("category") == "cuerpo-crecido", F.concat_ws("|", "name", "text")), F.when(F.col("category") == "guarda-quitada", F.col("name")), F.col("name"))
    calls = p.where("k % 6 = 0").select("path", k.alias("at"), F.lit("f").alias("name"), (k % 4).alias("given"))
    misfit = changes.misfit_calls(calls, p.select("path", k.alias("at")), spark.createDataFrame([("f", "(a)", "function"), ("g", "(a)", "function"), ("g", "(b)", "function")], "name string, sig string, kind string"), S.fits("sig", F.col("given").cast("int"), F.array().cast("array<string>"), F.lit(False)))
    modules = spark.range(0, 50, 2).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("module"))
    return together(*[r.select("what", "item") for r in (delta.select(F.col("category").alias("what"), F.concat_ws("|", "path", at).alias("item")), said(changes.grown(delta), "grown", "path", "by"), said(misfit.where("given = 0"), "misfit", "at"), said(changes.touched_modules(p, modules), "touched", "module"))])


_PY = 25


def python_files(spark: SparkSession, sf: str) -> DataFrame:
    """A Python module a nation, each importing the next and calling it."""
    k = F.col("n_nationkey")
    s = lambda c: c.cast("string")
    text = F.concat(
        F.lit("'''Module "), s(k), F.lit(".'''\nimport m"), s((k + 1) % _PY), F.lit("\nfrom m"), s((k + 2) % _PY), F.lit(" import run as go\nfrom m"), s((k + 3) % _PY), F.lit(" import missing as there\n\nclass Base:\n    def step(self, x, *, y='"), F.lit("z" * 40),
        F.lit("'):\n        return self.other(x)\n    def other(self, x): ...\n\nclass Sub(Base):\n    pass\n\nasync def run(a, b=1, *args, **kw):\n    '''Runs "), s(k), F.lit("\n    more'''\n    go(a)\n    m"), s((k + 1) % _PY), F.lit(".run(b)\n    print(len(a))\n    a.thing()\n    return [Base]\n"),
        F.when(k % 5 == 0, "def broken(:\n").otherwise(""),
    )
    return table(spark, sf, "nation").select(F.concat(F.lit("m"), s(k), F.lit(".py")).alias("path"), F.concat(F.lit("m"), s(k)).alias("module"), text.alias("text"), F.lit(False).alias("is_pkg"), F.lit("python").alias("lang"))


_PYTHON = """k AS (SELECT n_nationkey AS k, 'm' || n_nationkey AS m FROM nation), g AS (SELECT k, m, 'm' || (k + 1) % 25 AS m1, 'm' || (k + 2) % 25 AS m2, 'm' || (k + 3) % 25 AS m3 FROM k WHERE k % 5 <> 0), ok AS (SELECT m FROM g)"""


@query(f"""WITH {_PYTHON} {_said("error", "m || $$.py$$", "FROM k WHERE k % 5 = 0")} UNION ALL {_said("import", "m;t", "FROM (SELECT m, m1 AS t FROM g UNION ALL SELECT m, m2 || '.run' FROM g UNION ALL SELECT m, m3 || '.missing' FROM g)")}
UNION ALL {_said("alias", "m;a;t", "FROM (SELECT m, m1 AS a, m1 AS t FROM g UNION ALL SELECT m, 'go', m2 || '.run' FROM g UNION ALL SELECT m, 'there', m3 || '.missing' FROM g)")}
UNION ALL {_said("symbol", "m || s.q;s.kind;s.sig;CASE s.q WHEN $$$$ THEN $$Module $$ || k || $$.$$ WHEN $$.run$$ THEN $$Runs $$ || k ELSE $$$$ END", "FROM g, (VALUES ('', 'module', NULL), ('.Base', 'class', ''), ('.Base.step', 'method', '(self, x, *, y=''' || repeat('z', 23) || '…)'), ('.Base.other', 'method', '(self, x)'), ('.Sub', 'class', '(Base)'), ('.run', 'function', 'async (a, b=1, *args, **kw)')) s(q, kind, sig)")}
UNION ALL {_said("edge", "m || e.a;CASE WHEN e.b = $$2$$ THEN m2 || $$.run$$ WHEN e.b = $$1$$ THEN m1 || $$.run$$ ELSE m || e.b END;e.t", "FROM g, (VALUES ('', '.Base', 'DEFINES'), ('', '.Sub', 'DEFINES'), ('', '.run', 'DEFINES'), ('.Base.step', '.Base', 'MEMBER_OF'), ('.Base.other', '.Base', 'MEMBER_OF'), ('.Sub', '.Base', 'EXTENDS'), ('.Base.step', '.Base.other', 'CALLS'), ('.run', '2', 'CALLS'), ('.run', '1', 'CALLS')) e(a, b, t) WHERE (e.b <> '2' OR m2 IN (FROM ok)) AND (e.b <> '1' OR m1 IN (FROM ok))")}
UNION ALL {_said("unresolved", "r;n", "FROM (SELECT 'builtin' AS r, 2 * count(*) AS n FROM g UNION ALL SELECT 'nombre-desconocido', count(*) FROM g WHERE m2 NOT IN (FROM ok) UNION ALL SELECT 'atributo-de-variable', count(*) + count(*) FILTER (m1 NOT IN (FROM ok)) FROM g)")}
UNION ALL {_said("value", "m || $$.Base$$;m || $$.run$$", "FROM g")} UNION ALL {_said("broken", "m || $$.py$$;m3 || $$.missing$$", "FROM g WHERE m3 IN (FROM ok)")} UNION ALL {_said("module", "m;t", "FROM (SELECT m, m1 AS t FROM g UNION SELECT m, m2 FROM g UNION SELECT m, m3 FROM g) WHERE t IN (FROM ok)")}""")
def python_facts(spark, sf):
    """FX1, FX2, FX4 to FX12, FX14 to FX16: imports, names, signatures, symbols and their graph from sources."""
    from codefacts.operators import extract

    f = cut(extract.facts(python_files(spark, sf)))
    s = extract.symbols(f)
    edges, unresolved, named = extract.symbol_graph(f)
    mods = s.where("kind = 'module'").select("module")
    return together(
        said(extract.errors(f), "error", "path"), said(extract.raw_imports(f), "import", "module", "target"), said(extract.aliases(f), "alias", "module", "alias", "target"), said(s, "symbol", "qual", "kind", "sig", F.coalesce("doc", F.lit(""))), said(edges, "edge", "src", "dst", "etype"),
        said(unresolved, "unresolved", "reason", "n"), said(named, "value", "qual", "body"), said(extract.broken_imports(f), "broken", "path", "missing"), said(resolve.module_graph(extract.raw_imports(f), mods), "module", "src", "dst"),
    )


@query(f"""WITH {_PYTHON} {_said("abstract", "m || $$.A$$;1", "FROM k")} UNION ALL {_said("fact", "m || $$.py$$;s.f;s.t", "FROM k, (VALUES ('silencio', 'except ValueError:'), ('amplio', 'except Exception:'), ('pendiente', 'NotImplementedError'), ('guarda', 'if not x: raise ValueError(x)'), ('retorno', 'int | None')) s(f, t)")}
UNION ALL {_said("coverage", "10;5;0.666667", "")} UNION ALL {_said("panic", "l;t;f;n", "FROM (VALUES ('go', 'nil-pointer', '/a/main.go', 12), ('rust', 'unwrap-none', 'src/lib.rs', 7), ('dart', 'panic', 'bin/x.dart', 3)) v(l, t, f, n)")}
UNION ALL {_said("launcher", "x", "FROM (VALUES ('a.sh')) v(x)")} UNION ALL {_said("patched", "$$t.py$$;x", "FROM (VALUES ('pkg.mod.run'), ('pkg.other.stop')) v(x)")}""")
def code_shapes(spark, sf):
    """FX17, FX18, FX19, FX33, FX34, XT37: abstract classes, handlers and guards, coverage, panics, launchers, doubles."""
    from codefacts.operators import extract

    text = "from abc import ABC, abstractmethod\n\nclass A(ABC):\n    @abstractmethod\n    def f(self): ...\n\nclass B(A):\n    def f(self, x) -> int | None:\n        if not x:\n            raise ValueError(x)\n        try:\n            x()\n        except ValueError:\n            pass\n        except Exception:\n            x.log()\n        raise NotImplementedError\n"
    files = table(spark, sf, "nation").select(F.concat(F.lit("m"), F.col("n_nationkey").cast("string")).alias("module")).select(F.concat("module", F.lit(".py")).alias("path"), "module", F.lit(text).alias("text"), F.lit(False).alias("is_pkg"), F.lit("python").alias("lang"))
    f = cut(extract.facts(files))
    # classes of one name in every file: subclasses are counted by distinct names
    facts = extract.code_facts(f).where("fact != 'cuerpo'")
    edges = spark.range(10).select(F.lit("CALLS").alias("etype"))
    unresolved = spark.createDataFrame([("builtin", 7), ("nombre-ambiguo", 5)], "reason string, n long")
    out = spark.createDataFrame([(1, "panic: runtime error: invalid memory address or nil pointer dereference\n\ngoroutine 1 [running]:\nmain.main()\n\t/a/main.go:12 +0x1\n"), (2, "thread 'main' panicked at src/lib.rs:7:5:\ncalled `Option::unwrap()` on a `None` value\n"), (3, "Unhandled exception:\nodd thing\n#0 main (file://bin/x.dart:3:5)\n")], "id int, text string")
    panics = extract.panics(out, S.panic_type("message", extract.PANIC_TYPES))
    lines = spark.createDataFrame([("t.py", "@mock.patch('pkg.mod.run')"), ("t.py", 'monkeypatch.setattr("pkg.other.stop", None)'), ("t.py", "patch('bare')")], "path string, line string")
    return together(
        said(resolve.abstract_once(extract.classes(f)), "abstract", "qual", "implementations"), said(facts, "fact", "path", "fact", "text"), said(resolve.coverage(edges, unresolved), "coverage", "resolved", "unresolved", "share"), said(panics, "panic", "language", "type", "file", "line"),
        said(resolve.launchers(spark.createDataFrame([("a.sh", "b.py"), ("a.sh", "c.py")], "src string, dst string")), "launcher", "node"), said(resolve.patched(lines), "patched", "path", "target"),
    )


@query(f"""WITH {_SYM}, one AS (SELECT name, regexp_extract(module, '([^.]*)$', 1) AS tail, min(qual) AS qual, count(DISTINCT qual) AS n FROM sym GROUP BY 1, 2), asked AS (SELECT k, 'x.m' || (k % 50) || '.' || CASE WHEN k % 7 = 0 THEN '__call__' ELSE 'f' || k END AS called FROM sym),
a AS (SELECT *, split_part(called, '.', 2) AS tail, split_part(called, '.', 3) AS name FROM asked), ren AS (SELECT module FROM mods WHERE m % 2 = 0)
{_said("qualified", "k;CASE WHEN n = 1 THEN qual END;CASE WHEN n IS NULL THEN $$nombre-desconocido$$ WHEN n > 1 THEN $$nombre-ambiguo$$ END", "FROM a LEFT JOIN one USING (name, tail)")}
UNION ALL {_said("package", "s;d", "FROM (SELECT 'src' || m AS s, module AS d FROM mods WHERE starts_with(module, 'pkg.'))")} UNION ALL {_said("imports", "src;dst", "FROM imports")}
UNION ALL {_said("merged", "src;dst", "FROM (FROM imports UNION SELECT CASE WHEN src IN (SELECT src FROM imports UNION SELECT dst FROM imports) THEN src || ':ext' ELSE src END, 'other' FROM imports)")}
UNION ALL {_said("report", "q;m", "FROM (SELECT qual AS q, module AS m FROM sym WHERE m = 1 UNION SELECT CASE WHEN m = 1 THEN qual || ':ext' ELSE qual END, CASE WHEN m = 1 THEN module || ':ext' ELSE module END FROM sym WHERE m IN (1, 2))")} UNION ALL {_said("counter", "c;n", "FROM (VALUES ('calls', 7), ('resolved', 3)) v(c, n)")}
UNION ALL {_said("modules", "m", "FROM (SELECT module AS m FROM mods UNION SELECT 'lonely')")} UNION ALL {_said("context", "k;qual", "FROM sym WHERE kind = 'function'")}""")
def engines_merged(spark, sf):
    """FX22, FX23, FX27, FX28, FX29, XT38, XT42: names across engines, packages, merged graphs and reports."""
    sym = cut(symbol_rows(spark, sf))
    mods, k = module_rows(sym), F.col("k")
    imports = cut(import_edges(mods))
    asked = sym.select(k.cast("string").alias("body"), F.concat(F.lit("x.m"), (k % 50).cast("string"), F.lit("."), F.when(k % 7 == 0, "__call__").otherwise(F.concat(F.lit("f"), k.cast("string")))).alias("called"))
    specs = mods.where("module like 'pkg.%'").select(F.concat(F.lit("src"), F.col("m").cast("string")).alias("src"), F.concat(F.lit("com/ACME/PKG/M"), F.col("m").cast("string")).alias("spec"))
    etyped = imports.withColumn("etype", F.lit("IMPORTS")).unionByName(spark.createDataFrame([("a", "b", "CALLS")], "src string, dst string, etype string"))
    other = imports.select("src", F.lit("other").alias("dst"))
    empty = spark.createDataFrame([], "src string, dst string, etype string")
    counts = lambda *rows: spark.createDataFrame(list(rows), "name string, n long")
    nodes, _, counters = resolve.merge_reports(sym.where("m = 1"), empty, counts(("calls", 4), ("resolved", 3)), sym.where("m in (1, 2)"), empty, counts(("calls", 3)))
    contexts = sym.where("kind = 'function'").select(k, F.col("qual").alias("context"))
    own = resolve.context_map(contexts, sym).join(contexts, "context")
    lonely = spark.createDataFrame([("lonely",)], "node string")
    return together(
        said(resolve.qualified_calls(asked, sym).join(asked.select("body"), "body"), "qualified", "body", "dst", "reason"), said(resolve.packages(specs, mods), "package", "src", "dst"), said(resolve.import_graph(etyped), "imports", "src", "dst"), said(resolve.merge_engines(imports, other), "merged", "src", "dst"),
        said(nodes, "report", "qual", "module"), said(counters, "counter", "name", "n"), said(resolve.known_modules(mods.select(F.lit("module").alias("kind"), F.col("module").alias("qual")), lonely), "modules", "module"), said(own, "context", "k", "qual"),
    )


@query(f"""WITH {_SYM}, ctx AS (SELECT file, line + 1 AS line, 't' || (k % 3) AS c FROM sym WHERE k % 5 > 1), truth AS (SELECT qual, string_agg(DISTINCT c, ',' ORDER BY c) AS c FROM sym JOIN ctx ON sym.file = ctx.file AND sym.line <= ctx.line AND ctx.line <= sym."end" GROUP BY 1),
near AS (SELECT k, qual FROM sym WHERE kind = 'function'), gaps AS (SELECT src, dst FROM calls WHERE length(src) % 2 = 0)
{_said("truth", "qual;c", "FROM truth")} UNION ALL {_said("located", "k;qual", "FROM near")} UNION ALL {_said("enclosing", "k;qual", "FROM near")} UNION ALL {_said("leak", "x", "FROM (VALUES ('test_b.py')) v(x)")}
UNION ALL {_said("green", "q;m;s", "FROM (VALUES ('a', 0, 0.75::DOUBLE), ('b', 1, 0.5::DOUBLE)) v(q, m, s)")} UNION ALL {_said("missing", "src;dst", "FROM (SELECT src, min(dst) AS dst FROM gaps GROUP BY src)")}""")
def coverage_truth(spark, sf):
    """GR46, GR47, GR48, GR49, GR50, AG13, FX24, XT34: what tests really ran, leaks and missing edges."""
    sym = cut(symbol_rows(spark, sf))
    k = F.col("k")
    ctx = sym.where("k % 5 > 1").select("file", (F.col("line") + 1).alias("line"), F.concat(F.lit("t"), (k % 3).cast("string")).alias("context"))
    truth = impact.covered_truth(sym, ctx)
    points = sym.where("kind = 'function'").select(k.alias("p"), F.col("file").alias("path"), F.col("line").alias("at"))
    named = sym.select("qual", "file", "line", "end", "module")
    red = spark.createDataFrame([("a/test_a.py",), ("b/test_b.py",)], "path string")
    chosen = spark.createDataFrame([("x/test_a.py",)], "path string")
    greens = impact.false_greens(spark.createDataFrame([("a", ["t1"]), ("b", ["t1", "t2"])], "qual string, contexts array<string>"), spark.createDataFrame([("a", ["t1"], 4), ("b", ["t1", "t3"], 4)], "qual string, selected array<string>, total int"))
    calls = cut(call_edges(spark, sf, sym))
    gaps = calls.where(F.length("src") % 2 == 0)
    seeds = gaps.select(F.col("src").alias("key"), F.col("src").alias("node")).distinct()
    first = graph.first_missing(calls, calls.join(gaps, ["src", "dst"], "left_anti"), seeds, 1).where("depth = 0")
    return together(
        said(truth, "truth", "qual", F.array_join("contexts", ",")), said(spans.located(points, named, ["p"]), "located", "p", "qual"), said(spans.enclosing(points, named, ["p"]), "enclosing", "p", "body"), said(impact.leaks(red, chosen, False), "leak", "name"), said(greens, "green", "qual", "missed", "saving"),
        said(first, "missing", "src", "dst"),
    )


# parallel work, sets, notes, rules ---------------------------------------------------------


@query(f"""WITH {_SYM}, ev AS (SELECT floor(epoch(ts))::BIGINT AS ts, user_id % 3 AS agent, event_id AS id, floor(value / 25)::BIGINT AS node, CASE WHEN event_id % 4 = 0 THEN 'edicion' ELSE 'commit' END AS kind FROM events),
f AS (SELECT node, agent, ts AS t0, CASE WHEN kind = 'commit' THEN id END AS sha FROM ev QUALIFY row_number() OVER (PARTITION BY node, agent ORDER BY ts, CASE WHEN kind = 'commit' THEN id END NULLS FIRST) = 1),
p AS (SELECT a.agent AS src, b.agent AS dst, a.node, a.t0, min(b.ts) AS t1, any_value(a.sha) AS sha FROM f a JOIN ev b ON a.node = b.node AND a.agent <> b.agent AND b.ts > a.t0 GROUP BY ALL), born AS (SELECT module, m FROM mods WHERE m % 10 = 1)
{_said("inherited", "src;dst;node;t0;t1;CASE WHEN sha IS NOT NULL THEN sha % 2 = 0 END", "FROM p")} UNION ALL {_said("work", "b;w", "FROM (VALUES ('a', true), ('b', true), ('c', false)) v(b, w)")}
UNION ALL {_said("event", "agent;sha;nodes", "FROM (SELECT agent, id AS sha, string_agg(DISTINCT node::VARCHAR, ',') AS nodes FROM ev WHERE node % 3 = 0 GROUP BY 1, 2)")} UNION ALL {_said("born", "module", "FROM born")}
UNION ALL {_said("link", "a;b", "FROM (SELECT DISTINCT born.module AS a, t.module AS b FROM born JOIN mods t ON t.m = (born.m * 3 + 2) % 40 WHERE t.module <> born.module)")} UNION ALL {_said("notice", "2;1", "")}""")
def parallel_work(spark, sf):
    """CH12, CH14, SC29, SC30, WN4, XT11, XT20, XT41: inheritance of commits, branches with work, newborn modules and their links, the notice."""
    e = table(spark, sf, "events")
    ev = cut(e.select(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("ts"), (F.col("user_id") % 3).alias("agent"), F.col("event_id").alias("id"), F.floor(F.col("value") / 25).alias("node"), F.when(F.col("event_id") % 4 == 0, "edicion").otherwise("commit").alias("kind")))
    people = ev.select("agent").distinct()
    ancestry = ev.where("id % 2 = 0").select(F.col("id").alias("sha")).join(F.broadcast(people), how="cross")  # three agents
    found = activity.inherited(ev, ancestry)
    work = activity.has_work(spark.createDataFrame([("a",)], "branch string"), spark.createDataFrame([("b", "x.py"), ("c", "conftest.py"), ("c", "x.txt")], "branch string, path string"))
    log_ = ev.select("agent", F.col("id").alias("sha"), "ts", F.col("node").cast("string").alias("path"))
    events = activity.events_of(log_, ev.where("node % 3 = 0").select(F.col("node").cast("string").alias("path"), "node").distinct())
    mods = module_rows(cut(symbol_rows(spark, sf)))
    old, born = mods.where("m % 10 != 1"), activity.newborn(mods, mods.where("m % 10 != 1"))
    raw = mods.where("m % 10 = 1").select("module", ((F.col("m") * 3 + 2) % 40).alias("m2")).join(mods.select(F.col("module").alias("t"), F.col("m").alias("m2")), "m2").select("module", F.concat("t", F.lit(".x")).alias("target"))
    debts = spark.createDataFrame([("a", "mismo-nodo"), ("b", "vecino")], "agent string, class string")
    return together(
        said(found, "inherited", "src", "dst", "node", "ts_src", "ts_dst", "inherited"), said(work, "work", "branch", "work"), said(events, "event", "agent", "id", F.array_join("nodes", ",")), said(born, "born", "module"), said(activity.newborn_links(raw, born, old), "link", "src", "dst"),
        said(activity.sync_notice(debts, 2).unionByName(activity.sync_notice(debts, 1)), "notice", "pending", "clashes"),
    )


@query(f"""WITH {_SYM}, old AS (SELECT * FROM imports WHERE length(src) % 2 = 0), both AS (SELECT 1), dg AS (SELECT string_agg(path || ':' || h, chr(10) ORDER BY path) AS all_ FROM (SELECT 'd' || doc_id AS path, sha256(text) AS h FROM documents))
{_said("together", "src;dst", "FROM (FROM imports UNION FROM ext)")} UNION ALL {_said("shared", "module", "FROM mods WHERE m % 6 = 0")} UNION ALL {_said("tree", "sha256(all_)", "FROM dg")} UNION ALL {_said("full", "src || $$ -> $$ || dst", "FROM imports")}
UNION ALL {_said("added", "src || $$ -> $$ || dst", "FROM (FROM imports EXCEPT FROM old)")} UNION ALL {_said("file", "file;string_agg(line || $$:$$ || qual, $$,$$ ORDER BY line, qual)", "FROM sym GROUP BY file")} UNION ALL {_said("legend", "x", "FROM (VALUES ('CALLS'), ('EXTENDS')) v(x) WHERE x = 'EXTENDS' OR EXISTS (FROM calls)")}""".replace("both AS (SELECT 1), ", ""))
def shapes_and_maps(spark, sf):
    """ST2, ST4, ST6, ST7, XT13, XT14, XT40, CH28: unions, intersections, digests, session maps, symbols by file."""
    sym = cut(symbol_rows(spark, sf))
    mods = module_rows(sym)
    imports, ext = cut(import_edges(mods)), extends_edges(sym)
    files = table(spark, sf, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), "text")
    old = imports.where(F.length("src") % 2 == 0)
    by_file = search.by_file(sym).select("file", F.array_join(F.transform("symbols", lambda x: F.concat_ws(":", x["line"].cast("string"), x["qual"])), ",").alias("all"))
    kinds = call_edges(spark, sf, sym).unionByName(ext)
    return together(
        said(sets.together(imports, ext.select("src", "dst")), "together", "src", "dst"), said(sets.shared(mods.where("m % 2 = 0").select("module"), mods.where("m % 3 = 0").select("module")), "shared", "module"), said(sets.tree_fingerprint(files), "tree", "fingerprint"), said(sets.session_map(imports, None), "full", "item"),
        said(sets.session_map(imports, old).where("change = 'added'"), "added", "item"), said(sets.session_map(old, old), "silent", "item"), said(by_file, "file", "file", "all"), said(search.legend(kinds), "legend", "etype"),
    )


@query("""WITH n AS (SELECT p_partkey AS k, 'n' || lpad(p_partkey::VARCHAR, 9, '0') AS name, p_name AS description, CASE p_partkey % 3 WHEN 0 THEN 'always' WHEN 1 THEN 'project:shop' ELSE 'project:other' END AS scope FROM part) """ + " UNION ALL ".join([
    _said("note", "name;CASE WHEN k % 3 < 2 OR k % 5 = 0 THEN $$body $$ || k END;k % 3 = 2 AND k % 5 <> 0", "FROM n"), _said("line", "$$- $$ || name || $$: $$ || description", "FROM n"), _said("query", "$$p$$ || k", "FROM n WHERE k % 2 = 0"), _said("use", "x;y", "FROM (VALUES ('pkg.a', true), ('pkg.b.f', false)) v(x, y)"),
    _said("ungoverned", "x;y", "FROM (VALUES ('c.d', 'e')) v(x, y)"), _said("law", "k;CASE WHEN k % 2 = 0 THEN $$2 lineas mal escritas$$ ELSE $$$$ END", "FROM n WHERE k % 40 = 0 OR k % 40 = 1"), _said("rule", "0;$$app$$;$$db$$", ""), _said("rule", "1;$$ui$$;$$db$$", ""), _said("declared", "$$app$$;$$bus$$", "")]))
def notes_and_rules(spark, sf):
    """XT1, XT2, XT9, XT10, RB1, RB10, RB12, GR5, WN8: notes of a session, hook queries, uses as values, rules read and applied."""
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k.alias("k"), F.concat(F.lit("n"), F.lpad(k.cast("string"), 9, "0")).alias("name"), F.col("p_name").alias("description"), F.when(k % 3 == 0, "always").when(k % 3 == 1, "project:shop").otherwise("project:other").alias("scope"), F.when(k % 5 == 0, F.array(F.lit("shop"))).otherwise(F.array(F.lit("x"))).alias("tags"), F.concat(F.lit("body "), k.cast("string")).alias("body"), F.lit(False).alias("broken"))
    k = F.col("k")
    hooks = p.select(F.when(k % 2 == 0, F.concat(F.lit('{"tool_input": {"pattern": "p'), k.cast("string"), F.lit('"}}'))).otherwise("{oops").alias("value"))
    named = spark.createDataFrame([("q", "pkg.a.<modulo>"), ("q", "pkg.b.f"), ("z", "pkg.c")], "qual string, body string")
    read = rules.parse("CORE = app, ui  # both\nCORE -/-> db\napp => bus\napp.x ::\n")
    table_ = rules.rule_table(spark, read.forbidden)
    new = spark.createDataFrame([("app.x", "e"), ("c.d", "e"), ("tests.t", "e")], "src string, dst string")
    law = p.where("k % 40 in (0, 1)").select("k", F.array_join(rules.uncheckable(F.when(k % 2 == 0, 2).otherwise(0), F.lit(0), F.lit(0), F.lit(0)), ",").alias("why"))
    declared = graph.declared(new.limit(0), spark.createDataFrame([*read.declared, ("a", "a")], "src string, dst string"))
    return together(
        said(search.session_notes(p, "shop"), "note", "name", "body", "foreign"), said(search.index_lines(p), "line", "line"), said(search.hook_query(hooks), "query", "text"), said(search.value_uses(named, "q"), "use", "body", "module_level"), said(rules.ungoverned(new, rules.all_patterns(table_)), "ungoverned", "src", "dst"),
        said(law, "law", "k", "why"), said(table_, "rule", "rule_ord", "src_pat", "dst_pat"), said(declared, "declared", "src", "dst"),
    )
