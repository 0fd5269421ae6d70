"""Queries over the driver's tables, one or more per family of operators; ``ORACLES`` has the same rows in DuckDB's SQL.

The demo graph links two parts of an order that follow each other on lines of
large quantity.  It is cyclic at 38 and without cycles at 42.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codefacts.functions import scalars as S
from codefacts.operators import activity, changes, graph, impact, log, resolve, rules, search, sets, spans
from codefacts.session import cut, table
from codefacts.streaming.mailbox import normalised

BASELINE = "1997-01-01"
FORBIDDEN = [("AFRICA", "ASIA"), ("AMERICA.NATION_1", "EUROPE"), ("AFRICA.NATION_0", "ASIA.NATION_12"), ("ASIA", "AFRICA.NATION_5"), ("NOWHERE", "ASIA")]
SURFACES = [("ASIA", ["NATION_12", "NATION_2"]), ("EUROPE.NATION_3", [])]
TERMS = "license public the version"
PENDING_DAYS = 7


def parts_graph(spark: SparkSession, sf: str, least: int = 38, until: str | None = None) -> DataFrame:
    """PE38: distinct (src, dst) of parts on following lines of an order, both of at least so large a quantity."""
    lines = table(spark, sf, "lineitem").where(F.col("l_quantity") >= least).select("l_orderkey", "l_linenumber", "l_partkey")
    if until:
        kept = table(spark, sf, "orders").where(F.col("o_orderdate") < F.lit(until).cast("timestamp_ntz")).select(F.col("o_orderkey").alias("l_orderkey"))
        lines = lines.join(kept, "l_orderkey", "left_semi")
    a = lines.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.col("l_partkey").alias("src"))
    b = lines.select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("dst"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).where("src != dst").select("src", "dst").distinct()


def _parts(least: int = 38, until: str | None = None, name: str = "pe") -> str:
    day = f" AND a.l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '{until}')" if until else ""
    return f"""{name} AS (SELECT DISTINCT a.l_partkey AS src, b.l_partkey AS dst FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
  WHERE a.l_quantity >= {least} AND b.l_quantity >= {least} AND a.l_partkey <> b.l_partkey{day})"""


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# graph ---------------------------------------------------------------------


@query(f"""WITH {_parts()}, i AS (SELECT dst AS node, count(*) AS fan_in FROM pe GROUP BY 1), o AS (SELECT src AS node, count(*) AS fan_out FROM pe GROUP BY 1)
SELECT p_partkey AS node, p_brand AS brand, coalesce(fan_in, 0)::BIGINT AS fan_in, coalesce(fan_out, 0)::BIGINT AS fan_out FROM part LEFT JOIN i ON p_partkey = i.node LEFT JOIN o ON p_partkey = o.node
WHERE fan_in > 0 ORDER BY fan_in DESC, p_partkey LIMIT 10""")
def fan_degree_topk(spark, sf):
    """GR6, TK1: the parts with most ways in."""
    parts = table(spark, sf, "part").select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("brand"))
    return graph.top(graph.degrees(parts, parts_graph(spark, sf)).join(parts, "node").select("node", "brand", "fan_in", "fan_out"), "fan_in", "node", 10)


_SCC = f"""WITH RECURSIVE {_parts()}, r AS (SELECT src AS a, dst AS b FROM pe UNION SELECT r.a, pe.dst FROM r JOIN pe ON r.b = pe.src),
mutual AS (SELECT x.a AS node, least(x.a, min(x.b)) AS scc FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a)"""


@query(_SCC + " SELECT scc, count(*)::BIGINT AS size, string_agg(node::VARCHAR, ',' ORDER BY node) AS members FROM mutual GROUP BY scc")
def scc_cycles(spark, sf):
    """GR1, TK2: cycles of the demo graph."""
    return graph.cycles(graph.components(parts_graph(spark, sf))).select("scc", "size", F.array_join("members", ",").alias("members"))


@query(_SCC + " SELECT x.node AS a, y.node AS b FROM mutual x JOIN mutual y ON x.scc = y.scc AND x.node < y.node")
def co_cyclic_pairs(spark, sf):
    """GR2."""
    return graph.cyclic_pairs(graph.components(parts_graph(spark, sf)))


@query(_SCC + " SELECT pe.src, pe.dst, x.scc FROM pe JOIN mutual x ON pe.src = x.node JOIN mutual y ON pe.dst = y.node AND x.scc = y.scc")
def cycle_edges_real(spark, sf):
    """CH27: every step inside a cycle is an edge."""
    scc = cut(graph.components(parts_graph(spark, sf)))
    return parts_graph(spark, sf).join(scc.select(F.col("node").alias("src"), "scc"), "src").join(scc.select(F.col("node").alias("dst"), "scc"), ["dst", "scc"]).select("src", "dst", "scc")


@query("SELECT 0::BIGINT AS n")
def acyclic_control(spark, sf):
    """GR1 on clean input: no component at 42."""
    return graph.components(parts_graph(spark, sf, 42)).agg(F.count("*").alias("n"))


@query(f"""WITH RECURSIVE {_parts()}, {_parts(38, BASELINE, "old")}, r AS (SELECT src AS a, dst AS b FROM pe UNION SELECT r.a, pe.dst FROM r JOIN pe ON r.b = pe.src),
q AS (SELECT src AS a, dst AS b FROM old UNION SELECT q.a, old.dst FROM q JOIN old ON q.b = old.src),
m AS (SELECT DISTINCT x.a, x.b FROM r x JOIN r y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b), n AS (SELECT DISTINCT x.a, x.b FROM q x JOIN q y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b)
SELECT a, b FROM m EXCEPT SELECT a, b FROM n""")
def new_cyclic_pairs(spark, sf):
    """GR3, ST3: pairs on a cycle now and not before the baseline's day."""
    return graph.new_pairs(graph.components(parts_graph(spark, sf)), graph.components(parts_graph(spark, sf, until=BASELINE)))


def busiest(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "node").limit(1).select("node")


def _walk(a: str, b: str) -> str:
    return f"""WITH RECURSIVE {_parts()}, s AS (SELECT src AS node FROM pe GROUP BY src ORDER BY count(*) DESC, src LIMIT 1),
w AS (SELECT node AS key, node, 0 AS depth FROM s UNION SELECT w.key, pe.{b}, w.depth + 1 FROM w JOIN pe ON w.node = pe.{a} WHERE w.depth < 3)
SELECT key, node, min(depth)::INTEGER AS depth FROM w WHERE node <> key GROUP BY key, node"""


@query(_walk("dst", "src"))
def callers_depth3(spark, sf):
    """GR9: what leads to the busiest source within three steps."""
    edges = cut(parts_graph(spark, sf))
    return graph.callers(edges, busiest(edges), 3)


@query(_walk("src", "dst"))
def callees_depth3(spark, sf):
    """GR9 the other way."""
    edges = cut(parts_graph(spark, sf))
    return graph.callees(edges, busiest(edges), 3)


@query(f"""WITH RECURSIVE {_parts()}, t AS (SELECT p_partkey AS node FROM part WHERE p_size <= 5), s AS (SELECT p_partkey AS node FROM part WHERE p_retailprice IN (SELECT DISTINCT p_retailprice FROM part ORDER BY 1 LIMIT 10)),
w AS (SELECT node, 0 AS depth FROM s UNION SELECT pe.src, w.depth + 1 FROM w JOIN pe ON w.node = pe.dst WHERE w.depth < 8 AND (w.depth = 0 OR w.node NOT IN (SELECT node FROM t))),
f AS (SELECT node, min(depth) AS depth FROM w WHERE depth > 0 GROUP BY node)
SELECT node, depth::INTEGER AS depth, node IN (SELECT node FROM t) AS terminal,
  EXISTS (SELECT 1 FROM f JOIN pe ON f.node = pe.dst WHERE f.depth = 8 AND f.node NOT IN (SELECT node FROM t) AND pe.src NOT IN (SELECT node FROM f)) AS truncated FROM f""")
def impact_closure(spark, sf):
    """GR12: backwards from all parts of the ten lowest prices; small parts end the walk; eight steps at most."""
    part = table(spark, sf, "part")
    tests = cut(part.where("p_size <= 5").select(F.col("p_partkey").alias("node")))
    prices = part.select("p_retailprice").distinct().orderBy("p_retailprice").limit(10)
    seeds = part.join(prices, "p_retailprice", "left_semi").select(F.lit(0).alias("key"), F.col("p_partkey").alias("node"))
    found = impact.closure(graph.reversed_edges(parts_graph(spark, sf)), seeds, tests)
    return found.nodes.join(tests.withColumn("t", F.lit(True)), "node", "left").select("node", "depth", F.coalesce("t", F.lit(False)).alias("terminal"), F.lit(found.truncated).alias("truncated"))


@query(f"""WITH RECURSIVE {_parts(44)}, e AS (SELECT DISTINCT a.p_brand AS src, b.p_brand AS dst FROM pe JOIN part a ON a.p_partkey = pe.src JOIN part b ON b.p_partkey = pe.dst),
r AS (SELECT 'Brand#1' AS node UNION SELECT e.dst FROM r JOIN e ON r.node = e.src)
SELECT 'Brand#1' AS src, 'Brand#9' AS dst, EXISTS (SELECT 1 FROM r JOIN e ON r.node = e.src WHERE e.dst = 'Brand#9') AS reachable""")
def reachable_pair(spark, sf):
    """GR21: from one brand to another."""
    brand = table(spark, sf, "part").select("p_partkey", "p_brand")
    e = parts_graph(spark, sf, 44).join(brand.toDF("src", "a"), "src").join(brand.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    one = lambda x: spark.range(1).select(F.lit(x).alias("node"))
    return spark.range(1).select(F.lit("Brand#1").alias("src"), F.lit("Brand#9").alias("dst"), F.lit(graph.reaches(e, one("Brand#1"), one("Brand#9"))).alias("reachable"))


@query(f"""WITH RECURSIVE {_parts(42)}, w AS (SELECT dst AS node, 0 AS d FROM pe UNION SELECT src, 0 FROM pe UNION SELECT pe.src, w.d + 1 FROM w JOIN pe ON w.node = pe.dst)
SELECT node, max(d)::INTEGER AS layer FROM w GROUP BY node""")
def layers_dag(spark, sf):
    """GR22: longest way to a sink."""
    e = cut(parts_graph(spark, sf, 42))
    nodes = e.select(F.col("src").alias("node")).unionByName(e.select(F.col("dst").alias("node")))
    return graph.layers(nodes, e)


@query(f"WITH {_parts()}, {_parts(38, BASELINE, 'old')} SELECT src, dst FROM pe EXCEPT SELECT src, dst FROM old")
def new_edges_vs_baseline(spark, sf):
    """GR4: edges since the baseline's day."""
    return sets.kept_out(parts_graph(spark, sf), parts_graph(spark, sf, until=BASELINE), ["src", "dst"])


@query(f"""WITH {_parts()}, {_parts(42, None, "big")}, a AS (SELECT 'edges' AS kind, src || ' -> ' || dst AS item FROM pe UNION ALL SELECT DISTINCT 'modules', src::VARCHAR FROM pe),
b AS (SELECT 'edges' AS kind, src || ' -> ' || dst AS item FROM big UNION ALL SELECT DISTINCT 'modules', dst::VARCHAR FROM big)
SELECT kind, 'added' AS change, item FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT kind, 'removed', item FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def shape_delta(spark, sf):
    """ST1, ST2: what one shape has and another has not."""
    a, b = parts_graph(spark, sf), parts_graph(spark, sf, 42)
    return sets.shape_delta({"edges": a, "modules": a.select("src").distinct()}, {"edges": b, "modules": b.select(F.col("dst").alias("src")).distinct()})


@query(f"""WITH {_parts()} SELECT node, count(*) AS degree FROM (SELECT src AS node FROM pe UNION ALL SELECT dst FROM pe) GROUP BY node""")
def node_degree(spark, sf):
    """GR23."""
    return graph.degree(parts_graph(spark, sf))


@query(f"""WITH {_parts()}, i AS (SELECT pe.dst AS node, bool_and(p_type = 'ECONOMY') AS tests FROM pe JOIN part ON p_partkey = pe.src GROUP BY 1)
SELECT p_partkey AS node, CASE WHEN tests IS NULL THEN 'dead' ELSE 'only_tests' END AS state FROM part LEFT JOIN i ON p_partkey = i.node WHERE tests IS NULL OR tests""")
def dead_symbols(spark, sf):
    """GR27: parts that nothing leads to, or only economy parts do."""
    part = table(spark, sf, "part")
    edges = parts_graph(spark, sf).join(part.select(F.col("p_partkey").alias("src"), "p_type"), "src")
    return graph.dead(part.select(F.col("p_partkey").alias("node")), edges, F.col("p_type") == "ECONOMY")


@query(f"""WITH {_parts()}, {_parts(42, None, "big")}, h AS (SELECT count(*) AS found FROM (SELECT * FROM pe INTERSECT SELECT * FROM big))
SELECT (SELECT count(*) FROM pe) AS observed, found, round(found / (SELECT count(*) FROM pe), 6) AS recall, (SELECT count(*) FROM big) AS static, round(found / (SELECT count(*) FROM big), 6) AS "precision" FROM h""")
def edge_oracle(spark, sf):
    """GR44, GR45: recall and precision of one edge table against another."""
    return graph.oracle_scores(parts_graph(spark, sf), parts_graph(spark, sf, 42))


@query("""WITH c AS (SELECT turn + conv_id * 1000 AS seq, role AS node, conv_id || ':' || turn AS span_id, CASE WHEN turn % 3 > 0 THEN conv_id || ':' || (turn - 1) END AS parent_span, conv_id AS session_id, turn AS pid, turn - 1 AS ppid FROM conversations),
s AS (SELECT span_id, arg_max(node, seq) AS n FROM c GROUP BY 1), p AS (SELECT session_id, pid, arg_max(node, seq) AS n FROM c GROUP BY 1, 2)
SELECT DISTINCT coalesce(s.n, p.n) AS src, c.node AS dst FROM c LEFT JOIN s ON c.parent_span = s.span_id LEFT JOIN p ON c.session_id = p.session_id AND c.ppid = p.pid WHERE coalesce(s.n, p.n) <> c.node""")
def trace_chain(spark, sf):
    """GR40: roles that follow each other, by span, else by session and process."""
    c = table(spark, sf, "conversations")
    span = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    rows = c.select((F.col("turn") + F.col("conv_id") * 1000).alias("seq"), F.col("role").alias("node"), span(F.col("turn")).alias("span_id"), F.when(F.col("turn") % 3 > 0, span(F.col("turn") - 1)).alias("parent_span"), F.col("conv_id").alias("session_id"), F.col("turn").alias("pid"), (F.col("turn") - 1).alias("ppid"))
    return graph.process_chain(rows)


# rules ---------------------------------------------------------------------


def modules(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.concat_ws(".", "r_name", "n_name").alias("module"))


def trade(spark: SparkSession, sf: str) -> DataFrame:
    """Modules that buy from others: customers' nations to suppliers' nations."""
    m = modules(spark, sf)
    sold = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    lines = table(spark, sf, "lineitem").where("l_quantity >= 49").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "s_nationkey")
    pairs = sold.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select("c_nationkey", "s_nationkey").distinct()
    return pairs.join(m.toDF("c_nationkey", "src"), "c_nationkey").join(m.toDF("s_nationkey", "dst"), "s_nationkey").where("src != dst").select("src", "dst")


_TRADE = """m AS (SELECT n_nationkey AS k, r_name || '.' || n_name AS module FROM nation JOIN region ON n_regionkey = r_regionkey),
e AS (SELECT DISTINCT a.module AS src, b.module AS dst FROM orders JOIN customer ON o_custkey = c_custkey JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity >= 49 JOIN supplier ON l_suppkey = s_suppkey
  JOIN m a ON a.k = c_nationkey JOIN m b ON b.k = s_nationkey WHERE a.module <> b.module)"""
_RULES = "rules(rule_ord, src_pat, dst_pat) AS (VALUES " + ", ".join(f"({i}, '{a}', '{b}')" for i, (a, b) in enumerate(FORBIDDEN)) + ")"
_UNDER = lambda m, p: f"({m} = {p} OR starts_with({m}, {p} || '.'))"


@query(f"""WITH {_TRADE}, {_RULES} SELECT src, dst, src_pat, dst_pat FROM e JOIN rules ON {_UNDER('src', 'src_pat')} AND {_UNDER('dst', 'dst_pat')} QUALIFY row_number() OVER (PARTITION BY src, dst ORDER BY rule_ord) = 1""")
def rule_violations(spark, sf):
    """RB2, RB3."""
    return rules.violations(trade(spark, sf), rules.rule_table(spark, FORBIDDEN))


@query(f"""WITH {_TRADE}, {_RULES}, s AS (SELECT module || '.s' || k AS qual, module FROM m), c AS (SELECT a.qual AS caller, a.module AS ma, b.qual AS callee, b.module AS mb FROM e JOIN s a ON a.module = e.src JOIN s b ON b.module = e.dst)
SELECT ma AS caller_module, mb AS callee_module, caller, callee, src_pat, dst_pat FROM c JOIN rules ON {_UNDER('ma', 'src_pat')} AND {_UNDER('mb', 'dst_pat')} QUALIFY row_number() OVER (PARTITION BY caller, callee ORDER BY rule_ord) = 1""")
def call_violations(spark, sf):
    """RB4."""
    s = modules(spark, sf).select(F.concat(F.col("module"), F.lit(".s"), F.col("n_nationkey").cast("string")).alias("qual"), "module")
    calls = trade(spark, sf).join(s.toDF("a", "src"), "src").join(s.toDF("b", "dst"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    return rules.call_violations(calls, rules.rule_table(spark, FORBIDDEN), s)


@query(f"""WITH {_TRADE}, {_RULES} SELECT rule_ord, src_pat, dst_pat, EXISTS (SELECT 1 FROM m WHERE {_UNDER('module', 'src_pat')}) AS src_matches, EXISTS (SELECT 1 FROM m WHERE {_UNDER('module', 'dst_pat')}) AS dst_matches
FROM rules WHERE NOT (src_matches AND dst_matches)""")
def unmatched_rules(spark, sf):
    """RB6."""
    return rules.unmatched(modules(spark, sf), rules.rule_table(spark, FORBIDDEN))


@query(f"""WITH {_TRADE}, {_RULES} SELECT module FROM m WHERE NOT EXISTS (SELECT 1 FROM rules WHERE {_UNDER('module', 'src_pat')} OR {_UNDER('module', 'dst_pat')})""")
def modules_without_rule(spark, sf):
    """RB7, RB8."""
    return rules.without_rule(modules(spark, sf), rules.all_patterns(rules.rule_table(spark, FORBIDDEN)))


@query(f"""WITH {_TRADE}, s(pattern, public) AS (VALUES {', '.join(f"('{p}', {names}::VARCHAR[])" for p, names in SURFACES)})
SELECT src AS caller, dst AS callee, pattern FROM e JOIN s ON {_UNDER('dst', 'pattern')} WHERE NOT {_UNDER('src', 'pattern')} AND NOT list_contains(public, split_part(dst, '.', 2))""")
def surface_violations(spark, sf):
    """RB5, with modules standing for symbols."""
    m = modules(spark, sf).select(F.col("module").alias("qual"), "module")
    return rules.surface_violations(trade(spark, sf), rules.surface_table(spark, SURFACES), m)


@query(f"""WITH {_TRADE}, i AS (SELECT dst AS node, count(*) AS n FROM e GROUP BY 1), o AS (SELECT src AS node, count(*) AS n FROM e GROUP BY 1),
d AS (SELECT module AS node, coalesce(i.n, 0) AS fi, coalesce(o.n, 0) AS fo FROM m LEFT JOIN i ON i.node = module LEFT JOIN o ON o.node = module)
SELECT a.node AS src, b.node AS dst, false AS declared FROM d a JOIN d b ON a.node <> b.node WHERE a.fi + a.fo > 0 AND b.fi + b.fo > 0 AND a.fo / (a.fi + a.fo) <= 0.48 AND b.fo / (b.fi + b.fo) >= 0.52
AND NOT EXISTS (SELECT 1 FROM e WHERE e.src = a.node AND e.dst = b.node)""")
def candidate_rules(spark, sf):
    """RB9, with cutoffs that this even graph can meet."""
    e = cut(trade(spark, sf))
    return rules.candidates(graph.degrees(modules(spark, sf).select(F.col("module").alias("node")), e), e, core=0.48, edge=0.52)


@query("""WITH f AS (SELECT o_orderstatus AS s, n_nationkey AS k, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
g AS (SELECT n_nationkey AS k, coalesce(max(n) FILTER (s = 'F'), 0) AS f, coalesce(max(n) FILTER (s = 'O'), 0) AS o, coalesce(max(n) FILTER (s = 'P'), 0) AS p FROM nation LEFT JOIN f ON k = n_nationkey GROUP BY 1)
SELECT k, CASE WHEN f % 5 = 0 THEN 'rechazar' WHEN o % 7 = 0 THEN 'rechazar' WHEN p % 6 = 0 THEN 'escalar' WHEN f % 5 = 1 THEN 'escalar' WHEN (f + o + p) = 0 THEN 'escalar' WHEN o % 3 = 1 THEN 'aceptar' WHEN o % 3 = 2 THEN 'rechazar' ELSE 'sin-objeciones' END AS verdict,
(CASE WHEN f = 0 THEN 2 WHEN p % 6 = 0 THEN 3 WHEN o % 7 = 0 THEN 1 ELSE 0 END)::INTEGER AS code FROM g""")
def ladder_decision(spark, sf):
    """RB11, RB13: a verdict and an exit code from facts per nation."""
    n = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey").agg(*[F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in "FOP"])
    g = table(spark, sf, "nation").join(n, F.col("n_nationkey") == F.col("c_nationkey"), "left").select(F.col("n_nationkey").alias("k"), *[F.coalesce(c, F.lit(0)).alias(c) for c in "fop"])
    zero, flag = F.lit(0), lambda c: F.when(c, 1).otherwise(0)
    green = F.when(F.col("f") % 5 == 0, False).when(F.col("f") % 5 != 1, True)
    done = F.when(F.col("o") % 3 == 1, True).when(F.col("o") % 3 == 2, False)
    verdict = rules.ladder(green, flag(F.col("o") % 7 == 0), zero, zero, zero, zero, flag(F.col("p") % 6 == 0), zero, F.col("f") + F.col("o") + F.col("p"), done)
    return g.select("k", verdict.alias("verdict"), rules.gate_code(F.col("f") == 0, F.col("p") % 6 == 0, flag(F.col("o") % 7 == 0), zero, zero, zero).alias("code"))


# resolution ------------------------------------------------------------------


@query("""WITH m AS (SELECT r_name || '.' || n_name AS module FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 2 = 0 UNION ALL SELECT r_name FROM region),
t AS (SELECT c_custkey, r_name || '.' || n_name || '.' || c_custkey AS target, r_name, r_name || '.' || n_name AS two FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT target, CASE WHEN two IN (SELECT module FROM m) THEN two ELSE r_name END AS module FROM t""")
def longest_prefix_resolve(spark, sf):
    """FX3: dotted customers to the longest module they lie in."""
    m = modules(spark, sf)
    known = m.where("n_nationkey % 2 = 0").select("module").unionByName(table(spark, sf, "region").select(F.col("r_name").alias("module")))
    targets = table(spark, sf, "customer").join(m, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat_ws(".", "module", F.col("c_custkey").cast("string")).alias("target"))
    return resolve.to_internal(targets, known).select("target", "module")


@query("""WITH t AS (SELECT s_suppkey % 700 AS tail, s_name AS qual FROM supplier UNION ALL SELECT c_custkey % 700, c_name FROM customer), n AS (SELECT tail, count(DISTINCT qual) AS n, min(qual) AS q FROM t GROUP BY 1)
SELECT p_partkey AS part, p_partkey % 900 AS tail, CASE WHEN n = 1 THEN q END AS qual, CASE WHEN n IS NULL THEN 'nombre-desconocido' WHEN n > 1 THEN 'nombre-ambiguo' END AS reason FROM part LEFT JOIN n ON p_partkey % 900 = n.tail""")
def ambiguous_unique_join(spark, sf):
    """Uniqueness join: a name counts only if one thing has it."""
    t = table(spark, sf, "supplier").select((F.col("s_suppkey") % 700).alias("tail"), F.col("s_name").alias("qual")).unionByName(table(spark, sf, "customer").select((F.col("c_custkey") % 700).alias("tail"), F.col("c_name").alias("qual")))
    asked = table(spark, sf, "part").select(F.col("p_partkey").alias("part"), (F.col("p_partkey") % 900).alias("tail"))
    return resolve.unique(asked, t, "tail", "qual").select("part", "tail", "qual", "reason")


@query("""WITH a AS (SELECT n_nationkey AS m, (n_nationkey * 7 + 3) % 25 AS t FROM nation WHERE n_nationkey % 4 <> 1), k AS (SELECT n_nationkey AS m FROM nation WHERE n_nationkey % 6 = 5)
SELECT 'm' || n_nationkey AS module, 'x' AS attr, 'm' || CASE WHEN a1.t IN (FROM k) THEN a1.t WHEN a2.t IN (FROM k) THEN a2.t WHEN a3.t IN (FROM k) THEN a3.t WHEN a4.t IN (FROM k) THEN a4.t END || '.x' AS qual
FROM nation LEFT JOIN a a1 ON a1.m = n_nationkey LEFT JOIN a a2 ON a2.m = a1.t LEFT JOIN a a3 ON a3.m = a2.t LEFT JOIN a a4 ON a4.m = a3.t""")
def reexport_chain(spark, sf):
    """FX13: a name handed on from module to module, four hops at most."""
    n = table(spark, sf, "nation").select("n_nationkey")
    m = lambda c: F.concat(F.lit("m"), c.cast("string"))
    aliases = n.where("n_nationkey % 4 != 1").select(m(F.col("n_nationkey")).alias("module"), F.lit("x").alias("alias"), F.concat(m((F.col("n_nationkey") * 7 + 3) % 25), F.lit(".x")).alias("target"))
    known = n.where("n_nationkey % 6 = 5").select(F.concat(m(F.col("n_nationkey")), F.lit(".x")).alias("qual"))
    return resolve.reexport(n.select(m(F.col("n_nationkey")).alias("module"), F.lit("x").alias("attr")), aliases, known)


@query("""WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, '["'']([^"'']{2,160})["'']', 1)) AS q FROM pages),
p AS (SELECT page_id, q AS piece FROM l UNION ALL SELECT page_id, unnest(string_split_regex(q, '\\s+')) FROM l),
a AS (SELECT DISTINCT page_id, lower(regexp_extract(piece, '([^/\\\\]*)$', 1)) AS name FROM p),
n AS (SELECT lower(regexp_extract(p_name, '([^ ]*)$', 1)) AS name, count(DISTINCT p_name) AS n, min(p_name) AS dst FROM part GROUP BY 1)
SELECT page_id AS src, dst FROM a JOIN n ON a.name = n.name AND n.n = 1 WHERE a.name <> '' UNION SELECT page_id, w FROM a JOIN (VALUES ('the', 'the'), ('and', 'and'), ('to', 'to'), ('la', 'la')) v(name, w) ON a.name = v.name""")
def literal_links(spark, sf):
    """FX31, FX32: quoted pieces of pages that name exactly one thing."""
    part = table(spark, sf, "part").select(F.lower(F.regexp_extract("p_name", "([^ ]*)$", 1)).alias("name"), F.col("p_name").alias("dst"))
    few = spark.createDataFrame([(w, w) for w in ("the", "and", "to", "la")], "name string, dst string")
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("src"), F.col("html").alias("line"))
    return resolve.literal_links(pages.withColumn("src", F.col("src").cast("string")), part.unionByName(few)).select(F.col("src").cast("long").alias("src"), "dst")


# log -------------------------------------------------------------------------


def captures(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").where("event_type = 'error'")
    return e.select(F.col("event_id").alias("seq"), F.col("event_id").cast("string").alias("id"), "ts", F.col("event_type").alias("type"), F.concat(F.lit("u"), (F.col("user_id") % 10).cast("string"), F.lit(".py:"), F.floor(F.col("value") / 20).cast("string")).alias("where"), F.col("props").alias("message"), "user_id", "value")


_CAPTURES = "c AS (SELECT event_id AS seq, event_id::VARCHAR AS id, ts, event_type AS type, 'u' || (user_id % 10) || '.py:' || floor(value / 20)::BIGINT AS \"where\", props AS message, user_id, value FROM events WHERE event_type = 'error')"


@query(f"""WITH {_CAPTURES} SELECT type, "where", count(*) AS count, arg_max(ts, seq) AS last_ts, arg_max(id, seq) AS last_id, arg_max(message, seq) AS last_message, arg_min(ts, seq) AS first_ts FROM c GROUP BY 1, 2""")
def capture_summary(spark, sf):
    """AG1, WN1, TK7: signatures of errors."""
    return log.ranked(log.signatures(captures(spark, sf)))


@query("""WITH c AS (SELECT event_id, user_id FROM events WHERE event_type = 'error'), r AS (SELECT (SELECT max(c.event_id) FROM c WHERE c.user_id = e.user_id AND c.event_id < e.event_id) AS id FROM events e WHERE event_type = 'view' AND event_id % 3 = 0)
SELECT (SELECT count(*) FROM c) AS captures, count(DISTINCT id) AS "read", count(id) AS openings FROM r""")
def read_stats(spark, sf):
    """AG2: errors, those whose user viewed something next, and how often."""
    e = table(spark, sf, "events")
    over = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = e.withColumn("id", F.last(F.when(F.col("event_type") == "error", F.col("event_id")), ignorenulls=True).over(over))
    reads = rows.where("event_type = 'view' and event_id % 3 = 0").select("id")
    return log.read_stats(e.where("event_type = 'error'").select(F.col("event_id").alias("id")), reads)


@query(f"SELECT event_type AS cmd, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL {PENDING_DAYS} DAY GROUP BY 1")
def usage_last_days(spark, sf):
    """AG3, with the last event as the clock."""
    e = table(spark, sf, "events")
    last = e.agg(F.max("ts").alias("now"))
    return log.usage(e.select(F.col("event_type").alias("cmd"), "ts").join(F.broadcast(last)), F.col("now"), PENDING_DAYS)


def cycle(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    c = captures(spark, sf).withColumn("file", F.col("user_id").cast("string"))
    bought = e.where("event_type = 'purchase' and event_id % 7 = 0").select(F.col("user_id").cast("string").alias("file"), F.col("event_id").cast("string").alias("sha"), "ts")
    reads = e.where("event_type = 'view' and event_id % 3 = 0").select((F.col("event_id") - 1).cast("string").alias("id"))
    now = F.lit("2024-02-01").cast("timestamp_ntz")
    return log.error_cycle(c.select("seq", "id", "ts", F.col("user_id").cast("string").alias("type"), F.floor(F.col("value") / 50).cast("string").alias("where"), "file"), log.last_commits(bought), reads, now)


_CYCLE = """WITH c AS (SELECT event_id AS seq, event_id::VARCHAR AS id, ts, user_id::VARCHAR AS type, floor(value / 50)::BIGINT::VARCHAR AS "where" FROM events WHERE event_type = 'error'),
k AS (SELECT user_id::VARCHAR AS f, arg_max(event_id::VARCHAR, (ts, event_id::VARCHAR)) AS commit, max(ts) AS cts FROM events WHERE event_type = 'purchase' AND event_id % 7 = 0 GROUP BY 1),
r AS (SELECT DISTINCT (event_id - 1)::VARCHAR AS id FROM events WHERE event_type = 'view' AND event_id % 3 = 0),
g AS (SELECT type, "where", count(*) AS count, arg_max(ts, seq) AS last_ts, arg_max(c.id, seq) AS last_id, bool_or(r.id IS NOT NULL) AS was_read, min(ts) AS first_ts, max(commit) AS k, max(cts) AS cts, count(*) FILTER (ts > cts) AS after
  FROM c LEFT JOIN r ON c.id = r.id LEFT JOIN k ON c.type = k.f GROUP BY 1, 2),
h AS (SELECT *, coalesce(cts > first_ts, false) AS t FROM g),
cycle AS (SELECT type, "where", count, last_ts, last_id, was_read, CASE WHEN t THEN k END AS commit, CASE WHEN t THEN after ELSE 0 END AS reappearances,
  CASE WHEN t AND after = 0 THEN 'en-silencio' WHEN t THEN 'intervenida' WHEN was_read THEN 'leida' ELSE 'capturada' END AS state,
  CASE WHEN t AND after = 0 THEN greatest(0, floor((epoch(TIMESTAMP '2024-02-01') - floor(epoch(cts))) / 86400))::BIGINT END AS silent_days FROM h)"""


@query(_CYCLE + " SELECT * FROM cycle")
def error_cycle(spark, sf):
    """CH6, WN2, WN3: each signature's state."""
    return cycle(spark, sf)


@query(_CYCLE + " SELECT count(*) AS captured, count(*) FILTER (was_read) AS \"read\", count(commit) AS touched, count(*) FILTER (state = 'en-silencio') AS silent FROM cycle")
def error_funnel(spark, sf):
    """AG5."""
    return log.funnel(cycle(spark, sf))


@query(_CYCLE + " SELECT type, \"where\", count, state FROM cycle WHERE state <> 'en-silencio'")
def pending_queue(spark, sf):
    """The anti joins of the work queue."""
    return log.pending(cut(cycle(spark, sf))).select("type", "where", "count", "state")


@query("""SELECT e.event_id, e.user_id, v.event_id AS last_view, v.ts AS last_at FROM events e ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts >= v.ts WHERE e.event_type = 'error'""")
def as_of_last_read(spark, sf):
    """As-of join: the last view at or before each error of a user."""
    e = table(spark, sf, "events")
    left = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view"), F.col("ts").alias("at"))
    return log.as_of(left, right, ["user_id"], "ts", ["view", "at"], ["view"]).select("event_id", "user_id", F.col("last_view").alias("last_view"), "last_at")


@query("""WITH v AS (SELECT CASE WHEN event_id % 10 = 0 THEN substr(props, 1, 4) ELSE props END AS v FROM events), p AS (SELECT try_cast(json_extract_string(CASE WHEN json_valid(v) THEN v END, '$.k') AS INTEGER) AS k FROM v) SELECT k % 10 AS bucket, count(*) AS n, sum(k)::BIGINT AS total FROM p WHERE k IS NOT NULL GROUP BY 1""")
def json_props(spark, sf):
    """SF30: damaged rows are left out, never fatal."""
    e = table(spark, sf, "events").select(F.when(F.col("event_id") % 10 == 0, F.substring("props", 1, 4)).otherwise(F.col("props")).alias("value"))
    k = S.to_int(F.get_json_object("value", "$.k"))
    return e.where(F.try_parse_json("value").isNotNull()).select(k.alias("k")).where("k is not null").groupBy((F.col("k") % 10).alias("bucket")).agg(F.count("*").alias("n"), F.sum("k").alias("total"))


@query("""SELECT event_id::VARCHAR AS ts, CASE event_id % 3 WHEN 0 THEN 'js' WHEN 1 THEN 'java' ELSE 'rust' END AS lang, event_type AS type, user_id::INTEGER AS pid,
CASE event_id % 3 WHEN 0 THEN 'b.js' WHEN 1 THEN 'B.java' ELSE 'm.rs' END AS file, CASE event_id % 3 WHEN 1 THEN 'K.run' WHEN 0 THEN 'f' ELSE '?' END AS function, CASE event_id % 3 WHEN 2 THEN 1 ELSE 2 END AS frames FROM events""")
def normalize_records(spark, sf):
    """SF27 to SF29: three dialects to one record; frames end with the innermost."""
    e = table(spark, sf, "events")
    f = lambda name, fn: F.struct(F.lit(name).alias("file"), F.lit(3).alias("line"), F.lit(fn).alias("function"))
    js = F.to_json(F.struct(F.lit("js").alias("language"), F.col("event_id").cast("string").alias("ts"), F.struct(F.col("event_type").alias("type")).alias("exception"), F.array(f("b.js", "f"), f("node:a", "g")).alias("frames"), F.struct(F.col("user_id").alias("pid")).alias("process")))
    cls = lambda name: F.struct(F.lit(name).alias("file"), F.lit("3").alias("line"), F.lit("K").alias("class"), F.lit("run").alias("method"))
    java = F.to_json(F.struct(F.lit("java").alias("language"), F.col("event_id").cast("string").alias("ts"), F.struct(F.col("event_type").alias("type")).alias("exception"), F.array(cls("B.java"), cls("java.lang")).alias("frames"), F.struct(F.col("user_id").cast("string").alias("pid")).alias("process")))
    rust = F.to_json(F.struct(F.lit("rust").alias("lang"), F.col("event_id").cast("string").alias("ts"), F.struct(F.col("event_type").alias("type")).alias("error"), F.struct(F.lit("m.rs").alias("file"), F.lit(3).alias("line")).alias("location"), F.col("user_id").alias("pid")))
    raw = e.select(F.when(F.col("event_id") % 3 == 0, js).when(F.col("event_id") % 3 == 1, java).otherwise(rust).alias("value"))
    r = normalised(raw)
    u = S.user_frame("frames")
    return r.select("ts", F.col("language").alias("lang"), F.col("exception.type").alias("type"), F.col("process.pid").alias("pid"), u["file"].alias("file"), u["function"].alias("function"), F.size("frames").alias("frames"))


# parallel work -----------------------------------------------------------------


def work(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000).alias("ts"), (F.col("user_id") % 4).alias("agent"), F.col("event_id").alias("id"), F.floor(F.col("value") / 10).alias("node"))


_WORK = "w AS (SELECT floor(epoch(ts))::BIGINT AS ts, user_id % 4 AS agent, event_id AS id, floor(value / 10)::BIGINT AS node FROM events)"


@query(f"""WITH {_WORK}, d AS (SELECT * FROM w WHERE ts >= (SELECT max(ts) FROM w) - 86400), p AS (SELECT a.agent AS src, b.agent AS dst, a.node, a.ts AS ts_src, b.ts AS ts_dst FROM d a JOIN d b ON a.node = b.node AND a.agent <> b.agent AND b.ts > a.ts)
SELECT src, dst, node, ts_src, ts_dst FROM p QUALIFY row_number() OVER (PARTITION BY src, dst, node ORDER BY ts_src, ts_dst) = 1""")
def chronology_propagation(spark, sf):
    """CH14, WN4: the first time that work on a node follows another's, within a day."""
    events = work(spark, sf).select("ts", "agent", "id", F.array("node").alias("nodes"))
    return activity.chronology(events, 86400, None)[1]


@query(f"""WITH {_WORK} SELECT node, string_agg(DISTINCT agent::VARCHAR, ',' ORDER BY agent::VARCHAR) AS agents FROM w WHERE ts >= (SELECT max(ts) FROM w) - 21600 GROUP BY node HAVING count(DISTINCT agent) > 1""")
def crossing_nodes(spark, sf):
    """CH9: nodes that two or more agents touched in the last six hours."""
    w = work(spark, sf)
    last = w.agg(F.max("ts").alias("now"))
    found = activity.crossings(activity.recent(w.join(F.broadcast(last)), F.col("now"), 21600), ())
    return found.select("node", F.array_join(F.array_sort(F.transform("agents", lambda a: a.cast("string"))), ",").alias("agents"))


@query(f"""WITH {_WORK}, mine AS (SELECT id % 5000 AS sha FROM w WHERE agent = 0), own AS (SELECT DISTINCT node FROM w WHERE agent = 0 AND id % 50 = 0), theirs AS (SELECT agent, id % 5000 AS sha, max(ts) OVER (PARTITION BY agent, id % 5000) AS ts, node FROM w WHERE agent <> 0),
t AS (SELECT DISTINCT agent, sha, ts, node, node IN (FROM own) AS same FROM theirs WHERE sha NOT IN (FROM mine) AND (node IN (FROM own) OR node IN (SELECT node + 1 FROM own)))
SELECT agent, sha, CASE WHEN bool_or(same) THEN 'mismo-nodo' ELSE 'vecino' END AS class, string_agg(node::VARCHAR, ',' ORDER BY node) AS nodes, (SELECT max(ts) FROM w) - ts AS age FROM t GROUP BY agent, sha, ts""")
def debt(spark, sf):
    """CH15, ST9, TK5: others' work that is still to be merged."""
    w = cut(work(spark, sf).withColumn("sha", F.col("id") % 5000))
    own = w.where("agent = 0 and id % 50 = 0").select("node").distinct()
    theirs = w.where("agent != 0").withColumn("ts", F.max("ts").over(Window.partitionBy("agent", "sha"))).join(F.broadcast(w.agg(F.max("ts").alias("now"))))
    now = w.agg(F.max("ts")).first()[0]
    found = activity.debt(theirs.drop("now"), w.where("agent = 0"), own, own.select((F.col("node") + 1).alias("node")), F.lit(now))
    return found.select("agent", "sha", "class", F.array_join(F.transform(F.array_sort("nodes"), lambda n: n.cast("string")), ",").alias("nodes"), "age")


@query("SELECT (doc_id % 50)::VARCHAR AS path, count(DISTINCT sha256(text)) AS bodies, count(DISTINCT source) AS branches FROM documents GROUP BY 1 HAVING count(DISTINCT sha256(text)) > 1")
def collision_files(spark, sf):
    """CH18: the same path with different bytes."""
    return activity.collisions(table(spark, sf, "documents").select((F.col("doc_id") % 50).cast("string").alias("path"), F.col("text").alias("body"), F.col("source").alias("branch")))


@query("""WITH r AS (SELECT c_nationkey AS case_, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 3 END AS branch, max(CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN (o_totalprice > 490000)::INT ELSE 2 * (o_totalprice > 495000)::INT END) AS verdict FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
SELECT case_ AS "case", max(verdict)::INTEGER AS worst, coalesce(bool_or(verdict > 0) FILTER (branch IS NOT NULL) AND max(verdict) FILTER (branch IS NULL) = 0, false) AS rescued, coalesce(bool_and(verdict = 0) FILTER (branch IS NOT NULL) AND max(verdict) FILTER (branch IS NULL) > 0, false) AS clash FROM r GROUP BY 1""")
def verdict_matrix(spark, sf):
    """AG14, AG15: branches alone against their union."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    big = lambda n: (F.col("o_totalprice") > n).cast("int")
    v = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", big(490000)).otherwise(2 * big(495000))
    runs = o.groupBy(F.col("c_nationkey").alias("case"), F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 3).alias("branch")).agg(F.max(v).alias("verdict"))
    return activity.verdicts(runs)


@query(f"""WITH {_WORK}, n AS (SELECT max(ts) AS m FROM w), a AS (SELECT agent, node, count(*) AS c FROM w, n WHERE ts < m - 3600 AND ts >= m - 18000 GROUP BY 1, 2), b AS (SELECT agent, node, count(*) AS c FROM w, n WHERE ts >= m - 14400 GROUP BY 1, 2)
SELECT coalesce(a.agent, b.agent) AS agent, coalesce(a.node, b.node) AS node, CASE WHEN a.agent IS NULL THEN CASE WHEN coalesce(b.node, 0) % 2 = 0 THEN 'crea' ELSE 'toca' END WHEN b.agent IS NULL THEN 'suelta' ELSE 'escribe' END AS event
FROM a FULL JOIN b ON a.agent = b.agent AND a.node = b.node WHERE a.agent IS NULL OR b.agent IS NULL OR b.c > a.c""")
def snapshot_events(spark, sf):
    """CH23: what happened between two snapshots, moves only."""
    w = work(spark, sf)
    w = w.join(F.broadcast(w.agg(F.max("ts").alias("m"))))
    shot = lambda c: w.where(c).groupBy(F.col("agent").cast("string").alias("agent"), F.col("node").cast("string").alias("node")).agg(F.count("*").alias("writes")).withColumn("born", F.col("node").cast("long") % 2 == 0)
    found = activity.differences(shot("ts < m - 3600 and ts >= m - 18000"), shot("ts >= m - 14400")).where("event in ('crea', 'toca', 'suelta', 'escribe')")
    return found.select(F.col("agent").cast("long").alias("agent"), F.col("node").cast("long").alias("node"), "event")


# spans -------------------------------------------------------------------------


@query("""WITH o AS (SELECT o_orderkey, o_custkey % 100 AS f, epoch(o_orderdate)::BIGINT // 86400 AS a FROM orders), s AS (SELECT o_orderkey, f, a, a + 20 + o_orderkey % 30 AS b FROM o),
h AS (SELECT p_partkey AS k, p_partkey % 100 AS f, 9500 + p_partkey % 700 AS a, 9503 + p_partkey % 700 AS b FROM part) SELECT h.k AS hunk, s.o_orderkey AS span FROM h JOIN s ON h.f = s.f AND h.a <= s.b AND s.a <= h.b""")
def span_overlap_touched(spark, sf):
    """GR17, CH10: spans that a hunk meets."""
    day = F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400)
    s = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 100).alias("file"), day.alias("line")).withColumn("end", F.col("line") + 20 + F.col("o_orderkey") % 30)
    k = F.col("p_partkey")
    h = table(spark, sf, "part").select(k.alias("hunk"), (k % 100).alias("path"), (9500 + k % 700).alias("start"), (9503 + k % 700).alias("stop"))
    return spans.overlapping(s, h).select("hunk", F.col("o_orderkey").alias("span"))


@query("""WITH o AS (SELECT o_orderkey AS q, o_custkey % 100 AS f, epoch(o_orderdate)::BIGINT // 86400 AS a FROM orders), s AS (SELECT q, f, a, a + 20 + q % 30 AS b FROM o), p AS (SELECT p_partkey AS k, p_partkey % 100 AS f, 9500 + p_partkey % 700 AS x FROM part)
SELECT k AS point, q AS span FROM p JOIN s ON p.f = s.f AND s.a <= x AND x <= s.b QUALIFY row_number() OVER (PARTITION BY k ORDER BY a DESC, b, q) = 1""")
def innermost_container(spark, sf):
    """GR19, FX24: the span around a point that begins last."""
    day = F.floor(F.unix_seconds(F.col("o_orderdate").cast("timestamp")) / 86400)
    s = table(spark, sf, "orders").select(F.col("o_orderkey").alias("qual"), (F.col("o_custkey") % 100).alias("file"), day.alias("line")).withColumn("end", F.col("line") + 20 + F.col("qual") % 30)
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k.alias("point"), (k % 100).alias("path"), (9500 + k % 700).alias("at"))
    return spans.innermost(p, s, ["point"]).select("point", F.col("qual").alias("span"))


# text --------------------------------------------------------------------------


def doc_lines(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", "source", F.posexplode(F.split("text", "\n")).alias("i", "line"))


_LINES = "l AS (SELECT doc_id, lang, source, unnest(range(len(s))) AS i, unnest(s) AS line FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS s FROM documents))"


@query(f"""WITH {_LINES}, a AS (SELECT lang, line, doc_id * 100000 + i AS place FROM l WHERE source IN ('src1', 'src3', 'src5')), b AS (SELECT lang, line, count(*) AS n FROM l WHERE source IN ('src0', 'src2', 'src4') GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, line ORDER BY place) AS r FROM a) SELECT r.lang, r.line, r.place FROM r LEFT JOIN b ON r.lang = b.lang AND r.line = b.line WHERE r.r > coalesce(b.n, 0)""")
def multiset_new_lines(spark, sf):
    """WN10, ST8: lines of some sources beyond those of others, keeping their places."""
    rows = doc_lines(spark, sf).select("lang", "line", (F.col("doc_id") * 100000 + F.col("i")).alias("place"), "source")
    return changes.new_lines(rows.where("source in ('src1', 'src3', 'src5')").drop("source"), rows.where("source in ('src0', 'src2', 'src4')"), "lang", "line", "place")


_BODY = """CASE i % 6 WHEN 0 THEN 'assert ' || substr(line, 1, 20) || CASE WHEN doc_id % 2 = 0 THEN ' == 1' ELSE '' END WHEN 1 THEN 'def test_' || doc_id || '():' WHEN 2 THEN 'expect(' || substr(line, 1, 9) || ')' WHEN 3 THEN 'pytest.skip("x")' WHEN 4 THEN 'assert True' ELSE line END"""


def _like(x: str, patterns: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '{p.replace(chr(39), chr(39) * 2)}')" for p in patterns) + ")"


_CODE = """regexp_replace(regexp_replace(body, '''(\\\\.|[^''\\\\])*''', '''''', 'g'), '"(\\\\.|[^"\\\\])*"', '""', 'g')"""
_P = changes.P


@query(f"""WITH {_LINES}, b AS (SELECT source AS diff, 'tests/test_' || lang || '.py' AS path, doc_id AS section, 'f' || doc_id % 5 AS func, CASE WHEN (i + doc_id) % 3 = 0 THEN '-' ELSE '+' END AS sign, {_BODY} AS body, i AS ord FROM l),
k AS (SELECT *, {_CODE} AS code FROM b), m AS (SELECT *, {_like('code', _P.TEST_DEF)} AS is_def, {_like('code', _P.ASSERTION)} AS is_assert, regexp_matches(code, '{_P.COMPARES}') AS is_cmp, {_like('code', _P.SKIP)} AS is_skip, {_like('code', _P.WEAKENER)} AS is_weak FROM k),
n AS (SELECT *, coalesce(max((sign = '+' AND is_def)::INT) OVER (PARTITION BY diff, path, section ORDER BY ord ROWS UNBOUNDED PRECEDING), 0) = 1 AS inside FROM m),
w AS (SELECT diff, path, count(*) FILTER (sign = '-' AND is_def) - count(*) FILTER (sign = '+' AND is_def) AS lost, count(*) FILTER (sign = '+' AND is_skip) AS skips, count(*) FILTER (sign = '+' AND is_weak) AS weak FROM n GROUP BY 1, 2),
s AS (SELECT diff, path, section, max(func) AS func, count(*) FILTER (sign = '-' AND is_assert) AS gone, count(*) FILTER (sign = '+' AND is_assert AND NOT inside) AS came, count(*) FILTER (sign = '-' AND is_assert AND is_cmp) AS gc, count(*) FILTER (sign = '+' AND is_assert AND NOT inside AND is_cmp) AS cc FROM n WHERE section > 0 GROUP BY 1, 2, 3)
SELECT diff, path, 'TEST_REMOVED' AS signal, '' AS at, lost AS n FROM w WHERE lost > 0 UNION ALL SELECT diff, path, 'SKIP_ADDED', '', skips FROM w WHERE skips > 0 UNION ALL SELECT diff, path, 'WEAKENER_ADDED', '', weak FROM w WHERE weak > 0
UNION ALL SELECT diff, path, 'ASSERT_REMOVED', func, gone - came FROM s WHERE gone > came UNION ALL SELECT diff, path, 'ASSERT_WEAKENED', func, gc - cc FROM s WHERE gone <= came AND gc > cc""")
def test_signals_like(spark, sf):
    """CH2, CH3, WN7, AG8: signals of weakened tests over lines made from documents."""
    i, d, line = F.col("i"), F.col("doc_id"), F.col("line")
    body = (
        F.when(i % 6 == 0, F.concat(F.lit("assert "), F.substring(line, 1, 20), F.when(d % 2 == 0, " == 1").otherwise("")))
        .when(i % 6 == 1, F.concat(F.lit("def test_"), d.cast("string"), F.lit("():")))
        .when(i % 6 == 2, F.concat(F.lit("expect("), F.substring(line, 1, 9), F.lit(")")))
        .when(i % 6 == 3, 'pytest.skip("x")')
        .when(i % 6 == 4, "assert True")
        .otherwise(line)
    )
    rows = doc_lines(spark, sf).select(F.col("source").alias("diff"), F.concat(F.lit("tests/test_"), F.col("lang"), F.lit(".py")).alias("path"), d.alias("section"), F.concat(F.lit("f"), (d % 5).cast("string")).alias("func"), F.when((i + d) % 3 == 0, "-").otherwise("+").alias("sign"), body.alias("body"), i.alias("ord"), F.lit(False).alias("deleted"), F.lit(None).cast("string").alias("renamed_to"))
    return changes.test_signals(rows).select("diff", "path", "signal", "at", "n")


@query("SELECT doc_id, md5(regexp_replace(text, '" + S.ASSIGNED.replace("'", "''") + "', '\\1\\2<redactado>', 'g')) AS redacted FROM documents")
def redact_text(spark, sf):
    """SF19: values behind sensitive names."""
    return table(spark, sf, "documents").select("doc_id", F.md5(S.redact("text")).alias("redacted"))


@query("""WITH t AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]{2,}')) AS w FROM benchmark UNION SELECT unnest(['ring', 'widget', 'red'])), s AS (SELECT p_partkey::VARCHAR AS qual, split_part(p_name, ' ', 2) AS name FROM part),
d AS (SELECT l_partkey::VARCHAR AS node, count(*) AS degree FROM lineitem GROUP BY 1) SELECT qual, coalesce(degree, 0)::BIGINT AS degree FROM s LEFT JOIN d ON qual = node WHERE name IN (SELECT w FROM t) ORDER BY degree DESC, qual LIMIT 8""")
def related_tokens(spark, sf):
    """GR30, TK4: parts that a text names, most used first."""
    s = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("qual"), F.get(F.split("p_name", " "), F.lit(1)).alias("name"))
    d = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").cast("string").alias("node")).agg(F.count("*").alias("degree"))
    asked = table(spark, sf, "benchmark").select("text").unionByName(spark.range(1).select(F.lit("ring widget red").alias("text")))
    return search.related(s, d, asked)


@query("WITH n AS (SELECT doc_id, 'n' || lpad(doc_id::VARCHAR, 12, '0') AS name, lower(source || ' ' || lang) AS meta, lower(text) AS body FROM documents) SELECT name, (" + " + ".join(f"CASE WHEN contains(meta, '{t}') THEN 2 WHEN contains(body, '{t}') THEN 1 ELSE 0 END" for t in TERMS.split()) + ")::INTEGER AS score FROM n WHERE score > 0 ORDER BY score DESC, name LIMIT 6")
def note_recall(spark, sf):
    """SF42, TK3: the six best notes for some words."""
    n = table(spark, sf, "documents").select(F.concat(F.lit("n"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("name"), F.concat_ws(" ", "source", "lang").alias("meta"), F.col("text").alias("body"))
    return search.recall(n, TERMS)


@query("""WITH a AS (SELECT p_partkey, p_brand, p_size, string_split(p_name, ' ') AS w FROM part), b AS (SELECT p_partkey, ['/usr/bin/' || w[1], w[2], '--size=' || p_size, '-v', p_brand] AS v FROM a)
SELECT p_partkey, regexp_extract(v[1], '([^/\\\\]*)$', 1) || ' ' || CASE WHEN regexp_matches(v[2], '^[a-z][a-z0-9_-]{0,20}$') THEN v[2] ELSE '<arg>' END || ' --size=<val> -v <arg>' AS shape FROM b""")
def argv_shape(spark, sf):
    """SF23: the shape of a command line without its values."""
    w = F.split("p_name", " ")
    argv = F.array(F.concat(F.lit("/usr/bin/"), F.get(w, F.lit(0))), F.get(w, F.lit(1)), F.concat(F.lit("--size="), F.col("p_size").cast("string")), F.lit("-v"), F.col("p_brand"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(S.argv_shape(argv), " ").alias("shape"))


@query("""SELECT n_regionkey, substr(sha256(string_agg(n_name, ',' ORDER BY n_name) || '|' || string_agg(n_nationkey::VARCHAR, ',' ORDER BY n_nationkey::VARCHAR)), 1, 16) AS fingerprint FROM nation GROUP BY 1""")
def fingerprint(spark, sf):
    """ST10: one short digest of sorted collections."""
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list("n_name").alias("a"), F.collect_list(F.col("n_nationkey").cast("string")).alias("b"))
    return n.select("n_regionkey", sets.fingerprint([F.col("a"), F.col("b")]).alias("fingerprint"))


@query("""SELECT event_id::VARCHAR AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS ts, regexp_replace(substr(strftime(ts, '%Y-%m-%dT%H:%M:%S'), 1, 30), '[:-]', '', 'g') || '-' || substr(sha256(strftime(ts, '%Y-%m-%dT%H:%M:%S') || '|js|' || event_type || '|None|' || 'a.js|' || user_id || '|None'), 1, 6) AS stable FROM events""")
def stable_ids(spark, sf):
    """SF10: ids from content."""
    e = table(spark, sf, "events").withColumn("t", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"))
    void = F.lit(None).cast("string")
    return e.select(F.col("event_id").cast("string").alias("id"), F.col("t").alias("ts"), S.stable_id("t", F.lit("js"), "event_type", void, F.lit("a.js"), "user_id", void).alias("stable"))


@query("""SELECT page_id, round(CASE WHEN length(trim(html)) > 0 THEN coalesce(list_sum(list_transform(regexp_extract_all(html, '<!--[^>]*-->'), lambda x: length(x))), 0) / length(html) ELSE 0 END, 6) AS ratio FROM pages""")
def tool_ratio(spark, sf):
    """AG9: the share of a page inside comment blocks."""
    return table(spark, sf, "pages").select("page_id", F.round(S.tool_ratio("html", "<!--[^>]*-->"), 6).alias("ratio"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def kind_histogram(spark, sf):
    """AG6."""
    return log.histogram(table(spark, sf, "events"), "event_type")
