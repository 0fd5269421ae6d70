import datetime as dt

from pyspark.sql import functions as F

from codefacts.operators import activity, floor, log, resolve, search, sets, spans
from tests.conftest import rows

CAP = "seq long, id string, ts timestamp, type string, where string, message string, file string"


def day(n):
    return dt.datetime(2026, 1, n, tzinfo=dt.timezone.utc)


def caps(spark):
    return spark.createDataFrame(
        [(1, "a", day(1), "E", "f.py:1", "m1", "f.py"), (2, "b", day(3), "E", "f.py:1", "m2", "f.py"), (3, "c", day(2), None, None, "m3", None), (4, "d", day(5), "E", "g.py:1", "m4", "g.py")], CAP
    )


def test_last_is_by_order_of_appending(spark):
    c = caps(spark).withColumn("ts", F.when(F.col("seq") == 2, F.lit(day(1)) - F.expr("interval 9 days")).otherwise(F.col("ts")))
    found = {(r["type"], r["where"]): r for r in log.signatures(c).collect()}
    assert found[("E", "f.py:1")]["count"] == 2 and found[("E", "f.py:1")]["last_id"] == "b" and found[(None, None)]["count"] == 1


def test_error_cycle_states(spark):
    commits = spark.createDataFrame([("f.py", "s2", day(2)), ("g.py", "s6", day(6))], "file string, commit string, commit_ts timestamp")
    reads = spark.createDataFrame([("c",)], "id string")
    found = {r["where"]: r for r in log.error_cycle(caps(spark), commits, reads, F.lit(day(9))).collect()}
    assert (found["f.py:1"]["state"], found["f.py:1"]["reappearances"]) == ("intervenida", 1)
    assert (found["g.py:1"]["state"], found["g.py:1"]["silent_days"]) == ("en-silencio", 3)
    assert found[None]["state"] == "leida"
    cycle = log.error_cycle(caps(spark), commits, reads, F.lit(day(9)))
    assert rows(log.funnel(cycle)) == [(3, 1, 2, 1)]
    assert rows(log.pending(cycle).select("where")) == [("f.py:1",), (None,)]


def test_empty_log(spark):
    c = caps(spark).limit(0)
    assert rows(log.signatures(c)) == [] and rows(log.read_stats(c, c)) == [(0, 0, 0)]


def test_as_of_takes_the_latest_before(spark):
    left = spark.createDataFrame([(1, "u", 5), (2, "u", 1), (3, "w", 9)], "e int, k string, t int")
    right = spark.createDataFrame([("u", 4, 40), ("u", 5, 50), ("u", 6, 60)], "k string, t int, v int")
    assert rows(log.as_of(left, right, ["k"], "t", ["v"])) == [(1, "u", 5, 50), (2, "u", 1, None), (3, "w", 9, None)]


def test_propagation_is_first_per_pair_and_node(spark):
    e = spark.createDataFrame([(1, "A", "1", ["n"]), (2, "B", "2", ["n", "m"]), (3, "B", "3", ["n"]), (4, "A", "4", ["m"])], "ts long, agent string, id string, nodes array<string>")
    ordered, moves = activity.chronology(e)
    assert rows(moves) == [("A", "B", "n", 1, 2), ("B", "A", "m", 2, 4)] and ordered.count() == 4


def test_debt_and_crossing(spark):
    theirs = spark.createDataFrame([("B", "s1", 5, "n"), ("B", "s2", 6, "v"), ("B", "s0", 1, "n")], "agent string, sha string, ts long, node string")
    mine = spark.createDataFrame([("s0",)], "sha string")
    own, near = (spark.createDataFrame([(x,)], "node string") for x in "nv")
    assert [(r["sha"], r["class"]) for r in activity.debt(theirs, mine, own, near, F.lit(10)).collect()] == [("s1", "mismo-nodo"), ("s2", "vecino")]
    t = spark.createDataFrame([("n", "A", "sucio"), ("n", "B", "sucio"), ("m", "A", "sucio"), ("m", "B", "commit")], "node string, agent string, kind string")
    assert [r[0] for r in activity.crossings(t).collect()] == ["n"]


def test_spans(spark):
    s = spark.createDataFrame([("out", "f", 1, 20), ("in", "f", 5, 9), ("deco", "f", 12, 15)], "qual string, file string, line int, end int")
    p = spark.createDataFrame([(1, "f", 6), (2, "f", 9), (3, "f", 10), (4, "g", 1)], "k int, path string, at int")
    assert rows(spans.innermost(p, s, ["k"]).select("k", "qual")) == [(1, "in"), (2, "in"), (3, "out")]
    near = spark.createDataFrame([(1, "f", 10)], "k int, path string, at int")
    assert rows(spans.located(near, s.where("qual = 'deco'"), ["k"]).select("qual")) == [("deco",)]
    a = spark.createDataFrame([(1, 0, 25), (2, 30, 31)], "i int, lo int, hi int")
    b = spark.createDataFrame([(7, 24, 30)], "j int, a int, b int")
    assert rows(spans.bucketed_overlap(a, b, 10).select("i", "j")) == [(1, 7), (2, 7)]


def test_resolution(spark):
    mods = spark.createDataFrame([("a",), ("a.b",)], "module string")
    asked = spark.createDataFrame([("a.b.c",), ("a.x",), ("z",)], "target string")
    assert rows(resolve.to_internal(asked, mods)) == [("a.b.c", "a.b"), ("a.x", "a"), ("z", None)]
    al = spark.createDataFrame([("p", "f", "q.f"), ("q", "f", "p.f"), ("r", "f", "s.g"), ("s", "g", "t.h")], "module string, alias string, target string")
    known = spark.createDataFrame([("t.h",)], "qual string")
    got = resolve.reexport(spark.createDataFrame([("p", "f"), ("r", "f")], "module string, attr string"), al, known)
    assert rows(got) == [("p", "f", None), ("r", "f", "t.h")]
    t = spark.createDataFrame([("x", "m.x"), ("y", "m.y"), ("y", "n.y")], "name string, qual string")
    assert rows(resolve.unique(spark.createDataFrame([("x",), ("y",), ("z",)], "name string"), t, "name", "qual").select("name", "qual", "reason")) == [("x", "m.x", None), ("y", None, "nombre-ambiguo"), ("z", None, "nombre-desconocido")]
    p = resolve.packages(spark.createDataFrame([("m", "com.acme.Thing"), ("m", "x.nope")], "src string, spec string"), spark.createDataFrame([("src.acme.Thing",), ("src.other",)], "module string"))
    assert rows(p.select("dst")) == [("src.acme.Thing",)]


def test_sets_floor_search(spark):
    a, b = spark.createDataFrame([("x", "y")], "src string, dst string"), spark.createDataFrame([("y", "z")], "src string, dst string")
    assert sets.shape_delta({"e": a}, None) is None
    assert rows(sets.shape_delta({"e": a}, {"e": b})) == [("e", "added", "x -> y"), ("e", "removed", "y -> z")] and rows(sets.shape_delta({"e": a}, {"e": a})) == []
    ls = spark.createDataFrame([("SCOPE.md",), ("tests/test_a.py",), ("pyproject.toml",), ("go.mod",)], "path string")
    lv = floor.levels(ls)
    assert rows(floor.next_step(lv)) == [("arquitectura",)] and rows(floor.rolled_up(lv)) == [("2/8",)] and rows(floor.test_command(ls)) == [("python -m pytest",)]
    n = spark.createDataFrame([("b", "spark", ""), ("a", "", "spark"), ("c", "", "x")], "name string, meta string, body string")
    assert [tuple(r) for r in search.recall(n, "spark nothing").collect()] == [("b", 2), ("a", 1)]
    r = spark.createDataFrame([("/x/y/z.py",)], "path string")
    assert rows(floor.project_root(r, spark.createDataFrame([("/x",), ("/x/y",)], "root string"))) == [("/x/y/z.py", "/x/y")]


def test_verdicts(spark):
    d = spark.createDataFrame([("c", "A", 0), ("c", "B", 0), ("c", None, 1), ("r", "A", 1), ("r", None, 0)], "case string, branch string, verdict int")
    assert rows(activity.verdicts(d)) == [("c", 1, False, True), ("r", 1, True, False)]


def test_tail_is_the_end_in_order(spark):
    d = spark.createDataFrame([(3, "c"), (1, "a"), (2, "b")], "seq int, x string")
    assert [tuple(r) for r in log.tail(d, ["seq"], 2).collect()] == [(2, "b", 1), (3, "c", 1)]
    assert [tuple(r) for r in log.tail(d, ["seq"], 9).select("x", "cut").collect()] == [("a", 0), ("b", 0), ("c", 0)]
    assert [r[0] for r in log.capped(d, ["seq"], "x", 2).collect()] == ["a", "b", "+1 more"]


def test_a_touch_is_inherited_only_with_its_commit(spark):
    each = spark.createDataFrame([(1, "a", "s1", "n", "commit"), (2, "b", "s2", "n", "commit"), (3, "c", "e1", "m", "edicion"), (4, "a", "s3", "m", "commit")], "ts long, agent string, id string, node string, kind string")
    seen = activity.inherited(each, spark.createDataFrame([("b", "s1")], "agent string, sha string"))
    assert rows(seen.select("src", "dst", "node", "inherited")) == [("a", "b", "n", True), ("c", "a", "m", None)]
    blind = activity.inherited(each, spark.createDataFrame([], "agent string, sha string"))
    assert rows(blind.select("src", "dst", "inherited"))[0] == ("a", "b", False)
