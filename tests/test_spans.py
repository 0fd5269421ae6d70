import random

from conftest import rows
from pyspark.sql import functions as F

from codefacts.operators import impact, log, spans


def odd_spans(n, seed):
    """Spans with nulls, negative lines, ends before their starts and shared starts."""
    r = random.Random(seed)
    line = lambda: None if r.random() < 0.04 else r.randint(-40, 60)
    out = []
    for i in range(n):
        a = line()
        out.append((f"q{i:03d}", r.choice(["f", "g", "h", None]), a, line() if r.random() < 0.3 or a is None else a + r.choice([0, 1, 3, 7, 8, 30, 70])))
    return out


def joined_by_equality_only(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return not any("Join" in line and ("<=" in line or ">=" in line) for line in plan.splitlines())


SPAN, POINT = "qual string, file string, line int, end int", "k int, path string, at int"


def held(points, table):
    return [(k, q, a, b) for k, path, at in points for q, file, a, b in table if None not in (path, at, a, b) and path == file and a <= at <= b]


def first(pairs, order):
    best = {}
    for k, *span in pairs:
        if k not in best or order(span) < order(best[k]):
            best[k] = span
    return sorted((k, s[0]) for k, s in best.items())


def test_innermost_on_odd_spans_looks_at_no_pair_that_does_not_match(spark):
    table, r = odd_spans(150, 1), random.Random(2)
    points = [(k, r.choice(["f", "g", "x", None]), r.choice([None, *range(-30, 50)])) for k in range(120)]
    got = spans.innermost(spark.createDataFrame(points, POINT), spark.createDataFrame(table, SPAN), ["k"]).select("k", "qual")
    assert joined_by_equality_only(got)
    assert sorted(map(tuple, got.collect())) == first(held(points, table), lambda s: (-s[1], s[2], s[0]))


def test_crash_anchor_looks_at_no_symbol_that_does_not_hold_the_crash(spark):
    symbols = spark.createDataFrame([("m.f", "m.py", 1, 9), ("m.f.g", "m.py", 4, 6), ("m.h", "m.py", 8, 7)], SPAN)
    frames = "id string, ts timestamp_ntz, frames array<struct<file:string,line:int,is_library:boolean>>"
    crashes = spark.createDataFrame([(i, None, [("/p/m.py", at, False)]) for i, at in (("a", 5), ("b", 7), ("c", 10))], frames)
    calls = spark.createDataFrame([("m.h", "m.f.g")], "src string, dst string")
    none = spark.createDataFrame([], "file string")
    commits = spark.createDataFrame([], "file string, commit string, commit_ts timestamp_ntz")
    got = log.crash_anchor(crashes, symbols, calls, none, commits, "/p").select("id", "site", "node", "callers")
    assert joined_by_equality_only(got.select("id", "node"))
    assert rows(got) == [("a", "m.py:5", "m.f.g", ["m.h"]), ("b", "m.py:7", "m.f", [])]


def test_crash_anchor_gives_one_row_a_record_where_ids_recur(spark):
    symbols = spark.createDataFrame([("m.f", "m.py", 1, 9), ("m.f.g", "m.py", 4, 6)], SPAN)
    frames = "id string, ts timestamp_ntz, frames array<struct<file:string,line:int,is_library:boolean>>"
    crashes = spark.createDataFrame([(i, None, [("/p/m.py", at, False)]) for i, at in (("a", 5), ("a", 2), ("a", 90), ("b", 2))], frames)
    calls = spark.createDataFrame([("m.h", "m.f.g")], "src string, dst string")
    none = spark.createDataFrame([], "file string")
    commits = spark.createDataFrame([], "file string, commit string, commit_ts timestamp_ntz")
    got = log.crash_anchor(crashes, symbols, calls, none, commits, "/p").select("id", "site", "node")
    assert rows(got) == [("a", "m.py:2", "m.f.g"), ("a", "m.py:5", "m.f.g"), ("a", "m.py:90", "m.f.g"), ("b", "m.py:2", "m.f")]


def test_spans_far_from_all_points_are_left_out_before_they_are_cut_up(spark):
    table = spark.createDataFrame([(f"q{i}", "f", 100 * i, 100 * i + 40) for i in range(200)], SPAN)
    points = spark.createDataFrame([(1, "f", 310), (2, "f", 341)], POINT)
    assert rows(spans._near(points, table, "line", "end").select("qual").distinct()) == [("q3",)]
    assert rows(spans.innermost(points, table, ["k"]).select("k", "qual")) == [(1, "q3")]


def test_overlapping_on_odd_spans_looks_at_no_pair_that_does_not_match(spark):
    table, hunks = odd_spans(150, 3), odd_spans(90, 4)
    got = spans.overlapping(spark.createDataFrame(table, SPAN), spark.createDataFrame(hunks, "h string, path string, start int, stop int")).select("qual", "h")
    # the two remaining comparisons are filters on ends before starts, not conditions of a search
    want = [(q, h) for q, file, a, b in table for h, path, c, d in hunks if None not in (file, a, b, c, d) and path == file and c <= b and a <= d]
    assert rows(got) == sorted(want, key=repr)
    many = spark.range(300_000).selectExpr("'q' as qual", "'f' as file", "cast(id * 3 as int) as line", "cast(id * 3 + 1 as int) as end")
    assert spans.overlapping(many, many.selectExpr("'h' as h", "file as path", "line as start", "end as stop")).count() == 300_000  # 90 billion pairs of one file


def test_located_and_enclosing_on_odd_spans_look_at_no_pair_that_does_not_match(spark):
    table, r = [(*s, "m") for s in odd_spans(150, 5)], random.Random(6)
    points = [(k, r.choice(["f", "g", "x", None]), r.choice([None, *range(-30, 50)])) for k in range(120)]
    s, p = spark.createDataFrame(table, SPAN + ", module string"), spark.createDataFrame(points, POINT)
    bare = [t[:4] for t in table]
    around = dict(first(held(points, bare), lambda x: (x[2] - x[1], x[0])))
    got = spans.enclosing(p, s, ["k"])
    assert joined_by_equality_only(got)
    assert dict(map(tuple, got.collect())) == {k: around.get(k) for k, *_ in points}
    at = {k: x for k, _, x in points}
    near = [(k, q, a, b) for k, path, x in points for q, file, a, b in bare if None not in (path, x, a, b) and path == file and a <= x + 5 and x <= b]
    want = {}
    for k, q, a, b in near:
        place = (0 if a == at[k] else 1 if a < at[k] else 2, b - a, q)
        want[k] = min(want.get(k, place), place)
    got = spans.located(p, s, ["k"]).select("k", "qual")
    assert joined_by_equality_only(got)
    assert dict(map(tuple, got.collect())) == {k: place[2] for k, place in want.items()}


def test_value_edges_of_one_large_module_are_dealt_over_tasks(spark):
    named = spark.range(3000).selectExpr("concat('b', id) as qual", "if(id = 7, 'x.y', 'p.m.<modulo>') as body")
    symbols = spark.range(2500).selectExpr("concat('p.m.f', id) as qual", "if(id = 0, 'class', 'function') as kind", "'p.m' as module")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = impact.value_edges(named, symbols)
        wide = got.where("dst like 'p.m.f%'")
        assert got.count() - 1 == wide.distinct().count() == 2999 * 2499
        sizes = [r["count"] for r in wide.groupBy(F.spark_partition_id()).count().collect()]
        assert max(sizes) < 0.7 * sum(sizes)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
