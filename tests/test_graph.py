import random

from pyspark.sql import functions as F

from codefacts.operators import graph, impact, resolve
from tests.conftest import rows


def edges(spark, pairs):
    return spark.createDataFrame(pairs or [("", "")], "src string, dst string").where("src != ''")


def nodes(spark, names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def brute_scc(pairs):
    reach = {}
    for a in {x for p in pairs for x in p}:
        seen, todo = set(), [a]
        while todo:
            for s, d in pairs:
                if s == todo[-1] and d not in seen:
                    seen.add(d)
                    todo.append(d)
                    break
            else:
                todo.pop()
        reach[a] = seen
    return sorted((a, min(b for b in reach if b in reach[a] and a in reach[b])) for a in reach if a in reach[a])


def test_components_cycle_loop_and_tail(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("f", "f")])
    for local in (0, 100):
        assert rows(graph.components(e, local)) == [("a", "a"), ("b", "a"), ("c", "a"), ("f", "f")]


def test_components_agree_on_random_graphs(spark):
    r = random.Random(3)
    pairs = sorted({(f"n{r.randrange(12):02}", f"n{r.randrange(12):02}") for _ in range(18)})
    want = brute_scc(pairs)
    assert rows(graph.components(edges(spark, pairs), 0)) == want == rows(graph.components(edges(spark, pairs), 1000))


def test_acyclic_has_no_component(spark):
    assert rows(graph.components(edges(spark, [("a", "b"), ("b", "c")]), 0)) == []


def test_frontier_truncates_only_when_work_is_left(spark):
    chain = edges(spark, [(f"n{i}", f"n{i + 1}") for i in range(9)])
    seeds = spark.createDataFrame([(0, "n0")], "key int, node string")
    long = graph.frontier(chain, seeds, 8)
    assert long.truncated and long.nodes.count() == 8
    assert not graph.frontier(chain, seeds, 9).truncated


def test_terminals_end_the_walk_and_seeds_may_return(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("b", "a"), ("c", "d")])
    found = graph.frontier(e, spark.createDataFrame([(0, "a")], "key int, node string"), 8, terminals=nodes(spark, ["c"]), mark_seeds=False)
    assert rows(found.nodes) == [(0, "a", 2), (0, "b", 1), (0, "c", 2)] and not found.truncated


def test_callers_leave_the_origin_out(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a")])
    assert rows(graph.callers(e, nodes(spark, ["c"]), 5)) == [("c", "a", 2), ("c", "b", 1)]


def test_degrees_have_zero_rows(spark):
    assert rows(graph.degrees(nodes(spark, ["a", "b", "z"]), edges(spark, [("a", "b")]))) == [("a", 0, 1), ("b", 1, 0), ("z", 0, 0)]


def test_layers_condense_cycles(spark):
    e = edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("c", "d")])
    assert rows(graph.layers(nodes(spark, "abcd"), e)) == [("a", 2), ("b", 2), ("c", 1), ("d", 0)]


def test_new_cycles_need_a_new_pair(spark):
    before = graph.components(edges(spark, [("a", "b"), ("b", "a"), ("x", "y"), ("y", "x")]))
    now = graph.components(edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("x", "y"), ("y", "x")]))
    assert [r["members"] for r in graph.new_cycles(now, before).collect()] == [["a", "b", "c"]]


def test_dead_and_only_tests(spark):
    e = edges(spark, [("tests.x", "m.f"), ("m.g", "m.h")])
    assert rows(graph.dead(nodes(spark, ["m.f", "m.g", "m.h"]), e)) == [("m.f", "only_tests"), ("m.g", "dead")]


def test_partition_count_does_not_matter(spark):
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")])
    assert rows(graph.components(e.repartition(1))) == rows(graph.components(e.repartition(7)))


def test_process_chain_by_span_then_pid(spark):
    c = spark.createDataFrame([(1, "A", "s1", None, "S", 1, 0), (2, "B", "s2", "s1", "S", 2, 9), (3, "C", None, None, "S", 3, 2)], "seq long, node string, span_id string, parent_span string, session_id string, pid int, ppid int")
    assert rows(graph.process_chain(c)) == [("A", "B"), ("B", "C")]


def test_touched_owner_goes_with_its_method(spark):
    s = spark.createDataFrame([("m.C", "class", "m", "C", None, "m.py", 1, 9), ("m.C.f", "method", "m", "f", "C", "m.py", 3, 5), ("m.g", "function", "m", "g", None, "m.py", 11, 12)], "qual string, kind string, module string, name string, owner string, file string, line int, end int")
    h = spark.createDataFrame([("m.py", 4, 4), ("m.py", 12, 20)], "path string, start int, stop int")
    assert [r[0] for r in rows(impact.touched(s, h).select("qual"))] == ["m.C.f", "m.g"]


def test_force_layout_is_the_same_twice(spark):
    e = edges(spark, [("a", "b"), ("b", "c")])
    assert rows(graph.force_layout(nodes(spark, "abc"), e)) == rows(graph.force_layout(nodes(spark, "abc"), e))
    assert graph.ego(e, nodes(spark, "a")).count() == 2
    assert F.lit(1) is not None


def test_reaches_as_far_as_the_graph_goes(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(70)], "src long, dst long")
    one = lambda x: spark.createDataFrame([(x,)], "node long")
    assert graph.reaches(chain, one(0), one(70)) and not graph.reaches(chain, one(70), one(0))


def test_layers_are_the_same_in_one_task_and_by_peeling(spark, monkeypatch):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 3), (3, 4), (5, 6), (6, 5), (6, 3), (8, 5), (9, 9)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 11)], "node long")
    want = {1: 3, 2: 2, 3: 1, 4: 0, 5: 2, 6: 2, 7: 0, 8: 3, 9: 0, 10: 0}
    assert dict(rows(graph.layers(nodes, edges))) == want
    monkeypatch.setattr(graph, "LOCAL", 0)
    assert dict(rows(graph.layers(nodes, edges))) == want


def test_dead_code_leaves_alone_what_is_used(spark):
    nodes = spark.createDataFrame(
        [("a", "module", "a", "a.py", 1, None), ("a.f", "function", "a", "a.py", 2, None), ("a.g", "function", "a", "a.py", 5, None), ("a.K", "class", "a", "a.py", 9, None), ("a.main", "function", "a", "a.py", 12, None), ("a.v", "function", "a", "a.py", 15, None),
         ("b", "module", "b", "b.py", 1, None), ("c", "module", "c", "c.py", 1, None), ("tests.t", "function", "tests", "tests/t.py", 1, None)],
        "qual string, kind string, module string, file string, line int, test boolean",
    )
    edges = spark.createDataFrame([("a.g", "a.f", "CALLS"), ("tests.t", "a.g", "CALLS"), ("a", "a.K", "DEFINES")], "src string, dst string, etype string")
    dead = graph.dead_symbols(nodes, edges, spark.createDataFrame([("a.v",)], "qual string"))
    assert rows(dead.select("qual", "state")) == [("a.K", "dead"), ("a.g", "only_tests")]
    orphans = graph.orphan_modules(nodes, edges, spark.createDataFrame([("c", "b")], "src string, dst string"), spark.createDataFrame([("c.py",)], "file string"))
    assert rows(orphans) == []
    assert dict(rows(graph.dead_total(dead, orphans))) == {"dead": 1, "only_tests": 1, "total": 2}


def test_graphs_of_two_engines(spark):
    pairs = lambda *e: spark.createDataFrame(list(e), "src string, dst string")
    assert rows(resolve.merge_engines(pairs(("a", "b")), pairs(("a", "c"), ("c", "b")))) == [("a", "b"), ("a:ext", "c"), ("c", "b:ext")]
