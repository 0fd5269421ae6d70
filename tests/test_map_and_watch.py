from codefacts.functions.safe import bounded, safe_repr
from codefacts.plans import map as pages
from codefacts.streaming.watch import watch


def test_bounded_values(spark):
    assert bounded({"password": "x", "a": [1, 2]}) == "{'password': <redactado>, 'a': [1, 2]}"
    assert bounded("y" * 300).endswith("...(+62 chars)") and bounded([[[[[1]]]]]) == "[[[[[...]]]]]"
    assert "...(+5)" in bounded(list(range(15)))
    d = spark.createDataFrame([('{"token": 1}',), ("no json",), (None,)], "v string")
    assert [r[0] for r in d.select(safe_repr("v")).collect()] == ["{'token': <redactado>}", "no json", None]


def test_map_is_whole_or_says_what_is_missing(spark):
    n = spark.createDataFrame([(x,) for x in ("a", "b", "</script>")], "node string")
    e = spark.createDataFrame([("a", "b"), ("a", "</script>")], "src string, dst string")
    data = pages.payload(n, e)
    assert len(data["nodes"]) == 3 and len(data["edges"]) == 2 and data["left_out"] == 0
    assert pages.page(data).count("</script>") == 2 and pages.payload(n, e, 2)["left_out"] == 1


def test_watch_acts_on_change_and_heartbeat(spark):
    shots = [1, 1, 2, 2, 2]
    said, t = [], [0.0]

    def files():
        return spark.createDataFrame([("f", shots[min(len(seen), 4)], 1)], "path string, mtime int, size int")

    seen: list = []

    def sleep(x):
        seen.append(x)
        t[0] += 20

    assert watch(files, said.append, heartbeat=30, ticks=5, clock=lambda: t[0], sleep=sleep) == 3
    assert said == ["changed", "changed", "heartbeat"]
