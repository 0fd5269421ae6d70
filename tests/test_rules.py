from pyspark.sql import functions as F

from codefacts.operators import rules
from tests.conftest import rows

LAW = """
CORE = app.db,   # continued
       app.model
CORE -/-> app.web
app.web :: main, serve
app.cli => app.db
app.db -/-> app.db
nonsense
"""


def test_parse_groups_and_continuation():
    r = rules.parse(LAW)
    assert r.forbidden == [("app.db", "app.web"), ("app.model", "app.web")]
    assert r.surfaces == [("app.web", ["main", "serve"])] and r.declared == [("app.cli", "app.db")] and r.malformed == ["nonsense"]


def test_groups_hold_only_from_where_they_stand():
    assert rules.parse("G -/-> x\nG = a, b").forbidden == [("G", "x")]


def test_first_rule_wins_and_prefix_is_at_a_dot(spark):
    e = spark.createDataFrame([("app.db.x", "app.web"), ("app.dbx", "app.web")], "src string, dst string")
    t = rules.rule_table(spark, [("app.db", "app.web"), ("app", "app.web")])
    assert rows(rules.violations(e, t)) == [("app.db.x", "app.web", "app.db", "app.web"), ("app.dbx", "app.web", "app", "app.web")]


def test_clean_project_is_silent(spark):
    e = spark.createDataFrame([("app.web", "app.db")], "src string, dst string")
    assert rows(rules.violations(e, rules.rule_table(spark, [("app.db", "app.web")]))) == []


def test_surface_from_outside_only(spark):
    calls = spark.createDataFrame([("a.f", "w.hidden"), ("a.f", "w.open"), ("w.g", "w.hidden"), ("?.h", "w.hidden")], "src string, dst string")
    mods = spark.createDataFrame([("a.f", "a"), ("w.hidden", "w"), ("w.open", "w"), ("w.g", "w")], "qual string, module string")
    assert rows(rules.surface_violations(calls, rules.surface_table(spark, [("w", ["open"])]), mods)) == [("?.h", "w.hidden", "w"), ("a.f", "w.hidden", "w")]


def test_unmatched_and_uncovered(spark):
    n = spark.createDataFrame([("a",), ("b.c",), ("tests.t",)], "module string")
    t = rules.rule_table(spark, [("a", "zzz")])
    assert rows(rules.unmatched(n, t)) == [(0, "a", "zzz", True, False)]
    assert rows(rules.without_rule(n, rules.all_patterns(t))) == [("b.c",)]


def test_ladder_order(spark):
    one = lambda **k: spark.range(1).select(rules.ladder(*[F.lit(k.get(x)).cast("boolean" if x in ("green", "done") else "int") if x in k else (F.lit(None).cast("boolean") if x in ("green", "done") else F.lit(0)) for x in ("green", "cycles", "borders", "calls", "surfaces", "orphans", "law", "lawless", "modules", "done")]).alias("v")).first()[0]
    assert one(green=False, done=True) == "rechazar"
    assert one(green=True, cycles=1, law=1) == "rechazar"
    assert one(green=True, law=1, modules=1) == "escalar"
    assert one(modules=1) == "escalar"
    assert one(green=True, modules=1) == "sin-objeciones"
    assert one(green=True, modules=1, done=True) == "aceptar"
