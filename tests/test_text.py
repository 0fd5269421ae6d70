from pyspark.sql import functions as F

from codefacts.functions import scalars as S
from codefacts.operators import changes
from tests.conftest import rows

DIFF = """diff --git a/tests/test_a.py b/tests/test_a.py
--- a/tests/test_a.py
+++ b/tests/test_a.py
@@ -1,3 +1,2 @@ def test_x():
-    assert f() == 1
+    assert f()
+    # --- a header? no
@@ -10,2 +9,0 @@ def test_y():
-    assert g() == 2
-def test_z():
diff --git a/app.py b/app.py
--- a/app.py
+++ b/app.py
@@ -5 +5,2 @@
+x = 1
+y = 2
diff --git a/tests/test_gone.py b/tests/test_gone.py
deleted file mode 100644
--- a/tests/test_gone.py
+++ /dev/null
@@ -1,2 +0,0 @@
-def test_q():
-    assert 1
diff --git a/tests/test_m.py b/attic/m.py
rename from tests/test_m.py
rename to attic/m.py
"""


def one(spark, column, *values):
    return [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").select("i", column.alias("v")).orderBy("i").select("v").collect()]


def test_diff_hunks_and_signals(spark):
    d = spark.createDataFrame([("d", DIFF)], "diff string, text string")
    assert rows(changes.hunks(d).select("path", "start", "stop")) == [("app.py", 5, 6), ("tests/test_a.py", 1, 2), ("tests/test_a.py", 9, 9)]
    assert [r[0] for r in rows(changes.added_lines(d).where("path = 'app.py'").select("at"))] == [5, 6]
    got = rows(changes.test_signals(changes.test_lines(d)).select("path", "signal", "n"))
    assert got == [("tests/test_a.py", "ASSERT_REMOVED", 1), ("tests/test_a.py", "ASSERT_WEAKENED", 1), ("tests/test_a.py", "TEST_REMOVED", 1), ("tests/test_gone.py", "TEST_FILE_DELETED", 1), ("tests/test_m.py", "TEST_FILE_RENAMED_OUT", 1)]


def test_multiset_difference_keeps_the_later_lines(spark):
    now = spark.createDataFrame([("f", "x", 1), ("f", "x", 5), ("f", "y", 7), (None, "x", 1)], "k string, t string, l int")
    before = spark.createDataFrame([("f", "x", 9)], "k string, t string, l int")
    assert rows(changes.new_lines(now, before, "k", "t", "l")) == [("f", "x", 5), ("f", "y", 7), (None, "x", 1)]


def test_durations(spark):
    assert one(spark, S.duration_seconds("x"), "90s", "5m", "2h", "1d", "7", "", "manana", "5x", "-3m", "0s", "m") == [90.0, 300.0, 7200.0, 86400.0, 7.0] + [None] * 6


def test_moment_needs_an_offset(spark):
    got = one(spark, S.moment("x"), "2026-08-18T09:00:00.000Z", "2026-07-29T12:00:00+02:00", "2026-07-29T12:00:00", "x")
    assert got[0] is not None and got[1] is not None and got[2] is None and got[3] is None


def test_modules_and_files(spark):
    assert one(spark, S.module_of("x"), "src/app/core.py", "app/__init__.py", "./a/b.py") == ["app.core", "app", "a.b"]
    assert one(spark, S.module_of("x", "multi"), "web/index.ts", "a/b.go") == ["web", "a.b"]
    assert one(spark, S.file_of("x"), "/a/b.py:7", r"C:\x\a.py:7", "<string>:1", "?", "plain") == ["/a/b.py", r"C:\x\a.py", None, None, "plain"]
    assert one(spark, S.is_test_module("x"), "tests.a", "a.carrito_test", "a.CarritoTests", "a.b", "", "test_a") == [True, True, True, False, False, True]


def test_redaction(spark):
    assert one(spark, S.redact("x"), 'password = "x y"', "token=abc, z", "nothing here") == ["password = <redactado>", "token=<redactado>, z", "nothing here"]
    assert one(spark, S.sensitive("x"), "API_KEY", "b'password'", "name", None) == [True, True, False, False]


def test_argv_shape(spark):
    d = spark.createDataFrame([(["/usr/bin/tool", "calls", "x", "--token=abc", "-v"],), (["python", "-c", "print(1)"],), ([],)], "a array<string>")
    assert [r[0] for r in d.select(S.argv_shape("a")).collect()] == [["tool", "calls", "<arg>", "--token=<val>", "-v"], ["python", "-c", "<arg>"], []]


def test_signatures_that_break_calls(spark):
    d = spark.createDataFrame([("(a)", "(a, b)"), ("(a)", "(a, b=1)"), ("(a, b)", "(a)"), ("(a)", "(*args)"), ("(a='x, y')", "(a='x, y', b=(1, 2))")], "o string, n string")
    assert [r[0] for r in d.select(S.breaks_calls("o", "n")).collect()] == [True, False, True, False, False]


def test_code_only_and_comparison(spark):
    assert one(spark, S.code_only("x"), """f("a == b", 'c')""") == ['f("", \'\')']
    assert one(spark, S.compares("x"), 'assert f("==")', "assert a == b") == [False, True]


def test_fade_and_jitter(spark):
    d = spark.createDataFrame([(0,), (390,), (700,)], "a int")
    assert [r[0] for r in d.select(S.fade("a")).collect()] == [1.0, 0.5, 0.0]
    assert all(-1 <= x <= 1 for x in one(spark, S.jitter("x"), "a", "b", "c"))
    assert F.lit(1) is not None
