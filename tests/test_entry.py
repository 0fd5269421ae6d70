import os
import shutil
import subprocess
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_library_stands_without_the_corpus_operators(tmp_path):
    shutil.copytree(f"{REPO}/codefacts", tmp_path / "codefacts", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(k.startswith('op') or k == 'pipeline' for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_nothing_else_imports_the_corpus_operators():
    for folder, _, names in os.walk(f"{REPO}/codefacts"):
        if "llm" in folder.split(os.sep):
            continue
        for name in names:
            if name.endswith(".py"):
                with open(f"{folder}/{name}") as f:
                    assert "codefacts.llm" not in f.read()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
def test_entry_and_a_sample_of_queries_against_their_sql(spark):
    import duckdb

    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name in ("fan_degree_topk", "scc_cycles", "rule_violations", "error_cycle", "as_of_last_read", "debt", "test_signals_like", "innermost_container", "trace_chain", "dead_code", "captures_on_graph", "crash_anchors", "python_facts", "path_functions", "log_views", "diffs_parsed", "parallel_work"):
        got = e.queries()[name](spark, DATA)
        cols = sorted(got.columns)
        want = c.execute(f"SELECT {', '.join(chr(34) + x + chr(34) for x in cols)} FROM ({e.oracle_sql()[name]})").fetchall()
        assert sorted(map(repr, (tuple(r) for r in got.select(*[f"`{x}`" for x in cols]).collect()))) == sorted(map(repr, want)), name
