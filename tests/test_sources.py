import json
import subprocess

from pyspark.sql import functions as F

from codefacts.operators import extract
from codefacts.plans import commands
from codefacts.sources import files, git, jsonl
from codefacts.streaming import mailbox
from tests.conftest import rows

TREE = {
    "app/__init__.py": "",
    "app/util.py": "import os\n\ndef tidy(x, y=1):\n    '''Clean.'''\n    return x\n",
    "app/core.py": "﻿from .util import tidy\nfrom app import util\nfrom app.util import gone\n\nclass Base:\n    def inner_step(self):\n        return tidy(1)\n\nclass Worker(Base):\n    def serve(self):\n        self.inner_step()\n        util.tidy(2)\n        obj.launch()\n\nHANDLERS = [tidy]\n",
    "app/bad.py": "def (:\n",
    "tests/test_core.py": "from app.core import Worker\n\ndef test_worker():\n    Worker()\n",
    "node_modules/x.py": "import nope\n",
    "sub/pyproject.toml": "",
    "sub/inner.py": "import nope\n",
}


def write(root, tree):
    for path, text in tree.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    return str(root)


def run(root, *args):
    subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.com", *args], check=True, capture_output=True)


def test_tree_to_symbol_graph(spark, tmp_path):
    f = commands.tree_files(spark, write(tmp_path, TREE))
    assert sorted(r[0] for r in f.select("path").collect()) == ["app/__init__.py", "app/bad.py", "app/core.py", "app/util.py", "tests/test_core.py"]
    a = commands.analyse(f)
    assert rows(a.imports) == [("app.core", "app"), ("app.core", "app.util"), ("tests.test_core", "app.core")] or rows(a.imports) == [("app.core", "app.util"), ("tests.test_core", "app.core")]
    e = rows(a.edges)
    for want in [("app.core.Base.inner_step", "app.util.tidy", "CALLS"), ("app.core.Worker", "app.core.Base", "EXTENDS"), ("app.core.Worker.serve", "app.util.tidy", "CALLS"), ("tests.test_core.test_worker", "app.core.Worker", "CALLS"), ("app.core", "app.core.Base", "DEFINES"), ("app.core.Base.inner_step", "app.core.Base", "MEMBER_OF")]:
        assert want in e
    assert not any("launch" in x[1] for x in e)
    assert dict(rows(a.unresolved))["atributo-de-variable"] >= 1
    assert ("app.util.tidy", "app.core.<modulo>") in rows(a.named)
    assert rows(extract.errors(a.facts).select("path")) == [("app/bad.py",)]
    assert rows(extract.broken_imports(a.facts).select("missing")) == [("app.util.gone",)]
    sig = {r["qual"]: r["sig"] for r in a.symbols.collect()}
    assert sig["app.util.tidy"] == "(x, y=1)"


def test_git_source_and_selection(spark, tmp_path):
    root = write(tmp_path, {"calc/ops.py": "def plus(left, right):\n    total = left + right\n    return total\n\n\ndef minus(left, right):\n    return left - right\n", "tests/test_plus.py": "from calc.ops import plus\n\ndef test_plus():\n    assert plus(1, 2) == 3\n", "tests/test_minus.py": "from calc.ops import minus\n\ndef test_minus():\n    assert minus(2, 1) == 1\n"})
    run(root, "init", "-q")
    run(root, "add", "-A")
    run(root, "commit", "-qm", "one")
    (tmp_path / "calc/ops.py").write_text("def plus(left, right):\n    total = right + left\n    return total\n\n\ndef minus(left, right):\n    return left - right\n")
    assert rows(git.read(spark, root, "blobs", ref="HEAD").select("path")) == [("calc/ops.py",), ("tests/test_minus.py",), ("tests/test_plus.py",)]
    assert git.read(spark, root, "log").count() == 3
    chosen = commands.tests_report(spark, root, commands.tree_files(spark, root))
    assert not chosen.run_all and chosen.files == ["tests/test_plus.py"]


def test_gate_fires_on_a_cycle_and_is_silent_without(spark, tmp_path):
    bad = commands.tree_files(spark, write(tmp_path / "a", {"pkg/__init__.py": "", "pkg/a.py": "from . import b\n", "pkg/b.py": "from . import a\n"}))
    good = commands.tree_files(spark, write(tmp_path / "b", {"pkg/__init__.py": "", "pkg/a.py": "from . import b\n", "pkg/b.py": "\n"}))
    assert commands.graph_report(spark, bad).code == 1
    assert commands.graph_report(spark, good).code == 0
    assert commands.graph_report(spark, good, law="pkg.a -/-> pkg.b").code == 1
    assert commands.graph_report(spark, good, law="what is this").code == 2


def test_delta_counts_only_what_was_added(spark, tmp_path):
    old = "def f():\n    try:\n        g()\n    except Exception:\n        pass\n"
    new = "# moved\n" + old + "\ndef h() -> int | None:\n    raise NotImplementedError\n"
    before, now = (commands.tree_files(spark, write(tmp_path / n, {"lib.py": t})) for n, t in (("a", old), ("b", new)))
    assert rows(commands.delta_report(now, before).tables["added"].select("category", "line")) == [("pendiente", 9)]


def test_notes(spark, tmp_path):
    root = write(tmp_path, {"b.md": "---\nname: bee\ntags: [x, y]\nscope: always\n---\nbody\n", "plain.MD": "only body", "bad.md": "---\nname: x\nno end", "MEMORY.md": "index"})
    n = files.notes(files.tree(spark, root))
    assert rows(n.select("name", "broken")) == [("bad", True), ("bee", False), ("plain", False)]
    assert n.where("name = 'bee'").first()["tags"] == ["x", "y"]


def test_corrupt_lines_are_skipped(spark, tmp_path):
    (tmp_path / "i.jsonl").write_text('{"id": "a", "ts": "2026-01-01T00:00:00Z"}\n{esto no es json\n\n{"id": "b", "ts": "2026-01-02T00:00:00+00:00"}\n')
    assert rows(jsonl.index(spark, str(tmp_path / "i.jsonl")).select("id")) == [("a",), ("b",)]


def record(**more):
    return json.dumps({"schema": 2, "ts": "2026-08-18T09:00:00.000Z", "language": "js", "exception": {"type": "TypeError", "message": "x", "origin": "debugger"}, "frames": [{"file": "app.js", "line": 3, "function": "f", "source": "boom()"}, {"file": "node:internal", "line": 1}], "process": {"pid": "12", "cwd": "/p"}} | more)


def test_mailbox_normalises_and_is_idempotent(spark, tmp_path):
    box, root = tmp_path / "box", tmp_path / "root"
    box.mkdir()
    (box / "1.jsonl").write_text(record() + "\n" + record()[:40] + "\n" + record() + "\n" + record(language="lua", frames=None, stack=[{"short_src": "a.lua", "line": 2}]) + "\n")
    mailbox.ingest(spark, str(box), str(root))
    got = spark.read.parquet(f"{root}/archive")
    assert got.count() == 2
    js = got.where("language = 'js'").first()
    assert [f["file"] for f in js["frames"]] == ["node:internal", "app.js"] and js["frames"][0]["is_library"] and js["process"]["pid"] == 12 and js["odd_origin"] == "debugger" and js["thread"] == "MainThread"
    assert js["frames"][1]["source"][0]["text"] == "boom()"
    mailbox.ingest(spark, str(box), str(root))
    (box / "2.jsonl").write_text(record() + "\n")
    mailbox.ingest(spark, str(box), str(root))
    assert spark.read.parquet(f"{root}/archive").count() == 2


def test_launch_sites_and_panics(spark):
    f = spark.createDataFrame([("a.py", "x = 1\nsubprocess.run(['php', 'b.php'])\n"), ("b.go", "exec.Command(\"ls\")")], "path string, text string")
    assert rows(files.launch_sites(f).select("path", "at")) == [("a.py", 2), ("b.go", 1)]
    out = spark.createDataFrame([(1, "panic: index out of range\n\ngoroutine 1 [running]:\nmain.f()\n\t/x/m.go:7 +0x1\n"), (2, "thread 'main' panicked at 'boom', src/m.rs:3:5\n"), (3, "fine")], "id int, text string")
    from codefacts.functions.scalars import panic_type

    assert rows(extract.panics(out, panic_type("message", extract.PANIC_TYPES)).select("id", "language", "type", "line")) == [(1, "go", "index-out-of-range", 7), (2, "rust", "panic", 3)]
    assert F.lit(1) is not None
