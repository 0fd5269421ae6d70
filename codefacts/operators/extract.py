"""Facts of Python sources, file by file; everything across files is a join elsewhere (FX1, FX2, FX5 to FX11, FX15, FX16, FX18, FX19, FX34).

``facts`` is one long table; the functions below select its kinds.
"""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.operators import resolve
from codefacts.session import ship

COLUMNS = ("path", "module", "fact", "name", "qual", "owner", "target", "form", "base", "line", "end", "text", "flag")
SCHEMA = ", ".join(f"{c} {'int' if c in ('line', 'end') else 'boolean' if c == 'flag' else 'string'}" for c in COLUMNS)
DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
MARKS = ("TODO", "FIXME", "XXX", "HACK")


def import_base(level: int, name: str | None, module: str, is_pkg: bool) -> str | None:
    """FX2: what a ``from`` import starts at; None if it climbs out of the tree."""
    if not level:
        return name or ""
    home = module.split(".") if is_pkg else module.split(".")[:-1]
    if level - 1 > len(home):
        return None
    return ".".join([*home[: len(home) - level + 1], *([name] if name else [])])


def dotted(node: ast.expr) -> str:
    """The last name of a base class or decorator."""
    return node.attr if isinstance(node, ast.Attribute) else node.id if isinstance(node, ast.Name) else dotted(node.value) if isinstance(node, ast.Subscript) else ""


def first_line(node: ast.AST) -> str:
    """FX9."""
    return next((x.strip() for x in (ast.get_docstring(node) or "").splitlines() if x.strip()), "")


def signature(node: ast.FunctionDef | ast.AsyncFunctionDef) -> str:
    """FX10: parameters as a caller writes them; long defaults are cut."""

    def one(arg: ast.arg, default: ast.expr | None) -> str:
        text = "" if default is None else ast.unparse(default)
        return arg.arg if default is None else f"{arg.arg}={text if len(text) <= 25 else text[:24] + '…'}"

    a = node.args
    plain = [*a.posonlyargs, *a.args]
    given = [None] * (len(plain) - len(a.defaults)) + a.defaults
    out = [one(x, d) for x, d in zip(plain, given)]
    if a.posonlyargs:
        out.insert(len(a.posonlyargs), "/")
    if a.vararg or a.kwonlyargs:
        out.append("*" + (a.vararg.arg if a.vararg else ""))
    out += [one(x, d) for x, d in zip(a.kwonlyargs, a.kw_defaults)]
    if a.kwarg:
        out.append("**" + a.kwarg.arg)
    marks = "".join(f"@{d.id} " for d in node.decorator_list if isinstance(d, ast.Name) and d.id in ("property", "classmethod", "staticmethod"))
    return f"{marks}{'async ' * isinstance(node, ast.AsyncFunctionDef)}({', '.join(out)})"


class _File:
    """Collects rows of one file."""

    def __init__(self, path: str, module: str, is_pkg: bool):
        self.path, self.module, self.is_pkg, self.rows = path, module, is_pkg, []

    def put(self, fact: str, **more) -> None:
        self.rows.append({c: None for c in COLUMNS} | {"path": self.path, "module": self.module, "fact": fact} | more)

    def read(self, text: str) -> None:
        try:
            tree = ast.parse(text.lstrip("﻿"))
        except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
            self.put("error", text=str(e)[:200])
            return
        self.put("symbol", name=self.module.rpartition(".")[2], qual=self.module, form="module", line=1, text=first_line(tree))
        self._imports(tree)
        self._census(tree)
        self._symbols(tree)
        self._code(tree, text)

    def _imports(self, tree: ast.Module) -> None:
        top = set(map(id, tree.body))
        for n in ast.walk(tree):
            if isinstance(n, ast.Import):
                for a in n.names:
                    self.put("import", target=a.name, line=n.lineno)
                    self.put("alias", name=a.asname or a.name.split(".")[0], target=a.name, line=n.lineno)
            elif isinstance(n, ast.ImportFrom) and (base := import_base(n.level, n.module, self.module, self.is_pkg)) is not None:
                for a in n.names:
                    goal = f"{base}.{a.name}" if base else a.name
                    self.put("import", target=goal, line=n.lineno)
                    self.put("alias", name=a.asname or a.name, target=goal, line=n.lineno)
                    if id(n) in top and a.name != "*":
                        self.put("from", base=base, name=a.name, line=n.lineno)

    def _census(self, tree: ast.Module) -> None:
        names, wild = set(), any(isinstance(n, DEFS) and n.name == "__getattr__" for n in tree.body)
        for n in ast.walk(tree):
            if isinstance(n, (*DEFS, ast.ClassDef)):
                names.add(n.name)
            elif isinstance(n, ast.Name) and not isinstance(n.ctx, ast.Load):
                names.add(n.id)
            elif isinstance(n, (ast.Import, ast.ImportFrom)):
                wild |= any(a.name == "*" for a in n.names)
                names |= {a.asname or (a.name if isinstance(n, ast.ImportFrom) else a.name.split(".")[0]) for a in n.names}
            elif isinstance(n, ast.ExceptHandler) and n.name:
                names.add(n.name)
            elif isinstance(n, (ast.Global, ast.Nonlocal)):
                names |= set(n.names)
        for x in sorted(names - {"*"}):
            self.put("bound", name=x)
        if wild:
            self.put("wild")

    def _symbols(self, tree: ast.Module) -> None:
        rest = []
        for n in tree.body:
            if isinstance(n, DEFS):
                self._function(n, None, self.module)
            elif isinstance(n, ast.ClassDef):
                qual, bases = f"{self.module}.{n.name}", [b for b in map(dotted, n.bases) if b]
                self.put("symbol", name=n.name, qual=qual, form="class", line=n.lineno, end=n.end_lineno, text=first_line(n), target=f"({', '.join(bases)})" if bases else "")
                for b in bases:
                    self.put("base", name=n.name, qual=qual, target=b)
                abstract = any(isinstance(m, DEFS) and any(dotted(d) == "abstractmethod" for d in m.decorator_list) for m in n.body)
                if abstract or "ABC" in bases:
                    self.put("abstract", name=n.name, qual=qual, flag="Protocol" in bases)
                for m in n.body:
                    if isinstance(m, DEFS):
                        self._function(m, n.name, qual)
                    else:
                        rest.append((m, n.name))
            else:
                rest.append((n, None))
        for n, cls in rest:
            self._calls(n, f"{self.module}.<modulo>", cls)

    def _function(self, n, owner: str | None, above: str) -> None:
        qual = f"{above}.{n.name}"
        self.put("symbol", name=n.name, qual=qual, form="method" if owner else "function", owner=owner, line=n.lineno, end=n.end_lineno, text=first_line(n), target=signature(n))
        self._calls(n, qual, owner)

    def _calls(self, root: ast.AST, body: str, cls: str | None) -> None:
        called = set()
        for n in ast.walk(root):
            if not isinstance(n, ast.Call):
                continue
            f = n.func
            called.add(id(f))
            if isinstance(f, ast.Name):
                self.put("call", qual=body, owner=cls, form="name", name=f.id, line=n.lineno)
            elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
                called.add(id(f.value))
                self.put("call", qual=body, owner=cls, form="attr", base=f.value.id, name=f.attr, line=n.lineno)
            elif isinstance(f, ast.Attribute):
                self.put("call", qual=body, owner=cls, form="attr", base="", name=f.attr, line=n.lineno)
            else:
                self.put("call", qual=body, owner=cls, form="dynamic", line=n.lineno)
        for n in ast.walk(root):
            if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Load) and id(n) not in called:
                self.put("value", qual=body, name=n.id, line=n.lineno)

    def _code(self, tree: ast.Module, text: str) -> None:
        for n in ast.walk(tree):
            if isinstance(n, ast.ExceptHandler):
                kind = "except:" if n.type is None else f"except {n.type.id}:" if isinstance(n.type, ast.Name) else "except (...):"
                doing = [s for s in n.body if not (isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant))]
                if len(doing) == 1 and isinstance(doing[0], (ast.Pass, ast.Continue)):
                    self.put("silencio", line=n.lineno, text=kind)
                elif kind in ("except Exception:", "except BaseException:"):
                    self.put("amplio", line=n.lineno, text=kind)
            elif isinstance(n, ast.Raise):
                what = n.exc.func if isinstance(n.exc, ast.Call) else n.exc
                if isinstance(what, ast.Name) and what.id == "NotImplementedError":
                    self.put("pendiente", line=n.lineno, text=what.id)
            elif isinstance(n, (*DEFS, ast.ClassDef)):
                self.put("cuerpo", name=n.name, line=n.lineno, end=n.end_lineno)
                if isinstance(n, DEFS):
                    if n.returns is not None:
                        self.put("retorno", name=n.name, line=n.lineno, text=ast.unparse(n.returns))
                    inner = n.body[1:] if ast.get_docstring(n) is not None else n.body
                    for s in inner[:3]:
                        if isinstance(s, ast.If) and not s.orelse and isinstance(s.body[-1], ast.Raise) and s.body[-1].exc is not None:
                            self.put("guarda", name=n.name, line=s.lineno, text=f"if {ast.unparse(s.test)}: raise {ast.unparse(s.body[-1].exc)}"[:80])
        for i, line in enumerate(text.split("\n"), 1):
            if line.lstrip().startswith("#") and any(m in line for m in MARKS):
                self.put("pendiente", line=i, text=line.strip()[:70])


def facts(files: DataFrame) -> DataFrame:
    """All facts of Python files (path, module, text, is_pkg); a file that cannot be read or parsed is an ``error`` row."""

    def run(batches):
        for pdf in batches:
            rows = []
            for path, module, text, is_pkg in zip(pdf["path"], pdf["module"], pdf["text"], pdf["is_pkg"]):
                file = _File(path, module, bool(is_pkg))
                if text is None:
                    file.put("error", text="no se pudo leer")
                else:
                    file.read(text)
                rows += file.rows
            out = pd.DataFrame(rows, columns=list(COLUMNS))
            for c in ("line", "end"):
                out[c] = out[c].astype("Int32")
            yield out

    return files.where("lang = 'python'").select("path", "module", "text", "is_pkg").mapInPandas(run, SCHEMA)


def symbols(found: DataFrame) -> DataFrame:
    """FX11: ``symbols``."""
    return found.where("fact = 'symbol'").select("qual", F.col("form").alias("kind"), "module", "name", "owner", F.col("text").alias("doc"), F.col("path").alias("file"), "line", "end", F.col("target").alias("sig"), F.lit(None).cast("boolean").alias("test"))


def raw_imports(found: DataFrame) -> DataFrame:
    """FX1."""
    return found.where("fact = 'import'").select("module", "target").distinct()


def aliases(found: DataFrame) -> DataFrame:
    """FX5: the last binding of each name."""
    return found.where("fact = 'alias'").groupBy("module", F.col("name").alias("alias")).agg(F.max_by("target", "line").alias("target"))


def errors(found: DataFrame) -> DataFrame:
    return found.where("fact = 'error'").select("path", "text")


def code_facts(found: DataFrame) -> DataFrame:
    """FX19."""
    return found.where(F.col("fact").isin("silencio", "amplio", "pendiente", "cuerpo", "retorno", "guarda")).select("path", "fact", "name", "line", "end", "text")


def classes(found: DataFrame) -> DataFrame:
    """FX18's input: name, qual, bases, abstract, protocol."""
    bases = found.where("fact = 'base'").groupBy("qual").agg(F.collect_list("target").alias("bases"))
    abstract = found.where("fact = 'abstract'").select("qual", "flag")
    return symbols(found).where("kind = 'class'").select("name", "qual").join(bases, "qual", "left").join(abstract, "qual", "left").select("name", "qual", F.coalesce("bases", F.array().cast("array<string>")).alias("bases"), F.col("flag").isNotNull().alias("abstract"), F.coalesce("flag", F.lit(False)).alias("protocol"))


def broken_imports(found: DataFrame) -> DataFrame:
    """FX6, FX7, FX8: (path, line, missing) of top-level imports of a name that its module, read whole, does not have."""
    mods = found.where("fact = 'symbol' and form = 'module'").select("module")
    wild = found.where("fact = 'wild'").select("module").distinct()
    bound = found.where("fact = 'bound'").select("module", "name").distinct()
    asked = found.where("fact = 'from'").select("path", "line", F.col("base").alias("module"), "name").join(mods, "module", "left_semi").join(wild, "module", "left_anti").join(bound, ["module", "name"], "left_anti")
    asked = asked.withColumn("missing", F.concat_ws(".", "module", "name"))
    return asked.join(mods.select(F.col("module").alias("missing")), "missing", "left_anti").select("path", "line", "missing")


BUILTINS = [x for x in dir(__builtins__) if not x.startswith("_")] if not isinstance(__builtins__, dict) else [x for x in __builtins__ if not x.startswith("_")]


def symbol_graph(found: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """FX16: (edges src, dst, etype; unresolved reason, n; named_as_value qual, body).

    Edges are distinct; what could not be resolved is counted by call site.  A
    call of oneself is neither.
    """
    s = symbols(found)
    known = s.where("kind != 'module'")
    mods = s.where("kind = 'module'").select("module")
    functions, cls, methods = known.where("kind = 'function'"), known.where("kind = 'class'"), known.where("kind = 'method'")
    al = aliases(found)
    defines = known.where("kind in ('function', 'class')").select(F.col("module").alias("src"), F.col("qual").alias("dst"), F.lit("DEFINES").alias("etype"))
    member = methods.select(F.col("qual").alias("src"), F.concat_ws(".", "module", "owner").alias("dst"), F.lit("MEMBER_OF").alias("etype"))
    bases = resolve.bare_name(found.where("fact = 'base'").select("module", F.col("target").alias("name"), F.col("qual").alias("sub")), functions, cls, al, known)
    extends = bases.where("qual is not null and qual != sub").select(F.col("sub").alias("src"), F.col("qual").alias("dst"), F.lit("EXTENDS").alias("etype"))
    calls = found.where("fact = 'call'").select("module", F.col("qual").alias("body"), F.col("owner").alias("cls"), "form", "base", F.col("name").alias("attr"))
    done = resolve.resolve_calls(calls, functions, cls, methods, al, known, mods, BUILTINS)
    call = done.where("dst is not null and dst != body").select(F.regexp_replace("body", r"\.<modulo>$", "").alias("src"), "dst", F.lit("CALLS").alias("etype"))
    edges = defines.unionByName(member).unionByName(extends).unionByName(call).distinct()
    unresolved = done.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))
    used = resolve.bare_name(found.where("fact = 'value'").select("module", "name", F.col("qual").alias("body")), functions, cls, al, known)
    return edges, unresolved, used.where("qual is not null and qual != body").select("qual", "body").distinct()


PANICS = {
    "go": (r"(?m)^panic:\s*(.+)$", r"(?m)^\t(.+):(\d+)\s"),
    "rust": (r"thread '.+?'\s*(?:\(\d+\)\s*)?panicked at (?:'(.+?)',|.+?:\d+:\d+:\n(.+))", r"panicked at (?:'.+?',\s*)?(.+?):(\d+):(\d+)"),
    "dart": (r"(?m)^Unhandled exception:\n(.+)$", r"\((?:file://)?([^()\s]+):(\d+):\d+\)"),
    "elixir": (r"\*\* \(([\w.]+)\)", r"(?m)^\s+(?:\([^)]*\) )?(\S+\.exs?):(\d+):"),
}
PANIC_TYPES = (("nil pointer", "nil-pointer"), ("index out of", "index-out-of-range"), ("divide by zero", "division-by-zero"), ("unwrap", "unwrap-none"), ("overflow", "overflow"))


def panics(outputs: DataFrame, kind: Column) -> DataFrame:
    """FX34: (id, language, message, type, file, line) of crashes in error outputs (id, text); every language that matches counts."""
    rows = None
    for lang, (said, place) in PANICS.items():
        message = F.coalesce(F.nullif(F.regexp_extract("text", said, 1), F.lit("")), F.nullif(F.regexp_extract("text", said, 2), F.lit(""))) if said.count("(") - said.count("(?") > 1 and "|" in said else F.nullif(F.regexp_extract("text", said, 1), F.lit(""))
        one = outputs.select("id", F.lit(lang).alias("language"), F.trim(message).alias("message"), F.nullif(F.regexp_extract("text", place, 1), F.lit("")).alias("file"), F.regexp_extract("text", place, 2).try_cast("int").alias("line"))
        if lang == "go":
            one = outputs.where(F.col("text").rlike(r"goroutine\s+\d+\s+\[running\]:")).select("id", F.lit(lang).alias("language"), F.trim(F.coalesce(message, F.lit("unknown panic"))).alias("message"), F.nullif(F.regexp_extract("text", place, 1), F.lit("")).alias("file"), F.regexp_extract("text", place, 2).try_cast("int").alias("line"))
        one = one.where("message is not null")
        rows = one if rows is None else rows.unionByName(one)
    return rows.withColumn("type", kind)


def matched_symbols(rows: DataFrame) -> DataFrame:
    """FX21: symbols from an external matcher's rows (path, line, end, name, kind, ord, module), each place once, by the first pattern."""
    order = F.struct("ord", "kind", "end")
    kept = rows.groupBy("path", "line", "name", "module").agg(F.min(order).alias("o"))
    return kept.select(F.concat_ws(".", "module", "name").alias("qual"), F.col("o.kind").alias("kind"), "module", "name", F.col("path").alias("file"), "line", F.col("o.end").alias("end"))


def matched_facts(rows: DataFrame) -> DataFrame:
    """FX20: code facts from an external matcher's rows (path, fact, name, line, end, text)."""
    return rows.select("path", "fact", "name", "line", "end", "text").dropDuplicates(["path", "fact", "line", "text"])


ship(__name__)
