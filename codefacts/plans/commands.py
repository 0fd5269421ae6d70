"""Commands over a source tree and its history: what each one answers, as tables and an exit code.

Exit codes: 0 all well, 1 a fact is against it, 2 wrong use, 3 could not be checked.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codefacts.operators import changes, extract, graph, impact, resolve, rules, sets
from codefacts.session import cut
from codefacts.sources import files as sources
from codefacts.sources import git


@dataclass
class Report:
    """Tables by name, with the exit code and why."""

    tables: dict[str, DataFrame] = field(default_factory=dict)
    code: int = 0
    reasons: list[str] = field(default_factory=list)


def tree_files(spark: SparkSession, root: str) -> DataFrame:
    """SC1: this project's own sources: hidden, skipped and nested folders left out."""
    own, _ = sources.without_nested(sources.visible(sources.tree(spark, root)))
    return sources.source_files(own)


def files_at(spark: SparkSession, repo: str, ref: str) -> DataFrame:
    """SC5, SC6: the same from a commit."""
    own, _ = sources.without_nested(sources.visible(git.read(spark, repo, "blobs", ref=ref)))
    return sources.source_files(own, ref=ref)


@dataclass
class Analysis:
    facts: DataFrame
    symbols: DataFrame
    edges: DataFrame
    unresolved: DataFrame
    named: DataFrame
    modules: DataFrame
    imports: DataFrame


def analyse(files: DataFrame) -> Analysis:
    """GR8, FX25: facts once, then everything that follows from them by joins."""
    facts = cut(extract.facts(files))
    edges, unresolved, named = extract.symbol_graph(facts)
    symbols = extract.symbols(facts)
    modules = symbols.where("kind = 'module'").select("module")
    return Analysis(facts, symbols, cut(edges), unresolved, named, modules, cut(resolve.module_graph(extract.raw_imports(facts), modules)))


def graph_report(spark: SparkSession, now: DataFrame, before: DataFrame | None = None, law: str | None = None) -> Report:
    """``graph``: coupling, cycles and boundaries, and what is new against a baseline; declared edges count on both sides."""
    a = analyse(now)
    parsed = rules.parse(law or "")
    declared = spark.createDataFrame(parsed.declared, "src string, dst string")
    edges = graph.declared(a.imports, declared)
    nodes = a.modules.select(F.col("module").alias("node")).unionByName(declared.select(F.explode(F.array("src", "dst")).alias("node"))).distinct()
    scc = cut(graph.components(edges))
    table, surfaces = rules.rule_table(spark, parsed.forbidden), rules.surface_table(spark, parsed.surfaces)
    calls = a.edges.where("etype = 'CALLS'")
    mods = a.symbols.select("qual", "module")
    named = nodes.withColumnRenamed("node", "module")
    out = Report(
        {
            "degrees": graph.degrees(nodes, edges),
            "cycles": graph.cycles(scc),
            "violations": rules.violations(edges, table),
            "call_violations": rules.call_violations(calls, table, mods),
            "surface_violations": rules.surface_violations(calls, surfaces, mods),
            "unmatched": rules.unmatched(named, table),
            "without_rule": rules.without_rule(named, rules.all_patterns(table, surfaces)),
            "candidates": rules.candidates(graph.degrees(nodes, edges), edges, table),
            "abstract_once": extract.classes(a.facts).transform(resolve.abstract_once),
            "errors": extract.errors(a.facts),
        }
    )
    if before is not None:
        b = analyse(before)
        old = graph.declared(b.imports, declared)
        was = graph.components(old)
        out.tables |= {
            "new_cycles": graph.new_cycles(scc, was),
            "new_violations": sets.kept_out(out.tables["violations"], rules.violations(old, table), ["src", "dst"]),
            "ungoverned": rules.ungoverned(sets.kept_out(edges, old, ["src", "dst"]), rules.all_patterns(table, surfaces)),
        }
    some = lambda name: name in out.tables and bool(out.tables[name].limit(1).count())
    bad = [n for n in ("new_cycles" if before is not None else "cycles", "violations", "call_violations", "surface_violations") if some(n)]
    if parsed.malformed:
        out.code, out.reasons = 2, parsed.malformed
    elif some("errors"):
        out.code, out.reasons = 3, ["hay ficheros ilegibles"]
    elif bad:
        out.code, out.reasons = 1, bad
    return out


def calls_report(a: Analysis, name: str, depth: int = 2) -> Report:
    """``calls``: who calls a symbol and what it calls; similar names if there is none."""
    found = graph.lookup(a.symbols, name)
    if not found.limit(1).count():
        return Report({"similar": graph.similar(a.symbols, name)}, 1, ["no existe"])
    origin, calls = found.select(F.col("qual").alias("node")), a.edges.where("etype = 'CALLS'")
    return Report({"symbols": found, "callers": graph.callers(calls, origin, depth), "callees": graph.callees(calls, origin, depth), "split": graph.caller_split(calls.join(origin, F.col("dst") == F.col("node"), "left_semi"))})


def dead_report(a: Analysis, files: DataFrame | None = None) -> Report:
    """``dead``: symbols without callers, or called by tests only, and modules that nothing imports or uses; with ``files``, entry points are exempt."""
    nodes = a.symbols.select("qual", "kind", "module", "file", "line", "test")
    dead = cut(graph.dead_symbols(nodes, a.edges, a.named))
    entries = graph.entry_points(files).select(F.col("path").alias("file")) if files is not None else nodes.select("file").limit(0)
    orphans = cut(graph.orphan_modules(nodes, a.edges, a.imports, entries))
    return Report({"dead": dead, "orphans": orphans, "total": graph.dead_total(dead, orphans)})


def tests_report(spark: SparkSession, repo: str, files: DataFrame, range_: str | None = None) -> impact.Selection:
    """``tests``: which test files a change can reach."""
    a = analyse(files)
    diff = git.read(spark, repo, "diff", **({"range": range_} if range_ else {}))
    return impact.select_tests(a.symbols, a.edges, a.named, files.select("path", "text"), changes.hunks(diff), broken_imports=extract.broken_imports(a.facts).limit(1).count())


def check_report(spark: SparkSession, repo: str, range_: str) -> Report:
    """``check``: signals of weakened tests and the wave of what was touched; informs, never fails."""
    diff = git.read(spark, repo, "diff", range=range_)
    a = analyse(files_at(spark, repo, range_.split("..")[-1] or "HEAD"))
    hunks = changes.hunks(diff)
    before = extract.symbols(extract.facts(files_at(spark, repo, range_.split("..")[0])))
    touched = impact.touched(a.symbols, hunks)
    return Report(
        {
            "signals": changes.test_signals(changes.test_lines(diff)),
            "wave": impact.wave(a.symbols, a.edges, hunks),
            "stale_signatures": changes.stale_signatures(a.symbols, before, a.edges.where("etype = 'CALLS'"), touched),
            "untracked": git.read(spark, repo, "untracked").where(F.col("path").endswith(".py")),
        }
    )


def delta_report(now: DataFrame, before: DataFrame) -> Report:
    """``delta``: classic errors that a change added; informs, never fails."""
    return Report({"added": changes.fact_delta(extract.code_facts(extract.facts(now)), extract.code_facts(extract.facts(before)))})
