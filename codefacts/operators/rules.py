"""Boundary rules: parsing, violations, coverage of the law, gate and ladder (RB1 to RB13, SC34, SC37, WN8)."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codefacts.functions.scalars import is_test_module, under


@dataclass
class Rules:
    """A parsed rules file: each list in file order."""

    forbidden: list[tuple[str, str]] = field(default_factory=list)
    surfaces: list[tuple[str, list[str]]] = field(default_factory=list)
    declared: list[tuple[str, str]] = field(default_factory=list)
    malformed: list[str] = field(default_factory=list)

    def promises(self) -> bool:
        """SC37: whether the file protects anything."""
        return bool(self.forbidden or self.surfaces)


def logical_lines(text: str) -> list[str]:
    """WN8: lines without comments; one that ends with a comma goes on in the next."""
    out, held = [], ""
    for raw in text.splitlines():
        held = f"{held} {raw.partition('#')[0].strip()}".strip()
        if held.endswith(","):
            continue
        if held:
            out.append(held)
        held = ""
    return out + [held] * bool(held)


NAME = re.compile(r"[\w./*-]+")


def parse(text: str) -> Rules:
    """RB1: ``A -/-> B``, ``A => B``, ``M :: a, b`` and ``GROUP = a, b``; groups hold from where they stand, on both sides."""
    rules, groups = Rules(), {}

    def names(part: str) -> list[str] | None:
        found = [x.strip() for x in part.split(",") if x.strip()]
        if not found or not all(NAME.fullmatch(x) for x in found):
            return None
        return [m for x in found for m in groups.get(x, [x])]

    for line in logical_lines(text):
        if "=>" in line and "::" not in line:
            sort, (a, _, b) = "declared", line.partition("=>")
        elif "=" in line and "-/->" not in line and "::" not in line:
            sort, (a, _, b) = "group", line.partition("=")
        elif "::" in line:
            sort, (a, _, b) = "surface", line.partition("::")
        elif "-/->" in line:
            sort, (a, _, b) = "forbidden", line.partition("-/->")
        else:
            sort, a, b = "", "", ""
        left, right = names(a), names(b)
        if not sort or not left or not right or (sort == "group" and len(left) != 1):
            rules.malformed.append(line)
        elif sort == "group":
            groups[a.strip()] = right
        elif sort == "surface":
            rules.surfaces += [(m, right) for m in left]
        else:
            into = rules.declared if sort == "declared" else rules.forbidden
            into += [(x, y) for x in left for y in right if x != y]
    return rules


def rule_table(spark: SparkSession, pairs: list[tuple[str, str]]) -> DataFrame:
    """(rule_ord, src_pat, dst_pat)."""
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "rule_ord int, src_pat string, dst_pat string")


def surface_table(spark: SparkSession, surfaces: list[tuple[str, list[str]]]) -> DataFrame:
    """(rule_ord, pattern, public)."""
    return spark.createDataFrame([(i, m, p) for i, (m, p) in enumerate(surfaces)], "rule_ord int, pattern string, public array<string>")


def prefixes(module: Column) -> Column:
    """A dotted name and everything it lies below: its prefixes at dots."""
    parts = F.split(module, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "."))


def _joined(edges: DataFrame, rules: DataFrame, src: str, dst: str) -> DataFrame:
    """Edges with every rule they break: equi joins over the ends' prefixes instead of a loop over all rules."""
    wide = edges.withColumn("_ps", F.explode(prefixes(F.col(src)))).join(rules, F.col("_ps") == F.col("src_pat"))
    return wide.where(under(dst, F.col("dst_pat")))


def violations(edges: DataFrame, rules: DataFrame) -> DataFrame:
    """RB3: (src, dst, src_pat, dst_pat): edges that a rule forbids, each once, by the first rule of the file."""
    hit = _joined(edges.select("src", "dst").distinct(), rules, "src", "dst")
    order = Window.partitionBy("src", "dst").orderBy("rule_ord")
    return hit.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("src", "dst", "src_pat", "dst_pat")


def call_violations(calls: DataFrame, rules: DataFrame, modules: DataFrame) -> DataFrame:
    """RB4: (caller_module, callee_module, caller, callee, src_pat, dst_pat): calls across modules that a rule forbids; the first rule counts."""
    m = modules.select("qual", "module")
    rows = calls.select(F.col("src").alias("caller"), F.col("dst").alias("callee")).distinct()
    rows = rows.join(m.withColumnsRenamed({"qual": "caller", "module": "caller_module"}), "caller").join(m.withColumnsRenamed({"qual": "callee", "module": "callee_module"}), "callee").where("caller_module != callee_module")
    hit = _joined(rows, rules, "caller_module", "callee_module")
    order = Window.partitionBy("caller_module", "callee_module", "caller", "callee").orderBy("rule_ord")
    return hit.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("caller_module", "callee_module", "caller", "callee", "src_pat", "dst_pat")


def surface_violations(calls: DataFrame, surfaces: DataFrame, modules: DataFrame) -> DataFrame:
    """RB5: (caller, callee, pattern): calls from outside to a name that the surface does not list; an unknown caller is outside; every surface counts."""
    m = modules.select("qual", "module")
    rows = calls.select(F.col("src").alias("caller"), F.col("dst").alias("callee"))
    rows = rows.join(m.withColumnsRenamed({"qual": "callee", "module": "callee_module"}), "callee").join(m.withColumnsRenamed({"qual": "caller", "module": "caller_module"}), "caller", "left")
    wide = rows.withColumn("_p", F.explode(prefixes(F.col("callee_module")))).join(surfaces, F.col("_p") == F.col("pattern"))
    inside = F.coalesce(under("caller_module", F.col("pattern")), F.lit(False))
    name = F.element_at(F.split("callee", r"\."), -1)
    return wide.where(~inside & ~F.array_contains("public", name)).select("caller", "callee", "pattern")


def _matched(nodes: DataFrame, patterns: DataFrame, column: str) -> DataFrame:
    """Patterns of a column that some module lies under."""
    every = nodes.select(F.explode(prefixes(F.col("module"))).alias(column)).distinct()
    return patterns.select(column).distinct().join(every, column, "left_semi").withColumn(f"{column}_ok", F.lit(True))


def unmatched(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """RB6: (rule_ord, src_pat, dst_pat, src_matches, dst_matches) of rules with a side that no module matches."""
    found = rules.join(_matched(nodes, rules, "src_pat"), "src_pat", "left").join(_matched(nodes, rules, "dst_pat"), "dst_pat", "left")
    ok = lambda c: F.coalesce(F.col(c), F.lit(False))
    return found.select("rule_ord", "src_pat", "dst_pat", ok("src_pat_ok").alias("src_matches"), ok("dst_pat_ok").alias("dst_matches")).where("not (src_matches and dst_matches)")


def without_rule(nodes: DataFrame, patterns: DataFrame) -> DataFrame:
    """RB7: modules that no pattern mentions, tests exempt."""
    wide = nodes.select("module", F.explode(prefixes(F.col("module"))).alias("pattern"))
    covered = wide.join(patterns.select("pattern").distinct(), "pattern", "left_semi").select("module").distinct()
    return nodes.select("module").distinct().join(covered, "module", "left_anti").where(~is_test_module("module"))


def all_patterns(rules: DataFrame, surfaces: DataFrame | None = None) -> DataFrame:
    out = rules.select(F.col("src_pat").alias("pattern")).unionByName(rules.select(F.col("dst_pat").alias("pattern")))
    return out.unionByName(surfaces.select("pattern")) if surfaces is not None else out


def candidates(degrees: DataFrame, edges: DataFrame, known: DataFrame | None = None, core: float = 0.25, edge: float = 0.75, least: int = 4) -> DataFrame:
    """RB9: (src, dst, declared): rules that already hold, from what all import to what none does; a proposal, never a verdict.

    Both groups are the extremes of one module graph, and their product is the
    answer itself.
    """
    enough = degrees.agg(F.count("*").alias("n")).where(F.col("n") >= least)
    share = F.col("fan_out") / (F.col("fan_in") + F.col("fan_out"))
    rows = degrees.where("fan_in + fan_out > 0").select("node", share.alias("share"))
    low, high = rows.where(F.col("share") <= core).select(F.col("node").alias("src")), rows.where(F.col("share") >= edge).select(F.col("node").alias("dst"))
    pairs = low.join(high, F.col("src") != F.col("dst")).join(edges.select("src", "dst"), ["src", "dst"], "left_anti").join(enough, how="cross").drop("n")
    if known is None:
        return pairs.withColumn("declared", F.lit(False))
    k = known.select(F.col("src_pat").alias("src"), F.col("dst_pat").alias("dst")).distinct().withColumn("declared", F.lit(True))
    return pairs.join(k, ["src", "dst"], "left").select("src", "dst", F.coalesce("declared", F.lit(False)).alias("declared"))


def ungoverned(new_edges: DataFrame, patterns: DataFrame) -> DataFrame:
    """RB10: new edges of which neither end is mentioned by a rule, from code that is no test."""
    p = patterns.select("pattern").distinct()
    ends = new_edges.select("src", "dst", F.explode(F.array_union(prefixes(F.col("src")), prefixes(F.col("dst")))).alias("pattern"))
    return new_edges.join(ends.join(p, "pattern", "left_semi").select("src", "dst").distinct(), ["src", "dst"], "left_anti").where(~is_test_module("src"))


def gate_code(broken: Column, uncheckable: Column, new_cycles: Column, violations_: Column, calls: Column, surfaces: Column) -> Column:
    """RB11: 2 for unusable rules, 3 if nothing could be checked, 1 for a fact, else 0."""
    return F.when(broken, 2).when(uncheckable, 3).when((new_cycles > 0) | (violations_ > 0) | (calls > 0) | (surfaces > 0), 1).otherwise(0)


def uncheckable(malformed: Column, unmatched_: Column, elsewhere: Column, errors: Column) -> Column:
    """RB12: reasons for which no violations do not mean that all is well."""
    reason = lambda n, text: F.when(n > 0, F.concat(n.cast("string"), F.lit(text)))
    return F.array_compact(F.array(reason(malformed, " lineas mal escritas"), reason(unmatched_, " reglas sin modulo"), reason(elsewhere, " ficheros de reglas fuera"), reason(errors, " ficheros ilegibles")))


def ladder(green: Column, cycles: Column, borders: Column, calls: Column, surfaces: Column, orphans: Column, law: Column, lawless: Column, modules: Column, done: Column) -> Column:
    """RB13: a demonstrated failure first, then what could not be checked, then whether the task is done.

    ``green`` and ``done`` are booleans, null for unknown; the others count.
    """
    return (
        F.when(green.eqNullSafe(False), "rechazar")
        .when((cycles > 0) | (borders > 0) | (calls > 0) | (surfaces > 0) | (orphans > 0), "rechazar")
        .when(law > 0, "escalar")
        .when(green.isNull(), "escalar")
        .when((lawless > 0) | (modules == 0), "escalar")
        .when(done.eqNullSafe(True), "aceptar")
        .when(done.eqNullSafe(False), "rechazar")
        .otherwise("sin-objeciones")
    )


def same_rejection(runs: DataFrame, task: str = "task", order: str = "ord") -> DataFrame:
    """CH26: runs rejected for the reason of the run before."""
    before = F.lag("reason").over(Window.partitionBy(task).orderBy(order))
    return runs.withColumn("repeated", F.coalesce((F.col("verdict") == "rechazar") & (F.col("reason") == before), F.lit(False)))
