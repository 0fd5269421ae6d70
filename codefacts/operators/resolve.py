"""Names to what they stand for, as joins; whatever cannot be resolved is counted with its reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codefacts.functions.scalars import context_symbol
from codefacts.operators.rules import prefixes


def to_internal(targets: DataFrame, modules: DataFrame, target: str = "target") -> DataFrame:
    """FX3: each target with ``module``, the longest prefix that is a module, or null."""
    asked = targets.select(target).distinct().select(target, F.posexplode(prefixes(F.col(target))).alias("n", "module"))
    best = asked.join(modules.select("module").distinct(), "module").groupBy(target).agg(F.max_by("module", "n").alias("module"))
    return targets.join(best, target, "left")


def module_graph(raw: DataFrame, modules: DataFrame) -> DataFrame:
    """FX4: distinct edges (src, dst) between modules from raw imports (module, target), none to itself."""
    found = to_internal(raw.select(F.col("module").alias("src"), "target"), modules)
    return found.where("module is not null and module != src").select("src", F.col("module").alias("dst")).distinct()


def bare_name(uses: DataFrame, functions: DataFrame, classes: DataFrame, aliases: DataFrame, symbols: DataFrame) -> DataFrame:
    """FX12: ``uses`` (module, name, ...) with ``qual``: own function, else own class, else what was imported if it is a symbol."""
    f, c = (t.select("module", "name", F.col("qual").alias(k)) for t, k in ((functions, "_f"), (classes, "_c")))
    i = aliases.join(symbols.select(F.col("qual").alias("target")), "target", "left_semi").select("module", F.col("alias").alias("name"), F.col("target").alias("_i"))
    return uses.join(f, ["module", "name"], "left").join(c, ["module", "name"], "left").join(i, ["module", "name"], "left").withColumn("qual", F.coalesce("_f", "_c", "_i")).drop("_f", "_c", "_i")


def reexport(asked: DataFrame, aliases: DataFrame, symbols: DataFrame, hops: int = 4) -> DataFrame:
    """FX13: (module, attr, qual): follow imports of an attribute from module to module, ``hops`` at most; a name met twice ends it."""
    table = aliases.select(F.col("module").alias("_m"), F.col("alias").alias("_a"), F.col("target").alias("_t"))
    known = symbols.select(F.col("qual").alias("_t")).distinct().withColumn("_known", F.lit(True))
    now = asked.select("module", "attr", F.col("module").alias("at"), F.col("attr").alias("name"), F.lit(None).cast("string").alias("qual"), F.array().cast("array<string>").alias("seen"))
    for _ in range(hops):
        step = now.join(table, (F.col("at") == F.col("_m")) & (F.col("name") == F.col("_a")) & F.col("qual").isNull(), "left").join(known, "_t", "left")
        again = F.array_contains("seen", F.col("_t"))
        now = step.select(
            "module",
            "attr",
            F.when(F.col("_t").isNotNull() & ~again, F.regexp_extract("_t", r"^(.*)\.[^.]*$", 1)).alias("at"),
            F.element_at(F.split("_t", r"\."), -1).alias("name"),
            F.coalesce("qual", F.when(F.col("_known") & ~F.coalesce(again, F.lit(False)), F.col("_t"))).alias("qual"),
            F.when(F.col("_t").isNotNull(), F.array_append("seen", F.col("_t"))).otherwise(F.col("seen")).alias("seen"),
        )
    return now.select("module", "attr", "qual")


def unique(asked: DataFrame, table: DataFrame, key: str, value: str) -> DataFrame:
    """FX22, FX23: each key's value where exactly one row has it, else null and the reason."""
    n = table.groupBy(key).agg(F.count_distinct(value).alias("_n"), F.min(value).alias("_v"))
    found = asked.join(n, key, "left")
    reason = F.when(F.col("_n").isNull(), "nombre-desconocido").when(F.col("_n") > 1, "nombre-ambiguo")
    return found.withColumn("reason", reason).withColumn(value, F.when(F.col("_n") == 1, F.col("_v"))).drop("_n", "_v")


def packages(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """FX22: ``imports`` (src, spec) to modules by the shortest unique suffix of the specifier, then ignoring case."""
    parts = F.split(F.regexp_replace("spec", r"[/\\:]+", "."), r"\.")
    asked = imports.select("src", "spec").distinct().withColumn("p", F.filter(parts, lambda x: x != ""))
    asked = asked.select("src", "spec", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda k: F.array_join(F.slice("p", F.size("p") - k + 1, k), "."))).alias("k", "tail"))
    ends = F.split("module", r"\.")
    tails = modules.select("module", F.explode(F.transform(F.sequence(F.lit(1), F.size(ends)), lambda k: F.array_join(F.slice(ends, F.size(ends) - k + 1, k), "."))).alias("tail"))

    def once(key: Column) -> DataFrame:
        return tails.groupBy(key.alias("tail")).agg(F.count_distinct("module").alias("n"), F.min("module").alias("module")).where("n = 1")

    exact = asked.join(once(F.col("tail")).drop("n"), "tail").withColumn("stage", F.lit(0))
    folded = asked.withColumn("tail", F.lower("tail")).join(once(F.lower("tail")).drop("n"), "tail").withColumn("stage", F.lit(1))
    order = Window.partitionBy("src", "spec").orderBy("stage", "k", "module")
    found = exact.unionByName(folded).withColumn("r", F.row_number().over(order)).where("r = 1")
    return found.select("src", F.col("module").alias("dst"), "spec").where("src != dst")


def qualified_calls(calls: DataFrame, symbols: DataFrame) -> DataFrame:
    """FX23: calls (body, called) by the last two parts of the name: unique in its module, else ambiguous."""
    two = F.split("called", r"\.")
    asked = calls.withColumn("name", F.element_at(two, -1)).withColumn("tail", F.when(F.size(two) > 1, F.element_at(two, -2)))
    table = symbols.select("name", F.element_at(F.split("module", r"\."), -1).alias("tail"), "qual")
    n = table.groupBy("name", "tail").agg(F.count_distinct("qual").alias("n"), F.min("qual").alias("qual"))
    return asked.join(n, ["name", "tail"], "left").select("body", "called", F.when(F.col("n") == 1, F.col("qual")).alias("dst"), F.when(F.col("n") > 1, "nombre-ambiguo").when(F.col("n").isNull(), "nombre-desconocido").alias("reason"))


def resolve_calls(calls: DataFrame, functions: DataFrame, classes: DataFrame, methods: DataFrame, aliases: DataFrame, symbols: DataFrame, modules: DataFrame, builtins: list[str]) -> DataFrame:
    """FX14: calls (module, body, cls, form, base, attr) with ``dst`` or ``reason``.

    ``form`` is ``name`` (``attr`` called), ``attr`` (``base.attr``) or ``dynamic``.
    Strategies are joins in order of priority: own function, own class, import;
    for attributes the own class's method, a member of an imported module, a
    class's method, and re-exports.
    """
    named = bare_name(calls.where("form = 'name'").withColumn("name", F.col("attr")), functions, classes, aliases, symbols)
    named = named.select("module", "body", F.col("qual").alias("dst"), F.when(F.col("qual").isNull(), F.when(F.col("attr").isin(builtins), "builtin").otherwise("nombre-desconocido")).alias("reason"))
    dotted = calls.where("form = 'attr'")
    own = methods.select(F.col("module").alias("_m"), F.col("owner").alias("_o"), F.col("name").alias("_n"), F.col("qual").alias("_own"))
    rows = dotted.join(own, F.col("base").isin("self", "cls") & (F.col("module") == F.col("_m")) & (F.col("cls") == F.col("_o")) & (F.col("attr") == F.col("_n")), "left").drop("_m", "_o", "_n")
    into = aliases.select(F.col("module").alias("_m"), F.col("alias").alias("_a"), F.col("target").alias("_t"))
    rows = rows.join(into, (F.col("module") == F.col("_m")) & (F.col("base") == F.col("_a")), "left").drop("_m", "_a")
    local = classes.select(F.col("module").alias("_m"), F.col("name").alias("_n"), F.col("qual").alias("_class"))
    rows = rows.join(local, (F.col("module") == F.col("_m")) & (F.col("base") == F.col("_n")), "left").drop("_m", "_n")
    rows = rows.withColumn("_q", F.concat_ws(".", F.coalesce("_class", "_t"), "attr"))
    rows = rows.join(symbols.select(F.col("qual").alias("_q"), F.lit(True).alias("_sure")), "_q", "left")
    through = rows.where("_own is null and _sure is null and _t is not null").select(F.col("_t").alias("module"), "attr").distinct().join(modules.select("module"), "module", "left_semi")
    over = reexport(through, aliases, symbols).where("qual is not null").select(F.col("module").alias("_t"), "attr", F.col("qual").alias("_over"))
    rows = rows.join(over, ["_t", "attr"], "left")
    dst = F.coalesce("_own", F.when(F.col("_sure"), F.col("_q")), "_over")
    attr = rows.select("module", "body", dst.alias("dst"), F.when(dst.isNull(), "atributo-de-variable").alias("reason"))
    dynamic = calls.where("form = 'dynamic'").select("module", "body", F.lit(None).cast("string").alias("dst"), F.lit("expresion-dinamica").alias("reason"))
    return named.unionByName(attr).unionByName(dynamic)


def coverage(edges: DataFrame, unresolved: DataFrame) -> DataFrame:
    """FX17: (resolved, unresolved, share); built-ins are nobody's edge and count on neither side."""
    a = edges.where("etype = 'CALLS'").agg(F.count("*").alias("resolved"))
    b = unresolved.where("reason != 'builtin'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("unresolved"))
    return a.join(b).withColumn("share", F.when(F.col("resolved") + F.col("unresolved") > 0, F.round(F.col("resolved") / (F.col("resolved") + F.col("unresolved")), 6)))


def _renamed(rows: DataFrame, columns: list[str], names: DataFrame, ext: str) -> DataFrame:
    """Columns whose value is among ``names`` (n), with the extension behind."""
    for c in columns:
        rows = rows.join(names.select(F.col("n").alias(c), F.lit(True).alias("_k")), c, "left").withColumn(c, F.when(F.col("_k"), F.concat_ws(":", F.col(c), F.lit(ext))).otherwise(F.col(c))).drop("_k")
    return rows


def merge_engines(base: DataFrame, other: DataFrame, ext: str = "ext") -> DataFrame:
    """FX28: module edges of two engines; a name of the second that the first has too gets its extension."""
    names = base.select(F.col("src").alias("n")).unionByName(base.select(F.col("dst").alias("n"))).distinct()
    return base.select("src", "dst").unionByName(_renamed(other, ["src", "dst"], names, ext).select("src", "dst")).distinct()


def merge_reports(nodes: DataFrame, edges: DataFrame, counters: DataFrame, nodes2: DataFrame, edges2: DataFrame, counters2: DataFrame, ext: str = "ext") -> tuple[DataFrame, DataFrame, DataFrame]:
    """FX29: symbol reports of two engines: (nodes qual, kind, module; edges src, dst, etype; counters name, n).

    Names that both have get the second one's extension in the second; counters
    of the same name are summed.
    """
    names = nodes.select(F.col("qual").alias("n")).unionByName(nodes.select(F.col("module").alias("n"))).distinct()
    out_nodes = nodes.select("qual", "kind", "module").unionByName(_renamed(nodes2, ["qual", "module"], names, ext).select("qual", "kind", "module")).distinct()
    out_edges = edges.select("src", "dst", "etype").unionByName(_renamed(edges2, ["src", "dst"], names, ext).select("src", "dst", "etype")).distinct()
    return out_nodes, out_edges, counters.select("name", "n").unionByName(counters2.select("name", "n")).groupBy("name").agg(F.sum("n").alias("n"))


def import_graph(edges: DataFrame) -> DataFrame:
    """FX27: the module graph of a report that has imports only."""
    return edges.where("etype = 'IMPORTS'").select("src", "dst").distinct()


def engine(languages: DataFrame) -> str:
    """FX30: which reader a tree needs: ``python``, ``other``, ``both`` or ``none``."""
    has = languages.agg(F.max(F.col("lang") == "python").alias("p"), F.max(F.col("lang") != "python").alias("o")).first()
    return "both" if has.p and has.o else "python" if has.p else "other" if has.o else "none"


def known_modules(symbols: DataFrame, degrees: DataFrame) -> DataFrame:
    """XT42: modules of two reports, by symbol or by degree."""
    return symbols.where("kind = 'module'").select(F.col("qual").alias("module")).unionByName(degrees.select(F.col("node").alias("module"))).distinct()


def context_map(contexts: DataFrame, symbols: DataFrame) -> DataFrame:
    """XT38: coverage contexts (context) to the symbols with the same last two parts."""
    two = lambda c: F.array_join(F.slice(F.split(c, r"\."), F.greatest(F.size(F.split(c, r"\.")) - 1, F.lit(1)), 2), ".")
    return contexts.select("context", context_symbol("context").alias("k")).join(symbols.select("qual", two("qual").alias("k")), "k").select("context", "qual")


def patched(lines: DataFrame) -> DataFrame:
    """XT37: (path, target) of names that tests put a double for: the dotted string of ``patch`` and ``setattr``."""
    found = F.regexp_extract_all("line", F.lit(r"""(?:patch|setattr)\(\s*["']([A-Za-z_][\w.]*\.\w+)["']"""), F.lit(1))
    return lines.select("path", F.explode(found).alias("target")).distinct()


def abstract_once(classes: DataFrame) -> DataFrame:
    """FX18: abstract classes (name, qual, bases, abstract, protocol) with one subclass or none, protocols left out."""
    subs = classes.select("name", F.explode("bases").alias("base")).groupBy("base").agg(F.count_distinct("name").alias("n"))
    return classes.where("abstract and not protocol").join(subs, F.col("name") == F.col("base"), "left").select(classes["qual"], F.coalesce("n", F.lit(0)).cast("long").alias("implementations")).where("implementations <= 1").orderBy("qual")


def literal_links(lines: DataFrame, names: DataFrame) -> DataFrame:
    """FX31, FX32: (src, dst) once each: quoted pieces of a line, whole and word by word, whose last part is exactly one known file's name.

    ``lines``: src, line; ``names``: name (lower case), dst.
    """
    quoted = F.regexp_extract_all("line", F.lit("""["']([^"']{2,160})["']"""), F.lit(1))
    pieces = F.flatten(F.transform(quoted, lambda q: F.array_distinct(F.concat(F.array(q), F.filter(F.split(q, r"\s+"), lambda x: x != "")))))
    asked = lines.select("src", F.explode(pieces).alias("piece")).select("src", F.lower(F.regexp_extract("piece", r"([^/\\]*)$", 1)).alias("name")).where("name != ''").distinct()
    only = names.groupBy("name").agg(F.count_distinct("dst").alias("n"), F.min("dst").alias("dst")).where("n = 1")
    return asked.join(only, "name").where("src != dst").select("src", "dst").distinct()


def launchers(links: DataFrame) -> DataFrame:
    """FX33: files that start another."""
    return links.select(F.col("src").alias("node")).distinct().orderBy("node")
