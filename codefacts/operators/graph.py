"""Graph operators over edge tables (src, dst): one set-semantics traversal and what builds on it."""

from __future__ import annotations

from itertools import count
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codefacts.functions.scalars import is_test_file, is_test_symbol, jitter
from codefacts.session import cut, ship


class Reached(NamedTuple):
    """Rows (key, node, depth) and whether work was left when the depth ran out."""

    nodes: DataFrame
    truncated: bool


def normal(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) without nulls."""
    return edges.select("src", "dst").where("src is not null and dst is not null").distinct()


def declared(edges: DataFrame, extra: DataFrame) -> DataFrame:
    """GR5: declared edges join the parsed ones before anything is measured."""
    return normal(edges.select("src", "dst").unionByName(extra.select("src", "dst"))).where("src != dst")


def frontier(edges: DataFrame, seeds: DataFrame, max_depth: int | None, terminals: DataFrame | None = None, mark_seeds: bool = True, stop: DataFrame | None = None) -> Reached:
    """Level by level from keyed seeds (key, node): each node at the first level that reaches it.

    Nodes in ``terminals`` are reached but not gone on from.  With ``mark_seeds``
    a seed counts as seen and never comes back.  ``stop`` (key, node) ends the
    walk at the first hit.  Without ``max_depth`` it goes on until nothing new is
    reached.  Every level is one join, one anti join and one write; the frontier
    of all keys advances together.
    """
    edges = cut(normal(edges))
    ends = terminals.select(F.col(terminals.columns[0]).alias("node")).distinct() if terminals is not None else None
    front = seeds.select("key", "node").distinct()
    seen = front.select("key", "node", F.lit(0).alias("depth"))
    reached = None if mark_seeds else seen.limit(0)
    seen_all = seen if mark_seeds else seen.limit(0)
    left = True
    for depth in count(1) if max_depth is None else range(1, max_depth + 1):
        step = front.join(edges, F.col("node") == F.col("src")).select("key", F.col("dst").alias("node")).distinct()
        new = cut(step.join(seen_all, ["key", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if not new.limit(1).count():
            left = False
            break
        seen_all = seen_all.unionByName(new)
        reached = new if reached is None else reached.unionByName(new)
        if stop is not None and new.join(stop, ["key", "node"], "left_semi").limit(1).count():
            break
        front = (new.join(ends, "node", "left_anti") if ends is not None else new).select("key", "node")
    if left and stop is None:
        left = bool(front.join(edges, F.col("node") == F.col("src")).select("key", F.col("dst").alias("node")).join(seen_all, ["key", "node"], "left_anti").limit(1).count())
    if reached is None:
        reached = seen.limit(0)
    return Reached(reached, left)


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def callers(edges: DataFrame, origin: DataFrame, depth: int = 3) -> DataFrame:
    """GR9: who reaches each origin (node) within so many calls; the origin itself is left out."""
    return frontier(reversed_edges(edges), origin.select(F.col("node").alias("key"), "node"), depth).nodes


def callees(edges: DataFrame, origin: DataFrame, depth: int = 3) -> DataFrame:
    """GR9 the other way."""
    return frontier(edges, origin.select(F.col("node").alias("key"), "node"), depth).nodes


def call_index(edges: DataFrame) -> DataFrame:
    """GR11: (node, callers, callees) as sorted arrays; for looking up, not for joining."""
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.array_sort(F.collect_set("src")).alias("callers"))
    out = edges.groupBy(F.col("src").alias("node")).agg(F.array_sort(F.collect_set("dst")).alias("callees"))
    return into.join(out, "node", "full_outer")


def lookup(symbols: DataFrame, name: str) -> DataFrame:
    """GR10: the symbol of that name, else all that end with it after a dot."""
    exact = symbols.where(F.col("qual") == name)
    return exact if exact.limit(1).count() else symbols.where(F.col("qual").endswith("." + name))


def unique_anchor(symbols: DataFrame, name: str) -> tuple[str | None, str]:
    """XT31: the one symbol that a name stands for, or why there is none."""
    found = [r[0] for r in lookup(symbols, name).select("qual").orderBy("qual").limit(6).collect()]
    if len(found) == 1:
        return found[0], ""
    return None, "no existe" if not found else "ambiguo: " + ", ".join(found)


def similar(symbols: DataFrame, name: str, limit: int = 5) -> DataFrame:
    """GR31: names that contain it."""
    return symbols.where(F.lower("qual").contains(name.lower())).select("qual").orderBy("qual").limit(limit)


def reaches(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> bool:
    """GR21: whether any source (node) reaches any target (node), however far."""
    seeds = sources.select(F.lit(0).alias("key"), "node")
    goal = targets.select(F.lit(0).alias("key"), "node")
    return bool(frontier(edges, seeds, None, mark_seeds=False, stop=goal).nodes.join(goal, ["key", "node"], "left_semi").limit(1).count())


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GR6: (node, fan_in, fan_out) of every node, zeros included."""
    into, out = edges.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in")), edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return nodes.select("node").distinct().join(into, "node", "left").join(out, "node", "left").select("node", zero("fan_in"), zero("fan_out"))


def degree(edges: DataFrame) -> DataFrame:
    """GR23: (node, degree), both directions together."""
    return edges.select(F.col("src").alias("node")).unionAll(edges.select(F.col("dst").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))


def top(table: DataFrame, value: str, name: str, limit: int = 5) -> DataFrame:
    """TK1: the highest values, ties by name; zeros are dropped after the cut."""
    return table.orderBy(F.desc(value), name).limit(limit).where(F.col(value) > 0)


def trimmed(edges: DataFrame, rounds: int = 1000) -> DataFrame:
    """Edges that can lie on a cycle: nodes without a way in or out go, until all have both."""
    now = cut(normal(edges))
    before = now.count()
    for _ in range(rounds):
        sources, targets = now.select(F.col("src").alias("n")).distinct(), now.select(F.col("dst").alias("n")).distinct()
        both = sources.join(targets, "n", "left_semi")
        now = cut(now.join(both, F.col("src") == F.col("n"), "left_semi").join(both, F.col("dst") == F.col("n"), "left_semi"))
        after = now.count()
        if after == before:
            break
        before = after
    return now


def _least_reaching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): the smallest node of ``nodes`` that reaches each, itself included."""
    labels = cut(nodes.select("node", F.col("node").alias("label")))
    while True:
        offered = labels.join(edges, F.col("node") == F.col("src")).groupBy(F.col("dst").alias("n")).agg(F.min("label").alias("offer"))
        better = labels.join(offered, F.col("node") == F.col("n"), "left").select("node", F.least("label", F.coalesce("offer", "label")).alias("label"), (F.col("offer") < F.col("label")).alias("moved"))
        better = cut(better)
        if not better.where("moved").limit(1).count():
            return better.select("node", "label")
        labels = better.select("node", "label")


#: A graph of at most so many edges, by count, is settled inside one task.
LOCAL = 500_000


def _settled(batches):
    """Strongly connected components of the edges in one task, by two depth-first walks kept on explicit stacks."""
    import pandas as pd

    forth: dict = {}
    back: dict = {}
    for pdf in batches:
        for a, b in zip(pdf["src"].tolist(), pdf["dst"].tolist()):
            forth.setdefault(a, []).append(b)
            back.setdefault(b, []).append(a)
    order, seen = [], set()
    for start in forth:
        if start in seen:
            continue
        seen.add(start)
        stack = [(start, iter(forth[start]))]
        while stack:
            node, ways = stack[-1]
            step = next((x for x in ways if x not in seen), None)
            if step is None:
                order.append(node)
                stack.pop()
            else:
                seen.add(step)
                stack.append((step, iter(forth.get(step, ()))))
    nodes, names, done = [], [], set()
    for start in reversed(order):
        if start in done:
            continue
        done.add(start)
        group, todo = [start], [start]
        while todo:
            for x in back.get(todo.pop(), ()):
                if x not in done:
                    done.add(x)
                    group.append(x)
                    todo.append(x)
        if len(group) > 1 or start in forth.get(start, ()):
            nodes += group
            names += [min(group)] * len(group)
    if nodes:
        yield pd.DataFrame({"node": nodes, "scc": names})


def components(edges: DataFrame, local: int = LOCAL) -> DataFrame:
    """(node, scc): strongly connected components with more than one node or a loop, named by their smallest node.

    Up to ``local`` edges, counted first, one task settles the graph.  Beyond it,
    colouring: the smallest label flows forward; among nodes of one colour, those
    that reach its root backwards are the root's component and leave.  Each
    round settles at least one component of every colour.
    """
    edges = cut(normal(edges))
    if edges.count() <= local:
        kind = edges.schema["src"].dataType.simpleString()
        return edges.repartition(1).mapInPandas(_settled, f"node {kind}, scc {kind}")
    now, found = trimmed(edges), None
    while now.limit(1).count():
        nodes = now.select(F.col("src").alias("node")).distinct()
        colour = _least_reaching(now, nodes)
        a, b = colour.select(F.col("node").alias("src"), F.col("label").alias("ca")), colour.select(F.col("node").alias("dst"), F.col("label").alias("cb"))
        same = cut(now.join(a, "src").join(b, "dst").where("ca = cb").select("src", "dst", F.col("ca").alias("colour")))
        roots = colour.where("node = label").select(F.col("label").alias("key"), "node")
        # backward within the colour: walk reversed edges from each root
        part = roots.select(F.col("node"), F.col("key").alias("scc"))
        front, members = part, part
        while True:
            step = front.join(same, (F.col("node") == F.col("dst")) & (F.col("scc") == F.col("colour"))).select(F.col("src").alias("node"), "scc").distinct()
            new = cut(step.join(members, ["node", "scc"], "left_anti"))
            if not new.limit(1).count():
                break
            members, front = members.unionByName(new), new
        members = cut(members)
        sizes = members.groupBy("scc").agg(F.count("*").alias("n"))
        loops = now.where("src = dst").select(F.col("src").alias("node")).distinct()
        kept = members.join(sizes, "scc").join(loops.withColumn("loop", F.lit(True)), "node", "left").where("n > 1 or loop").select("node", "scc")
        found = kept if found is None else found.unionByName(kept)
        now = now.join(members, F.col("src") == F.col("node"), "left_anti").join(members.select(F.col("node").alias("d")), F.col("dst") == F.col("d"), "left_anti")
        now = trimmed(now)
    return cut(found) if found is not None else edges.select(F.col("src").alias("node"), F.col("src").alias("scc")).limit(0)


def cycles(components_: DataFrame) -> DataFrame:
    """GR1, TK2: (scc, size, members) with sorted members, largest first."""
    return components_.groupBy("scc").agg(F.count("*").alias("size"), F.array_sort(F.collect_list("node")).alias("members")).orderBy(F.desc("size"), "members")


def cyclic_pairs(components_: DataFrame) -> DataFrame:
    """GR2: unordered pairs (a, b) that share a cycle, for reports on small components."""
    a, b = components_.select(F.col("node").alias("a"), "scc"), components_.select(F.col("node").alias("b"), "scc")
    return a.join(b, "scc").where("a < b").select("a", "b")


def new_pairs(now: DataFrame, before: DataFrame) -> DataFrame:
    """GR3, ST3: co-cyclic pairs that the baseline had not."""
    return cyclic_pairs(now).join(cyclic_pairs(before), ["a", "b"], "left_anti")


def new_cycles(now: DataFrame, before: DataFrame) -> DataFrame:
    """GR3: components that hold a new pair: members that were together in fewer or other components before."""
    old = before.select("node", F.col("scc").alias("was"))
    mixed = now.join(old, "node", "left").groupBy("scc").agg(F.count("*").alias("n"), F.count("was").alias("known"), F.count_distinct("was").alias("from"))
    return cycles(now.join(mixed.where("n > 1 and (known < n or `from` > 1)").select("scc"), "scc", "left_semi"))


def _peeled(batches):
    """Longest ways to a sink over the edges (a, b) in one task: whoever has all its successors settled is next."""
    import pandas as pd

    into: dict = {}
    left: dict = {}
    for pdf in batches:
        for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
            into.setdefault(b, []).append(a)
            left[a] = left.get(a, 0) + 1
    high = {n: 0 for n in into if n not in left}
    todo = list(high)
    while todo:
        b = todo.pop()
        for a in into.get(b, ()):
            high[a] = max(high.get(a, 0), high[b] + 1)
            left[a] -= 1
            if not left[a]:
                todo.append(a)
    if high:
        yield pd.DataFrame({"c": list(high), "layer": list(high.values())}).astype({"layer": "int32"})


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """GR22: (node, layer): the longest way to a sink, cycles counting as one node."""
    scc = components(edges)
    name = scc.select(F.col("node").alias("n"), "scc")
    edges = normal(edges)
    c = edges.join(name, F.col("src") == F.col("n"), "left").select(F.coalesce("scc", "src").alias("a"), "dst").join(name, F.col("dst") == F.col("n"), "left").select("a", F.coalesce("scc", "dst").alias("b")).where("a != b").distinct()
    c = cut(c)
    every = nodes.select("node").distinct().join(name, F.col("node") == F.col("n"), "left").select("node", F.coalesce("scc", "node").alias("c"))
    if c.count() <= LOCAL:
        kind = c.schema["a"].dataType.simpleString()
        high = c.repartition(1).mapInPandas(_peeled, f"c {kind}, layer int")
        return every.join(high, "c", "left").select("node", F.coalesce("layer", F.lit(0)).alias("layer"))
    # from the sinks up: a node is settled once all that it leads to is, and its edges are done with
    front = cut(every.select("c").distinct().join(c.select(F.col("a").alias("c")), "c", "left_anti").withColumn("layer", F.lit(0)))
    settled, left = [front], c
    for layer in count(1):
        if not front.limit(1).count():
            break
        done = front.select(F.col("c").alias("b"))
        touched = left.join(done, "b", "left_semi").select("a").distinct()
        left = left.join(done, "b", "left_anti")
        left = cut(left) if layer % 4 == 0 else left  # else the plan grows with the layers
        front = cut(touched.join(left.select("a"), "a", "left_anti").select(F.col("a").alias("c"), F.lit(layer).alias("layer")))
        settled.append(front)
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return every.join(out, "c").select("node", "layer")


def neighbours(edges: DataFrame, modules: DataFrame, own: DataFrame) -> DataFrame:
    """GR20: modules one hop from ``own`` (module), either way; ``modules`` maps qual to module; DEFINES is skipped."""
    m = modules.select("qual", "module")
    e = edges.where("etype != 'DEFINES'").join(m.withColumnsRenamed({"qual": "src", "module": "ms"}), "src").join(m.withColumnsRenamed({"qual": "dst", "module": "md"}), "dst").where("ms != md").select("ms", "md").distinct()
    both = e.unionByName(e.select(F.col("md").alias("ms"), F.col("ms").alias("md")))
    return both.join(own.select(F.col("module").alias("ms")), "ms", "left_semi").select(F.col("md").alias("module")).distinct().join(own.select("module"), "module", "left_anti")


def ego(edges: DataFrame, own: DataFrame) -> DataFrame:
    """GR43: an agent's nodes and all that touch them, one hop both ways."""
    both = edges.select("src", "dst").unionByName(reversed_edges(edges))
    near = both.join(own.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node"))
    return near.unionByName(own.select("node")).distinct()


def dead(nodes: DataFrame, edges: DataFrame, is_test: Column | None = None) -> DataFrame:
    """GR27: (node, state): ``dead`` without any caller, ``only_tests`` if all callers are tests.

    ``nodes`` has ``node`` and may have a boolean ``test``; callers are judged by ``is_test`` over ``src``, else by name.
    """
    flag = is_test if is_test is not None else is_test_symbol("src")
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.every(flag).alias("tests"))
    return nodes.select("node").join(into, "node", "left").select("node", F.when(F.col("tests").isNull(), "dead").when(F.col("tests"), "only_tests").alias("state")).where("state is not null")


def dead_symbols(nodes: DataFrame, edges: DataFrame, as_value: DataFrame, called_outside: tuple[str, ...] = ("main",)) -> DataFrame:
    """GR27: (qual, kind, file, line, state) of functions and classes without callers or with tests as their only ones.

    ``nodes``: qual, kind, module, file, line, test.  Calls and inheritance count
    as use, and so does being named as a value; tests, special methods and what
    is called from outside are exempt.  A caller is a test by its file, else by
    its flag, else by name (GR28).
    """
    use = edges.where("etype in ('CALLS', 'EXTENDS')").select("src", "dst").distinct()
    who = nodes.select(F.col("qual").alias("src"), F.col("file").alias("_f"), F.col("test").alias("_t"))
    into = use.join(who, "src", "left").groupBy(F.col("dst").alias("qual")).agg(F.every(origin_is_test("_f", "_t", "src")).alias("tests"))
    name = F.element_at(F.split("qual", r"\."), -1)
    rows = nodes.where("kind in ('function', 'class')").where(~F.coalesce("test", F.lit(False)) & ~is_test_symbol("qual") & ~name.startswith("__") & ~name.isin(*called_outside))
    rows = rows.join(as_value.select("qual").distinct(), "qual", "left_anti").join(into, "qual", "left")
    return rows.select("qual", "kind", "file", "line", F.when(F.col("tests").isNull(), "dead").when(F.col("tests"), "only_tests").alias("state")).where("state is not null")


def orphan_modules(nodes: DataFrame, edges: DataFrame, imports: DataFrame, entries: DataFrame, called_outside: tuple[str, ...] = ("main",)) -> DataFrame:
    """GR27: (module, file) of modules that none imports and whose symbols no other module uses; tests and entry points (file) are exempt."""
    home = nodes.select(F.col("qual").alias("_q"), F.col("module").alias("_m"))
    use = edges.where("etype in ('CALLS', 'EXTENDS')").join(home.toDF("dst", "md"), "dst").join(home.toDF("src", "ms"), "src", "left")
    outside = use.where(F.col("md") != F.coalesce("ms", "src")).select(F.col("md").alias("qual"))
    used = outside.unionByName(imports.select(F.col("dst").alias("qual"))).distinct()
    name = F.element_at(F.split("qual", r"\."), -1)
    rows = nodes.where("kind = 'module'").where(~F.coalesce("test", F.lit(False)) & ~is_test_symbol("qual") & ~name.startswith("__") & ~name.isin(*called_outside))
    return rows.join(used, "qual", "left_anti").join(entries.select("file").distinct(), "file", "left_anti").select(F.col("qual").alias("module"), "file")


def dead_total(symbols: DataFrame, orphans: DataFrame) -> DataFrame:
    """AG11: (state, n) and all together."""
    each = symbols.select("state").unionByName(orphans.select(F.lit("orphan").alias("state")))
    return each.groupBy("state").agg(F.count("*").alias("n")).unionByName(each.agg(F.count("*").alias("n")).select(F.lit("total").alias("state"), "n"))


def edge_list(edges: DataFrame) -> DataFrame:
    """GR7: distinct edges in order, each with how many there are."""
    rows = normal(edges)
    return rows.join(F.broadcast(rows.agg(F.count("*").alias("edges"))), how="cross").orderBy("src", "dst")  # one row


def breakage_targets(nodes: DataFrame, edges: DataFrame, called: bool = True, limit: int = 20) -> DataFrame:
    """XT36: public functions with callers, or without, most called first."""
    into = edges.where("etype = 'CALLS'").groupBy(F.col("dst").alias("qual")).agg(F.count_distinct("src").alias("callers"))
    rows = nodes.where("kind = 'function'").where(~F.element_at(F.split("qual", r"\."), -1).startswith("_")).join(into, "qual", "left").select("qual", F.coalesce("callers", F.lit(0)).cast("long").alias("callers"))
    return rows.where("callers > 0" if called else "callers = 0").orderBy(F.desc("callers"), "qual").limit(limit)


def origin_is_test(file: str, flag: str, name: str) -> Column:
    """GR28: by file where known, else by flag, else by name."""
    return F.when(F.col(file).isNotNull(), is_test_file(file)).when(F.col(flag).isNotNull(), F.col(flag)).otherwise(is_test_symbol(name))


def entry_points(files: DataFrame) -> DataFrame:
    """GR29: files that guard a main block."""
    return files.where(F.col("text").rlike(r"""(?m)^if\s+__name__\s*==\s*['"]__main__['"]"""))


def caller_split(edges: DataFrame) -> DataFrame:
    """GR32: (node, tests, sources): how many callers are tests and how many are not."""
    return edges.groupBy(F.col("dst").alias("node")).agg(F.count_if(is_test_symbol("src")).alias("tests"), F.count_if(~is_test_symbol("src")).alias("sources"))


def symbol_delta(now: DataFrame, before: DataFrame, calls_now: DataFrame, calls_before: DataFrame) -> tuple[DataFrame, int, DataFrame]:
    """GR42: new symbols, how many are gone, new calls."""
    a, b = now.select("qual").distinct(), before.select("qual").distinct()
    return a.join(b, "qual", "left_anti"), b.join(a, "qual", "left_anti").count(), normal(calls_now).join(normal(calls_before), ["src", "dst"], "left_anti")


def process_chain(captures: DataFrame) -> DataFrame:
    """GR40: (src, dst) distinct nodes: a record's parent by span, else by session and parent process; later records win on a shared key.

    ``captures``: seq, node, span_id, parent_span, session_id, pid, ppid.
    """
    last = lambda *key: captures.where(" and ".join(f"{k} is not null" for k in key)).groupBy(*key).agg(F.max_by("node", "seq").alias("parent"))
    spans = last("span_id").select(F.col("span_id").alias("parent_span"), F.col("parent").alias("by_span"))
    pids = last("session_id", "pid").select("session_id", F.col("pid").alias("ppid"), F.col("parent").alias("by_pid"))
    found = captures.join(spans, "parent_span", "left").join(pids, ["session_id", "ppid"], "left")
    return found.select(F.coalesce("by_span", "by_pid").alias("src"), F.col("node").alias("dst")).where("src is not null and src != dst").distinct()


def oracle_scores(observed: DataFrame, static: DataFrame) -> DataFrame:
    """GR44, GR45, GR48: (observed, found, recall, static, confirmed, precision) of static edges against observed ones."""
    o, s = normal(observed), normal(static)
    hit = o.join(s, ["src", "dst"], "left_semi").agg(F.count("*").alias("found"))
    n, m = o.agg(F.count("*").alias("observed")), s.agg(F.count("*").alias("static"))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    return n.join(hit).join(m).select("observed", "found", share("found", "observed").alias("recall"), "static", share("found", "static").alias("precision"))


def first_missing(observed: DataFrame, static: DataFrame, seeds: DataFrame, max_depth: int = 8) -> DataFrame:
    """GR49: (key, src, dst, depth): the observed edges closest to each seed that static analysis lacks."""
    walked = frontier(observed, seeds, max_depth)
    at = walked.nodes.unionByName(seeds.select("key", "node", F.lit(0).alias("depth")))
    gaps = normal(observed).join(normal(static), ["src", "dst"], "left_anti")
    found = at.join(gaps, F.col("node") == F.col("src")).select("key", "src", "dst", "depth")
    return found.withColumn("r", F.row_number().over(Window.partitionBy("key").orderBy("depth", "src", "dst"))).where("r = 1").drop("r")


def seed_positions(nodes: DataFrame, step: float = 2.399963229728653) -> DataFrame:
    """GR26: golden-angle starting places by name's order, with GR25's jitter."""
    n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("node")) - 1
    r = F.sqrt(n + 0.5)
    return nodes.select("node", (r * F.cos(n * step) + jitter("node", 0.1)).alias("x"), (r * F.sin(n * step) + jitter(F.reverse("node"), 0.1)).alias("y"))


def force_layout(nodes: DataFrame, edges: DataFrame, rounds: int = 50, most: int = 3000) -> DataFrame:
    """GR24: deterministic force-directed places of a small graph; a picture of more than ``most`` nodes is refused."""
    if nodes.count() > most:
        raise ValueError(f"a layout of more than {most} nodes is no picture")
    start = seed_positions(nodes).groupBy(F.lit(1).alias("g")).agg(F.array_sort(F.collect_list(F.struct("node", "x", "y"))).alias("n"))
    links = edges.groupBy(F.lit(1).alias("g")).agg(F.collect_list(F.struct("src", "dst")).alias("e"))

    def run(batches):
        import numpy as np
        import pandas as pd

        for pdf in batches:
            for _, row in pdf.iterrows():
                names = [r["node"] for r in row["n"]]
                at = {n: i for i, n in enumerate(names)}
                p = np.array([[r["x"], r["y"]] for r in row["n"]])
                e = np.array([(at[r["src"]], at[r["dst"]]) for r in (row["e"] if row["e"] is not None else []) if r["src"] in at and r["dst"] in at and r["src"] != r["dst"]]).reshape(-1, 2)
                for i in range(rounds):
                    d = p[:, None] - p[None]
                    r2 = (d**2).sum(2) + 0.01
                    force = (d / r2[:, :, None]).sum(1)
                    if len(e):
                        pull = (p[e[:, 1]] - p[e[:, 0]]) * 0.1
                        np.add.at(force, e[:, 0], pull)
                        np.add.at(force, e[:, 1], -pull)
                    p = p + force * 0.1 * (1 - i / rounds)
                yield pd.DataFrame({"node": names, "x": p[:, 0], "y": p[:, 1]})

    kind = nodes.schema["node"].dataType.simpleString()
    return start.join(links, "g", "left").mapInPandas(run, f"node {kind}, x double, y double")


ship(__name__)
