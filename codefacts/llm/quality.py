"""Risk-controlled quality rules (operator 1); DataFrame functions only.

Base measures of a text are counts of words, symbols, repeated lines and
repeated three-word windows.  Each rule is a rate and a cutoff beyond which a
document goes.  Cutoffs are chosen per stratum (language) from labelled rows:

* labelled documents are split by a hash of their id into a fitting quarter and
  a holdout; candidate cutoffs of a rule are high percentiles of the good
  documents' rates and low ones of the bad documents' in the fitting part, so the
  holdout plays no part in proposing them.  A candidate must catch something: in
  the fitting part it has to reject at least ``LIFT`` times as large a share of
  the bad documents as of the good;
* a stratum's candidates form one sequence of nested steps: step s takes each
  rule's s-th mildest candidate, so every step rejects what the one before does;
* steps are tested in that order on the holdout's good documents (quality 1): a
  step at which the rules together reject k of n passes when the exact binomial
  upper bound of its false-rejection rate is at most ``risk``.  Testing stops at
  the first step that fails, so steps need no correction among themselves
  (fixed-sequence testing); over strata the level ``error`` is divided
  (Bonferroni);
* of the steps that passed, the mildest is used that catches nearly as many bad
  documents of the fitting part as any (``NEARLY``), or none.

So with probability 1 - ``error`` every stratum loses at most ``risk`` of its
good documents to all rules together.  At ``risk`` 0.02 and four strata 219 good
documents of the holdout, none of them rejected, suffice.

Every labelled row takes part in choosing and certifying: all rows are measured
where they are read and only their measures are joined with the labels, so no
text is shuffled.  The percentiles are exact ones of all rows of the fitting part.

Defined cases: null text has no words and fails the base rule; null labels and
labels of unknown ids take no part, of repeated labels the smallest counts; a
stratum without enough labels has no cutoff and keeps what the base rule keeps;
a null language is a stratum of its own; repeated rows give repeated results;
extra columns are carried in a struct, so that their names cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codefacts.llm.common import BLANK, cut, ship, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Rates of the rules, as (numerator, denominator); a document is rejected above the cutoff.
RULES = {
    "symbols": ("n_symbols", "word_chars"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "repeats": ("n_repeat_words", "n_words"),
    "word_length": ("word_chars", "n_words"),
}
RISK, ERROR, LIFT = 0.02, 0.05, 5
#: Percentiles of the good and of the bad documents in the fitting part that are proposed as cutoffs.
CANDIDATES = [1.0, 0.9995, 0.999, 0.998, 0.996, 0.994, 0.992, 0.99]
FROM_BAD = [0.02, 0.05, 0.1, 0.25]
NEARLY = 0.97


def measured(docs: DataFrame, *keep: str | Column) -> DataFrame:
    """A struct ``kept`` of the given columns and a struct ``m`` of base measures for every row, without a shuffle.

    A three-word window is told by the 64-bit hash of its words within one
    text.  Sorting a text's hashes shows whether any repeats; only then are
    windows sorted again with their places, and the places of repeating ones
    cover three words each, less what the next one covers as well.
    """
    blank = f"[{BLANK}]+"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*keep).alias("kept"), text.alias("t"))
    rows = rows.select("kept", "t", words_of("t").alias("w"))
    rows = rows.select("kept", "t", "w", F.expr("transform(slice(w, 1, greatest(size(w) - 2, 0)), (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2)))").alias("h"))
    rows = rows.select("kept", "t", "w", "h", F.sort_array("h").alias("s"))
    again = "exists(transform(s, (x, i) -> i > 0 and x = get(s, i - 1)), x -> x)"
    rows = rows.select("kept", "t", "w", F.expr(f"case when {again} then sort_array(transform(h, (x, i) -> struct(x as h, i as i))) end").alias("z"))
    rows = rows.select(
        "kept",
        "t",
        "w",
        F.expr("sort_array(transform(filter(z, (x, i) -> (i > 0 and x.h = get(z, i - 1).h) or x.h <=> get(z, i + 1).h), x -> x.i))").alias("p"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(f"[^{BLANK}]")).alias("lines"),
    )
    # A generator of one row keeps the optimiser from copying these expressions into every later use of a measure.
    return rows.select(
        "kept",
        F.explode(F.array(F.struct(
            F.size("w").cast("long").alias("n_words"),
            F.length(F.regexp_replace("t", blank, "")).cast("long").alias("word_chars"),
            F.regexp_count("t", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
            (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
            F.expr("coalesce(aggregate(transform(p, (x, i) -> least(3, coalesce(get(p, i + 1) - x, 3))), 0L, (a, x) -> a + x), 0L)").alias("n_repeat_words"),
            F.size("lines").cast("long").alias("n_lines"),
        ))).alias("m"),
    )


def base_failed() -> Column:
    return (F.col("m.n_words") < MIN_WORDS) | (100 * F.col("m.n_repeat_words") > MAX_REPEAT_PERCENT * F.col("m.n_words"))


def rates() -> Column:
    """Array of the rules' rates; zero where nothing is there to measure."""
    return F.array(*[F.when(F.col(f"m.{b}") > 0, F.col(f"m.{a}") / F.col(f"m.{b}")).otherwise(F.lit(0.0)) for a, b in RULES.values()])


def binomial_cdf(k: str, n: str, rate: float) -> Column:
    """P(X <= k) for X binomial (n, rate), k below n * rate: the largest term in logarithms, the others by their ratios to it."""
    top = f"aggregate(sequence(1L, greatest(1L, {k})), 0D, (a, j) -> a + if(j > {k}, 0D, ln(({n} - j + 1) / j))) + {k} * ln({rate}D) + ({n} - {k}) * ln(1 - {rate}D)"
    tail = f"aggregate(if({k} > 0, sequence({k}, 1L, -1L), array()), struct(1D as t, 1D as s), (a, j) -> struct(a.t * j * (1 - {rate}D) / (({n} - j + 1) * {rate}D) as t, a.s + a.t * j * (1 - {rate}D) / (({n} - j + 1) * {rate}D) as s), a -> a.s)"
    return F.expr(f"exp({top}) * {tail}")


def proposed(rows: DataFrame, at: list[float]) -> DataFrame:
    """(lang, rule, cutoff): exact percentiles of all rates, between two neighbours by linear interpolation; ranks come from a sort, so that memory does not grow with the rows."""
    group = Window.partitionBy("lang", "rule")
    ranked = rows.select("lang", "rule", "rate", F.row_number().over(group.orderBy("rate")).alias("rank"), F.count("*").over(group).alias("n"))
    ranked = ranked.withColumn("p", F.explode(F.array(*map(F.lit, at)))).withColumn("share", 1 - F.abs(F.col("rank") - 1 - (F.col("n") - 1) * F.col("p")))
    between = F.when(F.min("rate") == F.max("rate"), F.min("rate")).otherwise(F.sum(F.col("share") * F.col("rate")))
    return ranked.where("share > 0").groupBy("lang", "rule", "p").agg(between.alias("cutoff")).select("lang", "rule", "cutoff")


def cutoffs(docs: DataFrame, labels: DataFrame, risk: float = RISK, error: float = ERROR, sample: int | None = None) -> DataFrame:
    """(stratum, cut array<double>): per stratum each rule's certified cutoff, null where none is.

    All fitting rows propose; ``sample``, which no query sets, asks about so many a stratum and label only.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    rows = measured(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text").where("doc_id is not null"), "doc_id", "lang").where(~base_failed())
    told = cut(rows.select("kept.*", rates().alias("rates")).join(known, "doc_id"))
    told = told.withColumn("fitting", F.pmod(F.xxhash64(F.col("doc_id"), F.lit("fit")), F.lit(4)) == 0)
    fitting = told.where("fitting").select("doc_id", "lang", "quality", F.posexplode("rates").alias("rule", "rate"))
    proposing = fitting
    if sample is not None:
        sizes = told.where("fitting").groupBy(F.col("lang").alias("l"), (F.col("quality") == 1).alias("fine")).agg(F.count("*").alias("size"))  # two rows a stratum
        proposing = fitting.join(F.broadcast(sizes), F.col("lang").eqNullSafe(F.col("l")) & ((F.col("quality") == 1) == F.col("fine")))
        proposing = proposing.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("propose")), F.lit(1_000_000)) * F.col("size") < F.lit(sample * 1_000_000))
    grid = cut(proposed(proposing.where("quality = 1"), CANDIDATES).unionByName(proposed(proposing.where("quality != 1"), FROM_BAD)).distinct())
    over = F.col("rate") > F.col("cutoff")
    g, f = grid.alias("g"), fitting.alias("f")
    shares = [F.avg(F.when(F.col("quality") == 1, over.cast("int"))).alias("good"), F.avg(F.when(F.col("quality") != 1, over.cast("int"))).alias("bad")]
    useful = (F.col("bad") > 0) & (F.col("bad") >= LIFT * F.coalesce("good", F.lit(0.0)))
    lift = g.join(f, F.col("g.lang").eqNullSafe(F.col("f.lang")) & (F.col("g.rule") == F.col("f.rule"))).groupBy("g.lang", "g.rule", "cutoff").agg(*shares).where(useful)
    mildest = [F.sort_array(F.collect_list(F.when(F.col("rule") == i, F.col("cutoff"))), False).alias(f"r{i}") for i in range(len(RULES))]  # at most a dozen a rule
    rules = [f"r{i}" for i in range(len(RULES))]
    steps = lift.groupBy("lang").agg(*mildest).withColumn("step", F.explode(F.sequence(F.lit(1), F.greatest(*map(F.size, rules)))))
    steps = cut(steps.select("lang", "step", F.array(*[F.get(r, F.least(F.col("step"), F.size(r)) - 1) for r in rules]).alias("cut")))
    t, o = steps.alias("t"), told.alias("o")
    over = F.coalesce(F.exists(F.zip_with("rates", "cut", lambda r, c: F.coalesce(r > c, F.lit(False))), lambda x: x), F.lit(False))
    held = ~F.col("fitting") & (F.col("quality") == 1)
    tests = t.join(o, F.col("t.lang").eqNullSafe(F.col("o.lang"))).select("t.lang", "step", "cut", "quality", "fitting", held.alias("held"), over.alias("over"))
    caught = F.avg(F.when(F.col("fitting") & (F.col("quality") != 1), F.col("over").cast("int"))).alias("bad")
    tests = cut(tests.groupBy("lang", "step").agg(F.first("cut").alias("cut"), F.count_if("held").alias("n"), F.count_if(F.col("held") & F.col("over")).alias("k"), caught))
    level = error / max(1, tests.select("lang").distinct().count())
    sure = F.when(F.col("k") < F.col("n") * risk, binomial_cdf("k", "n", risk) <= level).otherwise(False)
    own = Window.partitionBy("lang")
    passed = tests.withColumn("sure", F.every(sure).over(own.orderBy("step"))).where("sure").withColumn("most", F.max("bad").over(own))
    best = passed.where(F.col("bad") >= NEARLY * F.col("most")).groupBy("lang").agg(F.min_by("cut", "step").alias("cut"))
    return cut(best.select(F.col("lang").alias("stratum"), "cut"))


def judged(docs: DataFrame, labels: DataFrame, *keep: str | Column) -> DataFrame:
    """Structs ``kept`` (the given columns) and ``m`` and the columns ``base_failed`` and ``kept_by_rules`` for every row."""
    limits = cutoffs(docs, labels)
    rows = measured(docs, F.struct(*keep).alias("row"), F.col("lang").alias("lang"))
    rows = rows.join(F.broadcast(limits), F.col("kept.lang").eqNullSafe(F.col("stratum")), "left")
    over = F.coalesce(F.exists(F.zip_with(rates(), "cut", lambda r, c: F.coalesce(r > c, F.lit(False))), lambda x: x), F.lit(False))
    return rows.select(F.col("kept.row").alias("kept"), "m", base_failed().alias("base_failed"), (~base_failed() & ~over).alias("kept_by_rules"))


ship(__name__)
