import math
import random
import re

import numpy as np

from pyspark.sql import functions as F

from codefacts.llm import mixing, quality
from tests.conftest import rows

WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 3000 else set()
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(3)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_measures_match_brute_force(spark, weird):
    got = quality.measured(weird, "doc_id", "text").select("kept.doc_id", "kept.text", "m.*").collect()
    assert len(got) == 11
    for r in got:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text), r.doc_id


def test_repeats_that_overlap(spark):
    texts = ["a b \u2028", "a b \u0085", " \u2029 a \u2029", "a b\r\n", "  ", "\n", "a a a a a", "a b c a b c a", "a b c d a b c", "x y z", "p q r s p q r t q r s"]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality.measured(d, "text").select("kept.text", "m.n_repeat_words", "m.n_words", "m.word_chars").collect():
        assert (r[1], r[2], r[3]) == (brute(r[0])[4], *brute(r[0])[:2]), r[0]


def test_binomial_bound_is_exact(spark):
    cases = [(0, 100), (3, 500), (10, 1000), (30, 4000)]
    d = spark.createDataFrame(cases, "k long, n long")
    for r in d.withColumn("p", quality.binomial_cdf("k", "n", 0.02)).collect():
        want = sum(math.comb(r.n, j) * 0.02**j * 0.98 ** (r.n - j) for j in range(r.k + 1))
        assert math.isclose(r.p, want, rel_tol=1e-9)


def labelled(spark, n=8000):
    good = "wo" + "rd other thing here now " * 12
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, F.concat(F.lit(good), F.lit("### $$$ *** " * 15))).otherwise(F.concat(F.expr("concat_ws(' ', transform(sequence(1, 60), i -> concat('w', i + id)))"))).alias("text"), F.lit("en").alias("lang"))
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 10 == 0, 0).otherwise(1).alias("quality"))
    return docs, labels


def test_certified_cutoff_rejects_bad_and_keeps_good(spark):
    docs, labels = labelled(spark)
    got = quality.judged(docs, labels, "doc_id").where("not base_failed")
    bad = got.where("kept.doc_id % 10 = 0 and kept_by_rules").count()
    lost = got.where("kept.doc_id % 10 != 0 and not kept_by_rules").count()
    assert lost <= 0.02 * 7200 and (bad == 0)


def test_every_label_certifies_whatever_the_sample(spark):
    words = "concat_ws(' ', transform(sequence(1, 60), i -> concat('w', i + id)))"
    docs = spark.range(8000).selectExpr("id as doc_id", f"concat({words}, if(id % 10 = 0, ' ### $$$ ***', '')) as text", "'en' as lang")
    labels = docs.selectExpr("doc_id", "if(doc_id % 10 = 0, 0, 1) as quality")
    few = rows(quality.cutoffs(docs, labels, sample=500))
    assert [r[0] for r in few] == ["en"] and any(c is not None for c in few[0][1])


def test_cutoffs_against_a_plain_version(spark):
    r = random.Random(3)
    data, labels = [], []
    for i in range(4000):
        bad = r.random() < 0.1
        words = [f"w{r.randrange(5000)}" for _ in range(80)]
        for _ in range(r.randint(4, 12) if bad and r.random() < 0.8 else int(r.random() < 0.01)):
            words[r.randrange(80)] = "#|#"
        data.append((i, " ".join(words), ["en", "de", None][i % 3] if i > 60 else "fr"))
        labels.append((i, 0 if bad else 1))
    docs, told = spark.createDataFrame(data, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int")
    fit = {x[0] for x in docs.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(4)) == 0).select("doc_id").collect()}
    rate = {i: [b[2] / b[1], b[3] / len(t.split("\n")), b[4] / b[0], b[1] / b[0]] for i, t, _ in data for b in [brute(t)]}
    good, want = {i for i, q in labels if q}, {}
    strata = {}
    for i, _, lang in data:
        strata.setdefault(lang, []).append(i)
    share = lambda ids, cut: sum(any(c is not None and a > c for a, c in zip(rate[i], cut)) for i in ids) / len(ids)
    steps = {}
    for lang, ids in strata.items():
        f = [i for i in ids if i in fit]
        fine, poor = [i for i in f if i in good], [i for i in f if i not in good]
        lists = []
        for j in range(4):
            one = lambda c, j=j: [c if k == j else None for k in range(4)]
            points = {float(np.quantile([rate[i][j] for i in fine], q)) for q in quality.CANDIDATES} | {float(np.quantile([rate[i][j] for i in poor], q)) for q in quality.FROM_BAD if poor}
            lists.append(sorted((c for c in points if poor and share(poor, one(c)) > 0 and share(poor, one(c)) >= quality.LIFT * share(fine, one(c))), reverse=True))
        if any(lists):
            steps[lang] = [[x[min(s, len(x) - 1)] if x else None for x in lists] for s in range(max(map(len, lists)))]
    for lang, cuts in steps.items():
        held = [i for i in strata[lang] if i not in fit and i in good]
        poor = [i for i in strata[lang] if i in fit and i not in good]
        passed = []
        for c in cuts:
            n, k = len(held), round(share(held, c) * len(held))
            if k >= 0.02 * n or sum(math.comb(n, j) * 0.02**j * 0.98 ** (n - j) for j in range(k + 1)) > 0.05 / len(steps):
                break
            passed.append((share(poor, c), c))
        if passed:
            want[lang] = next(c for b, c in passed if b >= quality.NEARLY * max(passed, key=lambda x: x[0])[0])
    got = {x.stratum: x.cut for x in quality.cutoffs(docs, told).collect()}
    assert set(got) == set(want) and len(want) >= 2
    for lang in want:
        assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, rel_tol=1e-9)) for a, b in zip(got[lang], want[lang]))
    kept = {x[0]: x[1] for x in quality.judged(docs, told, "doc_id").select("kept.doc_id", "kept_by_rules").collect()}
    assert all(kept[i] == (not any(c is not None and a > c for a, c in zip(rate[i], want.get(lang, [None] * 4)))) for i, _, lang in data)
    assert sum(not kept[i] for i in kept if i not in good) > 200


def test_no_cutoff_without_enough_labels(spark, weird):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (999, 0), (4, None)], "doc_id long, quality int")
    assert rows(quality.cutoffs(weird, labels)) == []
    got = quality.judged(weird, labels, *[c for c in weird.columns]).select("kept.*", "base_failed", "kept_by_rules")
    assert got.columns[:8] == weird.columns and got.count() == 11
    assert {r["doc_id"] for r in got.where("kept_by_rules").collect()} == {9}
    empty = quality.judged(weird.limit(0), labels.limit(0), "doc_id")
    assert empty.count() == 0


def test_targets_reshare_what_a_cap_leaves(spark):
    d = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 1000), (None, 90)], "source string, size long")
    got = {r["source"]: r["target"] for r in mixing.targets(d).collect()}
    assert got["a"] == 30 and math.isclose(sum(got.values()), 2100) and all(t <= 3 * s + 1e-9 for t, s in ((got["a"], 10), (got["b"], 1000), (got["c"], 1000), (got[None], 90)))


def test_highest_quotients(spark):
    d = spark.createDataFrame([("a", 53.0), ("b", 24.0), ("c", 23.0), ("z", 0.0)], "k string, w double")
    for seats in (0, 1, 7, 50, 1001):
        got = {r["k"]: r["quota"] for r in mixing.apportion(d.withColumn("s", F.lit(seats).cast("long")), None, ["k"], "w", "s").collect()}
        want = dict.fromkeys("abcz", 0)
        for _ in range(seats):
            best = max("abc", key=lambda k: ({"a": 53, "b": 24, "c": 23}[k] / (2 * want[k] + 1), -ord(k)))
            want[best] += 1
        assert got == want, seats


def test_mix_is_near_target_and_repeats(spark, weird):
    many = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("concat_ws(' ', transform(sequence(1, 20 + cast(id % 90 as int)), i -> 'w'))").alias("text"), F.concat(F.lit("s"), (F.col("id") % 5).cast("string")).alias("source"))
    got = mixing.mixed(many)
    for r in got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g")).collect():
        assert abs(r["t"] - r["g"]) <= max(16, 0.01 * r["g"])
    assert got.where("taken > 3 * size").count() == 0 and rows(got) == rows(mixing.mixed(many.repartition(7)))
    odd = mixing.mixed(weird)
    assert odd.count() == 11 and odd.where("size = 0 and taken > 0").count() == 0
    assert mixing.mixed(weird.limit(0)).count() == 0


def test_applied_mix_has_the_words_taken(spark):
    d = spark.createDataFrame([(i, "a b  c\nd e f g h i j" * (1 + i % 3), "en", f"s{i % 3}", 5) for i in range(60)], "doc_id long, text string, lang string, source string, n_chars long")
    taken = mixing.mixed(d.select("doc_id", "text", "source")).agg(F.sum("taken")).first()[0]
    out = mixing.applied(d)
    assert out.columns == d.columns and abs(sum(len(WORD.findall(r.text)) for r in out.collect()) - taken) <= 16 * 3
    assert out.where("n_chars != length(text)").count() == 0


def test_all_fitting_rows_propose_cutoffs(spark):
    import inspect

    import numpy as np

    default = inspect.signature(quality.cutoffs).parameters["sample"].default
    assert default is None
    r = np.random.default_rng(3)
    told = {("a", 0): r.random(4001), ("a", 1): np.repeat([0.0, 0.25], [300, 77]), (None, 0): np.array([0.5])}
    table = spark.createDataFrame([(lang, rule, float(x)) for (lang, rule), xs in told.items() for x in xs], "lang string, rule int, rate double")
    at = quality.CANDIDATES + quality.FROM_BAD
    got = rows(quality.proposed(table, at))
    want = sorted(((lang, rule, float(c)) for (lang, rule), xs in told.items() for c in np.percentile(xs, [100 * p for p in at])), key=repr)
    assert len(got) == len(want)
    key = lambda x: (repr(x[:2]), x[2])
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:2] == w[:2] and abs(g[2] - w[2]) < 1e-12
