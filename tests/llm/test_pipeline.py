import random

import numpy as np

import corpus_pipeline
from codefacts.llm import jaccard, mixing, pieces, queries, secrets
from tests.llm.test_native import WORD, brute
from tests.llm.test_python import plain_components, plain_fingerprint, plain_secrets

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=1, n=60):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(400)]
    out = []
    for i in range(n):
        text = " ".join(r.choice(words) for _ in range(r.randint(20, 160)))
        if i % 9 == 0:
            text = "same line of words here " * 30
        if i % 10 == 3:
            text += ' token = "0123456789abcdef0123456789abcdef01234567"'
        if i % 6 == 5:
            text = out[-1][1]
        out.append((i, text, "en", f"s{i % 4}", len(text)))
    return [*out, (None, out[3][1] + " x", None, None, 1), (None, None, None, None, None), (70, "", "en", "s0", 0)]


def test_each_stage_against_a_plain_version(spark, tmp_path):
    sf = str(tmp_path)
    docs = spark.createDataFrame(corpus(), DOCS).withColumnRenamed("lang", "lang")
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    now = spark.read.parquet(f"{sf}/documents.parquet")
    before = [tuple(r) for r in now.collect()]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, sf).write.parquet(f"{sf}/{name}")
        now = spark.read.parquet(f"{sf}/{name}")
        after = [tuple(r) for r in now.collect()]
        if name != "tokens":
            assert now.dtypes == docs.dtypes
        if name == "quality":
            fine = lambda t: (b := brute(t))[0] >= 50 and 100 * b[4] <= 50 * b[0]
            assert sorted(after, key=repr) == sorted((r for r in before if fine(r[1])), key=repr)
        elif name == "near_copies":
            fps = [plain_fingerprint(r[1]) for r in before]
            classes = plain_components(fps)
            assert len(after) == len({classes[f] for f in fps})
            for r in after:
                mine = classes[plain_fingerprint(r[1])]
                ids = [x[0] for x, f in zip(before, fps) if classes[f] == mine and x[0] is not None]
                assert r[0] == (min(ids) if ids else None)
        elif name == "secrets":
            want = {r[0]: secrets.masked(r[1], [s[:2] for s in plain_secrets(r[1])]) for r in before}
            assert {r[0]: r[1] for r in after} == want and all(r[4] == len(r[1]) for r in after)
            assert any("[SECRET]" in r[1] for r in after)
        elif name == "mix":
            prior = spark.read.parquet(f"{sf}/secrets")
            target = sum(r.target for r in mixing.targets(mixing.mixed(prior).select("source", "size")).collect())
            got = sum(len(WORD.findall(r[1])) for r in after)
            assert abs(got - target) <= 0.02 * target + 16 * 5
            sizes = {r[0]: len(WORD.findall(r[1])) for r in before}
            for k, n in sizes.items():
                assert sum(len(WORD.findall(r[1])) for r in after if r[0] == k) <= 3 * n
        else:
            codec = pieces.Codec(queries.model_file())
            texts = [r[1] for r in before]
            assert sorted(r.ids for r in now.collect()) == sorted(codec.encode(texts))
        before = after


def test_texts_of_jaccard_four_fifths_leave_one_copy(spark, tmp_path):
    r = random.Random(31)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    data = []
    for g in range(20):
        words = [word() for _ in range(100)]
        edited = [*words]
        edited[50] = word()
        edited[20] = word()
        data += [(10 * g, " ".join(words)), (10 * g + 1, " ".join(edited)), (10 * g + 2, " ".join([*words[:70], *[word() for _ in range(30)]]))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in data], DOCS)
    parts = {i: {tuple(t.split()[k : k + 5]) for k in range(96)} for i, t in data}
    alike = lambda a, b: 5 * len(parts[a] & parts[b]) >= 4 * len(parts[a] | parts[b])
    assert all(alike(10 * g, 10 * g + 1) and not alike(10 * g, 10 * g + 2) for g in range(20))
    got = {x.doc_id for x in corpus_pipeline.near_copies_stage(spark, docs, "").collect()}
    assert got == {10 * g + k for g in range(20) for k in (0, 2)}


def test_run_is_the_stages_and_empty_tables_pass(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame(corpus(2, 30), DOCS).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    assert corpus_pipeline.run(spark, sf).count() > 0 and 4 <= len(corpus_pipeline.STAGES) <= 5
    empty = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_rows_that_share_an_id_are_told_apart_by_their_text(spark):
    a, b = ("alpha beta gamma delta epsilon zeta eta theta " * 9), ("one two three four five six seven eight nine " * 9)
    data = [(1, a, "en", "s", 1), (5, a, "en", "s", 1), (5, b, "en", "s", 1), (5, b, "en", "s", 1), (5, b, "de", "s", 1)]
    got = [tuple(r) for r in corpus_pipeline.near_copies_stage(spark, spark.createDataFrame(data, DOCS), "").collect()]
    assert len(got) == 2 and data[0] in got and {r[:2] for r in got} == {(1, a), (5, b)}


def test_large_groups_lose_no_similar_pair(spark):
    """Three families of edited copies that share a long passage, more than a group holds, against all pairs."""
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    common, texts = [word() for _ in range(70)], []
    for _ in range(3):
        base = [*common, *[word() for _ in range(40)]]
        for _ in range(25):
            now = [*base]
            for _ in range(r.randint(1, 4)):
                now[r.randrange(len(now))] = word()
            texts.append(" ".join(now))
    r.shuffle(texts)
    sets = [jaccard.shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    fps = [plain_fingerprint(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            both = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) or (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    assert {x.doc_id for x in corpus_pipeline.near_copies_stage(spark, docs, "").collect()} == {find(i) for i in range(len(texts))}
    assert 3 < len({find(i) for i in range(len(texts))}) < 75


def similar(a, b):
    both = len(set(a.tolist()) & set(b.tolist()))
    return 5 * both >= 4 * (len(a) + len(b) - both)


def family(r, n, edits):
    """Copies of one text, each with so many words of its own."""
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    base, out = [word() for _ in range(60)], []
    for _ in range(n):
        now = [*base]
        for at in r.sample(range(len(now)), edits):
            now[at] = word()
        out.append(" ".join(now))
    return out


def test_a_family_of_edited_copies_makes_no_pairs_in_the_plan(spark, monkeypatch):
    """200 copies, half of them unlike all others: no table between the steps grows with their square, and none is lost where a home has several shares."""
    r = random.Random(8)
    texts = [t for e in (1, 2) for t in family(random.Random(8), 100, e)]
    r.shuffle(texts)
    sets, fps = [jaccard.shingles(t) for t in texts], [plain_fingerprint(t) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and (similar(sets[i], sets[j]) or (fps[i] ^ fps[j]).bit_count() <= 3):
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    made, cut = [], jaccard.cut

    def counted(df):
        out = cut(df)
        made.append(out.count())
        return out

    monkeypatch.setattr(jaccard, "cut", counted)
    monkeypatch.setattr(jaccard, "HOME", 4_000, raising=False)
    assert {x.doc_id for x in corpus_pipeline.near_copies_stage(spark, docs, "").collect()} == set(root)
    assert 3 < len(set(root)) < 190
    assert max(made) <= 200 * 14


def test_links_within_a_home_span_what_all_pairs_join():
    r = random.Random(9)
    texts = [t for n in (1, 40, 30) for t in family(r, n, 1)] + ["a b", "a b c d e f"]
    sets, c = [jaccard.shingles(t) for t in texts], [100 + i // 3 for i in range(len(texts))]
    for shares in (1, 2):
        share = [i % shares for i in range(len(texts))]
        pairs = {(c[i], c[j]) for i in range(len(texts)) for j in range(i) if similar(sets[i], sets[j]) and c[i] != c[j] and (shares == 1 or share[i] != share[j])}
        got = jaccard._spanning(np.array(c), sets, np.array(share))

        def joined(links):
            root = {x: x for x in c}
            for a, b in links:
                a, b = sorted((root[a], root[b]))
                root = {k: a if v == b else v for k, v in root.items()}
            return root

        assert len(got) < len(set(c)) and joined(got) == joined(pairs) and len(set(joined(pairs).values())) < len(set(c))
