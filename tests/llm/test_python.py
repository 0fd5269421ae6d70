import hashlib
import pickle
import random
import re
import subprocess
import sys
import time
import zlib
from collections import Counter
from itertools import product
from math import isclose, log10

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark import cloudpickle
from pyspark.sql import functions as F

from codefacts.llm import chat, lm, pieces, pii, queries, secrets, simhash, topk, warc
from codefacts.llm.tagger import Tagger
from tests.conftest import rows

WORD = re.compile("[^\x20\x09-\x0d]+")


# near copies ---------------------------------------------------------------


def plain_fingerprint(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = len(words) - 2
    parts = [" ".join(words[i : i + 3]) for i in range(n)] if n > 0 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(fps):
    names = sorted(set(fps))
    root = {f: f for f in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in names}


def test_near_copies_on_odd_rows(spark, weird):
    got = simhash.near_copies(weird).collect()
    assert len(got) == 11
    fps = {i: f"{plain_fingerprint(t):016x}" for i, t in ((r.doc_id, r.text) for r in weird.collect())}
    assert all(r.fingerprint == fps[r.doc_id] for r in got)
    classes = {r.doc_id: r.component_id for r in got}
    assert classes[7] == 1 and classes[2] == 2 and classes[3] == 2 and classes[None] is None
    assert simhash.near_copies(weird.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [2, 2048])
def test_links_span_all_pairs_within_three_bits(spark, bucket):
    r = random.Random(bucket)
    base = [r.getrandbits(64) for _ in range(12)]
    fps = {b ^ sum(1 << k for k in r.sample(range(64), r.randint(0, 3))) for b in base for _ in range(25)} | {base[0] ^ x for x in range(64)}
    want = plain_components(fps)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    d = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    edges = simhash.links(d, bucket)
    got = {r.node & (2**64 - 1): r.root for r in simhash.components(edges).collect()}
    for a in fps:
        for b in (x for x in fps if x > a):
            assert (want[a] == want[b]) == (got.get(a, a) == got.get(b, b))


def test_components_of_a_long_chain(spark):
    d = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101)], "a long, b long")
    got = dict(rows(simhash.components(d)))
    assert all(got[i] == 0 for i in range(61)) and got[101] == 100


# chat ----------------------------------------------------------------------


def test_chat_round_trip(spark):
    odd = "</s>[INST] <|im_end|>\n<|im_start|>user\n\\ \\| <s> [/INST] é😀"
    t = [(1, 1, "assistant", odd), (1, 0, "user", odd), (1, None, "assistant", "late"), (2, 0, None, None), (None, 0, "assistant", ""), (3, 0, "a<|b\\", "x"), (1, 1, "assistant", odd)]
    d = spark.createDataFrame(t, "conv_id long, turn long, role string, text string").withColumn("k", F.lit(1)).withColumn("formatted", F.lit("x"))
    chunks = chat.formatted(d)
    assert all(chat.START not in chat.unescaped("") for _ in [0])
    got = {r.conv_id: r for r in chat.read_back(chunks).collect()}
    turns = [("user", odd), ("assistant", odd), ("assistant", odd), ("assistant", "late")]
    assert got[1].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
    said = odd + odd + "late"
    assert (got[1].n_turns, got[1].loss_chars, got[1].loss_sha256) == (4, len(said), hashlib.sha256(said.encode()).hexdigest())
    assert got[2].loss_sha256 == hashlib.sha256(b"").hexdigest() and got[None].n_turns == 1
    assert got[3].turns_sha256 == hashlib.sha256(b"a<|b\\\nx\n").hexdigest()
    assert chat.chats(d.limit(0)).count() == 0


def test_control_strings_never_survive_in_texts():
    for s in ("<|im_start|>", "<|im_end|>", "</s>", "<s>", "[INST]", "[/INST]", "\\<|", "\\\\</s>"):
        e = s
        for a, b in chat.ESCAPES:
            e = e.replace(a, b)
        assert chat.unescaped(e) == s and not any(c in e for c in ("<|", "</s>", "<s>", "[INST]", "[/INST]"))


# pieces --------------------------------------------------------------------


def test_pieces_equal_the_library(spark, weird):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=queries.model_file())
    codec = pieces.Codec(queries.model_file())
    r = random.Random(4)
    texts = ["".join(r.choice("aab the in\n ▁\x00é漢字１,.<0xA>😀") for _ in range(r.randint(0, 60))) for _ in range(800)]
    texts += [" " * 3000, "ab" * 1500, "a" * 2500, "\n" * 50, "</s><s>", "x▁y  z"]
    got = codec.encode(texts)
    assert got == [model.encode(t) for t in texts]
    assert [codec.decode(g) for g in got] == [model.decode(g) for g in got]
    for row in pieces.encoded(weird, queries.model_file()).collect():
        text = {x.doc_id: x.text or "" for x in weird.collect()}[row.doc_id]
        ids = model.encode(text)
        assert row.ids == ids and row.n_tokens == len(ids) and row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(model.decode(ids).encode()).hexdigest()


# secrets -------------------------------------------------------------------


def plain_secrets(text):
    out = [(m.start(), m.end(), "assign") for m in secrets.ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), m.end(), "access") for m in secrets.ACCESS.finditer(text) if len(m[0]) >= 16]
    out += [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[0], secrets.KINDS.index(s[2])))


def test_secret_base_spans():
    r = random.Random(6)
    parts = ["password", "Token", "api_key", "APIKEY", "ſecret", "=", ":", " ", '"', "'", "AKIA", "ABCD1234ABCD", "0123456789abcdef", "deadbeef" * 4, "xyz/+_.-", "\n", "é"]
    for _ in range(1500):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 14)))
        assert secrets.base_spans(text) == plain_secrets(text), text


def test_random_strings_are_found_and_prose_is_not(spark, weird):
    r = random.Random(8)
    key = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(n))
    docs = [(i, f"the words {key(56)} and more") for i in range(60)] + [(100 + i, "internationalisierungsmassnahmen und donaudampfschifffahrtsgesellschaft " * 3) for i in range(60)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    got = secrets.secrets(d, F.col("doc_id")).collect()
    found = {x.kept: len(x.found) for x in got}
    assert sum(found[i] == 1 for i in range(60)) >= 54 and all(found[100 + i] == 0 for i in range(60))
    out = secrets.redacted(weird)
    assert out.columns == weird.columns and out.count() == 11 and secrets.redacted(weird.limit(0)).count() == 0
    assert secrets.masked("ab secret cd", [(3, 9), (5, 8)]) == "ab [SECRET] cd"


def test_few_short_keys_among_many_long_words_are_found(spark):
    r = random.Random(21)
    key = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
    parts = ["inter", "national", "Handler", "factory", "wort", "schaft", "ungen", "Manager", "element", "config", "/usr", "_name", "station", "donau", "Request"]
    words = []
    while len(words) < 8000:
        w = "".join(r.choice(parts) for _ in range(5))
        words += [w] if len(w) >= 20 else []
    docs = [(i, " ".join(words[20 * i : 20 * i + 20])) for i in range(400)]
    docs += [(1000 + i, f"see {key(20 + i % 12)} there") for i in range(60)]
    found = {x.kept: len(x.found) for x in secrets.secrets(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id")).collect()}
    assert sum(found[1000 + i] == 1 for i in range(60)) >= 54
    assert sum(found[i] for i in range(400)) <= 2


def test_chances_of_the_battery_are_even_for_random_runs():
    r = random.Random(2)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    for n in (16, 24, 40, 80):
        p = [secrets.cauchy(list(secrets.battery("".join(r.choice(alphabet) for _ in range(n)), alphabet))) for _ in range(1500)]
        assert np.mean(p) < 1 and np.mean(np.array(p) < 0.05) < 0.09, n
    assert secrets.cauchy([0.3, 0.3, 0.3]) == pytest.approx(0.3) and secrets.cauchy([1e-12, 0.5, 0.5]) == pytest.approx(3e-12, rel=1e-3)
    assert secrets.chance("AbAbAbAbAbAbAbAbAbAbAbAb") > 1e6 * secrets.chance("".join(r.choice(alphabet) for _ in range(24)))


def test_false_discoveries_are_controlled_at_every_length(spark):
    """Keys of 12 to 64 characters among generated writing: few lost where long, at most the level's share wrong."""
    r = random.Random(33)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    parts = ["inter", "national", "Handler", "factory", "wort", "schaft", "ungen", "Manager", "element", "config", "station", "donau", "Request", "2024", "v2"]
    write = lambda: "".join(r.choice(parts) for _ in range(r.randint(2, 9)))
    sizes = [12, 16, 20, 24, 32, 48, 64]
    docs = [(i, " ".join(write() for _ in range(30))) for i in range(400)]
    docs += [(1000 + i, "key " + "".join(r.choice(alphabet) for _ in range(sizes[i % 7])) + " end") for i in range(210)]
    found = {x.kept: len(x.found) for x in secrets.secrets(spark.createDataFrame(docs, "doc_id long, text string"), F.col("doc_id")).collect()}
    right, wrong = sum(found[1000 + i] == 1 for i in range(210)), sum(found[i] for i in range(400))
    assert wrong <= 0.03 * (right + wrong)
    assert all(sum(found[1000 + i] == 1 for i in range(210) if sizes[i % 7] == n) >= 26 for n in sizes[2:])


def test_secrets_in_very_long_texts(spark):
    key = "q7Zr0pVbX3mKd9TtL2yWc8NfHs5G"
    text = "word and more " * 60000 + key + " " + "x" * 200000 + " " + "-" * 100000
    got = secrets.secrets(spark.createDataFrame([(1, text), (2, key), (3, key + " " + key)], "doc_id long, text string"), F.col("doc_id")).collect()
    assert {x.kept: len(x.found) for x in got} == {1: 1, 2: 1, 3: 2}


# personal data -------------------------------------------------------------


def plain_pii(text):
    out = [(m.start(), m.end(), "email") for m in pii.EMAIL.finditer(text)]
    out += [(m.start(), m.end(), "ip") for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    digits = lambda s: re.sub("[^0-9]", "", s)

    def luhn(d):
        t = [int(c) for c in d][::-1]
        return (sum(t[::2]) + sum(sum(divmod(2 * x, 10)) for x in t[1::2])) % 10 == 0

    out += [(m.start(), m.end(), "card") for m in pii.CARD.finditer(text) if 16 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(m.start(), m.end(), "phone") for m in pii.PHONE.finditer(text) if 8 <= len(digits(m[0])) <= 15]
    return out


def test_pii_base_spans():
    r = random.Random(9)
    parts = ["a", "b.c", "@", "x-y", ".com", "_", "a@b.c_d@e.f", "1.2.3.4.5", " ", "\n", "+", "1", "12", "255", "4111 1111 1111 1111", "4111111111111111", "(", ")", "-", ".", "é", "@@"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 16)))
        assert pii.base_spans(text) == plain_pii(text), text


@pytest.fixture(scope="module")
def model():
    return pii.trained(pii.made_windows(pii.MADE))


def test_tagger_gradients():
    m = Tagger(5)
    r = np.random.default_rng(1)
    x, y = r.integers(0, 90, (6, 2)), r.integers(0, 5, (6, 2))
    _, g = m.gradients(x, y)
    for k in m.w:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        keep = m.w[k][at]
        loss = []
        for e in (0.01, -0.01):
            m.w[k][at] = keep + e
            loss.append(m.gradients(x, y)[0])
        m.w[k][at] = keep
        assert isclose((loss[0] - loss[1]) / 0.02, float(g[k][at]), rel_tol=0.05, abs_tol=1e-3), k


def test_model_finds_held_out_spans(spark, weird, model):
    made = pii.made_windows(300, 3)
    hit = wrong = missed = 0
    for text, spans in made:
        got = set(pii.model_spans(model, [text], [[]])[0])
        whole = {s for s in spans if s[0] > 0 and s[1] < len(text)}
        hit += len(got & set(spans))
        wrong += len(got - set(spans))
        missed += len(whole - got)
    assert hit / (hit + wrong) > 0.8 and hit / (hit + missed) > 0.75
    assert pii.personal(weird, model).count() == 11 and pii.personal(weird.limit(0), model).count() == 0
    long = "word " * 4000 + "jo.th12 [at] example [dot] com" + " word" * 4000
    assert pii.model_spans(model, [long], [[]])[0] == [(20000, 20030, "email")]


def test_best_labels_equal_enumeration():
    r, m, ok = np.random.default_rng(6), Tagger(pii.TAGS), pii.allowed()
    m.w["A"], m.w["a0"] = r.normal(size=(9, 9)).astype(np.float32), r.normal(size=9).astype(np.float32)
    em = r.normal(size=(4, 6, 9)).astype(np.float32)
    got = m.best(em, ok)
    for b in range(6):
        def value(y, b=b):
            if not ok[0][y[0]] or not all(ok[p][q] for p, q in zip(y, y[1:])):
                return -np.inf
            return m.w["a0"][y[0]] + sum(em[t, b, k] for t, k in enumerate(y)) + sum(m.w["A"][p][q] for p, q in zip(y, y[1:]))
        assert tuple(got[:, b]) == max(product(range(9), repeat=4), key=value)


def test_windows_of_a_stretch_give_one_label_a_character(model):
    text = "".join(f"lor nesi tam ({200 + i}) {100 + i}-{1000 + i} dire sen. " for i in range(40))
    (starts,) = pii.stretches(text)
    (tags,) = pii.stretch_labels(model, [text], [(0, starts)], pii.allowed())
    assert len(starts) > 10 and len(tags) == len(text)
    assert all(pii.allowed()[a][b] for a, b in zip(tags, tags[1:]))
    assert len(pii.model_spans(model, [text], [[]])[0]) >= 32


def test_recall_on_forms_that_training_does_not_make(model):
    """Names, hosts and endings other than the generator's, among English words."""
    r = random.Random(17)
    name = lambda: r.choice(["katherine", "oliver", "jackson", "sophia", "wright", "edwards", "thompson", "phillip", "beatrix", "schwartz", "lindqvist", "fitzgerald", "charles", "knight"])
    hit = total = 0
    for i in range(120):
        piece = [f"{name()}.{name()} [at] {name()} [dot] {r.choice(['edu', 'info', 'com'])}", f"{name()}(at){name()}.{r.choice(['edu', 'io', 'org'])}", f"({r.randrange(200, 999)}) {r.randrange(100, 999)}-{r.randrange(1000, 9999)}"][i % 3]
        text = f"please ask {name()} " * 5 + piece + f" about {name()}" * 5
        start = text.index(piece)
        total += 1
        hit += any(a <= start + 2 and b >= start + len(piece) - 2 for a, b, _ in pii.model_spans(model, [text], [[]])[0])
    assert hit / total >= 0.9, hit / total


@pytest.mark.parametrize("text", ["1" * 1_000_000, "a" * 500_000 + "@" + "b" * 500_000, "a" * 1_000_000, "1." * 500_000, "@" * 1_000_000, "+1" + "(" * 500_000, "a@" * 300_000, "a.b@c.d_" * 100_000])
def test_base_patterns_take_time_in_proportion(text):
    began = time.time()
    pii.base_spans(text)
    assert time.time() - began < 3


def test_model_needs_no_package_where_it_runs(spark, tmp_path):
    """What tasks get must load in an interpreter that does not know this package."""
    model = pii.trained(pii.made_windows(64), 1)
    tasks = cloudpickle.dumps((pii.model_spans, lm.scored_block, Tagger))
    broadcasts = pickle.dumps(model.w)
    (tmp_path / "run.py").write_bytes(b"import pickle, sys\nd = open(sys.argv[1], 'rb').read().split(b'--PART--')\nf, g, T = pickle.loads(d[0])\nm = T(9)\nm.w = pickle.loads(d[1])\nprint(len(f(m, ['a@b.c 1'], [[]])))")
    (tmp_path / "data").write_bytes(tasks + b"--PART--" + broadcasts)
    out = subprocess.run([sys.executable, "-I", "run.py", "data"], cwd=tmp_path, capture_output=True, text=True)
    assert out.stdout.strip() == "1", out.stderr


def test_address_without_digits_comes_out_of_a_long_text(model):
    addresses = ["jane.doe [at] example [dot] com", "marjo.lison [at] relan [dot] org", "thelis_son(at)marel.com", "jo.marli [at] isre [dot] net"]
    found = 0
    for a in addresses:
        text = "word " * 400 + a + " word" * 400
        assert pii.plausible("email", a) and not set(a) & set("0123456789@")
        assert any(s <= 2000 and e >= 2000 + len(a) for s, e in pii.reaches(text))
        got = pii.model_spans(model, [text], [[]])[0]
        assert set(got) <= {(2000, 2000 + len(a), "email")}
        found += len(got)
    assert found >= 3


def test_reaches_cover_every_plausible_address():
    r = random.Random(12)
    parts = ["a", "at", "AT", "dot", "x-y", ".", " ", "[", "]", "(", ")", "@", "_", "\n", "é"]
    hits = 0
    for _ in range(10000):
        text = "".join(r.choice(parts) for _ in range(r.randint(4, 12)))
        spans = [(s, e) for s in range(len(text)) for e in range(s + 1, len(text) + 1) if pii.plausible("email", text[s:e])]
        hits += bool(spans)
        covered = {p for s, e in pii.reaches(text) for p in range(s, e)}
        assert all(set(range(s, e)) <= covered for s, e in spans), text
    assert hits > 100


# language model ------------------------------------------------------------


def test_scores_against_plain_counts(spark, weird):
    docs = weird.select("doc_id", "text", "kept").unionByName(spark.range(100, 180).select(F.col("id").alias("doc_id"), F.concat(F.lit("the common words and id "), F.col("id").cast("string")).alias("text"), F.lit("x").alias("kept")))
    data = docs.collect()
    words = lambda t: (t or "").encode().lower().split()
    out = lambda i: zlib.crc32(str(i).encode() if i is not None else b"") % 10 == 0
    c = Counter(w for r in data if not out(r.doc_id) for w in [*words(r.text), b""])
    n, v = sum(c.values()), len(c)
    got = lm.scored(docs).collect()
    assert len(got) == len(data)
    want = Counter()
    for r in data:
        t = [*words(r.text), b""]
        want[(r.doc_id, out(r.doc_id), len(t), sum(c[w] > 0 for w in t), n, round(sum(log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), 4))] += 1
    assert want == Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got)
    assert all(r.score < 0 for r in got)
    common = next(r for r in got if r.doc_id == 110)
    assert common.bits_per_byte < 4
    assert lm.scored(docs.limit(0)).count() == 0


def test_chances_of_all_bytes_sum_to_one():
    words = [b"ab", b"ac", b"b", b""]
    counts = np.zeros((lm.OFFSETS[-1], 2))
    for w, k in zip(words, (5, 3, 2, 4)):
        slots, bit, _, _ = lm.contexts([w])
        for s in slots:
            np.add.at(counts, (s, bit), k)
    m = lm.Speller(counts)
    m.learn(words, np.array([5, 3, 2, 4]), 0.3)
    for start in (b"", b"a", b"zz"):
        total = 0.0
        for byte in range(256):
            slots, bit, node, _ = lm.contexts([start + bytes([byte]) if byte != 32 else start + b"\x20"])
            at = slice(8 * len(start), 8 * len(start) + 8)
            p = m.chances(slots[:, at], node[at])
            total += np.prod(np.where(bit[at] == 1, p, 1 - p))
        assert isclose(total, 1, rel_tol=1e-9)


def plain_scores(data, speller):
    """Scores text by text, with all counts of the other texts taken anew."""
    words = [[*lm.words_of(t), b""] for _, t in data]
    train = [not lm.held_out(i) for i, _ in data]
    every = sorted({w for t in words for w in t})
    code = dict(zip(every, (lm.word_hashes(pa.array([w.decode() for w in every], pa.large_string())) % lm.CODES + 1).tolist())).__getitem__
    bucket = lambda x, edges: sum(x >= e for e in edges)
    pairs = lambda t: [((t[i - 2] if i > 1 else b"", t[i - 1] if i else b""), t[i]) for i in range(len(t))]
    hits, known, parts, out = np.zeros((lm.N_HIT, 2)), np.zeros((lm.N_KNOWN, 2)), [], []
    follow_all, count_all = {}, Counter()
    for t, k in zip(words, train):
        if k:
            count_all.update(t)
            for c, w in pairs(t):
                follow_all.setdefault(c, Counter())[code(w)] += 1
    for t, k in zip(words, train):
        own, own_count = {}, Counter(t) if k else Counter()
        for c, w in pairs(t) if k else []:
            own.setdefault(c, Counter())[code(w)] += 1
        status, flags, least, states, fixed, plain = [], [], [], [], 0.0, 0
        run = 0
        for c, w in pairs(t):
            best = sorted(follow_all.get(c, Counter()).items(), key=lambda x: (-x[1], x[0]))[:2]
            total = sum(follow_all.get(c, Counter()).values()) - sum(own.get(c, Counter()).values())
            left = [(n - own.get(c, Counter())[f], f) for f, n in best]
            sure, guess = max(left, key=lambda x: x[0], default=(0, 0))
            n = count_all[w] - own_count[w]
            at = lambda x, i: x[-i] if len(x) >= i else 0
            ago = bucket(at(least, 1), [1, 2, 8, 64, 4096])
            met, hit = sure > 0, sure > 0 and guess == code(w)
            if met:
                place = (bucket(run, [1, 2, 3, 4, 8, 16, 32]), bucket(total, [2, 3, 5, 9, 17]), bucket(sure / total, [0.5, 0.75, 1.0]), at(status, 1) * 9 + at(status, 2) * 3 + at(status, 3), ago)
                states.append((hits, np.ravel_multi_index(place, lm.HITS), int(hit)))
            if not hit:
                place = (at(flags, 1) * 4 + at(flags, 2) * 2 + at(flags, 3), int(met), ago, int(run > 0))
                states.append((known, np.ravel_multi_index(place, lm.KNOWN), int(n > 0)))
                if n:
                    fixed += log10(n)
                    plain += 1
                else:
                    fixed += speller.score([w])[0]
            status.append(2 if hit else int(met))
            flags.append(int(n > 0))
            least.append(n)
            run = run + 1 if hit else 0
        if k:
            for h, s, y in states:
                h[s, y] += 1
        parts.append((states, fixed, plain, sum(count_all.values()) - (len(t) if k else 0)))
    a, b = lm.mixed_states(hits, lm.HITS), lm.mixed_states(known, lm.KNOWN)
    for states, fixed, plain, others in parts:
        out.append(fixed - plain * log10(max(1, others)) + sum((a if h is hits else b)[s, y] for h, s, y in states))
    return out


def test_scores_equal_a_plain_version_whatever_the_partitions(spark):
    r = random.Random(4)
    words = ["".join(r.choice("abcde") for _ in range(r.randint(1, 5))) for _ in range(60)]
    data = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60)))) for i in range(80)]
    data += [(200 + i, data[i][1]) for i in range(20)] + [(300, "x" * 3000 + " " + "y z " * 2000), (None, "a b"), (301, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    _, speller = lm.spelling(docs)
    speller = lm.Speller(np.stack([speller.zero, speller.one], 1).astype(np.float32), speller.weights, speller.hits)
    want = sorted((str(i), round(s, 6)) for (i, _), s in zip(data, plain_scores(data, speller)))
    assert sorted((str(x.doc_id), round(x.score, 6)) for x in lm.scored(docs).collect()) == want
    assert sorted((str(x.doc_id), round(x.score, 6)) for x in lm.scored(docs.repartition(7)).collect()) == want


def test_speller_is_trained_on_all_distinct_words(spark):
    ids = [i for i in range(1, 200) if not lm.held_out(i)][:70]
    texts = [" ".join(f"w{n}" for n in range(100 * k, 100 * k + 100)) for k in range(len(ids))]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    tokens, speller = lm.spelling(docs.repartition(5))
    assert tokens == 70 * 101
    bits = 8 * sum(len(f"w{n} ") for n in range(7000)) + 8
    assert speller.hits.sum() == 2 * bits  # three passes, the first of them forgotten
    again = lm.spelling(docs.repartition(3))[1]
    assert (again.weights == speller.weights).all() and (again.hits == speller.hits).all()


def test_order_and_copies_matter_and_held_out_texts_beat_the_base(spark):
    r = random.Random(14)
    vocab = ["".join(r.choice(["an", "re", "th", "on", "el", "mar"]) for _ in range(r.randint(1, 4))) for _ in range(900)]
    text = lambda: " ".join(r.choice(vocab) for _ in range(80))
    fluent = [text() for _ in range(30)]
    data = [(i, f"{r.choice(fluent)} {text()} {r.choice(fluent)}") for i in range(300)]
    first = next(i for i in range(1000, 2000) if lm.held_out(i))
    shuffled = fluent[0].split()
    r.shuffle(shuffled)
    docs = spark.createDataFrame([*data, (first, fluent[0]), (next(i for i in range(first + 1, 3000) if lm.held_out(i)), " ".join(shuffled))], "doc_id long, text string")
    got = {x.doc_id: x for x in lm.scored(docs).collect()}
    held = [x for x in got.values() if x.held_out and x.doc_id < 1000]
    assert sum(x.score for x in held) > sum(x.base_score for x in held)
    a, b = (got[k] for k in sorted(got) if k >= 1000)
    assert a.bits_per_byte < 0.5 * b.bits_per_byte and a.base_score == pytest.approx(b.base_score)


# search --------------------------------------------------------------------


def test_top_k_is_exhaustive(spark):
    r = random.Random(2)
    data = [(i, [round(r.uniform(-1, 1), 1) for _ in range(6)]) for i in range(230)] + [(300, None), (400, [1.0, None]), (500, [float("nan")]), (200, [0.5] * 6), (None, [1.0]), (600, []), (601, [1.0, 2.0])]
    d = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("score", F.lit("x"))
    got = rows(topk.top_k(d, F.col("vec_id") % 100 == 0, 10).where("query_id in (0, 100, 600)").select("query_id", "rank", "vec_id", "score"))
    q = lambda e: [int(np.floor(1024 * float(np.float32(x)))) for x in e]
    fine = [(i, q(e)) for i, e in data if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    want = []
    for qi in (0, 100, 600):
        v = max(e for i, e in fine if i == qi)
        s = sorted(((-sum(a * b for a, b in zip(v, e)), i) for i, e in fine if i != qi))[:10]
        want += [(qi, k + 1, i, -x) for k, (x, i) in enumerate(s)]
    assert got == sorted(want, key=repr)
    assert topk.top_k(d.limit(0), F.col("vec_id") % 100 == 0).count() == 0


# archives ------------------------------------------------------------------


def test_archive_round_trip_and_lookup(spark, tmp_path, monkeypatch):
    pages = [(5, "http://a.example.com/x", "same"), (3, "https://b.example.com:8080/y z\n", "same"), (9, None, None), (8, "not a url", ""), (None, "http://a.example.com/x", "same"), (7, "http://a.example.com/x", "é😀" * 50), (7, "http://a.example.com/x", "é😀" * 50)]
    pages += [(1000 + i, f"http://h{i % 7}.example.org/p?i={i}", f"page {i % 50}") for i in range(700)]
    d = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("h", F.lit(1)).withColumn("key", F.lit(2))
    got = warc.archived(d).collect()
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = Counter()
    for i, _, h in pages:
        data = (h or "").encode()
        f = first.get(h or "")
        back = f if f is not None and f != i else None
        want[(i, len(data), warc.digest(data), "revisit" if back is not None else "response", back)] += 1
    assert Counter(map(tuple, got)) == want
    assert warc.archived(d.limit(0)).count() == 0
    root = f"file://{tmp_path}/w"
    top = warc.indexed(warc.archive(d, root), root)
    index = warc.Index(top, root)
    found = index.find(warc.reversed_host("http://a.example.com/x"), 7)
    assert len(found) == 2 and index.read(found[0])["payload"].decode() == "é😀" * 50
    assert index.find("zzz", 1) == [] and index.find("", 9) != []


def test_reversed_host():
    assert warc.reversed_host("HTTP://M.Example.com:80/a?b#c") == "com,example,m)/a?b"
    assert warc.reversed_host("http://[bad/") == "http://[bad/" and warc.reversed_host(None) == ""


def test_components_in_one_task_and_by_rounds_agree(spark):
    r = random.Random(8)
    links = [(r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5, 5)]
    edges = spark.createDataFrame(links, "a long, b long")
    got = simhash.components(edges)
    assert got.rdd.getNumPartitions() == 1  # one task, no rounds of shuffles
    assert rows(got) == rows(simhash.components(edges, local=0))
    assert rows(simhash.components(edges.where("a = b"))) == []


def test_scored_texts_are_kept_in_little_space(spark, monkeypatch):
    """What is kept of each text between scoring and its sums: 7654 bytes here, 30840 as plain columns."""
    r = random.Random(12)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(300)]
    data = [(i, " ".join(r.choice(words) for _ in range(400)), "en", "s") for i in range(100)]
    kept, cut = [], lm.cut

    def seen(df):
        kept.append(cut(df))
        return kept[-1]

    monkeypatch.setattr(lm, "cut", seen)
    got = lm.scored(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()
    size = lambda v: len(v) if isinstance(v, (bytes, bytearray)) else 4 * len(v) if isinstance(v, list) else 8
    assert len(got) == 100 and sum(x.n_tokens for x in got) == 100 * 401
    assert sum(size(v) for row in kept[-1].collect() for v in row) < 15_000
