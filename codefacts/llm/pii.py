"""Personal data by rules and a character-level BiLSTM-CRF (operator 2).

Base spans follow fixed patterns.  The model is trained in numpy from labelled
spans: windows around the base spans of a bounded sample of documents (about
``SAMPLE`` documents by hash of their id, at most ``WINDOWS`` windows), and
``MADE`` generated windows with forms that the patterns miss, such as spelled
out at signs, phone numbers without a plus or cards with other separators, next
to numbers that are none of these.

Texts are read whole in windows of ``WIDTH`` characters that overlap by half.
A span counts only if it is ``plausible``, which needs digits, or an at sign or
"at" with a dot or "dot" after it.  Windows on such places, over all that a
plausible address can reach around them (``reaches``), are computed; in the
others no span can pass that test.
Windows that overlap are reconciled as one stretch: each character's scores are
the mean over its windows, weighted by its distance from their edges, and one
search for the best label sequence goes over the whole stretch, so the CRF's
transitions hold across window borders too.  A span of the model must still
look like its kind (number of digits, Luhn's test, address parts, ``LONGEST``)
and is dropped where it touches a base span.

The labelled sample is bounded by ``SAMPLE`` documents, by hash of their id, at
most eight windows of each, ``WINDOWS`` in all; it only fits the model.

Defined cases: null text is empty; repeated rows give repeated results; offsets
are code points, ends exclusive; other columns are ignored; without documents to
learn from the generated windows remain; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import ship
from codefacts.llm.tagger import PAD, Tagger, char_ids

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: The same matches in time proportional to the text: an address is looked for around each at sign, and a run of digits is tried from its beginning only.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP_RUN = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
DIGIT = re.compile("[0-9]")
TRIGGER = re.compile("[0-9@]")
#: What every plausible address holds: its at sign, spelled or not, one more part and a dot, spelled or not.
CORE = re.compile(r"(?=(?:@|at|AT)[\])]?\s?[A-Za-z0-9-]+\s?[\[(]?(?:\.|dot|DOT)[\])]?\s?([A-Za-z0-9-]))")
#: From there as far as an address can go on.
WAY = re.compile(r"(?:@|at|AT)[\])]?\s?[A-Za-z0-9-]*(?:(?:(?<=dot)|(?<=DOT)|\s?[\[(]?(?:\.|dot|DOT))[\])]?\s?[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Longest spans of the model that can be of their kind.
LONGEST = {"email": 254, "ip": 40, "card": 60, "phone": 40}
WIDTH, HOP = 64, 32
SAMPLE, WINDOWS, MADE = 1500, 1500, 4000
TAGS = 1 + 2 * len(KINDS)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the fixed patterns, by kind as listed, then start."""
    out: list[tuple[int, int, str]] = []
    at = done = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            out.append((start, m.end(), "email"))
            done = m.end()
        at = done = max(at + 1, done)
    if DIGIT.search(text):
        out += [(m.start(), m.end(), "ip") for m in IP_RUN.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        out += [(m.start(), m.end(), "card") for m in CARD.finditer(text) if 16 <= len(d := only_digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 8 <= len(only_digits(m[0])) <= 15]
    return out


def plausible(kind: str, s: str) -> bool:
    """Whether a span of the model can be of its kind."""
    if len(s) > LONGEST[kind]:
        return False
    d = only_digits(s)
    if kind == "email":
        return bool(re.fullmatch(r"[A-Za-z0-9._%+-]+\s?[\[(]?(@|at|AT)[\])]?\s?[A-Za-z0-9-]+(\s?[\[(]?(\.|dot|DOT)[\])]?\s?[A-Za-z0-9-]+)+", s))
    if kind == "ip":
        parts = re.split(r"\[?\.\]?|\s?\(dot\)\s?", s)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 4 and int(p) < 256 for p in parts)
    if kind == "card":
        return 15 <= len(d) <= 19 and luhn(d) and len(s) <= 2 * len(d)
    return 7 <= len(d) <= 15 and not re.search(r"[A-Za-z]", s) and (s[0] in "+(0" or bool(re.search(r"[0-9][-. ()]+[0-9]{3,}", s)))


def reaches(text: str) -> list[tuple[int, int]]:
    """(start, end) of every place where a plausible span can be: digits and at signs, and the whole length of possible addresses."""
    out = [(m.start(), m.end()) for m in TRIGGER.finditer(text)]
    last = end = 0
    for m in CORE.finditer(text):
        at = s = m.start()
        s -= text[s - 1 : s] in ("[", "(")
        s -= text[s - 1 : s].isspace() if s else 0
        while s > last and text[s - 1] in LOCAL:
            s -= 1
        if m.end(1) > end and (w := WAY.match(text, at)):
            end = max(end, w.end())
        out.append((s, max(end, m.end(1))))
        last = at
    return out


def window_starts(text: str) -> list[int]:
    """Starts of the windows over all reaches and a character on both sides."""
    blocks: set[int] = set()
    for s, e in reaches(text):
        blocks.update(range(max(0, s - 1) // HOP - 1, e // HOP + 1))
    return sorted({max(0, w) * HOP for w in blocks})


def _word(rng: random.Random) -> str:
    """A pronounceable word of any letters, or of common syllables."""
    if rng.random() < 0.3:
        return "".join(rng.choice(["an", "re", "th", "on", "is", "el", "mar", "jo", "li", "son"]) for _ in range(rng.randint(1, 3)))
    return "".join(rng.choice("bcdfghjklmnpqrstvwxyz") + rng.choice("aeiouy") + rng.choice(["", "", rng.choice("nrslt")]) for _ in range(rng.randint(1, 4)))


def _generated(rng: random.Random) -> tuple[str, str, str]:
    """(piece, kind or empty, sort of form): forms of personal data that the patterns miss or find, and numbers that are none."""
    word = lambda: _word(rng)
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    sort = rng.randrange(12)
    if sort < 3:
        at, dot = rng.choice([("@", "."), (" [at] ", " [dot] "), (" [at] ", " [dot] "), ("(at)", "."), ("(at)", "(dot)"), (" @ ", "."), ("[at]", "[dot]"), ("[at]", ".")])
        tail = lambda n: num(rng.randint(1, n)) if rng.random() < 0.5 else ""
        return f"{word()}{rng.choice(['.' + word(), '', '_' + word()])}{tail(2)}{at}{word()}{tail(1)}{dot}{rng.choice(['com', 'org', 'net', 'example' + dot + 'com', ''.join(rng.choice('abcdefghiklmnoprstu') for _ in range(rng.randint(2, 4)))])}", "email", "e"
    if sort < 5:
        dot = rng.choice([".", ".", "[.]", "(dot)"])
        return dot.join(str(rng.randrange(256)) for _ in range(4)), "ip", "i"
    if sort < 7:
        d = rng.choice("3456") + num(rng.choice([14, 15]))
        d = next(d[:-1] + c for c in "0123456789" if luhn(d[:-1] + c))
        sep = rng.choice(["", " ", "-", ".", "_"])
        return sep.join(d[i : i + 4] for i in range(0, len(d), 4)), "card", "c"
    if sort < 9:
        return rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"+{num(1)} ({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(6)}", f"0{num(3)} {num(7)}"]), "phone", "p"
    if sort == 9:
        d = num(16)
        return (d if not luhn(d) else d[:-1] + str((int(d[-1]) + 1) % 10)), "", "n"
    return rng.choice([f"{num(1)}.{num(1)}", f"20{num(2)}-0{num(1)}-1{num(1)}", f'token = "{num(8)}ab{num(6)}ef{num(12)}"', f"{num(3)}", f"v{num(1)}.{num(1)}.{num(1)}", f"@{word()}", f"http://{word()}.com/{num(3)}?page={num(1)}", f"{word()} at {word()}. {word()}", f"th{rng.choice(['at', 'at is'])} {word()}. {word()}"]), "", "o"


def made_windows(n: int, seed: int = 5) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Generated (window, labelled spans) between words of nonsense."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WIDTH:
            plain = lambda: _word(rng) if rng.random() < 0.5 else "".join(rng.choice("etaoinshrdluéñ") for _ in range(rng.randint(1, 9)))
            text += " ".join(plain() for _ in range(rng.randint(1, 6))) + rng.choice([" ", " ", ". ", ": "])
            piece, kind, _ = _generated(rng)
            if kind:
                spans.append((len(text), len(text) + len(piece), kind))
            text += piece + rng.choice([" ", " ", ".", ", ", "\n"])
        at = rng.randrange(max(1, len(text) - WIDTH))
        out.append((text[at : at + WIDTH], [(max(0, s - at), min(WIDTH, e - at), k) for s, e, k in spans if s - at < WIDTH and e > at]))
    return out


def labels(n: int, spans: list[tuple[int, int, str]]) -> np.ndarray:
    """One label a character: 0 outside, 1 + 2 k at the beginning of kind k, 2 + 2 k inside it."""
    y = np.zeros(n, np.int64)
    for s, e, kind in spans:
        k = KINDS.index(kind)
        y[s:e] = 2 + 2 * k
        y[s : s + 1] = 1 + 2 * k
    return y


def allowed() -> np.ndarray:
    """Which label may follow which: an inside only its own beginning or inside."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        inside = 2 + 2 * k
        ok[:, inside] = False
        ok[[inside - 1, inside], inside] = True
    return ok


def trained(windows: list[tuple[str, list[tuple[int, int, str]]]], epochs: int = 6) -> Tagger:
    x, y = np.full((len(windows), WIDTH), PAD), np.zeros((len(windows), WIDTH), np.int64)
    for i, (text, spans) in enumerate(windows):
        ids = char_ids(text)
        x[i, : len(ids)], y[i, : len(ids)] = ids, labels(len(ids), spans)
    model = Tagger(TAGS)
    model.train(x, y, epochs)
    return model


def sampled(docs: DataFrame, sample: int = SAMPLE, most: int = WINDOWS) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Windows with rule-labelled spans from a bounded sample of documents, the same at every run."""
    share = min(1.0, sample / max(1, docs.count()))
    rows = docs.select(F.xxhash64(F.col("doc_id").cast("long")).alias("o"), F.col("text").cast("string").alias("text")).where(F.pmod("o", F.lit(1 << 62)) < F.lit(int(share * (1 << 62))))

    def run(batches):
        for b in batches:
            out = []
            for o, t in zip(b.column(0).to_pylist(), b.column(1)):
                text = t.as_py() or ""
                spans = base_spans(text)
                for n, (start, _) in enumerate(sorted(reaches(text))[:8]):
                    at = max(0, start - (o + 7 * n) % 48)
                    out.append((o, n, text[at : at + WIDTH], [x for s, e, k in spans if s < at + WIDTH and e > at for x in (max(0, s - at), min(WIDTH, e - at), KINDS.index(k))]))
            cols = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64())))], ["o", "n", "window", "spans"])

    found = rows.mapInArrow(run, "o long, n long, window string, spans array<long>").orderBy("o", "n", "window").limit(most).collect()
    return [(r["window"], [(s, e, KINDS[k]) for s, e, k in zip(r["spans"][::3], r["spans"][1::3], r["spans"][2::3])]) for r in found]


def stretches(text: str) -> list[list[int]]:
    """Starts of windows that follow each other without a gap."""
    out: list[list[int]] = []
    for s in window_starts(text):
        if out and s <= out[-1][-1] + HOP:
            out[-1].append(s)
        else:
            out.append([s])
    return out


def stretch_labels(model: Tagger, texts: list[str], places: list[tuple[int, list[int]]], ok: np.ndarray, batch: int = 2048) -> list[np.ndarray]:
    """Best labels of stretches (text, starts of their windows): one search over each stretch's joined scores."""
    windows = [(p, i, s) for p, (i, starts) in enumerate(places) for s in starts]
    sizes = np.array([min(len(texts[i]), starts[-1] + WIDTH) - starts[0] for i, starts in places], np.int64)
    offsets = np.cumsum(sizes) - sizes
    scores, mass = np.zeros((int(sizes.sum()), TAGS), np.float32), np.zeros(int(sizes.sum()), np.float32)
    edge = (np.minimum(np.arange(WIDTH), np.arange(WIDTH)[::-1]) + 1).astype(np.float32)
    for at in range(0, len(windows), batch):
        part = windows[at : at + batch]
        x = np.full((len(part), WIDTH), PAD)
        for r, (_, i, s) in enumerate(part):
            ids = char_ids(texts[i][s : s + WIDTH])
            x[r, : len(ids)] = ids
        em = model.emissions(x.T).transpose(1, 0, 2)
        for r, (p, i, s) in enumerate(part):
            start, n = offsets[p] + s - places[p][1][0], min(WIDTH, len(texts[i]) - s)
            scores[start : start + n] += em[r, :n] * edge[:n, None]
            mass[start : start + n] += edge[:n]
    scores /= mass[:, None]
    out: list[np.ndarray] = [np.empty(0, np.int8)] * len(places)
    order = np.argsort(sizes, kind="stable")
    for at in range(0, len(order), batch):
        part = order[at : at + batch]
        for size in np.unique(sizes[part]):
            same = part[sizes[part] == size]
            best = model.best(np.stack([scores[offsets[p] : offsets[p] + size] for p in same], 1), ok)
            for c, p in enumerate(same):
                out[p] = best[:, c]
    return out


def model_spans(model: Tagger, texts: list[str], bases: list[list[tuple[int, int, str]]]) -> list[list[tuple[int, int, str]]]:
    """The model's spans of whole texts, by kind as listed, then start; spans that touch a base span are dropped."""
    places = [(i, starts) for i, text in enumerate(texts) for starts in stretches(text)]
    out: list[list[tuple[int, int, str]]] = [[] for _ in texts]
    for (i, starts), tags in zip(places, stretch_labels(model, texts, places, allowed())):
        text, first = texts[i], starts[0]
        begins = np.flatnonzero(tags % 2 == 1)
        outside = np.flatnonzero(np.r_[tags % 2 == 1, True] | np.r_[tags == 0, True])
        for s in begins.tolist():
            e = int(outside[np.searchsorted(outside, s, side="right")])
            span, kind = (first + s, first + e), KINDS[(int(tags[s]) - 1) // 2]
            a, b = span
            if plausible(kind, text[a:b]) and not text[max(0, a - 1) : a].isalnum() and not text[b : b + 1].isalnum() and not any(x < b and a < y for x, y, _ in bases[i]):
                out[i].append((a, b, kind))
    return [sorted(x, key=lambda x: (KINDS.index(x[2]), x[0])) for x in out]


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def personal(docs: DataFrame, model: Tagger | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_model) for every row."""
    if model is None:
        model = trained(sampled(docs) + made_windows(MADE))
    weights = docs.sparkSession.sparkContext.broadcast(model.w)  # some thousand numbers; a broadcast object would need this package where it is read

    def run(batches):
        tagger = Tagger(TAGS)
        tagger.w = weights.value
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                b = whole.slice(at, 512)
                texts = [t or "" for t in b.column(1).to_pylist()]
                bases = [base_spans(t) for t in texts]
                more = model_spans(tagger, texts, bases)
                order = lambda s: (KINDS.index(s[2]), s[0])
                counts = [[sum(k == kind for _, _, k in x) for x in bases] for kind in KINDS]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array([hashlib.sha256(joined(x).encode()).hexdigest() for x in bases], pa.string()), pa.array([joined(sorted(x + y, key=order)) for x, y in zip(bases, more)], pa.string()), pa.array([len(y) for y in more], pa.int64())],
                    ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_model"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_model long")


ship(__name__)
