"""Secret scans with a battery of randomness tests (operator 8).

Base patterns (assignments, access keys, long hexadecimal runs) give spans by
rule.  Beyond them, every run of ``FEWEST`` or more key characters that no base
span touches is a candidate.  Its encoding is inferred from the characters it
uses, and it is tested

* for uniformity: the number of equal pairs among its n characters, which is
  Pearson's chi-squared over the alphabet up to scale (X^2 = k + 2 k U / n - n);
* by a runs test of characters above and below the alphabet's middle;
* by the serial correlation of neighbouring characters.

The three chances are combined by the Cauchy combination into one chance p that
random draws look no more even than the run.  Short runs pass such tests for
want of power, so the hypothesis to reject is ordinary writing, which keeps to a
class of characters (small, capital, digit, sign) for a while and uses letters
as texts do.  The likelihood ratio of uniform draws to writing, times p, has a
mean of at most one under writing (p's mean under uniform draws is below one),
so by Markov's inequality the chance of so much evidence is at most its inverse,
times the number of alphabets to choose from.  A run that the battery rejects has
a small p and so needs as much more evidence; one with a chance below 1e-15 is none.

These chances enter a Benjamini-Hochberg control at ``FDR`` over all documents,
in strata of length, from a histogram of fixed size, so short strings need
stronger evidence by themselves and do not borrow from long ones.

Defined cases: null text is empty; repeated rows give repeated results; offsets
are code points, ends exclusive; other columns are ignored, or carried in a
struct; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import cut, ship

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Runs below this length can hardly hold the evidence that the control asks for: 12 random characters have some 70 bits, prose words of that length about as many.
FEWEST = 12
RUN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % FEWEST)
FDR = 0.01
#: First lengths of the strata.
STRATA = (12, 16, 20, 24, 32, 48, 64, 128)
#: Chances are counted in bins of a quarter of a power of ten.
BINS, STEP = 80, 4
#: Shares of letters in texts, in thousandths, a to z; a tenth of the mass is spread evenly, for other languages and names.
LETTERS = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)
LETTER_BITS = {chr(97 + i): -math.log2(0.9 * x / sum(LETTERS) + 0.1 / 26) for i, x in enumerate(LETTERS)}
#: Chance that writing changes to another class of characters, one of three.
CHANGE = 0.1
#: Alphabets that ``encoding`` chooses from.
ALPHABETS = 12
#: Evidence of fewer bits lies in the lowest bin, which the control never lets through: its chance times all tested exceeds any share of them.
LEAST_BITS = 0.5


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by the fixed patterns, by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(h in low for h in HINTS):
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def encoding(s: str) -> tuple[str, bool] | None:
    """The alphabet that a run seems to be written in and whether it is hexadecimal; none for numbers."""
    s = s.rstrip("=")
    kinds = {"d" if "0" <= c <= "9" else "l" if "a" <= c <= "z" else "u" if "A" <= c <= "Z" else "+" for c in set(s)}
    if not kinds - {"d", "+"}:
        return None
    digits, lower, upper = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    for case, letters in (("l", lower), ("u", upper)):
        if kinds <= {"d", case} and set(s) <= set(digits + letters[:6]):
            return digits + letters[:6], True
        if kinds == {case}:
            return letters, False
        if kinds == {"d", case}:
            return ("234567" + letters if not set(s) & set("0189") else digits + letters), False
    if kinds == {"l", "u"}:
        return upper + lower, False
    return upper + lower + digits + ("" if "+" not in kinds else "-_" if set(s) & set("-_") else "+/"), False


def _normal(z: float) -> float:
    """P(Z <= z)."""
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _poisson(u: int, mean: float) -> float:
    """P(X <= u)."""
    if u < 0:
        return 0.0
    if mean > 500:
        return _normal((u + 0.5 - mean) / math.sqrt(mean))
    term = total = math.exp(-mean)
    for i in range(1, u + 1):
        term *= mean / i
        total += term
        if i > mean and term < 1e-18:
            break
    return min(1.0, total)


def _kind(c: str) -> str:
    return "d" if "0" <= c <= "9" else "l" if "a" <= c <= "z" else "u" if "A" <= c <= "Z" else "+"


#: Class and bits of every key character as writing.
WRITTEN = {c: (_kind(c), math.log2(10) if _kind(c) == "d" else 2.0 if _kind(c) == "+" else LETTER_BITS[c.lower()]) for c in map(chr, range(33, 127))}
STAY, MOVE = -math.log2(1 - CHANGE), -math.log2(CHANGE / 3)


def writing_bits(s: str) -> float:
    """Bits that a run takes as ordinary writing; its first class costs nothing, which favours writing."""
    bits, before = 0.0, None
    for now, more in map(WRITTEN.__getitem__, s):
        bits += more if before is None else more + (STAY if now == before else MOVE)
        before = now
    return bits


def cauchy(chances: list[float]) -> float:
    """One chance from several that may depend on each other."""
    t = sum(math.tan((0.5 - min(1 - 1e-12, max(1e-300, p))) * math.pi) if p > 1e-9 else 1 / (max(p, 1e-300) * math.pi) for p in chances) / len(chances)
    return 0.5 - math.atan(t) / math.pi if t < 1e6 else 1 / (t * math.pi)


def battery(s: str, alphabet: str) -> tuple[float, float, float]:
    """Chances that random draws from the alphabet have as many equal pairs, as odd a number of runs, as strong a correlation of neighbours."""
    n, k = len(s), len(alphabet)
    place = {c: i for i, c in enumerate(alphabet)}
    v = [place.get(c, 0) for c in s]
    counts: dict[int, int] = {}
    for x in v:
        counts[x] = counts.get(x, 0) + 1
    pairs = sum(c * (c - 1) // 2 for c in counts.values())
    uniform = 1 - _poisson(pairs - 1, n * (n - 1) / 2 / k)
    above = [x >= k / 2 for x in v]
    a = sum(above)
    b = n - a
    runs = 1 + sum(x != y for x, y in zip(above, above[1:]))
    if a and b:
        mean = 1 + 2 * a * b / n
        var = max(1e-9, (mean - 1) * (mean - 2) / (n - 1))
        in_runs = 2 * _normal(-abs(runs - mean) / math.sqrt(var))
    else:
        in_runs = 2.0 ** (1 - n)
    m = sum(v) / n
    spread = sum((x - m) ** 2 for x in v)
    serial = 2 * _normal(-abs(sum((x - m) * (y - m) for x, y in zip(v, v[1:])) / spread + 1 / n) * math.sqrt(n)) if spread else 0.0
    return uniform, in_runs, serial


def chance(s: str) -> float:
    """The chance, at most, of as much evidence for random draws if a run is ordinary writing; one where no encoding fits."""
    found = encoding(s)
    s = s.rstrip("=")
    if not found or len(s) < FEWEST:
        return 1.0
    bits = writing_bits(s) - len(s) * math.log2(len(found[0])) - math.log2(ALPHABETS)
    if bits <= LEAST_BITS:
        return 1.0  # p is at most one, so the battery could not lift it above
    tests = battery(s, found[0])
    if min(tests) < 1e-15:
        return 1.0  # as far as double precision goes, no draw from the alphabet looks like this
    return min(1.0, 2.0 ** -min(1000.0, bits) / cauchy(list(tests)))


def candidates(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, int, int]]:
    """(start, end, stratum, bin) of the runs that touch no base span and may be less than writing; the higher the bin, the less like it."""
    out = []
    for m in RUN.finditer(text):
        s, e = m.span()
        if any(a < e and s < b for a, b, _ in base):
            continue
        if bin_ := min(BINS - 1, int(-math.log10(max(chance(m[0]), 1e-300)) * STEP)):
            out.append((s, e, sum(e - s >= x for x in STRATA) - 1, bin_))
    return out


def n_tested(text: str) -> list[int]:
    """How many runs of each stratum are tested, random or not."""
    out = [0] * len(STRATA)
    for m in RUN.finditer(text):
        out[sum(m.end() - m.start() >= x for x in STRATA) - 1] += 1
    return out


FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<s:long,e:long,kind:string>>, more array<struct<s:long,e:long,stratum:int,bin:int>>, tested array<long>"


def scanned(docs: DataFrame, keep: Column) -> DataFrame:
    """``kept`` and, for every row, base spans and candidates."""
    span, more = pa.struct([("s", pa.int64()), ("e", pa.int64()), ("kind", pa.string())]), pa.struct([("s", pa.int64()), ("e", pa.int64()), ("stratum", pa.int32()), ("bin", pa.int32())])

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column(1):
                text = t.as_py() or ""
                base = base_spans(text)
                kinds = [k for _, _, k in base]
                digest = hashlib.sha256(joined(base).encode()).hexdigest()
                rows.append((*(kinds.count(k) for k in KINDS[:3]), digest, [dict(zip("se", x[:2]), kind=x[2]) for x in base], [dict(zip(("s", "e", "stratum", "bin"), x)) for x in candidates(text, base)], n_tested(text)))
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(span), pa.list_(more), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), t) for c, t in zip(cols, kinds))], ["kept", "n_assign", "n_access", "n_hex", "base_sha256", "base", "more", "tested"])

    rows = docs.select(keep.alias("kept"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, f"kept {rows.schema['kept'].dataType.simpleString()}, {FOUND}")


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def thresholds(found: DataFrame, level: float = FDR) -> list[int]:
    """Per stratum the lowest bin that Benjamini-Hochberg lets through; ``BINS`` where none does."""
    tested = found.select(F.posexplode("tested").alias("stratum", "n")).groupBy("stratum").agg(F.sum("n").alias("n"))
    hits = found.select(F.explode("more").alias("m")).groupBy("m.stratum", "m.bin").count()
    m = {r[0]: r[1] for r in tested.collect()}  # one row a stratum
    seen: dict[int, dict[int, int]] = {}
    for stratum, b, n in hits.collect():  # at most strata x bins rows
        seen.setdefault(stratum, {})[b] = n
    out = []
    for stratum in range(len(STRATA)):
        best, total = BINS, 0
        for b in range(BINS - 1, -1, -1):
            total += seen.get(stratum, {}).get(b, 0)
            if total and m.get(stratum, 0) * 10 ** (-b / STEP) <= level * total:
                best = b
        out.append(best)
    return out


def secrets(docs: DataFrame, keep: Column) -> DataFrame:
    """``kept``, counts and digest of base spans, and ``found``: all spans (s, e, kind) by start, then kind, for every row."""
    each = cut(scanned(docs, keep))
    limits = F.array(*map(F.lit, thresholds(each)))
    more = F.transform(F.filter("more", lambda x: x["bin"] >= F.get(limits, x["stratum"])), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.lit("random").alias("kind")))
    rank = lambda x: F.struct(x["s"].alias("s"), F.array_position(F.array(*map(F.lit, KINDS)), x["kind"]).alias("o"), x["e"].alias("e"), x["kind"].alias("kind"))
    ordered = F.transform(F.sort_array(F.transform(F.concat("base", more), rank)), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))
    return each.select("kept", "n_assign", "n_access", "n_hex", "base_sha256", ordered.alias("found"))


def spelled(found: str = "found") -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def masked(text: str, spans: list[tuple[int, int]], mask: str = "[SECRET]") -> str:
    """The text with its spans, overlapping ones together, replaced."""
    out, at = [], 0
    for s, e in spans:
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """Documents with every secret masked; ``n_chars``, where there, follows."""
    found = secrets(docs, F.struct("*"))
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            texts = [None if t is None else masked(t, [(x["s"], x["e"]) for x in f]) if f else t for t, f in zip(b.column(at).to_pylist(), b.column(b.num_columns - 1).to_pylist())]
            cols = [pa.array(texts, b.column(at).type) if i == at else b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, b.schema.names[:-1])

    out = found.select("kept.*", F.transform("found", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"))).alias("__spans")).mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


ship(__name__)
