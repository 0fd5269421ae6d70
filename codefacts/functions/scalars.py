"""Column functions (SF1 to SF49); every one stays inside the JVM unless it says otherwise."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from codefacts.functions import patterns as P


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _any(conditions) -> Column:
    return reduce(or_, conditions, F.lit(False))


def under(module: Column | str, pattern: Column | str, sep: str = ".") -> Column:
    """RB2, SF15: equal, or below it at a separator's boundary; never a bare prefix."""
    m, p = _c(module), _c(pattern)
    return (m == p) | m.startswith(F.concat(p, F.lit(sep)))


def module_of(path: Column | str, style: str = "python") -> Column:
    """SF1, SF2, SF3: dotted module of a relative path.

    ``python`` drops ``.py`` and a closing ``__init__``; ``multi`` any extension
    and a closing ``index``, ``mod`` or ``__init__``; ``any`` any extension only.
    """
    rel = F.regexp_replace(F.regexp_replace(F.regexp_replace(_c(path), r"\\", "/"), r"(^|/)(\./)+", "$1"), r"/+", "/")
    rel = F.regexp_replace(rel, r"^/|^src/", "")
    if style == "python":
        rel = F.regexp_replace(F.regexp_replace(rel, r"(^|/)__init__\.py$", ""), r"\.py$", "")
    else:
        rel = F.regexp_replace(rel, r"\.[^./]*$", "")
        if style == "multi":
            rel = F.regexp_replace(rel, r"(^|/)(index|mod|__init__)$", "")
    return F.regexp_replace(rel, "/", ".")


def moment(ts: Column | str) -> Column:
    """SF4: an ISO stamp with an offset as a timestamp; null if it has none or does not parse."""
    fixed = F.regexp_replace(_c(ts), "Z$", "+00:00")
    return F.when(fixed.rlike(r"[+-]\d\d:?\d\d$"), F.try_to_timestamp(fixed))


def duration_seconds(text: Column | str) -> Column:
    """SF5: ``90s``, ``5m``, ``2h``, ``1d`` or a number as seconds; null where it is not positive or no duration."""
    t = F.lower(F.trim(_c(text)))
    n = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)([smhd]?)$", 1)
    unit = F.regexp_extract(t, r"^([0-9]+(?:\.[0-9]+)?)([smhd]?)$", 2)
    seconds = F.when(n != "", n.try_cast("double")) * F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).otherwise(1)
    return F.when(seconds > 0, seconds)


def relative_time(ts: Column | str, now: Column) -> Column:
    """SF6: how long ago, against an injected clock."""
    s = F.unix_timestamp(now) - F.unix_timestamp(_c(ts))
    say = lambda n, unit: F.concat(F.floor(n).cast("string"), F.lit(unit))
    return F.when(s.isNull(), F.lit("?")).when(s < 60, say(F.greatest(s, F.lit(0)), " s")).when(s < 3600, say(s / 60, " min")).when(s < 86400, say(s / 3600, " h")).otherwise(say(s / 86400, " d"))


def short_path(path: Column | str, project: Column | str) -> Column:
    """SF7: relative to the project where it lies below it."""
    p, base = _c(path), _c(project)
    return F.when(p.startswith(F.concat(base, F.lit("/"))), F.substring(p, F.length(base) + 2, F.length(p))).otherwise(p)


def slug(path: Column | str) -> Column:
    """SF8: the last part, 40 characters at most, with eight of the whole path's SHA-256."""
    p = _c(path)
    name = F.substring(F.regexp_replace(F.element_at(F.split(p, r"[\\/]"), -1), r"[^A-Za-z0-9._-]", "-"), 1, 40)
    return F.when(p.isNull() | (p == ""), F.lit("sin-proyecto")).otherwise(F.concat(name, F.lit("-"), F.substring(F.sha2(p, 256), 1, 8)))


def random_id(ts: Column | str) -> Column:
    """SF9: sortable by time; different at every evaluation."""
    return F.concat(F.substring(F.regexp_replace(_c(ts), "[:-]", ""), 1, 15), F.lit("-"), F.substring(F.sha2(F.uuid(), 256), 1, 6))


def stable_id(ts, lang, type_, message, file, line, pid) -> Column:
    """SF10: an id from a record's content; nulls read ``None``."""
    parts = [F.coalesce(_c(x).cast("string"), F.lit("None")) for x in (ts, lang, type_, message, file, line, pid)]
    stamp = F.regexp_replace(F.regexp_replace(F.coalesce(_c(ts), F.lit("")), "[:-]", ""), r"\+", "p")
    day = F.substring(stamp, 1, 15)
    return F.concat(F.when(day == "", F.lit("sin-fecha")).otherwise(day), F.lit("-"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 6))


def ephemeral(where: Column | str) -> Column:
    """SF11: a place in angle brackets is no file."""
    return F.ltrim(F.coalesce(_c(where), F.lit(""))).startswith("<")


def file_of(where: Column | str) -> Column:
    """SF13: the file of ``file:line``; a colon among the first two characters belongs to a drive."""
    w = F.trim(_c(where))
    cut_at = F.when(F.substring(w, 3, F.length(w)).contains(":"), F.regexp_extract(w, r"(?s)^(.*):[^:]*$", 1)).otherwise(w)
    return F.when((w == "") | (w == "?") | w.startswith("<"), None).otherwise(cut_at)


def signature_file(where: Column | str) -> Column:
    """SF14: everything before the last colon; null without one or for no file."""
    w = _c(where)
    return F.when(w.contains(":") & ~w.startswith("<"), F.nullif(F.regexp_extract(w, r"(?s)^(.*):[^:]*$", 1), F.lit("")))


def exploration(where: Column | str, roots: tuple[str, ...] = P.TEMPORARY) -> Column:
    """SF12, SF17: ephemeral, without a file, or below a temporary folder."""
    f = file_of(where)
    return ephemeral(where) | f.isNull() | F.coalesce(_any(under(f, F.lit(r), "/") for r in roots), F.lit(False))


def of_project(where: Column | str, root: Column | str) -> Column:
    """SF16: whether the file lies in this tree."""
    f = file_of(where)
    return F.coalesce(under(f, F.lit(root) if isinstance(root, str) else root, "/"), F.lit(False))


def sensitive(name: Column | str) -> Column:
    """SF18: whether a name suggests that its value must not be stored."""
    n = F.lower(F.coalesce(_c(name).cast("string"), F.lit("")))
    return _any(n.contains(p) for p in P.SENSITIVE)


#: Name with a sensitive part, separator, value: the same for Java and RE2.
ASSIGNED = r"(?i)(\b\w*(?:" + "|".join(P.SENSITIVE) + r")\w*\b)(['\"]?\s*[:=]\s*)(\"[^\"]*\"|'[^']*'|[^\s,)\]}]+)"


def redact(text: Column | str) -> Column:
    """SF19: values behind sensitive names in free text."""
    return F.regexp_replace(_c(text), ASSIGNED, "$1$2" + P.REDACTED)


def truncate(text: Column | str, limit: int) -> Column:
    """SF21: cut, saying how much is missing."""
    t = _c(text)
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("...(+"), (F.length(t) - limit).cast("string"), F.lit(" chars)"))).otherwise(t)


def redact_local(name: Column | str, value: Column | str) -> Column:
    """SF22."""
    return F.when(sensitive(name), F.lit(P.REDACTED)).otherwise(_c(value))


def argv_shape(argv: Column | str) -> Column:
    """SF23: program and flag names stay, values go; a first positional that looks like a subcommand stays."""
    a = _c(argv)
    rest = F.transform(
        F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0))),
        lambda x, i: F.when(~x.startswith("-"), F.when((i == 0) & x.rlike(r"^[a-z][a-z0-9_-]{0,20}$"), x).otherwise("<arg>")).when(x.contains("="), F.concat(F.regexp_extract(x, "^([^=]*)=", 1), F.lit("=<val>"))).otherwise(x),
    )
    return F.when(F.size(a) > 0, F.concat(F.array(F.regexp_extract(F.get(a, F.lit(0)), r"([^/\\]*)$", 1)), rest)).otherwise(F.array().cast("array<string>"))


def argv_redacted(argv: Column | str) -> Column:
    """SF24: the token after a sensitive flag, and the value behind ``=``, hidden."""
    a = _c(argv)
    return F.transform(
        a,
        lambda x, i: F.when(x.startswith("-") & x.contains("=") & sensitive(x), F.concat(F.regexp_extract(x, "^([^=]*)=", 1), F.lit("=<val>")))
        .when((i > 0) & F.get(a, i - 1).startswith("-") & ~F.get(a, i - 1).contains("=") & sensitive(F.get(a, i - 1)), F.lit("<val>"))
        .otherwise(x),
    )


def library_frame(file: Column | str, lang: Column | str) -> Column:
    """SF25, SF26: whether a frame belongs to the runtime's own library."""
    f, out = _c(file), F.lit(False)
    for name, marks in P.LIBRARY.items():
        out = F.when(_c(lang) == name, _any(f.contains(m) for m in marks)).otherwise(out)
    python = (_c(lang) == "python") & (f.contains("site-packages") | f.rlike(r"/lib/python[0-9.]+/") | f.startswith("<frozen"))
    return F.coalesce(out | python, F.lit(False))


def to_int(x: Column | str) -> Column:
    """SF30: null where it is no number."""
    return _c(x).try_cast("int")


def thread_of(origin: Column | str, known: tuple[str, ...]) -> Column:
    """SF29: an origin among the known ones names a thread; any other is the main one."""
    o = _c(origin)
    main = ("main", "thread-main", "exception", "process", "signal")
    return F.when(o.isin(*known) & ~o.isin(*main), o).otherwise("MainThread")


def code_only(line: Column | str) -> Column:
    """SF32: a line with its string literals emptied."""
    return F.regexp_replace(F.regexp_replace(_c(line), r"'(\\.|[^'\\])*'", "''"), r'"(\\.|[^"\\])*"', '""')


def matches(line: Column | str, pats: tuple[str, ...]) -> Column:
    """SF33: whether any pattern is found in the line's code."""
    code = code_only(line)
    return _any(code.rlike(p) for p in pats)


def compares(line: Column | str) -> Column:
    """SF34."""
    return code_only(line).rlike(P.COMPARES)


def is_test_file(path: Column | str) -> Column:
    """SF35."""
    return _c(path).rlike(P.TEST_FILE)


def is_test_module(module: Column | str) -> Column:
    """RB8: a folder of tests on the way, or a last part that is called like a test."""
    parts = F.filter(F.split(F.coalesce(_c(module), F.lit("")), r"\."), lambda x: x != "")
    last = F.element_at(parts, -1)
    folder = F.exists(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.lower(x).isin(*P.TEST_DIRS))
    named = F.lower(last).isin(*P.TEST_DIRS) | F.lower(last).startswith("test_") | _any(last.endswith(s) for s in P.TEST_SUFFIXES)
    return F.when(F.size(parts) == 0, F.lit(False)).otherwise(folder | named)


def is_test_symbol(qual: Column | str) -> Column:
    """GR32: the first part begins with test or ends with tests."""
    first = F.lower(F.substring_index(F.coalesce(_c(qual), F.lit("")), ".", 1))
    return first.startswith("test") | first.endswith("tests")


def parameters(sig: Column | str) -> Column:
    """Parameters of a signature text as (name, has_default, star), split at commas outside brackets and quotes."""
    body = F.regexp_replace(F.trim(F.coalesce(_c(sig), F.lit(""))), r"(?s)^[^(]*\((.*)\)[^)]*$", "$1")
    flat = F.regexp_replace(F.regexp_replace(body, r"""'[^']*'|"[^"]*\"""", "x"), r"\[[^\]]*\]|\([^)]*\)|\{[^}]*\}", "x")
    return F.transform(
        F.filter(F.transform(F.split(flat, ","), lambda p: F.trim(p)), lambda p: (p != "") & (p != "/")),
        lambda p: F.struct(F.trim(F.regexp_extract(p, r"^\**([^=:]*)", 1)).alias("name"), p.contains("=").alias("has_default"), p.startswith("*").alias("star")),
    )


def breaks_calls(old: Column | str, new: Column | str) -> Column:
    """SF36: a new required parameter, or one that is gone; with a star on either side nothing is said."""
    a, b = parameters(old), parameters(new)
    names = lambda x: F.transform(x, lambda p: p["name"])
    star = F.exists(F.concat(a, b), lambda p: p["star"])
    required = F.exists(b, lambda p: ~F.array_contains(names(a), p["name"]) & ~p["has_default"])
    return ~star & (required | (F.size(F.array_except(names(a), names(b))) > 0))


def fits(sig: Column | str, positional: Column, keywords: Column, method: Column) -> Column:
    """SF37: whether a call of so many positional and such keyword arguments binds to a signature."""
    p = F.when(method, F.slice(parameters(sig), 2, 1000)).otherwise(parameters(sig))
    names = F.transform(p, lambda x: x["name"])
    star = F.exists(p, lambda x: x["star"])
    missing = F.exists(F.slice(p, positional + 1, 1000), lambda x: ~x["has_default"] & ~F.array_contains(keywords, x["name"]))
    return star | ((positional <= F.size(p)) & (F.size(F.array_except(keywords, names)) == 0) & ~missing)


def nullable(kind: Column | str) -> Column:
    """SF38."""
    return F.coalesce(_c(kind).contains("None"), F.lit(False))


def unquoted(text: Column | str) -> Column:
    """SF39: without a pair of equal quotes around it."""
    t = F.trim(_c(text))
    ends = F.substring(t, 1, 1)
    return F.when((F.length(t) >= 2) & ends.isin("'", '"', "`") & (ends == F.substring(t, -1, 1)), F.substring(t, 2, F.length(t) - 2)).otherwise(t)


def language_of(path: Column | str) -> Column:
    """SF40: by extension; declaration files of TypeScript have none."""
    p = F.lower(_c(path))
    out = F.lit(None).cast("string")
    for name, extensions, *_ in P.LANGUAGES:
        out = F.when(_any(p.endswith(e) for e in extensions), F.lit(name)).otherwise(out)
    return F.when(~p.endswith(".d.ts"), out)


def is_test_path(path: Column | str) -> Column:
    """FX26: by the conventions of the path's language: a folder of tests on the way, or a stem that ends or begins like a test's."""
    p = F.regexp_replace(_c(path), r"\\", "/")
    parts = F.split(p, "/")
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    above = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.lower(x))
    lang, out = language_of(p), F.lit(False)
    for name, _, suffixes, dirs, _ in P.LANGUAGES:
        one = F.arrays_overlap(above, F.array(*map(F.lit, dirs))) | _any(stem.endswith(s) for s in suffixes) | (stem.startswith("test_") if name == "python" else F.lit(False))
        out = F.when(lang == name, one).otherwise(out)
    return out


def chain_head(chain: Column | str, depth: int = 3) -> Column:
    """SF31: the first links of an exception's chain."""
    return F.slice(_c(chain), 1, depth)


def inner_frames(frames: Column | str, keep: int = 20) -> Column:
    """XT43: the innermost frames; frames end with the innermost."""
    f = _c(frames)
    return F.slice(f, F.greatest(F.size(f) - keep + 1, F.lit(1)), keep)


def panic_type(message: Column | str, table: tuple[tuple[str, str], ...], default: str = "panic") -> Column:
    """SF41: the first needle that the message contains names its type."""
    low, out = F.lower(F.coalesce(_c(message), F.lit(""))), F.lit(default)
    for needle, kind in reversed(table):
        out = F.when(low.contains(needle.lower()), F.lit(kind)).otherwise(out)
    return out


def note_score(meta: Column | str, body: Column | str, terms: list[str]) -> Column:
    """SF42: two for a term in the index, else one for it in the body; repeated terms count again."""
    m, b = F.lower(_c(meta)), F.lower(_c(body))
    return sum((F.when(m.contains(t), 2).when(b.contains(t), 1).otherwise(0) for t in terms), F.lit(0))


def context_symbol(context: Column | str) -> Column:
    """SF43: module and function of a coverage context, written with ``::`` or with dots."""
    c = _c(context)
    nodes = F.split(F.regexp_replace(F.regexp_extract(c, r"^([^|\[]*)", 1), r"\.py::|::", "."), r"[./]")
    return F.array_join(F.slice(nodes, F.greatest(F.size(nodes) - 1, F.lit(1)), 2), ".")


def signature_line(type_, where, count) -> Column:
    """SF44, SF45: one line about a signature."""
    return F.concat_ws(" ", F.concat(_c(count).cast("string"), F.lit("x")), _c(type_), F.when(_c(where).isNotNull(), F.concat(F.lit("@ "), _c(where))))


def html_safe(json: Column | str) -> Column:
    """SF46: JSON that can stand in a script element."""
    return F.replace(F.replace(F.replace(_c(json), F.lit("<"), F.lit("\\u003c")), F.lit(">"), F.lit("\\u003e")), F.lit("&"), F.lit("\\u0026"))


def fade(age: Column | str, full: int = 180, gone: int = 600) -> Column:
    """SF47: one up to ``full`` seconds, then down to zero at ``gone``."""
    a = _c(age)
    return F.when(a <= full, 1.0).when(a >= gone, 0.0).otherwise((gone - a) / (gone - full))


def usage_label(cmd: Column | str, suffix: Column | str) -> Column:
    """SF48."""
    return F.when(F.coalesce(_c(suffix), F.lit("")) == "", _c(cmd)).otherwise(F.concat_ws(":", _c(cmd), _c(suffix)))


def jitter(name: Column | str, amplitude: float = 1.0) -> Column:
    """GR25: a number in [-amplitude, amplitude] from the name's MD5."""
    part = F.conv(F.substring(F.md5(_c(name)), 1, 8), 16, 10).cast("double") / 4294967295
    return (part * 2 - 1) * amplitude


def user_frame(frames: Column | str) -> Column:
    """WN9: the innermost frame that is not the library's, else the innermost; frames end with the innermost."""
    back = F.reverse(_c(frames))
    return F.coalesce(F.get(F.filter(back, lambda f: ~F.coalesce(f["is_library"], F.lit(False))), F.lit(0)), F.get(back, F.lit(0)))


def headline(frames: Column | str, origin: Column | str) -> Column:
    """The place of a record: ``file:line`` of its user frame, else where the exception says it began."""
    f = user_frame(frames)
    return F.coalesce(F.when(f.isNotNull(), F.concat_ws(":", F.coalesce(f["file"], F.lit("None")), F.coalesce(f["line"].cast("string"), F.lit("None")))), _c(origin))


def tool_ratio(text: Column | str, block: str) -> Column:
    """AG9: the share of a text inside blocks that match."""
    t = _c(text)
    inside = F.aggregate(F.regexp_extract_all(t, F.lit(block), F.lit(0)), F.lit(0), lambda a, x: a + F.length(x))
    return F.when(F.length(F.trim(t)) > 0, inside / F.length(t)).otherwise(0.0)
