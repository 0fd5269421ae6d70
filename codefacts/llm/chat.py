"""Chat formatting by columnar byte assembly (operator 3).

A turn becomes ``<|im_start|>role\\ntext<|im_end|>\\n``.  Control strings inside
roles and texts are escaped by a backslash behind their first character, and
backslashes are doubled; dropping the backslash of every pair undoes it.

Rows are dealt by ranges of (conversation, turn), so a conversation that holds
a third of all rows is formatted by many tasks, in chunks of at most ``ROWS``
turns.  For each chunk the lengths of all segments, their running offsets and
the scatter indices are computed as numpy arrays, and headers, roles and texts
are copied into one preallocated buffer that becomes the Arrow column without
another copy.  The loss mask is kept as byte ranges of the assistants' texts.

``read_back`` parses chunks in order, one conversation after another, carrying
only counts and running digests, so no conversation is held in memory.

Defined cases: null role and text are empty; turns go in order with null last,
equal turns by role, then text; a null conversation id is a conversation of its
own; repeated rows are repeated turns; other columns are ignored; a
conversation without an assistant has an empty mask; of an empty table nothing
comes out.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codefacts.llm.common import cut, ship, shuffles

START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings' beginnings and what they become inside a text; the backslash itself goes first.
ESCAPES = (("\\", "\\\\"), ("<|", "<\\|"), ("</s>", "<\\/s>"), ("<s>", "<\\s>"), ("[INST]", "[\\INST]"), ("[/INST]", "[\\/INST]"))
LOSS = "assistant"
ROWS = 1024
#: Bytes of text in a chunk, unless one turn alone is longer; scattering takes some 16 bytes of index for each.
BYTES = 4 << 20
UNESCAPE = re.compile(r"\\(.)", re.DOTALL)
CHUNK = "conv_id long, no_turn boolean, turn long, k long, formatted string, loss array<long>"


def unescaped(text: str) -> str:
    return UNESCAPE.sub(r"\1", text) if "\\" in text else text


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Contents and offsets of a string array without nulls."""
    a = pa.concat_arrays([a]) if a.offset else a
    offsets = np.frombuffer(a.buffers()[1], np.int64, len(a) + 1, a.offset * 8)
    data = a.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def assemble(role: pa.Array, text: pa.Array, starts: np.ndarray) -> tuple[pa.Array, list[np.ndarray]]:
    """Formatted text of each group of rows (beginning at ``starts``) and the byte ranges of its loss mask."""
    n = len(role)
    role, text = pc.fill_null(role, "").cast(pa.large_string()), pc.fill_null(text, "").cast(pa.large_string())
    masked = pc.equal(role, LOSS).to_numpy(zero_copy_only=False)
    for plain, escaped in ESCAPES:
        role, text = pc.replace_substring(role, plain, escaped), pc.replace_substring(text, plain, escaped)
    head, tail = np.frombuffer(START.encode(), np.uint8), np.frombuffer(END.encode(), np.uint8)
    (rb, ro), (tb, to) = _bytes(role), _bytes(text)
    rl, tl = np.diff(ro), np.diff(to)
    size = len(head) + rl + 1 + tl + len(tail)
    at = np.r_[0, np.cumsum(size)]
    out = np.empty(at[-1], np.uint8)
    begin = at[:-1]

    def spread(where: np.ndarray, lengths: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
        """Scatter variable segments: destination = source place + shift of its segment."""
        source = np.arange(offsets[0], offsets[-1])
        out[source + np.repeat(where - offsets[:-1], lengths)] = data[offsets[0] : offsets[-1]]

    out[begin[:, None] + np.arange(len(head))] = head
    spread(begin + len(head), rl, rb, ro)
    out[begin + len(head) + rl] = 10
    inner = begin + len(head) + rl + 1
    spread(inner, tl, tb, to)
    out[(inner + tl)[:, None] + np.arange(len(tail))] = tail
    bounds = np.r_[begin[starts], at[-1]].astype(np.int64) if n else np.zeros(1, np.int64)
    column = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(bounds), pa.py_buffer(out))
    group = np.searchsorted(starts, np.flatnonzero(masked), "right") - 1
    spans = np.c_[inner[masked], (inner + tl)[masked]] - bounds[group][:, None] if n else np.zeros((0, 2), np.int64)
    cuts = np.searchsorted(group, np.arange(1, len(starts)))
    return column, [s.ravel() for s in np.split(spans, cuts)]


def formatted(turns: DataFrame) -> DataFrame:
    """Chunks (conv_id, no_turn, turn, k, formatted, loss) of all conversations; in order of the middle three they make up each one."""

    def run(batches):
        last, k = None, 0
        for whole in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(whole.column(3)), 0).to_numpy().astype(np.int64))
            at = 0
            while at < whole.num_rows:
                limit = (ends[at - 1] if at else 0) + BYTES
                b = whole.slice(at, min(ROWS, max(1, int(np.searchsorted(ends, limit, "right")) - at)))
                at += b.num_rows
                conv = pc.fill_null(b.column(0), 0).to_numpy()
                void = pc.is_null(b.column(0)).to_numpy(zero_copy_only=False)
                starts = np.flatnonzero(np.r_[True, (conv[1:] != conv[:-1]) | (void[1:] != void[:-1])])
                column, loss = assemble(b.column(2), b.column(3), starts)
                picked = pa.array(starts)
                ids, turn = b.column(0).take(picked), b.column(1).take(picked)
                ks = []
                for i in ids.to_pylist():
                    k = k + 1 if i == last else 0
                    last = i
                    ks.append(k)
                yield pa.RecordBatch.from_arrays(
                    [ids, pc.is_null(turn), turn, pa.array(ks, pa.int64()), column.cast(pa.string()), pa.array(loss, pa.list_(pa.int64()))],
                    ["conv_id", "no_turn", "turn", "k", "formatted", "loss"],
                )

    rows = turns.select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))])
    order = ["conv_id", F.col("turn").isNull(), "turn"]
    rows = rows.repartitionByRange(shuffles(turns.sparkSession), *order).sortWithinPartitions(*order, F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return rows.mapInArrow(run, CHUNK)


def parsed(chunk: str) -> list[tuple[str, str]]:
    """(role, text) of each turn in a formatted chunk."""
    return [tuple(map(unescaped, t.removesuffix(END).split("\n", 1))) for t in chunk.split(START)[1:]]


def read_back(chunks: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from formatted chunks alone."""

    def run(batches):
        last, state = None, None

        def close():
            turns, all_sha, chars, loss_sha, size = state
            return (last[0], turns, all_sha.hexdigest(), chars, loss_sha.hexdigest(), size)

        for b in batches:
            done = []
            for conv, text, loss in zip(b.column(0).to_pylist(), b.column(4), b.column(5)):
                if state is None or last[0] != conv:
                    if state is not None:
                        done.append(close())
                    last, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = text.as_py()
                for role, said in parsed(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                raw, spans = text.encode(), loss.as_py()
                for s, e in zip(spans[::2], spans[1::2]):
                    said = unescaped(raw[s:e].decode())
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            yield _result(done)
        if state is not None:
            yield _result([close()])

    order = ["conv_id", "no_turn", "turn", "k"]
    return chunks.repartition(shuffles(chunks.sparkSession), "conv_id").sortWithinPartitions(*order).mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _result(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], list(kinds))


def chats(turns: DataFrame) -> DataFrame:
    """Format all conversations, write the chunks to the shared folder and read them back."""
    return read_back(cut(formatted(turns)))


def oracle(extra: str) -> str:
    """The same digests and sizes in DuckDB's SQL; ``extra`` selects rows to add to ``conversations``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    escaped = "x"
    for a, b in ESCAPES:
        escaped = f"replace({escaped}, {quote(a)}, {quote(b)})"
    size = lambda c: f"length({escaped.replace('(x,', f'({c},')})"
    order = "ORDER BY turn NULLS LAST, role, text"
    return f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL {extra}))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' {order})) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{LOSS}'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' {order}) FILTER (role = '{LOSS}'), '')) AS loss_sha256,
  sum({len(START) + 1 + len(END)} + {size("role")} + {size("text")})::BIGINT AS formatted_chars
FROM t GROUP BY conv_id"""


ship(__name__)
