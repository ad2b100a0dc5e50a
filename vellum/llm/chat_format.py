r"""Chat formatting with a grammar round trip.

    conversation := segment*
    segment      := "<s>[INST]" text "[/INST]"            a user's turn
                  | "<s>[ANS]" text "</s>"                an assistant's turn
                  | "<s><<SYS>>" text "<</SYS>>"          a system's turn
                  | "<s>[ROLE]" role "[/ROLE]" text "</s>"   any other role

A control string counts unless an odd number of backslashes stands before it. Rendering first takes the text as it is; the deterministic parser reads the segment again, and where it doesn't
recover role and text, the text is escaped: backslashes before a control string or at the end are doubled, and a control string gets one more. The round trip is then made again, and has to be identical.

Turns are formatted and parsed one by one, wherever they lie; only what a digest over a whole conversation needs is brought together, sorted by turn and streamed, so even a conversation of very many turns
never stands in memory. The output is a table of segments: conv_id, turn, segment, loss_start, loss_end (code points in the segment of an assistant's text, else null); a conversation's text is its segments joined.

Null text and null role are empty. Turns with equal numbers come in the order of their segments; null turns come first. Rows of a null conv_id are one conversation. An empty table gives no rows.
A very long text is read whole, in its row. Columns of any other name, those of the results too, are left out of reports and carried through where whole rows are returned.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import slices, table
from vellum.session import written

#: The control strings, and each role's opening and closing.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[ANS]", "<<SYS>>", "<</SYS>>", "[ROLE]", "[/ROLE]")
FRAMES = {"user": ("<s>[INST]", "[/INST]"), "assistant": ("<s>[ANS]", "</s>"), "system": ("<s><<SYS>>", "<</SYS>>")}
OTHER = ("<s>[ROLE]", "[/ROLE]", "</s>")
LOSS_ROLE = "assistant"
_ANY = "|".join(map(re.escape, CONTROLS))
_CONTROL = re.compile(rf"(\\*)({_ANY})")
_ESCAPED = re.compile(rf"(\\+)(?={_ANY}|\Z)")


def escape(text: str) -> str:
    text = _CONTROL.sub(lambda m: "\\" * (2 * len(m[1]) + 1) + m[2], text)
    return text + "\\" * (len(text) - len(text.rstrip("\\")))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\\" * (len(m[1]) // 2), text)


class ParseError(ValueError):
    pass


def _until(text: str, at: int, closer: str) -> tuple[str, int]:
    """The text from at to the next control string, which must be closer, and the place behind it."""
    for m in _CONTROL.finditer(text, at):
        if len(m[1]) % 2 == 0:
            if m[2] != closer:
                break
            return text[at : m.start(2)], m.end()
    raise ParseError(f"no {closer} behind {at}")


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the escaped text) of each turn of a formatted conversation."""
    out, at = [], 0
    while at < len(text):
        if text.startswith(OTHER[0], at):
            role, start = _until(text, at + len(OTHER[0]), OTHER[1])
            role, closer = unescape(role), OTHER[2]
        else:
            role, (opener, closer) = next(((r, f) for r, f in FRAMES.items() if text.startswith(f[0], at)), ("", ("", "")))
            if not opener:
                raise ParseError(f"no turn at {at}")
            start = at + len(opener)
        body, at = _until(text, start, closer)
        out.append((role, unescape(body), start, start + len(body)))
    return out


def render(role: str, text: str) -> tuple[str, int, int]:
    """A turn's segment, and the place of the text in it. Escapes only where the parser would not get the turn back."""
    for change in (lambda x: x, escape):
        own, body = change(role), change(text)
        head, tail = FRAMES[role] if role in FRAMES else (OTHER[0] + own + OTHER[1], OTHER[2])
        segment = head + body + tail
        try:
            if [x[:2] for x in parse(segment)] == [(role, text)]:
                return segment, len(head), len(head) + len(body)
        except ParseError:
            pass
    raise ParseError("the turn does not survive the round trip")


_SEGMENTS = "conv_id long, turn long, segment string, loss_start int, loss_end int"
_TURNS = "conv_id long, turn long, segment string, role string, text string, loss string, chars long"
_DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _formatted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        made = [(r or "", *render(r or "", t or "")) for r, t in zip(part.column(2).to_pylist(), part.column(3).to_pylist())]
        loss = [(a, b) if r == LOSS_ROLE else (None, None) for r, _, a, b in made]
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([m[1] for m in made], pa.string()), pa.array([x[0] for x in loss], pa.int32()), pa.array([x[1] for x in loss], pa.int32())], ["conv_id", "turn", "segment", "loss_start", "loss_end"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        segments, rows = part.column(2).to_pylist(), []
        for s, a, b in zip(segments, part.column(3).to_pylist(), part.column(4).to_pylist()):
            ((role, text, _, _),) = parse(s)
            rows.append((role, text, None if a is None else unescape(s[a:b]), len(s)))
        kinds = pa.string(), pa.string(), pa.string(), pa.int64()
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["conv_id", "turn", "segment", "role", "text", "loss", "chars"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From turns sorted by conversation and turn. Holds one slice and the state of one conversation."""
    new = lambda: [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
    open_, state, done = None, new(), []

    def row() -> tuple:
        return (open_[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])

    def batch() -> pa.RecordBatch:
        kinds = pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], k) for i, k in enumerate(kinds)], [x.split()[0] for x in _DIGESTS.split(", ")])

    for part in slices(batches):
        for conv, role, text, loss, chars in zip(*(part.column(i).to_pylist() for i in range(5))):
            if open_ != (conv,):
                if open_:
                    done.append(row())
                open_, state = (conv,), new()
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if loss is not None:
                state[2] += len(loss)
                state[3].update(loss.encode())
            state[4] += chars
        if done:
            yield batch()
            done.clear()
    if open_:
        done.append(row())
        yield batch()


def formatted(conversations: DataFrame) -> DataFrame:
    """The output: a segment per row of conversations (conv_id, turn, role, text)."""
    return conversations.select("conv_id", "turn", "role", "text").mapInArrow(_formatted, _SEGMENTS)


def read_back(output: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, from the output alone."""
    turns = output.mapInArrow(_read, _TURNS).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return turns.select("conv_id", "role", "text", "loss", "chars").mapInArrow(_digests, _DIGESTS)


#: The contract's own conversation.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))
    return read_back(written(formatted(rows), "segments"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _added(column: str) -> str:
    """Characters that escaping adds."""
    return rf"coalesce(list_sum(list_transform(regexp_extract_all({column}, '(\\*)({_ANY.replace('/', '/')})', 1), lambda x: length(x) + 1)), 0) + length(regexp_extract({column}, '\\*$'))"


SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES {", ".join(f"({a}, {b}, {_quoted(r)}, {_quoted(t)})" for a, b, r, t in PROBE)}),
f AS (SELECT *, length(text) + {_added("text")} + CASE role {" ".join(f"WHEN {_quoted(r)} THEN {len(a) + len(b)}" for r, (a, b) in FRAMES.items())} ELSE {sum(map(len, OTHER))} + length(role) + {_added("role")} END AS chars FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = '{LOSS_ROLE}'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = '{LOSS_ROLE}'), '')) AS loss_sha256, sum(chars)::BIGINT AS formatted_chars
FROM f GROUP BY conv_id
"""
