"""Chat formatting with a grammar round trip.

    turn  := "### " role ": " text "</turn>" newline

A turn is rendered raw, reparsed by the deterministic parser below and compared
with its source; where they differ, its conflicting content is escaped and the
turn is rendered and compared again until both are identical.  Escapes are a
backslash before a control string or a backslash.

The output is one row per turn, in order, with the span of its text under the
loss mask (assistant turns).  Turns are rendered where they lie; reading a
conversation back is a stream over its sorted turns with constant memory, so a
conversation of any length is held by no task.

Nulls: a null text or role is empty; a null conversation id is a conversation
of its own; null turns come first.  Turns with equal numbers are ordered by
role and text and all kept.  An empty table gives an empty result.
"""

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from corpusq.llm.arrow import extend

OPEN, SEPARATOR, CLOSE = "### ", ": ", "</turn>"
MARK = "###"
LEARNED = "assistant"
_TOKEN = re.compile(r"\\(\\|###|</turn>)|(###|</turn>)")
_ROLE_END = re.compile(r"\\(\\|###|</turn>|: )|(###|</turn>|: )")


class Conflict(ValueError):
    """The text is not a sentence of the grammar."""


def escape(text: str, role: bool = False) -> str:
    text = text.replace("\\", "\\\\").replace(MARK, "\\" + MARK).replace(CLOSE, "\\" + CLOSE)
    return text.replace(SEPARATOR, "\\" + SEPARATOR) if role else text


def _read(source: str, at: int, end: str, token) -> tuple[str, int, int]:
    """(unescaped content, where it ends, where the end mark ends)."""
    out, start = [], at
    for m in token.finditer(source, at):
        if m.group(1) is not None:
            out += [source[start:m.start()], m.group(1)]
            start = m.end()
        elif m.group(2) == end:
            return "".join([*out, source[start:m.start()]]), m.start(), m.end()
        else:
            raise Conflict(f"control string at {m.start()}")
    raise Conflict("the turn does not end")


def parse(source: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the rendered text) of each turn."""
    turns, at = [], 0
    while at < len(source):
        if not source.startswith(OPEN, at):
            raise Conflict(f"no turn at {at}")
        role, _, at = _read(source, at + len(OPEN), SEPARATOR, _ROLE_END)
        start = at
        text, end, at = _read(source, at, CLOSE, _TOKEN)
        if not source.startswith("\n", at):
            raise Conflict(f"no line end at {at}")
        at += 1
        turns.append((role, text, start, end))
    return turns


def render(role: str, text: str) -> str:
    """The turn as text that reads back as exactly this turn, with as few escapes as that takes."""
    for escape_role, escape_text in ((False, False), (False, True), (True, False), (True, True)):
        made = OPEN + (escape(role, True) if escape_role else role) + SEPARATOR + (escape(text) if escape_text else text) + CLOSE + "\n"
        try:
            read = parse(made)
        except Conflict:
            continue
        if len(read) == 1 and read[0][:2] == (role, text):
            return made
    raise AssertionError("a fully escaped turn reads back")


def format_turns(conversations: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, formatted, loss_start, loss_end); the span is null outside the loss mask."""
    base = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("_role"), F.coalesce("text", F.lit("")).alias("_text"))

    def factory():
        def compute(batch):
            made, starts, ends = [], [], []
            for role, text in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                turn = render(role, text)
                _, _, start, end = parse(turn)[0]
                made.append(turn)
                starts.append(start if role == LEARNED else None)
                ends.append(end if role == LEARNED else None)
            return [pa.array(made, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
        return compute
    return extend(base, "formatted string, loss_start bigint, loss_end bigint", factory).drop("_role", "_text")


DIGESTS = ("conv_id {id}, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")


class _Reading:
    """Running digests of one conversation, fed with its rendered turns in order."""

    def __init__(self, conv_id):
        self.conv_id, self.turns, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def feed(self, formatted, loss_start, loss_end):
        for role, text, start, end in parse(formatted):
            self.turns += 1
            self.all.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            if (start, end) == (loss_start, loss_end):
                self.loss_chars += len(text)
                self.loss.update(text.encode("utf-8", "surrogatepass"))
        self.chars += len(formatted)

    def row(self):
        return (self.conv_id, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars)


def read_back(formatted: DataFrame) -> DataFrame:
    """One row per conversation, parsed from the rendered turns alone, in order of turn and rendered text."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType
    schema = StructType.fromDDL(DIGESTS.format(id=formatted.schema["conv_id"].dataType.simpleString()))
    arrow = to_arrow_schema(schema)

    def stream(batches):
        held = None
        for batch in batches:
            done = []
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                conv_id, turn, *rest = row
                if held is None or held.conv_id != conv_id:
                    if held is not None:
                        done.append(held.row())
                    held = _Reading(conv_id)
                held.feed(*rest)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), arrow.types)], schema=arrow)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(held.row(), arrow.types)], schema=arrow)
    ordered = formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_end").repartition("conv_id")
    return ordered.sortWithinPartitions("conv_id", "turn", "formatted").mapInArrow(stream, schema)
