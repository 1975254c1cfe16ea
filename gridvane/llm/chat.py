"""Chat formatting that is checked by reading it back.

The template is a regular grammar, and the parser follows it from left to right without a choice:

    conversation  =  turn*
    turn          =  "[INST] " text " [/INST]"              user
                  |  "<s> " text " </s>"                    assistant
                  |  "<<SYS>> " text " <</SYS>>"            system
                  |  "[ROLE] " role " [TEXT] " text " [/TEXT]"   any other role

A turn is rendered and parsed; if what comes back is not the turn, its text (or role) holds something
that the grammar reads otherwise: a control string, or the escape sign itself. Then a sign goes before
each of them, and the turn is rendered and parsed again, until it comes back as it was. A text that
needs no escape has none. The whole conversation is parsed once more when its turns stand together.
The loss mask is where the assistants' texts stand in the output.

Rows are grouped by conversation and ordered by turn, nulls first, equal turns by role and text. A
group is first gathered within each map task, and its output is one string, so a conversation must
fit into one row (2 GB); a task takes some ten times its longest conversation. Nulls: a null text or
role is an empty one, rows with a null conversation are one conversation. Repeated rows are turns
each; empty texts are turns; empty tables give no rows. Columns beyond the four are dropped, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ESCAPE = "\\"
#: Opening and closing control strings of the roles that have their own; others use ROLE, TEXT, END.
MARKS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
ROLE, TEXT, END = "[ROLE]", "[TEXT]", "[/TEXT]"
CONTROLS = [x for pair in MARKS.values() for x in pair] + [ROLE, TEXT, END]
_OPENS = {pair[0]: (role, pair[1]) for role, pair in MARKS.items()}
_CONTROL = "|".join(map(re.escape, CONTROLS))
_SPECIAL = re.compile(f"{re.escape(ESCAPE)}|{_CONTROL}")
#: An escaped character, or a control string.
_TOKEN = re.compile(f"{re.escape(ESCAPE)}.|{_CONTROL}", re.S)
_ESCAPED = re.compile(f"{re.escape(ESCAPE)}(.)", re.S)


def escaped(text: str) -> str:
    """text with the escape sign before each control string and each escape sign."""
    return _SPECIAL.sub(lambda m: ESCAPE + m[0], text)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def rendered(role: str, text: str) -> str:
    """One turn by the template, nothing escaped."""
    if role in MARKS:
        return f"{MARKS[role][0]} {text} {MARKS[role][1]}"
    return f"{ROLE} {role} {TEXT} {text} {END}"


def _field(whole: str, at: int, close: str) -> tuple[int, int, int] | None:
    """(start, end, where to go on) of a text that stands from `at` to the next control string, which must be close."""
    pair = at + 1  # where the last escaped character ended: a pair must not reach into the closing space
    for m in _TOKEN.finditer(whole, at):
        if m[0][0] == ESCAPE:
            pair = m.end()
            continue
        start, end = at + 1, m.start() - 1
        if m[0] != close or end < pair or whole[at] != " " or whole[end] != " ":
            return None
        return start, end, m.end()
    return None


def parsed(whole: str) -> list[tuple[str, str, int, int]] | None:
    """(role, text, start, end) of each turn, read from the formatted text; None if it is not a conversation."""
    out, at = [], 0
    while at < len(whole):
        m = _TOKEN.match(whole, at)
        if m is None:
            return None
        if m[0] in _OPENS:
            role, close = _OPENS[m[0]]
            found = _field(whole, m.end(), close)
        elif m[0] == ROLE and (named := _field(whole, m.end(), TEXT)) is not None:
            role = unescaped(whole[named[0] : named[1]])
            found = _field(whole, named[2], END)
        else:
            return None
        if found is None:
            return None
        start, end, at = found
        out.append((role, unescaped(whole[start:end]), start, end))
    return out


def turn(role: str, text: str) -> str:
    """One turn, its content escaped until the parser gives it back."""
    shown_role, shown = role, text
    while True:
        block = rendered(shown_role, shown)
        got = parsed(block)
        if got is not None and len(got) == 1 and got[0][:2] == (role, text):
            return block
        if shown != escaped(text):
            shown = escaped(text)
        elif shown_role != escaped(role):
            shown_role = escaped(role)
        else:
            raise ValueError(f"a turn does not come back: {block[:200]!r}")


def conversation(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """(formatted text, spans under the loss mask) of a conversation; the text parses to the turns."""
    whole = "".join([turn(role, text) for role, text in turns])
    got = parsed(whole)
    if got is None or [t[:2] for t in got] != turns:
        raise ValueError(f"a conversation does not come back: {whole[:200]!r}")
    return whole, [(a, b) for role, _, a, b in got if role == "assistant"]


def formatted(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, formatted, loss): one row a conversation; loss has the (start, end) code points of the mask's spans."""
    kind = rows.schema[conv_col].dataType.simpleString()
    said = F.struct(F.col(turn_col).alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])
    grouped = rows.select(F.col(conv_col).alias("conv_id"), said.alias("said")).groupBy("conv_id").agg(F.sort_array(F.collect_list("said")).alias("said"))
    grouped = grouped.select("conv_id", F.col("said.role").alias("roles"), F.col("said.text").alias("texts"))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                made = [conversation(list(zip(r.as_py(), t.as_py()))) for r, t in zip(part.column(1), part.column(2))]
                spans = [[{"start": s, "end": e} for s, e in loss] for _, loss in made]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([m[0] for m in made], pa.string()), pa.array(spans, span)], ["conv_id", "formatted", "loss"])

    out = grouped.mapInArrow(run, f"conv_id {kind}, formatted string, loss array<struct<start: bigint, end: bigint>>")
    return out.withColumnRenamed("conv_id", conv_col)


def read(chats: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """(conv_id, formatted, turns, loss_text) of formatted(): turns(role, text) by the parser, loss_text by the mask."""
    kind = chats.schema[conv_col].dataType.simpleString()
    said = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                turns, losses = [], []
                for whole, spans in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    got = parsed(whole)
                    if got is None:
                        raise ValueError(f"not a formatted conversation: {whole[:200]!r}")
                    turns.append([{"role": t[0], "text": t[1]} for t in got])
                    losses.append("".join([unescaped(whole[s["start"] : s["end"]]) for s in spans]))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(turns, said), pa.array(losses, pa.string())], ["conv_id", "formatted", "turns", "loss_text"])

    out = chats.select(F.col(conv_col).alias("conv_id"), "formatted", "loss").mapInArrow(run, f"conv_id {kind}, formatted string, turns array<struct<role: string, text: string>>, loss_text string")
    return out.withColumnRenamed("conv_id", conv_col)
