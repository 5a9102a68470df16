r"""Chat formatting: a finite-state machine over roles, and text segments with loss flags from a declarative template.

A template names, for each role, the control text before and after a turn and whether the turn's text is trained on.
Control strings inside texts and role names are escaped reversibly: a backslash becomes `\\`, and `\-` is put after
the first character of each control string, so no control string is left in a text. The machine's transitions say
which role may follow which; turns that break them are marked, never dropped.

Turns are dealt out by conversation and sorted within the tasks, then streamed: a task holds one batch of turns and
one state, whatever a conversation's length. (A digest of a whole conversation is sequential by definition.)

Defined cases: a null text is empty and a null role is the role ``; rows repeating a (conv_id, turn) all stay, in
the order of role and text; turns without a number come first; a null conv_id is a conversation of its own; an
empty table gives no rows; only the named columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType


@dataclass(frozen=True)
class Turn:
    before: str
    after: str
    loss: bool = False


@dataclass(frozen=True)
class Template:
    """`other` serves the roles that are not in `turns`; its `{role}` stands for the escaped name."""

    turns: Mapping[str, Turn]
    other: Turn
    controls: tuple[str, ...]
    #: Allowed steps of the machine: state (the last role, or `start`) -> roles; `ends` are its final states.
    steps: Mapping[str, tuple[str, ...]]
    ends: tuple[str, ...]
    _escape: object = field(init=False, compare=False, repr=False)

    def __post_init__(self) -> None:
        heads = "|".join(f"{regex.escape(c[0])}(?={regex.escape(c[1:])})" for c in self.controls)
        object.__setattr__(self, "_escape", regex.compile(rf"\\|{heads}"))

    def escape(self, text: str) -> str:
        return self._escape.sub(lambda m: r"\\" if m[0] == "\\" else m[0] + r"\-", text)

    def render(self, role: str, text: str) -> tuple[str, str, str, bool]:
        """Control text before, escaped text, control text after, loss flag."""
        turn = self.turns.get(role, self.other)
        return turn.before.replace("{role}", self.escape(role)), self.escape(text), turn.after, turn.loss

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of each turn of a formatted conversation."""
        out, at = [], 0
        while at < len(formatted):
            role, before, after = next(
                (r, t.before, t.after) for r, t in [*self.turns.items(), (None, self.other)] if formatted.startswith(t.before.split("{role}")[0], at)
            )
            if role is None:
                head, tail = before.split("{role}")
                close = formatted.index(tail, at + len(head))
                role, at = unescape(formatted[at + len(head) : close]), close + len(tail)
            else:
                at += len(before)
            close = formatted.index(after, at)
            out.append((role, unescape(formatted[at:close])))
            at = close + len(after)
        return out


def unescape(text: str) -> str:
    return _CODES.sub(lambda m: "\\" if m[0] == r"\\" else "", text)


_CODES = regex.compile(r"\\\\|\\-")

INST = Template(
    turns={"system": Turn("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": Turn("<s>[INST] ", " [/INST]"), "assistant": Turn(" ", "</s>", True)},
    other=Turn("<<TURN {role} TURN>>", "<</TURN>>"),
    controls=("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<TURN ", " TURN>>", "<</TURN>>"),
    steps={"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
    ends=("assistant",),
)

_SEGMENT = [StructField("turn", IntegerType()), StructField("part", StringType()), StructField("text", StringType()), StructField("loss", BooleanType()), StructField("allowed", BooleanType())]


def _streamed(df: DataFrame, conv_id: str, order: list[str]) -> DataFrame:
    return df.repartition(conv_id).sortWithinPartitions(conv_id, *order)


def segments(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template = INST) -> DataFrame:
    """Three segments a turn (before, text, after): conv_id, turn (from 0), part, text, loss, allowed by the machine."""
    out = StructType([turns.schema[conv_id], *_SEGMENT])
    arrow = to_arrow_schema(out)
    rows = turns.select(conv_id, turn, role, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, n = object(), "start", 0
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                made = []
                for c, _, r, t in zip(*[column.to_pylist() for column in batch.slice(lo, 1000).columns]):
                    if c != conv:
                        conv, state, n = c, "start", 0
                    r = r or ""
                    before, inner, after, loss = template.render(r, t or "")
                    allowed = r in template.steps.get(state, ())
                    made += [(c, n, "before", before, False, allowed), (c, n, "text", inner, loss, allowed), (c, n, "close", after, False, allowed)]
                    state, n = r, n + 1
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made), arrow)], schema=arrow)

    return _streamed(rows, conv_id, [turn, role, text]).mapInArrow(run, out)


def read_back(formatted: DataFrame, conv_id: str = "conv_id", template: Template = INST) -> DataFrame:
    """Per conversation, parsed from the segments' text: turns, their digest, what the loss mask holds, validity."""
    out = StructType(
        [
            formatted.schema[conv_id],
            StructField("n_turns", LongType()),
            StructField("turns_sha256", StringType()),
            StructField("loss_chars", LongType()),
            StructField("loss_sha256", StringType()),
            StructField("formatted_chars", LongType()),
            StructField("valid", BooleanType()),
        ]
    )
    arrow = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, held, digests, pending = object(), None, None, ""

        def ended() -> list[tuple]:
            if held is None:
                return []
            n, chars, total, good, state = held
            return [(conv, n, digests[0].hexdigest(), chars, digests[1].hexdigest(), total, good and state in template.ends)]

        for batch in batches:
            made: list[tuple] = []
            for c, part, text, loss, allowed in zip(*[column.to_pylist() for column in batch.columns]):
                if held is None or c != conv:
                    made += ended()
                    conv, held, digests, pending = c, [0, 0, 0, True, "start"], (hashlib.sha256(), hashlib.sha256()), ""
                pending += text
                held[2] += len(text)
                if loss:
                    plain = unescape(text)
                    held[1] += len(plain)
                    digests[1].update(plain.encode())
                if part == "close":
                    for role, plain in template.parse(pending):
                        held[0] += 1
                        digests[0].update(f"{role}\n{plain}\n".encode())
                        held[4] = role
                    held[3] &= allowed
                    pending = ""
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*made), arrow)], schema=arrow)
        if rest := ended():
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rest), arrow)], schema=arrow)

    rank = F.when(F.col("part") == "before", 0).when(F.col("part") == "text", 1).otherwise(2)
    rows = formatted.withColumn("_rank", rank).repartition(conv_id).sortWithinPartitions(conv_id, "turn", "_rank")
    return rows.select(conv_id, "part", "text", "loss", "allowed").mapInArrow(run, out)
