"""Operator 4, chat formatting by a finite-state machine over roles.

A declarative template names, for each role, the control strings around its text and whether the text counts
for the loss. The machine walks a conversation's turns in order, checks each step against the allowed ones and
emits text segments with a loss flag. Control strings inside texts are broken by a backslash and backslashes are
doubled, so a formatted conversation reads back to exactly its turns.

Plan: one exchange by conversation and a sort by turn within partitions; then the turns stream through the
machine with the state of one conversation in memory, whatever its length. A conversation is read in
one task because its state and digest are sequential, but never held.

Cases: null role counts as the empty role, null text as empty; roles outside the template are written with their
name and break the order; turns with equal numbers stand by role, then text; a null turn comes first; a null
conversation id is a conversation; repeated rows are turns; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlark.llm.shared import bounded_batches


@dataclass(frozen=True)
class Template:
    """``turns``: role -> (opening, closing, text counts for the loss). Openings and closings start with a control string
    but for white space before closings. ``other``: opening, end of the role's name, closing. ``order``: role -> roles that may follow."""

    turns: dict[str, tuple[str, str, bool]]
    other: tuple[str, str, str]
    controls: tuple[str, ...]
    order: dict[str | None, tuple[str, ...]] = field(default_factory=dict)

    def escape(self, text: str) -> str:
        return re.sub("|".join(map(re.escape, self.controls)), lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))

    @staticmethod
    def unescape(text: str) -> str:
        return re.sub(r"\\(\\?)", r"\1", text)

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        """The formatted turn."""
        if role in self.turns:
            opening, closing, loss = self.turns[role]
            return [(opening, False), (self.escape(text), loss), (closing, False)]
        opening, middle, closing = self.other
        return [(opening + self.escape(role) + middle, False), (self.escape(text), False), (closing, False)]

    def read(self, formatted: str) -> Iterator[tuple[str, str, bool]]:
        """(role, text, loss) of each turn of a formatted conversation."""
        at = 0
        while at < len(formatted):
            for role, (opening, closing, loss) in self.turns.items():
                if formatted.startswith(opening, at):
                    at += len(opening)
                    break
            else:
                opening, middle, closing = self.other
                if not formatted.startswith(opening, at):
                    raise ValueError(f"no turn starts at {at}")
                end = formatted.index(middle, at + len(opening))
                role, loss, at = self.unescape(formatted[at + len(opening) : end]), False, end + len(middle)
            end = formatted.index(closing, at)
            yield role, self.unescape(formatted[at:end]), loss
            at = end + len(closing)


#: The default template (fixed values).
TEMPLATE = Template(
    turns={"system": ("[SYS] ", " [/SYS]", False), "user": ("[INST] ", " [/INST]", False), "assistant": ("<s> ", "</s>", True)},
    other=("[ROLE]", "[/ROLE]", "[/TURN]"),
    controls=("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]", "[ROLE]", "[/ROLE]", "[/TURN]"),
    order={None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)},
)
_NONE = object()
SEGMENTS = "conv_id long, turn long, role string, segments array<struct<text:string,loss:boolean>>, in_order boolean"


def format_turns(turns: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """conv_id, turn, role, text -> per turn, in order within each partition: its segments, and whether the
    conversation's roles have been in order so far."""
    bounded_batches(turns.sparkSession)
    kind = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, state, good = _NONE, None, True
        for batch in batches:
            out: list[list] = [[], []]
            conv, turn, roles, texts = (c.to_pylist() for c in batch.columns)
            for c, role, text in zip(conv, roles, texts):
                if held is _NONE or c != held:
                    held, state, good = c, None, True
                good = good and role in template.order.get(state, ())
                state = role
                out[0].append([{"text": t, "loss": loss} for t, loss in template.segments(role, text)])
                out[1].append(good)
            yield pa.RecordBatch.from_arrays([pa.array(conv, pa.int64()), pa.array(turn, pa.int64()), pa.array(roles, pa.string()), pa.array(out[0], kind), pa.array(out[1], pa.bool_())], ["conv_id", "turn", "role", "segments", "in_order"])

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, SEGMENTS)


def digests(formatted: DataFrame, template: Template = TEMPLATE) -> DataFrame:
    """Per conversation, read back from the segments of ``format_turns``: the number of turns, digests of the turns and
    of the text under the loss mask, characters of the formatted text, and whether all roles were in order."""
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, in_order boolean"
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _NONE
        out: list[tuple] = []

        def start():
            return {"n": 0, "turns": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "good": True}

        def close(conv, s):
            out.append((conv, s["n"], s["turns"].hexdigest(), s["loss_chars"], s["loss"].hexdigest(), s["chars"], s["good"]))

        def table():
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], names)

        s = start()
        for batch in batches:
            for conv, segments, good in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if held is not _NONE and conv != held:
                    close(held, s)
                    s = start()
                held = conv
                whole = "".join(x["text"] for x in segments)
                s["chars"] += len(whole)
                s["good"] = good
                for role, text, _ in template.read(whole):
                    s["n"] += 1
                    s["turns"].update(f"{role}\n{text}\n".encode())
                under = template.unescape("".join(x["text"] for x in segments if x["loss"]))
                s["loss"].update(under.encode())
                s["loss_chars"] += len(under)
            if out:
                yield table()
                out.clear()
        if held is not _NONE:
            close(held, s)
            yield table()

    return formatted.mapInArrow(run, schema)
