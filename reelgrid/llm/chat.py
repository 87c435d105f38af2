"""Chat formatting: a role machine checks the order of turns, a declarative template emits segments.

A template is data: the roles with their allowed followers, headers, the end mark and which roles'
texts carry loss. Every turn becomes four segments (header, text, end mark, separator), each with a
loss flag. Control strings inside texts are escaped so that the written conversation can be read back
exactly. Which state the machine is in follows from the role before, so a turn is judged by its
predecessor alone.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


@dataclass(frozen=True)
class Template:
    """``follows`` maps a state (``""`` at the start, then the last role) to the roles that may come next."""

    follows: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user",),
        }
    )
    loss: tuple[str, ...] = ("assistant",)
    opening: str = "### "
    closing: str = ": "
    end: str = "</turn>"
    separator: str = "\n"
    escape: str = "\\"

    def escapes(self) -> list[tuple[str, str]]:
        """What is written for each control string; the escape sign itself comes first."""
        return [
            (self.escape, self.escape + "b"),
            (self.opening, self.escape + "h"),
            (self.end, self.escape + "e"),
            (self.closing, self.escape + "c"),
        ]


def _escaped(template: Template, text: Column, head: bool) -> Column:
    for raw, written in template.escapes() if head else template.escapes()[:3]:
        text = F.replace(text, F.lit(raw), F.lit(written))
    return text


def format_turns(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per turn: ``conv_id, turn, n, valid, segments`` with ``segments`` of ``(text, loss)``.

    ``n`` numbers the turns of a conversation in the order of turn, role and text (nulls first), so ties
    and repeated rows have a defined order. ``valid`` tells whether the role may follow the one before.
    A null or unknown role never may; a null role is written as an empty one, a null text as an empty
    one. Turns are formatted whatever ``valid`` says; a null ``conv_id`` is one conversation. Other
    columns are left out.
    """
    template = template or Template()
    own = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    state = F.coalesce(F.lag("role").over(order), F.lit(""))
    moves = F.array(*[F.lit(f"{a}\0{b}") for a, after in template.follows.items() for b in after])
    head = F.concat(F.lit(template.opening), _escaped(template, F.col("role"), True), F.lit(template.closing))

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    return own.select(
        "conv_id",
        "turn",
        F.row_number().over(order).alias("n"),
        F.array_contains(moves, F.concat(state, F.lit("\0"), F.col("role"))).alias("valid"),
        F.array(
            segment(head, F.lit(False)),
            segment(_escaped(template, F.col("text"), False), F.col("role").isin(*template.loss)),
            segment(F.lit(template.end), F.lit(False)),
            segment(F.lit(template.separator), F.lit(False)),
        ).alias("segments"),
    )


class Reader:
    """Reads one written turn at a time."""

    def __init__(self, template: Template) -> None:
        self.template = template
        self.plain = {written: raw for raw, written in template.escapes()}
        self.marks = re.compile("|".join(re.escape(w) for w in self.plain)).sub

    def unescape(self, text: str) -> str:
        return self.marks(lambda m: self.plain[m[0]], text) if self.template.escape in text else text

    def turn(self, written: str) -> tuple[str, str]:
        """Role and text of one turn as written, from header to separator."""
        t = self.template
        if not written.startswith(t.opening) or not written.endswith(t.end + t.separator):
            raise ValueError("not a turn of this template")
        role, _, text = written[len(t.opening) : -len(t.end + t.separator)].partition(t.closing)
        return self.unescape(role), self.unescape(text)

    def conversation(self, written: str) -> list[tuple[str, str]]:
        """All turns of a whole conversation as written."""
        ends = self.template.end + self.template.separator
        found, at = [], 0
        while at < len(written):
            stop = written.index(ends, at) + len(ends)
            found.append(self.turn(written[at:stop]))
            at = stop
        return found


def read_back(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Per conversation: digests of the turns parsed from its segments, and of the text under loss.

    Conversations stream turn by turn through running digests, so that one of any length needs no more
    memory than its longest turn.
    """
    template = template or Template()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(template)
        own, state, done = object(), None, []

        def row() -> dict:
            n, turns, chars, loss, size, valid = state
            return {
                "conv_id": own, "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars,
                "loss_sha256": loss.hexdigest(), "formatted_chars": size, "valid": valid,
            }

        for batch in batches:
            for conv, valid, parts in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "valid", "segments")), strict=True):
                if state is None or conv != own:
                    if state is not None:
                        done.append(row())
                    own, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, True]
                written = "".join(p["text"] for p in parts)
                role, text = reader.turn(written)
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
                for p in parts:
                    if p["loss"]:
                        learned = reader.unescape(p["text"])
                        state[2] += len(learned)
                        state[3].update(learned.encode())
                state[4] += len(written)
                state[5] = state[5] and valid
            yield pa.RecordBatch.from_pylist(done, schema=_DIGESTS)
            done = []
        if state is not None:
            yield pa.RecordBatch.from_pylist([row()], schema=_DIGESTS)

    return (
        formatted.select("conv_id", "n", "valid", "segments")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "n")
        .mapInArrow(
            run,
            "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string,"
            " formatted_chars bigint, valid boolean",
        )
    )


_DIGESTS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("n_turns", pa.int64()),
        ("turns_sha256", pa.string()),
        ("loss_chars", pa.int64()),
        ("loss_sha256", pa.string()),
        ("formatted_chars", pa.int64()),
        ("valid", pa.bool_()),
    ]
)
