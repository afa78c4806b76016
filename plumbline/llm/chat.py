"""Chat formatting by prefix-target expansion: every assistant turn becomes an example of its own, with all turns
before it as context and only that reply under the loss mask.

Rows are dealt by conversation and sorted; each task keeps the running text of one conversation, never a whole group of
rows, and gives an example out as soon as its reply is read. The written size grows with the square of a conversation's
length, as the expansion asks for; a task's memory only with its length.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import partitions

#: The template's marks around a turn's text.
MARKS = {
    "system": ("<<SYS>>", "<</SYS>>"),
    "user": ("[INST] ", " [/INST]"),
    "assistant": ("<s>", "</s>"),
}
#: Around the name of any other role, and behind its text.
ROLE, NAMED, OTHER_END = "<<ROLE>>", "<</ROLE>>", "<</TEXT>>"
CONTROL = re.compile("|".join(map(re.escape, [*(m.strip() for pair in MARKS.values() for m in pair), ROLE, NAMED, OTHER_END])))
SLASHED = re.compile(r"\\(\\?)")

EXAMPLES = "conv_id long, example long, n_turns long, formatted string, loss_start long, loss_end long"
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def escape(text: str) -> str:
    """Backslashes are doubled, and one is put inside each control string; unescape() undoes both."""
    return CONTROL.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return SLASHED.sub(r"\1", text)


def format_turn(role: str | None, text: str | None) -> tuple[str, int, int]:
    """The turn's text in the template, and where the escaped text begins and ends in it."""
    own = escape(text or "")
    before, after = MARKS.get(role, (f"{ROLE}{escape(role or '')}{NAMED}", OTHER_END))
    return before + own + after, len(before), len(before) + len(own)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of an example."""
    out, at = [], 0
    while at < len(formatted):
        for role, (before, after) in MARKS.items():  # noqa: B007
            if formatted.startswith(before, at):
                at += len(before)
                break
        else:
            if not formatted.startswith(ROLE, at):
                raise ValueError(f"no turn begins at {at}")
            end = formatted.index(NAMED, at)
            role, after, at = unescape(formatted[at + len(ROLE) : end]), OTHER_END, end + len(NAMED)
        end = formatted.index(after, at)
        out.append((role, unescape(formatted[at:end])))
        at = end + len(after)
    return out


def _batches(rows: Iterator[tuple], schema: str, cost: int, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of about `limit` characters in the column numbered `cost`."""
    fields = [f.split() for f in schema.split(", ")]
    kinds, held, size = [{"long": pa.int64(), "string": pa.string()}[k] for _, k in fields], [], 0

    def batch() -> pa.RecordBatch:
        cols = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=[n for n, _ in fields])

    for row in rows:
        held.append(row)
        size += 100 + (len(row[cost]) if isinstance(row[cost], str) else 0)
        if size >= limit:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(c[i].as_py() for c in batch.columns)


def format_conversations(turns: DataFrame) -> DataFrame:
    """Examples of all conversations in `turns` (conv_id, turn, role, text), in order within each conversation.

    Columns: conv_id, example (from 0), n_turns in the example, formatted, and the loss mask as code points from
    loss_start up to loss_end. What follows the last reply, or a conversation without one, becomes a last example with
    an empty mask, so that every turn is in the output. Turns are taken by `turn` (nulls first), then role, then text; a
    repeated row is a turn of its own. A null text is empty; a null role is written as an empty name; rows with a null
    conv_id make one conversation. Other columns are ignored and an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def examples() -> Iterator[tuple]:
            now: Any = run  # no conversation yet
            context, pending, turn, example = "", 0, 0, 0
            for conv_id, role, text in _records(batches):
                if conv_id != now:
                    if pending:
                        yield now, example, turn, context, len(context), len(context)
                    now, context, pending, turn, example = conv_id, "", 0, 0, 0
                own, begin, end = format_turn(role, text)
                before = len(context)
                context += own
                turn += 1
                pending += 1
                if role == "assistant":
                    yield now, example, turn, context, before + begin, before + end
                    example += 1
                    pending = 0
            if pending:
                yield now, example, turn, context, len(context), len(context)

        return _batches(examples(), EXAMPLES, 3)

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.select("conv_id", "role", "text").mapInArrow(run, EXAMPLES)


def read_back(examples: DataFrame) -> DataFrame:
    """A row for each conversation, from its examples alone as format_conversations() leaves them (in order and side by
    side): n_turns and the digest of the turns from the last example, characters and digest of all text under the masks
    without escapes, and the characters of all examples. A null conv_id is a conversation like any other, other columns are
    ignored, and no examples give no rows. Nothing may come between the two steps that deals rows anew: it follows
    format_conversations() in the same task, or reads files that were written from it one for one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def digests() -> Iterator[tuple]:
            now: Any = run
            last, chars, total, loss = "", 0, 0, hashlib.sha256()

            def done() -> tuple:
                turns, whole = parse(last), hashlib.sha256()
                for role, text in turns:
                    whole.update(f"{role}\n{text}\n".encode())
                return now, len(turns), whole.hexdigest(), chars, loss.hexdigest(), total

            for conv_id, _, _, formatted, begin, end in _records(batches):
                if conv_id != now:
                    if now is not run:
                        yield done()
                    now, chars, total, loss = conv_id, 0, 0, hashlib.sha256()
                last = formatted
                total += len(formatted)
                text = unescape(formatted[begin:end])
                chars += len(text)
                loss.update(text.encode())
            if now is not run:
                yield done()

        return _batches(digests(), DIGESTS, 2)

    return examples.mapInArrow(run, DIGESTS)
