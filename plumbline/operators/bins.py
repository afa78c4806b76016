"""Depth cells: the blocks of records, the proof that a file's records share a layout, and records without their last
cells."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import byte_at, u16
from ..sources.pd0 import checksum
from ..vocabulary import BOTTOM_TRACK, CELL_BLOCKS, FIXED_LEADER, VARIABLE_LEADER

SUPPORTED = [FIXED_LEADER, VARIABLE_LEADER, *CELL_BLOCKS, BOTTOM_TRACK]


def blocks(records: DataFrame) -> DataFrame:
    """`records` with `blocks`, array<struct<id, offset, length>>: a block ends where the next begins."""
    ends = F.concat(F.slice("offsets", 2, F.size("offsets")), F.array("byte_count"))
    lengths = F.zip_with("offsets", ends, lambda a, b: b - a)
    return records.withColumn("blocks", F.arrays_zip(F.col("ids").alias("id"), F.col("offsets").alias("offset"), lengths.alias("length")))


def layouts(records: DataFrame) -> DataFrame:
    """(blocks, beams, cells, cell_cm, records, first_start): each distinct layout of `records`; a sound file has one."""
    leader = F.col("fixed_leader")
    rows = blocks(records).select("start", "blocks", byte_at(leader, 8).alias("beams"), byte_at(leader, 9).alias("cells"), u16(leader, 12).alias("cell_cm"), "total_bytes")
    return rows.groupBy("blocks", "beams", "cells", "cell_cm", "total_bytes").agg(F.count("*").alias("records"), F.min("start").alias("first_start"))


@dataclass(frozen=True)
class TrimPlan:
    """What a proven trim does to every record."""

    ids: tuple[str, ...]
    offsets: tuple[int, ...]
    lengths: tuple[int, ...]
    beams: int
    cells: int
    cell_cm: int
    remove: int
    records: int
    record_bytes: int

    @property
    def cells_left(self) -> int:
        return self.cells - self.remove

    def kept_length(self, k: int) -> int:
        own = CELL_BLOCKS.get(self.ids[k])
        return self.lengths[k] if own is None else 2 + self.cells_left * self.beams * own[1]

    @property
    def removed_bytes(self) -> int:
        return sum(n - self.kept_length(k) for k, n in enumerate(self.lengths))


def trim_effect(cells: F.Column, beams: F.Column, cell_cm: F.Column, remove: F.Column) -> F.Column:
    """struct<cells_left, removed_metres, removed_bytes>: what taking `remove` cells off a record does; metres as text."""
    width = sum(w for _, w in CELL_BLOCKS.values())
    metres = F.format_string("%.2f", remove * cell_cm / F.lit(100.0))
    return F.struct((cells - remove).alias("cells_left"), metres.alias("removed_metres"), (remove * beams * width).alias("removed_bytes"))


def refusal(remove: F.Column) -> F.Column:
    """Why the records of a row of layouts() can't lose `remove` cells, or null if they can: the first rule that is
    broken. A layout must consist of known blocks, each once, whose lengths follow from the fixed leader."""
    blocks_, ids = F.col("blocks"), F.col("blocks.id")
    times = lambda ident: F.size(F.filter(ids, lambda i: i == ident))
    strange = F.filter(ids, lambda i: ~i.isin(SUPPORTED))
    whole = F.lit(True)
    for ident in CELL_BLOCKS:
        whole = whole & (times(ident) == 1)

    def length_fault(ident: str, name: str, width: int) -> F.Column:
        length = F.filter(blocks_, lambda b: b["id"] == ident)[0]["length"]
        text = F.format_string(f"{name} has %d bytes, not those of %d cells x %d beams x {width}", length, F.col("cells"), F.col("beams"))
        return F.when(length != 2 + F.col("cells") * F.col("beams") * width, text)

    return F.coalesce(
        F.when(remove <= 0, "a trim removes one cell at least"),
        F.when(F.size(strange) > 0, F.concat(F.lit("block "), F.try_element_at(strange, F.lit(1)), F.lit(" is not one that a trim knows"))),
        F.when(~whole, "each block of cells must be there once"),
        F.when((times(FIXED_LEADER) != 1) | (times(VARIABLE_LEADER) != 1) | (times(BOTTOM_TRACK) > 1), "a leader or the bottom track is there twice or missing"),
        F.when(F.least("beams", "cells", "cell_cm") <= 0, "beams, cells or cell size are zero"),
        F.when(remove >= F.col("cells"), F.format_string("a trim leaves one cell at least: remove 1 to %d", F.col("cells") - 1)),
        *[length_fault(ident, *own) for ident, own in CELL_BLOCKS.items()],
    )


def prove_trim(found: DataFrame, remove: int) -> TrimPlan:
    """A plan from the layouts() of a file's records, or a ValueError that says what can't be proven. Two distinct layouts
    are enough to refuse, so no more than two rows are fetched."""
    rows = found.withColumn("refusal", refusal(F.lit(remove))).orderBy("first_start").limit(2).collect()
    if not rows:
        raise ValueError("nothing to trim: the file holds no complete record with a valid checksum")
    first = rows[0]
    faults = [first.refusal] if first.refusal else ["records differ in their blocks or in their numbers of beams and cells"] if len(rows) > 1 else []
    if faults:
        raise ValueError(f"no trim: {faults[0]}")
    fields = zip(*[(b.id, b.offset, b.length) for b in first.blocks], strict=True)
    return TrimPlan(*map(tuple, fields), first.beams, first.cells, first.cell_cm, remove, first.records, first.total_bytes)


def trimmed(record: bytes, plan: TrimPlan) -> bytes:
    """A record without its last cells: shorter cell blocks, the new number of cells, new offsets, length and checksum."""
    head = 6 + 2 * len(plan.ids)
    parts = [record[o : o + plan.kept_length(k)] for k, o in enumerate(plan.offsets)]
    leader = plan.ids.index(FIXED_LEADER)
    parts[leader] = parts[leader][:9] + bytes([plan.cells_left]) + parts[leader][10:]
    starts, at = [], head
    for part in parts:
        starts.append(at)
        at += len(part)
    body = record[:2] + struct.pack("<H", at) + record[4:6] + struct.pack(f"<{len(starts)}H", *starts) + b"".join(parts)
    return body + struct.pack("<H", checksum(body))


def trim_cells(records: DataFrame, plan: TrimPlan) -> DataFrame:
    """(start, payload) of every record, trimmed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([trimmed(x.as_py(), plan) for x in batch.column(1)], type=pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["start", "payload"])

    return records.select("start", "payload").mapInArrow(run, "start long, payload binary")


def trim_faults(source: DataFrame, output: DataFrame, plan: TrimPlan) -> DataFrame:
    """(physical_index, fault) of records whose trimmed form isn't what it must be, block by block.
    Both sides: blocks() with physical_index and payload. Only records with a fault are taken apart into rows."""
    side = lambda df, p: blocks(df).select("physical_index", F.transform("blocks", lambda b: F.struct(b["id"].alias("id"), F.substring(F.col("payload"), b["offset"] + 1, b["length"]).alias("bytes"))).alias(p))
    kept = F.create_map(*[F.lit(x) for k in range(len(plan.ids)) for x in (k, plan.kept_length(k))])

    def wanted(b: F.Column, k: F.Column) -> F.Column:
        own = F.when(b["id"] == FIXED_LEADER, F.concat(F.substring(b["bytes"], F.lit(1), F.lit(9)), F.lit(bytes([plan.cells_left])), F.substring(b["bytes"], F.lit(11), F.length(b["bytes"])))).otherwise(b["bytes"])
        return F.struct(b["id"].alias("id"), F.substring(own, F.lit(1), kept[k]).alias("bytes"))

    want = side(source, "s").withColumn("s", F.transform("s", wanted))
    both = want.join(side(output, "o"), "physical_index", "full").where(~F.col("s").eqNullSafe(F.col("o")))
    none = F.array().cast("array<struct<id: string, bytes: binary>>")
    each = both.select("physical_index", F.explode(F.arrays_zip(F.coalesce("s", none).alias("s"), F.coalesce("o", none).alias("o"))).alias("b"))
    wrong = ~F.col("b.s").eqNullSafe(F.col("b.o"))
    return each.where(wrong).select("physical_index", F.concat(F.lit("block "), F.coalesce("b.s.id", "b.o.id"), F.lit(" changed")).alias("fault"))
