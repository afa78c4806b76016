"""Scan of PD0 files: framed binary records, the byte regions between them, and damaged records at a file's edges.

Finding records is sequential within a file: where the search goes on depends on the record found before. That, and
nothing else, is the kernel here. It runs over Spark's binaryFile source, a task for each file, wherever Spark can read.
Of files that all machines can open, small ones share a task, and a larger one is walked once for the places where its
blocks begin; then each block is a task, and none of them holds more than a stretch of it. Neighbours with equal headers are tested and told about together.
All that can be told from a record's own bytes afterwards is left to native expressions.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import counter24, lower_hex, rtc_stamp, rtc_text
from ..vocabulary import BAD_CHECKSUM, FRAGMENT, NON_PD0, SYNC, TRUNCATED, VALID

#: kind: file, region, record or edge (a damaged record at a file's edge).
SCAN_SCHEMA = (
    "path string, size long, kind string, start long, end long, classification string, reason string, is_candidate boolean, "
    "declared long, side string, byte_count int, offsets array<int>, ids array<string>, number_lsb int, number_msb int, "
    "clock binary, fixed_leader binary, stored_checksum int, calculated_checksum int, checksum_present boolean, digest string, payload binary"
)

#: Files above so many bytes are scanned in blocks of about so many. A record has at most 65,537 bytes; that many and its
#: neighbour's header are in reach of every place that a search comes to.
BLOCK, REACH = 8 << 20, 66_000
#: What opening a file counts for, in bytes, where small files are put together.
OPENING = 16 << 10
#: Fewer neighbours than these are told about one by one; more are told about in parts of so many bytes.
FEW, TOLD_BYTES = 8, 4 << 20


@dataclass(frozen=True)
class Frame:
    """A validated record in a buffer."""

    start: int
    byte_count: int
    offsets: tuple[int, ...]
    stored: int

    @property
    def end(self) -> int:
        return self.start + self.byte_count + 2


@dataclass(frozen=True)
class Fault:
    """Why no record begins at a place."""

    classification: str
    reason: str
    declared: int | None

    def __str__(self) -> str:
        return f"{self.classification}: {self.reason}"


def _layout_faults(data: bytes, at: int, count: int, offsets: tuple[int, ...]) -> Iterator[tuple[bool, str]]:
    """Tests of a record's table of offsets, in the order in which they are reported."""
    head = 6 + 2 * len(offsets)
    yield offsets[0] != head, f"first offset {offsets[0]} != header length {head}"
    yield max(offsets) >= count, "data-type offset beyond checksum coverage"
    yield any(np.diff(offsets) <= 0), "data-type offsets not strictly increasing"
    ids = [data[at + o : at + o + 2] for o in offsets[:2]]
    yield ids[0] != b"\x00\x00", "missing fixed leader at first offset"
    yield ids[1] != b"\x80\x00", "missing variable leader at second offset"
    fixed, variable = (b - a for a, b in zip(offsets[:2], [*offsets[1:], count][:2], strict=True))
    yield fixed < 40, f"short fixed leader length {fixed}"
    yield variable < 18, f"short variable leader length {variable}"


def frame_at(data: bytes, at: int) -> Frame | Fault:
    """The record that begins at `at`, or the first test that it fails."""
    if at + 6 > len(data):
        return Fault(TRUNCATED, "incomplete header", None)
    if data[at : at + 2] != SYNC:
        return Fault(NON_PD0, "missing sync", None)
    (count,) = struct.unpack_from("<H", data, at + 2)
    size, kinds = count + 2, data[at + 5]
    if count < 6:
        return Fault(NON_PD0, f"implausible byte count {count}", size)
    if at + size > len(data):
        return Fault(TRUNCATED, f"declared {size} bytes beyond EOF", size)
    if not 2 <= kinds <= 64:
        return Fault(NON_PD0, f"implausible data type count {kinds}", size)
    if 6 + 2 * kinds > count:
        return Fault(FRAGMENT, "header length exceeds ensemble byte count", size)
    offsets = struct.unpack_from(f"<{kinds}H", data, at + 6)
    for failed, reason in _layout_faults(data, at, count, offsets):
        if failed:
            return Fault(FRAGMENT, reason, size)
    (stored,) = struct.unpack_from("<H", data, at + count)
    total = checksum(data[at : at + count])
    if stored != total:
        return Fault(BAD_CHECKSUM, f"stored 0x{stored:04x} != calculated 0x{total:04x}", size)
    return Frame(at, count, offsets, stored)


def checksum(data: bytes) -> int:
    return int(np.frombuffer(data, dtype=np.uint8).sum(dtype=np.uint64)) & 0xFFFF


def walk(data: bytes) -> Iterator[tuple[int, int, Frame | Fault]]:
    """(begin, end, finding) of all regions in the order of the search. After a candidate that fails, the search goes on
    one byte later, so its region and the next can overlap; a truncated one reaches as far as it declares."""
    at = 0
    while at < len(data):
        hit = data.find(SYNC, at)
        if hit < 0:
            yield at, len(data), Fault(NON_PD0, "no further sync bytes", None)
            return
        if hit > at:
            yield at, hit, Fault(NON_PD0, "bytes between validated candidates", None)
        found = frame_at(data, hit)
        if isinstance(found, Frame):
            yield hit, found.end, found
            at = found.end
        else:
            reach = found.declared if found.classification == TRUNCATED and found.declared is not None else 2
            yield hit, min(len(data), hit + reach), found
            at = hit + 1


def walk_strict(data: bytes) -> Iterator[tuple[int, int, Frame | Fault]]:
    """Records from byte 0, one behind the other; the first that fails is the last finding."""
    at = 0
    while at < len(data):
        found = frame_at(data, at)
        if isinstance(found, Fault):
            yield at, len(data), found
            return
        yield at, found.end, found
        at = found.end


def walk_lengths(data: bytes) -> Iterator[tuple[int, int, Frame | Fault]]:
    """Records by their declared lengths alone, checksums unseen; for checking outputs."""
    at = 0
    while at + 6 <= len(data) and data[at : at + 2] == SYNC:
        (count,) = struct.unpack_from("<H", data, at + 2)
        kinds = data[at + 5]
        if at + count + 2 > len(data) or 6 + 2 * kinds > count:
            break
        (stored,) = struct.unpack_from("<H", data, at + count)
        yield at, at + count + 2, Frame(at, count, struct.unpack_from(f"<{kinds}H", data, at + 6), stored)
        at += count + 2
    if at < len(data):
        yield at, len(data), Fault(NON_PD0, "not framed", None)


WALKS = {"resync": walk, "strict": walk_strict, "framing": walk_lengths}


@dataclass(frozen=True)
class Run:
    """Validated records one behind the other with equal headers, the first of them at first.start of `data`."""

    data: bytes
    first: Frame
    number: int


class Stretch:
    """The bytes of an open file, of which only some are held."""

    def __init__(self, file, size: int) -> None:
        self.file, self.size, self.base, self.data = file, size, 0, b""

    def hold(self, at: int) -> None:
        """Hold what is in reach of `at`."""
        if at < self.base or min(self.size, at + REACH) > self.base + len(self.data):
            self.file.seek(at)
            self.base, self.data = at, self.file.read(max(BLOCK // 2, 2 * REACH))

    def find(self, what: bytes, at: int) -> int:
        """The first place of two bytes from `at` on, or -1."""
        while at < self.size:
            self.hold(at)
            found = self.data.find(what, at - self.base)
            if found >= 0:
                return self.base + found
            at = max(at + 1, self.base + len(self.data) - 1)  # the two may lie across the end of what is held
        return -1


class Whole(Stretch):
    """Bytes that are all held."""

    def __init__(self, data: bytes) -> None:
        self.size, self.base, self.data = len(data), 0, data

    def hold(self, at: int) -> None:
        pass


def _alike(data: bytes, first: Frame, most: int) -> int:
    """How many records with the header of `first` follow one another from it on, `most` at most; all pass frame_at()."""
    size, count, head = first.byte_count + 2, first.byte_count, 6 + 2 * len(first.offsets)
    if most < 2 or data[first.end : first.end + head] != data[first.start : first.start + head]:
        return 1
    rows = np.frombuffer(data, dtype=np.uint8, count=most * size, offset=first.start).reshape(most, size)
    fixed, variable = first.offsets[:2]
    good, step = 1, 64
    while good < most:
        own = rows[good : good + step]
        sums = own[:, :count].sum(axis=1, dtype=np.uint32) & 0xFFFF
        stored = own[:, count] | own[:, count + 1].astype(np.uint32) << 8
        ok = (own[:, :head] == rows[0, :head]).all(axis=1) & (sums == stored)
        ok &= (own[:, fixed : fixed + 2] == 0).all(axis=1) & (own[:, variable] == 0x80) & (own[:, variable + 1] == 0)
        if not ok.all():
            return good + int(ok.argmin())
        good += len(own)
        step = min(8 * step, 1 << 15)
    return most


def findings(source: Stretch, mode: str, begin: int = 0, stop: int | None = None) -> Iterator[tuple[int, int, Run | Fault]]:
    """What walk() or walk_strict() finds from `begin` on, until it has come to `stop`; both are places where a search goes
    on. Neighbours alike are one finding."""
    size = source.size
    stop = size if stop is None else stop
    at = begin
    while at < stop:
        if mode == "resync":
            hit = source.find(SYNC, at)
            if hit < 0:
                yield at, size, Fault(NON_PD0, "no further sync bytes", None)
                return
            if hit > at:
                yield at, hit, Fault(NON_PD0, "bytes between validated candidates", None)
            at = hit
        source.hold(at)
        found = frame_at(source.data, at - source.base)
        if isinstance(found, Fault):
            if mode == "strict":
                yield at, size, found
                return
            reach = found.declared if found.classification == TRUNCATED and found.declared is not None else 2
            yield at, min(size, at + reach), found
            at += 1
            continue
        length = found.byte_count + 2
        n = _alike(source.data, found, max(1, min((source.base + len(source.data) - at) // length, -((at - stop) // length))))
        yield at, at + n * length, Run(source.data, found, n)
        at += n * length


def edges(size: int, regions: list[tuple[int, int, Fault]]) -> Iterator[tuple[str, tuple[int, int, Fault]]]:
    """The damaged region that stands for each edge of a file: a truncated record if there is one, else the shortest at
    the beginning, the latest at the end."""
    sides = {
        "leading": ([r for r in regions if r[0] == 0], lambda r: r[1]),
        "trailing": ([r for r in regions if r[1] == size], lambda r: -r[0]),
    }
    for side, (own, rank) in sides.items():
        if own:
            yield side, min(own, key=lambda r: (r[2].classification != TRUNCATED, rank(r)))


def _edge_row(data: bytes, side: str, begin: int, end: int, fault: Fault) -> dict:
    """What can be read of a damaged record: its declared length, offsets, counter and clock."""
    row: dict = {"kind": "edge", "start": begin, "end": end, "classification": fault.classification, "reason": fault.reason, "side": side, "checksum_present": False}
    there = end - begin
    if there < 4 or data[begin : begin + 2] != SYNC:
        return row
    (count,) = struct.unpack_from("<H", data, begin + 2)
    row |= {"declared": count + 2, "checksum_present": there >= count + 2}
    kinds = data[begin + 5] if there >= 6 else 0
    if 2 <= kinds <= 64 and there >= 6 + 2 * kinds:
        row["offsets"] = list(struct.unpack_from(f"<{kinds}H", data, begin + 6))
        leader = row["offsets"][1]
        if there >= leader + 13 and begin + leader + 13 <= len(data):
            row |= _leader(data, begin + leader)
    return row


def _leader(data: bytes, at: int) -> dict:
    return {"number_lsb": struct.unpack_from("<H", data, at + 2)[0], "number_msb": data[at + 11], "clock": data[at + 4 : at + 11]}


def _region_row(begin: int, end: int, found: Fault | None) -> dict:
    if found is None:
        return {"kind": "region", "start": begin, "end": end, "classification": VALID, "reason": VALID, "is_candidate": True, "declared": end - begin}
    sought = found.reason not in ("no further sync bytes", "bytes between validated candidates", "not framed")
    return {"kind": "region", "start": begin, "end": end, "classification": found.classification, "reason": found.reason, "is_candidate": sought, "declared": found.declared}


def _record_row(data: bytes, found: Frame, base: int, mode: str, payloads: bool) -> dict:
    """Of a record in `data`, which begins at `base` of its file."""
    begin, end, offsets, last = found.start, found.end, found.offsets, found.byte_count
    row = {
        "kind": "record", "start": base + begin, "end": base + end, "byte_count": last, "offsets": list(offsets),
        "ids": [data[begin + o : begin + o + 2].hex() for o in offsets],
        "fixed_leader": data[begin + offsets[0] : begin + offsets[1]],
        "stored_checksum": found.stored, "calculated_checksum": found.stored if mode != "framing" else checksum(data[begin : begin + last]),
        "digest": hashlib.sha256(data[begin:end]).hexdigest(), "payload": data[begin:end] if payloads else None,
    }
    return row | _leader(data, begin + offsets[1])


def scan_rows(data: bytes, mode: str = "resync", payloads: bool = True) -> Iterator[dict]:
    """Rows of SCAN_SCHEMA, without path and size, of one file."""
    yield {"kind": "file", "start": 0, "end": len(data)}
    damaged = []
    for begin, end, found in WALKS[mode](data):
        if isinstance(found, Fault):
            damaged.append((begin, end, found))
            yield _region_row(begin, end, found)
            continue
        yield _region_row(begin, end, None)
        yield _record_row(data, found, 0, mode, payloads)
    for side, region in edges(len(data), damaged) if mode == "resync" else ():
        yield _edge_row(data, side, *region)


def _arrow_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
    kinds |= {f"array<{k}>": pa.list_(v) for k, v in list(kinds.items())}
    return pa.schema([(f.split()[0], kinds[f.split()[1]]) for f in SCAN_SCHEMA.split(", ")])


SCHEMA = _arrow_schema()
#: Two bytes as four hex digits, by their value as a big-endian number.
HEX_PAIRS = pa.array([f"{i:04x}" for i in range(1 << 16)])


def _fixed_width(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values."""
    n, width = rows.shape
    ends = np.arange(0, (n + 1) * width, width, dtype=np.int32) if width else np.zeros(n + 1, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _lists(values: pa.Array, n: int) -> pa.Array:
    each = len(values) // n
    return pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * each, each, dtype=np.int32)), values)


def _batch(n: int, columns: dict) -> pa.RecordBatch:
    """`columns`: arrays, or values that all rows share; others are null."""
    made = []
    for f in SCHEMA:
        own = columns.get(f.name)
        made.append(pa.nulls(n, f.type) if own is None else own if isinstance(own, pa.Array) else pa.array(own, f.type) if isinstance(own, np.ndarray) else pa.repeat(pa.scalar(own, f.type), n))
    return pa.RecordBatch.from_arrays(made, schema=SCHEMA)


def _run_batches(fixed: dict, base: int, run: Run, payloads: bool) -> Iterator[pa.RecordBatch]:
    """The rows of _region_row() and _record_row() of all records of a run whose data begins at `base`."""
    first, offsets = run.first, run.first.offsets
    size, last = first.byte_count + 2, first.byte_count
    part = max(1, TOLD_BYTES // (300 + size))
    for i in range(0, run.number, part):
        n = min(part, run.number - i)
        at = first.start + i * size
        rows = np.frombuffer(run.data, dtype=np.uint8, count=n * size, offset=at).reshape(n, size)
        start = base + at + size * np.arange(n, dtype=np.int64)
        yield _batch(n, fixed | {"kind": "region", "start": start, "end": start + size, "classification": VALID, "reason": VALID, "is_candidate": True, "declared": size})
        wide = lambda k: rows[:, k].astype(np.int32)
        stored, leader, own = wide(last) | wide(last + 1) << 8, offsets[1], memoryview(run.data)
        ids = np.stack([wide(o) << 8 | wide(o + 1) for o in offsets], axis=1).ravel()
        yield _batch(n, fixed | {
            "kind": "record", "start": start, "end": start + size, "byte_count": last, "offsets": _lists(pa.array(np.tile(np.array(offsets, dtype=np.int32), n)), n),
            "ids": _lists(HEX_PAIRS.take(pa.array(ids)), n), "number_lsb": wide(leader + 2) | wide(leader + 3) << 8, "number_msb": wide(leader + 11),
            "clock": _fixed_width(rows[:, leader + 4 : leader + 11]), "fixed_leader": _fixed_width(rows[:, offsets[0] : offsets[1]]),
            "stored_checksum": stored, "calculated_checksum": stored, "digest": pa.array([hashlib.sha256(own[a : a + size]).hexdigest() for a in range(at, at + n * size, size)]),
            "payload": _fixed_width(rows) if payloads else None,
        })


def _scan(source: Stretch, path: str, mode: str, payloads: bool, begin: int = 0, stop: int | None = None, ends: list | None = None) -> Iterator[pa.RecordBatch | dict]:
    """SCAN_SCHEMA rows from `begin` to `stop`, one by one or in batches. ends: the edges() of the file, which come with its
    first block; None where all of it is scanned here."""
    fixed = {"path": path, "size": source.size}
    if begin == 0:
        yield {"kind": "file", "start": 0, "end": source.size}
    damaged = []
    for a, b, found in findings(source, mode, begin, stop):
        if isinstance(found, Fault):
            if ends is None:
                damaged.append((a, b, found))
            yield _region_row(a, b, found)
        elif found.number < FEW:
            for k in range(found.number):
                own, size = found.first, found.first.byte_count + 2
                (stored,) = struct.unpack_from("<H", found.data, own.start + k * size + own.byte_count)
                yield _region_row(a + k * size, a + (k + 1) * size, None)
                yield _record_row(found.data, Frame(own.start + k * size, own.byte_count, own.offsets, stored), a - own.start, mode, payloads)
        else:
            yield from _run_batches(fixed, a - found.first.start, found, payloads)
    if mode == "resync" and begin == 0:
        for side, (a, b, fault) in edges(source.size, damaged) if ends is None else ends:
            source.hold(a)
            yield _edge_row(source.data, side, a - source.base, b - source.base, fault) | {"start": a, "end": b}


def _batches(found: Iterator[pa.RecordBatch | dict], path: str, size: int, payloads: bool) -> Iterator[pa.RecordBatch]:
    """Single rows put together; output goes out every few MB."""
    fixed, held, weight = {"path": path, "size": size}, [], 0
    for row in found:
        if isinstance(row, pa.RecordBatch):
            yield row
            continue
        held.append(fixed | row)
        weight += 300 + (2 * (row["end"] - row["start"]) if payloads else 0)
        if weight > 8_000_000:
            yield pa.RecordBatch.from_pylist(held, schema=SCHEMA)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=SCHEMA)


def scan_contents(files: DataFrame, mode: str = "resync", payloads: bool = True) -> DataFrame:
    """SCAN_SCHEMA rows of `files` (path, content). mode: resync finds records between damage, strict stops at the first
    fault, framing trusts declared lengths. Null content counts as empty. Output goes out every few MB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1), strict=True):
                data, name = content.as_py() or b"", path.as_py()
                found = scan_rows(data, mode, payloads) if mode == "framing" else _scan(Whole(data), name, mode, payloads)
                yield from _batches(found, name, len(data), payloads)

    return files.select("path", "content").mapInArrow(run, SCAN_SCHEMA)


def file_contents(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(path, content) of files, a task for each large one. Paths are given to the reader as they are."""
    return spark.read.format("binaryFile").load(paths).select("path", "content")


def opened(path: str) -> str:
    """The name by which Python opens a file of Spark's local file system."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else os.path.abspath(path)


def local_sizes(spark: SparkSession, paths: list[str]) -> dict[str, int]:
    """The sizes of those of `paths` that are files of Spark's local file system, which Python can open, too."""
    plain = spark._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///").startswith("file:")
    local = [p for p in paths if p.startswith("file:") or plain and "://" not in p]
    return {p: os.path.getsize(at) for p, at in zip(local, map(opened, local), strict=True) if os.path.isfile(at)}


def _blocks(path: str, mode: str) -> Iterator[dict]:
    """The blocks of a file (begin, stop), each from where a search goes on to where another does, and its edges."""
    with open(opened(path), "rb") as f:
        size = os.fstat(f.fileno()).st_size
        cuts, at_edges, at = [0], [], 0
        for a, b, found in findings(Stretch(f, size), mode):
            if at - cuts[-1] >= BLOCK:
                cuts.append(at)
            if isinstance(found, Run):
                at = b
                continue
            if found.reason != "bytes between validated candidates":  # a search does not go on there, but at the candidate
                at = a + 1
            if a == 0 or b == size:
                at_edges.append((a, b, found))
    ends = json.dumps([(side, a, b, fault.classification, fault.reason, fault.declared) for side, (a, b, fault) in edges(size, at_edges)])
    for a, b in zip(cuts, [*cuts[1:], size], strict=True):
        yield {"path": path, "begin": a, "stop": b, "ends": ends}


def together(sizes: list[tuple[str, int]], most: int) -> list[list[str]]:
    """Small files (path, bytes) in lists of about `most` bytes."""
    out, weight = [], most
    for path, size in sizes:
        if weight + size + OPENING > most:
            out.append([])
            weight = 0
        out[-1].append(path)
        weight += size + OPENING
    return out


def scan_local(spark: SparkSession, sizes: list[tuple[str, int]], mode: str = "resync", payloads: bool = True) -> DataFrame:
    """scan_contents() of files (path as file:/..., bytes) that Python can open on all machines: a task for each block of a
    large one, small ones together. The driver holds a row for each block or small file."""
    paths = [p for p, size in sizes if size > BLOCK]
    small = [x for x in sizes if x[1] <= BLOCK]
    share = sum(size + OPENING for _, size in small) // (2 * spark.sparkContext.defaultParallelism)
    units = [[(p, 0, None, None) for p in some] for some in together(small, max(1 << 18, min(BLOCK, share)))]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_pylist(list(_blocks(paths[i], mode)))

    n = len(paths)
    found = spark.range(0, n, 1, n).mapInArrow(find, "path string, begin long, stop long, ends string").collect() if n else []
    units += [[tuple(r)] for r in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for unit in batch.column(0).to_pylist():
                for path, begin, stop, ends in json.loads(unit):
                    with open(opened(path), "rb") as f:
                        source = Stretch(f, os.fstat(f.fileno()).st_size)
                        at_edges = ends and [(side, (a, b, Fault(*fault))) for side, a, b, *fault in json.loads(ends)]
                        yield from _batches(_scan(source, path, mode, payloads, begin, stop, at_edges), path, source.size, payloads)

    # of an RDD the optimiser does not suppose that it is small: a range's few bytes would have the records broadcast
    each = spark.createDataFrame(spark.sparkContext.parallelize([(json.dumps(u),) for u in units], len(units)), "unit string")
    return each.mapInArrow(run, SCAN_SCHEMA)


def scan_files(spark: SparkSession, paths: list[str], mode: str = "resync", payloads: bool = True) -> DataFrame:
    """scan_contents() of files; where all machines can open them, large ones in blocks and small ones together."""
    sizes = local_sizes(spark, paths) if mode != "framing" else {}
    # Spark does not list small files whose names begin so
    own = {p: n for p, n in sizes.items() if n > BLOCK or not os.path.basename(opened(p)).startswith((".", "_"))}
    others = [p for p in paths if p not in own]
    found = [scan_contents(file_contents(spark, others), mode, payloads)] if others or not own else []
    if own:
        found.append(scan_local(spark, [(f"file:{opened(p)}", own[p]) for p in paths if p in own], mode, payloads))
    return found[0] if len(found) == 1 else found[0].unionByName(found[1])


def cut_pieces(cuts: DataFrame) -> DataFrame:
    """(key, part, piece) of `cuts` (key, part, path, begin, n), read from files that Python can open on all machines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pieces = []
            for path, begin, n in zip(*[batch.column(k).to_pylist() for k in (2, 3, 4)], strict=True):
                with open(opened(path), "rb") as f:
                    f.seek(begin)
                    pieces.append(f.read(n))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pieces, pa.binary())], names=["key", "part", "piece"])

    return cuts.select("key", "part", "path", "begin", "n").mapInArrow(run, "key string, part string, piece binary")


def _name() -> F.Column:
    return F.element_at(F.split("path", "/"), -1)


def records(scanned: DataFrame) -> DataFrame:
    """One row for each validated record, with what native expressions make of its bytes. `file` is the whole path, so
    equal names in two folders stay apart."""
    own = scanned.where("kind = 'record'").withColumn("rtc", rtc_stamp(F.col("clock")))
    return own.select(
        F.col("path").alias("file"), _name().alias("file_name"), "start", "end", (F.col("byte_count") + 2).alias("total_bytes"), "byte_count",
        F.size("offsets").alias("number_of_data_types"), "offsets", "ids", "number_lsb", "number_msb",
        counter24(F.col("number_lsb"), F.col("number_msb")).alias("number"),
        "rtc", F.col("rtc").isNotNull().alias("rtc_valid"), rtc_text(F.col("clock"), F.col("rtc")).alias("rtc_text"),
        F.sha2("fixed_leader", 256).alias("config"), lower_hex("fixed_leader").alias("fixed_leader_hex"), "fixed_leader",
        "digest", "stored_checksum", "calculated_checksum", "payload",
    )


def regions(scanned: DataFrame) -> DataFrame:
    return scanned.where("kind = 'region'").select(
        F.col("path").alias("file"), _name().alias("file_name"), "size", "start", "end", (F.col("end") - F.col("start")).alias("length"),
        "classification", "reason", "is_candidate", "declared",
    )


def fragments(scanned: DataFrame) -> DataFrame:
    """Damaged records at the files' edges."""
    own = scanned.where("kind = 'edge'").withColumn("rtc", rtc_stamp(F.col("clock")))
    return own.select(
        F.col("path").alias("file"), _name().alias("file_name"), "side", F.col("start").alias("byte_offset"), (F.col("end") - F.col("start")).alias("available"),
        "declared", counter24(F.col("number_lsb"), F.col("number_msb")).alias("number"),
        F.when(F.col("clock").isNotNull(), rtc_text(F.col("clock"), F.col("rtc"))).alias("rtc_text"),
        F.coalesce("offsets", F.array().cast("array<int>")).alias("offsets"), "checksum_present", "classification", "reason",
    )


def file_sizes(scanned: DataFrame) -> DataFrame:
    return scanned.where("kind = 'file'").select(F.col("path").alias("file"), _name().alias("file_name"), "size")
