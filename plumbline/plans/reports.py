"""Files and texts that tell what was found: CSV, JSON, Markdown."""

from __future__ import annotations

import csv
import io
import json
import shutil
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import recovery
from ..sources.sink import write_bytes
from .dataset import Dataset, Group, Validation

# Columns of the files that are written.
INVENTORY = [
    "file", "size_bytes", "valid_ensembles", "first_valid_ensemble_number", "last_valid_ensemble_number", "first_valid_rtc", "last_valid_rtc",
    "first_valid_fixed_leader_sha256", "checksum_error_regions", "non_pd0_regions", "truncated_regions", "leading_fragment_bytes", "trailing_fragment_bytes",
    "nominal_interval_ms", "fragments",
]
BOUNDARY = [
    "previous_file", "next_file", "primary_status", "facts", "previous_last_ensemble", "next_first_ensemble", "previous_last_rtc", "next_first_rtc", "elapsed_ms",
    "nominal_interval_ms", "missing_acquisition_ms", "estimated_missing_ensembles", "counter_transition", "fixed_leader_match", "exact_duplicate_overlap",
    "conflicting_time_overlap", "trailing_bytes_previous", "leading_bytes_next", "trailing_region_previous", "leading_region_next", "configuration_changed", "notes",
]
MAP = [
    "output_byte_offset", "source_file", "source_offset", "source_length", "continuation_file", "continuation_offset", "continuation_length", "reconstructed",
    "ensemble_sha256", "rtc", "ensemble_number",
]


def inventory(files: DataFrame, fragments: DataFrame) -> DataFrame:
    """Rows of the source inventory: `files` in the order of time with all facts, and the damaged records at their edges."""
    text = F.format_string("%s:%d:%d:%s", "side", "byte_offset", "available", "classification")
    edges = fragments.groupBy("file").agg(F.array_join(F.sort_array(F.collect_list(text)), " | ").alias("fragments"))
    n = lambda c: F.coalesce(c, F.lit(0))
    rows = files.join(edges, "file", "left").orderBy("place")
    return rows.select(
        F.col("file_name").alias("file"), n("size").alias("size_bytes"), n("valid").alias("valid_ensembles"), F.col("first.number").alias("first_valid_ensemble_number"),
        F.col("last.number").alias("last_valid_ensemble_number"), F.col("first.rtc_text").alias("first_valid_rtc"), F.col("last.rtc_text").alias("last_valid_rtc"),
        F.col("first.config").alias("first_valid_fixed_leader_sha256"), n("checksum_error_regions").alias("checksum_error_regions"), n("non_pd0_regions").alias("non_pd0_regions"),
        n("truncated_regions").alias("truncated_regions"), n("leading_bytes").alias("leading_fragment_bytes"), n("trailing_bytes").alias("trailing_fragment_bytes"),
        F.col("nominal_ms").alias("nominal_interval_ms"), F.coalesce("fragments", F.lit("")).alias("fragments"),
    )


def boundary_rows(boundaries: DataFrame) -> DataFrame:
    return boundaries.orderBy("boundary").select(*[F.array_join(c, {"facts": ";", "notes": " | "}[c]).alias(c) if c in ("facts", "notes") else c for c in BOUNDARY])


def ensemble_map(provenance: DataFrame) -> DataFrame:
    rows = provenance.orderBy("output_byte_offset")
    return rows.select(
        "output_byte_offset", F.col("file_name").alias("source_file"), F.col("start").alias("source_offset"), "source_length", "continuation_file",
        F.when(F.col("reconstructed"), 0).alias("continuation_offset"), "continuation_length", "reconstructed", F.col("digest").alias("ensemble_sha256"),
        F.col("rtc_text").alias("rtc"), F.col("number").alias("ensemble_number"),
    )


def write_csv(rows: DataFrame, path: Path) -> None:
    """One file, in the order of the rows; executors write its parts."""

    def text(values: Iterable[Iterable]) -> str:
        out = io.StringIO(newline="")
        csv.writer(out).writerows(values)
        return out.getvalue()

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = text(zip(*[c.to_pylist() for c in batch.columns], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([told.encode()], pa.binary())], names=["payload"])

    path.unlink(missing_ok=True)
    write_bytes(rows.mapInArrow(lines, "payload binary"), str(path), text([rows.columns]))


def as_json(rows: DataFrame) -> Column:
    """All columns of a row as one JSON object, nulls included."""
    return F.to_json(F.struct(*[F.col(c) for c in rows.columns]), {"ignoreNullFields": "false"})


def with_seconds(gaps: DataFrame) -> DataFrame:
    """Gaps with their times in seconds, too."""
    names = {"elapsed_ms": "elapsed_seconds", "expected_interval_ms": "expected_interval_seconds", "missing_acquisition_ms": "missing_acquisition_seconds"}
    return gaps.withColumns({to: F.col(c) / F.lit(1000.0) for c, to in names.items()})


# Fields of a split candidate in the manifest; its other keys are those of write_manifest().
SPLIT = [
    "previous_file", "next_file", "previous_offset", "previous_available_bytes", "next_consumed_bytes", "declared_total_bytes", "candidate_ensemble_number", "candidate_rtc",
    "status", "reason", "stored_checksum_validates", "fixed_leader_sha256", "ensemble_sha256",
]


def source_files(data: Dataset) -> DataFrame:
    """What the manifest holds of each file, in the order of time."""
    edges = data.fragments.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("side", *[c for c in data.fragments.columns if c != "side"]))).alias("fragments"))
    first, last = F.col("first"), F.col("last")
    return data.files.join(edges, "file", "left").orderBy("place").select(
        F.col("file_name").alias("file"), F.coalesce("size", F.lit(0)).alias("size_bytes"), F.coalesce("valid", F.lit(0)).alias("valid_ensembles"),
        first["rtc_text"].alias("first_rtc"), last["rtc_text"].alias("last_rtc"), first["number"].alias("first_ensemble_number"), last["number"].alias("last_ensemble_number"),
        F.coalesce("configs", F.create_map().cast("map<string, bigint>")).alias("fixed_leader_fingerprints"), F.coalesce("fragments", F.array()).alias("fragments"),
    )


def _rows(rows: DataFrame) -> Iterator[str]:
    """JSON of each row, a partition at a time through the driver."""
    return (r[0] for r in rows.select(as_json(rows)).toLocalIterator())


@dataclass
class Elements:
    """A file with the elements of a JSON list, each behind a comma and a new line."""

    path: Path


def _elements(rows: DataFrame, path: Path) -> Elements:
    """JSON of each row, in the order of the rows; executors write it."""
    path.unlink(missing_ok=True)
    write_bytes(rows.select(F.concat(F.lit(",\n"), as_json(rows)).cast("binary").alias("payload")), str(path))
    return Elements(path)


def _texts(rows: DataFrame) -> Iterator[str]:
    return (json.dumps(r[0]) for r in rows.toLocalIterator())


def write_json(path: Path, value: Mapping) -> None:
    """A JSON object whose values are plain, mappings of such, or iterators of JSON texts or Elements, which become lists;
    nothing is gathered."""
    with path.open("w", encoding="utf-8") as f:

        def put(own: object) -> None:
            if isinstance(own, Mapping):
                for i, (key, one) in enumerate(own.items()):
                    f.write(("{" if not i else ",") + f"\n{json.dumps(key)}: ")
                    put(one)
                f.write("\n}" if own else "{}")
            elif isinstance(own, Elements):
                f.write("[")
                f.flush()
                with own.path.open("rb") as elements:
                    elements.read(1)  # no comma before the first
                    shutil.copyfileobj(elements, f.buffer, 1 << 20)
                f.write("]")
            elif isinstance(own, Iterator):
                f.write("[")
                for i, text in enumerate(own):
                    f.write((",\n" if i else "\n") + text)
                f.write("]")
            else:
                f.write(json.dumps(own, default=str))

        put(value)


def write_manifest(path: Path, data: Dataset, verdict: str, removed: int, conflicts: DataFrame, validation: Validation | None, output: Path | None) -> None:
    boundaries = data.boundaries.orderBy("boundary")
    changed = boundaries.where("configuration_changed").select(F.concat_ws(" -> ", "previous_file", "next_file"))
    checked = validation and {
        "valid_count": validation.records, "issues": validation.issues, "duplicate_hashes": _texts(validation.duplicates), "nominal_interval_ms": validation.nominal_ms,
        "gaps": _rows(with_seconds(validation.gaps)),
    }
    accepted = _elements(ensemble_map(data.provenance).drop("output_byte_offset"), path.with_name(f"{path.name}.accepted"))
    write_json(path, {
        "verdict": verdict,
        "discovered_files": data.paths,
        "chronological_order": _texts(data.files.orderBy("place").select("file_name")),
        "nominal_interval_ms": data.nominal_ms,
        "configuration_changes": _texts(changed),
        "source_files": _rows(source_files(data)),
        "boundaries": _rows(boundaries.drop("boundary")),
        "split_candidates": _rows(data.splits.orderBy("boundary", "previous_offset").select(*SPLIT)),
        "duplicate_removed": removed,
        "conflicts": _texts(conflicts),
        "accepted_records": accepted,
        "gaps": _rows(with_seconds(data.gaps)),
        "validation": checked,
        "recovered_path": None if output is None else str(output),
    })
    accepted.path.unlink()


def _seconds(ms: int | None) -> str:
    return "unknown" if ms is None else f"{ms / 1000:.3f} s"


def _table(names: list[str], rows: Iterable[Iterable]) -> Iterator[str]:
    yield f"| {' | '.join(names)} |"
    yield "|" + " --- |" * len(names)
    for r in rows:
        yield f"| {' | '.join('' if v is None else str(v) for v in r)} |"
    yield ""


def group_text(groups: list[Group]) -> str:
    lines = ["## Candidate groups", ""]
    for g in groups:
        lines += [f"- group {g.number} ({g.basis}): {len(g.files)} file(s)", *[f"  - `{f}`" for f in g.files]]
    return "\n".join([*lines, ""])


def analysis_lines(data: Dataset) -> Iterator[str]:
    """Files, boundaries, splits and edges of one group."""
    files = lambda: inventory(data.files, data.fragments).toLocalIterator()
    boundaries = lambda: data.boundaries.orderBy("boundary").toLocalIterator()
    yield f"- Files in order of time: {', '.join(r.file for r in files())}"
    yield from (f"- Nominal interval: {_seconds(data.nominal_ms)}", "", "## Files", "")
    yield from _table(
        ["file", "bytes", "records", "first number", "last number", "first clock", "last clock", "bad checksums", "other data", "truncated"],
        ((r.file, r.size_bytes, r.valid_ensembles, r.first_valid_ensemble_number, r.last_valid_ensemble_number, r.first_valid_rtc, r.last_valid_rtc, r.checksum_error_regions, r.non_pd0_regions, r.truncated_regions) for r in files()),
    )
    yield from ("## Damage at edges", "")
    yield from _or_none(
        f"- {e.file_name}, {e.side}: byte {e.byte_offset}, {e.available} of {e.declared} bytes, ensemble {e.number}, clock {e.rtc_text}, {e.classification}"
        for e in data.fragments.orderBy("file", "side").toLocalIterator()
    )
    yield from ("", "## Boundaries", "")
    yield from _table(
        ["from", "to", "status", "facts", "elapsed", "expected", "missing", "counter", "copies", "conflicts"],
        ((b.previous_file, b.next_file, b.primary_status, ", ".join(b.facts), _seconds(b.elapsed_ms), _seconds(b.nominal_interval_ms), _seconds(b.missing_acquisition_ms), b.counter_transition, b.exact_duplicate_overlap, b.conflicting_time_overlap) for b in boundaries()),
    )
    yield from ("## Records across files", "")
    yield from _or_none(
        f"- `{s.previous_file}` at {s.previous_offset} with {s.next_consumed_bytes} bytes of `{s.next_file}`: {s.status}; {s.reason}" for s in data.splits.orderBy("boundary", "previous_offset").toLocalIterator()
    )
    yield from (f"- configuration changes from `{b.previous_file}` to `{b.next_file}`" for b in boundaries() if b.configuration_changed)
    yield ""


def _or_none(lines: Iterable[str]) -> Iterator[str]:
    n = 0
    for n, line in enumerate(lines, 1):  # noqa: B007
        yield line
    if not n:
        yield "- none"


def recovery_lines(data: Dataset, verdict: str, accepted: int, removed: int, conflicts: DataFrame, validation: Validation | None, output: Path | None) -> Iterator[str]:
    yield from ("# Recovery", "", f"- Verdict: `{verdict}`", f"- Records accepted: {accepted}", f"- Copies removed: {removed}")
    yield from analysis_lines(data)
    yield from ("## Gaps", "")
    yield from _or_none(
        f"- {g.before_rtc} ({g.before_source}) to {g.after_rtc} ({g.after_source}): {_seconds(g.missing_acquisition_ms)} missing, about {g.estimated_missing_ensembles} record(s), {g.location}"
        for g in data.gaps.orderBy("before_rtc").toLocalIterator()
    )
    yield from ("", "## Decision", "")
    clash = False
    for row in conflicts.toLocalIterator():
        if not clash:
            yield "- withheld: records contradict each other"
        clash = True
        yield f"- {row[0]}"
    if not clash:
        yield from (f"- recovered file: {output or 'withheld'}", "- every byte comes from a source; checksums are the original ones")
    yield from (f"- validation issues: {len(validation.issues) if validation else 'not validated'}", "")


def validation_lines(verdict: str, validation: Validation | None) -> Iterator[str]:
    yield from ("# Validation", "", f"- Verdict: `{verdict}`")
    if validation is None:
        yield "- no output was written; it needs review first"
        return
    yield from (f"- records parsed from byte 0: {validation.records}", f"- repeated records: {validation.duplicates.count()}", f"- nominal interval: {_seconds(validation.nominal_ms)}", f"- gaps: {validation.gaps.count()}")
    yield from (f"- issue: {i}" for i in validation.issues)
    if not validation.issues:
        yield "- the file parses to its end without faults"


def write_lines(path: Path, lines: Iterable[str]) -> None:
    with path.open("w", encoding="utf-8") as f:
        f.writelines(f"{line}\n" for line in lines)
