"""The four actions: inspect, recover, slice and slice-bins."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bins, recovery
from ..sources.sink import publish, write_bytes
from ..vocabulary import FAIL, OUTPUT_NAME, PASS, PASS_WITH_FRAGMENTS, PASS_WITH_GAPS, REVIEW, VALID
from . import reports
from .dataset import Dataset, find_groups, only_group, validate_file

PASSED = {PASS, PASS_WITH_GAPS, PASS_WITH_FRAGMENTS}


def inspect(spark: SparkSession, inputs: list[str], recursive: bool = False) -> tuple[str, int]:
    """The report on all groups, each by itself, and an exit code."""
    groups = find_groups(spark, inputs, recursive)
    if not groups:
        return f"{only_group(groups)}\n", 1
    texts = [only_group(groups), ""] if len(groups) > 1 else []
    texts.append(reports.group_text(groups))
    for group in groups:
        data = Dataset(spark, group.files)
        texts += [f"# Inspection of group {group.number}", "", *reports.analysis_lines(data)]
        data.close()
    return "\n".join(texts), 0


#: Conflicts that a Recovery shows; the manifest has all.
SHOWN = 100


@dataclass
class Recovery:
    verdict: str
    accepted: int
    removed: int
    conflicts: list[str]
    issues: list[str] | None
    output: Path | None


def recover(spark: SparkSession, paths: list[str], output_dir: str) -> Recovery:
    """Write the recovered file, unless it needs review, and all reports; these are written row by row."""
    data, folder = Dataset(spark, paths), Path(output_dir)
    folder.mkdir(parents=True, exist_ok=True)
    order = [c.asc_nulls_last() for c in recovery.order_columns()]
    conflicts = data.conflicts.orderBy(*order).select(recovery.conflict_message())
    output, validation = None, None
    verdict = data.verdict()
    if verdict not in (REVIEW, FAIL):
        output = folder / OUTPUT_NAME
        output.unlink(missing_ok=True)
        write_bytes(data.accepted.join(data.payloads, ["file", "start"]).orderBy(*order), str(output))
        validation = validate_file(spark, str(output))
        verdict = data.verdict(len(validation.issues))
    accepted = data.accepted.count()
    removed = data.records.count() + data.splits.where("bytes_data IS NOT NULL").count() - accepted
    shown = [r[0] for r in conflicts.limit(SHOWN).collect()]
    reports.write_csv(reports.inventory(data.files, data.fragments), folder / "source_inventory.csv")
    reports.write_csv(reports.boundary_rows(data.boundaries), folder / "boundary_analysis.csv")
    reports.write_csv(recovery.gap_seconds(data.gaps), folder / "recovered_gaps.csv")
    reports.write_csv(reports.ensemble_map(data.provenance), folder / "recovered_ensemble_map.csv")
    reports.write_lines(folder / "recovery_report.md", reports.recovery_lines(data, verdict, accepted, removed, conflicts, validation, output))
    reports.write_lines(folder / "recovered_validation.md", reports.validation_lines(verdict, validation))
    reports.write_manifest(folder / "recovery_manifest.json", data, verdict, removed, conflicts, validation, output)
    if validation is not None:
        validation.close()
    data.close()
    return Recovery(verdict, accepted, removed, shown, validation and validation.issues, output)


@dataclass
class SlicePlan:
    path: Path
    data: Dataset
    indexed: DataFrame
    removed: F.Column
    total: int
    removed_count: int
    unparsed: int
    trailing: int

    def lines(self) -> Iterator[str]:
        ranges = recovery.index_ranges(self.indexed.where(self.removed)).first()
        gone = self.indexed.where(self.removed).orderBy("physical_index").select("physical_index", "start", "end", "total_bytes", "number").toLocalIterator()
        yield from ("# Slice", "", f"- Input: `{self.path}`", f"- Records: {self.total}", f"- Removed, by place from 1: {ranges.ranges if ranges else 'none'} ({self.removed_count})")
        yield from (f"- Retained: {self.total - self.removed_count}", f"- Unparsed bytes: {self.unparsed}", f"- Bytes behind the last record: {self.trailing}", "", "## Removed records", "")
        yield from (f"- place {r.physical_index}: bytes {r.start} to {r.end}, length {r.total_bytes}, number {r.number}" for r in gone)
        if self.unparsed:
            yield from ("", "WARNING: no output will be written; it would lose unparsed bytes.")
        yield ""

    def text(self) -> str:
        return "\n".join(self.lines())


def plan_slice(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, range_spec: str | None = None) -> SlicePlan:
    asked = [(how, str(n)) for how, n in (("first", first), ("last", last), ("range", range_spec)) if n is not None]
    if len(asked) != 1:
        raise ValueError("a slice needs one of --first, --last and --range, and only one")
    data = Dataset(spark, [path])
    total = data.records.count()
    if not total:
        raise ValueError("nothing to slice: the file holds no complete record with a valid checksum")
    ((how, spec),) = asked
    bounds = spark.range(1).select(recovery.slice_bounds(F.lit(how), F.lit(spec), F.lit(total))).first()[0]
    if bounds is None:
        raise ValueError(f"--{how} {spec} asks for records that are not there: places go from 1 to {total}, a range is A:B")
    between = recovery.removed_by(between=(bounds.lowest, bounds.highest))
    facts = data.files.first()
    return SlicePlan(Path(path), data, recovery.physical_index(data.records), between, total, bounds.highest - bounds.lowest + 1, facts.unparsed_bytes or 0, facts.trailing_bytes or 0)


def _refuse_input(path: Path, output: Path) -> None:
    if path.resolve() == output.resolve():
        raise ValueError("the output would replace the input")


def _differing(spark: SparkSession, want: DataFrame, path: str) -> list[str]:
    """Faults of an output against wanted rows (physical_index, digest)."""
    found, issues, keys = Dataset(spark, [path]), [], ["physical_index", "digest"]
    if found.regions.where(F.col("classification") != VALID).limit(1).count():
        issues.append("some bytes belong to no record")
    own = recovery.physical_index(found.records).select(*keys)
    if own.join(want, keys, "left_anti").union(want.join(own, keys, "left_anti")).limit(1).count():
        issues.append("its records are not those that were retained")
    found.close()
    return issues


def write_slice(plan: SlicePlan, output: str) -> int:
    """Copy the retained records unchanged; the number of them. Nothing is written unless all bytes are records."""
    target, spark = Path(output), plan.data.spark
    if plan.unparsed:
        raise ValueError(f"{plan.unparsed} bytes belong to no record and would be lost; nothing was written")
    _refuse_input(plan.path, target)
    left = plan.indexed.where(~plan.removed)
    wanted = recovery.physical_index(left.drop("physical_index", "total")).select("physical_index", "digest")

    def check(path: str) -> list[str]:
        found = validate_file(spark, path, allow_duplicates=True)
        found.close()
        return [*found.issues, *_differing(spark, wanted, path)]

    bytes_ = plan.data.with_bytes.select("start", "payload")  # of one file
    publish(left.select("start").join(bytes_, "start").orderBy("start"), target, "slice-tmp", check)
    return plan.total - plan.removed_count


@dataclass
class BinPlan:
    path: Path
    data: Dataset
    trim: bins.TrimPlan

    def text(self) -> str:
        t = self.trim
        effect = self.data.spark.range(1).select(bins.trim_effect(*map(F.lit, (t.cells, t.beams, t.cell_cm, t.remove)))).first()[0]
        return "\n".join([
            "# Depth-cell trim", "", f"- Input: `{self.path}`", f"- Records: {t.records}", f"- Cells: {t.cells}, of which the last {t.remove} go and {t.cells_left} stay", f"- Beams: {t.beams}",
            f"- Cell size: {t.cell_cm / 100:.2f} m", f"- Range removed: {effect.removed_metres} m", f"- Record bytes: {t.record_bytes}, {t.removed_bytes} fewer, {t.record_bytes - t.removed_bytes} after",
            f"- Output bytes: {t.records * (t.record_bytes - t.removed_bytes)}", "",
        ])


def plan_bin_trim(spark: SparkSession, path: str, last: int) -> BinPlan:
    if last <= 0:
        raise ValueError("no trim: a trim removes one cell at least")
    data = Dataset(spark, [path])
    if data.records.limit(1).count() and data.regions.where(F.col("classification") != VALID).limit(1).count():
        raise ValueError("no trim: some bytes belong to no record with a valid checksum")
    return BinPlan(Path(path), data, bins.prove_trim(bins.layouts(data.records), last))


def write_bin_trim(plan: BinPlan, output: str) -> int:
    target, spark, t = Path(output), plan.data.spark, plan.trim
    _refuse_input(plan.path, target)

    def check(path: str) -> list[str]:
        found = Dataset(spark, [path])
        issues = []
        size = found.scanned.where("kind = 'file'").first().size
        if size != t.records * (t.record_bytes - t.removed_bytes):
            issues.append(f"it has {size} bytes instead of {t.records * (t.record_bytes - t.removed_bytes)}")
        if found.regions.where(F.col("classification") != VALID).limit(1).count():
            issues.append("some bytes belong to no record with a valid checksum")
        # all records of the input have one length, and those of a right output another: places follow from the starts
        place = lambda df, n: df.withColumn("physical_index", F.floor(F.col("start") / n) + 1)
        bad = bins.trim_faults(place(plan.data.with_bytes, t.record_bytes), place(found.with_bytes, t.record_bytes - t.removed_bytes), t).limit(3).collect()
        found.close()
        return [*issues, *[f"record {r.physical_index}: {r.fault}" for r in bad]]

    publish(bins.trim_cells(plan.data.with_bytes, t).orderBy("start"), target, "bin-trim-tmp", check)
    return t.records
