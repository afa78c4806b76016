"""The plan of an analysis: lazy tables over a set of files, from one scan."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..operators import boundaries, cadence, files, recovery, splits
from ..sources import pd0
from ..vocabulary import NO_INPUT, SEVERAL_GROUPS, VALID


@dataclass
class Group:
    number: int
    files: list[str]
    basis: str


def find_groups(spark: SparkSession, inputs: list[str], recursive: bool = False, output_dir: str | None = None) -> list[Group]:
    """Inputs as groups of files: the .000 files given by name are one, the files of each folder found another. Other
    inputs are ignored. Names of outputs are skipped in folders, not among given files."""
    given = [(str(Path(i).resolve()), Path(i).is_dir()) for i in inputs if Path(i).exists()]
    if not given:
        return []
    taken = spark.createDataFrame(given, "path string, is_folder boolean").withColumn("mode", files.input_mode(F.col("path"), F.col("is_folder"))).distinct().collect()
    named = sorted((r.path for r in taken if r.mode == "file"), key=lambda p: (Path(p).name, p))
    folders = sorted(r.path for r in taken if r.mode == "folder")
    groups = [Group(1, named, "explicit_files")] if named else []
    if not folders:
        return groups
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.000").option("recursiveFileLookup", str(recursive).lower())
    # names alone are read here, which need no task for every few files
    listed = reader.load(folders).coalesce(spark.sparkContext.defaultParallelism).select(F.regexp_replace("path", "^file:/*", "/").alias("path"))
    found = files.discovered(listed, folders, recursive, str(Path(output_dir).resolve()) if output_dir else None)
    for row in files.candidate_groups(found, "directory_recursive_parent" if recursive else "directory_non_recursive").orderBy("group_id").collect():
        groups.append(Group(len(groups) + 1, list(row.files), row.basis))
    return groups


def only_group(groups: list[Group]) -> Group | str:
    """The group to recover, or why there isn't one."""
    return groups[0] if len(groups) == 1 else SEVERAL_GROUPS if groups else NO_INPUT


@dataclass
class Dataset:
    """One group of files. Each property is a DataFrame that is computed when it is used; the scan is kept for all."""

    spark: SparkSession
    paths: list[str]
    mode: str = "resync"
    kept: list[DataFrame] = field(default_factory=list)

    def _keep(self, df: DataFrame) -> DataFrame:
        self.kept.append(df.persist(StorageLevel.MEMORY_AND_DISK))
        return df

    def close(self) -> None:
        for df in self.kept:
            df.unpersist()
        self.kept.clear()

    @cached_property
    def contents(self) -> DataFrame:
        return pd0.file_contents(self.spark, self.paths)

    @cached_property
    def scanned(self) -> DataFrame:
        """What the scan tells, without the records' bytes."""
        return self._keep(pd0.scan_files(self.spark, self.paths, self.mode, payloads=False))

    @cached_property
    def with_bytes(self) -> DataFrame:
        """Records with their payload, from a scan of its own that is not kept: only outputs need it."""
        return pd0.records(pd0.scan_files(self.spark, self.paths, self.mode))

    @cached_property
    def records(self) -> DataFrame:
        return pd0.records(self.scanned).drop("payload")

    @cached_property
    def regions(self) -> DataFrame:
        return pd0.regions(self.scanned)

    @cached_property
    def fragments(self) -> DataFrame:
        return pd0.fragments(self.scanned)

    @cached_property
    def nominal_ms(self) -> int | None:
        return cadence.global_interval(self.records).first()[0]

    @cached_property
    def files(self) -> DataFrame:
        """One row for each file in the order of time, with all facts."""
        sizes = pd0.file_sizes(self.scanned).drop("size")
        facts = files.record_facts(self.records).drop("file_name")
        damage = files.region_facts(self.regions)
        configs = files.config_histogram(self.records)
        rows = sizes.join(facts, "file", "left").join(damage, "file", "left").join(configs, "file", "left")
        return self._keep(files.chronological(rows))

    @cached_property
    def splits(self) -> DataFrame:
        local = len(pd0.local_sizes(self.spark, self.paths)) == len(set(self.paths))
        contents = None if local else self.contents  # to name all files to Spark's reader costs a task for each
        return self._keep(splits.split_candidates(self.records, self.regions, contents, files.adjacent(self.files), pd0.cut_pieces if local else None))

    @cached_property
    def boundaries(self) -> DataFrame:
        return self._keep(boundaries.boundaries(self.records, self.files, F.lit(self.nominal_ms).cast("long"), self.splits))

    @cached_property
    def accepted(self) -> DataFrame:
        """Records of the recovered file, without their bytes."""
        return self._keep(recovery.keep_first(splits.with_splits(self.records, self.splits)))

    @cached_property
    def conflicts(self) -> DataFrame:
        return self._keep(recovery.conflicts(self.accepted))

    @cached_property
    def gaps(self) -> DataFrame:
        return self._keep(recovery.gaps(self.accepted, F.lit(self.nominal_ms).cast("long")))

    @cached_property
    def provenance(self) -> DataFrame:
        """Not kept in memory: its rows lie in a table of the shared folder, in order, and are as many as the records."""
        return recovery.provenance(self.accepted)

    @cached_property
    def payloads(self) -> DataFrame:
        """(file, start, payload) of native records and safe splits; joined to the accepted ones only to be written."""
        rebuilt = self.splits.where("bytes_data IS NOT NULL").select("file", F.col("previous_offset").alias("start"), F.col("bytes_data").alias("payload"))
        return self.with_bytes.select("file", "start", "payload").unionByName(rebuilt)

    def verdict(self, issues: int = 0) -> str:
        some = lambda df: bool(df.limit(1).count())
        damaged = F.arrays_overlap("facts", F.array(*map(F.lit, ("UNRECOVERABLE_FRAGMENT", "TRUNCATED_PREVIOUS_FILE", "TRUNCATED_NEXT_FILE"))))
        row = self.spark.range(1).select(
            recovery.verdict(
                F.lit(some(self.conflicts)), F.lit(some(self.boundaries.where("primary_status = 'AMBIGUOUS'"))), F.lit(issues > 0),
                F.lit(some(self.boundaries.where(damaged)) or some(self.fragments)), F.lit(some(self.gaps)),
            )
        )
        return row.first()[0]


@dataclass
class Validation:
    """What an output is found to hold; duplicates (digest) and gaps are tables, lazily computed until close()."""

    records: int
    issues: list[str]
    nominal_ms: int | None
    data: Dataset

    @cached_property
    def duplicates(self) -> DataFrame:
        return self.data._keep(recovery.duplicate_digests(self.data.records).select("digest"))

    @cached_property
    def gaps(self) -> DataFrame:
        return self.data._keep(recovery.gaps(self.data.records, F.lit(self.nominal_ms).cast("long")))

    def close(self) -> None:
        self.data.close()


def validate_file(spark: SparkSession, path: str, allow_duplicates: bool = False) -> Validation:
    """Parse an output from byte 0; the first fault, repeated records and gaps in the order of its bytes."""
    own = Dataset(spark, [path], "strict")
    out = Validation(own.records.count(), [], own.nominal_ms, own)
    size = own.scanned.where("kind = 'file'").first()
    bad = own.regions.where(F.col("classification") != VALID).first()
    if bad is not None:
        out.issues.append(f"parsing stopped at byte {bad.start}: {bad.classification}: {bad.reason}")
        out.issues.append(f"the last {size.size - bad.start} of {size.size} bytes were not parsed")
    again = out.duplicates.count()
    if again and not allow_duplicates:
        out.issues.append(f"{again} records are there more than once")
    return out
