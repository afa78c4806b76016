"""Facts of files, their order in time, and the groups and paths of inputs."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..vocabulary import BAD_CHECKSUM, FRAGMENT, NO_INPUT, NON_PD0, ONE_GROUP, OUTPUT_DIRECTORIES, OUTPUT_NAME, SEVERAL_GROUPS, TRUNCATED, VALID
from .cadence import median_steps

EDGE_FIELDS = ["number", "number_lsb", "number_msb", "rtc", "rtc_text", "config", "digest", "start"]


def record_facts(records: DataFrame) -> DataFrame:
    """For each file with records: how many, the first and the last (structs of EDGE_FIELDS), and the median step."""
    edge = F.struct(*EDGE_FIELDS)
    facts = records.groupBy("file", "file_name").agg(
        F.count("*").alias("valid"), F.min_by(edge, "start").alias("first"), F.max_by(edge, "start").alias("last")
    )
    return facts.join(median_steps(records), "file", "left")


def config_histogram(records: DataFrame) -> DataFrame:
    """(file, configs map<string, long>): records of each configuration."""
    counts = records.groupBy("file", "config").agg(F.count("*").alias("n"))
    return counts.groupBy("file").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("config", "n")))).alias("configs"))


def region_facts(regions: DataFrame) -> DataFrame:
    """For each file with bytes: regions by kind, bytes and label of the edges, bytes that a next file's damaged record
    may continue into (prefix_limit), and the sum of unparsed lengths, which counts overlaps twice."""
    kind = F.col("classification")
    order = F.struct("start", "end", "classification", "reason", "is_candidate")
    own = F.struct("start", "end", "classification", "reason", F.col("length"))
    label = lambda r: F.concat_ws(":", r["classification"], r["reason"])
    facts = regions.groupBy("file").agg(
        F.max("size").alias("size"),
        F.count_if(kind == BAD_CHECKSUM).alias("checksum_error_regions"),
        F.count_if(kind.isin(NON_PD0, FRAGMENT)).alias("non_pd0_regions"),
        F.count_if(kind == TRUNCATED).alias("truncated_regions"),
        F.sum(F.when(kind != VALID, F.col("length")).otherwise(0)).alias("unparsed_bytes"),
        F.min(F.when(kind == VALID, F.col("start"))).alias("first_start"),
        F.min_by(own, order).alias("lead"), F.max_by(own, order).alias("tail"),
    )
    lead, tail = F.col("lead"), F.col("tail")
    clean_head, clean_tail = lead["classification"] == VALID, (tail["classification"] == VALID) & (tail["end"] == F.col("size"))
    return facts.select(
        "file", "size", "checksum_error_regions", "non_pd0_regions", "truncated_regions", "unparsed_bytes",
        F.when(clean_head, 0).otherwise(lead["length"]).alias("leading_bytes"),
        F.when(clean_head, "NONE").otherwise(label(lead)).alias("leading_region"),
        F.when(clean_tail, 0).otherwise(tail["length"]).alias("trailing_bytes"),
        F.when(clean_tail, "NONE").otherwise(label(tail)).alias("trailing_region"),
        F.when(clean_head, 0).otherwise(F.coalesce("first_start", lead["end"])).alias("prefix_limit"),
    )


def edge_fragments(regions: DataFrame) -> DataFrame:
    """(file, side, start, end, classification): of the damaged regions at an edge of a file, a truncated one before
    others, then the shortest at the beginning and the latest at the end."""
    bad = regions.where(F.col("classification") != VALID)
    other = (F.col("classification") != TRUNCATED).cast("int")
    row = F.struct("start", "end", "classification", "reason")
    sides = [("leading", "start = 0", F.col("end")), ("trailing", "end = size", -F.col("start"))]
    picked = [bad.where(where).groupBy("file").agg(F.min_by(row, F.struct(other, rank)).alias("r")).select("file", F.lit(side).alias("side"), "r.*") for side, where, rank in sides]
    return picked[0].unionByName(picked[1])


def merge_regions(regions: DataFrame) -> DataFrame:
    """Damaged regions of one file that follow each other without a byte between, alike in kind, reason, candidacy and
    declared length, as one: islands in the order of bytes. Any other region between two of them keeps them apart."""
    alike = ["classification", "reason", "is_candidate", "declared"]
    order = Window.partitionBy("file").orderBy("start", "end", "classification", "reason", "is_candidate")
    before = F.lag(F.struct("end", *alike)).over(order)
    goes_on = (before["end"] == F.col("start")) & (F.col("classification") != VALID)
    for name in alike:
        goes_on = goes_on & before[name].eqNullSafe(F.col(name))
    marked = regions.withColumn("island", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    marked = marked.withColumn("island", F.sum("island").over(order))
    return marked.groupBy("file", "island", *alike).agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def chronological(files: DataFrame) -> DataFrame:
    """`files` (file, file_name, first) with `place`, from 1: by the first record's clock, then files whose clock is no
    date by its text, then files without records by name; ties by name and path. One row for each file."""
    first = F.col("first")
    rank = F.when(first.isNull(), 2).when(first["rtc"].isNull(), 1).otherwise(0)
    order = Window.orderBy(rank, first["rtc"].asc_nulls_last(), F.when(rank == 1, first["rtc_text"]), "file_name", "file")
    return files.withColumn("place", F.row_number().over(order))


def adjacent(files: DataFrame) -> DataFrame:
    """Each file with the next in time: structs `a` and `b` of all columns, and `boundary`, from 1."""
    whole = F.struct(*files.columns)
    return files.select(F.col("place").alias("boundary"), whole.alias("a"), F.lead(whole).over(Window.orderBy("place")).alias("b")).where("b is not null")


def excluded_path(path: F.Column, output_dir: str | None = None) -> F.Column:
    """Whether a path found in a directory is an output: by its name, a folder's name, or under output_dir."""
    folders = f"/({'|'.join(OUTPUT_DIRECTORIES)})/"
    out = path.rlike(folders) | path.rlike(f"(^|/){re.escape(OUTPUT_NAME)}$")
    if output_dir is not None:
        root = output_dir.rstrip("/")
        out = out | (path == root) | path.startswith(f"{root}/")
    return out


def candidate_groups(paths: DataFrame, basis: str) -> DataFrame:
    """(group_id, files, basis) of `paths` (path): files of one folder are a group, ids by the folders' order."""
    parent = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    groups = paths.select("path", parent.alias("parent")).distinct().groupBy("parent").agg(F.sort_array(F.collect_set("path")).alias("files"))
    return groups.select(F.row_number().over(Window.orderBy("parent")).alias("group_id"), "files", F.lit(basis).alias("basis"))


def group_status(groups: DataFrame) -> DataFrame:
    """(status), one row: whether there is one group, none, or more than one to choose from."""
    n = F.count("*")
    return groups.agg(F.when(n == 0, NO_INPUT).when(n > 1, SEVERAL_GROUPS).otherwise(ONE_GROUP).alias("status"))


def input_mode(path: F.Column, is_folder: F.Column) -> F.Column:
    """How an input is taken: a folder is searched, a .000 file is one by name, anything else is ignored."""
    return F.when(is_folder, "folder").when(F.lower(path).endswith(".000"), "file").otherwise("ignored")


def discovered(paths: DataFrame, folders: list[str], recursive: bool, output_dir: str | None = None) -> DataFrame:
    """Of `paths` (path), once each, the .000 files that lie in the folders, or at any depth below them, and are no
    outputs."""
    parent = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    inside = F.lit(False)
    for folder in folders:
        inside = inside | (parent == folder) | (F.lit(recursive) & F.col("path").startswith(folder.rstrip("/") + "/"))
    return paths.where(inside & F.col("path").endswith(".000") & ~excluded_path(F.col("path"), output_dir)).select("path").distinct()
