"""What happens between two files that follow each other."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import counter_transition, in_order, primary_status, to_millis
from ..vocabulary import NOTES, SAFE_SPLIT
from .cadence import chosen_interval
from .files import adjacent

#: A boundary joins at the nominal interval if it is off by this many milliseconds at most.
TOLERANCE_MS = 20


def _sides(records: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of the earlier and of the later file of each boundary. The pairs are two strings a file."""
    pick = lambda side: pairs.select("boundary", F.col(f"{side}.file").alias("file"))
    return records.join(pick("a"), "file"), records.join(pick("b"), "file")


def exact_overlaps(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """(boundary, n): records of the earlier file whose whole bytes are in the later one."""
    a, b = _sides(records, pairs)
    return a.join(b.select("boundary", "digest"), ["boundary", "digest"], "left_semi").groupBy("boundary").agg(F.count("*").alias("n"))


def time_conflicts(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """(boundary, n): pairs of an earlier and a later record with equal valid clocks and different bytes. Pairs are
    counted, not made: all pairs of a clock less those with equal bytes."""
    a, b = (x.where("rtc_valid").groupBy("boundary", "rtc_text", "digest").agg(F.count("*").alias(n)) for x, n in zip(_sides(records, pairs), ("na", "nb"), strict=True))
    same = a.join(b, ["boundary", "rtc_text", "digest"]).groupBy("boundary", "rtc_text").agg(F.sum(F.col("na") * F.col("nb")).alias("same"))
    of = lambda x, n: x.groupBy("boundary", "rtc_text").agg(F.sum(n).alias(n))
    clocks = of(a, "na").join(of(b, "nb"), ["boundary", "rtc_text"]).join(same, ["boundary", "rtc_text"], "left")
    n = F.col("na") * F.col("nb") - F.coalesce("same", F.lit(0))
    return clocks.groupBy("boundary").agg(F.sum(n).alias("n")).where("n > 0")


def last_complete_before(records: DataFrame, probes: DataFrame) -> DataFrame:
    """As-of join: `probes` (file, at) with `before`, the last record of the file that ends at or before the place. Both
    sides go through one sorted window, so no pairs are made."""
    marks = probes.select("file", "at", F.col("at").alias("place"), F.lit(1).alias("probe"), F.lit(None).cast("long").alias("began"))
    ends = records.select("file", F.lit(None).cast("long").alias("at"), F.col("end").alias("place"), F.lit(0).alias("probe"), F.col("start").alias("began"))
    order = Window.partitionBy("file").orderBy("place", "probe", "began").rowsBetween(Window.unboundedPreceding, 0)
    seen = marks.unionByName(ends).withColumn("before", F.last("began", ignorenulls=True).over(order))
    return seen.where("probe = 1").select("file", "at", "before")


def classify(pairs: DataFrame, overlaps: DataFrame, conflicts: DataFrame, splits: DataFrame | None, overall: F.Column) -> DataFrame:
    """One row for each boundary with all its facts. Files need the columns of record_facts and, as far as there are any,
    of region_facts; splits: (boundary, status)."""
    count = lambda x, name: x.select("boundary", F.col("n").alias(name))
    rows = pairs.join(count(overlaps, "duplicates"), "boundary", "left").join(count(conflicts, "conflicts"), "boundary", "left")
    if splits is not None:
        rows = rows.join(splits.groupBy("boundary").agg(F.bool_or(F.col("status") == SAFE_SPLIT).alias("safe")), "boundary", "left")
    else:
        rows = rows.withColumn("safe", F.lit(False))
    rows = rows.withColumn("overall", overall)  # a subquery can't stand inside a higher-order function
    a, b = F.col("a"), F.col("b")
    prev, curr = a["last"], b["first"]
    rows = rows.select(
        "boundary", "a", "b", prev.alias("prev"), curr.alias("curr"),
        F.coalesce("duplicates", F.lit(0)).alias("duplicates"), F.coalesce("conflicts", F.lit(0)).alias("conflicts"), F.coalesce("safe", F.lit(False)).alias("safe"),
        (to_millis(curr["rtc"]) - to_millis(prev["rtc"])).alias("elapsed"),
        chosen_interval("a.nominal_ms", "b.nominal_ms", F.col("overall")).alias("nominal"),
        (prev["config"] == curr["config"]).alias("match"),
        F.least(F.coalesce(a["valid"], F.lit(0)), F.coalesce(b["valid"], F.lit(0))).alias("smaller"),
        F.coalesce(a["trailing_bytes"], F.lit(0)).alias("tail"), F.coalesce(a["trailing_region"], F.lit("NONE")).alias("tail_region"),
        F.coalesce(b["leading_bytes"], F.lit(0)).alias("head"), F.coalesce(b["leading_region"], F.lit("NONE")).alias("head_region"),
    )
    missing = F.greatest(F.lit(0), F.col("elapsed") - F.col("nominal"))
    missing = F.when(F.col("elapsed").isNotNull() & F.col("nominal").isNotNull(), missing)
    rows = rows.withColumns({"counter": counter_transition(F.col("prev"), F.col("curr")), "missing": missing})
    joins = F.coalesce((F.abs(F.col("elapsed") - F.col("nominal")) <= TOLERANCE_MS) & F.col("match"), F.lit(False))
    resets = F.col("counter").startswith("counter_reset") | (F.col("counter") == "counter_rollover")
    # (whether it holds, fact, note if it is not the fact's own), in the order of the notes
    tail_cut, head_cut = F.col("tail_region").startswith("TRUNCATED_ENSEMBLE"), F.col("head_region").startswith("TRUNCATED_ENSEMBLE")
    findings = [
        (F.col("prev").isNull() | F.col("curr").isNull(), "UNRECOVERABLE_FRAGMENT", F.lit(NOTES["ONE_SIDE"])),
        ((F.col("duplicates") > 0) & (F.col("duplicates") == F.col("smaller")), "EXACT_OVERLAP", None),
        ((F.col("duplicates") > 0) & (F.col("duplicates") != F.col("smaller")), "PARTIAL_OVERLAP", F.format_string(NOTES["PARTIAL_OVERLAP"], "duplicates")),
        (F.col("conflicts") > 0, "CONFLICT", F.format_string(NOTES["CONFLICT"], "conflicts")),
        (~F.col("match"), "CONFIGURATION_CHANGE", None),
        (joins, "CLEAN_CONTIGUOUS", None),
        (~joins & (F.col("elapsed") > F.col("nominal")), "GAP", None),
        (resets, "CLEAN_WITH_COUNTER_RESET", F.concat(F.lit(NOTES["CLEAN_WITH_COUNTER_RESET"]), F.col("counter"))),
        (tail_cut, "TRUNCATED_PREVIOUS_FILE", None),
        (head_cut, "TRUNCATED_NEXT_FILE", None),
        (F.col("safe"), "SAFE_SPLIT_RECONSTRUCTION", None),
        (~F.col("safe") & ((F.col("tail") > 0) | (F.col("head") > 0)), "UNRECOVERABLE_FRAGMENT", None),
    ]
    found = F.array_compact(F.array(*[F.when(holds, F.struct(F.lit(fact).alias("fact"), (F.lit(NOTES[fact]) if note is None else note).alias("note"))) for holds, fact, note in findings]))
    rows = rows.withColumn("found", found)
    none = F.size("found") == 0
    facts = F.when(none, F.array(F.lit("AMBIGUOUS"))).otherwise(in_order(F.col("found.fact")))
    notes = F.when(none, F.array(F.lit(NOTES["AMBIGUOUS"]))).otherwise(F.col("found.note"))
    return rows.select(
        "boundary", a["file_name"].alias("previous_file"), b["file_name"].alias("next_file"),
        primary_status(facts).alias("primary_status"), facts.alias("facts"),
        F.col("prev.number").alias("previous_last_ensemble"), F.col("curr.number").alias("next_first_ensemble"),
        F.col("prev.rtc_text").alias("previous_last_rtc"), F.col("curr.rtc_text").alias("next_first_rtc"),
        F.col("elapsed").alias("elapsed_ms"), F.col("nominal").alias("nominal_interval_ms"), F.col("missing").alias("missing_acquisition_ms"),
        F.bround(F.col("missing") / F.col("nominal")).cast("long").alias("estimated_missing_ensembles"), F.col("counter").alias("counter_transition"),
        F.col("match").alias("fixed_leader_match"), F.col("duplicates").alias("exact_duplicate_overlap"), F.col("conflicts").alias("conflicting_time_overlap"),
        F.col("tail").alias("trailing_bytes_previous"), F.col("head").alias("leading_bytes_next"),
        F.col("tail_region").alias("trailing_region_previous"), F.col("head_region").alias("leading_region_next"),
        F.coalesce(~F.col("match"), F.lit(False)).alias("configuration_changed"), notes.alias("notes"),
    )


def boundaries(records: DataFrame, files: DataFrame, overall: F.Column, splits: DataFrame | None = None) -> DataFrame:
    """All boundaries of `files` (chronological(): one row for each file); without the columns of region_facts, the
    files have no damage."""
    for name, kind in (("trailing_bytes", "long"), ("trailing_region", "string"), ("leading_bytes", "long"), ("leading_region", "string")):
        if name not in files.columns:
            files = files.withColumn(name, F.lit(None).cast(kind))
    pairs = adjacent(files)
    return classify(pairs, exact_overlaps(records, pairs), time_conflicts(records, pairs), splits, overall)
