"""Records cut in two by the end of a file: the tail of one file joined to the head of the next and parsed again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.pd0 import records as parsed_records
from ..sources.pd0 import regions as parsed_regions
from ..sources.pd0 import scan_contents
from ..vocabulary import REJECTED_SPLIT, SAFE_SPLIT, SPLIT_LATE, SPLIT_OTHER_LEADER, SPLIT_OUTSIDE, SPLIT_SAFE, TRUNCATED
from .boundaries import last_complete_before


def split_candidates(records: DataFrame, regions: DataFrame, contents: DataFrame | None, pairs: DataFrame, pieces: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row for each truncated record that reaches the end of an earlier file, where the next file begins with bytes
    that no record holds: whether both parts make a record, and why not. bytes_data holds a safe one.

    pairs: adjacent() of files with region_facts; contents: (path, content); pieces: what takes the parts from the files
    in place of `contents`, as cut_pieces() does. Only files with a candidate enter the search
    for the records around it, and what is cut from the contents is the candidates' own bytes.
    """
    cut = regions.where((F.col("classification") == TRUNCATED) & (F.col("end") == F.col("size")) & F.col("declared").isNotNull())
    cut = cut.select("file", F.col("start").alias("cut_at"), "declared", (F.col("size") - F.col("start")).alias("available"))
    sides = pairs.where("b.prefix_limit > 0").select(
        "boundary", F.col("a.file").alias("file"), F.col("b.file").alias("next_path"), F.col("a.file_name").alias("previous_file"), F.col("b.file_name").alias("next_file"),
        F.col("b.prefix_limit").alias("prefix_limit"), F.col("b.first").alias("following"),
    )
    rows = cut.join(sides, "file").withColumn("missing", F.col("declared") - F.col("available"))
    rows = rows.withColumn("inside", (F.col("missing") > 0) & (F.col("missing") <= F.col("prefix_limit")))
    rows = rows.withColumn("key", F.concat_ws(":", "boundary", "cut_at"))

    wanted = rows.where("inside")
    # both parts of each candidate in one pass over the contents
    sides = {"tail": ("file", F.col("cut_at"), F.col("available")), "head": ("next_path", F.lit(0).cast("long"), F.col("missing"))}
    parts = F.array(*[F.struct(F.lit(name).alias("part"), F.col(path).alias("path"), begin.alias("begin"), n.alias("n")) for name, (path, begin, n) in sides.items()])
    cuts = wanted.select("key", F.inline(parts))
    if pieces is not None:
        cuts = pieces(cuts)
    else:
        cuts = cuts.join(contents.select("path", "content"), "path").select("key", "part", F.expr("substring(content, CAST(begin AS INT) + 1, CAST(n AS INT))").alias("piece"))
    joined = F.concat(*[F.max(F.when(F.col("part") == name, F.col("piece"))) for name in sides])
    whole = cuts.groupBy(F.col("key").alias("path")).agg(joined.alias("content"))
    parsed = scan_contents(whole, "strict")
    good = parsed_records(parsed).where("start = 0").select(F.col("file").alias("key"), F.struct("number", "rtc", "rtc_text", "config", "digest", "payload", "total_bytes").alias("made"))
    bad = parsed_regions(parsed).where("start = 0 AND classification <> 'VALID_ENSEMBLE'").select(F.col("file").alias("key"), F.concat_ws(": ", "classification", "reason").alias("fault"))

    cut_files = records.join(rows.select("file").distinct(), "file", "left_semi")
    before = last_complete_before(cut_files, rows.select("file", F.col("cut_at").alias("at")).distinct())
    known = before.join(cut_files.select("file", F.col("start").alias("before"), F.struct("rtc", "config").alias("preceding")), ["file", "before"]).select("file", F.col("at").alias("cut_at"), "preceding")
    rows = rows.join(good, "key", "left").join(bad, "key", "left").join(known, ["file", "cut_at"], "left")

    made, preceding, following = F.col("made"), F.col("preceding"), F.col("following")
    in_time = F.coalesce(made["rtc"] >= preceding["rtc"], F.lit(True)) & F.coalesce(made["rtc"] <= following["rtc"], F.lit(True))
    same = F.coalesce(made["config"] == preceding["config"], F.lit(True)) & F.coalesce(made["config"] == following["config"], F.lit(True))
    doubts = F.concat_ws("; ", F.when(~in_time, SPLIT_LATE), F.when(~same, SPLIT_OTHER_LEADER))
    reason = F.when(~F.col("inside"), SPLIT_OUTSIDE).when(made.isNull(), F.col("fault")).when(~(in_time & same), doubts).otherwise(SPLIT_SAFE)
    safe = F.col("inside") & made.isNotNull() & in_time & same
    return rows.select(
        "boundary", "file", "previous_file", "next_file", "next_path", F.col("cut_at").alias("previous_offset"), F.col("available").alias("previous_available_bytes"),
        F.greatest(F.lit(0), F.col("missing")).alias("next_consumed_bytes"), F.col("declared").alias("declared_total_bytes"),
        made["number"].alias("candidate_ensemble_number"), made["rtc_text"].alias("candidate_rtc"), F.when(safe, SAFE_SPLIT).otherwise(REJECTED_SPLIT).alias("status"), reason.alias("reason"),
        made.isNotNull().alias("stored_checksum_validates"), made["config"].alias("fixed_leader_sha256"), made["digest"].alias("ensemble_sha256"),
        made["rtc"].alias("rtc"), F.when(safe, made["payload"]).alias("bytes_data"),
    )


def with_splits(records: DataFrame, splits: DataFrame) -> DataFrame:
    """Native records and safely rebuilt ones, as recovery takes them."""
    native = records.select(
        "file", "file_name", "start", F.col("total_bytes").cast("long").alias("source_length"), F.col("total_bytes").cast("long").alias("total_bytes"), "number", "rtc", "rtc_text", "config", "digest",
        F.lit(False).alias("reconstructed"), F.lit(None).cast("string").alias("continuation_file"), F.lit(None).cast("long").alias("continuation_length"),
    )
    rebuilt = splits.where(F.col("status") == SAFE_SPLIT).select(
        "file", F.col("previous_file").alias("file_name"), F.col("previous_offset").alias("start"), F.col("previous_available_bytes").alias("source_length"),
        F.col("declared_total_bytes").alias("total_bytes"), F.col("candidate_ensemble_number").alias("number"), "rtc", F.col("candidate_rtc").alias("rtc_text"),
        F.col("fixed_leader_sha256").alias("config"), F.col("ensemble_sha256").alias("digest"), F.lit(True).alias("reconstructed"),
        F.col("next_file").alias("continuation_file"), F.col("next_consumed_bytes").alias("continuation_length"),
    )
    return native.unionByName(rebuilt)
