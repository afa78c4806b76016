"""Intervals between records: median of a file, mode of all, and the choice for a boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import common_value, to_millis

#: Bytes of a file whose records one task puts in order.
STRETCH = 16 << 20


def steps(records: DataFrame) -> DataFrame:
    """(file, delta): positive milliseconds from a record to the next of its file, where both have a clock. A file's
    stretches of bytes are windows of their own; the first record of one is joined to the last of the one before."""
    rows = records.select("file", "start", F.floor(F.col("start") / STRETCH).alias("stretch"), to_millis("rtc").alias("ms"))
    ends = rows.groupBy("file", "stretch").agg(F.max_by("ms", "start").alias("end"))
    before = ends.select("file", "stretch", F.lag("end").over(Window.partitionBy("file").orderBy("stretch")).alias("end"))
    last = F.lag(F.struct("ms")).over(Window.partitionBy("file", "stretch").orderBy("start"))
    joined = rows.withColumn("last", last).join(before, ["file", "stretch"])
    earlier = F.when(F.col("last").isNull(), F.col("end")).otherwise(F.col("last.ms"))
    return joined.select("file", (F.col("ms") - earlier).alias("delta")).where("delta > 0")


def median_steps(records: DataFrame) -> DataFrame:
    """(file, nominal_ms): the median step, cut to a whole number; files without steps are absent."""
    return steps(records).groupBy("file").agg(F.median("delta").cast("long").alias("nominal_ms"))


def mode_interval(deltas: DataFrame) -> DataFrame:
    """(nominal_ms), one row: the most frequent `delta`; ties go to the one nearest the median, then to the smaller.
    Null for no deltas. Only counts of distinct deltas are shuffled after the first aggregation."""
    counts = deltas.groupBy("delta").agg(F.count("*").alias("n"))
    median = counts.agg(F.percentile("delta", F.lit(0.5), F.col("n"))).scalar()
    return counts.agg(F.max_by("delta", F.struct("n", -F.abs(F.col("delta") - median), -F.col("delta"))).cast("long").alias("nominal_ms"))


def global_interval(records: DataFrame) -> DataFrame:
    """(nominal_ms), one row: the mode of all files' steps; never across files."""
    return mode_interval(steps(records))


def chosen_interval(previous: str, following: str, overall: F.Column) -> F.Column:
    """Of two files' medians and the mode of all, the most frequent (see common_value)."""
    return common_value(F.array(F.col(previous), F.col(following), overall)).cast("long")
