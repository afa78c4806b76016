"""Records that are kept, conflicts, gaps, provenance, verdict and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import to_millis
from ..vocabulary import FAIL, NATIVE_CONFLICT, PASS, PASS_WITH_FRAGMENTS, PASS_WITH_GAPS, REBUILT_CONFLICT, REVIEW
from .cadence import STRETCH
from .ordered import global_lag, global_running_total


def order_columns() -> list[Column]:
    """The order of recovered records: by clock, records without one last."""
    return [F.col("rtc"), F.col("file_name"), F.col("file"), F.col("start")]


def _rank() -> Column:
    """The same order as one comparable value."""
    return F.struct(F.col("rtc").isNull().alias("no_clock"), "rtc", "file_name", "file", "start")


def keep_first(records: DataFrame) -> DataFrame:
    """The first record, in the order of recovery, of each whole-record digest. The choice is an aggregation with a
    map-side part, so a digest that a third of all rows share costs a row for each task."""
    chosen = records.groupBy("digest").agg(F.min(F.struct(_rank().alias("rank"), F.struct(*records.columns).alias("row"))).alias("x"))
    return chosen.select("x.row.*")


def conflicts(kept: DataFrame) -> DataFrame:
    """Of kept records with equal clock text, raw texts included, all but the first."""
    first = kept.groupBy("rtc_text").agg(F.min(_rank()).alias("__first"))
    return kept.join(first, "rtc_text").where(_rank() > F.col("__first")).select(kept.columns)


def conflict_message() -> Column:
    again = F.coalesce(F.col("reconstructed"), F.lit(False))
    native = F.format_string(NATIVE_CONFLICT, "rtc_text", "file_name", "start")
    return F.when(again, F.format_string(REBUILT_CONFLICT, "rtc_text", "file_name", "start", "continuation_file")).otherwise(native)


def gaps(kept: DataFrame, nominal: Column, parts: int | None = None) -> DataFrame:
    """Adjacent records of the recovered order that are further apart than the nominal interval, without tolerance;
    pairs without two clocks don't count."""
    ms = to_millis("rtc")
    before = F.struct("rtc_text", "number", "file_name", "file", ms.alias("ms"))
    narrow = kept.select("rtc", "rtc_text", "number", "file_name", "file", "start")
    rows = global_lag(narrow, order_columns(), before, "before", parts)
    rows = rows.withColumns({"nominal": nominal, "elapsed_ms": ms - F.col("before.ms")}).where("elapsed_ms > nominal")
    missing = F.col("elapsed_ms") - F.col("nominal")
    return rows.select(
        F.col("before.rtc_text").alias("before_rtc"), F.col("rtc_text").alias("after_rtc"), "elapsed_ms", F.col("nominal").alias("expected_interval_ms"),
        missing.alias("missing_acquisition_ms"), F.bround(missing / F.col("nominal")).cast("long").alias("estimated_missing_ensembles"),
        F.col("before.number").alias("before_ensemble"), F.col("number").alias("after_ensemble"),
        F.col("before.file_name").alias("before_source"), F.col("file_name").alias("after_source"),
        F.when(F.col("before.file") == F.col("file"), "within_file").otherwise("file_boundary").alias("location"),
    )


def gap_seconds(found: DataFrame) -> DataFrame:
    """Gaps as they are written: seconds with three decimals."""
    text = lambda c: F.format_string("%.3f", F.col(c) / F.lit(1000.0))
    return found.select(
        "before_rtc", "after_rtc", text("elapsed_ms").alias("elapsed_seconds"), text("expected_interval_ms").alias("expected_interval_seconds"),
        text("missing_acquisition_ms").alias("missing_acquisition_seconds"), "estimated_missing_ensembles", "before_ensemble", "after_ensemble",
        "before_source", "after_source", "location",
    )


def provenance(kept: DataFrame, parts: int | None = None) -> DataFrame:
    """Where each kept record lies in the output: output_byte_offset is the length of all before it."""
    return global_running_total(kept, order_columns(), F.col("total_bytes"), "output_byte_offset", parts)


def verify_provenance(mapped: DataFrame, output: DataFrame) -> DataFrame:
    """Rows of the map without an equal output record at their place, and the other way round; none if all is well.
    mapped: (output_byte_offset, total_bytes, digest), output: (start, total_bytes, digest)."""
    a = mapped.select(F.col("output_byte_offset").alias("place"), "total_bytes", "digest")
    b = output.select(F.col("start").alias("place"), "total_bytes", "digest")
    keys = ["place", "total_bytes", "digest"]
    lost = a.join(b, keys, "left_anti").withColumn("problem", F.lit("missing in output"))
    return lost.unionByName(b.join(a, keys, "left_anti").withColumn("problem", F.lit("not in map")))


def duplicate_digests(records: DataFrame) -> DataFrame:
    return records.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")


def verdict(conflicts: Column, ambiguous: Column, issues: Column, fragments: Column, gaps: Column) -> Column:
    """Counts or booleans in, verdict out; the first that holds decides."""
    return F.when(conflicts | ambiguous, REVIEW).when(issues, FAIL).when(fragments, PASS_WITH_FRAGMENTS).when(gaps, PASS_WITH_GAPS).otherwise(PASS)


def physical_index(records: DataFrame) -> DataFrame:
    """Records with physical_index, from 1 in the order of bytes, and the file's total. A file's stretches of bytes are
    windows of their own; of each, the number of records before it is added."""
    rows = records.withColumn("__stretch", F.floor(F.col("start") / STRETCH))
    counts = rows.groupBy("file", "__stretch").agg(F.count("*").alias("n"))
    own = Window.partitionBy("file")
    order = own.orderBy("__stretch")
    before = counts.select(
        F.col("file").alias("__file"), F.col("__stretch").alias("__of"), F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"),
        F.sum("n").over(own).alias("total"),
    )
    same = F.col("file").eqNullSafe(F.col("__file")) & F.col("__stretch").eqNullSafe(F.col("__of"))
    place = F.row_number().over(Window.partitionBy("file", "__stretch").orderBy("start"))
    joined = rows.withColumn("__place", place).join(before.withColumnRenamed("total", "__total"), same)
    return joined.select(*[c for c in records.columns if c not in ("physical_index", "total")], (F.col("__before") + F.col("__place")).cast("int").alias("physical_index"), F.col("__total").alias("total"))


def removed_by(first: int | None = None, last: int | None = None, between: tuple[int, int] | None = None) -> Column:
    """Whether a slice removes an indexed record: the first or last N, or the places from A to B."""
    at = F.col("physical_index")
    if first is not None:
        return at <= first
    if last is not None:
        return at > F.col("total") - last
    return at.between(*between)


def slice_bounds(how: Column, spec: Column, total: Column) -> Column:
    """struct<lowest, highest>: the places, from 1, that a slice removes, or null if it asks for what isn't there. how:
    first, last or range; spec: a number, or A:B with both ends included."""
    number = lambda text: F.when(text.rlike(r"^\s*[+-]?[0-9]{1,18}\s*$"), F.trim(text).cast("long"))
    cut = F.split(spec, ":", 2)
    a, b = number(cut[0]), number(F.try_element_at(cut, F.lit(2)))
    n = F.when(F.size(cut) == 1, a)
    low = F.when(how == "first", F.lit(1)).when(how == "last", total - n + 1).otherwise(a)
    high = F.when(how == "first", n).when(how == "last", total).otherwise(b)
    return F.when((low >= 1) & (low <= high) & (high <= total), F.struct(low.cast("long").alias("lowest"), high.cast("long").alias("highest")))


def index_ranges(indexes: DataFrame) -> DataFrame:
    """(file, ranges) of `indexes` (file, physical_index): runs as "1-3, 5"."""
    own = Window.partitionBy("file").orderBy("physical_index")
    island = F.col("physical_index") - F.row_number().over(own)
    runs = indexes.select("file", "physical_index", island.alias("island")).groupBy("file", "island").agg(F.min("physical_index").alias("a"), F.max("physical_index").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    ordered = runs.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("a", text.alias("t")))).alias("x"))
    return ordered.select("file", F.array_join(F.col("x.t"), ", ").alias("ranges"))
