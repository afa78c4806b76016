"""Windows over one global order without one task for all rows.

Rows are dealt by ranges of the whole order, so that equal leading keys, null ones too, can lie in several parts, and are
written once with the number of their part. Each part has its own window; what crosses a boundary is one row for each
part, which is joined back by broadcast. Pass narrow rows: what is written is all their columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import keep


def _parts(df: DataFrame, order: list[Column], parts: int | None) -> DataFrame:
    """`df` as a table with __part, numbered in the order; `order` ascends with nulls last."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keep(df.repartitionByRange(n, *[c.asc_nulls_last() for c in order]).withColumn("__part", F.spark_partition_id()), "ordered")


def _sortable(order: list[Column]) -> list[Column]:
    """The order's columns as parts of a struct: each with whether it is null, so that nulls come last."""
    return [part for c in order for part in (c.isNull(), c)]


def global_lag(df: DataFrame, order: list[Column], value: Column, name: str, parts: int | None = None) -> DataFrame:
    """`df` with `value` of the row before in the order, as column `name`. `order` is complete, ascending with nulls last."""
    rows = _parts(df.withColumn("__value", value), order, parts)
    own = Window.partitionBy("__part").orderBy(*[c.asc_nulls_last() for c in order])
    # one row for each part: the last of the nearest part before
    last = rows.groupBy("__part").agg(F.max_by("__value", F.struct(*_sortable(order))).alias("__end"))
    ends = last.select("__part", F.lag(F.struct("__end")).over(Window.orderBy("__part")).alias("__before"))
    joined = rows.withColumn("__in", F.lag(F.struct("__value")).over(own)).join(F.broadcast(ends), "__part")
    taken = F.when(F.col("__in").isNotNull(), F.col("__in")["__value"]).otherwise(F.col("__before")["__end"])
    return joined.withColumn(name, taken).drop("__part", "__value", "__in", "__before")


def global_running_total(df: DataFrame, order: list[Column], value: Column, name: str, parts: int | None = None) -> DataFrame:
    """`df` with the sum of `value` over all rows before, as column `name`; 0 for the first."""
    rows = _parts(df.withColumn("__value", value), order, parts)
    own = Window.partitionBy("__part").orderBy(*[c.asc_nulls_last() for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("__part").agg(F.sum("__value").alias("__sum"))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = rows.withColumn("__in", F.coalesce(F.sum("__value").over(own), F.lit(0))).join(F.broadcast(sums.select("__part", before.alias("__base"))), "__part")
    return joined.withColumn(name, (F.col("__base") + F.col("__in")).cast("long")).drop("__part", "__value", "__in", "__base")
