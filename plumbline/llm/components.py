"""Connected components of a graph given by its edges, without bringing edges or components to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import drop, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every end of an edge, as a table for drop(); component is the smallest node that links lead to.

    edges: two long columns `a` and `b`. Nulls and loops are dropped, repeats don't matter, no edges give no rows.
    Large-star and small-star steps alternate until the edges stay the same; each round goes to a table in the shared
    folder, so its cost doesn't depend on the rounds before. A hub's edges are joined to the hub's minimum, which was
    aggregated on the map side, and so can be split over tasks.
    """
    a, b = F.col("a"), F.col("b")
    now = materialize(
        edges.where(a.isNotNull() & b.isNotNull() & (a != b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(),
        "links",
    )
    seen = _digest(now)
    while True:
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        under = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(under, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(under.select("a", F.col("m").alias("b")))
        )
        after = materialize(small.distinct(), "links")
        drop(now)
        now, before, seen = after, seen, _digest(after)
        if before == seen:
            break
    out = materialize(now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct()), "components")
    drop(now)
    return out


def _digest(edges: DataFrame) -> tuple:
    """Two equal digests mean equal sets of edges, but for a collision of 64-bit sums."""
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("s")).first()
    return row["n"], row["s"]
