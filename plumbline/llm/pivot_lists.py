"""Near-duplicate embeddings by a pivot-permutation index.

A vector is described by the order of its nearest reference points. It is kept in the inverted list of its first pivot
and looks up the lists of its first few; a pair is verified if the two descriptions share enough pivots. Lists are
streamed: a task holds one list's members, of a bounded number, and reads the visitors past them. A long list is dealt to
several parts. Equal vectors are one member with a weight, so copies add nothing to a list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .simhash import unite
from .storage import drop, materialize, partitions
from .vectors import array_type, matrices, runs, sample_matrices, spread, unit, usable

FOUND = "kind int, a long, b long"
EDGE, COUNT = 0, 1


class PivotList:
    """One part of an inverted list: members, and links found so far."""

    def __init__(self, pivot: int, least: float, shared: int) -> None:
        self.pivot, self.least, self.shared = pivot, least, shared
        self.held: list[tuple] = []
        self.ready = False

    def add(self, *members: np.ndarray) -> None:
        self.held.append(members)

    def _settle(self) -> None:
        self.vectors, self.rep, self.weight, self.prefix = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.parent, self.count = np.arange(len(self.rep)), np.zeros(len(self.rep), dtype=np.int64)
        self.marks = self._marks(self.prefix)
        self.ready = True
        for i in range(0, len(self.rep), 256):
            near = self._near(self.vectors[i : i + 256], self.prefix[i : i + 256])
            near &= np.arange(len(self.rep))[None, :] > np.arange(i, i + len(near))[:, None]
            self._tally(near, i)

    def _marks(self, prefix: np.ndarray) -> np.ndarray:
        out = np.zeros((len(prefix), self._width()), dtype=np.float32)
        np.put_along_axis(out, prefix, 1, axis=1)
        return out

    def _width(self) -> int:
        return max(int(self.prefix.max()) + 1, 1)

    def _near(self, vectors: np.ndarray, prefix: np.ndarray) -> np.ndarray:
        width = self.marks.shape[1]
        own = np.zeros((len(prefix), width), dtype=np.float32)
        for column in prefix.T:  # pivots that no member has can't be shared
            inside = column < width
            own[np.flatnonzero(inside), column[inside]] = 1
        alike = own @ self.marks.T >= min(self.shared, prefix.shape[1])
        if 8 * np.count_nonzero(alike) < alike.size:
            a, b = np.nonzero(alike)
            alike[a, b] = np.einsum("ij,ij->i", vectors[a], self.vectors[b]) >= self.least
            return alike
        return alike & (vectors @ self.vectors.T >= self.least)

    def _tally(self, near: np.ndarray, begin: int) -> None:
        a, b = np.nonzero(near)
        np.add.at(self.count, a + begin, self.weight[b])
        np.add.at(self.count, b, self.weight[a + begin])
        self.parent = unite(self.parent, a + begin, b)

    def visit(self, vectors: np.ndarray, rep: np.ndarray, weight: np.ndarray, prefix: np.ndarray) -> Iterator[tuple]:
        """Links of visitors to members: (kind, a, b) rows for the visitors."""
        if not self.ready:
            self._settle()
        for i in range(0, len(rep), 256):
            part = slice(i, i + 256)
            near = self._near(vectors[part], prefix[part])
            # A pair whose first pivots are in both descriptions meets in two lists; the one of the lesser pivot has it.
            first = prefix[part][:, 0]
            twice = (self.prefix[None, :, :] == first[:, None, None]).any(axis=2) if len(self.rep) else near
            near &= ~(twice & (first < self.pivot)[:, None])
            a, b = np.nonzero(near)
            if not len(a):
                continue
            np.add.at(self.count, b, weight[part][a])
            found = np.bincount(a, weights=self.weight[b], minlength=len(near)).astype(np.int64)
            linked = np.flatnonzero(found)
            target = near.argmax(axis=1)
            self.parent = unite(self.parent, target[a], b)
            yield EDGE, rep[part][linked], self.rep[target[linked]]
            yield COUNT, rep[part][linked], found[linked]

    def close(self) -> Iterator[tuple]:
        if not self.held:
            return
        if not self.ready:
            self._settle()
        bound = np.flatnonzero(self.parent != np.arange(len(self.parent)))
        yield EDGE, self.rep[bound], self.rep[self.parent[bound]]
        some = np.flatnonzero(self.count)
        yield COUNT, self.rep[some], self.count[some]


def link_vectors(
    classes: DataFrame, *, least_cosine: float = 0.98, pivots: int = 128, prefix: int = 6, shared: int = 2,
    list_rows: int = 4096, sample_rows: int = 2048,
) -> DataFrame:
    """(kind, a, b) over `classes` (label, embedding, rep, weight), as a table for drop(): spanning edges between reps, and
    numbers of links. Each row is a vector of its own, without nulls; no rows give no rows.

    The pivots come from at most sample_rows vectors, those with the smallest hashes, such that no two pivots have a
    cosine above 0.7; every vector is indexed. Vectors of a length that the sample lacks share one list of their label.
    """
    chosen = {n: spread(unit(m), pivots, 0.7) for n, m in sample_matrices(classes, "embedding", sample_rows).items()}
    reference = classes.sparkSession.sparkContext.broadcast(chosen)
    kind = array_type(classes, "embedding")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            order: list = [None] * batch.num_rows
            for rows, matrix in matrices(batch.column(1), np.float64):
                points = reference.value.get(matrix.shape[1])
                if points is None:
                    near = np.zeros((len(rows), 1), dtype=np.int32)
                else:
                    near = np.argsort(-(unit(matrix) @ points.T), axis=1, kind="stable")[:, :prefix].astype(np.int32)
                for i, row in zip(rows.tolist(), near, strict=True):
                    order[i] = row
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(order, type=pa.list_(pa.int32()))], names=[*batch.schema.names, "prefix"])

    described = materialize(
        classes.select(F.col("label").cast("string").alias("label"), "embedding", "rep", "weight").mapInArrow(
            describe, f"label string, embedding {kind}, rep long, weight long, prefix array<int>"
        ).withColumn("dim", F.size("embedding")),
        "described",
    )
    at = ["label", "dim", "pivot"]
    first = F.col("prefix")[0]
    long = (
        described.groupBy("label", "dim", first.alias("pivot")).agg(F.count("*").alias("n")).where(F.col("n") > list_rows)
        .select(*at, F.ceil(F.col("n") / list_rows).cast("int").alias("parts"))
    )
    posted = described.select("*", F.posexplode("prefix").alias("place", "pivot")).join(long, at, "left")
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("rep"), parts).cast("int")
    later = F.when(F.col("place") > 0, F.sequence(F.lit(0), parts - 1)).otherwise(F.filter(F.sequence(F.lit(0), parts - 1), lambda p: p >= own))
    rows = posted.select(*at, F.explode(later).alias("part"), own.alias("own"), "place", "embedding", "rep", "weight", "prefix")
    member: Column = (F.col("place") == 0) & (F.col("part") == F.col("own"))
    keys = [*at, "part", "visitor"]
    dealt = rows.withColumn("visitor", (~member).cast("int")).select(*keys, "embedding", "rep", "weight", "prefix")
    dealt = dealt.repartition(partitions(classes.sparkSession), *keys[:-1]).sortWithinPartitions(*keys)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, current = None, None

        def out(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            for what, a, b in found:
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), what, dtype=np.int32)), pa.array(a), pa.array(b)], names=["kind", "a", "b"])

        for batch in batches:
            for key, begin, end in runs([batch.column(i).to_pylist() for i in range(5)]):
                if key[:-1] != now:
                    if current is not None:
                        yield from out(current.close())
                    now, current = key[:-1], PivotList(key[2], least_cosine, shared)
                some = batch.slice(begin, end - begin)
                if key[-1] and not current.held:
                    continue  # nobody lives here
                vectors = unit(next(matrices(some.column(5), np.float64))[1])
                order = next(matrices(some.column(8), np.int64))[1]
                rest = vectors, some.column(6).to_numpy(), some.column(7).to_numpy(), order
                if key[-1]:
                    yield from out(current.visit(*rest))
                else:
                    current.add(*rest)
        if current is not None:
            yield from out(current.close())

    found = materialize(dealt.mapInArrow(search, FOUND), "vector-links")
    drop(described)
    return found


def near_duplicate_vectors(vectors: DataFrame, *, least_cosine: float = 0.98, **options: int) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of `vectors` (vec_id, embedding, label).

    Rows link if their labels are equal and not null, their vectors have the same length, and the cosine in double
    precision is least_cosine or more, as far as the index finds them (README: recall). Vectors that are null, empty,
    zero or hold null or non-finite components link with nothing. n_links counts the other rows linked directly, copies
    included; component_id is the smallest vec_id that links lead to; kept says that it is the row's own. A row with a
    null vec_id links with nothing and has a null component_id. vec_id names a vector: of rows that repeat one with
    other vectors, the links are added up. Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(array_type(vectors, "embedding")).alias("embedding"), "label")
    takes_part = usable("embedding") & F.exists("embedding", lambda x: x != 0) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    some = rows.where(takes_part)
    classes = materialize(some.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "vector-classes")
    found = link_vectors(classes, least_cosine=least_cosine, **options)
    linked = connected_components(found.where(F.col("kind") == EDGE).select("a", "b"))
    parts = linked.select(F.col("node").alias("rep"), "component")
    counts = found.where(F.col("kind") == COUNT).groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("linked"))
    known = classes.join(parts, "rep", "left").join(counts, "rep", "left").select(
        "label", "embedding",
        (F.col("weight") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    out = some.join(known, ["label", "embedding"], "left").select("vec_id", "n_links", "component_id")
    rest = rows.where(~takes_part).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    whole = materialize(out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id"))), "vector-components")
    for used in (classes, found, linked):
        drop(used)
    return whole
