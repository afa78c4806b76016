"""Exact top-k inner products by pivot-table elimination.

A block of candidates keeps its distances to many pivots. By the triangle inequality, the greatest difference between two
rows of that table is a lower bound of the two vectors' distance, and so, with their lengths, an upper bound of their
inner product. The pivots near either vector give nearly all of that maximum, so a pair is bounded by the query's nearest
pivots and the candidate's own. Vectors are dealt to blocks around centres. A query first searches the block that
promises most; the k-th score found there rules out whole centres by their radius, and within the other blocks
candidates are scored in the order of their bounds until no bound reaches the k-th score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import drop, materialize, partitions
from .vectors import matrices, runs, sample_matrices, usable

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1
#: Longer vectors have no bounds in doubles: they are always scored.
GIANT = 1e75
#: The query's nearest pivots that bound a pair.
NEAREST = 16
SCALE = 1024
HITS = "query_id long, vec_id long, score long"


def component_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of the vectors that take part."""
    rows = vectors.where(usable("embedding") & F.col("vec_id").isNotNull())
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def scaled(components: np.ndarray) -> np.ndarray:
    """floor(1024 * x) as doubles, exact unless it overflows."""
    with np.errstate(over="ignore"):
        return np.floor(SCALE * components)


def lengths(matrix: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.sqrt((matrix * matrix).sum(axis=1))


def exact_product(a: np.ndarray, b: np.ndarray) -> int:
    """The inner product of floor(1024 * x), as the nearest long."""
    whole = lambda x: math.floor(SCALE * x) if math.isfinite(SCALE * x) else int(x) * SCALE
    total = sum(whole(x) * whole(y) for x, y in zip(a.tolist(), b.tolist(), strict=True))
    return min(max(total, LOWEST), HIGHEST)


def distances(matrix: np.ndarray, size: np.ndarray, points: np.ndarray) -> np.ndarray:
    """float32, pivots in rows. Giants have zeros."""
    own = np.where((size < GIANT)[:, None], matrix, 0)
    square = (points * points).sum(axis=1)[:, None] + (own * own).sum(axis=1)[None, :] - 2 * (points @ own.T)
    return np.sqrt(np.maximum(square, 0)).astype(np.float32)


def slack(size: np.ndarray | float, points: np.ndarray) -> np.ndarray | float:
    """More than the error of a vector's distances to any pivot."""
    return 1e-5 * (1 + size + (lengths(points).max() if len(points) else 0))


def greatest_product(size: float, sizes: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """An upper bound of inner products from the two lengths and a lower bound of the distance."""
    with np.errstate(over="ignore", invalid="ignore"):
        square, squares = size * size, sizes * sizes
        upper = np.minimum((square + squares - lower * lower) / 2, size * sizes) + 1e-9 * (square + squares) + 1
    return np.where((sizes < GIANT) & (size < GIANT), upper, np.inf)


class Block:
    """Candidates of one block with their pivot table, which is built when the first query comes."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = points
        self.held: list[tuple] = []
        self.ready = False
        #: Candidates that queries met, and those that were scored.
        self.met = self.scored = 0

    def add(self, ids: np.ndarray, components: np.ndarray) -> None:
        self.held.append((ids, components))

    def _settle(self) -> None:
        self.ids, self.components = (np.concatenate(x) for x in zip(*self.held, strict=True))
        self.vectors = scaled(self.components)
        self.sizes = lengths(self.vectors)
        self.vectors[~np.isfinite(self.vectors)] = 0  # their products are worked out from the components
        self.table = distances(self.vectors, self.sizes, self.points)
        if len(self.points):
            self.nearest = self.table.argmin(axis=0)
            self.radius = np.take_along_axis(self.table, self.nearest[None, :], axis=0)[0]
        self.slack = slack(self.sizes, self.points)
        self.ready = True

    def _bounds(self, vector: np.ndarray, size: float) -> np.ndarray:
        lower = np.zeros(len(self.ids))
        if len(self.points):
            own = distances(vector[None, :], np.array([size]), self.points)[:, 0]
            near = np.argpartition(own, min(NEAREST, len(own)) - 1)[:NEAREST]
            lower = np.maximum(np.abs(self.table[near] - own[near][:, None]).max(axis=0), np.abs(own[self.nearest] - self.radius))
            lower = np.maximum(lower.astype(np.float64) - self.slack - slack(size, self.points), 0)
        return greatest_product(size, self.sizes, lower)

    def _scores(self, components: np.ndarray, vector: np.ndarray, size: float, some: np.ndarray) -> np.ndarray:
        """Exact: sums in doubles stay below 2**53 where the product of the lengths does."""
        self.scored += len(some)
        plain = size * self.sizes[some] < 1 << 53
        # many survivors are scored as one product with the block, without a copy of their rows
        with np.errstate(over="ignore", invalid="ignore"):
            found = (self.vectors @ vector)[some] if 8 * len(some) > len(self.ids) else self.vectors[some] @ vector
        out = np.where(plain, found, 0).astype(np.int64)
        for i in np.flatnonzero(~plain):
            out[i] = exact_product(components, self.components[some[i]])
        return out

    def search(self, query: int, components: np.ndarray, k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best candidates, ties to smaller ids, of those that score `floor` or more."""
        if not self.ready:
            self._settle()
        vector = scaled(components)
        size = float(lengths(vector[None, :])[0])
        vector = np.where(np.isfinite(vector), vector, 0)
        upper = self._bounds(vector, size)
        upper[self.ids == query] = -np.inf
        self.met += len(upper)
        ids, scores, step = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 4 * k + 64
        while True:
            alive = np.flatnonzero(upper >= floor) if floor > LOWEST else np.flatnonzero(upper > -np.inf)
            if not len(alive):
                return ids, scores
            if step < len(alive) <= len(upper) // 8 or not len(ids) and step < len(alive):
                alive = alive[np.argpartition(-upper[alive], step - 1)[:step]]  # the greatest bounds first
            got = self._scores(components, vector, size, alive)
            upper[alive] = -np.inf
            good = got >= floor
            ids, scores = np.concatenate([ids, self.ids[alive][good]]), np.concatenate([scores, got[good]])
            best = np.lexsort((ids, ~scores))[:k]
            ids, scores = ids[best], scores[best]
            if len(ids) == k:
                floor = max(floor, int(scores[-1]))
            step *= 2


def _search_blocks(rows: DataFrame, points: dict[int, np.ndarray], k: int) -> DataFrame:
    """rows: (block, query, id, v, floor), query 0 for a block's candidates and 1 for queries sent to it; a block's vectors
    have one length. A task holds one block's candidates and streams the queries past them."""
    keys = ["block", "query"]
    dealt = rows.repartition(max(partitions(rows.sparkSession), 1), "block").sortWithinPartitions(*keys)
    reference = rows.sparkSession.sparkContext.broadcast(points)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, block = None, Block(np.zeros((0, 0)))
        for batch in batches:
            hits: list[tuple] = []
            for key, begin, end in runs([batch.column(i).to_pylist() for i in range(2)]):
                some = batch.slice(begin, end - begin)
                ids, components = some.column(2).to_numpy(), next(matrices(some.column(3), np.float64))[1]
                if key[0] != now:
                    now, block = key[0], Block(reference.value.get(components.shape[1], np.zeros((0, components.shape[1]))))
                if not key[1]:
                    block.add(ids, components)
                elif block.held:
                    for query, row, floor in zip(ids.tolist(), components, some.column(4).to_pylist(), strict=True):
                        found, scores = block.search(query, row, k, floor)
                        hits.append((np.full(len(found), query), found, scores))
            if hits:
                cols = [pa.array(np.concatenate(x)) for x in zip(*hits, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=["query_id", "vec_id", "score"])

    return dealt.select(*keys, "id", "v", "floor").mapInArrow(run, HITS)


def _best(hits: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 10, pivots: int = 1024, block_rows: int = 8192, sample_rows: int = 2048) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest integer inner products for each row that `is_query` (a condition
    on vec_id) takes, over all rows but those of its own vec_id; ties go to the smaller vec_id.

    Components count as floor(1024 * x). Vectors that are null, empty or hold null or non-finite components take no
    part, nor do rows with a null vec_id; all others do, whatever their size: a score beyond a long is the nearest long.
    Vectors compare with those of their own length. A vec_id on several rows is one query, by the smallest of its
    vectors; each of its rows is a candidate for others, and may come up several times. Other columns are ignored; an
    empty table gives no rows.

    The pivots are at most `pivots` vectors of a sample of at most sample_rows; the first of them, as many as there are
    blocks of block_rows, are centres. What goes to all tasks and the driver is the pivots, and a row for each centre; a
    centre with more vectors has several blocks.
    """
    spark = vectors.sparkSession
    clean = materialize(component_vectors(vectors), "topk-vectors")
    points: dict[int, np.ndarray] = {}
    for dim, found in sample_matrices(clean, "v", sample_rows).items():
        found = scaled(found)
        points[dim] = found[lengths(found) < GIANT][:pivots]
    centres = max(1, min(pivots, -(-clean.count() // block_rows)))
    reference = spark.sparkContext.broadcast({dim: own[:centres] for dim, own in points.items()})

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = 0
        for batch in batches:
            home, far, size = np.full(batch.num_rows, -1, dtype=np.int32), np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for rows, components in matrices(batch.column(1), np.float64):
                matrix = scaled(components)
                size[rows] = np.minimum(lengths(matrix), GIANT)
                own = reference.value.get(matrix.shape[1])
                if own is not None and len(own):
                    near = distances(np.where(np.isfinite(matrix), matrix, 0), size[rows], own)
                    home[rows], far[rows] = near.argmin(axis=0), near.min(axis=0)
            salts = pa.array(np.arange(salt, salt + batch.num_rows))
            salt += batch.num_rows
            names = ["vec_id", "v", "home", "far", "size", "salt"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home), pa.array(far), pa.array(size), salts], names=names)

    written = materialize(clean.mapInArrow(describe, "vec_id long, v array<double>, home int, far double, size double, salt long"), "topk-described")
    drop(clean)
    described = written.withColumn("dim", F.size("v"))
    # a row for each centre and each length of vectors
    found = described.groupBy("dim", "home").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high"), F.max("size").alias("size"))
    known: dict[int, list] = {}
    placed, before = [], 0
    for r in found.orderBy("dim", "home").collect():
        parts = -(-r.n // block_rows)
        placed.append((r.dim, r.home, before, parts))
        known.setdefault(r.dim, []).append((before, parts, r.home, r.low, r.high, r.size))
        before += parts
    groups = spark.sparkContext.broadcast({dim: np.array(own, dtype=np.float64) for dim, own in known.items()})

    def route(first: bool):  # noqa: ANN202
        """Blocks for each query: first one of the centre with the highest bound, then all others whose centre's bound
        reaches its floor."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, floors, got_block, got_row = batch.column(0).to_numpy(), batch.column(2).to_numpy(), [], []
                for rows, components in matrices(batch.column(1), np.float64):
                    matrix = scaled(components)
                    size = lengths(matrix)
                    start, parts, home, low, high, sizes = groups.value[matrix.shape[1]].T
                    own = reference.value.get(matrix.shape[1], np.zeros((0, matrix.shape[1])))
                    near = distances(np.where(np.isfinite(matrix), matrix, 0), size, own)
                    for i, d, n in zip(rows.tolist(), near.T, size.tolist(), strict=True):
                        to = d[home.astype(int)].astype(np.float64) if len(d) else np.zeros(len(home))
                        gap = np.where(home >= 0, np.maximum(to - high, low - to), 0)
                        gap = np.maximum(gap - 2 * slack(np.maximum(sizes, n), own), 0)
                        upper = greatest_product(n, sizes, gap)
                        best = int(upper.argmax())
                        seed = int(start[best] + ids[i] % parts[best])
                        if first:
                            some = np.array([seed])
                        else:
                            open_ = np.flatnonzero((upper >= floors[i]) | (floors[i] == LOWEST))
                            some = np.concatenate([np.arange(start[g], start[g] + parts[g]) for g in open_]) if len(open_) else np.zeros(0)
                            some = some[some != seed]
                        got_block.append(some.astype(np.int64))
                        got_row.append(np.full(len(some), i))
                if got_row:
                    picked = batch.take(pa.array(np.concatenate(got_row)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(got_block)), *picked.columns], names=["block", "id", "v", "floor"])

        return run

    lowest = F.lit(LOWEST).cast("long")
    at = spark.createDataFrame(placed, "dim int, home int, start long, parts long")
    # parts are dealt by row, so that a vec_id on many rows is in all of them
    block = F.col("start") + F.pmod(F.xxhash64("vec_id", "salt"), F.col("parts"))
    candidates = described.join(F.broadcast(at), ["dim", "home"]).select(block.alias("block"), F.lit(0).alias("query"), F.col("vec_id").alias("id"), "v", lowest.alias("floor"))
    # map-side minimum: a query id on many rows costs one row for each task
    queries = described.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v", lowest.alias("floor"))

    def searched(some: DataFrame, first: bool) -> DataFrame:
        routed = some.mapInArrow(route(first), "block long, id long, v array<double>, floor long").select("block", F.lit(1).alias("query"), "id", "v", "floor")
        return _search_blocks(candidates.unionByName(routed), points, k)

    seeds = materialize(searched(queries, True), "topk-seeds")
    floors = seeds.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k)
    again = queries.join(floors, queries.vec_id == floors.query_id, "left").select("vec_id", "v", F.coalesce("least", lowest).alias("floor"))
    hits = materialize(_best(seeds.unionByName(searched(again, False)), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "topk-best")
    for used in (written, seeds):
        drop(used)
    return hits
