"""SimHash near-duplicates: 64-bit fingerprints of 3-word shingles, linked exactly by vantage-point trees.

A tree over a sample splits Hamming space by distances to vantage points. Every fingerprint lives in the shard of its
leaf and, where the triangle inequality can't rule out a partner across a boundary, also visits later shards. A second
tree inside each shard finds all pairs within the radius; a shard returns a spanning forest of them, never the pairs.
A shard that turns out larger than its sample promised is dealt to parts, and two parts at a time to a task. Equal
fingerprints are one node, so copies cost nothing more.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .storage import drop, materialize

SHINGLE_WORDS, SEED = 3, 42


def fingerprint(text: str | None) -> int:
    """Unsigned 64 bits; zero for a text without words, null included."""
    import xxhash

    # split() cuts bytes at spaces and from tab to carriage return
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, k = b" ".join(words), SHINGLE_WORDS
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        hashes = np.array([digest(joined, SEED)], dtype=np.uint64)
    else:
        spans = zip(starts[: 1 - k].tolist(), ends[k - 1 :].tolist(), strict=True)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], dtype=np.uint64)
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 14):
        bits = np.unpackbits(hashes[i : i + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    on = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(on.view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) of each row of `docs` (doc_id, text): fp holds the fingerprint's 64 bits as a signed long, zero for a
    null or empty text. Null and repeated doc_ids stay as they are. Other columns are ignored; an empty table gives no
    rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


@dataclass
class VantageTree:
    """Inner nodes hold a vantage point and a distance; nearer or equal goes left. A child -1 - k is leaf k."""

    points: np.ndarray
    limits: np.ndarray
    left: np.ndarray
    right: np.ndarray
    leaves: int = field(default=1)

    @staticmethod
    def build(values: np.ndarray, leaf_rows: int, radius: int, seed: int = 7) -> VantageTree:
        """values: unsigned 64-bit; leaves of about leaf_rows of them. Of some candidates that divide a node's values
        well, the vantage point with the fewest values near the boundary is taken, so the fewest visit both sides."""
        rng, nodes, leaves = np.random.default_rng(seed), [], 0

        def grow(own: np.ndarray) -> int:
            nonlocal leaves
            split = _best_split(own, radius, rng) if len(own) > leaf_rows else None
            if split is None:
                leaves += 1
                return -leaves
            at = len(nodes)
            nodes.append([split[0], split[1], 0, 0])
            near = np.bitwise_count(own ^ split[0]) <= split[1]
            nodes[at][2] = grow(own[near])
            nodes[at][3] = grow(own[~near])
            return at

        grow(values)
        cols = list(zip(*nodes, strict=True)) if nodes else [[], [], [], []]
        return VantageTree(np.array(cols[0], dtype=np.uint64), *(np.array(c, dtype=np.int64) for c in cols[1:]), leaves=leaves)

    def visit(self, values: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
        """(leaf, indexes of values for which it can hold a partner within the radius); radius 0 gives homes."""
        stack = [(0 if len(self.points) else -1, np.arange(len(values)))]
        while stack:
            node, own = stack.pop()
            if node < 0:
                yield -1 - node, own
                continue
            far = np.bitwise_count(values[own] ^ self.points[node]).astype(np.int64)
            limit = self.limits[node]
            for child, some in ((self.left[node], own[far - radius <= limit]), (self.right[node], own[far + radius > limit])):
                if len(some):
                    stack.append((int(child), some))

    def homes(self, values: np.ndarray) -> np.ndarray:
        out = np.zeros(len(values), dtype=np.int64)
        for leaf, own in self.visit(values, 0):
            out[own] = leaf
        return out


def _best_split(own: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    some = own if len(own) <= 2048 else own[rng.integers(0, len(own), 2048)]
    best = None
    for point in rng.choice(own, min(12, len(own)), replace=False):
        far = np.bitwise_count(some ^ point).astype(np.int64)
        near = np.cumsum(np.bincount(far, minlength=66)) / len(some)
        for limit in range(65):
            if 0.25 <= near[limit] <= 0.75 or (best is None and 0 < near[limit] < 1):
                edge = near[min(64, limit + radius)] - (near[limit - radius] if limit >= radius else 0)
                uneven = abs(near[limit] - 0.5)
                cost = edge + uneven * uneven + (10 * uneven if not 0.25 <= near[limit] <= 0.75 else 0)
                if best is None or cost < best[0]:
                    best = (cost, point, limit)
    return None if best is None else (best[1], best[2])


def _settle(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the sets of a[i] and b[i]; parent is, and stays, settled with each set's smallest index as its root."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        a, b = a[apart], b[apart]
        if not len(a):
            break
        np.minimum.at(parent, np.maximum(ra, rb)[apart], np.minimum(ra, rb)[apart])
        parent = _settle(parent)
    return parent


def _close(x: np.ndarray, y: np.ndarray, radius: int, cells: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs of x and y within the radius, a block of rows at a time."""
    step = max(1, cells // max(1, len(y)))
    for i in range(0, len(x), step):
        a, b = np.nonzero(np.bitwise_count(x[i : i + step, None] ^ y[None, :]) <= radius)
        if len(a):
            yield a + i, b


def shard_forest(fp: np.ndarray, home: np.ndarray, radius: int, leaf_rows: int = 384) -> np.ndarray:
    """Roots of a shard's rows under all links of a home row to any row. fp: unsigned, distinct; home: whether the row
    lives in the shard or visits it. Visitors aren't compared among themselves; their own shards do that."""
    parent = np.arange(len(fp))
    own = np.flatnonzero(home)
    if not len(own):
        return parent
    tree = VantageTree.build(fp[own], leaf_rows, radius)
    leaf_of = np.full(len(fp), -1)
    leaf_of[own] = tree.homes(fp[own])
    order = own[np.argsort(leaf_of[own], kind="stable")]
    bounds = np.searchsorted(leaf_of[order], np.arange(tree.leaves + 1))
    for leaf, rows in tree.visit(fp, radius):
        members = order[bounds[leaf] : bounds[leaf + 1]]
        rows = rows[leaf_of[rows] <= leaf]  # a pair of home rows meets in the later leaf of the two
        for a, b in _close(fp[rows], fp[members], radius):
            parent = unite(parent, rows[a], members[b])
    return parent


def link_fingerprints(
    nodes: DataFrame, *, radius: int = 2, shard_rows: int = 16_384, sample_per_shard: int = 64, sample_most: int = 1 << 22
) -> DataFrame:
    """Spanning edges (a, b) of all pairs of `nodes` (fp, rep: distinct both, no nulls) whose fp differ in at most
    `radius` bits; no nodes give no edges. The shards' tree is built on the driver from at most sample_most fingerprints:
    those with the smallest hashes. Every fingerprint is compared; the sample only places the boundaries. A shard that
    turns out to be the home of more than four times shard_rows is cut into parts by a hash, and each two of its parts
    meet in a task."""
    spark = nodes.sparkSession
    rows = nodes.count()
    shards = max(1, -(-rows // shard_rows))
    most = min(sample_most, sample_per_shard * shards)
    sample = nodes.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(most).toArrow().column(0) if shards > 1 else pa.array([], type=pa.int64())
    values = sample.to_numpy().view(np.uint64)
    tree = spark.sparkContext.broadcast(VantageTree.build(values, max(1, most // shards), radius))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            homes = tree.value.homes(fp)
            for shard, own in tree.value.visit(fp, radius):
                own = own[homes[own] <= shard]
                if len(own):
                    picked = batch.take(pa.array(own))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), shard)), *picked.columns, pa.array(homes[own] == shard)],
                        names=["shard", "fp", "rep", "home"],
                    )

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rep")
        root = shard_forest(pdf.fp.to_numpy().view(np.uint64), pdf.home.to_numpy(), radius)
        rep, bound = pdf.rep.to_numpy(), np.flatnonzero(root != np.arange(len(root)))
        return pd.DataFrame({"a": rep[bound], "b": rep[root[bound]]})

    routed = nodes.select("fp", "rep").mapInArrow(route, "shard long, fp long, rep long, home boolean")
    # one row for each dense shard, of more than four times as many homes as the sample promised
    dense = routed.where("home").groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > 4 * shard_rows)
    dense = materialize(dense.select("shard", F.ceil(F.col("n") / shard_rows).cast("int").alias("parts")), "dense-shards")
    plain = routed.join(F.broadcast(dense), "shard", "left_anti").withColumns({"low": F.lit(0), "high": F.lit(0)})
    split = routed.join(F.broadcast(dense), "shard").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct(F.least("own", p).alias("low"), F.greatest("own", p).alias("high")))
    tiled = split.withColumn("tile", F.explode(others)).select("shard", "fp", "rep", "home", "tile.low", "tile.high")
    dealt = plain.unionByName(tiled) if dense.limit(1).count() else plain
    return dealt.groupBy("shard", "low", "high").applyInPandas(link, "a long, b long")


def near_duplicates(docs: DataFrame, *, radius: int = 2, shard_rows: int = 16_384) -> DataFrame:
    """(doc_id, fp, component_id) for every row of `docs` (doc_id, text; other columns are ignored).

    Rows link when their fingerprints differ in at most `radius` bits; component_id is the smallest doc_id that links
    lead to. Null and empty texts have fingerprint zero and link like any other. A row with a null doc_id gets its
    fingerprint and a null component_id, and links with nothing. Repeated doc_ids are each returned, and the
    fingerprints of which such a doc_id is the smallest count as linked. An empty table gives no rows.
    """
    each = materialize(fingerprints(docs), "fingerprints")
    nodes = materialize(each.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "fingerprint-nodes")
    parts = connected_components(link_fingerprints(nodes, radius=radius, shard_rows=shard_rows))
    labels = nodes.join(parts, nodes.rep == parts.node, "left").select("fp", F.coalesce("component", "rep").alias("component_id"))
    named = each.join(labels, "fp", "left")
    out = materialize(named.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")), "simhash-components")
    for used in (each, nodes, parts):
        drop(used)
    return out


def keep_representatives(docs: DataFrame, **options: int) -> DataFrame:
    """The rows of `docs` that stand for their group: doc_id equal to component_id. Of several such rows with one doc_id
    the one with the smallest hash of its text stays, then of all its columns' JSON; a row of that doc_id whose text
    belongs to another group doesn't. Rows with a null doc_id stay. The columns are those of `docs`, which may have any
    others besides doc_id and text."""
    groups = near_duplicates(docs, **options)
    found = groups.where("doc_id is not null")
    each = F.count("*").alias("n"), F.max(F.expr("doc_id = component_id")).alias("stands")
    kept = materialize(found.groupBy("doc_id", "fp").agg(*each), "kept")
    drop(groups)
    ids = kept.groupBy("doc_id").agg(F.sum("n").alias("n"), F.max("stands").alias("stands")).where("stands")
    # all grow with the input, so none is broadcast, whatever its size today
    once, again = (ids.where(x).select("doc_id").hint("merge") for x in ("n = 1", "n > 1"))
    stand = kept.where("stands").select(F.col("doc_id").alias("id"), "fp").hint("merge")

    @F.pandas_udf("long")
    def own_fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter(map(fingerprint, texts), dtype=np.uint64, count=len(texts)).view(np.int64))

    columns = [F.col(f"`{c}`") for c in docs.columns]
    single = docs.join(once, "doc_id", "left_semi").select(columns).unionByName(docs.where("doc_id is null"))
    if not ids.where("n > 1").limit(1).count():
        return single  # no doc_id is repeated, so no row needs its fingerprint again
    row = F.struct(*columns)
    rows = docs.join(again, "doc_id", "left_semi").select(
        F.col("doc_id").cast("long").alias("id"), own_fingerprint(F.col("text").cast("string")).alias("fp"), row.alias("row"),
        F.struct(F.xxhash64("text"), F.to_json(row)).alias("place"),
    )
    several = rows.join(stand, ["id", "fp"], "left_semi").groupBy("id").agg(F.min_by("row", "place").alias("row")).select("row.*")
    return single.unionByName(several)
