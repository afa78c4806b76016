import math
from fractions import Fraction

import numpy as np
import pytest

from plumbline.llm.pivot_lists import near_duplicate_vectors
from plumbline.llm.queries import QUERIES
from plumbline.llm.topk import LOWEST, Block, scaled, top_k
from pyspark.sql import functions as F


def ok(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


def slow_top_k(rows, takes, k=10):
    """In whole numbers of any size; scores are the nearest longs."""
    own = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in rows if i is not None and ok(v)]
    small = all(abs(x) < 1 << 25 for _, v in own for x in v)
    table = [(i, np.array(v, dtype=np.int64 if small else object)) for i, v in own]
    score = lambda x, y: min(max(int((x * y).sum()), -(1 << 63)), (1 << 63) - 1)
    out = set()
    for q, x in table:
        if takes(q):
            found = sorted((-score(x, y), i) for i, y in table if i != q and len(x) == len(y))[:k]
            out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(found)}
    return out


def slow_links(rows, least=0.98):
    """vec_id -> (n_links, component)"""
    own = [(i, np.asarray(v, dtype=np.float64), g) for i, v, g in rows if ok(v) and any(v) and g is not None]
    root, n = {i: i for i, _, _ in rows}, dict.fromkeys((i for i, _, _ in rows), 0)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, x, g) in enumerate(own):
        for j, y, h in own[:k]:
            if g == h and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= least:
                n[i] += 1
                n[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (n[i], find(i)) for i in n}


def table(n, seed, dim=16, clusters=True):
    rng = np.random.default_rng(seed)
    rows = []
    centre = rng.normal(size=dim)
    for i in range(n):
        kind = rng.integers(0, 6)
        if kind == 0 and clusters:
            v = centre + rng.normal(size=dim) * 0.03
        elif kind == 1 and rows:
            v = np.array(rows[rng.integers(0, len(rows))][1]) * rng.choice([1.0, 1.0, 2.0]) + rng.choice([0, 0.02]) * rng.normal(size=dim)
        else:
            v = rng.normal(size=dim)
        rows.append((i, [float(np.float32(x)) for x in v], int(rng.integers(0, 3))))
    return rows


@pytest.mark.parametrize("rows_per_block", [40, 100_000])
def test_top_k_is_exact(spark, rows_per_block):
    rows = table(600, 1)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = {tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0, block_rows=rows_per_block, pivots=8).collect()}
    assert got == slow_top_k([r[:2] for r in rows], lambda i: i % 20 == 0)


def test_top_k_with_odd_rows(spark):
    rows = [
        (0, [1.0, 2.0]), (100, [1.0, 2.0]), (1, [0.5, float("nan")]), (2, None), (3, [None, 1.0]), (4, [1.0, float("inf")]),
        (5, []), (6, [1.0, 1.0, 1.0]), (200, [2.0, 2.0, 2.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [3.0, 3.0]), (8, [1e9, 0.0]),
    ]
    df = spark.createDataFrame([(i, v, "x", 5) for i, v in rows], "vec_id long, embedding array<double>, block string, score int")
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 100 == 0).collect())
    five, both, far = 5 * 1024 * 1024, 6 * 1024 * 1024, 10**9 * 1024 * 1024
    assert got == [
        (0, 1, 8, far), (0, 2, 7, five), (0, 3, 7, five), (0, 4, 100, five),
        (100, 1, 8, far), (100, 2, 0, five), (100, 3, 7, five), (100, 4, 7, five), (200, 1, 6, both),
    ]
    assert top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_top_k_keeps_vectors_whose_scores_fit_a_long(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=4) * 10.0 ** rng.integers(-3, 6)).tolist()) for i in range(300)]
    rows += [(400, [2.9e6, 0.001, 0.0, 0.0]), (401, [-2.9e6, 0.002, 0.0, 0.0]), (402, [20_000.001, 0.5, 0.0, 0.0]), (500, [2.9e6, 0.003]), (501, [-2.9e6, 0.001])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = slow_top_k(rows, lambda i: i % 20 == 0)
    assert (500, 1, 501, -(2_969_600_000**2) + 3) in want
    for block_rows in (40, 8192):
        assert {tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0, block_rows=block_rows, pivots=8).collect()} == want


def test_top_k_keeps_every_finite_vector(spark):
    """Components of 2e4, 1e9 and up to the largest double, among many that fit."""
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=2)).tolist()) for i in range(120)]
    rows += [(200, [20_000.0, 0.0]), (201, [1e9, 0.5]), (202, [-1e30, 1.0]), (203, [1.7e308, -1.7e308]), (204, [4e6, 0.0]), (205, [3e153, 1.0]), (220, [-2e9, 3e9])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    want = slow_top_k(rows, lambda i: i % 20 == 0)
    assert any(s == (1 << 63) - 1 for _, _, _, s in want)
    for block_rows in (20, 8192):
        assert {tuple(r) for r in top_k(df, F.col("vec_id") % 20 == 0, block_rows=block_rows, pivots=8).collect()} == want


def test_copies_of_one_row_lie_in_several_blocks(spark):
    rows = [(1, [1.0, 0.0])] * 60 + [(0, [1.0, 1.0]), (2, [2.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(2)
    got = sorted(tuple(r) for r in top_k(df, F.col("vec_id") == 0, block_rows=8).collect())
    assert got == [(0, 1, 2, 2 << 20), *[(0, r, 1, 1 << 20) for r in range(2, 11)]]


def test_bounds_stop_the_search():
    """On a table of which half are pivots most candidates are never scored; what is found stays exact."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(2000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    block = Block(scaled(x[rng.permutation(2000)[:1000]]))
    block.add(np.arange(2000), x)
    whole = np.floor(1024 * x).astype(np.int64)
    for q in range(0, 2000, 100):
        ids, scores = block.search(q, x[q], 10, LOWEST)
        want = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)[:10]
        assert [(-s, i) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)] == want
    assert block.scored < 0.6 * block.met


def test_top_k_query_against_brute_force(spark):
    at = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()]
    assert {tuple(r) for r in QUERIES["op3_topk"](spark, at).collect()} == slow_top_k(rows, lambda i: i % 100 == 0)


@pytest.mark.parametrize("list_rows", [16, 4096])
def test_links_against_brute_force(spark, list_rows):
    rows = table(700, 2)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = near_duplicate_vectors(df, list_rows=list_rows, pivots=32).collect()
    want = slow_links(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_links_query_recall(spark, tmp_path):
    """Near copies among spread vectors, and one dense group of 300, each of a cosine of 0.98 to 0.995 to its origin."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    origin = np.concatenate([np.zeros(300, dtype=int), rng.integers(0, 4000, 900)])
    turn = rng.normal(size=(1200, 64))
    turn -= (turn * x[origin]).sum(axis=1, keepdims=True) * x[origin]
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    cosine = rng.uniform(0.98, 0.995, size=(1200, 1))
    x = np.concatenate([x, cosine * x[origin] + np.sqrt(1 - cosine**2) * turn]).astype(np.float32)
    label = np.concatenate([np.arange(4000), origin]) % 2
    rows = [(i, v.tolist(), int(g)) for i, (v, g) in enumerate(zip(x, label, strict=True))]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.vec_id: r for r in QUERIES["op5_pivot_lists"](spark, str(tmp_path)).collect()}
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    want = ((u @ u.T >= 0.98) & (label[:, None] == label[None, :])).sum(axis=1) - 1
    assert sum(want) > 10_000
    assert all(got[i].n_links <= n for i, n in enumerate(want))
    assert sum(r.n_links for r in got.values()) >= 0.99 * sum(want)


def test_links_with_odd_rows(spark):
    rows = [
        (1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], None), (4, [0.0, 0.0], 1), (5, None, 1), (6, [None, 1.0], 1),
        (7, [float("nan"), 1.0], 1), (8, [1.0, 0.0], 2), (9, [1.0, 0.0, 0.0], 1), (10, [1e300, 1e299], 1), (11, [1e300, 1e299], 1), (12, [], 1),
    ]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, rep int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(df).collect()}
    linked = {1: (3, 1, True), 2: (3, 1, False), 10: (3, 1, False), 11: (3, 1, False)}
    assert got == {i: linked.get(i, (0, i, True)) for i, _, _ in rows}
    none = spark.createDataFrame([(None, [1.0], 1)], "vec_id long, embedding array<double>, label int")
    assert [tuple(r) for r in near_duplicate_vectors(none).collect()] == [(None, 0, None, True)]
    assert near_duplicate_vectors(df.limit(0)).count() == 0
