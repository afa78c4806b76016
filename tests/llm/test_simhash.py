import random
import re

import numpy as np
import pytest
import xxhash

from plumbline.llm.simhash import (
    VantageTree,
    fingerprint,
    keep_representatives,
    link_fingerprints,
    near_duplicates,
    shard_forest,
)
from plumbline.llm.components import connected_components


WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def slow_fingerprint(text):
    words = WORD.findall((text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    votes = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for i in range(64):
            votes[i] += 1 if h >> i & 1 else -1
    return sum(1 << i for i in range(64) if votes[i] > 0)


def slow_components(values, radius=2):
    """values: {id: fingerprint}"""
    root = {k: k for k in values}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(values)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (values[a] ^ values[b]).bit_count() <= radius:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def clustered(n, seed):
    rng = random.Random(seed)
    out = set()
    while len(out) < n:
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 6])):
            x = base
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return list(out)[:n]


@pytest.mark.parametrize("text", ["", None, "  \t", "One", "One two", "a b c", "A b C d a b c", "é Ä\x0bx y\nz z z z z", "x " * 500])
def test_fingerprint_is_the_plain_one(text):
    assert fingerprint(text) == slow_fingerprint(text)


def test_fingerprint_hash_is_sparks_xxhash64(spark):
    from pyspark.sql import functions as F

    got = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first().h
    assert got % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


def test_tree_keeps_every_pair():
    values = np.array(clustered(3000, 1), dtype=np.uint64)
    tree = VantageTree.build(values[:500], 20, 2)
    assert tree.leaves > 8
    homes, seen = tree.homes(values), [set() for _ in values]
    for leaf, own in tree.visit(values, 2):
        for i in own.tolist():
            seen[i].add(leaf)
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values ^ values[i]) <= 2).tolist():
            assert homes[j] in seen[i]


def test_one_shard_is_exact():
    values = np.array(clustered(2000, 2), dtype=np.uint64)
    root = shard_forest(values, np.ones(len(values), dtype=bool), 2, leaf_rows=50)
    want = slow_components(dict(enumerate(values.tolist())))
    assert root.tolist() == [want[i] for i in range(len(values))]


def test_shards_together_are_exact(spark):
    values = clustered(3000, 3)
    signed = [(v - 2**64 if v >= 2**63 else v, 10 + i) for i, v in enumerate(values)]
    nodes = spark.createDataFrame(signed, "fp long, rep long").repartition(5)
    edges = link_fingerprints(nodes, shard_rows=200)
    got = {r.node: r.component for r in connected_components(edges).collect()}
    want = slow_components({10 + i: v for i, v in enumerate(values)})
    assert {k: got.get(k, k) for k in want} == want
    assert edges.count() < 3 * len(values)


def test_a_dense_shard_is_dealt_to_parts(spark):
    """Fingerprints a few bits from one centre, which no tree can part, and a sample that sees one shard only."""
    rng, centre, values = random.Random(4), 0x0123456789ABCDEF, set()
    while len(values) < 900:
        x = centre
        for b in rng.sample(range(64), rng.randint(0, 5)):
            x ^= 1 << b
        values.add(x)
    values = sorted(values) + clustered(100, 5)
    signed = [(v - 2**64 if v >= 2**63 else v, i) for i, v in enumerate(values)]
    edges = link_fingerprints(spark.createDataFrame(signed, "fp long, rep long").repartition(3), shard_rows=100, sample_per_shard=2)
    got = {r.node: r.component for r in connected_components(edges).collect()}
    want = slow_components(dict(enumerate(values)))
    assert {k: got.get(k, k) for k in want} == want
    assert link_fingerprints(spark.createDataFrame([], "fp long, rep long")).count() == 0


def test_long_chain_of_links(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(500, 500), (None, 3)], "a long, b long")
    got = {r.node: r.component for r in connected_components(edges).collect()}
    assert got == {i: 0 for i in range(301)}
    assert connected_components(edges.limit(0)).count() == 0


def test_documents_with_odd_rows(spark):
    texts = ["the cat sat on the mat today"] * 3 + [None, "", "  ", "other words here now", "The Cat SAT on the mat today"]
    rows = [(i, t, "x", 1.0) for i, t in enumerate(texts)] + [(None, "no id", "x", 1.0), (6, texts[6], "x", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id double")
    got = sorted((r.doc_id, r.component_id) for r in near_duplicates(docs).where("doc_id is not null").collect())
    values = {i: slow_fingerprint(t) for i, t in enumerate(texts)}
    assert got == sorted([*slow_components(values).items(), (6, 6)])
    kept = keep_representatives(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id if r.doc_id is not None else -1 for r in kept.collect()) == [-1, 0, 3, 6]
    assert near_duplicates(docs.limit(0)).count() == 0


def test_kept_rows_have_all_their_columns(spark):
    rows = [(1, "a b c d", 1, [1], "x"), (1, "a b c e", 2, None, "y"), (2, "a b c d", 3, [2], "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, rep int, `n.rows` array<int>, node string")
    (row,) = keep_representatives(docs).collect()
    assert tuple(row) in rows and row.doc_id == 1


def test_rows_of_a_kept_id_that_copy_another_document_go(spark):
    one, two, three, four = ("a cat sat on a mat", "rain fell over green hills", "seven ships left port early", "old clocks tick in empty halls")
    rows = [(1, one), (5, one), (5, two), (7, one), (7, three), (7, four), (7, three), (8, four), (9, "  "), (9, None)]
    kept = sorted(tuple(r) for r in keep_representatives(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert [r[0] for r in kept] == [1, 5, 7, 9]
    assert kept[:2] == [(1, one), (5, two)] and kept[2][1] in (three, four)


def test_query_against_brute_force(spark):
    from plumbline.llm.queries import QUERIES

    at = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    values = {k: slow_fingerprint(t) for k, t in texts.items()}
    want = slow_components(values)
    got = QUERIES["op9_simhash"](spark, at).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {k: (f"{values[k]:016x}", want[k]) for k in values}
