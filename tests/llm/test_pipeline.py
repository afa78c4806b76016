import corpus_pipeline
from plumbline.llm import byte_cnn, noisy_or
from plumbline.llm.byte_cnn import chunks
from plumbline.llm.queries import QUALITY_THRESHOLD, TOXIC_THRESHOLD

from .test_packing import check_pieces
from .test_simhash import slow_components, slow_fingerprint

import numpy as np


def test_pipeline_against_plain_python(spark):
    at = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    labels = spark.read.parquet(f"{at}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}

    net = byte_cnn.fit(docs, labels)
    score = lambda t: net.probabilities(net.pooled(chunks(t)), np.array([0]))[0]
    texts = {i: t for i, t in texts.items() if score(t) >= QUALITY_THRESHOLD}

    kept = docs.where(docs.doc_id.isin(list(texts)))
    model = noisy_or.fit(kept, labels)
    texts = {i: t for i, t in texts.items() if model.score(t) < TOXIC_THRESHOLD}

    root = slow_components({i: slow_fingerprint(t) for i, t in texts.items()})
    texts = {i: t for i, t in texts.items() if root[i] == i}
    assert 300 < len(texts) < 1000

    assert check_pieces(corpus_pipeline.run(spark, at).collect(), texts) < 1.03


def test_stages_return_the_columns_of_documents(spark):
    at = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{at}/documents.parquet")
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, at)
        assert docs.columns == columns
    empty = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, at).count() == 0


def test_stages_with_odd_rows(spark):
    """Null and repeated doc_ids, null and empty texts, a very long text, and columns with clashing names."""
    at = "/root/testdata/sf0.001"
    texts = [r.text for r in spark.read.parquet(f"{at}/documents.parquet").limit(40).collect()]
    rows = [(i, t, 1.0, "x") for i, t in enumerate(texts)] + [(3, texts[3], 1.0, "x"), (3, texts[4], 2.0, "y"), (None, texts[5], 1.0, "x"), (None, None, 1.0, "z"), (50, None, 1.0, "x"), (51, "", 1.0, "x"), (52, texts[0] * 100, 1.0, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score double, `fp.rep` string").repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = stage(spark, docs, at)
        assert left.columns == docs.columns
        kept = [tuple(r) for r in left.collect()]
        assert all(r in rows for r in kept) and len(kept) <= len(rows)
        if name == "near_duplicates":
            ids = [r[0] for r in kept if r[0] is not None]
            assert len(ids) == len(set(ids)) and 51 not in ids and sum(r[0] is None for r in kept) == 2
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, at)
    assert pieces.where("start = 0").count() == len(rows)
