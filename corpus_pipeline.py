"""A corpus from documents to packed sequences: good documents, without toxic ones and near-duplicates, packed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import byte_cnn, noisy_or, packing, simhash
from plumbline.llm.queries import QUALITY_THRESHOLD, TOXIC_THRESHOLD, tokenizer_path
from plumbline.llm.storage import drop, materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the byte network, learned from `docs` and their labels, finds good: all columns stay. Null texts count as
    empty, null and repeated doc_ids don't matter, an empty table gives no rows."""
    net = byte_cnn.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return byte_cnn.keep_good(docs, net, QUALITY_THRESHOLD)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose noisy-or of sentences, learned from `docs` and their labels, stays under the threshold: all columns stay.
    Texts without words, null ones too, stay; null and repeated doc_ids don't matter; an empty table gives no rows."""
    model = noisy_or.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return noisy_or.drop_toxic(docs, model, TOXIC_THRESHOLD)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, that with the smallest doc_id: all columns stay. Null and empty texts are
    copies of each other; rows with a null doc_id stay; of a repeated doc_id one row stays; an empty table gives no rows."""
    return simhash.keep_representatives(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of packed sequences, as digests. A null text is one piece with the end id; null and repeated doc_ids are
    packed like any other; an empty table gives no rows."""
    return packing.piece_digests(packing.pack_documents(docs, tokenizer=tokenizer_path("word_bpe_49k.json"), end_id=1))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("packing", pack),
]

#: Trained models decide in it, so no SQL gives its rows; tests/llm/test_pipeline.py holds it against plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what one stage leaves is a table that the next one reads."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if name != STAGES[0][0]:
            drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)
