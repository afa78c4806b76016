"""A bounded sample of labelled documents for training on the driver, the split into folds, and rows chosen by a model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import materialize


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo the number of folds, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_sample(docs: DataFrame, labels: DataFrame, column: str, most: int, most_chars: int = 48_000_000) -> DataFrame:
    """(doc_id, label, text) of at most `most` documents that aren't held out, those whose ids have the smallest hashes;
    whole texts, in that order only as long as the texts before hold fewer than most_chars characters together.

    label: the least of the ids' labels in `column`, 0 or 1; rows without one don't count. An id on several rows of
    `docs` is one document, by the text with the smallest hash. Null texts are empty, null ids take no part, other
    columns are ignored, and without documents or labels there are no rows. A table holds the texts until drop(). The ids, `most` at the most, are sent to
    all tasks.
    """
    rated = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    rated = rated.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(column).cast("int").alias("label"))
    order = F.xxhash64("doc_id"), F.col("doc_id")
    chosen = rated.orderBy(*order).limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    text = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    found = materialize(rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(text), "training-sample")
    # a row for each document of the sample, `most` at the most
    lengths = found.select("doc_id", F.length("text").cast("long").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = lengths.select("doc_id", before.alias("before")).where(F.col("before") < most_chars).select("doc_id")
    out = found.join(F.broadcast(within), "doc_id").select("doc_id", "label", "text")
    out._plumbline_path = found._plumbline_path  # drop() takes it
    return out


def rows_by_text(docs: DataFrame, judge: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows of `docs` whose text `judge` accepts (texts in, booleans out), with all columns. Columns are taken by
    place, so that any names do."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(judge(batch.column(at)), type=pa.bool_())).rename_columns(docs_columns)

    docs_columns = docs.columns
    return docs.toDF(*[f"c{i}" for i in range(len(docs_columns))]).mapInArrow(run, docs.schema)
