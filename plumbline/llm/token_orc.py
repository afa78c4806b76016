"""Token ids of documents in ORC files: stripes that readers take in parallel, integer run-length encoding, row indexes
and Bloom filters on document ids.

Rows are dealt by ranges of `doc_id` and sorted, so that the files in order of their names hold ascending ids; a
stripe's and a row group's least and greatest `doc_id` then say which ids can be in it, and its Bloom filter says which
are surely not. Tokenising follows the sort, so what is shuffled is the text, which is smaller than its ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import partitions
from .tokens import blocks, shared_encoder

#: Chunks that a worker remembers, next to a JVM that sorts and writes.
MEMO_ENTRIES = 1_000_000
SCHEMA = "doc_id long, file_start long, n_tokens int, tokens array<int>"


def write_token_orc(
    docs: DataFrame, path: str, *, tokenizer: str, end_id: int, stripe_bytes: int = 32 << 20, row_stride: int = 1000,
    spaces_matter: bool = True,
) -> None:
    """Encode `docs` (doc_id, text) and write (doc_id, file_start, n_tokens, tokens) to ORC files at `path`.

    A null text counts as empty and holds only the end id. A null doc_id is written first. Rows of one doc_id are all
    written, side by side in the order of a hash of their texts. Other columns are ignored; an empty table gives files
    without rows. file_start counts the ids that precede the document in its file.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, before = shared_encoder(tokenizer, end_id, spaces_matter, MEMO_ENTRIES), 0
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            for part in blocks(texts, 8_000_000):
                found = encoder.encode(texts[part])
                sizes = np.fromiter((len(x) // 4 for x in found), dtype=np.int64, count=len(found))
                ends = np.cumsum(sizes)
                values = pa.array(np.frombuffer(b"".join(found), dtype="<u4").view("<i4"))
                tokens = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), values)
                starts = before + ends - sizes
                before += int(ends[-1])
                out = pa.RecordBatch.from_arrays(
                    [ids[part.start : part.stop], pa.array(starts), pa.array(sizes.astype(np.int32)), tokens],
                    names=["doc_id", "file_start", "n_tokens", "tokens"],
                )
                for few in blocks(texts[part], 1_000_000):  # what is handed on at once
                    yield out.slice(few.start, few.stop - few.start)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # quantiles of the ids alone: a range exchange would sample whole rows, and so read every text twice
    n = partitions(docs.sparkSession)
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0]
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts or []))]).cast("array<bigint>")
    place = F.coalesce(F.size(F.filter(bounds, lambda c: c < F.col("doc_id"))), F.lit(0))
    place = F.when(F.col("doc_id").isNull(), 0).otherwise(place)
    dealt = rows.repartitionById(n, place).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc())
    (
        dealt.mapInArrow(encode, SCHEMA)
        .write.option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(row_stride))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("compression", "zstd")
        .orc(path)
    )


def read_token_orc(spark: SparkSession, path: str, where: Column | None = None) -> DataFrame:
    """The rows at `path` with `start`, the ids of all documents before it. `where` is a condition on doc_id: it
    reaches the ORC reader, which skips stripes and row groups by their ranges and Bloom filters.

    The starts of the files come from their n_tokens alone: one row for each file, as many as there were partitions.
    """
    rows = spark.read.schema(SCHEMA).orc(path)
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("long").alias("part")
    files = rows.select(part, "n_tokens").groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = files.select("part", before.alias("base"))
    chosen = rows if where is None else rows.where(where)
    return (
        chosen.select("*", part)
        .join(F.broadcast(bases), "part")
        .select("doc_id", (F.col("base") + F.col("file_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "tokens")
    )


def token_digests(rows: DataFrame) -> DataFrame:
    """`rows` of read_token_orc() with ids_crc32 instead of the ids: the unsigned crc32 of each list of ids as
    little-endian unsigned 32-bit integers. Null and repeated doc_ids stay as they are; no rows give no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = batch.column(3)
            view = memoryview(tokens.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)).cast("B")
            ends = (4 * tokens.offsets.to_numpy().astype(np.int64)).tolist()
            found = pa.array([zlib.crc32(view[a:b]) for a, b in zip(ends, ends[1:], strict=False)], type=pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], found], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.select("doc_id", "start", "n_tokens", "tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
