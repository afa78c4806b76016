import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm.queries import QUERIES
from plumbline.llm.token_orc import read_token_orc, token_digests, write_token_orc

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(texts, end=2):
    """[(doc_id, start, n, crc)] of (doc_id, text) in order."""
    tok, out, before = Tokenizer.from_file(PATH), [], 0
    for doc_id, text in texts:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc_id, before, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        before += len(ids)
    return out


def test_query_against_the_library(spark):
    at = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{at}/documents.parquet").orderBy("doc_id").collect()]
    got = [tuple(r) for r in QUERIES["op1_token_orc"](spark, at).orderBy("doc_id").collect()]
    assert got == plain(texts)


def test_files_hold_ascending_ids_and_prune(spark, tmp_path):
    texts = [(3 * i, f"document {i} " + "word " * (i % 7)) for i in range(500)]
    path = f"file://{tmp_path}/tokens"
    write_token_orc(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), path, tokenizer=PATH, end_id=2, row_stride=1000)
    rows = read_token_orc(spark, path)
    assert sorted(tuple(r) for r in token_digests(rows).collect()) == plain(texts)
    files = spark.read.orc(path).groupBy("_metadata.file_name").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).orderBy("file_name").collect()
    assert len(files) > 1 and all(x.b < y.a for x, y in zip(files, files[1:], strict=False))
    some = read_token_orc(spark, path, F.col("doc_id").isin(30, 33, 31))
    assert sorted(r.doc_id for r in some.collect()) == [30, 33]
    assert "PushedFilters: [In(doc_id" in some._jdf.queryExecution().toString()
    want = dict((p[0], p[1]) for p in plain(texts))
    assert all(r.start == want[r.doc_id] for r in some.collect())


def test_footers_have_bloom_filters(spark, tmp_path):
    path = f"file://{tmp_path}/tokens"
    write_token_orc(spark.createDataFrame([(i, "a b") for i in range(3000)], "doc_id long, text string"), path, tokenizer=PATH, end_id=2)
    reader = spark._jvm.org.apache.orc.OrcFile
    conf = spark._jsc.hadoopConfiguration()
    one = next(p for p in tmp_path.joinpath("tokens").iterdir() if p.suffix == ".orc")
    footer = reader.createReader(spark._jvm.org.apache.hadoop.fs.Path(f"file://{one}"), reader.readerOptions(conf))
    stripe = footer.rows().readStripeFooter(footer.getStripes().get(0))
    kinds = [str(s.getKind()) for s in stripe.getStreamsList()]
    encodings = [str(c.getKind()) for c in stripe.getColumnsList()]  # the row, doc_id, file_start, n_tokens, tokens, one token
    assert encodings == ["DIRECT", *["DIRECT_V2"] * 5]  # integers in runs
    assert "BLOOM_FILTER_UTF8" in kinds and "ROW_INDEX" in kinds
    assert footer.getRowIndexStride() == 1000


@pytest.mark.parametrize("rows", [[], [(None, None, 1), (None, "x y", 1), (5, "", 1), (5, "b", 1), (5, "b", 1), (6, "a <|endoftext|> b", 1), (-4, "word " * 50_000, 1)]])
def test_odd_rows(spark, tmp_path, rows):
    path = f"file://{tmp_path}/tokens"
    write_token_orc(spark.createDataFrame(rows, "doc_id long, text string, start int"), path, tokenizer=PATH, end_id=2)
    got = token_digests(read_token_orc(spark, path)).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert sorted(r.n_tokens for r in got) == sorted(p[2] for p in plain([r[:2] for r in rows]))
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).astype(int).tolist()[: len(got)]


def test_memo_is_bounded_and_keeps_what_is_used():
    from plumbline.llm.tokens import ChunkEncoder

    enc, library, learned = ChunkEncoder(PATH, 2, True, 400), Tokenizer.from_file(PATH), []
    learn = enc._learn
    enc._learn = lambda chunks: (learned.extend(chunks), learn(chunks))
    for k in range(60):
        text = " often, " + " ".join("abcdefghij"[i % 10] * (1 + i // 10 % 3) + f"x{k}y{i}" for i in range(50))
        assert enc.encode([text]) == [np.array([*library.encode(text, add_special_tokens=False).ids, 2], dtype="<u4").tobytes()]
        assert len(enc.memo) + len(enc.earlier) <= 400 + 4 * 50
    assert learned.count("often,") == 1
