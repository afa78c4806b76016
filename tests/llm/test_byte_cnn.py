import zlib

import numpy as np
import pytest

from plumbline.llm import byte_cnn
from plumbline.llm.byte_cnn import CHUNK, FILTERS, WIDTH, ByteCnn, chunks, fit, gradients, keep_good, score_quality, train
from plumbline.llm.labelled import training_sample
from plumbline.llm.queries import QUERIES


@pytest.mark.parametrize("n", [0, 1, 4, 5, 255, 256, 259, 260, 261, 512, 516, 5000])
def test_chunks_hold_every_window_once(n):
    data = bytes(1 + i % 250 for i in range(n))
    rows = chunks(data.decode("latin-1") if n < 128 else "".join(map(chr, (1 + i % 126 for i in range(n)))))
    starts = np.arange(len(rows))[:, None] * CHUNK + np.arange(CHUNK)[None, :]
    assert starts.ravel().tolist() == list(range(len(rows) * CHUNK))
    assert len(rows) == max(1, -(-(n - WIDTH + 1) // CHUNK))


def test_pooling_is_the_plain_convolution():
    net, text = ByteCnn.new(), "some text, é and more of it " * 40
    data = text.encode() + bytes(2 * CHUNK)
    got = net.pooled(chunks(text))
    for i, row in enumerate(got):
        plain = [sum(net.filters[j, data[i * CHUNK + t + j]] for j in range(WIDTH)) for t in range(CHUNK)]
        np.testing.assert_allclose(row, np.max(plain, axis=0), rtol=1e-4, atol=1e-4)
    assert got.shape[1] == FILTERS


def test_gradients_descend_to_a_separable_rule():
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("abc xyz"), 300)) + ("!!" * 40 if i % 2 else "") for i in range(200)]
    net = train([np.array(chunks(t)) for t in texts], np.array([i % 2 == 0 for i in range(200)], dtype=float), steps=150)
    new = ["".join(rng.choice(list("abc xyz"), 900)) + ("!!" * 40 if i % 2 else "") for i in range(40)]
    pooled = [net.pooled(chunks(t)) for t in new]
    counts = np.array([len(p) for p in pooled])
    score = net.probabilities(np.concatenate(pooled), np.cumsum(counts) - counts)
    assert ((score >= 0.5) == [i % 2 == 0 for i in range(40)]).mean() >= 0.95


def plain_probability(net, text):
    """The network worked out place by place."""
    data = (text or "").encode()
    n = max(1, -(-(len(data) - WIDTH + 1) // CHUNK))
    data, scores = data + bytes(n * CHUNK + WIDTH), []
    for i in range(n):
        tops = np.max([sum(net.filters[j, data[i * CHUNK + t + j]] for j in range(WIDTH)) for t in range(CHUNK)], axis=0)
        scores.append(np.tanh(np.tanh(tops + net.bias) @ net.inner + net.inner_bias) @ net.outer)
    return 1 / (1 + np.exp(-(net.mix[0] * np.mean(scores) + net.mix[1] * np.max(scores) + net.mix[2])))


def test_gradients_are_differences_of_the_loss():
    net = ByteCnn.new()
    net.mix[:] = [0.8, 0.5, -0.1]
    for name in ("filters", "bias", "inner", "inner_bias", "outer", "mix"):
        setattr(net, name, getattr(net, name).astype(np.float64))
    texts, labels = ["some text of words " * 30, "other", "x" * 300 + "é"], np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean([np.log(p if y else 1 - p) for p, y in zip((plain_probability(net, t) for t in texts), labels, strict=True)])
    found, rng = gradients(net, [chunks(t) for t in texts], labels), np.random.default_rng(1)
    for p, g in zip(net.parameters(), found, strict=True):
        some = np.argsort(-np.abs(g).ravel())[:2].tolist() + rng.integers(0, g.size, 1).tolist()
        for k in some:
            at, kept = np.unravel_index(k, g.shape), p.ravel()[k]
            p[at] = kept + 1e-6
            up = loss()
            p[at] = kept - 1e-6
            down = loss()
            p[at] = kept
            assert np.isclose((up - down) / 2e-6, g[at], rtol=1e-3, atol=1e-7)


def test_query_is_the_network_on_each_text(spark):
    """The query's rows and those that keep_good keeps, against the network worked out plainly."""
    at = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    net, got = fit(docs, labels), {r.doc_id: r for r in QUERIES["op8_byte_cnn"](spark, at).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert got.keys() == texts.keys()
    some = sorted(texts, key=lambda i: len(texts[i] or ""))[:60]
    for i in some:
        assert abs(got[i].score - plain_probability(net, texts[i])) < 1e-4
    assert {r.doc_id for r in keep_good(docs, net, 0.3).collect()} == {i for i, r in got.items() if r.score >= 0.3}


def test_keep_good_with_odd_rows(spark):
    rows = [(None, None, 1.0), (1, "", 1.0), (1, "abc " * 40_000, 1.0), (1, "abc", 1.0), (1, "abc", 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `score.held_out` double")
    net = ByteCnn.new()
    assert sorted(map(str, keep_good(docs, net, 0.0).collect())) == sorted(map(str, docs.collect()))
    assert keep_good(docs, net, 1.1).count() == 0 and keep_good(docs, net, 0.0).columns == docs.columns


def test_one_class_or_no_rows():
    assert train([], np.array([])).mix.tolist() == [0, 0, 0]
    assert train([np.array(chunks("a"))], np.array([1.0])).mix.tolist() == [0, 0, 6]


def test_query_on_the_held_out_fold(spark):
    at = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op8_byte_cnn"](spark, at).collect()}
    labels = spark.read.parquet(f"{at}/labels.parquet").collect()
    assert len(got) == 10_000
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) for i, r in got.items())
    held = [(r.quality, got[r.doc_id].predicted) for r in labels if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.97
    assert np.mean([p for q, p in held if q == 1]) > 0.98


def test_scores_need_only_the_text(spark):
    docs = spark.createDataFrame([(1, None, "x"), (2, "", "y"), (None, "abc " * 50_000, "z"), (1, None, "x")], "doc_id long, text string, score string")
    rows = score_quality(docs, ByteCnn.new()).collect()
    assert len(rows) == 4 and all(0 <= r.score <= 1 for r in rows)
    assert score_quality(docs.limit(0), ByteCnn.new()).count() == 0


def test_sample_is_bounded_and_leaves_the_fold_out(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)] + [(None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)] + [(1, 0), (4, None), (None, 1), (5, 7)], "doc_id long, quality int")
    rows = training_sample(docs, labels, "quality", 50).collect()
    assert len(rows) == 50 and all(zlib.crc32(str(r.doc_id).encode()) % 5 for r in rows)
    assert byte_cnn.fit(docs, labels.limit(0)).mix.tolist() == [0, 0, 0]
    assert byte_cnn.fit(docs.limit(0), labels).mix.tolist() == [0, 0, 0]


def test_sample_has_one_whole_text_for_an_id(spark):
    rows = [(1, f"t{i}") for i in range(500)] + [(2, None), (3, "long " * 50_000)]
    docs = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, label int")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1)], "doc_id int, quality int")
    got = {r.doc_id: r.text for r in training_sample(docs, labels, "quality", 3).collect()}
    assert len(got) == 3 and got[2] == "" and got[3] == "long " * 50_000 and (1, got[1]) in rows
    assert training_sample(docs, labels, "quality", 3).count() == 3
    assert training_sample(docs, labels, "quality", 3, most_chars=1).count() in (1, 2)  # up to the first text that isn't empty
