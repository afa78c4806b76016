import zlib

import numpy as np

from plumbline.llm.noisy_or import BUCKETS, MEMO_CHARS, NoisyOr, drop_toxic, fit, gradients, offending_sentences, score_toxicity, sentences, train, word_features
from plumbline.llm.queries import QUERIES


def test_sentences_hold_every_word():
    text = "One two. Three!\n\nfour " + "x " * 100 + "? End"
    found = sentences(text)
    assert [w for s in found for w in s] == ["one", "two", "three", "four", *["x"] * 100, "end"]
    assert [len(s) for s in found] == [2, 1, 101, 1]  # a long sentence is judged like any other
    assert sentences(None) == sentences(" ..!") == []


def test_score_is_the_noisy_or():
    rng = np.random.default_rng(0)
    model = NoisyOr(rng.normal(size=BUCKETS), -1.0)
    text = "a bb ccc. dddddd eeeeeeee a a! f"
    p = [1 / (1 + np.exp(-(model.bias + sum(model.weights[word_features(w)].sum() for w in set(s))))) for s in sentences(text)]
    assert np.isclose(model.score(text), 1 - np.prod(1 - np.array(p)))
    assert model.score("") == model.score(None) == 0


def test_gradients_are_differences_of_the_loss():
    rng = np.random.default_rng(2)
    sizes, counts, labels = np.array([3, 1, 4, 2, 2]), np.array([2, 1, 2]), np.array([1.0, 0.0, 1.0])
    features = rng.integers(0, 9, sizes.sum())

    def loss(model):
        z = [model.bias + sum(model.weights[f] for f in part) for part in np.split(features, np.cumsum(sizes)[:-1])]
        none = [np.prod([1 / (1 + np.exp(x)) for x in part]) for part in np.split(np.array(z), np.cumsum(counts)[:-1])]
        return -np.mean([np.log(1 - q) if y else np.log(q) for q, y in zip(none, labels, strict=True)])

    model = NoisyOr(np.zeros(BUCKETS), -0.5)
    model.weights[:9] = rng.normal(size=9)
    touched, gradient, down = gradients(model, features, sizes, counts, labels)
    assert set(touched) == set(features)
    for f, g in zip(touched, gradient, strict=True):
        a, b = NoisyOr(model.weights.copy(), model.bias), NoisyOr(model.weights.copy(), model.bias)
        a.weights[f] += 1e-5
        b.weights[f] -= 1e-5
        assert np.isclose((loss(a) - loss(b)) / 2e-5, g, rtol=1e-4, atol=1e-8)
    assert np.isclose((loss(NoisyOr(model.weights, -0.5 + 1e-5)) - loss(NoisyOr(model.weights, -0.5 - 1e-5))) / 2e-5, down.sum(), rtol=1e-4)


def test_query_is_the_model_on_each_text(spark):
    """The query's rows and those that drop_toxic keeps, against the noisy-or worked out plainly."""
    at = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet")
    model = fit(docs, labels)

    def plain(text):
        none = 1.0
        for words in sentences(text):
            none *= 1 - 1 / (1 + np.exp(-(model.bias + sum(model.weights[word_features(w)].sum() for w in set(words)))))
        return 1 - none

    want = {r.doc_id: plain(r.text) for r in docs.collect()}
    got = {r.doc_id: r for r in QUERIES["op6_noisy_or"](spark, at).collect()}
    assert got.keys() == want.keys() and all(abs(got[i].score - want[i]) < 1e-6 for i in want)
    assert {r.doc_id for r in drop_toxic(docs, model, 0.5).collect()} == {i for i, p in want.items() if p < 0.5}


def test_memo_forgets_long_words():
    model = NoisyOr(np.ones(BUCKETS), 0.0)
    model.score("x" * 100_000 + " y")
    assert set(model.memo) == {"y"} and MEMO_CHARS < 100


def test_learns_words_from_document_labels_and_finds_the_sentence(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    rows = []
    for i in range(600):
        lines = [" ".join(rng.choice(words, 8)) for _ in range(6)]
        if i % 3 == 0:
            lines[int(rng.integers(6))] += " vilex" + "".join(rng.choice(list("abcdefgh"), 3))
        rows.append((i, ". ".join(lines), int(i % 3 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    got = {r.doc_id: r for r in score_toxicity(docs, model).collect()}
    held = [i for i in got if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert np.mean([(got[i].score >= 0.5) == (i % 3 == 0) for i in held]) > 0.95
    found = offending_sentences(docs, model).collect()
    assert found and np.mean(["vilex" in r.sentence for r in found]) > 0.95
    texts = {i: t for i, t, _ in rows}
    assert all(texts[r.doc_id][r.begin : r.end] == r.sentence for r in found)


def test_odd_rows(spark):
    model = NoisyOr(np.zeros(BUCKETS), -3.0)
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "a. " * 100_000, 0), (1, "a", 0)], "doc_id long, text string, score int")
    assert sorted(r.score > 0 for r in score_toxicity(docs, model).collect()) == [False, False, True, True]
    assert drop_toxic(docs, model, 0.5).columns == docs.columns and drop_toxic(docs, model, 0.5).count() == 3
    assert score_toxicity(docs.limit(0), model).count() == 0
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert fit(docs, labels).score("a b c") < 1e-6
    odd = spark.createDataFrame([(1, 1), (2, 0), (1, 0), (None, 1), (3, None)], "doc_id long, toxic int")
    assert fit(docs, odd).bias < 0 and fit(docs.limit(0), odd).score("a") < 1e-6
    mixed = spark.createDataFrame([(None, None, "a"), (None, None, "b"), (5, "x. " * 30_000, "c")], "doc_id long, text string, `label.score` string")
    assert drop_toxic(mixed, model, 0.5).columns == mixed.columns and drop_toxic(mixed, model, 0.5).count() == 2
    assert offending_sentences(mixed, model).count() == 0
    empty = np.array([], dtype=np.int64)
    assert train(empty, empty, empty, np.array([])).bias == -5.0


def test_query_on_the_held_out_fold(spark):
    at = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in QUERIES["op6_noisy_or"](spark, at).collect()}
    assert len(got) == 10_000 and all(r.predicted == (r.score >= 0.5) for r in got.values())
    held = [(r.toxic, got[r.doc_id].predicted) for r in spark.read.parquet(f"{at}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.95
    assert np.mean([p for t, p in held if t == 0]) < 0.01
    assert np.mean([p for t, p in held if t == 1]) > 0.75
