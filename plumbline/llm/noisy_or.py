"""Toxicity by multiple-instance learning: sentences get scores, documents have labels.

A document is toxic if any of its sentences is: its probability is the noisy-or of its sentences' probabilities. Only
documents are labelled, so the gradient of the document's likelihood is shared among its sentences by what each adds.
Sentence features are hashed words and beginnings of words; a penalty on absolute weights leaves few of them.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, rows_by_text, training_sample
from .storage import drop

BUCKETS = 1 << 18
#: Beginnings of these lengths count besides the word itself.
BEGINNINGS = (4, 5, 6)
#: A sentence ends at these.
ENDS = re.compile(r"[.!?\n]+")
WORDS = re.compile(r"\w+")
#: A worker remembers the weights of so many words of at most so many letters.
MEMO_ENTRIES, MEMO_CHARS = 600_000, 64


def word_features(word: str) -> list[int]:
    """Buckets of a word in lower case."""
    parts = [word, *[f"{word[:n]}*" for n in BEGINNINGS if len(word) > n]]
    return [zlib.crc32(p.encode("utf-8", "surrogatepass")) % BUCKETS for p in parts]


def sentences(text: str | None) -> list[list[str]]:
    """The words of each sentence, in lower case; every word of the text is in one. No words: no sentences."""
    return [words for part in ENDS.split((text or "").lower()) if (words := WORDS.findall(part))]


@dataclass
class NoisyOr:
    """A sentence's logit is bias plus the weights of its distinct words' features."""

    weights: np.ndarray
    bias: float
    memo: dict[str, float] = field(default_factory=dict)

    def logits(self, found: list[list[str]]) -> np.ndarray:
        memo = self.memo
        if len(memo) > MEMO_ENTRIES:
            memo.clear()
        out = np.empty(len(found))
        for i, words in enumerate(found):
            total = self.bias
            for word in set(words):
                one = memo.get(word)
                if one is None:
                    one = float(self.weights[word_features(word)].sum())
                    if len(word) <= MEMO_CHARS:
                        memo[word] = one
                total += one
            out[i] = total
        return out

    def score(self, text: str | None) -> float:
        """The noisy-or of the sentences, 0 without any."""
        logits = self.logits(sentences(text))
        return float(-np.expm1(-np.logaddexp(0, logits).sum())) if len(logits) else 0.0


def gradients(
    model: NoisyOr, features: np.ndarray, sizes: np.ndarray, counts: np.ndarray, labels: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the documents' mean negative log-likelihood: (weights that it changes, their gradients, each sentence's share of
    the bias). features: buckets of all sentences one after another, sizes of them in each sentence, counts of sentences in
    each document."""
    begin = np.cumsum(sizes) - sizes
    z = model.bias + np.add.reduceat(model.weights[features], begin)
    total = np.add.reduceat(np.logaddexp(0, z), np.cumsum(counts) - counts)
    # by a document's sum of softplus, then by each sentence's logit
    outer = np.where(labels > 0, -1 / np.maximum(np.expm1(np.minimum(total, 50)), 1e-4), 1.0) / len(labels)
    down = np.repeat(outer, counts) / (1 + np.exp(-z))
    gradient = np.bincount(features, weights=np.repeat(down, sizes), minlength=BUCKETS)
    touched = np.flatnonzero(gradient)
    return touched, gradient[touched], down


def train(
    features: np.ndarray, sentence_starts: np.ndarray, doc_starts: np.ndarray, labels: np.ndarray, *, epochs: int = 40,
    batch: int = 64, rate: float = 0.4, penalty: float = 2e-4, seed: int = 5,
) -> NoisyOr:
    """features: buckets of all sentences one after another; sentence_starts: where each sentence's begin; doc_starts:
    the first sentence of each document. Steps by AdaGrad on the documents' likelihood, each followed by shrinking the
    weights by the penalty. Without documents nothing is toxic; with one label only the bias moves."""
    model = NoisyOr(np.zeros(BUCKETS), -5.0)
    square, bias_square = np.full(BUCKETS, 1e-6), 1e-6
    ends, doc_ends = np.append(sentence_starts[1:], len(features)), np.append(doc_starts[1:], len(sentence_starts))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), batch):
            own = order[i : i + batch]
            lines = np.concatenate([np.arange(doc_starts[d], doc_ends[d]) for d in own])
            index = np.concatenate([features[sentence_starts[doc_starts[d]] : ends[doc_ends[d] - 1]] for d in own])
            touched, gradient, down = gradients(model, index, ends[lines] - sentence_starts[lines], doc_ends[own] - doc_starts[own], labels[own])
            square[touched] += gradient * gradient
            step = rate / np.sqrt(square[touched])
            moved = model.weights[touched] - step * gradient
            model.weights[touched] = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
            g = down.sum()
            bias_square += g * g
            model.bias = float(model.bias - rate * g / np.sqrt(bias_square))
    return model


def fit(docs: DataFrame, labels: DataFrame, *, most: int = 10_000, most_chars: int = 48_000_000) -> NoisyOr:
    """Learn `labels.toxic` from whole texts of at most `most` documents that aren't held out, as training_sample()
    chooses them: one text for each id, null ids and other columns take no part. Texts without words teach nothing; with
    nothing to learn from, no text is toxic. The executors send buckets of features, about 2.5 bytes for a character, so
    most and most_chars bound what the driver receives."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, values, found, lengths = [], [], [], []
            for doc_id, label, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = [sorted({b for w in set(words) for b in word_features(w)}) for words in sentences(text)]
                if own:
                    ids.append(doc_id)
                    values.append(label)
                    found.append(np.concatenate(own).astype("<i4").tobytes())
                    lengths.append(np.array([len(x) for x in own], dtype="<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, type=pa.int64()), pa.array(values, type=pa.int32()), pa.array(found, type=pa.binary()), pa.array(lengths, type=pa.binary())],
                names=["doc_id", "label", "features", "lengths"],
            )

    sample = training_sample(docs, labels, "toxic", most, most_chars)
    rows = sample.mapInArrow(pick, "doc_id long, label int, features binary, lengths binary").toArrow().sort_by([("doc_id", "ascending"), ("features", "ascending")])
    drop(sample)
    if not rows.num_rows:
        return NoisyOr(np.zeros(BUCKETS), -20.0)
    features = np.concatenate([np.frombuffer(x.as_py(), dtype="<i4") for x in rows.column("features")])
    lengths = [np.frombuffer(x.as_py(), dtype="<i4") for x in rows.column("lengths")]
    sizes, counts = np.concatenate(lengths).astype(np.int64), np.array([len(x) for x in lengths])
    return train(features, np.cumsum(sizes) - sizes, np.cumsum(counts) - counts, rows.column("label").to_numpy().astype(np.float64))


def score_toxicity(docs: DataFrame, model: NoisyOr) -> DataFrame:
    """(doc_id, held_out, score) of each row of `docs` (doc_id, text): the probability that it is toxic, from all its
    sentences. A text without words, null or empty, has score 0; a null doc_id is not held out. Other columns are
    ignored; an empty table gives no rows."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [known.value.score(text.as_py()) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, type=pa.float64())], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"), held_out().alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double")


def offending_sentences(docs: DataFrame, model: NoisyOr, threshold: float = 0.5) -> DataFrame:
    """(doc_id, begin, end, sentence, score) of every sentence whose own probability is `threshold` or more; begin and
    end are code points of the text. Null and empty texts have none; a doc_id, null or repeated, is passed on as it is; other
    columns are ignored; an empty table gives no rows."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    whole = re.compile(r"[^.!?\n]+")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for m in whole.finditer(text or ""):
                    logits = known.value.logits(sentences(m[0]))
                    score = float(1 / (1 + np.exp(-logits[0]))) if len(logits) else 0.0
                    if score >= threshold:
                        out.append((doc_id, m.start(), m.end(), m[0], score))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "begin", "end", "sentence", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, begin long, end long, sentence string, score double")


def drop_toxic(docs: DataFrame, model: NoisyOr, threshold: float) -> DataFrame:
    """The rows of `docs` with a score below `threshold`, with all their columns, whatever these are called. Every row
    is judged by its own text, so null and repeated doc_ids don't matter; texts without words, null ones too, have score
    0. An empty table gives no rows."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    return rows_by_text(docs, lambda texts: np.array([known.value.score(text.as_py()) < threshold for text in texts]))
