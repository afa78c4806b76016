"""Document quality by a byte-level convolutional network in numpy.

Learned filters slide over all bytes of a document. The bytes are covered by chunks that overlap by a filter's width less
one, so no window is missed; each filter's greatest answer in a chunk is kept. A small layer turns a chunk's answers into
a score, and the mean and the greatest chunk score make the document's probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, rows_by_text, training_sample
from .storage import drop

WIDTH, FILTERS, HIDDEN, CHUNK = 5, 24, 16, 256
#: Bytes that a chunk spans: CHUNK places for a filter to begin at.
SPAN = CHUNK + WIDTH - 1


def chunks(text: str | None) -> np.ndarray:
    """All chunks of a text as rows of bytes; the last is filled up with zeros. An empty text has one."""
    data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)
    places = max(1, len(data) - WIDTH + 1)
    n = -(-places // CHUNK)
    padded = np.zeros((n - 1) * CHUNK + SPAN, dtype=np.uint8)
    padded[: len(data)] = data
    return np.lib.stride_tricks.as_strided(padded, (n, SPAN), (CHUNK, 1))


@dataclass
class ByteCnn:
    """filters[j, byte, f] is what filter f adds for a byte at place j of its window."""

    filters: np.ndarray
    bias: np.ndarray
    inner: np.ndarray
    inner_bias: np.ndarray
    outer: np.ndarray
    mix: np.ndarray  # of the mean chunk score, of the greatest, and a constant

    @staticmethod
    def new(seed: int = 3) -> ByteCnn:
        rng = np.random.default_rng(seed)
        return ByteCnn(
            (rng.normal(size=(WIDTH, 256, FILTERS)) * 0.25).astype(np.float32), np.zeros(FILTERS, dtype=np.float32),
            (rng.normal(size=(FILTERS, HIDDEN)) / np.sqrt(FILTERS)).astype(np.float32), np.zeros(HIDDEN, dtype=np.float32),
            (rng.normal(size=HIDDEN) / np.sqrt(HIDDEN)).astype(np.float32), np.array([1.0, 0.0, 0.0], dtype=np.float32),
        )

    def parameters(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.inner, self.inner_bias, self.outer, self.mix]

    def answers(self, rows: np.ndarray) -> np.ndarray:
        """The filters' answers at each place of each chunk: (chunks, CHUNK, FILTERS)."""
        out = np.take(self.filters[0], rows[:, :CHUNK], axis=0)
        for j in range(1, WIDTH):
            out += np.take(self.filters[j], rows[:, j : j + CHUNK], axis=0)
        return out

    def pooled(self, rows: np.ndarray, step: int = 24) -> np.ndarray:
        """Each filter's greatest answer in each chunk; a few chunks are worked on at a time."""
        out = np.empty((len(rows), FILTERS), dtype=self.filters.dtype)
        for i in range(0, len(rows), step):
            out[i : i + step] = self.answers(rows[i : i + step]).max(axis=1)
        return out

    def places(self, rows: np.ndarray, step: int = 24) -> tuple[np.ndarray, np.ndarray]:
        """pooled(), and where in its chunk each of them is (the first of equals)."""
        out, at = np.empty((len(rows), FILTERS), dtype=self.filters.dtype), np.empty((len(rows), FILTERS), dtype=np.int64)
        for i in range(0, len(rows), step):
            found = self.answers(rows[i : i + step])
            at[i : i + step] = best = found.argmax(axis=1)
            out[i : i + step] = np.take_along_axis(found, best[:, None, :], axis=1)[:, 0, :]
        return out, at

    def chunk_scores(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first = np.tanh(pooled + self.bias)
        hidden = np.tanh(first @ self.inner + self.inner_bias)
        return first, hidden, hidden @ self.outer

    def probabilities(self, pooled: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """starts: the first chunk of each document."""
        scores = self.chunk_scores(pooled)[2].astype(np.float64)
        counts = np.diff(np.append(starts, len(scores)))
        mean, most = np.add.reduceat(scores, starts) / counts, np.maximum.reduceat(scores, starts)
        return 1 / (1 + np.exp(-(self.mix[0] * mean + self.mix[1] * most + self.mix[2])))

    def score(self, texts: pa.Array) -> np.ndarray:
        """The probabilities of texts, one at least."""
        pooled = [self.pooled(chunks(text.as_py())) for text in texts]
        counts = np.array([len(own) for own in pooled])
        return self.probabilities(np.concatenate(pooled), np.cumsum(counts) - counts)


def gradients(net: ByteCnn, docs: list[np.ndarray], labels: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy of whole documents (docs: all chunks of each) by each of net.parameters(). A filter
    learns from the place of its greatest answer in each chunk."""
    rows = np.concatenate(docs)
    counts = np.array([len(own) for own in docs])
    starts = np.cumsum(counts) - counts
    pooled, at = net.places(rows)
    one, two, scores = net.chunk_scores(pooled)
    mean, most = np.add.reduceat(scores, starts) / counts, np.maximum.reduceat(scores, starts)
    p = 1 / (1 + np.exp(-(net.mix[0] * mean + net.mix[1] * most + net.mix[2])))
    error = (p - labels) / len(docs)
    doc = np.repeat(np.arange(len(docs)), counts)
    down = error[doc] * (net.mix[0] / counts[doc] + net.mix[1] * (scores == most[doc]))
    d_two = down[:, None] * net.outer[None, :] * (1 - two * two)
    d_one = (d_two @ net.inner.T) * (1 - one * one)
    d_filters = np.zeros(net.filters.shape)
    which = np.arange(FILTERS)[None, :]
    for j in range(WIDTH):
        index = rows[np.arange(len(rows))[:, None], at + j].astype(np.int64) * FILTERS + which
        d_filters[j] = np.bincount(index.ravel(), weights=d_one.ravel(), minlength=256 * FILTERS).reshape(256, FILTERS)
    return [d_filters, d_one.sum(axis=0), one.T @ d_two, d_two.sum(axis=0), two.T @ down, np.array([error @ mean, error @ most, error.sum()])]


def train(docs: list[np.ndarray], labels: np.ndarray, *, steps: int = 2000, batch: int = 32, rate: float = 0.004, seed: int = 3) -> ByteCnn:
    """docs: all chunks of each document. Adam on the documents' cross-entropy. Without documents every score is a half,
    with one label only it is near that label."""
    net = ByteCnn.new(seed)
    if not len(docs) or len(set(labels.tolist())) < 2:
        net.outer[:] = 0
        net.mix[:] = [0, 0, 0 if not len(docs) else (6 if labels[0] else -6)]
        return net
    rng, params = np.random.default_rng(seed), net.parameters()
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    order = np.array([], dtype=np.int64)
    for step in range(1, steps + 1):
        if len(order) < batch:
            order = np.concatenate([order, rng.permutation(len(docs))])
        own, order = order[:batch], order[batch:]
        now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
        for x, g, m, v in zip(params, gradients(net, [docs[i] for i in own], labels[own]), first, second, strict=True):
            m += (0.1 * (g - m)).astype(np.float32)
            v += (0.01 * (g * g - v)).astype(np.float32)
            x -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def fit(docs: DataFrame, labels: DataFrame, *, most: int = 8000, most_chars: int = 48_000_000) -> ByteCnn:
    """Learn `labels.quality` from whole texts of at most `most` documents that aren't held out, as training_sample()
    chooses them: one text for each id, null texts are empty and have one chunk, null ids and other columns take no part,
    and no documents or labels give a score of a half. most and most_chars bound what the driver receives."""
    sample = training_sample(docs, labels, "quality", most, most_chars)
    rows = sample.toArrow().sort_by("doc_id")
    drop(sample)
    own = [chunks(text.as_py()) for text in rows.column("text")]
    return train(own, rows.column("label").to_numpy().astype(np.float64))


def score_quality(docs: DataFrame, net: ByteCnn) -> DataFrame:
    """(doc_id, held_out, score) of each row of `docs` (doc_id, text): the probability that a document is good, from all
    its bytes. Null texts count as empty and have a score too; a null doc_id is not held out. Other columns are ignored;
    an empty table gives no rows."""
    known = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = known.value
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(net.score(batch.column(1)))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string"), held_out().alias("held_out"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double")


def keep_good(docs: DataFrame, net: ByteCnn, threshold: float) -> DataFrame:
    """The rows of `docs` with a score of `threshold` or more, with all their columns, whatever these are called. Every
    row is judged by its own text, so null and repeated doc_ids don't matter; a null text counts as empty. An empty table
    gives no rows."""
    known = docs.sparkSession.sparkContext.broadcast(net)
    return rows_by_text(docs, lambda texts: known.value.score(texts) >= threshold)
