"""Harmonic packing of token ids into sequences of one capacity.

A document is cut into pieces whose lengths are the capacity divided by a whole number, the longest first, until a short
rest is left. A piece of class k (k of its kind fit a sequence) goes to the open bin of its class, and a bin closes with
exactly k pieces. Each task fills bins by itself from the rows that it scans: nothing is shuffled and no task waits for
another. When a task's rows end, the pieces of its bins that are still open are packed together by best fit.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import blocks, shared_encoder

SCHEMA = "doc_id long, start long, length long, token_ids binary, doc_tokens long, sequence_id long, offset long"
#: Nothing else here needs much memory, so more chunks are remembered.
MEMO_ENTRIES = 1_500_000
Piece = tuple  # (doc_id, start, length, ids, doc_tokens)


def cut_lengths(tokens: int, capacity: int, shortest_cut: int) -> list[int]:
    """Piece lengths of a document: each but the last is capacity // k for some k; a rest under shortest_cut stays whole.
    A rest is at most capacity // k of its own class k, so k of that class always fit."""
    out = [capacity] * (tokens // capacity)
    rest = tokens % capacity
    while rest >= shortest_cut:
        k = -(-capacity // rest)
        while capacity // k > rest:
            k += 1
        out.append(capacity // k)
        rest -= capacity // k
    return [*out, rest] if rest else out


class HarmonicPacker:
    """Bins of one task. add() and finish() yield (piece, sequence, offset) as soon as a bin is complete."""

    def __init__(self, capacity: int, first_sequence: int = 0) -> None:
        self.capacity, self.next = capacity, first_sequence
        self.open: dict[int, list[Piece]] = {}

    def _emit(self, pieces: list[Piece]) -> Iterator[tuple[Piece, int, int]]:
        sequence, offset = self.next, 0
        self.next += 1
        for piece in pieces:
            yield piece, sequence, offset
            offset += piece[2]

    def add(self, piece: Piece) -> Iterator[tuple[Piece, int, int]]:
        k = self.capacity // piece[2]
        if k == 1:
            yield from self._emit([piece])
            return
        own = self.open.setdefault(k, [])
        own.append(piece)
        if len(own) == k:
            del self.open[k]
            yield from self._emit(own)

    def finish(self) -> Iterator[tuple[Piece, int, int]]:
        """Best fit, longest first. The open bins hold fewer than k pieces of class k, whatever the input's size."""
        bins: list[list[Piece]] = []
        room: list[tuple[int, int]] = []  # (room left, bin)
        for piece in sorted((p for own in self.open.values() for p in own), key=lambda p: -p[2]):
            at = bisect_left(room, (piece[2], -1))
            if at == len(room):
                bins.append([])
                left, own = self.capacity, len(bins) - 1
            else:
                left, own = room.pop(at)
            bins[own].append(piece)
            insort(room, (left - piece[2], own))
        self.open = {}
        for own in bins:
            yield from self._emit(own)


def pack_documents(
    docs: DataFrame, *, tokenizer: str, end_id: int, capacity: int = 2048, shortest_cut: int = 64, spaces_matter: bool = False
) -> DataFrame:
    """Pieces of all `docs` (doc_id, text), each with its ids as little-endian unsigned 32-bit integers in token_ids.

    Columns: doc_id, start (its document's ids before it), length, token_ids, doc_tokens (with the end id), sequence_id,
    offset (its place in the sequence; offsets are gapless from 0). A null text counts as empty: one piece with the end
    id. Rows with null or repeated doc_ids are packed like any other. Other columns are ignored. An empty table gives
    no rows. A sequence holds at most `capacity` ids; sequence_ids are unique but not consecutive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = shared_encoder(tokenizer, end_id, spaces_matter, MEMO_ENTRIES)
        packer = HarmonicPacker(capacity, TaskContext.get().partitionId() << 33)
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            cols = zip(*[(*piece, sequence, offset) for piece, sequence, offset in rows], strict=True)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            names = [f.split()[0] for f in SCHEMA.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for source in batches:
            ids, texts = source.column(0).to_pylist(), source.column(1).to_pylist()
            for part in blocks(texts, 8_000_000):
                for doc_id, tokens in zip(ids[part], encoder.encode(texts[part]), strict=True):
                    start, total = 0, len(tokens) // 4
                    for length in cut_lengths(total, capacity, shortest_cut):
                        piece = (doc_id, start, length, tokens[4 * start : 4 * (start + length)], total)
                        rows.extend(packer.add(piece))
                        start += length
                    size += len(tokens)
                if size > 4_000_000 and rows:
                    yield batch()
                    rows, size = [], 0
        rows.extend(packer.finish())
        if rows:
            yield batch()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def piece_digests(pieces: DataFrame) -> DataFrame:
    """`pieces` of pack_documents() with the unsigned crc32 of their ids instead of the ids; doc_ids, null or repeated,
    stay as they are, other columns are dropped, and no pieces give no rows."""
    return pieces.select("doc_id", "start", "length", F.crc32("token_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
