"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three machines are compiled from a model and composed with each input:

* the normaliser, which rewrites the longest rule that begins at a character (else copies it), puts a dummy space in
  front, writes spaces as U+2581 and, where the model asks for it, drops spaces that are too many;
* the pieces, a prefix tree whose final states emit an id;
* the byte fallback, which emits the ids of a character's bytes where no piece has it.

The encoding is the shortest path in the tropical semiring: weights add up along a path (plus), and of the paths to a
state the least stays (min). In a unigram model an arc weighs what its piece's score says. In a byte-pair encoding the
best sum of scores isn't the encoding, so there a state also remembers the last piece, and an arc weighs 0 if the two
pieces stay apart when they are merged as one string, and infinity otherwise: a row of pieces is the encoding exactly if
all its neighbours stay apart. As prefixes of an encoding are encodings, one state of finite weight is left at each place.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import pairwise
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import ChunkMemo, blocks

SPACE = "▁"
SPACE_BYTES = SPACE.encode()
#: A worker remembers so many units, and so many weights of pairs.
UNITS_MOST, PAIRS_MOST = 1_500_000, 2_000_000
#: Bytes that are looked at together.
STRETCH = 1 << 18
INFINITY = float("inf")
UNIGRAM, BPE = 1, 2
#: What the library puts on a character that no piece has, and on pieces that the user has defined.
UNKNOWN_PENALTY, USER_BONUS = 10.0, 0.1


def charsmap_rules(blob: bytes) -> dict[str, str]:
    """The rewriting rules in a model's compiled character map: a double array of byte strings whose values are places in
    a list of null-ended strings."""
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units, texts = np.frombuffer(blob, dtype="<u4", count=size // 4, offset=4).tolist(), blob[4 + size :]
    out: dict[str, str] = {}

    def walk(node: int, so_far: bytes) -> None:
        unit = units[node]
        base = node ^ ((unit >> 10) << ((unit & 1 << 9) >> 6))
        if unit >> 8 & 1:  # a leaf hangs here
            at = units[base] & 0x7FFFFFFF
            out[so_far.decode()] = texts[at : texts.index(b"\0", at)].decode()
        for label in range(1, 256):
            child = base ^ label
            if child < len(units) and units[child] & 0x800000FF == label:
                walk(child, so_far + bytes([label]))

    walk(0, b"")
    return out


class Normaliser:
    """The first machine: text in, text with U+2581 for spaces out."""

    def __init__(self, rules: dict[str, str], dummy_prefix: bool, single_spaces: bool, escape: bool) -> None:
        self.rules, self.dummy_prefix, self.single_spaces = rules, dummy_prefix, single_spaces
        self.space = SPACE if escape else " "
        first = sorted(rules, key=len, reverse=True)  # the longest rule that begins at a place is taken
        self.arcs = re.compile("|".join(map(re.escape, first))) if rules else None

    def __call__(self, text: str) -> str:
        if self.arcs is not None:
            text = self.arcs.sub(lambda m: self.rules[m[0]], text)
        if self.single_spaces:
            text = re.sub(" +", " ", text).strip(" ")
        if not text:
            return ""
        return (self.space if self.dummy_prefix else "") + text.replace(" ", self.space)


class PieceTransducer(ChunkMemo):
    """The machines of the model file at `path`, a unigram model or a byte-pair encoding."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto.FromString(Path(path).read_bytes())
        kinds, spec, trainer = sentencepiece_model_pb2.ModelProto.SentencePiece, model.normalizer_spec, model.trainer_spec
        if trainer.model_type not in (UNIGRAM, BPE) or trainer.treat_whitespace_as_suffix:
            raise ValueError("only unigram models and byte-pair encodings whose spaces come first are supported")
        self.unigram = trainer.model_type == UNIGRAM
        self.normalise = Normaliser(charsmap_rules(spec.precompiled_charsmap), spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces)
        self.text, self.cost, surface = {}, {}, [b""] * len(model.pieces)
        self.byte_piece = [0] * 256
        self.unknown, self.user = 0, set()
        scores = [p.score for p in model.pieces if p.type == kinds.NORMAL] or [0.0]
        for i, p in enumerate(model.pieces):
            if p.type == kinds.BYTE:
                self.byte_piece[int(p.piece[3:5], 16)] = i
                surface[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == kinds.UNKNOWN:
                self.unknown, surface[i] = i, (trainer.unk_surface if trainer.HasField("unk_surface") else " ⁇ ").encode()
            elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                self.text[p.piece], self.cost[p.piece] = i, -p.score
                surface[i] = p.piece.replace(SPACE, " ").encode()
                if p.type == kinds.USER_DEFINED:
                    self.user.add(p.piece)
                    self.cost[p.piece] = USER_BONUS - len(p.piece) * max(scores)
        self.bytes = pa.array(surface, pa.large_binary())
        self.fallback = trainer.byte_fallback
        if self.user and not self.unigram or any(SPACE in p.lstrip(SPACE) for p in self.text):
            raise ValueError("pieces with a space inside, and pieces of a user in a byte-pair encoding, are not supported")
        self.unknown_cost = UNKNOWN_PENALTY - min(scores)
        #: Little-endian ids of each piece, and of characters that the byte fallback has met.
        self.packed = {p: i.to_bytes(4, "little") for p, i in self.text.items()}
        #: Beginnings of pieces: the states of the piece machine, and whether each is final. A character alone always is:
        #: the byte fallback takes it if no piece does.
        self.states = {p[:n]: n == 1 for p in self.text for n in range(1, len(p) + 1)}
        self.states.update(dict.fromkeys(self.text, True))
        #: The longest piece that begins with one or two characters.
        self.reach: dict[str, int] = {}
        for p in sorted(self.text, key=len):
            self.reach[p[:2]] = len(p)
        self.path = self.shortest_path if self.unigram else self.first_path
        super().__init__(UNITS_MOST)
        self.apart = self._apart()
        self.arcs: dict[str, dict[str, float]] = {}
        self.pairs = 0

    def _apart(self) -> np.ndarray:
        """For two bytes, the first times 256 plus the second: whether texts are cut between them. No piece has a character
        that ends with the first before one that begins with the second, so no arc and no merge goes across, and paths of
        the two sides don't depend on each other. Without the byte fallback neighbours can be one unknown, so none are."""
        out = np.zeros((256, 256), dtype=bool)
        if self.fallback:
            out[:, [b for b in range(256) if not 0x80 <= b < 0xC0]] = True
        for piece in self.text:
            for a, b in pairwise(piece):
                out[a.encode()[-1], b.encode()[0]] = False
        return out.ravel()

    def merged(self, text: str) -> list[str]:
        """Byte-pair merges of a short string, the best-ranked pair first, of equals the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            ranks = [self.cost.get(a + b, INFINITY) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == INFINITY:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def weight(self, last: str, piece: str) -> float:
        """Of the arc for `piece` from the state that remembers `last` (empty: the beginning)."""
        if self.unigram:
            return self.cost.get(piece, self.unknown_cost)
        own = self.arcs.setdefault(last, {})
        known = own.get(piece)
        if known is None:
            apart = [last, piece] if last else [piece]
            known = own[piece] = 0.0 if self.merged(last + piece) == apart else INFINITY
            self.pairs += 1
        return known

    def first_path(self, unit: str) -> list[str]:
        """shortest_path() of a byte-pair encoding: as arcs weigh 0 or infinity, the first path of finite weight is the
        least. Of the states that the best-first search could go on from, that which came last is tried first, and of its
        arcs the longest; a place whose arcs all fail is not entered again, for one state of finite weight is all it has."""
        n, reach, arcs, text = len(unit), self.reach, self.arcs, self.text
        out, ends, dead = [""], [0], set()
        j = 0
        i = min(n, reach.get(unit[:2], 1))
        while j < n:
            last = out[-1]
            own = arcs.get(last)
            if own is None:
                own = arcs[last] = {}
            while i > j:
                piece = unit[j:i]
                if (piece in text or i == j + 1) and i not in dead:
                    known = own.get(piece)
                    if (self.weight(last, piece) if known is None else known) == 0.0:
                        break
                i -= 1
            if i > j:
                out.append(piece)
                ends.append(i)
                j = i
                i = min(n, j + reach.get(unit[j : j + 2], 1))
            else:  # no arc of finite weight goes on from here
                dead.add(j)
                i = ends.pop() - 1
                out.pop()
                j = ends[-1]
        return out[1:]

    def shortest_path(self, unit: str) -> list[str]:
        """The pieces, or characters left to the byte fallback, of the path with the least weight; of equals the one whose
        last piece begins first. At each place the arcs of all pieces that begin there are relaxed."""
        n, states, weight = len(unit), self.states, self.weight
        least = [0.0, *[INFINITY] * n]
        last: list = ["", *[None] * n]
        back = [0] * (n + 1)
        for j in range(n):
            so_far, before = least[j], last[j]
            if before is None:
                continue  # no finite path comes here
            arcs = self.cost if self.unigram else self.arcs.setdefault(before, {})
            for i in range(j + 1, n + 1):
                piece = unit[j:i]
                final = states.get(piece)
                if final is None and i > j + 1:
                    break
                if final is not False and so_far < least[i]:
                    own = arcs.get(piece)
                    total = so_far + (weight(before, piece) if own is None else own)
                    if total < least[i]:
                        least[i], last[i], back[i] = total, piece, j
                if final is None:
                    break
        out, i = [], n
        while i:
            out.append(last[i])
            i = back[i]
        return out[::-1]

    def _unit(self, unit: str) -> bytes:
        known, out = self.packed, []
        for piece in self.path(unit):
            ids = known.get(piece)
            if ids is None:  # the byte fallback's pieces
                found = [self.byte_piece[b] for b in piece.encode("utf-8", "surrogatepass")] if self.fallback else [self.unknown]
                ids = known[piece] = b"".join(i.to_bytes(4, "little") for i in found)
            out.append(ids)
        if not self.fallback:  # neighbours without a piece are one unknown
            none = self.unknown.to_bytes(4, "little")
            out = [ids for k, ids in enumerate(out) if not (k and ids == none and out[k - 1] == none)]
        return b"".join(out)

    @property
    def units(self) -> list[str]:
        """Units that are remembered."""
        return self.memo.column(0).to_pylist()

    def _learn(self, chunks: list[str]) -> None:
        if self.pairs > PAIRS_MOST:
            self.arcs, self.pairs = {}, 0
        self._append(pa.array(chunks, pa.large_string()), pa.array([*map(self._unit, chunks)], pa.large_binary()))

    def encode_all(self, texts: Sequence[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; null and empty texts have none."""
        held = pa.array([self.normalise(text) if text else "" for text in texts], pa.large_string())
        bounds = np.frombuffer(held.buffers()[1], dtype="<i8", count=len(texts) + 1)
        data = np.frombuffer(held.buffers()[2] or b"", dtype=np.uint8, count=bounds[-1])
        cut = np.zeros(len(data) + 1, dtype=bool)
        if len(data):
            for i in range(1, len(data), STRETCH):  # places take eight bytes for each byte of text
                part = data[i : i + STRETCH]
                cut[i : i + len(part)] = self.apart[(data[i - 1 : i - 1 + len(part)].astype(np.uint16) << 8) | part]
            spaces = np.flatnonzero(data == SPACE_BYTES[0])
            spaces = spaces[(data[1:][spaces] == SPACE_BYTES[1]) & (data[2:][spaces] == SPACE_BYTES[2])]
            cut[spaces[np.append(True, np.diff(spaces) != 3)[: len(spaces)]]] = True  # no piece has one behind another character
        cut[bounds] = True
        begins = np.flatnonzero(cut)  # the end, too
        units = pa.Array.from_buffers(pa.large_string(), len(begins) - 1, [None, pa.py_buffer(begins), held.buffers()[2]])
        coded = units.dictionary_encode()
        ids = self._recall(coded.dictionary).take(coded.indices)
        ends = np.frombuffer(ids.buffers()[1], dtype="<i8", count=len(ids) + 1)[np.searchsorted(begins, bounds)].tolist()
        joined = memoryview(ids.buffers()[2] or b"")
        return [bytes(joined[a:b]) for a, b in pairwise(ends)]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_all([text])[0]

    def decode_all(self, rows: Sequence[bytes | None]) -> list[str]:
        """The texts of little-endian ids: the dummy space is dropped, bytes that aren't UTF-8 become U+FFFD."""
        if any(len(x or b"") % 4 for x in rows):
            raise ValueError("ids are of four bytes each")
        ids = np.frombuffer(b"".join(x for x in rows if x), dtype="<u4")
        data = self.bytes.take(pa.array(ids))
        ends = np.frombuffer(data.buffers()[1], dtype="<i8", count=len(ids) + 1)
        ends = ends[np.cumsum([0, *(len(x or b"") // 4 for x in rows)])].tolist()
        joined, drop = memoryview(data.buffers()[2] or b""), self.normalise.dummy_prefix
        return [str(joined[a + (drop and joined[a : a + 1] == b" " and a < b) : b], "utf-8", "replace") for a, b in pairwise(ends)]

    def decode(self, ids: bytes) -> str:
        """The text of one row of ids."""
        return self.decode_all([ids])[0]


@lru_cache(maxsize=2)
def transducer(path: str) -> PieceTransducer:
    """Compiled once in each worker."""
    return PieceTransducer(path)


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, piece_ids) for each row of `docs` (doc_id, text): ids of the model's pieces as little-endian unsigned
    32-bit integers. Null and empty texts have none. Null and repeated doc_ids stay as they are. Other columns are
    ignored; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for part in blocks(texts, 4_000_000):
                found, ids = transducer(model).encode_all(texts[part]), batch.column(0)[part.start : part.stop]
                for few in blocks(texts[part], 1_000_000):  # what is handed on at once
                    yield pa.RecordBatch.from_arrays([ids[few.start : few.stop], pa.array(found[few], type=pa.binary())], names=["doc_id", "piece_ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece_ids binary")


def decode_pieces(rows: DataFrame, model: str, *, keep_ids: bool = False) -> DataFrame:
    """(doc_id, text) for each row of `rows` (doc_id, piece_ids), with keep_ids also piece_ids; null ids give an empty
    text. Encoded text comes back as it was, but for U+2581, which the model writes for a space."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = pa.array(transducer(model).decode_all(part.column(1).to_pylist()), type=pa.string())
                more = {"piece_ids": part.column(1)} if keep_ids else {}
                yield pa.RecordBatch.from_pydict({"doc_id": part.column(0), "text": texts, **more})

    schema = "doc_id long, text string" + ", piece_ids binary" * keep_ids
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "piece_ids").mapInArrow(run, schema)
