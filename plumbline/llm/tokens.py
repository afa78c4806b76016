"""Token ids of whole texts through the tokenizers library, with a memo of chunks.

Both supported vocabularies split a text at spaces before any merge, so the ids of a text are the ids of its
space-separated chunks put together. Chunks repeat far more than documents do; each worker asks the library once for
each chunk it has not seen and joins little-endian unsigned 32-bit ids. Texts whose chunks are not independent (runs of
white space under the byte-level pattern) go to the library whole, and so do texts that hold the string of a special
token, which the library gives that token's id.

Chunks are found, told apart, looked up and joined in Arrow arrays, whole blocks of texts at a time.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Sequence
from functools import lru_cache
from itertools import pairwise, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: The memo forgets chunks beyond this many, which bounds a worker's memory (under 64 bytes for each).
MEMO_ENTRIES = 600_000
#: Longer chunks are forgotten after the call.
MEMO_CHARS = 64
#: What such white space belongs to depends on its neighbours, so texts with a chunk that begins or ends with it, or is
#: empty because two spaces meet, go to the library whole. A line feed begins its chunk.
OTHER = frozenset(c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n")
LONE = OTHER | {"", "\n"}
#: Where a text's first chunk ends.
HEADLESS = re.compile(r"[ \n]|\Z")
#: Bytes of ASCII letters and of all other characters beyond ASCII, and of visible ASCII.
LETTER = np.array([b > 127 or chr(b).isalpha() for b in range(256)])
VISIBLE = np.array([32 < b < 127 for b in range(256)])
MEMO = pa.schema([("chunk", pa.large_string()), ("ids", pa.large_binary())])
EMPTY = pa.record_batch([[], []], schema=MEMO)


class ChunkMemo:
    """Ids of chunks in Arrow arrays, null for a chunk that has none of its own. `_learn` appends those of new chunks."""

    def __init__(self, entries: int) -> None:
        self.memo_entries = entries
        self.memo = self.earlier = EMPTY  # those used of late, and those used before them

    def _learn(self, chunks: list[str]) -> None:
        """Append the ids of `chunks`, in order, and then whatever else is worth remembering."""
        raise NotImplementedError

    def _forget(self) -> None:
        """Called when a half of the memo is forgotten."""

    def _append(self, chunks: pa.Array, ids: pa.Array) -> None:
        self.memo = pa.record_batch([pa.concat_arrays([old, new]) for old, new in zip(self.memo.columns, (chunks, ids), strict=True)], schema=MEMO)

    def _recall(self, chunks: pa.Array) -> pa.Array:
        """The ids of different `chunks`. A half of the memo that no call has used since it was filled is forgotten."""
        if 2 * len(self.memo) > self.memo_entries:
            self.earlier, self.memo = self.memo, EMPTY
            self._forget()
        at = pc.index_in(chunks, value_set=self.memo.column(0))
        if not at.null_count:
            return self.memo.column(1).take(at)
        known, missing = at.fill_null(0).to_numpy().astype(np.int64), np.flatnonzero(at.is_null().to_numpy(zero_copy_only=False))
        asked = chunks.take(pa.array(missing))
        before = pc.index_in(asked, value_set=self.earlier.column(0))
        new = before.is_null().to_numpy(zero_copy_only=False)
        known[missing[~new]] = len(self.memo) + np.arange(len(missing) - new.sum())
        self._append(*self.earlier.take(before.drop_null()).columns)
        begin, asked = len(self.memo), asked.filter(pa.array(new))
        known[missing[new]] = begin + np.arange(len(asked))
        if len(asked):
            self._learn(asked.to_pylist())
        out = self.memo.column(1).take(pa.array(known))
        long = np.flatnonzero(pc.utf8_length(self.memo.column(0).slice(begin)).to_numpy() > MEMO_CHARS)
        if len(long):
            self.memo = self.memo.take(pa.array(np.delete(np.arange(len(self.memo)), begin + long)))
        return out


class ChunkEncoder(ChunkMemo):
    """Encode texts with the tokenizer file at `path`; `end_id` is appended to every text.

    spaces_matter: the vocabulary keeps white space (byte-level BPE). Otherwise white space is dropped (word BPE).
    """

    def __init__(self, path: str, end_id: int, spaces_matter: bool, memo_entries: int = MEMO_ENTRIES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; idle threads would spin
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.end = np.uint32(end_id).astype("<u4").tobytes()
        self.spaces_matter = spaces_matter
        super().__init__(memo_entries)
        self.tails: dict[str, bytes] = {}
        pieces = self.tokenizer.get_vocab(with_added_tokens=True)
        self.edge = np.zeros(max(pieces.values()) + 1, dtype=bool)
        self.edge[[i for p, i in pieces.items() if (p.startswith("\u0120") if spaces_matter else p.endswith("</w>"))]] = True

    def _forget(self) -> None:
        self.tails.clear()

    def _library(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.asarray(x.ids, dtype="<u4").tobytes() for x in found]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only: many to a call, cut apart at the pieces that begin a word with its space, or
        that end a word."""
        lead, out = " " if self.spaces_matter else "", []
        for i in range(0, len(words), 512):
            part = words[i : i + 512]
            found = self.tokenizer.encode_batch_fast([lead + " ".join(part)], add_special_tokens=False)[0]
            ids = np.asarray(found.ids, dtype="<u4")
            marks = np.flatnonzero(self.edge[ids])
            cuts = (4 * (np.append(marks, len(ids)) if self.spaces_matter else np.append(0, marks + 1))).tolist()
            if len(cuts) == len(part) + 1 and cuts[0] == 0 and cuts[-1] == 4 * len(ids):
                joined = ids.tobytes()
                out += [joined[a:b] for a, b in pairwise(cuts)]
            else:  # a letter that the normaliser turns into more than letters
                out += self._library([lead + w for w in part])
        return out

    def _turns(self, word: str) -> bool:
        """Whether the word vocabulary's normaliser makes more than letters of these letters."""
        return not (self.spaces_matter or word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())

    def _odd(self, chunks: list[str]) -> list[bytes | None]:
        """Ids of chunks that are not letters before visible ASCII; those of white space that needs its neighbours have none."""
        lead, spaces = " " if self.spaces_matter else "", self.spaces_matter
        none = [spaces and (c[-1:] in LONE or c[c[0] == "\n"] in OTHER) for c in chunks]
        asked = [c if spaces and c[:1] == "\n" else lead + c for c, alone in zip(chunks, none, strict=True) if not alone]
        found = iter(self._library(asked))
        return [None if alone else next(found) for alone in none]

    def _learn(self, chunks: list[str]) -> None:
        """Append new chunks to the memo, in order, and after them the words that they begin with. A run of letters ends
        before any other ASCII character, whatever that is, so the two sides have ids of their own."""
        held = pa.array(chunks, pa.large_string())
        bounds = np.frombuffer(held.buffers()[1], dtype="<i8", count=len(chunks) + 1)
        data = np.frombuffer(held.buffers()[2] or b"", dtype=np.uint8, count=bounds[-1])
        begins, ends = bounds[:-1], bounds[1:]
        cuts, unseen = np.flatnonzero(~LETTER[data]), np.flatnonzero(~VISIBLE[data])
        cuts = np.minimum(np.append(cuts, len(data))[np.searchsorted(cuts, begins)], ends)
        plain = (cuts > begins) & (np.append(unseen, len(data))[np.searchsorted(unseen, cuts)] >= ends)
        parts = pa.Array.from_buffers(
            pa.large_string(), 2 * len(chunks), [None, pa.py_buffer(np.append(np.column_stack([begins, cuts]).ravel(), bounds[-1])), held.buffers()[2]]
        )
        heads = parts.take(pa.array(2 * np.flatnonzero(plain))).dictionary_encode()
        words, codes = heads.dictionary, heads.indices.to_numpy()
        alpha = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False)
        wide = np.flatnonzero(alpha & ~pc.string_is_ascii(words).to_numpy(zero_copy_only=False))
        alpha[wide] = [not self._turns(w) for w in words.take(pa.array(wide)).to_pylist()]
        at = pc.index_in(words, value_set=self.memo.column(0))
        new = np.flatnonzero(alpha & at.is_null().to_numpy(zero_copy_only=False))
        known = at.fill_null(0).to_numpy().copy()
        known[new] = len(self.memo) + np.arange(len(new))
        found = self._words(words.take(pa.array(new)).to_pylist())
        ids = pa.concat_arrays([self.memo.column(1), pa.array([*found, None], pa.large_binary())])
        known[~alpha] = len(ids) - 1
        # chunks whose letters are none after all join the odd ones
        chosen = np.flatnonzero(plain)[alpha[codes]]
        codes = codes[alpha[codes]]
        plain = np.zeros(len(chunks), dtype=bool)
        plain[chosen] = True
        tails = parts.take(pa.array(2 * chosen + 1)).dictionary_encode()
        ends = tails.dictionary.to_pylist()
        asked = [t for t in ends if t not in self.tails]
        self.tails.update(zip(asked, self._library(asked), strict=True))
        ends = pa.array([self.tails[t] for t in ends], pa.large_binary()).take(tails.indices)
        own = pc.binary_join_element_wise(ids.take(pa.array(known[codes])), ends, pa.scalar(b"", pa.large_binary()))
        odd = np.flatnonzero(~plain)
        rows = pa.concat_arrays([own, pa.array(self._odd([chunks[i] for i in odd.tolist()]), pa.large_binary())])
        place = np.empty(len(chunks), dtype=np.int64)
        place[chosen], place[odd] = np.arange(len(chosen)), len(chosen) + np.arange(len(odd))
        alone = np.zeros(len(words), dtype=bool)  # words that are among the chunks themselves
        alone[codes[cuts[chosen] == bounds[chosen + 1]]] = True
        more = ~alone[new]
        self._append(held, rows.take(pa.array(place)))
        self._append(words.take(pa.array(new[more])), ids.take(pa.array(known[new[more]])))

    def _chunks(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """All chunks of `texts` in order, and the places of each text's first one. The first chunk of a byte-level
        vocabulary, which has no space before it, is null. Chunks lie between spaces and line feeds; a line feed stays
        at the head of its chunk if white space matters."""
        held = pa.array(texts, pa.large_string())
        bounds = np.frombuffer(held.buffers()[1], dtype="<i8", count=len(texts) + 1)
        data = np.frombuffer(held.buffers()[2] or b"", dtype=np.uint8, count=bounds[-1])
        marks = data == 32
        feeds = data == 10
        dropped = marks if self.spaces_matter else marks | feeds
        marks = np.flatnonzero(marks | feeds)
        firsts = np.searchsorted(marks, bounds[:-1])
        gone = np.insert(dropped[marks], firsts, False)  # chunks behind a byte that is dropped
        begins = np.insert(marks, firsts, bounds[:-1])
        firsts = firsts + np.arange(len(texts))
        begins -= np.cumsum(gone) - gone
        places = np.append(begins, bounds[-1] - np.count_nonzero(gone))
        kept = pa.py_buffer(data[~dropped])
        valid = None
        if self.spaces_matter:
            some = np.ones(len(begins), dtype=bool)
            some[firsts] = False
            valid = pa.py_buffer(np.packbits(some, bitorder="little"))
        return pa.Array.from_buffers(pa.large_string(), len(begins), [valid, pa.py_buffer(places), kept]), firsts

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, with the end id; a null text is empty."""
        whole = {i for i, text in enumerate(texts) if text and any(special in text for special in self.special)}
        own = ["" if i in whole else text or "" for i, text in enumerate(texts)]
        chunks, firsts = self._chunks(own)
        coded = chunks.dictionary_encode()
        ids = self._recall(coded.dictionary).take(coded.indices)
        if ids.null_count > self.spaces_matter * len(own):  # chunks without ids of their own
            none = np.flatnonzero(ids.is_null().to_numpy(zero_copy_only=False))
            none = none[np.isin(none, firsts, invert=True)] if self.spaces_matter else none
            whole.update((np.searchsorted(firsts, none, side="right") - 1).tolist())
        joined = memoryview(ids.buffers()[2] or b"")
        ends = np.frombuffer(ids.buffers()[1], dtype="<i8", count=len(ids) + 1)[np.append(firsts, len(ids))].tolist()
        heads = repeat(b"")
        if self.spaces_matter:
            heads = self._library([text[: HEADLESS.search(text).start()] for text in own])
        out = [b"".join((head, joined[a:b], self.end)) for head, (a, b) in zip(heads, pairwise(ends))]
        whole = sorted(whole)
        for i, found in zip(whole, self._library([texts[i] for i in whole]), strict=True):
            out[i] = found + self.end
        return out


def blocks(texts: Sequence[str | None], chars: int = 4_000_000) -> list[slice]:
    """Slices of `texts` of about `chars` characters each, one text at least."""
    out, begin, size = [], 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= chars:
            out.append(slice(begin, i + 1))
            begin, size = i + 1, 0
    if begin < len(texts):
        out.append(slice(begin, len(texts)))
    return out


@lru_cache(maxsize=4)
def shared_encoder(path: str, end_id: int, spaces_matter: bool, memo_entries: int = MEMO_ENTRIES) -> ChunkEncoder:
    """The worker's encoder, with what it remembers from earlier tasks."""
    return ChunkEncoder(path, end_id, spaces_matter, memo_entries)
