import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from plumbline.llm.packing import HarmonicPacker, cut_lengths, pack_documents
from plumbline.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


@given(st.integers(1, 20_000), st.sampled_from([64, 100, 2048]))
@settings(max_examples=200, deadline=None)
def test_cuts_cover_the_document(tokens, capacity):
    cuts = cut_lengths(tokens, capacity, 16)
    assert sum(cuts) == tokens and min(cuts) > 0
    assert all(capacity // (capacity // x) == x for x in cuts[:-1])


@given(st.lists(st.integers(1, 3000), max_size=200))
@settings(max_examples=50, deadline=None)
def test_bins_hold_and_waste_little(sizes):
    packer, out, capacity = HarmonicPacker(512, 5), [], 512
    pieces = [(i, 0, x, b"", n) for i, n in enumerate(sizes) for x in cut_lengths(n, capacity, 16)]
    for p in pieces:
        out += packer.add(p)
    out += packer.finish()
    assert sorted(p for p, _, _ in out) == sorted(pieces)
    bins = defaultdict(list)
    for p, s, o in out:
        bins[s].append((o, p[2]))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == np.concatenate([[0], np.cumsum([n for _, n in own])[:-1]]).tolist()
        assert sum(n for _, n in own) <= capacity
    total = sum(sizes)
    assert len(bins) * capacity <= 1.04 * total + 2 * capacity


def check_pieces(rows, texts):
    tok = Tokenizer.from_file(PATH)
    want = {k: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for k, t in texts.items()}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append((r.offset, r.length))
    assert by_doc.keys() == want.keys()
    for k, own in by_doc.items():
        at = 0
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want[k])
            assert r.ids_crc32 == zlib.crc32(np.array(want[k][at : at + r.length], dtype="<u4").tobytes())
            at += r.length
        assert at == len(want[k])
    padded = 0
    for own in by_seq.values():
        own.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and own[0][0] == 0
        full = own[-1][0] + own[-1][1]
        assert full <= 2048
        padded += full if full & (full - 1) == 0 else 2048
    return padded / sum(map(len, want.values()))


def test_query_against_the_library(spark):
    at = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    assert check_pieces(QUERIES["op4_packing"](spark, at).collect(), texts) < 1.02


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 2.0), (2, "", 2.0), (None, "a b", 2.0), (3, "word " * 9000, 2.0), (3, "again", 2.0)], "doc_id long, text string, length double")
    rows = pack_documents(docs, tokenizer=PATH, end_id=1).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens) for r in rows if r.start == 0) == [(0, 3), (1, 1), (2, 1), (3, 2), (3, 9001)]
    assert pack_documents(docs.limit(0), tokenizer=PATH, end_id=1).count() == 0


@pytest.mark.parametrize("name,spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_memo_gives_the_librarys_ids(spark, name, spaces):
    from plumbline.llm.tokens import ChunkEncoder

    odd = [
        "a\x0b\nb", "\nA", "\n", "a\n", "éx é", "x,́", "a\x1e\nb", "x²y", "x_y a_", "a  b", "", "  a  b ", "a\n b", "x   ", " x", "x ",
        "a\n\n  b", "it's  ok 's", "é́ à", "Σας ΟΔΟΣ İst", "<|endoftext|> x", "a<|startoftext|>b", "see <|endoftext|>, <|endoftext|>\n<|ENDOFTEXT|> end", "1234 5 ½", "a" * 500, "!!! ,a .b", "don't we'll", "tab\tx",
    ]
    texts = odd + [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    enc = ChunkEncoder(public_tokenizers.path(name), 7, spaces)
    library = Tokenizer.from_file(public_tokenizers.path(name))
    want = [np.array([*library.encode(t, add_special_tokens=False).ids, 7], dtype="<u4").tobytes() for t in texts]
    assert enc.encode(texts) == want
    assert enc.encode(texts[::-1]) == want[::-1]


def test_other_white_space_between_spaces():
    from plumbline.llm.tokens import ChunkEncoder

    enc = ChunkEncoder(public_tokenizers.path("byte_bpe_50k.json"), 7, True)
    texts = ["Home \u00a0 \u00a0 About", "a \u00a0 \u00a0 b", "\u00a0 \u00a0 \u00a0", "a\u00a0 \u00a0b", "a \u00a0\n\u00a0 b", "a \u00a0 b"]
    assert enc.encode(texts) == [x + enc.end for x in enc._library(texts)]


PIECES = st.sampled_from([" ", "\n", "<|endoftext|>", "<|startoftext|>", "\t", "\r\n", "\u00a0", "a", "word", "Éa", "12", ",", "...", "'s", "e\u0301", "ß", "İ", "\u0958", "<s>"])

LIBRARY = {name: Tokenizer.from_file(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "word_bpe_49k.json")}


@given(st.lists(PIECES, max_size=25).map("".join))
@settings(max_examples=300, deadline=None)
def test_memo_on_mixed_white_space(text):
    for name, spaces in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        from plumbline.llm.tokens import shared_encoder

        enc, library = shared_encoder(public_tokenizers.path(name), 3, spaces), LIBRARY[name]
        assert enc.encode([text]) == [np.array([*library.encode(text, add_special_tokens=False).ids, 3], dtype="<u4").tobytes()]


@pytest.mark.parametrize("name,spaces", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_memo_is_compact_and_right_in_all_its_parts(name, spaces):
    from plumbline.llm.tokens import ChunkEncoder

    rng = random.Random(5)
    signs = [*"abcdeTH" * 8, *"éßñÉΣςİǅªⅧ²½１\u0301\u0130\u200d漢😀\u00ad", *",.'-_#%1\"" * 2, *" " * 30, "\n", "\n", " \n", "  ", "\t", "\u00a0", "\u2003"]
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 300))) for _ in range(400)]
    enc, library = ChunkEncoder(public_tokenizers.path(name), 7, spaces, 20_000), LIBRARY[name]
    want = [np.array([*library.encode(t, add_special_tokens=False).ids, 7], dtype="<u4").tobytes() for t in texts]
    for _ in range(2):  # from the memo, too
        for i in range(0, len(texts), 80):
            assert enc.encode(texts[i : i + 80]) == want[i : i + 80]
    # arrays, without a Python object for each chunk
    assert len(enc.memo) > 500 and enc.memo.get_total_buffer_size() < 64 * len(enc.memo)
    assert len(set(enc.memo.column(0).to_pylist())) == len(enc.memo)


def test_line_feeds_part_chunks():
    from plumbline.llm.tokens import ChunkEncoder

    enc, learned = ChunkEncoder(PATH, 7, False), []
    learn = enc._learn
    enc._learn = lambda chunks: (learned.extend(chunks), learn(chunks))
    text = "one.\nTwo one.\n\nTwo\none. Two\n"
    assert enc.encode([text, text]) == [x + enc.end for x in enc._library([text, text])]
    assert sorted(learned) == ["", "Two", "one."]
