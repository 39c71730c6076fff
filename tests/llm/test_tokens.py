import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paywarden.llm import bpe, tokenbin
from paywarden.llm.queries import op1_bpe, op9_token_files, tokenizer_path
from tests.conftest import SF
from tests.llm.conftest import edge_rows


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_path())


@pytest.fixture(scope="module")
def own():
    return bpe.Codec(open(tokenizer_path(), encoding="utf-8").read())


def ids(raw):
    return np.frombuffer(raw, "<u4").tolist()


PIECES = st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "'s", "é", "ß", "日本", "😀", "12", "!?", "<|endoftext|>", " ", "　", "\x1c", "\x85", "́"])
                  | st.characters(blacklist_categories=["Cs"]), max_size=30).map("".join)


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(PIECES, min_size=1, max_size=5))
def test_encode_equals_library(library, own, texts):
    found = own.encode(texts)
    for text, raw in zip(texts, found):
        assert ids(raw) == library.encode(text, add_special_tokens=False).ids
        assert own.decode(raw) == library.decode(ids(raw), skip_special_tokens=False)


def test_tree_merges_one_long_piece(library, own):
    for text in ("ab" * 5000, "thereof" * 900, "a" * 3000, "🙂" * 400):
        assert ids(own.encode([text])[0]) == library.encode(text, add_special_tokens=False).ids


def test_merge_many_equals_merge(own):
    words = [w.encode() for w in ("", "a", "th", "there", "unbelievable", "zzzzzzzz", "straße")]
    together = own.merge_many(words, 16)
    assert [ids(x) for x in together] == [own.merge([own.byte_id[b] for b in w]) for w in words]


def test_decode_replaces_what_is_not_utf8(own, library):
    broken = [own.byte_id[0xE2], own.byte_id[0x82], own.byte_id[0x41]]
    assert own.decode(np.array(broken, "<u4").tobytes()) == library.decode(broken, skip_special_tokens=False)


def test_cache_generations_change_nothing(own):
    small = bpe.Codec(open(tokenizer_path(), encoding="utf-8").read())
    small.cache.entries = 3
    texts = [f"some words {i} and {i % 7} more" for i in range(40)]
    assert [small.encode([t])[0] for t in texts] == own.encode(texts)


def test_edge_rows(spark, edge, empty, library):
    done = bpe.encode_decode(edge.withColumnRenamed("score", "TOKEN_IDS"), tokenizer_path())
    rows = done.collect()
    assert len(rows) == len(edge_rows()) and done.columns.count("token_ids") == 1 and "TOKEN_IDS" not in done.columns
    for r in rows:
        assert ids(r.token_ids) == library.encode(r.text or "", add_special_tokens=False).ids and r.decoded == (r.text or "")
    assert bpe.encode_decode(empty, tokenizer_path()).count() == 0


def test_op1_equals_library(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op1_bpe(spark, SF).collect():
        want = library.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(want) and r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(want, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("n", [1, 7, 8, 1000])
def test_planes_round_trip(bits, n):
    x = np.random.default_rng(n).integers(0, 1 << 32, n, dtype=np.uint64).astype("<u4")
    planes = tokenbin.to_planes(x, bits)
    assert len(planes) == (32 if bits else 4) and (tokenbin.from_planes(planes, n, bits) == x).all()


@pytest.mark.parametrize("bits", [False, True])
def test_files_round_trip(spark, edge, empty, library, bits):
    got = tokenbin.token_files(edge, tokenizer_path(), bits=bits, block=64).collect()
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r[0] for r in edge_rows()), key=lambda i: (i is not None, i or 0))
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got][:-1]]).tolist()
    texts = {}
    for row in edge_rows():
        texts.setdefault(row[0], []).append(library.encode(row[1] or "", add_special_tokens=False).ids + [0])
    for r in got:
        assert ids(r.ids) in texts[r.doc_id]
    assert tokenbin.token_files(empty, tokenizer_path()).count() == 0


def test_op9_equals_library(spark, library):
    rows = sorted((r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: r for r in op9_token_files(spark, SF).collect()}
    start = 0
    for doc_id, text in rows:
        want = library.encode(text, add_special_tokens=False).ids + [0]
        r = got[doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)


@settings(max_examples=200, deadline=None)
@given(texts=st.lists(PIECES, min_size=1, max_size=5))
def test_file_encoder_equals_library(library, texts):
    spec = open(tokenizer_path(), encoding="utf-8").read()
    found = tokenbin.encode_texts(spec, texts)
    assert [x.tolist() for x in found] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_file_encoder_where_every_mark_is_taken(library):
    spec = open(tokenizer_path(), encoding="utf-8").read()
    marks = "\x1e\x1f" + "".join(map(chr, range(0xE000, 0xE100)))
    texts = ["one two  three", marks + " and more", "", " x"]
    assert [x.tolist() for x in tokenbin.encode_texts(spec, texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(PIECES | st.lists(st.sampled_from(["a", "Zz", " ", "  ", ".", ",!", "\n", "é", "😀", "\x1e", ""]), max_size=12).map("".join), max_size=6))
def test_words_are_cut_beside_ascii_only(library, texts):
    """The words of a text joined are the text, its ids are the library's, and only texts with spaces that
    follow each other keep them together."""
    places, words = tokenbin.cut_words(texts)
    words = words.to_pylist()
    spec = open(tokenizer_path(), encoding="utf-8").read()
    for text, a, b, ids in zip(texts, places, places[1:], tokenbin.encode_texts(spec, texts)):
        assert "".join(words[a:b]) == text and all(words[a:b])
        assert "  " in text or not any(" " in w[1:] for w in words[a:b])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids
    assert len(places) == len(texts) + 1 and places[-1] == len(words)
