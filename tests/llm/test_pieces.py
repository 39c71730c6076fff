import hashlib
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paywarden.llm import piece
from paywarden.llm.queries import op11_sentencepiece, piece_path
from tests.conftest import SF
from tests.llm.conftest import edge_rows

TEXTS = st.lists(st.sampled_from(["a", "the", " ", "  ", "\n", "\t", "é", "日本", "😀", "12", "<unk>", "<s>", "▁", "▁▁", "ing", "\x00", "<0x0A>", "ﬁ",
                                  "ｶﾞ", "①", "　", "㌔", "½", "\x7f", " of"]) | st.characters(blacklist_categories=["Cs"]), max_size=30).map("".join)


def model_bytes():
    with open(piece_path(), "rb") as f:
        return f.read()


def varint(x):
    out = b""
    while x > 127:
        out, x = out + bytes([x & 127 | 128]), x >> 7
    return out + bytes([x])


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def changed(dummy=1, squeeze=0, char_map=b"", kinds=None, trainer=b""):
    """The given model with another normaliser and other kinds of some pieces."""
    own = piece.message(model_bytes())
    out = b""
    for i, row in enumerate(own[1]):
        r = piece.message(row)
        kind = (kinds or {}).get(i, r.get(3, [1])[0])
        out += field(1, field(1, r[1][0]) + (b"\x15" + r[2][0] if 2 in r else b"") + field(3, kind))
    return out + field(2, own[2][0] + trainer) + field(3, field(2, char_map) + field(3, dummy) + field(4, squeeze))


def library(model):
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def same(own, lib, texts):
    offsets, ids, begins, ends = own.encode(texts)
    for k, text in enumerate(texts):
        cut = slice(offsets[k], offsets[k + 1])
        want = lib.encode(text, return_type="proto")
        assert ids[cut].tolist() == [p.id for p in want.pieces]
        assert list(zip(begins[cut].tolist(), ends[cut].tolist())) == [(p.begin, p.end) for p in want.pieces]
        assert own.decode(ids[cut].tolist()) == lib.decode([p.id for p in want.pieces])


@pytest.fixture(scope="module")
def given_model():
    return piece.Pieces(model_bytes()), library(model_bytes())


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(TEXTS, min_size=1, max_size=5))
def test_ids_spans_and_text_equal_the_library(given_model, texts):
    same(*given_model, texts)


@settings(max_examples=300, deadline=None)
@given(ids=st.lists(st.integers(0, 300) | st.integers(0, 31999), max_size=10))
def test_decoding_any_ids_equals_the_library(given_model, ids):
    own, lib = given_model
    assert own.decode(ids) == lib.decode(ids)


def test_long_words_use_the_heap_and_equal_the_library(given_model):
    same(*given_model, ["ab" * 5000, "a" * 3000, " " * 700, "🙂" * 400, "unbelievable" * 200, "x▁" * 100])


def test_a_worker_table_that_starts_anew_changes_nothing():
    small, lib = piece.Pieces(model_bytes()), library(model_bytes())
    small.words.entries = 3
    for texts in (["one two three four five"], ["five four six"], ["one", "", "seven eight"], ["one two"]):
        same(small, lib, texts)


@pytest.fixture(scope="module")
def char_map():
    import sentencepiece
    rule = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc").serialized_model_proto()
    return piece.message(piece.message(rule)[3][0])[2][0]


@pytest.mark.parametrize("dummy", [0, 1])
@pytest.mark.parametrize("squeeze", [0, 1])
@pytest.mark.parametrize("variant", ["kinds", "no bytes"])
def test_compiled_character_maps_and_other_kinds_equal_the_library(char_map, dummy, squeeze, variant):
    if variant == "kinds":         # unused pieces are taken apart again, user-defined ones stay whole
        model = changed(dummy, squeeze, char_map, {300: 5, 400: 5, 1200: 5, 600: 4, 28705: 4})
    else:                          # runs of unknown characters become one unknown piece
        model = changed(dummy, squeeze, char_map, {i: 5 for i in range(3, 259)}, field(35, 0))
    own, lib = piece.Pieces(model), library(model)

    @settings(max_examples=100, deadline=None)
    @given(texts=st.lists(TEXTS, min_size=1, max_size=4))
    def run(texts):
        same(own, lib, texts)

    run()


def test_every_prefix_of_the_character_map_is_normalised_as_in_the_library(char_map):
    import sentencepiece
    own = piece.Pieces(changed(0, 0, char_map))
    lib = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc", add_dummy_prefix=False, remove_extra_whitespaces=False, escape_whitespaces=True)
    for start in range(0x20, 0x30000, 64):
        text = "".join(chr(c) for c in range(start, start + 64) if not 0xD800 <= c < 0xE000)
        assert own.general(text)[0] == lib.normalize(text)


def test_models_of_another_kind_are_refused():
    own = piece.message(model_bytes())
    unigram = b"".join(field(1, r) for r in own[1][:300]) + field(2, field(3, 1)) + field(3, own[3][0])
    with pytest.raises(ValueError, match="BPE"):
        piece.Pieces(unigram)
    assert struct.calcsize("<f") == 4


def test_query_equals_the_library_on_the_whole_table(spark):
    lib = library(model_bytes())
    rows = {r.doc_id: r for r in op11_sentencepiece(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids, r = lib.encode(d.text or ""), rows[d.doc_id]
        assert (r.n_tokens, r.covered_bytes) == (len(ids), len((d.text or "").encode()))
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_edge_rows(edge, empty, given_model):
    lib = given_model[1]
    clash = edge.withColumnRenamed("KEY", "Piece_IDs")
    done = piece.encode(clash, piece_path(), decoded="back")
    assert [c for c in done.columns if c.lower() == "piece_ids"] == ["piece_ids"]
    rows = done.collect()
    assert len(rows) == len(edge_rows())
    for r in rows:
        assert r.piece_ids == lib.encode(r.text or "") and r.back == lib.decode(r.piece_ids)
        assert len(r.piece_begins) == len(r.piece_ends) == len(r.piece_ids)
    again = piece.decode(done.select("text", "piece_ids", "back"), piece_path()).collect()
    assert all(r.decoded == r.back for r in again)
    assert piece.encode(empty, piece_path()).count() == 0
