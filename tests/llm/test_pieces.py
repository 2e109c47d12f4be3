import hashlib
import itertools
import random

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from segmill.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
TEXTS = ["", " ", "   x  y ", "▁", "a▁ b", "word " * 3000, "x" * 4000, "日本語 \U0001f642\U0001f642", "<s></s><unk><0x41>", "\x00\n\t", "f²..²x", "﻿ é"]


@pytest.mark.parametrize("text", TEXTS)
def test_texts(text):
    check(text)


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" ▁abcdeinrst.,'²1\n\té日<0x41>"), st.characters(codec="utf-8")), max_size=60))
def test_any_text(text):
    check(text)


def check(text):
    coder = pieces.vocabulary(PATH)
    ids = LIBRARY.encode(text)
    assert coder.encode(text) == ids
    assert coder.decode(ids) == LIBRARY.decode(ids) == coder.decode_joined(",".join(map(str, ids)))


def test_both_agendas_agree():
    coder = pieces.vocabulary(PATH)
    for text in ("▁internationalization", "▁aaaaaaaaaa", "▁thethethere"):
        assert coder._merge_short(list(text)) == coder._merge_long(list(text))


def test_many_units_side_by_side():
    """Agendas in the rows of arrays give what the agenda of a unit alone gives, and equal scores are taken from the left."""
    coder = pieces.vocabulary(PATH)
    rng = random.Random(3)
    parts = ["the", "ing", "tion", "aa", "a", "ße", "é", "日", "1", "7", ".", "\n", "\U0001f642", "qz"]
    units = [("▁" if rng.random() < 0.5 else "") + "".join(rng.choices(parts, k=rng.randrange(1, 9))) for _ in range(2000)]
    units += ["", "▁", "a" * 30, "a" * 31, "x" * 65, "the" * 30]
    assert coder.encode_units(units) == [coder.encode_unit(u) for u in units]
    assert [coder.encode_units(units[:n]) for n in (0, 1, pieces.TOGETHER_ROWS)] == [[coder.encode_unit(u) for u in units[:n]] for n in (0, 1, pieces.TOGETHER_ROWS)]
    texts = ["".join(units[i : i + 40]) for i in range(0, 2000, 40)]
    assert [n for n, *_ in coder.digests(texts)] == [len(LIBRARY.encode(t)) for t in texts]


def test_agendas_of_many_units_are_no_loop(monkeypatch):
    """New units of plain characters don't go through Python one by one."""
    coder = pieces.MergeVocabulary(PATH)
    alone = []
    merge = coder.merge
    monkeypatch.setattr(coder, "merge", lambda text: alone.append(text) or merge(text))
    text = " ".join("".join(p) for p in itertools.product(("ver", "an", "the"), ("ing", "tion", "heit"), ("s", "en", "able"), ("x", "or")))
    assert coder.encode(text) == LIBRARY.encode(text)
    assert len(alone) <= 2


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("  ab,.é²1_\n日ªº▁"), max_size=30))
def test_words_are_the_pattern_s_units(text):
    coder = pieces.vocabulary(PATH)
    assert [*coder.split(text)] == [coder.unit.findall(" " + text.replace("▁", " ")) if text else []]


def test_bytes_decode_with_the_rest():
    """A newline becomes a byte; texts with one are decoded without a loop over ids."""
    coder = pieces.MergeVocabulary(PATH)
    text = "one\ntwo 日\n\U0001f642 \x00x"
    ids = LIBRARY.encode(text)
    coder.decode_ids = None
    assert coder.decode_joined(",".join(map(str, ids))) == LIBRARY.decode(ids) == text
    cut = [*LIBRARY.encode("a"), coder.byte_ids[0xE6], coder.byte_ids[0x97], *LIBRARY.encode("b")]
    assert coder.decode_joined(",".join(map(str, cut))) == pieces.vocabulary(PATH).decode(cut)


def test_documents(spark, make_docs):
    rows = [(1, None), (None, "a b"), *((10 + i, t) for i, t in enumerate(TEXTS)), (10, "")]
    docs = make_docs(rows)

    def digest(text):
        ids = LIBRARY.encode(text or "")
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()

    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.digest_documents(docs, PATH).collect()), key=str)
    assert got == sorted(((d, *digest(t)) for d, t in rows), key=str)
    full = pieces.encode_documents(docs, PATH).collect()
    assert sorted((str(r.doc_id), list(r.ids)) for r in full) == sorted((str(d), LIBRARY.encode(t or "")) for d, t in rows)
    assert pieces.digest_documents(make_docs([]), PATH).count() == 0


def test_long_texts_in_parts(monkeypatch):
    """Parts of a text and texts that are learned together change nothing, and the table is bounded in bytes."""
    coder, texts = pieces.vocabulary(PATH), ["日 ab\U0001f642  x" * 200, "", "y z " * 100, " "]
    want = list(coder.digests(texts))
    monkeypatch.setattr(pieces, "TOGETHER", 60)
    monkeypatch.setattr(pieces, "UNITS", 7)
    small = pieces.MergeVocabulary(PATH)
    small.units.most = 2_000
    assert list(small.digests(texts)) == want and small.units.bytes <= 2_000
    small.encode("q" * 5000)
    assert all(len(u) <= 64 for u in small.units)


def test_a_difference_raises():
    coder = pieces.MergeVocabulary(PATH)
    coder._merge_short = lambda symbols: symbols
    with pytest.raises(ValueError, match="the library gives"):
        coder.encode("international")


def test_a_difference_in_decoding_raises():
    coder = pieces.MergeVocabulary(PATH)
    coder.decode_ids = lambda ids: "other"
    with pytest.raises(ValueError, match="decodes one of"):
        coder.encode("international")
