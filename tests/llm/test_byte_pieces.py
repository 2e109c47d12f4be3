import hashlib
import sys

import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from segmill.llm import byte_level, byte_pieces
from segmill.llm.common import Kept

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = byte_pieces.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
TEXTS = ["", " ", "   x  y ", "it's 12 o'clock\r\n\n x", "word " * 3000, "x" * 4000, " " * 5000 + "a", "日本語 \U0001f642\U0001f642", "<|endoftext|>", "\x00\n\t\x1c\x85", "f²..²x", "⁇ ▁ Ġ"]


@pytest.fixture(scope="module")
def coder():
    return byte_pieces.RankedBytes(RANKS)


def test_pattern_is_the_vocabularys():
    assert byte_level.PATTERN == public_tokenizers.PATTERN


@pytest.mark.parametrize("text", TEXTS)
def test_texts(coder, text):
    assert coder.encode(text) == LIBRARY.encode_ordinary(text)
    assert coder.decode(coder.encode(text)) == text.encode()


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" abcdeinrst.,'²1\n\té日"), st.characters(codec="utf-8")), max_size=60))
def test_any_text(text):
    coder = byte_pieces.coder_of(PATH)
    assert coder.encode(text) == LIBRARY.encode_ordinary(text)


def test_every_character_is_split_and_encoded_alike(coder):
    for first in range(0, 0x110000, 256):
        text = "".join(f"a{chr(i)}{chr(i)} {chr(i)}1" for i in range(first, first + 256, 101) if not 0xD800 <= i < 0xE000)
        assert coder.encode(text) == LIBRARY.encode_ordinary(text)


def test_tokens_that_no_merge_reaches():
    """A match that is a token is that token; within a longer match only merges count."""
    ranks = {bytes([b]): b for b in range(256)} | {b"abc": 256, b"xy": 300}
    ours, library = byte_pieces.RankedBytes(ranks), tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for text in ("abc", "abcd", "xyxy abc", "axyb"):
        assert ours.encode(text) == library.encode_ordinary(text)
    assert ours.encode("abc xy") == [256, 32, 300]


def test_documents(spark, make_docs):
    rows = [(1, None), (None, "a b"), *((10 + i, t) for i, t in enumerate(TEXTS)), (10, ""), (10, "")]
    docs = make_docs(rows)

    def digest(text):
        ids = LIBRARY.encode_ordinary(text or "")
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()

    got = sorted(((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_pieces.digest_documents(docs, PATH).collect()), key=str)
    assert got == sorted(((d, *digest(t)) for d, t in rows), key=str)
    coded = byte_pieces.encode_documents(docs, PATH)
    assert sorted((str(r.doc_id), list(r.ids)) for r in coded.collect()) == sorted((str(d), LIBRARY.encode_ordinary(t or "")) for d, t in rows)
    assert sorted((str(r.doc_id), bytes(r.decoded)) for r in byte_pieces.decode_documents(coded, PATH).collect()) == sorted((str(d), (t or "").encode()) for d, t in rows)
    assert byte_pieces.digest_documents(make_docs([]), PATH).count() == 0


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in byte_pieces.digest_documents(docs, PATH).collect()}
    for r in docs.collect():
        ids = LIBRARY.encode_ordinary(r.text)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())


def test_long_texts_in_parts(coder, monkeypatch):
    text = "ab1 c  d\n" * 400
    want, whole = list(coder.digests([text, "x y"])), coder.encode(text)
    monkeypatch.setattr(byte_pieces, "TOGETHER", 100)
    monkeypatch.setattr(byte_level, "WORDS", 50)
    assert coder.encode(text) == whole and list(coder.digests([text, "x y"])) == want


def test_bad_vocabularies_raise():
    with pytest.raises(ValueError, match="no token for the bytes"):
        byte_pieces.RankedBytes({b"a": 0})
    with pytest.raises(ValueError, match="must differ"):
        byte_pieces.RankedBytes({bytes([b]): b for b in range(256)} | {b"ab": 3})


def test_table_is_bounded_in_bytes():
    kept = Kept(100_000)
    kept.keep({f"{i}" + "x" * 100_000: "1" for i in range(100)})
    assert not kept
    size = lambda d: sum(104 + sys.getsizeof(k) + sys.getsizeof(v) for k, v in d.items())
    for i in range(10_000):
        assert i == 0 or not kept.unknown({"hot"})  # what is asked for again and again stays
        kept.keep({f"w{i}": "1,2", "hot": "3"})
        if i % 500 == 0:
            assert size(kept) + size(kept.older) < 101_000 and kept.bytes == size(kept)
    assert kept.unknown({"w9999", "w0", "hot"}) == {"w0"} and kept["w9999"] == "1,2"
