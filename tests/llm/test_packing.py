import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from segmill.llm import byte_level, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sdé²½Ⅷ١_,.<|>x0\x1c\x85  ß日"), st.characters(codec="utf-8")), max_size=40))
def test_word_tokens_are_the_library_s(text):
    for t in (text, text + "<|endoftext|>" + text):
        assert np.frombuffer(packing.word_tokenizer(PATH).encode(t), "<u4").tolist() == ids_of(t)[:-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sdmtrevlé²½Ⅷ١_,.<|>x0\x1c\x85\u2003\U0001f600ß日"), st.characters(codec="utf-8")), max_size=30), st.just(" <|endoftext|>'s"))), st.sampled_from([1, 7, 40, 1 << 22]))
def test_neighbouring_texts_are_encoded_apart(texts, at_once):
    """Many texts in one array, parts of any size, and an array that is a slice."""
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(packing, "PART_BYTES", at_once)
        found = packing.word_tokenizer(PATH).encode_all(pa.array(["'s no part é", *texts, "nor 're"]).slice(1, len(texts)))
    assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == [ids_of(t)[:-1] for t in texts]


def test_kinds_of_characters_are_the_pattern_s():
    found = byte_level.kinds(21)
    for kind, pattern in ((byte_level.LETTER, r"\p{L}"), (byte_level.DIGIT, r"\p{N}"), (byte_level.SPACE, r"\s")):
        own = regex.compile(pattern)
        assert all(bool(own.match(chr(c))) == (found[c] == kind) for c in range(0x30000))
    assert (byte_level.kinds(8) == found[:256]).all()


def test_words_of_neighbouring_texts_are_looked_up_once(monkeypatch):
    """Seconds a GB: new words go to the library in few calls, and a word that repeats in neighbouring texts is learned once."""
    coder, asked = packing.WordTokenizer(PATH), []
    own = coder._model_ids
    monkeypatch.setattr(coder, "_model_ids", lambda words: asked.append(words) or own(words))
    texts = [f"new{i}a words{i % 7}b for each text, and 's old ones " * 5 for i in range(100)]
    found = coder.encode_all(pa.array(texts))
    assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == [ids_of(t)[:-1] for t in texts]
    words = [w for some in asked for w in some]
    assert len(asked) == 1 and len(set(words)) == len(words) and b" words" in words


def test_tables_of_words_are_bounded_in_bytes():
    """Long words, as of web data in base64, are encoded and not kept."""
    coder = packing.WordTokenizer(PATH)
    coder.ids.most = 300_000
    for i in range(20):
        text = "".join(chr(97 + (i * j * j + j) % 26) for j in range(30_000)) + f" w{i} "
        assert np.frombuffer(coder.encode(text), "<u4").tolist() == ids_of(text)[:-1]
    assert all(len(w) <= 64 for w in coder.ids) and coder.ids.bytes < 300_000
    many = " ".join(f"{i:x}" for i in range(20_000))
    assert np.frombuffer(coder.encode(many), "<u4").tolist() == ids_of(many)[:-1] and coder.ids.bytes <= 300_000


def test_long_texts_in_parts(monkeypatch):
    coder, text = packing.WordTokenizer(PATH), "ab1  c d\n" * 300
    whole = coder.encode(text)
    monkeypatch.setattr(byte_level, "WORDS", 50)
    assert coder.encode(text) == whole


@given(st.lists(st.integers(1, 64), max_size=200))
def test_tree_is_first_fit(lengths):
    lengths = sorted(lengths, reverse=True)
    where, offset = packing.first_fit_decreasing(np.array(lengths, np.int64), 64)
    bins = []
    for n, w, o in zip(lengths, where, offset, strict=True):
        i = next((i for i, used in enumerate(bins) if used + n <= 64), len(bins))
        if i == len(bins):
            bins.append(0)
        assert (w, o) == (i, bins[i])
        bins[i] += n


@pytest.mark.parametrize("group_docs", [3, 4096])
def test_packing(spark, make_docs, group_docs):
    rows = [(1, None), (2, ""), (2, ""), (None, "a b"), (3, "word " * 5000), (4, "same text"), (4, "same text"), *((10 + i, "x y " * (i * 37 % 400)) for i in range(30))]
    got = packing.pack_documents(make_docs(rows), PATH, group_docs=group_docs).collect()
    want = defaultdict(int)
    for doc, text in rows:
        ids = ids_of(text)
        for i in range(0, len(ids), 2048):
            part = ids[i : i + 2048]
            want[doc, i, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), len(ids)] += 1
    seen = defaultdict(int)
    sequences = defaultdict(list)
    for r in got:
        seen[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
        sequences[r.sequence_id].append(r)
    assert seen == want
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 2048 and all(r.sequence_tokens == at for r in parts)
        assert {r.padded_to for r in parts} == {at if at & (at - 1) == 0 else 2048}


def test_little_padding(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = packing.pack_documents(docs, PATH).select("sequence_id", "sequence_tokens").distinct().collect()
    assert sum(r.sequence_tokens for r in got) / (2048 * len(got)) > 0.98


def test_empty_table(spark, make_docs):
    assert packing.pack_documents(make_docs([]), PATH).count() == 0


def test_groups_are_of_pieces(spark, monkeypatch):
    """Long documents make no group larger; their full pieces are sequences of their own."""
    rows = [(d, 8 * i, 8 if i < 300 else 5, 1, 2405) for d in range(40) for i in range(301)]
    packed = packing.pack(spark.createDataFrame(rows, packing.PIECES), length=8, group_docs=4).collect()
    assert sorted((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packed) == sorted(rows)
    full = [r for r in packed if r.length == 8]
    assert len({r.sequence_id for r in full}) == len(full) == 12000 and all(r.sequence_tokens == 8 and r.offset == 0 for r in full)
    sizes = {}
    for r in packed:
        if r.length < 8:
            sizes[r.sequence_id >> 33] = sizes.get(r.sequence_id >> 33, 0) + 1
    assert not {r.sequence_id for r in full} & {r.sequence_id for r in packed if r.length < 8}
    assert sum(sizes.values()) == 40 and 4 < len(sizes) <= 10 and max(sizes.values()) < 14


def test_order_of_rows_does_not_matter(spark, make_docs):
    """The same groups, whatever order and partitions the rows come in."""
    rows = [(i, "x y " * (i * 37 % 900)) for i in range(60)]
    one = packing.pack_documents(make_docs(rows), PATH, group_docs=8)
    two = packing.pack_documents(make_docs(rows[::-1]).repartition(7), PATH, group_docs=8)
    assert sorted(map(tuple, one.where("length < 2048").collect())) == sorted(map(tuple, two.where("length < 2048").collect()))


@pytest.mark.parametrize("at_once", [7, 1 << 16])
def test_repeated_rows_fill_no_group(spark, monkeypatch, at_once):
    """A row that stands a thousand times is dealt to all groups, and none of its copies is lost."""
    monkeypatch.setattr(packing, "COPIES", at_once)
    rows = [(None, 0, 1, 5, 1)] * 1000 + [(d, 0, 5, 1, 5) for d in range(500)]
    packed = packing.pack(spark.createDataFrame(rows, packing.PIECES), length=8, group_docs=50).collect()
    key = lambda r: (r[0] is not None, r[0] or 0)
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in packed), key=key) == sorted(rows, key=key)
    sizes = {}
    for r in packed:
        sizes[r.sequence_id >> 33] = sizes.get(r.sequence_id >> 33, 0) + 1
    assert len(sizes) == 30 and max(sizes.values()) < 100
