"""Packing of tokenised documents into training sequences.

A document's ids are those of a `tokenizers` file, then an end id. They are cut every `length` ids, so that all pieces
but the last fill a sequence; these need no packing and are sequences at once. What is left of each document is one piece at
most. Documents are dealt to randomised groups by a hash of their id and ids, so a task that runs again deals them alike, and
first-fit decreasing packs each group by itself; a tournament tree over the free room of its bins finds the first bin that fits
in log time. A group has `group_docs` pieces on average, whatever the number and length of the documents. Rows that repeat both
id and text are counted first and then told apart by a number, which is part of the hash, so they don't crowd one group.

A word (a match of the tokenizer's own splitting pattern) is encoded by the library once and its ids are then kept, in a
table of each Python worker that is bounded in bytes. Words are found in the bytes of an Arrow column, part by part: array operations
on the kinds of its characters give the places where they start, and each unlike word of a part is looked up once.

Nulls and empty texts are a document of one id, the end id. Null doc_ids and repeated rows are packed like any other
row. Extra columns are ignored. An empty table gives an empty result. A sequence is padded to `length`, unless its size is a
power of two; then it isn't padded.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from tokenizers.pre_tokenizers import Split

from segmill.llm.byte_level import SPLIT, visible_lines, word_starts
from segmill.llm.common import Kept, materialise, resident, slices

SEED = 17
#: Bytes of the table of words.
KEPT_WORDS = 160 << 20
#: Bytes of texts that are split at once.
PART_BYTES = 1 << 19
#: New words that the library is asked for at once.
ASKED_WORDS = 256
#: Numbers of repeated rows that are made at once.
COPIES = 1 << 16

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
PACKED = f"{PIECES}, sequence_id long, offset long, sequence_tokens long, padded_to long"


class WordTokenizer:
    """encode(text) gives the ids of a tokenizers file as little-endian unsigned 32-bit bytes, encode_all(texts) those of each."""

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = Split("\n", "removed")
        probe = " Aé\x00 b'll\n"
        if b"".join(self._model_ids([w.encode() for w in SPLIT.findall(probe)])) != np.array(self.library.encode(probe, add_special_tokens=False).ids, "<u4").tobytes():
            raise ValueError(f"{path} is no byte-level tokenizer")
        self.ids: Kept[bytes] = Kept(KEPT_WORDS)
        specials = {t.content.encode(): i for i, t in self.library.get_added_tokens_decoder().items()}
        self.special = {k: np.array([i], "<u4").tobytes() for k, i in specials.items()}
        self.at_special = re.compile(b"|".join(map(re.escape, sorted(specials, key=len, reverse=True)))) if specials else None

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text]))[0]

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """A null is an empty text."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        if edges[0] == edges[-1]:
            return [b""] * len(texts)
        raw = np.frombuffer(texts.buffers()[2], np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        found, counted, text_ids = [], 0, np.zeros(len(edges), np.int64)
        for start, end, starts in self._words(raw, edges):
            ids = self._ids_of(raw[start:end], np.append(starts, end) - start)
            before = np.frombuffer(ids.buffers()[1], np.int64)[ids.offset : ids.offset + len(ids) + 1]
            found.append(ids.buffers()[2].to_pybytes()[before[0] : before[-1]] if before[-1] else b"")
            here = slice(*np.searchsorted(edges, [start, end + (end == len(raw))]))
            text_ids[here] = counted + before[np.searchsorted(starts, edges[here])] - before[0]
            counted += len(found[-1])
        whole = memoryview(b"".join(found))
        return [bytes(whole[a:b]) for a, b in pairwise(text_ids.tolist())]

    def _words(self, raw: np.ndarray, edges: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """Parts of the texts, each with the places where its words start. A part ends with a word, and so may a long text."""
        spans = np.zeros((0, 2), np.int64)
        if self.at_special is not None:
            view = memoryview(raw)
            spans = np.array([m.span() for a, b in pairwise(edges.tolist()) for m in self.at_special.finditer(view, a, b)], np.int64).reshape(-1, 2)
        first = np.sort(np.append(edges, spans))
        start, size = 0, PART_BYTES
        while start < len(raw):
            end = min(start + size, len(raw))
            while end < len(raw) and raw[end] & 0xC0 == 0x80:
                end += 1
            starts, unsure = word_starts(raw[start:end], first[slice(*np.searchsorted(first, [start + 1, end]))] - start)
            if len(spans):
                # a special token is one word
                starts = starts[np.searchsorted(spans[:, 0], starts + start) == np.searchsorted(spans[:, 1], starts + start, "right")]
            if end < len(raw):
                starts = starts[starts < unsure]
                if len(starts) < 2:
                    size *= 2
                    continue
                starts, end = starts[:-1], start + int(starts[-1])
            yield start, end, starts + start
            start, size = end, PART_BYTES

    def _ids_of(self, raw: np.ndarray, edges: np.ndarray) -> pa.Array:
        """The ids of each word. Words that repeat are looked up once."""
        words = pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, [None, pa.py_buffer(edges), pa.py_buffer(raw)]).dictionary_encode()
        unlike = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        found = list(map(self.ids.get, unlike))
        if None in found:
            learned = self._learn({w for w, ids in zip(unlike, found, strict=True) if ids is None})
            found = [learned[w] if ids is None else ids for w, ids in zip(unlike, found, strict=True)]
        return pa.array(found, pa.large_binary()).take(words.indices)

    def _model_ids(self, words: list[bytes]) -> list[bytes]:
        """The model's ids of words that the splitting yields."""
        encoded = self.model.encode(visible_lines(words), add_special_tokens=False)
        ids = np.array(encoded.ids, "<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(np.array(encoded.word_ids, np.int64), minlength=len(words)))
        return [ids[a:b] for a, b in pairwise([0, *ends.tolist()])]

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        new = {w: self.special[w] for w in words if w in self.special}
        asked = list(self.ids.unknown(words - new.keys()))
        for i in range(0, len(asked), ASKED_WORDS):
            some = asked[i : i + ASKED_WORDS]
            new |= zip(some, self._model_ids(some), strict=True)
        found = {w: new[w] if w in new else self.ids[w] for w in words}
        self.ids.keep(new)
        return found


def word_tokenizer(path: str) -> WordTokenizer:
    """One for each file and worker process."""
    return resident(("words", path), lambda: WordTokenizer(path))


def pieces(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """Each document's ids in pieces of `length` and a shorter last one: doc_id, start, length, ids_crc32, doc_tokens."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = word_tokenizer(tokenizer), np.uint32(end_id).tobytes()
        for batch in slices(batches):
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), coder.encode_all(batch.column(1)), strict=True):
                ids += end
                n = len(ids) // 4
                rows += [(doc, i, min(length, n - i), zlib.crc32(ids[4 * i : 4 * (i + length)]), n) for i in range(0, n, length)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, PIECES)


class Bins:
    """Bins of equal size. The tree holds the most free room below each node; place() takes the first bin with room."""

    def __init__(self, count: int, size: int) -> None:
        self.leaves = 1 << max(0, count - 1).bit_length()
        self.room = [size] * (2 * self.leaves)

    def place(self, n: int) -> int:
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            at += room[at] < n
        room[at] -= n
        found = at - self.leaves
        while at > 1:
            at //= 2
            best = max(room[2 * at], room[2 * at + 1])
            if room[at] == best:
                break
            room[at] = best
        return found


def first_fit_decreasing(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset there of each piece; the lengths must be in descending order and at most `size`."""
    bins, used = Bins(len(lengths), size), {}
    where, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, n in enumerate(lengths.tolist()):
        b = bins.place(n)
        where[i], offset[i] = b, used.get(b, 0)
        used[b] = used.get(b, 0) + n
    return where, offset


def pack(cut: DataFrame, length: int = 2048, group_docs: int = 4096) -> DataFrame:
    """Pieces with sequence_id and offset, the sequence's tokens and the size that it is padded to.

    cut is read twice and should be a table.
    """
    full, rest = cut.where(F.col("length") == length), cut.where(F.col("length") < length)
    groups = max(1, math.ceil(rest.count() / group_docs))

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        group, lengths = table.column("group_id")[0].as_py(), table.column("length").to_numpy()
        where, offset = first_fit_decreasing(lengths, length)
        tokens = np.bincount(where, lengths).astype(np.int64)[where]
        padded = np.where(tokens & (tokens - 1) == 0, tokens, length)
        table = table.drop_columns("group_id")
        for name, column in (("sequence_id", 2 * ((group << 32) + where)), ("offset", offset), ("sequence_tokens", tokens), ("padded_to", padded)):
            table = table.append_column(name, pa.array(column, pa.int64()))
        return table

    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    numbered = rest.groupBy(*own).agg(F.count("*").alias("copies"))
    numbered = numbered.select(*own, "copies", F.explode(F.expr(f"sequence(0L, (copies - 1) div {COPIES})")).alias("part"))
    numbered = numbered.select(*own, F.explode(F.expr(f"sequence(part * {COPIES}, least(copies, (part + 1) * {COPIES}) - 1)")).alias("copy"))
    document = F.xxhash64("doc_id", "doc_tokens", "start", "ids_crc32", "copy", F.lit(SEED))
    packed = numbered.select(*own, F.pmod(document, F.lit(groups)).alias("group_id")).groupBy("group_id").applyInArrow(fit, PACKED)
    # odd numbers, so that they don't meet those of packed sequences
    number, whole = 2 * F.monotonically_increasing_id() + 1, F.lit(length).cast("long")
    return packed.unionByName(full.select("*", number.alias("sequence_id"), F.lit(0).cast("long").alias("offset"), whole.alias("sequence_tokens"), whole.alias("padded_to")))


def pack_documents(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 1, group_docs: int = 4096) -> DataFrame:
    """Every document's pieces, packed."""
    return pack(materialise(pieces(docs, tokenizer, length, end_id), "pieces"), length, group_docs)
