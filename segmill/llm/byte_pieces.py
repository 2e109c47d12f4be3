"""Byte-level BPE by ranks, with a sentencepiece model that is written from the vocabulary.

The model's pieces are the tokens with each byte as a visible character, in the order of their ranks and with the negative rank
as score, so the best pair to merge is the one of the lowest rank; its normalisation is the identity. Nothing is trained. A text
is split by the vocabulary's pattern, and each match that a worker hasn't met is encoded by the library, many in one call of an
Arrow batch; a match that is a token itself is that token, whether merges lead to it or not. Ids are decoded by the inverse
mapping, and every match is checked to decode to itself. What was encoded is kept in a table of each worker, bounded in bytes.

Texts of any length are split and hashed part by part. Null and empty texts have no ids. Repeated rows and null doc_ids stay,
extra columns are ignored, an empty table gives an empty result. A vocabulary without all 256 bytes raises.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterable, Iterator, Mapping
from pathlib import Path

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from segmill.llm.byte_level import PATTERN, visible, words_of
from segmill.llm.common import Kept, resident, slices

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

# Numbers of fields and kinds in the format of sentencepiece models.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
TEXT, SCORE, KIND = 1, 2, 3
NORMAL, UNKNOWN = 1, 2
MODEL_TYPE, VOCAB_SIZE, BPE = 3, 4, 2
NAME, DUMMY_PREFIX, REMOVE_SPACES, ESCAPE_SPACES = 1, 3, 4, 5
#: The piece for what is unknown; no byte stands for its character.
UNKNOWN_PIECE = "⁇"
#: Characters of neighbouring texts whose new words are learned together.
TOGETHER = 1 << 18
#: Bytes of the table of words.
KEPT_WORDS = 224 << 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ranks of a file with a token in base64 and its rank in each line."""
    lines = (line.split() for line in Path(path).read_bytes().splitlines())
    return {base64.b64decode(line[0]): int(line[1]) for line in lines if line}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def _number(field: int, value: int) -> bytes:
    return _varint(field << 3) + _varint(value)


def _block(field: int, content: bytes) -> bytes:
    return _varint(field << 3 | 2) + _varint(len(content)) + content


def serialise(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model with a piece for each token, in the order of ranks, and one for what is unknown."""
    tokens = sorted(ranks, key=ranks.__getitem__)

    def piece(text: str, score: int, kind: int) -> bytes:
        return _block(PIECES, _block(TEXT, text.encode()) + _varint(SCORE << 3 | 5) + struct.pack("<f", score) + _number(KIND, kind))

    pieces = [piece(visible(t), -ranks[t], NORMAL) for t in tokens]
    trainer = _number(MODEL_TYPE, BPE) + _number(VOCAB_SIZE, len(tokens) + 1)
    identity = _block(NAME, b"identity") + _number(DUMMY_PREFIX, 0) + _number(REMOVE_SPACES, 0) + _number(ESCAPE_SPACES, 0)
    return b"".join([*pieces, piece(UNKNOWN_PIECE, 0, UNKNOWN), _block(TRAINER, trainer), _block(NORMALIZER, identity)])


class RankedBytes:
    """encode and decode by ranks; the ids of a match of the pattern are kept as decimal numbers joined by commas."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        lacking = [b for b in range(256) if bytes([b]) not in ranks]
        if lacking:
            raise ValueError(f"no token for the bytes {lacking}")
        if len(set(ranks.values())) < len(ranks) or max(ranks.values()) >= 1 << 24:
            raise ValueError("ranks must differ and be below 2^24, as scores are floats")
        self.ranks, self.pattern = ranks, pattern
        self.library = sentencepiece.SentencePieceProcessor(model_proto=serialise(ranks))
        #: Ids of the model's pieces, as text.
        self.id_of = [str(r) for r in sorted(ranks.values())]
        self.bytes_of = {str(r): t for t, r in ranks.items()}
        self.known: Kept[str] = Kept(KEPT_WORDS)

    def _ids(self, words: set[str]) -> Mapping[str, str]:
        """Ids of words, of which the new ones go to the library in one call."""
        new = self.known.unknown(words)
        if not new:
            return self.known
        found = {w: self.known[w] for w in words if w not in new}
        raw = {w: w.encode() for w in new}
        split = [w for w in new if raw[w] not in self.ranks]
        found.update((w, str(self.ranks[raw[w]])) for w in new.difference(split))
        for w, pieces in zip(split, self.library.encode([visible(raw[w]) for w in split], num_threads=1) if split else [], strict=True):
            ids = [self.id_of[i] for i in pieces]
            if b"".join([self.bytes_of[i] for i in ids]) != raw[w]:
                raise ValueError(f"{w!r} doesn't decode to itself")
            found[w] = ",".join(ids)
        self.known.keep({w: found[w] for w in new})
        return found

    def coded(self, texts: Iterable[str]) -> Iterator[Iterator[str]]:
        """Of each text its ids, joined by commas, in parts. What is new in neighbouring texts is learned together."""
        held: list[list[str]] = []
        size = 0

        def done() -> Iterator[Iterator[str]]:
            ids = self._ids({w for words in held for w in words})
            for words in held:
                yield iter([",".join(map(ids.__getitem__, words))])

        for text in texts:
            if len(text) > TOGETHER:
                yield from done()
                held, size = [], 0
                yield (",".join(map(self._ids(set(words)).__getitem__, words)) for words in words_of(text, self.pattern))
                continue
            held.append([w for words in words_of(text, self.pattern) for w in words])
            size += len(text)
            if size > TOGETHER:
                yield from done()
                held, size = [], 0
        yield from done()

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str]) -> Iterator[list[int]]:
        for parts in self.coded(texts):
            yield [int(i) for part in parts if part for i in part.split(",")]

    def decode(self, ids: Iterable[int | str]) -> bytes:
        return b"".join([self.bytes_of[str(i)] for i in ids])

    def digests(self, texts: Iterable[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text the number of ids, and digests of the ids joined by commas and of the bytes decoded from them."""
        for parts in self.coded(texts):
            n, of_ids, of_bytes = 0, hashlib.sha256(), hashlib.sha256()
            for part in filter(None, parts):
                ids = part.split(",")
                of_ids.update(("," if n else "").encode() + part.encode())
                of_bytes.update(b"".join(map(self.bytes_of.__getitem__, ids)))
                n += len(ids)
            yield n, of_ids.hexdigest(), of_bytes.hexdigest()


def coder_of(path: str, pattern: str = PATTERN) -> RankedBytes:
    """One for each file and worker process."""
    return resident(("ranks", path, pattern), lambda: RankedBytes(read_ranks(path), pattern))


def encode_documents(docs: DataFrame, ranks: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id and ids (array<int>)."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(ranks, pattern)
        for batch in slices(batches):
            ids = list(coder.encode_all(t or "" for t in batch.column(1).to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(encode, "doc_id long, ids array<int>")


def decode_documents(coded: DataFrame, ranks: str) -> DataFrame:
    """doc_id and decoded (binary; ids may end within a character) of doc_id and ids. Null ids have no bytes; an id without a
    token raises."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(ranks)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([coder.decode(ids or ()) for ids in batch.column(1).to_pylist()], pa.binary())], names=["doc_id", "decoded"])

    return coded.selectExpr("cast(doc_id as long) doc_id", "ids").mapInArrow(decode, "doc_id long, decoded binary")


def digest_documents(docs: DataFrame, ranks: str, pattern: str = PATTERN) -> DataFrame:
    """doc_id, number of ids, and digests of the ids and of the bytes decoded from them, without shipping either."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(ranks, pattern)
        for batch in slices(batches):
            n, ids, decoded = zip(*coder.digests(t or "" for t in batch.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(digest, DIGESTS)
