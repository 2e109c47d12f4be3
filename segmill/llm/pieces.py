"""Encoding and decoding with a merge-type SentencePiece vocabulary.

The encoder keeps an agenda of adjacent symbol pairs that are pieces, ordered by score, then from the left, and merges
the best pair until none is left; symbols that are no pieces become bytes. Many new units have their agendas side by side, as
the rows of an array. Two exact cuts keep the work small. No piece
of such a vocabulary has a space after another character, so a text is cut before each run of spaces. A pair of
characters that stands in no piece is never merged across, so a unit is cut there too. A unit is encoded once and
kept in a table of each Python worker that is bounded in bytes. A long text's units are made part by part.

Every unit that is encoded is checked against the sentencepiece library, both its ids and what they decode to, by one call
for many texts; a difference raises.
Texts whose normalisation isn't the identity are not supported: the model must have an identity normaliser.

Null and empty texts have no ids. Extra columns are ignored, repeated rows stay, an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import sys
from collections.abc import Iterable, Iterator, Mapping
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from segmill.llm.common import Kept, resident, slices

SPACE = "▁"
#: Units of a text that are held at once, and characters of neighbouring texts whose new units are learned together.
UNITS, TOGETHER = 1 << 16, 1 << 21
#: Bytes of the table of units, which are dear to encode.
KEPT_UNITS = 224 << 20
#: A longer part has its agenda in a heap.
SHORT = 48
#: At least as many new units have their agendas in arrays, but for longer ones than LONGEST_ROW.
TOGETHER_ROWS, LONGEST_ROW = 32, 64
NONE = float("-inf")

DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class MergeVocabulary:
    """The pieces of a model file, and the agenda."""

    def __init__(self, path: str, check: bool = True) -> None:
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.check = check
        lib = self.library
        count = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(count)]
        self.byte_ids = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}
        plain = [i for i in range(count) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.decimal = [str(i) for i in range(count)]
        #: The text of ids; None for bytes.
        self.text_of = [None if i in self.byte_of else p.replace(SPACE, " ") for i, p in enumerate(self.pieces)]
        #: Of ids in decimal: their text; a byte above 127 is a surrogate that stands for it.
        self.escaped = {str(i): bytes([self.byte_of[i]]).decode(errors="surrogateescape") if t is None else t for i, t in enumerate(self.text_of)}
        self.score = {self.pieces[i]: lib.get_score(i) for i in plain}
        self.joined = {a + b for p in self.ids for a, b in zip(p, p[1:], strict=False)}
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("a piece has a space after another character")
        self.letter, self.unit = self._units()
        self._arrays()
        #: Of units: ids joined by commas.
        self.units: Kept[str] = Kept(KEPT_UNITS)

    def _units(self) -> tuple[re.Pattern, re.Pattern]:
        """What counts as a letter, and the pattern of a unit. No piece joins a letter and another character than a
        space; characters that would break this aren't letters here."""
        letter = re.compile(r"[^\W\d_]")
        mixed = [ab for ab in self.joined if SPACE not in ab and bool(letter.match(ab[0])) != bool(letter.match(ab[1]))]
        odd = "".join(map(re.escape, sorted({c for ab in mixed for c in ab if letter.match(c)})))
        letter = re.compile(rf"[^\W\d_{odd}]")
        #: With these in a text, what isalpha() says is a letter may be none here.
        self.no_words = re.compile(rf"[{odd}]") if odd else re.compile("(?!)")
        if any(SPACE not in ab and bool(letter.match(ab[0])) != bool(letter.match(ab[1])) for ab in self.joined):
            self.no_words = re.compile("")
            return letter, re.compile(" *[^ ]+| +")
        return letter, re.compile(rf" *[^\W\d_{odd}]+| *(?:[\W\d_{odd}](?<! ))+| +")

    def _arrays(self) -> None:
        """What merge_rows looks up: ids of characters; pairs of ids that make a piece, ascending, and its id; scores. -1 is none."""
        self.id_of_char = np.full(sys.maxunicode + 1, -1, np.int64)
        for p, i in self.ids.items():
            if len(p) == 1:
                self.id_of_char[ord(p)] = i
        pairs = sorted((self._pair(self.ids[a], self.ids[b]), i) for p, i in self.ids.items() for k in range(1, len(p)) if (a := p[:k]) in self.ids and (b := p[k:]) in self.ids)
        # the last one is above all pairs, so that a place to the right of each pair exists
        self.pairs = np.array([*(pair for pair, _ in pairs), np.iinfo(np.int64).max], np.int64)
        self.pair_ids = np.array([*(i for _, i in pairs), -1], np.int64)
        self.scores = np.array([*(self.score.get(p, NONE) for p in self.pieces), NONE])

    def _pair(self, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | int:
        return a * len(self.pieces) + b

    def _joint(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ids of the pieces that pairs of ids make."""
        pair = self._pair(a, b)
        at = np.searchsorted(self.pairs, pair)
        return np.where(self.pairs[at] == pair, self.pair_ids[at], -1)

    def merge_rows(self, symbols: np.ndarray) -> Iterator[tuple[list[int], list[list[int]]]]:
        """Ids of units with equal numbers of symbols, a row for each: numbers of rows that are done, and their ids. The agenda of a
        unit is a row of the ids that its pairs would have; each step merges the first of the best pairs of every row."""
        number = np.arange(len(symbols))
        joint = self._joint(symbols[:, :-1], symbols[:, 1:])
        score = self.scores[joint]
        while len(number):
            if not joint.shape[1]:
                yield number.tolist(), symbols.tolist()
                return
            rows = np.arange(len(number))
            best = score.argmax(axis=1)
            more = score[rows, best] > NONE
            if not more.all():
                yield number[~more].tolist(), symbols[~more].tolist()
                number, symbols, joint, score, best = number[more], symbols[more], joint[more], score[more], best[more]
                rows = rows[: len(number)]
            n, width = symbols.shape
            symbols[rows, best] = joint[rows, best]
            kept = np.ones(symbols.shape, bool)
            kept[rows, best + 1] = False
            symbols = symbols[kept].reshape(n, width - 1)
            kept = np.ones(joint.shape, bool)
            kept[rows, best] = False
            joint, score = joint[kept].reshape(n, width - 2), score[kept].reshape(n, width - 2)
            for those, place in ((best > 0, best - 1), (best < width - 2, best)):
                r, c = rows[those], place[those]
                joint[r, c] = made = self._joint(symbols[r, c], symbols[r, c + 1])
                score[r, c] = self.scores[made]

    def encode_units(self, units: list[str]) -> list[list[int]]:
        if len(units) < TOGETHER_ROWS:
            return [self.encode_unit(u) for u in units]
        ids: list[list[int]] = [[]] * len(units)
        of_length: dict[int, list[int]] = {}
        for i, u in enumerate(units):
            of_length.setdefault(len(u), []).append(i)
        for length, those in of_length.items():
            alone = those
            if 0 < length <= LONGEST_ROW:
                chars = np.frombuffer("".join([units[i] for i in those]).encode("utf-32-le"), np.uint32).reshape(-1, length)
                symbols = self.id_of_char[chars]
                known = (symbols >= 0).all(axis=1)
                at, alone = np.array(those)[known], np.array(those)[~known].tolist()
                for done, found in self.merge_rows(symbols[known]):
                    for i, row in zip(at[done].tolist(), found, strict=True):
                        ids[i] = row
            for i in alone:  # long, or with characters that become bytes
                ids[i] = self.encode_unit(units[i])
        return ids

    def merge(self, text: str) -> list[int]:
        """Ids of `text`, whose spaces are SPACE already."""
        ids: list[int] = []
        for s in self._merge_short(list(text)) if len(text) <= SHORT else self._merge_long(list(text)):
            known = self.ids.get(s)
            ids += [known] if known is not None else [self.byte_ids[b] for b in s.encode()]
        return ids

    def _merge_short(self, symbols: list[str]) -> list[str]:
        """The agenda is a list in the order of the text; the first of the best entries is taken."""
        score = self.score
        agenda = [score.get(a + b, NONE) for a, b in zip(symbols, symbols[1:], strict=False)]
        while agenda and (best := max(agenda)) > NONE:
            i = agenda.index(best)
            symbols[i] += symbols.pop(i + 1)
            del agenda[i]
            if i:
                agenda[i - 1] = score.get(symbols[i - 1] + symbols[i], NONE)
            if i < len(agenda):
                agenda[i] = score.get(symbols[i] + symbols[i + 1], NONE)
        return symbols

    def _merge_long(self, symbols: list[str]) -> list[str]:
        """The agenda is a heap, whose entries can be out of date."""
        left, right = list(range(-1, len(symbols) - 1)), [*range(1, len(symbols)), -1]
        agenda: list[tuple[float, int, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j >= 0 and (s := self.score.get(both := symbols[i] + symbols[j])) is not None:
                heapq.heappush(agenda, (-s, i, j, both))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while agenda:
            _, i, j, both = heapq.heappop(agenda)
            if right[i] != j or not symbols[i] or symbols[i] + symbols[j] != both:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = both, ""
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            offer(left[i], i)
            offer(i, right[i])
        return [s for s in symbols if s]

    def encode_unit(self, unit: str) -> list[int]:
        if len(unit) <= SHORT:
            return self.merge(unit)
        ids: list[int] = []
        start = 0
        for i in range(1, len(unit)):
            if unit[i - 1] + unit[i] not in self.joined:
                ids += self.merge(unit[start:i])
                start = i
        return ids + self.merge(unit[start:])

    def decode_ids(self, ids: list[int]) -> str:
        """The text of ids, with the leading space that encoding puts first."""
        try:
            return "".join(map(self.text_of.__getitem__, ids))
        except TypeError:  # bytes
            pass
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                raw.append(b)
                continue
            if raw:
                out.append(raw.decode(errors="replace"))
                raw.clear()
            out.append(self.pieces[i])
        out.append(raw.decode(errors="replace"))
        return "".join(out).replace(SPACE, " ")

    def split(self, text: str) -> Iterator[list[str]]:
        """Units of a text, UNITS at a time: a run of spaces, which SPACE is too, and what follows up to the next."""
        text = text.replace(SPACE, " ")
        if len(text) <= UNITS:
            yield self._split_words(text) if not (text and self.no_words.search(text)) else self.unit.findall(" " + text)
            return
        found = (m[0] for m in self.unit.finditer(" " + text))
        while units := list(islice(found, UNITS)):
            yield units

    def _split_words(self, text: str) -> list[str]:
        """The same units of a text without odd letters; words of letters are units as they are."""
        units: list[str] = []
        before = " "
        for word in text.split(" ") if text else []:
            if word.isalpha():
                units.append(before + word)
            elif word:
                units += self.unit.findall(before + word)
            else:
                before += " "
                continue
            before = " "
        if len(before) > 1:
            units.append(before[1:])
        return units

    def learn(self, units: set[str]) -> Mapping[str, str]:
        """Ids joined by commas of each unit; new ones are checked. A unit must decode to itself."""
        new = list(self.units.unknown(units))
        if not new:
            return self.units
        coded = self.encode_units([u.replace(" ", SPACE) for u in new])
        if self.check:
            # behind a character of the other kind, with which a unit never merges
            before = ["(" if self.letter.match(u) else "a" for u in new]
            skip = {b: len(self.encode_unit(SPACE + b)) for b in "(a"}
            plain = [b + u for b, u in zip(before, new, strict=True)]
            rights = self.library.encode(plain, num_threads=1)
            for u, ids, b, right in zip(new, coded, before, rights, strict=True):
                if ids != right[skip[b] :]:
                    raise ValueError(f"{u!r}: {ids}, but the library gives {right[skip[b] :]}")
            # one after another, as the units of a text are
            texts = [b + self.decode_ids(ids) for b, ids in zip(before, coded, strict=True)]
            if texts != plain or " ".join(texts) != self.library.decode(list(chain.from_iterable(rights))):
                raise ValueError(f"the library decodes one of {new} otherwise")
        fresh = {u: ",".join(map(self.decimal.__getitem__, ids)) for u, ids in zip(new, coded, strict=True)}
        known = {u: fresh[u] if u in fresh else self.units[u] for u in units}
        self.units.keep(fresh)
        return known

    def coded(self, texts: Iterable[str]) -> Iterator[Iterator[str]]:
        """Of each text its ids, joined by commas, in parts. What is new in neighbouring texts is learned together."""
        held: list[list[str]] = []
        size = 0

        def done() -> Iterator[Iterator[str]]:
            ids = self.learn(set().union(*held))
            for units in held:
                yield iter([",".join(map(ids.__getitem__, units))])

        for text in texts:
            if len(text) > TOGETHER:
                yield from done()
                held, size = [], 0
                yield (",".join(map(self.learn(set(units)).__getitem__, units)) for units in self.split(text))
                continue
            held.append([u for units in self.split(text) for u in units])
            size += len(text)
            if size > TOGETHER:
                yield from done()
                held, size = [], 0
        yield from done()

    def encode(self, text: str) -> list[int]:
        return [int(i) for parts in self.coded([text]) for part in parts if part for i in part.split(",")]

    def digests(self, texts: Iterable[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text the number of ids, and digests of the ids joined by commas and of the text decoded from them."""
        for parts in self.coded(texts):
            n, of_ids, of_text = 0, hashlib.sha256(), hashlib.sha256()
            for part in filter(None, parts):
                of_ids.update(("," if n else "").encode() + part.encode())
                # a unit is whole in its part, and so are the bytes of a character
                of_text.update(self.decode_joined(part, first=not n).encode())
                n += part.count(",") + 1
            yield n, of_ids.hexdigest(), of_text.hexdigest()

    def decode_joined(self, ids: str, first: bool = True) -> str:
        """decode() of ids joined by commas; first: whether they begin a text, whose leading space goes."""
        # a piece begins with a character, so bytes before it that end within one stay apart from it
        text = "".join(map(self.escaped.__getitem__, ids.split(","))) if ids else ""
        if not text.isascii():
            text = text.encode(errors="surrogateescape").decode(errors="replace")
        return text[1:] if first and text.startswith(" ") else text

    def decode(self, ids: list[int]) -> str:
        text = self.decode_ids(ids)
        return text[1:] if text.startswith(" ") else text


def vocabulary(path: str, check: bool = True) -> MergeVocabulary:
    """One for each file and worker process."""
    return resident(("pieces", path, check), lambda: MergeVocabulary(path, check))


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids (array<int>) and the text decoded from them."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(model)
        for batch in slices(batches):
            ids = [coder.encode(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(map(coder.decode, ids), pa.string())], names=["doc_id", "ids", "decoded"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(encode, "doc_id long, ids array<int>, decoded string")


def digest_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, number of ids, and digests of the ids and of the text decoded from them, without shipping either."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = vocabulary(model)
        for batch in filter(len, batches):
            n, ids, decoded = zip(*coder.digests(t.as_py() or "" for t in batch.column(1)), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(digest, DIGESTS)
