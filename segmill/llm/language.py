"""Language identification of whole texts, mixed ones included.

Each word gets a score for each language: the log probability of its character n-grams and, for a short word, of itself,
learned from labelled texts. A word's script narrows the languages down to those that were seen in that script. Viterbi
over the words, with a penalty for each switch, labels spans; the text's language is the one with most letters, and the
score is its share of the letters.

The model is fitted on at most `limit` labelled rows with at most `chars` characters, those with the smallest hashes of their
ids, and keeps all n-grams of that sample, each with the languages that have it only. So its size is bounded by the sample,
whatever the number of languages and the size of the input, and it can be broadcast. The paths of
short texts are found together; a long text's is found alone, with a byte or less for each word and language.

A null text, or one without letters, is `und` with score 0. If nothing can be learned every text is `und`. Repeated rows
and null doc_ids each get a prediction; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import sys
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmill.llm.common import ENTRY_BYTES, KEPT_BYTES, fold, materialise, resident, slices

UNKNOWN = "und"
TRAIN_ROWS, TRAIN_CHARS = 20_000, 1 << 27
#: Scores that a worker keeps of words, beside the words themselves, which are bounded in bytes.
MAX_CELLS = 1 << 24
#: Words of a text whose path is searched in lists at once.
BLOCK = 1 << 16
#: Scores of words that are held for texts that take their steps together, and the fewest such texts.
HELD, TOGETHER = 1 << 21, 4
#: Longer words are not n-grams themselves.
SHORT_WORD = 6
SWITCH = 14.0
#: A language counts for a script if so large a part of its letters is in it.
SCRIPT_SHARE = 0.001
OUT_OF_SCRIPT = -40.0
WORDS = re.compile(r"[^\W\d_]+")
#: First code points of ranges, and scripts (fixed values; what lies between is "other").
SCRIPTS = [(0x41, "latin"), (0x250, "other"), (0x370, "greek"), (0x400, "cyrillic"), (0x530, "armenian"), (0x590, "hebrew"), (0x600, "arabic"), (0x780, "other"), (0x900, "devanagari"), (0x980, "other"), (0xE00, "thai"), (0xE80, "other"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"), (0xD7B0, "other")]
STARTS = [s for s, _ in SCRIPTS]


def script(char: str) -> str:
    i = bisect_right(STARTS, ord(char)) - 1
    return SCRIPTS[i][1] if i >= 0 else "other"


def grams(word: str) -> list[str]:
    padded = f"<{word}>"
    found = [padded[i : i + n] for n in (2, 3) for i in range(len(padded) - n + 1)]
    return [*word, *found, f"={word}"] if len(word) <= SHORT_WORD else [*word, *found]


@dataclass
class Model:
    languages: list[str]
    rows: dict[str, int]
    #: log probability, in each language, of an n-gram that none of its texts has
    unseen: np.ndarray
    #: of row i the languages of its n-gram, from starts[i] on and below starts[i + 1], and what each has above unseen
    starts: np.ndarray
    seen_in: np.ndarray
    above: np.ndarray
    scripts: dict[str, np.ndarray]

    def log_probabilities(self, gram: str) -> np.ndarray:
        found = self.unseen.copy()
        if (i := self.rows.get(gram)) is not None:
            part = slice(self.starts[i], self.starts[i + 1])
            found[self.seen_in[part]] += self.above[part]
        return found


def fit(docs: DataFrame, train: Column, limit: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Model:
    """Learn from text and lang where train holds and lang isn't null."""
    labelled = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = (F.xxhash64("doc_id"), "doc_id")
    some = labelled.groupBy("doc_id").agg(F.sum(F.length("text")).alias("chars")).orderBy(*order).limit(limit)
    # one of them at least, and then as many as have room
    before = F.coalesce(F.sum("chars").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    chosen = some.withColumn("before", before).where((F.col("before") == 0) | (F.col("before") + F.col("chars") <= chars)).select("doc_id")
    rows = labelled.join(F.broadcast(chosen), "doc_id", "left_semi").select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, Counter] = {}
        for batch in slices(batches):
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(WORDS.findall(text.lower()))
        for lang, counts in words.items():
            total: Counter = Counter()
            for word, n in counts.items():
                for g in grams(word):
                    total[g] += n
                total["#" + script(word[0])] += n * len(word)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total)), pa.array(list(total)), pa.array(list(total.values()), pa.int64())], names=["lang", "gram", "n"])

    counted = rows.mapInArrow(count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "grams")
    # as many rows as the sample has n-grams
    told = counted.toArrow()
    langs, names, n = (told.column(c).to_pylist() for c in ("lang", "gram", "n"))
    languages = sorted(set(langs))
    at = {lang: i for i, lang in enumerate(languages)}
    plain = [i for i, g in enumerate(names) if g[0] != "#" or len(g) == 1]
    known = {g: i for i, g in enumerate(sorted({names[i] for i in plain}))}
    seen: dict[str, np.ndarray] = {}
    for i in set(range(len(names))) - set(plain):
        seen.setdefault(names[i][1:], np.zeros(len(languages)))[at[langs[i]]] = n[i]
    letters = np.maximum(sum(seen.values(), np.zeros(len(languages))), 1)
    row, column = (np.array([x[y[i]] for i in plain], np.int64) for x, y in ((known, names), (at, langs)))
    count_of = np.array([n[i] for i in plain], np.float64)
    # an n-gram that no text of a language has counts half, and so does one that was never seen
    totals = np.bincount(column, count_of, len(languages)) + 0.5 * (len(known) + 1)
    by_row = np.lexsort((column, row))
    starts = np.searchsorted(row[by_row], np.arange(len(known) + 1))
    return Model(languages, known, np.log(0.5 / totals), starts, column[by_row].astype(np.int32), np.log(2 * count_of[by_row] + 1), {s: c / letters >= SCRIPT_SHARE for s, c in seen.items()})


def _number(gram: str) -> int:
    """One number for up to three characters."""
    return sum(ord(c) << 21 * i for i, c in enumerate(gram))


class Scorer:
    """Scores of words, kept in a bounded table of each worker."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._begin()
        # n-grams as sorted numbers with their rows; words are looked up by themselves
        numbered = sorted((_number(g), i) for g, i in model.rows.items() if g[0] != "=")
        self.numbers = np.array([n for n, _ in numbered] or [0], np.int64)
        self.rows = np.array([i for _, i in numbered] or [len(model.rows)], np.int64)

    def _begin(self) -> None:
        self.at: dict[str, int] = {}
        self.bytes = 0
        self.scores = np.zeros((1024, len(self.model.languages)), np.float32)
        self.letters = np.zeros(1024, np.int32)

    def _rows_of(self, numbers: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.numbers, numbers), len(self.numbers) - 1)
        return np.where(self.numbers[at] == numbers, self.rows[at], len(self.model.rows))

    def _sums(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The sum of the log probabilities of each word's n-grams, and the code points of first letters."""
        model, unknown, wide = self.model, len(self.model.rows), len(self.model.languages)
        sizes = np.fromiter(map(len, new), np.int64, len(new))
        codes = np.frombuffer("".join([f"<{w}>" for w in new]).encode("utf-32-le"), np.uint32).astype(np.int64)
        starts = np.cumsum(sizes + 2) - sizes - 2
        word = np.repeat(np.arange(len(new)), sizes + 2)
        place = np.arange(len(codes)) - starts[word]
        left = sizes[word] - place
        two = codes[:-1] | codes[1:] << 21
        three = two[:-1] | codes[2:] << 42
        short = np.flatnonzero(sizes <= SHORT_WORD)
        words, rows = [short], [np.array([model.rows.get("=" + new[i], unknown) for i in short], np.int64)]
        # single letters, and pairs and triples with the marks of both ends
        for numbers, inside in ((codes, (place > 0) & (left >= 0)), (two, left[:-1] >= 0), (three, left[:-2] > 0)):
            words.append(word[: len(numbers)][inside])
            rows.append(self._rows_of(numbers[inside]))
        words, rows = np.concatenate(words), np.concatenate(rows)
        found = np.bincount(words, minlength=len(new))[:, None] * model.unseen
        # the cells of all rows, one after another
        words, rows = words[rows < unknown], rows[rows < unknown]
        n = model.starts[rows + 1] - model.starts[rows]
        cells = np.arange(n.sum()) + np.repeat(model.starts[rows] - np.cumsum(n) + n, n)
        found += np.bincount(np.repeat(words, n) * wide + model.seen_in[cells], model.above[cells], len(new) * wide).reshape(len(new), wide)
        return found, codes[starts + 1]

    def index(self, words: list[str]) -> np.ndarray:
        try:
            return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))
        except KeyError:
            self._learn([w for w in set(words) if w not in self.at], words)
            return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def _learn(self, new: list[str], words: list[str]) -> None:
        wide = max(1, len(self.model.languages))
        if self.at and (self.bytes > KEPT_BYTES or (len(self.at) + len(new)) * wide > MAX_CELLS):
            self._begin()
            new = list(set(words))
        start = len(self.at)
        if start + len(new) > len(self.scores):
            size = start + len(new) + min(start + len(new), MAX_CELLS // wide)
            self.scores = np.resize(self.scores, (size, self.scores.shape[1]))
            self.letters = np.resize(self.letters, size)
        # so many words at a time as have room for their scores
        step = max(1, HELD // wide)
        for i in range(0, len(new), step):
            self._put(new[i : i + step])

    def _put(self, new: list[str]) -> None:
        start = len(self.at)
        found, first = self._sums(new)
        kinds = np.searchsorted(STARTS, first, side="right") - 1
        for kind in np.unique(kinds):
            fits = self.model.scripts.get(SCRIPTS[kind][1] if kind >= 0 else "other")
            if fits is not None and fits.any() and not fits.all():
                found[kinds == kind] += np.where(fits, 0, OUT_OF_SCRIPT)
        self.at.update(zip(new, range(start, start + len(new)), strict=True))
        self.scores[start : start + len(new)] = found
        self.letters[start : start + len(new)] = [len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in new]
        self.bytes += sum(map(sys.getsizeof, new)) + ENTRY_BYTES * len(new)


def _only(scores: np.ndarray, switch: float) -> int | None:
    """The language of all words, if the best path surely never leaves it: no run of words gains more than a switch costs
    by leaving the language that is best for all."""
    if scores.shape[1] == 1:
        return 0
    best = int(scores.sum(axis=0).argmax())
    gain = np.delete(scores - scores[:, [best]], best, axis=1).max(axis=1, initial=-np.inf).astype(np.float64)
    total = np.concatenate([[0.0], np.cumsum(gain)])
    return best if (total - np.minimum.accumulate(total)).max() <= switch else None


def viterbi(scores: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The language of each word on the best path."""
    return viterbi_all([scores], switch)[0]


def viterbi_all(listed: list[np.ndarray], switch: float = SWITCH) -> list[np.ndarray]:
    """The same for several texts, which take their steps together; a text that is far longer than all others is alone."""
    paths: list[np.ndarray] = [np.zeros(0, np.int64)] * len(listed)
    mixed = []
    for i, scores in enumerate(listed):
        if len(scores):
            only = _only(scores, switch)
            if only is None:
                mixed.append(i)
            else:
                paths[i] = np.full(len(scores), only)
    mixed.sort(key=lambda i: -len(listed[i]))
    while mixed:
        if len(mixed) >= TOGETHER and 2 * len(listed[mixed[TOGETHER - 1]]) >= len(listed[mixed[0]]):
            for i, path in zip(mixed, _paths([listed[i] for i in mixed], switch), strict=True):
                paths[i] = path
            break
        i, *mixed = mixed
        paths[i] = _path(listed[i], switch)
    return paths


def _path(scores: np.ndarray, switch: float) -> np.ndarray:
    # few languages: lists are faster than arrays here, but are made for BLOCK words at a time
    value = scores[0].tolist()
    tops, stays = np.empty(len(scores), np.int32), np.empty(scores.shape, bool)
    for start in range(1, len(scores), BLOCK):
        came, kept = [], []
        for row in scores[start : start + BLOCK].tolist():
            top = max(value)
            least = top - switch
            came.append(value.index(top))
            kept.append([v >= least for v in value])
            value = [(v if v >= least else least) + s for v, s in zip(value, row, strict=True)]
        tops[start : start + BLOCK], stays[start : start + BLOCK] = came, kept
    at = value.index(max(value))
    path = np.empty(len(scores), np.int64)
    for i in range(len(scores) - 1, 0, -1):
        path[i] = at
        if not stays[i, at]:
            at = tops[i]
    path[0] = at
    return path


def _paths(listed: list[np.ndarray], switch: float) -> list[np.ndarray]:
    """The paths of texts that are sorted from the longest to the shortest."""
    lengths = np.array([len(s) for s in listed])
    first = np.cumsum(lengths) - lengths
    # how many texts have a word at each place, and where the words of that place start
    live = np.searchsorted(-lengths, -np.arange(lengths[0]), side="left")
    starts = np.cumsum(live) - live
    order = np.concatenate([first[:n] + i for i, n in enumerate(live.tolist())])
    value = np.ascontiguousarray(np.concatenate(listed)[order].T, np.float64)
    sizes, begins = live.tolist(), starts.tolist()
    for n, a, b in zip(sizes[1:], begins, begins[1:], strict=False):
        before = value[:, a : a + n]
        value[:, b : b + n] += np.maximum(before, before.max(axis=0) - switch)
    tops, stays = value.argmax(axis=0), value >= value.max(axis=0) - switch
    path, at, texts = np.empty(len(order), np.int64), tops[:0], np.arange(len(listed))
    for n, a in zip(reversed(sizes), reversed(begins), strict=True):
        # from the place before, the texts that have a word after it come with a language, the others end here
        top, on = tops[a : a + n], len(at)
        at = np.concatenate([np.where(stays[at, a + texts[:on]], at, top[:on]), top[on:]])
        path[a : a + n] = at
    placed = np.empty_like(path)
    placed[order] = path
    return np.split(placed, first[1:])


def labels_of(texts: Iterable[str | None], scorer: Scorer) -> Iterator[tuple[str, float]]:
    """The language of each text and its share of the letters."""
    held, cells = [], 0
    for text in texts:
        words = WORDS.findall((text or "").lower()) if scorer.model.languages else []
        # the table may be begun anew at the next text
        at = scorer.index(words)
        held.append((scorer.scores[at], scorer.letters[at]))
        cells += held[-1][0].size
        if cells > HELD:
            yield from _judged(held, scorer)
            held, cells = [], 0
    yield from _judged(held, scorer)


def _judged(held: list[tuple[np.ndarray, np.ndarray]], scorer: Scorer) -> Iterator[tuple[str, float]]:
    languages = scorer.model.languages
    for path, (_, letters) in zip(viterbi_all([scores for scores, _ in held]), held, strict=True):
        if letters.any():
            share = np.bincount(path, letters, len(languages)) / letters.sum()
            best = int(share.argmax())
            yield languages[best], float(share[best])
        else:
            yield UNKNOWN, 0.0


def _texts(batch: pa.RecordBatch) -> Iterator[str | None]:
    """The texts of a batch, made as they are used."""
    for part in slices(iter([batch])):
        yield from part.column("text").to_pylist()


def label(text: str | None, scorer: Scorer) -> tuple[str, float]:
    return next(labels_of([text], scorer))


def spans(text: str | None, scorer: Scorer) -> list[tuple[int, int, str]]:
    """Start and end, in characters, and language of each run of words of one language."""
    found = list(WORDS.finditer(text or ""))
    if not found or not scorer.model.languages:
        return []
    path = viterbi(scorer.scores[scorer.index([m[0].lower() for m in found])])
    starts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist()]
    ends = [*starts[1:], len(found)]
    return [(found[a].start(), found[b - 1].end(), scorer.model.languages[path[a]]) for a, b in zip(starts, ends, strict=True)]


def scorer_of(shared: Broadcast, key: str) -> Scorer:
    """One for each model and worker process."""
    return resident(("language", key), lambda: Scorer(shared.value))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shared, key)
        for batch in batches:
            found = list(labels_of(_texts(batch), scorer))
            langs, scores = [lang for lang, _ in found], [share for _, share in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(judge, "doc_id long, lang_pred string, score double")


def language_spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and the spans of each text: array of start, end, lang."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    key = uuid.uuid4().hex
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shared, key)
        for batch in slices(batches):
            found = [[{"start": a, "end": b, "lang": x} for a, b, x in spans(t, scorer)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(judge, "doc_id long, spans array<struct<start:int,end:int,lang:string>>")


def identify(docs: DataFrame, folds: int = 4, held_out: int = 2) -> DataFrame:
    """Fit on the rows outside the held-out fold and predict all: doc_id, held_out, lang_pred, score."""
    # a row without an id is in no fold, so nothing is learned from it
    model = fit(docs, fold(F.col("doc_id"), folds) != held_out)
    out = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    return predict(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def keep_clear(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows whose text has letters, of which one language has at least the share `least`."""
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = scorer_of(shared, key)
        for batch in batches:
            yield batch.filter(pa.array([share >= least for _, share in labels_of(_texts(batch), scorer)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
