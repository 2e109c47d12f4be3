"""Toxicity of whole texts by a learned lexicon, matched with misspellings and weighed by context.

The lexicon is learned from labelled texts: words, and beginnings of words, that toxic texts hold in many different
contexts and clean texts hardly at all. Counting contexts (the words on both sides) rather than texts keeps the words of
a text with many copies out. The lexicon is a trie; Levenshtein automata of its whole words, intersected with the
trie, run over each word of a text, so a term is also found with one letter wrong (two in a long one). Where a beginning is
the better term, the whole words below it that would be terms stay in the trie for their misspellings; the beginning itself
is matched as it is. The product automaton is built state by state as words come, and begun anew once it has MAX_PAIRS
pairs of node and errors.

Terms may stand in clean texts by chance, so a text is judged by how far its mentions exceed the rates of clean texts: the
deviance of Poisson counts, turned into a probability by a logistic curve that is fitted to the labelled texts. A mention
in a quotation counts in part; a window of words and the marks around it tell a quotation from abuse.

At most `limit` labelled rows, those with the smallest hashes of their ids, are learned from, so the lexicon is bounded by
that sample and can be broadcast whatever the size of the input. Words that report speech make a quotation of a mention
with a quotation mark near it. They are learned too: words that stand near mentions between quotation marks, in many
contexts, and hardly near others (or a list is given). A long text's words are made as they are used.

A null or empty text scores 0. If no terms can be learned, all texts do. Repeated rows and null doc_ids each get a score;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter, deque
from collections.abc import Container, Iterator
from dataclasses import dataclass, replace
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm.common import Kept, fold, materialise, resident, slices, training_labels

TRAIN_ROWS = 30_000
#: Trie nodes with errors, in all states of an automaton.
MAX_PAIRS = 400_000
#: Characters of a text whose words aren't all held at once.
LONG = 1 << 22
#: Beginnings of words have so many letters.
STEMS = range(4, 9)
#: Whole words of so many letters may have one wrong, of so many two.
ONE_ERROR, TWO_ERRORS = 5, 10
#: A term must be so unlikely to be as one-sided by chance (log probability); so many of the texts with it are toxic, and it
#: is so many times as frequent in these.
SURPRISE, PRECISION, RATIO = -14.0, 0.4, 20.0
#: Contexts for each toxic text with a term.
VARIETY = 0.5
#: Words on each side of a mention that belong to its context.
WINDOW = 5
#: The weight of a quotation before anything is learned about it, worth so many mentions.
QUOTED, QUOTED_PRIOR = 0.3, 4
#: Kinds of counts from here on are contexts of a word near mentions: even without quotation marks around these, odd with.
NEAR = 1000
#: Keys that a task counts before it sends them.
MAX_COUNTED = 200_000
WORDS = re.compile(r"[^\W_]+")
QUOTES = "\"“”„«»‹›"

Walk = frozenset[tuple[int, int, int]]


@dataclass
class Lexicon:
    """terms: a word, or a beginning of words if it ends with *, with its mentions for each word of clean texts."""

    terms: dict[str, float]
    #: The same for all mentions with one error, and with two.
    errors: tuple[float, float] = (1e-4, 1e-3)
    #: Misspellings that are words of clean texts.
    clean: frozenset[str] = frozenset()
    #: What a quoted mention counts.
    quoted: float = QUOTED
    #: Slope and offset of the logistic curve over the deviance.
    curve: tuple[float, float] = (1.0, -4.0)
    #: Whole words with a beginning among the terms, for their misspellings only.
    words: frozenset[str] = frozenset()
    #: Words that report speech.
    reporting: frozenset[str] = frozenset()


class Matcher:
    """The lexicon's trie and the product automaton. A state is a set of (trie node, errors made, errors allowed)."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.children: list[dict[str, int]] = [{}]
        self.word: list[str | None] = [None]
        self.stem: list[str | None] = [None]
        #: The most errors allowed to a word below each node.
        self.most: list[int] = [0]
        for term in (*lexicon.terms, *sorted(lexicon.words)):
            letters = term.removesuffix("*")
            allowed = 0 if term.endswith("*") else (len(letters) >= ONE_ERROR) + (len(letters) >= TWO_ERRORS)
            node = 0
            for c in letters:
                self.most[node] = max(self.most[node], allowed)
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(None)
                    self.stem.append(None)
                    self.most.append(0)
                node = self.children[node][c]
            self.most[node] = max(self.most[node], allowed)
            (self.stem if term.endswith("*") else self.word)[node] = term
        self.known: Kept[tuple[str, int] | None] = Kept()
        self._begin()

    def _begin(self) -> None:
        """An automaton of its first state only."""
        self.states: list[frozenset[tuple[int, int]]] = []
        self.numbers: dict[frozenset[tuple[int, int]], int] = {}
        self.moves: list[dict[str, int]] = []
        self.stems: list[str | None] = []
        self.ends: list[tuple[int, str] | None] = []
        self.pairs = 0
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """The number of a state; pairs of trie node and errors, letters of a term may be missing."""
        closed, todo = {}, sorted(pairs, key=lambda p: p[1])
        for node, errors in todo:
            if errors < closed.get(node, 9):
                closed[node] = errors
                if errors < self.most[node]:
                    todo += [(child, errors + 1) for child in self.children[node].values()]
        state = frozenset((n, e) for n, e in closed.items() if e <= self.most[n] or not e)
        if state not in self.numbers:
            self.numbers[state] = len(self.states)
            self.pairs += 1 + len(state)
            self.states.append(state)
            self.moves.append({})
            exact = [self.stem[n] for n, e in state if e == 0 and self.stem[n]]
            self.stems.append(max(exact, key=len) if exact else None)
            done = [(e, self.word[n]) for n, e in state if self.word[n] and e <= (len(self.word[n]) >= ONE_ERROR) + (len(self.word[n]) >= TWO_ERRORS)]
            self.ends.append(min(done) if done else None)
        return self.numbers[state]

    def _move(self, number: int, c: str) -> int:
        after: set[tuple[int, int]] = set()
        for node, errors in self.states[number]:
            if (child := self.children[node].get(c)) is not None:
                after.add((child, errors))
            if errors < self.most[node]:
                after.add((node, errors + 1))
                after.update((child, errors + 1) for child in self.children[node].values())
        to = self.moves[number][c] = self._state(after)
        return to

    def match(self, word: str) -> tuple[str, int] | None:
        """The term that a lower-case word is, and the number of errors; of several, that with fewest errors."""
        if self.pairs > MAX_PAIRS:
            self._begin()
        at, stem, moves = self.start, None, self.moves
        for c in word:
            to = moves[at].get(c)
            at = self._move(at, c) if to is None else to
            if not self.states[at]:
                return (stem, 0) if stem else None
            stem = self.stems[at] or stem
        end = self.ends[at]
        if stem:
            return stem, 0
        if end and end[0] == 0:
            return end[1], 0
        return (end[1], end[0]) if end and word not in self.lexicon.clean else None

    def words(self, text: str) -> set[str]:
        """The words of a lower-case text that match."""
        words = set(WORDS.findall(text)) if len(text) <= LONG else {m[0] for m in WORDS.finditer(text)}
        new = {w: self.match(w) for w in self.known.unknown(words)}
        hits = {w for w in words if (new[w] if w in new else self.known[w])}
        self.known.keep(new)
        return hits

    def mentions(self, text: str) -> Iterator[tuple[list[re.Match], int, str, int, bool, bool]]:
        """Words around and the mention's place there, term, errors, whether quotation marks stand on both sides, and whether
        the mention is quoted."""
        low = text.lower()
        hits = self.words(low)
        if not hits:
            return
        for found, i in windows(low, hits):
            m = found[i]
            term, errors = self.known.get(m[0]) or self.match(m[0])
            start, end = found[0].start(), found[-1].end()
            marked = any(q in low[start : m.start()] for q in QUOTES) and any(q in low[m.end() : end + 1] for q in QUOTES)
            near = low[max(0, start - 1) : end + 1]
            reported = any(q in near for q in QUOTES) and not self.lexicon.reporting.isdisjoint(x[0] for x in found)
            yield found, i, term, errors, marked, marked or reported

    def deviance(self, text: str | None) -> tuple[float, int]:
        """How far the mentions exceed the rates of clean texts, and their number."""
        counts: dict[str | int, float] = {}
        n = 0
        for _, _, term, errors, _, quoted in self.mentions(text or ""):
            key = errors or term
            counts[key] = counts.get(key, 0.0) + (self.lexicon.quoted if quoted else 1.0)
            n += 1
        if not n:
            return 0.0, 0
        size, total = sum(1 for _ in WORDS.finditer(text)), 0.0
        for key, count in counts.items():
            rate = self.lexicon.errors[key - 1] if isinstance(key, int) else self.lexicon.terms[key]
            if count > size * rate:
                total += count * math.log(count / (size * rate)) - count + size * rate
        return total, n

    def score(self, text: str | None) -> tuple[float, int]:
        """Score and number of mentions; 0 without any."""
        value, n = self.deviance(text)
        slope, offset = self.lexicon.curve
        return (1 / (1 + math.exp(-max(-700.0, slope * value + offset))) if n else 0.0), n


def windows(text: str, hits: Container[str]) -> Iterator[tuple[list[re.Match], int]]:
    """Each word that is a hit with up to WINDOW words on both sides, as a list of matches, and its place there."""
    if len(text) <= LONG:
        found = list(WORDS.finditer(text))
        for i, m in enumerate(found):
            if m[0] in hits:
                start = max(0, i - WINDOW)
                yield found[start : i + WINDOW + 1], i - start
        return
    for found, i in _windows(text):
        if found[i][0] in hits:
            yield found, i


def _windows(text: str) -> Iterator[tuple[list[re.Match], int]]:
    """All words of a long text, which are made as they are used."""
    around: deque[re.Match] = deque(maxlen=2 * WINDOW + 1)
    words, before = WORDS.finditer(text), 0
    around.extend(islice(words, WINDOW + 1))
    while before < len(around):
        yield list(around), before
        after = next(words, None)
        if after is not None:
            before = min(before + 1, WINDOW)
            around.append(after)
        elif before == WINDOW:
            around.popleft()
        else:
            before += 1


def hash_of(found: list[re.Match], i: int) -> int:
    """The words on both sides."""
    return xxhash.xxh64_intdigest(f"{found[i - 1][0] if i else ''} {found[i + 1][0] if i + 1 < len(found) else ''}") >> 1


def _counts(rows: DataFrame, each, schema: str) -> DataFrame:
    """each(label, text) gives keys; a task sums how often each came before it sends them."""

    def sent(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([t for t, _ in total], pa.string()), pa.array([k for _, k in total], pa.int64()), pa.array(list(total.values()), pa.int64())], names=["term", "kind", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        work = each()
        for batch in slices(batches):
            for mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                total.update(work(mark, text.lower()))
                if len(total) > MAX_COUNTED:
                    yield sent(total)
                    total.clear()
        if total:
            yield sent(total)

    return rows.mapInArrow(count, schema)


COUNTS = "term string, kind long, n long"


def _terms(text: str) -> set[str]:
    """The words of a text, and their beginnings marked with *."""
    words = set(WORDS.findall(text))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _one_sided(counted: DataFrame, share: float, yes: str = "toxic", no: str = "clean") -> DataFrame:
    """The terms whose texts are toxic so often that chance, at this share of toxic texts, explains it badly."""
    n = F.col(yes) + F.col(no)
    p = F.col(yes) / n
    # log of the Chernoff bound of the binomial tail
    rest = F.when(F.col(no) > 0, (1 - p) * F.log((1 - p) / (1 - share))).otherwise(0.0)
    bounded = counted.where(p >= PRECISION).withColumn("bound", -n * (p * F.log(p / share) + rest))
    return bounded.where(F.col("bound") <= SURPRISE)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, limit: int = TRAIN_ROWS, reporting: frozenset[str] | None = None) -> Lexicon:
    """Learn the lexicon from the labelled rows outside the held-out fold; words that report speech only if none are given."""
    marks = training_labels(labels, "toxic", folds, held_out, limit)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(marks), "doc_id").select("label", "text").distinct()
    rows = materialise(rows, "toxicity-rows")
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(1, 0), sizes.get(0, 0)
    if not n_toxic or not n_clean:
        return Lexicon({})
    share = n_toxic / (n_toxic + n_clean)
    least = max(2, math.ceil(SURPRISE / math.log(share))) if share < 1 else 2

    counted = _counts(rows, lambda: lambda mark, text: [(t, mark) for t in _terms(text)], COUNTS)
    sums = {name: F.sum(F.when(F.col("kind") == mark, F.col("n")).otherwise(0)).alias(name) for mark, name in enumerate(("clean", "toxic"))}
    counted = counted.groupBy("term").agg(*sums.values()).where(F.col("toxic") >= least)
    good = {r.term: r.toxic for r in _one_sided(counted, share).collect()}
    found = _mentions(rows, frozenset(good))
    sizes = {r.label: r.n for r in rows.groupBy("label").agg(F.sum(F.size(F.split("text", r"[^\p{L}\p{N}]+"))).alias("n")).collect()}
    # words that copies share stand in few contexts for so many texts
    kept = {t: (m1, m0) for t, (m1, m0, varied) in found.items() if varied >= max(least, VARIETY * good[t])}
    terms, words = _chosen(kept, sizes[1], sizes[0])
    return _with_contexts(rows, Lexicon(terms, words=words), sizes[0], reporting)


def _mentions(rows: DataFrame, terms: frozenset[str]) -> dict[str, tuple[int, int, int]]:
    """Of each term: mentions in toxic texts and in clean ones, of those in one text only ones in different contexts, and
    the number of different contexts in all toxic texts."""
    shared = rows.sparkSession.sparkContext.broadcast(terms)

    def contexts(known: frozenset[str], text: str) -> set[tuple[str, int]]:
        out = set()
        near = {w for w in set(WORDS.findall(text)) if w in known or any(w[:n] + "*" in known for n in STEMS if len(w) > n)}
        for found, i in windows(text, near):
            word = found[i][0]
            for t in (word, *(word[:n] + "*" for n in STEMS if len(word) > n)):
                if t in known:
                    out.add((t, hash_of(found, i)))
        return out

    def mentions():
        return lambda mark, text: [(t, mark) for t, _ in contexts(shared.value, text)]

    counted = _counts(rows, mentions, COUNTS).groupBy("term").pivot("kind", [0, 1]).agg(F.sum("n")).na.fill(0)
    seen = _counts(rows.where("label = 1"), lambda: lambda _, text: contexts(shared.value, text), COUNTS)
    varied = seen.select("term", "kind").distinct().groupBy("term").agg(F.count("*").alias("varied"))
    return {r["term"]: (r["1"], r["0"], r["varied"]) for r in counted.join(varied, "term").collect()}


def _chosen(terms: dict[str, tuple[int, int]], toxic_words: int, clean_words: int) -> tuple[dict[str, float], frozenset[str]]:
    """The terms that tell most, with their rates in clean texts; of words and their beginnings one, of ties the longest.
    Also the words that would be terms but for a beginning of theirs."""
    worth, rates = {}, {}
    for t, (toxic, clean) in terms.items():
        rates[t] = (clean + 0.5) / clean_words
        ratio = toxic / toxic_words / rates[t]
        # a term without mentions in clean texts has a ratio that grows with the texts
        if ratio >= (RATIO if clean else 0.5 * RATIO):
            worth[t] = toxic * math.log(ratio)
    kept: dict[str, float] = {}
    for t in sorted(worth, key=lambda t: (-worth[t], -len(t.removesuffix("*")), t)):
        letters = t.removesuffix("*")
        nested = any(letters[:n] + "*" in kept for n in STEMS if n <= len(letters)) or t.endswith("*") and any(k.startswith(letters) for k in kept)
        if not nested:
            kept[t] = rates[t]
    begun = frozenset(t for t in worth if not t.endswith("*") and any(t[:n] + "*" in kept for n in STEMS if n <= len(t)))
    return kept, begun


def _with_contexts(rows: DataFrame, lexicon: Lexicon, clean_words: int, reporting: frozenset[str] | None = None) -> Lexicon:
    """Learn what misspelled and quoted mentions are worth and which words report speech, then the curve."""
    if not lexicon.terms:
        return lexicon
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def work():
        matcher = Matcher(shared.value)

        def each(mark: int, text: str) -> set[tuple[str, int]]:
            out = set()
            for found, i, _, errors, marked, _ in matcher.mentions(text):
                out.add((found[i][0] if errors else "", 100 * mark + 10 * errors + marked))
                if reporting is None and not errors:
                    context = NEAR + 2 * (hash_of(found, i) >> 3) + marked
                    out.update((m[0] if j != i else "", context) for j, m in enumerate(found))
            return out

        return each

    counted = materialise(_counts(rows, work, COUNTS).groupBy("term", "kind").agg(F.sum("n").alias("n")), "toxicity-contexts")
    quoted, words = [0, 0], {}
    # misspellings are at most as many as the words near the lexicon's terms
    for r in counted.where(F.col("kind") < NEAR).toLocalIterator():
        mark, wrong, in_quotes = r.kind // 100, r.kind // 10 % 10, r.kind % 10
        if in_quotes and not wrong:
            quoted[mark] += r.n
        if wrong:
            words.setdefault(r.term, [wrong, 0, 0])[1 + mark] += r.n
    clean = frozenset(w for w, (_, c, t) in words.items() if c > t)
    # clean texts hold misspellings that were not seen as often as those that were seen once
    rates = [(sum(c for e, c, t in words.values() if e == wrong and c <= 1) + 0.5) / clean_words for wrong in (1, 2)]
    share = (quoted[1] + QUOTED_PRIOR * QUOTED) / (sum(quoted) + QUOTED_PRIOR)
    if reporting is None:
        reporting = _reporting(counted.where(F.col("kind") >= NEAR), Matcher(lexicon))
    lexicon = replace(lexicon, errors=tuple(rates), clean=clean, quoted=share, reporting=reporting)
    return replace(lexicon, curve=_curve(rows, lexicon))


def _reporting(near: DataFrame, matcher: Matcher) -> frozenset[str]:
    """Words whose contexts have quotation marks around the mention so often that chance explains it badly."""
    marked = F.col("kind") % 2
    counts = near.groupBy("term").agg(F.sum(marked).alias("quoted"), F.sum(1 - marked).alias("plain"))
    whole = counts.where("term = ''").first()
    if whole is None or not whole.quoted or not whole.plain:
        return frozenset()
    share = whole.quoted / (whole.quoted + whole.plain)
    found = _one_sided(counts.where("term <> '' and quoted > 0"), share, "quoted", "plain").collect()
    return frozenset(r.term for r in found if matcher.match(r.term) is None)


def _curve(rows: DataFrame, lexicon: Lexicon) -> tuple[float, float]:
    """Logistic regression on the deviance, from counts of texts by label and tenth of a unit."""
    shared = rows.sparkSession.sparkContext.broadcast(lexicon)

    def work():
        matcher = Matcher(shared.value)

        def each(mark: int, text: str) -> list[tuple[str, int]]:
            value, n = matcher.deviance(text)
            return [(str(mark), round(10 * min(value, 30.0)))] if n else []

        return each

    cells = [(int(r.term), r.kind / 10, r.n) for r in _counts(rows, work, COUNTS).groupBy("term", "kind").agg(F.sum("n").alias("n")).collect()]
    # a text of each label near the middle keeps the curve from growing too steep where labels are separate
    cells += [(0, 6.0, 1), (1, 3.0, 1)]
    y, x, n = (np.array(c, float) for c in zip(*cells, strict=True))
    w = start = np.array([1.0, -4.0])
    design = np.column_stack([x, np.ones(len(x))])

    def loss(w: np.ndarray) -> float:
        z = design @ w
        return float((n * (np.logaddexp(0, z) - y * z)).sum() + 5e-4 * ((w - start) ** 2).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-design @ w))
        slope = design.T @ (n * (y - p)) - 1e-3 * (w - start)
        step = np.linalg.solve(design.T @ (design * (n * p * (1 - p))[:, None]) + 1e-3 * np.eye(2), slope)
        # whole Newton steps can go back and forth for ever
        while np.abs(step).max() > 1e-9 and loss(w + step) > loss(w):
            step = step / 2
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return float(max(w[0], 0.0)), float(w[1])


def matcher_of(shared: Broadcast, key: str) -> Matcher:
    """One for each lexicon and worker process."""
    return resident(("toxicity", key), lambda: Matcher(shared.value))


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, score, mentions."""
    shared, key = docs.sparkSession.sparkContext.broadcast(lexicon), uuid.uuid4().hex

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = matcher_of(shared, key)
        for batch in slices(batches):
            scores, n = zip(*map(matcher.score, batch.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(n, pa.int64())], names=["doc_id", "score", "mentions"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(judge, "doc_id long, score double, mentions long")


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.5) -> DataFrame:
    """The rows whose text scores below the threshold."""
    shared, key = docs.sparkSession.sparkContext.broadcast(lexicon), uuid.uuid4().hex

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = matcher_of(shared, key)
        for batch in slices(batches):
            yield batch.filter(pa.array([matcher.score(t)[0] < threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)


def judge(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.5) -> DataFrame:
    """Fit and score all rows: doc_id, held_out, score, predicted."""
    out = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    scored = score(docs, fit(docs, labels, folds, held_out))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
