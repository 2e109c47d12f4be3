"""Quality of whole texts by a regularised quadratic discriminant.

Each text becomes a vector of transformed statistics (logarithms, logits and roots of counts and shares). For each
label, mean and covariance of the labelled texts' vectors come from sums that Spark adds up over all labelled rows
outside the held-out fold. A covariance is shrunk towards the pooled one's diagonal; its Cholesky factor is computed once
and sent to the tasks, which score a vector by the difference of the two log densities, from Mahalanobis distances.

The statistics are computed once and written to the shared folder, so the texts are read once.

A null text is like an empty one; it gets a score from the same statistics. If a label has no rows, all scores are the
share of label 1 (0.5 without any labels). Repeated rows and null doc_ids each get a score; extra columns are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm.common import fold, materialise, slices

FEATURES = ["words", "word_length", "word_spread", "letters", "digits", "symbols", "upper", "stops", "types", "top_word", "repeats", "line_length", "repeated_lines", "alone", "ends"]
#: Weight of the pooled diagonal in a label's covariance, and variance added to each statistic.
SHRINK, FLOOR = 0.1, 1e-3
#: Letters that are counted; what is neither letter, digit, space nor ordinary punctuation is a symbol.
NOT_PLAIN = re.compile(r"[^\w\s.,;:!?'\"()-]|_")
NO_SPACE, LINE, ENDS = re.compile(r"\S+"), re.compile(r"[^\n]+"), frozenset(["", ".", "!", "?"])
#: Characters of a text whose words and lines are made as they are used, BLOCK words at a time.
LONG, BLOCK = 1 << 22, 1 << 16
DIGITS, LETTERS, UPPER = re.compile(r"\d+"), re.compile(r"[^\W\d_]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]+")


def _logit(part: float, whole: float) -> float:
    return math.log((part + 0.5) / (whole - part + 0.5)) if whole >= part else 0.0


def _matches(pattern: re.Pattern, text: str) -> Iterator[str]:
    return (m[0] for m in pattern.finditer(text))


def _counted_words(words: Iterator[str]) -> tuple[Counter, int]:
    """How often each word occurs, and how often one is the same as the one before."""
    counts, again = Counter(), 0
    while part := list(islice(words, BLOCK)):
        if counts:
            again += part[0] == last
        again += sum(map(eq, part, islice(part, 1, None)))
        counts.update(part)
        last = part[-1]
    return counts, again


def statistics(text: str | None) -> list[float]:
    """The values of FEATURES."""
    text = text or ""
    size = len(text)
    long = size > LONG
    counts, again = _counted_words(_matches(NO_SPACE, text) if long else iter(text.split()))
    n = sum(counts.values())
    by_length: Counter = Counter()
    for word, k in counts.items():
        by_length[len(word)] += k
    mean = sum(x * k for x, k in by_length.items()) / max(1, n)
    spread = math.sqrt(sum(k * (x - mean) ** 2 for x, k in by_length.items()) / max(1, n))
    lines = ended = 0
    kinds = set()
    for x in _matches(LINE, text) if long else filter(None, text.split("\n")):
        lines += 1
        kinds.add(hash(x))
        ended += x.rstrip()[-1:] in ENDS
    in_all = lambda pattern: sum(map(len, _matches(pattern, text) if long else pattern.findall(text)))
    return [
        math.log1p(n),
        math.log1p(mean),
        math.log1p(spread),
        _logit(in_all(LETTERS), size),
        math.sqrt(in_all(DIGITS) / max(1, size)),
        math.sqrt(in_all(NOT_PLAIN) / max(1, size)),
        math.sqrt(in_all(UPPER) / max(1, size)),
        math.sqrt((text.count(".") + text.count(",")) / max(1, n)),
        math.log1p(len(counts)) - math.log1p(n) if n else 0.0,
        math.sqrt(max(counts.values(), default=0) / max(1, n)),
        math.sqrt(again / max(1, n)),
        math.log1p(size / max(1, lines)),
        math.sqrt(1 - len(kinds) / max(1, lines)) if lines else 0.0,
        math.sqrt((by_length[0] + by_length[1]) / max(1, n)) if n else 0.0,
        math.sqrt(ended / max(1, lines)),
    ]


def features(docs: DataFrame) -> DataFrame:
    """doc_id and a double column for each of FEATURES."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            values = np.array([statistics(t) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v) for v in values.T)], names=["doc_id", *FEATURES])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(compute, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


@dataclass
class Discriminant:
    """For labels 0 and 1: mean, inverse of the Cholesky factor, log determinant and log share; none if a label lacks rows."""

    classes: list[tuple[np.ndarray, np.ndarray, float, float]]
    share: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row of x."""
        if not self.classes:
            return np.full(len(x), self.share)
        logs = []
        for mean, inverse, logdet, prior in self.classes:
            z = (x - mean) @ inverse.T
            logs.append(prior - 0.5 * logdet - 0.5 * (z * z).sum(axis=1))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


def fit(measured: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> Discriminant:
    """Sums over all labelled rows outside the held-out fold: the driver gets two rows."""
    marks = labels.where(F.col("quality").isin(0, 1) & (fold(F.col("doc_id"), folds) != held_out)).groupBy("doc_id").agg(F.max("quality").alias("label"))
    rows = measured.join(marks, "doc_id")
    pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]
    sums = [F.sum(f).alias(f) for f in FEATURES] + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"p{i}_{j}") for i, j in pairs]
    found = {r["label"]: r for r in rows.groupBy("label").agg(F.count("*").alias("n"), *sums).collect()}
    total = sum(r["n"] for r in found.values())
    share = found[1]["n"] / total if 1 in found else 0.0 if total else 0.5
    if len(found) < 2:
        return Discriminant([], share)
    moments = {}
    for k, r in found.items():
        mean = np.array([r[f] for f in FEATURES]) / r["n"]
        second = np.zeros((len(FEATURES), len(FEATURES)))
        for i, j in pairs:
            second[i, j] = second[j, i] = r[f"p{i}_{j}"] / r["n"]
        moments[k] = (r["n"], mean, second - np.outer(mean, mean))
    pooled = sum(n * c for n, _, c in moments.values()) / total
    classes = []
    for k in (0, 1):
        n, mean, cov = moments[k]
        # few rows say little about a covariance
        weight = max(SHRINK, len(FEATURES) / (len(FEATURES) + n))
        cov = (1 - weight) * cov + weight * np.diag(np.diag(pooled)) + FLOOR * np.eye(len(mean))
        root = np.linalg.cholesky(cov)
        classes.append((mean, np.linalg.inv(root), 2 * np.log(np.diag(root)).sum(), math.log(n / total)))
    return Discriminant(classes, share)


def score(measured: DataFrame, model: Discriminant) -> DataFrame:
    """doc_id, score."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.column_stack([c.to_numpy() for c in batch.columns[1:]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return measured.select("doc_id", *FEATURES).mapInArrow(compute, "doc_id long, score double")


def judge(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """Fit and score all rows: doc_id, held_out, score, predicted."""
    measured = materialise(features(docs), "statistics")
    out = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    scored = score(measured, fit(measured, labels, folds, held_out))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
