"""How the sources of a language differ in their words.

A group is a language and a source; a language keeps the terms that enough of its documents have. For a count c in a group with N
occurrences of V kept terms, p = 1 + floor(SCALE (c + 2) / (N + 2 V)), and two of them differ by f = floor((p - q)^2 / (p + q)).
All arithmetic is of integers.

A pair of groups is compared by its joint histogram of counts: how many terms have the count a here and b there. Terms of both
groups are tallied where the rows of a term are together, and only tallies leave the task. Terms that one group lacks follow from
the histograms of single groups less those tallies, terms that both lack from V. f is evaluated once for each combination.

Counting goes through a table of each task that is bounded and sums before anything is shuffled, so a source with a third of all
rows sends no more than the others. A term's rows are as many as sources; where a language has over BLOCK sources these are dealt
to blocks, and each two blocks meet in a group of their own. The result has a row for each two sources, as asked for.

Null texts, languages and sources are ''. A group without terms is compared like any other; without kept terms all values are 0.
Rows that repeat count as documents of their own. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segmill.llm.common import lookup, materialise, slices

SCALE = 1_000_000_000
COUNTS = "lang string, source string, term string, n long, docs long"
TALLIES = "ga long, gb long, ca long, cb long, m long"
#: A task's table of counts is sent when it has so many entries, or has taken in so many bytes of text.
ENTRIES, TEXT_BYTES = 400_000, 256 << 20
#: Bytes of a text that are split at once.
SPLIT_BYTES = 1 << 20
#: Sources of a language that meet in one group, on average.
BLOCK = 256
#: Pairs that are tallied at once.
PAIRS = 1 << 20

#: ASCII letters in lower case, other ASCII as a space; bytes of other characters stay, as all of them belong to terms.
LETTERS = bytes(b if b > 127 else ord(chr(b).lower()) if chr(b).isalpha() else 32 for b in range(256))


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text in UTF-8, part by part."""
    raw = text.encode().translate(LETTERS)
    start = 0
    while start < len(raw):
        end = raw.find(b" ", start + SPLIT_BYTES)
        end = len(raw) if end < 0 else end
        yield raw[start:end].split()
        start = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each term of each group, and a row with the term '' for each group."""
    table: dict[tuple[str, str], tuple[Counter[bytes], Counter[bytes]]] = {}
    entries = taken = 0

    def sent() -> Iterator[pa.RecordBatch]:
        for (lang, source), (counts, docs) in table.items():
            terms = list(counts)
            n = [counts[t] for t in terms]
            columns = ([lang] * len(terms), [source] * len(terms), [t.decode() for t in terms], n, [docs[t] for t in terms])
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["lang", "source", "term", "n", "docs"])

    for batch in slices(batches):
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            counts, docs = table.setdefault((lang, source), (Counter({b"": 0}), Counter()))
            before, seen = len(counts), set()
            for terms in terms_of(text):
                counts.update(terms)
                seen.update(terms)
            docs.update(seen)
            entries += len(counts) - before
            taken += len(text)
            if entries > ENTRIES or taken > TEXT_BYTES:
                yield from sent()
                table, entries, taken = {}, 0, 0
    yield from sent()


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n and docs: occurrences of a term in a group and the group's documents that have it; and of each group
    a row with the term ''."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    counted = docs.select(text("text"), text("lang"), text("source")).mapInArrow(_count, COUNTS)
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counts: DataFrame, min_docs: int) -> DataFrame:
    """The rows of terms in at least min_docs documents of the language, and the groups' own; lang_n is the language's count,
    and `first` marks one row of each term."""
    w = Window.partitionBy("lang", "term")
    rows = counts.withColumns({"_docs": F.sum("docs").over(w), "lang_n": F.sum("n").over(w), "first": F.min("source").over(w) == F.col("source")})
    return rows.where((F.col("term") == "") | (F.col("_docs") >= min_docs)).select("lang", "source", "term", "n", "lang_n", "first")


def groups_of(kept: DataFrame) -> DataFrame:
    """Each group: number g, n_terms with a count, total of their counts, and the language's v and lang_total.

    g is a hash of the names; the seed is one for which the groups' hashes differ."""
    real = F.col("term") != ""
    of = lambda c, x: F.sum(F.when(c, x).otherwise(0))
    rows = kept.groupBy("lang", "source").agg(of(real, 1).alias("n_terms"), of(real, F.col("n")).alias("total"), of(real & F.col("first"), 1).alias("_v"), of(real & F.col("first"), F.col("lang_n")).alias("_n"))
    w = Window.partitionBy("lang")
    rows = materialise(rows.withColumns({"v": F.sum("_v").over(w), "lang_total": F.sum("_n").over(w)}).drop("_v", "_n"), "groups")
    for seed in range(100):
        numbered = rows.withColumn("g", number(seed))
        n, distinct = numbered.agg(F.count("*"), F.count_distinct("g")).first()
        if n == distinct:
            return numbered.withColumn("seed", F.lit(seed))
    raise ValueError("no seed tells the groups apart")


def number(seed: int) -> Column:
    return F.xxhash64("lang", "source", F.lit(seed))


def probability(count: Column, total: Column, v: Column) -> Column:
    """1 + floor(SCALE (count + 2) / (total + 2 v)), in decimals so that no count is too large."""
    above = (count + 2).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = (total + 2 * v).cast("decimal(19,0)")
    return F.call_function("div", above, below) + 1


def divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the groups of one term (arrays of g, own block and count, in the order of g) as tallies of (ga, gb, ca, cb)."""
    for batch in batches:
        members = batch.column("members")
        flat = members.flatten()
        g, own, n = (flat.field(k).to_numpy() for k in ("g", "own", "n"))
        sizes = members.value_lengths().to_numpy().astype(np.int64)
        ends = np.repeat(np.cumsum(sizes), sizes)
        within = np.repeat(batch.column("within").to_numpy(zero_copy_only=False), sizes)
        groups, a = np.unique(g, return_inverse=True)
        values, c = np.unique(n, return_inverse=True)
        partners = ends - np.arange(len(g)) - 1
        upto = np.cumsum(partners)
        start = 0
        while start < len(g):
            stop = max(start + 1, int(np.searchsorted(upto, (upto[start - 1] if start else 0) + PAIRS, "right")))
            count = partners[start:stop]
            left = np.repeat(np.arange(start, stop), count)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(count) - count, count)
            meet = within[left] | (own[left] != own[right])
            left, right = left[meet], right[meet]
            cells, m = _distinct([a[left], a[right], c[left], c[right]], [len(groups), len(groups), len(values), len(values)])
            columns = groups[cells[0]], groups[cells[1]], values[cells[2]], values[cells[3]], m
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["ga", "gb", "ca", "cb", "m"])
            start = stop


def _distinct(columns: list[np.ndarray], sizes: list[int]) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of columns of numbers below `sizes`, and how often each occurs."""
    if math.prod(sizes) >= 1 << 63:
        rows, m = np.unique(np.stack(columns), axis=1, return_counts=True)
        return list(rows), m
    keys, m = np.unique(np.ravel_multi_index(columns, sizes), return_counts=True)
    return list(np.unravel_index(keys, sizes)), m


def joint_counts(rows: DataFrame, blocks: int) -> DataFrame:
    """ga, gb, ca, cb, m: how many terms have the counts ca > 0 in the group ga and cb > 0 in gb, ga below gb. rows: lang, term, g, n."""
    if blocks == 1:
        dealt = rows.withColumns({"own": F.lit(0).cast("long"), "i": F.lit(0).cast("long"), "j": F.lit(0).cast("long")})
    else:
        dealt = rows.withColumn("own", F.pmod("g", F.lit(blocks)).cast("long")).withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
        dealt = dealt.withColumns({"i": F.least("own", "_other"), "j": F.greatest("own", "_other")})
    members = F.sort_array(F.collect_list(F.struct("g", "own", "n")))
    together = dealt.groupBy("lang", "term", "i", "j").agg(members.alias("members")).where(F.size("members") > 1)
    told = together.select("members", (F.col("i") == F.col("j")).alias("within")).mapInArrow(_tally, TALLIES)
    return told.groupBy("ga", "gb", "ca", "cb").agg(F.sum("m").alias("m"))


def group_pairs(groups: DataFrame) -> DataFrame:
    """Each two groups of a language, ga below gb, with their names, totals, numbers of terms, and v."""
    side = lambda x: groups.select("lang", "v", F.col("g").alias(f"g{x}"), F.col("source").alias(f"source_{x}"), F.col("total").alias(f"total_{x}"), F.col("n_terms").alias(f"terms_{x}"))
    return side("a").join(side("b").drop("v"), "lang").where("ga < gb")


def joint_histograms(pairs: DataFrame, rows: DataFrame, blocks: int) -> DataFrame:
    """The whole joint histogram of each pair: ga, gb, ca, cb, m, zeros included."""

    def cells(*listed: tuple[str, str, str]) -> Column:
        return F.inline(F.array(*(F.struct(*(F.expr(x).cast("long").alias(name) for x, name in zip(cell, ("ca", "cb", "m"), strict=True))) for cell in listed)))

    # a term of both is none that one of them lacks, and both lack what neither has
    both = joint_counts(rows, blocks).select("ga", "gb", cells(("ca", "cb", "m"), ("ca", "0", "-m"), ("0", "cb", "-m"), ("0", "0", "m")))
    single = rows.groupBy("g", "n").agg(F.count("*").alias("m"))
    lacks_b = pairs.join(single.withColumnRenamed("g", "ga"), "ga").select("ga", "gb", cells(("n", "0", "m")))
    lacks_a = pairs.join(single.withColumnRenamed("g", "gb"), "gb").select("ga", "gb", cells(("0", "n", "m")))
    neither = pairs.select("ga", "gb", cells(("0", "0", "v - terms_a - terms_b")))
    told = both.unionByName(lacks_b).unionByName(lacks_a).unionByName(neither)
    return told.groupBy("ga", "gb", "ca", "cb").agg(F.sum("m").alias("m")).where("m <> 0")


def pair_values(rows: DataFrame, groups: DataFrame, blocks: int) -> DataFrame:
    """lang, source, item, value: f summed over all kept terms, for each two sources of a language, in both directions."""
    pairs = materialise(group_pairs(groups), "group-pairs")
    cells = joint_histograms(pairs, rows, blocks)
    sized = cells.join(pairs.select("ga", "gb", "total_a", "total_b", "v"), ["ga", "gb"])
    f = divergence(probability(F.col("ca"), F.col("total_a"), F.col("v")), probability(F.col("cb"), F.col("total_b"), F.col("v")))
    sums = sized.groupBy("ga", "gb").agg(F.sum(f * F.col("m")).alias("value"))
    both = F.array(*(F.struct(F.col(f"source_{x}").alias("source"), F.col(f"source_{y}").alias("item")) for x, y in ("ab", "ba")))
    known = pairs.join(sums, ["ga", "gb"], "left").withColumn("value", F.coalesce("value", F.lit(0)).cast("long"))
    return known.select("lang", F.inline(both), "value").select("lang", "source", "item", "value")


def term_values(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: f of each term that a group has more often than its language."""
    total = groups.agg(F.coalesce(F.sum("n_terms"), F.lit(0))).first()[0]
    known = lookup(rows, groups.select("g", "total", "v", "lang_total", "n_terms"), "g", "n_terms", total)
    known = known.withColumns({"_p": probability(F.col("n"), F.col("total"), F.col("v")), "_q": probability(F.col("lang_n"), F.col("lang_total"), F.col("v"))})
    return known.where("_p > _q").select("lang", "source", F.col("term").alias("item"), divergence(F.col("_p"), F.col("_q")).alias("value"))


def audit(docs: DataFrame, min_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank. Part `pair`: each other source of the language, all ranks; part `term`: the terms by
    which a group differs most from its language, to the rank `top`. The largest value is first, ties by the item."""
    kept = materialise(kept_terms(term_counts(docs), min_docs), "kept-terms")
    groups = groups_of(kept)
    of_lang = groups.groupBy("lang").agg(F.count("*").alias("n"), F.first("seed").alias("seed")).agg(F.max("n"), F.max("seed")).first()
    if of_lang[0] is None:
        return groups.select("lang", "source", F.lit("pair").alias("part"), F.col("source").alias("item"), F.col("total").alias("value"), F.lit(1).alias("rank"))
    rows = kept.where("term <> ''").withColumn("g", number(of_lang[1]))
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    terms = term_values(rows, groups).withColumn("rank", order).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    pairs = pair_values(rows.select("lang", "term", "g", "n"), groups, -(-of_lang[0] // BLOCK)).withColumn("rank", order).withColumn("part", F.lit("pair"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
