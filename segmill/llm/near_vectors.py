"""Near-duplicate vectors by spherical-cap filters.

A filter is a cap around a random direction; near vectors share filters. The directions are CODES independent product codes:
after a random rotation a vector is cut into blocks, each block has its own random code words, and every combination of code
words is a direction. A vector is in every filter whose direction has an inner product with it of at least one threshold.
The list decoder finds them without trying all directions: block by block it keeps the partial sums that can still reach the
threshold with the best words of the remaining blocks.

The threshold is measured for the dimension: the largest for which `recall` of pairs with a cosine of just `least` share a
filter. As rotations are random, that holds for any such pair, and nearer pairs share more.

Vectors are joined on filters by number only: a row for each vector and filter is two numbers. Filters with one vector go;
those with up to FEW give candidate pairs, each once, for which the vectors are looked up. A filter with more vectors gets
these, in tasks by pairs of blocks, and a pair that shares several such filters counts in the smallest; such pairs aren't
candidates elsewhere. Every pair is verified by the cosine in double precision, so link counts are exact for the links found.

Equal vectors are one node, so copies cost nothing here. Only vectors with the same label (not null) and the same length are
compared. A vector that is null, empty, zero or holds null, NaN or infinite components links with nothing; neither does a row
with a null vec_id, whose component is null and which isn't kept. Rows that repeat a vec_id each get a result. Extra
columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm.common import groups_of, lookup, materialise, may_be_in, spread_blocks
from segmill.llm.embedding_common import usable
from segmill.llm.graph import components

#: Vectors that one task compares with each other, or with as many of another block.
BLOCK = 1024
#: The most vectors of a filter whose pairs are candidates.
FEW = 32
CODES, RECALL, SEED = 16, 0.985, 5
#: Binary logarithm of the number of vectors for which a code has the fewest directions, of which this is one, too.
FIRST, LEAST_BITS = 19, 16
#: Pairs by which the threshold is measured.
PAIRS = 1000
#: Candidates of the decoder that are held at once.
HELD = 1 << 21


def bits_for(vectors: int) -> int:
    """Binary logarithm of the number of directions of a code for so many vectors of one label and length, so that a filter has
    few that aren't near: 16 up to 2^19 vectors, then 4 more for each 16 times as many. Recall is the same at all."""
    return LEAST_BITS + 4 * max(0, math.ceil((math.log2(max(1, vectors)) - FIRST) / 4))


class Code:
    """One product code for vectors of `dim` components."""

    def __init__(self, dim: int, bits: int, number: int) -> None:
        rng = np.random.default_rng([SEED, dim, bits, number])
        n_blocks = max(1, min(dim, math.ceil(bits / 12)))
        self.rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
        self.edges = np.linspace(0, dim, n_blocks + 1).astype(int)
        self.words = []
        for i in range(n_blocks):
            words = rng.standard_normal((1 << ((bits + i) // n_blocks), self.edges[i + 1] - self.edges[i]))
            self.words.append(words / np.linalg.norm(words, axis=1, keepdims=True))

    def scores(self, x: np.ndarray) -> list[np.ndarray]:
        """For each block, the inner products of rows and words."""
        turned = x @ self.rotation
        return [turned[:, a:b] @ w.T for a, b, w in zip(self.edges[:-1], self.edges[1:], self.words, strict=True)]

    def decode(self, x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Rows and numbers of all directions with an inner product of at least the threshold, sorted by row."""
        scores = self.scores(x)
        # what the blocks after each one can add at most
        best = [np.zeros(len(x))]
        for s in reversed(scores[1:]):
            best.append(best[-1] + s.max(axis=1))
        rows, sums, numbers = np.arange(len(x)), np.zeros(len(x)), np.zeros(len(x), np.int64)
        for s, rest in zip(scores, reversed(best), strict=True):
            parts = []
            step = max(1, HELD // s.shape[1])
            for i in range(0, len(rows), step):
                part = rows[i : i + step]
                both = sums[i : i + step, None] + s[part]
                a, b = np.nonzero(both >= threshold - rest[part][:, None])
                parts.append((part[a], both[a, b], numbers[i : i + step][a] * s.shape[1] + b))
            if parts:
                rows, sums, numbers = (np.concatenate(c) for c in zip(*parts, strict=True))
        return rows, numbers


def near_pairs(dim: int, least: float, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of unit vectors with a cosine of `least`."""
    rng = np.random.default_rng([SEED, dim])
    x = unit(rng.standard_normal((n, dim)))
    y = rng.standard_normal((n, dim))
    y = unit(y - (y * x).sum(axis=1, keepdims=True) * x)
    return x, least * x + math.sqrt(1 - least * least) * y


@lru_cache(maxsize=8)
def codes(dim: int, bits: int, least: float, recall: float) -> tuple[list[Code], float]:
    """The codes for a dimension, and the threshold."""
    # of few components, more directions would part near vectors
    bits = min(bits, max(2, dim - 2))
    found = [Code(dim, bits, i) for i in range(CODES)]
    if dim < 2 or least >= 1:
        return found[:1], -math.inf
    x, y = near_pairs(dim, least, PAIRS)
    one, two = found[0].scores(x), found[0].scores(y)
    shared = [_common([s[i] for s in one], [s[i] for s in two]) for i in range(PAIRS)]
    # codes are independent, so each must find a part only
    part = 1 - (1 - recall) ** (1 / CODES)
    return found, float(np.quantile(shared, 1 - part))


def _common(one: list[np.ndarray], two: list[np.ndarray]) -> float:
    """The largest threshold that some direction reaches with two vectors, given as scores of their blocks' words, to a
    thousandth."""
    best = [int((s + t).argmax()) for s, t in zip(one, two, strict=True)]
    low = min(sum(s[i] for s, i in zip(part, best, strict=True)) for part in (one, two))
    high = min(sum(s.max() for s in part) for part in (one, two))
    while high - low > 1e-3:
        middle = (low + high) / 2
        a, b = np.zeros(1), np.zeros(1)
        for k, (s, t) in enumerate(zip(one, two, strict=True)):
            rest_a, rest_b = (middle - sum(x.max() for x in part[k + 1 :]) for part in (one, two))
            a, b = (a[:, None] + s).ravel(), (b[:, None] + t).ravel()
            on = (a >= rest_a) & (b >= rest_b)
            a, b = a[on], b[on]
        low, high = (middle, high) if len(a) else (low, middle)
    return low


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # squares of very large or small components stay finite
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def filters_of(x: np.ndarray, bits: int, least: float, recall: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows and filters of unit vectors; a filter is the number of its code and that of its direction there."""
    listed, threshold = codes(x.shape[1], bits, least, recall)
    rows, numbers = [], []
    for i, code in enumerate(listed):
        a, b = code.decode(x, threshold)
        rows.append(a)
        numbers.append(b * CODES + i)
    return np.concatenate(rows), np.concatenate(numbers)


def _by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of the vectors of each length, and these as a matrix."""
    lengths, start = np.diff(column.offsets.to_numpy()), column.offsets.to_numpy()[:-1]
    values = column.values.to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        yield at, values[start[at][:, None] + np.arange(dim)]


def with_bits(nodes: DataFrame, bits: int | None) -> DataFrame:
    """nodes with the bits of their codes: what the number of vectors of their own label and length asks for, whatever others there
    are."""
    if bits is not None:
        return nodes.withColumn("bits", F.lit(bits))
    group = F.xxhash64("label", F.size("embedding"))
    sizes = materialise(nodes.groupBy(group.alias("group")).agg(F.count("*").alias("rows")), "label-sizes")
    most, total = sizes.agg(F.coalesce(F.max("rows"), F.lit(0)), F.coalesce(F.sum("rows"), F.lit(0))).first()
    steps = {b: 1 << FIRST + b - LEAST_BITS for b in range(LEAST_BITS, bits_for(most), 4)}
    asked = F.lit(bits_for(most))
    for b, upto in sorted(steps.items(), reverse=True):
        asked = F.when(F.col("rows") <= upto, b).otherwise(asked)
    if not steps:
        return nodes.withColumn("bits", asked)
    return lookup(nodes.withColumn("group", group), sizes.select("group", "rows", asked.alias("bits")), "group", "rows", total).drop("group")


def decoded(nodes: DataFrame, least: float, recall: float) -> DataFrame:
    """node and key: a row for each vector and filter; the key stands for length, label and filter."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, label, vectors, bits = (batch.column(c) for c in ("node", "label", "embedding", "bits"))
            asked = bits.to_numpy()
            for at, x in _by_length(vectors):
                for b in np.unique(asked[at]).tolist():
                    mine = asked[at] == b
                    rows, filters = filters_of(unit(x[mine]), b, least, recall)
                    take = pa.array(at[mine][rows])
                    columns = [node.take(take), label.take(take), pa.array(np.full(len(rows), x.shape[1], np.int64)), pa.array(filters)]
                    yield pa.RecordBatch.from_arrays(columns, names=["node", "label", "dim", "filter"])

    rows = nodes.select("node", "label", "embedding", "bits").mapInArrow(decode, "node long, label long, dim long, filter long")
    return rows.select("node", F.xxhash64("dim", "label", "filter").alias("key"))


def linked(vectors: np.ndarray, filters: list[np.ndarray], own: np.ndarray, this: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of vectors with a cosine of at least `least` that share no filter below `this`. own: the block of
    each; where there are two, only pairs across count."""
    x = unit(vectors)
    near = np.triu(x @ x.T >= least, 1)
    if own.min() != own.max():
        near &= own[:, None] != own[None, :]
    a, b = np.nonzero(near)
    if not len(a):
        return a, b
    below = [f[f < this] for f in filters]
    numbers, at = np.unique(np.concatenate(below), return_inverse=True)
    if len(numbers):
        member = np.zeros((len(x), len(numbers)), np.float32)
        member[np.repeat(np.arange(len(x)), [len(f) for f in below]), at] = 1
        fresh = (member @ member.T)[a, b] == 0
        a, b = a[fresh], b[fresh]
    return a, b


FOUND = "node long, links long, low long"


def _in_large_filters(members: DataFrame, least: float) -> DataFrame:
    """node, links (rows linked to it) and low (a smallest linked node)."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups_of(batches, ["key", "i", "j"]):
            column = {name: group.column(name) for name in group.schema.names}
            listed, ends = column["filters"].values.to_numpy(), column["filters"].offsets.to_numpy()
            filters = [listed[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            node, n, own = (column[c].to_numpy() for c in ("node", "n", "own"))
            labels = column["label"].to_numpy()
            for at, x in _by_length(column["embedding"]):
                # a key stands for one length and label, unless hashes meet
                for label in np.unique(labels[at]):
                    some = labels[at] == label
                    yield from _counted(node[at][some], n[at][some], x[some], [filters[i] for i in at[some]], own[at][some], column["key"][0].as_py(), least)

    return members.mapInArrow(find, FOUND)


def _counted(node: np.ndarray, n: np.ndarray, vectors: np.ndarray, filters: list[np.ndarray], own: np.ndarray, this: int, least: float) -> Iterator[pa.RecordBatch]:
    a, b = linked(vectors, filters, own, this, least)
    if not len(a):
        return
    links = np.bincount(a, n[b], len(node)) + np.bincount(b, n[a], len(node))
    low = node.copy()
    while True:
        before = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        if (low == before).all():
            break
    at = np.flatnonzero(links)
    yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(links[at].astype(np.int64)), pa.array(low[at])], names=["node", "links", "low"])


def _only(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """The nodes that may be among the ends, so that other vectors aren't shuffled."""
    return may_be_in(nodes, ends, "node", "asked").where("asked").drop("asked")


def _of_pairs(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The same for candidate pairs (a, b)."""
    ends = _only(nodes, pairs.select(F.explode(F.array("a", "b")).alias("node")))

    def side(name: str) -> DataFrame:
        return ends.select(F.col("node").alias(name), *(F.col(c).alias(f"{c}_{name}") for c in ("label", "n", "embedding")))

    # both sides may be large
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where((F.col("label_a") == F.col("label_b")) & (F.size("embedding_a") == F.size("embedding_b")))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n_a, n_b = (batch.column(c).to_numpy() for c in ("a", "b", "n_a", "n_b"))
            for (at, x), (_, y) in zip(_by_length(batch.column("embedding_a")), _by_length(batch.column("embedding_b")), strict=True):
                near = at[(unit(x) * unit(y)).sum(axis=1) >= least]
                # either end of a link
                columns = [(a, b), (n_b, n_a), (np.minimum(a, b), np.minimum(a, b))]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([one[near], two[near]])) for one, two in columns], names=["node", "links", "low"])

    return both.select("a", "b", "n_a", "n_b", "embedding_a", "embedding_b").mapInArrow(verify, FOUND)


def candidates(shared: DataFrame, large: DataFrame) -> DataFrame:
    """The pairs (a, b), each once, of filters with up to FEW vectors; not those that share a large filter."""
    few = shared.where(F.col("size") <= FEW).groupBy("key").agg(F.sort_array(F.collect_list("node")).alias("nodes"))
    after = lambda i: F.slice("nodes", i + 2, F.greatest(F.size("nodes") - i - 1, F.lit(0)))
    ahead = F.transform("nodes", lambda x, i: F.transform(after(i), lambda y: F.struct(x.alias("a"), y.alias("b"))))
    pairs = few.select(F.explode(F.flatten(ahead)).alias("p")).select("p.a", "p.b").where("a <> b").distinct()
    sides = (large.select(F.col("node").alias(x), F.col("filters").alias(f"filters_{x}")) for x in "ab")
    pairs = pairs.join(next(sides), "a", "left").join(next(sides), "b", "left")
    return pairs.where(~F.coalesce(F.arrays_overlap("filters_a", "filters_b"), F.lit(False))).select("a", "b")


def found_links(nodes: DataFrame, least: float, bits: int | None, recall: float) -> DataFrame:
    """node, links and low, several rows for a node: what is linked to it and a smaller node that it is linked to."""
    rows = materialise(decoded(with_bits(nodes, bits), least, recall), "filters")
    sizes = materialise(rows.groupBy("key").agg(F.count("*").alias("size")).where("size > 1"), "shared-filters")
    # filters with as many vectors as a share of all are looked up by broadcast
    shared = lookup(rows, sizes.withColumn("rows", F.col("size")), "key", "rows", max(1, rows.count())).where("size is not null")
    shared = materialise(shared, "shared")
    large = materialise(shared.where(F.col("size") > FEW).groupBy("node").agg(F.sort_array(F.collect_list("key")).alias("filters")), "large-filters")
    members = _only(nodes, large).join(large, "node").withColumn("key", F.explode("filters"))
    in_large = _in_large_filters(spread_blocks(members, ["key"], "node", BLOCK), least)
    return _of_pairs(materialise(candidates(shared, large), "candidates"), nodes, least).unionByName(in_large)


def _nodes(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """key, node and n of the distinct vectors; and node, n, label and embedding. Only vectors that may repeat are shuffled."""
    known = keyed.where(F.col("key").isNotNull())
    groups = materialise(known.groupBy("key").agg(F.min("vec_id").alias("node"), F.count("*").alias("n")), "vectors")
    told = may_be_in(known, groups.where("n > 1"), "key", "many")
    once = told.where("not many").select(F.col("vec_id").alias("node"), F.lit(1).cast("long").alias("n"), "label", "embedding")
    many = lookup(told.where("many").drop("many"), groups.withColumn("rows", F.col("n")), "key", "rows", max(1, groups.agg(F.sum("n")).first()[0] or 0))
    first = many.where(F.col("vec_id") == F.col("node")).dropDuplicates(["key"]).select("node", "n", "label", "embedding")
    return groups, materialise(once.unionByName(first), "nodes")


def near_duplicates(embeddings: DataFrame, least: float = 0.93, bits: int | None = None, recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row. bits: the logarithm of each code's directions, by default what
    the number of vectors of a label and length asks for. Different vectors under one vec_id are one vertex."""
    good = usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull()
    # of equal vectors one is a node; the key stands for label and components
    key = F.when(good, F.unhex(F.md5(F.concat_ws(",", F.col("label").cast("string"), F.col("embedding").cast("array<string>")))))
    keyed = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding", key.alias("key"))
    rows = keyed.select("vec_id", "key")
    groups, nodes = _nodes(keyed)
    found = materialise(found_links(nodes, least, bits, recall), "links")
    total = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked_to = components(found.select(F.col("node").alias("a"), F.col("low").alias("b")))
    named = groups.join(total, "node", "left").join(linked_to, "node", "left")
    named = named.select("key", "n", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("root", "node").alias("component_id"))
    result = lookup(rows, named, "key", "n", max(1, rows.count()))
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id"))
    return result.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"))
