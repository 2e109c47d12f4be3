import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from segmill.llm import block_search, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, key string, n long, node long"
INF = float("inf")
ODD = [None, [], [0.0] * 8, [math.nan] + [1.0] * 7, [INF] + [1.0] * 7, [None] + [1.0] * 7, [1.0, 2.0]]


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, "k", 1, 2) for i, v, lab in rows], SCHEMA)


def usable(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def clustered(seed, n=300, dim=16, spread=0.09):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((40, dim))
    x = centers[rng.integers(0, 40, n)] + spread * rng.standard_normal((n, dim)) * rng.integers(0, 4, (n, 1))
    return x.astype(np.float32)


def plain_near(rows, least=0.93):
    good = [(i, np.array(v, np.float32).astype(float), lab) for i, v, lab in rows if i is not None and lab is not None and usable(v)]
    links, near = {}, {}
    for a, (i, x, lab) in enumerate(good):
        for b, (j, y, other) in enumerate(good):
            if a != b and lab == other and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links[i] = links.get(i, 0) + 1
                near.setdefault(i, set()).add(j)
    out = []
    for i, _, _ in rows:
        seen, todo = {i}, [i]
        while todo:
            for j in near.get(todo.pop(), ()):
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        low = None if i is None else min(seen)
        out.append((i, links.get(i, 0), low, i is not None and low == i))
    return out


@pytest.mark.parametrize("block", [7])
def test_near_vectors(spark, monkeypatch, block):
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    x = clustered(1)
    rows = [(1000 - 3 * i, v.tolist(), int(i % 5 == 0)) for i, v in enumerate(x)]
    rows += [(2000 + i, x[0].tolist(), 0) for i in range(9)] + [(2100, x[0].tolist(), None), (None, x[0].tolist(), 0)]
    rows += [(3000 + i, v, 0) for i, v in enumerate(ODD)] + [(3100, [2.0, 4.0], 0), (3101, [1e38] * 8, 0), (3102, [1e-40] * 8, 0)]
    # at this recall no link is missed; what the query's own recall is, is another test
    got = [tuple(r) for r in near_vectors.near_duplicates(frame(spark, rows), recall=1 - 1e-7).collect()]
    assert sorted(got, key=str) == sorted(plain_near(rows), key=str)


def test_near_vectors_in_64_dimensions(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = [tuple(r) for r in near_vectors.near_duplicates(frame(spark, rows)).collect()]
    assert sorted(got) == sorted(plain_near(rows))


def hard_pairs(dim, n, seed=2):
    """Pairs with a cosine of just 0.93, the hardest there are."""
    rng = np.random.default_rng(seed)
    x = near_vectors.unit(rng.standard_normal((n, dim)))
    y = rng.standard_normal((n, dim))
    y = near_vectors.unit(y - (y * x).sum(axis=1, keepdims=True) * x)
    return x, 0.9301 * x + math.sqrt(1 - 0.9301**2) * y


@pytest.mark.parametrize(("dim", "bits"), [(16, 12), (64, 24), (256, 18)])
def test_recall_of_the_query(spark, dim, bits):
    x, y = hard_pairs(dim, 700)
    rows = [(2 * i + k, v.tolist(), 0) for i in range(len(x)) for k, v in enumerate((x[i], y[i]))]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    found = {r.vec_id: r.n_links for r in near_vectors.near_duplicates(frame, bits=bits).collect()}
    every = near_vectors.unit(np.concatenate([x, y]))
    all_links = int(np.triu(every @ every.T >= 0.93, 1).sum())
    recall = sum(found.values()) / 2 / all_links
    print(dim, bits, recall)
    assert all_links >= 700 and 0.95 <= recall <= 1


@pytest.mark.parametrize("few", [3])
def test_large_filters(spark, monkeypatch, few):
    """A dense group in blocks of large filters counts each link once, beside pairs of small ones."""
    monkeypatch.setattr(near_vectors, "FEW", few)
    monkeypatch.setattr(near_vectors, "BLOCK", 16)
    rng = np.random.default_rng(7)
    center = rng.standard_normal(32)
    dense = center + 0.1 * rng.standard_normal((90, 32))
    others = np.repeat(rng.standard_normal((40, 32)), 2, axis=0) + 0.05 * rng.standard_normal((80, 32))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([dense, others]))]
    got = [tuple(r) for r in near_vectors.near_duplicates(frame(spark, rows), recall=1 - 1e-7).collect()]
    assert sorted(got) == sorted(plain_near(rows))


def test_decoder_finds_all_directions():
    """All directions above the threshold, and no others."""
    for dim, bits in ((12, 11), (40, 20)):
        code = near_vectors.Code(dim, bits, 3)
        x = near_vectors.unit(np.random.default_rng(3).standard_normal((20, dim)))
        total = np.zeros((len(x), 1))
        for s in code.scores(x):
            total = (total[:, :, None] + s[:, None, :]).reshape(len(x), -1)
        assert total.shape[1] == 1 << bits
        threshold = float(np.quantile(total, 0.999))
        rows, numbers = code.decode(x, threshold)
        assert set(zip(rows.tolist(), numbers.tolist(), strict=True)) == set(zip(*map(np.ndarray.tolist, np.nonzero(total >= threshold)), strict=True))


def test_bits_are_of_the_own_label(spark, monkeypatch):
    """What other labels and lengths hold doesn't change a label's codes; a label's filters stay small as it grows."""
    assert near_vectors.bits_for(10) == near_vectors.bits_for(1 << 19) == 16 and near_vectors.bits_for((1 << 19) + 1) == 20 and near_vectors.bits_for(10**9) == 28
    monkeypatch.setattr(near_vectors, "FIRST", 3)
    small = [(i, [1.0, i, 0.5], 1) for i in range(8)]
    rows = small + [(100 + i, [1.0, i, 0.5], 2) for i in range(50)] + [(200 + i, [1.0, i], 1) for i in range(200)]
    nodes = lambda some: frame(spark, some).select(F.col("vec_id").alias("node"), F.lit(1).alias("n"), "label", "embedding")
    alone = {r.node: r.bits for r in near_vectors.with_bits(nodes(small), None).collect()}
    beside = {r.node: r.bits for r in near_vectors.with_bits(nodes(rows), None).collect()}
    assert set(alone.values()) == {16} and beside == {i: near_vectors.bits_for(8 if i < 100 else 50 if i < 200 else 200) for i, *_ in rows}
    assert set(beside.values()) == {16, 20, 24}
    assert near_vectors.with_bits(nodes(rows), 12).where("bits <> 12").count() == 0 and near_vectors.with_bits(nodes([]), None).count() == 0


@pytest.mark.parametrize("dim", [8, 32, 768, 1536])
def test_recall_of_filters(dim):
    """The hardest pairs share a filter at the stated recall, in short and in long vectors."""
    x, y = hard_pairs(dim, 400)
    one, two = (set(zip(*map(np.ndarray.tolist, near_vectors.filters_of(v, 16, 0.93, near_vectors.RECALL)), strict=True)) for v in (x, y))
    recall = len({row for row, _ in one & two}) / 400
    print(dim, recall, len(one) / 400)
    assert recall >= 0.96


def test_no_vectors(spark):
    assert near_vectors.near_duplicates(frame(spark, [])).count() == 0
    assert [tuple(r) for r in near_vectors.near_duplicates(frame(spark, [(1, None, 1)])).collect()] == [(1, 0, 1, True)]
    assert block_search.nearest(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0


@pytest.mark.parametrize("blocks", [(2048, 8192), (3, 50)])
def test_search(spark, blocks):
    x = clustered(4, spread=0.02)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)] + [(500 + i, x[40].tolist(), 0) for i in range(30)]
    rows += [(1000 + 20 * i, v, 0) for i, v in enumerate(ODD)] + [(1001, [3.0, 1.0], None), (None, x[0].tolist(), 0), (7, x[7].tolist(), 0)]
    got = block_search.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0, 20, *blocks).collect()
    good = {i: np.array(v, np.float32).astype(float) for i, v, _ in rows if i is not None and usable(v)}
    want = []
    for q, x in good.items():
        if q % 20 == 0:
            others = []
            for i, y in good.items():
                if i != q and len(y) == len(x):
                    total = 0.0
                    for s, t in zip(x, y, strict=True):
                        total += s * t
                    others.append((-total, i))
            want += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(others)[:20], 1)]
    assert sorted(tuple(r) for r in got) == sorted(want)


@pytest.mark.parametrize("dim", [768, 1536, 4096])
def test_tiles_of_long_vectors(dim):
    """Whole numbers, so that quantising loses nothing, whose large partial sums cancel."""
    rng = np.random.default_rng(dim)
    half = rng.integers(60, 128, (400, dim // 2))
    rows = np.concatenate([half, -half + rng.integers(-1, 2, half.shape)], axis=1).astype(float)
    rows[:, 0] = 127
    queries = np.concatenate([np.full((24, dim // 2), 127.0), np.full((24, dim // 2), 127.0)], axis=1)
    queries[:, 1] = np.arange(24)
    q, r, score = block_search.nearest_in_tile(np.arange(24) + 10_000, queries, np.arange(400), rows, 20)
    exact = queries.astype(int) @ rows.astype(int).T
    want = {(i + 10_000, j, float(exact[i, j])) for i in range(24) for j in sorted(range(400), key=lambda j: (-exact[i, j], j))[:20]}
    assert set(zip(q.tolist(), r.tolist(), score.tolist(), strict=True)) == want
    assert block_search.whole_products(np.full((1, dim), 127, np.float32), np.full((1, dim), 127, np.float32))[0, 0] == 127 * 127 * dim


def test_products_beyond_double_precision(spark):
    """They are infinite, or minus infinity where they cancel to no number, and no row is lost."""
    rng = np.random.default_rng(9)
    x = [(1e200 * v).tolist() for v in rng.standard_normal((60, 4))] + [v.tolist() for v in rng.standard_normal((20, 4))]
    frame = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")
    got = block_search.nearest(frame, F.col("vec_id") % 20 == 0, 20).collect()
    assert len(got) == 4 * 20
    for q in (0, 20, 40, 60):
        want = []
        for i, y in enumerate(x):
            total = 0.0
            for s, t in zip(x[q], y, strict=True):
                total += s * t
            if i != q:
                want.append((math.inf if math.isnan(total) else -total, i))
        assert [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == [(i, -s) for s, i in sorted(want)[:20]]
