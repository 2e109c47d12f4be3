import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from segmill.llm import common, simhash
from segmill.llm.graph import components


def plain_fingerprint(text):
    raw = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in "\x20\x09\x0a\x0b\x0c\x0d" else c for c in raw).split(" ") if w]
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, fps):
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    low = {}
    for i, d in enumerate(ids):
        low[find(i)] = min(low.get(find(i), d), d)
    return [low[find(i)] for i in range(len(ids))]


TEXTS = [None, "", " \t\n", "One", "one two", "One TWO three", "one two three four", "É é\x1fx a b c", "a b c " * 3000, "x" * 50_000]


@pytest.mark.parametrize("long", [0, 1 << 22])
@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(monkeypatch, text, long):
    monkeypatch.setattr(simhash, "LONG", long)
    monkeypatch.setattr(simhash, "CHUNK", 1000)
    assert simhash.fingerprint(text) & (2**64 - 1) == plain_fingerprint(text)


def test_same_hash_as_spark(spark):
    (row,) = spark.sql("SELECT xxhash64('one two three') AS h").collect()
    assert simhash.fingerprint("one two three") == row.h


def test_against_brute_force(spark, make_docs):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randint(0, 99)) for _ in range(120)) for _ in range(30)]
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    for t in base:
        for _ in range(rng.choice([1, 2, 9])):
            words = t.split()
            for _ in range(rng.choice([0, 1, 2, 4])):
                words[rng.randrange(len(words))] = "new"
            rows.append((len(rows) * 7 % 1009, " ".join(words)))
    rows = list({r[0]: r for r in rows}.values())
    got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(make_docs(rows)).collect()}
    ids = [r[0] for r in rows]
    fps = [plain_fingerprint(r[1]) for r in rows]
    assert got == {d: (f, c) for d, f, c in zip(ids, fps, plain_components(ids, fps), strict=True)}


def test_every_near_pair_meets_in_a_list(spark):
    """A dense group of over a block, chains, and pairs at distance 3 in every choice of bytes."""
    rng = random.Random(5)
    center = rng.getrandbits(64)
    fps = {center}
    while len(fps) < 2300:  # two blocks
        fps.add(center ^ (1 << rng.randrange(16)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(8)))
    for a in range(8):
        for b in range(a, 8):
            for c in range(b, 8):
                x = rng.getrandbits(64)
                fps |= {x, x ^ (1 << 8 * a) ^ (2 << 8 * b) ^ (4 << 8 * c)}
    x = rng.getrandbits(64)
    for _ in range(20):  # neighbours differ in 3 bits, ends in many
        fps.add(x)
        x ^= sum(1 << b for b in rng.sample(range(64), 3))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    found = components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")))
    root = {r.node: r.root for r in found.collect()}
    label = [root.get(f, f) for f in signed]
    values = np.array(fps, np.uint64)
    own = list(range(len(fps)))

    def find(i):
        while own[i] != i:
            own[i] = own[own[i]]
            i = own[i]
        return i

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(values[:i] ^ values[i]) <= 3):
            own[find(i)] = find(int(j))
    groups = {}
    for i, lab in enumerate(label):
        groups.setdefault(find(i), set()).add(lab)
    assert all(len(g) == 1 for g in groups.values()) and len({min(g) for g in groups.values()}) == len(groups)


def test_null_ids_repeats_and_empty(spark, make_docs):
    rows = [(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (3, "a b c d"), (9, None), (8, "")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(make_docs(rows)).collect()), key=str)
    assert got == sorted([(None, None), (5, 3), (5, 3), (3, 3), (9, 8), (8, 8)], key=str)
    kept = simhash.keep_one(make_docs([*rows, (3, "a b c d")]))
    assert kept.columns == make_docs(rows).columns
    assert sorted((str(r.doc_id) for r in kept.collect())) == ["3", "8", "None"]
    assert simhash.near_duplicates(make_docs([])).count() == 0 and simhash.keep_one(make_docs([])).count() == 0


def test_components_of_a_long_chain(spark):
    order = list(range(200))
    random.Random(1).shuffle(order)
    edges = spark.createDataFrame([*zip(order, order[1:], strict=False), (1000, 1001), (1001, 1001)], "a long, b long")
    assert {r.node: r.root for r in components(edges).collect()} == {**{i: 0 for i in range(1, 200)}, 1001: 1000}


def test_lookup_of_hot_keys(spark):
    left = spark.createDataFrame([(i, 1 if i % 3 else i) for i in range(3000)] + [(-1, None)], "i long, k long")
    right = left.where("k is not null and k <> 6").groupBy("k").agg({"i": "count"}).withColumnRenamed("count(i)", "n").selectExpr("k", "n", "k * 2 as v")
    got = {r.i: r.v for r in common.lookup(left, right, "k", "n", 30).collect()}
    assert got == {**{i: 2 if i % 3 else 2 * i for i in range(3000) if i != 6}, 6: None, -1: None}


def test_keep_one_of_ids_with_several_texts(make_docs):
    a, b, c = (" ".join(f"{w}{i * i}" for i in range(60)) for w in ("red", "blue", "green"))
    # both texts of 5 are in components of their own; of 7, one text is a copy of 3's
    rows = [(5, a), (5, b), (5, b), (6, a), (3, c), (7, c), (7, "some other text than all of these"), (None, a), (9, None), (9, "")]
    kept = simhash.keep_one(make_docs(rows))
    got = sorted(((r.doc_id or 0, r.text or "") for r in kept.collect()), key=str)
    assert got == sorted([(5, a), (5, b), (3, c), (7, "some other text than all of these"), (0, a), (9, "")], key=str)
    assert kept.columns == make_docs(rows).columns


def test_keep_one_goes_by_rows(spark, make_docs):
    a, b, c = (" ".join(f"{w}{i * i}" for i in range(60)) for w in ("red", "blue", "green"))
    # two texts under one id: both stay; a copy of 3's text under an id that has another text goes; __rows is a column like any
    docs = make_docs([(5, a), (5, b), (3, c), (5, c), (4, c), (4, c), (2, "one"), (2, "one")]).withColumn("__rows", F.lit(1)).withColumn("row", F.lit(2))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == sorted([(5, a), (5, b), (3, c), (2, "one")])


def test_long_lists_are_split(spark, monkeypatch):
    """Lists over a block go to finer lists and then to blocks; no link is lost."""
    monkeypatch.setattr(simhash, "BLOCK", 40)
    rng = random.Random(9)
    fps, center = set(), rng.getrandbits(64)
    while len(fps) < 150:  # equal in five bytes, so that finer lists are long too
        fps.add(center ^ (rng.getrandbits(24) << 40))
    while len(fps) < 600:  # equal in three bytes
        fps.add((rng.getrandbits(40) << 24) | (center & 0xFFFFFF))
    for f in rng.sample(sorted(fps), 60):
        fps.add(f ^ (1 << rng.randrange(24, 64)) ^ (1 << rng.randrange(24, 64)) ^ (1 << rng.randrange(24, 64)))
    fps = sorted(fps)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    root = {r.node: r.root for r in components(simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    got = [root.get(f, f) for f in signed]
    assert got == plain_components(signed, fps)


def test_map_of_bits(spark):
    keys = spark.createDataFrame([(3 * i,) for i in range(1, 3000)], "k long")
    rows = spark.createDataFrame([(i,) for i in range(6000)] + [(None,)], "k long")
    flagged = {r.k for r in common.may_be_in(rows, keys, "k", "flag").where("flag").collect()}
    assert {3 * i for i in range(1, 2000)} <= flagged and len(flagged) < 2010
    assert common.may_be_in(rows, keys.limit(0), "k", "flag").where("flag").count() == 0


def test_result_reads_the_documents_once(spark, sf):
    """Before it, one pass makes fingerprints and one writes the rows that may go."""
    plan = simhash.keep_one(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    assert len([line for line in plan.splitlines() if "Relation" in line and "n_chars#" in line]) == 1
