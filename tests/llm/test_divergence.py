import re
from collections import Counter, defaultdict

import pytest

from segmill.llm import divergence, queries

ROWS = [
    (1, "The cat, the dog; Ünïcode ÄB x1y", "en", "a"), (2, "the THE cat", "en", "b"), (3, "cat dog bird", "en", "a"), (4, None, "en", "c"), (5, "", "en", "c"), (6, "der Hund", "de", "a"),
    (7, "the cat", None, None), (8, "der der Katze", "de", "b"), (8, "der der Katze", "de", "b"), (9, "日本語 日本語 the", "en", "b"), (10, "1 2 3 \x00\x7f-_", "fr", "z"), (None, "dog É é", "en", "d"), (11, "a" * 3000 + " the" * 900, "en", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string, term string, n long, g long, rank int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "t", 1, 2, 3) for r in rows], SCHEMA)


def plain(rows, min_docs, top):
    counts, docs, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [re.sub("[A-Z]", lambda m: m.group().lower(), w) for w in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        counts[lang, source].update(words)
        docs[lang].update(set(words))
        langs[lang].add(source)
    out = []
    for lang, sources in langs.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        whole = sum((counts[lang, s] for s in sources), Counter())

        def table(c, kept=kept):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (total + 2 * len(kept)) for t in kept}

        f = lambda p, q: (p - q) ** 2 // (p + q)
        p = {s: table(counts[lang, s]) for s in sources}
        q = table(whole)
        for s in sources:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(f(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", terms)):
                order = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, i) for i, (v, item) in enumerate(order, 1) if part == "pair" or i <= top]
    return out


def same(spark, rows, min_docs, top=10):
    got = [tuple(r) for r in divergence.audit(frame(spark, rows).repartition(3), min_docs, top).collect()]
    assert sorted(got) == sorted(plain(rows, min_docs, top))


@pytest.mark.parametrize("min_docs", [1, 2, 50])
def test_against_plain_counts(spark, min_docs):
    same(spark, ROWS, min_docs, 3)


def test_small_tables_of_tasks_and_blocks(spark, monkeypatch):
    """Tables that are sent again and again, texts in parts, sources in blocks and few pairs at once change nothing."""
    for name, value in (("ENTRIES", 3), ("SPLIT_BYTES", 20), ("BLOCK", 2), ("PAIRS", 2)):
        monkeypatch.setattr(divergence, name, value)
    rows = [(i, f"w{i % 7} x" + " abc" * (i % 4), "en", f"s{i % 9}") for i in range(60)]
    assert list(divergence.terms_of("ab c" * 30)) and sum(map(len, divergence.terms_of("ab c " * 30))) == 60
    same(spark, [*ROWS, *rows], 2)


def test_distinct_of_large_numbers():
    import numpy as np

    columns = [np.array([3, 1, 3]), np.array([2, 2, 2])]
    for sizes in ([5, 5], [1 << 40, 1 << 40]):
        (a, b), m = divergence._distinct(columns, sizes)
        assert (a.tolist(), b.tolist(), m.tolist()) == ([1, 3], [2, 2], [1, 2])


def test_joint_histogram_is_whole(spark):
    """The cells of each pair, zeros included, add up to the kept terms of the language."""
    kept = divergence.kept_terms(divergence.term_counts(frame(spark, ROWS)), 1).cache()
    groups = divergence.groups_of(kept)
    rows = kept.where("term <> ''").withColumn("g", divergence.number(groups.first()["seed"]))
    pairs = divergence.group_pairs(groups)
    cells = divergence.joint_histograms(pairs, rows.select("lang", "term", "g", "n"), 1)
    sums = {(r.ga, r.gb): r.m for r in cells.groupBy("ga", "gb").agg({"m": "sum"}).withColumnRenamed("sum(m)", "m").collect()}
    assert sums == {(r.ga, r.gb): r.v for r in pairs.collect() if r.v} and cells.where("m < 0").count() == 0
    kept.unpersist()


def test_large_counts_are_exact(spark):
    row = spark.sql("select 10000000000000L c, 70000000000001L t, 12345L v").select(divergence.probability(*map(__import__("pyspark.sql.functions", fromlist=["col"]).col, "ctv")).alias("p")).first()
    assert row.p == 1 + 10**9 * (10**13 + 2) // (70000000000001 + 2 * 12345)


def test_empty(spark):
    got = divergence.audit(frame(spark, []))
    assert got.count() == 0 and got.dtypes == divergence.audit(frame(spark, ROWS), 1).dtypes


def test_query_and_sql(spark, sf, duck):
    got = queries.op12_divergence(spark, sf)
    want = duck.execute(queries.OP12_SQL)
    names = [d[0] for d in want.description]
    rows = want.fetchall()
    assert rows and sorted(map(tuple, got.select(names).collect())) == sorted(rows)
