import hashlib
import math

import numpy as np
import pytest

from segmill.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, _key string, n long"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], lab, "c", "k", 2) for i, v, lab in rows], SCHEMA)


def plain(rows, parts=4, entries=256, rounds=4):
    """The contract in whole numbers of Python, one vector after another."""
    good = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], lab) for i, v, lab in rows if v and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(good[0][1]) // parts
    cut = lambda v, k: v[k * width : (k + 1) * width]
    books = [[cut(v, k) for _, v, _ in good[:entries]] for k in range(parts)]
    away = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))

    def nearest(v):
        return [min((away(cut(v, k), c), e) for e, c in enumerate(books[k])) for k in range(parts)]

    for _ in range(rounds):
        told = [nearest(v) for _, v, _ in good]
        for k in range(parts):
            for e in range(len(books[k])):
                mine = [cut(v, k) for (_, v, _), at in zip(good, told, strict=True) if at[k][1] == e]
                if mine:
                    books[k][e] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    out, by_label = [], {}
    for i, v, lab in good:
        at = nearest(v)
        out.append((i, lab, "".join(f"{e:02x}" for _, e in at), sum(d for d, _ in at)))
        by_label[lab] = by_label.get(lab, 0) + out[-1][3]
    sha = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return [(*r, by_label[r[1]], sha) for r in out]


def same(spark, rows, **settings):
    got = [tuple(r) for r in vector_codes.compress(frame(spark, rows).repartition(3), **settings).collect()]
    assert sorted(got, key=str) == sorted(plain(rows, **settings), key=str)


def test_against_plain_arithmetic(spark):
    rng = np.random.default_rng(5)
    rows = [(1000 - 3 * i, (rng.standard_normal(8) * 3).tolist(), None if i % 7 == 0 else int(i % 3)) for i in range(400)]
    # repeats, ties and what is no vector
    rows += [(4, rows[0][1], 1), (4, rows[1][1], None), (None, rows[2][1], 2), (-5, [0.0] * 8, 0), (-5, [0.0] * 8, 0), (-6, [-1 / 1024] * 8, 0)]
    rows += [(1, None, 0), (2, [math.nan] + [1.0] * 7, 0), (3, [math.inf] + [1.0] * 7, 0), (3, [None] + [1.0] * 7, 0), (3, [], 0)]
    same(spark, rows)
    same(spark, rows, parts=2, entries=16, rounds=3)


def test_ties_unused_entries_and_few_rows(spark):
    same(spark, [(i, [float(i // 4)] * 4, 0) for i in range(40)])
    same(spark, [(7, [0.5, -0.5, 0.25, -0.25], None)])


def test_rounds_down():
    assert (np.array([-3, 3]) // 2).tolist() == [-2, 1]


def test_other_lengths_have_no_code(spark):
    rows = [(1, [1.0] * 8, 0), (2, [2.0] * 8, 0), (3, [1.0] * 4, 0)]
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in vector_codes.compress(frame(spark, rows)).collect()}
    assert got == {1: ("00000000", 0, 0), 2: ("01010101", 0, 0), 3: (None, None, 0)}


def test_without_vectors(spark):
    for rows in ([], [(1, None, 0)]):
        got = vector_codes.compress(frame(spark, rows))
        assert got.count() == 0 and got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]


def test_what_would_be_inexact_raises(spark):
    with pytest.raises(Exception, match="for exact distances"):
        vector_codes.compress(frame(spark, [(1, [1e30] * 8, 0)])).collect()
    with pytest.raises(ValueError, match="don't divide"):
        vector_codes.compress(frame(spark, [(1, [1.0] * 6, 0)]))


def test_largest_components_are_exact():
    top = vector_codes.most(8) - 1
    block, books = np.full((1, 8), top), np.full((4, 2, 2), -top)
    nearest, error = vector_codes.assign(block, books)
    assert nearest.tolist() == [[0] * 4] and error.tolist() == [8 * (2 * top) ** 2]


def test_a_round_shuffles_sums_only(spark):
    rows = frame(spark, [(i, [float(i % 9)] * 8, 0) for i in range(3000)]).repartition(2)
    sent = spark.sparkContext.broadcast(vector_codes.first_books(rows, 4, 256))
    told = vector_codes.entry_sums(rows, sent)
    assert told.count() == 4 * 9 and told.agg({"n": "sum"}).first()[0] == 4 * 3000


def test_query_and_sql(spark, sf, duck):
    got = queries.op13_vector_codes(spark, sf)
    want = duck.execute(queries.OP13_SQL)
    names = [d[0] for d in want.description]
    assert sorted(map(tuple, got.select(names).collect())) == sorted(want.fetchall())
