"""Operators that learn: held-out accuracy, and defined results for odd rows."""

import math
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from plain_models import Toxicity
from pyspark.sql import functions as F

from segmill.llm import language, quality, toxicity
from segmill.llm.common import crc_fold

BIG = "/root/testdata/sf0.1"
ODD = [(1, None), (2, ""), (3, "123 ... !"), (4, "word " * 50_000), (4, "word " * 50_000), (None, "the"), (5, "²")]


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = (spark.read.parquet(f"{BIG}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels


def joined(result, other, column):
    rows = result.join(other, "doc_id").where("held_out").select("predicted" if "predicted" in result.columns else "lang_pred", column).collect()
    return np.array([(a, b) for a, b in rows])


def test_quality(tables):
    docs, labels = tables
    got = joined(quality.judge(docs, labels), labels, "quality")
    assert (got[:, 0] == got[:, 1]).mean() > 0.98


def test_toxicity(tables):
    docs, labels = tables
    got = joined(toxicity.judge(docs, labels), labels, "toxic")
    toxic = got[:, 1] == 1
    assert got[toxic, 0].mean() > 0.85 and got[~toxic, 0].mean() < 0.03


def test_language(tables):
    docs, _ = tables
    got = joined(language.identify(docs).drop("score"), docs, "lang")
    assert (got[:, 0] == got[:, 1]).mean() > 0.99


def test_odd_rows(spark, make_docs, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    both = docs.withColumn("doc_id", F.col("doc_id") + 100).unionByName(make_docs(ODD).select("doc_id", "text", "lang"))
    moved = labels.withColumn("doc_id", F.col("doc_id") + 100)
    for result in (quality.judge(both, moved), toxicity.judge(both, moved), language.identify(both)):
        rows = [r for r in result.collect() if r.doc_id is None or r.doc_id < 6]
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        assert {(r.doc_id, r.held_out) for r in rows} == {(d, crc_fold(d, 4) == 2 if "lang_pred" in result.columns else crc_fold(d, 5) == 0) for d, _ in ODD}
    by_id = {r.doc_id: r.lang_pred for r in language.identify(both).collect()}
    assert {d: by_id[d] for d in (1, 2, 3, 5)} == dict.fromkeys((1, 2, 3, 5), "und") and by_id[None] == "en"


def test_nothing_to_learn_from(spark, make_docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make_docs([(1, "a", None), (2, None, None)])
    assert {r.score for r in quality.judge(docs, none).collect()} == {0.5}
    assert {r.score for r in toxicity.judge(docs, none).collect()} == {0.0}
    assert {r.lang_pred for r in language.identify(docs).collect()} == {"und"}
    empty = make_docs([])
    assert quality.judge(empty, none).count() == toxicity.judge(empty, none).count() == language.identify(empty).count() == 0


def test_labels_are_no_inputs(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = labels.withColumns({c: F.when(held, 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    for judge in (quality.judge, toxicity.judge):
        one, two = ({r.doc_id: round(r.score, 9) for r in judge(docs, x).collect()} for x in (labels, other))
        assert one == two


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_is_edit_distance():
    import random

    rng = random.Random(1)
    terms = {"idiot": 0.9, "moron": 0.9, "scum": 0.9, "worthlessness": 0.9, "lowe*": 0.9}
    matcher = toxicity.Matcher(toxicity.Lexicon(terms))
    words = [t for t in terms if not t.endswith("*")]
    for _ in range(4000):
        word = list(rng.choice(words))
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(word) + 1)
            word[i : i + rng.randint(0, 1)] = rng.choice(["", "x", "o", "t"])
        word = "".join(word)
        near = sorted((d, t) for t in words if (d := distance(word, t)) <= (len(t) >= 5) + (len(t) >= 10))
        got = matcher.match(word)
        assert (got is None) == (not near), word
        if near:
            assert got[1] == near[0][0], word
    assert matcher.match("lowering") == ("lowe*", 0) and matcher.match("lower") == ("lowe*", 0) and matcher.match("low") is None


def test_beginnings_keep_the_misspellings_of_their_words(spark, make_docs):
    rows, marks = [], []
    names = [a + b for a in "bdfglnprtv" for b in ("ola", "emi", "uka", "ano", "iru", "ebo")]
    for i in range(400):
        a, b, c = names[i % 60], names[(7 * i + i // 60) % 60], names[(11 * i + 3) % 60]
        bad = ("idiot", "idiots", "disgusting", "disgustng")[i // 10 % 4] if i % 10 == 0 else "zebra"
        rows.append((i, f"{a} {b} {bad} {c} {a}"))
        marks.append((i, 1, int(i % 10 == 0)))
    labels = spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit(make_docs(rows), labels, folds=1, held_out=1)
    assert any(t.endswith("*") and "idiot".startswith(t[:-1]) for t in lexicon.terms)
    matcher = toxicity.Matcher(lexicon)
    for word, errors in (("idjot", 1), ("ixiot", 1), ("idot", 1), ("dsigusting", 2)):
        found = matcher.match(word)
        assert found and found[1] == errors, word
        assert matcher.score(f"bola demi {word} luka bola")[1] == 1
    # words as they are count for their beginning
    assert {matcher.match(w)[0][-1] for w in ("idiot", "idiots", "disgusting")} == {"*"} and matcher.match("bola") is None


def test_all_ngrams_of_the_sample_are_kept(spark, make_docs):
    """A language with few texts keeps all of its n-grams beside one with many; the sample is bounded in rows and characters."""
    import random

    rng = random.Random(3)
    texts = lambda letters, n: [" ".join("".join(rng.choices(letters, k=5)) for _ in range(30)) for _ in range(n)]
    rows = [(i, t, "aa") for i, t in enumerate(texts("abcdefghijklmnop", 300))] + [(1000 + i, t, "bb") for i, t in enumerate(texts("mnopqr", 4))]
    model = language.fit(make_docs(rows), F.lit(True))
    counts = {lang: Counter(g for _, t, x in rows if x == lang for w in t.split() for g in language.grams(w)) for lang in ("aa", "bb")}
    assert model.languages == ["aa", "bb"] and model.rows.keys() == counts["aa"].keys() | counts["bb"].keys()
    for gram in [*list(model.rows)[::7], "zzz"]:
        want = [math.log((counts[x][gram] + 0.5) / (counts[x].total() + 0.5 * (len(model.rows) + 1))) for x in ("aa", "bb")]
        assert model.log_probabilities(gram) == pytest.approx(want)
    scorer = language.Scorer(model)
    assert all(language.label(t, scorer)[0] == "bb" for t in texts("mnopqr", 20)) and all(language.label(t, scorer)[0] == "aa" for t in texts("abcdefghijklmnop", 20))
    few = language.fit(make_docs(rows), F.lit(True), chars=5 * len(rows[0][1]))
    assert 0 < len(few.rows) < len(model.rows)


def test_memory_with_many_languages(spark, monkeypatch):
    """400 languages: what a worker keeps is bounded in cells and bytes, whatever the words are."""
    n, rng = 400, np.random.default_rng(1)
    rows = {g: i for i, g in enumerate(dict.fromkeys(a + b + c for a in "abcdefghijklm" for b in "nopqrstuvwxyz" for c in "abcdefghijklmnopqrstuvwxyz"))}
    starts = np.arange(len(rows) + 1) * 3
    model = language.Model([f"l{i:03}" for i in range(n)], rows, np.full(n, -12.0), starts, rng.integers(0, n, 3 * len(rows)).astype(np.int32), rng.random(3 * len(rows)), {})
    scorer = language.Scorer(model)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    monkeypatch.setattr(language, "MAX_CELLS", 1 << 20)
    tracemalloc.start()
    for i in range(8):
        list(language.labels_of([" ".join(map("".join, letters[rng.integers(0, 26, (1000, 7))]))], scorer))
        list(language.labels_of(["x" * 100_000 + f"{i}" + "y" * 100_000], scorer))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert scorer.scores.shape[0] * n <= 2 * language.MAX_CELLS + 1001 * n and peak < 200 << 20
    word = "anbocp"
    want = sum(model.log_probabilities(g) for g in language.grams(word))
    assert scorer.scores[scorer.index([word])][0] == pytest.approx(want, rel=1e-5)


def test_candidates_are_one_sided(spark, make_docs):
    names = [a + b for a in "bdfglnprtv" for b in ("ol", "em", "uk", "an", "ir", "eb")]
    rows = [(i, f"{names[i % 60]} {names[(7 * i + i // 60) % 60]} {'scum' if i % 20 == 0 else 'zero'} {names[(11 * i + 3) % 60]} and the of") for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(600)], "doc_id long, quality int, toxic int")
    terms = toxicity.fit(make_docs(rows), labels, folds=1, held_out=1).terms
    assert "scum" in terms and "zero" not in terms


def test_automaton_stays_bounded():
    import random

    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    terms = {"".join(rng.choices(letters, k=rng.randint(5, 12))): 1e-6 for _ in range(400)}
    matcher, sizes = toxicity.Matcher(toxicity.Lexicon(terms)), []
    listed = list(terms)
    for i in range(200_000):
        if i % 3:
            word = "".join(rng.choices(letters, k=rng.randint(3, 12)))
        else:
            word = rng.choice(listed)
            at = rng.randrange(len(word))
            word = word[:at] + rng.choice(letters) + word[at + 1 :]
        found = matcher.match(word)
        assert i % 3 or found
        if i % 10_000 == 0:
            sizes.append(matcher.pairs)
            assert sum(len(s) for s in matcher.states) <= matcher.pairs
    assert max(sizes) < 1.1 * toxicity.MAX_PAIRS


def test_reporting_words_are_learned(spark, make_docs):
    """Words beside quoted mentions report speech, not words of one passage that is copied, nor words beside any mention."""
    rows = []
    names = [a + b for a in "bdfglnprtv" for b in ("ola", "emi", "uka", "ano", "iru", "ebo")]
    for i in range(900):
        a, b, c = names[i % 60], names[(7 * i + i // 60) % 60], names[(11 * i + 3) % 60]
        if i % 10 == 0:
            text, toxic = f"{a} {b} scumbag rather {c} {a}", 1
        elif i % 75 == 1:
            text, toxic = f'{a} proclaimed {b} "scumbag" {c} rather {a}', 0
        elif i % 75 == 2:
            text, toxic = f'copied {i} words here "scumbag" always follow {a}', 0
        else:
            text, toxic = f"{a} {b} zebra rather {c} {a}", 0
        rows.append((i, text, toxic))
    docs = make_docs([(i, text) for i, text, _ in rows])
    labels = spark.createDataFrame([(i, 1, toxic) for i, _, toxic in rows], "doc_id long, quality int, toxic int")
    lexicon = toxicity.fit(docs, labels, folds=1, held_out=1)
    model = Toxicity(sorted({(toxic, text) for _, text, toxic in rows}))
    assert lexicon.reporting == model.reporting == {"proclaimed"} and lexicon.quoted == pytest.approx(model.quoted) and lexicon.quoted < 0.1
    matcher = toxicity.Matcher(lexicon)
    assert matcher.score('you proclaimed a "scumbag')[0] < matcher.score('you decided a "scumbag')[0]
    given = toxicity.fit(docs, labels, folds=1, held_out=1, reporting=frozenset({"decided"}))
    assert given.reporting == {"decided"} and given.terms == lexicon.terms and given.quoted == lexicon.quoted


@pytest.mark.parametrize("long", [10, 1 << 22])
def test_windows_are_slices(monkeypatch, long):
    monkeypatch.setattr(toxicity, "LONG", long)
    for n in (0, 1, 4, 6, 11, 12, 30):
        text = " ".join(f"w{i}" for i in range(n))
        words = text.split()
        for hits in (set(words), set(words[::3])):
            got = [([m[0] for m in found], found[at][0]) for found, at in toxicity.windows(text, hits)]
            assert got == [(words[max(0, i - 5) : i + 6], w) for i, w in enumerate(words) if w in hits]


def test_long_texts_take_the_same_course(monkeypatch):
    text = ("Some words, some words! the the 12 ÄÖ\n\n" * 50 + "last line\x1f odd\u2003space.") * 3
    matcher = toxicity.Matcher(toxicity.Lexicon({"words": 1e-6}))
    want = quality.statistics(text), matcher.score(text)
    for module in (quality, toxicity):
        monkeypatch.setattr(module, "LONG", 10)
    monkeypatch.setattr(quality, "BLOCK", 7)
    monkeypatch.setattr(language, "BLOCK", 7)
    assert (quality.statistics(text), toxicity.Matcher(matcher.lexicon).score(text)) == want
    scores = np.random.default_rng(1).normal(0, 12, (100, 3)).astype(np.float32)
    path = language.viterbi(scores, 9.0)
    monkeypatch.setattr(language, "BLOCK", 1 << 16)
    assert np.array_equal(path, language.viterbi(scores, 9.0))


def test_context_weighs():
    matcher = toxicity.Matcher(toxicity.Lexicon({"idiot": 1e-6, "lowe*": 1e-3}, quoted=0.3))
    assert matcher.score("you are an idiot")[0] > 0.9 and 0 < matcher.score('they said "idiot" is a rude word')[0] < 0.5
    assert 0.5 < matcher.score("you are an idjot")[0] < matcher.score("you are an idiot")[0]
    assert matcher.score("IDIOT! idiot.")[1] == 2 and matcher.score(None) == (0, 0)
    # one chance mention of a word that clean texts have says nothing, many do
    assert matcher.score("lower " + "word " * 500)[0] < 0.1 and matcher.score("lower lowest lowering " + "word " * 500)[0] < 0.5 < matcher.score("lower " * 12 + "word " * 500)[0]


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(4)
    for _ in range(60):
        scores = rng.normal(0, 12, (6, 3)).astype(np.float32)
        path = language.viterbi(scores, 9.0)
        value = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - 9.0 * sum(a != b for a, b in itertools.pairwise(p))  # noqa: E731,B023
        assert value(path) == pytest.approx(max(value(p) for p in itertools.product(range(3), repeat=6)), abs=1e-3)


def test_texts_together_take_the_paths_of_each():
    rng = np.random.default_rng(6)
    for languages in (1, 2, 5):
        listed = [rng.normal(0, 6, (n, languages)).astype(np.float32) for n in [*rng.integers(0, 40, 60).tolist(), 900, 300]]
        listed += [np.round(scores / 4) for scores in listed]  # ties
        for switch in (0.0, 3.0, 14.0):
            for path, scores in zip(language.viterbi_all(listed, switch), listed, strict=True):
                assert np.array_equal(path, language.viterbi(scores, switch))


def test_word_scores_are_sums_of_ngrams(tables, monkeypatch):
    docs, _ = tables
    model = language.fit(docs, F.lit(True), limit=500)
    texts = [r.text for r in docs.limit(50).collect()] + ["ж Ж 中文字 a ab abc abcdef abcdefg \U0001f130x", "²³ x²", "", None]
    scorer = language.Scorer(model)
    words = sorted({w for t in texts for w in language.WORDS.findall((t or "").lower())})
    at = scorer.index(words)
    for word, score, letters in zip(words, scorer.scores[at], scorer.letters[at], strict=True):
        want = sum(model.log_probabilities(g) for g in language.grams(word))
        fits = model.scripts.get(language.script(word[0]))
        if fits is not None and fits.any() and not fits.all():
            want += np.where(fits, 0, language.OUT_OF_SCRIPT)
        assert score == pytest.approx(want, rel=1e-6) and letters == sum(map(str.isalpha, word))
    # held in small parts, and with a table of words that is begun anew
    whole = list(language.labels_of(texts, scorer))
    monkeypatch.setattr(language, "HELD", 50)
    monkeypatch.setattr(language, "MAX_CELLS", 80)
    assert list(language.labels_of(texts, language.Scorer(model))) == whole == [language.label(t, scorer) for t in texts]


def test_spans_of_mixed_text(spark, tables):
    docs, _ = tables
    model = language.fit(docs, F.lit(True), limit=2000)
    texts = {r.lang: r.text[:400] for r in docs.where("lang in ('en', 'es') and length(text) > 800 and doc_id % 7 = 1").orderBy("doc_id").limit(60).collect()}
    scorer = language.Scorer(model)
    mixed = texts["en"] + "\n" + texts["es"]
    found = language.spans(mixed, scorer)
    assert [x for _, _, x in found] == ["en", "es"] and abs(found[1][0] - len(texts["en"])) < 40
    rows = language.language_spans(spark.createDataFrame([(1, mixed), (2, None)], "doc_id long, text string"), model).collect()
    assert {r.doc_id: len(r.spans) for r in rows} == {1: 2, 2: 0}


def test_unseen_script_is_no_crash(tables):
    docs, _ = tables
    scorer = language.Scorer(language.fit(docs.limit(200), F.lit(True)))
    assert language.label("привет мир", scorer)[0] in scorer.model.languages
