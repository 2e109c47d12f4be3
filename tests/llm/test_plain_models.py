"""op8, op9 and op10 against plain versions: no Cholesky factors, automata, tables of words or shortened searches."""

import math
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from plain_models import TOKEN, WORD, Language, Toxicity, distance, in_fold, plain_grams, plain_lexicon

from segmill.llm import language, queries, toxicity

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    labels = spark.read.parquet(f"{SF}/labels.parquet").collect()
    return docs, labels


# ---------------------------------------------------------------- quality


def plain_statistics(text):
    words, lines = re.findall(r"\S+", text), [x for x in text.split("\n") if x]
    n, size = len(words), len(text)
    share = lambda k, of: math.sqrt(k / max(1, of))
    letters = sum(c.isalpha() or c.isalnum() and not c.isdecimal() for c in text)
    digits = sum(c.isdecimal() for c in text)
    symbols = sum(not (c.isalnum() or c.isspace() or c in ".,;:!?'\"()-") for c in text)
    upper = sum("A" <= c <= "Z" or "À" <= c <= "Ö" or "Ø" <= c <= "Þ" for c in text)
    lengths = [len(w) for w in words] or [0]
    counts = Counter(words)
    return [
        math.log(1 + n), math.log(1 + np.mean(lengths)), math.log(1 + np.std(lengths)), math.log((letters + 0.5) / (size - letters + 0.5)),
        share(digits, size), share(symbols, size), share(upper, size), share(sum(c in ".," for c in text), n),
        math.log((1 + len(counts)) / (1 + n)) if n else 0.0, share(max(counts.values(), default=0), n), share(sum(words[i] == words[i - 1] for i in range(1, n)), n),
        math.log(1 + size / max(1, len(lines))), math.sqrt(1 - len(set(lines)) / len(lines)) if lines else 0.0,
        share(sum(len(w) < 2 for w in words), n), share(sum(not x.rstrip() or x.rstrip()[-1] in ".!?" for x in lines), len(lines)),
    ]


def test_quality(spark, tables):
    docs, labels = tables
    marks = {}
    for r in labels:
        if r.quality in (0, 1) and in_fold(r.doc_id, 5):
            marks[r.doc_id] = max(r.quality, marks.get(r.doc_id, 0))
    x = {r.doc_id: np.array(plain_statistics(r.text or "")) for r in docs}
    by_label = {k: np.array([x[d] for d in x if marks.get(d) == k]) for k in (0, 1)}
    total = sum(map(len, by_label.values()))
    dim = len(next(iter(x.values())))
    covs = {k: np.cov(v.T, bias=True) for k, v in by_label.items()}
    pooled = sum(len(by_label[k]) * covs[k] for k in covs) / total
    logs = {}
    for k, v in by_label.items():
        weight = max(0.1, dim / (dim + len(v)))
        cov = (1 - weight) * covs[k] + weight * np.diag(np.diag(pooled)) + 1e-3 * np.eye(dim)
        inverse, mean = np.linalg.inv(cov), v.mean(axis=0)
        logs[k] = {d: math.log(len(v) / total) - 0.5 * np.linalg.slogdet(cov)[1] - 0.5 * (y - mean) @ inverse @ (y - mean) for d, y in x.items()}
    got = {r.doc_id: r for r in queries.op8_quality(spark, SF).collect()}
    assert got.keys() == x.keys()
    for d, r in got.items():
        want = 1 / (1 + math.exp(min(700, max(-700, logs[0][d] - logs[1][d]))))
        assert r.score == pytest.approx(want, abs=1e-9)
        assert r.held_out == (in_fold(d, 5) == 0) and r.predicted == (want >= 0.3)


# ---------------------------------------------------------------- language




def test_language(spark, tables):
    docs, _ = tables
    counts, scripts, seen = {}, {}, set()
    for r in docs:
        if r.lang is not None and r.text is not None and in_fold(r.doc_id, 4) != 2:
            for w in WORD.findall(r.text.lower()):
                found = counts.setdefault(r.lang, Counter())
                for g in plain_grams(w):
                    found[g] += 1
                    seen.add(g)
                scripts.setdefault(r.lang, Counter())[language.script(w[0])] += len(w)
    langs = sorted(counts)
    totals = {lang: sum(counts[lang].values()) + 0.5 * (len(seen) + 1) for lang in langs}

    def word_scores(w):
        out = {lang: sum(math.log((counts[lang][g] + 0.5) / totals[lang]) for g in plain_grams(w)) for lang in langs}
        fits = {lang for lang in langs if scripts[lang][language.script(w[0])] >= 0.001 * sum(scripts[lang].values())}
        return out if not fits else {lang: s if lang in fits else s - 40.0 for lang, s in out.items()}

    got = {r.doc_id: r for r in queries.op10_language(spark, SF).collect()}
    assert len(got) == len(docs) and len(langs) > 1
    switched = 0
    known = {}
    for r in docs:
        words = WORD.findall((r.text or "").lower())
        letters = [sum(c.isalpha() for c in w) for w in words]
        if not sum(letters):
            assert (got[r.doc_id].lang_pred, got[r.doc_id].score) == ("und", 0.0)
            continue
        best, backs = None, []
        for w in words:
            s = known.setdefault(w, None) or known.__setitem__(w, word_scores(w)) or known[w]
            if best is None:
                best = s
                continue
            back = {lang: max(langs, key=lambda k: best[k] - (14.0 if k != lang else 0.0)) for lang in langs}  # noqa: B023
            best = {lang: best[back[lang]] - (14.0 if back[lang] != lang else 0.0) + s[lang] for lang in langs}
            backs.append(back)
        path = [max(langs, key=best.get)]
        for back in reversed(backs):
            path.append(back[path[-1]])
        path.reverse()
        switched += len(set(path)) > 1
        shares = Counter()
        for lang, n in zip(path, letters, strict=True):
            shares[lang] += n / sum(letters)
        row = got[r.doc_id]
        assert row.held_out == (in_fold(r.doc_id, 4) == 2)
        assert row.score == pytest.approx(max(shares.values()), abs=1e-9) and shares[row.lang_pred] == pytest.approx(row.score, abs=1e-9)
    assert switched or all(r.score == 1.0 for r in got.values() if r.lang_pred != "und")


# ---------------------------------------------------------------- toxicity

def test_toxicity(spark, tables):
    sf = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    lexicon = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect() if r.text is not None}
    marks = {}
    for r in labels.collect():
        if r.toxic in (0, 1) and in_fold(r.doc_id, 5):
            marks[r.doc_id] = max(r.toxic, marks.get(r.doc_id, 0))
    rows = sorted({(m, texts[d].lower()) for d, m in marks.items() if d in texts})
    terms, begun = plain_lexicon(rows)
    assert terms.keys() == lexicon.terms.keys() and begun == set(lexicon.words)
    assert all(lexicon.terms[t] == pytest.approx(rate, rel=1e-2) for t, rate in terms.items())
    # scores: plain distances to all terms, plain windows, for texts of any kind and all words near a term
    whole = [t for t in (*lexicon.terms, *lexicon.words) if not t.endswith("*")]
    begins = [t for t in lexicon.terms if t.endswith("*")]
    known = {}

    def match(w):
        if w not in known:
            own = [t for t in begins if w.startswith(t[:-1])]
            near = sorted((d, t) for t in whole if abs(len(t) - len(w)) <= 2 and (d := distance(w, t)) <= (len(t) >= 5) + (len(t) >= 10))
            known[w] = (max(own, key=len), 0) if own else (near[0][1], near[0][0]) if near and (near[0][0] == 0 or w not in lexicon.clean) else None
        return known[w]

    def plain_score(text):
        low = text.lower()
        found = [(m[0], m.start(), m.end()) for m in TOKEN.finditer(low)]
        counts, n = Counter(), 0
        for i, (w, start, end) in enumerate(found):
            if (hit := match(w)) is None:
                continue
            window = found[max(0, i - 5) : i + 6]
            a, b = window[0][1], window[-1][2]
            quote = lambda part: any(q in part for q in toxicity.QUOTES)
            quoted = quote(low[a:start]) and quote(low[end : b + 1]) or any(x[0] in lexicon.reporting for x in window) and quote(low[max(0, a - 1) : b + 1])
            counts[hit[1] or hit[0]] += lexicon.quoted if quoted else 1.0
            n += 1
        if not n:
            return 0.0
        value = 0.0
        for key, k in counts.items():
            mean = len(found) * (lexicon.errors[key - 1] if isinstance(key, int) else lexicon.terms[key])
            value += k * math.log(k / mean) - k + mean if k > mean else 0.0
        return 1 / (1 + math.exp(-lexicon.curve[0] * value - lexicon.curve[1]))

    some = docs.where("length(text) < 3000").orderBy("doc_id").limit(400)
    sample = {r.doc_id: r.text for r in some.collect()}
    toxic_ids = [d for d, m in marks.items() if m == 1 and d in texts][:60]
    got = {r.doc_id: r.score for r in toxicity.score(some.unionByName(docs.where(docs.doc_id.isin(toxic_ids))), lexicon).collect()}
    sample |= {d: texts[d] for d in toxic_ids}
    assert len(got) == len(sample) and any(s > 0.5 for s in got.values())
    for d, text in sample.items():
        assert got[d] == pytest.approx(plain_score(text), abs=1e-9), d
    assert xxhash.xxh64_intdigest("a b") >> 1 == toxicity.hash_of([*re.finditer(r"\w", "a x b")], 1)


def test_misspellings_quotations_and_curve(spark):
    """What is learned about contexts, against plain counts over all labelled texts."""
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 4 = 1 and length(text) < 20000")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    lexicon = toxicity.fit(docs, labels)
    texts = {r.doc_id: r.text for r in docs.collect()}
    marks = {}
    for r in labels.collect():
        if r.toxic in (0, 1) and in_fold(r.doc_id, 5):
            marks[r.doc_id] = max(r.toxic, marks.get(r.doc_id, 0))
    model = Toxicity(sorted({(m, texts[d].lower()) for d, m in marks.items() if d in texts}))
    assert lexicon.terms and lexicon.terms.keys() == model.terms.keys() and set(lexicon.words) == model.words
    assert lexicon.clean == model.clean and lexicon.quoted == pytest.approx(model.quoted) and lexicon.errors == pytest.approx(model.errors)
    assert lexicon.reporting == model.reporting
    assert lexicon.curve == pytest.approx(model.curve, rel=1e-5)


def test_plain_language_model_is_the_plain_test_s(tables):
    docs, _ = tables
    model = Language([(r.lang, r.text) for r in docs if r.lang and in_fold(r.doc_id, 4) != 2])
    assert model.share("") == model.share(None) == model.share("12 !") == 0.0 and model.share(docs[0].text) > 0.5
