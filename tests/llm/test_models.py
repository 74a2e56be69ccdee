"""The trained operators against plain restatements of their definitions."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
from helixlake.llm import language_id, quality, toxicity
from pyspark.sql import functions as F

SMALL = "/root/testdata/sf0.001"


def plain_grams(text, n=language_id.N):
    pad = " " * (n - 1)
    t = pad + "".join(c if c.isalpha() else " " for c in text.lower()) + pad
    return [t[i : i + n] for i in range(len(t) - n + 1) if "  " not in t[i : i + n]]


def test_language_against_plain_sets(spark):
    """Filters, masks and corrected popcounts decide as sets of n-grams do, wherever those tell languages apart."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "lang")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    model = language_id.trained(docs)
    held = {r["doc_id"] for r in docs.where(language_id.fold("doc_id", 4) == 2).collect()}
    counts, size = defaultdict(Counter), Counter()
    for i, t, lang in rows:
        if i not in held and t and lang:
            counts[lang].update(plain_grams(t))
            size[lang] += len(t)
    most = Counter()
    for lang, c in counts.items():
        for g, n in c.items():
            most[g] = max(most[g], n / size[lang])
    sets = {lang: {g for g, n in c.items() if n / size[lang] >= language_id.MIN_RATE and n / size[lang] >= language_id.SHARE * most[g]} for lang, c in counts.items()}
    assert model.languages == sorted(sets)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, model).collect()}
    told = 0
    for i, t, _ in rows:
        hits = {lang: sum(g in own for g in plain_grams(t or "")) for lang, own in sets.items()}
        best, second = sorted(hits.values())[-1], sorted(hits.values())[-2]
        if best > 1.05 * second + 3:
            told += 1
            assert got[i][0] == max(hits, key=hits.get) and abs(got[i][1] - best / sum(hits.values())) < 0.05
    assert told > 0.9 * len(rows)


def test_many_languages_are_bounded(spark, monkeypatch):
    rows = [(i, f"w{'abcdefghij'[i % 10]}rd " * (30 - i % 10), f"l{i % 10}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    monkeypatch.setattr(language_id, "BLOCK_LANGUAGES", 3)
    model = language_id.learn(docs)
    assert [m.languages for m in (model, *model.more)] == [["l0", "l1", "l2"], ["l3", "l4", "l5"], ["l6", "l7", "l8"], ["l9"]]


def plain_risk(w, x, positive, prior):
    """The non-negative risk of g = x w with the squared loss, and the ridge, row by row."""
    loss = lambda g, y: float(np.mean((1 - y * g) ** 2)) / 4
    g = x @ w
    return prior * loss(g[positive], 1) + max(0.0, loss(g, -1) - prior * loss(g[positive], -1)) + quality.RIDGE / 2 * float(w @ w)


def test_quality_risk_is_least():
    rng = np.random.default_rng(3)
    for prior in (0.2, 0.5):
        y = rng.random(3000) < prior
        x = np.hstack([rng.normal(size=(3000, 4)) + y[:, None] * [1.5, 0.5, 0, -1], np.ones((3000, 1))])
        positive = np.flatnonzero(y)[:300]
        w = quality.minimise(x.T @ x, x[positive].T @ x[positive], prior)
        risk = plain_risk(w, x, positive, prior)
        for _ in range(300):
            assert risk <= plain_risk(w + rng.normal(size=5) * rng.choice([1e-3, 1e-2, 0.1]), x, positive, prior) + 1e-9


def test_inverse():
    rng = np.random.default_rng(1)
    for n in (1, 2, 40):
        x = rng.normal(size=(3 * n, n))
        a = x.T @ x + np.eye(n) * 0.01
        assert np.allclose(quality.inverse(a) @ a, np.eye(n), atol=1e-7)


def test_prior_of_separate_classes():
    """Where a feature tells the classes apart, positives and unlabelled texts give the share back."""
    rng = np.random.default_rng(8)
    for prior in (0.1, 0.35, 0.8):
        y = rng.random(20_000) < prior
        x = np.hstack([y[:, None] + 0.0, rng.normal(size=(20_000, 3)), np.ones((20_000, 1))])
        positive = np.flatnonzero(y)[::7]
        assert abs(quality.estimated_prior(x.T @ x, x[positive].T @ x[positive]) - y.mean()) < 0.02
    assert quality.estimated_prior(np.zeros((3, 3)), np.zeros((3, 3))) == 0.5


def test_moments_are_sums_over_rows(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").where("doc_id < 60")
    rows = docs.collect()
    flag = [r["doc_id"] % 3 == 0 for r in rows]
    x = np.array([quality.features([r["text"] or ""])[0] for r in rows])
    every, positive = quality.moments(docs, docs.where("doc_id % 3 = 0"), "doc_id", "text")
    assert np.allclose(every, x.T @ x) and np.allclose(positive, x[flag].T @ x[flag])


def plain_ftrl(rows, labels, epochs, alpha, beta, l1, l2, bias, positive=1.0):
    """FTRL-proximal, coordinate by coordinate."""
    z, n = defaultdict(float), defaultdict(float)

    def weight(i):
        return 0.0 if abs(z[i]) <= l1 else -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(epochs):
        for row, y in zip(rows, labels, strict=True):
            on = set(row) | {bias}
            w = {i: weight(i) for i in on}
            g = (1 / (1 + math.exp(-sum(w.values()))) - y) * (positive if y else 1.0)
            for i in on:
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * w[i]
                n[i] += g * g
    return {i: weight(i) for i in z if weight(i)}


def test_ftrl_coordinate_by_coordinate():
    rng = np.random.default_rng(4)
    rows = [np.unique(rng.integers(0, 400, rng.integers(1, 40))) for _ in range(300)]
    y = np.array([float(7 in r or rng.random() < 0.1) for r in rows])
    got = toxicity.ftrl(rows, y)
    want = plain_ftrl([r.tolist() for r in rows], y, toxicity.EPOCHS, toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2, toxicity.SIZE - 1)
    assert {int(i) for i in np.flatnonzero(got)} == set(want) and want[7] > 0
    assert all(abs(got[i] - w) < 1e-9 for i, w in want.items())


def test_ftrl_with_rare_labels_that_count_more():
    rng = np.random.default_rng(5)
    rows = [np.unique(rng.integers(0, 400, rng.integers(1, 40))) for _ in range(300)]
    y = np.array([float(7 in r) for r in rows])
    positive = toxicity.balance(y)
    assert positive == min(toxicity.MOST_BALANCE, (y == 0).sum() / y.sum())
    got = toxicity.ftrl(rows, y, positive=positive)
    want = plain_ftrl([r.tolist() for r in rows], y, toxicity.EPOCHS, toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2, toxicity.SIZE - 1, positive)
    assert {int(i) for i in np.flatnonzero(got)} == set(want) and want[7] > 0
    assert all(abs(got[i] - w) < 1e-9 for i, w in want.items())
    assert toxicity.balance(np.zeros(5)) == 5 and toxicity.balance(np.ones(3)) == toxicity.balance(np.zeros(0)) == 1


def test_toxic_features_are_words_pairs_and_skips():
    texts = ["You ARE, a b; a", "", "one", "x y x y x"]
    place, row = toxicity.features(texts)
    made = defaultdict(list)
    for p, r in zip(place.tolist(), row.tolist(), strict=True):
        made[r].append(p)
    for i, words in enumerate((["you", "are", "a", "b", "a"], [], ["one"], ["x", "y", "x", "y", "x"])):
        want = [("w", a) for a in words] + [("p", *p) for p in zip(words, words[1:], strict=False)] + [("s", *p) for p in zip(words, words[2:], strict=False)]
        assert len(made[i]) == len(want) and len(set(made[i])) == len(set(want))


def test_labels_that_disagree_and_rows_that_repeat(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice("kt mz rq vn bl".split()) for _ in range(12)) + (" vile" if i % 2 else "")) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int")
    clean = toxicity.learn(docs, labels)
    twice = toxicity.learn(docs.unionByName(docs), labels.unionByName(labels.withColumn("toxic", F.lit(0))).unionByName(labels.withColumn("toxic", F.lit(None).cast("int"))))
    assert np.count_nonzero(clean) and (clean == twice).all()
    monkeypatch.setattr(toxicity, "MOST_PLACES", 100)
    assert np.count_nonzero(toxicity.learn(docs, labels)) <= 100


def test_languages_beyond_one_model(spark, monkeypatch):
    """As many models as languages ask for decide like one model of all of them."""
    rng = random.Random(7)
    stock = {f"l{k:02d}": ["".join(rng.choice("abcdefghijklmnop"[k % 7 : k % 7 + 9]) for _ in range(rng.randint(3, 7))) for _ in range(40)] for k in range(11)}
    rows = [(i, " ".join(rng.choice(stock[lang]) for _ in range(30)), lang) for i, lang in enumerate(list(stock) * 12)]
    rows += [(900, "", "l00"), (901, None, None), (902, "12 ?", "l01"), (903, rows[5][1] + " " + rows[6][1], None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    told = lambda model: sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language_id.identify(docs, model).collect())
    by_row = lambda model: sorted((r["doc_id"], r["__told"]["lang_pred"], round(r["__told"]["score"], 9)) for r in language_id.identify_rows(docs, model).collect())
    whole = language_id.learn(docs)
    assert not whole.more and len(whole.languages) == 11
    want = told(whole)
    assert by_row(whole) == want
    monkeypatch.setattr(language_id, "BLOCK_LANGUAGES", 4)
    parts = language_id.learn(docs)
    assert [m.languages for m in (parts, *parts.more)] == [whole.languages[a : a + 4] for a in (0, 4, 8)]
    assert told(parts) == want == by_row(parts)
