import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from remitta.llm import langid, ordinal, quality, toxicity

BAD = ["vile", "scum", "trash"]


def text(rng, n, bad=0, junk=False):
    w = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(n)]
    for _ in range(bad):
        w[rng.randrange(n)] = rng.choice(BAD)
    return " ".join(x.upper() + "!!" for x in w) if junk else " ".join(w)


@pytest.fixture(scope="module")
def rated(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        bad, junk = (3 if i % 8 == 0 else 0), i % 8 == 1
        rows.append((i, text(rng, 60, bad, junk)))
        if i % 2 == 0 or junk:
            labels.append((i, int(not junk), int(bad > 0)))
    rows += [(500, None), (501, ""), (502, "word " * 60_000), (None, "scum vile trash")]
    labels += [(None, 1, 1), (3, None, None), (999, 1, 1), (8, 1, 1)]
    return spark.createDataFrame(rows, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")


def test_ordinal_regression_recovers_grades():
    rng = np.random.default_rng(1)
    rows = [dict.fromkeys(map(int, rng.choice(30, 6, replace=False)), 1.0) for _ in range(1500)]
    score = np.array([sum(2.0 if f < 3 else -1.5 if f < 6 else 0 for f in r) for r in rows]) + rng.logistic(0, 0.5, 1500)
    y = (score > 0.5).astype(int) + (score > 2.5)
    m = ordinal.fit(ordinal.Sparse.of(rows), y, 3)
    assert m.thresholds[0] < m.thresholds[1]
    w = dict(zip(m.features.tolist(), m.weights))
    assert all(w.get(f, 0) > 0.5 for f in range(3)) and all(w.get(f, 0) < -0.5 for f in range(3, 6)) and all(abs(w.get(f, 0)) < 0.5 for f in range(6, 30))
    s = m.score_rows(ordinal.Sparse.of(rows))
    tail = m.tail(s)
    assert (tail[:, 0] >= tail[:, 1]).all() and np.allclose(m.expected(s), tail.sum(1))
    assert np.corrcoef(m.expected(s), y)[0, 1] > 0.7


def test_likelihood_and_its_derivatives_by_finite_differences():
    rng = np.random.default_rng(4)
    score, theta, y = rng.normal(size=40), np.array([-0.5, 0.2, 1.5]), rng.integers(0, 4, 40)
    edge = lambda t, k: -np.inf if k < 0 else np.inf if k == len(t) else t[k]
    cdf = lambda z: 0.0 if z == -np.inf else 1.0 if z == np.inf else 1 / (1 + np.exp(-z))
    brute = lambda s, t: -np.mean([np.log(cdf(edge(t, k) - x) - cdf(edge(t, k - 1) - x)) for x, k in zip(s, y)])
    loss, g_score, g_theta = ordinal.likelihood(score, theta, y)
    assert abs(loss - brute(score, theta)) < 1e-9
    for g, at, f in ((g_score, score, lambda v: brute(v, theta)), (g_theta, theta, lambda v: brute(score, v))):
        for i in range(len(at)):
            d = np.zeros(len(at))
            d[i] = 1e-5
            assert abs((f(at + d) - f(at - d)) / 2e-5 - g[i]) < 1e-6


def test_fit_reaches_the_optimum_of_a_dense_optimiser():
    """Plain gradient descent on all weights, without a bound on features or a penalty."""
    rng = np.random.default_rng(5)
    x = (rng.random((800, 12)) < 0.3).astype(float)
    w = np.r_[2.0, -2.0, 1.0, np.zeros(9)]
    y = np.digitize(x @ w + rng.logistic(0, 1, 800), [0.3, 1.8])
    rows = [{int(f): 1.0 for f in np.flatnonzero(r)} for r in x]
    got = ordinal.fit(ordinal.Sparse.of(rows), y, 3, l1=0.0)
    dense, theta = np.zeros(12), np.array([0.0, 1.0])
    for _ in range(6000):
        _, g, g_theta = ordinal.likelihood(x @ dense, theta, y)
        dense, theta = dense - 2.0 * x.T @ g, theta - 2.0 * g_theta
    best = ordinal.likelihood(x @ dense, theta, y)[0]
    assert ordinal.likelihood(got.score_rows(ordinal.Sparse.of(rows)), got.thresholds, y)[0] < best + 2e-3
    assert np.allclose([dict(zip(got.features.tolist(), got.weights)).get(f, 0) for f in range(12)], dense, atol=0.15)


def test_an_id_on_many_rows_brings_one_text(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "vile scum"), (3, "fine words")], "doc_id int, text string")
    from remitta.llm.common import one_text

    got = one_text(docs, ["doc_id"]).collect()
    assert len(got) == 3 and {r.text for r in got if r.doc_id > 1} == {"vile scum", "fine words"}
    assert [r.text for r in one_text(docs.repartition(7), ["doc_id"]).filter("doc_id = 1").collect()] == [r.text for r in got if r.doc_id == 1]


def test_ordinal_regression_without_data():
    m = ordinal.fit(ordinal.Sparse.of([]), [], 3)
    assert len(m.features) == 0 and m.tail(np.zeros(2)).shape == (2, 2)
    assert len(ordinal.fit(ordinal.Sparse.of([{1: 1.0}] * 5), [1] * 5, 3).features) == 0


def test_toxicity(spark, rated):
    docs, labels = rated
    got = {r.doc_id: r for r in toxicity.toxicity(spark, docs, labels).collect()}
    held = [i for i in range(1, 400, 2)]
    assert all(got[i].rejected == (i % 8 == 0) for i in range(0, 400, 2))
    assert sum(got[i].rejected for i in held) == 0
    assert got[None].rejected and not got[500].rejected and not got[501].rejected and not got[502].rejected
    assert got[0].expected_severity > 0.5 > got[2].expected_severity
    kept = toxicity.keep_clean(spark, docs.withColumn("p_toxic", F.lit(1)), labels)
    assert kept.columns == ["doc_id", "text", "p_toxic"] and kept.count() == len(got) - sum(r.rejected for r in got.values())


def test_toxicity_without_labels_or_rows(spark, rated):
    docs, labels = rated
    assert toxicity.toxicity(spark, docs, labels.limit(0)).filter("rejected").count() == 0
    assert toxicity.toxicity(spark, docs.limit(0), labels).count() == 0
    assert toxicity.toxicity(spark, docs.unionByName(docs), labels).count() == 2 * docs.count()


def test_quality(spark, rated):
    docs, labels = rated
    got = {r.doc_id: r for r in quality.quality(spark, docs.withColumn("grade", F.lit("x")), labels).collect()}
    assert all(got[i].selected == (i % 8 != 1) for i in range(400))
    assert got[1].expected_grade < min(got[0].expected_grade, got[2].expected_grade)
    again = quality.quality(spark, docs.unionByName(docs.filter("doc_id < 9")), labels).collect()
    assert len(again) == len(got) + 9 and len({(r.doc_id, round(r.expected_grade, 9)) for r in again}) == len(got)
    assert {500, 501, 502} <= set(got)
    assert quality.quality(spark, docs.limit(0), labels).count() == 0
    assert quality.quality(spark, docs, labels.limit(0)).count() == len(got)


def test_shapes():
    s = quality.Shapes()
    assert s("AAA!! BB!!") == s("CCC!! DDD!!") != s("aaa bbb")
    assert s("") == {} and s("x x x x")[quality._REPEAT] > 0.8


# Language

SYLLABLES = {"aa": ["ka", "ko", "ri", "ta", "mu"], "bb": ["sch", "ein", "und", "ver", "ung"], "cc": ["ño", "ción", "el", "que", "ar"]}


def prose(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def spoken(spark):
    rng = random.Random(7)
    rows = [(i, prose(rng, lang, 60), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 60)]
    rows += [(900, None, "aa"), (901, "", None), (902, "123 !!", "bb"), (903, prose(rng, "cc", 30_000), None), (904, "Q", "aa"), (None, prose(rng, "aa", 30), "bb")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string")


def test_language(spark, spoken):
    got = langid.language(spark, spoken.withColumn("score", F.lit("x"))).collect()
    by = {r.doc_id: r for r in got}
    want = {r.doc_id: r.lang for r in spoken.collect()}
    assert len(got) == spoken.count()
    held = [i for i in range(180) if by[i].held_out]
    assert 10 < len(held) < 80 and all(by[i].lang_pred == want[i] for i in held)
    assert [by[i].lang_pred for i in (900, 901, 902)] == ["und"] * 3 and by[902].score == 0
    assert by[903].lang_pred == "cc" and by[904].lang_pred in SYLLABLES and by[None].lang_pred == "aa"
    assert all(0 <= r.score <= 1 for r in got)
    assert by[904].rejected or by[904].bits_per_char > by[0].bits_per_char


def test_language_of_repeated_rows(spark, spoken):
    twice = langid.language(spark, spoken.unionByName(spoken)).collect()
    assert len(twice) == 2 * spoken.count() and len({(r.doc_id, r.lang_pred, r.score) for r in twice}) == spoken.count()


def test_language_without_rows(spark, spoken):
    assert langid.language(spark, spoken.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.language(spark, spoken.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_kneser_ney_sums_to_one():
    rng = random.Random(1)
    m = langid.learn([("aa", prose(rng, "aa", 200)), ("bb", prose(rng, "bb", 200))], [])
    alphabet = sorted({c for g in SYLLABLES["aa"] + SYLLABLES["bb"] for c in g} | {" "})
    for context in ("   ", " ka", "ver", "kav", "zzz"):
        total = np.zeros(2)
        for c in alphabet:
            total += np.exp(m.position_scores(np.array([ord(x) for x in context + c], np.uint32))[0])
        unseen = np.exp(m.position_scores(np.array([ord(x) for x in context + "é"], np.uint32))[0])
        assert (abs(total + unseen - 1) < 1e-6).all(), (context, total, unseen)


def test_shape_of_a_whole_token():
    from remitta.llm.quality import shape

    assert shape("a" * 64 + "-1") != shape("a" * 64) and shape("a" * 500) == shape("aa")
