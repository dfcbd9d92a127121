import math
import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from remitta.llm import lm

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(t):
    import re

    return re.findall(r"[^\x20\x09-\x0d]+", (t or "").translate(LOW)) + ["\n"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for i in range(300):
        w, x = [], rng.randrange(20)
        for _ in range(rng.randint(5, 60)):
            x = (3 * x + rng.choice([1, 1, 1, 2])) % 20
            w.append(f"W{x}" if rng.random() < 0.9 else f"rare{rng.randrange(10**6)}")
        out.append((i, " ".join(w)))
    return [*out, (400, None), (401, ""), (402, "W1 " * 50_000), (403, "É é   x\x0by")]


def brute(rows):
    c = Counter(w for i, t in rows if i is None or crc32(str(i).encode()) % 5 != 1 for w in tokens(t))
    n, v = sum(c.values()), len(c)
    return {i: (i is not None and crc32(str(i).encode()) % 5 == 1, len(tokens(t)), sum(w in c for w in tokens(t)), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(t))) for i, t in rows}


@pytest.mark.parametrize("common", [lm.COMMON, 15])
def test_as_brute_force(spark, rows, monkeypatch, common):
    """Also where most words have to be joined."""
    monkeypatch.setattr(lm, "COMMON", common)
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("row", F.lit(1)).withColumn("model", F.lit("x"))
    got = {r.doc_id: r for r in lm.score(spark, df, rounds=1).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for i, (held, n, known, total, base) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [i for i in range(300) if got[i].held_out]
    if common > 15:
        assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


def test_repeated_rows_and_empty_tables(spark, rows):
    df = spark.createDataFrame(rows[:20], "doc_id bigint, text string")
    twice = lm.score(spark, df.unionByName(df), rounds=1)
    assert twice.count() == 40 and twice.groupBy("doc_id").agg(F.count_distinct("base_score").alias("n")).filter("n > 1").count() == 0
    assert lm.score(spark, df.limit(0), rounds=1).count() == 0


def test_probabilities_sum_to_one():
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(50)).encode() for _ in range(40)]
    c = Counter(w for t in texts for w in [*t.split(), b"\n"])
    top = sorted(c, key=lambda w: (-c[w], w))
    known = lm.Common(top, np.array([c[w] for w in top], float), sum(c.values()), len(c))
    w = lm.Weights.zero()
    for _ in range(5):
        lm.learn(w, known, lm.Batch(texts, known))
    total = sum(10 ** lm.log10_p(w, known, lm.Batch([b"w1 w2 " + x], known))[2] for x in top if x != b"\n")
    end = 10 ** lm.log10_p(w, known, lm.Batch([b"w1 w2"], known))[2]
    unseen = 10 ** (lm.log10_p(w, known, lm.Batch([b"w1 w2 unseen"], known))[2]) * (0.5 / known.total())
    assert abs(total + end + unseen - 1) < 1e-3


def test_score_depends_on_the_rows_alone(spark, rows, monkeypatch):
    """However the table is partitioned, and in whatever order its rows come."""
    monkeypatch.setattr(lm, "SHARD_TOKENS", 2000)
    df = spark.createDataFrame([*rows, (None, "no id"), (7, rows[7][1])], "doc_id bigint, text string")
    of = lambda d: sorted(((r.doc_id is None, r.doc_id or 0, r.score, r.n_tokens) for r in lm.score(spark, d).collect()))
    first = of(df.repartition(1))
    for other in (df.repartition(4), df.repartition(16), df.orderBy(F.desc("text"))):
        assert all(math.isclose(a[2], b[2], rel_tol=1e-7) and a[:2] == b[:2] for a, b in zip(first, of(other)))


def test_frequent_words_are_bounded_with_ties(spark, monkeypatch):
    monkeypatch.setattr(lm, "COMMON", 5)
    counts = spark.createDataFrame([(w, 3) for w in "gfedcba"] + [("x", 900), ("y", 1)], "word string, n bigint")
    known = lm.common(counts)
    assert list(known.index) == [b"x", b"a", b"b", b"c", b"d"] and (known.tokens, known.distinct) == (922, 9)


def test_all_gradients_of_a_bucket_count():
    error = np.array([[1, -1], [2, 0], [0, 4], [8, 8]], np.float32)
    table = np.zeros((lm.BUCKETS, 2), np.float32)
    lm._descend(table, [np.array([3, 7, 3, 3])], error.copy())
    assert np.allclose(table[7], -lm.RATE * error[1]) and np.allclose(table[3], -lm.RATE * 2 / 4 * (error[0] + error[2] + error[3]))
    assert np.count_nonzero(table.any(1)) == 2

    # one text that repeats a history: what follows it most must win, whatever comes last in the step
    text = b"a b " * 300 + b"a c"
    c = Counter([*text.split(), b"\n"])
    top = sorted(c, key=lambda w: (-c[w], w))
    known = lm.Common(top, np.array([c[w] for w in top], float), sum(c.values()), len(c))
    w = lm.Weights.zero()
    lm.learn(w, known, lm.Batch([text], known))
    after = lm.Batch([b"a b", b"a c"], known)
    got = lm.log10_p(w, known, after) - lm.log10_p(lm.Weights.zero(), known, after)
    assert got[1] > 0 and got[1] > got[4]


def _known_and_batch():
    rng = random.Random(4)
    text = " ".join(f"w{int(rng.paretovariate(0.6)) % 3000}" for _ in range(lm.STEP - 1)).encode()
    counts = Counter(lm.words(text) + [b"\n"])
    top = sorted(counts, key=lambda w: (-counts[w], w))
    known = lm.Common(top, np.array([counts[w] for w in top], float), sum(counts.values()), len(counts))
    return known, lm.Batch([text], known)


def test_steps_reuse_their_memory():
    import tracemalloc

    known, batch = _known_and_batch()
    w = lm.Weights.zero()
    lm.learn(w, known, batch)
    tracemalloc.start()
    lm.learn(w, known, batch)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 4 * 4 * lm.STEP * (lm.CLASSES + 1)  # bytes of four arrays of a number for each token and class


def test_a_step_is_that_of_a_loop():
    """Features of all sizes one after another: what is kept of an earlier step is not seen in a later one."""
    rng = np.random.default_rng(6)
    for n in (500, 3, 1, 200):
        table = rng.standard_normal((lm.BUCKETS, 33)).astype(np.float32)
        at = [(rng.pareto(0.5, n) * 3).astype(np.int64) % lm.BUCKETS for _ in range(3)]
        error = rng.standard_normal((n, 33)).astype(np.float32)
        want = table.astype(np.float64)
        for a in at:
            for bucket in set(a.tolist()):
                mine = error[a == bucket].astype(np.float64)
                want[bucket] -= 2 * lm.RATE / (len(mine) + 1) * mine.sum(0)
        lm._descend(table, at, error)
        assert np.allclose(table, want, atol=1e-4)


def test_histories_begin_with_each_text():
    known, _ = _known_and_batch()
    texts = [b"", b"w1", b"w1 w2", b"", b"w1 w2 w3 w4 w5 unseen w1", b"w2 w3"]
    together = lm.Batch(texts, known)
    for i, f in enumerate(together.features):
        assert f.tolist() == [x for t in texts for x in lm.Batch([t], known).features[i].tolist()]
    assert lm.Batch([], known).features[0].size == 0
