import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from remitta.llm import winnowing as W


def words(t):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(10, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + k]), set()).update([] if i is None else [str(i)])
    out = {}
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in {len(x) for x in windows}:
            for s in range(len(w) - k + 1):
                if (of := windows.get(tuple(w[s : s + k]))) is not None:
                    hit |= set(range(s, s + k))
                    found |= of
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def case(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "Ä", "the", "x1", "é", "don"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "'"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 9, 10, 11, 30]))) for i in range(8)] + [(98, None), (99, "x " * 40), (99, "z9"), (None, "q1 q2 q3"), (None, text(12))]
    docs = [(i, text(rng.randint(0, 60))) for i in range(30)]
    docs += [(100 + i, text(5) + " ".join(words(t)[j : j + 10]) + " " + text(4)) for i, (_, t) in enumerate(items) if t for j in (0, 3)][:30]
    docs = list({d: (d, t) for d, t in docs}.values())
    return [*docs, (900, None), (901, ""), (902, "x " * 30_000), (903, "!?"), (904, "before q1, Q2 q3 after")], items


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")


@pytest.mark.parametrize(("seed", "block"), [(1, 10**6), (2, 10**6), (3, 20)])
def test_as_brute_force(spark, seed, block):
    """Also with the items dealt over several blocks."""
    docs, items = case(seed)
    got = W.decontaminate(spark, *frames(spark, docs, items), block_words=block).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == brute(docs, items)


def test_every_shared_span_shares_a_fingerprint():
    rng = random.Random(5)
    for _ in range(300):
        shared = [str(rng.randint(0, 3)).encode() for _ in range(10)]
        prints = []
        for _ in range(2):
            t = [str(rng.randint(0, 3)).encode() for _ in range(rng.randint(0, 20))]
            g = W.grams(W.word_hashes(t + shared + t), W.GRAM)
            at = W.winnow(g)
            inside = at[(at >= len(t)) & (at + W.GRAM <= len(t) + 10)]
            prints.append(set((inside - len(t)).tolist()))
        assert prints[0] & prints[1]


def test_edges(spark):
    docs, items = case(4)
    d, b = frames(spark, docs, items)
    assert W.decontaminate(spark, d.limit(0), b).count() == 0
    clean = W.decontaminate(spark, d, b.limit(0))
    assert clean.filter("contaminated").count() == 0 and clean.count() == len(docs)
    odd = d.unionByName(d).withColumn("n_words", F.lit(1)).withColumn("spans", F.lit("x"))
    assert W.decontaminate(spark, odd, b).count() == 2 * len(docs)
    (r,) = W.decontaminate(spark, spark.createDataFrame([(None, "k1 k2 k3")], "doc_id bigint, text string"), spark.createDataFrame([("i", "k2")], "item_id string, text string")).collect()
    assert (r.doc_id, r.n_hit, r["items"]) == (None, 1, ["i"]) and r.spans[0].s == 1


def test_large_benchmarks_are_joined_as_small_ones_are(spark, monkeypatch):
    """Also with repeated rows, null ids, windows that many documents share, and a bitmap so full that it lets everything through."""
    from remitta.llm import common

    docs, items = case(6)
    docs += [(2000 + i, "before q1 q2 q3 after") for i in range(1500)] + [(None, "q1 q2 q3"), (None, "q1 q2 q3"), (5, docs[0][1])]
    d, b = frames(spark, docs, items)
    of = lambda df: sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), tuple(map(tuple, r.spans))) for r in df.collect()), key=repr)
    want = of(W.decontaminate(spark, d, b))
    assert of(W.decontaminate(spark, d, b, block_words=1)) == want
    monkeypatch.setattr(W, "BITS", 16)
    monkeypatch.setattr(common, "HOT_KEYS", 3)
    assert of(W.decontaminate(spark, d, b, block_words=1)) == want
    assert W.decontaminate(spark, d.limit(0), b, block_words=1).count() == 0
