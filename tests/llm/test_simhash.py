import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from remitta.llm import simhash as S


def brute_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0d]+", low) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(fps):
    """fps: id -> fingerprint."""
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if b > a and (fps[a] ^ fps[b]).bit_count() <= 3:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


TEXTS = [(1, None), (2, ""), (3, " \n"), (4, "One"), (5, "one"), (6, "one two"), (7, "A b C d E"), (8, "a b c d e"), (9, "é É b"), (10, "w " * 50_000), (11, "q" * 200_000)]


def test_fingerprints(spark):
    got = {r.doc_id: r.fingerprint for r in S.simhash_groups(spark, spark.createDataFrame(TEXTS, "doc_id bigint, text string")).collect()}
    assert got == {i: f"{brute_fingerprint(t):016x}" for i, t in TEXTS}


def random_prints(n, seed, near=40):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**64, n, np.uint64)
    more = []
    for i in range(near):
        x = int(base[i % 5])
        for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
            x ^= 1 << int(b)
        more.append(x)
    return np.unique(np.concatenate([base, np.array(more, np.uint64)]))


@pytest.mark.parametrize(("blocks", "tile", "bucket"), [(4, 4096, 64), (4, 8, 64), (5, 4096, 0), (6, 4096, -1)])
def test_all_links_are_found(spark, blocks, tile, bucket):
    """In every scheme of tables, and with buckets cut into tiles."""
    fps = random_prints(150, blocks)
    n = len(fps) if blocks != 5 else 1 << 20
    every = S.tables(n, bucket)
    assert every[0][0] == (blocks if blocks != 5 else every[0][0])
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp bigint")
    links = S.links(df, n, tile, bucket)
    got = {r.node: r.root for r in S.components(links).collect()}
    want = brute_components({int(x): int(x) & (2**64 - 1) for x in fps.view(np.int64)})
    assert {k: got.get(k, k) for k in want} == want
    for r in links.collect():
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 3


def test_planes_and_counters():
    rng = np.random.default_rng(1)
    fps = np.sort(rng.integers(0, 2**64, 500, np.uint64))
    fps[100] = fps[99] ^ np.uint64(0b111)
    fps[300] = fps[299] ^ np.uint64(0b1111)
    a, b = S.near_pairs(fps, np.zeros(500, np.int64))
    assert list(zip(a.tolist(), b.tolist())) == [(99, 100)]
    left, right = fps[:120], np.concatenate([fps[120:], fps[:1]])
    x, y = S.tile_pairs(left, right)
    assert list(zip(x.tolist(), y.tolist())) == [(0, 380)]


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a bigint, b bigint")
    got = {r.node: r.root for r in S.components(edges).collect()}
    assert all(got.get(i, i) == 0 for i in range(201)) and got[1001] == 1000


def test_groups(spark):
    same = " ".join(f"w{i}" for i in range(200))
    rows = [(i, same) for i in range(5, 300)] + [(1, "other text here"), (2, None), (3, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit("x")).withColumn("component_id", F.lit(1))
    got = {r.doc_id: r.component_id for r in S.simhash_groups(spark, df).collect()}
    assert got[299] == 5 and got[1] == 1 and got[3] == 2 and len(got) == len(rows)
    assert S.simhash_groups(spark, df.limit(0)).count() == 0
    assert S.simhash_groups(spark, df.unionByName(df)).count() == 2 * len(rows)
