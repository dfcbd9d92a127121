"""SimHash near-duplicates, compared bit plane by bit plane.

Fingerprints: 64 bits from the XXH64 of every three-word shingle. Candidates: the 64 bits are cut into blocks, and
two fingerprints that differ in at most three bits agree on all but three blocks; each choice of the blocks that
agree is one table whose key is those bits. Four, five or six blocks are used (16, 25 or 32 bits of key), the least
number that keeps the expected bucket short, so every link is found at any size. The distinct fingerprints of a
table are sorted by key; a batch stores their bits vertically, one plane of 64-bit words per bit, and the distances
of all rows to the rows d places further on are summed at once with carry-save counters. Words in which all lanes
have passed the radius are abandoned. A bucket longer than `tile` rows is cut into tiles, and every two tiles of it
are compared on their own, so no task holds a whole hot bucket.

Each batch returns the links of a spanning forest, never all pairs; a pair is reported only by the first table in
which both agree. Components come from alternating large-star and small-star rounds on tables in the shared folder.

Defined cases: texts without words (null, empty) have fingerprint zero and link like any other; fewer than three
words are one shingle; repeated rows have equal fingerprints and so one component. A null id has no say in
component_id. An empty table gives an empty result. Other columns are not read. Fingerprints and nodes with very many
rows are joined apart, so that no task gets all rows of one.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitta.llm.common import UPPER, binary_texts, id_text, saved, slices, spread_join

RADIUS, SHINGLE, SEED = 3, 3, 42
#: Expected rows of a bucket above which the key takes more bits.
BUCKET = 64
TILE = 4096
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())


def shingle_hashes(text: bytes, k: int = SHINGLE) -> list[int]:
    words = text.translate(_LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= k:
        return [xxhash.xxh64_intdigest(joined, SEED)]
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    return [digest(joined[s : e - 1], SEED) for s, e in zip([0, *ends], ends[k - 1 :])]


def fingerprint(text: bytes) -> int:
    """A bit is one if it is set in over half the shingles' hashes."""
    hashes = np.array(shingle_hashes(text), np.uint64)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        ones += np.unpackbits(hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""
    rows = id_text(docs, id_col, text_col)

    def run(batches):
        for batch in slices(batches):
            fps = np.fromiter((fingerprint(t) for t in binary_texts(batch)), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, fp bigint")


def tables(n: int, bucket: int = BUCKET) -> list[tuple[int, ...]]:
    """The blocks of bits; then for each table the blocks that make its key."""
    for blocks in (4, 5, 6):
        kept = blocks - RADIUS
        if n >> min(_widths(blocks)) * kept <= bucket or blocks == 6:
            return [(blocks, *c) for c in combinations(range(blocks), kept)]
    raise AssertionError


def _widths(blocks: int) -> list[int]:
    return [64 // blocks + (i < 64 % blocks) for i in range(blocks)]


def block_masks(blocks: int) -> list[int]:
    at, out = 0, []
    for w in _widths(blocks):
        out.append(((1 << w) - 1) << at)
        at += w
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def planes(fps: np.ndarray) -> np.ndarray:
    """64 rows: bit b of every fingerprint, packed into words of 64 lanes."""
    n = -len(fps) % 64
    bits = np.unpackbits(np.pad(fps, (0, n)).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")).view("<u8")


def _ahead(plane: np.ndarray, words: np.ndarray, d: int) -> np.ndarray:
    """Lanes of the given words, read d lanes further on; plane has spare words at its end."""
    w, s = divmod(d, 64)
    low = plane[words + w]
    return low if not s else (low >> np.uint64(s)) | (plane[words + w + 1] << np.uint64(64 - s))


def close_lanes(padded: np.ndarray, words: np.ndarray, alive: np.ndarray, other: np.ndarray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """The words and lanes (of those alive) whose fingerprint differs in at most three bits from the one d further on in other."""
    c1, c2, over = (np.zeros(len(words), np.uint64) for _ in range(3))
    for b in range(64):
        x = padded[b][words] ^ _ahead(other[b], words, d)
        carry = c1 & x
        c1 ^= x
        over |= c2 & carry
        c2 ^= carry
        if b % 8 == 7 and b < 63:
            live = (alive & ~over) != 0
            if not live.all():
                words, alive, c1, c2, over = words[live], alive[live], c1[live], c2[live], over[live]
            if not len(words):
                break
    return words, alive & ~over


def near_pairs(fps: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of rows (sorted by key) with one key that differ in at most three bits."""
    n = len(fps)
    if n < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    new = np.r_[True, keys[1:] != keys[:-1]]
    start = np.flatnonzero(new)
    size = np.diff(np.r_[start, n])
    left = (np.repeat(start + size, size) - np.arange(n) - 1).astype(np.int64)  # rows of the bucket after this one
    p = planes(fps)
    longest = int(left.max())
    padded = np.pad(p, ((0, 0), (0, longest // 64 + 2)))
    found_a, found_b = [], []
    for d in range(1, longest + 1):
        lanes = np.packbits(np.pad(left >= d, (0, -n % 64)), bitorder="little").view("<u8")
        words = np.flatnonzero(lanes)
        words, hit = close_lanes(padded, words, lanes[words], padded, d)
        _gather(words, hit, d, found_a, found_b)
    return _joined(found_a), _joined(found_b)


def tile_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices into a and b of rows of two tiles that differ in at most three bits."""
    if not len(a) or not len(b):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded_a, n = planes(a), len(a)
    b_at, mine = np.arange(len(b)), np.packbits(np.pad(np.ones(n, bool), (0, -n % 64)), bitorder="little").view("<u8")
    rows, cols = [], []
    bits_b = np.unpackbits(b.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(bool)
    full = ~np.uint64(0)
    for j in b_at:
        words, alive = np.arange(len(mine)), mine
        c1, c2, over = (np.zeros(len(mine), np.uint64) for _ in range(3))
        for k in range(64):
            x = padded_a[k][words] ^ (full if bits_b[j, k] else np.uint64(0))
            carry = c1 & x
            c1 ^= x
            over |= c2 & carry
            c2 ^= carry
            if k % 8 == 7 and k < 63:
                live = (alive & ~over) != 0
                words, alive, c1, c2, over = words[live], alive[live], c1[live], c2[live], over[live]
                if not len(words):
                    break
        at: list = []
        _gather(words, alive & ~over, 0, at, [])
        hit = _joined(at)
        rows.append(hit)
        cols.append(np.full(len(hit), j))
    return _joined(rows), _joined(cols)


def _gather(words, hit, d, found_a, found_b) -> None:
    some = np.flatnonzero(hit)
    if len(some):
        lanes = np.unpackbits(hit[some].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        w, lane = np.nonzero(lanes)
        at = words[some][w] * 64 + lane
        found_a.append(at)
        found_b.append(at + d)


def _joined(parts: list) -> np.ndarray:
    return np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As few of the links as join the same rows."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := parent.get(x, x)) != x:
            parent[x] = p = parent.get(p, p)
            x = p
        return x

    keep = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        rx, ry = root(x), root(y)
        if rx != ry:
            parent[max(rx, ry)] = min(rx, ry)
            keep.append(i)
    return a[keep], b[keep]


def _first_table(a: np.ndarray, b: np.ndarray, table: int, every: list[tuple[int, ...]]) -> np.ndarray:
    """Pairs that agree on no earlier table's key."""
    masks = block_masks(every[0][0])
    x, ok = a ^ b, np.ones(len(a), bool)
    for t in every[:table]:
        ok &= (x & np.uint64(sum(masks[i] for i in t[1:]))) != 0
    return ok


def links(distinct: DataFrame, n: int, tile: int = TILE, bucket: int = BUCKET) -> DataFrame:
    """a, b: a spanning forest for every batch of the fingerprints (column fp, distinct) that differ in at most three bits."""
    every = tables(n, bucket)
    masks = block_masks(every[0][0])
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(sum(masks[i] for i in c[1:])))).alias("key")) for t, c in enumerate(every)])).alias("k")).select("fp", "k.t", "k.key")
    sizes = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > tile)
    hot = saved(sizes, "simhash-hot")
    long = not hot.isEmpty()
    usual = keyed.join(hot, ["t", "key"], "left_anti") if long else keyed

    def emit(a, b):
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    def buckets(batches):
        rest = None
        for batch in _with_end(batches):
            if batch is not None:
                rows = pa.Table.from_batches([batch]).to_pydict() if batch.num_rows == 0 else {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(("fp", "t", "key"))}
                now = [np.asarray(rows["fp"], np.int64).view(np.uint64), np.asarray(rows["t"], np.int64), np.asarray(rows["key"], np.int64)]
                rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now)]
                if len(rest[0]) < 1 << 15:
                    continue
                cut = len(rest[0]) - 1  # the last bucket may go on in the next batch
                while cut and rest[1][cut - 1] == rest[1][-1] and rest[2][cut - 1] == rest[2][-1]:
                    cut -= 1
            elif rest is None:
                return
            else:
                cut = len(rest[0])
            part, rest = [x[:cut] for x in rest], [x[cut:] for x in rest]
            for t in np.unique(part[1]):
                of = part[1] == t
                fps = part[0][of]
                a, b = near_pairs(fps, part[2][of])
                ok = _first_table(fps[a], fps[b], int(t), every)
                a, b = forest(a[ok], b[ok])
                yield emit(fps[a], fps[b])

    found = usual.repartition("t", "key").sortWithinPartitions("t", "key").mapInArrow(buckets, "a bigint, b bigint")
    if long:
        # Row r of a long bucket is in tile r mod tiles; it goes to every pair of tiles that holds its own.
        tiled = keyed.join(hot, ["t", "key"]).withColumn("tiles", F.ceil(F.col("rows") / tile).cast("int"))
        mine = F.pmod(F.xxhash64("fp", F.lit(7)), F.col("tiles")).cast("int")
        tiled = tiled.withColumn("mine", mine).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        tiled = tiled.select("t", "key", F.least("mine", "with").alias("i"), F.greatest("mine", "with").alias("j"), (F.col("mine") > F.col("with")).alias("second"), "fp")

        def tiles(key, rows):
            fps, second = rows.column("fp").to_numpy().view(np.uint64), np.asarray(rows.column("second").to_pylist(), bool)
            if key[2].as_py() == key[3].as_py():
                a, b = near_pairs(fps, np.zeros(len(fps), np.int64))
                x, y = fps[a], fps[b]
            else:
                left, right = fps[~second], fps[second]
                a, b = tile_pairs(left, right)
                x, y = left[a], right[b]
            ok = _first_table(x, y, key[0].as_py(), every)
            x, y = forest(x[ok].view(np.int64), y[ok].view(np.int64))
            return pa.table({"a": pa.array(x, pa.int64()), "b": pa.array(y, pa.int64())})

        found = found.unionByName(tiled.groupBy("t", "key", "i", "j").applyInArrow(tiles, "a bigint, b bigint"))
    return found


def _with_end(batches):
    yield from batches
    yield None


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """node, root (the least node of its component) of all linked nodes but the roots, by alternating stars."""
    now = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u != v").distinct(), "links")
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(rounds):
        # large star: every larger neighbour of u is tied to the least of u and its neighbours
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = saved(spread_join(both.filter("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        # small star: the smaller neighbours of u, and u, are tied to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u != v").distinct()
        after = saved(small, "links")
        same = after.count() == now.count() and after.join(now, ["u", "v"], "left_anti").isEmpty()
        now = after
        if same:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def simhash_groups(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id; one row per row of docs."""
    prints = saved(fingerprints(docs, id_col, text_col), "simhash")
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    n = distinct.count()
    found = components(links(distinct.select("fp"), n, tile, bucket))
    tied = distinct.join(found, distinct.fp == found.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = tied.groupBy("root").agg(F.min("least").alias("component_id"))
    of = tied.join(ids, "root").select(F.col("fp"), "component_id")
    return spread_join(prints, of, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
