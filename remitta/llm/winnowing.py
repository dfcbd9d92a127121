"""Benchmark decontamination by winnowing.

A text is a sequence of words. Every five consecutive words are hashed (a k-gram), and in every six consecutive
k-grams the one with the least hash is a fingerprint. Ten shared words hold six shared k-grams, so a span of ten or
more words that a document shares with an item always shares a fingerprint. Fingerprints of the documents are
joined with those of the items; each match is extended to the item windows around it, compared word for word. Items
of fewer than ten words are matched as one window of their own length.

Items of at most about `block_words` words together, the usual case, go to every task: one scan, without a shuffle.
Beyond that nothing of the items but a bitmap of their fingerprints (2 ** BITS bits, whatever their number) goes to
the tasks: the windows around the fingerprints that it holds are joined with the items' windows by their words, and
the matches of a document are put together by the number of its row. Windows that many documents share are joined apart.

Defined cases: null and empty texts have no words; items without words match nothing; items that repeat an id count
once; the windows of an item without an id count as hits, but name no item; an empty benchmark leaves all documents clean. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitta.llm.common import binary_texts, id_text, release, saved, spread_join

WINDOW, GRAM = 10, 5
BLOCK_WORDS = 300_000
#: Bits of the bitmap of fingerprints: 16 MB.
BITS = 27
#: Bytes that belong to words stay, A-Z become a-z, others become blanks.
_WORD_BYTES = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
_MIX = np.array([pow(0x9E3779B97F4A7C15, i + 1, 2**64) for i in range(WINDOW)], np.uint64)
_END = b"\0"  # between documents; no word holds it


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of every k consecutive words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += hashes[i : i + n] * _MIX[i]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def winnow(grams_: np.ndarray, w: int = WINDOW - GRAM + 1) -> np.ndarray:
    """Positions of the least hash in every w consecutive ones; the last of equal ones."""
    n = len(grams_) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = grams_[:n].copy(), np.arange(n)
    for i in range(1, w):
        less = grams_[i : i + n] <= best
        best[less] = grams_[i : i + n][less]
        at[less] = np.flatnonzero(less) + i
    return np.unique(at)


def word_hashes(tokens: list[bytes]) -> np.ndarray:
    return np.fromiter(map(crc32, tokens), np.uint64, len(tokens))


class ItemIndex:
    """Windows and fingerprints of a block of items."""

    def __init__(self, items: list[tuple[str | None, bytes]]):
        self.windows: dict[bytes, list[str]] = {}
        fingerprints, short = [], {}
        for item, text in items:
            w = words(text)
            if not w:
                continue
            size = min(len(w), WINDOW)
            for s in range(len(w) - size + 1):
                of = self.windows.setdefault(b" ".join(w[s : s + size]), [])
                if item is not None and item not in of[-1:]:
                    of.append(item)
            h = word_hashes(w)
            if len(w) >= WINDOW:
                g = grams(h, GRAM)
                fingerprints.append(g[winnow(g)])
            else:
                short.setdefault(len(w), []).append(grams(h, len(w)))
        self.fingerprints = np.unique(np.concatenate(fingerprints)) if fingerprints else np.zeros(0, np.uint64)
        self.short = {k: np.unique(np.concatenate(v)) for k, v in short.items()}

    def matches(self, tokens: list[bytes]) -> list[tuple[int, int, list[str]]]:
        """Start, length and items of every item window in the tokens."""
        h, found = word_hashes(tokens), []
        if len(self.fingerprints):
            g = grams(h, GRAM)
            at = winnow(g)
            at = at[_in(g[at], self.fingerprints)]
            if len(at):
                starts = np.unique((at[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())
                for s in starts[(starts >= 0) & (starts + WINDOW <= len(tokens))].tolist():
                    if (of := self.windows.get(b" ".join(tokens[s : s + WINDOW]))) is not None:
                        found.append((s, WINDOW, of))
        for k, known in self.short.items():
            for s in np.flatnonzero(_in(grams(h, k), known)).tolist():
                if (of := self.windows.get(b" ".join(tokens[s : s + k]))) is not None:
                    found.append((s, k, of))
        return found


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(values):
        return np.zeros(0, bool)
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    return known[at] == values


def scan(texts: list[bytes], index: ItemIndex) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """For each text: words, hit spans and items."""
    tokens: list[bytes] = []
    starts = []
    for text in texts:
        starts.append(len(tokens))
        tokens += words(text)
        tokens.append(_END)
    out = [(end - s - 1, [], set()) for s, end in zip(starts, [*starts[1:], len(tokens)])]
    if found := index.matches(tokens):
        of = np.searchsorted(starts, [s for s, _, _ in found], "right") - 1
        for (s, k, items), d in zip(found, of.tolist()):
            out[d][1].append((s - starts[d], s - starts[d] + k))
            out[d][2].update(items)
    return out


def covered(spans) -> int:
    """Words inside any span."""
    total = end = 0
    for s, e in sorted(spans):
        total += max(0, e - max(s, end))
        end = max(end, e)
    return total


def _chunks(batch: pa.RecordBatch, limit: int = 1 << 20) -> Iterator[tuple[int, list[bytes]]]:
    """The row at which a part of about a megabyte begins, and its texts."""
    begin, texts, size = 0, [], 0
    for t in binary_texts(batch):
        texts.append(t)
        size += len(t)
        if size >= limit:
            yield begin, texts
            begin, texts, size = begin + len(texts), [], 0
    if texts:
        yield begin, texts


_OUT = "doc_id {0}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean, items array<string>, spans array<struct<s:int,e:int>>"
_SPANS = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
_STRINGS = pa.list_(pa.string())
_WINDOWS = pa.list_(pa.struct([("s", pa.int32()), ("k", pa.int32()), ("win", pa.string())]))


def _columns(out: list[tuple], names: list[str], kinds: list[pa.DataType], first: list[pa.Array]) -> pa.RecordBatch:
    cols = list(zip(*out)) if out else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([*first, *(pa.array(list(c), k) for c, k in zip(cols, kinds))], names)


def _items(benchmark: DataFrame, item_col: str, text_col: str) -> DataFrame:
    return benchmark.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def one_block(items: DataFrame, block_words: int) -> list[tuple[str | None, bytes]] | None:
    """All items, if they have about so many words together; no more than these are read."""
    block, size = [], 0
    for r in items.toLocalIterator():
        if size >= block_words:
            return None
        block.append((r.item, text := r.text.encode()))
        size += len(words(text))
    return block


def decontaminate(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, items, spans (of word positions); one row per row of docs."""
    rows = id_text(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]
    items = _items(benchmark, item_col, item_text_col)
    block = one_block(items, block_words)
    if block is not None:
        return rows.mapInArrow(_matcher(spark.sparkContext.broadcast(block)), _OUT.format(kind))
    known = saved(items.mapInArrow(_item_windows, "win string, item string, fp bigint, k int"), "winnowing-items")
    prints = known.filter("fp is not null")
    sizes = [r.k for r in prints.select("k").distinct().collect()]
    bits = spark.sparkContext.broadcast(_bitmap(prints.select("fp")))
    scanned = saved(rows.mapInArrow(_candidates(bits, sizes), f"doc_id {kind}, n_words bigint, found array<struct<s:int,k:int,win:string>>").withColumn("row", F.monotonically_increasing_id()), "winnowing-scan")
    windows = known.filter("win is not null").groupBy("win").agg(F.collect_set("item").alias("of"))
    hits = spread_join(scanned.select("row", F.inline("found")), windows, "win")
    merged = hits.groupBy("row").agg(F.collect_set(F.struct("s", (F.col("s") + F.col("k")).alias("e"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("of"))).alias("items"))
    none = lambda c: F.coalesce(c, F.array().cast(dict(merged.dtypes)[c]))
    found = scanned.drop("found").join(merged, "row", "left").select("doc_id", "n_words", none("spans").alias("spans"), none("items").alias("items"))
    return found.mapInArrow(_summed, _OUT.format(kind))


def _item_windows(batches):
    """The windows of each item, and its fingerprints; k: the words of what is hashed."""
    for batch in batches:
        for item, text in zip(batch.column(0).to_pylist(), binary_texts(batch)):
            w = words(text)
            if not w:
                continue
            size, h = min(len(w), WINDOW), word_hashes(w)
            wins = list({b" ".join(w[s : s + size]) for s in range(len(w) - size + 1)})
            fps = np.unique(g[winnow(g)] if len(w) >= WINDOW and len(g := grams(h, GRAM)) else grams(h, len(w))).view(np.int64)
            n, m = len(wins), len(fps)
            k = GRAM if len(w) >= WINDOW else -len(w)  # short items are matched whole
            yield pa.RecordBatch.from_arrays(
                [pa.array([*wins, *[None] * m], pa.binary()).cast(pa.string()), pa.array([item] * (n + m), pa.string()), pa.array([*[None] * n, *fps.tolist()], pa.int64()), pa.array([k] * (n + m), pa.int32())], ["win", "item", "fp", "k"]
            )


def _bitmap(prints: DataFrame) -> np.ndarray:
    """One bit for the last BITS bits of every fingerprint."""
    at = F.col("fp").bitwiseAND(F.lit((1 << BITS) - 1))
    maps = prints.groupBy(F.shiftright(at, 15).alias("b")).agg(F.bitmap_construct_agg(at.bitwiseAND(F.lit(32767))).alias("m"))
    out = np.zeros(1 << (BITS - 3), np.uint8)
    for r in maps.collect():
        out[r.b * 4096 : r.b * 4096 + len(r.m)] = np.frombuffer(r.m, np.uint8)
    return out


def _marked(bits: np.ndarray, prints: np.ndarray) -> np.ndarray:
    at = (prints & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7)) & 1 == 1


def _candidates(shared, sizes: list[int]):
    """Words of each document, and its windows that may be in an item."""

    def run(batches):
        bits = shared.value
        for batch in batches:
            for begin, texts in _chunks(batch):
                n_words, found = [], []
                for text in texts:
                    w = words(text)
                    h, wins = word_hashes(w), []
                    if GRAM in sizes:
                        g = grams(h, GRAM)
                        at = winnow(g)
                        at = at[_marked(bits, g[at])]
                        starts = np.unique((at[:, None] - np.arange(WINDOW - GRAM + 1)).ravel())
                        wins += [(s, WINDOW) for s in starts[(starts >= 0) & (starts + WINDOW <= len(w))].tolist()]
                    for k in (-k for k in sizes if k < 0):
                        wins += [(s, k) for s in np.flatnonzero(_marked(bits, grams(h, k))).tolist()]
                    n_words.append(len(w))
                    found.append([{"s": s, "k": k, "win": b" ".join(w[s : s + k]).decode()} for s, k in wins])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(texts)), pa.array(n_words, pa.int64()), pa.array(found, _WINDOWS)], ["doc_id", "n_words", "found"])
        release()

    return run


def _matcher(shared):
    """Matches with the items that are known to every task."""

    def run(batches):
        index = ItemIndex(shared.value)
        for batch in batches:
            for begin, texts in _chunks(batch):
                chosen = [(n, [{"s": s, "e": e} for s, e in sorted(set(spans))], sorted(items)) for n, spans, items in scan(texts, index)]
                yield from _summed([_columns(chosen, ["doc_id", "n_words", "spans", "items"], [pa.int64(), _SPANS, _STRINGS], [batch.column(0).slice(begin, len(texts))])])
        del index
        release()

    return run


def _summed(batches):
    for batch in batches:
        out = []
        for spans, items in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            spans, items = sorted((x["s"], x["e"]) for x in spans), sorted(items)
            n_hit = covered(spans)
            out.append((n_hit, len(items), hashlib.sha256(",".join(items).encode()).hexdigest(), n_hit > 0, items, [{"s": s, "e": e} for s, e in spans]))
        yield _columns(out, ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "items", "spans"], [pa.int64(), pa.int64(), pa.string(), pa.bool_(), _STRINGS, _SPANS], [batch.column(0), batch.column(1)])
