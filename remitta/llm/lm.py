"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

Counts. Every token of the training documents (those whose crc32 of the id, mod FOLDS, is not HELD_OUT) is counted
exactly: each task counts its batches, the counts are summed by word and written to the shared folder. The base score
of a text is its smoothed unigram log-probability. The COMMON most frequent words go to every task; all other words
of a text, none of which is frequent, are joined with the counts.

Model. The VOCABULARY most frequent tokens (ties by word) make CLASSES classes of GROUPS groups of GROUP_SIZE words, by
rank; one more class holds all other words. P(token) = P(class | history) P(group | class, history) P(token | group,
history), each a softmax over hashed features of the history (the last word, the last two, the word before the last, the
third last) added to log-priors from the counts. Words of the last class share its probability in proportion to their
base probability, so the model is normalised. Training is stochastic gradient descent in every shard of the training
documents, starting from the common weights; the weights' changes are averaged by tokens in steps of at most FAN
messages and added, ROUNDS times, each on its share of the documents; all training documents take part. Scoring works on batches of sparse rows in numpy.

The score depends on the rows of the table alone, not on how they are partitioned: shards are made by a hash of id and
text, are as many as the training tokens ask for, and are learned in the order of that hash; sums go by shard number.
(Only rows that repeat both id and text are bound to meet in one shard.)

Defined cases: null and empty texts have one token, the end. A row with a null id takes part in the training. With no
training tokens every token is the one unknown token, and the score equals the base. Repeated rows are scored alike.
Other columns are not read.
"""

from __future__ import annotations

import dataclasses
import math
from collections import Counter
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitta.llm.common import UPPER, binary_texts, id_text, release, saved

FOLDS, HELD_OUT = 5, 1
COMMON = 200_000
CLASSES, GROUPS, GROUP_SIZE = 32, 32, 32
VOCABULARY = CLASSES * GROUPS * GROUP_SIZE
BUCKETS = 1 << 15
_BUCKET = np.min_scalar_type(BUCKETS - 1)  # sixteen bits are sorted by radix
ROUNDS, RATE = 2, 0.1
STEP, CHUNK = 4096, 8192  # tokens of a gradient step, and of a scoring step
SHARD_TOKENS = 2_000_000
FAN = 32  # messages that are averaged at a time
COUNTED = 4000  # rows whose words are counted before they are handed on
PARTS = 32  # pieces of the weights that are averaged apart
END = "\n"  # no word holds it
_LOWER = bytes.maketrans(UPPER.encode(), UPPER.lower().encode())
_START = 0x5EED


def words(text: bytes) -> list[bytes]:
    return text.translate(_LOWER).split()


def held_out(doc_id) -> bool:
    return doc_id is not None and crc32(str(doc_id).encode()) % FOLDS == HELD_OUT


def _training(rows: DataFrame) -> DataFrame:
    return rows.filter(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS != HELD_OUT, F.lit(True)))


def count(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: of the tokens of all training documents."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, COUNTED):
                seen: Counter[bytes] = Counter()
                part = batch.slice(at, COUNTED)
                for text in binary_texts(part):
                    seen.update(words(text))
                seen[END.encode()] = part.num_rows
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        release()

    counted = _training(id_text(docs, id_col, text_col)).mapInArrow(run, "word string, n bigint")
    return saved(counted.groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")


class Common:
    """What every task knows of the counts."""

    def __init__(self, words: list[bytes], counts: np.ndarray, tokens: int, distinct: int):
        """words: by falling count."""
        self.counts, self.tokens, self.distinct = counts, tokens, distinct
        self.index = {w: i for i, w in enumerate(words)}
        self._derive()

    def __getstate__(self):
        return b" ".join(self.index), self.counts, self.tokens, self.distinct

    def __setstate__(self, state):
        joined, self.counts, self.tokens, self.distinct = state
        self.index = {w: i for i, w in enumerate(joined.split(b" "))} if len(self.counts) else {}
        self._derive()

    def _derive(self):
        self.base = np.log10((self.counts + 0.5) / self.total())
        self.ids = np.fromiter(map(crc32, [*self.index, b""]), np.uint64, len(self.index) + 1)  # the last is looked up for other words, and replaced
        n = min(VOCABULARY, len(self.index))
        p = np.zeros(VOCABULARY)
        p[:n] = 10.0 ** self.base[:n]
        words = p.reshape(CLASSES * GROUPS, GROUP_SIZE)
        groups = words.sum(1).reshape(CLASSES, GROUPS)
        rest = max(1 - p.sum(), 1e-12)
        with np.errstate(divide="ignore", invalid="ignore"):
            self.class_prior = np.log(np.r_[groups.sum(1), rest]).astype(np.float32)
            self.group_prior = np.where(groups > 0, np.log(groups / groups.sum(1, keepdims=True)), -np.inf).astype(np.float32)
            self.word_prior = np.where(words > 0, np.log(words / words.sum(1, keepdims=True)), -np.inf).astype(np.float32)
        self.log_rest = math.log10(rest)
        self.n_vocabulary = n

    def total(self) -> float:
        return self.tokens + 0.5 * (self.distinct + 1)


def common(counts: DataFrame) -> Common:
    """The COMMON most frequent words, ties by word. Whole steps of frequency come to the driver, and of the step that passes the bound only the first words."""
    step = F.floor(F.log2("n") * 64).cast("long")
    steps = counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("v"), F.sum("n").alias("n")).orderBy(F.desc("step")).collect()
    tokens, distinct = sum(s.n for s in steps), sum(s.v for s in steps)
    least, held = None, 0
    for s in steps:
        if held + s.v > COMMON:
            break
        least, held = s.step, held + s.v
    chosen = counts.filter(step >= least).select("word", "n") if least is not None else counts.limit(0).select("word", "n")
    if held < min(COMMON, distinct):
        cut = counts.filter(step == next(s.step for s in steps if least is None or s.step < least)).select("word", "n")
        chosen = chosen.unionByName(cut.orderBy(F.desc("n"), "word").limit(COMMON - held))
    top = chosen.toArrow()
    words = [w.encode() for w in top["word"].to_pylist()]
    n = top["n"].to_numpy()
    order = sorted(range(len(words)), key=lambda i: (-n[i], words[i]))
    return Common([words[i] for i in order], n[order].astype(np.float64) if len(order) else np.zeros(0), tokens, distinct)


class Batch:
    """Tokens of several texts: index among the common words (-1: another), history features."""

    def __init__(self, texts: list[bytes], known: Common):
        tokens: list[bytes] = []
        self.starts = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            self.starts[i] = len(tokens)
            tokens += words(text)
            tokens.append(END.encode())
        self.tokens = tokens
        self.index = np.fromiter(map(known.index.get, tokens, repeat(-1)), np.int64, len(tokens))
        ids = known.ids.take(self.index, mode="wrap")
        others = np.flatnonzero(self.index < 0)
        ids[others] = np.fromiter(map(crc32, map(tokens.__getitem__, others.tolist())), np.uint64, len(others))
        self.sizes = np.diff(np.r_[self.starts, len(tokens)])
        back = []
        for k in (1, 2, 3):
            b = np.empty(len(tokens), np.uint64)
            b[k:] = ids[:-k]
            for place in range(k):
                b[self.starts[self.sizes > place] + place] = _START
            back.append(b)
        b1, b2, b3 = back
        m = np.uint64(0x9E3779B97F4A7C15)
        mix = lambda x, salt: (x + np.uint64(salt)) * m
        self.features = [mix(b1, 1), mix(mix(b1, 2) ^ b2, 3), mix(b2, 5), mix(b3, 7)]
        vocabulary = (self.index >= 0) & (self.index < VOCABULARY)
        self.classes = np.where(vocabulary, self.index // (GROUPS * GROUP_SIZE), CLASSES)
        self.groups = np.where(vocabulary, self.index // GROUP_SIZE, 0)  # numbered through all classes
        self.within = np.where(vocabulary, self.index % GROUP_SIZE, 0)


def _bucket(feature: np.ndarray, extra: np.ndarray | None = None) -> np.ndarray:
    """extra: from _extra()."""
    x = feature if extra is None else feature + extra
    mixed = x >> np.uint64(32)
    mixed ^= x
    mixed *= np.uint64(0xD6E8FEB86659FD93)
    mixed >>= np.uint64(49)
    return mixed.view(np.int64)


def _extra(number: np.ndarray) -> np.ndarray:
    return number.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)


_rooms: dict[str, np.ndarray] = {}


def _room(name: str, rows: int, columns: int) -> np.ndarray:
    """Memory that is kept: what is freed after each step goes back to the system, and is slow to get again."""
    if len(_rooms.get(name, ())) < rows * columns:
        _rooms[name] = np.empty(rows * columns, np.float32)
    return _rooms[name][: rows * columns].reshape(rows, columns)


@dataclasses.dataclass
class Weights:
    classes: np.ndarray  # BUCKETS x (CLASSES + 1)
    groups: np.ndarray  # BUCKETS x GROUPS
    words: np.ndarray  # BUCKETS x GROUP_SIZE

    @staticmethod
    def zero() -> Weights:
        return Weights(*(np.zeros((BUCKETS, n), np.float32) for n in (CLASSES + 1, GROUPS, GROUP_SIZE)))

    def tables(self) -> list[np.ndarray]:
        return [self.classes, self.groups, self.words]


def _logits(table: np.ndarray, at: list[np.ndarray], prior: np.ndarray) -> np.ndarray:
    """Log-priors plus small weights, in kept memory; the bound only keeps exp() finite."""
    z, more = (_room(name, len(at[0]), table.shape[1]) for name in ("logits", "more"))
    np.take(table, at[0], axis=0, out=z, mode="clip")
    for a in at[1:]:
        np.take(table, a, axis=0, out=more, mode="clip")
        z += more
    z += prior
    return np.minimum(z, 60, out=z)


def _softmax(table: np.ndarray, at: list[np.ndarray], prior: np.ndarray) -> np.ndarray:
    """Rows that sum to one."""
    z = _logits(table, at, prior)
    np.exp(z, out=z)
    z *= (1 / (np.einsum("ij->i", z) + np.float32(1e-30)))[:, None]
    return z


def _descend(table: np.ndarray, at: list[np.ndarray], error: np.ndarray) -> None:
    """One step: the gradients of all tokens of a bucket are added up; their weight falls with their number, and is RATE for one. error is changed."""
    width = table.shape[1]
    lines = table.view(f"V{4 * width}").ravel()
    error *= np.float32(RATE)
    for a in at:
        order = a.astype(_BUCKET).argsort(kind="stable")
        rows = a.take(order)
        begins = np.ones(len(a) + 1, bool)
        np.not_equal(rows[1:], rows[:-1], out=begins[1:-1])
        first = begins.nonzero()[0]
        n, first = first[1:] - first[:-1], first[:-1]
        change, row = _room("change", len(first), width), _room("row", len(first), width)
        np.take(error, order.take(first), axis=0, out=change, mode="clip")
        several = (n > 1).nonzero()[0]
        if len(several):
            m = n.take(several)
            begin = np.cumsum(m) - m
            tokens = order.take(np.repeat(first.take(several) - begin, m) + np.arange(m.sum()))
            sums = np.add.reduceat(np.take(error, tokens, axis=0, out=_room("fetched", len(tokens), width), mode="clip"), begin, axis=0)
            sums *= (np.float32(2) / (m + 1).astype(np.float32))[:, None]
            change[several] = sums
        where = rows.take(first)
        np.take(table, where, axis=0, out=row, mode="clip")
        row -= change
        lines[where] = row.view(lines.dtype).ravel()


def _levels(w: Weights, known: Common, batch: Batch, cut: slice):
    """For the class, the group and the word: tokens, weights, buckets of the features, priors, and what came."""
    c = batch.classes[cut]
    yield slice(None), w.classes, [_bucket(f[cut]) for f in batch.features], known.class_prior, c
    inner = np.flatnonzero(c < CLASSES)
    if len(inner):
        c, g = c[inner], batch.groups[cut][inner]
        of = [f[cut][inner] for f in batch.features]
        extra = _extra(c + 1)
        yield inner, w.groups, [_bucket(f, extra) for f in of], known.group_prior.take(c, 0), g % GROUPS
        extra = _extra(g + CLASSES + 1)
        yield inner, w.words, [_bucket(f, extra) for f in of], known.word_prior.take(g, 0), batch.within[cut][inner]


def learn(w: Weights, known: Common, batch: Batch) -> None:
    for i in range(0, len(batch.index), STEP):
        for _, table, at, prior, came in _levels(w, known, batch, slice(i, i + STEP)):
            p = _softmax(table, at, prior)
            p.reshape(-1)[np.arange(0, p.size, p.shape[1]) + came] -= 1
            _descend(table, at, p)


def log10_p(w: Weights, known: Common, batch: Batch) -> np.ndarray:
    """Of each token; for words outside the vocabulary without their share of the class, which needs their count."""
    out = np.zeros(len(batch.index))
    for i in range(0, len(out), CHUNK):
        cut = slice(i, i + CHUNK)
        part = np.zeros(len(batch.index[cut]))
        for which, table, at, prior, came in _levels(w, known, batch, cut):
            z = _logits(table, at, prior)
            chosen = z.reshape(-1).take(np.arange(0, z.size, z.shape[1]) + came).astype(np.float64)
            np.exp(z, out=z)
            part[which] += np.maximum((chosen - np.log(np.einsum("ij->i", z) + np.float32(1e-30))) / math.log(10), -30)
        part[batch.classes[cut] == CLASSES] -= known.log_rest
        out[cut] = part
    return out


def _texts(batch: pa.RecordBatch, limit: int = 1 << 20):
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


def train(spark: SparkSession, docs: DataFrame, counts, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> Weights:
    w = Weights.zero()
    rows = _training(id_text(docs, id_col, text_col)).select(F.xxhash64("doc_id", "text", F.lit(3)).alias("h"), "text")
    shards = max(1, counts.value.tokens // SHARD_TOKENS)
    rows = rows.withColumn("shard", F.pmod(F.shiftright("h", 8), F.lit(shards)).cast("int"))
    for r in range(rounds):
        now = spark.sparkContext.broadcast(w)
        share = rows.filter(F.pmod("h", F.lit(rounds)) == r).repartitionById(shards, "shard")

        def run(shard: pa.Table) -> pa.Table:
            own, tokens = Weights(*(t.copy() for t in now.value.tables())), 0
            for batch in shard.sort_by([("h", "ascending"), ("text", "ascending")]).to_batches():
                for _, texts in _texts(batch):
                    b = Batch(texts, counts.value)
                    learn(own, counts.value, b)
                    tokens += len(b.index)
            parts = [x for new, old in zip(own.tables(), now.value.tables()) for x in _split(new - old)]
            release()
            return pa.Table.from_batches([_message(np.arange(len(parts)), shard.column("shard")[0].as_py(), parts, tokens)])

        changes, units = share.groupBy("shard").applyInArrow(run, _MESSAGE), shards
        while units > 1:
            units = -(-units // FAN)
            changes = changes.withColumn("into", F.col("unit") % units).groupBy("part", "into").applyInArrow(_averaged, _MESSAGE)
        got = {m.part: np.frombuffer(m.change, np.float16).astype(np.float32) for m in changes.collect()}
        if got:
            for i, table in enumerate(w.tables()):
                table += np.concatenate([got[i * PARTS + k] for k in range(PARTS)]).reshape(table.shape)
        now.destroy()
    return w


_MESSAGE = "part int, unit int, change binary, tokens bigint"


def _split(table: np.ndarray) -> list[bytes]:
    return [x.astype(np.float16).tobytes() for x in np.split(table, PARTS)]


def _message(parts, unit: int, changes, tokens) -> pa.RecordBatch:
    n = len(changes)
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([unit] * n, pa.int32()), pa.array(changes, pa.binary()), pa.array([tokens] * n, pa.int64())], ["part", "unit", "change", "tokens"])


def _averaged(rows: pa.Table) -> pa.Table:
    total, n = 0.0, 0
    for r in rows.sort_by("unit").to_pylist():
        total = total + np.frombuffer(r["change"], np.float16).astype(np.float64) * r["tokens"]
        n += r["tokens"]
    return pa.Table.from_batches([_message([rows.column("part")[0].as_py()], rows.column("into")[0].as_py(), [(total / n).astype(np.float16).tobytes()], n)])


def score(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score; one row per row of docs."""
    counts = count(docs, id_col, text_col)
    known = common(counts)
    shared = spark.sparkContext.broadcast(known)
    weights = spark.sparkContext.broadcast(train(spark, docs, shared, id_col, text_col, rounds))
    rows = id_text(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches):
        known, w = shared.value, weights.value
        for batch in batches:
            for begin, texts in _texts(batch):
                part, b = batch.slice(begin, len(texts)), Batch(texts, known)
                have = b.index >= 0
                base = np.where(have, known.base[b.index] if len(known.base) else 0, 0.0)
                model = log10_p(w, known, b)
                model += np.where(b.classes == CLASSES, base, 0)  # the other words' base is added after the join
                sums = [np.add.reduceat(x.astype(np.float64), b.starts) for x in (base, model, have)]
                others, numbers, ends = [], [], [0]
                missing = np.flatnonzero(~have)
                at = np.searchsorted(missing, [*b.starts[1:].tolist(), len(b.index)])
                for s, e in zip([0, *at[:-1].tolist()], at.tolist()):
                    found = Counter([b.tokens[i] for i in missing[s:e].tolist()])
                    others += found
                    numbers += found.values()
                    ends.append(len(others))
                pairs = pa.StructArray.from_arrays([pa.array(others, pa.binary()).cast(pa.string()), pa.array(numbers, pa.int64())], ["w", "n"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([held_out(i) for i in part.column(0).to_pylist()]), pa.array(b.sizes), pa.array(sums[2].astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)],
                    ["doc_id", "held_out", "n_tokens", "n_common", "base", "model", "others"],
                )
        release()

    scored = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, n_tokens bigint, n_common bigint, base double, model double, others array<struct<w:string,n:bigint>>")
    # written once, so a row keeps its number however often later stages are run
    scored = saved(scored.withColumn("row", F.monotonically_increasing_id()), "lm-scored")
    few = counts.select("word", F.col("n").alias("c"))
    term = F.col("n") * F.log10((F.coalesce(F.col("c"), F.lit(0)) + 0.5) / F.lit(known.total()))
    rest = scored.select("row", F.inline("others").alias("w", "n")).join(few, F.col("w") == F.col("word"), "left").groupBy("row").agg(F.sum(term).alias("other_base"), F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("other_known"))
    both = scored.drop("others").join(rest, "row", "left")
    other = F.coalesce("other_base", F.lit(0.0))
    return both.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_common") + F.coalesce("other_known", F.lit(0))).alias("n_known"), F.lit(known.tokens).cast("bigint").alias("train_tokens"), (F.col("base") + other).alias("base_score"), (F.col("model") + other).alias("score")
    )
