"""Language identification by interpolated Kneser-Ney character models.

One model per language, of order four, over lower-case letters with everything else as a blank. N-grams are 64-bit
hashes in sorted arrays: for every n-gram seen in training, of any language, the row of its log-probabilities under
all languages; for every context its back-off weights. A text gets the language with the least cross-entropy per
character. The score is the posterior of that language; how the evidence counts (a temperature, and the power of the
length) is fitted on texts that the models didn't see; `rejected` tells texts whose cross-entropy is above what 99.5 % of those texts have.

Learning uses at most `rows_per_language` whole documents for each language, chosen by the hash of their id (half
for the counts, half for calibration); documents without text, language or id take no part. Prediction reads only
the text.

Defined cases: null texts and texts without letters are `und` with score 0, and so is every text if nothing could be
learned. Equal cross-entropies go to the language first in order. Repeated rows get equal results; of rows that repeat
an id and a language one text is learned from. An empty table gives an empty result, a text of any length is read
whole, other columns are not read.
"""

from __future__ import annotations

import dataclasses
from functools import lru_cache
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from remitta.llm.common import _HASHES, hash_rank, one_text, slices

ORDER = 4
ROWS_PER_LANGUAGE = 400
FOLDS, HELD_OUT = 5, 0
UND = "und"
_P = np.array([pow(0x9E3779B97F4A7C15, 2 * i + 1, 2**64) for i in range(ORDER)], np.uint64)
_SLICE = 1 << 19  # characters scored at once


@lru_cache(1)
def _letters() -> np.ndarray:
    """Code point -> itself if a letter, else a blank."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = c
    return out


def codes(text: str) -> np.ndarray:
    """Letters and single blanks, with blanks before the first letter so that every letter has a full context."""
    c = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    blank = c == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    return np.concatenate([np.full(ORDER - 1, 32, np.uint32), c[keep]])


def hashes(c: np.ndarray, n: int) -> np.ndarray:
    """Of the n-gram that ends at each position from ORDER - 1 on."""
    c = c.astype(np.uint64)
    out = np.full(len(c) - ORDER + 1, np.uint64(n))
    for j in range(n):
        out += (c[ORDER - 1 - j : len(c) - j] + np.uint64(1)) * _P[j]
    out ^= out >> np.uint64(31)
    return out * np.uint64(0x94D049BB133111EB)


def contexts(c: np.ndarray, n: int) -> np.ndarray:
    """Of the n - 1 characters before each position from ORDER - 1 on."""
    return hashes(c[:-1], n - 1) if n > 1 and len(c) > ORDER else np.full(max(0, len(c) - ORDER + 1), np.uint64(0))


@dataclasses.dataclass
class Models:
    languages: list[str]
    grams: list[np.ndarray]  # by order, sorted hashes
    log_p: list[np.ndarray]  # rows as the grams, a column for each language
    contexts: list[np.ndarray]  # by order, sorted hashes of contexts
    log_backoff: list[np.ndarray]
    floor: np.ndarray  # log-probability of an unseen letter
    temperature: float = 1.0
    power: float = 1.0  # how much more the evidence of a longer text counts
    limits: np.ndarray | None = None

    def position_scores(self, c: np.ndarray) -> np.ndarray:
        """Natural log-probabilities of each position, a column for each language."""
        full = hashes(c, ORDER)
        at, hit = _find(self.grams[-1], full)
        out = self.log_p[-1][at]
        miss = np.flatnonzero(~hit)
        if len(miss):
            _, first, back = np.unique(full[miss], return_index=True, return_inverse=True)
            out[miss] = self._backed_off(c, miss[first])[back]
        return out

    def _backed_off(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of positions whose full n-gram is in no model."""
        total = np.zeros((len(at), len(self.languages)), np.float32)
        left = np.arange(len(at))
        windows = np.stack([c[at + j] for j in range(ORDER)], 1)  # the n-gram that ends at each position
        for n in range(ORDER, 0, -1):
            own = windows[left]
            h = _row_hash(own, n)
            i, hit = _find(self.grams[n - 1], h)
            total[left[hit]] += self.log_p[n - 1][i[hit]]
            left, own = left[~hit], own[~hit]
            if not len(left):
                return total
            k, known = _find(self.contexts[n - 1], _row_context(own, n))
            total[left[known]] += self.log_backoff[n - 1][k[known]]
        total[left] += self.floor
        return total

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per character (bits) under each language; the letters and blanks of each text."""
        out, size = np.full((len(texts), len(self.languages)), np.inf), np.zeros(len(texts), np.int64)
        part, total = [], 0
        for i, t in enumerate([*texts, None]):
            if t:
                c = codes(t)
                if (c != 32).any():
                    part.append((i, c))
                    total += len(c)
            if part and (total >= _SLICE or i == len(texts)):
                for j, c in part if len(part) == 1 else []:
                    sums = np.zeros(len(self.languages))
                    for a in range(0, len(c) - ORDER + 1, _SLICE):
                        sums += self.position_scores(c[a : a + _SLICE + ORDER - 1]).sum(0, dtype=np.float64)
                    size[j] = len(c) - ORDER + 1
                    out[j] = -sums / np.log(2) / size[j]
                if len(part) > 1:
                    scores = self.position_scores(np.concatenate([c for _, c in part]))
                    ends = np.cumsum([len(c) for _, c in part])
                    for (j, c), e in zip(part, ends.tolist()):
                        # positions between two texts have contexts of both and are left out
                        own = scores[e - len(c) : e - ORDER + 1]
                        size[j] = len(own)
                        out[j] = -own.sum(0, dtype=np.float64) / np.log(2) / size[j]
                part, total = [], 0
        return out, size

    def posterior(self, entropy: np.ndarray, size: np.ndarray) -> np.ndarray:
        logits = -(entropy - entropy.min(1, keepdims=True)) * (size**self.power)[:, None] * self.temperature
        p = np.exp(np.clip(logits, -60, 0))
        return p / p.sum(1, keepdims=True)


def _row_hash(rows: np.ndarray, n: int) -> np.ndarray:
    out = np.full(len(rows), np.uint64(n))
    for j in range(n):
        out += (rows[:, ORDER - 1 - j].astype(np.uint64) + np.uint64(1)) * _P[j]
    out ^= out >> np.uint64(31)
    return out * np.uint64(0x94D049BB133111EB)


def _row_context(rows: np.ndarray, n: int) -> np.ndarray:
    return _row_hash(np.concatenate([rows[:, :1], rows[:, :-1]], 1), n - 1) if n > 1 else np.zeros(len(rows), np.uint64)


def _find(known: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(known):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(known, wanted)
    at[at == len(known)] = 0
    return at, known[at] == wanted


def _kneser_ney(texts: list[str]) -> list[tuple]:
    """By order: n-gram rows (as characters), probability, contexts with back-off weight, as dictionaries by hash."""
    grams = np.concatenate([np.lib.stride_tricks.sliding_window_view(c, ORDER) for c in map(codes, texts) if len(c) >= ORDER] or [np.zeros((0, ORDER), np.uint32)])
    rows, counts = np.unique(grams, axis=0, return_counts=True)
    levels = []
    for n in range(ORDER, 0, -1):
        h, ctx = _row_hash(rows, n), _row_context(rows, n)
        groups, of = np.unique(ctx, return_inverse=True)
        n1, n2 = (counts == 1).sum(), (counts == 2).sum()
        d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
        total, kinds = np.bincount(of, counts, len(groups)), np.bincount(of, minlength=len(groups))
        levels.append((rows, h, (counts - d) / total[of], groups, d * kinds / total, of))
        # the next order counts the different characters that stand before an n-gram
        shorter = rows.copy()
        shorter[:, ORDER - n] = 0
        rows, counts = np.unique(shorter, axis=0, return_counts=True)
    return levels[::-1]


def learn(training: list[tuple[str, str]], calibration: list[tuple[str, str]]) -> Models | None:
    languages = sorted({lang for lang, t in training if any(map(str.isalpha, t))})
    if not languages:
        return None
    by_language = [_kneser_ney([t for lang, t in training if lang == x]) for x in languages]
    letters = len(np.unique(np.concatenate([lv[0][0][:, -1] for lv in by_language]))) + 1
    m = Models(languages, [], [], [], [], np.log(np.full(len(languages), 1 / letters)))
    for n in range(1, ORDER + 1):
        # the union of all languages' n-grams; a language that lacks one backs off
        rows = np.unique(np.concatenate([lv[n - 1][0] for lv in by_language]), axis=0)
        h = _row_hash(rows, n)
        order = np.argsort(h)
        h, rows = h[order], rows[order]
        ctx = np.unique(np.concatenate([lv[n - 1][3] for lv in by_language]))
        log_b = np.zeros((len(ctx), len(languages)), np.float32)
        p = np.zeros((len(h), len(languages)))
        for k, lv in enumerate(by_language):
            _, own_h, own_p, own_ctx, own_b, _ = lv[n - 1]
            log_b[np.searchsorted(ctx, own_ctx), k] = np.log(own_b)
            p[np.searchsorted(h, own_h), k] = own_p
        # contexts of these rows, and what the lower order says
        c_at, known = _find(ctx, _row_context(rows, n))
        weight = np.where(known[:, None], np.exp(log_b[c_at]), 1.0)
        if n == 1:
            lower = np.exp(m.floor)[None, :]
        else:
            shorter = rows.copy()
            shorter[:, ORDER - n] = 0
            at, hit = _find(m.grams[-1], _row_hash(shorter, n - 1))
            lower = np.exp(m.log_p[-1][at])
        m.grams.append(h)
        m.log_p.append(np.log(p + weight * lower).astype(np.float32))
        m.contexts.append(ctx)
        m.log_backoff.append(log_b)
    known = [(lang, t) for lang, t in calibration if lang in languages]
    entropy, size = m.entropies([t for _, t in known])
    ok = size > 0
    truth = np.array([languages.index(lang) for lang, _ in known], np.int64)[ok]
    entropy, size = entropy[ok], size[ok]
    m.limits = np.full(len(languages), np.inf)
    if len(truth):
        def loss(scale: tuple[float, float]) -> float:
            m.power, m.temperature = scale
            return -np.log(m.posterior(entropy, size)[np.arange(len(truth)), truth].clip(1e-12)).mean()

        m.power, m.temperature = min(((p, t) for p in (0.25, 0.5, 0.75, 1.0) for t in (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 1.0, 2.0, 5.0)), key=loss)
        for k in range(len(languages)):
            if (truth == k).any():
                m.limits[k] = np.quantile(entropy[truth == k, k], 0.995) + 0.25
    return m


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> Models | None:
    number = F.crc32(F.col(id_col).cast("string").cast("binary"))
    usable = docs.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & (number % FOLDS != HELD_OUT))
    rows = usable.select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"))
    # rows that can't be among those of their language go first, so no task gets many rows of one language
    share = rows.groupBy("lang").agg(F.least(F.lit(_HASHES), F.lit(2.0 * (rows_per_language + 50) * _HASHES) / F.count(F.lit(1))).alias("below"))
    rows = rows.join(F.broadcast(share), "lang").filter(hash_rank("i") < F.col("below")).select("i", "lang").distinct()
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(hash_rank("i"), "i"))
    chosen = rows.withColumn("r", rank).filter(F.col("r") <= rows_per_language)
    texts = usable.select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("t"))
    got = one_text(texts.join(F.broadcast(chosen), ["i", "lang"]), ["i", "lang", "r"], "t").collect()
    got = sorted(got, key=lambda r: (r.lang, r.r, r.t))
    return learn([(r.lang, r.t) for r in got if r.r % 2 == 1], [(r.lang, r.t) for r in got if r.r % 2 == 0])


def language(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", model: Models | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, bits_per_char, rejected; one row per row of docs."""
    shared = spark.sparkContext.broadcast(model or train(docs, id_col, text_col, lang_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        m = shared.value
        for batch in slices(batches):
            n, ids = batch.num_rows, batch.column(0)
            held = [i is not None and crc32(str(i).encode()) % FOLDS == HELD_OUT for i in ids.to_pylist()]
            pred, score, bits, rejected = [UND] * n, np.zeros(n), [None] * n, np.ones(n, bool)
            if m is not None and n:
                entropy, size = m.entropies(batch.column(1).to_pylist())
                some = np.flatnonzero(size)
                if len(some):
                    p, best = m.posterior(entropy[some], size[some]), entropy[some].argmin(1)
                    for i, k, q in zip(some.tolist(), best.tolist(), p):
                        pred[i], score[i], bits[i] = m.languages[k], q[k], float(entropy[i, k])
                        rejected[i] = bits[i] > m.limits[k]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(held), pa.array(pred, pa.string()), pa.array(score), pa.array(bits, pa.float64()), pa.array(rejected)],
                ["doc_id", "held_out", "lang_pred", "score", "bits_per_char", "rejected"],
            )

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double, bits_per_char double, rejected boolean")
