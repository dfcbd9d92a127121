"""Cumulative-link ordinal regression on sparse hashed features.

P(y <= k) = sigmoid(theta_k - w.x) with one weight vector for all grades and ordered thresholds theta. Fitted in numpy
on a bounded sample of rated rows (by their hash, so the same rows at every run), with an L1 term that leaves most
weights zero. What goes to the executors is the list of non-zero weights and the thresholds.
"""

from __future__ import annotations

import dataclasses
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame

from remitta.llm.common import hashed_sample

#: Most rated rows that a fit uses.
SAMPLE_ROWS = 6000
#: Most features that a fit uses: those that tell grades apart best, each in at least MIN_ROWS rows.
MAX_FEATURES, MIN_ROWS = 4096, 4


@dataclasses.dataclass
class Sparse:
    """Rows of features (hashes of 32 bits) with values; no values: all are one."""

    ends: np.ndarray  # int64, where each row ends
    features: np.ndarray  # uint32
    values: np.ndarray | None = None  # float32

    @staticmethod
    def of(rows: list[dict[int, float]]) -> Sparse:
        names = np.fromiter((f for r in rows for f in r), np.uint32)
        return Sparse(np.cumsum([len(r) for r in rows], dtype=np.int64), names, np.fromiter((v for r in rows for v in r.values()), np.float32))

    @staticmethod
    def joined(features: list[bytes], values: list[bytes] | None = None) -> Sparse:
        """Of rows packed as bytes."""
        ends = np.cumsum([len(f) // 4 for f in features], dtype=np.int64)
        return Sparse(ends, np.frombuffer(b"".join(features), np.uint32), None if values is None else np.frombuffer(b"".join(values), np.float32))

    def __len__(self) -> int:
        return len(self.ends)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self), dtype=np.int32), np.diff(self.ends, prepend=0))

    def take(self, chosen: np.ndarray) -> Sparse:
        sizes = np.diff(self.ends, prepend=0)
        use = np.repeat(chosen, sizes)
        return Sparse(np.cumsum(sizes[chosen]), self.features[use], None if self.values is None else self.values[use])


@dataclasses.dataclass(frozen=True)
class CumulativeLink:
    features: np.ndarray  # hashes of the features, sorted
    weights: np.ndarray
    thresholds: np.ndarray

    def tail(self, score: np.ndarray) -> np.ndarray:
        """P(y >= 1), P(y >= 2), ... for each score."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - np.asarray(score)[:, None], -40, 40)))

    def expected(self, score: np.ndarray) -> np.ndarray:
        return self.tail(score).sum(1)

    def score_rows(self, x: Sparse) -> np.ndarray:
        if not len(self.features):
            return np.zeros(len(x))
        col, at, value = _within(x, self.features)
        return np.bincount(at, self.weights[col] * value, len(x))


def sample(rated: DataFrame, id_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """At most so many rows, the same ones each time, from all parts of the table."""
    return hashed_sample(rated, id_col, rows)


def _within(x: Sparse, names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Column, row and value of the entries whose feature is one of the (sorted) names."""
    col = np.searchsorted(names, x.features).astype(np.int32)
    col[col == len(names)] = 0
    hit = names[col] == x.features
    return col[hit], x.rows()[hit], np.ones(int(hit.sum()), np.float32) if x.values is None else x.values[hit]


def likelihood(score: np.ndarray, theta: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the grades, and its derivatives by each score and by each threshold."""
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -35, 35)))
    n = len(y)
    hi, lo = sig(np.r_[theta, np.inf][y] - score), sig(np.r_[-np.inf, theta][y] - score)
    hi[y == len(theta)], lo[y == 0] = 1.0, 0.0
    p = np.maximum(hi - lo, 1e-9)
    g_hi, g_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
    g_theta = (np.bincount(y, -g_hi, len(theta) + 1)[:-1] + np.bincount(y, g_lo, len(theta) + 1)[1:]) / n
    return float(-np.log(p).mean()), (g_hi - g_lo) / n, g_theta


def split_grades(x: Sparse, yes: np.ndarray, ids: list) -> np.ndarray:
    """Three grades from ratings that say only yes or no: a two-grade model fitted on each half of the rows rates the others; the yes above the median are grade 2, the other yes 1, no 0."""
    half = np.array([crc32(str(i).encode()) % 2 for i in ids], np.int64)
    rating = np.zeros(len(x))
    for h in (0, 1):
        rating[half == h] = fit(x.take(half != h), yes[half != h], 2).score_rows(x.take(half == h))
    middle = np.median(rating[yes]) if yes.any() else 0.0
    return yes.astype(int) + (yes & (rating > middle))


def fit(x: Sparse, grades, n_grades: int, l1: float = 2e-4, steps: int = 400, rate: float = 0.1) -> CumulativeLink:
    """x: the features of each rated text. With one grade only no feature has a weight; with no rows everything is of grade 0."""
    y = np.asarray(grades, np.int64)
    n = len(y)
    share = np.array([(y > k).mean() if n else 0.0 for k in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    theta = -np.log(share / (1 - share))
    for k in range(1, len(theta)):
        theta[k] = max(theta[k], theta[k - 1] + 1e-3)
    names, df = np.unique(x.features, return_counts=True)
    often = df >= min(MIN_ROWS, max(1, n // 50))
    names, df = names[often], df[often]
    if not len(names) or len(np.unique(y)) < 2:
        return CumulativeLink(np.zeros(0, np.uint32), np.zeros(0), theta)
    col, at, value = _within(x, names)
    apart = np.bincount(col, (y - y.mean())[at], len(names)) ** 2 / (df * y.var())
    chosen = np.sort(np.argsort(-apart, kind="stable")[:MAX_FEATURES])
    col, at, value = _within(x, names[chosen])
    m = len(chosen)
    w, step = np.zeros(m), 0
    mom, var = np.zeros(m + len(theta)), np.zeros(m + len(theta))
    gap = np.log(np.diff(theta)) if len(theta) > 1 else np.zeros(0)
    first = theta[0]
    for step in range(1, steps + 1):
        theta = first + np.r_[0, np.cumsum(np.exp(gap))]
        s = np.bincount(at, w[col] * value, n)
        _, g_score, g_theta = likelihood(s, theta, y)
        g_w = np.bincount(col, g_score[at] * value, m)
        g_first = g_theta.sum()
        g_gap = np.array([g_theta[k + 1 :].sum() * np.exp(gap[k]) for k in range(len(gap))])
        g = np.r_[g_w, g_first, g_gap]
        mom, var = 0.9 * mom + 0.1 * g, 0.99 * var + 0.01 * g * g
        pace = rate * min(1.0, 3 * (1 - step / (steps + 1)))
        move = pace * (mom / (1 - 0.9**step)) / (np.sqrt(var / (1 - 0.99**step)) + 1e-6)
        w -= move[:m]
        first -= move[m]
        gap -= move[m + 1 :]
        w = np.sign(w) * np.maximum(np.abs(w) - pace * l1 / (np.sqrt(var[:m] / (1 - 0.99**step)) + 1e-4), 0)
    some = np.abs(w) > 1e-3
    return CumulativeLink(names[chosen][some], w[some], first + np.r_[0, np.cumsum(np.exp(gap))])
