"""Quality: expected grade and tail probabilities from a cumulative-link ordinal regression on hashed text.

Grades are of quality alone: 0 if it is rated 0; texts rated 1 are grade 2 if a model fitted on the other half of the
ratings rates them above the median of their kind, else 1. Features, hashed: the shapes of the tokens (letters as a or A, digits as 0, runs cut to two) and how
often a token repeats the one before it, each by the square root of its share of the tokens; and the words with
their beginnings, each counted once. One weight vector serves both thresholds. A text is selected if
P(grade >= `least`) is at least `confidence`.

Defined cases: null and empty texts have no features and get the probabilities of the thresholds alone; null ratings
and ratings without a document are not used, and without any usable rating nothing is selected; of several ratings of
one document the lowest counts, of several rows with a rated id one text is learned from. Repeated rows are rated alike,
an empty table gives an empty result, a text of any length is read whole, other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitta.llm.common import id_text, one_text, slices
from remitta.llm.ordinal import SAMPLE_ROWS, CumulativeLink, Sparse, fit, sample, split_grades
from remitta.llm.toxicity import _WORD, Scorer, word_features

GRADES = 3
_RUN = re.compile(r"(.)\1+")
_REPEAT = crc32(b"shape repeat")
_KEPT = 200_000


def shape(token: str) -> int:
    s = "".join("0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in token)
    return crc32(b"shape " + _RUN.sub(r"\1\1", s).encode("utf-8", "replace"))


class Shapes:
    def __init__(self):
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> dict[int, float]:
        tokens = text.split()
        if not tokens:
            return {}
        if len(self.known) >= _KEPT:
            self.known.clear()
        out: Counter[int] = Counter()
        for t, n in Counter(tokens).items():
            h = self.known.get(t)
            if h is None:
                h = self.known[t] = shape(t)
            out[h] += n
        if same := sum(map(eq, tokens, tokens[1:])):
            out[_REPEAT] = same
        return {h: (n / len(tokens)) ** 0.5 for h, n in out.items()}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> CumulativeLink:
    rated = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).cast("int").alias("grade"))
    chosen = F.broadcast(sample(rated, "doc_id", sample_rows))
    joined = one_text(id_text(docs, id_col, text_col).join(chosen, "doc_id"), ["doc_id", "grade"])

    def run(batches):
        shapes = Shapes()
        for batch in slices(batches):
            keys, values = [], []
            for text in batch.column(2).to_pylist():
                f = shapes(text)
                f.update((x, 1.0) for w in set(_WORD.findall(text.lower())) for x in word_features(w))
                order = sorted(f)
                keys.append(np.array(order, np.uint32).tobytes())
                values.append(np.array([f[k] for k in order], np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(keys, pa.binary()), pa.array(values, pa.binary())], ["doc_id", "grade", "f", "v"])

    got = joined.mapInArrow(run, f"doc_id {dict(joined.dtypes)['doc_id']}, grade int, f binary, v binary").toArrow().sort_by([("doc_id", "ascending"), ("grade", "ascending")])
    x = Sparse.joined(got["f"].to_pylist(), got["v"].to_pylist())
    return fit(x, split_grades(x, np.array(got["grade"].to_pylist(), np.int64) > 0, got["doc_id"].to_pylist()), GRADES)


def quality(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 1, confidence: float = 0.5, model: CumulativeLink | None = None) -> DataFrame:
    """doc_id, expected_grade, p_grade_1, p_grade_2 (of at least that grade), grade (most likely), selected; one row per row of docs."""
    shared = spark.sparkContext.broadcast(model or train(docs, labels, id_col, text_col))
    rows = id_text(docs, id_col, text_col)

    def run(batches):
        m = shared.value
        words, shapes, weights = Scorer(m), Shapes(), dict(zip(m.features.tolist(), m.weights.tolist()))
        for batch in slices(batches):
            texts = batch.column(1).to_pylist()
            score = words(texts) + np.array([sum(weights[f] * v for f, v in shapes(t).items() if f in weights) for t in texts])
            tail = m.tail(score)
            each = -np.diff(np.c_[np.ones(len(tail)), tail, np.zeros(len(tail))], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tail.sum(1)), pa.array(tail[:, 0]), pa.array(tail[:, 1]), pa.array(each.argmax(1)), pa.array(tail[:, least - 1] >= confidence)],
                ["doc_id", "expected_grade", "p_grade_1", "p_grade_2", "grade", "selected"],
            )

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, expected_grade double, p_grade_1 double, p_grade_2 double, grade bigint, selected boolean")
