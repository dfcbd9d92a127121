"""Toxicity: expected severity from a cumulative-link ordinal regression.

Features are the words of a text and their beginnings of three to five letters, each counted once. The labels say
only toxic or not, so the grades are made in two steps: a two-grade model is fitted on each half of the sample and
rates the toxic texts of the other half; those above the median are grade 2 (severe), the other toxic ones grade 1,
clean ones 0. The three-grade model has one weight vector and two ordered thresholds, and gives the expected severity
(0 to 2). A text is rejected if P(grade >= 1) is at least one half.

Defined cases: null and empty texts have no features, and get the severity of the thresholds alone. A label that is
null, or whose document is missing, is not used; without usable labels nothing is rejected. Several labels of one
document count by the highest; of several rows with a labelled id one text is learned from. Repeated rows are rated
alike, an empty table gives an empty result, a text of any length is read whole, other columns are not read.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitta.llm.common import id_text, one_text, slices
from remitta.llm.ordinal import SAMPLE_ROWS, CumulativeLink, Sparse, fit, sample, split_grades

GRADES = 3
_WORD = re.compile(r"[^\W\d_]+")
_KEPT_WORDS = 200_000


def word_features(word: str) -> list[int]:
    b = word.encode()
    return [crc32(b), *(crc32(b"%d" % n + word[:n].encode()) for n in (3, 4, 5) if len(word) >= n)]


def features(text: str) -> dict[int, float]:
    return {f: 1.0 for w in set(_WORD.findall(text.lower())) for f in word_features(w)}


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> CumulativeLink:
    rated = labels.filter(F.col(label_col).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label_col).cast("int").alias("grade"))
    chosen = F.broadcast(sample(rated, "doc_id", sample_rows))
    joined = one_text(id_text(docs, id_col, text_col).join(chosen, "doc_id"), ["doc_id", "grade"])

    def run(batches):
        for batch in slices(batches):
            packed = [np.sort(np.fromiter(features(t), np.uint32)).tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(packed, pa.binary())], ["doc_id", "grade", "f"])

    got = joined.mapInArrow(run, f"doc_id {dict(joined.dtypes)['doc_id']}, grade int, f binary").toArrow().sort_by([("doc_id", "ascending"), ("grade", "ascending")])
    x, toxic = Sparse.joined(got["f"].to_pylist()), np.array(got["grade"].to_pylist(), np.int64) > 0
    return fit(x, split_grades(x, toxic, got["doc_id"].to_pylist()), GRADES)


class Scorer:
    def __init__(self, model: CumulativeLink):
        self.model, self.weights, self.words = model, dict(zip(model.features.tolist(), model.weights.tolist())), {}

    def __call__(self, texts: list[str]) -> np.ndarray:
        out = np.zeros(len(texts))
        for i, text in enumerate(texts):
            found: set[int] = set()
            for w in set(_WORD.findall(text.lower())):
                f = self.words.get(w, 0)
                if f == 0:
                    if len(self.words) >= _KEPT_WORDS:
                        self.words.clear()
                    f = self.words[w] = [x for x in word_features(w) if x in self.weights] or None
                if f:
                    found.update(f)
            out[i] = sum(self.weights[f] for f in found)
        return out


def toxicity(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: CumulativeLink | None = None) -> DataFrame:
    """doc_id, expected_severity, p_toxic, p_severe, grade (most likely), rejected; one row per row of docs."""
    shared = spark.sparkContext.broadcast(model or train(docs, labels, id_col, text_col))
    rows = id_text(docs, id_col, text_col)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            tail = scorer.model.tail(scorer(batch.column(1).to_pylist()))
            each = -np.diff(np.c_[np.ones(len(tail)), tail, np.zeros(len(tail))], axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(tail.sum(1)), pa.array(tail[:, 0]), pa.array(tail[:, 1]), pa.array(each.argmax(1)), pa.array(tail[:, 0] >= 0.5)],
                ["doc_id", "expected_severity", "p_toxic", "p_severe", "grade", "rejected"],
            )

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, expected_severity double, p_toxic double, p_severe double, grade bigint, rejected boolean")


def keep_clean(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, that are not rejected; nothing is shuffled."""
    shared = spark.sparkContext.broadcast(train(docs, labels, id_col, text_col))
    at = docs.columns.index(text_col)

    def run(batches):
        scorer = Scorer(shared.value)
        for batch in slices(batches):
            p = scorer.model.tail(scorer([t or "" for t in batch.column(at).to_pylist()]))[:, 0]
            yield batch.filter(pa.array(p < 0.5))

    return docs.mapInArrow(run, docs.schema)
