"""A pipeline over `documents`: each stage's result is written as Parquet and read again by the next.

toxicity: documents that it rejects go. exact_dedup: one document of each group of equal texts stays. near_dedup: one
document of each SimHash group stays, the one with the smallest id. decontamination: documents that hold benchmark
windows go. bpe: the remaining documents are encoded and decoded.

Rows are decided on and dropped one by one, by a number that each has in its stage: ids may be null or stand on several
rows. Null ids come after all others. Other columns of the documents stay as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from remitta.llm import bpe as tokens
from remitta.llm import exact_dedup as exact
from remitta.llm import simhash, toxicity, winnowing
from remitta.llm.common import saved, table, without_rows


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.keep_clean(spark, docs, table(spark, sf_dir, "labels"))


def _free(docs: DataFrame, name: str) -> str:
    """A name that no column has."""
    while name.lower() in (c.lower() for c in docs.columns):
        name += "_"
    return name


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs with a number for each row, written once so it stays; and key and text alone, the key ordering rows by id, then number."""
    number = _free(docs, "__row")
    rows = saved(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    return rows, rows.select(F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col(number).alias("row")).alias("doc_id"), "text")


def _without(rows: DataFrame, decided: DataFrame) -> DataFrame:
    """The numbered rows but for those whose key is the doc_id of `decided`."""
    number = rows.columns[-1]
    return without_rows(rows, decided.select(F.col("doc_id.row").alias(number)), number).drop(number)


def exact_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, keyed = _numbered(docs)
    return _without(rows, exact.exact_dedup(spark, keyed).filter(~F.col("kept")))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, keyed = _numbered(docs)
    return _without(rows, simhash.simhash_groups(spark, keyed).filter(~F.col("doc_id").eqNullSafe(F.col("component_id"))))


def contaminated_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows, keyed = _numbered(docs)
    return _without(rows, winnowing.decontaminate(spark, keyed, table(spark, sf_dir, "benchmark")).filter("contaminated"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return tokens.bpe(spark, docs)


STAGES = [
    ("toxicity", toxic_out),
    ("exact_dedup", exact_copies_out),
    ("simhash_near_dedup", near_copies_out),
    ("decontamination", contaminated_out),
    ("bpe", encoded),
]

#: The classifier, XXH64 and BPE have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
