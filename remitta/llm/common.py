"""What the corpus operators share: tables, the shared folder, samples, filters and joins."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remitta.sources.shared import saved, scratch, shared_dir  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bitmaps of dropped rows that are sent to every executor: 64 MB.
BROADCAST_MAPS = 16_384

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Two columns, `doc_id` and `text`, whatever else the table has; null text becomes empty."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


_HASHES = 1 << 40


def hash_rank(id_col: str) -> Column:
    return F.pmod(F.xxhash64(F.col(id_col)), F.lit(_HASHES))


def hashed_sample(rows: DataFrame, id_col: str, n: int) -> DataFrame:
    """The n rows whose ids hash least: the same rows each time, from all parts of the table.

    Rows that can't be among them go before the sort, so a task hands on a few rows only, however many tasks there are.
    """
    total = rows.count()
    if total > 4 * n:
        rows = rows.filter(hash_rank(id_col) < min(_HASHES, 2 * (n + 50) * _HASHES // total))
    return rows.orderBy(hash_rank(id_col), id_col).limit(n)


def one_text(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys, text: of the rows that repeat the keys one, the same each time. Each task folds them before the shuffle, so a key on many rows brings one text."""
    first = F.min(F.struct(F.xxhash64(text).alias("h"), F.col(text).alias("t")))
    return rows.groupBy(*keys).agg(first.alias("first")).select(*keys, F.col("first.t").alias(text))


#: A key with more than one in so many rows is joined apart; there are at most so many of them.
HOT_KEYS = 10_000


def spread_join(rows: DataFrame, unique: DataFrame, key: str) -> DataFrame:
    """Inner join with a table that has each key once. Keys with many rows are few, so what they match goes to every executor, and no task gets all rows of one."""
    sizes = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    hot = F.broadcast(saved(sizes.filter(F.col("__n") > max(1000, rows.count() // HOT_KEYS)).select(key), "hot-keys"))
    at_once = rows.join(F.broadcast(unique.join(hot, key, "left_semi")), key)
    return at_once.unionByName(rows.join(hot, key, "left_anti").join(unique, key))


def without_rows(docs: DataFrame, dropped: DataFrame, number: str) -> DataFrame:
    """Rows whose number (from monotonically_increasing_id) is not in `dropped` (one column).

    A bitmap tells them: 4 KB for each 32 768 numbers that hold any. Up to BROADCAST_MAPS of them go to every executor, so
    the texts stay where they are; more are joined by the numbers' upper bits.
    """
    maps = dropped.select(F.col(number).alias("__n")).groupBy(F.shiftright("__n", 15).alias("__of")).agg(F.bitmap_construct_agg(F.col("__n").bitwiseAND(F.lit(32767))).alias("__map"))
    maps = saved(maps, "dropped")
    if maps.count() <= BROADCAST_MAPS:
        maps = F.broadcast(maps)
    byte = F.expr("cast(conv(hex(substring(__map, cast((n & 32767) div 8 as int) + 1, 1)), 16, 10) as bigint)")
    is_dropped = F.coalesce(F.getbit(byte, (F.col("n") % 8).cast("int")) == 1, F.lit(False))
    rows = docs.select(F.col(number).alias("n"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r"))  # names of its columns can't clash with ours
    return rows.join(maps, F.shiftright("n", 15) == F.col("__of"), "left").filter(~is_dropped).select("r.*")


def binary_texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """The UTF-8 bytes of a text column, without decoding them."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what Python holds of a batch stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def release() -> None:
    """Gives memory back that a task has freed: Python workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
