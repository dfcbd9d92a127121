"""Files that arrive: each is one message. Parsing a file needs no other file, so the stream has no state but its list of
files seen; findings decide what is passed on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from remitta.sources.remittance import DIAGNOSTICS, Options, parse_files, parse_tables
from remitta.sources.shared import scratch


def arriving(spark: SparkSession, folder: str, pattern: str = "*.835", max_files: int | None = None) -> DataFrame:
    """filename, content of files as they appear."""
    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("pathGlobFilter", pattern)
    if max_files:
        stream = stream.option("maxFilesPerTrigger", max_files)
    return stream.load(folder).select(F.col("path").alias("filename"), "content")


def stream_table(spark: SparkSession, folder: str, table: str | None = None, pattern: str = "*.835", max_files: int | None = None, **options) -> DataFrame:
    """A table of the arriving files as a stream."""
    return parse_files(arriving(spark, folder, pattern, max_files), Options(table, **({"ignore_errors": True} | options)))


def intake(spark: SparkSession, folder: str, out: str, checkpoint: str, tables: list[str] | None = None, worst_level: int = 1, pattern: str = "*.835", max_files: int | None = None, on_batch: Callable[[DataFrame, int], None] | None = None, **options) -> StreamingQuery:
    """Writes the tables of good files to `out`/<table>, and the findings of all to `out`/diagnostics.

    A file is held back, and its name written to `out`/rejected, if it has a finding of a level up to `worst_level` (1:
    the envelope; 3: amounts too). Each batch is read and parsed once, into the shared folder, from which its tables are
    written; a batch that is run again replaces what it wrote.
    """
    shape = Options(None, **options).shape
    names = tables or shape.table_names

    def batch(files: DataFrame, number: int) -> None:
        path = scratch(spark, "intake")
        every = parse_tables(files, [*names, DIAGNOSTICS], worst_level, **({"ignore_errors": True} | options))
        every.write.partitionBy("table").parquet(path)  # the files are read and parsed once
        kept = spark.read.schema(every.schema).parquet(path)
        of = lambda name: kept.filter(F.col("table") == name)
        rejected = of("rejected").select("filename")
        for name in [*names, DIAGNOSTICS]:
            of(name).select(F.col(name).alias("row_of"), "filename").select("row_of.*", "filename").write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        rejected.write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")
        if on_batch:
            on_batch(files.join(rejected, "filename", "left_anti"), number)

    return arriving(spark, folder, pattern, max_files).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
