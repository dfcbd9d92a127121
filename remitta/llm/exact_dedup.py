"""Exact deduplication as a stateful stream.

Each arriving document is written once to a content store in the shared folder: its normalised text, digest, stable id
and length. Its locator is its place there, the number of the feed and of the row, so it names one row for ever. A
streaming aggregation reads the store's small columns and keeps, for every digest, the locator of the first document,
the id and locator of the one that stays, and the size of the group, in RocksDB and without expiry. Partial aggregation
in each task makes a group of any size one row before the shuffle. Digests seen more than once are hits: in the stream's
batch the full bytes of the new documents, and of the documents that the state's locators name, are compared. Digests
whose texts differ are noted beside the state, and their documents are grouped by the text itself.

What is compared is picked by a bitmap of the hits (at most 2 ** BITS bits, whatever the input), which may let some
others through but leaves no hit out; each task folds equal texts before the shuffle. One plan serves all sizes. A later
call with the same folder goes on where the last one ended; if the documents have outgrown the number of state stores,
which a stream can't change, the stream begins anew with more, from the content store.

Defined cases: null text counts as empty, and all empty texts are equal. Among equal texts the row with the most
code points in the original stays, then the smallest id (null ids come last), then the row written first: one row of
each group, also where rows repeat an id, or an id and a text. An empty table gives an empty result. Other columns of
the input are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from remitta.llm.common import scratch

#: Deleted before texts are compared.
BLANKS = r"[\x20\x09-\x0D]+"
#: Bits of the bitmap that picks what is compared: 2 MB at most.
BITS = 24
#: A group with more than one in so many rows is joined apart; there are at most so many of them.
HOT_GROUPS = 10_000
#: Arrivals for each state store; a stream with less than a quarter of the stores it needs begins anew.
STORE_ROWS = 25_000

_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    # Many small stores: without this each one reserves several MB on disk for its logs.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, BLANKS, "")


def _bit(key: Column) -> Column:
    return F.xxhash64(key).bitwiseAND(F.lit((1 << BITS) - 1))


def marked(rows: DataFrame, column: str, keys: DataFrame) -> DataFrame:
    """The rows whose value is in `keys` (one column), and a few others: what goes to the executors is a bitmap of bounded size."""
    maps = keys.select(_bit(F.col(keys.columns[0])).alias("__v")).groupBy(F.shiftright("__v", 15).alias("__bucket")).agg(F.bitmap_construct_agg(F.col("__v").bitwiseAND(F.lit(32767))).alias("__map"))
    rows = rows.withColumn("__v", _bit(F.col(column)))
    byte = F.expr("cast(conv(hex(substring(__map, cast((__v & 32767) div 8 as int) + 1, 1)), 16, 10) as bigint)")
    found = rows.join(F.broadcast(maps), F.shiftright("__v", 15) == F.col("__bucket")).filter(F.getbit(byte, (F.col("__v") % 8).cast("int")) == 1)
    return found.select(*[c for c in rows.columns if c != "__v"])


class StreamingDedup:
    """Keyed state on disk; feed() adds documents to it and decides on them. A folder that was used before is gone on with."""

    def __init__(self, spark: SparkSession, folder: str | None = None, digest: Callable[[Column], Column] | None = None, store_rows: int = STORE_ROWS):
        self.spark, self.folder, self.store_rows = spark, folder or scratch(spark, "dedup"), store_rows
        self._digest = digest
        self.key = (lambda n: digest(n).cast("binary")) if digest else (lambda n: F.unhex(F.sha2(n, 256)))

    def _numbers(self, name: str, prefix: str) -> list[int]:
        """Numbers of the folders `prefix`n in a folder."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)
        fs = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        return sorted(int(n[len(prefix) :]) for s in fs.listStatus(path) if (n := s.getPath().getName()).startswith(prefix))

    def _content(self, kind: str) -> DataFrame:
        return self.spark.read.schema(f"digest binary, norm string, n_cp int, doc_id {kind}, row bigint, feed int").parquet(f"{self.folder}/content")

    def feed(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, keep_id, group_size, kept, text_sha256, locator of the kept row; one row per row of docs. Groups are those of all feeds so far."""
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        rows = docs.select(F.col(id_col).alias("doc_id"), normalised(text).alias("norm"), F.char_length(text).alias("n_cp"))
        kind = dict(rows.dtypes)["doc_id"]
        number = max(self._numbers("content", "feed="), default=-1) + 1
        rows = rows.select(self.key(F.col("norm")).alias("digest"), "norm", "n_cp", "doc_id", F.monotonically_increasing_id().alias("row"))
        rows.write.option("compression", "zstd").parquet(f"{self.folder}/content/feed={number}")
        content = self._content(kind)
        total = content.count()
        groups = self._stream(kind, total, number)
        mine = content.filter(F.col("feed") == number)
        bad = self.spark.read.schema("digest binary").parquet(f"{self.folder}/clashes").select("digest").distinct()
        clash = not bad.isEmpty()
        sha = F.lower(F.hex("digest")) if self._digest is None else F.sha2("norm", 256)
        light = mine.select("digest", "doc_id", "row", sha.alias("text_sha256"))
        rest = groups
        if clash:
            light, rest = light.join(bad, "digest", "left_anti"), groups.join(bad, "digest", "left_anti")
        # groups with many rows are few, by their size: their rows need not meet in one task
        many = F.col("group_size") > max(1000, total // HOT_GROUPS)
        hot = F.broadcast(rest.filter(many))
        found = light.join(hot, "digest").unionByName(light.join(hot.select("digest"), "digest", "left_anti").join(rest.filter(~many), "digest"))
        if clash:
            again = content.join(bad, "digest", "left_semi")
            exact = again.groupBy("norm").agg(_first().alias("first"), F.count(F.lit(1)).alias("group_size"))
            exact = exact.select("norm", F.col("first.doc_id").alias("keep_id"), F.col("first.feed").alias("keep_feed"), F.col("first.row").alias("keep_row"), "group_size")
            again = again.filter(F.col("feed") == number).select("doc_id", "row", "norm", F.sha2("norm", 256).alias("text_sha256"))
            found = found.select("doc_id", "row", "text_sha256", "keep_id", "keep_feed", "keep_row", "group_size").unionByName(again.join(exact, "norm").drop("norm"))
        kept = (F.col("keep_feed") == number) & (F.col("keep_row") == F.col("row"))
        return found.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256", F.concat_ws(":", "keep_feed", "keep_row").alias("locator"))

    def _stream(self, kind: str, total: int, number: int) -> DataFrame:
        """What the state holds of every digest that the new arrivals touched."""
        arrivals = self.spark.readStream.schema(f"digest binary, n_cp int, doc_id {kind}, row bigint, feed int").parquet(f"{self.folder}/content")
        seen = arrivals.groupBy("digest").agg(_first().alias("first"), F.min(F.struct("feed", "row")).alias("anchor"), F.count(F.lit(1)).alias("group_size"))
        seen = seen.select("digest", F.col("first.doc_id").alias("keep_id"), F.col("first.feed").alias("keep_feed"), F.col("first.row").alias("keep_row"), "anchor", "group_size")
        out, parts = scratch(self.spark, "dedup-groups"), []
        unchecked = max(self._numbers("clashes", "feed="), default=-1) + 1

        def take(batch: DataFrame, batch_number: int) -> None:
            path = f"{out}/batch={batch_number}"
            batch.write.mode("overwrite").parquet(path)
            parts.append(batch_number)
            groups = self.spark.read.schema(seen.schema).parquet(path)
            self._differing(self._content(kind), groups, unchecked).write.mode("overwrite").parquet(f"{self.folder}/clashes/feed={number}")

        wanted = max(1, min(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-total // self.store_rows)))
        have = max(self._numbers("", "state-"), default=0)
        stores = have if 4 * have > wanted else wanted
        conf = _STATE | {"spark.sql.shuffle.partitions": str(stores)}
        old = {k: self.spark.conf.get(k, None) for k in conf}
        for k, v in conf.items():
            self.spark.conf.set(k, v)
        try:
            query = seen.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", f"{self.folder}/state-{stores}").trigger(availableNow=True).start()
            query.awaitTermination()
        finally:
            for k, v in old.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        if not parts:
            self.spark.createDataFrame([], "digest binary").write.mode("overwrite").parquet(f"{self.folder}/clashes/feed={number}")
            return self.spark.createDataFrame([], seen.schema)
        groups = self.spark.read.schema(seen.schema).parquet(*[f"{out}/batch={n}" for n in parts])
        if len(parts) > 1:  # after a failure the last batch is taken in again
            whole = self.spark.read.schema(f"{_ddl(seen)}, batch int").option("basePath", out).parquet(*[f"{out}/batch={n}" for n in parts])
            columns = [c for c in seen.columns if c != "digest"]
            groups = whole.groupBy("digest").agg(F.max_by(F.struct(*columns), "batch").alias("last")).select("digest", "last.*")
        return groups

    @staticmethod
    def _differing(content: DataFrame, groups: DataFrame, unchecked: int) -> DataFrame:
        """Digests of hits under which the bytes of a new document differ from those of another, or of the one that the state's locator names."""
        hits = groups.filter("group_size > 1")
        texts = marked(content.filter(F.col("feed") >= unchecked).select("digest", "norm"), "digest", hits.select("digest"))
        if unchecked:
            named = hits.filter(F.col("anchor.feed") < unchecked).select("anchor")
            before = content.filter(F.col("feed") < unchecked).select("digest", "norm", F.struct("feed", "row").alias("anchor"))
            texts = texts.unionByName(marked(before, "anchor", named).join(named, "anchor", "left_semi").select("digest", "norm"))
        return texts.groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).filter(F.col("a") != F.col("b")).select("digest")


def _first() -> Column:
    """The row that stays."""
    return F.min(F.struct((-F.col("n_cp")).alias("shorter"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("feed"), F.col("row")))


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{n} {t}" for n, t in df.dtypes)


def exact_dedup(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[Column], Column] | None = None, folder: str | None = None) -> DataFrame:
    """One feed of a stream of its own, or of the one whose state is in `folder`."""
    return StreamingDedup(spark, folder, digest).feed(docs, id_col, text_col)
