"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Words of a text: runs of characters other than space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"
#: The separators between such words.
GAP = r"[\x20\x09-\x0D]+"

_LOCAL: list[str] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share.

    The folder is spark.checkpoint.dir. Only where that is unset (tests, local
    mode) a temporary folder of this machine takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _LOCAL:
            _LOCAL.append(f"file://{tempfile.mkdtemp(prefix='tonespark-')}")
        base = _LOCAL[0]
    return f"{base.rstrip('/')}/tonespark-{name}-{uuid.uuid4().hex}"


#: Files of a narrow table for each core, at most.
FILES = 4


def stored(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: a cut of the lineage that outlives executors.

    few: a narrow table, of which a task takes several partitions so that it has no
    more files than FILES a core. Not for tables whose rows hold their task's number.
    """
    return _written(df, shared_dir(df.sparkSession, name), few)


def _written(df: DataFrame, path: str, few: bool) -> DataFrame:
    (df.coalesce(FILES * max(1, df.sparkSession.sparkContext.defaultParallelism)) if few else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store that Spark can write."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


class Scratch:
    """Tables that one run of an operator reads again and again; they are deleted when the block ends, so its result is stored elsewhere."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.dir, self.n = spark, shared_dir(spark, name), 0

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        delete(self.spark, self.dir)

    def store(self, df: DataFrame, name: str, few: bool = False) -> DataFrame:
        self.n += 1
        return _written(df, f"{self.dir}/{self.n}-{name}", few)


@contextmanager
def small_batches(spark: SparkSession, rows: int = 512):
    """Within the block, bound what one Arrow batch of whole texts can hold; a smaller setting of the caller stays, and afterwards the caller's own holds again."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def release() -> None:
    """Give back what a worker's task has freed, so that idle workers stay small beside the next stage's."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of df has (case is ignored)."""
    have, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def text_keys() -> list[Column]:
    """k1 and k2, by which a text is known again: 128 bits of the column text."""
    text = F.col("text").cast("string")
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(7), text).alias("k2")]


def word_count(text):
    """Number of words, native; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def buckets_for(n_rows: int, rows_each: int = 512) -> int:
    """Buckets of a two-level running sum: groups stay small, and so do the bucket totals of one key."""
    return max(1, min(-(-n_rows // rows_each), 1 << 20))


def running_sums(df: DataFrame, key: str, bucket: str, order: list, value: str, start: str, rank: str) -> DataFrame:
    """Exclusive running sum and row number of each key without putting a key's rows into one task.

    bucket must ascend with the order. Each (key, bucket) is summed first, those
    totals are accumulated per key, and rows are accumulated inside their bucket.
    """
    totals = df.groupBy(key, bucket).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(key).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    base = totals.select(
        F.col(key).alias("_key"), F.col(bucket).alias("_bucket"),
        F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_rows"),
    )
    inside = W.partitionBy(key, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = df.withColumn("_before", F.coalesce(F.sum(value).over(inside), F.lit(0))).withColumn(
        "_no", F.row_number().over(W.partitionBy(key, bucket).orderBy(*order))
    )
    joined = local.join(base, local[key].eqNullSafe(base["_key"]) & (local[bucket] == base["_bucket"]))
    return joined.select(
        *[local[c] for c in df.columns],
        (F.col("_base") + F.col("_before")).cast("long").alias(start),
        (F.col("_rows") + F.col("_no") - 1).cast("long").alias(rank),
    )


#: Rows of keys that are sent to every executor at most (a few dozen bytes each); more are joined by shuffling.
BROADCAST_ROWS = 1_000_000


def without(docs: DataFrame, rejected: DataFrame, keys: dict) -> DataFrame:
    """docs less the rows whose keys (name in rejected: expression over docs) are in rejected; nulls equal nulls."""
    return _by_keys(docs, rejected, keys, "left_anti")


def with_only(docs: DataFrame, wanted: DataFrame, keys: dict) -> DataFrame:
    """The rows of docs whose keys are in wanted."""
    return _by_keys(docs, wanted, keys, "left_semi")


def _by_keys(docs: DataFrame, listed: DataFrame, keys: dict, how: str) -> DataFrame:
    with small_batches(docs.sparkSession):
        side = stored(listed.select(*keys).distinct(), "keys")
    side = F.broadcast(side) if side.count() <= BROADCAST_ROWS else side
    names = fresh(docs, *keys)
    marked = docs.withColumns({n: e for n, e in zip(names, keys.values())})
    on = reduce(Column.__and__, [marked[n].eqNullSafe(side[k]) for n, k in zip(names, keys)])
    return marked.join(side, on, how).drop(*names)
