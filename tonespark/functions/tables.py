"""Helpers on long tables: numbering, per-channel statistics and blocks, none of which puts a whole channel into one task."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

KEY = ("frame_id", "channel_id")


def kept(df: DataFrame) -> DataFrame:
    """df, worked out once where a plan reads it twice, on the executors' disks. The plan above it stays small, and lost parts are worked out again; clearCache() frees them."""
    return df.persist(StorageLevel.DISK_ONLY)


def number_rows(df: DataFrame, keys: list[str], bucket: Column, order: list, name: str) -> DataFrame:
    """Number rows of each key from 0. bucket ascends with the order and splits a key, so that a task sorts one bucket and adds what came before."""
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    local = df.withColumn("_no", F.row_number().over(W.partitionBy(*keys, "_bucket").orderBy(*order)))
    return local.join(before, [*keys, "_bucket"]).withColumn(name, (F.col("_before") + F.col("_no") - 1).cast("long")).drop("_bucket", "_before", "_no")


def with_stats(df: DataFrame, keys: tuple, **stats: Column) -> DataFrame:
    """df with statistics of its key: partial aggregates joined back, not a window over whole channels."""
    return df.join(df.groupBy(*keys).agg(*[e.alias(n) for n, e in stats.items()]), list(keys))


def with_channel_values(df: DataFrame, values: dict, name: str, default) -> DataFrame:
    """df with a value for each channel by its id: a literal for few channels, a joined table for many."""
    if len(values) <= 16:
        expr = F.lit(default)
        for channel, value in values.items():
            expr = F.when(F.col("channel_id") == channel, F.lit(value)).otherwise(expr)
        return df.withColumn(name, expr)
    table = df.sparkSession.createDataFrame(list(values.items()), ["channel_id", name])
    joined = df.join(F.broadcast(table) if len(values) <= 100_000 else table, "channel_id", "left")
    return joined.select(*df.columns, F.coalesce(name, F.lit(default)).alias(name))


def blocks(df: DataFrame, size: int, before: int = 0, after: int = 0, value: str = "value") -> DataFrame:
    """Blocks of `size` consecutive samples with a halo: frame_id, channel_id, block, start, values (sorted by sample_idx)."""
    at = F.col("sample_idx")
    first, last = F.floor((at - after) / size), F.floor((at + before) / size)
    ids = F.sequence(F.greatest(first, F.lit(0)), last) if before or after else F.array(F.floor(at / size))
    rows = df.select(*KEY, "sample_idx", value, F.explode(ids.cast("array<bigint>")).alias("block"))
    if before:  # blocks behind the last sample exist in its halo only
        top = df.groupBy(*KEY).agg(F.floor(F.max("sample_idx") / size).alias("_top"))
        rows = rows.join(top, list(KEY)).where("block <= _top")
    packed = rows.groupBy(*KEY, "block").agg(F.array_sort(F.collect_list(F.struct("sample_idx", F.col(value).alias("value")))).alias("_v"))
    return packed.select(*KEY, "block", F.col("_v")[0]["sample_idx"].alias("start"), F.transform("_v", lambda s: s["value"]).alias("values"))


def unblock(df: DataFrame, value: str = "value") -> DataFrame:
    """The long table of blocks (start, values)."""
    return df.select(*KEY, "start", F.posexplode("values").alias("_i", value)).select(*KEY, (F.col("start") + F.col("_i")).cast("long").alias("sample_idx"), value)
