"""Statistics and normalisation: partial aggregates, joined back where every sample needs them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import KEY, with_stats

TINY = 2.2250738585072014e-308


def rms(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEY).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))


def crest_factor(df: DataFrame) -> DataFrame:
    """Largest magnitude over RMS; 1 for silence."""
    both = df.groupBy(*KEY).agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"), F.max(F.abs("value")).alias("peak"))
    return both.select(*KEY, F.when(F.col("rms") > 0, F.col("peak") / F.col("rms")).otherwise(1.0).alias("crest_factor"))


def across_channels(df: DataFrame, how: str, name: str | None = None) -> DataFrame:
    """One channel: sum or mean of all at each sample."""
    value = {"sum": F.sum, "mean": F.avg}[how]("value").alias("value")
    return df.groupBy("frame_id", "sample_idx").agg(value).select("frame_id", F.lit(name or how).alias("channel_id"), "sample_idx", "value")


def remove_dc(df: DataFrame) -> DataFrame:
    return with_stats(df, KEY, _m=F.avg("value")).select(*KEY, "sample_idx", (F.col("value") - F.col("_m")).alias("value"))


def normalize(df: DataFrame, norm: float = math.inf, whole_frame: bool = False, threshold: float | None = None, fill: bool | None = None) -> DataFrame:
    """Divide by a norm of each channel (or frame). Smaller norms than threshold divide by 1, or give a filled or a zero channel."""
    if threshold is not None and threshold <= 0:
        raise ValueError("threshold is above 0")
    if norm == 0 and fill:
        raise ValueError("norm 0 cannot fill")
    size = F.abs("value")
    if norm == 0:
        length = F.sum(F.when(F.col("value") != 0, 1.0).otherwise(0.0))
    elif norm == math.inf:
        length = F.max(size)
    elif norm == -math.inf:
        length = F.min(size)
    else:
        length = F.pow(F.sum(F.pow(size, F.lit(float(norm)))), F.lit(1.0 / norm))
    keys = ("frame_id",) if whole_frame else KEY
    both = with_stats(df, keys, _l=length, _n=F.count(F.lit(1)))
    small = F.col("_l") < F.lit(threshold or TINY)
    value = F.col("value") / F.when(small, 1.0).otherwise(F.col("_l"))
    if fill is True:
        full = F.lit(1.0) if math.isinf(norm) else F.pow(F.col("_n").cast("double"), F.lit(-1.0 / norm))
        value = F.when(small, full).otherwise(value)
    elif fill is False:
        value = F.when(small, 0.0).otherwise(value)
    return both.select(*KEY, "sample_idx", value.alias("value"))


def derived_factors(df: DataFrame, factors: dict[str, float], target_rms: float | None = None, target_level: float | None = None, refs: dict[str, float] | None = None) -> dict[str, float]:
    """Calibration factors with which each channel has the target: exactly one of an RMS or a level in dB. An action over one row a channel."""
    if (target_rms is None) == (target_level is None):
        raise ValueError("give one target")
    out = {}
    for r in rms(df).groupBy("channel_id").agg(F.max("rms").alias("rms")).collect():
        target = target_rms if target_rms is not None else (refs or {}).get(r.channel_id, 1.0) * 10 ** (target_level / 20)
        if not r.rms > 0:
            raise ValueError(f"channel {r.channel_id} is silent")
        out[r.channel_id] = factors.get(r.channel_id, 1.0) * target / r.rms
    return out
