"""Framed and recursive operators over sample numbers."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.levels import level_db, power_db
from ..functions.tables import KEY, blocks, kept, unblock, with_channel_values, with_stats
from ..functions.windows import tukey

FAST, SLOW = 0.125, 1.0
BLOCK = 65_536


def frames_of(df: DataFrame, length: int, hop: int) -> DataFrame:
    """Partial sums of squares of centred frames: frame_id, channel_id, frame_idx, _sq, and nothing for frames of zeros only.

    Samples are first summed over the greatest common step of length, hop and the
    padding, so that each partial sum, not each sample, is sent to its frames.
    """
    pad = length // 2
    step = math.gcd(math.gcd(length, hop), pad) if pad else math.gcd(length, hop)
    cells = df.groupBy(*KEY, F.floor((F.col("sample_idx") + pad) / step).alias("_cell")).agg(F.sum(F.col("value") * F.col("value")).alias("_sq"))
    at = F.col("_cell") * step
    first = F.greatest(F.lit(0), F.floor((at - length) / hop) + 1)
    return cells.select(*KEY, "_sq", F.explode(F.sequence(first, F.floor(at / hop))).alias("frame_idx"))


def rms_trend(df: DataFrame, length: int = 2048, hop: int = 512, db: bool = False, refs: dict[str, float] | None = None) -> DataFrame:
    """RMS of centred, zero-padded frames; as a level in dB if wanted. df is calibrated (and weighted, if wanted) before."""
    if length < 1 or hop < 1:
        raise ValueError("length and hop are positive")
    sums = frames_of(df, length, hop).groupBy(*KEY, "frame_idx").agg(F.sum("_sq").alias("_sq"))
    counts = df.groupBy(*KEY).agg((F.floor((F.max("sample_idx") + 1 + 2 * (length // 2) - length) / hop)).alias("_last"))
    every = counts.select(*KEY, F.explode(F.sequence(F.lit(0).cast("long"), "_last")).alias("frame_idx"))
    rms = every.join(sums, [*KEY, "frame_idx"], "left").select(*KEY, F.col("frame_idx").alias("sample_idx"), F.sqrt(F.coalesce("_sq", F.lit(0.0)) / length).alias("value"))
    if not db:
        return rms
    return with_channel_values(rms, refs or {}, "_ref", 1.0).withColumn("value", level_db(F.col("value"), F.col("_ref"))).drop("_ref")


def smooth_blocks(values: np.ndarray, alpha: float) -> np.ndarray:
    """y[k] = alpha * y[k-1] + (1 - alpha) * values[k] from rest, in numpy: chunks of 256 by one matrix, carried by a short loop."""
    n, m = len(values), 256
    rows = -(-n // m)
    x = np.zeros(rows * m)
    x[:n] = values
    powers = alpha ** np.arange(m)
    tri = np.tril(powers[np.clip(np.subtract.outer(np.arange(m), np.arange(m)), 0, None)]) * (1 - alpha)
    y = x.reshape(rows, m) @ tri.T
    carry, keep = 0.0, alpha ** np.arange(1, m + 1)
    for r in range(rows):
        y[r] += carry * keep
        carry = y[r, -1]
    return y.reshape(-1)[:n]


def sound_level(df: DataFrame, rate: float, time_constant: float = FAST, db: bool = False, refs: dict[str, float] | None = None, block: int = BLOCK) -> DataFrame:
    """Time-weighted level: mean square under an exponential window, as amplitude or dB. df is frequency-weighted before.

    The recursion runs in each block from rest; a block's end and the decay over
    it give the state with which the next begins, so channels are not held whole.
    """
    alpha = math.exp(-1.0 / (rate * time_constant))
    packed = blocks(df.withColumn("value", F.col("value") * F.col("value")), block)

    def local(frames):
        for pdf in frames:
            yield pdf.assign(values=[smooth_blocks(np.asarray(v, float), alpha) for v in pdf["values"]])

    rest = kept(packed.mapInPandas(local, packed.schema))
    ends = rest.select(*KEY, "block", F.element_at("values", -1).alias("_end"), F.size("values").alias("_len"))
    # block states: s[b+1] = s[b] * alpha ** len + end[b]; one row a block, so one channel's blocks fit one task
    ordered = ends.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("block", "_end", "_len"))).alias("_e"))
    step = F.aggregate(
        "_e", F.struct(F.lit(0.0).alias("s"), F.array().cast("array<double>").alias("all")),
        lambda a, e: F.struct((a["s"] * F.pow(F.lit(alpha), e["_len"]) + e["_end"]).alias("s"), F.concat(a["all"], F.array(a["s"])).alias("all")),
    )["all"]
    states = ordered.select(*KEY, F.explode(F.arrays_zip(F.transform("_e", lambda e: e["block"]).alias("block"), step.alias("state"))).alias("_z")).select(*KEY, "_z.block", "_z.state")
    joined = rest.join(states, [*KEY, "block"]).select(*KEY, "start", "state", F.posexplode("values").alias("_i", "_y"))
    mean_square = F.col("_y") + F.col("state") * F.pow(F.lit(alpha), F.col("_i") + 1)
    out = joined.select(*KEY, (F.col("start") + F.col("_i")).cast("long").alias("sample_idx"), F.greatest(mean_square, F.lit(0.0)).alias("value"))
    if not db:
        return out.withColumn("value", F.sqrt("value"))
    return with_channel_values(out, refs or {}, "_ref", 1.0).withColumn("value", power_db(F.col("value"), F.col("_ref"))).drop("_ref")


#: Magnitudes whose squares, summed over any channel, stay within what a double holds.
LEAST, MOST = 1e-140, 1e140


def scaled(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """df with each channel whose greatest magnitude lies outside LEAST to MOST divided by a power of two near it, and the powers (_scale) by channel.

    Other channels keep their values to the bit (a power of 1). Samples some 1e150
    below a scaled channel's greatest one have squares of 0 and read as silence.
    """
    top = F.max(F.abs("value"))
    odd = (top > 0) & (top < float("inf")) & ((top < LEAST) | (top > MOST))
    scales = df.groupBy(*KEY).agg(F.when(odd, F.pow(F.lit(2.0), F.floor(F.log2(top)))).otherwise(1.0).alias("_scale"))
    return df.join(scales, list(KEY)).withColumn("value", F.col("value") / F.col("_scale")).drop("_scale"), scales


def unscaled(df: DataFrame, scales: DataFrame, db: bool, refs: dict[str, float], floor: float) -> DataFrame:
    """Amplitudes of scaled() samples at their own size, or as levels in dB, whose ratio to the reference is never formed."""
    out = df.join(scales, list(KEY))
    if not db:
        return out.withColumn("value", F.col("value") * F.col("_scale")).drop("_scale")
    level = 20 * F.log10("value") + 20 * F.log10("_scale") - 20 * F.log10("_ref")
    out = with_channel_values(out, refs, "_ref", 1.0).withColumn("value", F.when(F.col("value") > 0, F.greatest(level, F.lit(floor))).otherwise(floor))
    return out.drop("_scale", "_ref")


def crossings(df: DataFrame, level: float, block: int = BLOCK) -> DataFrame:
    """Samples before which a channel's sign against level rises: compared with the next sample, across blocks by a halo of one."""
    sign = F.signum(F.col("value") - level)
    rows = df.select(*KEY, "sample_idx", sign.alias("_s"), F.floor(F.col("sample_idx") / block).alias("_b"))
    halo = rows.unionByName(rows.where((F.col("sample_idx") % block == 0) & (F.col("sample_idx") > 0)).withColumn("_b", F.col("_b") - 1))
    next_ = F.lead("_s").over(W.partitionBy(*KEY, "_b").orderBy("sample_idx"))
    return halo.withColumn("_next", next_).where("_next > _s").where(F.floor(F.col("sample_idx") / block) == F.col("_b")).select(*KEY, "sample_idx")


def level_trigger(df: DataFrame, level: float, offset: int = 0, hold: int = 1) -> DataFrame:
    """Rising crossings, each more than `hold` samples after the one before that counted: frame_id, channel_id, point."""
    ends = df.groupBy(*KEY).agg((F.max("sample_idx") + 1).alias("_n"))
    found = crossings(df, level).join(ends, list(KEY)).where(F.col("sample_idx") + hold < F.col("_n"))

    def held(pdf: pd.DataFrame) -> pd.DataFrame:
        points, last = [], None
        for p in np.sort(pdf["sample_idx"].to_numpy()):
            if last is None or last + hold < p:
                points.append(int(p) + offset)
                last = p
        return pd.DataFrame({"frame_id": pdf["frame_id"].iloc[0], "channel_id": pdf["channel_id"].iloc[0], "point": points})

    return found.groupBy(*KEY).applyInPandas(held, "frame_id string, channel_id string, point long")


def cut(df: DataFrame, points: DataFrame, length: int, taper: float = 0.0, dc_cut: bool = False) -> DataFrame:
    """Segments of `length` from points (frame_id, channel_id, point) that lie in the channel, tapered: frame_id, channel_id, point, place, value."""
    ends = df.groupBy(*KEY).agg((F.max("sample_idx") + 1).alias("_n"))
    good = points.join(ends, list(KEY)).where((F.col("point") >= 0) & (F.col("point") + length <= F.col("_n"))).drop("_n")
    wanted = good.select(*KEY, "point", F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("place")).withColumn("sample_idx", F.col("point") + F.col("place"))
    rows = wanted.join(df.select(*KEY, "sample_idx", "value"), [*KEY, "sample_idx"])
    if dc_cut:
        rows = with_stats(rows, (*KEY, "point"), _m=F.avg("value")).withColumn("value", F.col("value") - F.col("_m")).drop("_m")
    gains = F.array(*[F.lit(float(g)) for g in tukey(length, taper)])
    return rows.select(*KEY, "point", "place", (F.col("value") * F.get(gains, F.col("place"))).alias("value"))


__all__ = ["blocks", "unblock", "rms_trend", "sound_level", "level_trigger", "cut", "smooth_blocks"]
