"""Selection, arithmetic, alignment and mixing of signals as plans over the long table (frame_id, channel_id, sample_idx, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import KEY, with_channel_values, with_stats

ALL = [*KEY, "sample_idx", "value"]
OPERATIONS = {
    "add": lambda a, b: a + b,
    "sub": lambda a, b: a - b,
    "mul": lambda a, b: a * b,
    # by zero as IEEE 754 has it: a power of -1 keeps the zero's sign, and nulls stay nulls
    "div": lambda a, b: F.when(b != 0, F.try_divide(a, b)).otherwise(a * F.pow(b, F.lit(-1.0))),
    "pow": lambda a, b: F.pow(a, b),
}


def select_channels(df: DataFrame, ids: list[str]) -> DataFrame:
    return df.where(F.col("channel_id").isin(list(ids)))


def remove_channels(df: DataFrame, ids: list[str]) -> DataFrame:
    return df.where(~F.col("channel_id").isin(list(ids)))


def repeat_channels(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """The channels that pairs (id, new id) name, as often as they do: rows are copied, not shuffled, where the list is small."""
    listed = df.sparkSession.createDataFrame(pairs, "channel_id string, _new string")
    joined = df.join(F.broadcast(listed) if len(pairs) <= 100_000 else listed, "channel_id")
    return joined.withColumn("channel_id", F.col("_new")).select(*df.columns)


def trim(df: DataFrame, first: int, end: int) -> DataFrame:
    """Samples first to end, numbered from 0: a range that reaches the scan."""
    if first < 0 or end < first:
        raise ValueError("a range is not negative")
    return df.where((F.col("sample_idx") >= first) & (F.col("sample_idx") < end)).withColumn("sample_idx", F.col("sample_idx") - first)


def common_length(df: DataFrame) -> DataFrame:
    """Samples that all channels of a recording have: up to the end of its shortest one."""
    ends = df.groupBy(*KEY).agg((F.max("sample_idx") + 1).alias("_n")).groupBy("frame_id").agg(F.min("_n").alias("_n"))
    return df.join(F.broadcast(ends), "frame_id").where(F.col("sample_idx") < F.col("_n")).select(*df.columns)


def fix_length(df: DataFrame, length: int) -> DataFrame:
    """Exactly `length` samples a channel: the tail is cut, or zeros are added."""
    ends = df.groupBy(*KEY).agg((F.max("sample_idx") + 1).alias("_n")).where(F.col("_n") < length)
    pad = ends.select(*KEY, F.explode(F.sequence("_n", F.lit(length - 1).cast("long"))).alias("sample_idx"), F.lit(0.0).alias("value"))
    return df.where(F.col("sample_idx") < length).select(*ALL).unionByName(pad)


def scale(df: DataFrame, factors: dict[str, float]) -> DataFrame:
    """Calibration: channels times their factors; nothing is done where all are 1."""
    if all(f == 1.0 for f in factors.values()):
        return df
    scaled = with_channel_values(df, {c: float(f) for c, f in factors.items()}, "_factor", 1.0)
    return scaled.withColumn("value", F.col("value") * F.col("_factor")).drop("_factor")


def with_scalar(df: DataFrame, op: str, scalar: float, reverse: bool = False) -> DataFrame:
    a, b = F.col("value"), F.lit(float(scalar))
    return df.withColumn("value", OPERATIONS[op](b, a) if reverse else OPERATIONS[op](a, b))


def with_signal(left: DataFrame, right: DataFrame, op: str, pairs: dict[str, str] | None = None) -> DataFrame:
    """Sample by sample; channels pair by place (pairs: left id to right id). Both have equal shapes, which the caller checks."""
    other = renamed(right, pairs).select(*KEY, "sample_idx", F.col("value").alias("_v"))
    joined = left.join(other, [*KEY, "sample_idx"])
    return joined.select(*KEY, "sample_idx", OPERATIONS[op](F.col("value"), F.col("_v")).alias("value"))


def renamed(df: DataFrame, pairs: dict[str, str] | None) -> DataFrame:
    """df with the channel ids that pairs (new id to old id) give; other channels go."""
    if not pairs or all(k == v for k, v in pairs.items()):
        return df
    named = with_channel_values(df, {old: new for new, old in pairs.items()}, "_new", None)
    return named.where("_new IS NOT NULL").withColumn("channel_id", F.col("_new")).drop("_new")


def _complex(op: str, a: tuple, b: tuple) -> tuple[Column, Column]:
    (ar, ai), (br, bi) = a, b
    if op in ("add", "sub"):
        return OPERATIONS[op](ar, br), OPERATIONS[op](ai, bi)
    if op == "mul":
        return ar * br - ai * bi, ar * bi + ai * br
    if op == "div":
        size = br * br + bi * bi
        return OPERATIONS["div"](ar * br + ai * bi, size), OPERATIONS["div"](ai * br - ar * bi, size)
    # a ** b by logarithm; 0 ** b is 0, and 1 where b is 0
    size, turn = F.sqrt(ar * ar + ai * ai), F.atan2(ai, ar)
    log = F.log(F.when(size > 0, size))
    grown, angle = F.exp(br * log - bi * turn), bi * log + br * turn
    zero = F.when((br == 0) & (bi == 0), F.lit(1.0)).otherwise(F.lit(0.0))
    return F.coalesce(grown * F.cos(angle), zero), F.coalesce(grown * F.sin(angle), F.lit(0.0))


def complex_scalar(df: DataFrame, op: str, scalar: complex, reverse: bool = False) -> DataFrame:
    mine, other = (F.col("re"), F.col("im")), (F.lit(scalar.real), F.lit(scalar.imag))
    re, im = _complex(op, *((other, mine) if reverse else (mine, other)))
    return df.select(*[c for c in df.columns if c not in ("re", "im")], re.alias("re"), im.alias("im"))


def with_spectrum(left: DataFrame, right: DataFrame, op: str, pairs: dict[str, str], index: list[str], parts: list[str]) -> DataFrame:
    """Bin by bin; channels pair by place (pairs: left id to right id)."""
    keys = [*KEY, *index]
    other = renamed(right, pairs).select(*keys, *[F.col(p).alias(f"_{p}") for p in parts])
    joined = left.join(other, keys)
    if parts == ["value"]:
        return joined.select(*left.columns[:-1], OPERATIONS[op](F.col("value"), F.col("_value")).alias("value"))
    re, im = _complex(op, (F.col("re"), F.col("im")), (F.col("_re"), F.col("_im")))
    return joined.select(*keys, re.alias("re"), im.alias("im"))


def absolute(df: DataFrame) -> DataFrame:
    return df.withColumn("value", F.abs("value"))


def power(df: DataFrame, exponent: float) -> DataFrame:
    return df.withColumn("value", F.pow("value", F.lit(float(exponent))))


def difference(df: DataFrame, reference: str) -> DataFrame:
    """Every channel less one of them."""
    base = df.where(F.col("channel_id") == reference).select("frame_id", "sample_idx", F.col("value").alias("_v"))
    return df.join(base, ["frame_id", "sample_idx"]).select(*KEY, "sample_idx", (F.col("value") - F.col("_v")).alias("value"))


def concat(left: DataFrame, right: DataFrame, rename: dict[str, str]) -> DataFrame:
    """Channels of both; right's get new ids (rename: old id to new id; others keep theirs)."""
    named = with_channel_values(right, rename, "_new", None)
    return left.select(*ALL).unionByName(named.select("frame_id", F.coalesce("_new", "channel_id").alias("channel_id"), "sample_idx", "value"))


def mix(df: DataFrame, other: DataFrame, gain: Column | None = None, one_channel: bool = False) -> DataFrame:
    """Add other where it has a sample; one channel of other serves all of df."""
    keys = ["frame_id", "sample_idx"] if one_channel else [*KEY, "sample_idx"]
    side = other.select(*keys, F.col("value").alias("_v"))
    return df.join(side, keys, "left").select(*KEY, "sample_idx", (F.col("value") + F.coalesce("_v", F.lit(0.0))).alias("value"))


def mix_snr(df: DataFrame, noise: DataFrame, snr_db: float) -> DataFrame:
    """Add noise scaled to a signal-to-noise ratio of each channel's RMS; silent noise adds nothing."""
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    clean = df.groupBy(*KEY).agg(rms("value").alias("_clean"))
    dirty = noise.groupBy(*KEY).agg(rms("value").alias("_noise"))
    gains = clean.join(dirty, list(KEY)).select(*KEY, F.when(F.col("_noise") > 0, F.col("_clean") / F.lit(10 ** (snr_db / 20)) / F.col("_noise")).otherwise(0.0).alias("_g"))
    scaled = noise.join(gains, list(KEY)).select(*KEY, "sample_idx", (F.col("value") * F.col("_g")).alias("value"))
    return mix(df, scaled)


def fade(df: DataFrame, samples: int) -> DataFrame:
    """Cosine ramps over `samples` at both ends of each channel (a symmetric Tukey taper)."""
    if samples <= 0:
        return df
    n = with_stats(df, KEY, _n=F.max("sample_idx") + 1)
    last = F.col("_n") - 1
    ramp = F.least(F.lit(1.0), F.lit(2.0 * samples) / F.col("_n")) * last / 2
    k = F.least(F.col("sample_idx"), last - F.col("sample_idx"))
    gain = F.when(k < ramp, 0.5 - 0.5 * F.cos(F.lit(3.141592653589793) * k / ramp)).otherwise(1.0)
    checked = F.when(F.col("_n") > 2 * samples, gain).otherwise(F.raise_error(F.lit("the fade is longer than half of a channel")).cast("double"))
    return n.select(*KEY, "sample_idx", (F.col("value") * checked).alias("value"))
