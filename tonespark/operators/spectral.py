"""Spectra. Frames are cut in the plan, transformed in Arrow batches of whole frames, and averaged, paired and viewed in the plan.

Spectra: frame_id, channel_id, freq_idx, re, im. Short-time spectra add frame_idx.
Complex numbers are pairs of columns.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import KEY, blocks
from ..functions.windows import window

SPECTRUM = "frame_id string, channel_id string, freq_idx int, re double, im double"


def one_sided(n_fft: int) -> np.ndarray:
    """2 for bins that stand for two, 1 for DC and the Nyquist bin of an even length."""
    s = np.full(n_fft // 2 + 1, 2.0)
    s[0] = 1.0
    if n_fft % 2 == 0 and n_fft > 1:
        s[-1] = 1.0
    return s


def channel_arrays(df: DataFrame, limit: int | None = None) -> DataFrame:
    """A row for each channel: its samples in order. limit keeps the first ones, in the scan."""
    if limit is not None:
        df = df.where(F.col("sample_idx") < limit)
    packed = df.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("sample_idx", "value"))).alias("_v"))
    return packed.select(*KEY, F.transform("_v", lambda s: s["value"]).alias("values"))


def _exploded(df: DataFrame, keys: list[str], index: str) -> DataFrame:
    return df.select(*keys, F.posexplode(F.arrays_zip("re", "im")).alias(index, "_z")).select(*keys, index, "_z.re", "_z.im")


def _map(df: DataFrame, keys: list[str], kernel, out: str = "re array<double>, im array<double>") -> DataFrame:
    """kernel(2-D array of a batch's rows of equal length) to arrays of the columns of out."""
    kinds = dict(df.dtypes)
    names = [c.split()[0] for c in out.split(", ")]

    def run(frames):
        for pdf in frames:
            result = pdf[keys].copy()
            columns: dict[str, list] = {n: [None] * len(pdf) for n in names}
            sizes = pdf["values"].map(len).to_numpy()
            for size in np.unique(sizes):
                rows = np.flatnonzero(sizes == size)
                got = kernel(np.stack([np.asarray(pdf["values"].iloc[i], float) for i in rows]))
                for name, values in zip(names, got):
                    for i, v in zip(rows, values):
                        columns[name][i] = v
            for name in names:
                result[name] = columns[name]
            yield result

    return df.select(*keys, "values").mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + f", {out}")


def fft(df: DataFrame, n_fft: int, win: str = "hann") -> DataFrame:
    """Peak-amplitude spectrum: cut or zero-padded to n_fft, then windowed over n_fft; one-sided bins are doubled and divided by the window's sum."""
    w = window(win, n_fft)
    gain = one_sided(n_fft) / w.sum()

    def kernel(x: np.ndarray):
        full = np.zeros((len(x), n_fft))
        full[:, : x.shape[1]] = x[:, :n_fft]
        s = np.fft.rfft(full * w) * gain
        return s.real, s.imag

    return _exploded(_map(channel_arrays(df, n_fft), list(KEY), kernel), list(KEY), "freq_idx")


def spectrum_arrays(df: DataFrame, keys: list[str], index: str = "freq_idx") -> DataFrame:
    """Rows of (re, im) by index, packed one array after the other: values."""
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(index, "re", "im"))).alias("_v"))
    return packed.select(*keys, F.concat(F.transform("_v", lambda s: s["re"]), F.transform("_v", lambda s: s["im"])).alias("values"))


def _samples(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.select(*keys, F.posexplode("value").alias("_i", "value")).select(*keys, F.col("_i").cast("long").alias("sample_idx"), "value")


def ifft(spectrum: DataFrame, n_fft: int, win: str = "hann") -> DataFrame:
    """Exact inverse of fft(): the windowed waveform of n_fft samples."""
    gain = window(win, n_fft).sum() / one_sided(n_fft)

    def kernel(x: np.ndarray):
        half = x.shape[1] // 2
        return (np.fft.irfft((x[:, :half] + 1j * x[:, half:]) * gain, n_fft),)

    return _samples(_map(spectrum_arrays(spectrum, list(KEY)), list(KEY), kernel, "value array<double>"), list(KEY))


#: Samples that a block holds before its halo, and values of the frames that a kernel gets at once.
BLOCK, FRAME_VALUES = 16_384, 1 << 20


def framed(df: DataFrame, width: int, hop: int, first_start: int, most: str, kernel) -> DataFrame:
    """kernel over frames of `width` samples from first_start (not positive) on, hop apart: frame_id, channel_id, frame_idx, re, im (arrays).

    Samples are shuffled once, into blocks with a halo of one frame; frames are cut
    inside a block and never are rows. Samples outside a channel are zeros; most is
    an expression over _n, the channel's length, for the last frame's number.
    Frames that no block reaches are left out.
    """
    per = max(1, max(BLOCK, width) // hop)
    size = per * hop
    ends = df.groupBy(*KEY).agg((F.max("sample_idx") + 1).alias("_n")).select(*KEY, F.expr(most).cast("long").alias("_most"))
    moved = df.select(*KEY, (F.col("sample_idx") - first_start).alias("sample_idx"), "value")
    packed = blocks(moved, size, after=width - 1).join(ends, list(KEY))

    def run(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                count = min(per, int(row.last) - row.block * per + 1)
                if count < 1:
                    continue
                x = np.zeros((count - 1) * hop + width)
                v, at = np.asarray(row.values, float), row.start - row.block * size
                v = v[: max(0, len(x) - at)]
                x[at : at + len(v)] = v
                every = np.lib.stride_tricks.sliding_window_view(x, width)[::hop]
                step = max(1, FRAME_VALUES // width)
                for lo in range(0, count, step):
                    re, im = kernel(every[lo : lo + step])
                    n = len(re)
                    yield pd.DataFrame({"frame_id": [row.frame_id] * n, "channel_id": [row.channel_id] * n, "frame_idx": np.arange(lo, lo + n, dtype=np.int32) + np.int32(row.block * per), "re": list(re), "im": list(im)})

    return packed.select(*KEY, "block", "start", "values", F.col("_most").alias("last")).mapInPandas(run, "frame_id string, channel_id string, frame_idx int, re array<double>, im array<double>")


def stft_span(n: int, win: np.ndarray, hop: int) -> tuple[int, int]:
    """First slice that overlaps the signal (not positive) and the one after the last: slice p covers p * hop - mid onward, in its window's non-zero part."""
    mid, used = len(win) // 2, np.flatnonzero(win)
    first, last = int(used[0]), int(used[-1])
    low = math.floor(-(last - mid) / hop)
    while low * hop - mid + last < 0:
        low += 1
    high = math.ceil((n + mid - first) / hop)
    while high * hop - mid + first < n:
        high += 1
    return min(low, 0), high


def stft(df: DataFrame, n: int | None, n_fft: int = 2048, hop: int | None = None, win_length: int | None = None, win: str = "hann") -> DataFrame:
    """Short-time spectra of peak amplitude; frame_idx 0 is the first slice. n: samples a channel; None takes each channel's own length."""
    win_length = win_length or n_fft
    hop = hop or n_fft // 4
    w = window(win, win_length)
    mid = win_length // 2
    low, high = stft_span(n or 0, w, hop)
    if n is None:
        last, ends = f"CAST(ceil((_n + {mid - int(np.flatnonzero(w)[0])}) / {hop}) - {low + 1} AS INT)", df.groupBy(*KEY).agg((F.max("sample_idx") + 1).alias("_n"))
    else:
        last, ends = high - low - 1, df.select(*KEY).distinct()
    gain = one_sided(n_fft) / np.abs(w).sum()

    def kernel(x: np.ndarray):
        full = np.zeros((len(x), n_fft))
        full[:, :win_length] = x * w
        s = np.fft.rfft(np.roll(full, -mid, axis=1)) * gain
        return s.real, s.imag

    frames = framed(df, win_length, hop, low * hop - mid, str(last), kernel)
    # slices over zeros alone are frames too
    every = ends.select(*KEY, F.explode(F.sequence(F.lit(0), F.expr(last) if n is None else F.lit(last))).alias("frame_idx"))
    nothing = F.array_repeat(F.lit(0.0), n_fft // 2 + 1)
    keys = [*KEY, "frame_idx"]
    frames = every.join(frames, keys, "left").select(*keys, F.coalesce("re", nothing).alias("re"), F.coalesce("im", nothing).alias("im"))
    return _exploded(frames, keys, "freq_idx")


def istft(spectra: DataFrame, n_fft: int, hop: int, win_length: int, win: str, n: int | DataFrame) -> DataFrame:
    """Overlap-add with the dual window: the first n samples, or those of each channel's length in a table frame_id, channel_id, _n."""
    w = window(win, win_length)
    mid = win_length // 2
    low, _ = stft_span(0, w, hop)  # the first slice does not depend on the length
    total = np.zeros(win_length)
    for k in range(-(win_length // hop) - 1, win_length // hop + 2):
        shifted = np.zeros(win_length)
        a, b = max(0, k * hop), min(win_length, win_length + k * hop)
        if a < b:
            shifted[a:b] = w[a - k * hop : b - k * hop] ** 2
        total += shifted
    if (total <= 1e-15).any():
        raise ValueError("this hop loses samples")
    dual = w / total
    gain = np.abs(w).sum() / one_sided(n_fft)

    def kernel(x: np.ndarray):
        half = x.shape[1] // 2
        frames = np.fft.irfft((x[:, :half] + 1j * x[:, half:]) * gain, n_fft)
        return (np.roll(frames, mid, axis=1)[:, :win_length] * dual,)

    keys = [*KEY, "frame_idx"]
    parts = _map(spectrum_arrays(spectra, keys), keys, kernel, "value array<double>")
    rows = parts.select(*KEY, "frame_idx", F.posexplode("value").alias("_i", "_v"))
    at = (F.col("frame_idx") + low) * hop - mid + F.col("_i")
    rows = rows.select(*KEY, at.cast("long").alias("sample_idx"), "_v")
    rows = rows.join(n, list(KEY)) if isinstance(n, DataFrame) else rows.withColumn("_n", F.lit(n))
    rows = rows.where((F.col("sample_idx") >= 0) & (F.col("sample_idx") < F.col("_n")))
    return rows.groupBy(*KEY, "sample_idx").agg(F.sum("_v").alias("value"))


def segment_arrays(df: DataFrame, n_fft: int, hop: int | None, win_length: int | None, win: str, detrend: str | bool = "constant") -> DataFrame:
    """Spectra of whole segments, unscaled: frame_id, channel_id, frame_idx, re, im (arrays)."""
    win_length = win_length or n_fft
    hop = hop or win_length // 2
    w = window(win, win_length)

    def kernel(x: np.ndarray):
        if detrend == "constant":
            x = x - x.mean(axis=1, keepdims=True)
        elif detrend == "linear":
            t = np.arange(win_length) - (win_length - 1) / 2
            x = x - x.mean(axis=1, keepdims=True) - np.outer(x @ t / (t @ t), t)
        s = np.fft.rfft(x * w, n_fft)
        return s.real, s.imag

    return framed(df, win_length, hop, 0, f"floor((_n - {win_length}) / {hop})", kernel)


def segments(df: DataFrame, n_fft: int, hop: int | None, win_length: int | None, win: str, detrend: str | bool = "constant") -> DataFrame:
    """The same with a row for each bin: frame_id, channel_id, frame_idx, freq_idx, re, im."""
    return _exploded(segment_arrays(df, n_fft, hop, win_length, win, detrend), [*KEY, "frame_idx"], "freq_idx")


def median_bias(n: int) -> float:
    """Expected median over mean of the average of n periodograms."""
    k = np.arange(1, (n - 1) // 2 + 1)
    return 1.0 + float(np.sum(1.0 / (2 * k + 1) - 1.0 / (2 * k)))


def _scale(n_fft: int, win_length: int, win: str, scaling: str, rate: float) -> np.ndarray:
    w = window(win, win_length)
    base = w.sum() ** 2 if scaling == "spectrum" else rate * (w @ w)
    return one_sided(n_fft) / base


def _by_bin(values: np.ndarray):
    return F.get(F.array(*[F.lit(float(v)) for v in values]), F.col("freq_idx"))


def averaged(column, average: str):
    """Mean over segments, or their median without its bias."""
    if average == "mean":
        return F.avg(column)
    n = F.count(F.lit(1)).cast("int")
    bias = 1.0 + F.aggregate(F.when(n >= 3, F.sequence(F.lit(1), F.floor((n - 1) / 2).cast("int"))).otherwise(F.array().cast("array<int>")), F.lit(0.0), lambda a, k: a + 1.0 / (2 * k + 1) - 1.0 / (2 * k))
    return F.median(column) / bias


def welch(df: DataFrame, n_fft: int = 2048, hop: int | None = None, win_length: int | None = None, win: str = "hann", average: str = "mean", rate: float = 1.0) -> DataFrame:
    """Peak-amplitude spectrum of averaged segments: frame_id, channel_id, freq_idx, value."""
    win_length = win_length or n_fft
    scale = _scale(n_fft, win_length, win, "spectrum", rate)
    amplitude = np.sqrt(scale) * np.where(one_sided(n_fft) == 2, math.sqrt(2), 1.0)
    power = segments(df, n_fft, hop, win_length, win).withColumn("_p", F.col("re") * F.col("re") + F.col("im") * F.col("im"))
    mean = power.groupBy(*KEY, "freq_idx").agg(averaged(F.col("_p"), average).alias("_p"))
    return mean.select(*KEY, "freq_idx", (F.sqrt("_p") * _by_bin(amplitude)).alias("value"))


def pair_products(spectra: DataFrame, summed: bool) -> DataFrame:
    """conj(input) * output of all ordered channel pairs of a frame's segments: frame_id, out_ch, in_ch, n, re, im (arrays).

    A segment's channels meet in one row. summed adds up the n segments that a task
    has seen of a pair; otherwise each segment is a row.
    """
    packed = spectra.groupBy("frame_id", "frame_idx").agg(F.collect_list(F.struct("channel_id", "re", "im")).alias("_c"))
    packed = packed.select("frame_id", F.transform("_c", lambda c: c["channel_id"]).alias("channels"), F.transform("_c", lambda c: c["re"]).alias("re"), F.transform("_c", lambda c: c["im"]).alias("im"))

    def run(frames):
        totals: dict = {}
        for pdf in frames:
            rows = []
            for row in pdf.itertuples(index=False):
                z = np.stack([np.asarray(x, float) for x in row.re]) + 1j * np.stack([np.asarray(x, float) for x in row.im])
                for i, a in enumerate(row.channels):
                    for b, product in zip(row.channels, z[i] * z.conj()):
                        if not summed:
                            rows.append((row.frame_id, a, b, 1, product.real, product.imag))
                        elif (key := (row.frame_id, a, b)) in totals:
                            totals[key][0] += 1
                            totals[key][1] += product
                        else:
                            totals[key] = [1, product.copy()]
            if rows:
                yield pd.DataFrame(rows, columns=["frame_id", "out_ch", "in_ch", "n", "re", "im"])
        for (frame, a, b), (n, product) in totals.items():
            yield pd.DataFrame({"frame_id": [frame], "out_ch": [a], "in_ch": [b], "n": [n], "re": [product.real], "im": [product.imag]})

    return packed.mapInPandas(run, "frame_id string, out_ch string, in_ch string, n long, re array<double>, im array<double>")


PAIR = ["frame_id", "out_ch", "in_ch", "freq_idx"]


def csd(df: DataFrame, n_fft: int = 2048, hop: int | None = None, win_length: int | None = None, win: str = "hann", detrend: str | bool = "constant", scaling: str = "spectrum", average: str = "mean", rate: float = 1.0) -> DataFrame:
    """Cross spectra of all ordered pairs, output-major: frame_id, out_ch, in_ch, freq_idx, re, im."""
    win_length = win_length or n_fft
    gain = _by_bin(_scale(n_fft, win_length, win, scaling, rate))
    products = pair_products(segment_arrays(df, n_fft, hop, win_length, win, detrend), average == "mean")
    long = products.select("frame_id", "out_ch", "in_ch", "n", F.posexplode(F.arrays_zip("re", "im")).alias("freq_idx", "_z")).select(*PAIR, "n", "_z.re", "_z.im")
    if average == "mean":
        mean = long.groupBy(*PAIR).agg((F.sum("re") / F.sum("n")).alias("re"), (F.sum("im") / F.sum("n")).alias("im"))
    else:
        mean = long.groupBy(*PAIR).agg(averaged(F.col("re"), average).alias("re"), averaged(F.col("im"), average).alias("im"))
    return mean.select(*PAIR, (F.col("re") * gain).alias("re"), (F.col("im") * gain).alias("im"))


def with_auto(cross: DataFrame) -> DataFrame:
    """Cross spectra with the power of their input (_in) and output (_out): the pairs of a bin meet in one row, so cross is worked out once."""
    packed = cross.groupBy("frame_id", "freq_idx").agg(F.collect_list(F.struct("out_ch", "in_ch", "re", "im")).alias("_p"))
    own = F.filter("_p", lambda p: p["out_ch"] == p["in_ch"])
    power = F.map_from_arrays(F.transform(own, lambda p: p["out_ch"]), F.transform(own, lambda p: p["re"]))
    each = packed.select("frame_id", "freq_idx", power.alias("_own"), F.explode("_p").alias("_p"))
    return each.select("frame_id", "freq_idx", "_p.*", F.col("_own")[F.col("_p.in_ch")].alias("_in"), F.col("_own")[F.col("_p.out_ch")].alias("_out"))


def coherence(df: DataFrame, n_fft: int = 2048, hop: int | None = None, win_length: int | None = None, win: str = "hann", detrend: str | bool = "constant") -> DataFrame:
    """Magnitude-squared coherence of all ordered pairs: frame_id, out_ch, in_ch, freq_idx, value (NaN without power)."""
    both = with_auto(csd(df, n_fft, hop, win_length, win, detrend))
    power = F.col("_in") * F.col("_out")
    return both.select(*PAIR, F.when(power > 0, (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / F.when(power > 0, power)).otherwise(F.lit(float("nan"))).alias("value"))


def transfer_function(df: DataFrame, n_fft: int = 2048, hop: int | None = None, win_length: int | None = None, win: str = "hann", detrend: str | bool = "constant", scaling: str = "spectrum", average: str = "mean", rate: float = 1.0) -> DataFrame:
    """Output over input of all ordered pairs: the cross spectrum by the input's power, NaN where that is 0 or not finite."""
    both = with_auto(csd(df, n_fft, hop, win_length, win, detrend, scaling, average, rate))
    ok = (F.col("_in") != 0) & ~F.isnan("_in") & (F.abs("_in") != F.lit(float("inf")))
    part = lambda c: F.when(ok, F.col(c) / F.when(ok, F.col("_in"))).otherwise(F.lit(float("nan"))).alias(c)
    return both.select(*PAIR, part("re"), part("im"))


def cepstrum(df: DataFrame, n_fft: int, win: str = "hann", floor: float = 1e-12) -> DataFrame:
    """Real cepstrum: frame_id, channel_id, quef_idx, value."""
    w = window(win, n_fft)
    kernel = lambda x: (np.fft.irfft(np.log(np.maximum(np.abs(_normed(x, n_fft, w)), floor)), n_fft),)
    got = _map(channel_arrays(df, n_fft), list(KEY), kernel, "value array<double>")
    return got.select(*KEY, F.posexplode("value").alias("quef_idx", "value"))


def _normed(x: np.ndarray, n_fft: int, w: np.ndarray) -> np.ndarray:
    full = np.zeros((len(x), n_fft))
    full[:, : x.shape[1]] = x[:, :n_fft]
    return np.fft.rfft(full * w) * one_sided(n_fft) / w.sum()


def cepstrogram(spectra: DataFrame, n_fft: int, floor: float = 1e-12) -> DataFrame:
    """Cepstra of short-time spectra: frame_id, channel_id, frame_idx, quef_idx, value."""
    keys = [*KEY, "frame_idx"]

    def kernel(x: np.ndarray):
        half = x.shape[1] // 2
        return (np.fft.irfft(np.log(np.maximum(np.hypot(x[:, :half], x[:, half:]), floor)), n_fft),)

    got = _map(spectrum_arrays(spectra, keys), keys, kernel, "value array<double>")
    return got.select(*keys, F.posexplode("value").alias("quef_idx", "value"))


def lifter(df: DataFrame, n_fft: int, bins: int, mode: str = "low") -> DataFrame:
    """Keep quefrencies below `bins` and their mirror ("low"), or all others ("high")."""
    near = (F.col("quef_idx") < bins) | (F.col("quef_idx") > n_fft - bins)
    return df.withColumn("value", F.when(near if mode == "low" else ~near, F.col("value")).otherwise(0.0))


def envelope(df: DataFrame, n_fft: int, keys: list[str] | None = None) -> DataFrame:
    """Spectral envelope of symmetric cepstra: frame_id, channel_id[, frame_idx], freq_idx, value."""
    keys = keys or list(KEY)
    packed = df.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("quef_idx", "value"))).alias("_v")).select(*keys, F.transform("_v", lambda s: s["value"]).alias("values"))

    def kernel(x: np.ndarray):
        if x.shape[1] != n_fft or not np.allclose(x[:, 1:], x[:, :0:-1], atol=1e-9):
            raise ValueError("an envelope needs a whole, symmetric cepstrum")
        return (np.exp(np.fft.rfft(x).real),)

    return _map(packed, keys, kernel, "value array<double>").select(*keys, F.posexplode("value").alias("freq_idx", "value"))


def unwrapped_phase(spectrum: DataFrame) -> DataFrame:
    """Phase without jumps along frequency, one short spectrum at a time: frame_id, channel_id, freq_idx, value."""
    got = _map(spectrum_arrays(spectrum, list(KEY)), list(KEY), lambda x: (np.unwrap(np.arctan2(x[:, x.shape[1] // 2 :], x[:, : x.shape[1] // 2]), axis=1),), "value array<double>")
    return got.select(*KEY, F.posexplode("value").alias("freq_idx", "value"))


def frame_at(spectra: DataFrame, frame_idx: int) -> DataFrame:
    return spectra.where(F.col("frame_idx") == frame_idx).drop("frame_idx")


def octave_bands(fmin: float, fmax: float, n: int = 3, g: int = 10, fr: float = 1000.0) -> pd.DataFrame:
    """Fractional-octave bands of base 10 or 2: band_idx, center, low, high."""
    if g not in (2, 10):
        raise ValueError("G is 2 or 10")
    ratio = 2.0 if g == 2 else 10**0.3
    half = 0.0 if n % 2 else 0.5
    low = math.ceil(n * math.log(fmin / fr) / math.log(ratio) - half - 0.5)
    high = math.floor(n * math.log(fmax / fr) / math.log(ratio) - half + 0.5)
    centers = [fr * ratio ** ((k + half) / n) for k in range(low, high + 1)]
    edge = ratio ** (1 / (2 * n))
    return pd.DataFrame([{"band_idx": i, "center": c, "low": c / edge, "high": c * edge} for i, c in enumerate(centers)])


def noct_synthesis(spectrum: DataFrame, rate: float, n_fft: int, bands: pd.DataFrame) -> DataFrame:
    """RMS in each band from a peak-amplitude spectrum: frame_id, channel_id, band_idx, center, value. A bin belongs to the band that its frequency lies in."""
    spark = spectrum.sparkSession
    table = F.broadcast(spark.createDataFrame(bands))  # a few dozen rows
    freq = F.col("freq_idx") * F.lit(rate / n_fft)
    # bands are adjacent, so a bin's band follows from its frequency's logarithm: an equi-join, not a range join
    step = math.log(bands.high.iloc[0] / bands.low.iloc[0])
    idx = F.when(freq > 0, F.floor(F.log(freq / F.lit(float(bands.low.iloc[0]))) / F.lit(step))).cast("long")
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) * _by_bin(1 / one_sided(n_fft))
    joined = spectrum.select(*KEY, idx.alias("band_idx"), power.alias("_p")).join(table.select(F.col("band_idx").cast("long").alias("band_idx"), "center"), "band_idx")
    return joined.groupBy(*KEY, "band_idx", "center").agg(F.sqrt(F.sum("_p")).alias("value"))
