"""Recursive filters and rate changes over blocks.

A filter runs in each block from rest. A block's last state and the decay of the
state over it give the state with which the next block begins; only those states
are gathered for a channel. What a first state adds is linear, so it is added to
each block. Filtering backward is the same with numbers turned round.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import Recursion, butterworth_sections, extension, harmonic_percussive, polyphase, ratio, resample_part, weighting_sections
from ..functions.tables import KEY, blocks, kept, unblock, with_stats
from ..functions.windows import window

BLOCK = 16_384
#: Values of the spectrogram of a block of median separation, without its halo.
SPECTRUM_VALUES = 1 << 19


BLOCKS = "frame_id string, channel_id string, block long, start long, values array<double>"


def recursive(df: DataFrame, b: np.ndarray, a: np.ndarray | None = None, steady: bool = False, block: int = BLOCK) -> DataFrame:
    """Filter every channel in one direction from rest, or (steady) from the state of its first sample held for ever. b alone are second-order sections."""
    return unblock(over_blocks(blocks(df, block), Recursion(b, a), steady))


def over_blocks(packed: DataFrame, system: Recursion, steady: bool = False, backward: bool = False) -> DataFrame:
    """Filter blocks (start, values) of channels; backward begins at the last sample of the last block."""
    d, turn = system.order, slice(None, None, -1 if backward else 1)

    def local(frames):
        for pdf in frames:
            rows = [system.run(np.asarray(v, float)[turn]) for v in pdf["values"]]
            yield pdf.assign(head=[float(v[-1 if backward else 0]) for v in pdf["values"]], values=[y[turn] for y, _ in rows], state=[s for _, s in rows])

    rest = kept(packed.mapInPandas(local, f"{BLOCKS}, head double, state array<double>"))

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block", ascending=not backward)
        s, out = (system.steady * pdf["head"].iloc[0] if steady else np.zeros(d)), []
        decay = powers_of(system)
        for n, end in zip(pdf["len"], pdf["state"]):
            out.append(s)
            s = decay(int(n)) @ s + np.asarray(end, float)
        return pd.DataFrame({"frame_id": pdf["frame_id"], "channel_id": pdf["channel_id"], "block": pdf["block"], "first": out})

    # one row a block: a channel of a thousand million samples has some sixty thousand
    states = rest.select(*KEY, "block", "head", F.size("values").alias("len"), "state").groupBy(*KEY).applyInPandas(chain, "frame_id string, channel_id string, block long, first array<double>")

    def add(frames):
        for pdf in frames:
            yield pdf.assign(values=[np.asarray(v, float) + free(system, np.asarray(s, float), len(v))[turn] for v, s in zip(pdf["values"], pdf["first"])]).drop(columns="first")

    return rest.select(*KEY, "block", "start", "values").join(states, [*KEY, "block"]).mapInPandas(add, BLOCKS)


def powers_of(system: Recursion):
    """What n samples of silence do to a state; worked out once for each n."""
    known: dict[int, np.ndarray] = {}

    def power(n: int) -> np.ndarray:
        if n not in known:
            known[n] = np.linalg.matrix_power(system.step, n) if system.order else np.zeros((0, 0))
        return known[n]

    return power


def free(system: Recursion, state: np.ndarray, n: int) -> np.ndarray:
    """What a first state adds to n outputs."""
    if not system.order or not state.any():
        return np.zeros(n)
    return system.run(np.zeros(n), state)[0]


def zero_phase(df: DataFrame, b: np.ndarray, a: np.ndarray | None = None, block: int = BLOCK) -> DataFrame:
    """Forward and backward with an odd extension of three filter lengths at both ends and steady first states. Channels are longer than that.

    Samples are put into blocks once and stay there for both directions.
    """
    pad, system = extension(b, a), Recursion(b, a)
    ends = df.groupBy(*KEY).agg((F.max("sample_idx") + 1).alias("_n"), F.max_by("value", "sample_idx").alias("_last"), F.min_by("value", "sample_idx").alias("_first"))
    n = F.when(F.col("_n") > pad, F.col("_n")).otherwise(F.raise_error(F.lit("a channel is shorter than the filter's extension")).cast("long"))
    at, x = F.col("sample_idx"), F.col("value")
    put = lambda i, v: F.struct(i.cast("long").alias("i"), v.alias("v"))
    head = F.when((at >= 1) & (at <= pad), put(F.lit(pad) - at, 2 * F.col("_first") - x))
    tail = F.when((at >= n - 1 - pad) & (at <= n - 2), put(2 * n - 2 - at + pad, 2 * F.col("_last") - x))
    wide = df.join(ends, list(KEY)).select(*KEY, F.explode(F.array_compact(F.array(put(at + pad, x), head, tail))).alias("_x")).select(*KEY, F.col("_x.i").alias("sample_idx"), F.col("_x.v").alias("value"))
    both = over_blocks(over_blocks(blocks(wide, block), system, steady=True), system, steady=True, backward=True)
    middle = unblock(both).join(ends.select(*KEY, "_n"), list(KEY)).where((at >= pad) & (at < F.col("_n") + pad))
    return middle.select(*KEY, (at - pad).alias("sample_idx"), "value")


def low_pass(df: DataFrame, cutoff: float, rate: float, order: int = 4) -> DataFrame:
    return zero_phase(df, butterworth_sections(order, "low", cutoff, rate))


def high_pass(df: DataFrame, cutoff: float, rate: float, order: int = 4) -> DataFrame:
    return zero_phase(df, butterworth_sections(order, "high", cutoff, rate))


def band_pass(df: DataFrame, low: float, high: float, rate: float, order: int = 4) -> DataFrame:
    return zero_phase(df, butterworth_sections(order, "band", (low, high), rate))


def frequency_weighting(df: DataFrame, rate: float, curve: str = "A") -> DataFrame:
    """Causal A, B or C weighting from rest; Z leaves samples as they are."""
    return df if curve == "Z" else recursive(df, weighting_sections(curve, rate))


def resample(df: DataFrame, rate: float, target: float, block: int = BLOCK) -> DataFrame:
    """Polyphase rate change: ceil(n * target / rate) samples a channel. Blocks of outputs take the inputs in their filter's reach."""
    up, down = ratio(rate, target)
    if up == down:
        return df
    _, half = polyphase(up, down)
    reach = -(-half // up) + 1
    n = with_stats(df, KEY, _n=F.max("sample_idx") + 1)
    count = F.ceil(F.col("_n") * F.lit(up) / F.lit(down))
    # outputs that an input reaches, as blocks of outputs
    first = F.greatest(F.lit(0), F.floor((F.col("sample_idx") - reach) * up / F.lit(down) / block))
    last = F.least(F.floor((count - 1) / block), F.floor((F.col("sample_idx") + reach) * up / F.lit(down) / block))
    sent = n.where("_n > 0").select(*KEY, "sample_idx", "value", count.alias("_m"), F.explode(F.when(last >= first, F.sequence(first, last))).alias("block"))
    packed = sent.groupBy(*KEY, "block").agg(F.max("_m").alias("_m"), F.array_sort(F.collect_list(F.struct("sample_idx", "value"))).alias("_v"))
    packed = packed.select(*KEY, "block", "_m", F.col("_v")[0]["sample_idx"].alias("start"), F.transform("_v", lambda s: s["value"]).alias("values"))

    def part(frames):
        for pdf in frames:
            firsts = pdf["block"] * block
            out = [resample_part(np.asarray(v, float), int(s), int(f), int(min(f + block, m)), up, down) for v, s, f, m in zip(pdf["values"], pdf["start"], firsts, pdf["_m"])]
            yield pd.DataFrame({"frame_id": pdf["frame_id"], "channel_id": pdf["channel_id"], "start": firsts, "values": out})

    return unblock(packed.mapInPandas(part, "frame_id string, channel_id string, start long, values array<double>"))


def hpss(df: DataFrame, which: str, kernel: int = 31, power: float = 2.0, margin: float = 1.0, n_fft: int = 2048, hop: int | None = None, win_length: int | None = None, win: str = "hann", center: bool = True, pad_mode: str = "constant", block: int | None = None) -> DataFrame:
    """The harmonic or the percussive part by median filtering of the spectrogram.

    A window shorter than n_fft lies in its middle. Centred frames reach over the
    ends, which are padded as pad_mode says; others begin at the first sample, and
    samples past the last whole frame become 0.

    Channels go through blocks (of `block` samples, a halo at least). A sample is
    made of the frames over it, and their masks of half a kernel of frames on either
    side: with a halo of so many samples each block gives what the whole channel
    would give. A halo is longer than a padded end, and only a channel that lies in
    one block can have fewer frames than half a kernel.
    """
    hop = hop or n_fft // 4
    length = win_length or n_fft
    if not 0 < length <= n_fft:
        raise ValueError("a window is as long as a transform at most")
    if pad_mode not in ("constant", "edge", "linear_ramp", "reflect", "symmetric"):
        raise ValueError(f"no padding {pad_mode!r}")
    left = (n_fft - length) // 2
    w = np.pad(window(win, length), (left, n_fft - length - left))
    edge, half = n_fft // 2 if center else 0, kernel // 2
    halo = n_fft + half * hop
    # blocks of four halos, but where frames lie so close that their spectra would be many
    block = max(halo, block or min(max(BLOCK, 4 * halo), hop * SPECTRUM_VALUES // (n_fft // 2 + 1)))

    def split(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                first, begin = row.block * block, row.start - halo
                # a channel that begins late is silent before
                silent = begin - max(0, first - halo)
                values = part_of(np.concatenate([np.zeros(silent), np.asarray(row.values, float)]), begin - silent, first)
                skipped = max(0, begin - first)
                if len(values) > skipped:  # other blocks hold what is another's halo
                    yield pd.DataFrame({"frame_id": [row.frame_id], "channel_id": [row.channel_id], "start": [first + skipped], "values": [values[skipped:]]})

    def part_of(x: np.ndarray, start: int, first: int) -> np.ndarray:
        """Results from sample `first` on, to the block's end or the channel's, of samples x from start. Places count from the first frame's, `edge` before sample 0."""
        n = start + len(x)  # the channel's length, or so far that no frame of the block reaches its end
        begin, end = first + edge, min(first + block, n) + edge
        if begin >= end:
            return np.zeros(0)
        origin = start + edge if start else 0
        wide = np.pad(x, (0 if start else edge, edge), mode=pad_mode)
        wide = np.pad(wide, (0, max(0, n_fft - len(wide))))
        count = 1 + max(0, n + 2 * edge - n_fft) // hop
        lo, hi = max(0, -(-(begin - n_fft + 1) // hop)), min(count - 1, (end - 1) // hop)  # frames over the block
        if lo > hi:
            return np.zeros(end - begin)
        low, high = max(0, lo - half), min(count - 1, hi + half)  # and those that their medians see
        frames = np.lib.stride_tricks.sliding_window_view(wide[low * hop - origin : high * hop + n_fft - origin], n_fft)[::hop]
        spectrum = np.fft.rfft(frames * w).T
        masks = harmonic_percussive(np.abs(spectrum), kernel, power, margin, lo - low, high - hi)
        part = np.fft.irfft((spectrum[:, lo - low : hi - low + 1] * masks[0 if which == "harmonic" else 1]).T, n_fft) * w
        base = min(begin, lo * hop)
        y, norm = np.zeros(max(end, hi * hop + n_fft) - base), np.zeros(max(end, hi * hop + n_fft) - base)
        for i, values in enumerate(part):
            at = (lo + i) * hop - base
            y[at : at + n_fft] += values
            norm[at : at + n_fft] += w * w
        return (y / np.where(norm > 1e-12, norm, 1.0))[begin - base : end - base]

    # numbered from a halo on, so that block b holds samples b * block - halo to (b + 1) * block + halo
    moved = df.select(*KEY, (F.col("sample_idx") + halo).alias("sample_idx"), "value")
    return unblock(blocks(moved, block, after=2 * halo).mapInPandas(split, "frame_id string, channel_id string, start long, values array<double>"))


def noct_spectrum(df: DataFrame, rate: float, bands: pd.DataFrame, order: int = 3, block: int = BLOCK) -> DataFrame:
    """RMS of each channel in fractional-octave bands, by causal band-pass filters: frame_id, channel_id, band_idx, center, value.

    All bands are worked out in one pass over the blocks. A block gives each band
    its sum of squares from rest and how a first state would change it, so that the
    bands' samples are never rows.
    """
    if len(bands) and not (bands["high"] < rate / 2).all():
        raise ValueError(f"bands up to {float(bands['high'].max()):g} Hz need a rate of more than twice that, not {rate:g} Hz")
    systems = [(int(b.band_idx), float(b.center), Recursion(butterworth_sections(order, "band", (b.low, b.high), rate))) for b in bands.itertuples()]

    def local(frames):
        for pdf in frames:
            rows = []
            longest = max((len(v) for v in pdf["values"]), default=0)
            for band, (_, _, system) in enumerate(systems):
                reach = reach_of(system, longest)
                for frame, channel, number, values in zip(pdf["frame_id"], pdf["channel_id"], pdf["block"], pdf["values"]):
                    y, state = system.run(np.asarray(values, float))
                    rows.append((frame, channel, number, len(y), band, float(y @ y), y @ reach[: len(y)], state))
            yield pd.DataFrame(rows, columns=["frame_id", "channel_id", "block", "len", "band", "squares", "mixed", "state"])

    parts = blocks(df, block).mapInPandas(local, "frame_id string, channel_id string, block long, len long, band int, squares double, mixed array<double>, state array<double>")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        idx, center, system = systems[int(pdf["band"].iloc[0])]
        decay, grams = powers_of(system), {}
        s, total = np.zeros(system.order), 0.0
        for n, squares, mixed, state in zip(pdf["len"], pdf["squares"], pdf["mixed"], pdf["state"]):
            if n not in grams:
                reach = reach_of(system, int(n))
                grams[n] = reach.T @ reach
            total += squares + 2 * float(s @ np.asarray(mixed, float)) + float(s @ grams[n] @ s)
            s = decay(int(n)) @ s + np.asarray(state, float)
        value = np.sqrt(max(total, 0.0) / pdf["len"].sum())
        return pd.DataFrame({"frame_id": pdf["frame_id"].iloc[:1], "channel_id": pdf["channel_id"].iloc[:1], "band_idx": [idx], "center": [center], "value": [value]})

    return parts.groupBy(*KEY, "band").applyInPandas(chain, "frame_id string, channel_id string, band_idx long, center double, value double")


def reach_of(system: Recursion, n: int) -> np.ndarray:
    """(n, order): what each part of a first state adds to each of n outputs."""
    return np.stack([free(system, row, n) for row in np.eye(system.order)], 1) if n else np.zeros((0, system.order))
