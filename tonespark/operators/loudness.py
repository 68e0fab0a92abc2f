"""Loudness (ISO 532-1) and sharpness (DIN 45692) of calibrated sound pressure in pascal.

Band levels come from Butterworth filters of order 3 at 48 kHz; other rates are
changed to that first.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import PA_REFERENCE
from ..functions import loudness as zwicker
from ..functions.kernels import Recursion, butterworth_sections
from ..functions.tables import KEY, blocks, unblock
from .filters import noct_spectrum, resample
from .spectral import octave_bands
from .windowed import smooth_blocks

SOUND_RATE = 48_000.0
#: Samples of a block of time-varying loudness, and samples before it after which filters and decay forget how they began: the slowest pole of the lowest band falls to 1e-11 in that time.
BLOCK, LEAD = 20 * 48_000, 3 * 48_000
#: Smoothing of squared bands: three low-passes with 2 / 3 of a period of the band's center, of 1 kHz above that.
SMOOTHED_UP_TO = 1000.0


def bands() -> pd.DataFrame:
    return octave_bands(25, 12_500)


def check(field: str, weighting: str = "din") -> None:
    if field not in zwicker.FIELDS:
        raise ValueError(f"a field is {' or '.join(zwicker.FIELDS)}, not {field!r}")
    if weighting not in zwicker.WEIGHTINGS:
        raise ValueError(f"a weighting is {', '.join(zwicker.WEIGHTINGS)}, not {weighting!r}")


def steady(df: DataFrame, rate: float, field: str = "free", weighting: str = "din") -> DataFrame:
    """frame_id, channel_id, loudness (sone) and sharpness (acum) of sounds that do not change, from the RMS of 28 bands."""
    check(field, weighting)
    levels = noct_spectrum(resample(df, rate, SOUND_RATE), SOUND_RATE, bands())
    rows = levels.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(F.struct("band_idx", "value"))), lambda s: s["value"]).alias("values"))  # 28 numbers a channel

    def run(frames):
        for pdf in frames:
            if not len(pdf):
                continue
            db = 20 * np.log10(np.maximum(np.stack(pdf["values"].to_list(), 1) / PA_REFERENCE, 1e-12))
            total, specific = zwicker.specific_loudness(zwicker.core_loudness(db, field))
            yield pd.DataFrame({"frame_id": pdf["frame_id"], "channel_id": pdf["channel_id"], "loudness": total, "sharpness": zwicker.sharpness(total, specific, weighting)})

    return rows.mapInPandas(run, "frame_id string, channel_id string, loudness double, sharpness double")


def band_levels(x: np.ndarray, systems: list) -> np.ndarray:
    """(28, n) levels in dB at LEVEL_RATE of samples at SOUND_RATE, from rest."""
    out = []
    for center, system in systems:
        y = system.run(x)[0] ** 2
        keep = np.exp(-1 / (SOUND_RATE * 2 / (3 * min(center, SMOOTHED_UP_TO))))
        for _ in range(3):
            y = smooth_blocks(y, keep)
        out.append(y[:: int(SOUND_RATE) // zwicker.LEVEL_RATE])
    return 10 * np.log10((np.maximum(np.array(out), 0.0) + 1e-12) / PA_REFERENCE**2)


def varying(df: DataFrame, rate: float, what: str = "loudness", field: str = "free", weighting: str = "din", block: int = BLOCK) -> DataFrame:
    """Loudness or sharpness over time, 500 values a second: frame_id, channel_id, sample_idx, value.

    Samples go into blocks with a lead of three seconds, from which filters, decay
    and weighting start at rest; no state goes from block to block.
    """
    check(field, weighting)
    step = int(SOUND_RATE) // zwicker.RATE
    if block % step:
        raise ValueError(f"blocks hold whole results, of {step} samples each")
    systems = [(float(b.center), Recursion(butterworth_sections(3, "band", (b.low, b.high), SOUND_RATE))) for b in bands().itertuples()]
    sound = resample(df, rate, SOUND_RATE)
    n = sound.groupBy(*KEY).agg((F.max("sample_idx") + 1).alias("_n"))
    # a sample serves its block and, as lead, the next one
    packed = blocks(sound, block, before=LEAD).join(n, list(KEY))

    def run(frames):
        for pdf in frames:
            for row in pdf.itertuples(index=False):
                first, end = row.block * block, min((row.block + 1) * block, row[-1])
                lead = min(LEAD, first)
                x = np.zeros(end - first + lead)
                at = row.start - (first - lead)
                v = np.asarray(row.values, float)[max(0, -at) :]
                v = v[: max(0, len(x) - max(at, 0))]
                x[max(at, 0) : max(at, 0) + len(v)] = v
                core = zwicker.decayed(zwicker.core_loudness(band_levels(x, systems), field))
                total, specific = zwicker.specific_loudness(core)
                each = zwicker.LEVEL_RATE // zwicker.RATE
                value = zwicker.weighted(total, smooth_blocks)[::each]
                if what == "sharpness":
                    value = zwicker.sharpness(value, specific[:, ::each], weighting)
                # whole steps only
                value = value[lead // step : lead // step + (end - first) // step]
                yield pd.DataFrame({"frame_id": [row.frame_id], "channel_id": [row.channel_id], "start": [first // step], "values": [value]})

    return unblock(packed.mapInPandas(run, "frame_id string, channel_id string, start long, values array<double>"))
