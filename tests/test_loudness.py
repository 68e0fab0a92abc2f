"""Loudness and sharpness against the standards' steps one by one, and against their anchors."""

import math

import numpy as np
import pytest

from tonespark.frame import PA_REFERENCE
from tonespark.functions import loudness as zwicker
from tonespark.functions.kernels import Recursion, butterworth_sections, section_response
from tonespark.operators import loudness
from tonespark.operators.windowed import smooth_blocks
from tonespark.plans.recipe import Recipe
from tonespark.signal import from_numpy


def tone(hz, db, seconds=1.0):
    return math.sqrt(2) * PA_REFERENCE * 10 ** (db / 20) * np.sin(2 * np.pi * hz * np.arange(int(48_000 * seconds)) / 48_000)


def steady(x, field="free"):
    rms = [[math.sqrt((Recursion(butterworth_sections(3, "band", (b.low, b.high), 48_000.0)).run(x)[0] ** 2).mean())] for b in loudness.bands().itertuples()]
    return zwicker.specific_loudness(zwicker.core_loudness(20 * np.log10(np.maximum(np.array(rms) / PA_REFERENCE, 1e-12)), field))


def walked(core):
    """Specific loudness of one column, in small steps along the Bark axis."""
    step, n, area, at, out = 1e-4, 0.0, 0.0, 0, []
    for i, end in enumerate(zwicker.UPPER + 1e-4):
        while at * step < end - 1e-9:
            if n <= core[i]:
                n = core[i]
            else:
                row = int(np.argmax(zwicker.RANGES < n))
                n = max(core[i], n - step * zwicker.SLOPES[row, min(max(i - 1, 0), 7)])
            at += 1
            area += n * step
            if at % 1000 == 0:
                out.append(n)
    return area, np.array(out[:240])


@pytest.mark.parametrize("seed", range(4))
def test_spread_against_small_steps(seed):
    r = np.random.default_rng(seed)
    core = np.append(r.exponential(3.0, 20) * (r.random(20) < 0.5), 0.0)
    total, specific = zwicker.specific_loudness(core[:, None])
    area, want = walked(core)
    assert total[0] == pytest.approx(area, rel=2e-3, abs=2e-3) and np.allclose(specific[:, 0], want, atol=6e-3)


@pytest.mark.parametrize("db,sone", [(40, 1.0), (50, 2.0), (60, 4.0), (70, 8.0), (80, 16.0)])
def test_loudness_doubles_every_ten_phon(db, sone):
    gains = [abs(section_response(butterworth_sections(3, "band", (b.low, b.high), 48_000.0), [1000.0], 48_000.0)[0]) for b in loudness.bands().itertuples()]
    levels = db + 20 * np.log10(np.maximum(gains, 1e-12))[:, None]  # of a tone without beginning
    assert zwicker.specific_loudness(zwicker.core_loudness(levels))[0][0] == pytest.approx(sone, rel=0.04)


def test_sharpness_anchor():
    noise = Recursion(butterworth_sections(3, "band", (920.0, 1080.0), 48_000.0)).run(np.random.default_rng(0).normal(size=96_000))[0]
    total, specific = steady(noise * PA_REFERENCE * 1000 / np.sqrt((noise**2).mean()))
    assert zwicker.sharpness(total, specific)[0] == pytest.approx(1.0, abs=0.03)
    for w in ("bismarck", "fastl"):  # these differ above 15 Bark only
        assert zwicker.sharpness(total, specific, w)[0] == pytest.approx(1.0, abs=0.03)
    high, low = steady(tone(6000, 60)), steady(tone(200, 60))
    for w in zwicker.WEIGHTINGS:
        assert zwicker.sharpness(*high, w)[0] > 2 * zwicker.sharpness(*low, w)[0]


def test_decay_against_a_loop():
    r = np.random.default_rng(5)
    core = np.repeat(r.exponential(2.0, (2, 6)), 200, axis=1) * np.repeat(r.random((2, 6)) < 0.6, 200, axis=1)
    short, long, var, dt = zwicker.SHORT, zwicker.LONG, zwicker.VARIABLE, 1 / (zwicker.LEVEL_RATE * zwicker.STEPS)

    def slope(u, w):
        """The circuit while its output is above its second state."""
        return -(1 / short + long / (var * short) - 1 / var) * u + (long / (var * short) - 1 / var) * w, (u - w) / var

    def fallen(u, w):
        if u <= w:
            return u * math.exp(-dt / long), None
        k1 = slope(u, w)
        k2 = slope(u + dt / 2 * k1[0], w + dt / 2 * k1[1])
        k3 = slope(u + dt / 2 * k2[0], w + dt / 2 * k2[1])
        k4 = slope(u + dt * k3[0], w + dt * k3[1])
        return (x + dt / 6 * (a + 2 * b + 2 * c + d) for x, a, b, c, d in zip((u, w), k1, k2, k3, k4))

    want = np.empty_like(core)
    for band, x in enumerate(core):
        u = w = 0.0
        for t, v in enumerate(x):
            rise = ((x[t + 1] if t + 1 < len(x) else 0.0) - v) / zwicker.STEPS
            for k in range(zwicker.STEPS):
                here = v + rise * k
                if here >= u:
                    u, w = here, here + (w - here) * math.exp(-dt / var) if here > w else here
                else:
                    u, w = fallen(u, w)
                    u = max(u, here)
                    w = u if w is None else min(w, u)
                if not k:
                    want[band, t] = u
    got = zwicker.decayed(core)
    assert got.shape == core.shape and np.allclose(got, want, atol=1e-8)
    some, more = (zwicker.decayed(np.concatenate([np.zeros((2, k)), core], 1))[:, k:] for k in (10, 1234))
    assert np.allclose(some, more, atol=1e-8)  # stretches begin elsewhere


def test_steady_table(spark):
    x = np.stack([tone(1000, 60), tone(250, 80), np.zeros(48_000)])
    s = from_numpy(spark, x, 48_000.0, channel_labels=["a", "b", "none"], units="Pa")
    free, diffuse = s.loudness_zwst(), s.loudness_zwst("diffuse")
    for label, row in zip("ab", x):
        total, specific = steady(row)
        assert free[label] == pytest.approx(total[0], abs=2e-3)
        assert s.sharpness_din_st()[label] == pytest.approx(zwicker.sharpness(total, specific)[0], abs=1e-3)
    assert diffuse["a"] == pytest.approx(steady(x[0], "diffuse")[0][0], abs=2e-3) != free["a"]
    assert free["none"] == 0 == s.sharpness_din_st("aures")["none"]


def test_loudness_over_time(spark):
    x = np.concatenate([tone(1000, 60, 1.2), np.zeros(24_000), tone(3000, 70, 2.8), np.zeros(30), tone(400, 50, 1.0)])
    s = from_numpy(spark, x, 48_000.0, units="Pa").cache()
    got = s.loudness_zwtv()
    assert got.rate == 500 and got.channels[0].unit == "sone" and got.operation_history[-1] == "loudness_zwtv"
    y = got.to_numpy()
    systems = [(float(b.center), Recursion(butterworth_sections(3, "band", (b.low, b.high), 48_000.0))) for b in loudness.bands().itertuples()]
    total, specific = zwicker.specific_loudness(zwicker.decayed(zwicker.core_loudness(loudness.band_levels(x, systems))))
    want = zwicker.weighted(total, smooth_blocks)[::4][: len(x) // 96]
    assert len(y) == len(x) // 96 and np.allclose(y, want, atol=1e-9)
    assert y[500] == pytest.approx(steady(tone(1000, 60))[0][0], rel=0.03) and y[849] < 0.2 * y[500]
    parts = loudness.varying(s.df, 48_000.0, block=96_000).orderBy("sample_idx").toPandas()
    assert parts["sample_idx"].tolist() == list(range(len(y))) and np.allclose(parts["value"], y, atol=2e-3)
    sharp = Recipe.from_json(Recipe.from_signal(s.sharpness_din("fastl")).to_json()).apply(s).to_numpy()
    assert np.allclose(sharp, zwicker.sharpness(zwicker.weighted(total, smooth_blocks)[::4], specific[:, ::4], "fastl")[: len(y)], atol=1e-9)


def test_odd_input(spark):
    s = from_numpy(spark, tone(1000, 60)[:50], 48_000.0)
    assert s.loudness_zwtv().df.count() == 0
    assert loudness.steady(s.df.limit(0), 48_000.0).count() == 0 == loudness.varying(s.df.limit(0), 48_000.0).count()
    for bad in (lambda: s.loudness_zwtv("none"), lambda: s.sharpness_din("none"), lambda: s.sharpness_din_st("din", "none"), lambda: s.loudness_zwst("none")):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(ValueError):
        zwicker.sharpness(np.ones(1), np.ones((240, 1)), "none")
