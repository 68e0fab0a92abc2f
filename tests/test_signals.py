import json
import math
import struct
import tracemalloc
from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tonespark.frame import Channel, Header, LevelReference, check_rate
from tonespark.functions import kernels, tables
from tonespark.functions.windows import tukey, window
from tonespark.operators import filters, spectral, windowed
from tonespark.plans.recipe import Recipe, RecipeError
from tonespark.plans.registry import register_operation
from tonespark.plans.transformers import BandPass, HighPass, LowPass, Normalize, RemoveDC
from tonespark.signal import Signal, from_numpy, generate_sin, load_sample_signal, spectrogram_from_numpy
from tonespark.sources import audio, read
from tonespark.streaming import levels as stream_levels

RATE = 1000.0


@pytest.fixture(scope="module")
def noise():
    return np.random.default_rng(0).normal(size=(2, 900))


@pytest.fixture(scope="module")
def signal(spark, noise):
    return from_numpy(spark, noise, RATE, "noise", ["a", "b"], "Pa").cache()


# ---- kernels ----------------------------------------------------------------------


def direct(b, a, x):
    y = np.zeros(len(x))
    for n in range(len(x)):
        y[n] = sum(b[k] * x[n - k] for k in range(len(b)) if n >= k) - sum(a[k] * y[n - k] for k in range(1, len(a)) if n >= k)
    return y


@pytest.mark.parametrize("kind,cutoff", [("low", 100.0), ("high", 100.0), ("band", (50.0, 200.0))])
def test_butterworth(kind, cutoff):
    b, a = kernels.butterworth(4, kind, cutoff, RATE)
    gains = abs(kernels.response(b, a, np.atleast_1d(cutoff), RATE))
    assert np.allclose(gains, 2**-0.5, atol=1e-9)
    edge = {"low": 1e-9, "high": 500.0, "band": 101.5}[kind]
    assert np.isclose(abs(kernels.response(b, a, [edge], RATE))[0], 1.0, atol=5e-3)
    x = np.random.default_rng(1).normal(size=300)
    assert np.allclose(kernels.Recursion(b, a).run(x)[0], direct(b, a, x), atol=1e-9)


@pytest.mark.parametrize("bad", [0.0, 500.0, 600.0, -1.0])
def test_butterworth_refuses(bad):
    with pytest.raises(ValueError):
        kernels.butterworth(4, "low", bad, RATE)


@settings(max_examples=30, deadline=None)
@given(st.integers(1, 400), st.integers(1, 5), st.integers(0, 5))
def test_recursion_in_parts(n, order, seed):
    r = np.random.default_rng(seed)
    b, a = kernels.butterworth(order, "low", 90.0, RATE)
    x = r.normal(size=n)
    cut = int(r.integers(0, n + 1))
    system = kernels.Recursion(b, a)
    first, state = system.run(x[:cut])
    assert np.allclose(np.concatenate([first, system.run(x[cut:], state)[0]]), system.run(x)[0], atol=1e-10)


def test_weighting_curve():
    b, a = kernels.weighting("A", 48_000)
    assert np.allclose(20 * np.log10(abs(kernels.response(b, a, [100, 1000], 48_000))), [-19.14, 0.0], atol=0.02)
    b, a = kernels.weighting("C", 48_000)
    assert np.isclose(20 * np.log10(abs(kernels.response(b, a, [1000], 48_000)))[0], 0.0, atol=0.02)


def test_windows():
    assert np.allclose(window("hann", 8), 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(8) / 8))
    assert np.allclose(window("hann", 9, periodic=False), np.hanning(9)) and np.allclose(window("hamming", 9, False), np.hamming(9))
    t = tukey(101, 0.4)
    assert np.allclose(t, t[::-1]) and t[0] == 0 and (t[20:81] == 1).all() and (tukey(9, 0) == 1).all()
    assert np.allclose(tukey(21, 1.0), np.hanning(21))
    with pytest.raises(ValueError):
        window("none such", 4)


def test_harmonic_and_percussive_parts():
    x = np.zeros((40, 50))
    x[10] = 1.0
    x[:, 20] = 1.0
    h, p = kernels.harmonic_percussive(x, 11)
    assert h[10, 5] > 0.9 and p[3, 20] > 0.9 and np.allclose((h + p)[x > 0], 1.0)


# ---- signals -----------------------------------------------------------------------------


def test_sine(spark):
    s = generate_sin(spark, [440.0, 880.0], 16_000, 0.25)
    assert np.allclose(list(s.rms().values()), 2**-0.5) and np.allclose(list(s.crest_factor().values()), 2**0.5)
    peak = s.fft().view("magnitude").where("channel_id = 'c1'").orderBy(F.desc("value")).first()
    assert peak.freq_idx * 16_000 / 4000 == 880 and math.isclose(peak.value, 1.0, rel_tol=1e-9)
    w = s.welch(1600).with_axis().where("channel_id = 'c0'").orderBy(F.desc("value")).first()
    assert w.freq_hz == 440 and math.isclose(w.value, 1.0, rel_tol=1e-6)
    assert s.duration() == 0.25 and "Generated Sin" in s.info()


def test_arithmetic_labels_and_calibration(signal, noise):
    c = signal.with_calibration([2.0, 0.5])
    f = np.array([[2.0], [0.5]])
    got = (1 + (c * 3 - signal) / 2) ** 2
    assert np.allclose(got.to_numpy(), (1 + (noise * f * 3 - noise) / 2) ** 2)
    assert [x.factor for x in got.channels] == [1.0, 1.0] and got.labels[0] == "((1 + (((a * 3) - a) / 2)) ** 2)"
    assert np.allclose(c.to_numpy(), noise * f) and np.allclose((2 - signal).to_numpy(), 2 - noise)
    with pytest.raises(TypeError):
        signal + True
    with pytest.raises(ValueError):
        signal + signal.trim(0, 0.1)
    d = signal.derive_calibration(target_level=94.0)
    assert np.allclose(list(d.levels().values()), 94.0)
    with pytest.raises(ValueError):
        signal.derive_calibration()


def test_selection(signal, noise):
    import re

    assert np.allclose(signal["b"].to_numpy(), noise[1]) and np.allclose(signal[["b", "a"]].to_numpy(), noise[::-1])
    assert np.allclose(signal[0, 10:30].to_numpy(), noise[0, 10:30]) and signal[0, 10:30].channels[0].offset == 0.01
    assert signal[re.compile("^b$")].labels == ["b"] and signal[[True, False]].labels == ["a"] and signal[-1].labels == ["b"]
    extra = signal.with_channel_extra("a", sensor="S1")
    assert extra.get_channel({"sensor": "S1"}).labels == ["a"] and extra.get_channel({"unit": "Pa", "sensor": re.compile("S.")}).labels == ["a"]
    assert signal.remove_channel("a").labels == ["b"] and signal.rename_channels({"a": "left"}).labels == ["left", "b"]
    for wrong in ("zz", {"sensor": "none"}):
        with pytest.raises(KeyError):
            signal.get_channel(wrong)
    with pytest.raises(ValueError):
        signal.rename_channels({"a": "b"})


def test_shapes(signal, noise):
    assert np.allclose(signal.fix_length(950).to_numpy(), np.pad(noise, ((0, 0), (0, 50)))) and signal.fix_length(duration=0.1).n_samples() == 100
    assert np.allclose(signal.trim(0.1, 0.2).to_numpy(), noise[:, 100:200])
    assert np.allclose(signal.sum().to_numpy(), noise.sum(0)) and np.allclose(signal.mean().to_numpy(), noise.mean(0))
    assert np.allclose(signal.channel_difference("a").to_numpy(), noise - noise[0])
    assert np.allclose(signal.remove_dc().to_numpy(), noise - noise.mean(1, keepdims=True))
    both = signal.concat_frame(signal, suffix_on_dup="_2")
    assert both.labels == ["a", "b", "a_2", "b_2"] and np.allclose(both.to_numpy(), np.vstack([noise, noise]))
    with pytest.raises(ValueError):
        signal.concat_frame(signal)
    part = signal.trim(0, 0.5)
    assert np.allclose(signal.mix(part["a"], "pad").to_numpy(), noise + np.pad(noise[:1, :500], ((0, 0), (0, 400))))
    with pytest.raises(ValueError):
        signal.mix(part)
    quiet = signal.mix(signal * 0, snr_db=3.0)
    assert np.allclose(quiet.to_numpy(), noise)
    loud = (signal.mix(signal, snr_db=6.0) - signal).rms()
    assert np.allclose(list(loud.values()), np.sqrt((noise**2).mean(1)) / 10**0.3)
    wide = signal.to_dataframe().orderBy("sample_idx").toPandas()
    assert list(wide.columns) == ["frame_id", "sample_idx", "a", "b"] and np.allclose(wide["b"], noise[1])
    assert np.allclose(signal.apply(lambda x: x[::-1]).to_numpy(), noise[:, ::-1])


@pytest.mark.parametrize("norm", [math.inf, -math.inf, 0, 1, 2, 3.5])
@pytest.mark.parametrize("axis", [-1, None])
def test_normalize(signal, noise, norm, axis):
    got = signal.normalize(norm, axis).to_numpy()
    if norm == 0:
        length = (noise != 0).sum(axis, keepdims=True)
    elif math.isinf(norm):
        length = (np.max if norm > 0 else np.min)(abs(noise), axis, keepdims=True)
    else:
        length = (abs(noise) ** norm).sum(axis, keepdims=True) ** (1 / norm)
    assert np.allclose(got, noise / length)


def test_normalize_silence(spark):
    silent = from_numpy(spark, np.zeros((1, 16)), RATE)
    assert (silent.normalize().to_numpy() == 0).all() and np.allclose(silent.normalize(2.0, fill=True).to_numpy(), 0.25)
    assert silent.crest_factor() == {"ch0": 1.0}
    with pytest.raises(ValueError):
        silent.normalize(0, fill=True)


def test_filters_over_blocks(signal, noise, monkeypatch):
    for name, kind, cut in (("low_pass_filter", "low", (100.0,)), ("high_pass_filter", "high", (100.0,)), ("band_pass_filter", "band", (50.0, 200.0))):
        b, a = kernels.butterworth(4, kind, cut if kind == "band" else cut[0], RATE)
        want = np.stack([kernels.zero_phase(b, a, x) for x in noise])
        assert np.allclose(getattr(signal, name)(*cut).to_numpy(), want, atol=1e-9)
    b, a = kernels.butterworth(3, "low", 80.0, RATE)
    got = filters.recursive(signal.df, b, a, block=64).orderBy("channel_id", "sample_idx").toPandas()["value"].to_numpy().reshape(2, -1)
    assert np.allclose(got, np.stack([kernels.Recursion(b, a).run(x)[0] for x in noise]), atol=1e-10)


def test_zero_phase_keeps_a_constant(spark):
    s = from_numpy(spark, np.full((1, 100), 3.0), RATE)
    assert np.allclose(s.low_pass_filter(100.0).to_numpy(), 3.0)
    with pytest.raises(Exception, match="extension"):
        from_numpy(spark, np.ones((1, 10)), RATE).low_pass_filter(100.0).to_numpy()


@pytest.mark.parametrize("target", [500.0, 1500.0, 441.0, 1000.0])
def test_resampling(spark, target):
    t = np.arange(1000) / RATE
    s = from_numpy(spark, np.sin(2 * np.pi * 10 * t)[None], RATE).resampling(target)
    got = s.to_numpy()
    assert len(got) == s.n_samples() == math.ceil(1000 * target / RATE) and s.rate == target
    want = np.sin(2 * np.pi * 10 * np.arange(len(got)) / target)
    assert abs(got - want)[len(got) // 5 : -len(got) // 5].max() < 2e-3


def test_resampling_blocks_agree(signal):
    one = filters.resample(signal.df, RATE, 750.0).orderBy("channel_id", "sample_idx").toPandas()
    many = filters.resample(signal.df, RATE, 750.0, block=50).orderBy("channel_id", "sample_idx").toPandas()
    assert np.allclose(one["value"], many["value"]) and (one["sample_idx"] == many["sample_idx"]).all()


def centered(x, length, hop):
    wide = np.pad(x, length // 2)
    return np.array([np.sqrt((wide[i : i + length] ** 2).mean()) for i in range(0, len(wide) - length + 1, hop)])


@pytest.mark.parametrize("length,hop", [(64, 16), (100, 30), (7, 3), (900, 900)])
def test_rms_trend(signal, noise, length, hop):
    got = signal.rms_trend(length, hop)
    assert np.allclose(got.to_numpy(), np.stack([centered(x, length, hop) for x in noise])) and got.rate == RATE / hop
    db = signal.rms_trend(length, hop, dB=True).to_numpy()
    assert np.allclose(db, 20 * np.log10(np.stack([centered(x, length, hop) for x in noise]) / 2e-5))


@pytest.mark.parametrize("block", [50, 65_536])
def test_sound_level(signal, noise, block):
    alpha = math.exp(-1 / (RATE * 0.125))
    want = np.zeros_like(noise)
    y = np.zeros(2)
    for n in range(noise.shape[1]):
        y = alpha * y + (1 - alpha) * noise[:, n] ** 2
        want[:, n] = np.sqrt(y)
    got = windowed.sound_level(signal.df, RATE, block=block).orderBy("channel_id", "sample_idx").toPandas()["value"].to_numpy().reshape(2, -1)
    assert np.allclose(got, want)
    assert np.allclose(signal.sound_level(dB=True).to_numpy(), 20 * np.log10(want / 2e-5))


def test_triggers_and_cuts(signal, noise):
    def brute(x, level, offset, hold):
        points = [i for i in np.flatnonzero(np.diff(np.sign(x - level)) > 0) if i + hold < len(x)]
        out, last = [], None
        for p in points:
            if last is None or last + hold < p:
                out.append(p + offset)
                last = p
        return out

    rows = signal.level_trigger(0.5, 1, 20).toPandas()
    for c, x in zip(("c0", "c1"), noise):
        assert sorted(rows[rows.channel_id == c].point) == brute(x, 0.5, 1, 20)
    cut = signal.cut_sig(signal.level_trigger(0.5, 1, 20), 16, 0.5, True).toPandas()
    p = brute(noise[0], 0.5, 1, 20)[0]
    part = cut[(cut.channel_id == "c0") & (cut.point == p)].sort_values("place").value
    assert np.allclose(part, (noise[0, p : p + 16] - noise[0, p : p + 16].mean()) * tukey(16, 0.5))
    many = windowed.crossings(signal.df, 0.5, block=7).where("channel_id = 'c0'").toPandas().sample_idx
    assert sorted(many) == np.flatnonzero(np.diff(np.sign(noise[0] - 0.5)) > 0).tolist()


def test_fade(signal, noise):
    assert np.allclose(signal.fade(50).to_numpy(), noise * tukey(900, 100 / 900))
    assert np.allclose(signal.fade(0).to_numpy(), noise)
    with pytest.raises(Exception, match="fade"):
        signal.fade(500).to_numpy()


@pytest.mark.parametrize("n_fft,win,hop,name", [(16, 16, 4, "hann"), (16, 12, 5, "hann"), (15, 15, 7, "hann"), (15, 11, 4, "boxcar"), (64, 64, 16, "hann")])
def test_stft_and_back(signal, noise, n_fft, win, hop, name):
    s = signal.stft(n_fft, hop, win, name)
    assert np.allclose(s.istft().to_numpy(), noise, atol=1e-10)
    assert s.abs().to_numpy().shape[1:] == s.to_numpy().shape[1:]


def test_spectra(signal, noise):
    x = signal.fft(1024).to_numpy()
    w = window("hann", 1024)
    want = np.fft.rfft(np.pad(noise, ((0, 0), (0, 124))) * w) * spectral.one_sided(1024) / w.sum()
    assert np.allclose(x, want)
    assert np.allclose(signal.fft(window="boxcar").ifft().to_numpy(), noise)
    step, win = 64, window("hann", 128)
    segments = np.stack([noise[:, i : i + 128] for i in range(0, 900 - 127, step)])
    spectrum = np.fft.rfft((segments - segments.mean(-1, keepdims=True)) * win)
    scale = spectral.one_sided(128) / win.sum() ** 2
    csd = np.einsum("sif,sof->oif", spectrum.conj(), spectrum) / len(segments) * scale
    got = signal.csd(128, step).df.orderBy("out_ch", "in_ch", "freq_idx").toPandas()
    assert np.allclose((got.re + 1j * got.im).to_numpy().reshape(2, 2, -1), csd)
    auto = np.real(np.stack([csd[0, 0], csd[1, 1]]))
    coherence = signal.coherence(128, step).df.orderBy("out_ch", "in_ch", "freq_idx").toPandas().value.to_numpy().reshape(2, 2, -1)
    assert np.allclose(coherence, abs(csd) ** 2 / (auto[:, None] * auto[None]))
    h = signal.transfer_function(128, step).df.orderBy("out_ch", "in_ch", "freq_idx").toPandas()
    assert np.allclose((h.re + 1j * h.im).to_numpy().reshape(2, 2, -1), csd / auto[None])
    assert signal.csd(128, step).select_pair("c0", "c1").df.count() == 65
    assert math.isclose(spectral.median_bias(3), 1 + 1 / 3 - 1 / 2)


def test_cepstra(signal):
    c = signal.cepstrum(256)
    full = c.to_numpy()
    assert np.allclose(full[:, 1:], full[:, :0:-1])
    low, high = c.lifter(0.02).to_numpy(), c.lifter(0.02, "high").to_numpy()
    assert np.allclose(low + high, full) and (low[:, 20:237] == 0).all()
    size = signal.fft(256).view("magnitude").orderBy("channel_id", "freq_idx").toPandas().value.to_numpy().reshape(2, -1)
    assert np.allclose(c.to_spectral_envelope().to_numpy(), size)
    s = signal.stft(64, 16).cepstrum()
    assert np.allclose(s.to_spectral_envelope().to_numpy(), signal.stft(64, 16).abs().to_numpy(), atol=1e-9)
    with pytest.raises(ValueError):
        c.lifter(0.1, "middle")


def test_views(signal):
    x = signal.fft(128)
    p = x.to_numpy()
    pull = lambda df: df.orderBy("channel_id", "freq_idx").toPandas().value.to_numpy().reshape(2, -1)
    assert np.allclose(pull(x.view("phase")), np.angle(p)) and np.allclose(pull(x.view("power")), abs(p) ** 2)
    assert np.allclose(pull(x.view("dB")), 20 * np.log10(np.maximum(abs(p) / 2e-5, 1e-12)))
    assert np.allclose(pull(x.unwrapped_phase()), np.unwrap(np.angle(p)))
    assert pull(x.view("dBA"))[0, 0] == pytest.approx(pull(x.view("dB"))[0, 0] - 45)


def test_bands(spark):
    bands = spectral.octave_bands(25, 20_000)
    assert len(bands) == 30 and math.isclose(bands.center[16], 1000.0, rel_tol=1e-9) and np.allclose(bands.high[:-1], bands.low[1:])
    s = generate_sin(spark, [1000.0], 48_000, 0.5)
    table = s.fft(window="boxcar").noct_synthesis(100, 10_000).df.orderBy(F.desc("value")).first()
    assert math.isclose(table.center, 1000.0, rel_tol=1e-6) and math.isclose(table.value, 2**-0.5, rel_tol=1e-6)
    top = generate_sin(spark, [1000.0], 8000, 0.5).noct_spectrum(250, 2000, 1).df.orderBy(F.desc("value")).first()
    assert math.isclose(top.center, 1000.0, rel_tol=1e-6) and abs(top.value - 2**-0.5) < 0.03
    with pytest.raises(ValueError):
        spectral.octave_bands(25, 20_000, g=3)


def test_hpss(spark):
    x = np.sin(2 * np.pi * 100 * np.arange(4000) / 8000)
    x[::500] += 5
    s = from_numpy(spark, x[None], 8000.0)
    h, p = s.hpss_harmonic(n_fft=256).to_numpy(), s.hpss_percussive(n_fft=256).to_numpy()
    assert np.allclose(h + p, x, atol=1e-8) and abs(p[500:3500:500]).mean() > 3 and np.abs(h[500:3500:500]).mean() < 2.5


# ---- metadata, files, plans --------------------------------------------------------------------


def test_values_are_checked():
    for bad in (0, -1, math.nan, math.inf, True, "x"):
        with pytest.raises(ValueError):
            check_rate(bad)
    with pytest.raises(ValueError):
        Channel("")
    with pytest.raises(ValueError):
        Channel("c", factor=0)
    with pytest.raises(ValueError):
        Header("time", 1.0, (Channel("c"), Channel("c")))
    assert Channel("c", unit="Pa").ref == 2e-5 and Channel("c", unit="V").with_unit("Pa").ref == 2e-5
    assert LevelReference(2e-5, "Pa").label == "dB SPL" and math.isclose(LevelReference(2e-5, "Pa").level(2.0), 100.0)
    h = Header("time", 8.0, (Channel("c", "l", "Pa", extra={"k": 1}),), {"n": 1}, "x", {"m": [1]})
    assert Header.from_json(h.to_json()) == h


@pytest.mark.parametrize("loud", [0.9, 3.0])
def test_wav_round_trip(spark, tmp_path, noise, loud):
    x = noise / abs(noise).max() * loud
    path = str(tmp_path / "x.wav")
    read.to_wav(from_numpy(spark, x, 8000.0), path)
    s = read.read(spark, path)
    assert s.rate == 8000 and np.allclose(s.to_numpy(), np.clip(x, -1, 32767 / 32768 if loud > 1 else 1), atol=1e-4) and s.channels[0].unit == "FS"
    part = read.read(spark, path, channel=1, start=0.01, end=0.05)
    assert np.allclose(part.to_numpy(), s.to_numpy()[1, 80:400]) and part.channels[0].offset == 0.01
    with open(path, "rb") as f:
        assert np.allclose(read.read(spark, f, channel=[0]).to_numpy(), s.to_numpy()[0])
    with pytest.raises(ValueError):
        read.read(spark, "x.flac")


def test_other_files():
    frames = np.array([[-32768, 0, 16384], [1, 2, -3]], ">i2")
    rate = struct.pack(">HQ", 16383 + 12, int(8000 / 2**12 * 2**63))
    comm = b"COMM" + struct.pack(">IhIh", 18, 2, 3, 16) + rate
    ssnd = b"SSND" + struct.pack(">III", 8 + 12, 0, 0) + frames.T.tobytes()
    data = b"FORM" + struct.pack(">I", 4 + len(comm) + len(ssnd)) + b"AIFF" + comm + ssnd
    meta = audio.info(data)
    assert meta.rate == 8000 and np.allclose(audio.decode(data, meta), frames / 32768)
    au = b".snd" + struct.pack(">IIIII", 24, 12, 3, 8000, 2) + frames.T.tobytes()
    assert np.allclose(audio.decode(au, audio.info(au), 1, 3), frames[:, 1:] / 32768)
    pcm24 = b"RIFF" + struct.pack("<I", 36 + 6) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 24000, 3, 24) + b"data" + struct.pack("<I", 6) + (-8388608).to_bytes(3, "little", signed=True) + (4194304).to_bytes(3, "little")
    assert np.allclose(audio.decode(pcm24, audio.info(pcm24)), [[-1.0, 0.5]])
    pcm8 = b"RIFF" + struct.pack("<I", 39) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", 3) + bytes([0, 128, 192])
    assert np.allclose(audio.decode(pcm8, audio.info(pcm8)), [[-1.0, 0.0, 0.5]])
    for bad in (b"", b"fLaC1234567890", b"RIFF0000WAVE"):
        with pytest.raises(ValueError):
            audio.info(bad)


@pytest.mark.parametrize("name,options", [("rms_trend", {"frame_length": 64, "hop_length": 16}), ("rms_trend", {"frame_length": 64, "hop_length": 16, "Aw": True}), ("sound_level", {"freq_weighting": "C"})])
def test_levels_of_extreme_values(spark, noise, name, options):
    factors, two = (1.0, 1e200, 1e-200, 0.0), noise[:, :200]
    x = np.concatenate([two * f for f in factors])
    s = from_numpy(spark, x, 48_000.0)
    level = lambda **more: getattr(s, name)(**options, **more).to_numpy().reshape(4, 2, -1)
    plain, wide, db, plain_db = level(), level(wide_range=True), level(dB=True, wide_range=True), level(dB=True)
    same, _ = windowed.scaled(s.df.where("channel_id IN ('c0', 'c1')"))
    assert np.array_equal(Signal(same, replace(s.header, channels=s.channels[:2])).to_numpy(), two)
    assert np.allclose(wide[0], plain[0], rtol=1e-12) and np.allclose(db[0], plain_db[0], atol=1e-9)  # sums in another order
    assert not np.isfinite(plain[1]).all() and (plain[2] == 0).any()
    least = -240 if name == "rms_trend" else -200
    for k, f in enumerate(factors[:3]):
        assert np.allclose(wide[k] / f, plain[0], rtol=1e-9)
        assert np.allclose(db[k], np.maximum(20 * np.log10(plain[0]) + 20 * math.log10(f), least), atol=1e-6)
    assert (wide[3] == 0).all() and (db[3] == least).all()
    pascal = Signal(s.df, Header("time", 48_000.0, tuple(Channel(c.id, c.label, "Pa") for c in s.channels)), n=200)
    assert np.allclose(getattr(pascal, name)(**options, dB=True, wide_range=True).to_numpy().reshape(4, 2, -1)[1], db[1] - 20 * math.log10(2e-5), atol=1e-6)


def test_ranges_are_read_by_parts(spark, tmp_path, monkeypatch):
    x = np.random.default_rng(2).uniform(-0.9, 0.9, (3, 150_000)).astype(np.float32).astype(float)
    names = [str(tmp_path / n) for n in ("x.wav", "a b.wav", "50%41.wav")]
    for n in names:
        with open(n, "wb") as f:
            f.write(audio.wav_bytes(x, 8000))
    plain, spaced, escaped = names
    assert read.header_of(f"file:{plain}", 44 + x.size * 4) == audio.info(audio.wav_bytes(x, 8000)) and read.header_of(f"file:{escaped}", 1) is None
    whole = read.read(spark, plain)
    assert np.array_equal(whole.to_numpy(), x) and whole.df.rdd.getNumPartitions() > 1
    for n in names:
        part = read.read(spark, n, start=1.5, end=17.25, channel=[2, 0])
        assert np.array_equal(part.to_numpy(), x[[2, 0], 12_000:138_000]) and part.channels[0].offset == 1.5 and part.n_samples() == 126_000
    assert read.read(spark, plain, start=4.0, end=4.0).df.count() == 0 == read.read(spark, plain, start=99.0).n_samples()
    monkeypatch.setattr(read, "header_of", lambda path, length: None)  # a store that Arrow does not reach
    assert np.array_equal(read.read(spark, plain, start=1.5, end=17.25).to_numpy(), x[:, 12_000:138_000])
    with pytest.raises(ValueError):
        read.read(spark, plain, channel=3)


def test_urls(spark, noise):
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    wav = audio.wav_bytes(noise / 10, 8000)
    table = b"time,ch1\n" + b"".join(b"%.2f,%d\n" % (i / 100, i) for i in range(50))

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            name, _, how = self.path.partition("?")
            body = {"/x.wav": wav, "/t.csv": table, "/plain": wav}.get(name)
            self.send_response(200 if body else 404)
            if how != "silent":
                self.send_header("Content-Length", {"odd": "many", "short": str(len(wav) + 9)}.get(how, str(len(body or b""))))
            self.end_headers()
            self.wfile.write(body or b"")

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_port}"
    try:
        s = read.read(spark, f"{at}/x.wav", start=0.05)
        assert np.allclose(s.to_numpy(), noise[:, 400:] / 10, atol=1e-7) and s.header.label == "x.wav" and s.channels[0].offset == 0.05
        assert np.array_equal(read.read(spark, f"{at}/t.csv").to_numpy(), np.arange(50)) and read.read(spark, f"{at}/t.csv").rate == 100
        assert read.read(spark, f"{at}/plain", file_type=".wav", max_bytes=len(wav)).n_samples() == noise.shape[1]
        assert read.read(spark, f"{at}/x.wav?silent", max_bytes=len(wav)).n_samples() == noise.shape[1]
        for bad, limit in (("x.wav", len(wav) - 1), ("x.wav?silent", len(wav) - 1), ("x.wav?odd", 10**9), ("x.wav?short", 10**9), ("none.wav", 10**9)):
            with pytest.raises(OSError):
                read.read(spark, f"{at}/{bad}", max_bytes=limit)
        for bad in ("plain", "x.mp3"):
            with pytest.raises(ValueError):
                read.read(spark, f"{at}/{bad}")
        with pytest.raises(ValueError):
            read.read(spark, f"{at}/x.wav", max_bytes=0)
    finally:
        server.shutdown()
        server.server_close()


def test_csv(spark, tmp_path):
    t = np.arange(100) * 0.01 + 5
    pd.DataFrame({"time": t, "ch1": np.sin(t), "ch2": np.cos(t)}).to_csv(tmp_path / "x.csv", index=False)
    s = read.read(spark, str(tmp_path / "x.csv"))
    assert s.rate == 100 and s.labels == ["ch1", "ch2"] and np.allclose(s.to_numpy(), [np.sin(t), np.cos(t)])
    p = read.read(spark, str(tmp_path / "x.csv"), time_column="time", channel=1, start=0.2, end=0.5)
    assert np.allclose(p.to_numpy(), np.cos(t[20:50])) and math.isclose(p.channels[0].offset, 5.2)
    same = read.read(spark, (tmp_path / "x.csv").read_bytes(), file_type=".csv")
    assert np.allclose(same.to_numpy(), s.to_numpy())
    pd.DataFrame({"time": t, "ch1": ["x"] * 100}).to_csv(tmp_path / "y.csv", index=False)
    with pytest.raises(ValueError):
        read.read(spark, str(tmp_path / "y.csv"))


def test_folders(spark, tmp_path):
    for i, (kind, split) in enumerate([("fan", "train"), ("fan", "test"), ("pump", "train")]):
        d = tmp_path / f"kind={kind}" / f"split={split}"
        d.mkdir(parents=True)
        (d / f"section_{i}.wav").write_bytes(audio.wav_bytes(np.full((1, 256), 0.1 * (i + 1)), 8000))
    every = read.from_folder(spark, str(tmp_path), recursive=True, use_path_metadata=True)
    assert len(every.paths()) == 3 and every.get_metadata()["files"] == 3
    fans = every.select(kind="fan")
    assert len(fans.paths()) == 2 and len(every.select(kind="fan", split="test").paths()) == 1
    rms = fans.trim(0.0, 0.01).read().df.groupBy("frame_id").agg(F.max("value").alias("v"), F.count("value").alias("n")).collect()
    assert sorted(round(r.v, 3) for r in rms) == [0.1, 0.2] and {r.n for r in rms} == {80}
    assert len(every.sample(2, seed=1).paths()) == 2 and every.sample(2, seed=1).paths() == every.sample(2, seed=1).paths()
    assert len(every.get_by_label("section_1.wav").paths()) == 1
    with pytest.raises(KeyError):
        every.select(colour="red")
    (tmp_path / "kind=fan" / "split=train" / "bad.wav").write_bytes(b"nothing")
    with pytest.raises(ValueError):
        read.from_folder(spark, str(tmp_path), recursive=True, use_path_metadata=True).read()
    assert read.from_folder(spark, str(tmp_path), recursive=True).read("permissive").df.select("frame_id").distinct().count() == 3
    with pytest.raises(ValueError):
        read.from_folder(spark, str(tmp_path), metadata_resolver=lambda p: {}, use_path_metadata=True)


def test_long_recordings_are_dealt_to_tasks(spark, tmp_path):
    long, short = np.random.default_rng(4).uniform(-0.9, 0.9, (2, 150_000)).astype("<f4").astype(float), np.full((2, 7), 0.5)
    for name, x in (("a.wav", long), ("b c.wav", short), ("d.wav", np.zeros((2, 0)))):
        (tmp_path / name).write_bytes(audio.wav_bytes(x, 8000))
    every = read.from_folder(spark, str(tmp_path))
    s = every.read()
    ids = {i.rpartition("/")[2]: i for i in every.paths()}
    assert np.array_equal(s.to_numpy(ids["a.wav"]), long) and np.array_equal(s.to_numpy(ids["b c.wav"]), short)
    assert s.df.select("frame_id").distinct().count() == 2
    metas = read._probe_all(spark.read.format("binaryFile").load(str(tmp_path))).orderBy("path").collect()
    assert [(m.frames, m.offset) for m in metas] == [(150_000, 44), (7, 44 if metas[1].offset else None), (0, 44)]
    (tmp_path / "e.wav").write_bytes(audio.wav_bytes(np.zeros((1, 9)), 8000))
    with pytest.raises(ValueError):
        read.from_folder(spark, str(tmp_path)).read()
    assert read.from_folder(spark, str(tmp_path)).read("permissive").df.select("frame_id").distinct().count() == 2


def test_save_and_load(spark, tmp_path, signal, noise):
    path = str(tmp_path / "stored")
    read.save(signal.with_calibration([2.0, 1.0]), path)
    back = read.load(spark, path)
    assert back.channels[0].factor == 2.0 and back.labels == ["a", "b"] and np.allclose(back.to_numpy(), noise * [[2.0], [1.0]])
    with pytest.raises(Exception, match="(?i)exist"):
        read.save(signal, path)
    read.save(signal, path, overwrite=True)
    assert read.load(spark, path).channels[0].factor == 1.0


def test_recipes(spark, signal, tmp_path):
    made = ((signal.remove_dc() * 2 + signal.normalize(math.inf)).low_pass_filter(100.0)).rms_trend(64, 16)
    plan = Recipe.from_signal(made)
    plan.save(str(tmp_path / "p.json"))
    again = Recipe.load(str(tmp_path / "p.json"))
    assert again == plan and [n.operation for n in plan.nodes] == ["remove_dc", "mul", "normalize", "add", "low_pass_filter", "rms_trend"]
    assert np.allclose(again.apply(signal).to_numpy(), made.to_numpy()) and made.operation_history[-1] == "rms_trend"
    other = from_numpy(spark, np.random.default_rng(8).normal(size=(2, 400)), RATE, "noise")
    assert again.apply({"noise": other}).n_channels == 2
    for broken in (json.dumps({**json.loads(plan.to_json()), "schema": 9}), json.dumps({**json.loads(plan.to_json()), "output": "n99"})):
        with pytest.raises(RecipeError):
            Recipe.from_json(broken)
    with pytest.raises(RecipeError):
        Recipe.from_signal(signal.apply(lambda x: x))
    with pytest.raises(RecipeError):
        again.apply({"other": signal})
    if "twice" not in __import__("tonespark.plans.registry", fromlist=["REGISTRY"]).REGISTRY:
        register_operation("twice", lambda s, times=2.0: s * times)
    from tonespark.plans.registry import get_operation

    assert np.allclose(Recipe.from_signal(get_operation("twice")(signal, times=3.0)).apply(signal).to_numpy(), signal.to_numpy() * 3)


def test_transformers(signal, noise, tmp_path):
    from pyspark.ml import PipelineModel

    stages = [RemoveDC(), HighPass(rate=RATE, cutoff=20.0), Normalize(norm=2.0)]
    got = PipelineModel(stages).transform(signal.df)
    want = signal.remove_dc().high_pass_filter(20.0).normalize(2.0).to_numpy()
    for one in (LowPass(rate=RATE, cutoff=200.0), BandPass(rate=RATE, low=30.0, high=150.0, order=2)):
        assert one.transform(signal.df).columns == signal.df.columns
    pdf = got.orderBy("channel_id", "sample_idx").toPandas()
    assert np.allclose(pdf.value.to_numpy().reshape(2, -1), want)
    stages[1].save(str(tmp_path / "hp"))
    assert HighPass.load(str(tmp_path / "hp")).getOrDefault("cutoff") == 20.0


def test_streams(spark, tmp_path):
    rows = [(f"c{i % 2}", datetime(2024, 1, 1) + timedelta(seconds=i), float(i % 5)) for i in range(300)]
    spark.createDataFrame(rows, "channel string, ts timestamp, value double").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("channel string, ts timestamp, value double").parquet(str(tmp_path / "in"))
    q = stream_levels.rms_windows(stream, "channel", "ts", "value", "1 minute").writeStream.outputMode("update").format("memory").queryName("rms_w").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.channel_id, r.start.minute): r.rms for r in spark.sql("SELECT * FROM rms_w").collect()}
    batch = {(r.channel_id, r.start.minute): r.rms for r in stream_levels.rms_windows(spark.read.parquet(str(tmp_path / "in")), "channel", "ts", "value").collect()}
    assert got == batch and len(got) == 10
    q = stream_levels.time_weighted(stream, "channel", "ts", "value", tau=2.0).writeStream.outputMode("append").format("memory").queryName("tw").start()
    q.processAllAvailable()
    q.stop()
    level = {(r.channel_id, r.ts): r.level for r in spark.sql("SELECT * FROM tw").collect()}
    y, decay = 0.0, math.exp(-1.0)
    for i in range(0, 300, 2):
        y = (decay if i else 0.0) * y + (1 - (decay if i else 0.0)) * (i % 5) ** 2
    assert math.isclose(level[max(k for k in level if k[0] == "c0")], math.sqrt(y), rel_tol=1e-9)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.floats(0, 1e6)), max_size=70), st.floats(0, 1e6))
def test_smoothed(rows, first):
    decay, x = (np.array([r[i] for r in rows], float) for i in (0, 1))
    y, want = first, []
    for d, v in rows:
        y = d * y + (1 - d) * v
        want.append(y)
    assert np.allclose(stream_levels.smoothed(decay, x, first), want, rtol=1e-9, atol=1e-9)


# ---- filters at high rates, spectra, pairs ------------------------------------------------------


def test_sections_equal_polynomials():
    x = np.random.default_rng(1).normal(size=500)
    for kind, cut in (("low", 100.0), ("high", 100.0), ("band", (50.0, 200.0))):
        for order in (1, 2, 3, 4, 5):
            sos, (b, a) = kernels.butterworth_sections(order, kind, cut, RATE), kernels.butterworth(order, kind, cut, RATE)
            assert kernels.extension(sos) == kernels.extension(b, a)
            assert np.allclose(kernels.Recursion(sos).run(x)[0], kernels.Recursion(b, a).run(x)[0], atol=1e-9)
            assert np.allclose(kernels.zero_phase(sos, None, x), kernels.zero_phase(b, a, x), atol=1e-8)


@pytest.mark.parametrize("rate", [48_000, 96_000, 192_000, 300_000])
def test_a_weighting_at_high_rates(rate):
    impulse, freq = np.zeros(2 * rate), np.array([31.5, 63, 125, 250, 500, 1000, 2000, 4000])
    impulse[0] = 1
    y = kernels.Recursion(kernels.weighting_sections("A", rate)).run(impulse)[0]
    got = [20 * np.log10(abs((y * np.exp(-2j * np.pi * f * np.arange(len(y)) / rate)).sum())) for f in freq]
    s, corners = 2j * np.pi * np.append(freq, 1000.0), np.array(kernels.CORNERS["A"])
    want = 20 * np.log10(abs(s**4 / np.prod(s[:, None] + 2 * np.pi * corners, axis=1)))
    assert np.allclose(got, want[:-1] - want[-1], atol=0.3 if rate == 48_000 else 0.1)


def test_band_pass_and_bands_at_48_khz(spark, noise):
    t = np.arange(24_000) / 48_000
    y = from_numpy(spark, np.sin(2 * np.pi * 100 * t)[None], 48_000).band_pass_filter(50, 200).to_numpy()
    assert np.isfinite(y).all() and abs(abs(y[8000:16000]).max() - 1) < 0.01
    bands = spectral.octave_bands(25, 20_000)
    x = np.sum([np.sin(2 * np.pi * c * np.arange(192_000) / 48_000) for c in bands.center[[0, 9, 17, 29]]], axis=0)
    got = filters.noct_spectrum(from_numpy(spark, x[None], 48_000.0).df, 48_000.0, bands).orderBy("band_idx").toPandas()
    assert len(got) == 30
    for i, b in bands.iterrows():
        want = np.sqrt(np.mean(kernels.Recursion(kernels.butterworth_sections(3, "band", (b.low, b.high), 48_000.0)).run(x)[0] ** 2))
        assert math.isclose(got["value"][i], want, rel_tol=1e-6)
    assert np.allclose(got["value"][[9, 17, 29]], 2**-0.5, rtol=0.02)
    with pytest.raises(ValueError, match="rate"):
        from_numpy(spark, x[None], 16_000.0).noct_spectrum()


def test_spectral_arithmetic_and_guards(signal, noise):
    x = signal.fft(64)
    z = pull(x, "c")
    y = signal.fft(64, "boxcar")
    assert np.allclose(pull(x + x * 2, "c"), 3 * z) and np.allclose(pull((1 + 2j) * x, "c"), (1 + 2j) * z)
    assert np.allclose(pull(x / (x + 5), "c"), z / (z + 5)) and np.allclose(pull(x**2, "c"), z**2) and (x + x).labels[0] == "(fft(a) + fft(a))"
    for bad in (lambda: x + y, lambda: x + signal, lambda: signal.csd(64) + 1, lambda: x.remove_dc(), lambda: x.normalize()):
        with pytest.raises(ValueError):
            bad()
    assert np.allclose((np.float64(2) * signal).to_numpy(), 2 * noise) and np.allclose((np.int64(2) - signal).to_numpy(), 2 - noise)
    assert np.allclose((signal * np.arange(noise.shape[1])).to_numpy(), noise * np.arange(noise.shape[1]))
    with pytest.raises(TypeError):
        np.arange(3) * signal


def pull(s, kind=None):
    pdf = s.df.orderBy("channel_id", "freq_idx").toPandas()
    return (pdf["re"] + 1j * pdf["im"]).to_numpy() if kind else pdf


def test_added_channels(spark, signal, noise):
    n = noise.shape[1]
    s = signal.add_channel(np.arange(n), "ramp", source_time_offset=0.5)
    assert s.labels == ["a", "b", "ramp"] and np.allclose(s.to_numpy(), np.vstack([noise, np.arange(n)])) and s.channels[2].offset == 0.5
    assert np.allclose(signal.add_channel(np.ones((1, 5)), align="pad").to_numpy()[2], np.r_[np.ones(5), np.zeros(n - 5)])
    assert signal.add_channel(np.ones(n + 5), "a", "truncate", suffix_on_dup="2").labels[2] == "a2"
    for bad in (lambda: signal.add_channel(np.ones(5)), lambda: signal.add_channel(np.ones(n), "a"), lambda: signal.add_channel(np.ones((2, n)))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        signal.add_channel(signal)
    assert from_numpy(spark, np.ones((1, 1)), RATE).n_samples() == 1 and Signal(from_numpy(spark, np.ones((1, 1)), RATE).df, signal.header).n_samples() == 1


def test_pairs(signal):
    c = signal.csd(64, scaling="density")
    assert [(p.output.id, p.input.id) for p in c.pairs] == [("c0", "c0"), ("c0", "c1"), ("c1", "c0"), ("c1", "c1")]
    one = c.select_pair("c1", 0)
    assert one.df.select("out_ch", "in_ch").distinct().collect() == [("c1", "c0")] and one.pair_at(-1) == c.get_pair(2) == c.pairs[c.pair_row_index(1, "c0")]
    assert c.select_pairs([3, 0]).df.count() == 66 and [p.output.id for p in c.select_pairs([3, 0]).pairs] == ["c1", "c0"]
    for bad, error in ((lambda: c.select_pair("a", "b"), KeyError), (lambda: one.pair_row_index(0, 0), KeyError), (lambda: c.pair_at(4), IndexError), (lambda: c.pair_at(True), TypeError), (lambda: c.select_pairs([]), ValueError)):
        with pytest.raises(error):
            bad()


def test_slices_replay(signal, noise):
    plan = Recipe.from_json(Recipe.from_signal(signal[:, 10:50].rename_channels({0: "first"}).astype("float64")).to_json())
    again = plan.apply(signal)
    assert np.allclose(again.to_numpy(), noise[:, 10:50]) and again.labels[0] == "first"


def test_spectrogram_of_an_array(spark, signal, noise):
    x = signal.stft(64, 16)
    got = x.to_numpy()
    back = spectrogram_from_numpy(spark, got.transpose(0, 2, 1), RATE, 64, 16)
    assert np.allclose(back.to_numpy(), got)
    y = back.istft().to_numpy()
    n = min(y.shape[1], noise.shape[1])
    assert n > noise.shape[1] - 64 and np.allclose(y[:, : n - 64], noise[:, : n - 64], atol=1e-9)


@pytest.mark.parametrize("size", [16, 100])
def test_frames_across_blocks(signal, monkeypatch, size):
    one = signal.stft(64, 24).to_numpy()
    monkeypatch.setattr(spectral, "BLOCK", size)
    monkeypatch.setattr(spectral, "FRAME_VALUES", 128)
    assert np.allclose(signal.stft(64, 24).to_numpy(), one, atol=1e-12)


def test_folders_of_both_kinds(spark, tmp_path):
    for place in ("kind=fan/train", "kind=pump/test"):
        (tmp_path / "good" / place).mkdir(parents=True)
        (tmp_path / "good" / place / "x.wav").write_bytes(b"x")
    found = read.from_folder(spark, str(tmp_path / "good"), recursive=True, use_path_metadata=True)
    assert sorted((r.meta["kind"], r.meta["partition_1"]) for r in found.metadata_table().collect()) == [("fan", "train"), ("pump", "test")]
    assert len(found.sample(0).paths()) == 1 and found.select(kind="fan").metadata_table().first().frame_id.endswith("train/x.wav")
    for k, place in enumerate(("name=a", "partition_0=b", "k=a/k=b")):
        (tmp_path / str(k) / place).mkdir(parents=True)
        (tmp_path / str(k) / place / "x.wav").write_bytes(b"x")
        with pytest.raises(Exception, match="reserved|plain folders|twice"):
            read.from_folder(spark, str(tmp_path / str(k)), recursive=True, use_path_metadata=True).metadata_table().collect()


def test_mix_refuses_equal_lengths_to_align(signal):
    for align in ("pad", "truncate"):
        with pytest.raises(ValueError):
            signal.mix(signal, align)


def test_many_channels_join_their_values(spark):
    x = np.arange(60.0).reshape(20, 3)
    s = from_numpy(spark, x, RATE).with_calibration([float(i + 1) for i in range(20)])
    assert np.allclose((s + 0).to_numpy(), x * np.arange(1, 21)[:, None])
    assert np.allclose((s + s).to_numpy(), 2 * x * np.arange(1, 21)[:, None])


# ---- repeated channels, options of median separation, tables to draw, collections by number -----


def test_repeated_channels(signal, noise):
    s = signal[[1, 0, 1, 1]]
    assert s.labels == ["b", "a", "b", "b"] and [c.id for c in s.channels] == ["c1", "c0", "c1.1", "c1.2"] and len({c.unit for c in s.channels}) == 1
    assert np.array_equal(s.to_numpy(), noise[[1, 0, 1, 1]])
    again = s.get_channel([0, 2, 0])  # a suffix that is taken is passed over
    assert [c.id for c in again.channels] == ["c1", "c1.1", "c1.2"] and np.array_equal(again.to_numpy(), noise[[1, 1, 1]])
    assert np.array_equal(Recipe.from_signal(s).apply(signal).to_numpy(), s.to_numpy())
    with pytest.raises(ValueError):
        signal.csd(64).get_channel([0, 0])


def test_precision(signal):
    z = signal.fft(64)
    assert dict(z.astype("complex64").df.dtypes)["re"] == "float" and dict(z.astype("complex128").df.dtypes)["im"] == "double"
    assert dict(signal.astype("float32").df.dtypes)["value"] == "float"
    for s, dtype in ((z, "float32"), (signal, "complex64"), (signal, "int16")):
        with pytest.raises(ValueError):
            s.astype(dtype)


@pytest.mark.parametrize("options", [{"win_length": 200}, {"center": False}, {"pad_mode": "reflect"}, {"win_length": 128, "center": False, "hop_length": 32}])
def test_hpss_options(spark, options):
    x = np.sin(2 * np.pi * 100 * np.arange(4000) / 8000)
    x[::500] += 5
    s = from_numpy(spark, x[None], 8000.0)
    h, p = (getattr(s, f"hpss_{w}")(n_fft=256, **options).to_numpy() for w in ("harmonic", "percussive"))
    inside = slice(300, 3700)  # without centring, the ends lie under one window's edge alone
    assert len(h) == len(p) == 4000 and np.allclose((h + p)[inside], x[inside], atol=1e-8)
    assert not np.allclose(h, s.hpss_harmonic(n_fft=256).to_numpy())


def plain_hpss(x, which, kernel, n_fft, hop, win_length, center, pad_mode):
    """Median separation of a whole channel at once."""
    before = (n_fft - win_length) // 2
    w, edge = np.pad(window("hann", win_length), (before, n_fft - win_length - before)), n_fft // 2 if center else 0
    wide = np.pad(x, edge, mode=pad_mode)
    places = np.arange(0, len(wide) - n_fft + 1, hop)[:, None] + np.arange(n_fft)
    spectrum = np.fft.rfft(wide[places] * w).T
    part = np.fft.irfft((spectrum * kernels.harmonic_percussive(abs(spectrum), kernel)[which == "percussive"]).T, n_fft) * w
    y, norm = np.zeros(len(wide)), np.zeros(len(wide))
    for at, values in zip(places, part):
        y[at] += values
        norm[at] += w * w
    return (y / np.where(norm > 1e-12, norm, 1.0))[edge : edge + len(x)]


@pytest.mark.parametrize("which", ["percussive", "harmonic"])
@pytest.mark.parametrize("options", [(31, 64, 16, 64, True, "constant"), (7, 64, 16, 48, True, "reflect"), (31, 32, 32, 32, False, "edge"), (5, 32, 7, 32, True, "linear_ramp")])
def test_hpss_by_blocks(spark, monkeypatch, which, options):
    """Channels go through blocks, none of which holds more than it has to, and give what whole channels give; the ends of channels and blocks fall in all places."""
    kernel, n_fft, hop, win_length, center, pad_mode = options
    rng, halo = np.random.default_rng(5), n_fft + kernel // 2 * hop
    channels = {f"c{n}": rng.exponential(50, n) for n in (1, 40, halo + 1, 3 * 700, 3 * 700 + 1, 2900)}
    channels["c1"] = channels["c1"] if pad_mode != "reflect" else rng.exponential(50, 2)
    rows = spark.createDataFrame([("r", c, i, float(v)) for c, x in channels.items() for i, v in enumerate(x) if center or len(x) >= n_fft], "frame_id string, channel_id string, sample_idx long, value double")
    parts = []
    monkeypatch.setattr(filters, "unblock", lambda df: parts.append(df) or tables.unblock(df))
    got = filters.hpss(rows, which, kernel, 2.0, 1.0, n_fft, hop, win_length, "hann", center, pad_mode, block=700).toPandas()
    assert max(r[0] for r in parts[0].select(F.size("values")).collect()) <= 700
    assert not got.duplicated(["channel_id", "sample_idx"]).any() and len(got) == rows.count()
    for c, g in got.groupby("channel_id"):
        assert np.allclose(g.sort_values("sample_idx")["value"], plain_hpss(channels[c], which, kernel, n_fft, hop, win_length, center, pad_mode), rtol=0, atol=1e-10), c


@pytest.mark.parametrize("which", ["percussive", "harmonic"])
def test_hpss_of_long_channels(spark, monkeypatch, which):
    """Without a word on blocks, the rows do not grow with the channel."""
    parts = []
    monkeypatch.setattr(filters, "unblock", lambda df: parts.append(df) or tables.unblock(df))
    rows = spark.range(50_000).select(F.lit("r").alias("frame_id"), F.lit("c").alias("channel_id"), F.col("id").alias("sample_idx"), F.sin(F.col("id") * F.col("id") / 1000).alias("value"))
    got = filters.hpss(rows, which, n_fft=64).toPandas().sort_values("sample_idx")
    sizes = [r[0] for r in parts[0].select(F.size("values")).collect()]
    assert sum(sizes) == 50_000 and max(sizes) <= filters.BLOCK
    x = np.sin(np.arange(50_000) ** 2 / 1000)
    assert got["sample_idx"].tolist() == list(range(50_000)) and np.allclose(got["value"], plain_hpss(x, which, 31, 64, 16, 64, True, "constant"), atol=1e-8)


def test_hpss_of_late_channels(spark):
    """Samples keep their numbers; a channel that begins late is silent before."""
    x = np.random.default_rng(6).normal(size=900)
    rows = lambda lo: spark.createDataFrame([("r", "c", i, float(v)) for i, v in enumerate(x) if i >= lo], "frame_id string, channel_id string, sample_idx long, value double")
    got = filters.hpss(rows(450), "harmonic", 5, n_fft=32, block=100).orderBy("sample_idx").toPandas()
    assert got["sample_idx"].tolist() == list(range(450, 900)) and np.allclose(got["value"], plain_hpss(np.where(np.arange(900) < 450, 0, x), "harmonic", 5, 32, 8, 32, True, "constant")[450:])


def test_medians_are_bounded():
    """Windows of a long spectrogram are not gathered all at once."""
    x = np.random.default_rng(7).exponential(size=(65, 8000))
    tracemalloc.start()
    kernels.harmonic_percussive(x)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 12 * x.nbytes + (1 << 26)


def test_hpss_refuses(signal):
    for bad in ({"win_length": 600}, {"pad_mode": "wrap"}):
        with pytest.raises(ValueError):
            signal.hpss_harmonic(n_fft=512, **bad)


def test_tables_to_draw(signal, noise):
    got = {r.channel_id: r for r in signal.describe().collect()}
    for i, x in enumerate(noise):
        r, rms = got[f"c{i}"], math.sqrt(np.mean(x * x))
        assert r.n == 900 and np.allclose([r.min, r.max, r.mean, r.rms, r.crest_factor, r.level], [x.min(), x.max(), x.mean(), rms, abs(x).max() / rms, 20 * math.log10(rms / 2e-5)])
    for aw in (False, True):
        t = signal.plot_tables(256, Aw=aw)
        assert {"time_s", "value"} <= set(t["waveform"].columns) and {"freq_hz", "value"} <= set(t["spectrum"].columns) and {"time_s", "freq_hz", "value"} <= set(t["spectrogram"].columns)
        assert t["waveform"].agg(F.max("time_s")).first()[0] == 0.899 and t["spectrum"].agg(F.max("freq_hz")).first()[0] == 500.0
        steps = sorted(r[0] for r in t["spectrogram"].select("time_s").distinct().collect())
        assert np.allclose(np.diff(steps), 0.064)
    shown = signal.plot_tables(256)["spectrum"].where("channel_id = 'c0'").orderBy("freq_hz").toPandas()["value"]
    assert np.allclose(shown, signal.welch(256).view("dB").where("channel_id = 'c0'").orderBy("freq_idx").toPandas()["value"])


def test_sample_signal():
    x = load_sample_signal(2.0, 50, 1.5)
    assert len(x) == 75 and np.allclose(x, np.sin(2 * np.pi * 2 * np.arange(75) / 50))


def test_recordings_by_number(spark, tmp_path):
    for i, n in enumerate(("b", "a", "c")):
        (tmp_path / f"{n}.wav").write_bytes(audio.wav_bytes(np.full((1, 10), i / 10), 100.0))
    every = read.from_folder(spark, str(tmp_path))
    assert len(every) == 3 and [every[i].paths()[0][-5:] for i in range(3)] == ["a.wav", "b.wav", "c.wav"]
    assert every["b.wav"].paths() == every.get_all_by_label("b.wav").paths() == every[1].paths() and every["z.wav"].paths() == []
    for bad, error in ((3, IndexError), (-1, IndexError), (True, TypeError), (1.0, TypeError)):
        with pytest.raises(error):
            every[bad]
