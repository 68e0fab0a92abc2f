"""Filter design and recursions in numpy, from their published definitions."""

from __future__ import annotations


from fractions import Fraction
from functools import lru_cache

import numpy as np

from .windows import kaiser


def butterworth(order: int, kind: str, cutoff, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (b, a) of a digital Butterworth filter: low, high or band (cutoff is a pair)."""
    z, p, k = butterworth_roots(order, kind, cutoff, rate)
    return k * np.real(np.poly(z)), np.real(np.poly(p))


def butterworth_roots(order: int, kind: str, cutoff, rate: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of the same filter."""
    edges = np.atleast_1d(np.asarray(cutoff, float))
    if not ((edges > 0) & (edges < rate / 2)).all() or (kind == "band" and not (len(edges) == 2 and edges[0] < edges[1])):
        raise ValueError("cutoffs lie in order between 0 and half of the sampling rate")
    w = 4 * np.tan(np.pi * edges / rate)  # prewarped for a bilinear transform at rate 2
    m = np.arange(-order + 1, order, 2)
    poles = -np.exp(1j * np.pi * m / (2 * order))
    if kind == "low":
        zeros, poles, gain = np.array([]), poles * w[0], w[0] ** order
    elif kind == "high":
        zeros, poles, gain = np.zeros(order), w[0] / poles, 1.0
    elif kind == "band":
        width, center = w[1] - w[0], w[0] * w[1]
        q = poles * width / 2
        root = np.sqrt(q * q - center)
        zeros, poles, gain = np.zeros(order), np.concatenate([q + root, q - root]), width**order
    else:
        raise ValueError(f"no filter kind {kind!r}")
    return bilinear(zeros, poles, gain, 2.0)


def sections(zeros: np.ndarray, poles: np.ndarray, gain: float) -> np.ndarray:
    """Second-order sections (b0, b1, b2, a0, a1, a2) with real zeros and with these poles, the gain in the first.

    Poles far from the unit circle come first; each section takes the nearest zeros,
    so that one which passes no constant stands beside the poles that need it.
    """
    upper = [p for p in poles if p.imag > 1e-12 * abs(p)]
    real = sorted((p.real for p in poles if abs(p.imag) <= 1e-12 * abs(p)), key=abs)
    pairs = sorted([*((p, p.conjugate()) for p in upper), *zip(real[::2], real[1::2])], key=lambda x: abs(x[0]))
    if len(real) % 2:
        pairs.insert(0, (real[-1],))
    left, out = list(np.real(zeros)), []
    for pair in reversed(pairs):
        mine = []
        for p in pair:
            if left:
                # a pair of complex poles takes one zero at each end of the band where it can
                near = min(left, key=lambda z: (abs(z - mine[0]) < 1e-9 if mine and abs(np.imag(p)) > 0 else 0, abs(z - p)))
                left.remove(near)
                mine.append(near)
        row = [np.poly(mine) if mine else np.ones(1), np.real(np.poly(pair))]
        out.append(np.concatenate([np.pad(x, (0, 3 - len(x))) for x in row]))
    out = np.array(out[::-1])
    out[0, :3] *= gain
    return out


def butterworth_sections(order: int, kind: str, cutoff, rate: float) -> np.ndarray:
    return sections(*butterworth_roots(order, kind, cutoff, rate))


def bilinear(zeros, poles, gain: float, fs: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Digital zeros, poles and gain of analog ones."""
    zeros, poles = np.asarray(zeros, complex), np.asarray(poles, complex)
    c = 2 * fs
    z = np.concatenate([(c + zeros) / (c - zeros), -np.ones(len(poles) - len(zeros))])
    return z, (c + poles) / (c - poles), float(np.real(gain * np.prod(c - zeros) / np.prod(c - poles)))


# Pole frequencies in Hz of the A and C weighting curves (fixed values of the standard).
CORNERS = {"A": (20.598997057568145, 20.598997057568145, 12194.21714799801, 12194.21714799801, 107.65264864304628, 737.8622307362899), "C": (20.598997057568145, 20.598997057568145, 12194.21714799801, 12194.21714799801), "B": (20.598997057568145, 20.598997057568145, 12194.21714799801, 12194.21714799801, 10**2.2)}


def weighting_roots(curve: str, rate: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Zeros, poles and gain of a frequency weighting with 0 dB at 1 kHz before the bilinear transform."""
    corners = CORNERS[curve]
    poles = -2 * np.pi * np.array(corners)
    zeros = np.zeros(len(corners) - 2)
    s = 2j * np.pi * 1000
    gain = 1 / abs(np.prod(s - zeros) / np.prod(s - poles))
    return bilinear(zeros, poles, gain, rate)


def weighting(curve: str, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(b, a) of a frequency weighting."""
    z, p, k = weighting_roots(curve, rate)
    return k * np.real(np.poly(z)), np.real(np.poly(p))


def weighting_sections(curve: str, rate: float) -> np.ndarray:
    return sections(*weighting_roots(curve, rate))


def section_response(sos: np.ndarray, freq, rate: float) -> np.ndarray:
    z = np.exp(-2j * np.pi * np.asarray(freq, float) / rate)
    return np.prod([np.polyval(row[2::-1], z) / np.polyval(row[:2:-1], z) for row in sos], axis=0)


def response(b: np.ndarray, a: np.ndarray, freq, rate: float) -> np.ndarray:
    z = np.exp(-2j * np.pi * np.asarray(freq, float) / rate)
    return np.polyval(b[::-1], z) / np.polyval(a[::-1], z)


class Recursion:
    """A filter as a linear system with a state, run in chunks: within a chunk by matrices, between chunks by the state.

    It is given as coefficients (b, a), or as second-order sections in a row, whose
    states are kept apart: polynomials of high order with poles near the unit circle
    lose the digits that keep them stable. y = O s + T x and s' = P s + K x for
    chunks of `size` samples.
    """

    def __init__(self, b: np.ndarray, a: np.ndarray | None = None, size: int = 64):
        rows = [(row[:3], row[3:]) for row in np.asarray(b, float)] if a is None else [(b, a)]
        self.step, self.push, self.feed, self.steady = np.zeros((0, 0)), np.zeros(0), 1.0, np.zeros(0)
        out, constant = np.zeros(0), 1.0  # constant: what a constant input of 1 is before the next section
        for one in rows:
            step, push, read, feed, steady, gain = _section(*one)
            n, m = len(push), len(self.push)
            both = np.zeros((m + n, m + n))
            both[:m, :m], both[m:, m:], both[m:, :m] = self.step, step, np.outer(push, out)
            self.step, self.push = both, np.concatenate([self.push, push * self.feed])
            out, self.feed = np.concatenate([out * feed, read]), self.feed * feed
            self.steady, constant = np.concatenate([self.steady, steady * constant]), constant * gain
        self.order, self.size, self.read = len(self.push), size, out
        d = self.order
        powers = [np.eye(d)]
        for _ in range(size):
            powers.append(self.step @ powers[-1])
        self.out = np.array([out @ p for p in powers[:size]]).reshape(size, d)
        impulse = np.array([self.feed, *[float(out @ (p @ self.push)) if d else 0.0 for p in powers[: size - 1]]])
        lag = np.subtract.outer(np.arange(size), np.arange(size))
        self.within = np.where(lag >= 0, impulse[np.clip(lag, 0, None)], 0.0)
        self.carry = np.stack([powers[size - 1 - k] @ self.push for k in range(size)], 1).reshape(d, size)
        self.power = powers[size]

    def run(self, x: np.ndarray, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Output and last state."""
        x = np.asarray(x, float)
        s = np.zeros(self.order) if state is None else np.asarray(state, float)
        whole = len(x) // self.size
        chunks = x[: whole * self.size].reshape(whole, self.size)
        y, pushed = chunks @ self.within.T, chunks @ self.carry.T
        states = np.empty((whole, self.order))
        for i in range(whole):
            states[i] = s
            s = self.power @ s + pushed[i]
        y = y + states @ self.out.T
        tail = np.empty(len(x) - whole * self.size)
        for i, v in enumerate(x[whole * self.size :]):
            tail[i] = self.feed * v + (float(self.read @ s) if self.order else 0.0)
            s = self.step @ s + self.push * v
        return np.concatenate([y.reshape(-1), tail]), s


def _section(b, a) -> tuple:
    """Transposed direct form of one section: step, push, read, feed, the state under a constant input of 1, and the gain of a constant."""
    n = max(len(a), len(b))
    a, b = np.pad(np.asarray(a, float), (0, n - len(a))), np.pad(np.asarray(b, float), (0, n - len(b)))
    a, b = a / a[0], b / a[0]
    while n > 1 and a[-1] == 0 and b[-1] == 0:
        a, b, n = a[:-1], b[:-1], n - 1
    d = n - 1
    step = np.zeros((d, d))
    step[:, 0] = -a[1:]
    step[np.arange(d - 1), np.arange(1, d)] = 1
    push, read = b[1:] - a[1:] * b[0], np.zeros(d)
    read[:1] = 1
    rest = np.eye(d) - step
    steady = np.linalg.solve(rest, push) if d and abs(np.linalg.det(rest)) > 1e-300 else np.zeros(d)
    gain = 0.0 if abs(b.sum()) <= 1e-12 * abs(b).max() else b.sum() / a.sum()
    return step, push, read, b[0], steady, gain


def extension(b: np.ndarray, a: np.ndarray | None = None) -> int:
    """Samples by which zero-phase filtering extends both ends: three lengths of the filter's coefficients."""
    if a is not None:
        return 3 * max(len(a), len(b))
    return 3 * (1 + sum(2 if row[2] or row[5] else 1 for row in b))


def zero_phase(b: np.ndarray, a: np.ndarray | None, x: np.ndarray) -> np.ndarray:
    """Forward and backward filtering with an odd extension of three filter lengths and steady first states."""
    r, pad = Recursion(b, a), extension(b, a)
    if len(x) <= pad:
        raise ValueError("a channel is longer than the extension")
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    y, _ = r.run(wide, r.steady * wide[0])
    y, _ = r.run(y[::-1], r.steady * y[-1])
    return y[::-1][pad:-pad]


def ratio(rate: float, target: float, most: int = 1_000_000) -> tuple[int, int]:
    """Whole numbers up and down with target / rate = up / down."""
    f = Fraction(str(target)) / Fraction(str(rate))
    if f.denominator > most or f.numerator > most:
        f = f.limit_denominator(most)
    return f.numerator, f.denominator


@lru_cache(maxsize=4)
def polyphase(up: int, down: int) -> tuple[np.ndarray, int]:
    """Low-pass of a rational rate change (Kaiser window, shape 5) and half its length; designed once in a process."""
    most = max(up, down)
    half = 10 * most
    h = np.sinc(np.arange(-half, half + 1) / most) / most * kaiser(2 * half + 1, 5.0)
    return h / h.sum() * up, half


def resample_part(values: np.ndarray, start: int, first: int, end: int, up: int, down: int) -> np.ndarray:
    """Outputs first to end from samples start.. of a channel; samples outside `values` count as 0."""
    h, half = polyphase(up, down)
    j = np.arange(first, end)
    at = j * down  # place among the upsampled inputs
    low = -(-(at - half) // up)
    taps = 2 * half // up + 1
    k = low[:, None] + np.arange(taps)
    place = at[:, None] - k * up + half
    ok = (place >= 0) & (place <= 2 * half) & (k >= start) & (k < start + len(values))
    x = values[np.clip(k - start, 0, max(len(values) - 1, 0))]
    return np.where(ok, x * h[np.clip(place, 0, 2 * half)], 0.0).sum(1)


#: Values that medians gather at once.
MEDIAN_VALUES = 1 << 21


def harmonic_percussive(magnitude: np.ndarray, kernel: int = 31, power: float = 2.0, margin: float = 1.0, before: int = 0, after: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Soft masks of median-filtered spectrograms (bins, frames): smooth along time is harmonic, along frequency percussive.

    The first `before` and the last `after` frames, half a kernel each at most, are
    neighbours of the others and get no masks.
    """
    half = kernel // 2

    def medians(x: np.ndarray, first: int = 0, last: int = 0) -> np.ndarray:
        wide = np.pad(x, ((0, 0), (half - first, half - last)), mode="symmetric" if x.shape[1] > half else "reflect" if x.shape[1] > 1 else "edge")
        windows = np.lib.stride_tricks.sliding_window_view(wide, kernel, axis=1)
        out = np.empty(windows.shape[:2])
        step = max(1, MEDIAN_VALUES // max(1, windows.shape[1] * kernel))
        for lo in range(0, len(out), step):
            out[lo : lo + step] = np.median(windows[lo : lo + step], axis=-1)
        return out

    harmonic, percussive = medians(magnitude, before, after), medians(magnitude[:, before : magnitude.shape[1] - after].T).T

    def mask(x, ref):
        top = np.maximum(x, ref)
        small = top < 1e-30
        top[small] = 1.0
        a, b = (x / top) ** power, (ref / top) ** power
        out = np.where(small, 0.5 if margin == 1 else 0.0, a / np.where(a + b == 0, 1, a + b))
        return out

    return mask(harmonic, percussive * margin), mask(percussive, harmonic * margin)


