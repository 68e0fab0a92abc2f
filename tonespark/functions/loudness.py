"""Loudness and sharpness of sounds in numpy, from ISO 532-1 (Zwicker) and DIN 45692.

Levels of 28 third-octave bands (25 Hz to 12.5 kHz) become the core loudness of
20 critical bands; its upward spread is a decay whose slope depends on the value,
so the loudness at a place of the Bark axis and the area below it are looked up
in integrals of 1 / slope, without steps along the axis.
"""

from __future__ import annotations

import math

import numpy as np

# ---- fixed values of ISO 532-1 --------------------------------------------------

#: Levels up to which the low bands take a row of LOW_DB.
LOW_LEVELS = np.array([45, 55, 65, 71, 80, 90, 100, 120], float)
#: Corrections in dB of the eleven lowest bands.
LOW_DB = np.array([
    [-32, -24, -16, -10, -5, 0, -7, -3, 0, -2, 0],
    [-29, -22, -15, -10, -4, 0, -7, -2, 0, -2, 0],
    [-27, -19, -14, -9, -4, 0, -6, -2, 0, -2, 0],
    [-25, -17, -12, -9, -3, 0, -5, -2, 0, -2, 0],
    [-23, -16, -11, -7, -3, 0, -4, -1, 0, -1, 0],
    [-20, -14, -10, -6, -3, 0, -4, -1, 0, -1, 0],
    [-18, -12, -9, -6, -2, 0, -3, -1, 0, -1, 0],
    [-15, -10, -8, -4, -2, 0, -3, -1, 0, -1, 0],
], float)
#: Thresholds in quiet, transmission of the ear, diffuse minus free field, and band width corrections, in dB, of 20 critical bands.
QUIET = np.array([30, 18, 12, 8, 7, 6, 5, 4, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3, 3], float)
EAR = np.array([0, 0, 0, 0, 0, 0, 0, 0, 0, 0, -0.5, -1.6, -3.2, -5.4, -5.6, -4, -1.5, 2, 5, 12])
DIFFUSE = np.array([0, 0, 0.5, 0.9, 1.2, 1.6, 2.3, 2.8, 3, 2, 0, -1.4, -2, -1.9, -1, 0.5, 3, 4, 4.3, 4])
WIDTH = np.array([-0.25, -0.6, -0.8, -0.8, -0.5, 0, 0.5, 1.1, 1.5, 1.7, 1.8, 1.8, 1.7, 1.6, 1.4, 1.2, 0.8, 0.5, 0, -0.5])
#: Upper ends of the critical bands in Bark.
UPPER = np.array([0.9, 1.8, 2.8, 3.5, 4.4, 5.4, 6.6, 7.9, 9.2, 10.6, 12.3, 13.8, 15.2, 16.7, 18.1, 19.3, 20.6, 21.8, 22.7, 23.6, 24.0])
#: Specific loudness down to which a row of SLOPES holds, and slopes in sone / Bark^2 by band (the last column for all higher ones).
RANGES = np.array([21.5, 18, 15.1, 11.5, 9, 6.1, 4.4, 3.1, 2.13, 1.36, 0.82, 0.42, 0.30, 0.22, 0.15, 0.10, 0.035, 0])
SLOPES = np.array([
    [13, 8.2, 6.3, 5.5, 5.5, 5.5, 5.5, 5.5],
    [9, 7.5, 6, 5.1, 4.5, 4.5, 4.5, 4.5],
    [7.8, 6.7, 5.6, 4.9, 4.4, 3.9, 3.9, 3.9],
    [6.2, 5.4, 4.6, 4, 3.5, 3.2, 3.2, 3.2],
    [4.5, 3.8, 3.6, 3.2, 2.9, 2.7, 2.7, 2.7],
    [3.7, 3, 2.8, 2.35, 2.2, 2.2, 2.2, 2.2],
    [2.9, 2.3, 2.1, 1.9, 1.8, 1.7, 1.7, 1.7],
    [2.4, 1.7, 1.5, 1.35, 1.3, 1.3, 1.3, 1.3],
    [1.95, 1.45, 1.3, 1.15, 1.1, 1.1, 1.1, 1.1],
    [1.5, 1.2, 0.94, 0.86, 0.82, 0.82, 0.82, 0.82],
    [0.72, 0.67, 0.64, 0.63, 0.62, 0.62, 0.62, 0.62],
    [0.59, 0.53, 0.51, 0.50, 0.42, 0.42, 0.42, 0.42],
    [0.40, 0.33, 0.26, 0.24, 0.22, 0.22, 0.22, 0.22],
    [0.27, 0.21, 0.20, 0.18, 0.17, 0.17, 0.17, 0.17],
    [0.16, 0.15, 0.14, 0.12, 0.11, 0.11, 0.11, 0.11],
    [0.12, 0.11, 0.10, 0.08, 0.08, 0.08, 0.08, 0.08],
    [0.09, 0.08, 0.07, 0.06, 0.06, 0.06, 0.06, 0.05],
    [0.06, 0.05, 0.03, 0.02, 0.02, 0.02, 0.02, 0.02],
])
#: Time constants in seconds: of the decay after a sound's end, and of the two parts (with their shares) of temporal weighting.
SHORT, LONG, VARIABLE = 0.005, 0.015, 0.075
WEIGHTS = ((0.47, 0.0035), (0.53, 0.07))

# ---- end of fixed values -----------------------------------------------------------

BARK = np.arange(1, 241) / 10
FIELDS, WEIGHTINGS = ("free", "diffuse"), ("din", "aures", "bismarck", "fastl")
#: Rates of levels and of results, and steps between two levels for the decay.
LEVEL_RATE, RATE, STEPS = 2000, 500, 24


def core_loudness(levels: np.ndarray, field: str = "free") -> np.ndarray:
    """(21, n) core loudness of (28, n) band levels in dB; the last row is zero."""
    if field not in FIELDS:
        raise ValueError(f"a field is {' or '.join(FIELDS)}, not {field!r}")
    low = np.empty((11, levels.shape[1]))
    for i in range(11):
        row = np.cumprod(levels[i] > (LOW_LEVELS - LOW_DB[:, i])[:, None], axis=0).sum(0)
        low[i] = 10 ** (0.1 * (levels[i] + LOW_DB[np.minimum(row, 7), i]))
    merged = np.stack([low[:6].sum(0), low[6:9].sum(0), low[9:].sum(0)])
    heard = np.concatenate([10 * np.log10(np.maximum(merged, 1e-30)), levels[11:28]]) - EAR[:, None]
    if field == "diffuse":
        heard += DIFFUSE[:, None]
    quiet = QUIET[:, None]
    core = 0.0635 * 10 ** (0.025 * quiet) * ((0.75 + 0.25 * 10 ** (0.1 * (heard - WIDTH[:, None] - quiet))) ** 0.25 - 1)
    core = np.where(heard > quiet, np.maximum(core, 0.0), 0.0)
    core[0] *= np.minimum(0.4 + 0.32 * core[0] ** 0.2, 1.0)
    return np.concatenate([core, np.zeros((1, levels.shape[1]))])


def _integrals(slope: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At knots in rising order: specific loudness, Bark that it takes to fall from there to 0, and the area below that fall."""
    knots = np.concatenate([RANGES[::-1], [1000.0]])
    each = np.concatenate([slope[:0:-1], slope[:1]])
    along = np.concatenate([[0.0], np.cumsum(np.diff(knots) / each)])
    area = np.concatenate([[0.0], np.cumsum(np.diff(knots**2) / (2 * each))])
    return knots, along, area


_FALLS = [_integrals(SLOPES[:, c]) for c in range(8)]


def specific_loudness(core: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Loudness in sone (n) and specific loudness at BARK (240, n) of core loudness (21, n).

    Within a band the value is that of the band, or what came from the band below
    and fell so far, whichever is greater.
    """
    n = core.shape[1]
    total, specific, came, start = np.zeros(n), np.zeros((len(BARK), n)), np.zeros(n), 0.0
    for i, end in enumerate(UPPER + 1e-4):
        knots, along, area = _FALLS[min(max(i - 1, 0), 7)]
        slope = np.diff(knots) / np.diff(along)

        def below(v):
            k = np.clip(np.searchsorted(knots, v, side="right") - 1, 0, len(slope) - 1)
            return area[k] + (v * v - knots[k] ** 2) / (2 * slope[k])

        own = core[i]
        top = np.maximum(came, own)
        at = np.interp(top, knots, along)
        for p in np.flatnonzero((BARK > start) & (BARK <= end)):
            specific[p] = np.maximum(own, np.interp(at - (BARK[p] - start), along, knots))
        last = np.maximum(own, np.interp(at - (end - start), along, knots))
        fall = at - np.interp(last, knots, along)
        total += below(top) - below(last) + last * np.maximum(end - start - fall, 0.0)
        came, start = last, end
    digits = np.where(total <= 16, 1000.0, 100.0)
    return np.floor(np.maximum(total, 0.0) * digits + 0.5) / digits, specific


def sharpness(loudness: np.ndarray, specific: np.ndarray, weighting: str = "din") -> np.ndarray:
    """Sharpness in acum; 0 below 0.1 sone."""
    z = BARK[:, None]
    n = np.maximum(loudness, 0.1)
    if weighting == "din":
        g = np.where(z > 15.8, 0.15 * np.exp(0.42 * (z - 15.8)) + 0.85, 1.0)
    elif weighting == "bismarck":
        g = np.where(z > 15, 0.2 * np.exp(0.308 * (z - 15)) + 0.8, 1.0)
    elif weighting == "fastl":
        g = np.where(z > 16, 0.066 * np.exp(0.171 * z), 1.0)
    elif weighting == "aures":
        g = 0.078 * np.exp(0.171 * z) / z * (n / np.log(0.05 * n + 1))
    else:
        raise ValueError(f"a weighting is {', '.join(WEIGHTINGS)}, not {weighting!r}")
    return np.where(loudness >= 0.1, 0.11 * (specific * g * z * 0.1).sum(0) / n, 0.0)


def between(x: np.ndarray) -> np.ndarray:
    """x along its last axis with STEPS - 1 values laid between neighbours, the last ones falling to 0."""
    following = np.concatenate([x[..., 1:], np.zeros_like(x[..., :1])], -1)
    return (x[..., None] + (following - x)[..., None] * (np.arange(STEPS) / STEPS)).reshape(*x.shape[:-1], -1)


#: Levels that the decay works out side by side, and levels before them from which it starts at rest: 20 of its longest time constants.
SPAN, LEAD = LEVEL_RATE // 2, int(20 * VARIABLE * LEVEL_RATE)


def decayed(core: np.ndarray) -> np.ndarray:
    """Core loudness (bands, n) at LEVEL_RATE with the ear's decay after loud parts: a fast fall, and a slower one after long sounds.

    The decay is a circuit of two states that forgets its past within LEAD levels,
    so stretches of SPAN levels are worked out side by side, each from rest LEAD
    levels before it.
    """
    bands, n = core.shape
    count = -(-n // SPAN)
    wide = np.pad(core, ((0, 0), (LEAD, count * SPAN - n + 1)))
    rises = np.diff(wide) / STEPS
    rises[:, :LEAD] = 0.0  # nothing rises before the first level
    x, rises = (np.stack([y[:, k * SPAN : k * SPAN + LEAD + SPAN] for k in range(count)]) for y in (wide, rises))  # stretches, bands, levels
    dt = 1 / (LEVEL_RATE * STEPS)
    p, q = (VARIABLE + LONG) / (VARIABLE * SHORT), 1 / (SHORT * VARIABLE)
    l1, l2 = -p / 2 + math.sqrt(p * p / 4 - q), -p / 2 - math.sqrt(p * p / 4 - q)
    den, e1, e2, a1, a2 = VARIABLE * (l1 - l2), math.exp(l1 * dt), math.exp(l2 * dt), VARIABLE * l1 + 1, VARIABLE * l2 + 1
    # output and second state one step on, of both while they fall
    to_second, from_second = ((e1 - e2) / den, -(a2 * e1 - a1 * e2) / den)
    to_out, out_second = ((a1 * e1 - a2 * e2) / den, -a1 * a2 * (e1 - e2) / den)
    fall, charge = math.exp(-dt / LONG), math.exp(-dt / VARIABLE)
    out, second = np.zeros((count, bands)), np.zeros((count, bands))
    result = np.empty((count, bands, SPAN))
    for t in range(LEAD + SPAN):
        here, rise = x[:, :, t], rises[:, :, t]
        for k in range(STEPS):
            v = here + rise * k
            apart = out > second
            down = np.maximum(np.where(apart, out * to_out + second * out_second, out * fall), v)
            low = np.where(apart, np.minimum(out * to_second + second * from_second, down), down)
            up = v >= out
            new = np.where(up, v, down)
            second = np.where(up, np.where(new > second, (second - v) * charge + v, v), low)
            out = new
            if not k and t >= LEAD:
                result[:, :, t - LEAD] = out
    return result.transpose(1, 0, 2).reshape(bands, -1)[:, :n]


def weighted(total: np.ndarray, smooth) -> np.ndarray:
    """Loudness at LEVEL_RATE under temporal weighting; smooth(values, decay of a step) is a low-pass from rest."""
    fine = between(total)
    return sum(share * smooth(fine, math.exp(-1 / (LEVEL_RATE * STEPS * tau)))[::STEPS] for share, tau in WEIGHTS)
