"""Window functions in numpy. Periodic forms serve spectra, symmetric ones tapers."""

from __future__ import annotations

import numpy as np


def window(name: str, n: int, periodic: bool = True) -> np.ndarray:
    """boxcar, hann, hamming, blackman, bartlett or ("tukey", share)."""
    if isinstance(name, (tuple, list)):
        return tukey(n, name[1], periodic)
    if n < 1:
        raise ValueError("a window has a length")
    m = n if periodic else n - 1
    x = 2 * np.pi * np.arange(n) / max(m, 1)
    if name in ("boxcar", "rectangular", "ones"):
        return np.ones(n)
    if name in ("hann", "hanning"):
        return 0.5 - 0.5 * np.cos(x)
    if name == "hamming":
        return 0.54 - 0.46 * np.cos(x)
    if name == "blackman":
        return 0.42 - 0.5 * np.cos(x) + 0.08 * np.cos(2 * x)
    if name in ("bartlett", "triang"):
        return 1 - np.abs(2 * np.arange(n) / max(m, 1) - 1)
    raise ValueError(f"no window named {name!r}")


def tukey(n: int, alpha: float, periodic: bool = False) -> np.ndarray:
    """Flat with cosine ramps over alpha / 2 of the length at each end."""
    m = n if periodic else n - 1
    if alpha <= 0 or m < 1:
        return np.ones(n)
    ramp = min(alpha, 1.0) * m / 2
    k = np.minimum(np.arange(n), m - np.arange(n))
    return np.where(k < ramp, 0.5 - 0.5 * np.cos(np.pi * k / ramp), 1.0)


def kaiser(n: int, beta: float) -> np.ndarray:
    return np.kaiser(n, beta)
