"""Levels and spectral views as column expressions. Spark's log10 of 0 is null, so every logarithm has its floor or its case."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

AMPLITUDE_FLOOR, POWER_FLOOR = 1e-12, 1e-20


def level_db(amplitude: Column, ref: Column | float = 1.0, floor: float = AMPLITUDE_FLOOR) -> Column:
    return 20 * F.log10(F.greatest(F.abs(amplitude) / (F.lit(ref) if not isinstance(ref, Column) else ref), F.lit(floor)))


def power_db(power: Column, ref: Column | float = 1.0, floor: float = POWER_FLOOR) -> Column:
    ref = F.lit(float(ref)) if not isinstance(ref, Column) else ref
    return 10 * F.log10(F.greatest(power / (ref * ref), F.lit(floor)))


def unfloored_db(value: Column, factor: float) -> Column:
    """factor * log10; minus infinity at 0."""
    return F.when(value > 0, factor * F.log10(value)).when(value == 0, F.lit(float("-inf")))


def magnitude(re: Column, im: Column) -> Column:
    return F.sqrt(re * re + im * im)


def phase(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def a_weighting_db(freq: Column, least: float | None = -45.0) -> Column:
    """The analog A curve in dB, near 0 at 1 kHz."""
    f2 = freq * freq
    ra = F.lit(12194.0**2) * f2 * f2 / ((f2 + 20.6**2) * F.sqrt((f2 + 107.7**2) * (f2 + 737.9**2)) * (f2 + 12194.0**2))
    db = F.when(ra > 0, 20 * F.log10(ra) + 2.0)
    return db if least is None else F.coalesce(F.greatest(db, F.lit(least)), F.lit(least))


def a_weighting_sql(freq: str, least: float = -45.0) -> str:
    """The same curve for SQL."""
    f2 = f"(({freq})*({freq}))"
    ra = f"({12194.0**2!r}*{f2}*{f2}/(({f2}+{20.6**2!r})*sqrt(({f2}+{107.7**2!r})*({f2}+{737.9**2!r}))*({f2}+{12194.0**2!r})))"
    return f"(CASE WHEN {freq} > 0 THEN greatest(20*log10({ra})+2.0, {least}) ELSE {least} END)"


def to_db(x: float, floor: float = AMPLITUDE_FLOOR) -> float:
    return 20 * math.log10(max(abs(x), floor))
