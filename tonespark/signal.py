"""Signals: a long table of values and an immutable header, with methods that build plans.

A signal may hold many recordings (frame_id) of one channel layout. Methods
validate on the driver and change the plan; only rms, crest_factor,
derive_calibration, n_samples and the collecting methods run anything.
Calibration is applied once, lazily: numeric operators read calibrated values,
and their results have factors of 1.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .frame import Channel, Header, LevelReference, Step, check_rate
from .functions import levels, windows
from .functions.tables import KEY, with_channel_values
from .operators import filters, loudness, pointwise, spectral, stats, windowed
from .plans.registry import REGISTRY, operation

INDEX = {
    "time": ["sample_idx"], "spectrum": ["freq_idx"], "amplitude": ["freq_idx"], "stft": ["frame_idx", "freq_idx"], "magnitude": ["frame_idx", "freq_idx"], "cepstrum": ["quef_idx"], "cepstrogram": ["frame_idx", "quef_idx"],
    "bands": ["band_idx"], "csd": ["freq_idx"], "coherence": ["freq_idx"], "transfer": ["freq_idx"],
}
COMPLEX = {"spectrum", "stft", "csd", "transfer"}
PAIRS = {"csd", "coherence", "transfer"}


@dataclass(frozen=True)
class Pair:
    """Output and input of a pairwise spectrum, with what its values' unit and reference follow from."""

    output: Channel
    input: Channel
    kind: str
    scaling: str | None = None

    @property
    def unit(self) -> str:
        if self.kind == "coherence":
            return "1"
        if self.kind == "transfer":
            return f"{self.output.unit}/{self.input.unit}" if self.input.unit else self.output.unit
        names = [u for u in (self.input.unit, self.output.unit) if u]
        base = f"{names[0]}^2" if len(names) == 2 and names[0] == names[1] else "*".join(names)
        return f"{base}/Hz" if self.scaling == "density" else base

    @property
    def ref(self) -> float:
        return 1.0 if self.kind == "coherence" else self.output.ref / self.input.ref if self.kind == "transfer" else self.input.ref * self.output.ref


class Signal:
    """df: frame_id, channel_id (or out_ch, in_ch), the kind's indices, and value (or re, im)."""

    def __init__(self, df: DataFrame, header: Header, previous: Signal | None = None, n: int | None = None):
        self.df, self.header, self.previous, self._n = df, header, previous, n

    # ---- description -------------------------------------------------------

    @property
    def kind(self) -> str:
        return self.header.kind

    @property
    def rate(self) -> float:
        return self.header.rate

    sampling_rate = rate

    @property
    def channels(self) -> tuple[Channel, ...]:
        return self.header.channels

    @property
    def labels(self) -> list[str]:
        return self.header.labels

    @property
    def n_channels(self) -> int:
        return len(self.channels)

    @property
    def operation_history(self) -> list[str]:
        return self.header.history()

    def n_samples(self) -> int:
        """Samples of the longest channel; counted once where it is not known."""
        if self._n is None:
            last = self.df.agg(F.max("sample_idx")).first()[0] if self.kind == "time" else None
            self._n = 0 if last is None else last + 1
        return self._n

    def duration(self) -> float:
        return self.n_samples() / self.rate

    def info(self) -> str:
        return f"{self.kind} signal {self.header.label!r}: {self.n_channels} channels at {self.rate:g} Hz; {' > '.join(self.operation_history) or 'as read'}"

    def debug_info(self) -> str:
        """info() with a line for each channel and the plan's output columns."""
        lines = [f"  {c.id}: {c.label!r} {c.unit or '-'} ref {c.ref:g} factor {c.factor:g} offset {c.offset:g} s {c.extra or ''}".rstrip() for c in self.channels]
        return "\n".join([self.info(), *lines, "  " + ", ".join(f"{n} {t}" for n, t in self.df.dtypes), f"  params {self.header.params} metadata {self.header.metadata}"])

    def print_operation_history(self) -> None:
        for i, name in enumerate(self.operation_history, 1):
            print(f"{i}. {name}")

    def with_axis(self) -> DataFrame:
        """df with the physical axis: time_s, freq_hz or quefrency_s."""
        axis = {
            "sample_idx": ("time_s", 1 / self.rate), "freq_idx": ("freq_hz", self.rate / (self.header.params.get("n_fft") or 1)), "quef_idx": ("quefrency_s", 1 / self.rate),
            "frame_idx": ("time_s", (self.header.params.get("hop") or 1) / self.rate), "band_idx": ("band", 1.0),
        }
        return self.df.withColumns({axis[i][0]: F.col(i) * F.lit(axis[i][1]) for i in INDEX[self.kind]})

    # ---- building ----------------------------------------------------------

    def _need(self, *kinds: str) -> None:
        if self.kind not in kinds:
            raise ValueError(f"this needs a signal of kind {' or '.join(kinds)}, not {self.kind}")

    def _new(self, df: DataFrame, name: str, given: dict | None = None, inputs: tuple = (), n: int | None = None, **changes) -> Signal:
        step = Step(name, given or {}, (self.header.lineage or self.header.label or "input", *[i.header.lineage or i.header.label or "input" for i in inputs]))
        return Signal(df, replace(self.header, lineage=step, **changes), self, n)

    def _calibrated(self) -> DataFrame:
        self._need("time")
        return pointwise.scale(self.df, {c.id: c.factor for c in self.channels})

    def _unit_factors(self, label: str | None = None) -> tuple[Channel, ...]:
        return tuple(replace(c, factor=1.0, label=f"{label}({c.label})" if label else c.label) for c in self.channels)

    def _pointwise(self, df: DataFrame, name: str, params: dict | None = None, label: str | None = None, n: int | None = -1, **changes) -> Signal:
        return self._new(df, name, params, n=self._n if n == -1 else n, channels=changes.pop("channels", self._unit_factors(label)), **changes)

    # ---- selection and annotation -------------------------------------------

    def channel_ids(self, query) -> list[str]:
        """Ids of channels by label, pattern, predicate, index, list, mask, slice or a dict of details (values may be patterns)."""
        every = self.channels
        if isinstance(query, bool):
            raise KeyError("a single truth value selects nothing")
        if isinstance(query, (int, np.integer)):
            return [every[query].id]
        if isinstance(query, slice):
            return [c.id for c in every[query]]
        if isinstance(query, str):
            found = [c.id for c in every if query in (c.label, c.id)]
        elif isinstance(query, re.Pattern):
            found = [c.id for c in every if query.search(c.label)]
        elif isinstance(query, dict):
            match = lambda want, got: bool(want.search(str(got))) if isinstance(want, re.Pattern) else want == got
            found = [c.id for c in every if all(match(v, {**c.extra, "label": c.label, "unit": c.unit, "ref": c.ref, "id": c.id}.get(k)) for k, v in query.items())]
        elif callable(query):
            found = [c.id for c in every if query(c)]
        else:
            items = list(query)
            if items and all(isinstance(i, (bool, np.bool_)) for i in items):
                if len(items) != len(every):
                    raise ValueError("a mask has an entry for each channel")
                return [c.id for c, k in zip(every, items) if k]
            return [i for item in items for i in self.channel_ids(item)]
        if not found:
            raise KeyError(f"no channel matches {query!r}")
        return found

    @operation("get_channel")
    def get_channel(self, query) -> Signal:
        """The channels of a query, in its order. A channel may come again: with its label, and its id with the least free suffix .1, .2, ..."""
        ids = self.channel_ids(query)
        by, new, taken = {c.id: c for c in self.channels}, [], set(ids)
        for place, i in enumerate(ids):
            name = i if i not in ids[:place] else next(n for n in (f"{i}.{k}" for k in range(1, len(ids) + len(taken) + 1)) if n not in taken)
            taken.add(name)
            new.append((i, name))
        if len(set(ids)) == len(ids):
            df = pointwise.select_channels(self.df, ids)
        else:
            self._need(*set(INDEX) - PAIRS)
            df = pointwise.repeat_channels(self.df, new)
        return self._new(df, "get_channel", {"query": query if isinstance(query, (int, str, list)) else ids}, n=self._n, channels=tuple(replace(by[i], id=name) for i, name in new))

    def __getitem__(self, key) -> Signal:
        if isinstance(key, tuple):
            out = self[key[0]]
            part = key[1]
            if not isinstance(part, slice) or part.step not in (None, 1):
                raise ValueError("time is cut by slices of step 1")
            first, end, _ = part.indices(self.n_samples())
            return out.cut_samples(first, max(first, end))
        if isinstance(key, slice):  # saved plans know ids, not slices
            return self if key == slice(None) else self.get_channel(self.channel_ids(key))
        return self.get_channel(key)

    @operation("remove_channel")
    def remove_channel(self, query) -> Signal:
        ids = self.channel_ids(query)
        return self._new(pointwise.remove_channels(self.df, ids), "remove_channel", {"query": query if isinstance(query, (int, str, list)) else ids}, n=self._n, channels=tuple(c for c in self.channels if c.id not in ids))

    @operation("rename_channels")
    def rename_channels(self, mapping: dict) -> Signal:
        new = list(self.channels)
        for old, label in mapping.items():
            old = int(old) if isinstance(old, str) and old.isdigit() and old not in self.labels else old  # a saved plan has texts as keys
            if isinstance(old, int) and old < 0:
                raise ValueError("channels are numbered from 0")
            k = old if isinstance(old, int) else self.labels.index(old)
            new[k] = replace(new[k], label=label)
        if len({c.label for c in new}) != len(new):
            raise ValueError("labels are distinct")
        return self._new(self.df, "rename_channels", {"mapping": mapping}, n=self._n, channels=tuple(new))

    def with_label(self, label: str) -> Signal:
        return Signal(self.df, replace(self.header, label=label), self.previous, self._n)

    def with_metadata(self, **metadata) -> Signal:
        return Signal(self.df, replace(self.header, metadata={**self.header.metadata, **metadata}), self.previous, self._n)

    def with_channel_extra(self, query, **extra) -> Signal:
        ids = self.channel_ids(query)
        return Signal(self.df, replace(self.header, channels=tuple(replace(c, extra={**c.extra, **extra}) if c.id in ids else c for c in self.channels)), self.previous, self._n)

    def with_source_time_offset(self, offset) -> Signal:
        each = [offset] * self.n_channels if isinstance(offset, (int, float)) else list(offset)
        return Signal(self.df, replace(self.header, channels=tuple(replace(c, offset=float(o)) for c, o in zip(self.channels, each, strict=True))), self.previous, self._n)

    def with_calibration(self, values) -> Signal:
        """Factors for all channels: a number for each (list), one for all (number), or by label."""
        by = {c.label: f for c, f in zip(self.channels, values, strict=True)} if isinstance(values, (list, tuple, np.ndarray)) else values if isinstance(values, dict) else {c.label: values for c in self.channels}
        return Signal(self.df, replace(self.header, channels=tuple(replace(c, factor=float(by[c.label])) if c.label in by else c for c in self.channels)), self.previous, self._n)

    def derive_calibration(self, target_rms: float | None = None, target_level: float | None = None, unit: str | None = None) -> Signal:
        channels = tuple(c.with_unit(unit) if unit else c for c in self.channels)
        got = stats.derived_factors(self._calibrated(), {c.id: c.factor for c in channels}, target_rms, target_level, {c.id: c.ref for c in channels})
        return Signal(self.df, replace(self.header, channels=tuple(replace(c, factor=got[c.id]) for c in channels)), self.previous, self._n)

    @operation("astype")
    def astype(self, dtype: str) -> Signal:
        """Another precision: float32 or float64 of real signals, complex64 or complex128 of complex ones."""
        parts, names = (["re", "im"], {"complex64": "float", "complex128": "double"}) if self.kind in COMPLEX else (["value"], {"float32": "float", "float64": "double"})
        if dtype not in names:
            raise ValueError(f"signals of kind {self.kind} become {' or '.join(names)}")
        return self._new(self.df.withColumns({p: F.col(p).cast(names[dtype]) for p in parts}), "astype", {"dtype": dtype}, n=self._n)

    # ---- time domain ---------------------------------------------------------

    @operation("cut_samples")
    def cut_samples(self, first: int, end: int) -> Signal:
        """Samples first to end: what a slice of time becomes."""
        self._need("time")
        return self._cut(first, end)

    def _cut(self, first: int, end: int) -> Signal:
        moved = tuple(replace(c, offset=c.offset + first / self.rate) for c in self.channels)
        return self._new(pointwise.trim(self.df, first, end), "trim", {"first": first, "end": end}, n=None if self._n is None else max(0, min(end, self._n) - first), channels=moved)

    @operation("trim")
    def trim(self, start: float = 0.0, end: float | None = None) -> Signal:
        self._need("time")
        if start < 0 or (end is not None and end < start):
            raise ValueError("times are in order and not negative")
        return self._cut(int(start * self.rate), int(end * self.rate) if end is not None else self.n_samples())

    @operation("fix_length")
    def fix_length(self, length: int | None = None, duration: float | None = None) -> Signal:
        self._need("time")
        if (length is None) == (duration is None):
            raise ValueError("give a length or a duration")
        n = length if length is not None else int(duration * self.rate)
        return self._new(pointwise.fix_length(self.df, n), "fix_length", {"length": n}, n=n)

    def _arith(self, other, op: str, reverse: bool = False) -> Signal:
        sign = {"add": "+", "sub": "-", "mul": "*", "div": "/", "pow": "**"}[op]
        if isinstance(other, (bool, np.bool_)):
            raise TypeError("truth values are no operands")
        if isinstance(other, np.ndarray):
            if reverse:
                return NotImplemented
            self._need("time")
            wide = np.broadcast_to(np.asarray(other, float), (self.n_channels, self.n_samples()))
            other = from_numpy(self.df.sparkSession, wide, self.rate, frame_id=self._one_frame())
        if self.kind != "time":
            return self._spectral_arith(other, op, reverse, sign)
        if isinstance(other, (int, float, np.integer, np.floating)):
            other = other.item() if isinstance(other, np.generic) else other
            df = pointwise.with_scalar(self._calibrated(), op, float(other), reverse)
            label = (lambda x: f"({other} {sign} {x})") if reverse else (lambda x: f"({x} {sign} {other})")
            return self._pointwise(df, op, {"scalar": other, "reverse": reverse}, channels=tuple(replace(c, factor=1.0, label=label(c.label)) for c in self.channels))
        if not isinstance(other, Signal):
            return NotImplemented
        if self.rate != other.rate or self.n_channels != other.n_channels or self.kind != other.kind or self.n_samples() != other.n_samples():
            raise ValueError("both signals have the same kind, rate, channels and length")
        df = pointwise.with_signal(self._calibrated(), other._calibrated(), op, {a.id: b.id for a, b in zip(self.channels, other.channels)})
        channels = tuple(replace(a, factor=1.0, label=f"({a.label} {sign} {b.label})") for a, b in zip(self.channels, other.channels))
        return self._new(df, op, {}, (other,), n=self._n, channels=channels)

    def _one_frame(self) -> str:
        """The only recording's frame_id, which an array is joined to."""
        ids = [r[0] for r in self.df.select("frame_id").distinct().limit(2).collect()]
        if len(ids) != 1:
            raise ValueError("an array joins one recording")
        return ids[0]

    def _spectral_arith(self, other, op: str, reverse: bool, sign: str) -> Signal:
        """Arithmetic of spectra: bins join on the kind's indices; both need the same axis, window and channels."""
        if self.kind in PAIRS or self.kind == "bands":
            raise ValueError(f"signals of kind {self.kind} have no arithmetic")
        parts = ["re", "im"] if self.kind in COMPLEX else ["value"]
        number = isinstance(other, (int, float, complex, np.number))
        if number:
            z = complex(other)
            if z.imag and self.kind not in COMPLEX:
                raise ValueError(f"signals of kind {self.kind} are real")
            df = pointwise.complex_scalar(self.df, op, z, reverse) if self.kind in COMPLEX else pointwise.with_scalar(self.df, op, z.real, reverse)
            label = (lambda x: f"({other} {sign} {x})") if reverse else (lambda x: f"({x} {sign} {other})")
            return self._new(df, op, {"scalar": other, "reverse": reverse}, n=self._n, channels=tuple(replace(c, label=label(c.label)) for c in self.channels))
        if not isinstance(other, Signal):
            return NotImplemented
        same = ("kind", "rate", "n_channels")
        if any(getattr(self, k) != getattr(other, k) for k in same) or self.header.params != other.header.params:
            raise ValueError("both signals have the same kind, rate, channels, axis and window")
        df = pointwise.with_spectrum(self.df, other.df, op, {a.id: b.id for a, b in zip(self.channels, other.channels)}, INDEX[self.kind], parts)
        return self._new(df, op, {}, (other,), n=self._n, channels=tuple(replace(a, label=f"({a.label} {sign} {b.label})") for a, b in zip(self.channels, other.channels)))

    #: NumPy leaves operators with a signal on the right to the signal.
    __array_ufunc__ = None

    def __add__(self, o):
        return self._arith(o, "add")

    def __sub__(self, o):
        return self._arith(o, "sub")

    def __mul__(self, o):
        return self._arith(o, "mul")

    def __truediv__(self, o):
        return self._arith(o, "div")

    def __pow__(self, o):
        return self._arith(o, "pow")

    def __radd__(self, o):
        return self._arith(o, "add", True)

    def __rsub__(self, o):
        return self._arith(o, "sub", True)

    def __rmul__(self, o):
        return self._arith(o, "mul", True)

    def __rtruediv__(self, o):
        return self._arith(o, "div", True)

    def __rpow__(self, o):
        return self._arith(o, "pow", True)

    @operation("abs")
    def abs(self) -> Signal:
        if self.kind == "stft":
            df = self.df.select(*KEY, "frame_idx", "freq_idx", levels.magnitude(F.col("re"), F.col("im")).alias("value"))
            return self._new(df, "abs", kind="magnitude")
        self._need("time")
        return self._pointwise(pointwise.absolute(self._calibrated()), "abs", label="abs")

    @operation("power")
    def power(self, exponent: float = 2.0) -> Signal:
        return self._pointwise(pointwise.power(self._calibrated(), exponent), "power", {"exponent": exponent}, "power")

    @operation("remove_dc")
    def remove_dc(self) -> Signal:
        return self._pointwise(stats.remove_dc(self._calibrated()), "remove_dc", {}, "dcRM")

    @operation("normalize")
    def normalize(self, norm: float = math.inf, axis: int | None = -1, threshold: float | None = None, fill: bool | None = None) -> Signal:
        df = stats.normalize(self._calibrated(), norm, axis is None, threshold, fill)
        return self._pointwise(df, "normalize", {"norm": norm, "axis": axis, "threshold": threshold, "fill": fill}, "norm")

    @operation("fade")
    def fade(self, fade_ms: float = 50.0) -> Signal:
        return self._pointwise(pointwise.fade(self._calibrated(), round(fade_ms * self.rate / 1000)), "fade", {"fade_ms": fade_ms}, "fade")

    @operation("channel_difference")
    def channel_difference(self, other_channel=0) -> Signal:
        ref = self.channel_ids(other_channel)[0]
        return self._pointwise(pointwise.difference(self._calibrated(), ref), "channel_difference", {"other_channel": other_channel}, "diff")

    def _across(self, how: str) -> Signal:
        units, offsets = {c.unit for c in self.channels}, {c.offset for c in self.channels}
        one = Channel(how, how, units.pop() if len(units) == 1 else "", offset=offsets.pop() if len(offsets) == 1 else 0.0)
        return self._new(stats.across_channels(self._calibrated(), how), how, n=self._n, channels=(one,))

    @operation("sum")
    def sum(self) -> Signal:
        return self._across("sum")

    @operation("mean")
    def mean(self) -> Signal:
        return self._across("mean")

    def concat_frame(self, other: Signal, label_prefix: str | None = None, suffix_on_dup: str | None = None) -> Signal:
        if self.rate != other.rate:
            raise ValueError("sampling rates differ")
        taken, ids, new, rename = set(self.labels), {c.id for c in self.channels}, [], {}
        for c in other.channels:
            label = f"{label_prefix}_{c.label}" if label_prefix else c.label
            if label in taken:
                if suffix_on_dup is None:
                    raise ValueError(f"label {label!r} is taken")
                label += suffix_on_dup
            new_id = next(i for i in (c.id, *(f"c{k}" for k in range(10**6))) if i not in ids)
            rename[c.id] = new_id
            taken.add(label)
            ids.add(new_id)
            new.append(replace(c, id=new_id, label=label))
        return self._new(pointwise.concat(self.df, other.df, rename), "concat_frame", {}, (other,), n=self._n, channels=(*self.channels, *new))

    def add_channel(self, data: np.ndarray, label: str | None = None, align: str = "strict", suffix_on_dup: str | None = None, source_time_offset: float | list | None = None) -> Signal:
        """One more channel from an array on the driver: (samples,) or (1, samples). align "pad" adds zeros to a shorter one, "truncate" cuts a longer one."""
        self._need("time")
        if not isinstance(data, np.ndarray):
            raise TypeError("a channel is added from an array; concat_frame() takes signals")
        if data.ndim != 1 and not (data.ndim == 2 and len(data) == 1):
            raise ValueError("one channel is (samples,) or (1, samples)")
        values, n = np.asarray(data, float).reshape(-1), self.n_samples()
        if align not in ("strict", "pad", "truncate") or (align == "strict" and len(values) != n) or (align == "pad" and len(values) > n) or (align == "truncate" and len(values) < n):
            raise ValueError(f"lengths {n} and {len(values)} do not align as {align!r}")
        values = np.pad(values[:n], (0, n - len(values[:n])))
        new_label = label or f"ch{self.n_channels}"
        if new_label in self.labels:
            if not suffix_on_dup:
                raise ValueError(f"label {new_label!r} is taken")
            new_label += suffix_on_dup
        offset = float(np.asarray(0.0 if source_time_offset is None else source_time_offset, float).reshape(-1)[0])
        one = from_numpy(self.df.sparkSession, values, self.rate, channel_labels=[new_label], frame_id=self._one_frame())
        out = self.concat_frame(Signal(one.df, replace(one.header, channels=(replace(one.channels[0], offset=offset),)), n=n))
        return Signal(out.df, replace(out.header, lineage=Step("add_channel", {"label": new_label}, (self.header.lineage or self.header.label or "input", "array"))), self, n)

    def mix(self, other: Signal, align: str = "strict", snr_db: float | None = None) -> Signal:
        """Add other; align "pad" takes a shorter, "truncate" a longer one."""
        if self.rate != other.rate or other.n_channels not in (1, self.n_channels):
            raise ValueError("rates are equal, and channels are as many or one")
        mine, theirs = self.n_samples(), other.n_samples()
        if align not in ("strict", "pad", "truncate") or (align == "strict" and mine != theirs) or (align == "pad" and theirs >= mine) or (align == "truncate" and theirs <= mine):
            raise ValueError(f"lengths {mine} and {theirs} do not align as {align!r}")
        side = other._calibrated()
        if other.n_channels == 1:
            side = side.select("frame_id", F.explode(F.array(*[F.lit(c.id) for c in self.channels])).alias("channel_id"), "sample_idx", "value")
        else:
            side = pointwise.concat(side.limit(0), side, {b.id: a.id for a, b in zip(self.channels, other.channels)})
        side = side.where(F.col("sample_idx") < mine)
        df = pointwise.mix(self._calibrated(), side) if snr_db is None else pointwise.mix_snr(self._calibrated(), side, snr_db)
        return self._new(df, "mix", {"align": align, "snr_db": snr_db}, (other,), n=mine, channels=self._unit_factors())

    @operation("low_pass_filter")
    def low_pass_filter(self, cutoff: float, order: int = 4) -> Signal:
        return self._pointwise(filters.low_pass(self._calibrated(), cutoff, self.rate, order), "low_pass_filter", {"cutoff": cutoff, "order": order}, "lpf")

    @operation("high_pass_filter")
    def high_pass_filter(self, cutoff: float, order: int = 4) -> Signal:
        return self._pointwise(filters.high_pass(self._calibrated(), cutoff, self.rate, order), "high_pass_filter", {"cutoff": cutoff, "order": order}, "hpf")

    @operation("band_pass_filter")
    def band_pass_filter(self, low_cutoff: float, high_cutoff: float, order: int = 4) -> Signal:
        return self._pointwise(filters.band_pass(self._calibrated(), low_cutoff, high_cutoff, self.rate, order), "band_pass_filter", {"low_cutoff": low_cutoff, "high_cutoff": high_cutoff, "order": order}, "bpf")

    @operation("a_weighting")
    def a_weighting(self) -> Signal:
        return self._pointwise(filters.frequency_weighting(self._calibrated(), self.rate), "a_weighting", {}, "Aw")

    @operation("resampling")
    def resampling(self, target_sr: float) -> Signal:
        check_rate(target_sr)
        up, down = filters.ratio(self.rate, target_sr)
        n = None if self._n is None else -(-self._n * up // down)
        return self._pointwise(filters.resample(self._calibrated(), self.rate, target_sr), "resampling", {"target_sr": target_sr}, "rs", n=n, rate=float(target_sr))

    @operation("hpss_harmonic")
    def hpss_harmonic(
        self, kernel_size: int = 31, power: float = 2.0, margin: float = 1.0, n_fft: int = 2048, hop_length: int | None = None, win_length: int | None = None,
        window: str = "hann", center: bool = True, pad_mode: str = "constant",
    ) -> Signal:
        return self._hpss("harmonic", "Hrm", kernel_size, power, margin, n_fft, hop_length, win_length, window, center, pad_mode)

    @operation("hpss_percussive")
    def hpss_percussive(
        self, kernel_size: int = 31, power: float = 2.0, margin: float = 1.0, n_fft: int = 2048, hop_length: int | None = None, win_length: int | None = None,
        window: str = "hann", center: bool = True, pad_mode: str = "constant",
    ) -> Signal:
        return self._hpss("percussive", "Prc", kernel_size, power, margin, n_fft, hop_length, win_length, window, center, pad_mode)

    def _hpss(self, which: str, short: str, *options) -> Signal:
        return self._pointwise(filters.hpss(self._calibrated(), which, *options), f"hpss_{which}", {}, short)

    @operation("rms_trend")
    def rms_trend(self, frame_length: int = 2048, hop_length: int = 512, dB: bool = False, Aw: bool = False, wide_range: bool = False) -> Signal:
        """RMS of frames. wide_range looks at each channel's greatest magnitude first, so that squares of values like 1e200 or 1e-200 neither overflow nor vanish."""
        curve, refs = "A" if Aw else "Z", {c.id: c.ref for c in self.channels}
        df, scales = windowed.scaled(self._calibrated()) if wide_range else (self._calibrated(), None)
        out = windowed.rms_trend(filters.frequency_weighting(df, self.rate, curve), frame_length, hop_length, dB and not wide_range, refs)
        out = windowed.unscaled(out, scales, dB, refs, 20 * math.log10(levels.AMPLITUDE_FLOOR)) if wide_range else out
        return self._pointwise(out, "rms_trend", {"frame_length": frame_length, "hop_length": hop_length, "dB": dB, "Aw": Aw}, "RMS", n=None, rate=self.rate / hop_length)

    @operation("sound_level")
    def sound_level(self, freq_weighting: str = "Z", time_weighting: str = "Fast", dB: bool = False, wide_range: bool = False) -> Signal:
        """Time-weighted level; wide_range as in rms_trend()."""
        tau, refs = {"Fast": windowed.FAST, "Slow": windowed.SLOW}[time_weighting], {c.id: c.ref for c in self.channels}
        df, scales = windowed.scaled(self._calibrated()) if wide_range else (self._calibrated(), None)
        out = windowed.sound_level(filters.frequency_weighting(df, self.rate, freq_weighting), self.rate, tau, dB and not wide_range, refs)
        out = windowed.unscaled(out, scales, dB, refs, 10 * math.log10(levels.POWER_FLOOR)) if wide_range else out
        return self._pointwise(out, "sound_level", {"freq_weighting": freq_weighting, "time_weighting": time_weighting, "dB": dB}, f"L{freq_weighting}")

    def _heard(self, what: str, name: str, field_type: str, weighting: str = "din") -> Signal:
        df = loudness.varying(self._calibrated(), self.rate, what, field_type, weighting)
        unit = "sone" if what == "loudness" else "acum"
        return self._pointwise(df, name, {}, n=None, rate=float(loudness.zwicker.RATE), channels=tuple(replace(c.with_unit(unit), factor=1.0, label=f"{name}({c.label})") for c in self.channels))

    @operation("loudness_zwtv")
    def loudness_zwtv(self, field_type: str = "free") -> Signal:
        """Loudness over time in sone (ISO 532-1), 500 values a second; values are sound pressure in pascal."""
        return self._heard("loudness", "loudness_zwtv", field_type)

    @operation("sharpness_din")
    def sharpness_din(self, weighting: str = "din", field_type: str = "free") -> Signal:
        """Sharpness over time in acum (DIN 45692), 500 values a second."""
        return self._heard("sharpness", "sharpness_din", field_type, weighting)

    def _steady(self, which: str, field_type: str, weighting: str = "din") -> dict[str, float]:
        got = {r.channel_id: r[which] for r in loudness.steady(self._calibrated(), self.rate, field_type, weighting).collect()}
        return {c.label: got.get(c.id, 0.0) for c in self.channels}

    def loudness_zwst(self, field_type: str = "free") -> dict[str, float]:
        """Loudness in sone of a sound that does not change (ISO 532-1)."""
        return self._steady("loudness", field_type)

    def sharpness_din_st(self, weighting: str = "din", field_type: str = "free") -> dict[str, float]:
        """Sharpness in acum of a sound that does not change (DIN 45692)."""
        return self._steady("sharpness", field_type, weighting)

    def rms(self) -> dict[str, float]:
        got = {r.channel_id: r.rms for r in stats.rms(self._calibrated()).collect()}
        return {c.label: got.get(c.id, 0.0) for c in self.channels}

    def crest_factor(self) -> dict[str, float]:
        got = {r.channel_id: r.crest_factor for r in stats.crest_factor(self._calibrated()).collect()}
        return {c.label: got.get(c.id, 1.0) for c in self.channels}

    def levels(self) -> dict[str, float]:
        return {c.label: LevelReference(c.ref, c.unit).level(v) for c, v in zip(self.channels, self.rms().values())}

    def level_trigger(self, level: float, offset: int = 0, hold: int = 1) -> DataFrame:
        return windowed.level_trigger(self._calibrated(), level, offset, hold)

    def cut_sig(self, points: DataFrame, cut_len: int, taper_rate: float = 0.0, dc_cut: bool = False) -> DataFrame:
        return windowed.cut(self._calibrated(), points, cut_len, taper_rate, dc_cut)

    # ---- spectra ---------------------------------------------------------------

    def _spectral(self, df: DataFrame, name: str, kind: str, **params) -> Signal:
        return self._new(df, name, params, kind=kind, params={**params, "length": self._n}, channels=self._unit_factors(None if kind in PAIRS else name))

    @operation("fft")
    def fft(self, n_fft: int | None = None, window: str = "hann") -> Signal:
        self._need("time")
        n_fft = n_fft or self.n_samples()
        return self._spectral(spectral.fft(self._calibrated(), n_fft, window), "fft", "spectrum", n_fft=n_fft, window=window)

    @operation("ifft")
    def ifft(self) -> Signal:
        self._need("spectrum")
        p = self.header.params
        return self._new(spectral.ifft(self.df, p["n_fft"], p["window"]), "ifft", kind="time", params={}, n=p["n_fft"])

    @operation("stft")
    def stft(self, n_fft: int = 2048, hop_length: int | None = None, win_length: int | None = None, window: str = "hann") -> Signal:
        self._need("time")
        hop, win, n = hop_length or n_fft // 4, win_length or n_fft, self.n_samples()
        return self._spectral(spectral.stft(self._calibrated(), n, n_fft, hop, win, window), "stft", "stft", n_fft=n_fft, hop=hop, win_length=win, window=window)

    @operation("istft")
    def istft(self) -> Signal:
        self._need("stft")
        p = self.header.params
        return self._new(spectral.istft(self.df, p["n_fft"], p["hop"], p["win_length"], p["window"], p["length"]), "istft", kind="time", params={}, n=p["length"])

    to_channel_frame = istft

    @operation("welch")
    def welch(self, n_fft: int = 2048, hop_length: int | None = None, win_length: int | None = None, window: str = "hann", average: str = "mean") -> Signal:
        self._need("time")
        return self._spectral(spectral.welch(self._calibrated(), n_fft, hop_length, win_length, window, average, self.rate), "welch", "amplitude", n_fft=n_fft, hop=hop_length, win_length=win_length, window=window, average=average)

    @operation("csd")
    def csd(self, n_fft: int = 2048, hop_length: int | None = None, win_length: int | None = None, window: str = "hann", detrend: str = "constant", scaling: str = "spectrum", average: str = "mean") -> Signal:
        self._need("time")
        return self._spectral(spectral.csd(self._calibrated(), n_fft, hop_length, win_length, window, detrend, scaling, average, self.rate), "csd", "csd", n_fft=n_fft, hop=hop_length, win_length=win_length, window=window, scaling=scaling)

    @operation("coherence")
    def coherence(self, n_fft: int = 2048, hop_length: int | None = None, win_length: int | None = None, window: str = "hann", detrend: str = "constant") -> Signal:
        self._need("time")
        return self._spectral(spectral.coherence(self._calibrated(), n_fft, hop_length, win_length, window, detrend), "coherence", "coherence", n_fft=n_fft, hop=hop_length, win_length=win_length, window=window)

    @operation("transfer_function")
    def transfer_function(self, n_fft: int = 2048, hop_length: int | None = None, win_length: int | None = None, window: str = "hann", detrend: str = "constant", scaling: str = "spectrum", average: str = "mean") -> Signal:
        self._need("time")
        return self._spectral(spectral.transfer_function(self._calibrated(), n_fft, hop_length, win_length, window, detrend, scaling, average, self.rate), "transfer_function", "transfer", n_fft=n_fft, hop=hop_length, win_length=win_length, window=window, scaling=scaling)

    # ---- pairs: rows are output-major over the source channels, or as selected ----

    @property
    def pairs(self) -> list[Pair]:
        self._need(*PAIRS)
        by = {c.id: c for c in self.channels}
        ids = self.header.params.get("pairs") or [(o.id, i.id) for o in self.channels for i in self.channels]
        return [Pair(by[o], by[i], self.kind, self.header.params.get("scaling")) for o, i in ids]

    def pair_at(self, row: int) -> Pair:
        """The pair of a row; its channels are known by id, not by label."""
        if isinstance(row, bool) or not isinstance(row, (int, np.integer)):
            raise TypeError("a row is a whole number")
        return self.pairs[int(row)]

    get_pair = pair_at

    def _source(self, which) -> str:
        if isinstance(which, bool) or not isinstance(which, (int, np.integer, str)):
            raise TypeError("a source channel is a number or an id")
        if isinstance(which, str):
            if which not in {c.id for c in self.channels}:
                raise KeyError(f"no source channel {which!r}; labels are no identity here")
            return which
        return self.channels[int(which)].id

    def pair_row_index(self, output, input) -> int:  # noqa: A002
        wanted = (self._source(output), self._source(input))
        rows = [(p.output.id, p.input.id) for p in self.pairs]
        if wanted not in rows:
            raise KeyError(f"pair {wanted} is not selected")
        return rows.index(wanted)

    @operation("select_pair")
    def select_pair(self, output, input) -> Signal:  # noqa: A002
        return self.select_pairs([self.pair_row_index(output, input)])

    def select_pairs(self, rows: list[int]) -> Signal:
        """The pairs of some rows, in that order."""
        if isinstance(rows, (str, bytes)) or not len(rows):
            raise ValueError("name one row at least, in a sequence")
        chosen = [self.pair_at(r) for r in rows]
        ids = [(p.output.id, p.input.id) for p in chosen]
        if len(set(ids)) != len(ids):
            raise ValueError("select a pair once")
        listed = self.df.sparkSession.createDataFrame(ids, "out_ch string, in_ch string")
        df = self.df.join(F.broadcast(listed) if len(ids) <= 100_000 else listed, ["out_ch", "in_ch"], "left_semi")
        return self._new(df.select(self.df.columns), "select_pairs", {"rows": list(map(int, rows))}, params={**self.header.params, "pairs": ids})

    @operation("cepstrum")
    def cepstrum(self, n_fft: int | None = None, window: str = "hann", floor: float = 1e-12) -> Signal:
        if self.kind == "stft":
            return self._spectral(spectral.cepstrogram(self.df, self.header.params["n_fft"], floor), "cepstrum", "cepstrogram", n_fft=self.header.params["n_fft"], hop=self.header.params["hop"])
        self._need("time")
        n_fft = n_fft or self.n_samples()
        return self._spectral(spectral.cepstrum(self._calibrated(), n_fft, window, floor), "cepstrum", "cepstrum", n_fft=n_fft, window=window)

    @operation("lifter")
    def lifter(self, cutoff: float, mode: str = "low") -> Signal:
        self._need("cepstrum", "cepstrogram")
        if mode not in ("low", "high"):
            raise ValueError("mode is low or high")
        return self._new(spectral.lifter(self.df, self.header.params["n_fft"], math.floor(cutoff * self.rate), mode), "lifter", {"cutoff": cutoff, "mode": mode})

    @operation("to_spectral_envelope")
    def to_spectral_envelope(self) -> Signal:
        self._need("cepstrum", "cepstrogram")
        keys = [*KEY, "frame_idx"] if self.kind == "cepstrogram" else list(KEY)
        return self._new(spectral.envelope(self.df, self.header.params["n_fft"], keys), "to_spectral_envelope", kind="magnitude" if self.kind == "cepstrogram" else "amplitude")

    @operation("noct_spectrum")
    def noct_spectrum(self, fmin: float = 25, fmax: float = 20000, n: int = 3, G: int = 10, fr: float = 1000) -> Signal:
        self._need("time")
        return self._spectral(filters.noct_spectrum(self._calibrated(), self.rate, spectral.octave_bands(fmin, fmax, n, G, fr)), "noct_spectrum", "bands", fmin=fmin, fmax=fmax, n=n, G=G, fr=fr)

    @operation("noct_synthesis")
    def noct_synthesis(self, fmin: float = 25, fmax: float = 20000, n: int = 3, G: int = 10, fr: float = 1000) -> Signal:
        self._need("spectrum")
        if self.rate != 48000:
            raise ValueError("band synthesis needs a rate of 48000 Hz")
        return self._spectral(spectral.noct_synthesis(self.df, self.rate, self.header.params["n_fft"], spectral.octave_bands(fmin, fmax, n, G, fr)), "noct_synthesis", "bands", fmin=fmin, fmax=fmax, n=n, G=G, fr=fr)

    @operation("get_frame_at")
    def get_frame_at(self, frame_idx: int) -> Signal:
        self._need("stft", "magnitude")
        return self._new(spectral.frame_at(self.df, frame_idx), "get_frame_at", {"frame_idx": frame_idx}, kind="spectrum" if self.kind == "stft" else "amplitude")

    def unwrapped_phase(self) -> DataFrame:
        self._need("spectrum")
        return spectral.unwrapped_phase(self.df)

    def view(self, name: str) -> DataFrame:
        """magnitude, phase, power, dB or dBA of a spectrum, as value."""
        re, im = (F.col("re"), F.col("im")) if self.kind in COMPLEX else (F.col("value"), F.lit(0.0))
        size, df = levels.magnitude(re, im), self.df
        ref: Column | float = 1.0
        if self.kind not in PAIRS and any(c.ref != 1.0 for c in self.channels):
            df = with_channel_values(df, {c.id: c.ref for c in self.channels}, "_ref", 1.0)
            ref = F.col("_ref")
        db = levels.level_db(size, ref)
        freq = F.col("freq_idx") * F.lit(self.rate / self.header.params.get("n_fft", 1)) if "freq_idx" in self.df.columns else F.col("center") if self.kind == "bands" else None
        if name == "dBA" and (self.kind in PAIRS or freq is None):
            raise ValueError("no A-weighted view of this kind")
        value: Column = {"magnitude": lambda: size, "phase": lambda: levels.phase(re, im), "power": lambda: size * size, "dB": lambda: db, "dBA": lambda: db + levels.a_weighting_db(freq)}[name]()
        keep = [c for c in self.df.columns if c not in ("re", "im", "value")]
        return df.select(*keep, value.alias("value"))

    def plot_tables(self, n_fft: int = 2048, hop_length: int | None = None, win_length: int | None = None, window: str = "hann", Aw: bool = False) -> dict[str, DataFrame]:
        """What a summary of a time signal draws, as plans: waveform, spectrum (Welch) and spectrogram, with their axes; spectra in dB, or A-weighted."""
        self._need("time")
        view = "dBA" if Aw else "dB"
        drawn = lambda s: Signal(s.view(view), s.header).with_axis()
        power, short = self.welch(n_fft, hop_length, win_length, window), self.stft(n_fft, hop_length, win_length, window)
        short = Signal(short.df, replace(short.header, params={**short.header.params, "hop": hop_length or n_fft // 4}))
        return {"waveform": Signal(self._calibrated(), self.header).with_axis(), "spectrum": drawn(power), "spectrogram": drawn(short)}

    def describe(self) -> DataFrame:
        """A row for each channel of each recording: its samples, least, greatest and mean value, RMS, crest factor and level in dB."""
        self._need("time")
        rms = F.sqrt(F.avg(F.col("value") * F.col("value")))
        peak = F.max(F.abs("value"))
        out = self._calibrated().groupBy(*KEY).agg(
            F.count(F.lit(1)).alias("n"), F.min("value").alias("min"), F.max("value").alias("max"), F.avg("value").alias("mean"), rms.alias("rms"), F.when(rms > 0, peak / rms).otherwise(1.0).alias("crest_factor")
        )
        return with_channel_values(out, {c.id: c.ref for c in self.channels}, "_ref", 1.0).withColumn("level", levels.level_db(F.col("rms"), F.col("_ref"))).drop("_ref")

    # ---- hand-offs --------------------------------------------------------------

    def apply(self, func: Callable[[np.ndarray], np.ndarray], **changes) -> Signal:
        """func over each channel's samples (one array in, one out), in Arrow batches; not part of saved plans."""

        def run(frames):
            for pdf in frames:
                yield pd.DataFrame({"frame_id": pdf["frame_id"], "channel_id": pdf["channel_id"], "start": 0, "values": [np.asarray(func(np.asarray(v, float)), float) for v in pdf["values"]]})

        packed = spectral.channel_arrays(self._calibrated()).mapInPandas(run, "frame_id string, channel_id string, start long, values array<double>")
        return self._new(filters.unblock(packed), "apply", {}, channels=self._unit_factors(), **changes)

    def cache(self) -> Signal:
        return Signal(self.df.persist(), self.header, self.previous, self._n)

    def to_numpy(self, frame_id: str | None = None) -> np.ndarray:
        """Channels by samples of one recording, calibrated, on the driver; one channel is a vector."""
        df = self._calibrated() if self.kind == "time" else self.df
        df = df.where(F.col("frame_id") == frame_id) if frame_id else df
        index = INDEX[self.kind]
        pdf = df.toPandas()
        if pdf.frame_id.nunique() > 1:
            raise ValueError("name one recording")
        values = pdf["re"] + 1j * pdf["im"] if self.kind in COMPLEX else pdf["value"]
        out = []
        for c in self.channels:
            mine = pdf.channel_id == c.id
            part = values[mine].to_numpy()[np.lexsort([pdf.loc[mine, i] for i in index[::-1]])]
            out.append(part.reshape([pdf.loc[mine, i].nunique() for i in index]) if len(index) > 1 else part)
        return np.stack(out).squeeze(0) if len(out) == 1 else np.stack(out)

    def to_dataframe(self) -> DataFrame:
        """One column for each channel, a row for each index."""
        if len(INDEX[self.kind]) > 1 or self.kind in COMPLEX:
            raise ValueError("only one real axis makes a table")
        df = self._calibrated() if self.kind == "time" else self.df
        wide = df.groupBy("frame_id", *INDEX[self.kind]).pivot("channel_id", [c.id for c in self.channels]).agg(F.first("value"))
        return wide.toDF("frame_id", *INDEX[self.kind], *self.labels)


def from_numpy(spark: SparkSession, data: np.ndarray, rate: float, label: str = "", channel_labels: list[str] | None = None, units: list[str] | str | None = None, metadata: dict | None = None, frame_id: str = "frame") -> Signal:
    """A signal of an array on the driver: samples, or channels by samples."""
    data = np.atleast_2d(np.asarray(data, float))
    if data.ndim != 2:
        raise ValueError("an array has one or two dimensions")
    labels = channel_labels or [f"ch{i}" for i in range(len(data))]
    units = [units] * len(data) if isinstance(units, str) else units or [""] * len(data)
    channels = tuple(Channel(f"c{i}", n, u) for i, (n, u) in enumerate(zip(labels, units, strict=True)))
    rows = [(frame_id, c.id, 0, row.tolist()) for c, row in zip(channels, data, strict=True)]
    df = filters.unblock(spark.createDataFrame(rows, "frame_id string, channel_id string, start long, values array<double>"))
    return Signal(df, Header("time", check_rate(rate), channels, {}, label, metadata or {}), n=data.shape[1])


def generate_sin(spark: SparkSession, freqs: float | list[float] = 1000.0, sampling_rate: float = 16000, duration: float = 1.0, label: str = "Generated Sin") -> Signal:
    """A sine of amplitude 1 for each frequency, generated on the executors."""
    freqs = [freqs] if isinstance(freqs, (int, float)) else list(freqs)
    n = int(sampling_rate * duration)
    table = F.array(*[F.struct(F.lit(f"c{i}").alias("channel_id"), F.lit(float(f)).alias("f")) for i, f in enumerate(freqs)])
    df = spark.range(n).select(F.col("id").alias("sample_idx"), F.explode(table).alias("_c")).select(
        F.lit("frame").alias("frame_id"), "_c.channel_id", "sample_idx", F.sin(F.lit(2 * math.pi) * F.col("_c.f") * F.col("sample_idx") / F.lit(float(sampling_rate))).alias("value")
    )
    return Signal(df, Header("time", check_rate(sampling_rate), tuple(Channel(f"c{i}", f"Channel {i + 1}") for i in range(len(freqs))), {}, label), n=n)


def load_sample_signal(frequency: float = 5.0, sampling_rate: int = 100, duration: float = 1.0) -> np.ndarray:
    """A sine as an array on the driver, to try things with."""
    return np.sin(2 * np.pi * frequency * np.arange(int(sampling_rate * duration)) / sampling_rate)


def spectrogram_from_numpy(spark: SparkSession, data: np.ndarray, rate: float, n_fft: int, hop_length: int, win_length: int | None = None, window: str = "hann", label: str = "", channel_labels: list[str] | None = None, frame_id: str = "frame") -> Signal:
    """A short-time spectrum of a complex array on the driver: bins by frames, or channels by bins by frames. The length that istft() gives back is what its slices cover."""
    data = np.asarray(data, complex)
    data = data[None] if data.ndim == 2 else data
    if data.ndim != 3 or data.shape[1] != n_fft // 2 + 1:
        raise ValueError(f"a spectrogram has {n_fft // 2 + 1} bins and one or many channels")
    labels = channel_labels or [f"ch{i}" for i in range(len(data))]
    channels = tuple(Channel(f"c{i}", n) for i, n in enumerate(labels))
    rows = [(frame_id, c.id, t, z[:, t].real.tolist(), z[:, t].imag.tolist()) for c, z in zip(channels, data, strict=True) for t in range(z.shape[1])]
    arrays = spark.createDataFrame(rows, "frame_id string, channel_id string, frame_idx int, re array<double>, im array<double>")
    win, w = win_length or n_fft, windows.window(window, win_length or n_fft)
    low, _ = spectral.stft_span(0, w, hop_length)
    length = max(0, (data.shape[2] - 1 + low) * hop_length + 1)
    params = {"n_fft": n_fft, "hop": hop_length, "win_length": win, "window": window, "length": length}
    return Signal(spectral._exploded(arrays, [*KEY, "frame_idx"], "freq_idx"), Header("stft", check_rate(rate), channels, params, label), n=length)


__all__ = ["Pair", "Signal", "spectrogram_from_numpy", "from_numpy", "generate_sin", "load_sample_signal", "REGISTRY"]
