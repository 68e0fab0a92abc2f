"""Driver-side descriptions of signals: channels, calibration, headers and lineage. All values are immutable."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace

#: Reference pressure of sound levels in air, in pascal.
PA_REFERENCE = 2e-5


def check_rate(rate) -> float:
    if isinstance(rate, bool) or not isinstance(rate, (int, float)) or not math.isfinite(rate) or rate <= 0:
        raise ValueError(f"a sampling rate is a finite number above 0, not {rate!r}")
    return float(rate)


def unit_reference(unit: str) -> float:
    return PA_REFERENCE if unit == "Pa" else 1.0


@dataclass(frozen=True)
class LevelReference:
    """What 0 dB means."""

    value: float = 1.0
    unit: str = ""

    @property
    def label(self) -> str:
        return {"FS": "dBFS", "Pa": "dB SPL"}.get(self.unit, "dB")

    def level(self, rms: float, floor: float = 1e-12) -> float:
        return 20 * math.log10(max(abs(rms) / self.value, floor))


@dataclass(frozen=True)
class Channel:
    """One channel: a stable id, a label, its calibration (factor, unit, reference), time offset and free details."""

    id: str
    label: str = ""
    unit: str = ""
    ref: float | None = None
    factor: float = 1.0
    offset: float = 0.0
    extra: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.id:
            raise ValueError("a channel needs an id")
        if not self.factor > 0:
            raise ValueError("a calibration factor is above 0")
        if self.ref is None:
            object.__setattr__(self, "ref", unit_reference(self.unit))
        if not self.ref > 0:
            raise ValueError("a level reference is above 0")

    def with_unit(self, unit: str) -> Channel:
        return replace(self, unit=unit, ref=unit_reference(unit))

    @property
    def level_reference(self) -> LevelReference:
        return LevelReference(self.ref, self.unit)


@dataclass(frozen=True)
class Step:
    """One operation of a lineage: its name, version, parameters, and the lineages it read."""

    name: str
    params: dict = field(default_factory=dict)
    inputs: tuple = ()
    version: int = 1


@dataclass(frozen=True)
class Header:
    """What a signal's tables do not say: kind, sampling rate, channels, domain parameters, label, metadata and lineage."""

    kind: str
    rate: float
    channels: tuple[Channel, ...]
    params: dict = field(default_factory=dict)
    label: str = ""
    metadata: dict = field(default_factory=dict)
    lineage: Step | None = None

    def __post_init__(self):
        check_rate(self.rate)
        ids = [c.id for c in self.channels]
        if len(set(ids)) != len(ids):
            raise ValueError("channel ids are distinct")

    @property
    def labels(self) -> list[str]:
        return [c.label for c in self.channels]

    def history(self) -> list[str]:
        out, at = [], self.lineage
        while at is not None:
            out.append(at.name)
            at = next((i for i in at.inputs if isinstance(i, Step)), None)
        return out[::-1]

    def to_json(self) -> str:
        return json.dumps(
            {"kind": self.kind, "rate": self.rate, "channels": [c.__dict__ for c in self.channels], "params": self.params, "label": self.label, "metadata": self.metadata}, sort_keys=True
        )

    @staticmethod
    def from_json(text: str) -> Header:
        d = json.loads(text)
        return Header(d["kind"], d["rate"], tuple(Channel(**c) for c in d["channels"]), d["params"], d["label"], d["metadata"])
