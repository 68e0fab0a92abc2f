"""pyspark.ml transformers over long tables of samples (frame_id, channel_id, sample_idx, value)."""

from __future__ import annotations

import math

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame

from ..operators import filters, stats


class _Rated(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    rate = Param(Params._dummy(), "rate", "samples a second", TypeConverters.toFloat)
    order = Param(Params._dummy(), "order", "filter order", TypeConverters.toInt)

    def __init__(self, **params):
        super().__init__()
        self._setDefault(order=4)
        self._set(**params)


class HighPass(_Rated):
    cutoff = Param(Params._dummy(), "cutoff", "Hz", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, rate: float | None = None, cutoff: float | None = None, order: int | None = None):
        super().__init__(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return filters.high_pass(dataset, self.getOrDefault("cutoff"), self.getOrDefault("rate"), self.getOrDefault("order"))


class LowPass(HighPass):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return filters.low_pass(dataset, self.getOrDefault("cutoff"), self.getOrDefault("rate"), self.getOrDefault("order"))


class BandPass(_Rated):
    low = Param(Params._dummy(), "low", "Hz", TypeConverters.toFloat)
    high = Param(Params._dummy(), "high", "Hz", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, rate: float | None = None, low: float | None = None, high: float | None = None, order: int | None = None):
        super().__init__(**{k: v for k, v in self._input_kwargs.items() if v is not None})

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return filters.band_pass(dataset, self.getOrDefault("low"), self.getOrDefault("high"), self.getOrDefault("rate"), self.getOrDefault("order"))


class RemoveDC(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    def _transform(self, dataset: DataFrame) -> DataFrame:
        return stats.remove_dc(dataset)


class Normalize(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    norm = Param(Params._dummy(), "norm", "order of the norm", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, norm: float = math.inf):
        super().__init__()
        self._setDefault(norm=math.inf)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return stats.normalize(dataset, self.getOrDefault("norm"))
