"""Pipeline stages for the fitted steps that MLlib's own stages define differently.

MLlib's imputer takes a lower median, its scaler the sample deviation, and its indexer gives
unknown categories the next free code; these stages keep the exact median, the population
deviation, missing indicators fitted on training data, and grouped rare categories. Pipelines
built from them save and load as usual.
"""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame

from holdfast.functions.scalars import MISSING
from holdfast.operators import prep
from holdfast.session import durable


class _Columns(Params):
    columns = Param(Params._dummy(), "columns", "input columns", TypeConverters.toListString)

    def getColumns(self) -> list[str]:
        return self.getOrDefault(self.columns)


class MedianImputer(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Exact training medians, plus a 0/1 indicator for each column that had NULLs in training."""

    indicate = Param(Params._dummy(), "indicate", "add missing indicators", TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, *, columns=None, indicate=True):
        super().__init__()
        self._setDefault(indicate=True)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> MedianImputerModel:
        columns = self.getColumns()
        train = durable(dataset.select(*columns))
        medians = prep.fit_medians(train, columns)
        known = [c for c in columns if c in medians]  # a column without any value is left out
        flagged = prep.columns_with_nulls(train, known) if self.getOrDefault(self.indicate) else []
        return MedianImputerModel(columns=known, medians=[medians[c] for c in known], flagged=flagged)


class MedianImputerModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    medians = Param(Params._dummy(), "medians", "fitted medians", TypeConverters.toListFloat)
    flagged = Param(Params._dummy(), "flagged", "columns with an indicator", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, columns=None, medians=None, flagged=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def output_columns(self) -> list[str]:
        return self.getColumns() + [prep.indicator_name(c, "numeric") for c in self.getOrDefault(self.flagged)]

    def _transform(self, dataset: DataFrame) -> DataFrame:
        flagged = prep.add_indicators(dataset, self.getOrDefault(self.flagged), "numeric")
        return prep.impute(flagged, dict(zip(self.getColumns(), self.getOrDefault(self.medians))))


class Standardiser(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Zero mean and unit population deviation."""

    @keyword_only
    def __init__(self, *, columns=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> StandardiserModel:
        scales = prep.fit_scales(dataset, self.getColumns())
        known = list(scales)
        return StandardiserModel(columns=known, means=[scales[c][0] for c in known],
                                 deviations=[scales[c][1] for c in known])


class StandardiserModel(Model, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    means = Param(Params._dummy(), "means", "fitted means", TypeConverters.toListFloat)
    deviations = Param(Params._dummy(), "deviations", "fitted deviations", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, *, columns=None, means=None, deviations=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        pairs = zip(self.getOrDefault(self.means), self.getOrDefault(self.deviations))
        return prep.standardise(dataset, dict(zip(self.getColumns(), pairs)))


class CategoryFill(Transformer, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Categories as text, NULL as a category of its own, optionally with missing indicators."""

    flagged = Param(Params._dummy(), "flagged", "columns with an indicator", TypeConverters.toListString)
    marker = Param(Params._dummy(), "marker", "text for a missing category", TypeConverters.toString)

    @keyword_only
    def __init__(self, *, columns=None, flagged=None, marker=MISSING):
        super().__init__()
        self._setDefault(flagged=[], marker=MISSING)
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        flagged = prep.add_indicators(dataset, self.getOrDefault(self.flagged), "categorical")
        return prep.fill_categories(flagged, self.getColumns(), self.getOrDefault(self.marker))


class RareCategoryGrouper(Estimator, _Columns, DefaultParamsReadable, DefaultParamsWritable):
    """Fill NULL by the training mode, then give categories seen fewer than ``minFrequency`` times
    one shared name. Categories unseen in training become NULL.

    The category table stays a DataFrame: a column may have more categories than a driver holds.
    """

    minFrequency = Param(Params._dummy(), "minFrequency", "rows a category needs", TypeConverters.toInt)

    @keyword_only
    def __init__(self, *, columns=None, minFrequency=10):
        super().__init__()
        self._setDefault(minFrequency=10)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> RareCategoryGrouperModel:
        columns = self.getColumns()
        train = durable(dataset.select(*columns))
        modes = prep.fit_modes(train, columns)
        slots = prep.fit_onehot_slots(prep.impute(train, modes), columns, self.getOrDefault(self.minFrequency))
        model = RareCategoryGrouperModel(columns=columns, modes=[modes.get(c, MISSING) for c in columns])
        model.slots = durable(slots)
        return model


class _SlotsWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.slots.write.parquet(f"{path}/slots")


class _SlotsReader(MLReader):
    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = RareCategoryGrouperModel()
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        model.slots = self.sparkSession.read.parquet(f"{path}/slots")
        return model


class RareCategoryGrouperModel(Model, _Columns, MLReadable, MLWritable):
    modes = Param(Params._dummy(), "modes", "fitted modes", TypeConverters.toListString)

    @keyword_only
    def __init__(self, *, columns=None, modes=None):
        super().__init__()
        self.slots: DataFrame | None = None
        self._set(**self._input_kwargs)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        columns = self.getColumns()
        filled = prep.impute(dataset, dict(zip(columns, self.getOrDefault(self.modes))))
        return prep.apply_slots(filled, self.slots, columns)

    def write(self):
        return _SlotsWriter(self)

    @classmethod
    def read(cls):
        return _SlotsReader()
