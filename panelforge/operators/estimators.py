"""``pyspark.ml`` Estimator / Model classes for the library's fitted
transformers (X-U7), so they compose in a ``Pipeline`` and save / load
(S13) like any Spark ML stage."""

from __future__ import annotations

import json

from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Transformer
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import hybrid as H
from panelforge.operators import mlprep


class _ScalerParams(Params):
    inputCols = Param(Params._dummy(), "inputCols", "columns to scale", typeConverter=TypeConverters.toListString)
    kind = Param(Params._dummy(), "kind", "robust | standard | minmax", typeConverter=TypeConverters.toString)
    fitFilter = Param(Params._dummy(), "fitFilter", "SQL predicate selecting fitting rows ('' = all)",
                      typeConverter=TypeConverters.toString)


class PanelScaler(Estimator, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    """M1-M3 as an Estimator: statistics from the rows matching
    ``fitFilter`` (train rows), applied to every row."""

    @keyword_only
    def __init__(self, *, inputCols=None, kind="robust", fitFilter=""):
        super().__init__()
        self._setDefault(kind="robust", fitFilter="")
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "PanelScalerModel":
        cols = self.getOrDefault(self.inputCols)
        flt = self.getOrDefault(self.fitFilter)
        fit_on = F.expr(flt) if flt else None
        fitter = {"robust": mlprep.fit_robust, "standard": mlprep.fit_standard, "minmax": mlprep.fit_minmax}
        st = fitter[self.getOrDefault(self.kind)](df, cols, fit_on)
        m = PanelScalerModel(stats=json.dumps({"kind": st.kind, "center": st.center, "scale": st.scale}))
        return self._copyValues(m)


class PanelScalerModel(Model, _ScalerParams, DefaultParamsReadable, DefaultParamsWritable):
    stats = Param(Params._dummy(), "stats", "fitted statistics (JSON)", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, *, stats=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        s = json.loads(self.getOrDefault(self.stats))
        return mlprep.transform(df, mlprep.Stats(s["kind"], s["center"], s["scale"]))


class HybridAdjuster(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """H1 as a Transformer: ``y * (1 + clip(a, -bound, bound))``."""

    predictionCol = Param(Params._dummy(), "predictionCol", "baseline column", typeConverter=TypeConverters.toString)
    adjustmentCol = Param(Params._dummy(), "adjustmentCol", "adjustment column", typeConverter=TypeConverters.toString)
    outputCol = Param(Params._dummy(), "outputCol", "output column", typeConverter=TypeConverters.toString)
    bound = Param(Params._dummy(), "bound", "clip bound", typeConverter=TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, predictionCol="prediction", adjustmentCol="adjustment", outputCol="y_hybrid",
                 bound=H.ADJUST_BOUND):
        super().__init__()
        self._setDefault(predictionCol="prediction", adjustmentCol="adjustment", outputCol="y_hybrid",
                         bound=H.ADJUST_BOUND)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        a = F.coalesce(F.col(self.getOrDefault(self.adjustmentCol)), F.lit(0.0))
        return df.withColumn(self.getOrDefault(self.outputCol),
                             H.adjust(self.getOrDefault(self.predictionCol), a, self.getOrDefault(self.bound)))
