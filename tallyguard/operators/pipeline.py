"""The anomaly model as a Spark ML pipeline that can be saved whole and loaded elsewhere.

Categories are folded to their frequent levels, indexed, one-hot encoded, assembled with the
numeric columns, standardised and scored by an isolation forest. The two stages that Spark ML lacks
are an estimator each with a model that writes itself: a saved pipeline is one folder.

Levels beyond the ``most`` frequent ones share a level of their own, so no column is refused
however dirty it is, and nothing as large as the number of levels reaches the driver. A level that
was not there when fitting is one of these if there are any, else the indexer's unknown level.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Model, Pipeline
from pyspark.ml.feature import OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasInputCols, HasOutputCol, HasOutputCols, HasSeed
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
from pyspark.sql import functions as F

from .. import config as C
from ..plans import stage
from . import isolation
from .features import RARE, frequent_levels

MISSING = "<missing>"


class _Levels(HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    most = Param(Params._dummy(), "most", "levels that keep a name of their own", TypeConverters.toInt)


class LevelFolder(Estimator, _Levels):
    """Finds the ``most`` frequent levels of each input column."""

    def __init__(self, inputCols=(), outputCols=(), most=500):
        super().__init__()
        self._set(inputCols=list(inputCols), outputCols=list(outputCols), most=most)

    def _fit(self, dataset: DataFrame) -> LevelFolderModel:
        levels = {c: frequent_levels(dataset, c, self.getOrDefault(self.most)) for c in self.getInputCols()}
        model = LevelFolderModel(self.getInputCols(), self.getOutputCols(), json.dumps(levels))
        return model._resetUid(self.uid)


class LevelFolderModel(Model, _Levels):
    """Names of frequent levels as they are, one name for the others, one for none."""

    levels = Param(Params._dummy(), "levels", "frequent levels per column, as JSON", TypeConverters.toString)

    def __init__(self, inputCols=(), outputCols=(), levels="{}"):
        super().__init__()
        self._set(inputCols=list(inputCols), outputCols=list(outputCols), levels=levels)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        levels = json.loads(self.getOrDefault(self.levels))

        def folded(column: str):
            kept = [name for name in levels[column] if name != RARE]
            value = F.col(f"`{column}`").cast("string")
            if RARE in levels[column]:
                value = F.when(value.isin(kept), value).when(value.isNotNull(), F.lit(RARE))
            return F.coalesce(value, F.lit(MISSING))

        pairs = zip(self.getInputCols(), self.getOutputCols())
        return dataset.withColumns({out: folded(column) for column, out in pairs})


class _Forest(HasInputCol, HasOutputCol, HasSeed):
    idCol = Param(Params._dummy(), "idCol", "column by which trees draw rows", TypeConverters.toString)
    trees = Param(Params._dummy(), "trees", "number of trees", TypeConverters.toInt)
    treeRows = Param(Params._dummy(), "treeRows", "rows of one tree at most", TypeConverters.toInt)


class IsolationForest(Estimator, _Forest, DefaultParamsReadable, DefaultParamsWritable):
    """Grows trees over a vector column, each from its own rows, see ``isolation``."""

    def __init__(self, inputCol="features", outputCol="score", idCol="transaction_id", **options):
        super().__init__()
        self._setDefault(trees=C.TREES, treeRows=C.TREE_ROWS, seed=C.SEED)
        self._set(inputCol=inputCol, outputCol=outputCol, idCol=idCol, **options)

    def _fit(self, dataset: DataFrame) -> IsolationForestModel:
        of = self.getOrDefault
        rows = dataset.select(
            F.col(of(self.idCol)).alias("transaction_id"),
            vector_to_array(self.getInputCol(), "float32").alias("x"),
        )
        grown = isolation.fit(rows, "x", None, of(self.trees), of(self.treeRows), self.getSeed())
        model = IsolationForestModel(self.getInputCol(), self.getOutputCol(), stage(grown, "forest"))
        return model._resetUid(self.uid)


class IsolationForestModel(Model, _Forest, MLReadable, MLWritable):
    """Scores vectors by a table of nodes, which is written beside the parameters."""

    def __init__(self, inputCol="features", outputCol="score", nodes: DataFrame | None = None):
        super().__init__()
        self._set(inputCol=inputCol, outputCol=outputCol)
        self.nodes = nodes

    def _transform(self, dataset: DataFrame) -> DataFrame:
        forest = isolation.Forest.load(self.nodes, [])
        shared = dataset.sparkSession.sparkContext.broadcast((forest.trees, isolation.expected_path(forest.sample)))

        @F.pandas_udf("double")
        def score(x: pd.Series) -> pd.Series:
            trees, scale = shared.value
            points = np.ascontiguousarray(np.stack(x.to_numpy()).astype(np.float32))
            return pd.Series(isolation.scores(points, trees, scale))

        vector = vector_to_array(self.getInputCol(), "float32")
        return dataset.withColumn(self.getOutputCol(), score(vector))

    def write(self) -> MLWriter:
        return _ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _ForestReader()


class _ForestWriter(MLWriter):
    def __init__(self, model: IsolationForestModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.model, path, self.sparkSession)
        self.model.nodes.write.parquet(f"{path}/nodes")


class _ForestReader(MLReader):
    def load(self, path: str) -> IsolationForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = IsolationForestModel(nodes=self.sparkSession.read.parquet(f"{path}/nodes"))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model


def inputs_pipeline(numeric: list[str], categorical: list[str], most: int = 500) -> Pipeline:
    """From numeric and category columns to the vector ``scaled`` of zero mean and unit deviation."""
    folded, indexed, encoded = ([f"{c}_{kind}" for c in categorical] for kind in ("folded", "index", "encoded"))
    return Pipeline(
        stages=[
            LevelFolder(categorical, folded, most),
            StringIndexer(inputCols=folded, outputCols=indexed, handleInvalid="keep"),
            OneHotEncoder(inputCols=indexed, outputCols=encoded, handleInvalid="keep", dropLast=False),
            VectorAssembler(inputCols=[*numeric, *encoded], outputCol="assembled"),
            StandardScaler(inputCol="assembled", outputCol="scaled", withMean=True, withStd=True),
        ]
    )


def detector_pipeline(
    numeric: list[str], categorical: list[str], most: int = 500, id_col: str = "transaction_id", **forest
) -> Pipeline:
    """:func:`inputs_pipeline` with an isolation forest behind it; the score is in ``score``."""
    stages = inputs_pipeline(numeric, categorical, most).getStages()
    return Pipeline(stages=[*stages, IsolationForest("scaled", "score", id_col, **forest)])
