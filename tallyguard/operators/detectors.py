"""Anomaly detectors compared at one alert budget."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame

from .. import config as C
from ..plans import passing, shuffles_removed, stage, together
from .evaluation import LABEL, Ranking, recall_at_budget
from .isolation import Forest, standardised
from .lof import local_outlier_factor, neighbours
from .projection import projected_neighbours

Detector = Callable[[DataFrame], DataFrame]


def by_column(name: str) -> Detector:
    """A score that the rows already have."""
    return lambda rows: rows.withColumn("score", rows[name])


def by_forest(forest: Forest) -> Detector:
    return forest.apply


def by_density(
    columns: list[str] | str, k: int = C.NEIGHBOURS, exact: bool = False, scale: bool = True
) -> Detector:
    """Local outlier factors of numeric columns or a vector column.

    Neighbours come from random projections, at any number of rows in bounded cells; with
    ``exact`` every true neighbour is found, at a cost that grows with the dimensions.
    """
    search = neighbours if exact else projected_neighbours

    def score(rows: DataFrame) -> DataFrame:
        scaled = standardised(rows, columns) if scale and not isinstance(columns, str) else rows
        return local_outlier_factor(scaled, columns, k, search).withColumnRenamed("lof", "score")

    return score


def compare(
    rows: DataFrame,
    detectors: Mapping[str, Detector],
    budget: int = C.ALERT_BUDGET,
    id_col: str = "transaction_id",
) -> DataFrame:
    """What each detector catches with its ``budget`` highest scores: one row per detector.

    ``rows`` carry the 0/1 column ``label``. Each score is written once and ranked by itself, ties
    at the budget go to the smallest ids. Rows that a detector gives no score are never alerts. What
    a detector stages on its way is removed when its score is written.
    """

    def line(name: str, detector: Detector) -> DataFrame:
        with passing(rows.sparkSession) as keep:
            scored = detector(rows).selectExpr(f"CAST(`{id_col}` AS STRING) AS transaction_id", LABEL, "score")
            scored = keep(stage(scored, "detector"))
        return recall_at_budget(scored, Ranking(scored), budget, name)

    with shuffles_removed(rows.sparkSession):
        lines = together(*[lambda n=n, d=d: line(n, d) for n, d in detectors.items()])
    out = lines[0]
    for other in lines[1:]:
        out = out.unionByName(other)
    return out
