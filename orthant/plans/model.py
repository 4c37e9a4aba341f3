"""What a fit returns."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession


class History:
    """Per-iteration scalars, kept as small rows and shown as a DataFrame."""

    SCHEMA = "iteration int, phase string, metric string, value double"

    def __init__(self):
        self.rows: list[tuple[int, str, str, float]] = []

    def add(self, iteration: int, phase: str, **metrics: float) -> None:
        for name, value in metrics.items():
            self.rows.append((int(iteration), phase, name, float(value)))

    def values(self, metric: str, phase: str | None = None) -> list[float]:
        return [r[3] for r in self.rows if r[2] == metric and phase in (None, r[1])]

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, self.SCHEMA)


def centers_df(spark: SparkSession, centers: np.ndarray) -> DataFrame:
    rows = [(i, [float(v) for v in c]) for i, c in enumerate(centers)]
    return spark.createDataFrame(rows, "cluster int, center array<double>")


def matrix_df(spark: SparkSession, m: np.ndarray) -> DataFrame:
    rows = [(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(m.shape[1])]
    return spark.createDataFrame(rows, "i int, j int, value double")


@dataclass
class ClusterModel:
    """Labels and the other results; a field is None where a method does not produce it."""

    spark: SparkSession
    labels: DataFrame
    centers_matrix: np.ndarray | None = None
    rotation_matrix: np.ndarray | None = None
    residual: float = float("inf")
    inertia: float | None = None
    n_iter: int = 0
    stop_reason: str = ""
    trace: History = field(default_factory=History)
    outliers: DataFrame | None = None
    corrected: DataFrame | None = None
    embedding: DataFrame | None = None

    @property
    def centers(self) -> DataFrame:
        return centers_df(self.spark, self.centers_matrix)

    @property
    def rotation(self) -> DataFrame:
        return matrix_df(self.spark, self.rotation_matrix)

    @property
    def history(self) -> DataFrame:
        return self.trace.to_df(self.spark)

    def save(self, path: str) -> None:
        """Write every result this model has as parquet below ``path``."""
        base = path.rstrip("/")
        tables = {"labels": self.labels, "history": self.history}
        if self.centers_matrix is not None:
            tables["centers"] = self.centers
        if self.rotation_matrix is not None:
            tables["rotation"] = self.rotation
        for name in ("outliers", "corrected", "embedding"):
            if getattr(self, name) is not None:
                tables[name] = getattr(self, name)
        for name, df in tables.items():
            df.write.mode("overwrite").parquet(f"{base}/{name}")
