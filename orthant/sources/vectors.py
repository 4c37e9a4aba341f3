"""Loading labelled vectors, and the checked, cached table the estimators iterate over."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orthant.functions import rows as R
from orthant.operators.passes import map_rows, sum_pass, unit_rows

# Accepted field names, in order of preference.
FEATURE_FIELDS = ("fea", "alls")
LABEL_FIELDS = ("gnd", "idxg")
TRANSPOSED_FIELDS = ("alls",)

# Rows below which a further task costs more than it saves.
ROWS_PER_TASK = 2_000


def read_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Read parquet, or csv / json / orc by file ending. Without a schema a csv is read twice."""
    for ending in ("csv", "json", "orc"):
        if path.rstrip("/").endswith("." + ending):
            reader = spark.read if schema is None else spark.read.schema(schema)
            if ending == "csv":
                reader = reader.option("header", True).option("inferSchema", schema is None)
            return reader.format(ending).load(path)
    return spark.read.parquet(path)


def pack_columns(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """Numeric columns to ``(id, x)``."""
    return df.select(
        F.col(id_col).cast("long").alias("id"),
        F.array(*[F.col(c).cast("double") for c in columns]).alias("x"),
    )


def vector_column(df: DataFrame, features_col: str) -> Column:
    """An array column or an ml vector column as an array of doubles."""
    x = F.col(features_col)
    if not isinstance(df.schema[features_col].dataType, T.ArrayType):
        from pyspark.ml.functions import vector_to_array

        x = vector_to_array(x)
    return R.as_double_vector(x)


def to_vectors(df: DataFrame, id_col: str = "id", features_col: str = "x") -> DataFrame:
    """``(id long, x array<double>)``."""
    return df.select(F.col(id_col).cast("long").alias("id"), vector_column(df, features_col).alias("x"))


def untranspose(df: DataFrame, values_col: str, feature_col: str = "feature") -> DataFrame:
    """A table with one row per feature to one row per observation.

    The longest group is one vector of an observation, so its size is the number of
    features, which the driver has to hold anyway.
    """
    cells = df.select(F.col(feature_col).alias("j"), F.posexplode(values_col).alias("id", "v"))
    return cells.groupBy(F.col("id").cast("long").alias("id")).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("j", "v"))), lambda s: s["v"].cast("double")
        ).alias("x")
    )


def load_labelled(
    df: DataFrame,
    features: str | None = None,
    label: str | None = None,
    id_col: str = "id",
    labels_df: DataFrame | None = None,
) -> DataFrame:
    """``(id, x, label)`` with the field names resolved through the accepted aliases.

    A feature-per-row table carries its labels in ``labels_df`` (``id`` plus a label field).
    """

    def pick(given, accepted, frame, what):
        for name in (given,) if given else accepted:
            if name in frame.columns:
                return name
        raise ValueError(f"no {what} field found, looked for {given or accepted}")

    feature_field = pick(features, FEATURE_FIELDS, df, "feature")
    if feature_field in TRANSPOSED_FIELDS:
        if labels_df is None:
            raise ValueError("a feature-per-row table needs labels_df")
        label_field = pick(label, LABEL_FIELDS, labels_df, "label")
        truth = labels_df.select(F.col(id_col).cast("long").alias("id"), F.col(label_field).alias("label"))
        return untranspose(df, feature_field).join(truth, "id")
    label_field = pick(label, LABEL_FIELDS, df, "label")
    return df.select(
        F.col(id_col).cast("long").alias("id"),
        vector_column(df, feature_field).alias("x"),
        F.col(label_field).alias("label"),
    )


def vector_profile(df: DataFrame, check_ids: bool = True, extra: tuple = ()) -> DataFrame:
    """One row: count, shortest and longest vector, rows with bad entries, distinct ids."""
    unusable = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    bad = F.col("x").isNull() | unusable
    aggs = [
        F.count(F.lit(1)).alias("n"),
        F.min(F.size("x")).alias("d_min"),
        F.max(F.size("x")).alias("d_max"),
        F.count_if(bad).alias("n_bad"),
        *extra,
    ]
    if check_ids:
        aggs.append(F.countDistinct("id").alias("n_ids"))
    return df.agg(*aggs)


def check_profile(p) -> None:
    """An error for a profile row of a table that no operator can work on."""
    if p["n"] == 0:
        raise ValueError("the table has no rows")
    if p["n_bad"]:
        raise ValueError(f"{p['n_bad']} rows have a null or NaN entry, or an infinite one")
    if p["d_min"] != p["d_max"]:
        raise ValueError(f"vectors differ in length: {p['d_min']} to {p['d_max']}")
    if p["d_min"] == 0:
        raise ValueError("vectors are empty")


@dataclass
class VectorTable:
    """A checked and cached ``(id, x)`` table. The cache is rebuilt from the source if lost."""

    df: DataFrame
    n: int
    d: int
    n_parts: int
    column: str = "x"

    @classmethod
    def load(
        cls, df: DataFrame, id_col: str = "id", features_col: str = "x", check_ids: bool = True
    ) -> "VectorTable":
        vectors = to_vectors(df, id_col, features_col).persist(StorageLevel.MEMORY_AND_DISK)
        placed = vectors.withColumn("part", F.spark_partition_id())
        p = vector_profile(placed, check_ids, (F.max("part").alias("last"),)).first()
        try:
            check_profile(p)
            if check_ids and p["n_ids"] != p["n"]:
                raise ValueError(f"ids are not unique: {p['n_ids']} ids on {p['n']} rows")
        except ValueError:
            vectors.unpersist()
            raise
        n_parts, cores = p["last"] + 1, df.sparkSession.sparkContext.defaultParallelism
        if n_parts < cores and p["n"] > cores * ROWS_PER_TASK:
            # few input splits would leave cores idle in every pass
            spread = vectors.repartition(cores).persist(StorageLevel.MEMORY_AND_DISK)
            spread.count()
            vectors.unpersist()
            vectors, n_parts = spread, cores
        return cls(vectors, p["n"], p["d_min"], n_parts)

    def sums(self, kernel, size: int) -> np.ndarray:
        return sum_pass(self.df, [self.column], kernel, size, self.n_parts)

    def gram(self, normalize: bool = False) -> np.ndarray:
        d = self.d

        def kernel(x):
            x = unit_rows(x) if normalize else x
            return (x.T @ x).ravel()

        return self.sums(kernel, d * d).reshape(d, d)

    def map(self, kernel, schema: str) -> DataFrame:
        return map_rows(self.df, ["id", self.column], kernel, schema)

    def multiply(self, matrix: np.ndarray) -> DataFrame:
        """``(id, x)`` with every row multiplied by a small matrix."""
        return self.map(lambda i, x: (i, x @ matrix), "id long, x array<double>")

    def release(self) -> None:
        self.df.unpersist()


def check_cluster_count(n_clusters: int, n: int, d: int) -> int:
    k = int(n_clusters)
    if k < 1:
        raise ValueError("n_clusters must be positive")
    if k > n:
        raise ValueError(f"more clusters than observations: {k} > {n}")
    if k > d:
        raise ValueError(f"vectors need at least as many entries as clusters: {d} < {k}")
    return k


def warn_if_not_square(d: int, k: int) -> None:
    """Rotations are meant for embeddings of as many dimensions as clusters."""
    if d != k:
        warnings.warn(f"vectors have {d} entries for {k} clusters", stacklevel=3)
