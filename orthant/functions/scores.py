"""Cluster-quality scores of a table with a truth column and a prediction column.

One shuffle counts the (cluster, class) pairs; every score follows from these counts and
their margins, which a cube yields together. Counts stay in Spark, so a table of singletons
is as welcome as a table of three clusters.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthant.operators.matching import LargePart, best_mapping


def contingency(df: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    """Long table ``(cluster, class, n)``."""
    return df.groupBy(F.col(prediction).alias("cluster"), F.col(truth).alias("class")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confusion_wide(cells: DataFrame, classes: list) -> DataFrame:
    """One row per cluster, one column per given class."""
    return cells.groupBy("cluster").pivot("class", classes).agg(F.sum("n")).na.fill(0)


def distinct_labels(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).alias("label")).distinct().orderBy("label")


def margins(cells: DataFrame) -> DataFrame:
    """``(level, n, top)`` for cells, clusters, classes and the whole table (levels 0 to 3).

    ``top`` is the largest cell of the group.
    """
    return (
        cells.cube("cluster", "class")
        .agg(F.grouping_id().cast("int").alias("level"), F.sum("n").alias("s"), F.max("n").alias("top"))
        .select("level", F.col("s").cast("double").alias("n"), F.col("top").cast("double").alias("top"))
    )


def purity(df: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    per_cluster = contingency(df, truth, prediction).groupBy("cluster").agg(
        F.max("n").alias("top"), F.sum("n").alias("n")
    )
    return per_cluster.agg(
        (F.sum("top") / F.sum("n")).alias("purity"), F.sum("n").alias("n_rows")
    )


def scores_from_cells(cells: DataFrame, average: str = "arithmetic") -> DataFrame:
    """One row: purity, homogeneity, completeness, v_measure, nmi, ari."""
    if average not in ("arithmetic", "geometric"):
        raise ValueError(f"average must be 'arithmetic' or 'geometric', got {average!r}")

    def at(level: int, value: Column) -> Column:
        return F.sum(F.when(F.col("level") == level, value).otherwise(0.0))

    n = F.col("n")
    n_log_n, pairs = n * F.log(n), n * (n - 1) / 2
    totals = margins(cells).agg(
        at(3, n).alias("total"),
        *[at(i, n_log_n).alias(f"log{i}") for i in (0, 1, 2)],
        *[at(i, pairs).alias(f"pair{i}") for i in (0, 1, 2, 3)],
        at(1, F.col("top")).alias("top"),
        at(1, F.lit(1.0)).alias("n_clusters"),
        at(2, F.lit(1.0)).alias("n_classes"),
    )
    c = F.col

    def entropy(level: int) -> Column:
        return F.log("total") - c(f"log{level}") / c("total")

    base = totals.select(
        "*",
        F.when(c("n_classes") == 1, 0.0).otherwise(entropy(2)).alias("h_class"),
        F.when(c("n_clusters") == 1, 0.0).otherwise(entropy(1)).alias("h_cluster"),
    ).withColumn(
        "mi",
        F.when((c("n_classes") == 1) | (c("n_clusters") == 1), 0.0).otherwise(
            F.greatest(c("h_class") + c("h_cluster") - entropy(0), F.lit(0.0))
        ),
    )
    shares = base.select(
        "*",
        F.when(c("h_class") == 0, 1.0).otherwise(c("mi") / c("h_class")).alias("homogeneity"),
        F.when(c("h_cluster") == 0, 1.0).otherwise(c("mi") / c("h_cluster")).alias("completeness"),
    )
    both = c("homogeneity") + c("completeness")
    mean = (
        (c("h_class") + c("h_cluster")) / 2
        if average == "arithmetic"
        else F.sqrt(c("h_class") * c("h_cluster"))
    )
    chance = c("pair1") * c("pair2") / c("pair3")
    same = (c("pair0") == c("pair1")) & (c("pair0") == c("pair2"))
    return shares.select(
        (c("top") / c("total")).alias("purity"),
        "homogeneity",
        "completeness",
        F.when(both == 0, 0.0)
        .otherwise(2 * c("homogeneity") * c("completeness") / both)
        .alias("v_measure"),
        F.when((c("n_classes") == 1) & (c("n_clusters") == 1), 1.0)
        .when(c("mi") == 0, 0.0)
        .otherwise(c("mi") / mean)
        .alias("nmi"),
        F.when(same, 1.0)
        .otherwise((c("pair0") - chance) / ((c("pair1") + c("pair2")) / 2 - chance))
        .alias("ari"),
    )


def accuracy_from_cells(cells: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row: share of rows whose mapped cluster equals their class."""
    matched = cells.alias("c").join(
        mapping.alias("m"),
        F.col("c.cluster").eqNullSafe(F.col("m.cluster")),
        "left",
    )
    good = F.when(F.col("c.class").eqNullSafe(F.col("m.mapped")), F.col("c.n")).otherwise(0)
    return matched.agg((F.sum(good) / F.sum("c.n")).alias("accuracy"))


def accuracy(df: DataFrame, truth: str = "truth", prediction: str = "prediction") -> DataFrame:
    cells = contingency(df, truth, prediction).persist()
    return accuracy_from_cells(cells, best_mapping(cells))


def cluster_scores(
    df: DataFrame,
    truth: str = "truth",
    prediction: str = "prediction",
    average: str = "arithmetic",
) -> DataFrame:
    """Long table ``(metric, value)``: the six scores and purity.

    Accuracy alone needs labels to be matched. Where they are too many for that, it is null, with
    a warning; the other scores take any number of labels.
    """
    cells = contingency(df, truth, prediction).persist()
    rates = scores_from_cells(cells, average)
    names = rates.columns
    pairs = ", ".join(f"'{name}', {name}" for name in names)
    long = rates.selectExpr(f"stack({len(names)}, {pairs}) as (metric, value)")
    try:
        acc = accuracy_from_cells(cells, best_mapping(cells))
    except LargePart as large:
        warnings.warn(f"no accuracy: {large}", stacklevel=2)
        acc = cells.sparkSession.range(1).select(F.lit(None).cast("double").alias("accuracy"))
    return long.unionByName(acc.select(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")))
