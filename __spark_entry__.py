"""

Every query reads the whole of its tables. Numbers are rounded to six digits on both sides.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from orthant.functions import rows as R  # noqa: E402
from orthant.functions import scores as S  # noqa: E402
from orthant.operators import graph as G  # noqa: E402
from orthant.operators.eigen import NodeGraph, leading_eigenvectors  # noqa: E402
from orthant.operators.knn import knn_graph, knn_neighbors  # noqa: E402
from orthant.operators.matching import best_mapping, label_changes, relabel  # noqa: E402
from orthant.operators.passes import polar_factor  # noqa: E402
from orthant.operators.selection import curvature_threshold, kth_largest  # noqa: E402
from orthant.plans import rounding as P  # noqa: E402
from orthant.plans.agglomerate import agglomerate  # noqa: E402
from orthant.plans.alternating import IndicatorClustering  # noqa: E402
from orthant.plans.compare import compare, kmeans_baseline  # noqa: E402
from orthant.plans.joint import JointIndicatorClustering, spectral_embedding  # noqa: E402
from orthant.plans.lloyd import lloyd_pass, nearest_labels, next_centers  # noqa: E402
from orthant.plans.model import centers_df, matrix_df  # noqa: E402
from orthant.plans.riemann import RiemannianIndicatorClustering, violation_pass  # noqa: E402
from orthant.plans.robust import (  # noqa: E402
    RobustIndicatorClustering,
    objective,
    tall_qr,
    update_rows,
)
from orthant.session import Scratch  # noqa: E402
from orthant.sources.vectors import (  # noqa: E402
    VectorTable,
    load_labelled,
    pack_columns,
    vector_profile,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and the SQL that computes the same rows where SQL can."""

    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def r6(value: Column | str) -> Column:
    return F.round(F.col(value) if isinstance(value, str) else value, 6) + F.lit(0.0)


def exploded(df: DataFrame, keys: list[str], column: str = "x") -> DataFrame:
    """One row per vector entry: keys, pos (0-based), value."""
    return df.select(*keys, F.posexplode(column).alias("pos", "v")).select(
        *keys, "pos", r6("v").alias("value")
    )


# ---------------------------------------------------------------- fixtures from the tables


def embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label"
    )


def planted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four groups of customers, each near its own axis."""
    key, label = F.col("c_custkey"), F.col("c_nationkey") % 4
    x = [F.when(label == j, 1.0).otherwise(0.0) + 0.05 * F.sin(key * (j + 1.0)) for j in range(4)]
    return read(spark, sf_dir, "customer").select(
        key.alias("id"), F.array(*x).alias("x"), label.alias("label")
    )


def planted_outlier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four groups, with every twentieth customer moved off its axis."""
    key, label = F.col("c_custkey"), F.col("c_nationkey") % 4
    planted = key % 20 == 7
    x = [
        F.when(planted, F.sin(key * 1.7 * (j + 1.0))).otherwise(
            F.when(label == j, 1.0).otherwise(0.0) + 0.05 * F.sin(key * (j + 1.0))
        )
        for j in range(4)
    ]
    return read(spark, sf_dir, "customer").select(
        key.alias("id"), F.array(*x).alias("x"), label.alias("label"), planted.alias("planted")
    )


TURN = np.deg2rad(25.0)
COS, SIN = float(np.cos(TURN)), float(np.sin(TURN))


def turned_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups of customers near two perpendicular axes that are turned by 25 degrees."""
    key, label = F.col("c_custkey"), F.col("c_nationkey") % 2
    a, b = (F.when(label == j, 1.0).otherwise(0.0) + 0.05 * F.sin(key * (j + 1.0)) for j in (0, 1))
    x = F.array(a * COS + b * SIN, b * COS - a * SIN)
    return read(spark, sf_dir, "customer").select(key.alias("id"), x.alias("x"), label.alias("label"))


LINKS = 60
# Links that are tried in one task.
TASK_LINKS = 1_000_000


def planted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A directed graph on the customers: pseudo-random links within three groups of nations,
    and light links between consecutive customers, whatever their group."""
    nodes = planted_nodes(spark, sf_dir)
    n = nodes.count()
    key = F.col("src")
    steps = F.explode(F.sequence(F.lit(1), F.lit(LINKS))).alias("t")
    # the table is small and may be one file split; its links are not
    width = max(spark.sparkContext.defaultParallelism, -(-n * LINKS // TASK_LINKS))
    tried = nodes.repartition(width, "id").select(F.col("id").alias("src"), F.col("label").alias("a"), steps).withColumn(
        "dst", (key * (7919 * F.col("t") + 1) + 104729 * F.col("t")) % n
    )
    inside = tried.join(nodes.select(F.col("id").alias("dst"), F.col("label").alias("b")), "dst").where(
        (F.col("a") == F.col("b")) & (F.col("src") != F.col("dst"))
    )
    bridge = nodes.where(F.col("id") % 50 == 0).select(
        F.col("id").alias("src"), ((F.col("id") + 1) % n).alias("dst"), F.lit(0.01).alias("w")
    )
    return inside.select("src", "dst", F.lit(1.0).alias("w")).unionByName(bridge)


def planted_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = F.col("c_nationkey") % 9
    label = F.when(group <= 3, 0).when(group <= 6, 1).otherwise(2)
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), label.alias("label"))


def wave(d: int, k: int, phase: float = 0.0) -> np.ndarray:
    """A fixed d x k matrix that SQL can write too."""
    return np.array([[np.cos(i * (j + 1) + phase) / 8 for j in range(k)] for i in range(d)])


EMB = "e AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings)"


def _axis_sql(mod: int, j: int) -> str:
    return (
        f"(CASE WHEN c_nationkey % {mod} = {j} THEN 1.0 ELSE 0.0 END"
        f" + CAST(0.05 AS DOUBLE) * sin(c_custkey * CAST({j + 1}.0 AS DOUBLE)))"
    )


PLANTED = (
    "f AS (SELECT c_custkey AS id, c_nationkey % 4 AS label, ["
    + ", ".join(_axis_sql(4, j) for j in range(4))
    + "]::DOUBLE[] AS x FROM customer)"
)
PLANTED_OUT = (
    "f AS (SELECT c_custkey AS id, c_nationkey % 4 AS label, c_custkey % 20 = 7 AS planted, ["
    + ", ".join(
        f"CASE WHEN c_custkey % 20 = 7 THEN sin(c_custkey * CAST(1.7 AS DOUBLE) * {j + 1})"
        f" ELSE {_axis_sql(4, j)} END"
        for j in range(4)
    )
    + "]::DOUBLE[] AS x FROM customer)"
)
TURNED = (
    f"g AS (SELECT c_custkey AS id, c_nationkey % 2 AS label, CAST({_axis_sql(2, 0)} AS DOUBLE) AS a,"
    f" CAST({_axis_sql(2, 1)} AS DOUBLE) AS b FROM customer),"
    f" f AS (SELECT id, label, a * CAST({COS!r} AS DOUBLE) + b * CAST({SIN!r} AS DOUBLE) AS p,"
    f" b * CAST({COS!r} AS DOUBLE) - a * CAST({SIN!r} AS DOUBLE) AS q FROM g)"
)
NODES = (
    "nodes AS (SELECT c_custkey AS id, CAST(CASE WHEN c_nationkey % 9 <= 3 THEN 0"
    " WHEN c_nationkey % 9 <= 6 THEN 1 ELSE 2 END AS INTEGER) AS label FROM customer)"
)
DIRECTED = (
    NODES + ", total AS (SELECT count(*) AS n FROM customer),"
    " tried AS (SELECT id AS src, label AS a, (id * (7919 * t + 1) + 104729 * t) % n AS dst"
    f" FROM nodes, total, generate_series(1, {LINKS}) s(t)),"
    " directed AS (SELECT src, dst, CAST(1.0 AS DOUBLE) AS w FROM tried JOIN nodes ON id = dst"
    " WHERE a = label AND src <> dst"
    " UNION ALL SELECT id, (id + 1) % n, CAST(0.01 AS DOUBLE) FROM nodes, total WHERE id % 50 = 0)"
)
SYMMETRIC = (
    DIRECTED + ", edges AS (SELECT src, dst, sum(w) / 2 AS w FROM (SELECT src, dst, w FROM directed"
    " UNION ALL SELECT dst, src, w FROM directed) GROUP BY src, dst)"
)
DEGREES = SYMMETRIC + ", deg AS (SELECT src AS id, sum(w) AS deg FROM edges GROUP BY src)"
LAPLACIAN = (
    DEGREES + ", lap AS (SELECT src, dst, -w / sqrt(a.deg * b.deg) AS value FROM edges"
    " JOIN deg a ON a.id = src JOIN deg b ON b.id = dst WHERE src <> dst"
    " UNION ALL SELECT id, id, CAST(1.0 AS DOUBLE) FROM deg)"
)


def _wave_sql(k: int, phase: str = "0") -> str:
    """Scores of the rows e under the wave matrix, as a table u(id, label, u)."""
    cols = ", ".join(
        f"list_sum(list_transform(generate_series(1, len(x)), lambda i: x[i] * cos((i - 1) * {j + 1} + {phase}) / 8))"
        for j in range(k)
    )
    return f"u AS (SELECT id, label, x, [{cols}] AS u FROM e)"


LONG_X = "unnest(generate_series(1, len(x))) AS i"

# ---------------------------------------------------------------- sources and checks


@query(
    "validate_vectors",
    f"WITH {EMB} SELECT count(*) AS n, CAST(min(len(x)) AS INTEGER) AS d_min,"
    " CAST(max(len(x)) AS INTEGER) AS d_max,"
    " count(*) FILTER (x IS NULL OR len(list_filter(x, lambda v: v IS NULL OR isnan(v))) > 0) AS n_bad,"
    " count(DISTINCT id) AS n_ids FROM e",
)
def validate_vectors(spark, sf_dir):
    return vector_profile(embedding_rows(spark, sf_dir).select("id", "x"))


@query(
    "load_labelled",
    f"WITH {EMB} SELECT id, label, CAST(len(x) AS INTEGER) AS d, round(list_sum(x), 6) + 0.0 AS total FROM e",
)
def load_labelled_query(spark, sf_dir):
    raw = read(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("fea"), F.col("label").alias("idxg")
    )
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    return load_labelled(raw).select("id", "label", F.size("x").alias("d"), r6(total).alias("total"))


@query("load_by_feature", ORACLES["load_labelled"])
def load_by_feature(spark, sf_dir):
    """The same vectors from a table with one row per feature, and a label table."""
    raw = read(spark, sf_dir, "embeddings")
    cells = raw.select(F.col("vec_id").alias("id"), F.posexplode("embedding").alias("feature", "v"))
    listed = F.array_sort(F.collect_list(F.struct("id", F.col("v").cast("double").alias("v"))))
    by_feature = cells.groupBy("feature").agg(F.transform(listed, lambda c: c["v"]).alias("alls"))
    labels = raw.select(F.col("vec_id").alias("id"), F.col("label").alias("gnd"))
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    return load_labelled(by_feature, labels_df=labels).select(
        "id", "label", F.size("x").alias("d"), r6(total).alias("total")
    )


@query(
    "pack_columns",
    "SELECT p_partkey AS id, CAST(3 AS INTEGER) AS d,"
    " round(p_size + p_retailprice + length(p_name), 6) + 0.0 AS total FROM part",
)
def pack_columns_query(spark, sf_dir):
    parts = read(spark, sf_dir, "part").withColumn("len", F.length("p_name"))
    rows = pack_columns(parts, "p_partkey", ["p_size", "p_retailprice", "len"])
    total = F.aggregate("x", F.lit(0.0), lambda s, v: s + v)
    return rows.select("id", F.size("x").alias("d"), r6(total).alias("total"))


# ---------------------------------------------------------------- row-wise maps


@query(
    "row_normalize",
    f"WITH {EMB}, s AS (SELECT id, list_transform(x, lambda v: v * (id + 1)) AS x FROM e),"
    " m AS (SELECT id, x, sqrt(list_sum(list_transform(x, lambda v: v * v))) AS n FROM s)"
    f" SELECT id, CAST(i - 1 AS INTEGER) AS pos, round(x[i] / n, 6) + 0.0 AS value FROM (SELECT id, x, n, {LONG_X} FROM m)",
)
def row_normalize(spark, sf_dir):
    rows = embedding_rows(spark, sf_dir)
    scaled = rows.select("id", F.transform("x", lambda v: v * (F.col("id") + 1)).alias("x"))
    return exploded(scaled.select("id", R.unit_row(F.col("x")).alias("x")), ["id"])


@query(
    "init_first_k",
    f"WITH {EMB} SELECT id, CAST(i - 1 AS INTEGER) AS pos, round(x[i], 6) + 0.0 AS value"
    " FROM e, generate_series(1, 10) s(i)",
)
def init_first_k(spark, sf_dir):
    rows = embedding_rows(spark, sf_dir)
    return exploded(rows.select("id", R.first_coordinates(F.col("x"), 10).alias("x")), ["id"])


@query(
    "rotate_given_z",
    f"WITH {EMB}, {_wave_sql(3)} SELECT id, round(u[1], 6) + 0.0 AS u0, round(u[2], 6) + 0.0 AS u1,"
    " round(u[3], 6) + 0.0 AS u2 FROM u",
)
def rotate_given_z(spark, sf_dir):
    u = embedding_rows(spark, sf_dir).select("id", R.rotate(F.col("x"), wave(64, 3)).alias("u"))
    return u.select("id", *[r6(F.col("u")[j]).alias(f"u{j}") for j in range(3)])


@query(
    "nonnegative_part",
    f"WITH {EMB}, {_wave_sql(3)} SELECT id, round(greatest(u[1], 0), 6) + 0.0 AS n0,"
    " round(greatest(u[2], 0), 6) + 0.0 AS n1, round(greatest(u[3], 0), 6) + 0.0 AS n2 FROM u",
)
def nonnegative_part(spark, sf_dir):
    u = embedding_rows(spark, sf_dir).select(
        "id", R.nonnegative(R.rotate(F.col("x"), wave(64, 3))).alias("u")
    )
    return u.select("id", *[r6(F.col("u")[j]).alias(f"n{j}") for j in range(3)])


ARGMAX = "CAST(list_position(x, list_max(x)) - 1 AS INTEGER)"


@query(
    "project_indicator_max",
    f"WITH {EMB} SELECT id, {ARGMAX} AS prediction, round(list_max(x), 6) + 0.0 AS h FROM e",
)
def project_indicator_max(spark, sf_dir):
    p = embedding_rows(spark, sf_dir).select("id", R.indicator(F.col("x")).alias("p"))
    return p.select("id", "p.prediction", r6(F.col("p.h")).alias("h"))


@query(
    "project_indicator_one",
    f"WITH {EMB} SELECT id, {ARGMAX} AS prediction, CAST(1.0 AS DOUBLE) AS h FROM e",
)
def project_indicator_one(spark, sf_dir):
    p = embedding_rows(spark, sf_dir).select("id", R.indicator(F.col("x"), "one").alias("p"))
    return p.select("id", "p.prediction", "p.h")


@query(
    "project_indicator_colnorm",
    f"WITH {EMB}, p AS (SELECT id, {ARGMAX} AS prediction, list_max(x) AS h FROM e),"
    " q AS (SELECT prediction, sqrt(sum(h * h)) AS len FROM p GROUP BY prediction)"
    " SELECT id, prediction, round(h / len, 6) + 0.0 AS h FROM p JOIN q USING (prediction)",
)
def project_indicator_colnorm(spark, sf_dir):
    rows = embedding_rows(spark, sf_dir)
    table = VectorTable.load(rows)
    view = P.View(np.eye(64), False)
    length = np.sqrt(P.view_pass(table, view, False, None).h_square)
    scale = F.lit([1.0 / v if v > 0 else 1.0 for v in length])
    p = P.label_rows(table, view, False)
    return p.select(
        "id", "prediction", r6(F.col("h") * F.element_at(scale, F.col("prediction") + 1)).alias("h")
    )


@query(
    "one_hot",
    f"WITH {EMB} SELECT id, CAST(j AS INTEGER) AS pos, CAST(j = label AS INTEGER) AS value"
    " FROM e, generate_series(0, 9) s(j)",
)
def one_hot(spark, sf_dir):
    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return rows.select("id", F.posexplode(R.one_hot(F.col("label"), 10)).alias("pos", "value"))


# lengths from 0.1 to 0.7, so that thresholds fall among them
SCALED = "s AS (SELECT id, list_transform(x, lambda v: v * (id % 7 + 1) * 0.1::DOUBLE) AS x FROM e)"


def scaled_rows(spark, sf_dir):
    rows = embedding_rows(spark, sf_dir)
    return rows.select("id", F.transform("x", lambda v: v * (F.col("id") % 7 + 1) * 0.1).alias("x"))


@query(
    "soft_threshold_rows",
    f"WITH {EMB}, {SCALED}, m AS (SELECT id, x, sqrt(list_sum(list_transform(x, lambda v: v * v))) AS n FROM s)"
    " SELECT id, CAST(i - 1 AS INTEGER) AS pos,"
    " round(CASE WHEN n <= 0.35 THEN 0.0 ELSE (1 - 0.35::DOUBLE / n) * x[i] END, 6) + 0.0 AS value"
    f" FROM (SELECT id, x, n, {LONG_X} FROM m)",
)
def soft_threshold_rows(spark, sf_dir):
    rows = scaled_rows(spark, sf_dir)
    return exploded(rows.select("id", R.shrink_row(F.col("x"), 0.35).alias("x")), ["id"])


@query(
    "outlier_filter",
    f"WITH {EMB}, {SCALED} SELECT id FROM s WHERE sqrt(list_sum(list_transform(x, lambda v: v * v))) > 0.35::DOUBLE",
)
def outlier_filter(spark, sf_dir):
    rows = scaled_rows(spark, sf_dir)
    return rows.where(R.has_nonzero(R.shrink_row(F.col("x"), 0.35))).select("id")


@query(
    "violation_cost",
    f"WITH {EMB}, {_wave_sql(3)}, v AS (SELECT id, x, list_transform(u, lambda a: least(a, 0)) AS v FROM u),"
    " c AS (SELECT 0.5 * sum(list_sum(list_transform(v, lambda a: a * a))) AS cost FROM v)"
    " SELECT 'cost' AS part, CAST(0 AS INTEGER) AS i, CAST(0 AS INTEGER) AS j, round(cost, 6) + 0.0 AS value FROM c"
    " UNION ALL SELECT 'gradient', CAST(i - 1 AS INTEGER), CAST(j - 1 AS INTEGER), round(sum(x[i] * v[j]), 6) + 0.0"
    " FROM v, generate_series(1, 64) a(i), generate_series(1, 3) b(j) GROUP BY i, j",
)
def violation_cost(spark, sf_dir):
    table = VectorTable.load(embedding_rows(spark, sf_dir))
    costs, grads = violation_pass(table, [wave(64, 3)], False)
    grad = matrix_df(spark, grads[0]).select(
        F.lit("gradient").alias("part"), "i", "j", r6("value").alias("value")
    )
    cost = spark.createDataFrame([("cost", 0, 0, float(costs[0]))], "part string, i int, j int, value double")
    return cost.select("part", "i", "j", r6("value").alias("value")).unionByName(grad)


@query(
    "label_changes",
    f"WITH {EMB}, {_wave_sql(4)}, v AS (SELECT id, u FROM u), "
    + _wave_sql(4, "1").replace("u AS (SELECT", "w AS (SELECT", 1).replace("] AS u FROM", "] AS b FROM", 1)
    + " SELECT count(*) AS changed FROM v JOIN w USING (id)"
    " WHERE list_position(u, list_max(u)) <> list_position(b, list_max(b))",
)
def label_changes_query(spark, sf_dir):
    table = VectorTable.load(embedding_rows(spark, sf_dir))
    a = P.label_rows(table, P.View(wave(64, 4), False), False)
    b = P.label_rows(table, P.View(wave(64, 4, 1.0), False), False)
    return label_changes(a, b)


@query("label_changes_one_pass", ORACLES["label_changes"])
def label_changes_one_pass(spark, sf_dir):
    table = VectorTable.load(embedding_rows(spark, sf_dir))
    sums = P.view_pass(table, P.View(wave(64, 4), False), False, P.View(wave(64, 4, 1.0), False))
    return spark.createDataFrame([(int(sums.changed),)], "changed long")


# ---------------------------------------------------------------- sums of one pass

CUT = "n AS (SELECT id, x, list_transform(u, lambda a: greatest(a, 0)) AS n FROM u)"
LABELLED = (
    CUT + ", p AS (SELECT id, x, n, list_position(n, list_max(n)) AS lab, list_max(n) AS h FROM n)"
)


def wave_sums(spark, sf_dir):
    table = VectorTable.load(embedding_rows(spark, sf_dir))
    view = P.View(wave(64, 3), True)
    return table, view, P.view_pass(table, view, False, None)


@query(
    "cross_product",
    f"WITH {EMB}, {_wave_sql(3)}, {CUT} SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j,"
    " round(sum(x[i] * n[j]), 6) + 0.0 AS value FROM n, generate_series(1, 64) a(i), generate_series(1, 3) b(j)"
    " GROUP BY i, j",
)
def cross_product(spark, sf_dir):
    _, _, sums = wave_sums(spark, sf_dir)
    return matrix_df(spark, sums.cross).select("i", "j", r6("value").alias("value"))


@query(
    "cluster_sums",
    f"WITH {EMB}, {_wave_sql(3)}, {LABELLED} SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j,"
    " round(coalesce(sum(CASE WHEN lab = j THEN h * x[i] END), 0), 6) + 0.0 AS value"
    " FROM p, generate_series(1, 64) a(i), generate_series(1, 3) b(j) GROUP BY i, j",
)
def cluster_sums(spark, sf_dir):
    _, _, sums = wave_sums(spark, sf_dir)
    return matrix_df(spark, sums.by_label).select("i", "j", r6("value").alias("value"))


@query(
    "column_norms",
    f"WITH {EMB}, {_wave_sql(3)}, {LABELLED} SELECT CAST(j - 1 AS INTEGER) AS j,"
    " round(sqrt(sum(CASE WHEN lab = j THEN h * h ELSE 0 END)), 6) + 0.0 AS value"
    " FROM p, generate_series(1, 3) b(j) GROUP BY j",
)
def column_norms(spark, sf_dir):
    _, _, sums = wave_sums(spark, sf_dir)
    rows = [(j, float(np.sqrt(v))) for j, v in enumerate(sums.h_square)]
    return spark.createDataFrame(rows, "j int, value double").select("j", r6("value").alias("value"))


@query(
    "gram_matrix",
    f"WITH {EMB} SELECT CAST(i - 1 AS INTEGER) AS i, CAST(j - 1 AS INTEGER) AS j,"
    " round(sum(x[i] * x[j]), 6) + 0.0 AS value FROM e, generate_series(1, 64) a(i), generate_series(1, 64) b(j)"
    " GROUP BY i, j",
)
def gram_matrix(spark, sf_dir):
    gram = VectorTable.load(embedding_rows(spark, sf_dir)).gram()
    return matrix_df(spark, gram).select("i", "j", r6("value").alias("value"))


@query(
    "frobenius_residual",
    f"WITH {EMB}, {_wave_sql(3)}, {LABELLED}, d AS (SELECT p.id,"
    " list_sum(list_transform(generate_series(1, 3), lambda j: (u[j] - n[j]) * (u[j] - n[j]))) AS a,"
    " list_sum(list_transform(generate_series(1, 3), lambda j:"
    " (u[j] - CASE WHEN j = lab THEN h ELSE 0 END) * (u[j] - CASE WHEN j = lab THEN h ELSE 0 END))) AS b"
    " FROM p JOIN u ON p.id = u.id)"
    " SELECT round(sqrt(sum(a)), 6) + 0.0 AS to_cut, round(sqrt(sum(b)), 6) + 0.0 AS to_indicator FROM d",
)
def frobenius_residual(spark, sf_dir):
    table, view, sums = wave_sums(spark, sf_dir)
    residual = P.Residuals(table, False)
    a = residual(view, view.z, sums.cross, sums.n_square)
    b = residual(view, view.z, sums.by_label, float(sums.h_square.sum()), np.ones(3))
    out = spark.createDataFrame([(a, b)], "to_cut double, to_indicator double")
    return out.select(r6("to_cut").alias("to_cut"), r6("to_indicator").alias("to_indicator"))


@query(
    "cluster_centers",
    f"WITH {EMB}, {_wave_sql(3)}, {LABELLED}, s AS (SELECT j, i, avg(x[i]) FILTER (lab = j AND h <> 0) AS m"
    " FROM p, generate_series(1, 64) a(i), generate_series(1, 3) b(j) GROUP BY i, j)"
    " SELECT CAST(j - 1 AS INTEGER) AS cluster, CAST(i - 1 AS INTEGER) AS pos,"
    " round(coalesce(m, 0), 6) + 0.0 AS value FROM s",
)
def cluster_centers(spark, sf_dir):
    table, view, _ = wave_sums(spark, sf_dir)
    centers, _ = P.center_pass(table, view, False)
    return exploded(centers_df(spark, centers), ["cluster"], "center")


# ---------------------------------------------------------------- scores

FLAGS = "t AS (SELECT l_returnflag AS truth, l_linestatus AS prediction FROM lineitem)"
ORDERS = "t AS (SELECT o_orderstatus AS truth, o_orderpriority AS prediction FROM orders)"


def flag_pairs(spark, sf_dir):
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("truth"), F.col("l_linestatus").alias("prediction")
    )


def order_pairs(spark, sf_dir):
    return read(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("truth"), F.col("o_orderpriority").alias("prediction")
    )


def planted_pairs(spark, sf_dir):
    """Two partitions of the customers that agree on most nations."""
    nation = F.col("c_nationkey")
    return read(spark, sf_dir, "customer").select(
        (nation % 4).alias("truth"), F.when(nation < 20, (nation + 1) % 4).otherwise(4).alias("prediction")
    )


PAIRS = (
    "t AS (SELECT c_nationkey % 4 AS truth,"
    " CASE WHEN c_nationkey < 20 THEN (c_nationkey + 1) % 4 ELSE 4 END AS prediction FROM customer)"
)


@query(
    "contingency",
    f"WITH {FLAGS} SELECT prediction AS cluster, truth AS class, count(*) AS n FROM t GROUP BY ALL",
)
def contingency_flags(spark, sf_dir):
    return S.contingency(flag_pairs(spark, sf_dir))


@query(
    "contingency_labels",
    "SELECT toxic AS cluster, quality AS class, count(*) AS n FROM labels GROUP BY ALL",
)
def contingency_labels(spark, sf_dir):
    return S.contingency(read(spark, sf_dir, "labels"), "quality", "toxic")


@query(
    "confusion_wide",
    f"WITH {FLAGS} SELECT prediction AS cluster, count(*) FILTER (truth = 'A') AS \"A\","
    " count(*) FILTER (truth = 'N') AS \"N\", count(*) FILTER (truth = 'R') AS \"R\" FROM t GROUP BY prediction",
)
def confusion_wide(spark, sf_dir):
    return S.confusion_wide(S.contingency(flag_pairs(spark, sf_dir)), ["A", "N", "R"])


@query(
    "distinct_labels",
    "SELECT DISTINCT o_orderpriority AS label FROM orders",
)
def distinct_labels(spark, sf_dir):
    return S.distinct_labels(read(spark, sf_dir, "orders"), "o_orderpriority")


CELLS = "cells AS (SELECT prediction AS cluster, truth AS class, count(*) AS n FROM t GROUP BY ALL)"


@query(
    "purity",
    f"WITH {ORDERS}, {CELLS}, c AS (SELECT cluster, max(n) AS top, sum(n) AS s FROM cells GROUP BY cluster)"
    " SELECT round(sum(top) / sum(s), 6) + 0.0 AS purity, CAST(sum(s) AS BIGINT) AS n_rows FROM c",
)
def purity(spark, sf_dir):
    out = S.purity(order_pairs(spark, sf_dir))
    return out.select(r6("purity").alias("purity"), "n_rows")


PERMUTED = (
    "opts AS (SELECT a.n AS na, b.n AS nb, c.n AS nc, d.n AS nd, a.cluster AS ca, b.cluster AS cb,"
    " c.cluster AS cc, d.cluster AS cd FROM (SELECT * FROM cells WHERE class = 0) a,"
    " (SELECT * FROM cells WHERE class = 1) b, (SELECT * FROM cells WHERE class = 2) c,"
    " (SELECT * FROM cells WHERE class = 3) d WHERE a.cluster <> b.cluster AND a.cluster <> c.cluster"
    " AND a.cluster <> d.cluster AND b.cluster <> c.cluster AND b.cluster <> d.cluster AND c.cluster <> d.cluster),"
    " best AS (SELECT * FROM opts ORDER BY na + nb + nc + nd DESC LIMIT 1)"
)


@query(
    "best_mapping",
    f"WITH {PAIRS}, {CELLS}, {PERMUTED} SELECT cluster, CASE cluster WHEN ca THEN 0 WHEN cb THEN 1"
    " WHEN cc THEN 2 WHEN cd THEN 3 END AS mapped FROM (SELECT DISTINCT cluster FROM cells), best",
)
def best_mapping_query(spark, sf_dir):
    return best_mapping(S.contingency(planted_pairs(spark, sf_dir)))


@query(
    "relabel",
    f"WITH {PAIRS}, {CELLS}, {PERMUTED} SELECT CASE prediction WHEN ca THEN 0 WHEN cb THEN 1"
    " WHEN cc THEN 2 WHEN cd THEN 3 END AS mapped, truth, count(*) AS n FROM t, best GROUP BY ALL",
)
def relabel_query(spark, sf_dir):
    pairs = planted_pairs(spark, sf_dir)
    mapped = relabel(pairs, best_mapping(S.contingency(pairs)))
    return mapped.groupBy("mapped", "truth").agg(F.count(F.lit(1)).alias("n"))


@query(
    "accuracy_many_labels",
    "WITH k AS (SELECT l_orderkey, count(*) FILTER (l_linenumber > 3) AS n, count(*) FILTER (l_linenumber <= 3) AS m"
    " FROM lineitem GROUP BY l_orderkey)"
    " SELECT round((sum(n) + greatest(0, max(m - n))) / CAST(sum(n + m) AS DOUBLE), 6) + 0.0 AS accuracy FROM k",
)
def accuracy_many_labels(spark, sf_dir):
    # one cluster has rows of almost all classes and links them into one part; it can be
    # matched with one of them, at the cost of that class's own cluster
    rows = read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("truth"),
        F.when(F.col("l_linenumber") <= 3, -1).otherwise(F.col("l_orderkey")).alias("prediction"),
    )
    return S.accuracy(rows).select(r6("accuracy").alias("accuracy"))


@query(
    "accuracy",
    f"WITH {PAIRS}, {CELLS}, {PERMUTED} SELECT round((na + nb + nc + nd)"
    " / (SELECT CAST(count(*) AS DOUBLE) FROM t), 6) + 0.0 AS accuracy FROM best",
)
def accuracy(spark, sf_dir):
    return S.accuracy(planted_pairs(spark, sf_dir)).select(r6("accuracy").alias("accuracy"))


SCORES = (
    CELLS + ", tot AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM cells),"
    " kc AS (SELECT cluster, CAST(sum(n) AS DOUBLE) AS a FROM cells GROUP BY cluster),"
    " cc AS (SELECT class, CAST(sum(n) AS DOUBLE) AS b FROM cells GROUP BY class),"
    " hk AS (SELECT -sum(a / t * ln(a / t)) AS hk, sum(a * (a - 1) / 2) AS pk FROM kc, tot),"
    " hc AS (SELECT -sum(b / t * ln(b / t)) AS hc, sum(b * (b - 1) / 2) AS pc FROM cc, tot),"
    " mi AS (SELECT sum(n / t * ln(n * t / (a * b))) AS mi, sum(n::DOUBLE * (n - 1) / 2) AS p"
    " FROM cells JOIN kc USING (cluster) JOIN cc USING (class), tot)"
)
SCORE_SQL = {
    "homogeneity": "mi / hc",
    "completeness": "mi / hk",
    "v_measure": "2 * (mi / hc) * (mi / hk) / (mi / hc + mi / hk)",
    "nmi": "mi / ((hc + hk) / 2)",
    "nmi_geometric": "mi / sqrt(hc * hk)",
    "ari": "(p - pk * pc / (t * (t - 1) / 2)) / ((pk + pc) / 2 - pk * pc / (t * (t - 1) / 2))",
}


def score_query(metric: str):
    average = "geometric" if metric.endswith("geometric") else "arithmetic"
    column = metric.split("_geometric")[0]

    def run(spark, sf_dir):
        cells = S.contingency(planted_pairs(spark, sf_dir))
        return S.scores_from_cells(cells, average).select(r6(column).alias(metric))

    return run


for _metric, _expr in SCORE_SQL.items():
    query(
        _metric,
        f"WITH {PAIRS}, {SCORES} SELECT round({_expr}, 6) + 0.0 AS {_metric} FROM mi, hc, hk, tot",
    )(score_query(_metric))


@query(
    "cluster_scores_orders",
    f"WITH {ORDERS}, {SCORES} "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round({e}, 6) + 0.0 AS value FROM mi, hc, hk, tot"
        for m, e in SCORE_SQL.items()
        if m != "nmi_geometric"
    )
    + " UNION ALL SELECT 'purity', round(sum(top) / max(t), 6) + 0.0"
    " FROM (SELECT cluster, max(n) AS top FROM cells GROUP BY cluster), tot"
    " UNION ALL SELECT 'accuracy', round(max(a.n + b.n + c.n) / max(t), 6) + 0.0"
    " FROM cells a, cells b, cells c, tot WHERE a.class = 'F' AND b.class = 'O' AND c.class = 'P'"
    " AND a.cluster <> b.cluster AND a.cluster <> c.cluster AND b.cluster <> c.cluster",
)
def cluster_scores_orders(spark, sf_dir):
    rates = S.cluster_scores(order_pairs(spark, sf_dir))
    return rates.select("metric", r6("value").alias("value"))


# ---------------------------------------------------------------- graphs


@query(
    "knn_graph",
    f"WITH {EMB}, d AS (SELECT a.id AS src, b.id AS dst, list_sum(list_transform(generate_series(1, 64),"
    " lambda i: (a.x[i] - b.x[i]) * (a.x[i] - b.x[i]))) AS d2 FROM e a, e b WHERE a.id <> b.id),"
    " r AS (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank FROM d)"
    " SELECT src, dst, CAST(1.0 AS DOUBLE) AS w FROM r WHERE rank <= 5",
)
def knn_graph_query(spark, sf_dir):
    return knn_graph(embedding_rows(spark, sf_dir).select("id", "x"))


@query(
    "knn_distances",
    f"WITH {PLANTED}, d AS (SELECT a.id AS src, b.id AS dst, "
    + " + ".join(f"(a.x[{i}] - b.x[{i}]) * (a.x[{i}] - b.x[{i}])" for i in range(1, 5))
    + " AS d2 FROM f a, f b WHERE a.id <> b.id),"
    " r AS (SELECT src, d2, row_number() OVER (PARTITION BY src ORDER BY d2, dst) AS rank FROM d)"
    " SELECT src, CAST(rank AS INTEGER) AS rank, round(d2, 6) + 0.0 AS d2 FROM r WHERE rank <= 4",
)
def knn_distances(spark, sf_dir):
    """Squared distances to the four nearest of the grouped rows, which fill several blocks."""
    found = knn_neighbors(planted_rows(spark, sf_dir).select("id", "x"), 4)
    rank = F.row_number().over(Window.partitionBy("src").orderBy("d2", "dst"))
    return found.select("src", rank.alias("rank"), r6("d2").alias("d2"))


@query(
    "symmetrize",
    f"WITH {SYMMETRIC} SELECT src, dst, round(w, 6) + 0.0 AS w FROM edges",
)
def symmetrize_query(spark, sf_dir):
    return G.symmetrize(planted_edges(spark, sf_dir)).select("src", "dst", r6("w").alias("w"))


@query("degrees", f"WITH {DEGREES} SELECT id, round(deg, 6) + 0.0 AS deg FROM deg")
def degrees_query(spark, sf_dir):
    return G.degrees(G.symmetrize(planted_edges(spark, sf_dir))).select("id", r6("deg").alias("deg"))


@query(
    "laplacian_normalized",
    f"WITH {LAPLACIAN} SELECT src, dst, round(value, 6) + 0.0 AS value FROM lap",
)
def laplacian_normalized(spark, sf_dir):
    lap = G.laplacian(G.symmetrize(planted_edges(spark, sf_dir)))
    return lap.select("src", "dst", r6("value").alias("value"))


@query(
    "laplacian_plain",
    f"WITH {DEGREES} SELECT src, dst, round(-w, 6) + 0.0 AS value FROM edges WHERE src <> dst"
    " UNION ALL SELECT id, id, round(deg, 6) + 0.0 FROM deg",
)
def laplacian_plain(spark, sf_dir):
    lap = G.laplacian(G.symmetrize(planted_edges(spark, sf_dir)), normalized=False)
    return lap.select("src", "dst", r6("value").alias("value"))


def node_vectors(spark, sf_dir):
    key = F.col("id")
    return planted_nodes(spark, sf_dir).select(
        "id", F.array(F.sin(key * 1.0), F.cos(key * 2.0)).alias("x"), F.col("label").alias("prediction")
    )


NODE_VECTORS = (
    "y AS (SELECT id, label, sin(CAST(id AS DOUBLE)) AS a, cos(id * CAST(2.0 AS DOUBLE)) AS b FROM nodes)"
)


@query(
    "graph_product",
    f"WITH {LAPLACIAN}, {NODE_VECTORS} SELECT dst AS id, round(sum(value * a), 6) + 0.0 AS p0,"
    " round(sum(value * b), 6) + 0.0 AS p1 FROM lap JOIN y ON id = src GROUP BY dst",
)
def graph_product(spark, sf_dir):
    lap = G.laplacian(G.symmetrize(planted_edges(spark, sf_dir)))
    out = G.multiply_vectors(lap, node_vectors(spark, sf_dir), 2)
    return out.select("id", r6(F.col("x")[0]).alias("p0"), r6(F.col("x")[1]).alias("p1"))


@query(
    "lowrank_product",
    f"WITH {NODES}, {NODE_VECTORS}, s AS (SELECT label, sum(a) AS p0, sum(b) AS p1 FROM y GROUP BY label)"
    " SELECT id, round(p0, 6) + 0.0 AS p0, round(p1, 6) + 0.0 AS p1 FROM y JOIN s USING (label)",
)
def lowrank_product(spark, sf_dir):
    vectors = node_vectors(spark, sf_dir)
    out = G.same_cluster_product(vectors, vectors, 2, 3)
    return out.select("id", r6(F.col("x")[0]).alias("p0"), r6(F.col("x")[1]).alias("p1"))


@query(
    "joint_objective",
    f"WITH {LAPLACIAN}, {NODE_VECTORS}, s AS (SELECT label, sum(a) AS p0, sum(b) AS p1 FROM y GROUP BY label),"
    " h AS (SELECT sum(p0 * p0 + p1 * p1) AS h FROM s),"
    " q AS (SELECT sum(value * (s.a * d.a + s.b * d.b)) AS q FROM lap JOIN y s ON s.id = src JOIN y d ON d.id = dst)"
    " SELECT round(0.5 * (h / (SELECT count(*) FROM nodes) - q), 6) + 0.0 AS objective FROM h, q",
)
def joint_objective(spark, sf_dir):
    vectors = node_vectors(spark, sf_dir)
    lap = G.laplacian(G.symmetrize(planted_edges(spark, sf_dir)))
    out = G.joint_objective(lap, vectors, vectors, 2, 1.0 / vectors.count())
    return out.select(r6("objective").alias("objective"))


@query(
    "sign_fix",
    f"WITH {EMB}, s AS ("
    + " UNION ALL ".join(
        f"(SELECT {j} AS j, sign(x[{j}]) AS s FROM e ORDER BY abs(x[{j}]) DESC, id LIMIT 1)" for j in range(1, 65)
    )
    + ") SELECT id, CAST(j - 1 AS INTEGER) AS pos, round(x[j] * s, 6) + 0.0 AS value FROM e, s",
)
def sign_fix(spark, sf_dir):
    return exploded(G.fix_signs(embedding_rows(spark, sf_dir).select("id", "x"), 64), ["id"])


def separate_edges(spark, sf_dir):
    """The links within the three groups, without those between them."""
    nodes = planted_nodes(spark, sf_dir)
    ends = [nodes.select(F.col("id").alias(e), F.col("label").alias(f"{e}_label")) for e in ("src", "dst")]
    edges = G.symmetrize(planted_edges(spark, sf_dir)).join(ends[0], "src").join(ends[1], "dst")
    return edges.where("src_label = dst_label").select("src", "dst", "w")


@query(
    "eigen_projector",
    f"WITH {SYMMETRIC}, e AS (SELECT src, dst, w, s.label AS label FROM edges JOIN nodes s ON s.id = src"
    " JOIN nodes d ON d.id = dst WHERE s.label = d.label),"
    " own AS (SELECT src AS id, label, sum(w) AS deg FROM e WHERE src <> dst GROUP BY src, label),"
    " volume AS (SELECT label, sum(deg) AS v FROM own GROUP BY label),"
    " pairs AS (SELECT src, dst FROM e UNION SELECT id, id FROM own)"
    " SELECT src, dst, round(sqrt(a.deg * b.deg) / v, 6) + 0.0 AS value FROM pairs"
    " JOIN own a ON a.id = src JOIN own b ON b.id = dst JOIN volume ON volume.label = a.label",
)
def eigen_projector(spark, sf_dir):
    """V V' of the leading eigenvectors, at every edge and node: the same for any basis."""
    scratch = Scratch(spark, "projector")
    # read by the eigenvectors and by the pairs
    edges = Scratch(spark, "separate").cut(separate_edges(spark, sf_dir))
    vectors, _, _ = leading_eigenvectors(NodeGraph.build(edges, True, scratch), 3, scratch, tol=1e-8)
    pairs = edges.select("src", "dst").union(vectors.select("id", "id")).distinct()
    both = pairs.join(vectors.select(F.col("id").alias("src"), F.col("x").alias("a")), "src").join(
        vectors.select(F.col("id").alias("dst"), F.col("x").alias("b")), "dst"
    )
    return both.select("src", "dst", r6(R.dot(F.col("a"), F.col("b"))).alias("value"))


# ---------------------------------------------------------------- centres and Lloyd steps

START = 0.6 * np.eye(4) + 0.1
START_SQL = (
    "c0 AS (SELECT CAST(j AS INTEGER) AS j, "
    + ", ".join(f"(CASE WHEN j = {i} THEN 0.7 ELSE 0.1 END)::DOUBLE AS m{i}" for i in range(4))
    + " FROM generate_series(0, 3) s(j))"
)
DIST = " + ".join(f"(x[{i + 1}] - m{i}) * (x[{i + 1}] - m{i})" for i in range(4))


def _lloyd_sql(steps: int) -> str:
    parts = [PLANTED, START_SQL]
    for s in range(1, steps + 1):
        parts.append(
            f"d{s} AS (SELECT id, x, j, {DIST} AS d2 FROM f, c{s - 1}),"
            f" a{s} AS (SELECT id, x, j, d2 FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY d2, j) AS r"
            f" FROM d{s}) WHERE r = 1),"
            f" c{s} AS (SELECT j, " + ", ".join(f"avg(x[{i + 1}]) AS m{i}" for i in range(4)) + f" FROM a{s} GROUP BY j)"
        )
    return ", ".join(parts)


@query(
    "nearest_center",
    f"WITH {_lloyd_sql(1)} SELECT id, j AS prediction, round(d2, 6) + 0.0 AS d2 FROM a1",
)
def nearest_center(spark, sf_dir):
    near = R.nearest_center(F.col("x"), START)
    rows = planted_rows(spark, sf_dir).select("id", near.alias("c"))
    return rows.select("id", "c.prediction", r6(F.col("c.d2")).alias("d2"))


@query(
    "kmeans_objective",
    f"WITH {_lloyd_sql(1)} SELECT round(sum(d2), 6) + 0.0 AS inertia, count(*) AS n FROM a1",
)
def kmeans_objective(spark, sf_dir):
    table = VectorTable.load(planted_rows(spark, sf_dir))
    labels = nearest_labels(table, START)
    return labels.agg(r6(F.sum("d2")).alias("inertia"), F.count(F.lit(1)).alias("n"))


@query(
    "lloyd_3_steps",
    f"WITH {_lloyd_sql(3)} SELECT j AS cluster, round(m0, 6) + 0.0 AS m0, round(m1, 6) + 0.0 AS m1,"
    " round(m2, 6) + 0.0 AS m2, round(m3, 6) + 0.0 AS m3 FROM c3",
)
def lloyd_3_steps(spark, sf_dir):
    table = VectorTable.load(planted_rows(spark, sf_dir))
    centers = START
    for _ in range(3):
        total, count, _, _ = lloyd_pass(table, centers, None)
        centers = next_centers(table, centers, total, count)
    c = F.col("center")
    return centers_df(spark, centers).select("cluster", *[r6(c[i]).alias(f"m{i}") for i in range(4)])


# ---------------------------------------------------------------- thresholds

BALANCE = "b AS (SELECT abs(c_acctbal) AS t, row_number() OVER (ORDER BY abs(c_acctbal) DESC) AS r FROM customer)"


def balances(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.abs("c_acctbal").alias("t"))


def one_value(spark, value: float) -> DataFrame:
    return spark.createDataFrame([(float(value),)], "threshold double").select(
        r6("threshold").alias("threshold")
    )


@query(
    "threshold_furthest",
    f"WITH {BALANCE} SELECT round(t, 6) + 0.0 AS threshold FROM b WHERE r = 75",
)
def threshold_furthest(spark, sf_dir):
    return one_value(spark, kth_largest(balances(spark, sf_dir), "t", 75))


@query(
    "threshold_percent",
    f"WITH {BALANCE} SELECT round(t, 6) + 0.0 AS threshold FROM b"
    " WHERE r = (SELECT CAST(floor(count(*) * 0.3) AS BIGINT) FROM b)",
)
def threshold_percent(spark, sf_dir):
    rows = balances(spark, sf_dir)
    return one_value(spark, kth_largest(rows, "t", int(0.3 * rows.count())))


@query(
    "threshold_counted",
    "WITH b AS (SELECT l_extendedprice AS t, row_number() OVER (ORDER BY l_extendedprice DESC) AS r,"
    " count(*) OVER () AS n FROM lineitem)"
    " SELECT round(t, 6) + 0.0 AS threshold FROM b WHERE r = CAST(floor(n * 0.3) AS BIGINT)",
)
def threshold_counted(spark, sf_dir):
    """A rank in proportion to a large table, found by counting bins."""
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("t"))
    return one_value(spark, kth_largest(rows, "t", int(0.3 * rows.count())))


@query(
    "threshold_adaptive",
    f"WITH {BALANCE}, c AS (SELECT t, r, t + lead(t, 2) OVER (ORDER BY r) - 2 * lead(t, 1) OVER (ORDER BY r) AS v"
    " FROM b WHERE r <= (SELECT CAST(floor(count(*) * 0.1) AS BIGINT) FROM b))"
    " SELECT round(coalesce((SELECT t FROM c WHERE v > 0 ORDER BY v DESC, r LIMIT 1),"
    " (SELECT min(t) FROM c)), 6) + 0.0 AS threshold",
)
def threshold_adaptive(spark, sf_dir):
    rows = balances(spark, sf_dir)
    return one_value(spark, curvature_threshold(rows, "t", int(0.1 * rows.count())))


# ---------------------------------------------------------------- one ADMM step

RHO, MU = 2.0, 0.1
ADMM = (
    f"WITH {PLANTED_OUT}, s AS (SELECT id, x AS u, list_transform(x, lambda v: v * 0.9::DOUBLE) AS w,"
    " list_transform(x, lambda v: v * 0.2::DOUBLE) AS l, list_position(x, list_max(x)) AS lab FROM f),"
    f" t AS (SELECT *, list_transform(generate_series(1, 4), lambda i: w[i] - u[i] + l[i] / {RHO}::DOUBLE) AS t FROM s),"
    " n AS (SELECT *, sqrt(list_sum(list_transform(t, lambda v: v * v))) AS norm FROM t),"
    f" v AS (SELECT *, list_transform(t, lambda q: CASE WHEN norm <= {2 * MU / RHO}::DOUBLE THEN 0.0::DOUBLE"
    f" ELSE (1 - {2 * MU / RHO}::DOUBLE / norm) * q END) AS v FROM n),"
    f" k AS (SELECT *, list_transform(generate_series(1, 4), lambda i: ({RHO}::DOUBLE * (v[i] + u[i]) - l[i]"
    f" + CASE WHEN lab = i THEN 1 ELSE 0 END) / (1 + {RHO}::DOUBLE)) AS w2 FROM v),"
    f" m AS (SELECT *, list_transform(generate_series(1, 4), lambda i: l[i] + {RHO}::DOUBLE * (w2[i] - v[i] - u[i])) AS l2 FROM k)"
)


def admm_step(spark, sf_dir):
    rows = planted_outlier_rows(spark, sf_dir)
    state = rows.select(
        "id",
        F.col("x").alias("u"),
        F.transform("x", lambda v: v * 0.9).alias("w"),
        F.transform("x", lambda v: v * 0.2).alias("l"),
    )
    return update_rows(state, P.View(np.eye(4), False), True, np.eye(4), np.ones(4), MU, RHO)


@query(
    "admm_one_step",
    ADMM + " SELECT id, CAST(i - 1 AS INTEGER) AS pos, round(w2[i], 6) + 0.0 AS w, round(l2[i], 6) + 0.0 AS l"
    " FROM m, generate_series(1, 4) s(i)",
)
def admm_one_step(spark, sf_dir):
    both = admm_step(spark, sf_dir).select("id", F.posexplode(F.arrays_zip("w", "l")).alias("pos", "p"))
    return both.select("id", "pos", r6(F.col("p.w")).alias("w"), r6(F.col("p.l")).alias("l"))


@query(
    "admm_objective",
    ADMM + ", g AS (SELECT list_sum(list_transform(v, lambda a: a * a)) AS v2,"
    " list_sum(list_transform(generate_series(1, 4), lambda i: (w2[i] - v[i] - u[i]) * (w2[i] - v[i] - u[i]))) AS gap2,"
    " list_sum(list_transform(generate_series(1, 4), lambda i: (w2[i] - w[i]) * (w2[i] - w[i]))) AS step2,"
    " list_sum(list_transform(generate_series(1, 4), lambda i: l2[i] * (w2[i] - v[i] - u[i]))) AS lg,"
    " list_sum(list_transform(generate_series(1, 4), lambda i: (w2[i] - CASE WHEN lab = i THEN 1 ELSE 0 END)"
    " * (w2[i] - CASE WHEN lab = i THEN 1 ELSE 0 END))) AS fit2 FROM m)"
    f" SELECT round(0.5 * sqrt(sum(fit2)) + {MU} * sum(sqrt(v2)) + sum(lg) + {RHO} / 2 * sum(gap2), 6) + 0.0 AS objective,"
    f" round(sqrt(sum(gap2)), 6) + 0.0 AS primal, round({RHO} * sqrt(sum(step2)), 6) + 0.0 AS dual FROM g",
)
def admm_objective(spark, sf_dir):
    names = ("v_norm", "gap2", "step2", "l_gap", "fit2")
    sums = admm_step(spark, sf_dir).agg(*[F.sum(c).alias(c) for c in names])
    value = objective({c: F.col(c) for c in ("gap2", "l_gap")} | {"v_norm": 0.0, "fit2": 0.0}, MU, RHO)
    return sums.select(
        r6(0.5 * F.sqrt("fit2") + MU * F.col("v_norm") + value).alias("objective"),
        r6(F.sqrt("gap2")).alias("primal"),
        r6(RHO * F.sqrt("step2")).alias("dual"),
    )


# ---------------------------------------------------------------- fixed step counts, closed form


def _polar_sql(step: int, source: str, cut: bool, round_up: bool) -> str:
    """One step of the 2 x 2 iteration: scores, their cut or indicator part, polar factor."""
    prev = f"z{step - 1}"
    u0, u1 = "p * z11 + q * z21", "p * z12 + q * z22"
    n = "greatest({}, 0)" if cut else "{}"
    out = f"u{step} AS (SELECT p, q, {n.format(u0)} AS a0, {n.format(u1)} AS b0 FROM f, {prev}), "
    if round_up:
        out += (
            f"h{step} AS (SELECT p, q, CASE WHEN a0 >= b0 THEN a0 ELSE 0 END AS a,"
            f" CASE WHEN a0 >= b0 THEN 0 ELSE b0 END AS b FROM u{step}), "
        )
    else:
        out += f"h{step} AS (SELECT p, q, a0 AS a, b0 AS b FROM u{step}), "
    out += (
        f"m{step} AS (SELECT sum(p * a) AS a, sum(p * b) AS b, sum(q * a) AS c, sum(q * b) AS d FROM h{step}),"
        f" z{step} AS (SELECT CASE WHEN a * d - b * c > 0 THEN (a + d) / r ELSE (a - d) / s END AS z11,"
        f" CASE WHEN a * d - b * c > 0 THEN (b - c) / r ELSE (b + c) / s END AS z12,"
        f" CASE WHEN a * d - b * c > 0 THEN (c - b) / r ELSE (b + c) / s END AS z21,"
        f" CASE WHEN a * d - b * c > 0 THEN (a + d) / r ELSE (d - a) / s END AS z22"
        f" FROM (SELECT *, sqrt((a + d) * (a + d) + (b - c) * (b - c)) AS r,"
        f" sqrt((a - d) * (a - d) + (b + c) * (b + c)) AS s FROM m{step}))"
    )
    return out


Z0 = "z0 AS (SELECT 1.0::DOUBLE AS z11, 0.0::DOUBLE AS z12, 0.0::DOUBLE AS z21, 1.0::DOUBLE AS z22)"
Z_OUT = (
    " SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(CASE WHEN i = 0 AND j = 0 THEN z11"
    " WHEN i = 0 THEN z12 WHEN j = 0 THEN z21 ELSE z22 END, 6) + 0.0 AS value"
    " FROM z3, generate_series(0, 1) a(i), generate_series(0, 1) b(j)"
)


@query(
    "rotation_2d_3_steps",
    f"WITH {TURNED}, {Z0}, " + ", ".join(_polar_sql(s, "f", False, True) for s in (1, 2, 3)) + Z_OUT,
)
def rotation_2d_3_steps(spark, sf_dir):
    table = VectorTable.load(turned_rows(spark, sf_dir))
    z = np.eye(2)
    for _ in range(3):
        z = polar_factor(P.view_pass(table, P.View(z, False), False, None).by_label)
    return matrix_df(spark, z).select("i", "j", r6("value").alias("value"))


@query(
    "alternating_2d_3_steps",
    f"WITH {TURNED}, {Z0}, " + ", ".join(_polar_sql(s, "f", True, False) for s in (1, 2, 3)) + Z_OUT,
)
def alternating_2d_3_steps(spark, sf_dir):
    table = VectorTable.load(turned_rows(spark, sf_dir))
    z = np.eye(2)
    for _ in range(3):
        z = polar_factor(P.view_pass(table, P.View(z, True), False, None).cross)
    return matrix_df(spark, z).select("i", "j", r6("value").alias("value"))


# ---------------------------------------------------------------- fits on planted groups


def matched(labels: DataFrame, truth: DataFrame) -> DataFrame:
    """Each row's planted label and its prediction after label matching."""
    both = truth.select("id", F.col("label").alias("truth")).join(labels, "id")
    named = relabel(both, best_mapping(S.contingency(both)))
    return named.select("id", F.col("truth").alias("label"), "mapped")


RECOVERED = f"WITH {PLANTED} SELECT id, label, label AS mapped FROM f"
RECOVERED_2D = "SELECT c_custkey AS id, c_nationkey % 2 AS label, c_nationkey % 2 AS mapped FROM customer"
RECOVERED_GRAPH = f"WITH {NODES} SELECT id, label, label AS mapped FROM nodes"


def planted_fit(spark, sf_dir, estimator, refine=False):
    rows = planted_rows(spark, sf_dir)
    return matched(estimator.fit(rows, refine=refine).labels, rows)


@query("alternating_fit", RECOVERED)
def alternating_fit(spark, sf_dir):
    return planted_fit(spark, sf_dir, IndicatorClustering(4, post_rotation=False))


@query("spectral_rotation_fit", RECOVERED)
def spectral_rotation_fit(spark, sf_dir):
    return planted_fit(spark, sf_dir, IndicatorClustering(4, do_inner=False))


@query("post_rotation_fit", RECOVERED)
def post_rotation_fit(spark, sf_dir):
    return planted_fit(spark, sf_dir, IndicatorClustering(4, post_rotation=True))


@query("column_normalized_fit", RECOVERED)
def column_normalized_fit(spark, sf_dir):
    return planted_fit(spark, sf_dir, IndicatorClustering(4, normalize_columns=True, h_values="one"))


@query("refined_fit", RECOVERED)
def refined_fit(spark, sf_dir):
    return planted_fit(spark, sf_dir, IndicatorClustering(4), refine=True)


@query("turned_fit", RECOVERED_2D)
def turned_fit(spark, sf_dir):
    rows = turned_rows(spark, sf_dir)
    return matched(IndicatorClustering(2).fit(rows).labels, rows)


@query("riemann_fit_sd", RECOVERED)
def riemann_fit_sd(spark, sf_dir):
    return planted_fit(spark, sf_dir, RiemannianIndicatorClustering(4))


@query("riemann_fit_cg", RECOVERED)
def riemann_fit_cg(spark, sf_dir):
    return planted_fit(spark, sf_dir, RiemannianIndicatorClustering(4, solver="CG"))


@query("riemann_fit_tr", RECOVERED)
def riemann_fit_tr(spark, sf_dir):
    return planted_fit(spark, sf_dir, RiemannianIndicatorClustering(4, solver="TR"))


@query("riemann_fit_nm", RECOVERED_2D)
def riemann_fit_nm(spark, sf_dir):
    rows = turned_rows(spark, sf_dir)
    return matched(RiemannianIndicatorClustering(2, solver="NM").fit(rows).labels, rows)


@query("riemann_refined_fit", RECOVERED)
def riemann_refined_fit(spark, sf_dir):
    return planted_fit(spark, sf_dir, RiemannianIndicatorClustering(4), refine=True)


PLANTED_IDS = "SELECT c_custkey AS id FROM customer WHERE c_custkey % 20 = 7"


@query("robust_fit_furthest", PLANTED_IDS)
def robust_fit_furthest(spark, sf_dir):
    rows = planted_outlier_rows(spark, sf_dir)
    count = rows.where("planted").count()
    return RobustIndicatorClustering(4, mu=f"furthest {count}").fit(rows).outliers


@query("robust_fit_adaptive", PLANTED_IDS)
def robust_fit_adaptive(spark, sf_dir):
    return RobustIndicatorClustering(4).fit(planted_outlier_rows(spark, sf_dir)).outliers


@query("robust_fit_percent", "SELECT c_custkey AS id, CAST((SELECT floor(count(*) * 0.1) FROM customer) AS BIGINT)"
       " AS n_outliers FROM customer WHERE c_custkey % 20 = 7")
def robust_fit_percent(spark, sf_dir):
    """The planted rows among the outliers, each with the number of all outliers."""
    rows = planted_outlier_rows(spark, sf_dir)
    found = RobustIndicatorClustering(4, mu="10%").fit(rows).outliers.persist()
    planted = found.join(rows.where("planted"), "id").select("id")
    return planted.withColumn("n_outliers", F.lit(found.count()).cast("long"))


@query("robust_labels", "SELECT c_custkey AS id, c_custkey % 20 = 7 AS planted,"
       " CASE WHEN c_custkey % 20 <> 7 THEN c_nationkey % 4 END AS label FROM customer")
def robust_labels(spark, sf_dir):
    """Every id; rows that were moved off their axis are marked and have no label to compare."""
    rows = planted_outlier_rows(spark, sf_dir)
    labels = RobustIndicatorClustering(4, mu=0.2).fit(rows).labels
    clean = matched(labels, rows.where(~F.col("planted"))).select("id", F.col("mapped").alias("found"))
    every = labels.select("id").join(rows.select("id", "planted"), "id").join(clean, "id", "left")
    return every.select("id", "planted", F.col("found").alias("label"))


@query("corrected_data")
def corrected_data(spark, sf_dir):
    rows = planted_outlier_rows(spark, sf_dir)
    return exploded(RobustIndicatorClustering(4, mu=0.2).fit(rows).corrected, ["id"])


@query(
    "thin_qr",
    f"WITH {TURNED}, gram AS (SELECT sum(p * p) AS a, sum(p * q) AS b, sum(q * q) AS c FROM f),"
    " r AS (SELECT sqrt(a) AS r11, b / sqrt(a) AS r12, sqrt(c - b * b / a) AS r22 FROM gram)"
    " SELECT id, round(p / r11, 6) + 0.0 AS q0, round((q - p / r11 * r12) / r22, 6) + 0.0 AS q1 FROM f, r",
)
def thin_qr(spark, sf_dir):
    q, _, _ = tall_qr(VectorTable.load(turned_rows(spark, sf_dir)))
    return q.select("id", r6(F.col("x")[0]).alias("q0"), r6(F.col("x")[1]).alias("q1"))


@query("joint_fit", RECOVERED_GRAPH)
def joint_fit(spark, sf_dir):
    model = JointIndicatorClustering(3).fit_graph(planted_edges(spark, sf_dir))
    return matched(model.labels, planted_nodes(spark, sf_dir))


@query("spectral_embedding", RECOVERED_GRAPH)
def spectral_embedding_query(spark, sf_dir):
    """Embed the graph, then cluster the embedding."""
    embedding = spectral_embedding(G.symmetrize(planted_edges(spark, sf_dir)), 3)
    labels = IndicatorClustering(3).fit(embedding).labels
    return matched(labels, planted_nodes(spark, sf_dir))


@query("agglomerate_ward", RECOVERED)
def agglomerate_ward(spark, sf_dir):
    rows = planted_rows(spark, sf_dir)
    return matched(agglomerate(rows.select("id", "x"), 4), rows)


@query("kmeans_baseline", RECOVERED_2D)
def kmeans_baseline_query(spark, sf_dir):
    rows = turned_rows(spark, sf_dir)
    return matched(kmeans_baseline(rows, 2, seed=1), rows)


def scattered_rows(spark, sf_dir):
    """The four groups with uniform scatter around each axis."""
    label = F.col("c_nationkey") % 4
    x = [
        F.when(label == j, 1.0).otherwise(0.0)
        + F.pmod(F.xxhash64("c_custkey", F.lit(j)), F.lit(1000)) * 0.0004
        for j in range(4)
    ]
    return read(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), F.array(*x).alias("x"), label.alias("label")
    )


@query("compare")
def compare_query(spark, sf_dir):
    table = compare({"customers": scattered_rows(spark, sf_dir)})
    return table.where(F.col("metric") != "seconds")


# ---------------------------------------------------------------- optional subpackage

try:
    import corpus_pipeline
    from orthant.llm import queries as corpus_queries
except ImportError:  # the subpackage may be left out
    pass
else:
    QUERIES.update(corpus_queries.QUERIES)
    ORACLES.update(corpus_queries.ORACLES)
    QUERIES["pipeline"] = corpus_pipeline.run
    if corpus_pipeline.ORACLE_SQL:
        ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL


# ---------------------------------------------------------------- driver contract


def entry(spark: SparkSession) -> DataFrame:
    """Alternating projections with refinement on planted groups, scored."""
    sf_dir = "/root/testdata/sf0.001"
    rows = planted_rows(spark, sf_dir)
    labels = IndicatorClustering(4).fit(rows, refine=True).labels
    pairs = labels.join(rows.select("id", F.col("label").alias("truth")), "id")
    return S.cluster_scores(pairs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
