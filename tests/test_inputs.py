import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from orthant import VectorTable, load_labelled
from orthant.functions import rows as R
from orthant.plans.params import (
    Threshold,
    check_h_values,
    check_solver,
    parse_init,
    parse_inner,
    parse_threshold,
)
from orthant.sources.vectors import check_cluster_count, read_table, untranspose


def test_row_functions_on_edge_rows(spark):
    rows = [(0, [0.0, 0.0]), (1, [2.0, 2.0]), (2, [-3.0, -4.0]), (3, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "id int, x array<double>")
    x = F.col("x")
    got = df.orderBy("id").select(
        R.unit_row(x).alias("u"),
        R.indicator(x).alias("p"),
        R.shrink_row(x, 2.5).alias("s"),
        R.nonnegative(x).alias("n"),
    )
    zero, tie, negative, plain = got.collect()
    assert zero["u"] == [0.0, 0.0] and zero["s"] == [0.0, 0.0]
    assert tie["p"]["prediction"] == 0
    assert negative["p"] == (0, -3.0) and negative["n"] == [0.0, 0.0]
    assert plain["u"] == [0.6, 0.8]
    assert plain["s"] == pytest.approx([1.5, 2.0])


@pytest.mark.parametrize(
    "rows, message",
    [
        ([(0, [1.0, None])], "null or NaN"),
        ([(0, [1.0, float("nan")])], "null or NaN"),
        ([(0, None)], "null or NaN"),
        ([(0, [1.0, float("inf")])], "infinite"),
        ([(0, [1.0]), (1, [1.0, 2.0])], "length"),
        ([(0, [1.0]), (0, [2.0])], "unique"),
        ([], "no rows"),
    ],
)
def test_bad_tables_are_refused(spark, rows, message):
    df = spark.createDataFrame(rows, "id long, x array<double>")
    with pytest.raises(ValueError, match=message):
        VectorTable.load(df)


def test_input_forms(spark, vectors):
    x = np.arange(12.0).reshape(4, 3)
    base = vectors(x)
    floats = base.select("id", F.col("x").cast("array<float>").alias("x"))
    packed = base.select("id", array_to_vector("x").alias("x"))
    for df in (base, floats, packed):
        table = VectorTable.load(df)
        assert (table.n, table.d) == (4, 3)
        assert np.allclose(table.gram(), x.T @ x)


def test_labelled_aliases(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 7)], "id long, fea array<double>, gnd int")
    assert load_labelled(df).collect() == [(1, [1.0, 2.0], 7)]
    with pytest.raises(ValueError, match="feature"):
        load_labelled(df.drop("fea"))
    with pytest.raises(ValueError, match="label"):
        load_labelled(df.drop("gnd"))


def test_transposed_table(spark):
    x = np.arange(6.0).reshape(3, 2)
    df = spark.createDataFrame(
        [(j, [float(v) for v in x[:, j]]) for j in range(2)], "feature int, alls array<double>"
    )
    got = {r["id"]: r["x"] for r in untranspose(df, "alls").collect()}
    assert got == {i: list(x[i]) for i in range(3)}
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)], "id long, idxg int")
    assert load_labelled(df, labels_df=labels).count() == 3


def test_csv_source(spark, tmp_path):
    path = str(tmp_path / "t.csv")
    spark.createDataFrame([(1, 2.5)], "id long, a double").write.option("header", True).csv(path)
    assert read_table(spark, path).collect() == [(1, 2.5)]


def test_threshold_grammar():
    assert parse_threshold(0, 5) == Threshold("fixed", 0.0)
    assert parse_threshold("10%", 5) == Threshold("percent", 0.1)
    assert parse_threshold("Furthest 5", 5) == Threshold("furthest", 5)
    assert parse_threshold("furthest-3", 5) == Threshold("furthest", 3)
    assert parse_threshold("ADAPTIVE", 5) == Threshold("adaptive")
    for bad in (-1, "101%", "x%", "furthest 6", "furthest", "near 3", "", None, [1]):
        with pytest.raises(ValueError):
            parse_threshold(bad, 5)


def test_other_parameters(spark):
    assert np.array_equal(parse_init("eye", 3, 2), np.eye(3, 2))
    assert parse_init("random", 3, 2) is None
    cells = spark.createDataFrame([(i, j, 1.0 * i + j) for i in range(3) for j in range(2)], "i int, j int, value double")
    assert np.array_equal(parse_init(cells, 3, 2), np.add.outer(np.arange(3.0), np.arange(2.0)))
    for bad in ("ones", np.eye(2), None):
        with pytest.raises(ValueError):
            parse_init(bad, 3, 2)
    assert parse_inner("relu") and not parse_inner(0)
    for call in (
        lambda: parse_inner("softmax"),
        lambda: check_solver("BFGS"),
        lambda: check_h_values("two"),
        lambda: check_cluster_count(4, 3, 5),
        lambda: check_cluster_count(4, 5, 3),
    ):
        with pytest.raises(ValueError):
            call()


def test_ml_vectors_keep_one_row_per_row(spark, vectors):
    rows = vectors(np.arange(6.0).reshape(3, 2), ids=[1, 1, 2])
    raw = rows.select("id", array_to_vector("x").alias("fea"), F.col("id").alias("gnd"))
    assert load_labelled(raw).count() == 3


def test_square_search_starts_at_a_rotation():
    from orthant.plans.riemann import as_rotation

    mirror = np.diag([1.0, -1.0])
    assert np.linalg.det(as_rotation(mirror)) == 1.0
    assert as_rotation(np.eye(3)[:, :2]).shape == (3, 2)


def test_warning_when_entries_and_clusters_differ(vectors):
    from orthant import IndicatorClustering

    with pytest.warns(UserWarning, match="entries"):
        IndicatorClustering(2, max_iter_out=1).fit(vectors(np.eye(3)))
