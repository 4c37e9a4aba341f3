import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from orthant import (
    IndicatorClustering,
    JointIndicatorClustering,
    RiemannianIndicatorClustering,
    RobustIndicatorClustering,
    VectorTable,
    lloyd,
    spectral_embedding,
)
from orthant.operators import graph as G
from orthant.operators.eigen import NodeGraph, leading_eigenvectors
from orthant.plans import rounding as P
from orthant.plans.lloyd import squared_distances
from orthant.plans.riemann import curvature_pass, retract, tangent, violation_pass
from orthant.plans.robust import tall_qr
from orthant.session import Scratch

SF_DIR = "/root/testdata/sf0.001"


def block_graph(spark, sizes=(50, 40, 30)):
    a = np.zeros((sum(sizes), sum(sizes)))
    starts = np.cumsum([0, *sizes[:-1]])
    for s, z in zip(starts, sizes):
        a[s : s + z, s : s + z] = 1
    np.fill_diagonal(a, 0)
    for s, t in zip(starts[:-1], starts[1:]):
        a[s, t] = a[t, s] = 0.01
    i, j = np.nonzero(a)
    rows = [(int(p), int(q), float(a[p, q])) for p, q in zip(i, j)]
    truth = np.repeat(np.arange(len(sizes)), sizes)
    return spark.createDataFrame(rows, "src long, dst long, w double"), a, truth


def array(df):
    return np.array([r[1] for r in df.orderBy("id").collect()])


def test_pass_sums_and_residuals(vectors):
    rng = np.random.default_rng(0)
    x, z = rng.standard_normal((120, 5)), rng.standard_normal((5, 3))
    table = VectorTable.load(vectors(x))
    view = P.View(z, True)
    n = np.maximum(x @ z, 0)
    label, h = n.argmax(1), n.max(1)
    hot = np.zeros_like(n)
    hot[np.arange(120), label] = h
    sums = P.view_pass(table, view, False, P.View(-z, True))
    assert np.allclose(sums.cross, x.T @ n) and np.isclose(sums.n_square, (n**2).sum())
    assert np.allclose(sums.by_label, x.T @ hot) and np.allclose(sums.h_square, (hot**2).sum(0))
    assert sums.changed == (label != np.maximum(-x @ z, 0).argmax(1)).sum()
    target = np.linalg.qr(z)[0]
    residual = P.Residuals(table, False)
    want = np.linalg.norm(x @ target - n)
    assert residual(view, target, sums.cross, sums.n_square) == pytest.approx(want)
    assert P.direct_residual(table, view, target, False, None) == pytest.approx(want)
    want = np.linalg.norm(x @ target - hot)
    assert P.direct_residual(table, view, target, False, np.ones(3)) == pytest.approx(want)


def test_tree_sums_equal_direct_sums(vectors, monkeypatch):
    from orthant.operators import passes

    x = np.random.default_rng(0).standard_normal((50, 4))
    table = VectorTable.load(vectors(x))
    direct = table.gram()
    monkeypatch.setattr(passes, "DIRECT_DOUBLES", 0)
    assert np.allclose(table.gram(), direct) and np.allclose(direct, x.T @ x)


def test_fit_properties(spark):
    rows = E.planted_rows(spark, SF_DIR)
    truth = [r["label"] for r in rows.orderBy("id").collect()]
    model = IndicatorClustering(4).fit(rows)
    assert array(model.labels).tolist() == truth
    z = model.rotation_matrix
    assert np.allclose(z.T @ z, np.eye(4))
    assert model.residual == model.trace.values("residual")[-1]
    gaps = [v for it, phase, metric, v in model.trace.rows if metric == "gap" and it == 1]
    assert all(a >= b for a, b in zip(gaps[:-1], gaps[1:-1]))
    for parts in (1, 16):
        again = IndicatorClustering(4).fit(rows.repartition(parts, "x"))
        assert array(again.labels).tolist() == truth
    scaled = rows.select("id", F.transform("x", lambda v: v * (F.col("id") + 1)).alias("x"))
    assert array(IndicatorClustering(4).fit(scaled).labels).tolist() == truth
    again = IndicatorClustering(4, init=z).fit(rows)
    assert array(again.labels).tolist() == truth
    assert set(array(IndicatorClustering(4, init="random", seed=5).fit(rows).labels)) <= set(range(4))


def test_saved_model(spark, tmp_path):
    model = IndicatorClustering(4).fit(E.planted_rows(spark, SF_DIR), refine=True)
    model.save(str(tmp_path / "m"))
    for name in ("labels", "centers", "rotation", "history"):
        assert spark.read.parquet(str(tmp_path / "m" / name)).count() > 0


def test_centers_leave_out_zero_rows(vectors):
    x = np.array([[1.0, 0.0], [-1.0, -1.0], [0.0, 2.0]])
    table = VectorTable.load(vectors(x))
    centers, count = P.center_pass(table, P.View(np.eye(2), True, "max"), False)
    assert count.tolist() == [1, 1] and centers.tolist() == [[1, 0], [0, 2]]
    centers, count = P.center_pass(table, P.View(np.eye(2), True, "one"), False)
    assert count.tolist() == [2, 1] and centers.tolist() == [[0, -0.5], [0, 2]]


def test_lloyd_matches_numpy_and_fills_empty_centers(vectors):
    rng = np.random.default_rng(4)
    x = np.vstack([rng.normal(c, 0.1, (30, 2)) for c in ((0, 0), (3, 0), (0, 3))])
    table = VectorTable.load(vectors(x))
    model = lloyd(table, np.array([[0.0, 0.0], [3.0, 0.0], [90.0, 90.0]]))
    centers = model.centers_matrix
    dist = squared_distances(x, centers)
    assert array(model.labels).tolist() == dist.argmin(1).tolist()
    assert model.inertia == pytest.approx(dist.min(1).sum())
    assert sorted(np.bincount(dist.argmin(1))) == [30, 30, 30]


@pytest.mark.parametrize("solver", ["SD", "CG", "TR", "NM"])
def test_riemann_solvers(spark, solver):
    rows = E.turned_rows(spark, SF_DIR)
    model = RiemannianIndicatorClustering(2, solver=solver).fit(rows)
    truth = np.array([r["label"] for r in rows.orderBy("id").collect()])
    got = array(model.labels)
    assert (got == truth).all() or (got == 1 - truth).all()


def test_riemann_derivatives(vectors):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((60, 4))
    table = VectorTable.load(vectors(x))
    r = np.linalg.qr(rng.standard_normal((4, 2)))[0]
    xi = tangent(r, rng.standard_normal((4, 2)))
    cost, grad = violation_pass(table, [r], False)
    assert cost[0] == pytest.approx(0.5 * (np.minimum(x @ r, 0) ** 2).sum())
    step = 1e-6
    up, down = (violation_pass(table, [r + s * xi], False) for s in (step, -step))
    assert np.vdot(grad[0], xi) == pytest.approx((up[0][0] - down[0][0]) / (2 * step), rel=1e-5)
    bent = curvature_pass(table, r, xi, False)
    assert np.allclose(bent, (up[1][0] - down[1][0]) / (2 * step), atol=1e-4)
    moved = retract(r, xi)
    assert np.allclose(moved.T @ moved, np.eye(2))


def test_stiefel_search_lowers_the_cost(spark, vectors):
    x = np.abs(np.random.default_rng(7).standard_normal((80, 3))) * [1, -1, 1]
    model = RiemannianIndicatorClustering(2, max_iter_in=15, max_iter_out=2).fit(vectors(x))
    z = model.rotation_matrix
    assert z.shape == (3, 2) and np.allclose(z.T @ z, np.eye(2))


@pytest.mark.parametrize("mu", ["furthest 7", 0.2])
def test_robust_finds_planted_outliers(spark, mu):
    rows = E.planted_outlier_rows(spark, SF_DIR)
    planted = {r["id"] for r in rows.where("planted").collect()}
    assert len(planted) == 8
    model = RobustIndicatorClustering(4, mu=mu.replace("7", "8") if isinstance(mu, str) else mu).fit(rows)
    assert {r["id"] for r in model.outliers.collect()} == planted
    assert model.corrected.count() == rows.count() == model.labels.count()


def test_robust_wide_rows_and_no_outliers(spark, vectors):
    x = np.hstack([np.kron(np.eye(2), np.ones((10, 1))), np.full((20, 1), 0.1)])
    model = RobustIndicatorClustering(2, mu="0%", max_iter=2).fit(vectors(x))
    assert model.outliers.count() == 0 and model.n_iter <= 2


def test_thin_qr(vectors):
    x = np.random.default_rng(0).standard_normal((40, 3))
    q, r, changed = tall_qr(VectorTable.load(vectors(x)))
    assert changed and np.allclose(array(q) @ r, x) and np.allclose(array(q).T @ array(q), np.eye(3))
    assert not tall_qr(VectorTable.load(q))[2]


@pytest.mark.parametrize("normalized", [True, False])
def test_eigenvectors(spark, normalized):
    edges, a, _ = block_graph(spark, (20, 15, 10))
    d = a.sum(1)
    lap = np.eye(len(a)) - a / np.sqrt(np.outer(d, d)) if normalized else np.diag(d) - a
    values, vecs = np.linalg.eigh(lap)
    scratch = Scratch(spark, "test")
    g = NodeGraph.build(edges, normalized, scratch)
    x, got, error = leading_eigenvectors(g, 3, scratch)
    x = array(x)
    assert np.allclose(-got, values[:3], atol=1e-8) and error < 1e-6
    assert np.allclose(x @ x.T, vecs[:, :3] @ vecs[:, :3].T, atol=1e-6)


@pytest.mark.parametrize("normalized", [True, False])
def test_label_term_against_dense_eigenvectors(spark, normalized):
    edges, a, truth = block_graph(spark, (20, 15, 10))
    d, n = a.sum(1), len(a)
    lap = np.eye(n) - a / np.sqrt(np.outer(d, d)) if normalized else np.diag(d) - a
    # label 3 of 4 has no node, and one label is spread over two blocks
    label = np.where(np.arange(n) % 7 == 0, 1, np.minimum(truth, 1) * 2)
    h = np.eye(4)[label]
    rho = 0.3
    values, vecs = np.linalg.eigh(-lap + rho * h @ h.T)
    labels = spark.createDataFrame([(i, int(c)) for i, c in enumerate(label)], "id long, prediction int")
    scratch = Scratch(spark, "test")
    g = NodeGraph.build(edges, normalized, scratch)
    x, got, error = leading_eigenvectors(g, 3, scratch, labels=labels, rho=rho, n_labels=4)
    x = array(x)
    assert np.allclose(got, values[::-1][:3], atol=1e-7) and error < 1e-5
    assert np.allclose(x @ x.T, vecs[:, -3:] @ vecs[:, -3:].T, atol=1e-5)
    # the same from a start near the result
    start = spark.createDataFrame([(i, [float(e) for e in r]) for i, r in enumerate(x)], "id long, x array<double>")
    _, again, _ = leading_eigenvectors(g, 3, scratch, labels=labels, rho=rho, n_labels=4, start=start)
    assert np.allclose(again, values[::-1][:3], atol=1e-7)


def test_hubs_are_spread_without_changing_products(spark, monkeypatch):
    edges, a, _ = block_graph(spark, (12, 8))
    monkeypatch.setattr(G, "SLOT_EDGES", 5)
    slotted, hubs = G.spread_hubs(edges)
    assert hubs.count() == 20 and slotted.groupBy("src", "slot").count().count() > 20
    g = NodeGraph.build(edges, True, Scratch(spark, "test"))
    _, values, _ = leading_eigenvectors(g, 2, Scratch(spark, "test"))
    d = a.sum(1)
    want = np.linalg.eigvalsh(np.eye(20) - a / np.sqrt(np.outer(d, d)))[:2]
    assert np.allclose(-values, want, atol=1e-7)


def test_joint_recovers_blocks(spark):
    edges, a, truth = block_graph(spark)
    model = JointIndicatorClustering(3).fit_graph(edges)
    got = array(model.labels)
    assert len({(t, p) for t, p in zip(truth, got)}) == 3
    d = a.sum(1)
    h = np.eye(3)[got]
    m = a / np.sqrt(np.outer(d, d)) - np.eye(len(a)) + h @ h.T / len(a)
    assert model.inertia == pytest.approx(0.5 * np.linalg.eigvalsh(m)[-3:].sum(), abs=1e-7)


def test_embedding_signs_and_scaling(spark):
    edges, a, _ = block_graph(spark, (20, 15))
    x = array(spectral_embedding(edges, 2))
    root = np.sqrt(a.sum(1))
    assert np.allclose(np.linalg.norm(x * root[:, None], axis=0), 1)
    assert all(x[np.abs(x[:, j]).argmax(), j] > 0 for j in range(2))


def test_plans_stay_narrow(spark):
    table = VectorTable.load(E.planted_rows(spark, SF_DIR))
    plan = P.label_rows(table, P.View(np.eye(4), True), True)._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1].split("InMemoryRelation")[0]
    assert "Exchange" not in physical and "Cartesian" not in plan and "NestedLoop" not in plan


def test_residuals_fall_below_what_inner_products_lose(spark):
    """Blocks that start at nearly converged vectors stayed at residuals of 1e-7."""
    n = 400
    rng = np.random.default_rng(3)
    w = np.zeros((n, n))
    for step in (1, 2, 7, 31):
        i = np.arange(n)
        w[i, (i + step) % n] = w[(i + step) % n, i] = rng.uniform(0.5, 1.5, n)
    rows = [(int(a), int(b), float(w[a, b])) for a, b in zip(*np.nonzero(w), strict=True)]
    edges = spark.createDataFrame(rows, "src long, dst long, w double")
    g = NodeGraph.build(edges, True, Scratch(spark, "test"))
    x, got, error = leading_eigenvectors(g, 3, Scratch(spark, "test"), tol=1e-9, max_rounds=6)
    root = np.sqrt(w.sum(1))
    want, vectors = np.linalg.eigh(w / np.outer(root, root))
    assert error <= 1e-9
    np.testing.assert_allclose(got, want[::-1][:3] - 1.0, atol=1e-9)
    found = np.array([r["x"] for r in x.orderBy("id").collect()])
    top = vectors[:, ::-1][:, :3]
    np.testing.assert_allclose(found @ found.T, top @ top.T, atol=1e-7)


def test_products_shuffle_no_edges(spark):
    from orthant.operators.eigen import _next_block

    edges, _, _ = block_graph(spark, (12, 8))
    g = NodeGraph.build(edges, True, Scratch(spark, "test"))
    g.edges.count()
    block = F.array(F.lit(1.0), F.lit(2.0))
    state = g.nodes.select("id", "deg", "slots", block.alias("now"), block.alias("before"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        step = _next_block(g, state, True, 2)
        plan = step._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # the sorted edges come straight from the cache
    edge_side = plan.split("SortMergeJoin [src")[1].split("InMemoryTableScan [src")[0]
    assert "Exchange" not in edge_side


def test_copies_are_limited_before_the_shuffle(spark, vectors):
    from pyspark.sql import Window

    copies = Window.partitionBy("x").orderBy("id")
    heads = vectors(np.zeros((4, 2))).withColumn("rank", F.row_number().over(copies))
    plan = heads.where(F.col("rank") <= 6)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("form", ["packed", "joins"])
@pytest.mark.parametrize("normalized", [True, False])
def test_products_over_packed_groups_and_by_joins(spark, monkeypatch, normalized, form):
    """Graphs beyond one task: groups of chunks, with a node without links and repeated edges."""
    from orthant.operators import eigen

    monkeypatch.setattr(eigen, "TASK_NODES", 10)
    monkeypatch.setattr(eigen, "CHUNK_NODES", 3)
    if form == "joins":
        monkeypatch.setattr(eigen, "MOST_BLOCK_EDGES", 1)
    edges, a, truth = block_graph(spark, (20, 15, 10))
    edges, a = edges.unionByName(edges), np.pad(2 * a, (0, 1))
    lone = spark.createDataFrame([(45,)], "id long")
    d = a.sum(1)
    root = np.sqrt(np.where(d > 0, d, np.inf))
    lap = np.eye(46) - a / np.outer(root, root) if normalized else np.diag(d) - a
    h = np.eye(3)[[*np.minimum(truth, 1), 2]]
    label_rows = [(i, int(c)) for i, c in enumerate(h.argmax(1))]
    labels = spark.createDataFrame(label_rows, "id long, prediction int")
    scratch = Scratch(spark, "test")
    g = NodeGraph.build(edges, normalized, scratch, lone)
    assert (g.n, g.groups) == (46, 8 if form == "packed" else 0)
    x, got, _ = leading_eigenvectors(g, 3, scratch)
    assert x.count() == 46
    np.testing.assert_allclose(-got, np.linalg.eigvalsh(lap)[:3], atol=1e-7)
    x, got, _ = leading_eigenvectors(g, 3, scratch, labels=labels, rho=0.3, n_labels=3, start=x)
    values, vectors = np.linalg.eigh(-lap + 0.3 * h @ h.T)
    np.testing.assert_allclose(got, values[::-1][:3], atol=1e-7)
    x = np.array([r["x"] for r in x.orderBy("id").collect()])
    np.testing.assert_allclose(x @ x.T, vectors[:, -3:] @ vectors[:, -3:].T, atol=1e-5)
    with pytest.raises(RuntimeError, match="residual"):
        leading_eigenvectors(g, 3, scratch, tol=-1.0, max_rounds=1)
