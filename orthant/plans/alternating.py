"""Alternating projections and spectral rotation."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthant.functions import rows as R
from orthant.operators.passes import polar_factor, sum_pass, unit_rows
from orthant.plans.lloyd import lloyd
from orthant.plans.model import ClusterModel, History
from orthant.plans.params import check_h_values, check_positive, parse_init
from orthant.plans.rounding import Residuals, View, center_pass, label_rows, view_pass
from orthant.sources.vectors import VectorTable, check_cluster_count, warn_if_not_square

TINY = 1e-12


def random_rotation(table: VectorTable, k: int, normalize: bool, seed: int) -> np.ndarray:
    """Polar factor of X'H for seeded uniform labels: one pass."""
    d = table.d

    def kernel(x, label):
        x = unit_rows(x) if normalize else x
        hot = np.zeros((len(label), k))
        hot[np.arange(len(label)), label] = 1.0
        return (x.T @ hot).ravel()

    labelled = table.df.select(table.column, R.seeded_label(F.col("id"), k, seed).alias("label"))
    total = sum_pass(labelled, [table.column, "label"], kernel, d * k, table.n_parts)
    return polar_factor(total.reshape(d, k))


def settled(now: float, before: float, tol: float) -> dict[str, bool]:
    """Which of the residual's stop tests hold."""
    known = np.isfinite(before)
    return {
        "zero": now < TINY,
        "flat": bool(known and abs(now - before) < before * tol),
        "up": now > before,
    }


@dataclass
class State:
    """An outer step's outcome: what its labels depend on and how good it was."""

    view: View
    z: np.ndarray
    residual: float


@dataclass
class Loop:
    """Options shared by the alternating and the manifold estimators."""

    tol_out: float
    max_iter_out: int
    do_inner: bool
    post_rotation: bool
    normalize_rows: bool
    normalize_columns: bool
    h_values: str


@dataclass
class Outcome:
    state: State
    n_iter: int
    stop_reason: str
    trace: History


def outer_loop(table: VectorTable, k: int, z0: np.ndarray, loop: Loop, inner, residuals) -> Outcome:
    """Outer iterations shared by both inner solvers.

    ``inner(z, earlier_view, values, step, trace)`` returns the matrix whose cut scores are to
    be rounded and the sums of the pass over it.
    """
    norm = loop.normalize_rows
    trace = History()
    do_inner, values = loop.do_inner, loop.h_values
    state: State | None = None
    z, before, reason = z0, float("inf"), "max_iter"
    steps = 0
    for step in range(1, loop.max_iter_out + 1):
        steps = step
        earlier = state
        seen = earlier.view if earlier else None
        if do_inner:
            z_view, sums = inner(z, seen, values, step, trace)
            view = View(z_view, True, values, loop.normalize_columns)
        else:
            view = View(z, False, values, loop.normalize_columns)
            sums = view_pass(table, view, norm, seen)
        x_h, h_square, scale = sums.by_label, float(sums.h_square.sum()), np.ones(k)
        if loop.normalize_columns:
            length = np.sqrt(sums.h_square)
            scale = 1.0 / np.where(length > 0, length, 1.0)
            x_h, h_square = x_h * scale, float(np.count_nonzero(length))
        z = polar_factor(x_h)
        now = residuals(view, z, x_h, h_square, scale)
        state = State(view, z, now)
        trace.add(step, "inner" if do_inner else "rotation", residual=now, changed=sums.changed)
        tests = settled(now, before, loop.tol_out)
        tests["labels"] = earlier is not None and sums.changed == 0
        before_now, before = before, now
        if any(tests.values()):
            if loop.post_rotation and do_inner:
                do_inner, values = False, "max"
                continue
            if tests["up"] and not tests["flat"]:
                state = earlier
                trace.add(step, "rollback", residual=before_now)
            reason = next(name for name, hit in tests.items() if hit)
            break
    return Outcome(state, steps, reason, trace)


def project_to_orthant(table: VectorTable, loop: Loop, tol: float, max_iter: int, residuals):
    """Inner solver: cut the negative scores, project back, until the gap settles."""

    def inner(z, earlier, values, step, trace):
        before = float("inf")
        used, sums = z, None
        for it in range(1, max_iter + 1):
            view = View(z, True, values, loop.normalize_columns)
            sums = view_pass(table, view, loop.normalize_rows, earlier)
            used, z = z, polar_factor(sums.cross)
            now = residuals(view, z, sums.cross, sums.n_square)
            trace.add(step, f"pass {it}", gap=now)
            tests, before = settled(now, before, tol), now
            if any(tests.values()):
                break
        return used, sums

    return inner


def finish(table: VectorTable, outcome: Outcome, normalize: bool) -> ClusterModel:
    state = outcome.state
    centers, _ = center_pass(table, state.view, normalize)
    labels = label_rows(table, state.view, normalize).select("id", "prediction")
    return ClusterModel(
        spark=table.df.sparkSession,
        labels=labels,
        centers_matrix=centers,
        rotation_matrix=state.z,
        residual=state.residual,
        inertia=state.residual,
        n_iter=outcome.n_iter,
        stop_reason=outcome.stop_reason,
        trace=outcome.trace,
    )


def refine_model(table: VectorTable, model: ClusterModel) -> ClusterModel:
    """Lloyd iterations on the rows as given, from the centres of the (normalised) rows."""
    refined = lloyd(table, model.centers_matrix)
    trace = History()
    trace.rows = model.trace.rows + refined.trace.rows
    return replace(
        model,
        labels=refined.labels,
        centers_matrix=refined.centers_matrix,
        inertia=refined.inertia,
        trace=trace,
    )


@dataclass
class IndicatorClustering:
    """Find a rotation of the vectors that brings every row close to one coordinate axis.

    ``h_values='max'`` keeps a row's largest score as its indicator value and ``'one'`` uses 1.
    With ``do_inner=False`` only the rotation steps run (spectral rotation).
    """

    n_clusters: int
    init: object = "eye"
    tol_in: float = 1e-3
    tol_out: float = 1e-5
    max_iter_in: int = 200
    max_iter_out: int = 50
    do_inner: bool = True
    post_rotation: bool = True
    normalize_rows: bool = True
    normalize_columns: bool = False
    h_values: str = "max"
    seed: int = 0

    def loop(self) -> Loop:
        return Loop(
            self.tol_out,
            self.max_iter_out,
            self.do_inner,
            self.post_rotation,
            self.normalize_rows,
            self.normalize_columns,
            self.h_values,
        )

    def solve(self, table: VectorTable, gram: np.ndarray | None = None) -> Outcome:
        check_positive(
            max_iter_out=self.max_iter_out,
            max_iter_in=self.max_iter_in,
            tol_out=self.tol_out,
            tol_in=self.tol_in,
        )
        check_h_values(self.h_values)
        k = check_cluster_count(self.n_clusters, table.n, table.d)
        warn_if_not_square(table.d, k)
        z0 = parse_init(self.init, table.d, k)
        if z0 is None:
            z0 = random_rotation(table, k, self.normalize_rows, self.seed)
        residuals = Residuals(table, self.normalize_rows, gram)
        loop = self.loop()
        inner = project_to_orthant(table, loop, self.tol_in, self.max_iter_in, residuals)
        return outer_loop(table, k, z0, loop, inner, residuals)

    def fit_table(self, table: VectorTable, refine: bool = False) -> ClusterModel:
        model = finish(table, self.solve(table), self.normalize_rows)
        return refine_model(table, model) if refine else model

    def fit(
        self, df: DataFrame, id_col: str = "id", features_col: str = "x", refine: bool = False
    ) -> ClusterModel:
        """Fit; ``refine=True`` adds Lloyd iterations."""
        return self.fit_table(VectorTable.load(df, id_col, features_col), refine)

    def fit_predict(self, df: DataFrame, refine: bool = False, **columns) -> DataFrame:
        return self.fit(df, refine=refine, **columns).labels
