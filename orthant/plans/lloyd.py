"""Lloyd's k-means from given centres, one pass per iteration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from orthant.plans.model import ClusterModel, History
from orthant.sources.vectors import VectorTable


def squared_distances(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    """Per row and centre, by the difference itself: no digits are lost far from the origin."""
    out = np.empty((len(x), len(centers)))
    for j, c in enumerate(centers):
        diff = x - c
        out[:, j] = np.einsum("ij,ij->i", diff, diff)
    return out


def lloyd_pass(table: VectorTable, centers: np.ndarray, earlier: np.ndarray | None):
    """Sums and counts per nearest centre, total squared distance, label changes."""
    k, d = centers.shape

    def kernel(x):
        dist = squared_distances(x, centers)
        label = dist.argmin(axis=1)
        hot = np.zeros((len(x), k))
        hot[np.arange(len(x)), label] = 1.0
        changed = len(x)
        if earlier is not None:
            changed = np.count_nonzero(label != squared_distances(x, earlier).argmin(axis=1))
        tail = [dist.min(axis=1).sum(), changed]
        return np.concatenate([(hot.T @ x).ravel(), hot.sum(axis=0), tail])

    flat = table.sums(kernel, k * d + k + 2)
    return flat[: k * d].reshape(k, d), flat[k * d : -2], flat[-2], flat[-1]


def furthest_rows(table: VectorTable, centers: np.ndarray, m: int):
    """The m rows furthest from their centre (m <= k): label and vector, ties by id."""

    def kernel(ids, x):
        dist = squared_distances(x, centers)
        return ids, dist.argmin(axis=1).astype(np.int32), dist.min(axis=1)

    far = (
        table.map(kernel, "id long, label int, d2 double").orderBy(F.desc("d2"), "id").limit(m)
    )
    found = {r["id"]: r for r in far.collect()}
    rows = table.df.where(F.col("id").isin(list(found))).select("id", table.column).collect()
    vectors = {r["id"]: np.array(r[1]) for r in rows}
    return [(r["label"], vectors[i]) for i, r in found.items()]


def next_centers(table: VectorTable, centers: np.ndarray, total: np.ndarray, count: np.ndarray):
    """Means of the assigned rows; an empty centre moves to a row furthest from its own."""
    total, count = total.copy(), count.copy()
    empty = np.flatnonzero(count == 0)
    if len(empty):
        for target, (label, x) in zip(empty, furthest_rows(table, centers, len(empty))):
            total[label] -= x
            count[label] -= 1
            total[target], count[target] = x, 1
    means = total / np.where(count > 0, count, 1)[:, None]
    means[count <= 0] = centers[count <= 0]
    return means


def mean_variance(table: VectorTable) -> float:
    d = table.d
    mean = table.sums(lambda x: x.sum(axis=0), d) / table.n
    return float(table.sums(lambda x: ((x - mean) ** 2).sum(axis=0), d).mean() / table.n)


def nearest_labels(table: VectorTable, centers: np.ndarray, with_vectors: bool = False):
    """Lazy ``(id, prediction, d2)``, or ``(id, x, prediction)`` with the vectors kept."""

    def kernel(ids, x):
        dist = squared_distances(x, centers)
        label = dist.argmin(axis=1).astype(np.int32)
        return (ids, x, label) if with_vectors else (ids, label, dist.min(axis=1))

    if with_vectors:
        return table.map(kernel, "id long, x array<double>, prediction int")
    return table.map(kernel, "id long, prediction int, d2 double")


def lloyd(
    table: VectorTable, centers: np.ndarray, max_iter: int = 300, tol: float = 1e-4
) -> ClusterModel:
    """k-means from ``centers``; stops when no label changes or the centres hardly move.

    ``tol`` is relative to the mean variance of the features.
    """
    limit = tol * mean_variance(table) if tol > 0 else 0.0
    centers = np.asarray(centers, dtype=float)
    earlier: np.ndarray | None = None
    trace, reason, steps = History(), "max_iter", 0
    for steps in range(1, max_iter + 1):
        total, count, inertia, changed = lloyd_pass(table, centers, earlier)
        trace.add(steps, "lloyd", inertia=inertia, changed=changed)
        moved = next_centers(table, centers, total, count)
        shift = float(((moved - centers) ** 2).sum())
        earlier, centers = centers, moved
        if changed == 0:
            reason = "labels"
            break
        if shift <= limit:
            reason = "shift"
            break
    inertia = float(lloyd_pass(table, centers, None)[2])
    trace.add(steps, "lloyd", final_inertia=inertia)
    return ClusterModel(
        spark=table.df.sparkSession,
        labels=nearest_labels(table, centers).select("id", "prediction"),
        centers_matrix=centers,
        inertia=inertia,
        n_iter=steps,
        stop_reason=reason,
        trace=trace,
    )
