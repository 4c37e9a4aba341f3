"""The pass that turns a rotation into labels, and the sums that go with it.

A *view* is what a labelling depends on: a small matrix and whether negative scores are cut
off. Labels, indicator values and label changes all follow from views row by row, so moving
back to an earlier state restores a view and copies no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from orthant.operators.passes import unit_rows
from orthant.sources.vectors import VectorTable

# Largest vector length for which X'X is kept on the driver to get residuals for free.
GRAM_LIMIT = 2_000


@dataclass(frozen=True)
class View:
    z: np.ndarray
    cut: bool
    values: str = "max"
    unit_columns: bool = False


def scorer(view: View, normalize: bool):
    z, cut = view.z, view.cut

    def score(x):
        if normalize:
            x = unit_rows(x)
        s = x @ z
        return x, np.maximum(s, 0.0) if cut else s

    return score


def assign(scores: np.ndarray, values: str):
    label = scores.argmax(axis=1)
    if values == "max":
        return label, scores[np.arange(len(label)), label]
    return label, np.ones(len(label))


@dataclass
class Sums:
    """Totals of one pass under a view."""

    cross: np.ndarray  # X' N
    n_square: float  # |N|^2
    by_label: np.ndarray  # X' H before column scaling
    h_square: np.ndarray  # squared column norms of H before scaling
    changed: float  # rows labelled differently under the earlier view


def view_pass(table: VectorTable, view: View, normalize: bool, earlier: View | None) -> Sums:
    d, k = view.z.shape
    score = scorer(view, normalize)
    score_earlier = scorer(earlier, False) if earlier is not None else None
    values = view.values

    def kernel(x):
        x, s = score(x)
        label, h = assign(s, values)
        hot = np.zeros_like(s)
        hot[np.arange(len(label)), label] = h
        changed = len(label)
        if score_earlier is not None:
            changed = np.count_nonzero(label != score_earlier(x)[1].argmax(axis=1))
        return np.concatenate(
            [
                (x.T @ s).ravel(),
                [np.vdot(s, s)],
                (x.T @ hot).ravel(),
                np.einsum("ij,ij->j", hot, hot),
                [changed],
            ]
        )

    flat = table.sums(kernel, 2 * d * k + k + 2)
    cross, rest = flat[: d * k].reshape(d, k), flat[d * k :]
    by_label = rest[1 : 1 + d * k].reshape(d, k)
    return Sums(cross, rest[0], by_label, rest[1 + d * k : -1], rest[-1])


def direct_residual(
    table: VectorTable,
    view: View,
    target: np.ndarray,
    normalize: bool,
    column_scale: np.ndarray | None,
) -> float:
    """|X target - N| or, with a column scale, |X target - H|, by summing the squares."""
    score = scorer(view, normalize)
    values = view.values

    def kernel(x):
        x, s = score(x)
        if column_scale is not None:
            label, h = assign(s, values)
            s = np.zeros_like(s)
            s[np.arange(len(label)), label] = h * column_scale[label]
        diff = x @ target - s
        return np.array([np.vdot(diff, diff)])

    return float(np.sqrt(table.sums(kernel, 1)[0]))


class Residuals:
    """|X Z - M| from small matrices: tr(Z'GZ) + |M|^2 - 2 tr(Z'X'M) with G = X'X.

    Where that difference has lost its digits, or G is too large to keep, the squares are
    summed in a pass of their own.
    """

    def __init__(self, table: VectorTable, normalize: bool, gram: np.ndarray | None = None):
        self.table, self.normalize = table, normalize
        if gram is None and table.d <= GRAM_LIMIT:
            gram = table.gram(normalize)
        self.gram = gram

    def __call__(
        self, view: View, target, x_m, m_square, column_scale: np.ndarray | None = None
    ) -> float:
        if self.gram is not None:
            square = np.vdot(target, self.gram @ target) + m_square - 2 * np.vdot(target, x_m)
            if square > 1e-12 * max(m_square, 1e-300):
                return float(np.sqrt(square))
        return direct_residual(self.table, view, target, self.normalize, column_scale)


def label_rows(table: VectorTable, view: View, normalize: bool):
    """Lazy ``(id, prediction, h)`` under a view; h is before column scaling."""
    score = scorer(view, normalize)
    values = view.values

    def kernel(ids, x):
        label, h = assign(score(x)[1], values)
        return ids, label.astype(np.int32), h

    return table.map(kernel, "id long, prediction int, h double")


def center_pass(table: VectorTable, view: View, normalize: bool) -> tuple[np.ndarray, np.ndarray]:
    """Mean of the (normalised) rows of each label whose indicator value is not zero.

    A label without rows gets a zero centre. Also returns the number of rows used.
    """
    d, k = view.z.shape
    score = scorer(view, normalize)
    values = view.values

    def kernel(x):
        x, s = score(x)
        label, h = assign(s, values)
        hot = np.zeros_like(s)
        hot[np.arange(len(label)), label] = h != 0
        return np.concatenate([(hot.T @ x).ravel(), hot.sum(axis=0)])

    flat = table.sums(kernel, d * k + k)
    count = flat[d * k :]
    return flat[: d * k].reshape(k, d) / np.maximum(count, 1)[:, None], count
