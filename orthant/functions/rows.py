"""Row-wise vector functions. Each takes and returns a Column; none of them shuffles."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    A column used inside a lambda is evaluated again for every element; binding it through
    a one-element array keeps row functions linear in the vector length.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def as_double_vector(x: Column) -> Column:
    return x.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def squared_norm(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v)


def row_norm(x: Column) -> Column:
    return F.sqrt(squared_norm(x))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v
    )


def unit_row(x: Column) -> Column:
    """x / |x|; a zero row stays zero."""
    return bind(
        row_norm(x), lambda n: F.when(n == 0, x).otherwise(F.transform(x, lambda v: v / n))
    )


def first_coordinates(x: Column, k: int) -> Column:
    return F.slice(x, 1, k)


def rotate(x: Column, z: np.ndarray) -> Column:
    """The row x times the small matrix z, as an array with one entry per column of z."""
    columns = F.lit([[float(v) for v in col] for col in np.asarray(z, dtype=float).T])
    return F.transform(columns, lambda c: dot(x, c))


def nonnegative(u: Column) -> Column:
    return F.transform(u, lambda v: F.greatest(v, F.lit(0.0)))


def nonpositive_cost(u: Column) -> Column:
    """Half the squared length of the negative part of a row."""
    return F.aggregate(
        F.transform(u, lambda v: F.least(v, F.lit(0.0))),
        F.lit(0.0),
        lambda s, v: s + v * v,
        lambda s: s * 0.5,
    )


def row_max(n: Column) -> Column:
    return F.array_max(n)


def row_argmax(n: Column) -> Column:
    """0-based position of the largest entry; the first one wins a tie."""
    return (F.array_position(n, F.array_max(n)) - 1).cast("int")


def indicator(n: Column, values: str = "max") -> Column:
    """Nearest one-entry row: a struct of the entry's position and its value."""
    if values not in ("max", "one"):
        raise ValueError(f"values must be 'max' or 'one', got {values!r}")
    h = row_max(n) if values == "max" else F.lit(1.0)
    return F.struct(row_argmax(n).alias("prediction"), h.alias("h"))


def one_hot(label: Column, k: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: (j == label).cast("int"))


def shrink_row(t: Column, threshold: float | Column) -> Column:
    """Row-group soft threshold: shorten t by ``threshold``, or return zero if it is shorter."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return bind(
        row_norm(t),
        lambda n: F.when(n <= limit, F.transform(t, lambda v: F.lit(0.0))).otherwise(
            F.transform(t, lambda v: v * (F.lit(1.0) - limit / n))
        ),
    )


def has_nonzero(v: Column) -> Column:
    return F.exists(v, lambda e: e != 0)


def nearest_center(x: Column, centers: np.ndarray) -> Column:
    """Struct of the nearest centre's position and its squared distance."""
    table = F.lit([[float(v) for v in c] for c in np.asarray(centers, dtype=float)])
    return bind(
        F.transform(table, lambda c: squared_distance(x, c)),
        lambda d: F.struct(
            (F.array_position(d, F.array_min(d)) - 1).cast("int").alias("prediction"),
            F.array_min(d).alias("d2"),
        ),
    )


def seeded_label(id_col: Column, k: int, seed: int) -> Column:
    """A uniform label that depends on the id and seed only, never on the partitioning."""
    return F.pmod(F.xxhash64(id_col, F.lit(seed)), F.lit(k)).cast("int")
