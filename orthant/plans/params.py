"""Parameter grammars and their checks."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame


def check_positive(**values) -> None:
    for name, value in values.items():
        if not value > 0:
            raise ValueError(f"{name} must be positive, got {value}")


def parse_init(init, d: int, k: int) -> np.ndarray | None:
    """The start matrix for 'eye', an array or an ``(i, j, value)`` table; None for 'random'."""
    if isinstance(init, str):
        if init == "eye":
            return np.eye(d, k)
        if init == "random":
            return None
    elif isinstance(init, DataFrame):
        cells = init.select("i", "j", "value").limit(d * k + 1).collect()
        if len(cells) != d * k or any(not (0 <= r[0] < d and 0 <= r[1] < k) for r in cells):
            raise ValueError(f"init must hold the {d} x {k} entries of a matrix")
        out = np.zeros((d, k))
        for i, j, v in cells:
            out[i, j] = v
        return out
    elif hasattr(init, "__array__") or isinstance(init, (list, tuple)):
        out = np.asarray(init, dtype=float)
        if out.shape != (d, k):
            raise ValueError(f"init must be {d} x {k}, got {out.shape}")
        return out
    raise ValueError(f"init must be 'eye', 'random', a matrix or a table, got {init!r}")


@dataclass(frozen=True)
class Threshold:
    """How the robust estimator picks its threshold: kind and amount."""

    kind: str  # 'fixed', 'percent', 'furthest' or 'adaptive'
    amount: float = 0.0

    def rank(self, n: int) -> int:
        """How many of the largest norms are to stay above the threshold."""
        if self.kind == "percent":
            return int(self.amount * n)
        if self.kind == "adaptive":
            return int(0.1 * n)
        return int(self.amount)


def parse_threshold(mu, n: int) -> Threshold:
    """A number >= 0, 'NN%', 'furthest NN' or 'adaptive' (words in any case)."""
    if isinstance(mu, (int, float)) and not isinstance(mu, bool):
        if not mu >= 0:
            raise ValueError(f"mu must not be negative, got {mu}")
        return Threshold("fixed", float(mu))
    if not isinstance(mu, str):
        raise ValueError(f"unknown kind of mu: {mu!r}")
    word = mu.lower()
    if word == "adaptive":
        return Threshold("adaptive")
    percent, mark = mu[:-1], mu[-1:]
    if mark == "%" and percent.isnumeric() and float(percent) <= 100:
        return Threshold("percent", float(percent) / 100)
    count = mu[len("furthest") + 1 :]
    if word.startswith("furthest") and count.isnumeric() and int(count) <= n:
        return Threshold("furthest", int(count))
    raise ValueError(f"mu must be a number, 'NN%', 'furthest NN' or 'adaptive', got {mu!r}")


SOLVERS = ("SD", "CG", "TR", "NM")


def check_solver(name: str) -> str:
    if name not in SOLVERS:
        raise ValueError(f"solver must be one of {', '.join(SOLVERS)}, got {name!r}")
    return name


def parse_inner(do_inner) -> bool:
    """A bool, an int or 'relu'. The soft-max cost has no definition to run, so it is refused."""
    if isinstance(do_inner, (bool, int)):
        return bool(do_inner)
    if do_inner == "relu":
        return True
    raise ValueError(f"do_inner must be a bool or 'relu', got {do_inner!r}")


def check_h_values(h_values: str) -> str:
    if h_values not in ("max", "one"):
        raise ValueError(f"h_values must be 'max' or 'one', got {h_values!r}")
    return h_values
