"""One-pass reductions of a table of vectors to a small array of sums.

Every iterative method here keeps its n-sized state implicit: labels and scores are row-wise
functions of the stored vectors and of a small matrix. One iteration is then one narrow pass
over the table. Each task folds its Arrow batches into one partial array of sums; no row
leaves its partition.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Doubles that all partial sums together may send straight to the driver (32 MB). Beyond it
# the partial sums are added up by a shuffle on the position, and only the totals return.
DIRECT_DOUBLES = 4_000_000
# Doubles a single total may have: what the driver is ready to factorise.
MAX_TOTAL = 20_000_000


def to_numpy(column) -> np.ndarray:
    """An Arrow column as a vector, or as a matrix if it holds equally long lists."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        offsets = column.offsets.to_numpy()
        lengths = np.diff(offsets)
        if column.null_count or (len(lengths) and (lengths != lengths[0]).any()):
            raise ValueError("vectors are null or differ in length")
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.reshape(len(column), -1)
    return column.to_numpy(zero_copy_only=False)


def unit_rows(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    norm[norm == 0] = 1.0
    return x / norm[:, None]


def sum_pass(
    df: DataFrame, columns: list[str], kernel: Callable[..., np.ndarray], size: int, n_parts: int
) -> np.ndarray:
    """Sum ``kernel(*columns of a batch)``, an array of ``size`` doubles, over all batches."""
    sum_pass.calls += 1
    if size > MAX_TOTAL:
        raise ValueError(f"a total of {size} values is more than the driver takes ({MAX_TOTAL})")
    direct = n_parts * size <= DIRECT_DOUBLES

    def fold(batches):
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += kernel(*[to_numpy(c) for c in batch.columns])
        if direct:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["part"])
        else:
            pos = pa.array(np.arange(size, dtype=np.int32))
            yield pa.RecordBatch.from_arrays([pos, pa.array(total)], names=["pos", "part"])

    source = df.select(*columns)
    if direct:
        parts = source.mapInArrow(fold, "part binary").collect()
        return sum((np.frombuffer(r[0]) for r in parts), np.zeros(size))
    totals = (
        source.mapInArrow(fold, "pos int, part double")
        .groupBy("pos")
        .agg(F.sum("part").alias("total"))
        .collect()
    )
    out = np.zeros(size)
    for r in totals:
        out[r["pos"]] = r["total"]
    return out


#: Passes made by this process, for the bench.
sum_pass.calls = 0


def map_rows(df: DataFrame, columns: list[str], kernel, schema: str) -> DataFrame:
    """Lazy narrow map: ``kernel(*columns of a batch)`` returns the output columns."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                outs = []
                for value in kernel(*[to_numpy(c) for c in batch.columns]):
                    if isinstance(value, np.ndarray) and value.ndim == 2:
                        width = value.shape[1]
                        offsets = np.arange(0, value.size + 1, width, dtype=np.int64)
                        if value.size >= 2**31:
                            raise ValueError("a batch of vectors is too large; lower the batch size")
                        offsets = offsets.astype(np.int32)
                        value = pa.ListArray.from_arrays(
                            pa.array(offsets), pa.array(np.ascontiguousarray(value).ravel())
                        )
                    elif isinstance(value, np.ndarray):
                        value = pa.array(value)
                    outs.append(value)
                yield pa.RecordBatch.from_arrays(outs, names=[f"c{i}" for i in range(len(outs))])

    return df.select(*columns).mapInArrow(run, schema)


def polar_factor(c: np.ndarray) -> np.ndarray:
    """The matrix with orthonormal columns that is closest to c."""
    left, _, right = np.linalg.svd(c, full_matrices=False)
    return left @ right
