"""Work that has to spread over tasks, or stay within a bound, as tables grow."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from orthant.operators import knn as K
from orthant.operators import matching as M
from orthant.plans import agglomerate as A


def test_links_of_a_small_file_are_tried_in_many_tasks(spark, tmp_path):
    n = 300
    rows = [(i, i * 7 % 25) for i in range(n)]
    customers = spark.createDataFrame(rows, "c_custkey long, c_nationkey int").coalesce(1)
    customers.write.parquet(f"{tmp_path}/customer.parquet")
    edges = entry.planted_edges(spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    group = [0 if g <= 3 else 1 if g <= 6 else 2 for g in (v % 9 for _, v in rows)]
    want = [(i, (i + 1) % n, 0.01) for i in range(0, n, 50)]
    for i in range(n):
        ends = [(i * (7919 * t + 1) + 104729 * t) % n for t in range(1, entry.LINKS + 1)]
        want += [(i, j, 1.0) for j in ends if j != i and group[i] == group[j]]
    assert sorted((r["src"], r["dst"], r["w"]) for r in edges) == sorted(want)
    assert len({r["task"] for r in edges}) >= 8


def one_block(x):
    """A block as it is packed, and its rows as queries without bounds."""
    y = K.sketches(x, *K.leading_directions(x[:512]))
    order = K.tile_order(y) if hasattr(K, "tile_order") else np.arange(len(x))
    ids, x, y, size = order, x[order], y[order], np.ones(len(x))
    return (ids, x, size, np.full(len(x), np.inf), y), (ids, x, size, y)


def test_rows_of_a_block_meet_only_near_ones(monkeypatch):
    t = np.random.default_rng(5).random(6000)
    x = np.c_[np.cos(6 * t), np.sin(6 * t), t]
    met, weigh = [0], K.pair_weight

    def counted(a, b):
        out = weigh(a, b)
        met[0] += np.size(out)
        return out

    monkeypatch.setattr(K, "pair_weight", counted)
    src, dst, _ = K.block_neighbors(*one_block(x), 3)
    d2 = K.exact_square_distance(np.repeat(x[::97], len(x), axis=0), np.tile(x, (len(x[::97]), 1))).reshape(-1, len(x))
    for i, row in zip(range(0, len(x), 97), d2):
        want = [j for j in np.lexsort((np.arange(len(x)), row)) if j != i][:3]
        assert sorted(dst[src == i]) == sorted(want)
    assert met[0] < 0.3 * len(x) ** 2


def test_memory_of_a_search_is_bounded():
    x = np.random.default_rng(6).normal(size=(20_000, 24))
    query, block = one_block(x)
    tracemalloc.start()
    K.block_neighbors(tuple(v[:1024] for v in query), block, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6


def linked(rng):
    """A hub with many classes, trees, cycles and null labels."""
    cells = {(-1, i): int(rng.integers(1, 5)) for i in range(40)}
    cells |= {(i, i): int(rng.integers(1, 5)) for i in range(40) if i % 3}
    cells |= {(100 + i, 100 + (i + s) % 9): int(rng.integers(1, 9)) for i in range(9) for s in (0, 1)}
    cells |= {(100 + i, 120 + i): int(rng.integers(1, 9)) for i in range(9)}
    cells |= {(200 + i // 3, 200 + i): int(rng.integers(1, 6)) for i in range(20)}
    cells |= {(230 + i, 200 + i): 3 for i in range(0, 20, 2)} | {(None, 5): 2, (240, None): 4, (None, None): 1}
    return [(a, b, n) for (a, b), n in cells.items()]


@pytest.mark.parametrize("seed, dense", [(0, 2), (1, 300)])
def test_labels_with_one_cell_count_against_no_limit(spark, monkeypatch, seed, dense):
    rows = linked(np.random.default_rng(seed))
    weight = {(a, b): n for a, b, n in rows}
    best = sum(weight.get(pair, 0) for part in M.split_parts(rows) for pair in M.match_part(part))
    monkeypatch.setattr(M, "DRIVER_CELLS", 5)
    monkeypatch.setattr(M, "DENSE_LABELS", dense)
    monkeypatch.setattr(M, "STEM_CELLS", 10)
    monkeypatch.setattr(M, "MAX_LABELS", 60)
    cells = spark.createDataFrame(rows, "cluster long, class long, n long")
    got = [tuple(r) for r in M.best_mapping(cells).collect()]
    used = [b for a, b in got if (a, b) in weight]
    assert sorted({a for a, _, _ in rows}, key=str) == sorted((a for a, _ in got), key=str)
    assert len(used) == len(set(used)) and sum(weight.get(pair, 0) for pair in got) == best


def one_at_a_time(x, k):
    parts = [[i] for i in range(len(x))]
    while len(parts) > k:
        centres, sizes = np.array([x[p].mean(axis=0) for p in parts]), np.array([float(len(p)) for p in parts])
        scores = A.ward_scores(centres, sizes, centres, sizes)
        np.fill_diagonal(scores, np.inf)
        i, j = sorted(divmod(int(scores.argmin()), len(parts)))
        parts[i] += parts.pop(j)
    return {frozenset(p) for p in parts}


@pytest.mark.parametrize("d", [1, 2, 4])
def test_merges_within_cells_are_those_of_ward(monkeypatch, d):
    monkeypatch.setattr(A, "PAIR_ROWS", 60)
    x = np.random.default_rng(d).random((200, d)) ** 2
    log, ids = [], np.arange(len(x))
    state = ids, x, np.ones(len(x)), np.full((len(x), 1), np.inf), np.zeros(len(x), dtype=np.int64)
    state = A.merge_cell(*state, 1.0, log)
    inside = sum(len(row[0]) for row in log)
    assert 20 <= inside < len(x)
    A.merge_near(*state, log)
    keep, gone, height, step = (np.concatenate(v) for v in zip(*log))
    assert len(gone) == len(set(gone)) == len(x) - 1
    for k in (2, 7, 40):
        label = ids.copy()
        for m in np.lexsort((gone, step, height))[: len(x) - k]:
            label[label == label[gone[m]]] = label[keep[m]]
        assert {frozenset(np.flatnonzero(label == v).tolist()) for v in set(label)} == one_at_a_time(x, k)
