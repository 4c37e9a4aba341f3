import itertools
from collections import Counter
from math import comb, log

import numpy as np
import pytest

from orthant import accuracy, best_mapping, cluster_scores, contingency, label_changes, relabel
from orthant.operators.matching import max_weight_assignment

CASES = {
    "one cluster": [("a", 0), ("b", 0), ("b", 0)],
    "singletons": [("a", 0), ("b", 1), ("b", 2)],
    "more clusters": [("a", 0), ("a", 1), ("b", 2), ("b", 2)],
    "more classes": [("a", 0), ("b", 0), ("c", 1), ("c", 1)],
    "perfect": [("a", 1), ("a", 1), ("b", 0)],
    "one class one cluster": [("a", 3), ("a", 3)],
}


def by_hand(pairs):
    n = len(pairs)
    cells, classes, clusters = Counter(pairs), Counter(t for t, _ in pairs), Counter(p for _, p in pairs)
    ent = lambda c: -sum(v / n * log(v / n) for v in c.values())
    mi = sum(v / n * log(v * n / (classes[t] * clusters[p])) for (t, p), v in cells.items())
    hc, hk = ent(classes), ent(clusters)
    hom = mi / hc if len(classes) > 1 else 1.0
    com = mi / hk if len(clusters) > 1 else 1.0
    v = 2 * hom * com / (hom + com) if hom + com > 1e-12 else 0.0
    both = sum(comb(v, 2) for v in cells.values())
    a, b = (sum(comb(v, 2) for v in c.values()) for c in (classes, clusters))
    if both == a == b:
        ari = 1.0
    else:
        chance = a * b / comb(n, 2)
        ari = (both - chance) / ((a + b) / 2 - chance)
    if len(classes) == len(clusters) == 1:
        nmi = 1.0
    else:
        nmi = mi / ((hc + hk) / 2) if abs(mi) > 1e-12 else 0.0
    ts, ps = sorted(classes), sorted(clusters)
    size = max(len(ts), len(ps))
    best = max(
        sum(cells[(ts[q[j]], ps[j])] for j in range(len(ps)) if q[j] < len(ts))
        for q in itertools.permutations(range(size), len(ps))
    )
    top = sum(max(cells[(t, p)] for t in ts) for p in ps)
    return {
        "homogeneity": hom, "completeness": com, "v_measure": v, "nmi": nmi, "ari": ari,
        "accuracy": best / n, "purity": top / n,
    }


@pytest.mark.parametrize("case", CASES)
def test_scores_by_hand(spark, case):
    df = spark.createDataFrame(CASES[case], "truth string, prediction int")
    got = {r["metric"]: r["value"] for r in cluster_scores(df).collect()}
    assert got == pytest.approx(by_hand(CASES[case]), abs=1e-9)
    assert got["purity"] >= got["accuracy"] - 1e-12


def test_scores_ignore_label_names(spark):
    rng = np.random.default_rng(3)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 4, (300, 2))]
    renamed = [(a, (b * 7 + 3) % 11) for a, b in pairs]
    one, two = (
        {r[0]: r[1] for r in cluster_scores(spark.createDataFrame(p, "truth int, prediction int")).collect()}
        for p in (pairs, renamed)
    )
    assert one == pytest.approx(two)


def test_assignment_beats_all_permutations():
    rng = np.random.default_rng(0)
    for n in range(1, 6):
        for _ in range(20):
            w = rng.integers(0, 5, (n, n)).astype(float)
            got = max_weight_assignment(w)
            best = max(sum(w[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
            assert sorted(got) == list(range(n)) and w[np.arange(n), got].sum() == best


def test_left_over_cluster_maps_to_null(spark):
    df = spark.createDataFrame(CASES["more clusters"], "truth string, prediction int")
    mapping = best_mapping(contingency(df))
    assert sorted((r["mapped"] or "") for r in mapping.collect()) == ["", "a", "b"]
    assert relabel(df, mapping).count() == 4
    assert accuracy(df).first()[0] == 0.75


def test_label_changes(spark):
    a = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "id long, prediction int")
    b = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "id long, prediction int")
    assert label_changes(a, b).first()[0] == 1


def test_any_number_of_labels(spark):
    rows = spark.range(5_000).selectExpr("id as truth", "id * 7 % 5000 as prediction")
    got = {r["metric"]: r["value"] for r in cluster_scores(rows).collect()}
    assert len(got) == 7 and got["accuracy"] == 1.0 and got["purity"] == 1.0


@pytest.mark.parametrize("cells_on_driver", [100_000, 3])
def test_other_scores_stand_without_a_matching(spark, monkeypatch, cells_on_driver):
    from orthant.operators import matching as M

    rows = spark.range(400).selectExpr("id % 10 as truth", "id % 7 as prediction")
    whole = {r["metric"]: r["value"] for r in cluster_scores(rows).collect()}
    monkeypatch.setattr(M, "DRIVER_CELLS", cells_on_driver)
    monkeypatch.setattr(M, "DENSE_LABELS", 5)
    monkeypatch.setattr(M, "MAX_LABELS", 6)
    if cells_on_driver > 3:  # matched where the cells are, whatever the number of labels
        assert {r["metric"]: r["value"] for r in cluster_scores(rows).collect()} == whole
        return
    with pytest.warns(UserWarning, match="over 6 labels"):
        got = {r["metric"]: r["value"] for r in cluster_scores(rows).collect()}
    assert got.pop("accuracy") is None and whole.pop("accuracy") > 0
    assert got == whole


def test_parts_found_by_spark(spark, monkeypatch):
    from orthant.operators import matching as M

    rng = np.random.default_rng(4)
    rows = [(int(a), int(a // 3 * 3 + b)) for a, b in zip(rng.integers(0, 30, 900), rng.integers(0, 3, 900), strict=True)]
    rows += [(None, 99)] * 3 + [(50, None)]
    df = spark.createDataFrame(rows, "prediction long, truth long")
    here = {tuple(r) for r in best_mapping(contingency(df)).collect()}
    monkeypatch.setattr(M, "DRIVER_CELLS", 3)
    assert {tuple(r) for r in best_mapping(contingency(df)).collect()} == here
    assert (None, 99) in here and (50, None) in here


def agreed(cells, mapping):
    """Rows on which a one-to-one mapping agrees, from (cluster, class) counts."""
    used = [v for v in mapping.values() if v is not None]
    assert len(used) == len(set(used)) and set(mapping) == {c for c, _ in cells}
    return sum(cells.get(pair, 0) for pair in mapping.items())


@pytest.mark.parametrize("blocks", [1, 4])
@pytest.mark.parametrize("seed", range(3))
def test_auction_agrees_with_dense_assignment(seed, blocks):
    from orthant.operators.auction import auction, bidders_block

    rng = np.random.default_rng(seed)
    for _ in range(60):
        a, b = rng.integers(1, 9, 2)
        weight = rng.integers(0, 5, (a, b)) * (rng.random((a, b)) < 0.6)
        weight[np.arange(a), rng.integers(0, b, a)] += 1  # every label has a cell
        weight[rng.integers(0, a, b), np.arange(b)] += 1
        i, j = np.nonzero(weight)
        bidder, obj = np.concatenate([i, a + j]), np.concatenate([j, b + i])
        n = np.concatenate([weight[i, j]] * 2).astype(np.int64)
        parts = [bidder % blocks == k for k in range(blocks)]
        found = auction([bidders_block(bidder[p], obj[p], n[p], a, b) for p in parts if p.any()], a, b)
        taken = found[found >= 0]
        square = np.zeros((max(a, b),) * 2)
        square[:a, :b] = weight
        best = square[np.arange(len(square)), max_weight_assignment(square)].sum()
        assert len(set(taken)) == len(taken)
        assert weight[np.flatnonzero(found >= 0), taken].sum() == best


def test_auction_in_spark_blocks(spark, monkeypatch):
    from orthant.operators import auction as A
    from orthant.operators import matching as M

    rng = np.random.default_rng(7)
    rows = [(int(a), int(b)) for a, b in zip(rng.integers(0, 14, 200), rng.integers(0, 13, 200))]
    rows += [(None, 7)] * 40 + [(3, None)] * 2
    df = spark.createDataFrame(rows, "prediction long, truth long")
    counts = Counter(rows)
    best = agreed(counts, {r[0]: r[1] for r in best_mapping(contingency(df)).collect()})
    monkeypatch.setattr(M, "DRIVER_CELLS", 3)
    monkeypatch.setattr(M, "DENSE_LABELS", 10)
    monkeypatch.setattr(A, "BLOCK_CELLS", 100)
    got = {r[0]: r[1] for r in best_mapping(contingency(df)).collect()}
    assert agreed(counts, got) == best and got[None] == 7


def test_twenty_thousand_linked_labels(spark):
    n = 20_000
    # a ring: each class has two rows in its own cluster and one in the next
    rows = spark.range(3 * n).selectExpr(
        f"id % {n} as truth", f"(id + if(id < {n}, 1, 0)) % {n} as prediction"
    )
    got = {r["metric"]: r["value"] for r in cluster_scores(rows).collect()}
    assert len(got) == 7 and got["accuracy"] == pytest.approx(2 / 3)


@pytest.mark.parametrize("dense", [300, 1])
def test_no_cells_and_single_cells(spark, monkeypatch, dense):
    from orthant.operators import matching as M

    monkeypatch.setattr(M, "DENSE_LABELS", dense)
    monkeypatch.setattr(M, "DRIVER_CELLS", 0)
    empty = spark.createDataFrame([], "prediction long, truth long")
    assert best_mapping(contingency(empty)).count() == 0
    one = spark.createDataFrame([(1, 2), (1, 3), (1, 3)], "prediction long, truth long")
    assert [tuple(r) for r in best_mapping(contingency(one)).collect()] == [(1, 3)]
