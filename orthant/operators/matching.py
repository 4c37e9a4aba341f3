"""Matching clusters to classes.

Labels with a single cell are taken out first, in rounds of Spark aggregates: such a cell is worth
its count to the label at its other end, whose other cells lose that much, and are dropped if they
are worth no more. The heaviest such cell is taken in the end unless its other end finds better.

A matching of largest weight can be found in each connected part of what is left on its own. Spark
finds the parts. Small parts, one task each, run a dense assignment. The cells of
large parts go to an auction (operators/auction.py), which works on sparse blocks of bounded size
and keeps one price a label on the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orthant.operators.auction import auction, auction_by_blocks, local_block
from orthant.session import Scratch

# Non-zero (cluster, class) counts up to which the driver finds the parts itself.
DRIVER_CELLS = 100_000
# Labels a side of one connected part up to which the assignment is dense; it is cubic in them.
DENSE_LABELS = 300
# Cells of small parts that a task takes at once.
TASK_CELLS = 50_000
# Cells of a label beyond which its other cells are changed by broadcast.
STEM_CELLS = 500_000
# Labels of large parts, both sides together, for which the driver keeps a price each.
MAX_LABELS = 4_000_000


def max_weight_assignment(weight: np.ndarray) -> np.ndarray:
    """Column of each row in a one-to-one assignment of largest total weight (square input).

    Rows are added one at a time; each finds the cheapest augmenting path under the dual
    prices so far.
    """
    cost = weight.max(initial=0.0) - weight
    n = len(cost)
    row_price, col_price = np.zeros(n), np.zeros(n)
    owner = np.full(n, -1)
    for start in range(n):
        reach = np.full(n, np.inf)
        via = np.full(n, -1)
        done = np.zeros(n, dtype=bool)
        row, base, last = start, 0.0, -1
        while True:
            slack = base + cost[row] - row_price[row] - col_price
            better = ~done & (slack < reach)
            reach[better] = slack[better]
            via[better] = last
            nearest = int(np.where(done, np.inf, reach).argmin())
            base = reach[nearest]
            done[nearest] = True
            last = nearest
            if owner[nearest] < 0:
                break
            row = owner[nearest]
        row_price[start] += base
        for col in np.flatnonzero(done):
            if owner[col] >= 0:
                row_price[owner[col]] += base - reach[col]
            col_price[col] -= base - reach[col]
        while last >= 0:
            before = via[last]
            owner[last] = owner[before] if before >= 0 else start
            last = before
    out = np.empty(n, dtype=int)
    out[owner] = np.arange(n)
    return out


def match_matrix(rows, clusters: list, classes: list) -> np.ndarray:
    """Counts, classes in the rows and clusters in the columns, padded square with zeros."""
    side = max(len(clusters), len(classes))
    at_cluster = {v: i for i, v in enumerate(clusters)}
    at_class = {v: i for i, v in enumerate(classes)}
    out = np.zeros((side, side))
    for cluster, label, n in rows:
        out[at_class[label], at_cluster[cluster]] += n
    return out


def _ordered(values) -> list:
    return sorted(values, key=lambda v: (v is None, v))


class LargePart(ValueError):
    """The label table has too many linked labels to be matched."""

    def __init__(self):
        super().__init__(f"large connected parts of the label table have over {MAX_LABELS} labels")


def match_part(rows: list[tuple]) -> list[tuple]:
    """``(cluster, mapped)`` of one connected part, given as (cluster, class, n)."""
    clusters = _ordered({r[0] for r in rows})
    classes = _ordered({r[1] for r in rows})
    if max(len(clusters), len(classes)) > DENSE_LABELS:
        at_cluster = {v: i for i, v in enumerate(clusters)}
        at_class = {v: i for i, v in enumerate(classes)}
        cells = np.array([(at_cluster[c], at_class[k], n) for c, k, n in rows], dtype=np.int64).T
        row_of = auction([local_block(*cells, len(clusters), len(classes))], len(clusters), len(classes))
        return [(c, classes[k] if k >= 0 else None) for c, k in zip(clusters, row_of)]
    row_of = max_weight_assignment(match_matrix(rows, clusters, classes).T)
    return [
        (c, classes[row_of[i]] if row_of[i] < len(classes) else None)
        for i, c in enumerate(clusters)
    ]


def split_parts(rows: list[tuple]) -> list[list[tuple]]:
    """The cells by connected part: those linked through a common cluster or class."""
    root: dict = {}

    def find(v):
        root.setdefault(v, v)
        while root[v] != v:
            root[v] = v = root[root[v]]
        return v

    for cluster, label, _ in rows:
        root[find((0, cluster))] = find((1, label))
    parts: dict = {}
    for row in rows:
        parts.setdefault(find((0, row[0])), []).append(row)
    return list(parts.values())


def find_parts(cells: DataFrame) -> DataFrame:
    """``cells`` with ``part``, the least cluster of the connected part, found by Spark.

    Parts spread from clusters to classes and back, and then follow the part of the part.
    """
    scratch = Scratch(cells.sparkSession, "parts")
    cells = cells.select(F.struct("cluster").alias("c"), F.struct("class").alias("k"), "n")
    state = scratch.cut(cells.select("c", F.col("c").alias("part")).distinct())
    while True:
        by_class = cells.join(state, "c").groupBy("k").agg(F.min("part").alias("p"))
        spread = cells.join(by_class, "k").groupBy("c").agg(F.min("p").alias("part"))
        ahead = spread.select(F.col("c").alias("part"), F.col("part").alias("next"))
        moved = scratch.cut(
            spread.join(ahead, "part")
            .select("c", F.least("part", "next").alias("part"))
            .join(state.select("c", F.col("part").alias("before")), "c")
        )
        state = moved.select("c", "part")
        if moved.where(F.col("part") != F.col("before")).isEmpty():
            joined = cells.join(state, "c")
            return joined.select("part", F.col("c.cluster"), F.col("k.class"), "n")


def numbered(labels: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """``label`` and ``at``, numbers from 0 without gaps, and how many there are.

    The rows are written once with the places they have in their partition; the driver adds
    up the partitions' counts.
    """
    placed = scratch.cut(labels.select("label", F.monotonically_increasing_id().alias("m")))
    part = F.shiftright("m", 33)
    counts = placed.groupBy(part.alias("part")).count().orderBy("part").collect()
    ends = np.cumsum([r["count"] for r in counts]).tolist()
    starts = placed.sparkSession.createDataFrame(
        [(r["part"], e - r["count"]) for r, e in zip(counts, ends)], "part long, before long"
    )
    place = F.col("m").bitwiseAND(F.lit((1 << 33) - 1))
    out = placed.withColumn("part", part).join(F.broadcast(starts), "part")  # a row a partition
    return out.select("label", (F.col("before") + place).alias("at")), ends[-1] if ends else 0


def match_large(cells: DataFrame) -> DataFrame:
    """``(cluster, mapped)`` of the cells of large parts, by auction in blocks."""
    scratch = Scratch(cells.sparkSession, "auction")
    sides = [F.struct(c).alias("label") for c in ("cluster", "class")]
    clusters, n_clusters = numbered(cells.select(sides[0]).distinct(), scratch)
    classes, n_classes = numbered(cells.select(sides[1]).distinct(), scratch)
    if n_clusters + n_classes > MAX_LABELS:
        raise LargePart
    placed = (
        cells.select(F.struct("cluster").alias("a"), F.struct("class").alias("b"), "n")
        .join(clusters.select(F.col("label").alias("a"), F.col("at").alias("i")), "a")
        .join(classes.select(F.col("label").alias("b"), F.col("at").alias("j")), "b")
        .select("i", "j", "n")
    )
    found = auction_by_blocks(placed, n_clusters, n_classes, scratch)
    return (
        clusters.join(found, F.col("at") == F.col("i"), "left")
        .select(F.col("label.cluster").alias("cluster"), "j")
        .join(classes.select(F.col("label.class").alias("mapped"), F.col("at").alias("j")), "j", "left")
        .select("cluster", "mapped")
    )


def strip_leaves(cells: DataFrame, leaf: str, stem: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The cells without labels of side ``leaf`` that have one cell, and the heaviest of these a label.

    ``cells`` has ``cluster`` and ``class``, as structs, and n. A label of very many cells gets
    what it loses by broadcast; only so many labels can have that many cells.
    """
    single = (
        cells.groupBy(leaf)
        .agg(F.count(F.lit(1)).alias("d"), F.min(stem).alias(stem), F.min("n").alias("n"))
        .where(F.col("d") == 1)
        .select("cluster", "class", "n")
    )
    single = scratch.cut(single)
    best = single.groupBy(stem).agg(F.max_by(F.struct(leaf, "n"), F.struct("n", leaf)).alias("v"))
    best = scratch.cut(best.select(stem, f"v.{leaf}", "v.n"))
    # both ends together are unique, so no label's cells meet in one task
    rest = cells.join(single.select("cluster", "class"), ["cluster", "class"], "left_anti")
    lost = best.select(stem, F.col("n").alias("lost"))
    many = cells.groupBy(stem).count().where(F.col("count") > STEM_CELLS).select(stem)
    heavy = F.broadcast(lost.join(F.broadcast(many), stem, "left_semi").withColumnRenamed("lost", "most"))
    rest = rest.join(heavy, stem, "left")
    left = F.col("n") - F.col("lost")
    others = rest.where(F.col("most").isNull()).join(lost, stem, "left")
    rest = rest.where(F.col("most").isNotNull()).select("cluster", "class", (F.col("n") - F.col("most")).alias("n"))
    rest = rest.unionByName(others.select("cluster", "class", F.coalesce(left, F.col("n")).alias("n")))
    return scratch.cut(rest.where(F.col("n") > 0)), best


def best_mapping(cells: DataFrame) -> DataFrame:
    """``(cluster, mapped)``: the one-to-one mapping that agrees on most rows.

    Only labels that share rows are matched. A cluster without a partner maps to null. Over
    MAX_LABELS labels in large connected parts are an error, not counting those that are taken
    out because they have a single cell, at first or once others are out.
    """
    cells = cells.select("cluster", "class", "n")
    schema = T.StructType(
        [
            T.StructField("cluster", cells.schema["cluster"].dataType),
            T.StructField("mapped", cells.schema["class"].dataType),
        ]
    )
    if len(cells.select("n").limit(DRIVER_CELLS + 1).collect()) <= DRIVER_CELLS:
        return match_cells(cells, schema)
    scratch = Scratch(cells.sparkSession, "leaves")
    first = scratch.cut(cells.select(F.struct("cluster").alias("cluster"), F.struct("class").alias("class"), "n"))
    rest, count, taken = first, first.count(), []
    sides = [("cluster", "class"), ("class", "cluster")]
    idle = 0
    while count and idle < 2:
        leaf, stem = sides[len(taken) % 2]
        rest, best = strip_leaves(rest, leaf, stem, scratch)
        taken.append((stem, best))
        before, count = count, rest.count()
        # a long chain loses little a round: what is small enough goes to the assignment
        much = before - count > (before // 10 if before <= MAX_LABELS else 0)
        idle = 0 if much else idle + 1
    found = match_cells(rest.select("cluster.cluster", "class.class", "n"), schema)
    found = found.select(F.struct("cluster").alias("cluster"), F.struct(F.col("mapped").alias("class")).alias("class"))
    # a dense assignment also pairs labels that share nothing, which hold no one else back
    found = scratch.cut(found.join(rest.select("cluster", "class"), ["cluster", "class"], "left_semi"))
    for stem, best in reversed(taken):
        # who found nothing better takes the label that was taken out
        found = scratch.cut(found.unionByName(best.join(found.select(stem), stem, "left_anti").select("cluster", "class")))
    out = first.select("cluster").distinct().join(found, "cluster", "left")
    out = out.select("cluster.cluster", F.col("class.class").alias("mapped"))
    out = Scratch(cells.sparkSession, "mapping").cut(out)
    scratch.release(keep=0)
    return out


def match_cells(cells: DataFrame, schema: T.StructType) -> DataFrame:
    """``(cluster, mapped)`` of the cells by their connected parts."""
    rows = [tuple(r) for r in cells.limit(DRIVER_CELLS + 1).collect()]
    if len(rows) <= DRIVER_CELLS:
        out = [pair for part in split_parts(rows) for pair in match_part(part)]
        return cells.sparkSession.createDataFrame(out, schema)

    def matched(table: pa.Table) -> pa.Table:
        cells_here = list(zip(*(table.column(c).to_pylist() for c in ("cluster", "class", "n"))))
        found = [pair for part in split_parts(cells_here) for pair in match_part(part)]
        fields = [("cluster", table.schema.field("cluster").type), ("mapped", table.schema.field("class").type)]
        columns = zip(*found)
        return pa.table([pa.array(v, t) for v, (_, t) in zip(columns, fields)], names=["cluster", "mapped"])

    parts = find_parts(cells).persist()
    sides = parts.groupBy("part").agg(*[F.count_distinct(F.struct(c)).alias(c) for c in ("cluster", "class")])
    large = sides.where(F.greatest("cluster", "class") > DENSE_LABELS).select("part")
    # a group is many small parts, of at most DENSE_LABELS squared cells each
    groups = -(-cells.count() // TASK_CELLS)
    group = F.pmod(F.xxhash64("part"), F.lit(groups)).alias("group")
    out = parts.join(large, "part", "left_anti").groupBy(group).applyInArrow(matched, schema)
    if not large.isEmpty():
        out = out.unionByName(match_large(parts.join(large, "part", "left_semi").drop("part")))
    out = Scratch(cells.sparkSession, "mapping").cut(out)
    parts.unpersist()
    return out


def relabel(df: DataFrame, mapping: DataFrame, column: str = "prediction") -> DataFrame:
    """Add ``mapped``. Null clusters are labels like any other."""
    names = mapping.select(F.col("cluster").alias("__cluster"), "mapped")
    return df.join(names, F.col(column).eqNullSafe(F.col("__cluster")), "left").drop("__cluster")


def label_changes(a: DataFrame, b: DataFrame, column: str = "prediction") -> DataFrame:
    """One row: how many ids carry a different label in the two tables."""
    both = a.select("id", F.col(column).alias("a")).join(
        b.select("id", F.col(column).alias("b")), "id"
    )
    return both.agg(F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("changed"))
