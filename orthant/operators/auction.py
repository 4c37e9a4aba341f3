"""One-to-one assignment of largest weight on sparse cells, by auction.

Both sides bid: clusters for classes, and a mirrored copy of the classes for a mirrored copy of
the clusters. Everyone may also take their own mirror image at weight 0, so all bidders can be
served whatever the cells are, and prices may start anywhere, as scaling needs. Each half of the
solution is a matching of largest weight, where labels may stay without a partner.

A bidder offers what makes its best object as good as its second best, plus a step. Steps shrink
from phase to phase. Weights are multiplied by the number of bidders plus one, so a last step of 1
makes the result exact.

Bidders are cut into blocks. In a round each block runs its own auction to the end against the
prices of the round's start, and the highest offer for an object wins among the blocks. No price
in a block is above the merged one, so what a winner leaves is no better after the merge than it
was before, and the bound on each bidder's loss holds. The driver keeps one price and one owner
a label; a task has one block and these. How many rounds there are depends on how many blocks want
the same objects, so blocks are as large as a task can well hold: few tables have several.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orthant.session import Scratch

# Cells of a block of bidders, some 40 bytes each while it bids.
BLOCK_CELLS = 8_000_000
# By how much a step is smaller than that of the phase before.
SHRINK = 6

_LOW = np.iinfo(np.int64).min // 2

#: Bidders (ascending), bounds of their edges, object and weight of each edge.
Block = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def bidders_block(bidder: np.ndarray, obj: np.ndarray, weight: np.ndarray, n_clusters: int, n_classes: int) -> Block:
    """A block of the edges of whole bidders; the edge to the own mirror image is added."""
    own = np.unique(bidder)
    image = np.where(own < n_clusters, own + n_classes, own - n_clusters)
    bidder = np.concatenate([bidder, own])
    obj = np.concatenate([obj, image])
    weight = np.concatenate([weight, np.zeros(len(own), np.int64)])
    order = np.lexsort((obj, bidder))
    bounds = np.append(np.searchsorted(bidder[order], own), len(order))
    return own, bounds, obj[order], weight[order]


def local_block(i: np.ndarray, j: np.ndarray, n: np.ndarray, n_clusters: int, n_classes: int) -> Block:
    """All bidders as one block."""
    bidder = np.concatenate([i, n_clusters + j])
    obj = np.concatenate([j, n_classes + i])
    return bidders_block(bidder, obj, np.concatenate([n, n]), n_clusters, n_classes)


def offers(block: Block, scale: int, price: np.ndarray, holds: np.ndarray, step: int):
    """(object, bidder, price) of the objects whose owner changes in an auction of this block."""
    own, bounds, obj, weight = block
    price = price.copy()
    mine = holds[own]
    owner = np.full(len(price), -1)
    owner[mine[mine >= 0]] = np.flatnonzero(mine >= 0)
    sold = np.zeros(len(price), dtype=bool)
    open_ = np.flatnonzero(mine < 0)
    while len(open_):
        size = bounds[open_ + 1] - bounds[open_]
        start = np.cumsum(size) - size
        edge = np.arange(size.sum()) + np.repeat(bounds[open_] - start, size)
        value = weight[edge] * scale - price[obj[edge]]
        best = np.maximum.reduceat(value, start)
        at = np.flatnonzero(value == np.repeat(best, size))
        of = np.repeat(np.arange(len(open_)), size)[at]
        at = at[np.append(True, of[1:] != of[:-1])]
        value[at] = _LOW
        # everyone has a cell and the own image, so there is a second best
        wanted = obj[edge[at]]
        offer = price[wanted] + best - np.maximum.reduceat(value, start) + step
        order = np.lexsort((open_, -offer, wanted))
        order = order[np.append(True, np.diff(wanted[order]) != 0)]
        taken, winner = wanted[order], open_[order]
        before = owner[taken]
        before = before[before >= 0]
        mine[before] = -1
        mine[winner], owner[taken], price[taken], sold[taken] = taken, winner, offer[order], True
        left = np.ones(len(open_), dtype=bool)
        left[order] = False
        open_ = np.sort(np.concatenate([open_[left], before]))
    objects = np.flatnonzero(sold)
    return objects, own[owner[objects]], price[objects]


Round = Callable[[int, np.ndarray, np.ndarray, int], Iterable[tuple[np.ndarray, np.ndarray, np.ndarray]]]


def run_rounds(bid: Round, top: int, n_clusters: int, n_classes: int) -> np.ndarray:
    """The class of each cluster, -1 for none. ``bid`` gives the offers of all blocks."""
    n = n_clusters + n_classes
    scale = n + 1
    if top * scale > 2**56:
        raise ValueError(f"counts of up to {top} in {n} labels are too large to be matched exactly")
    price = np.zeros(n, dtype=np.int64)
    step = max(1, top * scale // 4)
    while True:
        holds, owner = np.full(n, -1), np.full(n, -1)
        while (holds < 0).any():
            objects, bidders, prices = (np.concatenate(c) for c in zip(*bid(scale, price, holds, step)))
            order = np.lexsort((bidders, -prices, objects))
            order = order[np.append(True, np.diff(objects[order]) != 0)]
            objects, bidders = objects[order], bidders[order]
            before = owner[objects]
            holds[before[before >= 0]] = -1
            holds[bidders], owner[objects], price[objects] = objects, bidders, prices[order]
        if step == 1:
            out = holds[:n_clusters]
            return np.where(out < n_classes, out, -1)
        price -= price.min()
        step = max(1, step // SHRINK)


def auction(blocks: list[Block], n_clusters: int, n_classes: int) -> np.ndarray:
    """The class of each cluster, -1 for none, of blocks in memory."""
    top = max((int(b[3].max()) for b in blocks), default=0)

    def bid(scale, price, holds, step):
        return [offers(b, scale, price, holds, step) for b in blocks]

    return run_rounds(bid, top, n_clusters, n_classes)


def auction_by_blocks(cells: DataFrame, n_clusters: int, n_classes: int, scratch: Scratch) -> DataFrame:
    """``i`` and ``j`` of the matched cells; ``cells`` has i, j (numbers from 0) and n.

    Blocks are packed and written once; a round is one narrow pass over them. A bidder has at
    most as many cells as there are labels.
    """
    spark = cells.sparkSession
    both = cells.select(F.col("i").alias("bidder"), F.col("j").alias("obj"), "n").unionByName(
        cells.select((F.col("j") + n_clusters).alias("bidder"), (F.col("i") + n_classes).alias("obj"), "n")
    )
    stats = cells.agg(F.count("*").alias("c"), F.max("n").alias("top")).first()
    n_blocks = -(-2 * stats["c"] // BLOCK_CELLS)

    def pack(table: pa.Table) -> pa.Table:
        columns = [table.column(c).to_numpy() for c in ("bidder", "obj", "n")]
        block = bidders_block(*columns, n_clusters, n_classes)
        buffers = [pa.array([a.astype("<i8").tobytes()], pa.binary()) for a in block]
        return pa.table(buffers, names=["own", "bounds", "obj", "weight"])

    block = F.pmod(F.xxhash64("bidder"), F.lit(n_blocks))
    packed = scratch.cut(
        both.groupBy(block.alias("block")).applyInArrow(pack, "own binary, bounds binary, obj binary, weight binary")
    )

    def bid(scale, price, holds, step):
        def run(batches):
            for batch in batches:
                for row in zip(*(batch.column(k) for k in range(4))):
                    made = offers(
                        tuple(np.frombuffer(b.as_buffer(), "<i8") for b in row), scale, price, holds, step
                    )
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a, pa.int64()) for a in made], names=["object", "bidder", "price"]
                    )

        got = packed.mapInArrow(run, "object long, bidder long, price long").toArrow()
        return [tuple(got.column(c).to_numpy() for c in ("object", "bidder", "price"))]

    found = run_rounds(bid, stats["top"], n_clusters, n_classes)
    at = np.flatnonzero(found >= 0)
    return spark.createDataFrame(pa.table({"i": at, "j": found[at]}))
