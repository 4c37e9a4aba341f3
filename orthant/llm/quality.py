"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of a whole text are computed inside tasks. The trees are grown on histograms of
quantile bins from a bounded sample of labelled rows, and then laid out as arrays, so that
scoring walks all rows through all trees at once with numpy indexing.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

from orthant.llm.common import bounded_sample, crc_mod, map_texts, settle

#: Labelled rows that the trees are fitted on, at most: those of the lowest hash of the id.
SAMPLE_ROWS = 20_000
#: Score from which a document is accepted.
ACCEPT = 0.7

MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_{|}~"


def statistics(text: str) -> list[float]:
    """Shares and counts that describe a text; all zero for a text without characters."""
    data = text.encode("utf-8")
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = max(1, len(data))
    words = text.split()
    n = max(1, len(words))
    frequency = Counter(words)
    lines = text.split("\n")
    filled = [line for line in lines if line.strip()]
    sizes = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1)
    ends = Counter(word[-1] for word in words)
    row = [
        np.log1p(len(text)),
        np.log1p(len(words)),
        counts[65:91].sum() / size,
        counts[48:58].sum() / size,
        counts[128:].sum() / size,
        counts[32] / size,
        counts[10] / size,
        sum(counts[ord(c)] for c in MARKS) / size,
        sizes.mean(),
        sizes.std(),
        float(sizes.max()),
        (sizes <= 2).mean(),
        len(frequency) / n,
        max(frequency.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n,
        sum(map(eq, words, words[2:])) / n,
        sum(map(eq, words, words[3:])) / n,
        sum(1 for w in words if not any(map(str.isalpha, w[:2]))) / n,
        sum(v for c, v in ends.items() if not c.isalnum()) / n,
        len(filled) / n,
        1 - len(set(filled)) / max(1, len(filled)),
        sum(1 for line in filled if len(line) < 30) / max(1, len(filled)),
        sum(1 for w in frequency if w.isupper()) / max(1, len(frequency)),
    ]
    row += [counts[ord(c)] / size for c in MARKS]
    return [float(x) for x in row]


N_STATISTICS = len(statistics(""))


@dataclass(frozen=True)
class Trees:
    """All trees in flat arrays. Inner nodes: feature, cut, children; a leaf points at itself."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        for _ in range(self.depth):
            goes_left = x[rows, self.feature[at]] <= self.cut[at]
            at = np.where(goes_left, self.left[at], self.right[at])
        total = self.base + self.value[at].sum(axis=1)
        return 1.0 / (1.0 + np.exp(-total))


def fit_trees(
    x: np.ndarray,
    y: np.ndarray,
    n_trees: int = 80,
    depth: int = 4,
    rate: float = 0.15,
    bins: int = 64,
    ridge: float = 1.0,
    least: int = 10,
) -> Trees:
    """Boosting on the logistic loss; each level takes its splits from one histogram."""
    n = len(y)
    prior = (y.sum() + 1.0) / (n + 2.0)
    base = float(np.log(prior / (1 - prior)))
    features, cuts, lefts, rights, values, roots = [], [], [], [], [], []
    if n and 0 < y.sum() < n:
        grid = np.arange(1, bins) / bins
        edges = [np.unique(np.quantile(x[:, f], grid)) for f in range(x.shape[1])]
        binned = np.stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)], axis=1)
        width, n_features = bins + 1, x.shape[1]
        offset = binned + np.arange(n_features) * width
        margin = np.full(n, base)
        for _ in range(n_trees):
            p = 1.0 / (1.0 + np.exp(-margin))
            grad, hess = y - p, p * (1 - p)
            roots.append(len(features))
            open_nodes = [len(features)]
            node = np.zeros(n, np.int64)  # place in open_nodes, or -1
            spot = np.full(n, len(features))

            def add_leaf():
                at = len(features)
                features.append(0)
                cuts.append(0.0)
                lefts.append(at)
                rights.append(at)
                values.append(0.0)
                return at

            add_leaf()
            for _level in range(depth):
                inside = node >= 0
                if not open_nodes or not inside.any():
                    break
                key = (node[inside, None] * (n_features * width) + offset[inside]).ravel()
                shape = (len(open_nodes), n_features, width)
                length = int(np.prod(shape))
                each = lambda v: np.bincount(key, np.repeat(v, n_features), length)
                g = each(grad[inside]).reshape(shape).cumsum(axis=2)
                h = each(hess[inside]).reshape(shape).cumsum(axis=2)
                c = np.bincount(key, minlength=length).reshape(shape).cumsum(axis=2)
                gt, ht, ct = g[:, :1, -1:], h[:, :1, -1:], c[:, :1, -1:]
                gain = g**2 / (h + ridge) + (gt - g) ** 2 / (ht - h + ridge) - gt**2 / (ht + ridge)
                gain = np.where((c >= least) & (ct - c >= least), gain, 0.0)
                gain = gain.reshape(len(open_nodes), -1)
                best = gain.argmax(axis=1)
                following, moved = [], np.full(n, -1)
                for k, at in enumerate(open_nodes):
                    if gain[k, best[k]] <= 1e-6:
                        continue
                    f, b = divmod(int(best[k]), width)
                    if b >= len(edges[f]):
                        continue
                    features[at], cuts[at] = f, float(edges[f][b])
                    lefts[at], rights[at] = add_leaf(), add_leaf()
                    here = node == k
                    low = here & (binned[:, f] <= b)
                    for side, rows in ((lefts[at], low), (rights[at], here & ~low)):
                        spot[rows] = side
                        moved[rows] = len(following)
                        following.append(side)
                open_nodes, node = following, moved
            reached = np.bincount(spot - roots[-1], grad), np.bincount(spot - roots[-1], hess)
            leaf = rate * reached[0] / (reached[1] + ridge)
            for k, v in enumerate(leaf):
                values[roots[-1] + k] = float(v)
            margin += leaf[spot - roots[-1]]
    return Trees(
        np.array(features or [0]),
        np.array(cuts or [0.0]),
        np.array(lefts or [0]),
        np.array(rights or [0]),
        np.array(values or [0.0]),
        np.array(roots or [0]),
        depth,
        base,
    )


def with_statistics(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` and ``stats``, the statistics of each whole text."""

    def kernel():
        return lambda texts: {"stats": [statistics(t) for t in texts]}

    return map_texts(df, text, kernel, StructType([StructField("stats", ArrayType(DoubleType()))]), keep)


def fit_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS
) -> Trees:
    """Trees from the labelled documents outside the held-out part.

    Held out: crc32 of the id as text mod 4 is 2. Ids with contradicting labels, null ids and
    null labels are left out. Without labels of both kinds every score is the smoothed share
    of label 1 (one half if there is none).
    """
    known = (
        labels.select(F.col("doc_id").alias("__id"), F.col(label).cast("int").alias("__y"))
        .where(F.col("__id").isNotNull() & F.col("__y").isNotNull() & (crc_mod("__id", 4) != 2))
        .groupBy("__id")
        .agg(F.min("__y").alias("__y"), F.max("__y").alias("__z"))
        .where(F.col("__y") == F.col("__z"))
        .drop("__z")
    )
    known = bounded_sample(known, "__id", sample_rows)
    # at most sample_rows pairs of numbers
    texts = docs.select(F.col("doc_id").alias("__id"), "text").join(F.broadcast(known), "__id")
    rows = (
        with_statistics(texts, "text", ["__id", "__y"])
        .orderBy(F.xxhash64("__id"), "__id", "stats")
        .limit(sample_rows)
        .collect()
    )
    x = np.array([r["stats"] for r in rows]).reshape(len(rows), N_STATISTICS)
    return fit_trees(x, np.array([float(r["__y"] == 1) for r in rows]))


def score_quality(
    df: DataFrame, trees: Trees, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``score`` in 0..1 of each whole text, from its statistics alone; null counts as empty."""
    shared = df.sparkSession.sparkContext.broadcast(trees)  # bounded by trees x depth
    keep = ["doc_id"] if keep is None else keep

    def kernel():
        model = shared.value
        settle()

        def run(texts):
            x = np.array([statistics(t) for t in texts]).reshape(len(texts), N_STATISTICS)
            return {"score": model.score(x)}

        return run

    return map_texts(df, text, kernel, StructType([StructField("score", DoubleType())]), keep)


def classify(
    docs: DataFrame,
    labels: DataFrame,
    accept: float = ACCEPT,
    sample_rows: int = SAMPLE_ROWS,
    keep: list[str] | None = None,
) -> DataFrame:
    """``score`` and ``predicted`` (1 from ``accept`` on) of every document.

    Repeated rows are scored each; equal texts have equal scores.
    """
    trees = fit_quality(docs, labels, sample_rows=sample_rows)
    scored = score_quality(docs, trees, keep=keep)
    return scored.withColumn("predicted", (F.col("score") >= accept).cast("int"))
