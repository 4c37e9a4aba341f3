"""Near-duplicate classes by ProbMinHash.

A document is a set of word 5-grams, each of weight 1 however often it occurs, as the similarity
that is verified is that of sets. For each shingle points of a Poisson process arrive with the
weight as rate, each at a random register; a register keeps the shingle that arrives first, and a
shingle is dropped as soon as its next arrival is later than every register. Two documents agree
in a register with their probability Jaccard, at equal weights the Jaccard of the sets.

Registers are grouped in bands. Documents that agree in a band share a bucket; each is compared
with one representative of the bucket, not with all others, and only verified links (exact
Jaccard of the shingle sets) count. Where a bucket is then still spread over several classes, its
members meet fresh representatives, one for each of their rarest shingles, and at last a pair of
members still in different classes is compared if they share one of their rarest shingles:
sets of similarity t have at least t of each in common, so among the n - ceil(t n) + 1 rarest
shingles of each, by any one order, one is common; and what follows the first common one in
either set must still be enough. Both bounds are exact and drop no link, and documents that have
only frequent passages in common are not paired.

Texts with the same words are one node from the start, so exact copies cost one row each.
"""

from __future__ import annotations

import hashlib

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    IntegerType,
    LongType,
    StructField,
    StructType,
)

from orthant.llm.common import cut, map_texts, settle
from orthant.llm.words import find_words
from orthant.session import Scratch

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 25, 5
REGISTERS = BANDS * ROWS
#: Rounds with fresh representatives before all pairs that are still apart.
ROUNDS = 2
#: Words of documents whose registers are filled together.
TOGETHER = 30_000
#: Words whose hash a task remembers.
MEMO = 400_000

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class WordHashes(dict):
    """64-bit word hashes, remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMO:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8"))
        return value

    def of(self, text: str) -> np.ndarray:
        words = find_words(text)
        return np.fromiter(map(self.__getitem__, words), _U, len(words))


def shingles(ids: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of runs of ``size`` words; a shorter text is one shingle, an empty one has none."""
    n = max(1, len(ids) - size + 1) if len(ids) else 0
    if not n:
        return ids
    out = np.full(n, _U(min(size, len(ids))))
    for j in range(min(size, len(ids))):
        out = mix((out + _U(0x9E3779B97F4A7C15)) ^ ids[j : j + n])
    return out


def prob_minhash(
    items: np.ndarray, weights: np.ndarray, owner: np.ndarray, n: int, registers: int = REGISTERS
) -> np.ndarray:
    """For n documents, the item whose arrival is the first at each register.

    ``owner`` is the document of each item. Documents are handled side by side; an item is
    dropped once its arrival is later than every register of its document.
    """
    first = np.full(n * registers, np.inf)
    kept = np.zeros(n * registers, _U)
    base = owner * registers
    at = np.zeros(len(items))
    state = mix(items)
    while len(items):
        state = mix(state + _U(0x9E3779B97F4A7C15))
        uniform = ((state >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53
        at = at - np.log(uniform) / weights
        register = base + (mix(state ^ _U(0xD1B54A32D192ED03)) % _U(registers)).astype(np.int64)
        early = np.flatnonzero(at < first[register])
        order = early[np.argsort(-at[early], kind="stable")]
        first[register[order]] = at[order]
        kept[register[order]] = items[order]
        latest = first.reshape(n, registers).max(axis=1)
        open_ = np.flatnonzero(at < latest[owner])
        items, weights, owner, base = items[open_], weights[open_], owner[open_], base[open_]
        at, state = at[open_], state[open_]
    return kept.reshape(n, registers)


def signatures(texts: list[np.ndarray]) -> tuple[np.ndarray, list[int]]:
    """Band hashes, and the number of different shingles, of documents given by their word
    hashes."""
    found = [np.unique(shingles(ids)) for ids in texts]
    owner = np.repeat(np.arange(len(texts)), [len(items) for items in found])
    items = np.concatenate(found)
    kept = prob_minhash(items, np.ones(len(items)), owner, len(texts))
    band = np.broadcast_to(np.arange(BANDS, dtype=_U), (len(texts), BANDS))
    for r in range(ROWS):
        band = mix((band + _U(0x9E3779B97F4A7C15)) ^ kept.reshape(-1, BANDS, ROWS)[:, :, r])
    return band.view(np.int64), [len(items) for items in found]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, th, k1, k2 (hash of the words), n (different shingles) and bands of each row."""
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    added = StructType(
        [
            StructField("k1", LongType()),
            StructField("k2", LongType()),
            StructField("n", IntegerType()),
            StructField("bands", ArrayType(LongType())),
        ]
    )

    def kernel():
        hashes = WordHashes()
        settle()

        def run(texts):
            words = [hashes.of(t) for t in texts]
            out: dict[str, list] = {f.name: [] for f in added.fields}
            for t, ids in zip(texts, words, strict=True):
                data = ids.tobytes() if len(ids) else b"\0" + t.encode("utf-8")
                key = np.frombuffer(hashlib.blake2b(data, digest_size=16).digest(), "<i8")
                out["k1"].append(int(key[0]))
                out["k2"].append(int(key[1]))
            none = np.zeros(0, np.int64)
            out["bands"], out["n"] = [none] * len(texts), [0] * len(texts)
            group: list[int] = []
            for i in range(len(texts)):
                if len(words[i]):
                    group.append(i)
                if group and (i + 1 == len(texts) or sum(len(words[g]) for g in group) >= TOGETHER):
                    bands, sizes = signatures([words[g] for g in group])
                    for g, band, size in zip(group, bands, sizes, strict=True):
                        out["bands"][g], out["n"][g] = band, size
                    group = []
            return out

        return run

    return map_texts(keyed, "text", kernel, added, ["doc_id", "th"])


def numbered(rows: DataFrame) -> DataFrame:
    """``node`` (a number), k1, k2, n, bands, doc_id, th: one row for each sequence of words.

    The numbers are fixed by writing the table once.
    """
    return cut(rows.dropDuplicates(["k1", "k2"]).withColumn("node", F.monotonically_increasing_id()))


def close_sizes(m: str, n: str, threshold: float) -> Column:
    """Whether sets of these sizes can have the similarity at all."""
    return F.least(m, n) >= threshold * F.greatest(m, n) - 1e-6


def representative_pairs(nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Each member of a bucket with the bucket's least node: distinct (a, b)."""
    members = nodes.select("node", "n", F.explode("bands").alias("band"))
    # cut off, so that a hot bucket can be split in the join
    least = cut(
        members.groupBy("band")
        .agg(F.count("*").alias("c"), F.min("node").alias("b"), F.min_by("n", "node").alias("bn"))
        .where("c > 1")
    )
    return (
        members.join(least, "band")
        .where((F.col("node") != F.col("b")) & close_sizes("n", "bn", threshold))
        .select(F.col("node").alias("a"), "b")
        .distinct()
    )


def mixed_members(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """node, n, class and ``bands`` of the nodes in buckets that hold more than one class, with
    those buckets only."""
    members = nodes.select("node", "n", F.explode("bands").alias("band")).join(classes, "node", "left")
    members = cut(members.withColumn("class", F.coalesce("class", "node")))
    mixed = (
        members.groupBy("band")
        .agg(F.min("class").alias("lo"), F.max("class").alias("hi"))
        .where("lo <> hi")
        .select("band")
    )
    # a node is in at most BANDS buckets
    return members.join(cut(mixed), "band").groupBy("node", "n", "class").agg(F.collect_list("band").alias("bands"))


def rarest_shingles(members: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """node, n, class, bands, ``g`` and ``at``: of each member the rarest shingles, one of which it
    shares with every set of the given similarity, and how many come before it in the order.

    Shingles of one class only come first in the order; they make no pair and are counted only.
    """
    own = cut(members.join(sets, "node"))
    posted = own.select("node", "class", F.explode("g").alias("g"))
    spread = cut(
        posted.groupBy("g")
        .agg(F.count("*").alias("c"), F.min("class").alias("lo"), F.max("class").alias("hi"))
        .where("lo <> hi")
        .select("g", "c")
    )
    # a list is no longer than the document's own set
    shared = (
        posted.join(spread, "g")
        .groupBy("node")
        .agg(F.sort_array(F.collect_list(F.struct("c", "g"))).alias("shared"))
    )
    first = F.col("n") - F.ceil(threshold * F.col("n") - 1e-6) + 1  # how many are needed
    alone = F.col("n") - F.size("shared")
    left = F.greatest(first - alone, F.lit(0)).cast("int")
    return (
        own.drop("g")
        .join(shared, "node")
        .select(
            "node",
            "n",
            "class",
            "bands",
            alone.alias("alone"),
            F.posexplode(F.slice("shared", F.lit(1), left)["g"]).alias("i", "g"),
        )
        .select("node", "n", "class", "bands", "g", (F.col("alone") + F.col("i")).alias("at"))
    )


def relabelled(rare: DataFrame, classes: DataFrame) -> DataFrame:
    """The rarest shingles with the members' present classes."""
    now = classes.select("node", F.col("class").alias("now"))
    return rare.join(now, "node", "left").withColumn("class", F.coalesce("now", "class")).drop("now")


def meeting(rare: DataFrame, other: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different classes, one of each table, that share a bucket and a rarest
    shingle.

    Similar sets of m and n shingles share t / (1 + t) * (m + n). If ``g`` is the first that two
    sets share, all that they share is at or after it in both; a pair that is similar passes
    with its first one.
    """
    other = other.select("g", *[F.col(c).alias("b_" + c) for c in ("node", "n", "class", "bands", "at")])
    needed = threshold / (1 + threshold) * (F.col("n") + F.col("b_n")) - 1e-6
    enough = F.least(F.col("n") - F.col("at"), F.col("b_n") - F.col("b_at")) >= needed
    met = rare.join(other, "g").where((F.col("class") != F.col("b_class")) & enough)
    return met.where(F.arrays_overlap("bands", "b_bands")).select(
        F.least("node", "b_node").alias("a"), F.greatest("node", "b_node").alias("b")
    ).distinct()


def fresh_pairs(rare: DataFrame, salt: int, threshold: float) -> DataFrame:
    """Each member that has a shingle with one of the members that have it: as many pairs as rows
    at most. In round 0 it is the one with the least share of rarer shingles, which is likely to
    be near many; later another one for each shingle and round."""
    rarer = F.col("at") / F.col("n")
    place = F.struct(rarer if salt == 0 else F.lit(0.0), F.xxhash64("node", "g", F.lit(salt)))
    row = F.struct("node", "n", "class", "bands", "at")
    chosen = rare.groupBy("g").agg(F.min_by(row, place).alias("r")).select("g", "r.*")
    return meeting(rare, cut(chosen), threshold)


def crossing_pairs(rare: DataFrame, threshold: float) -> DataFrame:
    """All pairs of nodes of different classes that share a bucket and one of their rarest
    shingles: none of the given similarity is missing."""
    return meeting(rare, rare, threshold)


def shingle_sets(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``node`` and ``g``, its different shingles, of the nodes that share a bucket."""
    banded = nodes.select("node", "doc_id", "th", F.explode("bands").alias("band"))
    crowded = banded.groupBy("band").count().where("count > 1").select("band")
    wanted = (
        banded.join(crowded, "band", "left_semi")
        .select("node", F.col("doc_id").alias("__id"), F.col("th").alias("__th"))
        .distinct()
    )
    keyed = docs.select("doc_id", F.xxhash64("text").alias("th"), "text")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))
    found = keyed.join(wanted, same).select("node", "text")

    def kernel():
        hashes = WordHashes()
        settle()
        return lambda texts: {"g": [np.unique(shingles(hashes.of(t))).view(np.int64) for t in texts]}

    added = StructType([StructField("g", ArrayType(LongType()))])
    return map_texts(found, "text", kernel, added, ["node"]).dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least the given Jaccard similarity.

    Sets are shuffled with the pairs of ``a``; as ``b``, which may be the representative of very
    many, a set is sent once to each task.
    """
    shared = F.size(F.array_intersect("ga", "gb"))
    return (
        pairs.join(sets.select(F.col("node").alias("a"), F.col("g").alias("ga")), "a")
        .join(sets.select(F.col("node").alias("b"), F.col("g").alias("gb")), "b")
        .where(shared >= threshold * (F.size("ga") + F.size("gb") - shared) - 1e-9)
        .select("a", "b")
    )


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``class`` (its component's least node) of the nodes that have a link.

    Labels move along links and then jump to the label of the label, so paths halve each round.
    Each round is cut off; its joins have one row a node on one side.
    """
    both = cut(
        links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        .unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        .distinct()
    )
    labels = cut(
        both.groupBy("u").agg(F.min("v").alias("m")).select(
            F.col("u").alias("node"), F.least("u", "m").alias("class")
        )
    )
    while True:
        sent = both.join(labels, both["u"] == labels["node"]).select(F.col("v").alias("node"), "class")
        least = sent.unionByName(labels).groupBy("node").agg(F.min("class").alias("class"))
        ahead = least.select(F.col("node").alias("class"), F.col("class").alias("next"))
        moved = cut(
            least.join(ahead, "class")
            .select("node", F.least("class", "next").alias("class"))
            .join(labels.select("node", F.col("class").alias("before")), "node")
        )
        labels = moved.select("node", "class")
        if moved.where(F.col("class") != F.col("before")).isEmpty():
            return labels


def near_duplicate_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, th, ``class_id`` (the least doc_id of the class), ``class_size`` and ``first``.

    A class is a connected set of links of similarity ``threshold`` or more; texts with the same
    words are alike, and so are equal texts without any word (null counts as empty). ``first``
    marks the rows of the class's first document, by doc_id (null ids last) and text hash.
    """
    scratch = Scratch(docs.sparkSession, "cut")
    rows = cut(sketches(docs))
    nodes = numbered(rows)
    sets = scratch.cut(shingle_sets(docs, nodes))
    links = scratch.cut(verified(scratch.cut(representative_pairs(nodes, threshold)), sets, threshold))
    classes = components(links)
    members = scratch.cut(mixed_members(nodes, classes))
    if not members.isEmpty():
        rare = scratch.cut(rarest_shingles(members, sets, threshold))
        for salt in range(ROUNDS + 1):
            # what is in one class by now makes no more pairs
            now = scratch.cut(relabelled(rare, classes))
            pairs = fresh_pairs(now, salt, threshold) if salt < ROUNDS else crossing_pairs(now, threshold)
            more = scratch.cut(verified(scratch.cut(pairs), sets, threshold))
            if not more.isEmpty():
                links = links.unionByName(more)
                classes = components(links)
    scratch.release(keep=0)
    labelled = (
        rows.select("doc_id", "th", "k1", "k2")
        .join(nodes.select("k1", "k2", "node"), ["k1", "k2"])
        .join(classes, "node", "left")
        .select("doc_id", "th", F.coalesce("class", "node").alias("class"))
    )
    # heads are cut off as well: a class may hold a third of all rows
    order = F.struct(F.col("doc_id").isNull().alias("nil"), "doc_id", "th")
    heads = cut(labelled.groupBy("class").agg(F.min(order).alias("head"), F.count("*").alias("class_size")))
    return labelled.join(heads, "class").select(
        "doc_id",
        "th",
        F.col("head.doc_id").alias("class_id"),
        "class_size",
        (F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.col("th") == F.col("head.th"))).alias("first"),
    )


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, with all their columns, that are the first of their class; of rows that
    share id and text one stays."""
    id_ = F.col("doc_id").cast("string")
    key = [id_.isNull().alias("__nil"), F.coalesce(id_, F.lit("")).alias("__id")]
    names = ["__nil", "__id", "__key"]
    classes = near_duplicate_classes(docs, threshold).where("first")
    first = classes.select(*key, F.col("th").alias("__key")).distinct()
    keyed = docs.select("*", *key, F.xxhash64("text").alias("__key"))
    # one key for both, so that texts are shuffled once
    return keyed.join(first, names, "left_semi").dropDuplicates(names).drop(*names)


NEAR_DEDUP_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w,
         coalesce(text, '') AS t FROM documents),
n AS (
  SELECT min(doc_id) AS node, CASE WHEN len(w) = 0 THEN t ELSE array_to_string(w, ' ') END AS k,
         len(w) > 0 AS has, any_value(w) AS w
  FROM d GROUP BY 2, 3),
s AS (
  SELECT DISTINCT node, array_to_string(w[i + 1:i + 5], ' ') AS g
  FROM (SELECT node, w, unnest(range(greatest(len(w) - 4, 1))) AS i FROM n WHERE has)),
c AS (SELECT node, count(*) AS c FROM s GROUP BY node),
e AS (
  SELECT p.a, p.b FROM (
    SELECT x.node AS a, y.node AS b, count(*) AS m FROM s x JOIN s y ON x.g = y.g AND x.node <> y.node
    GROUP BY 1, 2) p JOIN c u ON u.node = p.a JOIN c v ON v.node = p.b
  WHERE m >= 0.8 * (u.c + v.c - m) - 1e-9),
r AS (SELECT node, node AS seen FROM n UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a),
k AS (SELECT node, min(seen) AS class_id FROM r GROUP BY node),
m AS (
  SELECT d.doc_id, k.class_id FROM d JOIN n
    ON n.has = (len(d.w) > 0) AND n.k = CASE WHEN len(d.w) = 0 THEN d.t ELSE array_to_string(d.w, ' ') END
  JOIN k ON k.node = n.node)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM m
"""
