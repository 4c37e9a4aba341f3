"""Document fingerprints by locally consistent parsing.

A text is parsed in levels. On each level runs of one symbol are folded, deterministic coin
tossing shrinks the alphabet (a symbol becomes the lowest bit in which it differs from its left
neighbour, and the value of that bit, a few times over), phrases start at local maxima of the
small labels, and each phrase is named by a hash of its symbols. A border depends on a few
neighbours only, so equal substrings get equal phrases inside, at whatever offset they stand.

The fingerprint keeps, for each of a fixed number of registers, the least name of the phrases on
levels 2 and 3 that fall in it; a name that occurs again counts as another one each time.
Likeness is the share of registers that agree.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import (
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from orthant.llm.common import settle

REGISTERS = 128
#: Levels whose phrases enter the fingerprint; a phrase on level n is about 3**n characters.
LEVELS = (2, 3)
#: Characters parsed together; documents are never cut.
CHUNK = 60_000
#: Buckets of neighbouring ids per shuffle partition.
BUCKETS_PER_PARTITION = 4

_U = np.uint64
_EMPTY = 0xFFF


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


#: Place of the lowest set bit of a byte (0 for none).
_LOW8 = np.array([(v & -v).bit_length() - 1 if v else 0 for v in range(256)], np.uint8)


def _lowest_bit(x: np.ndarray) -> np.ndarray:
    """Place of the lowest set bit, through the lowest byte that is not 0."""
    place = np.zeros(len(x), np.uint8)
    open_ = np.arange(len(x))
    for k in range(8):
        byte = ((x >> _U(8 * k)) & _U(255)).astype(np.uint8)
        place[open_] = _LOW8[byte] + np.uint8(8 * k)
        rest = np.flatnonzero(byte == 0)
        if not rest.size:
            break
        open_, x = open_[rest], x[rest]
    return place


def _toss(x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One round of coin tossing: 2 * (lowest differing bit) + its value, in a byte. ``first``
    marks symbols without a left neighbour."""
    left = np.empty_like(x)
    left[1:] = x[:-1]
    left[first] = x[first] ^ x.dtype.type(1)
    differ = x ^ left
    if x.dtype == np.uint8:
        place = _LOW8[differ]
        bit = (x >> place) & np.uint8(1)
    else:
        place = _lowest_bit(differ)
        bit = ((x >> place.astype(_U)) & _U(1)).astype(np.uint8)
    return (place << np.uint8(1)) | bit


def parse_level(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and document numbers of the phrases; documents are parsed apart."""
    if not len(names):
        return names, doc
    change = np.empty(len(names), bool)
    change[0] = True
    change[1:] = (names[1:] != names[:-1]) | (doc[1:] != doc[:-1])
    start = np.flatnonzero(change)
    run = np.diff(np.append(start, len(names))).astype(_U)
    x, doc = names[start], doc[start]
    folded = np.flatnonzero(run > 1)
    x[folded] = _mix(x[folded] + run[folded] * _U(0x9E3779B97F4A7C15))
    first = np.empty(len(x), bool)
    first[0] = True
    first[1:] = doc[1:] != doc[:-1]
    label = x
    for _ in range(4):
        label = _toss(label, first)
    label = label.view(np.int8)
    before = np.empty_like(label)
    before[1:] = label[:-1]
    after = np.full_like(label, -1)
    after[:-1] = label[1:]
    last = np.append(first[1:], True)
    after[last] = -1
    begins = (label > before) & (label > after) & ~last
    begins[first] = True
    begins[1:] &= ~begins[:-1] | first[1:]
    start = np.flatnonzero(begins)
    length = np.diff(np.append(start, len(x)))
    inside = np.arange(len(x)) - np.repeat(start, length)
    with np.errstate(over="ignore"):
        summed = np.add.reduceat(_mix(x + inside.astype(_U) * _U(0xD6E8FEB86659FD93)), start)
        return _mix(summed + length.astype(_U)), doc[start]


def sketches(texts: list[str]) -> np.ndarray:
    """texts x REGISTERS of 12-bit values; 0xFFF where no phrase falls."""
    out = np.full((len(texts), REGISTERS), _EMPTY, np.uint16)
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
            size += len(texts[j])
            j += 1
        out[i:j] = _sketch_chunk(texts[i:j])
        i = j
    return out


def _sketch_chunk(texts: list[str]) -> np.ndarray:
    n = len(texts)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    doc = np.repeat(np.arange(n), [len(t) for t in texts])
    names = points.astype(_U)
    least = np.full(n * REGISTERS, np.iinfo(_U).max, _U)
    for level in range(1, max(LEVELS) + 1):
        if not len(names):
            break
        names, doc = parse_level(names, doc)
        if level in LEVELS:
            salted = _mix(names + _U(level) + doc.astype(_U) * _U(0x9E3779B97F4A7C15))
            order = np.argsort(salted)  # brings the occurrences of a name in a document together
            ordered = salted[order]
            fresh = np.append(True, ordered[1:] != ordered[:-1])
            place = np.arange(len(order))
            nth = place - np.maximum.accumulate(np.where(fresh, place, 0))
            counted = _mix(names[order] + _U(level) + nth.astype(_U) * _U(0xD6E8FEB86659FD93))
            at = doc[order] * REGISTERS + (counted % _U(REGISTERS)).astype(np.int64)
            np.minimum.at(least, at, counted // _U(REGISTERS))
    short = (_mix(least) % _U(_EMPTY)).astype(np.uint16)
    short[least == np.iinfo(_U).max] = _EMPTY
    return short.reshape(n, REGISTERS)


_HEX3 = [f"{v:03x}" for v in range(4096)]


def to_string(sketch: np.ndarray) -> str:
    """Three hexadecimal digits a register."""
    return "".join(map(_HEX3.__getitem__, sketch.tolist()))


def from_string(fingerprint: str) -> np.ndarray:
    return np.array([int(fingerprint[i : i + 3], 16) for i in range(0, len(fingerprint), 3)], np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of the registers in use that agree; 1 for two empty texts. Works row by row."""
    used = ((a != _EMPTY) | (b != _EMPTY)).sum(axis=-1)
    same = ((a == b) & (a != _EMPTY)).sum(axis=-1)
    return np.where(used == 0, 1.0, same / np.maximum(used, 1))


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the start of the next one."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def in_order_with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows dealt out by ranges of the key, so that a task meets each document's next one.

    Columns: part, guard, key, text, sorted within tasks. Each range ends with a copy of the
    first document of the next range (guard = 1; after the last range, the first one), so the
    text moves once and no task sees more than its ranges. Nulls sort first; rows of one key
    are ordered by text. The driver handles one number per range.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.select(F.col(f"`{key}`").cast("long").alias("key"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    wanted = n * BUCKETS_PER_PARTITION
    marks = [i / wanted for i in range(1, wanted)]
    found = rows.agg(F.percentile_approx("key", marks, 10 * wanted)).first()[0] or []
    splits = [float("-inf"), *sorted({float(v) for v in found}), float("inf")]
    as_double = F.coalesce(F.col("key").cast("double"), F.lit(float("-inf")))
    ranges = Bucketizer(splits=splits, inputCol="__k", outputCol="__p")
    placed = rows.withColumn("__k", as_double)
    if len(splits) > 2:
        placed = ranges.transform(placed).withColumn("part", F.col("__p").cast("int"))
    else:
        placed = placed.withColumn("part", F.lit(0))
    placed = placed.select("part", "key", "text")
    least = sorted(
        (r["part"], r["k"])
        for r in placed.groupBy("part")
        .agg(F.min(F.struct(F.col("key").isNotNull().alias("has"), "key")).getField("key").alias("k"))
        .collect()
    )
    parts = [p for p, _ in least]
    guard_of = [(k, parts[i - 1]) for i, (_, k) in enumerate(least)]
    guards = spark.createDataFrame(guard_of, "gk long, part int")
    copies = rows.join(F.broadcast(guards), F.col("key").eqNullSafe(F.col("gk")))  # a row a range
    whole = placed.select("part", F.lit(0).alias("guard"), "key", "text").unionByName(
        copies.select("part", F.lit(1).alias("guard"), "key", "text")
    )
    return whole.repartition(n, "part").sortWithinPartitions(
        "part", "guard", F.asc_nulls_first("key"), "text"
    )


def fingerprints(df: DataFrame) -> DataFrame:
    """Fingerprints of each document and of its edited text, by ascending doc_id.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next. Null and empty texts have an empty fingerprint, which is like other empty ones
    only. Documents that share an id follow each other in the order of their texts, null ids
    come first; repeated rows stay. A lone document is its own next one.
    """
    schema = StructType(
        [
            StructField("doc_id", LongType()),
            StructField("n_chars", LongType()),
            StructField("edited_sha256", StringType()),
            StructField("fingerprint", StringType()),
            StructField("edited_fingerprint", StringType()),
            StructField("near_edited", DoubleType()),
            StructField("near_next", DoubleType()),
        ]
    )
    arrow = to_arrow_schema(schema)

    def run(batches):
        settle()
        waiting = None  # part, key, text, sketch
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True))
            for at in range(0, len(rows), 256):
                piece = rows[at : at + 256]
                own = sketches([r[3] for r in piece])
                line = [waiting] if waiting else []
                line += [(r[0], r[1], r[2], r[3], s) for r, s in zip(piece, own, strict=True)]
                pairs = [
                    (a, b)
                    for a, b in zip(line, line[1:], strict=False)
                    if a[1] == 0 and a[0] == b[0]
                ]
                waiting = line[-1]
                if not pairs:
                    continue
                new = [edited(a[3], b[3]) for a, b in pairs]
                changed = sketches(new)
                mine = np.array([a[4] for a, _ in pairs])
                following = np.array([b[4] for _, b in pairs])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([a[2] for a, _ in pairs], pa.int64()),
                        pa.array([len(a[3]) for a, _ in pairs], pa.int64()),
                        pa.array([hashlib.sha256(t.encode("utf-8")).hexdigest() for t in new]),
                        pa.array([to_string(s) for s in mine]),
                        pa.array([to_string(s) for s in changed]),
                        pa.array(likeness(mine, changed), pa.float64()),
                        pa.array(likeness(mine, following), pa.float64()),
                    ],
                    schema=arrow,
                )

    return in_order_with_next(df).mapInArrow(run, schema)
