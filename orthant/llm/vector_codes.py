"""Vector code compression: small codebooks per part of a vector, searched by Orchard's method.

Vectors become integers, so every sum and distance is exact and no result depends on the order
of the rows. They are cut into equal parts; each part has a codebook that starts at the first
vectors by id and is moved to the mean of its members a fixed number of times.

Orchard's search keeps for every codebook entry the list of all entries by their distance from
it. A part starts at some entry and goes down that entry's list; an entry that was compared
before is marked and passed over; a nearer one becomes the current entry, and the search jumps
to its list. It ends where the list is beyond twice the current distance, as by the triangle
inequality no entry from there on is as near. Ties go to the lower index: entries at exactly
twice the distance are still compared. A batch takes its steps together.

A round is one narrow pass over the packed integers and a shuffle of one row for each task,
part and entry. The driver holds the codebooks only; their size does not grow with the data.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from orthant.llm.common import cut

#: A component x counts as floor(SCALE * x).
SCALE = 4096
PARTS, ENTRIES, ROUNDS = 8, 16, 6


@dataclass(frozen=True)
class Codebooks:
    """The entries of each part, as integers: part, entry, position."""

    entries: np.ndarray

    def digest(self) -> str:
        """SHA-256 of all integers by part, entry and position, with commas between them."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


class Orchard:
    """Nearest entries of one codebook."""

    def __init__(self, book: np.ndarray):
        self.book = book
        far = np.iinfo(np.int64).max
        gaps = ((book[:, None, :] - book[None, :, :]) ** 2).sum(axis=2)
        self.lists = np.argsort(gaps, axis=1, kind="stable")
        gaps = np.take_along_axis(gaps, self.lists, axis=1)
        # a list ends with an entry that is beyond everything
        self.gaps = np.hstack([gaps, np.full((len(book), 1), far)])
        self.lists = np.hstack([self.lists, np.zeros((len(book), 1), np.int64)])
        self.ladder = np.argsort(book[:, 0], kind="stable")
        self.compared = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry of each row, the lowest of equals, and its squared distance."""
        n = len(x)
        rung = np.searchsorted(self.book[self.ladder, 0], x[:, 0]).clip(0, len(self.book) - 1)
        current = self.ladder[rung]
        distance = ((x - self.book[current]) ** 2).sum(axis=1)
        marked = np.zeros((n, len(self.book)), bool)
        rows = np.arange(n)
        marked[rows, current] = True
        place = np.zeros(n, np.int64)
        self.compared += n
        while len(rows):
            gap, d = self.gaps[current[rows], place[rows]], distance[rows]
            # gap <= 4 d, without a product that could overflow
            rows = rows[(gap // 4 < d) | ((gap // 4 == d) & (gap % 4 == 0))]
            entry = self.lists[current[rows], place[rows]]
            place[rows] += 1
            new = ~marked[rows, entry]
            seen, entry = rows[new], entry[new]
            marked[seen, entry] = True
            self.compared += len(seen)
            d = ((x[seen] - self.book[entry]) ** 2).sum(axis=1)
            nearer = (d < distance[seen]) | ((d == distance[seen]) & (entry < current[seen]))
            to = seen[nearer]
            current[to], distance[to], place[to] = entry[nearer], d[nearer], 0
        return current, distance


def packed_vectors(df: DataFrame, vector: str, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and ``v``, the integers of each vector as bytes; without the rows
    whose vector is null or empty or holds a null or non-finite component."""
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{vector}`").cast("array<double>").alias("__v"))
    schema = StructType([*source.schema.fields[:-1], StructField("v", BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            flat = pc.fill_null(lists.flatten(), float("nan")).to_numpy(zero_copy_only=False)
            good = sizes > 0
            starts = (np.cumsum(sizes) - sizes)[good]
            if len(starts):
                good[good] = np.logical_and.reduceat(np.isfinite(flat), starts)
            left = np.repeat(good, sizes)
            whole = np.floor(SCALE * flat[left])
            width = sizes[good]
            limit = np.sqrt(2.0**62 / width.max()) / 2 if len(width) else 0.0
            if len(whole) and np.abs(whole).max() > min(limit, 2.0**31 - 1):
                raise ValueError("components are too large for exact 64-bit sums of squares")
            data = whole.astype("<i4").tobytes()
            ends = np.r_[0, np.cumsum(width) * 4].astype(np.int32)
            packed = pa.Array.from_buffers(
                pa.binary(), len(width), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data)]
            )
            mask = pa.array(good)
            kept = [batch.column(i).filter(mask) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, packed], schema=arrow)

    return source.mapInArrow(run, schema)


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of packed vectors as one matrix."""
    return np.array([np.frombuffer(b, "<i4") for b in column.to_pylist()], np.int64).reshape(-1, width)


def _checked_width(packed: DataFrame, parts: int) -> int:
    """How many components the vectors have; 0 for an empty table."""
    size = F.octet_length("v") / 4
    low, high = packed.agg(F.min(size), F.max(size)).first()
    if low is None:
        return 0
    if low != high or high % parts:
        raise ValueError(f"vectors have {low:g} to {high:g} components; {parts} equal parts are needed")
    return int(high)


def _moved(packed: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with each entry at the floor of the mean of its members."""
    parts, entries, width = books.shape
    sums = [f"s{i}" for i in range(width)]

    def run(batches):
        searches = [Orchard(b) for b in books]
        totals = np.zeros((parts, entries, width), np.int64)
        counts = np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = matrix(batch.column(0), parts * width)
            for p, search in enumerate(searches):
                part = x[:, p * width : (p + 1) * width]
                at, _ = search.nearest(part)
                counts[p] += np.bincount(at, minlength=entries)
                np.add.at(totals[p], at, part)
        columns = [np.repeat(np.arange(parts, dtype=np.int32), entries)]
        columns += [np.tile(np.arange(entries, dtype=np.int32), parts), counts.ravel()]
        columns += list(totals.reshape(-1, width).T)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["part", "entry", "n", *sums])

    schema = "part int, entry int, n bigint, " + ", ".join(f"{s} bigint" for s in sums)
    tables = packed.select("v").mapInArrow(run, schema).where("n > 0").groupBy("part", "entry")
    moved = books.copy()
    # parts x entries rows, whatever the size of the data
    for row in tables.agg(F.sum("n").alias("n"), *[F.sum(s).alias(s) for s in sums]).collect():
        moved[row["part"], row["entry"]] = [row[s] // row["n"] for s in sums]
    return moved


def fit_codebooks(
    packed: DataFrame, id_column: str = "vec_id", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> Codebooks:
    """Codebooks of a table of packed vectors, from all its rows.

    They start at the vectors of the lowest ids, equal ids by their bytes and null ids last;
    with fewer rows there are fewer entries, without a row none.
    """
    width = _checked_width(packed, parts)
    order = F.col(f"`{id_column}`").asc_nulls_last()
    first = packed.orderBy(order, "v").limit(entries).select("v").collect()
    start = np.array([np.frombuffer(r[0], "<i4") for r in first], np.int64)
    if not len(start):
        return Codebooks(np.zeros((parts, 0, 0), np.int64))
    books = start.reshape(len(start), parts, width // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _moved(packed, np.ascontiguousarray(books))
    return Codebooks(np.ascontiguousarray(books))


def encode(packed: DataFrame, codebooks: Codebooks, keep: list[str]) -> DataFrame:
    """``code`` (two hex digits a part) and ``error`` (squared distance, summed over the parts)."""
    books = codebooks.entries
    parts, _, width = books.shape
    source = packed.select(*[F.col(f"`{c}`") for c in keep], "v")
    added = [StructField("code", StringType()), StructField("error", LongType())]
    schema = StructType([*source.schema.fields[:-1], *added])
    arrow = to_arrow_schema(schema)

    def run(batches):
        searches = [Orchard(b) for b in books] if books.size else []
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(len(keep)), parts * width)
            codes = np.zeros((len(x), parts), np.uint8)
            error = np.zeros(len(x), np.int64)
            for p, search in enumerate(searches):
                at, distance = search.nearest(x[:, p * width : (p + 1) * width])
                codes[:, p] = at
                error += distance
            digits = codes.tobytes().hex()
            text = [digits[i : i + 2 * parts] for i in range(0, len(digits), 2 * parts)]
            kept = [batch.column(i) for i in range(len(keep))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(text), pa.array(error)], schema=arrow)

    return source.mapInArrow(run, schema)


def compress(
    df: DataFrame,
    vector: str = "embedding",
    id_column: str = "vec_id",
    keep: list[str] | None = None,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, Codebooks]:
    """Codes of the vectors of a table, and the codebooks they refer to.

    The table has ``keep`` (default: the id), ``code`` and ``error``. Rows whose vector is null
    or empty or has a null or non-finite component are left out; ids may be null or repeat, and
    every row is coded. Vectors of different lengths are an error, as are components beyond
    exact 64-bit arithmetic. An empty table gives an empty one and empty codebooks. Kept columns
    must not be called v, code or error; other columns are ignored. Codebooks have at most 256
    entries.
    """
    keep = [id_column] if keep is None else keep
    clash = sorted(set(keep) & {"v", "code", "error"})
    if clash:
        raise ValueError(f"columns {clash} would be ambiguous")
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits, so 1 to 256 entries")
    packed = cut(packed_vectors(df, vector, list(dict.fromkeys([id_column, *keep]))))
    codebooks = fit_codebooks(packed, id_column, parts, entries, rounds)
    return encode(packed, codebooks, keep), codebooks


def vector_codes_sql(dims: int = 64, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    """The codes of ``embeddings`` as plain SQL that compares every part with every entry."""
    width = dims // parts
    floor_div = "CAST((sum(c) - ((sum(c) % count(*)) + count(*)) % count(*)) // count(*) AS BIGINT)"
    steps = [
        "kept AS (SELECT vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v"
        " FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0"
        " AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"parts AS MATERIALIZED (SELECT vec_id, label, CAST(p AS INTEGER) AS p, v[p * {width} + 1 : p * {width} + {width}] AS x"
        f" FROM kept, range({parts}) r(p))",
        f"b0 AS (SELECT p, CAST(e AS INTEGER) AS e, x AS c FROM parts JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e"
        f" FROM kept ORDER BY vec_id LIMIT {entries}) USING (vec_id))",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"a{r} AS MATERIALIZED (SELECT vec_id, label, p, x, m.e AS e, m.d AS d FROM"
            f" (SELECT vec_id, any_value(label) AS label, p, any_value(x) AS x, min({{'d': d, 'e': e}}) AS m FROM"
            f" (SELECT vec_id, label, parts.p AS p, x, e, list_sum([(x[i] - c[i]) * (x[i] - c[i]) FOR i IN range(1, {width + 1})])::BIGINT AS d"
            f" FROM parts JOIN b{r} ON parts.p = b{r}.p) GROUP BY vec_id, p))"
        )
        if r < rounds:
            steps.append(
                f"b{r + 1} AS MATERIALIZED (SELECT b{r}.p AS p, b{r}.e AS e, coalesce(n.c, b{r}.c) AS c FROM b{r} LEFT JOIN"
                f" (SELECT p, e, list(c ORDER BY i) AS c FROM (SELECT p, e, i, {floor_div} AS c FROM"
                f" (SELECT p, e, unnest(range({width})) AS i, unnest(x) AS c FROM a{r}) GROUP BY p, e, i) GROUP BY p, e) n"
                f" ON n.p = b{r}.p AND n.e = b{r}.e)"
            )
    steps += [
        f"coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code,"
        f" CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id)",
        "totals AS (SELECT label, CAST(sum(error) AS BIGINT) AS label_error FROM coded GROUP BY label)",
        f"digest AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{rounds})",
    ]
    return (
        "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, label_error, codebooks_sha256"
        " FROM coded JOIN totals ON coded.label IS NOT DISTINCT FROM totals.label, digest"
    )
