"""What the operators share: column handling, and Arrow batches over whole texts."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Texts are handed to a kernel in slices of at most so many bytes; one longer text is a
#: slice of its own. It bounds the memory of a task and changes no result.
SLICE_BYTES = 4_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def crc_mod(column: str, mod: int) -> Column:
    """crc32 of the value as text, mod; a null value counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % mod


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else. ``lower`` is much the faster where all is ASCII."""
    plain = F.octet_length(text) == F.char_length(text)
    some = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(plain, F.lower(text)).otherwise(some)


def apart(text: Column, between: str) -> Column:
    """What stands between the matches of a pattern, without empty parts. Extracting the matches
    of the opposite pattern gives the same words at ten times the time."""
    return F.array_remove(F.split(text, between), "")


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Bounds of slices of a batch of texts that hold SLICE_BYTES bytes each, or one text."""
    start = total = 0
    for i, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if i > start and total + size > SLICE_BYTES:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(texts):
        yield start, len(texts)


def map_texts(
    df: DataFrame,
    text: str,
    kernel: Callable[[], Callable[[list[str]], dict[str, list]]],
    added: StructType,
    keep: list[str],
) -> DataFrame:
    """The columns ``keep`` and those a kernel computes from each whole text; null counts as ''.

    ``kernel()`` is called once per task and returns a function from texts to columns. The
    step is narrow: no shuffle, and memory bounded by an Arrow batch.
    """
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    schema = StructType(source.schema.fields[:-1] + added.fields)
    arrow = to_arrow_schema(schema)

    def run(batches):
        apply = kernel()
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for a, b in slices(texts):
                columns = apply([t or "" for t in texts.slice(a, b - a).to_pylist()])
                kept = [batch.column(i).slice(a, b - a) for i in range(len(keep))]
                made = [
                    pa.array(columns[f.name], type=arrow.field(len(keep) + i).type)
                    for i, f in enumerate(added.fields)
                ]
                yield pa.RecordBatch.from_arrays(kept + made, schema=arrow)

    return source.mapInArrow(run, schema)


def settle() -> None:
    """Take large tables out of the worker's cycle collector, which would walk them again and
    again; nothing in them forms cycles."""
    gc.freeze()
    gc.set_threshold(500_000, 50, 100)


def bounded_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows, those of the lowest hash of the key; the same ones in every run.

    A hash threshold from the row count first cuts the rows to about n, so that the last step
    sorts few.
    """
    order = F.xxhash64(F.col(key).cast("string"))
    total = df.count()
    if total > n:
        share = min(1.0, 1.1 * n / total + 0.0001)
        df = df.where(F.pmod(order, F.lit(1 << 40)) < int(share * (1 << 40)))
        order = F.pmod(order, F.lit(1 << 40))
    return df.orderBy(order, key).limit(n)


def shared_root(spark: SparkSession) -> str:
    """The shared folder in ``spark.checkpoint.dir``; beside the warehouse only where unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return (root or f"{spark.conf.get('spark.sql.warehouse.dir')}/scratch").rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """The rows, written once as Parquet in the shared folder and read back.

    It cuts the lineage. Unlike a checkpoint the table has its real size: estimates carried
    through the joins of a loop multiply, until planning takes longer than the work.
    """
    path = f"{shared_root(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
