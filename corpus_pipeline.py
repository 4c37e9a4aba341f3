"""The corpus pipeline: documents in, token ids of the cleaned corpus out.

Each stage works on all that its predecessor kept. ``run`` writes the rows of each stage as
Parquet under the shared folder and reads them back, so that a lost executor costs one stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthant.llm import decontaminate, line_dedup, near_dedup, quality
from orthant.llm.common import read, shared_root
from orthant.llm.queries import round_trip


def packed(docs: DataFrame) -> DataFrame:
    """Id, text, and the whole row in one column, so that no name meets an operator's own."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.select("doc_id", "text", row.alias("__row"))


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. A null text is scored as an empty one,
    repeated rows are scored each, and other columns are carried over whatever their names."""
    labels = read(spark, sf_dir, "labels")
    scored = quality.classify(packed(docs), labels, keep=["doc_id", "__row"])
    return scored.where("predicted = 1").select("__row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later repeated lines and passages; one that had nothing else goes.

    A null or empty text stays. Repeated rows are one document. ``n_chars`` is that of the new
    text; other columns are carried over whatever their names.
    """
    cut = line_dedup.dedup_text(packed(docs))
    untouched = (F.col("n_removed") == 0) & (F.col("n_cut") == 0)
    kept = cut.where(untouched | (F.col("text") != ""))
    types = dict(docs.dtypes)
    own = {"text": F.col("text"), "n_chars": F.length("text")}
    return kept.select(
        *[own.get(c, F.col("__row").getField(c)).cast(types[c]).alias(c) for c in docs.columns]
    )


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of near duplicates, repeated rows being one class; other
    columns are carried over whatever their names."""
    return near_dedup.one_of_each(packed(docs)).select("__row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; null and empty texts have none. Other
    columns are carried over whatever their names."""
    kept = decontaminate.decontaminate(packed(docs), read(spark, sf_dir, "benchmark"))
    return kept.select("__row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number and digest of the token ids of each document, and of the bytes they decode to."""
    return round_trip(docs)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

#: SQL cannot express the trained classifier and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a folder."""
    base = f"{shared_root(spark)}/corpus-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
