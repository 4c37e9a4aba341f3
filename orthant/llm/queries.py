"""The registered queries of the operators, and SQL for those that SQL can express.

Each applies its operator, with production parameters, to the whole table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orthant.llm import (
    bpe,
    fingerprints,
    language,
    line_dedup,
    near_dedup,
    periodic,
    pii,
    piece_bpe,
    quality,
    vector_codes,
)
from orthant.llm import decontaminate as decontamination
from orthant.llm import token_counts as counts
from orthant.llm import url_filter as urls
from orthant.llm.common import crc_mod, cut, read
from orthant.llm.line_dedup_sql import LINE_DEDUP

TOKEN_FILE = "byte_bpe_50k.json"
RANK_FILE = "byte_bpe_multi_50k.tiktoken"
PIECE_FILE = "piece_bpe_32k.model"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return counts.token_counts(docs, public_tokenizers.path(TOKEN_FILE))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")
    return decontamination.contamination(docs, items)


def op2_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with stretches near a window of the benchmark: doc_id, n_places, n_items."""
    found = decontamination.proximity_matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.groupBy("doc_id").agg(
        F.count_distinct("start", "end").alias("n_places"), F.count_distinct("item_id").alias("n_items")
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(read(spark, sf_dir, "documents"))


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return pii.find_personal_data(docs, pii.fit_field(docs))


def digests(coded: DataFrame) -> DataFrame:
    """Ids of each document and what they decode to, as digests."""
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def round_trip(docs: DataFrame) -> DataFrame:
    return digests(bpe.encode_decode(docs, public_tokenizers.path(RANK_FILE)))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    scored = quality.classify(docs, labels)
    return scored.select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language.detect(docs, language.fit_language(docs))
    held_out = (crc_mod("doc_id", 5) == 0).alias("held_out")
    return found.select("doc_id", held_out, "lang_pred", "score", "ambiguous")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    return kept.select("doc_id", "n_lines", "n_removed", digest)


def op8_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup, and the passages that lines still share; op8_line_dedup is its first step."""
    kept = line_dedup.dedup_text(read(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")
    return kept.select("doc_id", "n_lines", "n_removed", "n_cut", digest)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_dedup.near_duplicate_classes(read(spark, sf_dir, "documents"))
    return classes.select("doc_id", "class_id", "class_size")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(read(spark, sf_dir, "pages"))


def op11_piece_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return digests(piece_bpe.encode_decode(docs, public_tokenizers.path(PIECE_FILE)))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    coded, codebooks = vector_codes.compress(vectors, keep=["vec_id", "label"])
    coded = cut(coded)
    totals = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    totals = totals.withColumnRenamed("label", "__label")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("__label"))).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks.digest()).alias("codebooks_sha256")
    )


def with_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text``: in documents whose crc32 ends in 0, the words from some place on
    repeat a stretch of words. A null id leaves the text as it is."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = F.floor((n - a) / (g % 8 + 3)) + 1
        at = F.struct(a.alias("a"), p.alias("p"))
        return line_dedup.let(at, lambda s: F.array_join(F.transform(w, lambda x, i: F.when(
            i >= s["a"], F.get(w, (s["a"] + (i - s["a"]) % s["p"]).cast("int"))
        ).otherwise(x)), " "))

    planted = line_dedup.let(words, lambda w: F.when(F.size(w) > 0, repeated(w)).otherwise(F.lit("")))
    return docs.select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_repeats(read(spark, sf_dir, "documents")))
    best = periodic.strongest(F.col("runs"))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.array_join(F.transform(lines, lambda s: F.concat(s, F.lit("\n"))), "")
    found = found.select("doc_id", "runs", "collapsed", best.alias("b"), text.alias("t"))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "b.start",
        "b.length",
        "b.period",
        F.expr("1000 * b.length div b.period").alias("exponent_milli"),
        F.sha2("t", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_counts,
        op2_decontamination,
        op2_proximity,
        op3_fingerprints,
        op4_personal_data,
        op5_byte_bpe,
        op6_quality,
        op7_language,
        op8_line_dedup,
        op8_passage_dedup,
        op9_near_dedup,
        op10_url_filter,
        op11_piece_bpe,
        op12_vector_codes,
        op13_periodic_runs,
    )
}

ORACLES: dict[str, str] = {
    "op2_decontamination": decontamination.DECONTAMINATION_SQL,
    "op8_line_dedup": LINE_DEDUP,
    "op9_near_dedup": near_dedup.NEAR_DEDUP_SQL,
    "op12_vector_codes": vector_codes.vector_codes_sql(),
}
