"""Language identification by error-correcting output codes.

Each language has a codeword of +1 and -1. For each bit a binary classifier over hashed byte
n-grams (naive Bayes log odds) says on which side a text lies. Decoding adds the logistic loss of
each bit, weighted by how reliable the bit was for that language in training, and takes the
codeword with the least loss. A close second codeword flags the text as ambiguous.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    StringType,
    StructField,
    StructType,
)

from orthant.llm.common import crc_mod, map_texts, settle

#: Documents of a language that the classifiers are fitted on, about so many at most. They are
#: chosen by a hash of the id against a threshold from the language's count.
SAMPLE_PER_LANGUAGE = 2_000
#: n-gram buckets per order.
BUCKETS = 1 << 14
ORDERS = (1, 2, 3, 4)
#: Length of the codes for more than seven languages.
LONG_CODE = 48
#: Share of the best language below which a text is flagged.
AMBIGUOUS = 0.75
UNDETERMINED = "und"

_CLEAN = bytes(
    c if c >= 128 or chr(c).isalpha() else 32 for c in range(256)
)


def grams(text: str) -> np.ndarray:
    """Counts of the hashed byte n-grams of a text, one block of buckets per order."""
    data = text.lower().encode("utf-8").translate(_CLEAN)
    b = np.frombuffer(b" " + data + b" ", np.uint8).astype(np.uint32)
    out = []
    key = b
    for order in ORDERS:
        if order > 1:
            key = key[:-1] * np.uint32(0x01000193) + b[order - 1 :] if len(key) > 1 else key[:0]
        mixed = key * np.uint32(2654435761)
        out.append(np.bincount((mixed >> np.uint32(18)).astype(np.int64), minlength=BUCKETS))
    return np.concatenate(out)


def codewords(n: int) -> np.ndarray:
    """n codewords: all dichotomies up to seven languages, beyond that the best of several
    seeded random codes by least distance between codewords."""
    if n <= 1:
        return np.ones((n, 0))
    if n <= 7:
        subsets = np.arange(1, 1 << (n - 1))
        bits = (subsets[None, :] >> np.arange(n)[:, None]) & 1
        return 2.0 * bits - 1.0
    best, best_distance = None, -1
    for seed in range(64):
        code = np.random.default_rng(seed).choice([-1.0, 1.0], (n, LONG_CODE))
        apart = (LONG_CODE - code @ code.T) / 2 + LONG_CODE * np.eye(n)
        if (abs(code.sum(axis=0)) < n).all() and apart.min() > best_distance:
            best, best_distance = code, apart.min()
    return best


@dataclass(frozen=True)
class LanguageModel:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits
    reliability: np.ndarray  # languages x bits, rows add up to 1

    def margins(self, text: str) -> np.ndarray:
        counts = grams(text)
        present = np.flatnonzero(counts)
        n = counts.sum()
        return 12.0 * (counts[present] @ self.weights[present]) / (n + 40.0)

    def decide(self, text: str) -> tuple[str, float, bool]:
        """Language, share of the best codeword, and whether the runner-up is close."""
        if not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0, False
        if len(self.languages) == 1:
            return self.languages[0], 1.0, False
        loss = np.logaddexp(0.0, -self.code * self.margins(text))
        total = len(self.code[0]) * (self.reliability * loss).sum(axis=1)
        share = np.exp(total.min() - total)
        share /= share.sum()
        best = int(share.argmax())
        return self.languages[best], float(share[best]), bool(share[best] < AMBIGUOUS)


def fit_language(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> LanguageModel:
    """Classifiers from text and language of the documents outside the held-out part.

    Held out: crc32 of the id as text mod 5 is 0. Rows with a null text or language are left
    out. The driver gets n-gram counts per language, never rows.
    """
    spark = docs.sparkSession
    usable = docs.where(
        F.col("text").isNotNull() & F.col("lang").isNotNull() & (crc_mod("doc_id", 5) != 0)
    ).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    code = codewords(len(languages))
    if len(languages) < 2:
        return LanguageModel(languages, code, np.zeros((1, 0)), np.zeros((len(languages), 0)))
    limits = spark.createDataFrame(
        [(x, i, min(1.0, per_language / sizes[x])) for i, x in enumerate(languages)],
        StructType(
            [
                StructField("lang", StringType()),
                StructField("k", IntegerType()),
                StructField("share", DoubleType()),
            ]
        ),
    )
    place = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1 << 30)) / (1 << 30)
    sample = usable.join(F.broadcast(limits), "lang").where(place < F.col("share"))  # a row a language
    totals = gram_totals(sample, len(languages))
    smoothed = totals + 0.5
    weights = np.empty((totals.shape[1], code.shape[1]))
    for bit in range(code.shape[1]):
        high = smoothed[code[:, bit] > 0].sum(axis=0)
        low = smoothed[code[:, bit] < 0].sum(axis=0)
        odds = []
        for part in np.split(np.arange(totals.shape[1]), len(ORDERS)):
            odds.append(np.log(high[part] / high[part].sum()) - np.log(low[part] / low[part].sum()))
        weights[:, bit] = np.concatenate(odds)
    even = np.full(code.shape, 1.0 / code.shape[1])
    model = LanguageModel(languages, code, weights, even)
    return LanguageModel(languages, code, weights, reliabilities(sample, model))


def gram_totals(sample: DataFrame, n: int) -> np.ndarray:
    """n-gram counts of each language, added up in tasks and then by a shuffle on the bucket."""
    schema = "k int, bucket int, c long"

    def run(batches):
        sums = np.zeros((n, BUCKETS * len(ORDERS)), np.int64)
        for batch in batches:
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                sums[k] += grams(text)
        import pyarrow as pa

        ks, buckets = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ks, pa.int32()),
                pa.array(buckets, pa.int32()),
                pa.array(sums[ks, buckets], pa.int64()),
            ],
            names=["k", "bucket", "c"],
        )

    parts = sample.select("k", "text").coalesce(16).mapInArrow(run, schema)
    totals = np.zeros((n, BUCKETS * len(ORDERS)))
    packed = (
        parts.groupBy("k", "bucket")
        .agg(F.sum("c").alias("c"))
        .groupBy("k")
        .agg(F.collect_list(F.struct("bucket", "c")).alias("cs"))
    )
    for row in packed.toLocalIterator():
        for bucket, c in row["cs"]:
            totals[row["k"], bucket] = c
    return totals


def reliabilities(sample: DataFrame, model: LanguageModel) -> np.ndarray:
    """Share of a language's sample on the right side of each bit, normalised per language."""
    shared = sample.sparkSession.sparkContext.broadcast(model)  # bounded by buckets x bits

    def kernel():
        fitted = shared.value
        return lambda texts: {"m": [fitted.margins(t).tolist() for t in texts]}

    added = StructType([StructField("m", ArrayType(DoubleType()))])
    rows = (
        map_texts(sample, "text", kernel, added, ["k"])
        .select("k", F.posexplode("m").alias("bit", "m"))
        .groupBy("k", "bit")
        .agg(F.avg((F.col("m") > 0).cast("double")).alias("high"))
        .collect()
    )
    right = np.full(model.code.shape, 0.5)
    for r in rows:
        up = model.code[r["k"], r["bit"]] > 0
        right[r["k"], r["bit"]] = r["high"] if up else 1.0 - r["high"]
    right += 1e-3
    return right / right.sum(axis=1, keepdims=True)


def detect(
    df: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None
) -> DataFrame:
    """``lang_pred``, ``score`` and ``ambiguous`` of each whole text.

    A null text, one without a letter, and any text if nothing was learned: ``und``, score 0.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)  # bounded by buckets x bits
    keep = ["doc_id"] if keep is None else keep

    def kernel():
        fitted = shared.value
        settle()

        def run(texts):
            found = [fitted.decide(t) for t in texts]
            return {
                "lang_pred": [f[0] for f in found],
                "score": [f[1] for f in found],
                "ambiguous": [f[2] for f in found],
            }

        return run

    added = StructType(
        [
            StructField("lang_pred", StringType()),
            StructField("score", DoubleType()),
            StructField("ambiguous", BooleanType()),
        ]
    )
    return map_texts(df, text, kernel, added, keep)


