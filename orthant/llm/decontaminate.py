"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

Test items are cut into windows of consecutive words. The corpus frequency of each test term is
counted over all documents, and every window is filed under its rarest term. The index keeps the
postings (document, position) of these terms, with the windows that pass when the lists of
their other terms are intersected at the offset: each posting looks at the words around it, so
lists of frequent words are never shuffled. For a phrase all words must stand in order; for a
proximity match a stretch of a few words more than the window's own must hold them all, as often
as the window has them, in any order.

The windows are broadcast in blocks of at most BLOCK of them; a larger benchmark takes several
passes over the documents, and never a larger broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthant.llm.common import apart, ascii_lower, cut

#: Words in a window. An item with fewer words, but not none, is one window.
WINDOW = 10
#: Windows in a broadcast, about 200 bytes each.
BLOCK = 100_000
#: Words in a stretch of a document that a posting looks around in, without the margins.
STRETCH = 64
# Fixed value: what a word is made of, after A-Z are lower-cased.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# What stands between words, in lower-cased texts and in texts as they stand.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_ANY = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    return apart(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN)


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``phrase`` (array of words) and ``items`` (the ids, as strings, that hold it)."""
    w = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words(F.col("text")).alias("w"))
    last = F.greatest(F.size("w") - window, F.lit(0))
    phrases = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("w", i + 1, window))
    return (
        w.where(F.size("w") > 0)
        .select("item", F.explode(phrases).alias("phrase"))
        .groupBy("phrase")
        .agg(F.collect_set("item").alias("items"))
    )


def filed_windows(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """``term`` and ``files``: for each rarest term the windows filed under it.

    Windows with a term that no document has are dropped: they cannot occur.
    """
    at = phrases.select("phrase", "items", F.posexplode("phrase").alias("o", "term"))
    terms = phrases.select(F.explode("phrase").alias("term")).distinct()
    seen = (
        docs.select(F.explode(words(F.col("text"))).alias("term"))
        .join(F.broadcast(terms), "term", "left_semi")  # at most BLOCK * window terms
        .groupBy("term")
        .agg(F.count("*").alias("n"))
    )
    rated = at.join(F.broadcast(seen), "term", "left")  # a row a test term
    whole = rated.groupBy("phrase", "items").agg(
        F.count("n").alias("known"), F.min(F.struct("n", "o", "term")).alias("rarest")
    )
    return (
        whole.where(F.col("known") == F.size("phrase"))
        .select("rarest.term", F.struct(F.col("rarest.o").alias("o"), "phrase", "items").alias("f"))
        .groupBy("term")
        .agg(F.collect_list("f").alias("files"))
    )


def stretches(docs: DataFrame, margin: int) -> DataFrame:
    """doc_id, th, base and ``w``: stretches of STRETCH words, with ``margin`` more on each side
    where the document has them. ``base`` is the position of the stretch's first own word, and
    ``lead`` how many words stand before it. However long a document is, a row is short."""
    w = docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("w"))
    every = F.sequence(F.lit(0), F.greatest(F.size("w") - 1, F.lit(0)), F.lit(STRETCH))
    bases = F.filter(every, lambda base: base < F.size("w"))

    def one(base: Column) -> Column:
        lead = F.least(base, F.lit(margin))
        part = F.slice("w", base - lead + 1, lead + STRETCH + margin)
        return F.struct(base.alias("base"), lead.alias("lead"), part.alias("w"))

    # a filter on their number would have the words worked out twice
    cut_up = w.select("doc_id", "th", F.explode(F.transform(bases, one)).alias("s"))
    return cut_up.select("doc_id", "th", "s.base", "s.lead", "s.w")


def index_matches(docs: DataFrame, files: DataFrame, window: int, slop: int | None = None) -> DataFrame:
    """Postings of the filed terms with at least one match: doc_id, th, and ``found``, an array
    of (start, end, items).

    Without ``slop`` a match is the exact phrase. With it, a match is the first stretch of len +
    slop words (fewer where the document ends) that holds the posting and all words of the window,
    each as often as the window has it.
    """
    around = stretches(docs, window - 1 + (slop or 0))
    posted = around.select("doc_id", "th", "base", "lead", "w", F.posexplode("w").alias("q", "term"))
    own = (F.col("q") >= F.col("lead")) & (F.col("q") < F.col("lead") + STRETCH)
    posted = posted.where(own).join(F.broadcast(files), "term")  # at most BLOCK windows
    where_in = F.col("q")

    def length(f: Column) -> Column:
        return F.size(f["phrase"]) + (slop or 0)

    def holds_all(f: Column, start: Column) -> Column:
        part = F.slice("w", start + 1, length(f))

        def times(words_: Column, t: Column) -> Column:
            return F.size(F.filter(words_, lambda x: x == t))

        return F.forall(f["phrase"], lambda t: times(part, t) >= times(f["phrase"], t))

    def start(f: Column) -> Column:
        if slop is None:
            return where_in - f["o"]
        first = F.greatest(where_in - length(f) + 1, F.lit(0))
        fit = F.filter(F.sequence(first, where_in), lambda s: holds_all(f, s))
        return F.coalesce(F.get(fit, F.lit(0)), F.lit(-1))

    def end(f: Column) -> Column:
        if slop is None:
            return where_in - f["o"] + F.size(f["phrase"])
        return F.least(start(f) + length(f), F.size("w"))

    def there(f: Column) -> Column:
        if slop is None:
            stretch = F.slice("w", F.greatest(start(f), F.lit(0)) + 1, end(f) - start(f))
            return (start(f) >= 0) & (stretch == f["phrase"])
        # most postings lack a word altogether
        reach = F.greatest(where_in - length(f) + 1, F.lit(0))
        near = F.slice("w", reach + 1, 2 * length(f))
        return (F.size(F.array_except(f["phrase"], near)) == 0) & (start(f) >= 0)

    shift = F.col("base") - F.col("lead")
    found = F.transform(
        F.filter("files", there),
        lambda f: F.struct(
            (shift + start(f)).alias("start"), (shift + end(f)).alias("end"), f["items"].alias("items")
        ),
    )
    return posted.where(F.exists("files", there)).select("doc_id", "th", found.alias("found"))


def _in_blocks(docs: DataFrame, items: DataFrame, window: int, slop: int | None) -> DataFrame:
    phrases = cut(windows_of(items, window))
    blocks = -(-phrases.count() // BLOCK)
    out = None
    for block in range(max(1, blocks)):
        part = phrases.where(F.pmod(F.xxhash64("phrase"), F.lit(max(1, blocks))) == block)
        files = cut(filed_windows(docs, part))
        matches = index_matches(docs, files, window, slop)
        out = matches if out is None else out.unionByName(matches)
    return out


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document.

    Words in any occurrence of a window are hit; overlaps count once. Null and empty texts have
    no words and are clean, as is everything where the benchmark is empty. Null item ids count
    as one item named null. Repeated rows get the same result each; other columns are ignored.
    """
    matches = _in_blocks(docs, items, window, None)
    spans = F.array_sort(F.array_distinct(F.flatten(F.collect_list("found"))))
    nothing = F.struct(F.lit(0).alias("n"), F.lit(0).alias("reached"))

    def add(state: Column, s: Column) -> Column:
        return F.struct(
            (state["n"] + F.greatest(s["end"] - F.greatest(s["start"], state["reached"]), F.lit(0))).alias("n"),
            F.greatest(state["reached"], s["end"]).alias("reached"),
        )

    hits = (
        matches.groupBy("doc_id", "th")
        .agg(spans.alias("s"))
        .select(
            F.col("doc_id").alias("__id"),
            F.col("th").alias("__th"),
            F.aggregate("s", nothing, add)["n"].cast("long").alias("hit"),
            F.array_sort(F.array_distinct(F.flatten(F.transform("s", lambda x: x["items"])))).alias("items"),
        )
    )
    counted = docs.select(
        "doc_id",
        F.xxhash64("text").alias("th"),
        # upper case does not change the number
        F.size(apart(F.coalesce("text", F.lit("")), BETWEEN_ANY)).cast("long").alias("n_words"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))
    n_hit = F.coalesce("hit", F.lit(0).cast("long"))
    items_ = F.coalesce("items", F.array().cast("array<string>"))
    return counted.join(hits, same, "left").select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items_).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def proximity_matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 5) -> DataFrame:
    """doc_id, start, end and item_id (string): for each place of a window's rarest term the first
    stretch of ``slop`` words more than the window that holds it and all the window's words, each as
    often as the window has it, in any order.

    Null and empty texts match nothing, nor does anything where a table is empty. Null item ids
    are one item named null. Equal results are one row, so repeated rows count once; other columns
    are ignored.
    """
    found = _in_blocks(docs, items, window, slop).select("doc_id", F.explode("found").alias("f"))
    return found.select("doc_id", "f.start", "f.end", F.explode("f.items").alias("item_id")).distinct()


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, in which no window of the benchmark occurs."""
    matches = _in_blocks(docs, items, window, None).select(
        F.col("doc_id").alias("__id"), F.col("th").alias("__th")
    )
    keyed = docs.withColumn("__key", F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__th"))
    return keyed.join(matches.distinct(), same, "left_anti").drop("__key")


DECONTAMINATION_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i + 1:i + 10], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.p = bw.p AND dw.n = bw.n),
h AS (
  SELECT doc_id, count(DISTINCT pos) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM m) GROUP BY doc_id),
t AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
