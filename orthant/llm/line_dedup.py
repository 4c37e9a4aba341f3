"""Line dedup by winnowing over line hashes, in DataFrame operations only.

Every window of ``window`` consecutive non-blank lines has its least line hash as fingerprint;
neighbouring windows mostly share it, so a document has fewer fingerprints than lines. A shared
run of at least ``window`` lines has the same windows, and so a common fingerprint, on both
sides. Positions are joined on the fingerprint: those whose fingerprint occurs once go. From the
others the match is extended both ways, to each window that the fingerprint stands for; windows
are compared whole (128 bits), and those that overlap join up to the repeated run. Of each
window the first occurrence, by (doc_id, text hash, position), stays; lines of later ones go.

The first and the last line of a document are windows of one line as well, so that headers and
footers are caught; they meet other first and last lines only.

Nothing is paired: windows are grouped with partial aggregation and joined back to one row a
window, so work follows the number of lines whatever the size of a group of copies.

What is left may still share passages that are one line, or stand inside lines. ``cut_passages``
winnows over words: of each window of PASSAGE words, wherever it starts, the first occurrence
stays and the words of later ones go.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orthant.llm.common import apart
from orthant.session import Scratch

#: Lines in a window: the shortest run that is certain to be found.
WINDOW = 2
#: Windows with fewer words than this are left alone.
MIN_WORDS = 3
#: A line of so many bytes has MIN_WORDS words at least, whatever it is made of.
LONG_BYTES = 100
#: Words in the shortest repeated passage that is cut out of lines, and in the pieces it is
#: winnowed by. Each passage has a fingerprint as it holds PASSAGE - PIECE + 1 pieces.
PASSAGE, PIECE = 50, 25
# White space, and letters of scripts that put none between words; each of these
# letters is a word.
SPACE = r"\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
PASSAGE_WORD = f"[{UNSPACED}]|[^{SPACE}{UNSPACED}]+"
# The range comes first, as it is quick to see that a character is not in it; it has them all.
ANY_UNSPACED = f"[\\x{{E00}}-\\x{{10FFFF}}&&[{UNSPACED}]]"


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def words_of(line: Column, least: int) -> Column:
    """How many words a line counts for: each letter of a script without spaces is one.

    The number is only compared with ``least``, so the words of long lines are not counted.
    """
    count = F.regexp_count(line, F.lit(PASSAGE_WORD))
    return F.when(F.octet_length(line) >= LONG_BYTES, F.lit(least)).otherwise(count)


def fingerprints(df: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS) -> DataFrame:
    """A row for each selected position: fp, doc_id, th (text hash), and ``ws``, the windows
    whose least line it is: hash (h1, h2, edge), start and line numbers."""
    trimmed = F.transform(
        lines_of(F.col("text")),
        lambda s, i: F.struct(i.cast("int").alias("i"), F.trim(s).alias("s")),
    )
    hashed = F.transform(
        F.filter(trimmed, lambda x: x["s"] != ""),
        lambda x: F.struct(
            x["i"].alias("i"),
            F.xxhash64(F.lit(1), x["s"]).alias("a"),
            F.xxhash64(F.lit(2), x["s"]).alias("b"),
            words_of(x["s"], min_words).alias("w"),
        ),
    )

    def a_window(start: Column, length: int, edge: bool) -> Column:
        part = F.slice("l", start + 1, F.lit(length))
        hashes = F.transform(part, lambda x: x["a"])
        least = F.array_position(hashes, F.array_min(hashes)).cast("int") - 1
        return F.struct(
            (start + least).alias("at"),
            F.lit(edge).alias("edge"),
            F.xxhash64(F.lit(3), hashes).alias("h1"),
            F.xxhash64(F.lit(4), F.transform(part, lambda x: x["b"])).alias("h2"),
            F.transform(part, lambda x: x["i"]).alias("lines"),
            F.aggregate(part, F.lit(0), lambda s, x: s + x["w"]).alias("w"),
        )

    n = F.size("l")
    every = F.when(
        n >= window,
        F.transform(F.sequence(F.lit(0), n - window), lambda i: a_window(i, window, False)),
    )
    edges = F.when(
        n > 1, F.array(a_window(F.lit(0), 1, True), a_window(n - 1, 1, True))
    ).when(n == 1, F.array(a_window(F.lit(0), 1, True)))
    rows = df.select("doc_id", F.xxhash64("text").alias("th"), hashed.alias("l"))
    # without lines es is null, and so is what is exploded; a filter would hash all lines twice
    rows = rows.select("doc_id", "th", "l", F.coalesce(every, F.array()).alias("ws"), edges.alias("es"))
    selected = F.array_distinct(
        F.concat(F.transform("ws", lambda x: x["at"]), F.transform("es", lambda x: x["at"]))
    )

    def here(at: Column) -> Column:
        """The windows with this least line; they start at most ``window`` - 1 lines before it."""
        first = F.greatest(at - (window - 1), F.lit(0))
        near = F.slice("ws", first + 1, F.lit(window))
        mine = F.filter(F.concat(near, F.col("es")), lambda x: (x["at"] == at) & (x["w"] >= min_words))
        return F.struct(F.get(F.col("l"), at)["a"].alias("fp"), mine.alias("ws"))

    return rows.select("doc_id", "th", F.explode(F.transform(selected, here)).alias("f")).select(
        F.col("f.fp").alias("fp"), "doc_id", "th", F.col("f.ws").alias("ws")
    ).where(F.size("ws") > 0)


def repeated_lines(
    df: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS, scratch: Scratch | None = None
) -> DataFrame:
    """``doc_id``, ``th`` and ``gone``: the sorted line numbers to delete of each document that
    has any. Rows that share id and text are one document."""
    scratch = scratch or Scratch(df.sparkSession, "cut")
    # written, so that the texts are worked through once
    prints = scratch.cut(fingerprints(df, window, min_words))
    shared = scratch.cut(prints.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1").drop("c"))
    met = prints.join(shared, "fp").select("doc_id", "th", F.explode("ws").alias("w"))
    met = scratch.cut(met.select("doc_id", "th", "w.edge", "w.h1", "w.h2", "w.lines").distinct())
    scratch.release()
    place = F.struct("doc_id", "th", F.get("lines", F.lit(0)).alias("i"))
    first = scratch.cut(
        met.groupBy("edge", "h1", "h2")
        .agg(F.min(place).alias("first"), F.count("*").alias("c"))
        .where("c > 1")
        .drop("c")
    )
    later = met.join(first, ["edge", "h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "th").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("lines")))).alias("gone")
    )


def without_lines(lines: Column, gone: Column) -> Column:
    """The lines but those at the sorted positions, as one text: slices between them."""
    ends = F.concat(gone, F.array(F.size(lines)))
    starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda i: i + 1))
    kept = F.flatten(
        F.zip_with(starts, ends, lambda a, b: F.slice(lines, a + 1, F.greatest(b - a, F.lit(0))))
    )
    return F.array_join(kept, "\n")


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row, also where lambdas refer to it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def over_runs(values: Column, length: int, f: Callable[[Column, Column], Column]) -> Column:
    """Each run of ``length`` values folded by f, in steps that double; the values must be as many."""

    def folded(step: int) -> Callable[[Column], Column]:
        return lambda v: F.transform(
            F.slice(v, F.lit(1), F.size(v) - step), lambda x, i: f(x, F.get(v, i + step))
        )

    done = 1
    while done < length:
        step = min(done, length - done)
        values = let(values, folded(step))
        done += step
    return values


def passage_words(text: Column) -> Column:
    """The words of a text; none for null. Without letters that are words, what stands between
    white space is the same."""
    text = F.coalesce(text, F.lit(""))
    matches = F.regexp_extract_all(text, F.lit(PASSAGE_WORD), F.lit(0))
    return F.when(text.rlike(ANY_UNSPACED), matches).otherwise(apart(text, f"[{SPACE}]+"))


def pieces_of(text: Column) -> Column:
    """Hashes of the runs of PIECE words; none where the text has fewer than PASSAGE words."""
    found = passage_words(text)
    none = F.array().cast("array<bigint>")
    return let(found, lambda w: F.when(
        F.size(w) >= PASSAGE,
        over_runs(F.transform(w, lambda x: F.xxhash64(x)), PIECE, lambda a, b: F.xxhash64(a, b)),
    ).otherwise(none))


def passage_prints(docs: DataFrame) -> DataFrame:
    """fp, doc_id, th, a, b: passages start at the words a to b whose least piece is fp.

    Pieces are ordered by the upper half of their hash and then by place, so a text that repeats
    itself has as many fingerprints as places.
    """

    def selected(pieces: Column) -> Column:
        upper = F.lit(-(1 << 32))
        keys = F.transform(pieces, lambda x, i: x.bitwiseAND(upper).bitwiseOR(i.cast("long")))
        least = over_runs(keys, PASSAGE - PIECE + 1, lambda a, b: F.least(a, b))

        def ranges(m: Column) -> Column:
            n = F.size(m)
            starts = F.filter(
                F.sequence(F.lit(0), n - 1), lambda s: (s == 0) | (F.get(m, s) != F.get(m, s - 1))
            )
            return let(starts, lambda t: F.transform(t, lambda s, j: F.struct(
                F.get(pieces, F.get(m, s).bitwiseAND(F.lit((1 << 32) - 1)).cast("int")).alias("fp"),
                s.alias("a"),
                (F.coalesce(F.get(t, j + 1), n) - 1).alias("b"),
            )))

        none = F.array().cast("array<struct<fp: bigint, a: int, b: int>>")
        return F.when(F.size(pieces) > 0, let(least, ranges)).otherwise(none)

    found = docs.select("doc_id", F.xxhash64("text").alias("th"), F.explode(let(pieces_of(F.col("text")), selected)).alias("f"))
    return found.select("f.fp", "doc_id", "th", "f.a", "f.b")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """``doc_id``, ``th`` and ``cuts``: start and end words of what to cut out of each document
    that has any, in order and apart. Rows that share id and text are one document."""
    scratch = Scratch(docs.sparkSession, "cut")
    prints = scratch.cut(passage_prints(docs))
    shared = scratch.cut(prints.groupBy("fp").agg(F.count("*").alias("c")).where("c > 1").drop("c"))
    met = prints.join(shared, "fp").groupBy("doc_id", "th").agg(
        F.collect_set(F.struct("fp", "a", "b")).alias("fs")
    ).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "fs")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))
    texts = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").join(scratch.cut(met), same)

    def windows(pieces: Column) -> Column:
        return F.flatten(F.transform("fs", lambda f: F.transform(F.sequence(f["a"], f["b"]), lambda s: F.struct(
            s.alias("s"),
            f["fp"].alias("fp"),
            F.xxhash64(F.get(pieces, s), F.get(pieces, s + (PASSAGE - PIECE))).alias("h"),
        ))))

    found = texts.select("doc_id", "th", F.explode(let(pieces_of(F.col("text")), windows)).alias("w"))
    found = scratch.cut(found.select("doc_id", "th", "w.s", "w.fp", "w.h").distinct())
    scratch.release()
    place = F.struct("doc_id", "th", "s")
    first = scratch.cut(
        found.groupBy("fp", "h").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1").drop("c")
    )
    later = found.join(first, ["fp", "h"]).where(~place.eqNullSafe(F.col("first")))
    starts = later.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("s")).alias("t"))
    apart = F.lit(PASSAGE)
    begins = F.filter("t", lambda s, j: (j == 0) | (s > F.get(F.col("t"), j - 1) + apart))
    ends = F.filter("t", lambda s, j: (j == F.size("t") - 1) | (F.get(F.col("t"), j + 1) > s + apart))
    cuts = F.zip_with(begins, ends, lambda a, b: F.struct(a.alias("a"), (b + apart).alias("b")))
    return starts.select("doc_id", "th", cuts.alias("cuts"))


def without_words(text: Column, cuts: Column) -> Column:
    """The text without the given stretches of words and the space before each of the words."""
    whole = F.regexp_extract_all(text, F.lit(f"[{SPACE}]*(?:{PASSAGE_WORD})"), F.lit(0))

    def left(w: Column) -> Column:
        starts = F.concat(F.array(F.lit(0)), F.transform(cuts, lambda c: c["b"]))
        ends = F.concat(F.transform(cuts, lambda c: c["a"]), F.array(F.size(w)))
        return F.array_join(F.flatten(F.zip_with(starts, ends, lambda a, b: F.slice(w, a + 1, b - a))), "")

    kept = F.concat(let(whole, left), F.regexp_extract(text, f"[{SPACE}]*\\z", 0))
    kept = F.when(F.get(cuts, F.lit(0))["a"] == 0, F.regexp_replace(kept, f"\\A[{SPACE}]+", "")).otherwise(kept)
    return F.when(F.regexp_replace(kept, f"[{SPACE}]+", "") == "", F.lit("")).otherwise(kept)


def cut_passages(df: DataFrame) -> DataFrame:
    """All rows and columns, ``text`` without the words of passages of PASSAGE words or more that
    occurred before, by (doc_id, text hash, position), and ``n_cut``, how many words went.

    Words are compared as they stand, whatever white space is between them; a passage may lie
    inside a line or go over several. A null text stays null.
    """
    cuts = repeated_passages(df).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), "cuts")
    cuts = cuts.withColumnRenamed("cuts", "__cuts")
    names = [c for c in df.columns if c != "n_cut"]
    rows = df.select(*[F.col(f"`{c}`") for c in names], F.xxhash64("text").alias("__key"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__th"))
    rows = rows.join(cuts, same, "left")
    none = F.col("__cuts").isNull()
    text = F.when(none, F.col("text")).otherwise(without_words(F.col("text"), F.col("__cuts")))
    gone = F.aggregate("__cuts", F.lit(0), lambda n, c: n + c["b"] - c["a"])
    return rows.select(
        *[text.alias("text") if c == "text" else F.col(f"`{c}`") for c in names],
        F.coalesce(gone, F.lit(0)).cast("long").alias("n_cut"),
    )


def dedup_text(df: DataFrame) -> DataFrame:
    """Line dedup, and then the passages that lines still share: the columns of both."""
    scratch = Scratch(df.sparkSession, "cut")
    lines = scratch.cut(dedup_lines(df, scratch=scratch))
    scratch.release()
    return cut_passages(lines)


def dedup_lines(
    df: DataFrame, window: int = WINDOW, min_words: int = MIN_WORDS, scratch: Scratch | None = None
) -> DataFrame:
    """All rows and columns, ``text`` without the lines of later repeated runs, and ``n_lines``
    and ``n_removed``.

    Lines are cut at newlines and compared without spaces at their ends; blank lines are never
    counted and stay, unless no other line is left: then the text is empty. A null text stays
    null. Null ids come first in the order; a column called n_lines or n_removed is replaced.
    """
    gone = repeated_lines(df, window, min_words, scratch).select(
        F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("gone").alias("__gone")
    )
    names = [c for c in df.columns if c not in ("n_lines", "n_removed")]
    rows = df.select(*[F.col(f"`{c}`") for c in names], F.xxhash64("text").alias("__key"))
    rows = rows.join(
        gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__th")), "left"
    )
    lines = lines_of(F.col("text"))
    short = without_lines(lines, F.col("__gone"))
    text = F.when(F.col("__gone").isNull(), F.col("text")).when(
        F.trim(F.translate(short, "\n", "")) == "", F.lit("")
    ).otherwise(short)
    kept = [text.alias("text") if c == "text" else F.col(f"`{c}`") for c in names]
    return rows.select(
        *kept,
        F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias("n_removed"),
    )
