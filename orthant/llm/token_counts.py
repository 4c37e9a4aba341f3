"""Token counts by the whole-token shortcut.

Most pieces that the pre-tokenizer cuts are themselves one token. Being in the vocabulary is
not enough for that: merges may stop short of a vocabulary string. So each vocabulary string is
put through the merges once, on the driver, and the strings that come out as one token form the
*proven* set. A piece in the set counts 1 without any merging; only the rest is merged.

The proven set and the merge table grow with the vocabulary file, not with the data.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter
from dataclasses import dataclass
from functools import cache

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from orthant.llm.common import map_texts, settle

#: Merged pieces that a task remembers; the memo is emptied when it is full.
MEMO = 400_000
#: Above any rank.
NONE = 1 << 60

# Fixed value: the split of the byte-level pre-tokenizer.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: itself if printable, else one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


@dataclass(frozen=True)
class Vocabulary:
    """A byte-level BPE file: merge ranks, ids, and the added tokens matched before the split."""

    ranks: dict[tuple[str, str], int]
    ids: dict[str, int]
    added: tuple[str, ...]

    @staticmethod
    def load(path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, split = spec["model"], spec["pre_tokenizer"]
        plain = (
            model["type"] == "BPE"
            and split["type"] == "ByteLevel"
            and split["use_regex"]
            and not split["add_prefix_space"]
            and spec["normalizer"] is None
            and not model.get("ignore_merges")
            and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"])
        )
        if not plain:
            raise ValueError(f"{path}: only plain byte-level BPE files are counted")
        merges = (tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"])
        added = tuple(t["content"] for t in spec["added_tokens"])
        return Vocabulary({m: i for i, m in enumerate(merges)}, model["vocab"], added)


def merge(symbols: str, ranks: dict[tuple[str, str], int]) -> int:
    """How many tokens the merges leave of a string of byte characters.

    Short strings look for the lowest rank in a list. In long ones a heap holds the adjacent
    pairs by (rank, place), so that n bytes take n log n.
    """
    n = len(symbols)
    if n <= 64:
        parts = list(symbols)
        found = [ranks.get(pair, NONE) for pair in zip(parts, parts[1:], strict=False)]
        while found and (rank := min(found)) != NONE:
            i = found.index(rank)
            parts[i] += parts.pop(i + 1)
            del found[i]
            if i:
                found[i - 1] = ranks.get((parts[i - 1], parts[i]), NONE)
            if i < len(found):
                found[i] = ranks.get((parts[i], parts[i + 1]), NONE)
        return len(parts)
    part, after, before = list(symbols), [*range(1, n), -1], [*range(-1, n - 1)]
    heap = [
        (rank, i, pair)
        for i in range(n - 1)
        if (rank := ranks.get(pair := (part[i], part[i + 1]))) is not None
    ]
    heapq.heapify(heap)
    left = n
    while heap:
        _, i, pair = heapq.heappop(heap)
        j = after[i] if part[i] else -1
        if j < 0 or (part[i], part[j]) != pair:
            continue
        part[i] += part[j]
        part[j] = ""
        left -= 1
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
        for a, b in ((before[i], i), (i, k)):
            if a >= 0 and b >= 0:
                rank = ranks.get(pair := (part[a], part[b]))
                if rank is not None:
                    heapq.heappush(heap, (rank, a, pair))
    return left


def prove(vocabulary: Vocabulary) -> frozenset[str]:
    """The vocabulary strings, as text, that the merges turn into exactly one token.

    A string that is no whole UTF-8 text can never be a piece and is left out.
    """
    byte_of = {c: b for b, c in enumerate(byte_alphabet())}
    proven = set()
    for token in vocabulary.ids:
        if all(c in byte_of for c in token) and merge(token, vocabulary.ranks) == 1:
            try:
                proven.add(bytes(byte_of[c] for c in token).decode("utf-8"))
            except UnicodeDecodeError:
                continue
    return frozenset(proven)


class Counting:
    """Counts the tokens of texts; holds what one task needs."""

    def __init__(self, vocabulary: Vocabulary, proven: frozenset[str]):
        self.ranks = vocabulary.ranks
        self.alphabet = byte_alphabet()
        self.memo: dict[str, int] = {}
        self.proven = proven
        self.pieces = regex.compile(BYTE_LEVEL).findall
        longest_first = sorted(filter(None, vocabulary.added), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, longest_first)) or r"(?!)")

    def merged(self, piece: str) -> int:
        found = self.memo.get(piece)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = merge("".join(self.alphabet[b] for b in piece.encode("utf-8")), self.ranks)
            if len(piece) <= 64:
                self.memo[piece] = found
        return found

    def text(self, text: str) -> int:
        """Added tokens count 1 each; what lies between them is split and counted."""
        total, start = 0, 0
        for match in self.added.finditer(text):
            total += 1 + self.plain(text[start : match.start()])
            start = match.end()
        return total + self.plain(text[start:] if start else text)

    def plain(self, text: str) -> int:
        proven, total = self.proven, 0
        for piece in self.pieces(text):
            total += 1 if piece in proven else self.merged(piece)
        return total


@cache
def _loaded(path: str) -> tuple[Vocabulary, frozenset[str]]:
    vocabulary = Vocabulary.load(path)
    return vocabulary, prove(vocabulary)


def token_counts(
    df: DataFrame, path: str, text: str = "text", limit: int = 512, keep: list[str] | None = None
) -> DataFrame:
    """``n_bytes``, ``n_tokens`` and ``over_limit`` (n_tokens > limit) of each whole text.

    Null and empty texts count 0. Repeated rows are counted each. ``keep`` names the columns
    carried over (default: doc_id); other columns, whatever they are called, are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(_loaded(path))  # bounded by the vocabulary
    keep = ["doc_id"] if keep is None else keep

    def kernel():
        counting = Counting(*shared.value)
        settle()
        return lambda texts: {
            "n_bytes": [len(t.encode("utf-8")) for t in texts],
            "n_tokens": [counting.text(t) for t in texts],
        }

    added = StructType([StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])
    counted = map_texts(df, text, kernel, added, keep)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def piece_profile(text: str, path: str) -> Counter:
    """How many pieces of a text were counted directly and how many were merged."""
    vocabulary, proven = _loaded(path)
    counting = Counting(vocabulary, proven)
    return Counter("direct" if p in proven else "merged" for p in counting.pieces(text))
