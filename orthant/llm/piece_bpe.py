"""SentencePiece BPE encoding by backtracking, and decoding.

A row of tokens is the encoding of its text if and only if each token encodes as itself and each
two neighbours encode as those two. So the encoder goes from left to right: an Aho-Corasick
automaton gives the longest token at each place; if it does not go with the token before it,
its longest prefix that is a token is tried, and so on; if none goes, the token before is taken
back. Places from which nothing went on are marked in a bitfield and never tried again, so the
work is linear. Whether two tokens go together is found by merging their joint text again, once
a pair.

No token has a space mark behind another character. Where the model proves it, a text falls
into words with the marks before them, whose ids are remembered; a character without a token
becomes its bytes and is a border as well.
"""

from __future__ import annotations

import codecs
import re
import struct
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from orthant.llm.common import map_texts, settle

#: Words and pairs of tokens that a task remembers; each memo is emptied when it is full.
MEMO = 300_000
#: Longer words are not remembered.
MEMO_CHARS = 48
# The mark that stands for a space, and what an unknown id decodes to.
MARK = "▁"
UNKNOWN = " ⁇ "

codecs.register_error("each_byte", lambda e: ("�", e.start + 1))


@dataclass(frozen=True)
class Pieces:
    """A model: texts of all ids, scores of those that merge, ids of bytes, of begin and end."""

    texts: tuple[str, ...]
    scores: dict[str, float]
    ids: dict[str, int]
    of_byte: tuple[int, ...]
    begin: int
    end: int
    unknown: int
    sound: frozenset[str]  # tokens that encode as themselves
    by_word: bool

    @staticmethod
    def load(path: str) -> Pieces:
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        texts = tuple(model.id_to_piece(i) for i in range(size))
        plain = [
            i for i in range(size)
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))
        ]
        of_byte = tuple(model.piece_to_id(f"<0x{b:02X}>") for b in range(256))
        scores = {texts[i]: model.get_score(i) for i in plain}
        # the library shows what the model does to white space and to other forms of a character
        fits = (
            all(model.is_byte(i) for i in of_byte)
            and not any(model.is_unused(i) for i in range(size))
            and [i for i in range(size) if model.is_control(i)] == [model.bos_id(), model.eos_id()]
            and model.normalize(" ﬁ  x ") == f"{MARK}{MARK}ﬁ{MARK}{MARK}x{MARK}"
            and all(c in scores for t in scores for c in t)
        )
        if not fits:
            raise ValueError(f"{path}: only merge models with bytes, plain spaces and no normal forms are encoded")
        by_word = not any(MARK in t.lstrip(MARK) for t in scores)
        sound = frozenset(t for t in scores if merge(t, scores) == [t])
        return Pieces(
            texts, scores, {texts[i]: i for i in plain}, of_byte,
            model.bos_id(), model.eos_id(), model.unk_id(), sound, by_word,
        )


def merge(text: str, scores: dict[str, float]) -> list[str]:
    """The merges of the model, one after the other: best score first, then the leftmost."""
    parts = list(text)
    none = float("-inf")
    found = [scores.get(a + b, none) for a, b in zip(parts, parts[1:], strict=False)]
    while found and (best := max(found)) != none:
        i = found.index(best)
        parts[i] += parts.pop(i + 1)
        del found[i]
        if i:
            found[i - 1] = scores.get(parts[i - 1] + parts[i], none)
        if i < len(found):
            found[i] = scores.get(parts[i] + parts[i + 1], none)
    return parts


class Encoder(dict):
    """Packed ids by word; a word that is not there yet is encoded when it is asked for."""

    def __init__(self, pieces: Pieces):
        super().__init__()
        self.pieces = pieces
        self.automaton = ahocorasick.Automaton()
        for text in pieces.sound:
            self.automaton.add_word(text, pieces.ids[text])
        self.automaton.make_automaton()
        known = {c for t in pieces.scores for c in t}
        inside = "".join(re.escape(c) for c in sorted(known - {MARK}))
        words = f"{MARK}+[{inside}]*|[{inside}]+|." if pieces.by_word else f"[{MARK}{inside}]+|."
        self.words = re.compile(words, re.DOTALL).findall
        self.known = known
        self.length = [len(t) for t in pieces.texts]
        # by id, the longest token that is a proper prefix; -1 where there is none
        self.shorter = [self._prefix(t) for t in pieces.texts]
        self.pairs: dict[int, bool] = {}

    def _prefix(self, token: str) -> int:
        shorter = (token[:n] for n in range(len(token) - 1, 0, -1))
        return next((self.pieces.ids[t] for t in shorter if t in self.pieces.sound), -1)

    def together(self, left: int, right: int) -> bool:
        """Whether the joint text of two tokens encodes as the two; remembered by pair."""
        if len(self.pairs) >= MEMO:
            self.pairs.clear()
        pair = [self.pieces.texts[left], self.pieces.texts[right]]
        found = merge("".join(pair), self.pieces.scores) == pair
        self.pairs[left << 32 | right] = found
        return found

    def tokens(self, word: str) -> list[int]:
        """The tokens of a stretch of known characters."""
        size = len(word)
        length, shorter, pairs = self.length, self.shorter, self.pairs
        longest = [-1] * (size + 1)
        longest[size] = 0

        def look(at: int) -> int:
            """The longest token at a place; those after it are kept as far as they are new."""
            for last, token in self.automaton.iter_long(word, at):
                start = last + 1 - length[token]
                if longest[start] >= 0:
                    break
                longest[start] = token
            return longest[at]

        failed = bytearray(size // 8 + 1)
        at, left, token = 0, -1, look(0)
        out: list[int] = []
        while True:
            end = at + length[token]
            fits = not failed[end >> 3] >> (end & 7) & 1
            if fits and left >= 0:
                fits = pairs.get(left << 32 | token)
                if fits is None:
                    fits = self.together(left, token)
            if fits:
                out.append(token)
                if end == size:
                    return out
                at, left, token = end, token, longest[end]
                if token < 0:
                    token = look(at)
                continue
            token = shorter[token]
            while token < 0:
                failed[at >> 3] |= 1 << (at & 7)
                taken = out.pop()
                at -= length[taken]
                left = out[-1] if out else -1
                # the place it led to is marked, so a shorter one is next
                token = shorter[taken]

    def __missing__(self, word: str) -> bytes:
        if word[0] in self.known:
            found = self.tokens(word)
        else:
            found = [self.pieces.of_byte[b] for b in word.encode("utf-8")]
        packed = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[word] = packed
        return packed

    def encode(self, text: str) -> bytes:
        """Ids of a text with begin and end, as little-endian 32-bit integers."""
        ends = struct.pack("<I", self.pieces.begin), struct.pack("<I", self.pieces.end)
        if not text:
            return b"".join(ends)
        words = self.words(MARK + text.replace(" ", MARK))
        return b"".join([ends[0], *map(self.__getitem__, words), ends[1]])


class Decoder:
    """Texts of ids: marks are spaces, one at the front goes, and bytes join up to characters."""

    def __init__(self, pieces: Pieces):
        self.parts = [t.replace(MARK, " ").encode("utf-8") for t in pieces.texts]
        for b, i in enumerate(pieces.of_byte):
            self.parts[i] = bytes([b])
        plain = set(pieces.ids.values())
        self.marked = [i in plain and t.startswith(MARK) for i, t in enumerate(pieces.texts)]
        self.parts[pieces.unknown] = UNKNOWN.encode("utf-8")
        self.silent = {pieces.begin, pieces.end}
        for i in self.silent:
            self.parts[i] = b""

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4").tolist()
        if numbers and numbers[0] in self.silent:
            del numbers[0]
        if numbers and numbers[-1] in self.silent:
            del numbers[-1]
        if self.silent.isdisjoint(numbers):
            return self._stretch(numbers, True)
        # bytes on the two sides of a begin or end do not join up
        out, start = "", 0
        for i, number in enumerate([*numbers, next(iter(self.silent))]):
            if number in self.silent:
                out += self._stretch(numbers[start:i], start == 0 or not out)
                start = i + 1
        return out

    def _stretch(self, numbers: list[int], first: bool) -> str:
        joined = b"".join(map(self.parts.__getitem__, numbers))
        if first and numbers and self.marked[numbers[0]]:
            joined = joined[1:]
        return joined.decode("utf-8", "each_byte")


@cache
def _loaded(path: str) -> Pieces:
    return Pieces.load(path)


def encode_decode(df: DataFrame, path: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``ids`` (begin, tokens, end; little-endian 32-bit) and ``decoded`` of each whole text.

    A null or empty text has begin and end only and decodes to the empty text. Spaces and space
    marks both decode to spaces. Repeated rows are encoded each, an empty table gives none.
    ``keep`` names the columns carried over (default: doc_id); other columns, whatever they are
    called, are ignored, and kept ones must not be called ids or decoded.
    """
    keep = ["doc_id"] if keep is None else keep
    clash = sorted(set(keep) & {"ids", "decoded"})
    if clash:
        raise ValueError(f"columns {clash} would be ambiguous")
    shared = df.sparkSession.sparkContext.broadcast(_loaded(path))  # bounded by the vocabulary

    def kernel():
        encoder, decoder = Encoder(shared.value), Decoder(shared.value)
        settle()

        def apply(texts: list[str]) -> dict[str, list]:
            ids = [encoder.encode(t) for t in texts]
            return {"ids": ids, "decoded": [decoder.decode(i) for i in ids]}

        return apply

    added = StructType([StructField("ids", BinaryType()), StructField("decoded", StringType())])
    return map_texts(df, text, kernel, added, keep)
