"""Byte-level BPE encoding and decoding by transducers.

Encoding. Let e(p) be the BPE tokens of a byte string p. Two facts make a transducer possible
where every vocabulary token encodes as itself: the tokens of a prefix never depend on what lies
left of a token border, and a sequence is an encoding exactly if each adjacent pair encodes as
itself. So a prefix has one last token, and a configuration after reading p is the set of its
open hypotheses: a token is under way (a trie node) since an earlier border, after the last token
up to that border. The output of a configuration is the last token of the prefix read; read from
the end, each such token leads to the border before it, and those on the way are the encoding.
Configurations are numbered as they are met and their moves are kept (lazy determinisation); the
table is emptied when it is full, as the current configuration can be entered again at any time.

Decoding. An incremental UTF-8 state machine, lifted from bytes to tokens: for each of its
states a table has the state after a whole token, so a stream of ids steps once per token.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

from orthant.llm.common import map_texts, settle

#: Moves and configurations kept by a task before its tables are emptied.
MOVES = 900_000
#: Whole pieces remembered by a task, each of at most 48 characters.
MEMO = 400_000
#: Above any rank.
NONE = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        pairs = (line.split() for line in file)
        return {base64.b64decode(token): int(rank) for token, rank in pairs}


def bpe(piece: bytes, ranks: dict[bytes, int], least: int = 1) -> list[bytes]:
    """Plain merging, lowest rank first, until ``least`` parts are left; used on tokens and pairs
    of tokens only."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    found = [ranks.get(a + b, NONE) for a, b in zip(parts, parts[1:], strict=False)]
    while len(parts) > least and (rank := min(found)) != NONE:
        i = found.index(rank)
        parts[i] += parts.pop(i + 1)
        del found[i]
        if i:
            found[i - 1] = ranks.get(parts[i - 1] + parts[i], NONE)
        if i < len(found):
            found[i] = ranks.get(parts[i] + parts[i + 1], NONE)
    return parts


@dataclass(frozen=True)
class Trie:
    """Vocabulary trie over the tokens that encode as themselves.

    Nodes are multiples of 256, so that node + byte is the key of a child. By node number,
    ``token`` has the id that ends there or -1, and ``inner`` whether there are children.
    ``halves`` has the two ids that a token is merged from; it is None where one of them may be
    merged later than the token's rank says.
    """

    child: dict[int, int]
    token: list[int]
    inner: bytes
    halves: dict[int, tuple[int, int]] | None

    @staticmethod
    def build(ranks: dict[bytes, int]) -> Trie:
        child: dict[int, int] = {}
        token = [-1]
        halves: dict[int, tuple[int, int]] = {}
        for text, rank in ranks.items():
            parts = bpe(text, ranks, 2)
            if len(parts) > 2:
                continue
            if len(parts) == 2:
                halves[rank] = ranks[parts[0]], ranks[parts[1]]
            node = 0
            for byte in text:
                key = node + byte
                node = child.get(key)
                if node is None:
                    node = child[key] = len(token) << 8
                    token.append(-1)
            token[node >> 8] = rank
        inner = bytearray(len(token))
        for key in child:
            inner[key >> 8] = 1
        ordered = all(half < rank or half not in halves for rank, two in halves.items() for half in two)
        return Trie(child, token, bytes(inner), halves if ordered else None)


#: A hypothesis is its trie node times 2^32, and one more than the id before it.
LAST = (1 << 32) - 1


class Transducer:
    """Bytes in, token ids out: one reading from the left, and one of its outputs from the end.

    A configuration is a tuple of hypotheses, the longest under way first; the last one always
    stands at the root, after the last token of the prefix read, which is ``output``. A move is
    the number of the next configuration.
    """

    def __init__(self, ranks: dict[bytes, int], trie: Trie, bytes_of: list[bytes]):
        self.ranks, self.trie, self.bytes_of = ranks, trie, bytes_of
        self.lengths = [len(token) for token in bytes_of]
        self.reset()

    def reset(self) -> None:
        self.configs: list[tuple[int, ...]] = []
        self.output: list[int] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.moves: dict[int, int] = {}
        self.number((0,))

    def fits(self, left: int, right: int) -> bool:
        """Whether the two tokens, side by side, encode as themselves.

        Where merges go by rank, the tokens at the border are taken apart in reverse order, and no
        two that stood there side by side may have a merge that comes before the next one done.
        """
        ranks, bytes_of, halves = self.ranks, self.bytes_of, self.trie.halves
        if halves is None:
            a, b = bytes_of[left], bytes_of[right]
            return bpe(a + b, ranks) == [a, b]
        before = NONE
        a, b = halves.get(left), halves.get(right)
        while True:
            if ranks.get(bytes_of[left] + bytes_of[right], NONE) < before:
                return False
            if a is not None and (b is None or left > right):
                before, left = left, a[1]
                a = halves.get(left)
            elif b is not None:
                # of equal ranks the merge on the left is done first
                before, right = right + 1, b[0]
                b = halves.get(right)
            else:
                return True

    def number(self, config: tuple[int, ...]) -> int:
        found = self.numbers.get(config)
        if found is None:
            found = self.numbers[config] = len(self.configs)
            self.configs.append(config)
            self.output.append((config[-1] & LAST) - 1)
        return found

    def step(self, state: int, byte: int) -> int:
        """Build the move from a state on a byte."""
        child, token, inner = self.trie.child.get, self.trie.token, self.trie.inner
        alive, done = [], -1
        for open_ in self.configs[state]:
            node = child((open_ >> 32) + byte)
            if node is None:
                continue
            place, last = node >> 8, open_ & LAST
            if done < 0 and (ended := token[place]) >= 0 and (not last or self.fits(last - 1, ended)):
                done = ended
            if inner[place]:
                alive.append(node << 32 | last)
        if done < 0:
            raise ValueError("a byte of the input has no token")
        alive.append(done + 1)
        move = self.moves[state << 8 | byte] = self.number(tuple(alive))
        return move

    def encode(self, data: bytes) -> list[int]:
        state, move_of, output = 0, self.moves.get, self.output
        ends: list[int] = []
        for byte in data:
            move = move_of(state << 8 | byte)
            if move is None:
                if len(self.configs) + len(self.moves) >= MOVES:
                    here = self.configs[state]
                    self.reset()
                    state, move_of, output = self.number(here), self.moves.get, self.output
                move = self.step(state, byte)
            state = move
            ends.append(output[state])
        out: list[int] = []
        i, lengths = len(ends), self.lengths
        while i:
            token = ends[i - 1]
            out.append(token)
            i -= lengths[token]
        out.reverse()
        return out


def ranges(kind: str, chars: str) -> str:
    """The characters of one kind, as the inside of a bracket of ``re``."""
    runs = (run.group() for run in regex.finditer(kind + "+", chars))
    return "".join(f"\\U{ord(run[0]):08x}-\\U{ord(run[-1]):08x}" for run in runs)


def plain_pattern(top: int) -> Callable[[str], list[str]]:
    """``findall`` of public_tokenizers.PATTERN for texts of characters below ``top``, by ``re``,
    which is faster with short brackets. What a character is, ``regex`` tells."""
    chars = "".join(map(chr, (c for c in range(top) if not 0xD800 <= c < 0xE000)))
    letter, digit, space = (ranges(kind, chars) for kind in (r"\p{L}", r"\p{N}", r"\s"))
    return re.compile(
        f" ?[{letter}]++|'(?:[stmd]|re|ve|ll)| ?[{digit}]++| ?[^{letter}{digit}{space}]++"
        f"|[{space}]+(?![^{space}])|[{space}]+"
    ).findall


def pieces_of(pattern: str) -> Callable[[str], list[str]]:
    """The matches of the pattern in a text."""
    anywhere = regex.compile(pattern).findall
    if pattern != public_tokenizers.PATTERN:
        return anywhere
    ascii_only, two_bytes = plain_pattern(0x80), plain_pattern(0x10000)

    def pieces(text: str) -> list[str]:
        if text.isascii():
            return ascii_only(text)
        if len(text.encode("utf-16-le", "surrogatepass")) == 2 * len(text):
            return two_bytes(text)
        return anywhere(text)

    return pieces


class Encoder(dict):
    """Texts to ids: cut by the pattern, each piece through the transducer.

    As a dictionary it holds the packed ids of whole pieces; one that is not there yet is encoded
    when it is asked for.
    """

    def __init__(self, ranks: dict[bytes, int], trie: Trie, pattern: str):
        super().__init__()
        bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            bytes_of[rank] = token
        self.ranks, self.transducer = ranks, Transducer(ranks, trie, bytes_of)
        self.pieces = pieces_of(pattern)

    def __missing__(self, piece: str) -> bytes:
        data = piece.encode("utf-8")
        whole = self.ranks.get(data)
        ids = [whole] if whole is not None else self.transducer.encode(data)
        packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 48:
            if len(self) >= MEMO:
                self.clear()
            self[piece] = packed
        return packed

    def text(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.__getitem__, self.pieces(text)))


# States of the UTF-8 machine.
READY, NEED1, NEED2, NEED3, AFTER_E0, AFTER_ED, AFTER_F0, AFTER_F4, BAD = range(9)


def utf8_table() -> np.ndarray:
    """next[state, byte] of the machine that accepts well-formed UTF-8."""
    table = np.full((9, 256), BAD, dtype=np.uint8)
    table[READY, :0x80] = READY
    table[READY, 0xC2:0xE0] = NEED1
    table[READY, 0xE0:0xF0] = NEED2
    table[READY, 0xE0], table[READY, 0xED] = AFTER_E0, AFTER_ED
    table[READY, 0xF1:0xF4] = NEED3
    table[READY, 0xF0], table[READY, 0xF4] = AFTER_F0, AFTER_F4
    table[NEED1, 0x80:0xC0] = READY
    table[NEED2, 0x80:0xC0] = NEED1
    table[NEED3, 0x80:0xC0] = NEED2
    table[AFTER_E0, 0xA0:0xC0] = NEED1
    table[AFTER_ED, 0x80:0xA0] = NEED1
    table[AFTER_F0, 0x90:0xC0] = NEED2
    table[AFTER_F4, 0x80:0x90] = NEED2
    return table


class Decoder:
    """Ids to bytes and text, as a stream: ``feed`` may be called with any part of the ids."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values(), default=-1) + 1
        self.bytes_of = [b""] * size
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.table = table = utf8_table()
        self.after = np.full((9, size), BAD, dtype=np.uint8)
        longest = max(map(len, self.bytes_of), default=0)
        padded = np.zeros((size, longest), np.uint8)
        lengths = np.array([len(t) for t in self.bytes_of], np.int64)
        for rank, token in enumerate(self.bytes_of):
            padded[rank, : len(token)] = np.frombuffer(token, np.uint8)
        for state in range(8):
            at = np.full(size, state, np.uint8)
            for i in range(longest):
                at = np.where(i < lengths, table[at, padded[:, i]], at)
            self.after[state] = at
        self.clean = self.after[READY] == READY
        self.reset()

    def reset(self) -> None:
        self.state, self.tail = READY, b""

    def feed(self, ids: np.ndarray, end: bool = False, text: bool = True) -> tuple[bytes, str]:
        """The bytes of the ids, and the text whose code points are complete so far.

        Ill-formed bytes become U+FFFD, also a code point still open at the end. Without
        ``text`` only the bytes are made; the machine goes on all the same.
        """
        data = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        state = self._walk(ids)
        if state == READY and not text:
            self.state, self.tail = READY, b""
            return data, ""
        whole = self.tail + data
        cut = len(whole)
        if state == BAD:
            cut, state = self._cut(whole)
        elif state != READY:
            cut, _ = self._cut(whole)
        if end:
            cut, state = len(whole), READY
        self.state, self.tail = state, whole[cut:]
        return data, whole[:cut].decode("utf-8", "replace") if text else ""

    def _walk(self, ids: np.ndarray) -> int:
        """The state after the ids. Single steps only where a token begins or ends inside a
        code point; elsewhere the state stays READY."""
        state = self.state
        if state == READY and self.clean[ids].all():
            return READY
        dirty = np.flatnonzero(~self.clean[ids])
        i = 0 if state != READY else int(dirty[0])
        while i < len(ids) and state != BAD:
            state = int(self.after[state, ids[i]])
            i += 1
            if state == READY:
                k = np.searchsorted(dirty, i)
                i = int(dirty[k]) if k < dirty.size else len(ids)
        return state

    def _cut(self, data: bytes) -> tuple[int, int]:
        """Where an unfinished but so far well-formed code point begins, and its state."""
        for n in range(min(3, len(data)), 0, -1):
            state = READY
            for byte in data[-n:]:
                state = self.table[state, byte]
            if state not in (READY, BAD) and data[-n] >= 0xC2:
                return len(data) - n, int(state)
        return len(data), READY


@cache
def _loaded(path: str) -> tuple[dict[bytes, int], Trie]:
    ranks = load_ranks(path)
    return ranks, Trie.build(ranks)


def encode_decode(
    df: DataFrame,
    path: str,
    pattern: str = public_tokenizers.PATTERN,
    text: str = "text",
    keep: list[str] | None = None,
    decode: bool = True,
) -> DataFrame:
    """``ids`` (little-endian unsigned 32-bit, packed) of each whole text and, where asked,
    ``decoded``: the bytes that the streaming decoder makes of them.

    Null and empty texts have no ids. Repeated rows are encoded each. Special tokens are never
    produced. ``keep`` names the columns carried over; others are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(_loaded(path))  # bounded by the vocabulary
    keep = ["doc_id"] if keep is None else keep

    def kernel():
        ranks, trie = shared.value
        settle()
        encoder = Encoder(ranks, trie, pattern)
        decoder = Decoder(ranks) if decode else None

        def run(texts):
            ids = [encoder.text(t) for t in texts]
            if decoder is None:
                return {"ids": ids}
            out = []
            for packed in ids:
                decoder.reset()
                out.append(decoder.feed(np.frombuffer(packed, dtype="<u4"), end=True, text=False)[0])
            return {"ids": ids, "decoded": out}

        return run

    fields = [StructField("ids", BinaryType())]
    if decode:
        fields.append(StructField("decoded", BinaryType()))
    return map_texts(df, text, kernel, StructType(fields), keep)
