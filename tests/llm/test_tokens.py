import hashlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from orthant.llm import bpe, token_counts
from orthant.llm.queries import RANK_FILE, TOKEN_FILE, round_trip

SAMPLES = [
    "",
    "plain words, and 12345 numbers",
    "<|endoftext|>a<|endoftext|> b <|endoftext",
    " \n\n  x　y 北京 naïve 🙂🙂 ١٢٣ \x00\x7f",
    "a" * 3000,
    "don't we'll I'm they've   trailing  ",
    "ß" * 700 + "é",
]


@pytest.fixture(scope="module")
def counting():
    return token_counts.Counting(*token_counts._loaded(public_tokenizers.path(TOKEN_FILE)))


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(TOKEN_FILE))


@pytest.fixture(scope="module")
def coder():
    ranks, trie = bpe._loaded(public_tokenizers.path(RANK_FILE))
    tool = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    return bpe.Encoder(ranks, trie, public_tokenizers.PATTERN), bpe.Decoder(ranks), tool


def test_counts_match_the_library(counting, library):
    expected = [len(e.ids) for e in library.encode_batch(SAMPLES, add_special_tokens=False)]
    assert [counting.text(t) for t in SAMPLES] == expected


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_counts_of_any_text(counting, library, text):
    assert counting.text(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_proven_strings_are_one_token(library):
    _, proven = token_counts._loaded(public_tokenizers.path(TOKEN_FILE))
    some = sorted(proven)[::97]
    pieces = library.encode_batch(some, add_special_tokens=False, is_pretokenized=False)
    for text, coded in zip(some, pieces, strict=True):
        if len(token_counts.regex.findall(token_counts.BYTE_LEVEL, text)) == 1:
            assert len(coded.ids) == 1, text


def test_both_ways_to_merge_agree():
    ranks = token_counts._loaded(public_tokenizers.path(TOKEN_FILE))[0].ranks
    word = "abcabcabdtheatherein" * 3
    long = word * 2
    assert len(word) <= 64 < len(long)
    parts, total = list(long), len(long)
    while True:
        pairs = [(ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:], strict=False))]
        rank, i = min(pairs)
        if rank == 1 << 60:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        total -= 1
    assert token_counts.merge(long, ranks) == total


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(coder, text):
    encoder, decoder, tool = coder
    ids = np.frombuffer(encoder.text(text), "<u4")
    assert ids.tolist() == tool.encode_ordinary(text)
    decoder.reset()
    assert decoder.feed(ids, end=True) == (text.encode(), text)


def test_samples_and_small_tables(coder, monkeypatch):
    encoder, _, tool = coder
    monkeypatch.setattr(bpe, "MOVES", 50)
    monkeypatch.setattr(bpe, "MEMO", 5)
    for text in SAMPLES:
        assert np.frombuffer(encoder.text(text), "<u4").tolist() == tool.encode_ordinary(text)


def test_new_words_need_no_merging(coder, monkeypatch):
    """Each pair of tokens that met was merged from its bytes again, and configurations held all
    ids since the last common one, so that hardly one came up twice."""
    encoder, _, tool = coder
    made = bpe.Encoder(encoder.ranks, encoder.transducer.trie, public_tokenizers.PATTERN)
    monkeypatch.setattr(bpe, "bpe", None)
    rng = np.random.default_rng(3)
    parts = ["tion", "ing", "the", "os", "ción", "ra", "h", "ñ", "er", "ll"]
    text = " ".join("".join(rng.choice(parts, rng.integers(1, 7))) for _ in range(3000))
    assert np.frombuffer(made.text(text), "<u4").tolist() == tool.encode_ordinary(text)
    assert len(made.transducer.configs) < 4000


@pytest.mark.parametrize("ordered", [True, False])
def test_small_vocabularies_in_any_order(ordered):
    rng = np.random.default_rng(5)
    for _ in range(40):
        tokens = [b"a", b"b", b"c"]
        while len(tokens) < 14:
            new = b"".join(tokens[i] for i in rng.integers(0, len(tokens), 2))
            tokens += [new] if new not in tokens else []
        order = range(14) if ordered else rng.permutation(14).tolist()
        ranks = {t: int(r) for t, r in zip(tokens, order, strict=True)}
        trie, names = bpe.Trie.build(ranks), {r: t for t, r in ranks.items()}
        assert trie.halves is not None or not ordered
        machine = bpe.Transducer(ranks, trie, [names[i] for i in range(14)])
        for _ in range(40):
            data = bytes(rng.choice(list(b"abc"), rng.integers(0, 30)).tolist())
            assert [names[i] for i in machine.encode(data)] == bpe.bpe(data, ranks) if data else True


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=40))
def test_pieces_of_any_text(text):
    """Three ways to cut a text, by the characters in it; they cut alike."""
    own = bpe.regex.compile(public_tokenizers.PATTERN).findall
    pieces = bpe.pieces_of(public_tokenizers.PATTERN)
    for t in (text, text.encode("ascii", "ignore").decode(), f"{text} \x1c\x85's  '{text}\U0001d400"):
        assert pieces(t) == own(t)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50_000), max_size=30), st.integers(1, 7))
def test_streaming_decode_of_any_ids(coder, ids, step):
    _, decoder, tool = coder
    decoder.reset()
    ids = np.array(ids, np.uint32)
    parts = [decoder.feed(ids[i : i + step]) for i in range(0, len(ids), step)]
    parts.append(decoder.feed(ids[:0], end=True))
    assert b"".join(p[0] for p in parts) == tool.decode_bytes(ids.tolist())
    assert "".join(p[1] for p in parts) == tool.decode_bytes(ids.tolist()).decode("utf-8", "replace")


def test_tables(spark, coder, library):
    _, _, tool = coder
    rows = [(i, t, "x") for i, t in enumerate(SAMPLES)] + [(90, None, "x"), (0, "", "y"), (None, "a b", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    counted = token_counts.token_counts(docs, public_tokenizers.path(TOKEN_FILE)).collect()
    assert len(counted) == len(rows)
    for row in counted:
        if row["doc_id"] is not None and row["doc_id"] < 90:
            text = SAMPLES[row["doc_id"]]
            n = len(library.encode(text, add_special_tokens=False).ids)
            assert (row["n_bytes"], row["n_tokens"]) == (len(text.encode()), n)
            assert row["over_limit"] == (n > 512)
    coded = {r["doc_id"]: r for r in round_trip(docs).collect()}
    assert coded[90]["n_tokens"] == 0
    for i, text in enumerate(SAMPLES):
        ids = np.array(tool.encode_ordinary(text), "<u4")
        assert coded[i]["n_tokens"] == len(ids)
        assert coded[i]["ids_sha256"] == hashlib.sha256(ids.tobytes()).hexdigest()
        assert coded[i]["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    empty = docs.limit(0)
    assert round_trip(empty).count() == 0
    assert token_counts.token_counts(empty, public_tokenizers.path(TOKEN_FILE)).count() == 0
