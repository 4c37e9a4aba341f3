"""SentencePiece encoding, vector codes and periodic runs against plain versions of them."""

import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from orthant.llm import periodic, piece_bpe, queries, vector_codes

MODEL = public_tokenizers.path(queries.PIECE_FILE)
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
PIECES = piece_bpe.Pieces.load(MODEL)
ENCODER, DECODER = piece_bpe.Encoder(PIECES), piece_bpe.Decoder(PIECES)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


# ------------------------------------------------------------------ pieces


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab cdehinorst\n\t▁é", max_size=80)))
def test_pieces_as_the_library(text):
    ids = ENCODER.encode(text)
    want = LIBRARY.encode(text, add_bos=True, add_eos=True)
    assert np.frombuffer(ids, "<u4").tolist() == want
    assert DECODER.decode(ids) == LIBRARY.decode(want)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=8))
def test_any_ids_decode_as_the_library(ids):
    assert DECODER.decode(np.array(ids, "<u4").tobytes()) == LIBRARY.decode(ids)


def test_backtracking_marks_places_and_agrees_with_the_merges():
    rng = random.Random(5)
    texts = [t for t in PIECES.scores if "▁" not in t]
    for _ in range(2000):
        word = "".join(rng.choice(texts) for _ in range(rng.randint(1, 6)))
        got = [PIECES.texts[i] for i in ENCODER.tokens(word)]
        assert got == piece_bpe.merge(word, PIECES.scores)
    # one stretch without a border
    word = "".join(rng.choice("aeinorst") for _ in range(3000))
    assert [PIECES.texts[i] for i in ENCODER.tokens(word)] == piece_bpe.merge(word, PIECES.scores)


def test_full_memos_change_nothing(monkeypatch):
    monkeypatch.setattr(piece_bpe, "MEMO", 3)
    encoder = piece_bpe.Encoder(PIECES)
    text = "over the hills and far away they went over the hills"
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == LIBRARY.encode(text, add_bos=True, add_eos=True)


def test_piece_columns_and_odd_rows(spark):
    rows = [(1, "a b", 5), (1, "a b", 6), (None, None, 7), (2, "", None), (3, " x" * 60_000, 0), (4, "日本\x00 é" * 300, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    out = piece_bpe.encode_decode(df, MODEL, keep=["doc_id", "n_tokens"]).collect()
    assert sorted(map(repr, ((r[0], r[1]) for r in out))) == sorted(map(repr, ((r[0], r[2]) for r in rows)))
    for r in out:
        text = next(t for i, t, n in rows if (i, n) == (r["doc_id"], r["n_tokens"])) or ""
        assert np.frombuffer(r["ids"], "<u4").tolist() == LIBRARY.encode(text, add_bos=True, add_eos=True)
        assert r["decoded"] == text
    assert piece_bpe.encode_decode(df.limit(0), MODEL).count() == 0
    with pytest.raises(ValueError, match="ids"):
        piece_bpe.encode_decode(df.withColumnRenamed("n_tokens", "ids"), MODEL, keep=["ids"])


def test_op11_digests(spark, tmp_path):
    rows = [(1, "A line.\nAnother  one"), (2, None), (3, "▁x ßß"), (None, "y")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in queries.op11_piece_bpe(spark, str(tmp_path)).collect():
        text = dict(rows)[r["doc_id"]] or ""
        ids = LIBRARY.encode(text, add_bos=True, add_eos=True)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == sha(np.array(ids, "<u4").tobytes())
        assert r["decoded_sha256"] == sha(LIBRARY.decode(ids).encode())


# ------------------------------------------------------------------ vector codes


def plain_codes(vectors: dict[int, list], parts=8, entries=16, rounds=6):
    kept = {
        i: [int(np.floor(4096 * x)) for x in v]
        for i, v in vectors.items()
        if v and all(x is not None and np.isfinite(x) for x in v)
    }
    width = len(next(iter(kept.values()))) // parts
    books = [[kept[i][p * width : (p + 1) * width] for i in sorted(kept)[:entries]] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), j) for j, e in enumerate(books[p]))

    def assign():
        return {i: [nearest(p, v[p * width : (p + 1) * width]) for p in range(parts)] for i, v in kept.items()}

    for _ in range(rounds):
        at = assign()
        fresh = []
        for p in range(parts):
            book = []
            for j, entry in enumerate(books[p]):
                mine = [kept[i][p * width : (p + 1) * width] for i in kept if at[i][p][1] == j]
                book.append([sum(c) // len(mine) for c in zip(*mine, strict=True)] if mine else entry)
            fresh.append(book)
        books = fresh
    at = assign()
    digest = sha(",".join(str(c) for b in books for e in b for c in e).encode())
    return {i: ("".join(f"{j:02x}" for _, j in a), sum(d for d, _ in a)) for i, a in at.items()}, digest


def test_op12_as_plain_python(spark, tmp_path):
    rng = np.random.default_rng(3)
    vectors = {i: np.round(rng.normal(size=16), 1).astype("float32").tolist() for i in range(120)}
    for i in range(100, 110):
        vectors[i] = vectors[i - 100]  # copies
    vectors[3] = None
    vectors[7][5] = float("nan")
    vectors[8][0] = float("inf")
    vectors[9][2] = None
    vectors[11] = []
    labels = {i: None if i % 5 == 0 else i % 3 for i in vectors}
    rows = [(i, v, labels[i], "x") for i, v in vectors.items()]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, code string")
    df.repartition(5).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = queries.op12_vector_codes(spark, str(tmp_path)).collect()
    want, digest = plain_codes(vectors)
    assert {r["vec_id"]: (r["code"], r["error"]) for r in out} == want
    assert {r["codebooks_sha256"] for r in out} == {digest}
    totals = {}
    for i, (_, error) in want.items():
        totals[labels[i]] = totals.get(labels[i], 0) + error
    assert all(r["label_error"] == totals[labels[r["vec_id"]]] for r in out)


def test_orchard_finds_the_nearest_of_equals_with_fewer_comparisons():
    rng = np.random.default_rng(8)
    centres = rng.integers(-4000, 4000, (16, 3))
    book = (centres[rng.integers(0, 16, 16)] // 100 * 100).astype(np.int64)
    x = book[rng.integers(0, 16, 5000)] + rng.integers(-60, 60, (5000, 3))
    x = np.vstack([x, (book[rng.integers(0, 16, 500)] + book[rng.integers(0, 16, 500)]) // 2])
    search = vector_codes.Orchard(book)
    at, distance = search.nearest(x)
    every = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (at == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert search.compared < every.size / 2


def test_vector_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    empty, codebooks = vector_codes.compress(spark.createDataFrame([], schema))
    assert empty.count() == 0 and codebooks.entries.size == 0
    few = [(None, [1.0] * 8, 1), (2, [0.5] * 8, None), (2, [0.5] * 8, None)]
    coded, codebooks = vector_codes.compress(spark.createDataFrame(few, schema), keep=["vec_id", "label"])
    assert sorted(r["code"] for r in coded.collect()) == ["00" * 8, "00" * 8, "02" * 8]
    assert codebooks.entries.shape == (8, 3, 1)
    with pytest.raises(ValueError, match="parts"):
        vector_codes.compress(spark.createDataFrame([(1, [1.0] * 8, 1), (2, [1.0] * 16, 1)], schema))
    with pytest.raises(ValueError, match="ambiguous"):
        vector_codes.compress(spark.createDataFrame(few, schema).withColumnRenamed("label", "code"), keep=["code"])
    with pytest.raises(Exception, match="too large"):
        vector_codes.compress(spark.createDataFrame([(1, [1e30] * 8, 1)], schema))


# ------------------------------------------------------------------ periodic runs


def plain_runs(w):
    found = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(6, 4 * q):
                smallest = next(p for p in range(1, q + 1) if all(w[t] == w[t + p] for t in range(i, i + length - p)))
                if smallest == q:
                    found.add((i, q, length))
            i = max(j, i + 1)
    return [(i, n, q) for i, q, n in sorted(found)]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=50), min_size=1, max_size=4))
def test_runs_as_plain_search(texts):
    words = np.array([w for t in texts for w in t], np.int64)
    segments = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    got = list(zip(*(a.tolist() for a in periodic.runs_of(words, segments)), strict=True))
    want, base = [], 0
    for t in texts:
        want += [(base + i, n, q) for i, n, q in plain_runs(t)]
        base += len(t)
    assert got == want


def test_splitting_drops_rare_words_only():
    rng = random.Random(2)
    for _ in range(200):
        w = [rng.randrange(6) for _ in range(60)]
        a, p = rng.randrange(40), rng.randint(1, 6)
        for i in range(a + p, 60):
            w[i] = w[i - p]
        at, segment = periodic.split_rare(np.array(w), np.zeros(60, np.int64))
        inside = {j for i, n, _ in plain_runs(w) for j in range(i, i + n)}
        assert inside <= set(at.tolist())
        for s in set(segment.tolist()):
            mine = at[segment == s].tolist()
            assert mine == list(range(mine[0], mine[-1] + 1)) and len(mine) >= 6
            assert all([w[j] for j in mine].count(w[i]) >= 4 for i in mine)


def plain_op13(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
    runs = plain_runs(words)
    gone = {j for i, length, q in runs for j in range(i + q, i + length)}
    best = None
    for i, length, q in runs:
        if best is None or length * best[2] > best[1] * q:
            best = (i, length, q)
    one = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{i},{length},{q}\n" for i, length, q in runs)
    kept = " ".join(w for j, w in enumerate(words) if j not in gone)
    return (len(runs), *one, sha(listed.encode()), sha(kept.encode()))


def test_op13_as_plain_python(spark, tmp_path):
    rng = random.Random(4)
    rows = [(None, "a a a a a a a"), (None, None), (1, ""), (2, " \t\n"), (-3, "x y \x1cz x y"), (5, "b " * 300)]
    for i in range(6, 400):
        words = [rng.choice(["ab", "ba", "é", "c,", "x y", "ld"][: rng.randint(1, 6)]) for _ in range(rng.randrange(90))]
        rows.append((i, "".join(w + rng.choice([" ", "  ", "\n", "\t", "\x0b", "\r\n"]) for w in words)))
    rows.append((7, rows[12][1]))
    df = spark.createDataFrame([(*r, 1, []) for r in rows], "doc_id long, text string, n_words int, runs array<int>")
    df.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    want = [(i, *plain_op13(i, t)) for i, t in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_long_and_empty_run_tables(spark):
    rows = [(1, "one two three " * 100_000), (2, " ".join(str(i % 5000) for i in range(30_000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r for r in periodic.periodic_runs(df).collect()}
    assert [tuple(r) for r in out[1]["runs"]] == [(0, 300_000, 3)] and out[1]["collapsed"] == "one two three"
    assert [tuple(r) for r in out[2]["runs"]] == [(0, 30_000, 5000)]
    assert periodic.periodic_runs(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="runs"):
        periodic.periodic_runs(df.withColumnRenamed("doc_id", "runs"), keep=["runs"])
