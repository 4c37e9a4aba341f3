import re
import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from orthant.llm import fingerprints, language, pii, quality, queries

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_quality_on_held_out_documents(spark):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    rows = queries.op6_quality(spark, DATA).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in rows]) >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)


def test_quality_odd_tables(spark, docs):
    odd = spark.createDataFrame(
        [(1, None, 5), (None, "", 6), (1, None, 5), (2, "x" * 200_000, 7)], "doc_id long, text string, score int"
    )
    none = spark.createDataFrame([], "doc_id long, quality int")
    scored = quality.classify(odd, none).collect()
    assert len(scored) == 4 and {r["score"] for r in scored} == {0.5}
    one_kind = spark.createDataFrame([(2, 1), (2, 1), (None, 0), (3, None)], "doc_id long, quality int")
    assert quality.classify(odd, one_kind).count() == 4
    assert quality.classify(docs.limit(0), none).count() == 0


def test_trees_walk_like_nested_ifs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 4))
    y = ((x[:, 0] > 0.3) & (x[:, 2] < 0.5)).astype(float)
    trees = quality.fit_trees(x, y, n_trees=20)
    for row, got in zip(x[:50], trees.score(x[:50]), strict=True):
        total = trees.base
        for node in trees.roots:
            while trees.left[node] != node:
                low = row[trees.feature[node]] <= trees.cut[node]
                node = trees.left[node] if low else trees.right[node]
            total += trees.value[node]
        assert got == pytest.approx(1 / (1 + np.exp(-total)))
    assert ((trees.score(x) > 0.5) == (y > 0.5)).mean() > 0.97


def test_language_on_held_out_documents(spark, docs):
    rows = queries.op7_language(spark, DATA).join(docs.select("doc_id", "lang"), "doc_id")
    rows = rows.where("held_out and lang is not null").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) >= 0.97


def test_language_odd_tables(spark, docs):
    model = language.fit_language(docs)
    odd = spark.createDataFrame(
        [(1, None), (2, ""), (3, "123 ... 4"), (4, "ß"), (4, "ß")], "doc_id long, text string"
    )
    got = {r["doc_id"]: r for r in language.detect(odd, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3
    assert got[4]["lang_pred"] == "de"
    nothing = language.fit_language(docs.limit(0))
    assert {r["lang_pred"] for r in language.detect(odd, nothing).collect()} == {"und"}


@pytest.mark.parametrize("n", [2, 4, 7, 12])
def test_codewords_are_apart(n):
    code = language.codewords(n)
    apart = (code.shape[1] - code @ code.T) / 2 + 99 * np.eye(n)
    assert apart.min() >= max(1, code.shape[1] // 4) and (abs(code.sum(axis=0)) < n).all()


def plain_base(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(v) <= 255 for v in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub(r"[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and pii.luhn(digits):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(a, b, pii.KINDS[k]) for a, k, b in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1@.-+ ()é4", max_size=60))
def test_base_spans_of_any_text(text):
    assert pii.base_spans(text) == plain_base(text)


def test_base_spans_of_numbers():
    text = "x 4111 1111 1111 1111, 10.0.0.300 10.0.0.255.1.2.3.4 +1 (415) 555-2671; a.b@c.de@f.gh 0000000000.0.0.1"
    assert pii.base_spans(text) == plain_base(text)
    long = "1." * 50_000 + "@" + "a" * 100_000
    assert pii.base_spans(long) == [] or all(k == "ip" for *_, k in pii.base_spans(long))


@pytest.fixture(scope="module")
def field(docs):
    return pii.fit_field(docs)


def test_spans_that_the_base_misses(field):
    text = "call +1 (869) 555-3296 4111111111111111 now"
    base, added = pii.all_spans(text, field)
    assert not any(k == "phone" for *_, k in base)
    found = {text[a:b]: k for a, b, k in added}
    assert found.get("+1 (869) 555-3296") == "phone"
    assert pii.all_spans("nothing here in 1999, 12 of 3.14", field) == ([], [])


def test_personal_data_table(spark, docs, field):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pii.find_personal_data(docs, field).collect():
        base = plain_base(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(b[2] == k for b in base) for k in pii.KINDS]
        assert {f"{k}:{a}:{b}" for a, b, k in base} <= set(r["spans"].split(",")) | {""}
    odd = spark.createDataFrame([(1, None, 0), (1, None, 0), (None, "", 1)], "doc_id long, text string, spans int")
    assert [r["spans"] for r in pii.find_personal_data(odd, field).collect()] == ["", "", ""]


def brute_fingerprint_rows(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    texts = [t or "" for _, t in rows]
    out = []
    for i, (doc_id, _) in enumerate(rows):
        a, b = texts[i], texts[(i + 1) % len(rows)]
        q = len(a) // 4
        out.append((doc_id, a, b, a[: len(a) - q] + b[:q]))
    return out


@pytest.mark.parametrize("partitions", ["1", "7"])
def test_fingerprints_against_brute_force(spark, docs, partitions):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()] + [(5, "tie"), (5, "tie"), (-3, None), (None, "first"), (10**9, "")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        table = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
        got = fingerprints.fingerprints(table).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    expected = sorted(
        (i is not None, i or 0, len(a), hashlib.sha256(e.encode()).hexdigest()) for i, a, _, e in brute_fingerprint_rows(rows)
    )
    assert expected == sorted(
        (r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"], r["edited_sha256"]) for r in got
    )
    of = {}
    for i, a, b, e in brute_fingerprint_rows(rows):
        of.setdefault((i, hashlib.sha256(e.encode()).hexdigest()), (a, b, e))
    for r in got[::37]:
        a, b, e = of[r["doc_id"], r["edited_sha256"]]
        own, new, following = fingerprints.sketches([a, e, b])
        assert r["fingerprint"] == fingerprints.to_string(own)
        assert r["edited_fingerprint"] == fingerprints.to_string(new)
        assert r["near_edited"] == pytest.approx(float(fingerprints.likeness(own, new)))
        assert r["near_next"] == pytest.approx(float(fingerprints.likeness(own, following)))


def test_equal_substrings_share_phrases_at_any_offset(docs):
    text = docs.where(F.length("text") > 3000).first()["text"]
    own = fingerprints.sketches([text])[0]
    for shift in range(1, 6):
        moved = fingerprints.sketches(["#" * shift + "q" + text])[0]
        assert fingerprints.likeness(own, moved) > 0.95
    assert (fingerprints.from_string(fingerprints.to_string(own)) == own).all()


def test_fingerprints_of_few_documents(spark):
    one = spark.createDataFrame([(7, "abcdefgh")], "doc_id long, text string")
    row = fingerprints.fingerprints(one).collect()
    assert len(row) == 1 and row[0]["near_next"] == 1.0
    assert row[0]["edited_sha256"] == hashlib.sha256(b"abcdefab").hexdigest()
    assert fingerprints.fingerprints(one.limit(0)).count() == 0
