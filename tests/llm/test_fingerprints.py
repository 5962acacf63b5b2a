import hashlib
import re

import pytest
from pyspark.sql import functions as F

from risekit.llm import fingerprints, queries

SF = "/root/testdata/sf0.01"


def shingles(text):
    w = [x for x in re.split("[\t-\r ]+", text.lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.fixture(scope="module")
def result(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    return docs, queries.queries()["op8_fingerprints"](spark, SF).collect()


def test_edited_texts(result):
    docs, rows = result
    order = sorted(docs, reverse=True)
    after = {d: docs[order[(i + 1) % len(order)]] for i, d in enumerate(order)}
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        t = docs[r["doc_id"]]
        k = len(t) // 3
        edited = t[: len(t) - k] + after[r["doc_id"]][:k]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()


def test_likeness_estimates_jaccard(result):
    docs, rows = result
    order = sorted(docs, reverse=True)
    after = {d: docs[order[(i + 1) % len(order)]] for i, d in enumerate(order)}
    errors = []
    for r in rows:
        t = docs[r["doc_id"]]
        edited = t[: len(t) - len(t) // 3] + after[r["doc_id"]][: len(t) // 3]
        errors.append((r["near_edited"] - jaccard(t, edited), r["near_next"] - jaccard(t, after[r["doc_id"]])))
    assert abs(sum(e for e, _ in errors) / len(errors)) < 0.01
    assert sum(e * e for e, _ in errors) / len(errors) < 0.05**2
    assert sum(abs(e) for _, e in errors) / len(errors) < 0.01


def test_equal_texts_have_equal_fingerprints(result):
    docs, rows = result
    by = {}
    for r in rows:
        assert by.setdefault(docs[r["doc_id"]], r["fingerprint"]) == r["fingerprint"]
        assert len(r["fingerprint"]) == 256
    assert len(set(by.values())) > 0.9 * len(by)


def test_edges(documents):
    rows = [(5, None), (4, ""), (3, "one"), (2, "é" * 7), (1, "a b c d e f g h i"), (1, "a b c d e f g h i"), (None, "x y")]
    got = fingerprints.fingerprint_pairs(documents(rows)).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["text"]): r for r in got}
    assert by[5, ""]["fingerprint"] == "" and by[4, ""]["n_chars"] == 0
    assert by[3, "one"]["edited"] == "oné" and by[None, "x y"]["edited"] == "x "  # the first text is empty
    assert fingerprints.fingerprint_pairs(documents([])).count() == 0


def test_ranges_give_the_same_as_one(spark, documents):
    rows = [(i * 7 % 1000 * 3, f"text {i}") for i in range(400)]
    df = documents(rows).select("doc_id", "text")
    order = sorted(rows, reverse=True)
    want = {d: order[(k + 1) % len(order)][1] for k, (d, _) in enumerate(order)}
    for size in (1, 7, 100_000):
        got = {r["doc_id"]: r["next_text"] for r in fingerprints.beside_next(df, "doc_id", ["text"], size).collect()}
        assert got == want


def test_likeness_of_fingerprints(spark):
    a = "ab" * 128
    df = spark.createDataFrame([(a, a), (a, ""), ("", ""), (a, "cd" * 128), (a, "ab" * 64 + "cd" * 64)], "a string, b string")
    got = [r[0] for r in df.select(fingerprints.likeness(F.col("a"), F.col("b"))).collect()]
    assert got[:4] == [1, 0, 1, 0] and got[4] == pytest.approx((0.5 - 1 / 256) / (1 - 1 / 256))


def test_main_path_is_native(spark):
    import contextlib
    import io

    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        queries.queries()["op8_fingerprints"](spark, "/root/testdata/sf0.001").explain()
    assert not re.search("Python|Pandas|Arrow", out.getvalue())


def test_ids_are_whole_numbers(spark):
    with pytest.raises(TypeError):
        fingerprints.fingerprint_pairs(spark.createDataFrame([("a", "b")], "doc_id string, text string"))
