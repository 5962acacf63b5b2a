import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from risekit.llm import decontaminate as d


def words(text):
    out, w = [], ""
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        if c.isascii() and not (c.isdigit() or "a" <= c <= "z"):
            out, w = (out + [w] if w else out), ""
        else:
            w += c
    return out + [w] if w else out


def brute(text, items, window=10):
    w, hit, found = words(text), set(), set()
    for item, t in items:
        b = words(t)
        for i in range(max(1, len(b) - window + 1) if b else 0):
            p = b[i : i + window]
            for j in range(len(w) - len(p) + 1):
                if w[j : j + len(p)] == p:
                    hit |= set(range(j, j + len(p)))
                    found |= {item} - {None}
    return len(w), len(hit), sorted(found)


def make(seed, n_docs=60):
    r = random.Random(seed)
    vocab = [f"v{i}" for i in range(30)] + ["É", "x9", "9"]
    items = [(i, " ".join(r.choices(vocab, k=r.choice([1, 3, 9, 10, 11, 40])))) for i in range(25)]
    items += [(90, ""), (91, None), (92, "!?"), (None, " ".join(["nullitem"] * 3)), (93, items[5][1]), (5, "another text under a used id entirely")]
    docs = []
    for i in range(n_docs):
        parts = [" ".join(r.choices(vocab + ["out", "Of", "vocab"], k=r.randint(0, 60)))]
        for _ in range(r.randint(0, 3)):
            parts.append(r.choice(items)[1] or "")
            parts.append(" ".join(r.choices(vocab, k=r.randint(0, 12))))
        docs.append((i, r.choice([" ", ", ", "\n--"]).join(parts).replace("v1 ", "V1 ")))
    return docs + [(100, None), (101, ""), (102, " . "), (3, docs[3][1]), (None, "nullitem nullitem nullitem nullitem")], items


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("blocks", [False, True])
def test_against_brute_force(spark, documents, seed, blocks, monkeypatch):
    if blocks:
        monkeypatch.setattr(d, "BLOCK_BYTES", 600)
    docs, items = make(seed)
    bench = spark.createDataFrame(items, "item_id long, text string")
    df = documents(docs).withColumn("ITEMS_", F.lit(1)).repartition(2)
    out = d.contaminated(df, bench).select("doc_id", "text", "n_words", d.n_hit().alias("n_hit"), "items").collect()
    assert len(out) == len(docs)
    for r in out:
        assert (r["n_words"], r["n_hit"], r["items"]) == brute(r["text"], items), r["text"]


def test_small_shards_give_the_same():
    docs, items = make(4)
    p = d.Phrases(items)
    split = [d.words_of(t) for _, t in docs]
    whole = d.shard_hits(split, p)
    for i, w in enumerate(split):
        assert d.shard_hits([w], p).get(0) == whole.get(i)


def test_suffix_array_and_index():
    r = np.random.default_rng(3)
    for n, sigma in ((1, 2), (50, 3), (400, 4), (400, 40)):
        symbols = r.integers(2, sigma + 2, n)
        symbols[r.random(n) < 0.05] = 1
        symbols = np.r_[symbols, symbols[: n // 2], 1]
        breaks = symbols == 1
        rank = symbols + breaks.sum()
        rank[breaks] = np.arange(1, breaks.sum() + 1)
        want = sorted(range(len(symbols)), key=lambda i: rank[i:].tolist())
        assert d.suffix_array(symbols, breaks).tolist() == want
        index = d.FmIndex(symbols, sample=3)
        text = symbols.tolist()
        for _ in range(30):
            m = int(r.integers(1, 5))
            p = r.integers(2, sigma + 3, m)
            lo, hi = index.search(p[None], np.array([m]))
            places = sorted(index.locate(np.arange(lo[0], hi[0])).tolist()) if lo[0] < hi[0] else []
            assert places == [i for i in range(len(text) - m + 1) if text[i : i + m] == p.tolist()]


def test_spans_are_cut_out(spark, documents):
    bench = spark.createDataFrame([(1, "Alpha beta, gamma!"), (2, "gamma delta")], "item_id long, text string")
    df = documents([(1, "é Keep (alpha Beta gamma delta) rest."), (2, "nothing here"), (3, None), (4, "alpha beta gamma")])
    out = {r["doc_id"]: r["text"] for r in d.cut_spans(d.contaminated(df, bench)).collect()}
    assert out == {1: "é Keep () rest.", 2: "nothing here", 3: None, 4: ""}


def test_clashing_columns_are_replaced(spark, documents, monkeypatch):
    monkeypatch.setattr(d, "BLOCK_BYTES", 12)  # several passes
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "gamma delta")], "item_id long, text string")
    df = documents([(1, "x alpha beta gamma delta")]).selectExpr("*", "'a' AS spans", "'b' AS Items", "array('c') AS n_words", "1 AS start")
    (r,) = d.contaminated(df, bench).collect()
    assert (r["n_words"], [tuple(s) for s in r["spans"]], r["items"], r["start"], r["text"]) == (5, [(1, 5)], [1, 2], 1, "x alpha beta gamma delta")


def test_no_rows(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(documents([]), none).count() == 0
    r = d.contaminated(documents([(1, "a b")]), none).collect()[0]
    assert (r["n_words"], r["spans"], r["items"]) == (2, [], [])


def test_digest_of_no_items(spark):
    from risekit.llm import queries

    rows = queries.queries()["op9_decontamination"](spark, "/root/testdata/sf0.001").collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert any(r["contaminated"] for r in rows) and all((r["items_sha256"] == empty) == (r["n_items"] == 0) for r in rows)


def test_repeated_items_and_ids_of_any_type(spark, documents, monkeypatch):
    phrase = " ".join(f"w{i}" for i in range(12))
    monkeypatch.setattr(d, "BLOCK_BYTES", 40)
    items = spark.createDataFrame([("b", phrase)] * 300 + [("a", "w3 w4"), (None, "w9"), ("c", None)], "item_id string, text string")
    seen = []
    kept = d.Phrases.__init__
    monkeypatch.setattr(d.Phrases, "__init__", lambda self, rows, *a: (seen.append(len(rows)), kept(self, rows, *a))[1])
    got = {r["doc_id"]: r for r in d.contaminated(documents([(1, f"x {phrase} y"), (2, "w3 w4"), (3, "none")]), items).collect()}
    assert sum(seen) == 3
    assert got[1]["items"] == ["a", "b"] and got[2]["items"] == ["a"] and got[3]["items"] == []
    assert [tuple(s) for s in got[1]["spans"]] == [(1, 13)]


@pytest.mark.parametrize("block", [1 << 24, 12])
def test_the_search_cuts_spans_as_cut_spans_does(spark, documents, monkeypatch, block):
    monkeypatch.setattr(d, "BLOCK_BYTES", block)  # in one pass and in several
    bench = spark.createDataFrame([(1, "Alpha beta, gamma!"), (2, "gamma delta")], "item_id long, text string")
    df = documents([(1, "é Keep (alpha Beta gamma delta) rest."), (2, "nothing here"), (3, None), (4, "alpha beta gamma"), (5, "x gamma delta y alpha beta gamma z")])
    once = d.contaminated(df, bench, cut=True)
    assert sorted(map(str, once.collect())) == sorted(map(str, d.cut_spans(d.contaminated(df, bench)).collect()))
    assert {r["doc_id"]: r["text"] for r in once.collect()}[5] == "x  y  z"


def test_the_pipelines_stage_takes_one_python_worker_a_task(spark, documents):
    import corpus_pipeline

    plan = corpus_pipeline.decontamination_stage(spark, documents([(1, "a b")]), "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "EvalPython" not in plan
