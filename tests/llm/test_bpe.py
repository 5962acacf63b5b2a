import hashlib
import random

import numpy as np
import pytest

from risekit.llm import bpe, queries

tokenizers = pytest.importorskip("tokenizers")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pair():
    path = bpe.vocabulary_path()
    t = tokenizers.Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return bpe.WordBpe(path), t


def same(ours, theirs, texts):
    want = theirs.encode_batch(texts, add_special_tokens=False)
    got = ours.encode_batch(texts)
    for text, g, w in zip(texts, got, want):
        ids = np.frombuffer(g, "<u4").tolist()
        assert ids == w.ids, text
        assert ours.decode(g) == theirs.decode(w.ids, skip_special_tokens=False)


def test_random_texts(pair):
    r = random.Random(1)
    letters = "aaabbbéèßΣσİǅﬁ'’sтt re've12٣½ \t\x1c\x85​　中文字😀AÅ\r\n\x00"
    same(*pair, ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(3000)])


def test_words_and_edges(pair):
    r = random.Random(2)
    words = ["".join(r.choices("etaoinshrdlucmfwypvbgkjqxz", k=r.randint(1, 30))) for _ in range(3000)]
    same(*pair, [" ".join(words), "", " ", "<|endoftext|>x<|startoftext|><|endoftext|", "ΑΣ ΟΔΟΣ", "ß" * 500, "a" * 3000, "ab" * 4000, "it's don't WE'LL 'S"])


def test_most_words_need_no_merging(pair):
    ours, _ = pair
    ours.cache.clear()
    before = ours.exact
    ours.encode_batch(["the quick brown fox jumps over the lazy dog while every good reader waits for another story"])
    assert ours.exact - before <= 3


def test_small_cache_gives_the_same():
    path = bpe.vocabulary_path()
    small, large = bpe.WordBpe(path, cache_words=5), bpe.WordBpe(path)
    texts = ["some words here", "and others there now", "some words again"]
    assert [x for t in texts for x in small.encode_batch([t])] == large.encode_batch(texts)


def test_query_against_the_library(spark, pair):
    _, t = pair
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.queries()["op3_bpe"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        e = t.encode(docs[r["doc_id"]] or "", add_special_tokens=False)
        assert r["n_tokens"] == len(e.ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(e.ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(t.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def test_nulls_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, None, "old"), (2, "", "old"), (None, "a b", "old"), (None, "a b", "old")], "doc_id long, text string, IDS string")
    out = bpe.decode(bpe.encode(df, bpe.vocabulary_path()), bpe.vocabulary_path())
    assert out.columns == ["doc_id", "text", "ids", "n_tokens", "decoded"]
    got = sorted((r["n_tokens"], r["decoded"]) for r in out.collect())
    assert got[:2] == [(0, ""), (0, "")] and got[2] == got[3] == (2, "a</w> b</w>")
    assert bpe.encode(df.limit(0), bpe.vocabulary_path()).count() == 0
