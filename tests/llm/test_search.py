import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from risekit.llm import queries, search

SF = "/root/testdata/sf0.01"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items, most=10):
    docs = [(d, Counter(terms(t))) for d, t in docs]
    docs = [(d, c, sum(c.values())) for d, c in docs if c]
    n_all, total = len(docs), sum(n for *_, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for i, text in dict.fromkeys(items):
        q, found = set(terms(text)), []
        for d, c, n in docs:
            m = 10 + 90 * n * n_all // total
            s = sum(math.floor(1000 * math.log((2 * n_all + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in q if t in c)
            if s > 0:
                found.append((-s, d is None, d or 0, d))
        out += [(i, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(found, key=lambda x: x[:3])[:most])]
    return Counter(out)


def ranked(spark, docs, items, **kw):
    d = spark.createDataFrame([(i, t, "clash", 1.5) for i, t in docs], "doc_id long, text string, sketch string, n double").repartition(3)
    q = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, item string")
    return Counter(map(tuple, search.search(search.index(d), q, **kw).collect()))


def test_terms():
    texts = ["Ab1-c é_É x", None, "", "!?", "  ÀB ", "x" * 70 + " " + "X" * 70, "a", "中文 字"]
    got, row = search.terms_of(pa.array(texts, pa.string()))
    want = [(t, i) for i, x in enumerate(texts) for t in terms(x)]
    assert row.tolist() == [i for _, i in want]
    names = {}
    assert all(names.setdefault(t, h) == h for (t, _), h in zip(want, got.tolist())) and len(set(names.values())) == len(names)
    part, _ = search.terms_of(pa.array(["zz", *texts], pa.string()).slice(1))
    assert part.tolist() == got.tolist()


def test_hashes_of_many_words_differ():
    r = random.Random(3)
    words = list({"".join(r.choices("ab0é", k=r.randint(1, 60))) for _ in range(200_000)})
    got, _ = search.terms_of(pa.array(words, pa.string()))
    assert len(set(got.tolist())) == len(words)


def test_bounds_hold():
    r = random.Random(5)
    texts = [" ".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.choice([1, 5, 50, 700]))) for _ in range(60)] + ["w " * 400]
    q = search.Queries(["a b c", "z", "none here", "!", "w a"])
    term, row, number, tf, n = search.occurrences(pa.array(texts, pa.string()))
    q.weigh(len(texts), int(n.sum()), {})
    sketch = pa.array(search.sketches(row, term[number], tf, len(texts)), pa.binary())
    bounds, scores = q.bounds(n, sketch), q.scores(pa.array(texts, pa.string()))
    assert bounds.shape == scores.shape == (61, 4)
    assert (bounds >= scores).all() and (bounds > scores).any() and (bounds == scores).mean() > 0.5


def test_against_brute_force(spark):
    r = random.Random(7)
    words = ["".join(r.choices("aeioubcd", k=r.randint(1, 5))) for _ in range(300)]
    docs = [(i, " ".join(r.choices(words, k=r.randint(0, 60)))) for i in range(250)]
    docs += [(None, "aa bb cc"), (None, None), (7, "aa bb cc"), (7, "aa bb cc"), (300, ""), (301, "?!"), (302, " ".join(words * 40))]
    docs += [(400 + i, "a shared passage of some words aa bb cc") for i in range(300)]
    items = [(i, " ".join(r.choices(words, k=r.randint(1, 12)))) for i in range(25)]
    items += [(50, None), (51, ""), (52, "unknownterm"), (None, "aa bb"), (53, "aa bb cc"), (53, "aa bb cc"), (54, "shared passage of"), (55, " ".join(words)), (56, docs[3][1])]
    want = brute(docs, items)
    assert ranked(spark, docs, items) == want
    assert ranked(spark, docs, items, block_bytes=100) == want
    assert ranked(spark, docs, items, most=1) == brute(docs, items, 1)


def test_empty_tables(spark):
    assert not ranked(spark, [], [(1, "a")])
    assert not ranked(spark, [(1, "a")], [])
    assert not ranked(spark, [(1, None), (2, "")], [(1, "a")])


def test_few_texts_are_scored(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("text <> ''").collect()
    texts = pa.array([r["text"] for r in rows], pa.string())
    q = search.Queries([r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    term, row, number, tf, n = search.occurrences(texts)
    df = np.bincount(number, minlength=len(term))
    q.weigh(len(texts), int(n.sum()), dict(zip(term.view(np.int64).tolist(), df.tolist())))
    bounds = q.bounds(n, pa.array(search.sketches(row, term[number], tf, len(texts)), pa.binary()))
    tenth = np.sort(q.scores(texts), axis=0)[-10]
    assert ((bounds >= tenth).sum(0) < 0.2 * len(texts)).mean() > 0.5


def test_query_against_sql(compare):
    ours, theirs = compare(queries.queries()["op12_search"], queries.oracle_sql()["op12_search"])
    assert ours == theirs and len(ours) > 100
