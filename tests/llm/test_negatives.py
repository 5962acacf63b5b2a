import math
import random
from collections import Counter

import numpy as np
import pytest

from risekit.llm import negatives, queries


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def order(rows):
    return sorted(rows, key=lambda x: (-x[1], x[0] is None, x[0] or 0))


def brute(rows, positives=5, most=3, low=50, high=95):
    """rows of (id, vector, label, anchor)."""
    rows = [r for r in rows if r[1] is not None and r[2] is not None]
    out = []
    for k, (i, v, label, anchor) in enumerate(rows):
        if not anchor:
            continue
        scores = [(r[0], product(v, r[1]), r[2]) for j, r in enumerate(rows) if j != k]
        for p, ps, _ in order([x for x in scores if x[2] == label])[:positives]:
            found = order([x for x in scores if x[2] != label and low * ps <= 100 * x[1] <= high * ps])[:most]
            out += [(i, p, n + 1, x[0], ps, x[1]) for n, x in enumerate(found)]
    return Counter(out)


def mined(spark, rows, parts=3, **kw):
    df = spark.createDataFrame([(*r, "clash") for r in rows], "id long, vector array<long>, label int, anchor boolean, score string").repartition(parts)
    return Counter(map(tuple, negatives.hard_negatives(df, **kw).collect()))


def vectors(seed, n, dims, spread, clusters):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(clusters, dims))
    v = centres[r.integers(0, clusters, n)] + r.normal(size=(n, dims)) * spread
    return np.floor(v * 256 * np.exp(r.normal(size=(n, 1)) * 0.5)).astype(int).tolist()


@pytest.mark.parametrize("seed,dims,spread", [(1, 16, 0.05), (2, 16, 1.0), (3, 3, 0.3)])
def test_against_brute_force(spark, monkeypatch, seed, dims, spread):
    r = random.Random(seed)
    rows = [(i, v, r.randrange(4), i % 9 == 0) for i, v in enumerate(vectors(seed, 700, dims, spread, 6))]
    want = brute(rows)
    assert want and mined(spark, rows) == want
    assert mined(spark, rows, anchor_bytes=1500) == want


def test_edges(spark):
    base = [[3, 4], [0, 0], [-3, -4], [3, 4, 0], [6, 8], [4, 3], [1], [], None]
    rows = [(i, v, lab, True) for i, (v, lab) in enumerate((v, lab) for v in base for lab in (0, 1, None))]
    rows += [(None, [5, 5], 0, True), (None, [5, 5], 1, False), (7, [3, 4], 1, True), (7, [3, 4], 1, True)]
    rows += [(100 + i // 2, [30, 40], i % 3, i == 0) for i in range(200)] + [(500 + i, [27, 36], i % 3, False) for i in range(100)]
    assert mined(spark, rows) == brute(rows)
    assert not mined(spark, [])
    assert not mined(spark, [(1, [1, 2], 0, False)])
    assert not mined(spark, [(1, [1, 2], 0, True), (2, None, None, True)])


def test_large_components(spark):
    rows = [(i, [(i * 7919 % 1001 - 500) * 1_000_003, i * 1_000_033], i % 3, i % 5 == 0) for i in range(60)]
    assert mined(spark, rows) == brute(rows)


def test_ranges_lose_nothing_and_prune():
    v = np.floor(negatives._unit(np.array(vectors(4, 2000, 16, 0.1, 20)))[0] * 4096).astype(int)  # of about one length
    unit, norm = negatives._unit(v)
    b = negatives.Block({"label": 0, "row": 0, "longest": norm.max(), "ids": list(range(2000)), "anchors": [False] * 2000, "vectors": v.astype("<i8").tobytes(), "dims": 16, "lists": np.argsort(unit, axis=0, kind="stable").T.astype("<u2").tobytes()})
    q = negatives.Anchors([{"row": -1, "id": i, "label": 1, "vector": v[i].tolist()} for i in range(0, 2000, 40)])
    exact = q.v @ v.T
    for share in (0.3, 0.9, 0.99):
        least = exact.max(1) * share
        got, checked = {}, 0
        for a, rows, score in q.candidates(b, np.arange(len(q.ids)), least):
            checked += len(rows)
            assert (score == exact[a, rows]).all()
            got[a] = {int(x) for x, s in zip(rows, score) if s >= least[a]}
        for a in range(len(q.ids)):
            assert got.get(a, set()) == set(np.flatnonzero(exact[a] >= least[a]).tolist())
    assert checked < 0.2 * exact.size
    assert not list(q.candidates(b, np.arange(len(q.ids)), q.norm * norm.max() * 1.01))


def test_clean_vectors(spark):
    rows = [(1, [1.0, None], 1), (2, [float("nan")], 1), (3, [float("inf")], 1), (4, None, 1), (5, [0.5], None), (7, [0.5, -0.001], 9), (50, [], 3), (None, [1.0], 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {r["id"]: (r["vector"], r["label"], r["anchor"]) for r in negatives.whole_vectors(df).collect()}
    assert got == {7: ([128, math.floor(-0.256)], 0, False), 50: ([], 3, True), None: ([256], 2, False)}


def test_query_against_sql(compare):
    ours, theirs = compare(queries.queries()["op13_hard_negatives"], queries.oracle_sql()["op13_hard_negatives"])
    assert ours == theirs and len(ours) > 50
