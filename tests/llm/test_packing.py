import random
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from risekit.llm import bpe, packing, queries

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(bpe.vocabulary_path())
    t.no_truncation()
    t.no_padding()
    return lambda text: [*t.encode(text or "", add_special_tokens=False).ids, 1]


def best_fit(lengths, capacity):
    """Best-fit decreasing, one item after another."""
    rooms, bins = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else capacity
        bins += room == capacity
        if room > n:
            insort(rooms, room - n)
    return bins


def slots(ranges, histogram):
    """All planned places: (sequence, offset, length)."""
    out, by = [], defaultdict(list)
    for length, first, sequence, each, offset in ranges.tolist():
        by[length].append((first, sequence, each, offset))
    for length, n in histogram.items():
        for (first, sequence, each, offset), (last, *_) in zip(by[length], by[length][1:] + [(n,)]):
            out += [(sequence + (k - first) // each, offset + (k - first) % each * length, length) for k in range(first, last)]
    return out


def without_gaps(places, capacity):
    by = defaultdict(list)
    for s, offset, length in places:
        by[s].append((offset, length))
    for s, cells in by.items():
        at = 0
        for offset, length in sorted(cells):
            assert offset == at, s
            at += length
        assert at <= capacity
    return len(by)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_best_fit_decreasing(seed):
    r = random.Random(seed)
    capacity = r.choice([1, 2, 7, 64, 4096])
    lengths = [min(capacity, max(1, int(r.paretovariate(0.6)))) if seed % 2 else r.randint(1, capacity) for _ in range(r.randint(0, 3000))]
    lengths += [r.randint(1, capacity)] * r.choice([0, 5000])
    histogram = Counter(lengths)
    places = slots(packing.plan(histogram, capacity), histogram)
    assert len(places) == len(lengths)
    assert without_gaps(places, capacity) == best_fit(lengths, capacity)


def test_plan_grows_with_lengths_not_with_documents():
    few = {n: 3 + n % 5 for n in range(1, 4097)}
    a, b = packing.plan(few), packing.plan({n: c * 1_000_003 for n, c in few.items()})
    assert len(a) < 14 * 4096 and len(b) < 14 * 4096


def test_query_against_the_library(spark, library):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.queries()["op11_packing"](spark, SF).collect()
    ids = {d: library(t) for d, t in docs.items()}
    got = {(r["doc_id"], r["piece"]): r for r in rows}
    assert len(got) == len(rows) == sum(-(-len(x) // 4096) for x in ids.values())
    for d, x in ids.items():
        for k in range(-(-len(x) // 4096)):
            cut, r = x[k * 4096 : (k + 1) * 4096], got[d, k]
            assert (r["start"], r["length"]) == (k * 4096, len(cut))
            assert r["ids_crc32"] == zlib.crc32(np.array(cut, "<u4").tobytes())
    n = without_gaps([(r["sequence_id"], r["offset"], r["length"]) for r in rows], 4096)
    lengths = [r["length"] for r in rows]
    assert n == best_fit(lengths, 4096) <= -(-sum(lengths) // 4096) + 1
    assert dict(queries.queries()["op11_packing"](spark, SF).dtypes) == {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}


def test_edges_and_sequences(spark, library):
    texts = [None, "", "a b c d e f g h i j k l m n o p q r s t u v w x y z", "one two three", "one two three", "x"]
    rows = [(i if i < 4 else None, t, "clash", "clash") for i, t in enumerate(texts)] + [(9, "", "c", "c")] * 500 + [(None, None, "c", "c")] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string, rank string, ids string").repartition(7)
    packed = packing.pack(df, bpe.vocabulary_path(), capacity=8, with_ids=True).cache()
    got = packed.collect()
    want = Counter()
    for i, t, *_ in rows:
        x = library(t)
        for k in range(0, len(x), 8):
            want[i, k // 8, k, tuple(x[k : k + 8])] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], tuple(np.frombuffer(r["ids"], "<u4").tolist())) for r in got) == want
    n = without_gaps([(r["sequence_id"], r["offset"], r["length"]) for r in got], 8)
    assert n == best_fit([r["length"] for r in got], 8)
    whole = packing.sequences(packed).collect()
    assert len(whole) == n
    by = {(r["sequence_id"], r["offset"]): r for r in got}
    for s in whole:
        at = 0
        for c in s["documents"]:
            piece = by[s["sequence_id"], c["offset"]]
            assert s["ids"][4 * at : 4 * (at + c["length"])] == piece["ids"] and c["doc_id"] == piece["doc_id"]
            at += c["length"]
        assert at == s["n_tokens"] == len(s["ids"]) // 4
    packed.unpersist()


def test_empty_table_and_long_text(spark, library):
    schema = "doc_id string, text string"
    assert packing.pack(spark.createDataFrame([], schema), bpe.vocabulary_path()).count() == 0
    text = "word " * 30_000
    rows = packing.pack(spark.createDataFrame([("a", text)], schema), bpe.vocabulary_path()).orderBy("piece").collect()
    n = len(library(text))
    assert [r["length"] for r in rows] == [4096] * (n // 4096) + [n % 4096] * (n % 4096 > 0)
    assert len({r["sequence_id"] for r in rows}) == len(rows)
