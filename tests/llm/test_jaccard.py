import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from risekit.llm import jaccard
from risekit.llm.components import connected_components


def shingles(text, n):
    w = [x for x in re.split("[\t-\r ]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def brute(rows, n, percent):
    sets = [shingles(t, n) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    for i, s in enumerate(sets):
        common = defaultdict(int)
        for g in s:
            for j in holders[g]:
                if j < i:
                    common[j] += 1
        for j, c in common.items():
            if 100 * c >= percent * (len(s) + len(sets[j]) - c):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    own = [min((x for x in least[root(i)] if x is not None), default=None) for i in range(len(rows))]
    return sorted(((d, len(sets[i]), own[i]) for i, (d, _) in enumerate(rows)), key=str)


def corpus(seed, groups, size, copies, edits):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    passage = [r.choice(words) for _ in range(60)]
    rows, i = [], 0
    for _ in range(groups):
        base = [r.choice(words) for _ in range(r.randint(*size))]
        for _ in range(r.randint(*copies)):
            text = list(base)
            for _ in range(r.randint(*edits)):
                k = r.randrange(len(text))
                text[k : k + r.choice([0, 1, 1])] = [r.choice(words).upper()] * r.choice([0, 1, 1, 2])
                text = text or ["x"]
            rows.append((i, " ".join(passage * r.choice([0, 0, 1]) + text)))
            i += 1
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("n", "percent"), [(4, 85), (5, 80)])
def test_against_brute_force(spark, documents, n, percent):
    rows = corpus(1, 60, (1, 12), (1, 4), (0, 2)) + [(10_000 + i, t) for i, t in corpus(2, 40, (30, 300), (1, 6), (0, 12))]
    rows += [(50_000, None), (50_001, ""), (50_002, " \t\n"), (50_003, "one"), (50_004, "ONE"), (50_005, "one two three"), (50_006, "É à"), (50_007, "é à"), (None, rows[0][1]), (rows[0][0], rows[0][1])]
    got = [tuple(x) for x in jaccard.near_duplicates(documents(rows), n=n, percent=percent).collect()]
    assert sorted(got, key=str) == brute(rows, n, percent)


@pytest.mark.parametrize("long_run", [3, 8])
def test_long_runs_lose_no_link(spark, documents, long_run, monkeypatch):
    # near copies whose edits add up: many pairs are just over or under the threshold, and nearly all runs are long
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 16)
    monkeypatch.setattr(jaccard, "ROWS_PER_PART", 10)
    monkeypatch.setattr(jaccard, "PAIRS_PER_PART", 4)
    monkeypatch.setattr(jaccard.meetings, "__defaults__", (long_run,))
    rows = corpus(3, 3, (60, 150), (60, 60), (0, 9)) + [(20_000 + i, t) for i, t in corpus(4, 2, (4, 12), (40, 40), (0, 3))]
    docs = documents(rows)
    sets, pairs, core, texts = jaccard.met_sets(docs, "doc_id", "text", 4, 85)
    assert core.select("sid").distinct().count() > 50
    got = [tuple(x) for x in jaccard.near_duplicates(docs, n=4, percent=85).collect()]
    assert sorted(got, key=str) == brute(rows, 4, 85)


def test_stragglers_meet_the_whole_run(documents, monkeypatch):
    # a star of near copies, and a chain at its end whose sets are not linked with the star's middle
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 8)
    monkeypatch.setattr(jaccard.meetings, "__defaults__", (3,))
    base = [f"w{i}" for i in range(200)]
    rows = [(i, " ".join([*base[: 2 * i], "x", *base[2 * i + 1 :]])) for i in range(30)]
    rows += [(100 + k, " ".join([*(f"y{j}" for j in range(4 * k)), *base[4 * k :]])) for k in range(1, 12)]
    got = [tuple(x) for x in jaccard.near_duplicates(documents(rows), n=4, percent=85).collect()]
    assert sorted(got, key=str) == brute(rows, 4, 85)


def test_common_shingles_are_counted_in_blocks(documents, monkeypatch):
    # what very many members have is counted where they meet in blocks, in some of which few have it
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 16)
    monkeypatch.setattr(jaccard.meetings, "__defaults__", (3,))
    monkeypatch.setattr(jaccard.member_grams, "__defaults__", (3,))
    rows = corpus(3, 3, (60, 150), (60, 60), (0, 9)) + [(20_000 + i, t) for i, t in corpus(4, 2, (4, 12), (40, 40), (0, 3))]
    docs = documents(rows)
    plain = docs.select("doc_id", "text")
    schemes = jaccard.Schemes(85)
    sets = jaccard.document_sets(plain, "doc_id", "text", 4)
    met = jaccard.written(jaccard.meetings(jaccard.signature_rows(plain, "text", 4, schemes), 85), "met")
    members = jaccard.written(jaccard.long_run_members(met, jaccard.long_segments(met), schemes), "members")
    found = jaccard.written(jaccard.member_grams(members, jaccard.set_texts(plain, sets, members), 4), "grams")
    met_grams = jaccard.meetings(found.where("kind = 0").select("key", "sid", "meta"), 85)
    own = {}
    for _, text in rows:
        shingle = jaccard.grams(text, 4)
        own[jaccard.set_id(shingle)] = set(shingle.tolist())
    inside = {r["sid"] for r in members.select("sid").distinct().collect()}
    holders = defaultdict(set)
    for sid in inside:
        for g in own[sid]:
            holders[g].add(sid)
    want = sorted((sid, len(own[sid]), sum(len(holders[g]) > 3 for g in own[sid])) for sid in inside)
    assert len(inside) > 50 and any(c for _, _, c in want)
    assert sorted(tuple(r) for r in jaccard.common_parts(found, met_grams).collect()) == want
    assert found.where("kind = 0").count() < 0.7 * sum(len(own[s]) for s in inside)
    got = [tuple(x) for x in jaccard.near_duplicates(docs, n=4, percent=85).collect()]
    assert sorted(got, key=str) == brute(rows, 4, 85)


def passages(count, own):
    r = random.Random(7)
    passage = " ".join(f"p{i}" for i in range(300))
    return [(i, passage + " " + " ".join(f"o{r.randrange(1 << 40)}" for _ in range(own))) for i in range(count)]


@pytest.mark.parametrize("own", [90, 35])
def test_a_shared_passage_alone_sends_no_text(documents, own):
    # unlinked documents that share a long passage: texts cross the network as often in a long run as in a short one
    sent = []
    for count in (60, 120):
        sets, pairs, core, texts = jaccard.met_sets(documents(passages(count, own)), "doc_id", "text", 4, 85)
        sent.append((pairs.count() + core.count()) / count)
    assert sent[1] <= sent[0]
    assert jaccard.near_duplicates(documents(passages(60, own)), n=4, percent=85).where("component_id <> doc_id").count() == 0


def test_schemes_leave_a_segment_for_every_pair():
    for percent in (80, 85, 95):
        schemes = jaccard.Schemes(percent, most=5000)
        assert any(b.deletion for b in schemes.bands) or percent == 95
        for b in schemes.bands:
            needs = b.differ // 2 + 1 if b.deletion else b.differ + 1
            assert b.segments == needs + b.spare
            for x in {b.low, b.high}:
                for y in range(x, x * 100 // percent + 1):
                    common = -(-percent * (x + y) // (100 + percent))
                    assert x + y - 2 * common <= b.differ and schemes.band(y) <= schemes.band(x) + 1


def test_grams():
    a = jaccard.grams("The  quick\tbrown FOX jumps", 4)
    assert len(a) == 2 and np.array_equal(a, jaccard.grams("the quick brown fox\njumps", 4))
    assert len(jaccard.grams("a b", 4)) == 1 and len(jaccard.grams(" ", 4)) == 0 and len(jaccard.grams(None, 4)) == 0
    assert not np.array_equal(jaccard.grams("a b", 4), jaccard.grams("ab", 4)) and not np.array_equal(jaccard.grams("É b", 4), jaccard.grams("é b", 4))
    words = " ".join(f"x{i}" for i in range(5000))
    assert len(jaccard.grams(words, 5)) == 4996


def test_runs_across_batches(spark):
    """A long run that spans many Arrow batches keeps all members, each once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        schemes = jaccard.Schemes(85)
        meta = int(jaccard._meta(5, True, False, np.array([1]), 50)[0])
        rows = [(1, s, meta) for s in range(100)] * 2 + [(2, 5, meta), (2, 6, meta), (3, 9, meta)] + [(k, s, meta) for k in range(10, 40) for s in range(k % 5)]
        met = jaccard.meetings(spark.createDataFrame(rows, "key long, sid long, meta long"), 85).collect()
        assert sorted(r["b"] for r in met if r["kind"] == 1 and r["a"] == 1) == list(range(100))
        assert {r["a"] for r in met if r["kind"] == 1} == {1}
        total = sum((r["meta"] & 0xFFFFFFFF) for r in met if r["kind"] == 0)
        assert total == 1 + sum((k % 5) * (k % 5 - 1) // 2 for k in range(10, 40)) and schemes
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_marks_make_long_runs(spark):
    """Marks, before or after a run's rows and repeated, make it a long run and are no members."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        meta = int(jaccard._meta(0, True, False, 0, 50))
        least = int(np.iinfo(np.int64).min)
        rows = [(k, s, meta) for k in range(20) for s in range(-1, k % 5)] + [(k, least, jaccard.MARK) for k in range(0, 20, 2)] * 2
        met = jaccard.meetings(spark.createDataFrame(rows, "key long, sid long, meta long"), 85).collect()
        assert sorted((r["a"], r["b"]) for r in met if r["kind"] == 1) == [(k, s) for k in range(0, 20, 2) for s in range(-1, k % 5)]
        assert sum((r["meta"] & 0xFFFFFFFF) for r in met if r["kind"] == 0) == sum((k % 5 + 1) * (k % 5) // 2 for k in range(1, 20, 2))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_components(spark):
    r = random.Random(9)
    links = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1100)] + [(r.randint(2000, 2200), r.randint(2000, 2200)) for _ in range(150)] + [(5, 5)]
    got = {x["node"]: x["component"] for x in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    parent = {x: x for e in links for x in e}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    alone = {a for a, b in links if a == b} - {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: root(x) for x in parent if x not in alone}


@pytest.mark.parametrize("shared", [4096, 4097, 8193])
def test_block_counts_the_last_shared_shingle(shared):
    # each set is linked at common = 85 and union = 100 parts, and not with one shingle of its own more
    alone = shared * 100 // 85 - shared
    a, b = np.arange(shared, dtype=np.uint64), np.arange(shared + alone, dtype=np.uint64)
    assert 100 * shared >= 85 * len(b) > 100 * (shared - 1)
    assert jaccard.block_near([a], [b], 85).tolist() == [[True]]
    assert jaccard.block_near([a], [np.arange(len(b) + 1, dtype=np.uint64), b], 85).tolist() == [[False, True]]


@pytest.mark.parametrize("ids", [lambda i: i // 8, lambda i: None, lambda i: i // 3 if i % 3 else None])
def test_repeated_and_null_ids_with_texts_of_their_own(documents, ids):
    texts = [t for _, t in corpus(5, 12, (30, 80), (2, 5), (0, 4))]
    rows = [(ids(i), t) for i, t in enumerate(texts)] + [(10_000 + i, t + " end") for i, t in enumerate(texts)]
    got = [tuple(x) for x in jaccard.near_duplicates(documents(rows), n=4, percent=85).collect()]
    assert sorted(got, key=str) == brute(rows, 4, 85)


@pytest.mark.parametrize("long_run", [3, 32])
def test_links_are_counted(documents, long_run, monkeypatch):
    # short and long runs, several blocks a key, copies, repeated and null ids
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 16)
    monkeypatch.setattr(jaccard.meetings, "__defaults__", (long_run,))
    rows = corpus(3, 2, (60, 150), (50, 50), (0, 4)) + [(20_000 + i, t) for i, t in corpus(4, 20, (4, 40), (1, 12), (0, 3))]
    rows += [(rows[0][0], rows[1][1]), (None, rows[2][1]), (30_000, rows[3][1]), (30_001, " "), (30_002, None)]
    sets = [shingles(t, 4) for _, t in rows]
    links = [sum(i != j and 100 * len(a & b) >= 85 * len(a | b) > 0 for j, b in enumerate(sets)) for i, a in enumerate(sets)]
    got = jaccard.near_links(documents(rows), n=4, percent=85).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=str) == brute(rows, 4, 85)
    assert sum(links) > 2 * len(rows)
    assert sorted(((r["doc_id"], r["n_shingles"], r["n_links"]) for r in got), key=str) == sorted(((d, len(s), k) for (d, _), s, k in zip(rows, sets, links)), key=str)


def test_no_documents(documents):
    assert jaccard.near_duplicates(documents([])).count() == 0
    assert jaccard.near_duplicates(documents([(1, None), (2, "")])).count() == 2


def test_runs_name_their_pivot_and_what_lies_outside(spark):
    """One join gives a run's members their pivot; of the pieces of a run only the smaller ones are joined."""
    members = spark.createDataFrame([(1, s, 20, 4) for s in (10, 11, 12, 13)] + [(2, 10, 20, 2), (2, 14, 20, 2)], "key long, sid long, n long, members long")
    parts = spark.createDataFrame([(10, 20, 17), (11, 20, 20), (12, 20, 20), (13, 20, 19), (14, 20, 3)], "sid long, n long, common long")
    core = jaccard.core_members(members, parts, 80)
    assert {(r["key"], r["sid"], r["pivot"]["sid"]) for r in core.collect()} == {(1, s, 11) for s in (10, 11, 12, 13)}
    assert {tuple(r) for r in jaccard.pivot_pairs(core, 80).collect()} == {(11, 12), (11, 13)}
    component = spark.createDataFrame([(11, 11), (12, 11), (10, 10), (13, 13)], "node long, component long")
    assert {tuple(r) for r in jaccard.stragglers(core, component).collect()} == {(1, 10), (1, 13)}
    sized = {tuple(r) for r in jaccard.homes(core, members.select("key", "sid", "members")).collect()}
    assert sized == {(s, 1) for s in (10, 11, 12, 13, 14)}


def test_a_set_of_many_runs_is_joined_once_with_its_home(spark, monkeypatch):
    """What homes() and core_members() join, beyond the members themselves, is a row for each set, not for each of its runs."""
    rows = [(k, s, 20, 40) for k in range(1, 31) for s in range(40)] + [(99, s, 20, 3) for s in (0, 50, 51)]
    members = spark.createDataFrame(rows, "key long, sid long, n long, members long")
    joined = []
    plain = jaccard._salted_join
    monkeypatch.setattr(jaccard, "_salted_join", lambda left, *rest, **named: joined.append(left.count()) or plain(left, *rest, **named))
    assert {tuple(r) for r in jaccard.homes(members, members.select("key", "sid", "members")).collect()} == {(s, 30) for s in (*range(40), 50, 51)}
    assert joined == [42]
    joined.clear()
    parts = spark.createDataFrame([(s, 20, 20) for s in (*range(40), 50, 51)], "sid long, n long, common long")
    core = jaccard.core_members(members, parts, 85)
    none = spark.createDataFrame([], "node long, component long")
    left = jaccard.stragglers(core, none, ["key", "sid", "members"])
    assert {(r["key"], r["members"]) for r in left.collect()} == {*((k, 40) for k in range(1, 31)), (99, 3)}
    joined.clear()
    jaccard.home_blocks(core, left, "test-homes")
    assert max(joined) == 40  # one set of each run is its largest component
