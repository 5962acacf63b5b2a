import os
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash

from risekit.llm import queries, sharding
from risekit.llm.common import new_path

SF = "/root/testdata/sf0.01"


def check(rows, n_shards):
    size, slots = Counter(), defaultdict(list)
    for r in rows:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return [size[s] for s in range(n_shards)]


def test_whole_table(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.queries()["op6_sharding"](spark, SF).collect()
    assert {r["doc_id"] for r in rows} == set(docs) and len(rows) == len(docs)
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
    loads = check(rows, 16)
    assert max(loads) - min(loads) < 0.01 * sum(loads) / 16
    homes = defaultdict(set)
    for r in rows:
        homes[docs[r["doc_id"]]].add(r["shard"])
    assert all(len(h) == 1 for h in homes.values())


@pytest.fixture
def path(spark):
    return new_path(spark, "test-map")


def hash64(*values):
    """Spark's xxhash64 of longs and strings; nulls leave the seed as it is."""
    seed = 42
    for v in values:
        if v is not None:
            seed = xxhash.xxh64(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed=seed).intdigest()
    return seed - (1 << 64) if seed >= 1 << 63 else seed


def brute(rows, n_shards, n_slots):
    """(doc_id, size, crc, slot of the map, shard, slot) of each row, by lists and loops."""
    light = [(d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), hash64(t or "")) for d, t in rows]
    group_bytes, group_rows = Counter(), Counter()
    for _, size, _, h in light:
        group_bytes[h] += size
        group_rows[h] += 1
    hot = {h for h in group_rows if group_bytes[h] * n_shards > sum(group_bytes.values()) or group_rows[h] * n_shards > len(rows)}
    virtual = [(hash64(h, hash64(d)) if h in hot else h) % n_slots for d, _, _, h in light]
    weight = Counter()
    for v, (_, size, _, _) in zip(virtual, light):
        weight[v] += size
    owner, stuck = {v: v % n_shards for v in range(n_slots)}, set()
    while len(stuck) < n_shards:
        load = Counter({k: 0 for k in range(n_shards)})
        for v, k in owner.items():
            load[k] += weight[v]
        high = max((k for k in range(n_shards) if k not in stuck), key=lambda k: load[k])
        low = min(range(n_shards), key=lambda k: load[k])
        gap = load[high] - load[low]
        fits = sorted((abs(gap - 2 * weight[v]), v) for v, k in owner.items() if k == high and 0 < weight[v] < gap)
        if fits:
            owner[fits[0][1]] = low
            stuck.clear()
        else:
            stuck.add(high)
    order = sorted(range(len(rows)), key=lambda i: (virtual[i], hash64(light[i][0], light[i][1]) % sharding.N_LANES, light[i][0] is not None, light[i][0] or 0, light[i][3]))
    used, out = Counter(), []
    for i in order:
        shard = owner[virtual[i]]
        out.append((*light[i][:3], virtual[i], shard, used[shard]))
        used[shard] += 1
    return sorted(out, key=str)


def test_against_brute_force(documents, path):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i} é " * (1 + i % 7)) for i in range(600)] + [(1, "again"), (1, "again"), (None, None), (None, None), (5000, "")]
    got = [tuple(r) for r in sharding.shard_rows(documents(rows), path, n_shards=5, n_slots=64).collect()]
    assert sorted(got, key=str) == brute(rows, 5, 64)


def test_hot_group_is_dealt_out(documents, path):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i} " * (1 + i % 7)) for i in range(3000)] + [(1, "again"), (None, None), (None, None), (5000, "")]
    got = sharding.shard_rows(documents(rows), path).collect()
    assert len(got) == len(rows)
    loads = check(got, 16)
    assert max(loads) < 1.02 * min(loads)


@pytest.mark.parametrize("other", [None, 7])
def test_hot_copies_of_one_id_are_dealt_out(documents, path, other):
    rows = [(other, "copy " * 20)] * 1000 + [(i, f"text {i} " * (1 + i % 3)) for i in range(2000)]
    got = sharding.shard_rows(documents(rows).repartition(3), path).collect()
    assert len(got) == 3000
    loads = check(got, 16)
    assert max(loads) < 1.02 * min(loads)
    assert len({r["virtual_slot"] for r in got if r["size"] == 101 and r["doc_id"] == other}) > 500


def test_a_version_that_a_lost_driver_left_is_written_over(spark, documents, path):
    rows = [(i, f"t{i}") for i in range(50)]
    sharding.shard_rows(documents(rows), path, n_shards=3, n_slots=32)
    spark.createDataFrame([(1,)], "text_hash long").write.parquet(f"{path}/hot/version=3")  # and no slots
    spark.createDataFrame([(1,)], "slot int").write.parquet(f"{path}/slots/version=4")
    os.remove(path.removeprefix("file:") + "/slots/version=4/_SUCCESS")
    assert sharding.versions(spark, path) == [1, 2]
    assert sharding.grow_map(spark, path) == 3 and sharding.grow_map(spark, path) == 4
    assert sharding.load_map(spark, path).count() == 32 and sharding.load_hot(spark, path, 3) == []
    with pytest.raises(ValueError):
        sharding.store_map(spark, path, 4, [0], [0], [], 1)


def test_a_last_shard_without_slots_is_kept(spark, path):
    sharding.store_map(spark, path, 1, [0, 0, 1, 1], [4, 4, 4, 4], [], 3)
    assert sharding.grow_map(spark, path) == 2
    assert {r["shard"] for r in sharding.load_map(spark, path).collect()} == {0, 1, 3}
    assert {r["shards"] for r in sharding.load_map(spark, path).collect()} == {4}


def test_stored_map_is_edited(spark, documents, path):
    rows = [(i, f"t{i} " * (1 + i % 9)) for i in range(500)]
    first = {r["doc_id"]: (r["virtual_slot"], r["shard"]) for r in sharding.shard_rows(documents(rows), path, n_shards=4, n_slots=128).collect()}
    assert sharding.versions(spark, path) == [1, 2]
    grown = sharding.grow_map(spark, path)
    by = {v: {r["slot"]: r["shard"] for r in sharding.load_map(spark, path, v).collect()} for v in (1, 2, grown)}
    assert grown == 3 and all(set(m) == set(range(128)) for m in by.values())
    moved = {s: by[3][s] for s in by[2] if by[2][s] != by[3][s]}
    assert moved and set(moved.values()) == {4}
    # rows of another day land by the edited map: documents of slots that did not move keep their shard
    later = rows + [(1000 + i, f"u{i} " * (1 + i % 50)) for i in range(60)]
    second = {r["doc_id"]: (r["virtual_slot"], r["shard"]) for r in sharding.shard_rows(documents(later), path).collect()}
    assert sharding.versions(spark, path) == [1, 2, 3, 4] and sharding.load_map(spark, path).count() == 128
    last = {r["slot"]: r["shard"] for r in sharding.load_map(spark, path).collect()}
    assert {r["slot"]: r["shard"] for r in sharding.load_map(spark, path, 2).collect()} == by[2]
    assert all(second[d] == (slot, last[slot]) for d, (slot, _) in first.items())
    unmoved = [d for d, (slot, _) in first.items() if by[2][slot] == last[slot]]
    assert len(unmoved) > 200 and all(second[d] == first[d] for d in unmoved)


def test_growing_takes_a_fair_share():
    sizes = [1 + i % 13 for i in range(1000)]
    owner = sharding.rebalance(sizes, [i % 4 for i in range(1000)], 4)
    grown = sharding.grow(sizes, owner, 4)
    load = Counter()
    for s, o in zip(sizes, grown):
        load[o] += s
    assert load[4] == pytest.approx(sum(sizes) / 5, rel=0.05)
    assert max(load.values()) < 1.1 * min(load.values())


def test_empty_table(spark, documents, path):
    assert sharding.shard_rows(documents([]), path).count() == 0
    assert sharding.load_map(spark, path).count() == sharding.N_SLOTS
