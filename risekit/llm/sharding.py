"""Sharding by fixed virtual slots.

Records hash into thousands of slots; bytes and rows are aggregated per slot; a versioned map,
stored as Parquet, says which shard owns each slot. Version 1 deals slots round robin. Later ones
are the one before, edited: until the shards' bytes are near equal, or to grow by a shard, which
moves slots into the new shard only. Rows find their shard by joining a stored version. Only the
slot table (a fixed number of rows) reaches the driver.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from risekit.llm.common import new_path, written

N_SHARDS = 16
N_SLOTS = 4096
#: Each slot is numbered in so many lanes, so that no task numbers a whole hot slot.
N_LANES = 16


def rebalance(slot_bytes: list[int], owner: list[int], n_shards: int) -> list[int]:
    """owner, edited: slots move from the heaviest shard to the lightest while that helps."""
    owner = list(owner)
    load = [0] * n_shards
    slots: list[list[tuple[int, int]]] = [[] for _ in range(n_shards)]
    for slot, (size, shard) in enumerate(zip(slot_bytes, owner)):
        load[shard] += size
        if size:
            slots[shard].append((size, slot))
    stuck: set[int] = set()
    for _ in range(4 * len(owner)):
        order = [s for s in range(n_shards) if s not in stuck]
        if not order:
            break
        high, low = max(order, key=load.__getitem__), min(range(n_shards), key=load.__getitem__)
        gap = load[high] - load[low]
        fits = [x for x in slots[high] if x[0] < gap]
        if not fits:
            stuck.add(high)
            continue
        size, slot = min(fits, key=lambda x: (abs(gap - 2 * x[0]), x[1]))
        slots[high].remove((size, slot))
        slots[low].append((size, slot))
        owner[slot] = low
        load[high] -= size
        load[low] += size
        stuck.clear()
    return owner


def grow(slot_bytes: list[int], owner: list[int], n_shards: int) -> list[int]:
    """owner for one more shard: slots of the heaviest shards move into the new one, none elsewhere."""
    owner = list(owner)
    load, slots = [0] * n_shards, [[] for _ in range(n_shards)]
    for slot, (size, shard) in enumerate(zip(slot_bytes, owner)):
        load[shard] += size
        heapq.heappush(slots[shard], (-size, slot))
    share, taken = sum(slot_bytes) / (n_shards + 1), 0
    heap = [(-load[s], s) for s in range(n_shards)]
    heapq.heapify(heap)
    while heap and taken < share:
        weight, shard = heapq.heappop(heap)
        while slots[shard]:
            size, slot = heapq.heappop(slots[shard])
            if taken - size <= share * 1.01:
                owner[slot] = n_shards
                taken -= size
                heapq.heappush(heap, (weight - size, shard))
                break
    return owner


def slot_of(text_hash: Column, id_hash: Column, row: Column, hot: list[int], copies: list[int], n_slots: int) -> Column:
    """Equal texts share a slot, but those of a hot group are dealt out by id, and copies of one id and text row by row."""
    by_text = F.pmod(text_hash, F.lit(n_slots))
    if not hot:
        return by_text
    dealt = F.xxhash64(text_hash, id_hash)
    if copies:
        dealt = F.when(dealt.isin(copies), F.xxhash64(text_hash, id_hash, row)).otherwise(dealt)
    return F.when(text_hash.isin(hot), F.pmod(dealt, F.lit(n_slots))).otherwise(by_text)


def store_map(spark: SparkSession, path: str, version: int, owner: list[int], slot_bytes: list[int], hot: list[int], n_shards: int) -> None:
    """Write a version of the map: (slot, shard, bytes, shards) for every slot, and the hot groups that are dealt out by id.

    A version is a folder of its own, and one that is whole is never changed. The slots' folder is
    written last; what a lost driver left of a version that isn't whole is written over.
    """
    if version in versions(spark, path):
        raise ValueError(f"version {version} of the map is there")
    spark.createDataFrame([(h,) for h in hot], "text_hash long").coalesce(1).write.mode("overwrite").parquet(f"{path}/hot/version={version}")
    rows = [(slot, shard, slot_bytes[slot], n_shards) for slot, shard in enumerate(owner)]
    spark.createDataFrame(rows, "slot int, shard int, bytes long, shards int").coalesce(1).write.mode("overwrite").parquet(f"{path}/slots/version={version}")


def versions(spark: SparkSession, path: str) -> list[int]:
    """The stored versions of a map, in order; none where there is no map."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/slots")
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = [f.getPath() for f in files.listStatus(folder)]
    whole = [p for p in found if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in whole)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """(slot, shard, bytes, shards) of a stored version, the last one if none is named."""
    version = versions(spark, path)[-1] if version is None else version
    return spark.read.schema("slot int, shard int, bytes long, shards int").parquet(f"{path}/slots/version={version}")


def load_hot(spark: SparkSession, path: str, version: int) -> list[int]:
    rows = spark.read.schema("text_hash long").parquet(f"{path}/hot/version={version}").collect()  # fewer than 2 * n_shards rows a version
    return sorted(r["text_hash"] for r in rows)


def _owner(stored: DataFrame) -> tuple[list[int], list[int], int]:
    """owner and bytes of each slot of a stored version, and its number of shards; a fixed number of rows."""
    rows = sorted(tuple(r) for r in stored.select("slot", "shard", "bytes", "shards").collect())
    return [r[1] for r in rows], [r[2] for r in rows], rows[0][3]


def rebalance_map(spark: SparkSession, path: str, slot_bytes: list[int], hot: list[int]) -> int:
    """Edit the last stored version for the slots' bytes of today and store the result; its version."""
    last = versions(spark, path)[-1]
    owner, _, n_shards = _owner(load_map(spark, path, last))
    store_map(spark, path, last + 1, rebalance(slot_bytes, owner, n_shards), slot_bytes, hot, n_shards)
    return last + 1


def grow_map(spark: SparkSession, path: str) -> int:
    """Edit the last stored version for one more shard and store the result; its version."""
    last = versions(spark, path)[-1]
    owner, slot_bytes, n_shards = _owner(load_map(spark, path, last))
    store_map(spark, path, last + 1, grow(slot_bytes, owner, n_shards), slot_bytes, load_hot(spark, path, last), n_shards + 1)
    return last + 1


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, th, row) of each row: what placing it needs, without its text; row is a number of its own."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = (F.octet_length(text) + 1).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("th"), F.monotonically_increasing_id().alias("row"))


def hot_groups(light: DataFrame, n_shards: int) -> list[int]:
    """Hashes of the texts that hold more than a shard's fair part of all bytes or rows: fewer than 2 * n_shards."""
    groups = light.groupBy("th").agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    total = light.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("tb"), F.count("*").alias("tn")).first()
    large = groups.where((F.col("b") * n_shards > total["tb"]) | (F.col("n") * n_shards > total["tn"]))
    return sorted(r["th"] for r in large.select("th").collect())


def hot_copies(light: DataFrame, hot: list[int], n_shards: int) -> list[int]:
    """Of hot groups, hashes of an id and text that hold more than a sixteenth of a shard's fair part: fewer than 32 * n_shards."""
    if not hot:
        return []
    groups = light.where(F.col("th").isin(hot)).groupBy(F.xxhash64("th", F.xxhash64("doc_id")).alias("pair")).agg(F.sum("size").alias("b"), F.count("*").alias("n"))
    total = light.agg(F.sum("size").alias("tb"), F.count("*").alias("tn")).first()
    part = 16 * n_shards
    large = groups.where(((F.col("b") * part > total["tb"]) | (F.col("n") * part > total["tn"])) & (F.col("n") > 1))
    return sorted(r["pair"] for r in large.select("pair").collect())


def placed(light: DataFrame, hot: list[int], copies: list[int], n_slots: int) -> DataFrame:
    """light with its virtual_slot and lane."""
    slot = slot_of(F.col("th"), F.xxhash64("doc_id"), F.col("row"), hot, copies, n_slots).cast("int")
    return light.withColumn("virtual_slot", slot).withColumn("lane", F.pmod(F.xxhash64("doc_id", "size"), F.lit(N_LANES)).cast("int"))


def assigned(rows: DataFrame, lanes: DataFrame, stored: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot, shard, slot: placed rows joined with a stored version of the map.

    slot numbers a shard's rows from 0 without a gap, by (virtual slot, lane, id, text hash); lanes
    counts the rows of each lane, n_slots * N_LANES rows at most.
    """
    owned = lanes.join(F.broadcast(stored.select(F.col("slot").alias("virtual_slot"), "shard")), "virtual_slot")
    before = Window.partitionBy("shard").orderBy("virtual_slot", "lane").rowsBetween(Window.unboundedPreceding, -1)
    start = owned.select("virtual_slot", "lane", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    number = F.row_number().over(Window.partitionBy("virtual_slot", "lane").orderBy("doc_id", "th"))
    numbered = rows.withColumn("n", number).join(F.broadcast(start), ["virtual_slot", "lane"])
    return numbered.select("doc_id", "size", "text_crc32", "virtual_slot", "shard", (F.col("start") + F.col("n") - 1).cast("long").alias("slot"))


def shard_rows(
    docs: DataFrame,
    map_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    n_shards: int = N_SHARDS,
    n_slots: int = N_SLOTS,
) -> DataFrame:
    """A row per document: doc_id, size, text_crc32, virtual_slot, shard, slot, by the map at map_path.

    Without a stored map, version 1 deals n_slots slots to n_shards round robin. The last version is edited by the
    bytes of today, the result is stored as the next one, and rows are placed by joining it.

    size is the text's UTF-8 bytes plus 1 (null: 1). Equal texts share a virtual slot and so a
    shard, unless they hold more than a shard's fair part of all bytes or rows: such a group (there
    are fewer than 2 * n_shards) is dealt over all slots by id, and the copies of one id in it row by
    row, so that shards stay near equal; once dealt out it stays so in later versions. Rows that
    repeat an id each get a slot of their own.
    Null ids are one id. No rows: an empty result.
    """
    spark = docs.sparkSession
    light = written(sized(docs, id_col, text_col), "shard-rows")
    stored = versions(spark, map_path)
    if stored:  # a stored map's slots and shards are what they are
        owner, _, n_shards = _owner(load_map(spark, map_path))
        n_slots = len(owner)
    hot = hot_groups(light, n_shards)
    if stored:
        hot = sorted({*hot, *load_hot(spark, map_path, stored[-1])})
    else:
        store_map(spark, map_path, 1, [s % n_shards for s in range(n_slots)], [0] * n_slots, hot, n_shards)
    rows = placed(light, hot, hot_copies(light, hot, n_shards), n_slots)
    lanes = written(rows.groupBy("virtual_slot", "lane").agg(F.sum("size").alias("b"), F.count("*").alias("n")), "shard-lanes")
    slot_bytes = [0] * n_slots
    for r in lanes.groupBy("virtual_slot").agg(F.sum("b").alias("b")).collect():  # n_slots rows at most
        slot_bytes[r["virtual_slot"]] = r["b"]
    version = rebalance_map(spark, map_path, slot_bytes, hot)
    return assigned(rows, lanes, load_map(spark, map_path, version))


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = shard_rows(docs, new_path(spark, "shard-map"))
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )
