"""Chat formatting with cumulative-snapshot collapse.

Chat logs often hold a conversation many times, each a snapshot a few turns longer. Every turn
gets a rolling hash of its conversation up to it; a conversation whose full hash is the hash of
some longer conversation's prefix is a snapshot and goes, and of equal conversations the one with
the smallest id stays. What stays is rendered turn by turn into marked-up text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from risekit.llm.common import written

#: A rendered row has so many turns at most; longer conversations get several, numbered by part.
TURNS_PER_PART = 64


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text, h1, h2): turns numbered from 1, with rolling prefix hashes.

    turns is dealt in ranges of (conv_id, turn, role, text), so a conversation with a third of all
    rows spreads over many tasks. Each range numbers and hashes its own piece of a conversation,
    and the pieces' counts and hashes carry over. The rolling hash of a prefix is the XOR of
    hashes that hold each turn's position, so pieces combine in any order.
    """
    order = ["turn", "role", "text"]
    ranged = turns.repartitionByRange("conv_id", *order).withColumn("piece", F.spark_partition_id())
    ranged = written(ranged, "chat-turns")
    inside = Window.partitionBy("conv_id", "piece").orderBy(*order)
    pieces = ranged.groupBy("conv_id", "piece").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    offset = pieces.select(F.col("conv_id").alias("c"), F.col("piece").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    placed = (
        ranged.withColumn("i", F.row_number().over(inside))
        .join(offset, ranged["conv_id"].eqNullSafe(offset["c"]) & (ranged["piece"] == offset["p"]))
        .withColumn("pos", (F.col("offset") + F.col("i")).cast("long"))
    )
    turn = ["pos", F.isnull("role"), "role", F.isnull("text"), "text"]  # a hash passes over nulls, so they are named
    hashed = placed.select("conv_id", "piece", "pos", "role", "text", F.xxhash64(*turn).alias("x1"), F.xxhash64(F.lit("second"), *turn).alias("x2"))
    hashed = written(hashed, "chat-hashed")
    totals = hashed.groupBy("conv_id", "piece").agg(F.expr("bit_xor(x1)").alias("x1"), F.expr("bit_xor(x2)").alias("x2"))
    carried = totals.select(
        F.col("conv_id").alias("c"),
        F.col("piece").alias("p"),
        F.coalesce(F.expr("bit_xor(x1)").over(before), F.lit(0)).alias("c1"),
        F.coalesce(F.expr("bit_xor(x2)").over(before), F.lit(0)).alias("c2"),
    )
    so_far = Window.partitionBy("conv_id", "piece").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rolling = hashed.withColumn("r1", F.expr("bit_xor(x1)").over(so_far)).withColumn("r2", F.expr("bit_xor(x2)").over(so_far))
    joined = rolling.join(carried, rolling["conv_id"].eqNullSafe(carried["c"]) & (rolling["piece"] == carried["p"]))
    return joined.select("conv_id", "pos", "role", "text", F.col("r1").bitwiseXOR(F.col("c1")).alias("h1"), F.col("r2").bitwiseXOR(F.col("c2")).alias("h2"))


def collapse_snapshots(conversations: DataFrame) -> DataFrame:
    """The maximal conversations' turns: (conv_id, pos, role, text).

    Rows that repeat (conv_id, turn, role, text) are one turn. Turns are ordered by (turn, role,
    text), nulls first, so ties are defined. Rows with a null conv_id are one conversation. A null
    role or text differs from an empty one, and a null role before a text from that text as the role
    of a null. Other columns are not read. An empty table gives an empty result.
    """
    turns = conversations.select("conv_id", "turn", "role", "text").distinct()
    hashed = written(prefix_hashes(turns), "chat-prefixes")
    length = hashed.groupBy(F.col("conv_id").alias("c")).agg(F.max("pos").alias("end"))
    full = hashed.join(length, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") == F.col("end"))).select(F.col("conv_id").alias("c"), "end", "h1", "h2")
    full = written(full, "chat-full")
    # of equal conversations the one with the smallest id stays; then those that are a proper prefix of another go
    first = F.min_by(F.struct("c"), F.struct(F.col("c").isNull(), "c"))
    unique = full.groupBy(F.col("end").alias("pos"), "h1", "h2").agg(first.alias("k"))
    inner = hashed.join(full.select("c", "end"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("pos") < F.col("end")), "left_semi")
    prefixes = inner.select("pos", "h1", "h2").distinct()
    maximal = unique.join(prefixes, ["pos", "h1", "h2"], "left_anti").select(F.col("k.c").alias("keep"))
    return hashed.join(maximal, F.col("conv_id").eqNullSafe(F.col("keep")), "left_semi").select("conv_id", "pos", "role", "text")


def render(turns: DataFrame, per_part: int = TURNS_PER_PART) -> DataFrame:
    """(conv_id, part, n_turns, rendered): each turn as ``<|im_start|>role\\ntext<|im_end|>\\n``, in order."""
    marked = F.concat(F.lit("<|im_start|>"), F.coalesce("role", F.lit("")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("<|im_end|>\n"))
    parts = turns.select("conv_id", F.floor((F.col("pos") - 1) / per_part).cast("long").alias("part"), F.struct("pos", marked.alias("m")).alias("turn"))
    grouped = parts.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    return grouped.select("conv_id", "part", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.col("turns.m"), "").alias("rendered"))


def op10_chat_format(spark, sf_dir: str) -> DataFrame:
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return render(collapse_snapshots(conversations))


def op10_sql() -> str:
    return f"""
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
placed AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS pos FROM turns),
prefixes AS (
  SELECT conv_id, pos, count(*) OVER (PARTITION BY conv_id) AS n,
         string_agg(chr(1) || role || chr(2) || text, chr(3)) OVER (PARTITION BY conv_id ORDER BY pos) AS prefix
  FROM placed),
ends AS (SELECT prefix, min(conv_id) AS conv_id FROM prefixes WHERE pos = n GROUP BY prefix),
kept AS (SELECT conv_id FROM ends WHERE prefix NOT IN (SELECT prefix FROM prefixes WHERE pos < n))
SELECT conv_id, (pos - 1) // {TURNS_PER_PART} AS part, count(*) AS n_turns,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY pos) AS rendered
FROM placed WHERE conv_id IN (SELECT conv_id FROM kept)
GROUP BY conv_id, (pos - 1) // {TURNS_PER_PART}
"""
