"""Best-fit packing into sequences, planned over the histogram of lengths.

A document's tokens and an end token form pieces of at most a sequence's capacity. Pieces of one
length are interchangeable, so best-fit decreasing needs their counts only, of which there are as
many as the capacity at most. The plan is a list of ranges: the pieces of a length whose ranks lie
between two numbers go to consecutive sequences, a fixed number to each. Every piece then finds its
range by its length and its rank among the pieces of that length.

Ranks need no sort. While it encodes, a task counts the pieces of each length that it has made, and
the counts of the tasks before it are added by a join; a length that most documents share is
therefore no hot key.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from risekit.llm import bpe
from risekit.llm.common import slices, small_batches, table, written

CAPACITY = 4096
#: Follows every document.
END_ID = 1
#: Words kept by each Python worker, over its tasks.
CACHE_WORDS = 600_000


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over counts of lengths, all from 1 to capacity.

    A row for each range, in order of length and first: (length, first, sequence, each, offset).
    The piece of that length and rank k lies in sequence + (k - first) // each, at offset +
    (k - first) % each * length. Sequences with equal room are kept as runs of numbers. As what is
    left of a sequence's room is less than half of it whenever pieces of one length fill it, a run
    is used at most log2(capacity) times and a length splits two runs at most.
    """
    rooms: list[int] = []  # sorted, those of open
    runs: dict[int, list[tuple[int, int]]] = {}
    ranges: list[tuple[int, int, int, int, int]] = []
    used = 0

    def leave(room: int, start: int, n: int) -> None:
        if room and n:
            if room not in runs:
                runs[room] = []
                insort(rooms, room)
            runs[room].append((start, n))

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                room, start = capacity, used
                n = -(-left // (capacity // length))
                used += n
            else:
                room = rooms[at]
                start, n = runs[room].pop()
                if not runs[room]:
                    del runs[room], rooms[at]
            each = room // length
            for take, of in ((min(n, left // each), each), (1, left % each)):
                if not n or not take or not of or left < of:
                    continue
                ranges.append((length, rank, start, of, capacity - room))
                leave(room - of * length, start, take)
                rank, left, start, n = rank + take * of, left - take * of, start + take, n - take
            leave(room, start, n)
    return np.array(sorted(ranges), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, part, nth), with_ids also ids: the pieces of each document.

    nth counts the pieces of one length within a task, whose number is part. Nothing is shuffled.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    fields = [("piece", T.IntegerType()), ("start", T.LongType()), ("length", T.LongType()), ("ids_crc32", T.LongType()), ("part", T.IntegerType()), ("nth", T.LongType())]
    schema = T.StructType([source.schema["doc_id"], *[T.StructField(k, t) for k, t in fields + [("ids", T.BinaryType())] * with_ids]])
    end = end_id.to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = bpe.tokenizer(path, CACHE_WORDS, False)
        part, made = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for batch in batches:
            for rows in slices(batch, 1, 1 << 22):
                owner, cells, cut = [], [], []
                for k, ids in enumerate(words.encode_batch(t or "" for t in rows.column(1).to_pylist())):
                    ids += end
                    for i in range(0, len(ids), 4 * capacity):
                        x = ids if len(ids) <= 4 * capacity else ids[i : i + 4 * capacity]
                        n = len(x) // 4
                        owner.append(k)
                        cells.append((i // (4 * capacity), i // 4, n, zlib.crc32(x), part, made[n]))
                        made[n] += 1
                        if with_ids:
                            cut.append(x)
                columns = [pa.array(c, pa.int32() if i in (0, 4) else pa.int64()) for i, c in enumerate(zip(*cells))]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array(owner, pa.int64())), *columns, *[pa.array(cut, pa.binary())] * with_ids], names=schema.names)

    return small_batches(source).mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), with_ids also ids: each piece and its place.

    piece counts a document's pieces from 0 and start is the number of its tokens before the piece.
    A null or empty text is its end token alone. A text longer than the capacity has full pieces and
    a last one. Rows that repeat an id or a text are documents of their own, null ids too. Other
    columns of docs are not read. No rows: no rows. Sequences are numbered from 0; within one, offsets
    leave no gap. Memory: a task holds a slice of texts and one count per length, the driver one
    count per length and the plan.
    """
    spark = docs.sparkSession
    made = written(pieces(docs, path, capacity, end_id, id_col, text_col, with_ids), "packing-pieces")
    counts = made.groupBy("part", "length").agg((F.max("nth") + 1).alias("n"))
    counts = written(counts, "packing-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = made.join(base, ["part", "length"]).withColumn("rank", F.col("base") + F.col("nth"))
    shared = spark.sparkContext.broadcast(plan(histogram, capacity))
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    source = ranked.select(*kept, "rank")
    schema = T.StructType([*[source.schema[c] for c in kept], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = shared.value
        starts = np.searchsorted(ranges[:, 0], np.arange(capacity + 2))  # of each length's ranges
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            low, high = starts[length], starts[length + 1]
            while (open_ := high - low > 1).any():  # all rows search at once for the last range that starts at or before their rank
                middle = (low + high) // 2
                reached = ranges[middle, 1] <= rank
                low, high = np.where(open_ & reached, middle, low), np.where(open_ & ~reached, middle, high)
            _, first, sequence, each, offset = ranges[low].T
            k = rank - first
            found = [pa.array(sequence + k // each), pa.array(offset + k % each * length)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *found], names=schema.names)

    return source.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids, documents) of what pack() returns with_ids: the packed sequences.

    ids holds little-endian unsigned 32-bit integers; documents has a struct (doc_id, piece, offset,
    length) for each piece in order. A sequence has no more pieces than tokens, so groups are small.
    """
    cells = F.array_sort(F.collect_list(F.struct("offset", "length", "piece", "doc_id", "ids")))
    out = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), cells.alias("cells"))
    ids = F.unhex(F.array_join(F.transform("cells", lambda c: F.hex(c["ids"])), ""))
    return out.select("sequence_id", "n_tokens", ids.alias("ids"), F.transform("cells", lambda c: F.struct(c["doc_id"].alias("doc_id"), c["piece"].alias("piece"), c["offset"].alias("offset"), c["length"].alias("length"))).alias("documents"))


def op11_packing(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), bpe.vocabulary_path())
