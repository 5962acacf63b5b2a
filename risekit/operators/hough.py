"""Straight segments in edge pixels: votes for lines, then runs along the lines that have enough.

A pixel votes for one distance at each of 180 angles. Tasks count the votes of their batches before
anything is shuffled. A line stays where it has enough votes and more than its neighbours in angle
and distance. Along each line pixels are put in order and cut into runs at gaps. Sines and cosines
are whole numbers (2 ** -16 each), so that distances are exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

ANGLES, ONE = 180, 1 << 16
COS, SIN = ([round(f(math.pi * a / ANGLES) * ONE) for a in range(ANGLES)] for f in (math.cos, math.sin))
#: Pixels of a frame whose votes are counted together.
PIXELS = 4096
#: Distances are less than half of this from 0, as idx has so many of them; places and coordinates then are less than it.
PLACES = 1 << 20


def _table(values: list[int]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.col("angle"))


def dealt(rows: DataFrame) -> DataFrame:
    """Rows by frame over all shuffle partitions, as many in all uses, so that they join without another shuffle."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "frame_id")


def _place(c: str) -> Column:
    """x and y of a place along a line."""
    x, y = ((F.shiftright(c, n).bitwiseAND(2 * PLACES - 1) - PLACES).alias(k) for k, n in (("x", 21), ("y", 0)))
    return F.struct(x, y).alias(c)


def lines(edges: DataFrame, threshold: int) -> DataFrame:
    """(frame_id, angle, distance, votes) of the lines with threshold votes or more of edges (frame_id, x, y)."""
    schema = T.StructType([edges.schema["frame_id"], *[T.StructField(*x) for x in (("angle", T.IntegerType()), ("distance", T.LongType()), ("votes", T.LongType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cos, sin, angle = np.array(COS), np.array(SIN), np.arange(ANGLES)
        for batch in batches:
            frames = batch.column(0).dictionary_encode()
            x, y = (batch.column(i).to_numpy() for i in (1, 2))
            code = frames.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(code[order])) + 1):
                for part in (rows[i : i + PIXELS] for i in range(0, len(rows), PIXELS)):
                    d = (x[part, None] * cos + y[part, None] * sin + ONE // 2) >> 16
                    low = int(d.min())
                    votes = np.bincount((angle * (int(d.max()) - low + 1) + d - low).ravel())
                    at = np.flatnonzero(votes)
                    a, k = np.divmod(at, int(d.max()) - low + 1)
                    name = frames.dictionary.take(pa.array(np.full(len(at), code[part[0]])))
                    yield pa.RecordBatch.from_arrays([name, pa.array(a.astype(np.int32)), pa.array(k + low), pa.array(votes[at])], names=schema.names)

    whole = edges.where("frame_id IS NOT NULL").select("frame_id", F.col("x").cast("long"), F.col("y").cast("long"))
    votes = whole.mapInArrow(run, schema).groupBy("frame_id", "angle", "distance").agg(F.sum("votes").alias("votes")).where(F.col("votes") >= threshold)
    # votes, then the smaller angle, then the smaller distance: in one number, as numbers are compared without a sort
    own = F.shiftleft(F.col("votes"), 28) + F.shiftleft((ANGLES - 1 - F.col("angle")).cast("long"), 20) + ((PLACES >> 1) - 1 - F.col("distance"))
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])).alias("d")
    here = (F.col("d.i") == 0) & (F.col("d.j") == 0)
    seen = dealt(votes).select("frame_id", "angle", "distance", own.alias("own"), steps)
    seen = seen.select("frame_id", (F.col("angle") + F.col("d.i")).alias("angle"), (F.col("distance") + F.col("d.j")).alias("distance"), F.when(here, F.col("own")).alias("mine"), F.when(~here, F.col("own")).alias("other"))
    best = seen.groupBy("frame_id", "angle", "distance").agg(F.max("mine").alias("mine"), F.max("other").alias("other"))  # within a frame's task
    return best.where((F.col("mine") > F.col("other")) | (F.col("mine").isNotNull() & F.col("other").isNull())).select("frame_id", "angle", "distance", F.shiftright("mine", 28).alias("votes"))


def segments(edges: DataFrame, threshold: int, min_length: int, max_gap: int) -> DataFrame:
    """(frame_id, idx, x1, y1, x2, y2): runs of edge pixels along the lines of a frame, in order of frame_id and idx.

    Neighbours along a line are max_gap steps apart at most; a segment is at least min_length wide or
    high. idx is ordered by angle, distance and place. A pixel may lie on several lines.
    """
    found = lines(edges, threshold)
    found = found.drop("votes")
    at = dealt(edges.select("frame_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"))).join(found, "frame_id")
    cos, sin = _table(COS).cast("long"), _table(SIN).cast("long")
    on = at.where(F.shiftright(F.col("x") * cos + F.col("y") * sin + ONE // 2, 16) == F.col("distance"))
    t = F.shiftright(F.col("y") * cos - F.col("x") * sin + ONE // 2, 16)
    # place along the line, x and y in one number, which is in their order
    place = F.shiftleft(t + PLACES, 42) + F.shiftleft(F.col("x") + PLACES, 21) + F.col("y") + PLACES
    placed = on.select("frame_id", "angle", "distance", place.alias("q"))
    line = Window.partitionBy("frame_id", "angle", "distance").orderBy("q")
    so_far = line.rowsBetween(Window.unboundedPreceding, 0)
    steps = placed.withColumns({"back": F.lag("q").over(line), "ahead": F.lead("q").over(line)})
    apart = lambda p, q: F.shiftright(q, 42) - F.shiftright(p, 42) > max_gap
    new = F.coalesce(apart(F.col("back"), F.col("q")), F.lit(True))
    runs = steps.withColumns({"run": F.sum(new.cast("int")).over(so_far), "p": F.last(F.when(new, F.col("q")), True).over(so_far)})
    ends = runs.where(F.coalesce(apart(F.col("q"), F.col("ahead")), F.lit(True))).select("frame_id", "angle", "distance", "run", _place("p"), _place("q"))
    long = ends.where(F.greatest(F.abs(F.col("q.x") - F.col("p.x")), F.abs(F.col("q.y") - F.col("p.y"))) >= min_length)
    idx = (F.col("angle") * PLACES + F.col("distance") + (PLACES >> 1)) * PLACES + F.col("run")
    return long.select("frame_id", idx.alias("idx"), *[F.col(f"{e}.{c}").cast("int").alias(f"{c}{i}") for i, e in ((1, "p"), (2, "q")) for c in ("x", "y")])
