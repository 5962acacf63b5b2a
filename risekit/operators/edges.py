"""Edge pixels: gradients, thinning across the edge, and weak edges that reach a strong one.

A frame is cut into tiles with a margin of two pixels, which hold all that a tile's own pixels need.
Each tile thins its gradients and labels the connected candidates inside of it. Labels that touch
across a tile's border are then linked, a frame at a time, and a component stays where it has a
strong pixel in any of its tiles. Only candidates next to a border take part in the linking.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from risekit.scratch import scratch_path

TILE, MARGIN = 256, 2
#: Pixels of tiles of one shape that are thinned together.
CELLS = 1 << 18
#: Tangent of an eighth of a half turn: below it a gradient counts as level, above 2 more as upright, else as diagonal.
SLANT = 0.41421356237309503


def _shifted(a: np.ndarray, dy: int, dx: int) -> np.ndarray:
    """a[..., y + dy, x + dx] at each place, 0 outside."""
    out = np.zeros_like(a)
    h, w = a.shape[-2:]
    out[..., max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = a[..., max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
    return out


def thinned(v: np.ndarray) -> np.ndarray:
    """Gradient strength |gx| + |gy| where it is largest across the edge, else 0; beyond the border the last pixel repeats. v is a patch or a stack of them."""
    p = np.pad(v.astype(np.int64), [(0, 0)] * (v.ndim - 2) + [(1, 1)] * 2, mode="edge")
    rows = p[..., :-2, :] + 2 * p[..., 1:-1, :] + p[..., 2:, :]
    columns = p[..., :-2] + 2 * p[..., 1:-1] + p[..., 2:]
    gx, gy = rows[..., 2:] - rows[..., :-2], columns[..., 2:, :] - columns[..., :-2, :]
    x, y = np.abs(gx), np.abs(gy)
    m = x + y
    near = {(dy, dx): _shifted(m, dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)}
    level, upright = y < x * SLANT, y > x * (SLANT + 2)
    falling = (gx >= 0) == (gy >= 0)
    before, after = np.where(falling, near[-1, -1], near[-1, 1]), np.where(falling, near[1, 1], near[1, -1])
    across = np.where(level, (m > near[0, -1]) & (m >= near[0, 1]), np.where(upright, (m > near[-1, 0]) & (m >= near[1, 0]), (m > before) & (m > after)))
    return np.where(across, m, 0)


def rooted(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest one that links (a, b) reach, by hooking roots and halving paths."""
    root = np.arange(n)
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            return root
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root = root[root]


def edge_pixels(pixels: DataFrame, lower: Column, upper: Column, tile: int = TILE) -> DataFrame:
    """(frame_id, x, y) of the edges of frames (frame_id, x, y, v), whole numbers, each frame a full rectangle.

    A pixel is a candidate where its thinned gradient is above lower, and strong above upper (columns
    of pixels, equal within a frame). Candidates stay where they are connected, by sides or corners,
    to a strong one. Frames without an id and no rows give no rows. tile is 4 at least.
    """
    spark = pixels.sparkSession
    cell = lambda c, d: F.floor((F.col(c) + d) / tile)
    homes = F.array_distinct(F.array(*[F.struct(cell("x", i).alias("tx"), cell("y", j).alias("ty")) for i in (-MARGIN, MARGIN) for j in (-MARGIN, MARGIN)]))
    whole = [F.col(c).cast("long").alias(c) for c in ("x", "y", "v")]
    dealt = pixels.where("frame_id IS NOT NULL").select("frame_id", *whole, lower.cast("double").alias("lower"), upper.cast("double").alias("upper"), F.explode(homes).alias("t")).select("*", "t.*").drop("t")
    schema = T.StructType([pixels.schema["frame_id"], *[T.StructField(*x) for x in (("x", T.LongType()), ("y", T.LongType()), ("strong", T.BooleanType()), ("label", T.LongType()))]])

    def candidates(n: int, h: int, w: int, at: np.ndarray, place: tuple, values: np.ndarray, per: dict[str, np.ndarray]) -> tuple:
        """Tile, x, y, strong and label of the candidates of n tiles of one shape, side by side in a stack."""
        x, y = place
        patch = np.zeros((n, h, w), np.int64)
        patch[at, y - per["y0"][at], x - per["x0"][at]] = values
        m = thinned(patch)
        m[(np.arange(h) + per["y0"][:, None]) // tile != per["ty"][:, None]] = 0  # the margin is another tile's
        m.transpose(0, 2, 1)[(np.arange(w) + per["x0"][:, None]) // tile != per["tx"][:, None]] = 0
        k, py, px = np.nonzero(m > per["lower"][:, None, None])
        number = np.full((n, h + 2, w + 2), -1)
        number[k, py + 1, px + 1] = np.arange(len(k))
        ends = [(np.arange(len(k)), number[k, py + 1 + dy, px + 1 + dx]) for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1))]
        a, b = (np.concatenate(e) for e in zip(*[(i[j >= 0], j[j >= 0]) for i, j in ends]))
        root = rooted(len(k), a, b)
        x, y = px + per["x0"][k], py + per["y0"][k]
        return k, x, y, m[k, py, px] > per["upper"][k], (y[root] << 32) + x[root]

    def starts(rows: pa.Table) -> tuple[np.ndarray, pa.DictionaryArray]:
        """Where tiles begin in rows in order of tiles, and the frames."""
        frames = rows.column("frame_id").combine_chunks().dictionary_encode()
        keys = np.stack([frames.indices.to_numpy(), *(rows.column(c).to_numpy() for c in ("tx", "ty"))])
        return np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(0)]), frames

    def whole_tiles(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        first, frames = starts(rows)
        x, y, v = (rows.column(c).to_numpy() for c in ("x", "y", "v"))
        per = {c: rows.column(c).to_numpy()[first] for c in ("tx", "ty", "lower", "upper")} | {"x0": np.minimum.reduceat(x, first), "y0": np.minimum.reduceat(y, first)}
        h, w = np.maximum.reduceat(y, first) - per["y0"] + 1, np.maximum.reduceat(x, first) - per["x0"] + 1
        of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(x)]))
        for high, wide in np.unique(np.stack([h, w]), axis=1).T.tolist():
            alike = np.flatnonzero((h == high) & (w == wide))
            most = max(1, CELLS // (high * wide))
            for some in (alike[i : i + most] for i in range(0, len(alike), most)):
                at = np.full(len(first), -1)
                at[some] = np.arange(len(some))
                mine = np.flatnonzero(at[of] >= 0)
                k, *cells = candidates(len(some), high, wide, at[of[mine]], (x[mine], y[mine]), v[mine], {c: p[some] for c, p in per.items()})
                frame = frames.dictionary.take(frames.indices.take(pa.array(first[some][k])))
                yield pa.RecordBatch.from_arrays([frame, *map(pa.array, cells)], names=schema.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last tile may go on in the next batch
        for batch in batches:
            if batch.num_rows:
                rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
                last = int(starts(rows)[0][-1])
                if last:
                    yield from whole_tiles(rows[:last])
                held = rows[last:]
        if held is not None:
            yield from whole_tiles(held)

    path = scratch_path(spark, "edge-candidates")
    ordered = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "frame_id", "tx", "ty").sortWithinPartitions("frame_id", "tx", "ty")
    ordered.mapInArrow(run, schema).write.parquet(path)
    found = spark.read.schema(schema).parquet(path)
    places = [F.col(c) % tile for c in ("x", "y")]
    border = found.where(places[0].isin(0, tile - 1) | places[1].isin(0, tile - 1)).select("frame_id", "x", "y", "label")
    steps = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (-1, 1), (0, 1), (1, 1))])).alias("d")
    reached = border.select("frame_id", F.col("label").alias("other"), "x", "y", steps).select("frame_id", "other", (F.col("x") + F.col("d.i")).alias("x"), (F.col("y") + F.col("d.j")).alias("y"))
    links = reached.join(border, ["frame_id", "x", "y"]).where("label <> other").select("frame_id", "label", "other").distinct()

    def linked(group: pa.Table) -> pa.Table:
        names, ends = np.unique(np.r_[group.column("label").to_numpy(), group.column("other").to_numpy()], return_inverse=True)
        root = names[rooted(len(names), *np.split(ends, 2))]
        frame = pa.array([group.column("frame_id")[0].as_py()] * len(names), group.schema.field("frame_id").type)
        return pa.table([frame, pa.array(names), pa.array(root)], names=["frame_id", "label", "root"])

    roots = links.groupBy("frame_id").applyInArrow(linked, T.StructType([schema["frame_id"], T.StructField("label", T.LongType()), T.StructField("root", T.LongType())]))
    rows = found.join(roots, ["frame_id", "label"], "left").withColumn("root", F.coalesce("root", "label"))
    kept = rows.groupBy("frame_id", "root").agg(F.max("strong").alias("strong")).where("strong")
    return rows.join(kept.select("frame_id", "root"), ["frame_id", "root"], "left_semi").select("frame_id", "x", "y")
