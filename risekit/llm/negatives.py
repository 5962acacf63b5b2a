"""Hard negatives by inner product, with coordinate pruning in length buckets.

Rows are dealt by label and length into blocks of rows of one label and about one length, which keep
a sorted list for each coordinate of their unit vectors. Where an anchor needs a score of at least
t, a row of a block must lie within an angle d of it, with cos d = t / (anchor's length x largest
length of the block). The angles of both to an axis then differ by d at most, so each coordinate of
the row has a feasible range. Ranges of the anchor's largest (focus) coordinates are looked up in the
sorted lists, the candidates of the shortest are intersected with the others, and what is left is
verified by exact integer products. Where ranges keep most of a block, all of it is verified at once.

Anchors are a query set: they are searched in blocks of bounded size, against all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from risekit.llm.common import table, written

POSITIVES, NEGATIVES = 5, 3
#: Per cent of the positive's score that a negative's lies between.
LOW, HIGH = 50, 95
BLOCK_ROWS = 4096
#: A block ends where lengths fall below this part of its largest, if it has so many rows.
SHORTER, LEAST_ROWS = 0.9, 32
#: Coordinates of an anchor whose ranges are intersected.
FOCUS = 4
#: Ranges that keep more of a block are not used.
MOST_KEPT = 0.25
#: Bytes of anchors searched in one pass.
ANCHOR_BYTES = 8 << 20
SLACK = 1e-9


def _matrix(vectors: pa.Array, dims: int | None = None) -> np.ndarray:
    """Rows of a list column as integers, shorter ones filled up with zeros."""
    size = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(size), max([1, *size]) if dims is None else dims), np.int64)
    out[np.repeat(np.arange(len(size)), size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = vectors.flatten().to_numpy()
    return out


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((v.astype(np.float64) ** 2).sum(1))
    return v / np.maximum(norm, 1e-300)[:, None], norm


def blocks(rows: DataFrame) -> DataFrame:
    """rows (id, vector array<long>, label, anchor boolean) as blocks, one row each: (label, row, longest, ids, anchors, vectors, dims, lists).

    row numbers the block's first row, ids and anchors are arrays, vectors and lists packed integers
    of 64 and 16 bits.
    """
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    keys = [F.col("label"), F.col("length").desc(), F.col("id"), F.col("place")]  # place parts rows that repeat an id
    dealt = rows.select("id", "vector", "label", "anchor", length.alias("length"), F.monotonically_increasing_id().alias("place"))
    dealt = dealt.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "vector", "label", "anchor", "length")
    schema = T.StructType([dealt.schema["label"], *[T.StructField(*x) for x in (("row", T.LongType()), ("longest", T.DoubleType()), ("ids", T.ArrayType(dealt.schema["id"].dataType)), ("anchors", T.ArrayType(T.BooleanType())), ("vectors", T.BinaryType()), ("dims", T.IntegerType()), ("lists", T.BinaryType()))]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        left: pa.Table | None = None

        def cuts(t: pa.Table, last: bool) -> tuple[list[pa.Table], pa.Table]:
            """Whole blocks of t, and what may grow with the next batch."""
            label, length = t["label"].to_pylist(), t["length"].to_numpy()
            out, begin = [], 0
            for i in range(1, len(length)):
                if label[i] != label[begin] or i - begin == BLOCK_ROWS or i - begin >= LEAST_ROWS and length[i] < SHORTER * length[begin]:
                    out.append(t.slice(begin, i - begin))
                    begin = i
            rest = t.slice(begin)
            return ([*out, rest], t.slice(len(t))) if last and len(rest) else (out, rest)

        def block(t: pa.Table) -> pa.RecordBatch:
            nonlocal row
            v = _matrix(t["vector"].combine_chunks())
            lists = np.argsort(_unit(v)[0], axis=0, kind="stable").T.astype("<u2")
            cells = [t["label"][0].as_py(), row, t["length"][0].as_py(), t["id"].to_pylist(), t["anchor"].to_pylist(), v.astype("<i8").tobytes(), v.shape[1], lists.tobytes()]
            row += len(t)
            kinds = [t.schema.field("label").type, pa.int64(), pa.float64(), pa.list_(t.schema.field("id").type), pa.list_(pa.bool_()), pa.binary(), pa.int32(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(cells, kinds)], names=schema.names)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            whole, left = cuts(t if left is None else pa.concat_tables([left, t]), False)
            yield from map(block, whole)
        if left is not None:
            yield from map(block, cuts(left, True)[0])

    return written(dealt.mapInArrow(run, schema), "negatives-blocks")


def anchors(blocked: DataFrame) -> DataFrame:
    """(row, id, label, vector) of the anchors in the blocks."""
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", blocked.schema["ids"].dataType.elementType), blocked.schema["label"], T.StructField("vector", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in map(Block, batch.to_pylist()):
                at = np.flatnonzero(b.anchors)
                cells = [pa.array(b.row + at), pa.array([b.ids[i] for i in at], batch.column(3).type.value_type), pa.array([b.label] * len(at), batch.column(0).type), pa.array(b.v[at].tolist(), pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(cells, names=schema.names)

    return written(blocked.mapInArrow(run, schema), "negatives-anchors")


class Block:
    """Rows of one label and about one length, with sorted lists of their unit vectors' coordinates."""

    def __init__(self, b: dict):
        self.label, self.row, self.longest, self.ids, self.anchors = b["label"], b["row"], b["longest"], b["ids"], np.array(b["anchors"], bool)
        self.v = np.frombuffer(b["vectors"], "<i8").reshape(-1, b["dims"])
        self.lists = np.frombuffer(b["lists"], "<u2").reshape(b["dims"], -1)
        self.unit, _ = _unit(self.v)
        self.most = int(np.abs(self.v).max(initial=0))
        self.order = None

    def by_id(self) -> np.ndarray:
        """Each row's place in the order of ids, null last."""
        if self.order is None:
            self.order = pc.rank(pa.array(self.ids), sort_keys="ascending", null_placement="at_end", tiebreaker="first").to_numpy()
        return self.order

    def products(self, q: np.ndarray, rows: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Exact scores of anchors (or one) and rows; in floating point where that is exact."""
        dims = min(q.shape[-1], self.v.shape[1])
        exact = int(np.abs(q).max(initial=0)) * self.most * dims < 1 << 53
        kind = np.float64 if exact else np.int64
        return (q[..., :dims].astype(kind) @ self.v[rows, :dims].T.astype(kind)).astype(np.int64)

    def first(self, rows: np.ndarray, score: np.ndarray, most: int) -> np.ndarray:
        """Places of the most first rows: highest score, then smallest id."""
        if len(rows) > most:
            few = np.flatnonzero(score >= np.partition(score, -most)[-most])
            return few[np.lexsort((self.by_id()[rows[few]], -score[few]))[:most]]
        return np.arange(len(rows))


class Anchors:
    """A block of anchors."""

    def __init__(self, rows: list):
        self.row = np.array([r["row"] for r in rows], np.int64)
        self.ids, self.label = [r["id"] for r in rows], np.array([r["label"] for r in rows], object)
        self.v = _matrix(pa.array([r["vector"] for r in rows], pa.list_(pa.int64())))
        self.unit, self.norm = _unit(self.v)
        self.focus = np.argsort(-np.abs(self.unit), axis=1, kind="stable")[:, :FOCUS]

    def candidates(self, b: Block, who: np.ndarray, least: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, rows, exact scores) for each anchor of who, with all rows of the block whose score is its least or more."""
        reach = self.norm[who] * b.longest
        near = least[who] <= reach * (1 + SLACK) + SLACK
        who, reach = who[near], reach[near]
        if not len(who):
            return
        cosine = np.divide(least[who], reach, out=np.full(len(who), -1.0), where=reach > 0) - SLACK
        prune = cosine > 0
        angle = np.arccos(np.clip(cosine, -1, 1))
        focus = np.minimum(self.focus[who], b.v.shape[1] - 1)
        own = np.arccos(np.clip(self.unit[who[:, None], self.focus[who]], -1, 1))
        low, high = np.cos(np.minimum(np.pi, own + angle[:, None])) - SLACK, np.cos(np.maximum(0, own - angle[:, None])) + SLACK
        outside = self.focus[who] >= b.v.shape[1]  # the block has no such coordinate: no range
        low[outside], high[outside] = -2, 2
        begin, end = np.zeros(focus.shape, np.int64), np.full(focus.shape, len(b.v))
        for f in np.unique(focus[prune]):
            values = b.unit[b.lists[f], f]
            at = (focus == f) & prune[:, None]
            begin[at], end[at] = np.searchsorted(values, low[at], "left"), np.searchsorted(values, high[at], "right")
        best = (end - begin).argmin(1)
        kept = np.take_along_axis(end - begin, best[:, None], 1)[:, 0]
        whole = ~prune | (kept > MOST_KEPT * len(b.v))
        every, step = np.arange(len(b.v)), max(1, (1 << 22) // len(b.v))
        dense = np.flatnonzero(whole)
        for i in range(0, len(dense), step):
            part = dense[i : i + step]
            for k, score in zip(part.tolist(), b.products(self.v[who[part]])):
                yield int(who[k]), every, score
        for k in np.flatnonzero(~whole & (kept > 0)).tolist():
            rows = b.lists[focus[k, best[k]], begin[k, best[k]] : end[k, best[k]]].astype(np.int64)
            inside = b.unit[rows[:, None], focus[k]]
            rows = rows[((inside >= low[k]) & (inside <= high[k])).all(1)]
            if len(rows):
                yield int(who[k]), rows, b.products(self.v[who[k]], rows)


def _nearest(shared, known, most: int):
    """Of each task, the most best other rows of an anchor's label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, least = shared.value, np.array(known.value, np.float64)
        found: list[list[tuple]] = [[] for _ in q.ids]
        kind = pa.null()
        for batch in batches:
            kind = batch.column(3).type.value_type
            for b in map(Block, batch.to_pylist()):
                for a, rows, score in q.candidates(b, np.flatnonzero(q.label == b.label), least):
                    keep = np.flatnonzero((score >= least[a]) & (b.row + rows != q.row[a]))
                    rows, score = rows[keep], score[keep]
                    at = b.first(rows, score, most)
                    found[a] = _best(found[a] + [(s, b.ids[r]) for r, s in zip(rows[at].tolist(), score[at].tolist())], most)
                    if len(found[a]) == most:
                        least[a] = max(least[a], found[a][-1][0])
        yield _rows([(a, 0, i, s) for a, x in enumerate(found) for s, i in x], kind)

    return run


def _between(shared, wanted, most: int):
    """Of each task, the most best rows of other labels within the limits of each of an anchor's positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, limits = shared.value, [[list(x) for x in xs] for xs in wanted.value]
        least = np.array([min((low for low, high in xs if low <= high), default=np.inf) for xs in limits], np.float64)
        found = [[[] for _ in xs] for xs in limits]
        kind = pa.null()
        for batch in batches:
            kind = batch.column(3).type.value_type
            for b in map(Block, batch.to_pylist()):
                for a, rows, score in q.candidates(b, np.flatnonzero((q.label != b.label) & np.isfinite(least)), least):
                    for own, x in zip(limits[a], found[a]):
                        keep = np.flatnonzero((score >= own[0]) & (score <= own[1]))
                        if len(keep):
                            at = keep[b.first(rows[keep], score[keep], most)]
                            x[:] = _best(x + [(s, b.ids[r]) for r, s in zip(rows[at].tolist(), score[at].tolist())], most)
                            if len(x) == most:
                                own[0] = max(own[0], x[-1][0])
                    least[a] = min(low for low, high in limits[a] if low <= high)
        yield _rows([(a, k, i, s) for a, xs in enumerate(found) for k, x in enumerate(xs) for s, i in x], kind)

    return run


def _best(found: list[tuple], most: int) -> list[tuple]:
    return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1]) if x[1] is not None else (-x[0], True))[:most]


def _rows(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), kind, pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate(kinds)], names=["anchor", "positive", "id", "score"])


def hard_negatives(rows: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, anchor_bytes: int = ANCHOR_BYTES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows (id, vector array<long>, label, anchor).

    An anchor's positives are the other rows of its label with the highest products. For each, the
    highest rows of other labels between low and high per cent of its product (a negative one has
    none). Equal scores come by ascending id, null last. Rows without a label or a vector take no
    part; shorter vectors count as filled up with zeros; rows that repeat an id are rows of their own,
    also as anchors. Products must fit into 64 bits. No rows: no rows.
    """
    spark = rows.sparkSession
    blocked = blocks(rows.where("label IS NOT NULL AND vector IS NOT NULL"))
    asked = anchors(blocked)
    kind = rows.schema["id"].dataType
    out = T.StructType([T.StructField("anchor", T.LongType()), T.StructField("positive", T.LongType()), T.StructField("id", kind), T.StructField("score", T.LongType())])
    rank = F.row_number().over(Window.partitionBy("anchor", "positive").orderBy(F.desc("score"), F.col("id").asc_nulls_last()))
    longest = blocked.groupBy("label").agg(F.max(F.struct("longest", F.size("ids").alias("rows"), "row")).alias("top"))
    longest = written(longest.select("label", "top.*"), "negatives-longest")  # the longest block of each label
    first, two = longest.select("row"), longest.orderBy(F.desc("longest"), F.desc("rows"), "row").limit(2).select("row")

    def best(source: DataFrame, probe, most: int, only: bool) -> list:
        """The most best for each anchor and positive, or only the last of them where there are so many: bounded by the anchors."""
        ranked = source.mapInArrow(probe, out).withColumn("rank", rank)
        return ranked.where(F.col("rank") == most if only else F.col("rank") <= most).orderBy("anchor", "positive", "rank").collect()

    total = asked.agg(F.sum(F.lit(8) * F.size("vector") + 64)).first()[0] or 0
    parts, result = -(-total // anchor_bytes), None
    for p in range(parts):
        mine = asked.where(F.pmod(F.xxhash64("row"), F.lit(parts)) == p).collect()
        if not mine:
            continue
        q = Anchors(mine)
        shared, share = spark.sparkContext.broadcast(q), spark.sparkContext.broadcast
        least = [-np.inf] * len(mine)
        for r in best(blocked.join(first, "row", "left_semi"), _nearest(shared, share(least), positives), positives, True):
            least[r["anchor"]] = r["score"]
        near: list[list[tuple]] = [[] for _ in mine]
        for r in best(blocked, _nearest(shared, share(least), positives), positives, False):
            near[r["anchor"]].append((r["id"], r["score"]))
        limits = [[[-(-low * s // 100), high * s // 100] for _, s in x] for x in near]
        for r in best(blocked.join(two, "row", "left_semi"), _between(shared, share(limits), negatives), negatives, True):
            limits[r["anchor"]][r["positive"]][0] = r["score"]
        found = written(blocked.mapInArrow(_between(shared, share(limits), negatives), out), "negatives-found")
        pairs = [(a, k, q.ids[a], i, s) for a, x in enumerate(near) for k, (i, s) in enumerate(x)]
        names = T.StructType([*out.fields[:2], T.StructField("anchor_id", kind), T.StructField("positive_id", kind), T.StructField("positive_score", T.LongType())])
        ranked = found.withColumn("rank", rank).where(F.col("rank") <= negatives).join(F.broadcast(spark.createDataFrame(pairs, names)), ["anchor", "positive"])
        ranked = ranked.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        result = ranked if result is None else result.union(ranked)
    if result is None:
        result = spark.createDataFrame([], T.StructType([T.StructField("anchor_id", kind), T.StructField("positive_id", kind), T.StructField("rank", T.IntegerType()), T.StructField("negative_id", kind), T.StructField("positive_score", T.LongType()), T.StructField("negative_score", T.LongType())]))
    return result


def whole_vectors(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """(id, vector, label, anchor) of embeddings (vec_id, embedding, label), as op13 takes them."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vector = F.transform("embedding", lambda x: F.floor(scale * x.cast("double")))
    kept = embeddings.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return kept.select(F.col("vec_id").alias("id"), vector.alias("vector"), label.alias("label"), F.coalesce(F.col("vec_id") % 50 == 0, F.lit(False)).alias("anchor"))


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    return hard_negatives(whole_vectors(table(spark, sf_dir, "embeddings")))


def op13_sql() -> str:
    return f"""
WITH v AS (SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c AS (SELECT r, vec_id, label, unnest(e) AS x, unnest(range(len(e))) AS k FROM v),
s AS (SELECT a.r AS ar, b.r AS br, any_value(a.vec_id) AS anchor_id, any_value(b.vec_id) AS vec_id, any_value(a.label) AS la, any_value(b.label) AS lb, sum(a.x * b.x)::BIGINT AS score
  FROM c AS a JOIN c AS b USING (k) WHERE a.vec_id % 50 = 0 AND a.r <> b.r GROUP BY a.r, b.r),
p AS (SELECT ar, br AS pr, anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE la = lb
  QUALIFY row_number() OVER (PARTITION BY ar ORDER BY score DESC, vec_id) <= {POSITIVES}),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.ar, p.pr ORDER BY s.score DESC, s.vec_id) AS rank
  FROM p JOIN s ON s.ar = p.ar AND s.la <> s.lb AND {LOW} * positive_score <= 100 * s.score AND 100 * s.score <= {HIGH} * positive_score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
