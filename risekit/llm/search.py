"""Ranked lexical search by hashed max-sketches.

The index keeps, for each document, how often its terms occur, folded by two hashes into two short
arrays whose cells hold the maximum of what falls into them. A document's impact of a term grows
with the term's occurrences alone, for its length is the same for all its terms, so a term's smaller
cell gives an upper bound of its impact, and the query's weighted sum of them one of the score.
Arrays have four to eight cells for each distinct term.

Queries are looked up in blocks of bounded size, against all documents. A first pass over the
sketches finds the documents of the highest bounds, whose exact scores are a threshold. In the second
one each task takes its documents in descending order of bounds and scores their texts exactly until
no bound reaches the threshold, which rises meanwhile. Documents below it can't be among the best.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark import TaskContext
from pyspark.sql.window import Window

from risekit.llm.common import LOWER, UPPER, slices, small_batches, table, written

TOP = 10
#: Bytes of item texts searched in one pass.
BLOCK_BYTES = 1 << 20
#: Terms whose document counts a task keeps before it writes them.
COUNTED_TERMS = 1 << 20
#: Cells of bounds computed at a time.
CELLS = 1 << 21
#: No impact reaches it.
LIMIT = 1_000_000
#: Longer words are hashed one by one.
LONG_WORD = 64

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[list(UPPER.encode())] = list(LOWER.encode())
_IN_WORD = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
_STEP, _LETTER = np.uint64(0x9E3779B97F4A7C15), np.random.default_rng(12).integers(1, 1 << 63, 256, np.uint64)


def terms_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(term, row) of each term of a text column in order, terms as 64-bit hashes; null has none."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or ends[-1] == ends[0]:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    data = _LOWER[np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]]]
    ends = ends - ends[0]
    word = _IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)  # where a text begins or ends
    edge[ends] = True
    start = np.flatnonzero(word & (edge[:-1] | ~np.r_[False, word[:-1]]))
    end = np.flatnonzero(word & (edge[1:] | ~np.r_[word[1:], False])) + 1
    row = np.searchsorted(ends, start, side="right") - 1
    size = end - start
    order = np.argsort(-np.minimum(size, LONG_WORD + 1).astype(np.int8), kind="stable")
    at, n = start[order], size[order]
    long = int(np.count_nonzero(n > LONG_WORD))
    h = np.full(len(at), 42, np.uint64) + n.astype(np.uint64) * _STEP
    many = len(at) - np.searchsorted(np.minimum(n, LONG_WORD)[::-1], np.arange(1, LONG_WORD + 1))  # words of so many letters
    for k in range(LONG_WORD):
        m = many[k]
        if m <= long:
            break
        x = (h[long:m] ^ _LETTER[data[at[long:m] + k]]) * _STEP
        h[long:m] = x ^ (x >> np.uint64(29))
    for i in range(long):
        h[i] = xxhash.xxh64_intdigest(data[at[i] : at[i] + n[i]].tobytes())
    h = (h ^ (h >> np.uint64(32))) * _STEP
    out = np.empty(len(h), np.uint64)
    out[order] = h ^ (h >> np.uint64(31))
    return out, row


def occurrences(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct terms of a text column, then (row, number of the term, occurrences) in order of rows, and all terms of each row."""
    term, row = terms_of(texts)
    distinct, number = np.unique(term, return_inverse=True)
    pair, tf = np.unique(row * max(1, len(distinct)) + number, return_counts=True)
    return distinct, pair // max(1, len(distinct)), pair % max(1, len(distinct)), tf, np.bincount(row, minlength=len(texts))


def _cells(h: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A term's cell in either array of mask + 1 cells, the second one counted from the first's start."""
    return (h & mask.astype(np.uint64)).astype(np.int64), ((h >> np.uint64(32)) & mask.astype(np.uint64)).astype(np.int64) + mask + 1


def sketches(row: np.ndarray, term: np.ndarray, tf: np.ndarray, rows: int) -> list[bytes]:
    """Both arrays of each row, of bytes; 255 stands for all from 255."""
    width = 1 << np.ceil(np.log2(np.maximum(4 * np.bincount(row, minlength=rows), 1))).astype(np.int64)
    end = np.cumsum(2 * width)
    flat = np.zeros(int(end[-1]) if rows else 0, np.uint8)
    for cell in _cells(term, width[row] - 1):
        np.maximum.at(flat, (end - 2 * width)[row] + cell, np.minimum(tf, 255).astype(np.uint8))
    raw = flat.tobytes()
    return [raw[e - 2 * w : e] for e, w in zip(end.tolist(), width.tolist())]


def index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index of docs, as a table of two kinds of rows: (row, doc_id, text, n, sketch) of a document, (term, df) of a task's terms.

    n counts a document's terms with repeats (null and empty texts: 0), row numbers the rows, so rows
    that repeat an id or a text are documents of their own. The df of a term sum up to the number of
    documents that hold it. Other columns of docs are not read. Nothing is shuffled; a task holds a
    slice of texts and a bounded number of terms.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = source.schema["doc_id"].dataType
    schema = T.StructType([T.StructField(*x) for x in (("row", T.LongType()), ("doc_id", kind), ("text", T.StringType()), ("n", T.LongType()), ("sketch", T.BinaryType()), ("term", T.LongType()), ("df", T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: list[tuple[np.ndarray, np.ndarray]] = []
        ids, row0 = pa.null(), TaskContext.get().partitionId() << 40

        def merged(keep: bool) -> Iterator[pa.RecordBatch]:
            if not counted:
                return
            term, where = np.unique(np.concatenate([t for t, _ in counted]), return_inverse=True)
            df = np.bincount(where, np.concatenate([n for _, n in counted])).astype(np.int64)
            counted.clear()
            if keep and len(term) <= COUNTED_TERMS // 2:
                counted.append((term, df))
                return
            for i in range(0, len(term), 1 << 16):
                cells = [pa.array(x[i : i + (1 << 16)]) for x in (term.view(np.int64), df)]
                none = [pa.nulls(len(cells[0]), t) for t in (pa.int64(), ids, pa.string(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*none, *cells], names=schema.names)

        for batch in batches:
            ids = batch.column(0).type
            for part in slices(batch, 1, 1 << 22):
                term, row, number, tf, n = occurrences(part.column(1))
                counted.append((term, np.bincount(number, minlength=len(term))))
                sketch = sketches(row, term[number], tf, part.num_rows)
                numbers = pa.array(np.arange(row0, row0 + part.num_rows))
                row0 += part.num_rows
                none = [pa.nulls(part.num_rows, pa.int64())] * 2
                yield pa.RecordBatch.from_arrays([numbers, *part.columns, pa.array(n, pa.int64()), pa.array(sketch, pa.binary()), *none], names=schema.names)
                if sum(len(t) for t, _ in counted) > COUNTED_TERMS:
                    yield from merged(keep=True)
        yield from merged(keep=False)

    return written(small_batches(source).mapInArrow(run, schema), "search-index")


class Queries:
    """A block of items: their terms' hashes and weights, and bounds and scores of documents."""

    def __init__(self, texts: list[str]):
        self.terms, item, self.of, _, self.sizes = occurrences(pa.array(texts, pa.string()))
        self.items = np.flatnonzero(self.sizes)  # those with terms
        self.begin = np.searchsorted(item, self.items)

    def weigh(self, n: int, total: int, df: dict[int, int]) -> None:
        """n documents have terms, total of them with repeats; df by term as a signed integer."""
        self.n, self.total = n, total
        self.weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df.get(t, 0) + 1))) for t in self.terms.view(np.int64).tolist()], np.int64)

    def norm(self, n: np.ndarray) -> np.ndarray:
        return 10 + 90 * n * self.n // self.total

    def sums(self, impacts: np.ndarray) -> np.ndarray:
        """Weighted sums over each item's terms, of documents' impacts by term."""
        return np.add.reduceat(impacts[:, self.of] * self.weight[self.of], self.begin, axis=1)

    def step(self) -> int:
        return max(1, CELLS // max(1, len(self.of)))

    def bounds(self, n: np.ndarray, sketch: pa.Array) -> np.ndarray:
        """An upper bound of each document's score for each item."""
        ends = np.frombuffer(sketch.buffers()[1], np.int32)[sketch.offset : sketch.offset + len(sketch) + 1].astype(np.int64)
        flat, out, tf = np.frombuffer(sketch.buffers()[2], np.uint8), [], np.arange(256)
        for i in range(0, len(sketch), self.step()):
            at = ends[i : i + self.step() + 1]
            one, two = _cells(self.terms[None, :], ((at[1:] - at[:-1]) // 2 - 1)[:, None])
            seen = np.minimum(flat[at[:-1, None] + one], flat[at[:-1, None] + two])
            impact = 10**9 * tf // np.maximum(1, 1000 * tf + 8 * self.norm(n[i : i + self.step()])[:, None])
            impact[:, 255] = LIMIT
            out.append(self.sums(np.take_along_axis(impact, seen.astype(np.int64), 1)))
        return np.vstack(out)

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Each document's score for each item."""
        out = []
        for i in range(0, len(texts), self.step()):
            part = texts.slice(i, self.step())
            distinct, row, number, tf, n = occurrences(part)
            where = np.minimum(np.searchsorted(self.terms, distinct), len(self.terms) - 1)
            ours = np.where(self.terms[where] == distinct, where, -1)[number]
            keep = ours >= 0
            row, ours, tf = row[keep], ours[keep], tf[keep].astype(np.int64)
            impact = np.zeros((len(part), len(self.terms)), np.int64)
            impact[row, ours] = 10**9 * tf // (1000 * tf + 8 * self.norm(n)[row])
            out.append(self.sums(impact))
        return np.vstack(out)


def _first(found: list[tuple], most: int) -> list[tuple]:
    """The first of (score, id): highest score, then smallest id, null last."""
    return sorted(found, key=lambda x: (-x[0], x[1] is None, x[1]) if x[1] is not None else (-x[0], True))[:most]


def _highest(shared, most: int):
    """Of each task, the rows of the highest bounds of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        rows, best = np.zeros((0, len(q.items)), np.int64), np.zeros((0, len(q.items)), np.int64)
        for batch in batches:
            for part in slices(batch, 2, 1 << 22):
                bound = q.bounds(part.column(1).to_numpy(), part.column(2))
                best = np.vstack([best, bound])
                rows = np.vstack([rows, np.repeat(part.column(0).to_numpy()[:, None], len(q.items), 1)])
                if len(best) > most:
                    top = np.argpartition(-best, most - 1, axis=0)[:most]
                    best, rows = np.take_along_axis(best, top, 0), np.take_along_axis(rows, top, 0)
        item = np.tile(np.arange(len(q.items)), len(best))
        yield pa.RecordBatch.from_arrays([pa.array(item), pa.array(rows.ravel()), pa.array(best.ravel())], names=["item", "row", "bound"])

    return run


def _scored(shared, thresholds, most: int):
    """Of each task, each item's best documents: texts are scored in descending order of bounds until none reaches the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        least = np.maximum(1, np.array(thresholds.value, np.int64))
        best: list[list[tuple]] = [[] for _ in q.items]
        kind = pa.null()
        for batch in batches:
            kind = batch.column(0).type
            for part in slices(batch, 3, 1 << 22):
                bound = q.bounds(part.column(1).to_numpy(), part.column(2))
                ids, open_, step = part.column(0), np.ones(len(bound), bool), most
                while (bound[open_] >= least).any():
                    left = np.flatnonzero(open_)
                    top = left[np.argpartition(-bound[left], step - 1, axis=0)[:step]] if step < len(left) else np.repeat(left[:, None], bound.shape[1], 1)
                    take = np.unique(top[np.take_along_axis(bound, top, 0) >= least])
                    open_[take] = False
                    score = q.scores(part.column(3).take(pa.array(take)))
                    names = ids.take(pa.array(take)).to_pylist()
                    for k in np.flatnonzero((score >= least).any(0)).tolist():
                        best[k] = _first(best[k] + [(int(score[i, k]), names[i]) for i in np.flatnonzero(score[:, k] >= least[k]).tolist()], most)
                        if len(best[k]) == most:
                            least[k] = max(least[k], best[k][-1][0])
                    step *= 4
        item = [k for k, x in enumerate(best) for _ in x]
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int64()), pa.array([i for x in best for _, i in x], kind), pa.array([s for x in best for s, _ in x], pa.int64())], names=["item", "doc_id", "score"])

    return run


def search(indexed: DataFrame, items: DataFrame, most: int = TOP, id_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(item_id, rank, doc_id, score): the most highest-scoring documents of each item, scores above 0.

    Equal scores come by ascending doc_id, null last. Items that repeat an id and a text are one;
    those that repeat an id with other texts are ranked each. Items without terms, and all where no
    document has a term, give no rows.
    """
    spark = indexed.sparkSession
    docs = indexed.where("n > 0")
    n, total = docs.agg(F.count("*"), F.sum("n")).first()
    asked = items.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text")).where("text IS NOT NULL").distinct()
    blocks = -(-(asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes)
    item = T.StructField("item_id", asked.schema["item_id"].dataType)
    out = None
    for b in range(blocks if n else 0):
        rows = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        q = Queries([r["text"] for r in rows])
        if not len(q.items):
            continue
        wanted = spark.createDataFrame([(t,) for t in q.terms.view(np.int64).tolist()], "term long")  # a block's terms
        df = indexed.join(F.broadcast(wanted), "term").groupBy("term").agg(F.sum("df")).collect()
        q.weigh(n, total, dict(map(tuple, df)))
        shared = spark.sparkContext.broadcast(q)
        best = Window.partitionBy("item").orderBy(F.desc("bound"), "row")
        high = docs.select("row", "n", "sketch").mapInArrow(_highest(shared, most), "item long, row long, bound long")
        high = written(high.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= most), "search-high")
        rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
        cells = T.StructType([T.StructField("item", T.LongType()), T.StructField("doc_id", indexed.schema["doc_id"].dataType), T.StructField("score", T.LongType())])
        none = spark.sparkContext.broadcast([0] * len(q.items))
        few = docs.join(F.broadcast(high.select("row").distinct()), "row")  # most rows for each item of a block
        worst = few.select("doc_id", "n", "sketch", "text").mapInArrow(_scored(shared, none, most), cells).withColumn("rank", rank).where(F.col("rank") == most).collect()
        least = {r["item"]: r["score"] for r in worst}
        known = spark.sparkContext.broadcast([least.get(k, 0) for k in range(len(q.items))])
        found = written(docs.select("doc_id", "n", "sketch", "text").mapInArrow(_scored(shared, known, most), cells), "search-found")
        names = spark.createDataFrame([(k, rows[i]["item_id"]) for k, i in enumerate(q.items.tolist())], T.StructType([T.StructField("item", T.LongType()), item]))
        ranked = found.withColumn("rank", rank).where(F.col("rank") <= most).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        out = ranked if out is None else out.union(ranked)
    if out is None:
        out = spark.createDataFrame([], T.StructType([item, T.StructField("rank", T.IntegerType()), T.StructField("doc_id", indexed.schema["doc_id"].dataType), T.StructField("score", T.LongType())]))
    return out


def op12_search(spark, sf_dir: str) -> DataFrame:
    return search(index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


def op12_sql() -> str:
    terms = f"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {terms} AS w FROM documents WHERE text IS NOT NULL),
filled AS (SELECT r, doc_id, w, len(w)::BIGINT AS n FROM d WHERE len(w) > 0),
size AS (SELECT count(*)::BIGINT AS n_all, sum(n)::BIGINT AS l_all FROM filled),
b AS (SELECT DISTINCT item_id, unnest(w) AS t FROM (SELECT item_id, {terms} AS w FROM benchmark WHERE text IS NOT NULL)),
tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM filled) GROUP BY r, t),
weight AS (SELECT t, floor(1000 * ln((2 * n_all + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight
  FROM (SELECT t, count(*)::BIGINT AS df FROM tf WHERE t IN (SELECT t FROM b) GROUP BY t), size),
score AS (SELECT item_id, r, sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_all) // l_all))))::BIGINT AS score
  FROM b JOIN tf USING (t) JOIN weight USING (t) JOIN filled USING (r), size GROUP BY item_id, r),
best AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
  FROM score JOIN filled USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM best WHERE rank <= {TOP}
"""
