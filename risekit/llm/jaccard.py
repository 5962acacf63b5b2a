"""N-gram Jaccard join by universe partitioning and the pigeonhole principle.

A document is the set of its word n-grams, hashed to 64 bits. Sets fall into size bands, and every
band has a scheme: the hash universe is cut into segments, more than similar sets can differ in, so
that similar sets agree in some segment (or, in schemes that allocate one deletion, agree in some
segment up to one n-gram). Signatures of segment subsets, and of subsets with one n-gram deleted,
meet in sorted runs; the sets that meet are verified exactly on their texts.

A scheme has a few segments to spare. So a set may ignore that many segments whose subset very many
sets have (long runs), and the pair is still found in another. Sets with more such segments than
that share a passage with very many others. Among these the universe is cut once more, into a
segment for each n-gram: rare n-grams make pairs that share as many as linked ones must beyond what
very many sets have. Only sets that are almost all common content are left to compare within long
runs: first with the one that has the least of its own, then those still outside of their run's
largest component with all others, in blocks of bounded size that are verified by exact incidence
products and emit links and no candidate pairs.

Equal sets are one node from the start, so exact copies cost nothing further.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from risekit.llm.common import small_batches, table, written
from risekit.llm.components import connected_components

#: Longer runs of one signature are long runs.
LONG_RUN = 32
#: Instead of a signature's meta: the run is long, whatever rows of it there are.
MARK = -1
#: Cost of a signature that is likely to meet by chance, against that of a row.
CHANCE_COST = 8
#: Members and n-grams of a block in which a long run's sets are verified against each other.
BLOCK_ROWS, BLOCK_GRAMS = 512, 1 << 18
#: A table of ids is broadcast up to so many rows.
BROADCAST_ROWS = 500_000
#: Rows of one key, and pairs of one set, that a task gets where they join a row of that key.
ROWS_PER_PART, PAIRS_PER_PART = 500, 64
#: Parts that rows without a key are dealt into.
NULL_PARTS = 1024
#: Sets that a task remembers so as not to send equal ones again.
SEEN = 100_000
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]
_BYTE = np.random.default_rng(1).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x5851F42D4C957F2D
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose outputs look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Powers:
    """Powers of the hash base and of its inverse modulo 2**64, as long as the longest text so far."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            base = np.full(size, _BASE, np.uint64)
            base[0] = 1
            self.up = np.cumprod(base)
            base[1:] = pow(_BASE, -1, 1 << 64)
            self.down = np.cumprod(base)
        return self.up, self.down


_powers = _Powers()


def grams(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct hashes of the text's n-word shingles; of all words where they are fewer; none of none.

    Words are runs of other than ASCII white space, with A-Z lower-cased.
    """
    data = np.frombuffer((text or "").encode().lower(), np.uint8)
    blank = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = _powers.get(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    words = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64) * _C[0])
    k = min(n, len(words))
    count = len(words) - k + 1
    h = np.full(count, k, np.uint64) * _C[7]
    for j in range(k):
        h = mix(h + words[j : j + count] * _C[1])
    return np.unique(h)


@dataclass(frozen=True)
class Scheme:
    """How sets of a band meet each other and those of the next band."""

    low: int
    high: int
    differ: int  # elements in which a linked pair of this scheme differs at most
    segments: int
    spare: int
    deletion: bool


class Schemes:
    """The bands and their schemes for linking at 100 * common >= percent * union."""

    def __init__(self, percent: int, most: int = 1 << 34):
        self.percent = percent
        self.bands: list[Scheme] = []
        low = 1
        while low < most:
            high = low * 100 // percent
            self.bands.append(self._scheme(low, high))
            low = high + 1
        self.lows = np.array([b.low for b in self.bands], np.int64)

    def _scheme(self, low: int, high: int) -> Scheme:
        p = self.percent
        top = high + high * 100 // p
        differ = max(s - 2 * -(-p * s // (p + 100)) for s in range(max(2 * low, top - p - 100), top + 1))
        size = (low + high) / 2
        options = []
        for deletion in (False, True):
            least = differ // 2 + 1 if deletion else differ + 1
            spare = max(1, least // 4)
            segments = least + spare
            t = size / segments
            chance = math.exp(-t) * (1 + t)
            rows = segments + (size if deletion else 0)
            options.append((rows + CHANCE_COST * segments * chance, deletion, segments, spare))
        _, deletion, segments, spare = min(options)
        return Scheme(low, high, differ, segments, spare, deletion)

    def band(self, n: int) -> int:
        return int(np.searchsorted(self.lows, n, side="right")) - 1

    def signatures(self, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(keys, meta) of a set under its own band's scheme and that of the band below."""
        k, n = self.band(len(tokens)), len(tokens)
        value = mix(tokens ^ _C[5])
        keys, meta = [], []
        for b in (k, k - 1):
            if b < 0 or not self.bands[b].differ:
                continue
            s = self.bands[b]
            segment = ((tokens >> np.uint64(32)) * np.uint64(s.segments) >> np.uint64(32)).astype(np.int64)
            count = np.bincount(segment, minlength=s.segments)
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value)))
            bound = np.concatenate(([0], np.cumsum(count)))
            subset = sums[bound[1:]] - sums[bound[:-1]]
            number = np.arange(s.segments)
            keys.append(_key(subset, count, number, b))
            meta.append(_meta(b, b == k, False, number, n))
            if s.deletion:
                keys.append(_key(subset[segment] - value, count[segment] - 1, segment, b))
                meta.append(_meta(b, b == k, True, segment, n))
        if not keys:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate(keys).view(np.int64), np.concatenate(meta)


def _key(subset: np.ndarray, count: np.ndarray, segment: np.ndarray, band: int) -> np.ndarray:
    return mix(mix(subset + count.astype(np.uint64) * _C[2]) + segment.astype(np.uint64) * _C[3] + np.uint64((band + 1) * int(_C[4]) % (1 << 64)))


def _meta(band: int, own: bool, deleted: bool, segment: np.ndarray | int, n: int) -> np.ndarray:
    """band, own band, deleted, segment (24 bits) and set size (28 bits) in one integer; larger sets count as 2**28 - 1."""
    return (band << 54 | own << 53 | deleted << 52) | np.minimum(segment, (1 << 24) - 1) << 28 | min(n, (1 << 28) - 1)


def set_id(tokens: np.ndarray) -> int:
    """A 64-bit name of the set; sets with equal names are taken as equal."""
    return int(mix(np.add.reduce(mix(tokens ^ _C[6]), keepdims=True) + np.uint64(len(tokens) * int(_C[0]) % (1 << 64)))[0].view(np.int64))


def document_sets(docs: DataFrame, id_col: str, text_col: str, n: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, sid) of each row; sid is null for a text without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [grams(t.as_py(), n) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) if len(s) else None for s in sets], pa.int64())],
                names=["doc_id", "text_hash", "n_shingles", "sid"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("text_hash"), text_col)
    return rows.mapInArrow(run, f"doc_id {kind}, text_hash long, n_shingles long, sid long")


def set_texts(docs: DataFrame, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """(sid, text): for each sid of wanted the text of one row of docs (doc_id, text) that has this set.

    The row is found by its id, which may be null, and the hash of its text: rows of one id may differ in their texts.
    """
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")
    first = sets.where("sid IS NOT NULL").groupBy("sid").agg(F.min(row).alias("row")).join(wanted, "sid", "left_semi")
    first = written(first.select("sid", F.col("row.doc_id").alias("first_id"), F.col("row.text_hash").alias("first_hash")), "jaccard-first")
    few = first.count() <= BROADCAST_ROWS  # 24 bytes a row; beyond that the planner shuffles both sides
    same = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.xxhash64("text") == F.col("first_hash"))
    return docs.join(F.broadcast(first) if few else first, same).select("sid", "text").dropDuplicates(["sid"])


def signature_rows(docs: DataFrame, text_col: str, n: int, schemes: Schemes) -> DataFrame:
    """(key, sid, meta) of the distinct sets that each task comes across."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        keys, sids, metas, size = [], [], [], 0

        def flush() -> pa.RecordBatch:
            out = [np.concatenate(keys), np.repeat(np.array(sids, np.int64), [len(k) for k in keys]), np.concatenate(metas)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["key", "sid", "meta"])

        for batch in batches:
            for text in batch.column(0):
                tokens = grams(text.as_py(), n)
                if not len(tokens):
                    continue
                sid = set_id(tokens)
                if sid in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(sid)
                key, meta = schemes.signatures(tokens)
                if len(key):
                    keys.append(key)
                    sids.append(sid)
                    metas.append(meta)
                    size += len(key)
                if size > 100_000:
                    yield flush()
                    keys, sids, metas, size = [], [], [], 0
        if size:
            yield flush()

    return docs.select(text_col).mapInArrow(run, "key long, sid long, meta long")


def meetings(signatures: DataFrame, percent: int, long_run: int = LONG_RUN) -> DataFrame:
    """Pairs (kind 0: a < b, meta band and how often) of short runs, and the members (kind 1: a key, b set, meta) of long ones.

    Rows are sorted by key and streamed, so a run of any length takes bounded memory. A row with MARK
    for its meta makes its run a long one and is no member.
    """
    ordered = signatures.repartition("key").sortWithinPartitions("key", "sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 3
        open_key, last_sid = None, None  # the long run that the last batch ended in
        for batch in batches:
            key, sid, meta = (np.concatenate((h, c.to_numpy())) for h, c in zip(held, batch.columns))
            fresh = np.r_[True, (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])]
            if open_key is not None and len(key) and key[0] == open_key and sid[0] == last_sid:
                fresh[0] = False  # a long run leaves nothing held, so row 0 may repeat its last member
            key_last, sid_last = key[-1] if len(key) else None, sid[-1] if len(key) else None
            key, sid, meta = key[fresh], sid[fresh], meta[fresh]
            if not len(key):
                continue
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            size = np.diff(np.r_[start, len(key)])
            long = (size > long_run) | np.logical_or.reduceat(meta == MARK, start)
            if open_key is not None and key[0] == open_key:
                long[0] = True
            stop = len(key)
            if not long[-1]:
                stop = start[-1]
                held = [x[stop:] for x in (key, sid, meta)]
                open_key = None
                long, size = long[:-1], size[:-1]
            else:
                held = [np.zeros(0, np.int64)] * 3
                open_key, last_sid = key_last, sid_last
            yield from _runs(key[:stop], sid[:stop], meta[:stop], np.repeat(size, size), np.repeat(long, size), percent)
        size = np.full(len(held[0]), len(held[0]))
        yield from _runs(*held, size, np.zeros(len(size), bool), percent)

    return ordered.mapInArrow(run, "kind int, a long, b long, meta long")


def _runs(key, sid, meta, size, long, percent: int) -> Iterator[pa.RecordBatch]:
    """Output rows of whole runs (and parts of long ones); size and long are per row."""

    def rows(kind: int, a: np.ndarray, b: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(a), pa.array(b), pa.array(m)], names=["kind", "a", "b", "meta"])

    if long.any():
        named = long & (meta != MARK)
        yield rows(1, key[named], sid[named], meta[named])
    pick = ~long & (size > 1)
    key, sid, meta = key[pick], sid[pick], meta[pick]
    n, own, deleted = meta & (1 << 28) - 1, meta >> 53 & 1, meta >> 52 & 1
    found = []
    for step in range(1, int(size[pick].max()) if len(key) else 1):
        same = np.flatnonzero(key[step:] == key[:-step])
        if not len(same):
            break
        i, j = same, same + step
        ok = (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent) & ((own[i] | own[j]) == 1) & ((deleted[i] & deleted[j]) == 0)
        x, y = sid[i[ok]], sid[j[ok]]
        found.append(np.stack((np.minimum(x, y), np.maximum(x, y), meta[i[ok]] >> 54)))
    if found:
        pairs, times = np.unique(np.concatenate(found, axis=1), axis=1, return_counts=True)
        if pairs.shape[1]:
            yield rows(0, pairs[0].copy(), pairs[1].copy(), pairs[2] << 32 | times)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * common >= percent * (len(a) + len(b) - common) and common > 0


def verify(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of sets that are linked, checked on their documents' whole texts.

    A set of very many pairs has its text sent in parts of PAIRS_PER_PART pairs each.
    """
    total = pairs.count()
    with_b = _salted_join(pairs, "b", texts.select(F.col("sid").alias("key"), F.col("text").alias("tb")), total, PAIRS_PER_PART, "inner")
    both = _salted_join(with_b, "a", texts.select(F.col("sid").alias("key"), F.col("text").alias("ta")), total, PAIRS_PER_PART, "inner", pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        recent: OrderedDict[int, np.ndarray] = OrderedDict()

        def tokens(sid: int, text: pa.Scalar) -> np.ndarray:
            if sid not in recent:
                if len(recent) >= 64:
                    recent.popitem(last=False)
                recent[sid] = grams(text.as_py(), n)
            return recent[sid]

        for batch in batches:
            a, b, ta, tb = batch.columns
            x, y = a.to_pylist(), b.to_pylist()
            ok = [linked(tokens(x[i], ta[i]), tokens(y[i], tb[i]), percent) for i in range(len(x))]
            yield pa.RecordBatch.from_arrays([a, b], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def forest(pairs: DataFrame) -> DataFrame:
    """Of each set's pairs with smaller ones, that with the smallest: a star where all of a group meet."""
    return pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")


def across(pairs: DataFrame, component: DataFrame) -> DataFrame:
    """The pairs whose ends are not yet in one component: only these can still change the components."""
    x = component.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    y = component.select(F.col("node").alias("b"), F.col("component").alias("cb"))
    ends = pairs.join(x, "a", "left").join(y, "b", "left")
    return ends.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each of left shares with each of right, by exact incidence products."""
    size = np.array([len(s) for s in (*left, *right)])
    flat = np.concatenate((*left, *right))
    _, code, times = np.unique(flat, return_inverse=True, return_counts=True)
    rank = np.cumsum(times > 1) - 1
    row = np.repeat(np.arange(len(size)), size)
    shared = times[code] > 1
    row, col = row[shared], rank[code[shared]]
    common = np.zeros((len(left), len(right)))
    width = 4096
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    cuts = np.searchsorted(col, np.arange(0, (col[-1] + 1 if len(col) else 0) + width, width))
    for a, b in zip(cuts[:-1], cuts[1:]):
        part = np.zeros((len(size), width), np.float32)
        part[row[a:b], col[a:b] % width] = 1
        common += part[: len(left)] @ part[len(left) :].T
    return common


def block_near(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of left are linked with which of right."""
    common = common_counts(left, right)
    union = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :] - common
    return (100 * common >= percent * union) & (common > 0)


def link_forest(left: list[int], right: list[int], near: np.ndarray) -> list[tuple[int, int]]:
    """A forest of the links in a matrix between two lists of sets, which may share some."""
    parent: dict[int, int] = {x: x for x in (*left, *right)}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(*np.nonzero(near)):
        x, y = root(left[i]), root(right[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((left[i], right[j]))
    return out


def _long_rows(met: DataFrame) -> DataFrame:
    band, segment = F.shiftright("meta", 54).cast("int"), F.shiftright("meta", 28).bitwiseAND(F.lit((1 << 24) - 1))
    size = F.col("meta").bitwiseAND(F.lit((1 << 28) - 1))
    return met.where("kind = 1").select(F.col("a").alias("key"), F.col("b").alias("sid"), band.alias("band"), segment.alias("segment"), size.alias("n"))


def _spare(schemes: Schemes) -> Column:
    return F.get(F.array(*[F.lit(b.spare) for b in schemes.bands]), F.col("band"))


def long_segments(met: DataFrame) -> DataFrame:
    """(sid, band, long): in how many segments a set has a signature in a long run."""
    return _long_rows(met).groupBy("sid", "band").agg(F.countDistinct("segment").alias("long"))


def candidate_pairs(met: DataFrame, long: DataFrame, schemes: Schemes) -> DataFrame:
    """Pairs (a, b) that meet in so many short runs as linked ones must.

    Linked sets agree in more segments than their scheme has spare ones. Of these, either set's
    segments in long runs may be missing among the short runs, but all others are there.
    """
    times = F.sum(F.col("meta").bitwiseAND(F.lit((1 << 32) - 1)))
    pairs = met.where("kind = 0").groupBy("a", "b", F.shiftright("meta", 32).cast("int").alias("band")).agg(times.alias("times"))
    x = long.select(F.col("sid").alias("a"), "band", F.col("long").alias("la"))
    y = long.select(F.col("sid").alias("b"), "band", F.col("long").alias("lb"))
    both = pairs.join(x, ["a", "band"], "left").join(y, ["b", "band"], "left")
    missing = F.least(F.coalesce("la", F.lit(0)), F.coalesce("lb", F.lit(0)))
    return both.where(F.col("times") > _spare(schemes) - missing).select("a", "b").distinct()


def long_run_members(met: DataFrame, long: DataFrame, schemes: Schemes) -> DataFrame:
    """(key, sid, n, members) of the sets that must compare within long runs: those with more long segments than spare ones; members: how many such sets the run has.

    In subset schemes such a set leaves out as many of its most frequent signatures as its scheme
    has spare segments: a linked pair shares more than that, so its rarest common one is kept.
    """
    deletion = F.get(F.array(*[F.lit(b.deletion) for b in schemes.bands]), F.col("band"))
    many = long.where(F.col("long") > _spare(schemes)).select("sid", "band")
    rows = _long_rows(met).join(many, ["sid", "band"], "left_semi").select("key", "sid", "band", "n").distinct()
    times = rows.groupBy("key").agg(F.count("*").alias("times")).where("times > 1")
    order = Window.partitionBy("sid", "band").orderBy(F.col("times").desc(), "key")
    ranked = rows.join(times, "key").withColumn("i", F.row_number().over(order))
    return ranked.where(deletion | (F.col("i") > _spare(schemes))).select("key", "sid", "n", F.col("times").alias("members"))


def member_grams(members: DataFrame, texts: DataFrame, n: int, long_run: int = LONG_RUN) -> DataFrame:
    """The n-grams of the sets that compare in long runs, with what very many sets have counted before the shuffle.

    Sets of one neighbourhood are dealt into blocks. An n-gram of over long_run sets of a block is
    common: the block counts for each set how many it has (kind 1: key its size, sid, meta the count)
    and sends the n-gram once, marked. Every other n-gram of a set is a row in the form of signatures,
    a segment for each n-gram (kind 0: key, sid, meta; marked ones among them).
    """

    def run(group: pa.Table) -> pa.Table:
        sids = group.column("sid").to_numpy()
        sets = [grams(t.as_py(), n) for t in group.column("text")]
        size = np.array([len(s) for s in sets])
        row = np.repeat(np.arange(len(sets)), size)
        key, code, times = np.unique(np.concatenate(sets).view(np.int64), return_inverse=True, return_counts=True)
        hot = times > long_run
        few = ~hot[code]
        meta = np.array([_meta(0, True, False, 0, k) for k in size], np.int64)
        common = np.bincount(row[~few], minlength=len(sets))
        marks = key[hot]
        cells = [
            (np.zeros(few.sum(), np.int32), key[code[few]], sids[row[few]], meta[row[few]]),
            (np.zeros(len(marks), np.int32), marks, np.full(len(marks), np.iinfo(np.int64).min), np.full(len(marks), MARK)),
            (np.ones(len(sets), np.int32), size, sids, common),
        ]
        return pa.table({c: pa.array(np.concatenate(x)) for c, x in zip(("kind", "key", "sid", "meta"), zip(*cells))})

    rows = texts.join(home_blocks(members, members.select("key", "sid", "members"), "jaccard-gram-blocks"), "sid").select("block", "sid", "text")
    return rows.groupBy("block").applyInArrow(run, "kind int, key long, sid long, meta long")


def _needed(percent: int, x: Column, y: Column) -> Column:
    """What two sets of sizes x and y share at least if they are linked."""
    return F.ceil(percent * (x + y) / (100 + percent))


def common_parts(rows: DataFrame, met: DataFrame) -> DataFrame:
    """(sid, n, common): size of each set, and how many of its n-grams very many of the sets have; of member_grams and their meetings."""
    size = rows.where("kind = 1").select("sid", F.col("key").alias("n"), F.col("meta").alias("counted"))
    common = met.where("kind = 1").groupBy(F.col("b").alias("sid")).agg(F.count("*").alias("common"))
    return size.join(common, "sid", "left").select("sid", "n", (F.col("counted") + F.coalesce("common", F.lit(0))).alias("common"))


def rare_pairs(met: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that share so many rare n-grams as linked ones must, whose common n-grams are too few to link them."""
    times = F.sum(F.col("meta").bitwiseAND(F.lit((1 << 32) - 1)))
    pairs = met.where("kind = 0").groupBy("a", "b").agg(times.alias("times"))
    x, y = (parts.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("common").alias(f"c{c}")) for c in ("a", "b"))
    return pairs.join(x, "a").join(y, "b").where(F.col("times") >= _needed(percent, F.col("na"), F.col("nb")) - F.least("ca", "cb")).select("a", "b")


def core_members(members: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """(key, sid, n, common, pivot, members): members of long runs that their common n-grams alone may link to another.

    Of two sets that common n-grams alone link, either has percent of its n-grams among them, and
    the smaller one (small) so many as a pair of its size needs. Runs without a small one go; pivot
    is the small one of the run that has the fewest n-grams of its own, members how many such members it has.
    """
    core = parts.where(100 * F.col("common") >= percent * F.col("n")).withColumn("small", F.col("common") >= _needed(percent, F.col("n"), F.col("n")))
    rows = written(members.select("key", "sid").join(core, "sid"), "jaccard-core")
    share = F.when(F.col("small"), F.struct((F.col("common") / F.col("n")).alias("share"), (-F.col("sid")).alias("first")))
    keys = rows.groupBy("key").agg(F.max_by(F.struct("sid", "n", "common"), share).alias("pivot"), F.count("*").alias("members"), F.max("small").alias("some")).where("some AND members > 1")
    return _salted_join(rows, "key", keys.select("key", "pivot", "members"), rows.count(), how="inner").select("key", "sid", "n", "common", "pivot", "members")


def pivot_pairs(core: DataFrame, percent: int) -> DataFrame:
    """(a, b): each member with the member of its run that has the fewest n-grams of its own, where common ones may link them."""
    met = core.where(F.col("sid") != F.col("pivot.sid"))
    close = met.where(F.least("common", "pivot.common") >= _needed(percent, F.col("n"), F.col("pivot.n")))
    return close.select(F.least("sid", "pivot.sid").alias("a"), F.greatest("sid", "pivot.sid").alias("b")).distinct()


def stragglers(core: DataFrame, component: DataFrame, keep: Sequence[str] = ("key", "sid")) -> DataFrame:
    """The columns keep of core, key and sid among them: members outside of the largest component of their run."""
    own = component.select(F.col("node").alias("sid"), "component")
    rows = written(core.select(*keep).join(own, "sid", "left").select(*keep, F.coalesce("component", "sid").alias("component")), "jaccard-runs")
    per = rows.groupBy("key", "component").agg(F.count("*").alias("rows"))
    main = per.groupBy("key").agg(F.max_by("component", F.struct("rows", "component")).alias("main"), F.count("*").alias("pieces")).where("pieces > 1")
    # pieces meet first, so that only what lies outside is joined
    outside = per.join(main, "key").where("component <> main").select(F.struct("key", "component").alias("key"))
    return _salted_join(rows.withColumn("piece", F.struct("key", "component")), "piece", outside, rows.count(), how="inner").select(*keep)


def homes(core: DataFrame, some: DataFrame) -> DataFrame:
    """(sid, home) of the sets of some (key, sid, and members if that is known): a key that the sets of one neighbourhood agree upon.

    Each set names the longest of its runs, each run the longest that its sets name, and each set
    takes the one that the run which it has named names. So a set, however many runs it is in, is
    joined once.
    """
    if "members" not in some.columns:
        some = written(_salted_join(some, "key", core.groupBy("key").agg(F.count("*").alias("members")), some.count(), how="inner"), "jaccard-sized")
    own = some.withColumn("run", F.struct("members", "key"))
    named = written(own.groupBy("sid").agg(F.max("run").alias("run")), "jaccard-named")
    label = some.join(named, "sid").groupBy("key").agg(F.max("run")["key"].alias("home"))
    return _salted_join(named.select("sid", F.col("run.key").alias("named")), "named", label, named.count(), how="inner").select("sid", "home")


def home_blocks(core: DataFrame, some: DataFrame, name: str) -> DataFrame:
    """(sid, n, block): each set of some (key, sid) in one block of bounded size, that of its neighbourhood where it fits."""
    home = written(homes(core, some).join(core.select("sid", "n").distinct(), "sid"), f"{name}-of")
    size = home.groupBy(F.col("home").alias("key")).agg(_blocks().alias("blocks"))
    dealt = _salted_join(home, "home", size, home.count(), how="inner")
    return written(dealt.select("sid", "n", F.xxhash64("home", F.pmod(F.xxhash64("sid"), "blocks")).alias("block")), name)


def dealt_blocks(core: DataFrame, some: DataFrame) -> DataFrame:
    """(block, part, sid, left): each set of some (key, sid) in one block, which meets the parts of all members of core that share a run with it.

    The sets of one neighbourhood share blocks. Blocks and parts are of bounded size, and a member
    is sent once to each block that it meets.
    """
    home = home_blocks(core, some, "jaccard-homes")
    blocks = written(some.join(home, "sid").select("key", "block").distinct(), "jaccard-blocks")
    right = _salted_join(core.select("key", "sid", "n"), "key", blocks, core.count(), how="inner")
    right = written(right.select("block", "sid", "n").distinct(), "jaccard-parts")
    parts = written(right.groupBy("block").agg(_blocks().alias("parts")), "jaccard-part-counts")
    right = right.join(parts, "block").select("block", F.pmod(F.xxhash64("sid"), "parts").alias("part"), "sid", F.lit(False).alias("left"))
    left = home.join(parts, "block").select("block", F.explode(F.sequence(F.lit(0).cast("long"), (F.col("parts") - 1).cast("long"))).alias("part"), "sid", F.lit(True).alias("left"))
    return left.union(right)


def _blocks() -> Column:
    return F.greatest(F.ceil(F.count("*") / BLOCK_ROWS), F.ceil(F.sum("n") / BLOCK_GRAMS)).cast("int")


def block_links(dealt: DataFrame, texts: DataFrame, copies: DataFrame, n: int, percent: int) -> DataFrame:
    """Of each block's sets against each of its parts a forest of the links (kind 0: a, b) and how many rows they link to (kind 1: a set, b rows)."""
    rows = dealt.join(texts, "sid").join(copies, "sid")

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        at = group.column("left").to_numpy(zero_copy_only=False)
        sids, copy = group.column("sid").to_numpy(), group.column("copies").to_numpy()
        sets = [grams(t.as_py(), n) for t in group.column("text")]
        (left, x), (right, y) = ((sids[side], [s for s, z in zip(sets, side) if z]) for side in (at, ~at))
        if not len(left) or not len(right):
            return pa.table({"kind": pa.array([], pa.int32()), "a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        near = block_near(x, y, percent) & (left[:, None] != right[None, :])
        links = link_forest(left.tolist(), right.tolist(), near)
        count = near @ copy[~at].astype(np.int64)
        some = np.flatnonzero(count)
        a, b = [p for p, _ in links] + left[some].tolist(), [q for _, q in links] + count[some].tolist()
        kind = np.repeat(np.array([0, 1], np.int32), [len(links), len(some)])
        return pa.table({"kind": pa.array(kind), "a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return rows.select("block", "part", "sid", "left", "text", "copies").groupBy("block", "part").applyInArrow(run, "kind int, a long, b long")


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links): near_duplicates, and to how many other rows each row links.

    Every pair that meets is verified. Pairs that common n-grams alone may link are counted in their
    blocks and not emitted.
    """
    sets, pairs, core, texts = met_sets(docs, id_col, text_col, n, percent)
    copies = written(sets.where("sid IS NOT NULL").groupBy("sid").agg(F.count("*").alias("copies")), "jaccard-copies")
    verified = written(verify(pairs, texts, n, percent), "jaccard-links")
    dealt = written(dealt_blocks(core, core.select("key", "sid", "members")), "jaccard-dealt")
    blocks = written(block_links(dealt, texts, copies, n, percent), "jaccard-block-links")
    component = connected_components(verified.union(blocks.where("kind = 0").select("a", "b")))
    # a pair counts once each way: in the block of the one where the other is sent there, else from the verified pairs
    home = dealt.where("left").select("sid", "block").distinct()
    sent = dealt.where("NOT left").select(F.col("sid").alias("other"), "block")
    ends = verified.select(F.explode(F.array(F.struct(F.col("a").alias("sid"), F.col("b").alias("other")), F.struct(F.col("b").alias("sid"), F.col("a").alias("other")))).alias("e")).select("e.*")
    alone = ends.join(home, "sid", "left").join(sent, ["other", "block"], "left_anti")
    ends = alone.join(copies.select(F.col("sid").alias("other"), "copies"), "other").select("sid", F.col("copies").alias("n"))
    counts = ends.union(blocks.where("kind = 1").select("a", "b")).union(copies.select("sid", F.col("copies") - 1))
    per_set = counts.groupBy("sid").agg(F.sum("n").alias("n_links")).join(component, F.col("sid") == F.col("node"), "left")
    total = sets.count()
    joined = _salted_join(sets, "sid", per_set.select(F.col("sid").alias("key"), "n_links", "component"), total)
    joined = joined.select("doc_id", "n_shingles", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "sid").alias("class"))
    return _least_ids(written(joined, "jaccard-classes"), total).select("doc_id", "n_shingles", "component_id", "n_links")


def met_sets(docs: DataFrame, id_col: str, text_col: str, n: int, percent: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The sets of the rows, pairs that must be verified, core members of long runs, and the texts of both.

    Each linked pair of unequal sets is among the pairs, or both are core members of one run.
    """
    schemes = Schemes(percent)
    plain = small_batches(docs).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sets = written(document_sets(plain, "doc_id", "text", n), "jaccard-sets")
    met = written(meetings(signature_rows(plain, "text", n, schemes), percent), "jaccard-met")
    long = written(long_segments(met), "jaccard-long")
    pairs = written(candidate_pairs(met, long, schemes), "jaccard-pairs")
    members = written(long_run_members(met, long, schemes), "jaccard-members")
    wanted = pairs.select(F.col("a").alias("sid")).union(pairs.select("b")).union(members.select("sid")).distinct()
    texts = written(set_texts(plain, sets, wanted), "jaccard-texts")
    rows = written(member_grams(members, texts, n), "jaccard-grams")
    met_grams = written(meetings(rows.where("kind = 0").select("key", "sid", "meta"), percent), "jaccard-met-grams")
    parts = written(common_parts(rows, met_grams), "jaccard-common")
    pairs = written(pairs.union(rare_pairs(met_grams, parts, percent)).distinct(), "jaccard-pairs")
    core = written(core_members(members, parts, percent), "jaccard-core")
    return sets, pairs, core, texts


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, text_hash, n_shingles, class) of each row of docs: rows that links connect share a class, null without words."""
    sets, pairs, core, texts = met_sets(docs, id_col, text_col, n, percent)
    first = written(forest(pairs).union(pivot_pairs(core, percent)).distinct(), "jaccard-first-pairs")
    links = written(verify(first, texts, n, percent), "jaccard-links")
    component = written(connected_components(links), "jaccard-components")
    open_pairs = written(across(pairs.join(first, ["a", "b"], "left_anti"), component), "jaccard-open")
    if not open_pairs.isEmpty():
        links = links.union(written(verify(open_pairs, texts, n, percent), "jaccard-more"))
        component = written(connected_components(links), "jaccard-components")
    left = written(stragglers(core, component, ["key", "sid", "members"]), "jaccard-stragglers")
    if not left.isEmpty():
        none = sets.where("sid IS NOT NULL").select("sid").distinct().withColumn("copies", F.lit(1).cast("long"))
        blocks = block_links(dealt_blocks(core, left), texts, none, n, percent).where("kind = 0").select("a", "b")
        component = connected_components(links.union(written(blocks, "jaccard-block-links")))
    joined = _salted_join(sets, "sid", component.select(F.col("node").alias("key"), "component"), sets.count())
    return written(joined.select("doc_id", "text_hash", "n_shingles", F.coalesce("component", "sid").alias("class")), "jaccard-classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row of docs.

    Two rows link when 100 * common shingles >= percent * all shingles of both; component_id is the
    smallest id that a row reaches by links. A text of fewer than n words is one shingle, a text
    without words has none and links with nothing: its component is its own id. Rows that repeat
    an id or a text link as any others; null ids are never the smallest. No rows: no rows.

    Nothing is capped: each linked pair of unequal sets meets in a short run, shares rare n-grams,
    or is in a block of a long run. A forest of the pairs is verified first, then every pair whose
    ends that left in different components, then those in the blocks; all on whole texts. Shingles
    and sets are compared by 64-bit hashes.
    """
    rows = classes(docs, id_col, text_col, n, percent)
    return _least_ids(rows, rows.count()).select("doc_id", "n_shingles", "component_id")


def _least_ids(joined: DataFrame, total: int) -> DataFrame:
    """joined (of total rows) and component_id, the smallest doc_id of its class."""
    least = joined.where("class IS NOT NULL").groupBy("class").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    out = _salted_join(joined, "class", least.select(F.col("class").alias("key"), "least"), total)
    return out.withColumn("component_id", F.coalesce("least", "doc_id"))


def _salted_join(rows: DataFrame, column: str, per_key: DataFrame, total: int, per_part: int = ROWS_PER_PART, how: str = "left", counted: DataFrame | None = None) -> DataFrame:
    """rows (of total rows) joined with the few rows of per_key (column key) that have their key.

    A key of more than per_part rows, of which there are BROADCAST_ROWS at most, is dealt into as
    many parts as its rows need. counted may stand for rows where it has the same keys.
    """
    most = max(per_part, total // BROADCAST_ROWS)
    source = rows if counted is None else counted
    hot = source.groupBy(F.col(column).alias("__key")).agg(F.count("*").alias("__n")).where(F.col("__n") > most)
    hot = F.broadcast(hot.select("__key", F.ceil(F.col("__n") / most).cast("int").alias("__parts")))
    salt = F.when(F.col(column).isNull(), F.lit(NULL_PARTS)).otherwise(F.coalesce("__parts", F.lit(1)))
    salted = rows.join(hot, F.col(column) == F.col("__key"), "left").withColumn("__salt", F.pmod(F.xxhash64(*source.columns), salt)).drop("__key", "__parts")
    keyed = per_key.withColumnRenamed("key", "__of")
    spread = keyed.join(hot, F.col("__of") == F.col("__key"), "left").withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), (F.coalesce("__parts", F.lit(1)) - 1).cast("long"))))
    spread = spread.drop("__key", "__parts")
    return salted.join(spread, (F.col(column) == F.col("__of")) & (F.col("__salt") == F.col("__part")), how).drop("__salt", "__part", "__of")


def op2_ngram_jaccard(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs, n=4, percent=85)


def op2_ngram_jaccard_links(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_links(docs, n=4, percent=85)


def op2_sql() -> str:
    return """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y USING (g) WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 85 * (na.n + nb.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT doc_id, b FROM reach JOIN both_ways ON a = other)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, r.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)
"""
