"""Benchmark decontamination with an FM-index per shard of training documents.

Each task cuts its documents into shards of bounded size. A shard's words are coded over the
phrases' alphabet; words that no phrase has break the text, and stretches shorter than the
shortest phrase are left out, as no phrase can lie there. Over the rest a suffix array gives the
Burrows-Wheeler transform, kept as a wavelet tree. All phrases are searched backward at once by
wavelet ranks, occurrences are located by walking to sampled suffix positions, and their spans are
merged per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from risekit.llm.common import small_batches, table

WINDOW = 10
#: Bytes of documents indexed together; one longer document is a shard of its own.
SHARD_BYTES = 5_000_000
#: Bytes of benchmark text that one pass over the documents searches for.
BLOCK_BYTES = 16_000_000
SAMPLE = 8
LOCATE_ROWS = 1 << 20
_WORDS = bytes(b + 32 if 65 <= b <= 90 else (b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32) for b in range(256))
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
_ARROW_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters, in UTF-8."""
    return (text or "").encode().translate(_WORDS).split()


class Phrases:
    """The distinct windows of benchmark items, coded over their own alphabet (codes from 2)."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        found: dict[tuple[bytes, ...], set[int]] = {}
        for item, text in items:
            words = words_of(text)
            for i in range(max(1, len(words) - window + 1) if words else 0):
                found.setdefault(tuple(words[i : i + window]), set()).update(() if item is None else (item,))
        self.codes: dict[bytes, int] = {}
        for phrase in found:
            for w in phrase:
                self.codes.setdefault(w, len(self.codes) + 2)
        self.length = np.array([len(p) for p in found], np.int64)
        self.matrix = np.ones((len(found), window), np.int64)
        for i, phrase in enumerate(found):
            self.matrix[i, : len(phrase)] = [self.codes[w] for w in phrase]
        self.items = [sorted(s) for s in found.values()]
        self.shortest = int(self.length.min()) if found else 0


def suffix_array(symbols: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Suffix array of symbols; every break (symbol 1) is smaller than all codes and unlike any other."""
    n = len(symbols)
    rank = symbols + int(breaks.sum())
    rank[breaks] = np.arange(1, breaks.sum() + 1)
    bits = int(rank.max()).bit_length()
    packed = max(1, 62 // bits)
    key = np.zeros(n, np.int64)
    for j in range(packed):
        key <<= bits
        if j < n:
            key[: n - j] |= rank[j:]
    sa = np.argsort(key, kind="stable")
    ordered = key[sa]
    new = np.r_[True, ordered[1:] != ordered[:-1]]
    rank = np.empty(n, np.int64)
    rank[sa] = np.flatnonzero(new)[np.cumsum(new) - 1]
    tied = ~(new & np.r_[new[1:], True])
    at = np.flatnonzero(tied)  # rows of sa whose order isn't settled; rank is the first row of their group
    step = packed
    while len(at):
        pos = sa[at]
        ahead = pos + step
        after = np.where(ahead < n, rank[np.minimum(ahead, n - 1)] + 1, 0)
        key = rank[pos] * (n + 1) + after
        order = np.argsort(key, kind="stable")
        pos, key = pos[order], key[order]
        sa[at] = pos  # groups keep their rows, as at and rank ascend together
        new = np.r_[True, key[1:] != key[:-1]]
        rank[pos] = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
        at = at[~(new & np.r_[new[1:], True])]
        step *= 2
    return sa


class Wavelet:
    """Wavelet tree over an integer sequence, level by level, with packed bits and block counts."""

    def __init__(self, seq: np.ndarray, sigma: int):
        self.n, self.sigma = len(seq), sigma
        self.levels = max(1, (sigma - 1).bit_length())
        self.bits: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.zeros: list[int] = []
        for level in range(self.levels - 1, -1, -1):
            bit = (seq >> level & 1).astype(bool)
            padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
            padded[: self.n] = bit
            words = np.packbits(padded, bitorder="little").view("<u8")
            self.bits.append(words)
            self.counts.append(np.concatenate(([0], np.cumsum(np.bitwise_count(words), dtype=np.int64))))
            self.zeros.append(int(self.n - self.counts[-1][-1]))
            seq = np.concatenate((seq[~bit], seq[bit]))

    def ones(self, level: int, i: np.ndarray) -> np.ndarray:
        """Set bits of a level before i."""
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[level][i >> 6] + np.bitwise_count(self.bits[level][i >> 6] & mask)

    def place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where the occurrences of symbol from i on start in the last level's order."""
        for level in range(self.levels):
            one = self.ones(level, i)
            bit = symbol >> (self.levels - 1 - level) & 1
            i = np.where(bit == 1, self.zeros[level] + one, i - one)
        return i

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at i, and the place of that occurrence in the last level's order."""
        symbol = np.zeros(len(i), np.int64)
        for level in range(self.levels):
            one = self.ones(level, i)
            bit = (self.bits[level][i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            symbol = symbol << 1 | bit
            i = np.where(bit == 1, self.zeros[level] + one, i - one)
        return symbol, i


class FmIndex:
    """Backward search and location over coded text, in which symbol 1 is a break."""

    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        n = len(symbols)
        breaks = symbols == 1
        sa = suffix_array(symbols, breaks)
        used = np.unique(symbols)
        self.dense = np.full(int(symbols.max()) + 1, -1)
        self.dense[used] = np.arange(len(used))
        small = self.dense[symbols]
        self.wavelet = Wavelet(small[sa - 1], len(used))
        self.first = np.concatenate(([0], np.cumsum(np.bincount(small, minlength=len(used)))))
        self.base = self.wavelet.place(np.arange(len(used)), np.zeros(len(used), np.int64))
        # a break has no defined predecessor row, so the first word of each stretch is sampled too
        kept = (np.arange(n) % sample == 0) | np.r_[True, breaks[:-1]]
        self.sampled = kept[sa]
        self.slot = np.cumsum(self.sampled) - 1
        self.position = sa[self.sampled]

    def search(self, matrix: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals [lo, hi) of all phrases."""
        lo, hi = np.zeros(len(length), np.int64), np.full(len(length), self.wavelet.n)
        for step in range(matrix.shape[1] - 1, -1, -1):
            live = np.flatnonzero((step < length) & (lo < hi))
            symbol = matrix[live, step]
            symbol = np.where(symbol < len(self.dense), self.dense[np.minimum(symbol, len(self.dense) - 1)], -1)
            hi[live[symbol < 0]] = lo[live[symbol < 0]]
            live, symbol = live[symbol >= 0], symbol[symbol >= 0]
            for bound in (lo, hi):
                bound[live] = self.first[symbol] + self.wavelet.place(symbol, bound[live]) - self.base[symbol]
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by steps back to a sampled one."""
        out, steps = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64)
        live, at = np.arange(len(rows)), rows.copy()
        while len(live):
            done = self.sampled[at]
            out[live[done]] = self.position[self.slot[at[done]]] + steps[live[done]]
            live, at = live[~done], at[~done]
            symbol, place = self.wavelet.access(at)
            at = self.first[symbol] + place - self.base[symbol]
            steps[live] += 1
        return out


def shard_hits(words: list[list[bytes]], phrases: Phrases) -> dict[int, tuple[list[tuple[int, int]], list[int]]]:
    """For each document with occurrences: merged word spans and the items, from one shard's index."""
    get = phrases.codes.get
    size = np.array([len(w) + 1 for w in words])
    if not len(phrases.length) or not len(size):
        return {}
    # a break after each document and for each word that no phrase has
    coded = np.fromiter((c for w in words for c in (*[get(x, 1) for x in w], 1)), np.int64, int(size.sum()))
    known = coded > 1
    edge = np.flatnonzero(np.diff(np.r_[False, known, False].astype(np.int8)))
    start, end = edge[::2], edge[1::2]
    long = end - start >= phrases.shortest
    start, end = start[long], end[long]
    if not len(start):
        return {}
    run = end - start + 1  # with one break after each stretch
    offset = np.cumsum(run) - run
    origin = np.repeat(start - offset, run) + np.arange(int(run.sum()))
    symbols = coded[origin]
    index = FmIndex(symbols)
    lo, hi = index.search(phrases.matrix, phrases.length)
    doc_start = np.cumsum(size) - size
    mark = np.zeros(len(coded) + 1, np.int64)
    items: dict[int, set[int]] = {}
    found = np.flatnonzero(lo < hi)
    counts = hi[found] - lo[found]
    for part in np.array_split(found, max(1, int(counts.sum()) // LOCATE_ROWS)) if len(found) else []:
        n = hi[part] - lo[part]
        which = np.repeat(part, n)
        rows = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[part], n)
        at = origin[index.locate(rows)]
        np.add.at(mark, at, 1)
        np.add.at(mark, at + phrases.length[which], -1)
        doc = np.searchsorted(doc_start, at, side="right") - 1
        for pair in np.unique(doc * len(phrases.length) + which).tolist():
            d, w = divmod(pair, len(phrases.length))
            items.setdefault(d, set()).update(phrases.items[w])
    covered = np.cumsum(mark) > 0
    edge = np.flatnonzero(np.diff(np.r_[False, covered, False].astype(np.int8)))
    out = {d: ([], sorted(s)) for d, s in items.items()}
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
        d = int(np.searchsorted(doc_start, a, side="right")) - 1
        out[d][0].append((a - int(doc_start[d]), b - int(doc_start[d])))
    return out


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_spans(docs: DataFrame, phrases: Phrases, text_col: str = "text", keep: list[str] | None = None, before: bool = False, kind: T.DataType = T.LongType(), cut: bool = False) -> DataFrame:
    """docs with n_words, spans (word start and end, merged) and items (ids of that kind), in place of columns of these names.

    before: docs is the result of another pass, whose spans and items are added to. cut: texts come
    without their spans, as cut_spans has them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(phrases)  # BLOCK_BYTES of text at most
    added = ["n_words", "spans", "items"]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    extra = [c for c in dict.fromkeys([text_col, *(("spans", "items") if before else ())]) if c not in kept]
    source = docs.select(*[F.col(f"`{c}`") for c in [*kept, *extra]])
    fields = [source.schema[c] for c in kept]
    schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(kind))])
    names = [*kept, *extra]
    at = names.index(text_col)
    items_type = pa.list_(to_arrow_type(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        held, words, size = [], [], 0
        for batch in batches:
            texts, begin = batch.column(at), 0
            for i, text in enumerate(texts):
                text = text.as_py()
                words.append(words_of(text))
                size += len(text or "")
                if size >= SHARD_BYTES:
                    held.append(batch.slice(begin, i + 1 - begin))
                    yield from _answer(held, words, own)
                    held, words, size, begin = [], [], 0, i + 1
            if begin < batch.num_rows:
                held.append(batch.slice(begin))
        if held:
            yield from _answer(held, words, own)

    def _answer(held: list[pa.RecordBatch], words: list[list[bytes]], own: Phrases) -> Iterator[pa.RecordBatch]:
        hits, at_row = shard_hits(words, own), 0
        for batch in held:
            rows = range(at_row, at_row + batch.num_rows)
            at_row += batch.num_rows
            spans = [hits[r][0] if r in hits else [] for r in rows]
            items = [hits[r][1] if r in hits else [] for r in rows]
            if before:
                old_s, old_i = batch.column(names.index("spans")).to_pylist(), batch.column(names.index("items")).to_pylist()
                spans = [_merged([*s, *((x["start"], x["end"]) for x in o)]) for s, o in zip(spans, old_s)]
                items = [sorted({*i, *o}) for i, o in zip(items, old_i)]
            cells = [
                pa.array([len(words[r]) for r in rows], pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], _ARROW_SPANS),
                pa.array(items, items_type),
            ]
            columns = batch.columns[: len(kept)]
            if cut and at < len(kept) and any(spans):
                texts = [without_spans(t, [{"start": a, "end": b} for a, b in s]) for t, s in zip(columns[at].to_pylist(), spans)]
                columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays([*columns, *cells], names=[*kept, *added])

    return small_batches(source).mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: list[str] | None = None, cut: bool = False) -> DataFrame:
    """docs (or their columns in keep) with n_words, spans and items.

    Windows are WINDOW consecutive words of an item, or all its words where it has fewer; items
    without words have none. Spans are the merged word ranges inside occurrences, items the sorted
    ids of items with an occurring window (a null id isn't listed, its windows count). Item ids are of
    any one type; repeated items count once. The benchmark is searched in blocks of bounded size, one pass over the documents each. A null text
    has no words; repeated rows get equal results; nothing is shuffled or dropped. Columns of docs
    named n_words, spans or items are replaced, all others come through. cut: the last pass cuts the
    spans (of the texts as they were) out, as cut_spans does, without another Python worker for it.
    """
    given = benchmark.select("item_id", "text").where("text IS NOT NULL").distinct()  # repeated rows would share a block
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    kind = benchmark.schema["item_id"].dataType
    out = docs
    for b in range(blocks):
        rows = given.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()
        last = b == blocks - 1
        out = find_spans(out, Phrases([(r["item_id"], r["text"]) for r in rows]), text_col, keep if last else None, before=b > 0, kind=kind, cut=cut and last)
    return out


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + (s["end"] - s["start"]))


def cut_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with their texts' spans cut out, from the first hit word to the last; other texts as they are."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without_spans(t, s) for t, s in zip(text, spans)], dtype=object)

    cells = [F.when(F.size("spans") > 0, cut(F.col(c), F.col("spans"))).otherwise(F.col(c)).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return docs.select(*cells)


def without_spans(text: str | None, spans) -> str | None:
    if text is None or spans is None or not len(spans):
        return text
    raw = text.encode()
    blank = np.r_[True, np.frombuffer(raw.translate(_WORDS), np.uint8) == 32, True]
    start, end = np.flatnonzero(blank[:-1] & ~blank[1:]), np.flatnonzero(~blank[:-1] & blank[1:])
    out, at = [], 0
    for s in spans:
        out.append(raw[at : start[s["start"]]])
        at = int(end[s["end"] - 1])
    return b"".join([*out, raw[at:]]).decode()


def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contaminated(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    listed = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id",
        "n_words",
        n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        (n_hit() > 0).alias("contaminated"),
    )


def op9_sql() -> str:
    words = "regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, coalesce({words.format(t="text")}, []) AS w FROM documents),
b AS (SELECT item_id, {words.format(t="text")} AS w FROM benchmark),
bw AS (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS p, least(len(w), {WINDOW}) AS n FROM bw),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d),
dp AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS p FROM dw, sizes WHERE i + n - 1 <= len(w)),
occ AS (SELECT DISTINCT doc_id, i, dp.n, item_id FROM dp JOIN win USING (p)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM occ) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS listed FROM occ GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
