"""BPE encoding and decoding by speculate and verify.

Each distinct word is cut greedily into longest matching tokens. A cut is what the merges would
give exactly when every token is reachable by itself and every adjacent pair is compatible, that
is, no merge would have joined across the boundary before one of the two sides had merged away
from it. Pair checks run vectorised over all words of a batch; only words that fail are merged
exactly. Words are looked up in a bounded cache, so work per task follows its distinct words.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from risekit.llm.common import slices, small_batches, table

#: The tokenizer of the production query, from the public vocabularies.
TOKENIZER = "word_bpe_49k.json"
#: Distinct words and chunks kept between batches of a task.
CACHE_WORDS = 300_000
END = "</w>"
#: White space as the vocabulary's normaliser sees it (Unicode White_Space).
_SPACE = r"\t-\r \x85\xa0  -     　"
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_SPACE}\p{{L}}\p{{N}}]+")


def _ranges(kind: str, top: int = 0x250) -> str:
    """Regex ranges of the characters below top whose Unicode category starts with kind."""
    found, out = [c for c in range(top) if unicodedata.category(chr(c))[0] == kind], []
    for c in found:
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in out)


#: The same words for texts of Latin letters, in the quicker standard module.
_LATIN = re.compile(rf"[{_ranges('L')}]+|'(?:s|t|re|ve|m|ll|d)|[{_ranges('N')}]|[^{_SPACE}{_ranges('L')}{_ranges('N')}]+")
_NOT_LATIN = re.compile("[^\x00-\u024f]")
#: White space to Python, but not to the vocabulary.
_SEPARATOR = re.compile("[\x1c-\x1f]")
_CHUNK = re.compile(f"[^{_SPACE}]+")
_FOREVER = np.int64(1 << 40)
_NO_PAIR = 1 << 60
#: Bytes of words that are merged side by side in one array, and rows of it.
_SIDE_BY_SIDE, _ROWS = (8, 16, 32), 1 << 15
#: Letters that tokens are looked up by.
_HEAD = 4


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters, spare = [""] * 256, 256
    for b in range(256):
        if b in printable:
            letters[b] = chr(b)
        else:
            letters[b] = chr(spare)
            spare += 1
    return letters


def packed(ids: list[int]) -> bytes:
    """Ids as little-endian unsigned 32-bit integers."""
    return struct.pack(f"<{len(ids)}I", *ids)


class WordBpe:
    """Encoder and decoder of one vocabulary file whose words end in ``</w>``."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS, speculate: bool = True):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (max([*self.vocab.values(), *self.special.values()]) + 1)
        for s, i in [*self.vocab.items(), *self.special.items()]:
            self.strings[i] = s
        n = len(self.strings)
        merges: dict[int, int] = {}  # pair of ids -> rank and merged id, in one integer each
        self.born = np.full(n, -1, np.int64)
        self.left, self.right = np.arange(n), np.arange(n)
        keys, ranks = [], []
        for r, (a, b) in enumerate(model["merges"]):
            i, j, k = self.vocab[a], self.vocab[b], self.vocab[a + b]
            merges[i << 20 | j] = r << 20 | k
            keys.append(i << 20 | j)
            ranks.append(r)
            if self.born[k] < 0:
                self.born[k], self.left[k], self.right[k] = r, i, j
        self.best = merges.get
        order = np.argsort(keys)
        self.keys, self.key_ranks = np.array(keys, np.int64)[order], np.array(ranks, np.int64)[order]
        self.merged = np.array([self.vocab[a + b] for a, b in model["merges"]], np.int64)
        self.letters = dict(enumerate(byte_letters()))
        self.letter, self.last_letter = (np.array([self.vocab.get(x + end, -1) for x in byte_letters()], np.int64) for end in ("", END))
        self.whole = min(self.letter.min(), self.last_letter.min()) >= 0  # the vocabulary has every letter
        # the longest token, and the longest with a word's end, among those that start with the same letters
        self.reach: dict[str, int] = {}
        self.reach_end: dict[str, int] = {}
        for token in self.vocab:
            reach, letters = (self.reach_end, token.removesuffix(END)) if token.endswith(END) else (self.reach, token)
            head = letters[:_HEAD]
            reach[head] = max(reach.get(head, 0), len(letters))
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # words and chunks (stretches between white space) of two generations, each of half the size
        self.cache: dict[str | int, bytes] = {}
        self.older: dict[str | int, bytes] = {}
        self.cache_words, self.speculate = cache_words, speculate
        self.exact = 0  # words that needed exact merging
        self.reachable = self._reachable()

    def _reachable(self) -> np.ndarray:
        """Tokens that the merges make from their own string: both halves are reachable and compatible."""
        ok = np.ones(len(self.strings), bool)
        made = np.flatnonzero(self.born >= 0)
        fits = self.compatible(self.left[made], self.right[made], self.born[made])
        for k, fit in sorted(zip(made.tolist(), fits.tolist()), key=lambda x: self.born[x[0]]):
            ok[k] = fit and ok[self.left[k]] and ok[self.right[k]]
        return ok

    def compatible(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """For each adjacent pair of tokens, whether no merge (before rank until) joins across it.

        Both sides are undone step by step, the later-made first; at each step the two symbols at
        the boundary exist at the same time, and a merge of them wins if it ranks before the merge
        that takes the left symbol away, or not after the one that takes the right symbol away.
        """
        a, b = np.array(a), np.array(b)
        end_a = np.full(len(a), _FOREVER) if until is None else until.copy()
        end_b = end_a.copy() if until is None else until - 1
        ok = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            rank = self.ranks(x, y)
            clash = (rank < end_a[live]) & (rank <= end_b[live])
            ok[live[clash]] = False
            go = ~clash & ((self.born[x] >= 0) | (self.born[y] >= 0))
            live, x, y = live[go], x[go], y[go]
            undo_left = self.born[x] > self.born[y]
            rows = live[undo_left]
            end_a[rows], a[rows] = self.born[x[undo_left]], self.right[x[undo_left]]
            rows = live[~undo_left]
            end_b[rows], b[rows] = self.born[y[~undo_left]], self.left[y[~undo_left]]
        return ok

    def symbols(self, word: str) -> str:
        return word.encode().decode("latin-1").translate(self.letters)

    def greedy(self, s: str) -> list[int] | None:
        """Longest-match tokens of a word's letters and its end; None where the vocabulary lacks one."""
        get, reach, reach_end, out, i, n = self.vocab.get, self.reach.get, self.reach_end.get, [], 0, len(s)
        while i < n:
            if n - i <= reach_end(s[i : i + _HEAD], 0):
                k = get(s[i:] + END)
                if k is not None:
                    out.append(k)
                    return out
            most = i + reach(s[i : i + _HEAD], _HEAD - 1)
            for j in range(min(n - 1, most), i, -1):
                k = get(s[i:j])
                if k is not None:
                    out.append(k)
                    i = j
                    break
            else:
                return None
        return out

    def merge(self, s: str) -> list[int]:
        """Exact merging: the pair of lowest rank first, leftmost of equals."""
        vocab = self.vocab
        ids = [i for i in [*map(vocab.get, s[:-1]), vocab.get(s[-1] + END)] if i is not None]
        return self._merge_short(ids) if len(ids) <= 48 else self._merge_long(ids)

    def _merge_short(self, ids: list[int]) -> list[int]:
        """The best pair is searched anew after each merge: quadratic, and quick on short words."""
        best, none = self.best, _NO_PAIR
        pairs = [best(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while pairs:
            m = min(pairs)
            if m == none:
                break
            i = pairs.index(m)
            ids[i] = k = m & 0xFFFFF
            del ids[i + 1], pairs[i]
            if i:
                pairs[i - 1] = best(ids[i - 1] << 20 | k, none)
            if i < len(pairs):
                pairs[i] = best(k << 20 | ids[i + 1], none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """A heap of pairs over a linked list, for words of any length."""
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        best = self.best
        heap = [(m, i) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (m := best(a << 20 | b)) is not None]
        heapq.heapify(heap)
        dead = [False] * len(ids)
        while heap:
            m, i = heapq.heappop(heap)
            j = after[i]
            if dead[i] or j >= len(ids) or best(ids[i] << 20 | ids[j]) != m:
                continue
            ids[i], dead[j] = m & 0xFFFFF, True
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for left in (before[i], i):
                if left >= 0 and after[left] < len(ids):
                    m = best(ids[left] << 20 | ids[after[left]])
                    if m is not None:
                        heapq.heappush(heap, (m, left))
        return [t for t, d in zip(ids, dead) if not d]

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge, or _FOREVER."""
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], _FOREVER)

    def merge_words(self, words: list[str]) -> list[bytes]:
        """Exact merging of many words: short ones side by side as rows of an array, a merge each at a time."""
        raw = [w.encode() for w in words]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        out: list[bytes] = [b""] * len(raw)
        least = 0
        for most in _SIDE_BY_SIDE:
            rows = np.flatnonzero((size > least) & (size <= most)) if self.whole else np.zeros(0, np.int64)
            for part in (rows[i : i + _ROWS] for i in range(0, len(rows), _ROWS)):
                for i, ids in zip(part.tolist(), self._merge_rows([raw[i] for i in part.tolist()], size[part], most)):
                    out[i] = ids
            least = most if self.whole else 0
        for i in np.flatnonzero(size > least).tolist():
            out[i] = packed(self.merge(self.symbols(words[i])))
        return out

    def _merge_rows(self, raw: list[bytes], size: np.ndarray, width: int) -> list[bytes]:
        at = np.arange(width)
        letters = np.frombuffer(b"".join(r.ljust(width, b"\0") for r in raw), np.uint8).reshape(-1, width)
        ids = np.where(at == size[:, None] - 1, self.last_letter[letters], self.letter[letters])
        best = np.where(at[1:] < size[:, None], self.ranks(ids[:, :-1], ids[:, 1:]), _FOREVER)
        best = np.hstack([best, np.full((len(ids), 1), _FOREVER)])
        done, n, live = ids.astype("<u4"), size.copy(), np.arange(len(ids))
        while len(live):
            i = best.argmin(1)
            row = np.arange(len(live))
            rank = best[row, i]
            go = rank < _FOREVER
            if not go.all():
                done[live[~go]] = ids[~go]
                ids, best, i, rank, live = ids[go], best[go], i[go], rank[go], live[go]
                row = np.arange(len(live))
            n[live] -= 1
            left = n[live]
            new = self.merged[rank]
            shift = np.minimum(at + (at > i[:, None]), width - 1)
            ids = np.take_along_axis(ids, shift, 1)
            ids[row, i] = new
            best = np.take_along_axis(best, np.minimum(at + (at >= i[:, None]), width - 1), 1)
            after = np.minimum(i + 1, width - 1)
            best[row, i] = np.where(i + 1 < left, self.ranks(new, ids[row, after]), _FOREVER)
            inner = np.flatnonzero(i > 0)
            best[inner, i[inner] - 1] = self.ranks(ids[inner, i[inner] - 1], new[inner])
        flat, ends = done.tobytes(), n.tolist()
        return [flat[4 * width * k : 4 * width * k + 4 * m] for k, m in enumerate(ends)]

    def learn(self, words: Iterable[str]) -> None:
        """Encode words that the cache lacks: speculate, verify all pairs at once, merge the rest."""
        words = list(words)
        if self.speculate:
            text = [self.symbols(w) for w in words]
            cuts = [self.greedy(s) for s in text]
            flat = np.fromiter((t for c in cuts for t in (c or ())), np.int64)
            size = np.fromiter((len(c or ()) for c in cuts), np.int64, len(cuts))
            owner = np.repeat(np.arange(len(cuts)), size)
            good = size > 0
            good[owner[~self.reachable[flat]]] = False
            inner = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.zeros(0, np.int64)
            if len(inner):
                pairs, where = np.unique(flat[inner] << 20 | flat[inner + 1], return_inverse=True)
                fits = self.compatible(pairs >> 20, pairs & (1 << 20) - 1)
                good[owner[inner[~fits[where]]]] = False
            good = good.tolist()
            self.cache.update((w, packed(c)) for w, c, ok in zip(words, cuts, good) if ok)
            words = [w for w, ok in zip(words, good) if not ok]
        self.exact += len(words)
        self.cache.update(zip(words, self.merge_words(words)))

    def chunks(self, text: str) -> list[str | int]:
        """The stretches between white space after normalisation, no word spans two; a special token's string gives its id."""
        out: list[str | int] = []
        for piece in self.split.split(text) if self.split else [text]:
            if piece in self.special:
                out.append(self.special[piece])
            elif piece:
                if not piece.isascii():
                    piece = unicodedata.normalize("NFC", piece).replace("Σ", "σ")  # lower() has a rule for final sigma
                piece = piece.lower()
                # split() also breaks at four separators that are no white space to the vocabulary
                out += _CHUNK.findall(piece) if _SEPARATOR.search(piece) else piece.split()
        return out

    def learn_chunks(self, chunks: set[str | int]) -> None:
        """Put chunks into the cache, from the generation before or by learning their words."""
        if len(self.cache) + len(chunks) > self.cache_words // 2:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        cuts, new = [], set()
        for x in chunks:
            if isinstance(x, int):
                cache[x] = packed([x])
            elif (ids := older.get(x)) is not None:
                cache[x] = ids
            else:
                words = (_WORD if _NOT_LATIN.search(x) else _LATIN).findall(x)
                cuts.append((x, words))
                for w in words:
                    if w not in cache:
                        if (ids := older.get(w)) is not None:
                            cache[w] = ids
                        else:
                            new.add(w)
        self.learn(new)
        for x, words in cuts:
            if words != [x]:
                cache[x] = b"".join([cache[w] for w in words])

    def encode_batch(self, texts: Iterable[str]) -> list[bytes]:
        """Ids of each text, packed as little-endian unsigned 32-bit integers."""
        get, out, waiting, new = self.cache.get, [], [], set()
        for text in texts:
            chunks = self.chunks(text)
            cells = list(map(get, chunks))
            if None in cells:
                gaps = [i for i, c in enumerate(cells) if c is None]
                names = [chunks[i] for i in gaps]
                new.update(names)
                waiting.append((len(out), cells, gaps, names))
                out.append(b"")
            else:
                out.append(b"".join(cells))
        if new:
            self.learn_chunks(new)
            found = self.cache
            for k, cells, gaps, names in waiting:
                for i, x in zip(gaps, names):
                    cells[i] = found[x]
                out[k] = b"".join(cells)
        return out

    def forget(self) -> None:
        """Give the cache's memory back."""
        self.cache, self.older = {}, {}

    def decode(self, ids: bytes) -> str:
        """The tokens' strings joined by blanks; this vocabulary names no other decoder."""
        strings = self.strings
        return " ".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()])


@lru_cache(maxsize=2)
def tokenizer(path: str, cache_words: int = CACHE_WORDS, speculate: bool = True) -> WordBpe:
    return WordBpe(path, cache_words, speculate)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def encode(docs: DataFrame, path: str, text_col: str = "text", keep: list[str] | None = None, decoded: bool = False) -> DataFrame:
    """docs (or their columns in keep) with columns ids (packed little-endian unsigned 32-bit) and n_tokens.

    With decoded, also the text that the ids decode to, in the same pass. A null or empty text has
    no tokens. Rows are handled one by one where they lie: nothing is shuffled, and repeated rows
    get equal ids. Existing columns of these names are replaced. Memory: one slice of a batch, the
    vocabulary and a bounded cache of words, which a task gives back at its end.
    """
    added = ["ids", "n_tokens", *["decoded"] * decoded]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in added]
    names = kept if text_col in kept else [*kept, text_col]
    source = docs.select(*[F.col(f"`{c}`") for c in names])
    at = names.index(text_col)
    fields = [T.StructField("ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()), *[T.StructField("decoded", T.StringType())] * decoded]
    schema = T.StructType([*source.schema.fields[: len(kept)], *fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for part in slices(batch, at, 1 << 22):
                ids = bpe.encode_batch(t or "" for t in part.column(at).to_pylist())
                columns = [*part.columns[: len(kept)], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if decoded:
                    columns.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=[*kept, *added])
        bpe.forget()

    return small_batches(source).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with a column decoded, the text of its ids (null ids: empty); an existing one is replaced."""
    kept = [c for c in encoded.columns if c.lower() != "decoded"]
    source = encoded.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(ids_col)
    schema = T.StructType([*source.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for part in slices(batch, at):
                text = [bpe.decode(x or b"") for x in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string())], names=[*kept, "decoded"])

    return small_batches(source).mapInArrow(run, schema)


def op3_bpe(spark, sf_dir: str) -> DataFrame:
    path = vocabulary_path()
    out = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, keep=["doc_id"], decoded=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
