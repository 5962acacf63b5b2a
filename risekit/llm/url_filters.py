"""URL filters: glob rules packed in multiword Shift-And masks, all simulated at once per URL.

A rule is a host and a path prefix. It fits URLs of its host and of all subdomains whose path
starts with the rule's path; the longest fitting rule wins. As globs over the canonical URL
(host + path) a rule is ``host path *`` and ``* . host path *``, where the first ``*`` stays
within the host. Every glob takes one bit per literal byte; the bits of all globs lie side by
side in 64-bit words. One step per URL byte advances all globs of all URLs of a batch.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risekit.llm.common import ascii_lower, unused

#: (verdict, host, path) of the production rule set.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: What the method says of a URL that no rule fits: a block list lets it pass.
DEFAULT_VERDICT = "allow"
_SLASH = ord("/")


class GlobAutomaton:
    """Shift-And masks of rules; match() gives each canonical URL's longest fitting rule."""

    def __init__(self, rules: Sequence[tuple[str, str, str]]):
        globs = []
        for k, (_, host, path) in enumerate(rules):
            literal = (host + path).encode()
            globs += [(k, False, literal), (k, True, b"." + literal)]
        bits = sum(len(g[2]) for g in globs)
        words = max(1, -(-bits // 64))
        self.chars = np.zeros((256, words), np.uint64)  # byte -> bits whose literal it is
        self.first = np.zeros(words, np.uint64)  # the first bit of each glob
        self.floating = np.zeros(words, np.uint64)  # the first bits of globs with a leading star
        self.last: list[tuple[int, np.uint64, int]] = []
        at = 0
        for k, star, literal in globs:
            for j, byte in enumerate(literal):
                word, bit = divmod(at, 64)
                mask = np.uint64(1) << np.uint64(bit)
                self.chars[byte, word] |= mask
                if j == 0:
                    self.first[word] |= mask
                    if star:
                        self.floating[word] |= mask
                at += 1
            self.last.append((word, mask, k))
        self.sticky = np.zeros(words, np.uint64)  # last bits: the trailing star keeps them set
        for word, mask, _ in self.last:
            self.sticky[word] |= mask
        self.size = np.array([len(host + path) for _, host, path in rules])

    def match(self, urls: Sequence[bytes]) -> np.ndarray:
        """Index of the longest rule that fits each URL, -1 for none."""
        n = len(urls)
        length = np.fromiter(map(len, urls), np.int64, n)
        order = np.argsort(-length, kind="stable")
        flat = np.frombuffer(b"".join(urls), np.uint8)
        start = np.concatenate(([0], np.cumsum(length)[:-1])) if n else length
        start, sorted_len = start[order], length[order]
        state = np.zeros((n, len(self.first)), np.uint64)
        in_host = np.ones(n, bool)
        one, top = np.uint64(1), np.uint64(63)
        for t in range(int(sorted_len[0]) if n else 0):
            live = int(np.searchsorted(-sorted_len, -t, side="left"))  # URLs longer than t
            byte = flat[start[:live] + t]
            before = state[:live]
            step = before << one
            step[:, 1:] |= before[:, :-1] >> top
            step &= ~self.first
            if t == 0:
                step |= self.first
            else:
                step[in_host[:live]] |= self.floating
            state[:live] = (step & self.chars[byte]) | (before & self.sticky)
            in_host[:live] &= byte != _SLASH
        best = np.full(n, -1)
        for word, mask, k in self.last:
            hit = (state[:, word] & mask) != 0
            better = hit & ((best < 0) | (self.size[k] > self.size[best]))
            best[better] = k
        out = np.empty(n, np.int64)
        out[order] = best
        return out


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path columns; both empty for a null URL or one without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    given = F.coalesce(url, F.lit(""))
    return ascii_lower(F.regexp_extract(given, pattern, 1)), F.regexp_extract(given, pattern, 2)


def filter_urls(
    pages: DataFrame,
    url_col: str = "url",
    rules: Sequence[tuple[str, str, str]] = RULES,
    default: str = DEFAULT_VERDICT,
) -> DataFrame:
    """pages with columns host, path, rule and verdict added (replaced where they exist).

    Nothing is shuffled and no row is dropped, so repeated rows each get the same verdict and a
    host with a third of all rows costs nothing extra. Null URLs have empty host and path, no
    rule and the default verdict. Of fitting rules of equal length the first in rules wins. An empty
    table gives an empty result.
    """
    names = [host + path for _, host, path in rules]
    verdicts = [verdict for verdict, _, _ in rules]

    @F.pandas_udf("int")
    def rule_index(host: pd.Series, path: pd.Series) -> pd.Series:
        automaton = GlobAutomaton(rules)
        urls = [h.encode() + p.encode() for h, p in zip(host, path)]
        return pd.Series(automaton.match(urls).astype("int32"))

    host, path = url_parts(F.col(url_col))
    kept = [c for c in pages.columns if c.lower() not in {"host", "path", "rule", "verdict"}]
    (number,) = unused(pages, "rule_number")
    found = pages.select(*[F.col(f"`{c}`") for c in kept], host.alias("host"), path.alias("path")).withColumn(number, rule_index("host", "path"))

    def pick(values: list[str]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]).cast("array<string>"), F.when(F.col(number) >= 0, F.col(number)))

    return found.select(*[F.col(f"`{c}`") for c in kept], "host", "path", pick(names).alias("rule"), F.coalesce(pick(verdicts), F.lit(default)).alias("verdict"))


def op5_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op5_sql() -> str:
    cases = "\n".join(
        f"WHEN (host = '{host}' OR host LIKE '%.{host}') AND path LIKE '{path}%' THEN '{host}{path}'"
        for _, host, path in sorted(RULES, key=lambda r: -len(r[1] + r[2]))
    )
    verdicts = "\n".join(f"WHEN '{host}{path}' THEN '{verdict}'" for verdict, host, path in RULES)
    return f"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages),
ruled AS (SELECT page_id, host, path, CASE {cases} ELSE NULL END AS rule FROM parts)
SELECT page_id, host, path, rule, CASE rule {verdicts} ELSE '{DEFAULT_VERDICT}' END AS verdict FROM ruled
"""
