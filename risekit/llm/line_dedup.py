"""Line dedup: lines that many documents share lose all their occurrences.

Lines are exploded once, with their position and a hash of their normalised form; documents are
counted per hash, hashes over the threshold are joined back to the (light) line rows, and each
document is rebuilt from its own text and the positions it loses. Texts cross the network once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from risekit.functions.once import once
from risekit.llm.common import ascii_lower, unused, written

#: A line is boilerplate from so many documents on, if its key has so many code points.
MIN_DOCS = 10
MIN_CHARS = 1
BLANKS = "\t\n\x0b\x0c\r "


def text_lines(text: Column) -> Column:
    """The lines of a text; a null or empty one has one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
) -> DataFrame:
    """docs with the kept lines as text, and columns n_lines and n_dropped.

    A line's key is the line stripped of ASCII white space with A-Z lower-cased. Keys of at least
    min_chars code points found in at least min_docs documents (distinct ids; rows with a null id
    count as one document) lose all their lines. Rows may repeat an id,
    with the same text or another, and are of any type. A null or empty text is
    one empty line, which is never lost; its result is the empty text. Columns of docs named n_lines
    or n_dropped are replaced, all others come through, whatever they are called.

    Keys are compared by two 64-bit hashes of their bytes. A key in a third of all documents is
    pre-aggregated before the shuffle, and its line rows are salted over 32 partitions, which the
    adaptive skew join splits further where they are large.
    """
    salts = 32
    of, at, lost_at = unused(docs, "of", "at", "lost")
    rest = [c for c in docs.columns if c.lower() not in {"n_lines", "n_dropped"}]
    version = F.xxhash64(F.col(text_col))
    exploded = (
        docs.select(F.col(id_col).alias("id"), version.alias("v"), F.posexplode(text_lines(ascii_lower(F.col(text_col)))).alias("pos", "line"))
        .select("id", "v", "pos", F.btrim("line", F.lit(BLANKS)).alias("key"))
        .where(F.char_length("key") >= min_chars)
        .select("id", "v", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )
    lines = written(exploded, "line-hashes")
    common = (
        lines.select("h1", "h2", "id")
        .distinct()
        .groupBy("h1", "h2")
        .count()
        .where(F.col("count") >= min_docs)
        .select("h1", "h2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    lost = (
        lines.withColumn("salt", F.pmod(F.xxhash64("id", "pos"), F.lit(salts)).cast("int"))
        .join(common, ["h1", "h2", "salt"], "left_semi")
        .groupBy(F.col("id").alias(of), F.col("v").alias(at))
        .agg(F.collect_set("pos").alias(lost_at))
    )
    joined = docs.join(lost, F.col(id_col).eqNullSafe(F.col(of)) & (version == F.col(at)), "left")
    own = text_lines(F.col(text_col))

    def without(lines: Column) -> Column:
        left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost_at)
        return F.transform(left, lambda i: F.get(lines, i))

    kept = F.when(F.col(lost_at).isNull(), own).otherwise(once(own, without))
    cells = [F.array_join(kept, "\n").alias(c) if c == text_col else F.col(f"`{c}`") for c in rest]
    dropped = F.when(F.col(lost_at).isNull(), 0).otherwise(F.size(lost_at)).cast("long")
    return joined.select(*cells, F.size(own).cast("long").alias("n_lines"), dropped.alias("n_dropped"))


def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = dedup_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_sql() -> str:
    return f"""
WITH split AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM split),
common AS (
  SELECT key FROM keyed WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS})
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (key IN (SELECT key FROM common)) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (key NOT IN (SELECT key FROM common)), '')) AS kept_sha256
FROM keyed GROUP BY doc_id
"""
