"""The corpus pipeline: five stages from raw documents to token ids.

Each stage is written as Parquet in the shared folder and read again as the next one's documents.
All but the last return the columns of documents, whatever they are called; n_chars follows a text
that a stage changes. A null text counts as an empty one. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from risekit.llm import bpe, decontaminate, jaccard, line_dedup, toxicity
from risekit.llm.common import table, written

#: No single SQL statement expresses a trained classifier or merges by rank.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, document): all other columns in one, so that none clashes with a column that an operator adds."""
    return docs.select("doc_id", "text", F.struct(F.lit(0).alias("first"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")]).alias("document"))


def _unpacked(packed: DataFrame, like: DataFrame, changed: bool = False) -> DataFrame:
    """packed in the columns of like; where texts have changed, n_chars (if there is such a column) is taken from them."""
    cells = {c: F.col(c if c in ("doc_id", "text") else f"document.c{i}").alias(c) for i, c in enumerate(like.columns)}
    if changed and "n_chars" in cells:
        cells["n_chars"] = F.coalesce(F.char_length("text"), F.lit(0)).cast(like.schema["n_chars"].dataType).alias("n_chars")
    return packed.select(*cells.values())


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go; it learns from the labels of rows not held out."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return _unpacked(toxicity.score(_packed(docs), model).where("predicted = 0"), docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that at least ten documents share go; documents stay, a text may become empty."""
    return _unpacked(line_dedup.dedup_lines(_packed(docs)), docs, changed=True)


def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles at a similarity of 0.8 or more the smallest id stays.

    One document of each group stays: of rows that repeat the kept id one text, of rows that repeat
    both one row. A null id stays where its group has no other. Documents without words are in no
    group and all stay.
    """
    rows = jaccard.classes(docs, n=5, percent=80)
    counted = rows.where("class IS NOT NULL").groupBy("class", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    first = counted.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash", "n")).alias("row"))
    leaders = first.select(F.col("row.doc_id").alias("kept"), F.col("row.text_hash").alias("hash"), (F.col("row.n") > 1).alias("repeated"))
    wordless = rows.where("class IS NULL").select("doc_id", "text_hash", F.lit(False)).distinct()
    stay = _packed(docs).join(leaders.union(wordless), F.col("doc_id").eqNullSafe(F.col("kept")) & (F.xxhash64("text") == F.col("hash")))
    once, again = stay.where("NOT repeated"), stay.where("repeated").dropDuplicates(["doc_id", "text"])
    return _unpacked(once.union(again), docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; documents stay, a text may become empty."""
    cut = decontaminate.contaminated(_packed(docs), table(spark, sf_dir, "benchmark"), cut=True)
    return _unpacked(cut, docs, changed=True)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, ids (packed), n_tokens and the text that they decode to."""
    keep = ["doc_id", "lang", "source"]
    return bpe.encode(docs, bpe.vocabulary_path(), keep=keep, decoded=True)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("BPE", bpe_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), "stage-" + name.lower().replace(" ", "-"))
    return docs
