"""Document fingerprints: one-permutation MinHash, all in DataFrame functions.

Every five-word shingle of a text gets one 64-bit hash. Its top bits name a bin and each bin keeps
its smallest hash. An empty bin copies the bin that comes first in a random order of its own over
all bins (optimal densification: the choice is uniform among the filled ones, and the same for all
documents). Of each bin's hash the low bits are stored, packed as hex digits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from risekit.llm.common import ascii_lower

BINS = 128
#: Low-order bits kept of each bin's hash, in two hex digits.
BITS = 8
WORDS = 5
#: Rows of one range of documents when each is put beside the next.
ROWS_PER_RANGE = 2000


def shingle_hashes(text: Column) -> Column:
    """Hashes of the text's five-word shingles; of a shorter one, of its whole sequence; of none, empty."""
    words = F.filter(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[ \t-\r]+"), lambda w: w != "")
    return F.transform(F.array(F.transform(words, lambda w: F.xxhash64(w))), _shingles)[0]


def _shingles(h: Column) -> Column:
    """h as a lambda's variable is computed once per row, not once per use."""
    n = F.size(h)
    long = F.transform(F.slice(h, 1, F.greatest(n - (WORDS - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, WORDS)]))
    short = F.array(F.aggregate(h, F.lit(42).cast("long"), lambda acc, x: F.xxhash64(acc, x)))
    return F.when(n >= WORDS, long).when(n > 0, short).otherwise(F.array().cast("array<long>"))


def minhash(hashes: Column, bins: int = BINS) -> Column:
    """One value per bin, all bins filled; null for no hashes."""
    shift = 64 - (bins - 1).bit_length()

    def bin_of(h: Column) -> Column:
        return F.shiftrightunsigned(h, shift)

    def of_sorted(s: Column) -> Column:
        return F.filter(s, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(s, i - 1))))

    def of_least(least: Column) -> Column:
        def of_bins(own: Column) -> Column:
            def value(b: Column) -> Column:
                at = F.array_position(own, b)
                order = F.transform(own, lambda o, k: F.shiftleft(F.shiftright(F.xxhash64(b, o), 10), 10) + k)
                donor = F.array_min(order).bitwiseAND(F.lit(1023))
                return F.get(least, F.when(at > 0, at - 1).otherwise(donor).cast("int"))

            return F.transform(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long")), value)

        return F.transform(F.array(F.transform(least, bin_of)), of_bins)[0]

    least = F.transform(F.array(F.sort_array(hashes)), of_sorted)
    return F.when(F.size(hashes) > 0, F.transform(least, of_least)[0])


def pack(values: Column, bits: int = BITS) -> Column:
    """The low bits of each value as hex digits, a fixed number for each bin; empty for null."""
    digits = -(-bits // 4)
    cells = F.transform(values, lambda v: F.lpad(F.lower(F.hex(v.bitwiseAND(F.lit((1 << bits) - 1)))), digits, "0"))
    return F.coalesce(F.array_join(cells, ""), F.lit(""))


def fingerprint(text: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """The packed fingerprint of a text; the empty string for a text without words or null."""
    return pack(minhash(shingle_hashes(text), bins), bits)


def likeness(a: Column, b: Column, bins: int = BINS, bits: int = BITS) -> Column:
    """Estimated Jaccard similarity of two fingerprints, from 0 to 1.

    Bins with equal low bits are counted; as unequal hashes share them by chance 2**-bits of the
    time, that part is taken off. Two empty fingerprints are alike, an empty and another are not.
    """
    digits = -(-bits // 4)
    same = F.size(F.filter(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.substring(a, i * digits + 1, F.lit(digits)) == F.substring(b, i * digits + 1, F.lit(digits))))
    chance = 2.0**-bits
    corrected = F.greatest(F.lit(0.0), (same / F.lit(float(bins)) - chance) / (1 - chance))
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(corrected)


def beside_next(docs: DataFrame, id_col: str, columns: list[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Each row with next_<c> of the row that follows in descending id, after the last the first.

    Ids are cut into ranges at their quantiles. The first row of each range is also sent to the
    range that comes before, where it serves as the next of the last row, so rows cross the network
    once and no task sees more than its range. Rows that repeat an id follow each other in the
    order of their columns; null ids come last.
    """
    spark = docs.sparkSession
    n = docs.count()
    ranges = max(1, min(10_000, n // rows_per_range))
    cuts = docs.stat.approxQuantile(id_col, [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    cuts = sorted({int(c) for c in cuts})
    bounds = F.array(*[F.lit(c) for c in cuts]).cast("array<long>")
    # range 0 holds the largest ids
    own = F.when(F.col(id_col).isNull(), len(cuts)).otherwise(F.size(F.filter(bounds, lambda c: c >= F.col(id_col))))
    placed = docs.withColumn("__range", own.cast("int"))
    top = F.max(F.struct(F.col(id_col).isNotNull().alias("given"), F.col(id_col).alias("id")))
    heads = {r["__range"]: r["top"]["id"] for r in placed.groupBy("__range").agg(top.alias("top")).collect()}  # a row per range
    used = sorted(heads)
    previous = [(r, heads[r], used[i - 1]) for i, r in enumerate(used)]
    guests = spark.createDataFrame(previous, "r int, head long, to int") if used else spark.createDataFrame([], "r int, head long, to int")
    joined = placed.join(F.broadcast(guests), (F.col("__range") == F.col("r")) & F.col(id_col).eqNullSafe(F.col("head")), "left")
    homes = F.when(F.col("to").isNull(), F.array(F.struct(F.col("__range").alias("at"), F.lit(0).alias("guest")))).otherwise(
        F.array(F.struct(F.col("__range").alias("at"), F.lit(0).alias("guest")), F.struct(F.col("to").alias("at"), F.lit(1).alias("guest")))
    )
    dealt = joined.withColumn("__home", F.explode(homes)).select(*docs.columns, F.col("__home.at").alias("__at"), F.col("__home.guest").alias("__guest"))
    order = Window.partitionBy("__at").orderBy("__guest", F.col(id_col).desc_nulls_last(), *columns)
    cells = [F.lead(c).over(order).alias(f"next_{c}") for c in columns]
    return dealt.select(*docs.columns, "__guest", *cells).where("__guest = 0").drop("__guest")


def fingerprint_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text, of its edited text, and their likeness (see op8).

    Ids are whole numbers (others raise an error) and meant to be nearly unique, as rows that repeat
    one meet in one task. Only the id and the text are read, whatever other columns docs has. No
    rows: no rows.
    """
    if not isinstance(docs.schema[id_col].dataType, T.IntegralType):
        raise TypeError(f"{id_col} must be of a whole number type to be put in order by ranges")
    base = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    own = base.withColumn("fingerprint", fingerprint(F.col("text")))
    both = beside_next(own, "doc_id", ["text", "fingerprint"])
    n = F.char_length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - cut), F.substring("next_text", F.lit(1), cut))
    return both.select(
        "doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "next_fingerprint"
    ).withColumn("edited_fingerprint", fingerprint(F.col("edited")))


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = fingerprint_pairs(docs)
    return out.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
