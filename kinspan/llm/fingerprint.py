"""One-permutation MinHash fingerprints, by DataFrame functions only.

Every shingle of five words is hashed once; the top bits of the hash name one of
BINS bins, and a bin keeps its least hash. An empty bin takes over the value of
another bin: each bin has a random order of its own over all bins and takes the
first one that is not empty (optimal densification), so that two texts whose bins
are filled alike borrow alike. Of each value the low BITS bits are stored. Two
fingerprints agree in a bin with the probability J + (1 - J) / 2**BITS, from which
the likeness J is estimated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import n_partitions, range_bounds, range_bucket, read_table
from .words import SHINGLE_WORDS

BINS_LOG2 = 7
BINS = 1 << BINS_LOG2
#: White space, in the whole of Unicode.
SPACES = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
BITS = 8
_VALUE_BITS = 63 - BINS_LOG2


def _bin(value: Column) -> Column:
    return F.shiftright(value, _VALUE_BITS).cast("int")


def with_fingerprint(df: DataFrame, text: Column, name: str) -> DataFrame:
    """``df`` and a column of BINS * BITS / 4 hexadecimal digits.

    Words are runs without white space. A text of fewer than five words has one
    shingle of all of them; a text without words has the fingerprint of zeros,
    which no other text is given on purpose.
    """
    words, hashes, least = f"{name}_words", f"{name}_hashes", f"{name}_least"
    df = df.withColumn(words, F.transform(F.filter(F.split(text, SPACES), lambda w: w != ""), lambda w: F.xxhash64(w)))
    n = F.size(words)
    rolled = F.transform(words, lambda w, i: F.shiftrightunsigned(F.xxhash64(w, *[F.get(words, i + k) for k in range(1, SHINGLE_WORDS)]), 1))
    whole = F.array(F.shiftrightunsigned(F.xxhash64(F.col(words)), 1))
    shingles = F.when(n >= SHINGLE_WORDS, F.slice(rolled, 1, F.greatest(n - (SHINGLE_WORDS - 1), F.lit(0)))).when(n > 0, whole)
    df = df.withColumn(hashes, F.sort_array(F.coalesce(shingles, F.array().cast("array<bigint>"))))
    first = F.filter(hashes, lambda h, i: (i == 0) | (_bin(h) != _bin(F.get(hashes, i - 1))))
    df = df.withColumn(least, first)
    m = F.size(least)
    nothing = F.lit(None).cast("bigint")
    # The kept values with a null for each empty bin between them.
    spread = F.flatten(F.transform(least, lambda v, i: F.concat(F.array_repeat(nothing, _bin(v) - F.coalesce(_bin(F.get(least, i - 1)), F.lit(-1)) - 1), F.array(v))))
    spread = F.concat(spread, F.array_repeat(nothing, BINS - 1 - F.coalesce(_bin(F.get(least, m - 1)), F.lit(-1))))
    low = (1 << BITS) - 1

    def borrowed(i: Column) -> Column:
        rank = F.transform(least, lambda v: F.shiftrightunsigned(F.xxhash64(i, _bin(v)), 1).bitwiseAND(F.lit(~low)).bitwiseOR(v.bitwiseAND(F.lit(low))))
        return F.coalesce(F.array_min(rank).bitwiseAND(F.lit(low)), F.lit(0))

    bits = F.transform(spread, lambda v, i: F.when(v.isNotNull(), v.bitwiseAND(F.lit(low))).otherwise(borrowed(i)))
    packed = F.array_join(F.transform(bits, lambda v: F.lpad(F.hex(v), BITS // 4, "0")), "")
    return df.withColumn(name, packed).drop(words, hashes, least)


def likeness(one: Column, two: Column) -> Column:
    """Estimated Jaccard index of two fingerprints, 0 to 1."""
    digits = BITS // 4
    alike = F.aggregate(F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(0), lambda acc, i: acc + F.when(F.substring(one, i * digits + 1, F.lit(digits)) == F.substring(two, i * digits + 1, F.lit(digits)), 1).otherwise(0))
    chance = 2.0**-BITS
    return F.greatest(F.lit(0.0), (alike / BINS - chance) / (1 - chance))


def in_descending_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, shard, ghost) dealt into ranges of doc_id, each with the row
    that follows its last one as a ghost; null text is empty.

    Ranges end at ids that occur, so that the row that a range lacks is the one
    with the end of the range below; the lowest range is followed by the highest id.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = rows.where("doc_id is not null")
    bounds = range_bounds(ids, "doc_id", 4 * n_partitions(spark))
    top = ids.agg(F.max("doc_id")).first()[0]
    ends = sorted({*bounds, top} - {None})
    if not ends:
        return rows.select("doc_id", "text", F.lit(0).alias("shard"), F.lit(False).alias("ghost"))
    shard = F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(range_bucket(F.col("doc_id"), ends[:-1]))
    own = F.struct(F.col("own").alias("shard"), F.lit(False).alias("ghost"))
    other = F.struct(((F.col("own") + 1) % len(ends)).cast("int").alias("shard"), F.lit(True).alias("ghost"))
    at_end = F.col("doc_id") == F.get(F.array(*[F.lit(e) for e in ends]), F.col("own"))
    rows = rows.withColumn("own", shard.cast("int"))
    rows = rows.withColumn("copy", F.explode(F.when(F.coalesce(at_end, F.lit(False)), F.array(own, other)).otherwise(F.array(own))))
    return rows.select("doc_id", "text", "copy.*")


def op3_oph_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per row of documents: its fingerprint, that of its edited text, and likenesses.

    Rows without doc_id come after the lowest id; rows that repeat an id are in
    order of their texts. A table of one row follows itself.
    """
    rows = in_descending_order(read_table(spark, sf_dir, "documents"))
    rows = rows.repartition(n_partitions(spark), "shard")
    rows = with_fingerprint(rows, F.col("text"), "fingerprint")
    follows = Window.partitionBy("shard").orderBy("ghost", F.desc_nulls_last("doc_id"), "text")
    rows = rows.withColumns({"next_text": F.lead("text").over(follows), "next_fingerprint": F.lead("fingerprint").over(follows)}).where("not ghost")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half)))
    rows = with_fingerprint(rows.drop("next_text"), F.col("edited"), "edited_fingerprint")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.coalesce("next_fingerprint", "fingerprint")).alias("near_next"),
    )
