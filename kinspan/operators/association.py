"""Counts, windows and tables behind association tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import islands, overlap_join, sweep


def weighted_bins(found: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Events spread over fixed windows, each with the share of its length that lies there."""
    s, e = F.col("start_pos"), F.col("end_pos")
    spread = found.where(e > s).withColumn("bin", F.explode(F.sequence(F.floor(s / width), F.ceil(e / width) - 1)))
    share = (F.least(e, (F.col("bin") + 1) * width) - F.greatest(s, F.col("bin") * width)) / (e - s)
    return spread.groupBy(*keys, "bin").agg(F.round(F.sum(share), 6).alias("weight"), F.count("*").alias("n_events"))


def tile_consensus(segments: DataFrame, keys: list[str], code: str, width: int, share: float = 0.9) -> DataFrame:
    """Elementary intervals and what the entities there agree on: 1, 0 or -1.

    ``code`` is 1, 0 or null for each segment; a value needs the given share of all
    entities with a segment there.
    """
    value = F.col(code)
    counts = sweep(segments, keys, {"n": F.lit(1), "n_0": F.coalesce((value == 0).cast("int"), F.lit(0)), "n_1": F.coalesce((value == 1).cast("int"), F.lit(0))}, width).where("n > 0")
    return counts.withColumn("consensus", F.when(F.col("n_1") >= share * F.col("n"), 1).when(F.col("n_0") >= share * F.col("n"), 0).otherwise(-1))


def margins(df: DataFrame, sets: list[list[str]], count: str = "n") -> DataFrame:
    """Counts over several grouping sets in one pass; a column that a set leaves out is null."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(F.count("*").alias(count))


def robust_outliers(df: DataFrame, value: str, by: list[str], cutoff: float = 3.5) -> DataFrame:
    """Rows whose 0.6745 |x - median| / MAD is above ``cutoff`` within their group."""
    centre = df.groupBy(*by).agg(F.median(value).alias("median"))
    away = df.join(centre, by).withColumn("deviation", F.abs(F.col(value) - F.col("median")))
    spread = away.groupBy(*by).agg(F.median("deviation").alias("mad"))
    scored = away.join(spread, by).withColumn("score", F.round(F.try_divide(0.6745 * F.col("deviation"), F.col("mad")), 6))
    return scored.where(F.col("score") > cutoff)


def histogram(df: DataFrame, value: Column, low: float, high: float, n: int) -> DataFrame:
    """Counts in n equal bins of [low, high]; the last one holds ``high`` too."""
    number = F.when(value == high, n - 1).otherwise(F.floor((value - low) / ((high - low) / n))).cast("int")
    return df.where(value.between(low, high)).groupBy(number.alias("bin")).agg(F.count("*").alias("n"))


def moving_average(df: DataFrame, value: str, keys: list[str], order: list[str], half: int) -> DataFrame:
    """Centred sum over 2 half + 1 rows by that number: rows beyond the ends count as 0."""
    frame = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-half, half)
    return df.withColumn("average", F.sum(value).over(frame) / (2 * half + 1))


def fill_unknown(df: DataFrame, value: str, keys: list[str], order: list[str]) -> DataFrame:
    """Null runs take the value of both flanks where these are equal; at the ends they are 0."""
    over = Window.partitionBy(*keys).orderBy(*order)
    before = F.last(value, ignorenulls=True).over(over.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(value, ignorenulls=True).over(over.rowsBetween(0, Window.unboundedFollowing))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(before.isNull() | after.isNull(), 0).when(before == after, before)
    return df.withColumn("filled", filled)


def flagged_regions(df: DataFrame, flag: Column, keys: list[str], order: list[str]) -> DataFrame:
    """Runs of flagged rows as intervals."""
    over = Window.partitionBy(*keys).orderBy(*order)
    marked = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    runs = islands(marked.withColumn("_changed", F.col("_flag") != F.lag("_flag").over(over)), keys, order, F.col("_changed"), "_run").where("_flag")
    return runs.groupBy(*keys, "_run").agg(F.min("start_pos").alias("start_pos"), F.max("end_pos").alias("end_pos"), F.count("*").alias("n_rows")).drop("_run")


def distinct_tests(df: DataFrame, values: list[str], keys: list[str], order: list[str]) -> DataFrame:
    """How often the row of values differs from the one before: the number of different tests."""
    now = F.struct(*values)
    changed = ~now.eqNullSafe(F.lag(now).over(Window.partitionBy(*keys).orderBy(*order)))
    return df.select(*keys, changed.alias("_c")).groupBy(*keys).agg(F.count_if("_c").alias("n_tests"))


def covered_share(intervals: DataFrame, pieces: DataFrame, keys: list[str], width: int) -> DataFrame:
    """Bases of each interval (iv_id) that disjoint ``pieces`` cover, 0 where none does."""
    common = F.least("end_pos", "r_end_pos") - F.greatest("start_pos", "r_start_pos")
    sums = overlap_join(intervals, pieces, keys, width).groupBy("iv_id").agg(F.sum(common).alias("covered"))
    return intervals.join(sums, "iv_id", "left").na.fill(0, ["covered"]).withColumn("share", F.round(F.col("covered") / (F.col("end_pos") - F.col("start_pos")), 6))
