"""Gap-based grouping of recombinations on a stream, as session windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_sessions(recombinations: DataFrame, gap: str, delay: str, keys: list[str]) -> DataFrame:
    """Recombinations (keys, ts) of one key less than ``gap`` apart as one event, emitted
    once the watermark passes it; even numbers are gene conversions.

    Works on batch tables too, where it gives the same rows. A session window ends where
    the gap is reached; for ``operators.recombination.events``, whose bound is included,
    a gap one unit longer says the same.
    """
    session = F.session_window("ts", gap)
    grouped = recombinations.withWatermark("ts", delay).groupBy(*keys, session.alias("session")).agg(F.count("*").alias("n_recombinations"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return grouped.select(*keys, "first_ts", "last_ts", "n_recombinations", (F.col("n_recombinations") % 2 == 0).alias("is_gene_conversion"))
