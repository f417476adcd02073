"""Order-dependent selections, run within groups that cannot touch one another."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import with_union
from ..sources.stores import settled


def each_member_once(pairs: DataFrame) -> DataFrame:
    """Pairs of a family taken in order as long as neither sibling was taken before.

    ``pairs`` has family, sibling1, sibling2 and priority (lower first); a family is
    one group.
    """

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        taken: set = set()
        keep = []
        for row in group.sort_values(["priority", "sibling1", "sibling2"]).itertuples():
            if row.sibling1 not in taken and row.sibling2 not in taken:
                taken |= {row.sibling1, row.sibling2}
                keep.append(row.Index)
        return group.loc[keep]

    return pairs.groupBy("family").applyInPandas(pick, pairs.schema)


def first_fit_clusters(intervals: DataFrame, keys: list[str], share: float = 0.5) -> DataFrame:
    """(iv_id, cluster): each interval, in order of start and end, joins the first cluster
    whose first member it overlaps by ``share`` of both lengths, or begins one.

    Equal intervals are one; clusters are named by the least iv_id of their first ones.
    Intervals that are in no common union cannot meet, so that unions are dealt over tasks.
    Within one, intervals pass in order of start as a stream, and only first members that
    reach beyond the current start are held: those differ in length by half or more where
    they overlap, so that they are few.
    """
    different = intervals.groupBy(*keys, "start_pos", "end_pos").agg(F.min("iv_id").alias("name"))
    types = dict(different.dtypes)
    united = with_union(different, keys)
    dealt = united.repartition(*keys, "union_start").sortWithinPartitions(*keys, "union_start", "start_pos", "end_pos")
    schema = ", ".join(f"{c} {types[c]}" for c in [*keys, "start_pos", "end_pos"]) + ", cluster long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        axis, heads = None, []
        for batch in batches:
            names = []
            for row in batch.itertuples(index=False):
                here = (*(getattr(row, k) for k in keys), row.union_start)
                heads = [h for h in heads if h[1] > row.start_pos] if here == axis else []
                axis = here
                for start, end, name in heads:
                    common = min(row.end_pos, end) - max(row.start_pos, start)
                    if common >= share * (row.end_pos - row.start_pos) and common >= share * (end - start):
                        names.append(name)
                        break
                else:
                    heads.append((row.start_pos, row.end_pos, row.name))
                    names.append(row.name)
            yield batch[[*keys, "start_pos", "end_pos"]].assign(cluster=names)

    found = dealt.mapInPandas(run, schema)
    return intervals.select(*keys, "start_pos", "end_pos", "iv_id").join(found, [*keys, "start_pos", "end_pos"]).select("iv_id", "cluster")


def widened_mask(segments: DataFrame, keys: list[str], mask, by: int) -> DataFrame:
    """Parts of masked segments' intervals, each widened by ``by`` on both sides and merged."""
    from ..functions.intervals import merge_overlaps

    wide = segments.where(mask).select(*keys, F.greatest(F.col("start_pos") - by, F.lit(0)).alias("start_pos"), (F.col("end_pos") + by).alias("end_pos"))
    return merge_overlaps(wide, keys)


def similar_collections(members: DataFrame, share: float = 0.8) -> DataFrame:
    """(one, two): pairs of collections of which one holds the other's deletion, and whose
    common members are at least ``share`` of either.

    ``members`` has collection and member, of the same ids. Sizes that differ by more than
    the share are out at once. Members are ranked by how many collections hold them, rare
    ones first: two similar collections share one of the first few of each (as many as may
    be missing, and one), so that only such pairs have all their members compared. Members
    are compared as rows; no collection is gathered into one.
    """
    rows = settled(members.select("collection", "member").distinct().where("collection is not null and member is not null"), "members")
    sizes = rows.groupBy("collection").agg(F.count("*").alias("n"))
    spread = rows.groupBy("member").agg(F.count("*").alias("_spread"))
    order = Window.partitionBy("collection").orderBy("_spread", "member")
    ranked = rows.join(spread, "member").join(sizes, "collection").withColumn("_rank", F.row_number().over(order))
    heads = ranked.where(F.col("_rank") <= F.col("n") - F.ceil(share * F.col("n") - 1e-9) + 1).select("collection", "member")
    low, high = F.least("collection", "member"), F.greatest("collection", "member")
    pairs = rows.where("collection <> member").select(low.alias("one"), high.alias("two")).distinct()
    for side, n in (("one", "n_one"), ("two", "n_two")):
        pairs = pairs.join(sizes.select(F.col("collection").alias(side), F.col("n").alias(n)), side)
    pairs = pairs.where((F.col("n_one") >= share * F.col("n_two")) & (F.col("n_two") >= share * F.col("n_one")))

    def common(rows: DataFrame, pairs: DataFrame) -> DataFrame:
        """A row for each common member of each pair."""
        one = pairs.join(rows.withColumnRenamed("collection", "one"), "one")
        return one.join(rows.withColumnRenamed("collection", "two"), ["two", "member"])

    likely = pairs.join(common(heads, pairs).select("one", "two").distinct(), ["one", "two"], "left_semi")
    counted = common(rows, likely).groupBy("one", "two", "n_one", "n_two").agg(F.count("*").alias("n"))
    return counted.where((F.col("n") >= share * F.col("n_one")) & (F.col("n") >= share * F.col("n_two"))).select("one", "two")


def dedupe_collections(collections: DataFrame, pairs: DataFrame) -> DataFrame:
    """``collections`` (collection, weight) with is_kept: taken by falling weight (of equal
    ones the lower id first), a collection stays unless a similar one (``pairs``) stayed before.

    A round keeps all undecided collections none of whose undecided neighbours comes before
    them, and drops the neighbours of those; what comes out is what the loop gives. Rounds
    are as many as the longest chain of decisions that wait for one another.
    """
    weights = collections.select("collection", "weight")
    ends = pairs.join(weights.select(F.col("collection").alias("one"), F.col("weight").alias("w1")), "one").join(weights.select(F.col("collection").alias("two"), F.col("weight").alias("w2")), "two")
    first = (F.col("w1") > F.col("w2")) | ((F.col("w1") == F.col("w2")) & (F.col("one") < F.col("two")))
    return keep_first(collections, ends.select(F.when(first, F.col("one")).otherwise(F.col("two")).alias("before"), F.when(first, F.col("two")).otherwise(F.col("one")).alias("after")))


def keep_first(collections: DataFrame, edges: DataFrame) -> DataFrame:
    """``collections`` with is_kept, as ``dedupe_collections`` tells it, from (before, after) of
    the similar ones."""
    edges, dropped = settled(edges, "edges"), None
    while not edges.isEmpty():
        waiting = edges.select(F.col("after").alias("before")).distinct()
        kept = edges.select("before").distinct().join(waiting, "before", "left_anti")
        gone = settled(edges.join(kept, "before", "left_semi").select(F.col("after").alias("collection")).distinct(), "dropped")
        dropped = gone if dropped is None else dropped.unionByName(gone)
        # Edges of dropped ones bind nobody; those of kept ones have done their work.
        left = edges.join(gone.withColumnRenamed("collection", "after"), "after", "left_anti").join(gone.withColumnRenamed("collection", "before"), "before", "left_anti")
        edges = settled(left, "edges")
    if dropped is None:
        return collections.withColumn("is_kept", F.lit(True))
    marked = collections.join(dropped.withColumn("_gone", F.lit(True)), "collection", "left")
    return marked.withColumn("is_kept", F.col("_gone").isNull()).drop("_gone")
