"""Which rows, families and pairs an analysis keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import running
from .ibd import normalised_pair


def standard_families(segments: DataFrame) -> DataFrame:
    """Families all of whose segments have four deletion tracks (one couple)."""
    return segments.groupBy("family").agg(F.every(F.size("dels") == 4).alias("_standard"), F.count("*").alias("n_segments")).where("_standard").drop("_standard")


def fully_phased(segments: DataFrame, owner: str, n_chroms: int) -> DataFrame:
    """Owners and whether as many different chromosomes of theirs are phased as asked for."""
    return segments.groupBy(owner).agg(F.count_distinct("chrom").alias("n_chroms")).withColumn("is_fully_phased", F.col("n_chroms") == n_chroms)


def sound_pairs(pairs: DataFrame) -> DataFrame:
    """Sibling pairs that are fully phased and outliers in neither identity nor crossovers."""
    return pairs.where("is_fully_phased and not is_ibd_outlier and not is_crossover_outlier")


def of_pairs(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """Events (child1, child2) of the given pairs (sibling1, sibling2), in either order."""
    low, high = normalised_pair(F.col("child1"), F.col("child2"))
    known = pairs.select(F.col("sibling1").alias("_low"), F.col("sibling2").alias("_high")).distinct()
    return events.withColumns({"_low": low, "_high": high}).join(known, ["_low", "_high"], "left_semi").drop("_low", "_high")


def masked_upd(segments: DataFrame) -> DataFrame:
    """Phases as null where the slot of one parent holds the other one's chromosome
    (maternal codes are 0 and 1, paternal ones 2 and 3)."""
    own = {"mat": F.when(F.col("mat").isin(0, 1), F.col("mat")), "pat": F.when(F.col("pat").isin(2, 3), F.col("pat"))}
    return segments.withColumns(own)


def sound_deletions(deletions: DataFrame, family_sizes: DataFrame, least_length: int, sizes: list[int]) -> DataFrame:
    """Deletions of a least length, not in hard regions, of families of the given sizes."""
    wanted = family_sizes.where(F.col("n_members").isin(*sizes)).select("family")
    return deletions.where((F.col("end_pos") - F.col("start_pos") >= least_length) & ~F.col("is_hts")).join(wanted, "family", "left_semi")


def rare_sites(sites: DataFrame, low: float, high: float, keep_unknown: bool) -> DataFrame:
    """Sites with an allele frequency above ``low`` and at most ``high``; those without one
    stay if asked."""
    rare = (F.col("af") > low) & (F.col("af") <= high)
    return sites.where(rare | F.col("af").isNull() if keep_unknown else rare)


def in_one_family(members: DataFrame) -> DataFrame:
    """Members (family, individual) that belong to one family only."""
    n = F.count("*").over(Window.partitionBy("individual"))
    return members.select("family", "individual").distinct().withColumn("_n", n).where("_n = 1").drop("_n")


def well_called(genotypes: DataFrame, by: list[str], most_missing: float) -> DataFrame:
    """Groups of which at most a share of calls is missing, with that share."""
    counts = genotypes.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("gt") == -1).alias("n_missing"))
    return counts.where(F.col("n_missing") <= most_missing * F.col("n")).withColumn("missing_share", F.round(F.col("n_missing") / F.col("n"), 6))


def without_listed(pairs: DataFrame, listed: DataFrame) -> DataFrame:
    """Pairs (sibling1, sibling2) but those of a list, such as identical twins, in either order."""
    low, high = normalised_pair(F.col("sibling1"), F.col("sibling2"))
    return pairs.join(listed.select(low.alias("sibling1"), high.alias("sibling2")).distinct(), ["sibling1", "sibling2"], "left_anti")


def without_massive(events: DataFrame, owner: str, longest: int, most: int) -> DataFrame:
    """Events shorter than ``longest`` of owners with fewer than ``most`` events in all."""
    counts = events.groupBy(owner).agg(F.count("*").alias("_n")).where(F.col("_n") < most).select(owner)
    return events.where(F.col("end_pos") - F.col("start_pos") < longest).join(counts, owner, "left_semi")


def single_contributors(deletions: DataFrame, by: list[str]) -> DataFrame:
    """Deletions that are the only one of their group (collection and family)."""
    return deletions.withColumn("_n", F.count("*").over(Window.partitionBy(*by))).where("_n = 1").drop("_n")


def listed_sites(sites: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sites (chrom, pos) that are wanted, and the wanted ones that there are no sites for."""
    keys = ["chrom", "pos"]
    return sites.join(wanted.select(*keys).distinct(), keys, "left_semi"), wanted.select(*keys).distinct().join(sites, keys, "left_anti")


def without_samples(genotypes: DataFrame, samples: DataFrame) -> DataFrame:
    """Genotypes but those of given samples (as if these people had not been sequenced)."""
    return genotypes.join(samples.select("sample").distinct(), "sample", "left_anti")


def family_batches(families: DataFrame, size: int, width: int = 1 << 20) -> DataFrame:
    """Families (whole numbers) in order, ``size`` to a batch, without one task seeing all."""
    ranked = running(families.select("family").distinct().withColumns({"_n": F.lit(1), "_axis": F.lit(0)}), ["_axis"], "family", ["_n"], width)
    return ranked.select("family", F.floor(F.col("_n_before") / size).alias("batch"))


def mapped_ids(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """``rows`` with ids as a map (old, new) spells them, either with dots or underscores;
    rows without an entry are left out."""
    spelled = ids.select(F.translate("old", ".", "_").alias("_old"), F.col("new").alias("_new")).dropDuplicates(["_old"])
    return rows.join(spelled, F.translate(F.col(column).cast("string"), ".", "_") == F.col("_old")).withColumn(column, F.col("_new")).drop("_old", "_new")


def lifted(sites: DataFrame, exchange: DataFrame, order: list[str]) -> DataFrame:
    """Sites at the positions that an exchange table (rec, new_chrom, new_pos) gives them;
    without those that it lacks, and of those that fall on one position the first."""
    moved = sites.drop("chrom", "pos").join(exchange.select("rec", F.col("new_chrom").alias("chrom"), F.col("new_pos").alias("pos")), "rec")
    first = F.row_number().over(Window.partitionBy("chrom", "pos").orderBy(*order))
    return moved.withColumn("_n", first).where("_n = 1").drop("_n")


def peak(df: DataFrame, by: list[str], value: Column, carried: str) -> DataFrame:
    """The largest value of each group and ``carried`` of its row, of equal ones the least."""
    best = F.max(F.struct(value.alias("peak"), (-F.col(carried)).alias("_c")))
    return df.groupBy(*by).agg(best.alias("_b")).select(*by, F.col("_b.peak").alias("peak"), (-F.col("_b._c")).alias(carried))
