"""Identity by descent of sibling pairs, and pairs themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIDES = ("maternal", "paternal", "matxpat")


def sibling_pairs(children: DataFrame) -> DataFrame:
    """Unordered pairs of the children (family, individual) of a family."""
    one = children.select("family", F.col("individual").alias("sibling1"))
    two = children.select("family", F.col("individual").alias("sibling2"))
    return one.join(two, "family").where("sibling1 < sibling2")


def normalised_pair(a: Column, b: Column) -> tuple[Column, Column]:
    return F.least(a, b), F.greatest(a, b)


def match_codes(mat1: Column, mat2: Column, pat1: Column, pat2: Column) -> dict[str, Column]:
    """True, false or null (a phase is unknown) for each side; both sides together
    are unknown if either is."""
    mat, pat = mat1 == mat2, pat1 == pat2
    return {"maternal": mat, "paternal": pat, "matxpat": F.when(mat.isNotNull() & pat.isNotNull(), mat & pat)}


def ibd(segments: DataFrame, by: list[str]) -> DataFrame:
    """Bases that match, differ or are unknown for each side, and their shares.

    ``segments`` has start_pos, end_pos, mat_1, mat_2, pat_1, pat_2 (null: unknown).
    ibd is match / (match + mismatch), null without known bases.
    """
    length = F.col("end_pos") - F.col("start_pos")
    sums = []
    for side, code in match_codes(*(F.col(c) for c in ("mat_1", "mat_2", "pat_1", "pat_2"))).items():
        sums += [F.sum(F.when(code, length).otherwise(0)).alias(f"{side}_match"), F.sum(F.when(~code, length).otherwise(0)).alias(f"{side}_mismatch"), F.sum(F.when(code.isNull(), length).otherwise(0)).alias(f"{side}_unknown")]
    totals = segments.groupBy(*by).agg(*sums)
    shares = []
    for side in SIDES:
        match, mismatch, unknown = (F.col(f"{side}_{k}") for k in ("match", "mismatch", "unknown"))
        shares += [F.round(F.try_divide(match, match + mismatch), 6).alias(f"{side}_ibd"), F.round(F.try_divide(unknown, match + mismatch + unknown), 6).alias(f"{side}_unknown_fraction")]
    return totals.select("*", *shares)


def by_chromosome_arrays(per_chrom: DataFrame, by: list[str], chroms: list[str], value: str) -> DataFrame:
    """An array with the value of each chromosome in the given order, null where missing."""
    maps = per_chrom.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("chrom", value))).alias("_m"))
    return maps.select(*by, F.array(*[F.col("_m")[c] for c in chroms]).alias(f"{value}_chroms"))


def identical(maternal: Column, paternal: Column) -> Column:
    return (maternal > 0.8) & (paternal > 0.8)


def region_weighted(segments: DataFrame, pieces: DataFrame, keys: list[str]) -> DataFrame:
    """``segments`` cut to the parts that lie in ``pieces`` (an overlap join's result)."""
    start, end = F.greatest("start_pos", "r_start_pos"), F.least("end_pos", "r_end_pos")
    return pieces.withColumns({"_s": start, "_e": end}).drop("start_pos", "end_pos").withColumnsRenamed({"_s": "start_pos", "_e": "end_pos"}).select(*keys, "start_pos", "end_pos", *[c for c in segments.columns if c not in {*keys, "start_pos", "end_pos"}])
