"""Sites and genotypes: filters, frequencies, intervals and trios. Codes: 0, 1, 2; -1 missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SITE_KEYS = ["chrom", "pos"]


def usable_sites(sites: DataFrame, use_pass: bool = True) -> DataFrame:
    """SNPs (that pass, if asked) at positions with one record only."""
    alone = F.count("*").over(Window.partitionBy(*SITE_KEYS)) == 1
    kept = sites.withColumn("_alone", alone).where("_alone and is_snp").drop("_alone")
    return kept.where("is_pass") if use_pass else kept


def keep_first(sites: DataFrame, order: list[str], keys: list[str] = SITE_KEYS) -> DataFrame:
    """One record of each position, the first in ``order``."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return sites.withColumn("_n", first).where("_n = 1").drop("_n")


def class_counts(genotypes: DataFrame, by: list[str] = SITE_KEYS) -> DataFrame:
    gt = F.col("gt")
    return genotypes.groupBy(*by).agg(*[F.count_if(gt == k).alias(n) for k, n in ((0, "n_ref"), (1, "n_het"), (2, "n_hom"), (-1, "n_missing"))])


def allele_frequency(genotypes: DataFrame) -> DataFrame:
    """(het + 2 hom) / (2 called), 0 without calls."""
    called = F.col("n_ref") + F.col("n_het") + F.col("n_hom")
    return class_counts(genotypes).withColumn("af", F.round(F.coalesce(F.try_divide(F.col("n_het") + 2 * F.col("n_hom"), 2 * called), F.lit(0.0)), 6))


def hardy_weinberg(genotypes: DataFrame) -> DataFrame:
    """Expected class counts and the chi-square statistic, null where an expectation is 0.

    With a and b the alleles of both kinds among n calls, all three squared differences
    are those of 4 ref hom - het**2, so that chi2 = n (4 ref hom - het**2)**2 / (a b)**2:
    whole numbers up to the one division.
    """
    counts = class_counts(genotypes).withColumns({"_n": F.col("n_ref") + F.col("n_het") + F.col("n_hom"), "_a": 2 * F.col("n_ref") + F.col("n_het"), "_b": F.col("n_het") + 2 * F.col("n_hom")}).where("_n > 0")
    n, a, b = F.col("_n"), F.col("_a"), F.col("_b")
    away = 4 * F.col("n_ref") * F.col("n_hom") - F.col("n_het") * F.col("n_het")
    expected = {"e_ref": a * a / (4.0 * n), "e_het": a * b / (2.0 * n), "e_hom": b * b / (4.0 * n)}
    return counts.withColumns({**expected, "chi2": F.try_divide(n * (away * away).cast("double"), a * a * b * b)}).select(*SITE_KEYS, "n_ref", "n_het", "n_hom", *expected, "chi2")


def family_variant_sites(genotypes: DataFrame, families: DataFrame) -> DataFrame:
    """(family, chrom, pos) where a member has a variant; missing calls alone don't count."""
    return genotypes.where("gt > 0").join(families, "sample").select("family", *SITE_KEYS).distinct()


def interleave_gaps(sites: DataFrame, length: Column, keys: list[str]) -> DataFrame:
    """Positions as intervals [pos, pos + 1) and the gaps before, between and after them,
    which tile 1 .. length; empty gaps are left out."""
    over = Window.partitionBy(*keys).orderBy("pos")
    before = F.coalesce(F.lag("pos").over(over) + 1, F.lit(1))
    last = F.lead("pos").over(over).isNull()
    dealt = sites.select(*keys, "pos", before.alias("_before"), last.alias("_last"), length.alias("_length"))
    gap = F.struct(F.col("_before").alias("start_pos"), F.col("pos").alias("end_pos"), F.lit(0).alias("is_site"))
    site = F.struct(F.col("pos").alias("start_pos"), (F.col("pos") + 1).alias("end_pos"), F.lit(1).alias("is_site"))
    tail = F.struct((F.col("pos") + 1).alias("start_pos"), F.col("_length").alias("end_pos"), F.lit(0).alias("is_site"))
    parts = F.explode(F.when(F.col("_last"), F.array(gap, site, tail)).otherwise(F.array(gap, site)))
    return dealt.select(*keys, parts.alias("_p")).select(*keys, "_p.*").where("start_pos < end_pos")


def trio_calls(genotypes: DataFrame, trios: DataFrame) -> DataFrame:
    """Child, mother and father calls at the child's stored sites; an absent cell is 0."""
    child = genotypes.withColumnRenamed("gt", "child_gt")
    out = trios.join(child, trios.child == child["sample"]).drop("sample")
    for parent in ("mother", "father"):
        calls = genotypes.select(F.col("sample").alias(parent), *SITE_KEYS, F.col("gt").alias(f"{parent}_gt"))
        out = out.join(calls, [parent, *SITE_KEYS], "left").withColumn(f"{parent}_gt", F.coalesce(f"{parent}_gt", F.lit(0)))
    return out


def denovo_candidates(genotypes: DataFrame, trios: DataFrame) -> DataFrame:
    return trio_calls(genotypes, trios).where("child_gt = 1 and mother_gt = 0 and father_gt = 0").select("family", "child", *SITE_KEYS)


def transmission_counts(genotypes: DataFrame, trios: DataFrame) -> DataFrame:
    """Alleles that heterozygous parents passed on and kept, by site, in trios without missing calls."""
    calls = trio_calls(genotypes, trios).where("child_gt >= 0 and mother_gt >= 0 and father_gt >= 0")
    hets = (F.col("mother_gt") == 1).cast("int") + (F.col("father_gt") == 1).cast("int")
    homs = (F.col("mother_gt") == 2).cast("int") + (F.col("father_gt") == 2).cast("int")
    passed = F.col("child_gt") - homs
    sound = calls.where((hets > 0) & passed.between(0, hets))
    return sound.groupBy(*SITE_KEYS).agg(F.sum(passed).alias("n_transmitted"), F.sum(hets - passed).alias("n_not_transmitted"))


def null_allele_frequencies(genotypes: DataFrame) -> DataFrame:
    """Allele frequencies and expected class shares at each site, without and with a null allele.

    Without one (p0, q0) missing calls are left out; with one (p, q, r) they are those of two
    null alleles, and a reference call may hide one: r = sqrt(missing), p = sqrt(r**2 + ref) - r,
    q = 1 - r - p, all of shares. Expected shares are e0_ref, e0_het, e0_hom and e_ref, e_het,
    e_hom, e_missing. Sites without any call have no p0 and q0.
    """
    counts = class_counts(genotypes)
    called = F.col("n_ref") + F.col("n_het") + F.col("n_hom")
    whole = (called + F.col("n_missing")).cast("double")
    p0 = F.sqrt(F.try_divide(F.col("n_ref"), called))
    r = F.sqrt(F.col("n_missing") / whole)
    named = counts.withColumns({"p0": p0, "q0": 1 - p0, "r": r}).withColumn("p", F.sqrt(F.col("r") * F.col("r") + F.col("n_ref") / whole) - F.col("r")).withColumn("q", 1 - F.col("r") - F.col("p"))
    p, q, r, p0, q0 = (F.col(n) for n in ("p", "q", "r", "p0", "q0"))
    expected = {"e0_ref": p0 * p0, "e0_het": 2 * p0 * q0, "e0_hom": q0 * q0, "e_ref": p * p + 2 * p * r, "e_het": 2 * p * q, "e_hom": q * q + 2 * q * r, "e_missing": r * r}
    return named.withColumns(expected)
