"""Queries of estimates, pedigrees over generations and transmitted deletions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters, deletions, genotypes, inference
from ..sources.pedigree import prune_generations
from . import projections as p
from .registry import AF_SQL, query


@query(
    AF_SQL
    + """, s AS (SELECT *, n_ref + n_het + n_hom AS n, CAST(n_ref + n_het + n_hom + n_missing AS DOUBLE) AS w FROM counts
), a AS (SELECT *, sqrt(n_ref / nullif(CAST(n AS DOUBLE), 0)) AS p0, sqrt(n_missing / w) AS r FROM s), b AS (SELECT *, 1 - p0 AS q0, sqrt(r * r + n_ref / w) - r AS p FROM a), c AS (SELECT *, 1 - r - p AS q FROM b)
SELECT chrom, pos, n_ref, n_het, n_hom, n_missing, round(p0, 6) AS p0, round(q0, 6) AS q0, round(r, 6) AS r, round(p, 6) AS p, round(q, 6) AS q, round(p0 * p0, 6) AS e0_ref, round(2 * p0 * q0, 6) AS e0_het, round(q0 * q0, 6) AS e0_hom, round(p * p + 2 * p * r, 6) AS e_ref, round(2 * p * q, 6) AS e_het, round(q * q + 2 * q * r, 6) AS e_hom, round(r * r, 6) AS e_missing FROM c"""
)
def null_allele_frequencies(spark, sf_dir):
    found = genotypes.null_allele_frequencies(p.genotype(spark, sf_dir))
    return found.withColumns({c: F.round(c, 6) for c in found.columns if c not in ("chrom", "pos", "n_ref", "n_het", "n_hom", "n_missing")})


HAPLOTYPE_SQL = (
    "WITH "
    + p.SEGMENT_SQL
    + """, seg AS (SELECT *, m1_del AS d0, CASE WHEN v % 5 = 1 THEN 0 ELSE 1 END AS d1, CASE WHEN v % 6 < 2 THEN 0 WHEN v % 13 = 0 THEN NULL ELSE 1 END AS d2, CASE WHEN v % 9 = 4 THEN 0 ELSE 1 END AS d3 FROM segment
), hap AS (SELECT family, chrom, seg_id, start_pos, end_pos, is_hard, h, CASE h WHEN 0 THEN d0 WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS raw, coalesce(CASE WHEN h < 2 THEN d0 = 0 AND d1 = 0 ELSE d2 = 0 AND d3 = 0 END, false) AS both_, CASE WHEN h < 2 THEN mat ELSE pat END AS one, CASE WHEN h < 2 THEN mat_other ELSE pat_other END AS two FROM seg, (SELECT unnest([0, 1, 2, 3]) AS h) z
), told AS (SELECT *, CASE WHEN both_ OR coalesce(one = h OR two = h, false) THEN raw END AS state FROM hap
), gone AS (SELECT *, coalesce(state = 0, false) AS g, lead(start_pos) OVER w AS nx, row_number() OVER w AS k, count(*) OVER (PARTITION BY family, chrom, h) AS n FROM told WINDOW w AS (PARTITION BY family, chrom, h ORDER BY start_pos, seg_id)
), marked AS (SELECT *, g <> lag(g) OVER w AS changed, last_value(CASE WHEN state = 1 THEN nx END IGNORE NULLS) OVER (PARTITION BY family, chrom, h ORDER BY start_pos, seg_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opt, first_value(nx) OVER w AS second FROM gone WINDOW w AS (PARTITION BY family, chrom, h ORDER BY start_pos, seg_id)
), numbered AS (SELECT *, sum(CASE WHEN changed THEN 1 ELSE 0 END) OVER (PARTITION BY family, chrom, h ORDER BY start_pos, seg_id ROWS UNBOUNDED PRECEDING) AS run FROM marked
), runs AS (SELECT family, chrom, h, run, min(start_pos) AS start_pos, max(end_pos) AS end_pos, arg_min(coalesce(opt, second), k) AS opt_start_pos, arg_min(both_, k) AS is_double, bool_and(one IS NOT NULL AND two IS NOT NULL AND NOT is_hard) AND min(one) = max(one) AND min(two) = max(two) AS sound, min(one) AS one, min(two) AS two, min(k) AS lo, max(k) AS hi, min(n) AS n FROM numbered WHERE g GROUP BY family, chrom, h, run
), deletion AS (SELECT *, CAST(one = h AS INT) AS t1, CAST(two = h AS INT) AS t2 FROM runs WHERE sound AND lo > 1 AND hi < n AND (one = h OR two = h))"""
)


def _transmitted(spark, sf_dir):
    """Families of two children, over the segments' states."""
    rows = p.segment(spark, sf_dir)
    others = ("case when v % 5 = 1 then 0 else 1 end", "case when v % 6 < 2 then 0 when v % 13 = 0 then null else 1 end", "case when v % 9 = 4 then 0 else 1 end")
    dels = F.array("m1_del", *[F.expr(x) for x in others])
    child = lambda k, mat, pat: F.struct((F.col("family") * 2 + k).alias("individual"), F.col(mat).alias("mat"), F.col(pat).alias("pat"))
    phases = F.array(child(0, "mat", "pat"), child(1, "mat_other", "pat_other"))
    return deletions.transmitted_deletions(rows.withColumns({"dels": dels, "phases": phases}), ["family", "chrom"])


@query(HAPLOTYPE_SQL + " SELECT family, chrom, h AS haplotype, start_pos, end_pos, end_pos - start_pos + 1 AS length, opt_start_pos, is_double, CASE WHEN t1 = 1 AND t2 = 1 THEN concat(family * 2, ',', family * 2 + 1) WHEN t1 = 1 THEN CAST(family * 2 AS VARCHAR) ELSE CAST(family * 2 + 1 AS VARCHAR) END AS trans, 2 - t1 - t2 AS n_notrans FROM deletion")
def transmitted_deletions(spark, sf_dir):
    return _transmitted(spark, sf_dir).withColumns({"trans": F.array_join("trans", ","), "n_notrans": F.size("notrans")}).drop("notrans")


@query(HAPLOTYPE_SQL + ", child AS (SELECT h < 2 AS is_mat, family * 2 AS individual, t1 AS t FROM deletion UNION ALL SELECT h < 2, family * 2 + 1, t2 FROM deletion) SELECT 1 + individual % 2 AS phenotype, 1 + CAST(floor(individual / 2.0) AS BIGINT) % 2 AS sex, is_mat, CAST(sum(t) AS BIGINT) AS n_transmitted, CAST(sum(1 - t) AS BIGINT) AS n_not_transmitted FROM child GROUP BY ALL")
def transmission_of_deletions(spark, sf_dir):
    """Children with and without their parents' deletions, by phenotype, sex and parent."""
    found = _transmitted(spark, sf_dir).withColumn("is_mat", F.col("haplotype") < 2)
    families = p.table(spark, sf_dir, "events").select((F.col("user_id") * 2).alias("individual")).distinct()
    people = families.union(families.select(F.col("individual") + 1)).select("individual", (1 + F.col("individual") % 2).alias("phenotype"), (1 + F.floor(F.col("individual") / 2) % 2).alias("sex"))
    return deletions.transmission_contingency(found, people, ["is_mat", "sex"])


GENERATION_SQL = "person AS (SELECT c_custkey AS individual, CAST(c_nationkey AS BIGINT) AS family, CASE WHEN c_custkey % 5 > 0 THEN CAST(floor(c_custkey / 3.0) AS BIGINT) END AS mother, CASE WHEN c_custkey % 5 > 0 THEN CAST(floor(c_custkey / 3.0) AS BIGINT) + 1 END AS father, c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_custkey % 3 = 0 AS sampled FROM customer)"


@query("WITH RECURSIVE " + GENERATION_SQL + ", kept AS (SELECT individual FROM person WHERE sampled UNION SELECT unnest([q.mother, q.father]) FROM person q JOIN kept k ON q.individual = k.individual) SELECT family, individual, mother, father FROM person WHERE individual IN (SELECT individual FROM kept)")
def pruned_generations(spark, sf_dir):
    """Customers as one pedigree of many generations (descent by number), few of them sampled."""
    people = p.table(spark, sf_dir, "customer").selectExpr(
        "cast(c_nationkey as bigint) as family", "c_custkey as individual",
        "case when c_custkey % 5 > 0 then floor(c_custkey / 3) end as mother", "case when c_custkey % 5 > 0 then floor(c_custkey / 3) + 1 end as father",
        "c_mktsegment in ('BUILDING', 'MACHINERY') and c_custkey % 3 = 0 as sampled",
    )
    samples = people.where("sampled").select(F.col("individual").alias("sample"))
    return prune_generations(people.drop("sampled"), samples)


@query()
def density_clusters(spark, sf_dir):
    """Orders by day and price in five thousands; the tests hold clusters against plain neighbour lists."""
    points = p.table(spark, sf_dir, "orders").select("o_orderkey", p.day("o_orderdate").alias("day"), F.floor(F.col("o_totalprice") / 5000).alias("price"))
    found = clusters.density_clusters(points, "day", "price", 5.0, 8)
    return found.select("o_orderkey", "day", "price", "is_core", F.concat_ws(":", "component.cx", "component.cy").alias("cluster"))


@query()
def bootstrap_odds(spark, sf_dir):
    """Odds ratios with bootstrap intervals, resampled within four strata of orders."""
    rows = p.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.floor(F.col("o_totalprice") / 50_000) / 10).alias("price"), (F.col("o_custkey") % 2).alias("parity"), (F.col("o_custkey") % 4).alias("stratum"))
    found = inference.bootstrap_logistic(rows, ["o_orderkey"], ["price", "parity"], "y", ["stratum"], replicates=200)
    return spark.createDataFrame(found, "term string, coefficient double, low double, high double, odds_ratio double, odds_low double, odds_high double")
