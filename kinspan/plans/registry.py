"""Registered queries: name -> (function of session and folder, SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PhaseConfig
from ..functions import intervals, stats
from ..operators import association, deletions, genotypes, greedy, hmm, ibd, inference, matching, recombination
from ..sources.stores import settled
from . import projections as p

CUTOFF = 20000
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def _tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = p.segment(spark, sf_dir)
    known = {f"{side}_phase": F.when(~F.col("is_hard"), F.col(side)) for side in ("mat", "pat")}
    return s.withColumns(known)


RECOMBINATION_SQL = (
    "WITH "
    + p.SEGMENT_SQL
    + """, track AS (
  SELECT family, chrom, seg_id, start_pos, end_pos, 1 AS side, CASE WHEN NOT is_hard THEN mat END AS phase, is_hard FROM segment
  UNION ALL SELECT family, chrom, seg_id, start_pos, end_pos, 0, CASE WHEN NOT is_hard THEN pat END, is_hard FROM segment
), counted AS (
  SELECT *, sum(CAST(is_hard AS INT)) OVER (PARTITION BY family, chrom, side ORDER BY start_pos, seg_id ROWS UNBOUNDED PRECEDING) AS hard FROM track
), known AS (
  SELECT *, lag(phase) OVER w AS phase_before, lag(end_pos) OVER w AS end_before, lag(hard) OVER w AS hard_before
  FROM counted WHERE phase IS NOT NULL WINDOW w AS (PARTITION BY family, chrom, side ORDER BY start_pos, seg_id)
), recombination AS (
  SELECT family, chrom, side, end_before - 1 AS start_pos, start_pos AS end_pos, hard > hard_before AS is_hts FROM known WHERE phase <> phase_before
)"""
)
EVENT_SQL = (
    RECOMBINATION_SQL
    + f""", dealt AS (
  SELECT *, CASE WHEN start_pos - lag(end_pos) OVER (PARTITION BY family, chrom, side ORDER BY start_pos, end_pos) > {CUTOFF} THEN 1 ELSE 0 END AS brk FROM recombination
), numbered AS (
  SELECT *, sum(brk) OVER (PARTITION BY family, chrom, side ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS island FROM dealt
), event AS (
  SELECT family, chrom, side, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS n, max(CAST(is_hts AS INT)) = 1 AS is_hts FROM numbered GROUP BY family, chrom, side, island
)"""
)


@query(RECOMBINATION_SQL + " SELECT family, chrom, side = 1 AS is_mat, start_pos, end_pos, is_hts FROM recombination")
def recombinations(spark, sf_dir):
    return recombination.recombinations(recombination.by_side(_tracks(spark, sf_dir)), "phase", ["family", "chrom", "is_mat"])


def _events(spark, sf_dir):
    return recombination.both_sides(_tracks(spark, sf_dir), CUTOFF, CUTOFF)


@query(EVENT_SQL + " SELECT family, chrom, side = 1 AS is_mat, start_pos, end_pos, n AS n_recombinations, n > 1 AS is_complex, is_hts FROM event WHERE n % 2 = 1")
def crossovers(spark, sf_dir):
    return _events(spark, sf_dir).where("not is_gene_conversion").drop("recombinations", "is_gene_conversion")


@query(EVENT_SQL + " SELECT family, chrom, side = 1 AS is_mat, start_pos, end_pos, n AS n_recombinations, n > 2 AS is_complex, is_hts FROM event WHERE n % 2 = 0")
def gene_conversions(spark, sf_dir):
    return _events(spark, sf_dir).where("is_gene_conversion").drop("recombinations", "is_gene_conversion")


@query(EVENT_SQL + ", counts AS (SELECT family, sum(side) AS m, sum(1 - side) AS p FROM event WHERE n % 2 = 1 GROUP BY family) SELECT f.family, CAST(coalesce(m, 0) AS BIGINT) AS maternal_crossovers, CAST(coalesce(p, 0) AS BIGINT) AS paternal_crossovers FROM (SELECT DISTINCT user_id AS family FROM events) f LEFT JOIN counts c ON f.family = c.family")
def crossover_counts(spark, sf_dir):
    owners = p.table(spark, sf_dir, "events").select(F.col("user_id").alias("family")).distinct()
    return recombination.crossover_counts(_events(spark, sf_dir), owners, ["family"])


@query("WITH " + p.SEGMENT_SQL + """, marked AS (
  SELECT *, row_number() OVER w AS rn, coalesce(mat, -1) AS m, coalesce(pat, -1) AS q, lag(coalesce(mat, -1)) OVER w AS m0, lag(coalesce(pat, -1)) OVER w AS q0, lag(is_hard) OVER w AS h0
  FROM segment WINDOW w AS (PARTITION BY family, chrom ORDER BY start_pos, seg_id)
), runs AS (
  SELECT *, sum(CASE WHEN rn > 1 AND m = m0 AND q = q0 AND is_hard = h0 THEN 0 ELSE 1 END) OVER (PARTITION BY family, chrom ORDER BY start_pos, seg_id ROWS UNBOUNDED PRECEDING) AS run FROM marked
) SELECT family, chrom, mat, pat, is_hard, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS n_rows FROM runs GROUP BY family, chrom, run, mat, pat, is_hard""")
def segments_rle(spark, sf_dir):
    return intervals.merge_runs(p.segment(spark, sf_dir), ["family", "chrom"], ["mat", "pat", "is_hard"], ["start_pos", "seg_id"])


def _ibd_sql(by: str) -> str:
    parts = []
    codes = {"maternal": "mat = mat_other", "paternal": "pat = pat_other", "matxpat": "CASE WHEN mat = mat_other IS NOT NULL AND pat = pat_other IS NOT NULL THEN mat = mat_other AND pat = pat_other END"}
    codes["matxpat"] = "CASE WHEN mat IS NOT NULL AND mat_other IS NOT NULL AND pat IS NOT NULL AND pat_other IS NOT NULL THEN mat = mat_other AND pat = pat_other END"
    for side, code in codes.items():
        parts += [f"CAST(sum(CASE WHEN {code} THEN n ELSE 0 END) AS BIGINT) AS {side}_match", f"CAST(sum(CASE WHEN NOT ({code}) THEN n ELSE 0 END) AS BIGINT) AS {side}_mismatch", f"CAST(sum(CASE WHEN ({code}) IS NULL THEN n ELSE 0 END) AS BIGINT) AS {side}_unknown"]
    shares = []
    for side in codes:
        shares += [f"round({side}_match / nullif(CAST({side}_match + {side}_mismatch AS DOUBLE), 0), 6) AS {side}_ibd", f"round({side}_unknown / nullif(CAST({side}_match + {side}_mismatch + {side}_unknown AS DOUBLE), 0), 6) AS {side}_unknown_fraction"]
    return "WITH " + p.SEGMENT_SQL + f", sums AS (SELECT {by}, {', '.join(parts)} FROM (SELECT *, end_pos - start_pos AS n FROM segment) s GROUP BY {by}) SELECT *, {', '.join(shares)} FROM sums"


def _siblings(spark, sf_dir):
    s = p.segment(spark, sf_dir)
    return s.withColumnsRenamed({"mat": "mat_1", "mat_other": "mat_2", "pat": "pat_1", "pat_other": "pat_2"})


@query(_ibd_sql("family"))
def ibd_sibpair(spark, sf_dir):
    return ibd.ibd(_siblings(spark, sf_dir), ["family"])


@query(_ibd_sql("family, chrom"))
def ibd_by_chrom(spark, sf_dir):
    return ibd.ibd(_siblings(spark, sf_dir), ["family", "chrom"])


@query("WITH " + p.PEDIGREE_SQL + " SELECT a.family, a.individual AS sibling1, b.individual AS sibling2 FROM pedigree a JOIN pedigree b ON a.family = b.family AND a.individual < b.individual WHERE a.mother IS NOT NULL AND b.mother IS NOT NULL")
def sibpairs(spark, sf_dir):
    return ibd.sibling_pairs(p.pedigree(spark, sf_dir).where("mother is not null"))


@query("WITH " + p.PEDIGREE_SQL + " SELECT family, individual AS child, mother, father, sex, phenotype FROM pedigree WHERE mother IS NOT NULL AND father IS NOT NULL")
def children(spark, sf_dir):
    return p.pedigree(spark, sf_dir).where("mother is not null and father is not null").select("family", F.col("individual").alias("child"), "mother", "father", "sex", "phenotype")


@query("WITH " + p.PEDIGREE_SQL + " SELECT family, min(individual) AS first_member, max(individual) AS last_member, sum(CASE WHEN phenotype = 2 AND role >= 2 THEN 1 ELSE 0 END)::BIGINT AS n_affected_children FROM pedigree GROUP BY family HAVING count(*) = 4")
def quads(spark, sf_dir):
    members = p.pedigree(spark, sf_dir).groupBy("family").agg(F.count("*").alias("n"), F.min("individual").alias("first_member"), F.max("individual").alias("last_member"), F.count_if(F.expr("phenotype = 2 and role >= 2")).alias("n_affected_children"))
    return members.where("n = 4").drop("n")


DELETION_SQL = "WITH " + p.SEGMENT_SQL + """, marked AS (
  SELECT family, chrom, seg_id, start_pos, end_pos, is_hard, coalesce(m1_del, -1) AS state, lag(coalesce(m1_del, -1)) OVER (PARTITION BY family, chrom ORDER BY start_pos, seg_id) AS before FROM segment
), numbered AS (
  SELECT *, sum(CASE WHEN state <> before THEN 1 ELSE 0 END) OVER (PARTITION BY family, chrom ORDER BY start_pos, seg_id ROWS UNBOUNDED PRECEDING) AS run FROM marked
), runs AS (
  SELECT family, chrom, run, state, min(start_pos) AS start_pos, sum(CASE WHEN is_hard THEN end_pos - start_pos ELSE 0 END) AS hard, sum(end_pos - start_pos) AS bases FROM numbered GROUP BY family, chrom, run, state
), seen AS (
  SELECT *, lead(start_pos) OVER w AS nx, lead(state) OVER w AS ns, lead(start_pos, 2) OVER w AS nnx, lag(state) OVER w AS ls, lag(start_pos) OVER w AS lx FROM runs WINDOW w AS (PARTITION BY family, chrom ORDER BY run)
) SELECT family, chrom, start_pos, nx AS end_pos, nx - start_pos + 1 AS length, CASE WHEN ls = -1 THEN lx ELSE start_pos END AS opt_start_pos, CASE WHEN ns = -1 THEN nnx ELSE nx END AS opt_end_pos, hard > 0.9 * bases AS is_hts FROM seen WHERE state = 0"""


@query(DELETION_SQL)
def inherited_deletions(spark, sf_dir):
    return deletions.deletions(p.segment(spark, sf_dir), ["family", "chrom"], "m1_del")


@query("WITH " + p.INTERVAL_SQL + " SELECT sample, count(*) AS n_deletions, CAST(sum(end_pos - start_pos) AS BIGINT) AS bases, CAST(sum(is_mat) AS BIGINT) AS n_maternal, CAST(sum(1 - is_mat) AS BIGINT) AS n_paternal, CAST(sum(is_mat * (end_pos - start_pos)) AS BIGINT) AS maternal_bases FROM interval_ GROUP BY sample")
def deletion_burden(spark, sf_dir):
    return deletions.burden(p.interval(spark, sf_dir), "sample")


@query("WITH " + p.INTERVAL_SQL + ", pairs AS (SELECT a.iv_id, count(*) AS n, sum(least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos)) AS c FROM interval_ a JOIN interval_ b ON a.chrom = b.chrom AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos AND a.iv_id <> b.iv_id GROUP BY a.iv_id) SELECT i.iv_id, coalesce(n, 0) AS n_matches, CAST(coalesce(c, 0) AS BIGINT) AS common_bases FROM interval_ i LEFT JOIN pairs USING (iv_id)")
def deletion_collections(spark, sf_dir):
    return deletions.collection_sizes(p.interval(spark, sf_dir), ["chrom"], 256)


@query("WITH " + p.INTERVAL_SQL + ", pairs AS (SELECT a.iv_id, count(*) AS n, sum(least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos)) AS c FROM interval_ a JOIN interval_ b ON a.chrom = b.chrom AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos AND a.iv_id <> b.iv_id AND least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos) >= 0.8 * (a.end_pos - a.start_pos) GROUP BY a.iv_id) SELECT i.iv_id, coalesce(n, 0) AS n_matches, CAST(coalesce(c, 0) AS BIGINT) AS common_bases FROM interval_ i LEFT JOIN pairs USING (iv_id)")
def deletion_collections_by_share(spark, sf_dir):
    return deletions.collection_sizes(p.interval(spark, sf_dir), ["chrom"], 32, 0.8)


RECIPROCAL_SQL = "WITH " + p.INTERVAL_SQL + ", pairs AS (SELECT a.iv_id, b.iv_id AS r_iv_id FROM interval_ a JOIN interval_ b ON a.chrom = b.chrom AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos AND a.iv_id <> b.iv_id AND least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos) + 1 >= 0.5 * (a.end_pos - a.start_pos + 1) AND least(a.end_pos, b.end_pos) - greatest(a.start_pos, b.start_pos) + 1 >= 0.5 * (b.end_pos - b.start_pos + 1))"


@query(RECIPROCAL_SQL + " SELECT iv_id, count(*) AS n_partners, min(r_iv_id) AS first_partner FROM pairs GROUP BY iv_id")
def reciprocal_overlap(spark, sf_dir):
    return deletions.reciprocal_counts(p.interval(spark, sf_dir), ["chrom"])


@query(RECIPROCAL_SQL + " SELECT iv_id, sample, chrom, start_pos, end_pos, is_mat FROM interval_ WHERE iv_id NOT IN (SELECT iv_id FROM pairs)")
def private_deletions(spark, sf_dir):
    return deletions.private(p.interval(spark, sf_dir), ["chrom"])


@query("WITH " + p.INTERVAL_SQL + ", marker AS (SELECT DISTINCT CAST(l_suppkey % 22 + 1 AS INT) AS chrom, CAST(floor(epoch_us(l_shipdate) / 86400000000.0) AS BIGINT) AS pos FROM lineitem) SELECT i.iv_id, count(m.pos) AS n_markers FROM interval_ i LEFT JOIN marker m ON i.chrom = m.chrom AND m.pos >= i.start_pos AND m.pos < i.end_pos GROUP BY i.iv_id")
def markers_in_interval(spark, sf_dir):
    markers = p.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 22 + 1).cast("int").alias("chrom"), p.day("l_shipdate").alias("pos")).distinct()
    return intervals.points_within(p.interval(spark, sf_dir), markers, ["chrom"], 256).withColumnRenamed("n", "n_markers")


POINT_SQL = "point AS (SELECT o_orderkey AS point_id, o_custkey AS family, concat('chr', CAST(o_orderkey % 3 + 1 AS VARCHAR)) AS chrom, (o_orderkey * 7919) % 2592000 AS pos FROM orders)"


@query("WITH " + p.SEGMENT_SQL + ", " + POINT_SQL + ", hits AS (SELECT q.point_id, max(s.start_pos * 10000000 + s.seg_id) AS k FROM point q JOIN segment s ON q.family = s.family AND q.chrom = s.chrom AND s.start_pos <= q.pos GROUP BY q.point_id) SELECT q.point_id, q.family, q.chrom, q.pos, k % 10000000 AS seg_id FROM point q LEFT JOIN hits USING (point_id)")
def asof_segment(spark, sf_dir):
    points = p.table(spark, sf_dir, "orders").selectExpr("o_orderkey as point_id", "o_custkey as family", "concat('chr', cast(o_orderkey % 3 + 1 as string)) as chrom", "(o_orderkey * 7919) % 2592000 as pos")
    return intervals.as_of(points, p.segment(spark, sf_dir), ["family", "chrom"], "seg_id").select("point_id", "family", "chrom", "pos", "seg_id")


ANNOTATION_SQL = "WITH " + p.INTERVAL_SQL + ", " + p.REGION_SQL + ", hits AS (SELECT i.iv_id, r.category, sum(least(i.end_pos, r.end_pos) - greatest(i.start_pos, r.start_pos)) AS c FROM interval_ i JOIN region_ r ON i.chrom = r.chrom AND i.start_pos < r.end_pos AND r.start_pos < i.end_pos GROUP BY i.iv_id, r.category)"


@query(ANNOTATION_SQL + " SELECT h.iv_id, category, CAST(c AS BIGINT) AS covered FROM hits h JOIN interval_ i USING (iv_id) WHERE c > 0.25 * (i.end_pos - i.start_pos)")
def region_annotation(spark, sf_dir):
    own = p.interval(spark, sf_dir)
    found = intervals.overlap_sums(own, p.region(spark, sf_dir), ["chrom"], {"n": F.lit(1)}, 256, by="category").where("n > 0 and n_bases > 0.25 * (end_pos - start_pos)")
    return own.join(found, ["chrom", "start_pos", "end_pos"]).select("iv_id", "category", F.col("n_bases").alias("covered"))


@query(ANNOTATION_SQL + ", total AS (SELECT iv_id, sum(c) AS c FROM hits GROUP BY iv_id) SELECT i.iv_id, i.chrom, i.start_pos, i.end_pos FROM interval_ i LEFT JOIN total t USING (iv_id) WHERE coalesce(c, 0) <= 0.66 * (i.end_pos - i.start_pos)")
def excluded_regions(spark, sf_dir):
    own = p.interval(spark, sf_dir)
    total = intervals.overlap_sums(own, p.region(spark, sf_dir), ["chrom"], {"n": F.lit(1)}, 256)
    kept = own.join(total, ["chrom", "start_pos", "end_pos"], "left").na.fill(0, ["n_bases"])
    return kept.where("n_bases <= 0.66 * (end_pos - start_pos)").select("iv_id", "chrom", "start_pos", "end_pos")


COVERAGE_SQL = "WITH " + p.INTERVAL_SQL + """, reach AS (
  SELECT *, max(end_pos) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM interval_ WHERE is_mat = 0
), numbered AS (SELECT *, sum(CASE WHEN start_pos > r THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS g FROM reach
), merged AS (SELECT chrom, min(start_pos) AS s, max(end_pos) AS e FROM numbered GROUP BY chrom, g
), sums AS (SELECT i.iv_id, sum(least(i.end_pos, m.e) - greatest(i.start_pos, m.s)) AS c FROM interval_ i JOIN merged m ON i.chrom = m.chrom AND i.start_pos < m.e AND m.s < i.end_pos WHERE i.is_mat = 1 GROUP BY i.iv_id)
SELECT i.iv_id, CAST(coalesce(c, 0) AS BIGINT) AS covered, round(coalesce(c, 0) / CAST(i.end_pos - i.start_pos AS DOUBLE), 6) AS share FROM interval_ i LEFT JOIN sums USING (iv_id) WHERE i.is_mat = 1"""


@query(COVERAGE_SQL)
def union_coverage(spark, sf_dir):
    own = p.interval(spark, sf_dir)
    other = intervals.merge_overlaps(own.where("is_mat = 0"), ["chrom"], 256)
    return association.covered_share(own.where("is_mat = 1"), other, ["chrom"], 64).select("iv_id", "covered", "share")


COVERAGE_ALL_SQL = "WITH " + p.INTERVAL_SQL + """, reach AS (
  SELECT *, max(end_pos) OVER (PARTITION BY chrom, is_mat ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM interval_
), numbered AS (SELECT *, sum(CASE WHEN start_pos > r THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, is_mat ORDER BY start_pos, end_pos ROWS UNBOUNDED PRECEDING) AS g FROM reach
), merged AS (SELECT chrom, is_mat, min(start_pos) AS s, max(end_pos) AS e FROM numbered GROUP BY chrom, is_mat, g
), sums AS (SELECT i.iv_id, sum(least(i.end_pos, m.e) - greatest(i.start_pos, m.s)) AS c FROM interval_ i JOIN merged m ON i.chrom = m.chrom AND i.is_mat <> m.is_mat AND i.start_pos < m.e AND m.s < i.end_pos GROUP BY i.iv_id)
SELECT i.iv_id, CAST(coalesce(c, 0) AS BIGINT) AS covered, round(coalesce(c, 0) / CAST(i.end_pos - i.start_pos AS DOUBLE), 6) AS share FROM interval_ i LEFT JOIN sums USING (iv_id)"""


@query(COVERAGE_ALL_SQL)
def union_coverage_all(spark, sf_dir):
    """Every interval, of either parent, against the union of the other parent's."""
    own = p.interval(spark, sf_dir)
    other = intervals.merge_overlaps(own.select("chrom", (1 - F.col("is_mat")).alias("side"), "start_pos", "end_pos"), ["chrom", "side"], 256)
    return association.covered_share(own.withColumn("side", F.col("is_mat")), other, ["chrom", "side"], 64).select("iv_id", "covered", "share")


MATCH_SQL = EVENT_SQL + """, named AS (SELECT *, row_number() OVER () AS k FROM event), called AS (SELECT * FROM named WHERE n % 2 = 1), truth AS (SELECT * FROM named WHERE n % 2 = 0), pairs AS (SELECT c.k AS ck, t.k AS tk FROM called c JOIN truth t ON c.family = t.family AND c.chrom = t.chrom AND c.side = t.side AND c.start_pos < t.end_pos + 50000 AND t.start_pos - 50000 < c.end_pos
), judged AS (SELECT side, 1 AS is_call, CASE WHEN k IN (SELECT ck FROM pairs) THEN 1 ELSE 0 END AS m FROM called UNION ALL SELECT side, 0, CASE WHEN k IN (SELECT tk FROM pairs) THEN 1 ELSE 0 END FROM truth
), sums AS (SELECT CAST(side AS INT) AS is_mat, sum(is_call) AS n_called, sum(is_call * m) AS n_matched, sum(1 - is_call) AS n_truth, sum((1 - is_call) * m) AS n_truth_matched FROM judged GROUP BY ROLLUP (side))"""


@query(MATCH_SQL + " SELECT is_mat, CAST(n_called AS BIGINT) AS n_called, CAST(n_matched AS BIGINT) AS n_matched, CAST(n_truth AS BIGINT) AS n_truth, CAST(n_truth_matched AS BIGINT) AS n_truth_matched, round(n_matched / nullif(CAST(n_called AS DOUBLE), 0), 6) AS precision_, round(n_truth_matched / nullif(CAST(n_truth AS DOUBLE), 0), 6) AS recall FROM sums")
def precision_recall(spark, sf_dir):
    found = settled(_events(spark, sf_dir).withColumn("side", F.col("is_mat").cast("int")).drop("recombinations"), "events")
    return matching.match_rates(found.where("not is_gene_conversion"), found.where("is_gene_conversion"), ["family", "chrom", "side"], 100_000, 50_000, F.col("side")).withColumnRenamed("by", "is_mat")


@query(RECOMBINATION_SQL + ", spread AS (SELECT side, chrom, start_pos, end_pos, unnest(range(CAST(floor(start_pos / 100000.0) AS BIGINT), CAST(ceil(end_pos / 100000.0) AS BIGINT))) AS bin FROM recombination WHERE end_pos > start_pos) SELECT CAST(side AS INT) AS side, chrom, bin, round(sum((least(end_pos, (bin + 1) * 100000) - greatest(start_pos, bin * 100000)) / CAST(end_pos - start_pos AS DOUBLE)), 6) AS weight, count(*) AS n_events FROM spread GROUP BY side, chrom, bin")
def window_binning(spark, sf_dir):
    return association.weighted_bins(recombinations(spark, sf_dir).withColumn("side", F.col("is_mat").cast("int")), ["side", "chrom"], 100_000)


@query("WITH " + p.INTERVAL_SQL + ", steps AS (SELECT chrom, pos, sum(n) AS n, sum(m) AS m FROM (SELECT chrom, start_pos AS pos, 1 AS n, is_mat AS m FROM interval_ UNION ALL SELECT chrom, end_pos, -1, -is_mat FROM interval_) x GROUP BY chrom, pos) SELECT chrom, start_pos, end_pos, n, n_mat FROM (SELECT chrom, pos AS start_pos, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS end_pos, CAST(sum(n) OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n, CAST(sum(m) OVER (PARTITION BY chrom ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS n_mat FROM steps) y WHERE end_pos IS NOT NULL")
def sweep_counts(spark, sf_dir):
    return intervals.sweep(p.interval(spark, sf_dir), ["chrom"], {"n": F.lit(1), "n_mat": F.col("is_mat")}, 256)


@query("WITH " + p.INTERVAL_SQL + ", point AS (SELECT chrom, start_pos AS pos FROM interval_ UNION SELECT chrom, end_pos FROM interval_), tile AS (SELECT chrom, pos AS start_pos, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS end_pos FROM point), counts AS (SELECT t.chrom, t.start_pos, t.end_pos, count(*) AS n, CAST(sum(1 - is_mat) AS BIGINT) AS n_0, CAST(sum(is_mat) AS BIGINT) AS n_1 FROM tile t JOIN interval_ i ON t.chrom = i.chrom AND i.start_pos <= t.start_pos AND t.end_pos <= i.end_pos GROUP BY t.chrom, t.start_pos, t.end_pos) SELECT *, CASE WHEN n_1 >= 0.6 * n THEN 1 WHEN n_0 >= 0.6 * n THEN 0 ELSE -1 END AS consensus FROM counts")
def tiling_consensus(spark, sf_dir):
    return association.tile_consensus(p.interval(spark, sf_dir), ["chrom"], "is_mat", 256, 0.6)


@query("SELECT o_orderstatus, o_orderpriority, o_custkey % 5 AS grp, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority, o_custkey % 5 UNION ALL SELECT NULL, o_orderpriority, o_custkey % 5, count(*) FROM orders GROUP BY o_orderpriority, o_custkey % 5")
def contingency_margins(spark, sf_dir):
    return association.margins(p.table(spark, sf_dir, "orders").withColumn("grp", F.col("o_custkey") % 5), [["o_orderstatus", "o_orderpriority", "grp"], ["o_orderpriority", "grp"]])


@query("WITH " + p.PEDIGREE_SQL + ", " + p.INTERVAL_SQL + ", told AS (SELECT i.is_mat, i.sample AS individual, 1 AS t FROM interval_ i UNION ALL SELECT i.is_mat, CASE WHEN i.sample % 4 = 2 THEN i.sample + 1 ELSE i.sample - 1 END, 0 FROM interval_ i) SELECT q.phenotype, q.sex, w.is_mat, CAST(sum(t) AS BIGINT) AS n_transmitted, CAST(sum(1 - t) AS BIGINT) AS n_not_transmitted FROM told w JOIN pedigree q ON w.individual = q.individual WHERE q.mother IS NOT NULL GROUP BY q.phenotype, q.sex, w.is_mat")
def transmission_contingency(spark, sf_dir):
    own = p.interval(spark, sf_dir).select("is_mat", F.array("sample").alias("trans"), F.array(F.when(F.col("sample") % 4 == 2, F.col("sample") + 1).otherwise(F.col("sample") - 1)).alias("notrans"))
    people = p.pedigree(spark, sf_dir).where("mother is not null").select("individual", "phenotype", "sex")
    return deletions.transmission_contingency(own, people, ["is_mat", "sex"]).select("phenotype", "sex", "is_mat", "n_transmitted", "n_not_transmitted")


@query("WITH " + p.PEDIGREE_SQL + ", " + p.INTERVAL_SQL + ", c AS (SELECT q.family, CAST(floor(i.start_pos / 30.0) AS BIGINT) AS iv_id, CAST(sum(is_mat) AS BIGINT) AS n_mat, CAST(sum(1 - is_mat) AS BIGINT) AS n_pat, count(DISTINCT q.individual) AS n_children FROM interval_ i JOIN pedigree q ON i.sample = q.individual WHERE q.mother IS NOT NULL GROUP BY 1, 2) SELECT *, CASE WHEN n_mat > 0 AND n_pat > 0 AND n_children < n_mat + n_pat THEN 'double' WHEN n_mat > 0 AND n_pat > 0 THEN 'doublehet' ELSE 'het' END AS context FROM c")
def deletion_context(spark, sf_dir):
    people = p.pedigree(spark, sf_dir).where("mother is not null").select("family", "individual")
    own = p.interval(spark, sf_dir).select(F.floor(F.col("start_pos") / 30).alias("iv_id"), F.col("sample").alias("individual"), "is_mat")
    return deletions.context(own.join(people, "individual"))


AF_SQL = "WITH " + p.GENOTYPE_SQL + ", counts AS (SELECT chrom, pos, CAST(sum(CASE WHEN gt = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_ref, CAST(sum(CASE WHEN gt = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_het, CAST(sum(CASE WHEN gt = 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_hom, CAST(sum(CASE WHEN gt = -1 THEN 1 ELSE 0 END) AS BIGINT) AS n_missing FROM genotype GROUP BY chrom, pos)"


@query(AF_SQL + " SELECT *, round(coalesce((n_het + 2 * n_hom) / nullif(CAST(2 * (n_ref + n_het + n_hom) AS DOUBLE), 0), 0), 6) AS af FROM counts")
def allele_frequency(spark, sf_dir):
    return genotypes.allele_frequency(p.genotype(spark, sf_dir))


@query(AF_SQL + ", t AS (SELECT *, n_ref + n_het + n_hom AS n, 2 * n_ref + n_het AS a, n_het + 2 * n_hom AS b FROM counts WHERE n_ref + n_het + n_hom > 0) SELECT chrom, pos, n_ref, n_het, n_hom, round(a * a / (4.0::DOUBLE * n), 4) AS e_ref, round(a * b / (2.0::DOUBLE * n), 4) AS e_het, round(b * b / (4.0::DOUBLE * n), 4) AS e_hom, round(n * CAST((4 * n_ref * n_hom - n_het * n_het) * (4 * n_ref * n_hom - n_het * n_het) AS DOUBLE) / nullif(a * a * b * b, 0), 5) AS chi2 FROM t")
def hardy_weinberg(spark, sf_dir):
    return genotypes.hardy_weinberg(p.genotype(spark, sf_dir)).withColumns({"chi2": F.round("chi2", 5), **{f"e_{k}": F.round(f"e_{k}", 4) for k in ("ref", "het", "hom")}})


@query("WITH " + p.GENOTYPE_SQL + " SELECT sample, count(*) AS n_calls, CAST(sum(CASE WHEN gt = -1 THEN 1 ELSE 0 END) AS BIGINT) AS n_missing FROM genotype GROUP BY sample")
def genotype_missingness(spark, sf_dir):
    return p.genotype(spark, sf_dir).groupBy("sample").agg(F.count("*").alias("n_calls"), F.count_if(F.col("gt") == -1).alias("n_missing"))


@query("WITH " + p.SITE_SQL + ", c AS (SELECT *, count(*) OVER (PARTITION BY chrom, pos) AS n FROM site) SELECT rec, chrom, pos, is_snp, is_pass FROM c WHERE n = 1 AND is_snp AND is_pass")
def multiallelic_filter(spark, sf_dir):
    return genotypes.usable_sites(p.site(spark, sf_dir))


@query("WITH " + p.SITE_SQL + ", c AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY rec) AS n FROM site) SELECT rec, chrom, pos, is_snp, is_pass FROM c WHERE n = 1")
def keep_first_site(spark, sf_dir):
    return genotypes.keep_first(p.site(spark, sf_dir), ["rec"])


@query("WITH " + p.SITE_SQL + ", d AS (SELECT DISTINCT chrom, pos + 2 AS pos FROM site), w AS (SELECT chrom, pos, coalesce(lag(pos) OVER (PARTITION BY chrom ORDER BY pos) + 1, 1) AS b, lead(pos) OVER (PARTITION BY chrom ORDER BY pos) AS nx FROM d), parts AS (SELECT chrom, b AS start_pos, pos AS end_pos, 0 AS is_site FROM w UNION ALL SELECT chrom, pos, pos + 1, 1 FROM w UNION ALL SELECT chrom, pos + 1, 1000000, 0 FROM w WHERE nx IS NULL) SELECT chrom, start_pos, end_pos, is_site FROM parts WHERE start_pos < end_pos")
def interleave_gaps(spark, sf_dir):
    sites = p.site(spark, sf_dir).select("chrom", (F.col("pos") + 2).alias("pos")).distinct()
    return genotypes.interleave_gaps(sites, F.lit(1_000_000), ["chrom"])


TRIO_SQL = "WITH " + p.GENOTYPE_SQL + ", " + p.TRIOS_SQL + ", calls AS (SELECT t.family, t.child, g.chrom, g.pos, g.gt AS c, coalesce(m.gt, 0) AS m, coalesce(f.gt, 0) AS f FROM trios t JOIN genotype g ON t.child = g.sample LEFT JOIN genotype m ON t.mother = m.sample AND g.chrom = m.chrom AND g.pos = m.pos LEFT JOIN genotype f ON t.father = f.sample AND g.chrom = f.chrom AND g.pos = f.pos)"


@query(TRIO_SQL + " SELECT family, child, chrom, pos FROM calls WHERE c = 1 AND m = 0 AND f = 0")
def denovo_candidates(spark, sf_dir):
    return genotypes.denovo_candidates(p.genotype(spark, sf_dir), p.trios(spark, sf_dir))


@query(TRIO_SQL + ", h AS (SELECT chrom, pos, CAST(m = 1 AS INT) + CAST(f = 1 AS INT) AS hets, c - CAST(m = 2 AS INT) - CAST(f = 2 AS INT) AS passed FROM calls WHERE c >= 0 AND m >= 0 AND f >= 0) SELECT chrom, pos, CAST(sum(passed) AS BIGINT) AS n_transmitted, CAST(sum(hets - passed) AS BIGINT) AS n_not_transmitted FROM h WHERE hets > 0 AND passed BETWEEN 0 AND hets GROUP BY chrom, pos")
def tdt_counts(spark, sf_dir):
    return genotypes.transmission_counts(p.genotype(spark, sf_dir), p.trios(spark, sf_dir))


@query("WITH a AS (SELECT o_orderpriority, median(o_totalprice) AS median FROM orders GROUP BY 1), b AS (SELECT o.o_orderkey, o.o_orderpriority, abs(o_totalprice - median) AS d FROM orders o JOIN a USING (o_orderpriority)), c AS (SELECT o_orderpriority, median(d) AS mad FROM b GROUP BY 1) SELECT b.o_orderkey, round(0.6745 * d / nullif(mad, 0), 6) AS score FROM b JOIN c USING (o_orderpriority) WHERE round(0.6745 * d / nullif(mad, 0), 6) > 1.2")
def mad_outliers(spark, sf_dir):
    return association.robust_outliers(p.table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"], 1.2).select("o_orderkey", "score")


@query("SELECT CAST(CASE WHEN o_totalprice = 500000 THEN 49 ELSE floor(o_totalprice / 10000.0) END AS INT) AS bin, count(*) AS n FROM orders WHERE o_totalprice BETWEEN 0 AND 500000 GROUP BY 1")
def histogram(spark, sf_dir):
    """Bins of a fixed range; what lies outside it is in no bin."""
    return association.histogram(p.table(spark, sf_dir, "orders"), F.col("o_totalprice"), 0.0, 500000.0, 50)


@query("WITH w AS (SELECT event_id, user_id, sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS average FROM events) SELECT event_id, user_id, round(average, 4) AS average FROM w")
def moving_average(spark, sf_dir):
    return association.moving_average(p.table(spark, sf_dir, "events"), "value", ["user_id"], ["ts", "event_id"], 2).select("event_id", "user_id", F.round("average", 4).alias("average"))


@query("WITH " + p.SEGMENT_SQL + ", k AS (SELECT family, chrom, seg_id, mat, start_pos, max(CASE WHEN mat IS NOT NULL THEN rn * 4 + mat END) OVER (PARTITION BY family, chrom ORDER BY start_pos, seg_id ROWS UNBOUNDED PRECEDING) AS b, min(CASE WHEN mat IS NOT NULL THEN rn * 4 + mat END) OVER (PARTITION BY family, chrom ORDER BY start_pos, seg_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM (SELECT *, row_number() OVER (PARTITION BY family, chrom ORDER BY start_pos, seg_id) AS rn FROM segment) z) SELECT family, chrom, seg_id, CASE WHEN mat IS NOT NULL THEN mat WHEN a IS NULL OR b IS NULL THEN 0 WHEN a % 4 = b % 4 THEN a % 4 END AS filled FROM k")
def fill_unknown(spark, sf_dir):
    return association.fill_unknown(p.segment(spark, sf_dir), "mat", ["family", "chrom"], ["start_pos", "seg_id"]).select("family", "chrom", "seg_id", "filled")


@query("WITH " + p.SEGMENT_SQL + ", m AS (SELECT *, v % 5 < 3 AS f, lag(v % 5 < 3) OVER (PARTITION BY family, chrom ORDER BY start_pos, seg_id) AS g FROM segment), r AS (SELECT *, sum(CASE WHEN f <> g THEN 1 ELSE 0 END) OVER (PARTITION BY family, chrom ORDER BY start_pos, seg_id ROWS UNBOUNDED PRECEDING) AS run FROM m) SELECT family, chrom, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS n_rows FROM r WHERE f GROUP BY family, chrom, run")
def bad_regions(spark, sf_dir):
    return association.flagged_regions(p.segment(spark, sf_dir), F.col("v") % 5 < 3, ["family", "chrom"], ["start_pos", "seg_id"])


@query("WITH " + p.SEGMENT_SQL + ", m AS (SELECT family, chrom, row_number() OVER w AS rn, coalesce(mat, -1) AS a, coalesce(pat, -1) AS b, lag(coalesce(mat, -1)) OVER w AS a0, lag(coalesce(pat, -1)) OVER w AS b0 FROM segment WINDOW w AS (PARTITION BY family, chrom ORDER BY start_pos, seg_id)) SELECT family, chrom, CAST(sum(CASE WHEN rn > 1 AND a = a0 AND b = b0 THEN 0 ELSE 1 END) AS BIGINT) AS n_tests FROM m GROUP BY family, chrom")
def distinct_tests(spark, sf_dir):
    return association.distinct_tests(p.segment(spark, sf_dir), ["mat", "pat"], ["family", "chrom"], ["start_pos", "seg_id"])


@query("WITH " + p.INTERVAL_SQL + " SELECT chrom, max(end_pos - start_pos) AS peak, max(n) AS n FROM (SELECT *, count(*) OVER (PARTITION BY chrom) AS n FROM interval_) z GROUP BY chrom ORDER BY peak DESC, chrom LIMIT 5")
def top_peaks(spark, sf_dir):
    peaks = p.interval(spark, sf_dir).groupBy("chrom").agg(F.max(F.col("end_pos") - F.col("start_pos")).alias("peak"), F.count("*").alias("n"))
    return peaks.orderBy(F.desc("peak"), "chrom").limit(5)


@query("SELECT l_returnflag AS called, l_linestatus AS truth, count(*) AS n, CAST(sum(l_quantity) AS BIGINT) AS quantity FROM lineitem GROUP BY l_returnflag, l_linestatus")
def confusion_matrix(spark, sf_dir):
    return p.table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("called"), F.col("l_linestatus").alias("truth")).agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("quantity"))


@query("SELECT 'both' AS kind, count(*) AS n FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders) a UNION ALL SELECT 'first', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders) b UNION ALL SELECT 'either', count(*) FROM (SELECT c_custkey FROM customer UNION SELECT o_custkey FROM orders) c")
def set_ops(spark, sf_dir):
    one = p.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    two = p.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"))
    kinds = {"both": one.intersect(two), "first": one.subtract(two), "either": one.union(two).distinct()}
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n") for kind, df in kinds.items()]
    return parts[0].union(parts[1]).union(parts[2])


SESSION_SQL = """WITH e AS (
  SELECT user_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts) AS before FROM events
), s AS (SELECT *, sum(CASE WHEN epoch_us(ts) - epoch_us(before) >= 7200000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, count(*) AS n_recombinations, CAST(floor(min(epoch_us(ts)) / 1000000.0) AS BIGINT) AS first_second, CAST(floor(max(epoch_us(ts)) / 1000000.0) AS BIGINT) AS last_second, count(*) % 2 = 0 AS is_gene_conversion FROM s GROUP BY user_id, g"""


@query(SESSION_SQL)
def session_events(spark, sf_dir):
    from ..streaming.recombination_stream import event_sessions

    events = p.table(spark, sf_dir, "events").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    sessions = event_sessions(events, "2 hours", "1 day", ["user_id"])
    return sessions.select("user_id", "n_recombinations", F.unix_seconds("first_ts").alias("first_second"), F.unix_seconds("last_ts").alias("last_second"), "is_gene_conversion")


TABLE_SQL = "WITH t AS (SELECT l_suppkey, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F') AS a, count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus <> 'F') AS b, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus = 'F') AS c, count(*) FILTER (WHERE l_returnflag <> 'R' AND l_linestatus <> 'F') AS d FROM lineitem GROUP BY l_suppkey)"


def _tables(spark, sf_dir):
    """A 2x2 table for each supplier."""
    one, two = F.col("l_returnflag") == "R", F.col("l_linestatus") == "F"
    items = p.table(spark, sf_dir, "lineitem")
    return items.groupBy("l_suppkey").agg(F.count_if(one & two).alias("a"), F.count_if(one & ~two).alias("b"), F.count_if(~one & two).alias("c"), F.count_if(~one & ~two).alias("d"))


@query(TABLE_SQL + " SELECT l_suppkey, a, b, c, d, round((a + b + c + d) * CAST(a * d - b * c AS DOUBLE) * (a * d - b * c) / nullif(CAST(a + b AS DOUBLE) * (c + d) * (a + c) * (b + d), 0), 6) AS chi2 FROM t")
def chi2_contingency(spark, sf_dir):
    columns = [F.col(x).cast("double") for x in "abcd"]
    return _tables(spark, sf_dir).withColumn("chi2", F.round(stats.chi2_2x2(*columns), 6))


@query(TABLE_SQL + ", q AS (SELECT *, CAST(a AS DOUBLE) / (a + b) AS p1, CAST(c AS DOUBLE) / (c + d) AS p2, CAST(a + c AS DOUBLE) / (a + b + c + d) AS pool FROM t WHERE a + b > 0 AND c + d > 0) SELECT l_suppkey, round((p1 - p2) / nullif(sqrt(pool * (1 - pool) * (1.0 / (a + b) + 1.0 / (c + d))), 0), 5) AS z FROM q")
def two_proportion_z(spark, sf_dir):
    n1, n2 = F.col("a") + F.col("b"), F.col("c") + F.col("d")
    return _tables(spark, sf_dir).where((n1 > 0) & (n2 > 0)).select("l_suppkey", F.round(stats.two_proportion_z(F.col("a"), n1, F.col("c"), n2), 5).alias("z"))


@query(TABLE_SQL + ", q AS (SELECT l_suppkey, a, a + b AS n, a + b + 3.8414588206941245 AS m FROM t WHERE a + b > 0), c AS (SELECT *, (a + 1.9207294103470622) / m AS centre FROM q) SELECT l_suppkey, a, n, round(greatest(centre - 1.959963984540054 * sqrt(centre * (1 - centre) / m), 0), 5) AS low, round(least(centre + 1.959963984540054 * sqrt(centre * (1 - centre) / m), 1), 5) AS high FROM c")
def proportion_intervals(spark, sf_dir):
    rows = _tables(spark, sf_dir).select("l_suppkey", "a", (F.col("a") + F.col("b")).alias("n")).where("n > 0")
    low, high = stats.agresti_coull(F.col("a"), F.col("n"))
    return rows.select("l_suppkey", "a", "n", F.round(low, 5).alias("low"), F.round(high, 5).alias("high"))


@query(TABLE_SQL + """, b AS (SELECT a, n, unnest(range(0, n + 1)) AS i FROM (SELECT DISTINCT a, a + b AS n FROM t) z
), bm AS (SELECT a, n, i, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2) AS l, lgamma(n + 1) - lgamma(a + 1) - lgamma(n - a + 1) - n * ln(2) AS own FROM b
), bp AS (SELECT a, n, least(sum(CASE WHEN l <= own + 1e-7 THEN exp(l) ELSE 0 END), 1) AS binomial_p FROM bm GROUP BY a, n
), f AS (SELECT a, b, c, d, unnest(range(greatest(0, a - d), least(a + b, a + c) + 1)) AS i FROM (SELECT DISTINCT a, b, c, d FROM t) z
), fm AS (SELECT a, b, c, d, i, lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) + lgamma(c + d + 1) - lgamma(a + c - i + 1) - lgamma(d - a + i + 1) AS l, lgamma(a + b + 1) - lgamma(a + 1) - lgamma(b + 1) + lgamma(c + d + 1) - lgamma(c + 1) - lgamma(d + 1) AS own, lgamma(a + b + c + d + 1) - lgamma(a + c + 1) - lgamma(b + d + 1) AS whole FROM f
), fp AS (SELECT a, b, c, d, least(sum(CASE WHEN l <= own + 1e-7 THEN exp(l - whole) ELSE 0 END), 1) AS fisher_p FROM fm GROUP BY a, b, c, d
) SELECT l_suppkey, t.a, t.b, t.c, t.d, bp.n, round(binomial_p, 6) AS binomial_p, round(fisher_p, 6) AS fisher_p FROM t JOIN bp ON t.a = bp.a AND t.a + t.b = bp.n JOIN fp ON t.a = fp.a AND t.b = fp.b AND t.c = fp.c AND t.d = fp.d""")
def exact_tests(spark, sf_dir):
    rows = _tables(spark, sf_dir).withColumn("n", F.col("a") + F.col("b")).withColumn("half", F.lit(0.5))
    rows = stats.on_distinct(rows, ["a", "n", "half"], "binomial_p", stats.binomial_p)
    rows = stats.on_distinct(rows, ["a", "b", "c", "d"], "fisher_p", stats.fisher_p)
    return rows.drop("half").withColumns({c: F.round(c, 6) for c in ("binomial_p", "fisher_p")})


@query()
def chi2_p_values(spark, sf_dir):
    rows = chi2_contingency(spark, sf_dir).withColumn("dof", F.lit(1))
    return stats.on_distinct(rows, ["chi2", "dof"], "p", stats.chi2_p).drop("dof")


@query("SELECT round(corr(l_quantity, l_extendedprice), 6) AS r, count(*) AS n FROM lineitem")
def pearson(spark, sf_dir):
    return p.table(spark, sf_dir, "lineitem").agg(F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.count("*").alias("n"))


@query("WITH v AS (SELECT CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS g, o_totalprice AS x FROM orders), s AS (SELECT count(CASE WHEN g = 0 THEN x END) AS n0, count(CASE WHEN g = 1 THEN x END) AS n1, avg(CASE WHEN g = 0 THEN x END) AS m0, avg(CASE WHEN g = 1 THEN x END) AS m1, var_samp(CASE WHEN g = 0 THEN x END) / count(CASE WHEN g = 0 THEN x END) AS s0, var_samp(CASE WHEN g = 1 THEN x END) / count(CASE WHEN g = 1 THEN x END) AS s1 FROM v) SELECT n0, n1, round((m1 - m0) / sqrt(s0 + s1), 5) AS t, round((s0 + s1) * (s0 + s1) / (s0 * s0 / (n0 - 1) + s1 * s1 / (n1 - 1)), 3) AS dof FROM s")
def welch_t(spark, sf_dir):
    rows = p.table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("g"), "o_totalprice")
    return stats.welch(rows, "o_totalprice", "g").select("n0", "n1", F.round("t", 5).alias("t"), F.round("dof", 3).alias("dof"))


@query("WITH v AS (SELECT o_totalprice AS x, sum(CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END) AS a, sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS b FROM orders GROUP BY 1), r AS (SELECT abs(sum(a) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) / CAST((SELECT sum(a) FROM v) AS DOUBLE) - sum(b) OVER (ORDER BY x ROWS UNBOUNDED PRECEDING) / CAST((SELECT sum(b) FROM v) AS DOUBLE)) AS d FROM v) SELECT round(max(d), 6) AS ks FROM r")
def ks_two_sample(spark, sf_dir):
    rows = p.table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("g"), "o_totalprice")
    return stats.ks_statistic(rows, "o_totalprice", "g").select(F.round("ks", 6).alias("ks"))


@query()
def phase_quads(spark, sf_dir):
    """Segments of quads of suppliers over the genotype projection, by the family model."""
    members = p.table(spark, sf_dir, "supplier").selectExpr("cast(floor(s_suppkey / 4) as bigint) as family", "s_suppkey as sample", "cast(s_suppkey % 4 as int) as place")
    config = PhaseConfig()
    found = hmm.observations(p.genotype(spark, sf_dir), members)
    return hmm.phase(found, hmm.uniform_costs(4, 1), 2, config)


@query("WITH " + p.INTERVAL_SQL + ", c AS (SELECT chrom, CAST(sum(is_mat) AS BIGINT) AS k, count(*) AS n FROM interval_ GROUP BY chrom), g AS (SELECT chrom, k, n, t, (k + 1) * ln(t) + (n - k + 1) * ln(1 - t) AS l FROM (SELECT chrom, k, n, unnest(range(1, 200)) / 200.0 AS t FROM c) z), m AS (SELECT *, exp(l - max(l) OVER (PARTITION BY chrom)) AS w FROM g) SELECT chrom, k, n, round(sum(t * w) / sum(w), 6) AS posterior_mean, round(sum(CASE WHEN t > 0.5 THEN w ELSE 0 END) / sum(w), 6) AS above_half FROM m GROUP BY chrom, k, n")
def bayes_tdt(spark, sf_dir):
    counts = p.interval(spark, sf_dir).groupBy("chrom").agg(F.sum("is_mat").alias("k"), F.count("*").alias("n"))
    return inference.transmission_posterior(counts)


def _density_sql(bandwidth: float, fit: str, out: str) -> str:
    reach, w = int(4 * bandwidth) + 1, f"{2 * bandwidth * bandwidth}"
    return EVENT_SQL + f""", counts AS (SELECT f.family, CAST(coalesce(m, 0) AS BIGINT) AS x, CAST(coalesce(p, 0) AS BIGINT) AS y FROM (SELECT DISTINCT user_id AS family FROM events) f LEFT JOIN (SELECT family, sum(side) AS m, sum(1 - side) AS p FROM event WHERE n % 2 = 1 GROUP BY family) c ON f.family = c.family
), usual AS (SELECT x, y, count(*) AS n FROM counts WHERE {fit} GROUP BY x, y), wanted AS (SELECT DISTINCT x, y FROM counts
), dens AS (SELECT w.x, w.y, max(CASE WHEN u.x = w.x AND u.y = w.y THEN u.n ELSE 0 END) AS n, sum(CASE WHEN abs(u.x - w.x) <= {reach} AND abs(u.y - w.y) <= {reach} THEN u.n * exp(-((u.x - w.x) * (u.x - w.x) + (u.y - w.y) * (u.y - w.y)) / {w}) ELSE 0 END) / ((SELECT sum(n) FROM usual) * 2 * pi() * {bandwidth * bandwidth}) AS density FROM wanted w CROSS JOIN usual u GROUP BY w.x, w.y
), logs AS (SELECT *, CASE WHEN density > 0 THEN log10(density) END AS l FROM dens), ends AS (SELECT min(l) AS lo, (max(l) - min(l)) / 10 AS step FROM logs WHERE n > 0
), hist AS (SELECT lo + b * step AS edge, log10(sum(n)) AS log_n FROM (SELECT n, lo, step, least(floor((l - lo) / step), 9) AS b FROM logs, ends WHERE n > 0) z GROUP BY b, lo, step
), line AS (SELECT regr_slope(log_n, edge) AS m, regr_intercept(log_n, edge) AS b FROM hist), found AS (SELECT x, y, n, density, l, coalesce(l < -b / m, true) AS is_outlier FROM logs, line) {out}"""


@query(_density_sql(1.0, "true", "SELECT x, y, CAST(n AS BIGINT) AS n, round(density, 8) AS density, round(l, 6) AS log_density, is_outlier FROM found"))
def kde_outliers(spark, sf_dir):
    found = inference.density_outliers(crossover_counts(spark, sf_dir), "maternal_crossovers", "paternal_crossovers", 1.0)
    return found.withColumns({"density": F.round("density", 8), "log_density": F.round("log_density", 6)})


@query(_density_sql(10.0, "x >= 5 AND y >= 5 AND x <= 3 * (SELECT median(x) FROM counts) AND y <= 3 * (SELECT median(y) FROM counts)", "SELECT x AS maternal_crossovers, y AS paternal_crossovers, is_outlier FROM found"))
def crossover_outliers(spark, sf_dir):
    """The SQL knows the bandwidth of 10 only, which a maternal median above 10 asks for."""
    return inference.crossover_outliers(crossover_counts(spark, sf_dir))


@query()
def permutation_test(spark, sf_dir):
    burden = p.interval(spark, sf_dir).groupBy(F.col("sample").alias("individual")).agg(F.count("*").alias("value"))
    people = p.pedigree(spark, sf_dir).select("family", "individual", "phenotype").join(burden, "individual", "left").na.fill(0, ["value"])
    return inference.permutation_test(people, 100)


@query()
def logistic_regression(spark, sf_dir):
    rows = p.table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "F").cast("int").alias("y"), (F.col("o_totalprice") / 100000).alias("price"), (F.col("o_custkey") % 2).alias("parity"))
    return spark.createDataFrame(inference.logistic(rows, ["price", "parity"], "y"), "term string, coefficient double, std_error double, p double")


@query("SELECT round(regr_slope(o_totalprice, o_custkey), 6) AS slope, round(regr_intercept(o_totalprice, o_custkey), 4) AS intercept, round(regr_r2(o_totalprice, o_custkey), 8) AS r2 FROM orders")
def linear_fit(spark, sf_dir):
    return p.table(spark, sf_dir, "orders").agg(F.expr("round(regr_slope(o_totalprice, o_custkey), 6)").alias("slope"), F.expr("round(regr_intercept(o_totalprice, o_custkey), 4)").alias("intercept"), F.expr("round(regr_r2(o_totalprice, o_custkey), 8)").alias("r2"))


@query("WITH RECURSIVE " + p.INTERVAL_SQL + """, d AS (SELECT chrom, start_pos, end_pos, min(iv_id) AS name, row_number() OVER (PARTITION BY chrom ORDER BY start_pos, end_pos) AS rn FROM interval_ GROUP BY chrom, start_pos, end_pos
), r AS (SELECT chrom, rn, name, name AS cluster, [{'s': start_pos, 'e': end_pos, 'n': name}] AS heads FROM d WHERE rn = 1
  UNION ALL SELECT chrom, rn, name, coalesce(hit.n, name), CASE WHEN hit IS NULL THEN list_append(heads, {'s': start_pos, 'e': end_pos, 'n': name}) ELSE heads END
  FROM (SELECT d.chrom, d.rn, d.name, d.start_pos, d.end_pos, list_filter(r.heads, lambda h: h.e > d.start_pos) AS heads,
          list_filter(r.heads, lambda h: 2 * (least(h.e, d.end_pos) - greatest(h.s, d.start_pos)) >= d.end_pos - d.start_pos AND 2 * (least(h.e, d.end_pos) - greatest(h.s, d.start_pos)) >= h.e - h.s)[1] AS hit
        FROM r JOIN d ON d.chrom = r.chrom AND d.rn = r.rn + 1) z
) SELECT i.iv_id, r.cluster FROM interval_ i JOIN d ON i.chrom = d.chrom AND i.start_pos = d.start_pos AND i.end_pos = d.end_pos JOIN r ON r.chrom = d.chrom AND r.rn = d.rn""")
def deletion_clusters(spark, sf_dir):
    return greedy.first_fit_clusters(p.interval(spark, sf_dir), ["chrom"])


@query("WITH " + p.PEDIGREE_SQL + ", q AS (SELECT a.family, a.individual AS sibling1, b.individual AS sibling2, (a.individual + b.individual) % 3 AS priority FROM pedigree a JOIN pedigree b ON a.family = b.family AND a.individual < b.individual), f AS (SELECT *, row_number() OVER (PARTITION BY family ORDER BY priority, sibling1, sibling2) AS k FROM q), one AS (SELECT * FROM f WHERE k = 1), rest AS (SELECT f.*, row_number() OVER (PARTITION BY f.family ORDER BY f.k) AS j FROM f JOIN one o ON f.family = o.family AND f.sibling1 NOT IN (o.sibling1, o.sibling2) AND f.sibling2 NOT IN (o.sibling1, o.sibling2)) SELECT family, sibling1, sibling2, priority FROM one UNION ALL SELECT family, sibling1, sibling2, priority FROM rest WHERE j = 1")
def disjoint_sibpairs(spark, sf_dir):
    """The SQL takes two pairs at most, as families have four members."""
    pairs = ibd.sibling_pairs(p.pedigree(spark, sf_dir).select("family", "individual")).withColumn("priority", (F.col("sibling1") + F.col("sibling2")) % 3)
    return greedy.each_member_once(pairs)


@query("WITH " + p.SEGMENT_SQL + """, wide AS (SELECT family, chrom, greatest(start_pos - 5000, 0) AS s, end_pos + 5000 AS e FROM segment WHERE is_hard
), reach AS (SELECT *, max(e) OVER (PARTITION BY family, chrom ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM wide
), numbered AS (SELECT *, sum(CASE WHEN s > r THEN 1 ELSE 0 END) OVER (PARTITION BY family, chrom ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM reach)
SELECT family, chrom, min(s) AS start_pos, max(e) AS end_pos FROM numbered GROUP BY family, chrom, g""")
def widened_mask(spark, sf_dir):
    return greedy.widened_mask(p.segment(spark, sf_dir), ["family", "chrom"], F.col("is_hard"), 5000)


@query("WITH r AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_partkey % 2 AS y, l_discount AS s FROM lineitem), c AS (SELECT s, sum(y) AS tp, sum(1 - y) AS fp FROM r GROUP BY s) SELECT s AS score, CAST(sum(tp) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp, CAST(sum(fp) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fp FROM c")
def roc_curve(spark, sf_dir):
    rows = p.table(spark, sf_dir, "lineitem").select(F.col("l_discount").alias("score"), (F.col("l_partkey") % 2).alias("y"))
    return stats.roc_points(rows, "score", "y")


@query("SELECT o_orderpriority, round(percentile_cont(0.025) WITHIN GROUP (ORDER BY o_totalprice), 4) AS low, round(median(o_totalprice), 4) AS middle, round(percentile_cont(0.975) WITHIN GROUP (ORDER BY o_totalprice), 4) AS high FROM orders GROUP BY o_orderpriority")
def quantiles(spark, sf_dir):
    rows = p.table(spark, sf_dir, "orders")
    return rows.groupBy("o_orderpriority").agg(*[F.round(F.percentile("o_totalprice", q), 4).alias(n) for q, n in ((0.025, "low"), (0.5, "middle"), (0.975, "high"))])
