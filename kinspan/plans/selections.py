"""Queries of the selections, matches and summaries, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intervals, stats
from ..operators import deletions, genotypes, ibd, matching, selections, summaries
from ..sources.files import chromosome_arms
from . import projections as p
from .registry import AF_SQL, DELETION_SQL, TRIO_SQL, query

TRACK = ["family", "chrom"]


def _sql(*parts: str) -> str:
    return "WITH " + ", ".join(parts[:-1]) + " " + parts[-1]


@query(_sql(p.SEGMENT_SQL, "SELECT family, count(*) AS n_segments FROM segment GROUP BY family HAVING bool_and(CASE WHEN family % 7 = 3 THEN 6 ELSE 4 END = 4)"))
def standard_families(spark, sf_dir):
    rows = p.segment(spark, sf_dir)
    return selections.standard_families(rows.withColumn("dels", F.array_repeat("m1_del", F.when(F.col("family") % 7 == 3, 6).otherwise(4))))


@query(_sql(p.SEGMENT_SQL, "SELECT family, count(DISTINCT chrom) AS n_chroms, count(DISTINCT chrom) = 3 AS is_fully_phased FROM segment GROUP BY family"))
def fully_phased_families(spark, sf_dir):
    return selections.fully_phased(p.segment(spark, sf_dir), "family", 3)


PAIRS_SQL = "pairs AS (SELECT a.family, a.individual AS sibling1, b.individual AS sibling2, a.individual % 5 <> 0 AS is_fully_phased, a.individual % 7 = 0 AS is_ibd_outlier, b.individual % 11 = 0 AS is_crossover_outlier, CAST(a.phenotype = 2 AS INT) + CAST(b.phenotype = 2 AS INT) AS n_affected FROM pedigree a JOIN pedigree b ON a.family = b.family AND a.individual < b.individual WHERE a.mother IS NOT NULL AND b.mother IS NOT NULL)"


def _pairs(spark, sf_dir):
    people = p.pedigree(spark, sf_dir).where("mother is not null")
    kinds = people.select("family", "phenotype").groupBy("family").agg(F.count_if(F.col("phenotype") == 2).cast("int").alias("n_affected"))
    flags = {"is_fully_phased": F.col("sibling1") % 5 != 0, "is_ibd_outlier": F.col("sibling1") % 7 == 0, "is_crossover_outlier": F.col("sibling2") % 11 == 0}
    return ibd.sibling_pairs(people).withColumns(flags).join(kinds, "family")


@query(_sql(p.PEDIGREE_SQL, PAIRS_SQL, "SELECT * FROM pairs WHERE is_fully_phased AND NOT is_ibd_outlier AND NOT is_crossover_outlier"))
def sound_sibpairs(spark, sf_dir):
    return selections.sound_pairs(_pairs(spark, sf_dir))


@query(_sql(p.PEDIGREE_SQL, PAIRS_SQL, p.INTERVAL_SQL, "SELECT iv_id, child1, child2 FROM (SELECT iv_id, sample AS child1, sample + CASE WHEN sample % 2 = 0 THEN 1 ELSE -1 END AS child2 FROM interval_) e WHERE EXISTS (SELECT 1 FROM pairs q WHERE is_fully_phased AND NOT is_ibd_outlier AND NOT is_crossover_outlier AND least(child1, child2) = q.sibling1 AND greatest(child1, child2) = q.sibling2)"))
def events_of_sound_sibpairs(spark, sf_dir):
    other = F.col("sample") + F.when(F.col("sample") % 2 == 0, 1).otherwise(-1)
    events = p.interval(spark, sf_dir).select("iv_id", F.col("sample").alias("child1"), other.alias("child2"))
    return selections.of_pairs(events, selections.sound_pairs(_pairs(spark, sf_dir)))


@query(_sql(p.SEGMENT_SQL, "SELECT seg_id, CASE WHEN v % 4 < 2 THEN v % 4 END AS mat, CASE WHEN CAST(floor(v / 4.0) AS BIGINT) % 4 >= 2 THEN CAST(floor(v / 4.0) AS BIGINT) % 4 END AS pat FROM segment"))
def masked_upd(spark, sf_dir):
    slots = p.segment(spark, sf_dir).select("seg_id", (F.col("v") % 4).alias("mat"), (F.floor(F.col("v") / 4) % 4).alias("pat"))
    return selections.masked_upd(slots)


@query(_sql(p.INTERVAL_SQL, p.PEDIGREE_SQL, "SELECT i.iv_id, CAST(floor(sample / 4.0) AS BIGINT) AS family FROM interval_ i WHERE end_pos - start_pos >= 20 AND iv_id % 3 <> 0 AND CAST(floor(sample / 4.0) AS BIGINT) IN (SELECT family FROM pedigree GROUP BY family HAVING count(*) = 4)"))
def sound_deletions(spark, sf_dir):
    own = p.interval(spark, sf_dir).withColumns({"family": F.floor(F.col("sample") / 4), "is_hts": F.col("iv_id") % 3 == 0})
    sizes = p.pedigree(spark, sf_dir).groupBy("family").agg(F.count("*").alias("n_members"))
    return selections.sound_deletions(own, sizes, 20, [4]).select("iv_id", "family")


@query(AF_SQL + ", f AS (SELECT chrom, pos, (n_het + 2 * n_hom) / nullif(CAST(2 * (n_ref + n_het + n_hom) AS DOUBLE), 0) AS af FROM counts) SELECT chrom, pos, round(af, 6) AS af FROM f WHERE round(af, 6) > 0.1 AND round(af, 6) <= 0.6 OR af IS NULL")
def rare_sites(spark, sf_dir):
    called = F.col("n_ref") + F.col("n_het") + F.col("n_hom")
    sites = genotypes.class_counts(p.genotype(spark, sf_dir)).select("chrom", "pos", F.round(F.try_divide(F.col("n_het") + 2 * F.col("n_hom"), 2 * called), 6).alias("af"))
    return selections.rare_sites(sites, 0.1, 0.6, keep_unknown=True)


@query(_sql(p.PEDIGREE_SQL, "m AS (SELECT family, individual FROM pedigree UNION SELECT family + 1, individual FROM pedigree WHERE individual % 10 = 0)", "SELECT min(family) AS family, individual FROM m GROUP BY individual HAVING count(*) = 1"))
def members_of_one_family(spark, sf_dir):
    people = p.pedigree(spark, sf_dir).select("family", "individual")
    return selections.in_one_family(people.unionByName(people.where("individual % 10 = 0").withColumn("family", F.col("family") + 1)))


@query(_sql(p.INTERVAL_SQL, p.REGION_SQL, "SELECT iv_id, chrom, start_pos, end_pos FROM interval_ i WHERE NOT EXISTS (SELECT 1 FROM region_ r WHERE r.category = 'Brand#11' AND r.chrom = i.chrom AND i.start_pos < r.end_pos AND r.start_pos < i.end_pos)"))
def outside_centromeres(spark, sf_dir):
    return matching.outside(p.interval(spark, sf_dir), p.region(spark, sf_dir).where("category = 'Brand#11'"), ["chrom"], 64).select("iv_id", "chrom", "start_pos", "end_pos")


@query(_sql(p.GENOTYPE_SQL, "s AS (SELECT chrom, pos, count(*) AS n, CAST(sum(CASE WHEN gt = -1 THEN 1 ELSE 0 END) AS BIGINT) AS n_missing FROM genotype GROUP BY chrom, pos)", "SELECT *, round(n_missing / CAST(n AS DOUBLE), 6) AS missing_share FROM s WHERE n_missing <= 0.1 * n"))
def well_called_sites(spark, sf_dir):
    return selections.well_called(p.genotype(spark, sf_dir), ["chrom", "pos"], 0.1)


@query(_sql(p.PEDIGREE_SQL, PAIRS_SQL, "SELECT family, sibling1, sibling2 FROM pairs WHERE NOT (family % 6 = 1)"))
def pairs_without_twins(spark, sf_dir):
    pairs = _pairs(spark, sf_dir).select("family", "sibling1", "sibling2")
    twins = pairs.where("family % 6 = 1").select(F.col("sibling2").alias("sibling1"), F.col("sibling1").alias("sibling2"))
    return selections.without_listed(pairs, twins)


@query(_sql(p.INTERVAL_SQL, "SELECT iv_id, sample FROM interval_ WHERE end_pos - start_pos < 60 AND sample IN (SELECT sample FROM interval_ GROUP BY sample HAVING count(*) < 12)"))
def without_massive_events(spark, sf_dir):
    return selections.without_massive(p.interval(spark, sf_dir), "sample", 60, 12).select("iv_id", "sample")


@query(_sql(p.INTERVAL_SQL, "n AS (SELECT iv_id, count(*) OVER (PARTITION BY chrom, CAST(floor(start_pos / 300.0) AS BIGINT), CAST(floor(sample / 4.0) AS BIGINT)) AS n FROM interval_)", "SELECT iv_id FROM n WHERE n = 1"))
def single_contributors(spark, sf_dir):
    own = p.interval(spark, sf_dir).select("iv_id", "chrom", F.floor(F.col("start_pos") / 300).alias("part"), F.floor(F.col("sample") / 4).alias("family"))
    return selections.single_contributors(own, ["chrom", "part", "family"]).select("iv_id")


WANTED_SQL = "wanted AS (SELECT DISTINCT CAST(l_partkey % 3 + 1 AS INT) AS chrom, CAST(floor(l_partkey * 3 / 2.0) AS BIGINT) AS pos FROM lineitem WHERE l_linenumber = 1)"


def _wanted(spark, sf_dir):
    return p.table(spark, sf_dir, "lineitem").where("l_linenumber = 1").selectExpr("cast(l_partkey % 3 + 1 as int) as chrom", "cast(floor(l_partkey * 3 / 2) as bigint) as pos")


@query(_sql(p.SITE_SQL, WANTED_SQL, "SELECT rec, chrom, pos FROM site s WHERE EXISTS (SELECT 1 FROM wanted w WHERE w.chrom = s.chrom AND w.pos = s.pos)"))
def listed_sites(spark, sf_dir):
    return selections.listed_sites(p.site(spark, sf_dir), _wanted(spark, sf_dir))[0].select("rec", "chrom", "pos")


@query(_sql(p.SITE_SQL, WANTED_SQL, "SELECT chrom, pos FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM site s WHERE w.chrom = s.chrom AND w.pos = s.pos)"))
def absent_sites(spark, sf_dir):
    return selections.listed_sites(p.site(spark, sf_dir), _wanted(spark, sf_dir))[1]


@query(_sql(p.GENOTYPE_SQL, p.TRIOS_SQL, "SELECT sample, count(*) AS n_calls FROM genotype WHERE sample NOT IN (SELECT mother FROM trios WHERE family % 2 = 0) GROUP BY sample"))
def blanked_parents(spark, sf_dir):
    mothers = p.trios(spark, sf_dir).where("family % 2 = 0").select(F.col("mother").alias("sample"))
    return selections.without_samples(p.genotype(spark, sf_dir), mothers).groupBy("sample").agg(F.count("*").alias("n_calls"))


@query(_sql(p.PEDIGREE_SQL, "f AS (SELECT DISTINCT family FROM pedigree)", "SELECT family, CAST(floor((row_number() OVER (ORDER BY family) - 1) / 50.0) AS BIGINT) AS batch FROM f"))
def family_batches(spark, sf_dir):
    return selections.family_batches(p.pedigree(spark, sf_dir), 50, 1000)


@query(_sql(p.INTERVAL_SQL, "SELECT i.iv_id, concat('new', CAST(sample * 2 AS VARCHAR)) AS sample FROM interval_ i WHERE sample % 5 <> 0"))
def mapped_samples(spark, sf_dir):
    ids = p.table(spark, sf_dir, "customer").where("c_custkey % 5 <> 0").select(F.concat(F.lit("s."), F.col("c_custkey").cast("string")).alias("old"), F.concat(F.lit("new"), (F.col("c_custkey") * 2).cast("string")).alias("new"))
    own = p.interval(spark, sf_dir).select("iv_id", F.concat(F.lit("s_"), F.col("sample").cast("string")).alias("sample"))
    return selections.mapped_ids(own, ids, "sample")


@query(_sql(p.SITE_SQL, "moved AS (SELECT rec, is_snp, is_pass, chrom, CAST(floor(pos / 2.0) AS BIGINT) + 100 AS pos FROM site WHERE rec % 9 <> 4), n AS (SELECT *, row_number() OVER (PARTITION BY chrom, pos ORDER BY rec) AS k FROM moved)", "SELECT rec, chrom, pos, is_snp, is_pass FROM n WHERE k = 1"))
def lifted_sites(spark, sf_dir):
    sites = p.site(spark, sf_dir)
    exchange = sites.where("rec % 9 <> 4").select("rec", F.col("chrom").alias("new_chrom"), (F.floor(F.col("pos") / 2) + 100).alias("new_pos"))
    return selections.lifted(sites, exchange, ["rec"]).select("rec", "chrom", "pos", "is_snp", "is_pass")


@query(_sql(p.INTERVAL_SQL, "r AS (SELECT chrom, iv_id, end_pos - start_pos AS peak, row_number() OVER (PARTITION BY chrom ORDER BY end_pos - start_pos DESC, iv_id) AS k FROM interval_)", "SELECT chrom, peak, iv_id FROM r WHERE k = 1"))
def peak_positions(spark, sf_dir):
    return selections.peak(p.interval(spark, sf_dir), ["chrom"], F.col("end_pos") - F.col("start_pos"), "iv_id")


MARKER_SQL = "marker AS (SELECT DISTINCT CAST(l_suppkey % 22 + 1 AS INT) AS chrom, CAST(floor(epoch_us(l_shipdate) / 86400000000.0) AS BIGINT) AS pos FROM lineitem)"


@query(_sql(MARKER_SQL, p.REGION_SQL, "SELECT chrom, pos FROM marker m WHERE EXISTS (SELECT 1 FROM region_ r WHERE r.chrom = m.chrom AND m.pos BETWEEN r.start_pos AND r.end_pos)"))
def markers_in_regions(spark, sf_dir):
    markers = p.table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 22 + 1).cast("int").alias("chrom"), p.day("l_shipdate").alias("pos")).distinct()
    return intervals.covered_points(markers, p.region(spark, sf_dir), ["chrom"], 256)


@query(_sql(p.INTERVAL_SQL, p.REGION_SQL, "c AS (SELECT * FROM interval_), t AS (SELECT * FROM region_), pairs AS (SELECT iv_id, region_id AS truth_id, least(c.end_pos, t.end_pos) - greatest(c.start_pos, t.start_pos) AS n, c.end_pos - c.start_pos AS cl, t.end_pos - t.start_pos AS tl FROM c JOIN t ON c.chrom = t.chrom AND c.start_pos < t.end_pos AND t.start_pos < c.end_pos)", "SELECT iv_id, truth_id, round(n / CAST(cl AS DOUBLE), 6) AS call_share, round(n / CAST(tl AS DOUBLE), 6) AS truth_share FROM pairs UNION ALL SELECT NULL, region_id, NULL, NULL FROM t WHERE region_id NOT IN (SELECT truth_id FROM pairs) UNION ALL SELECT iv_id, NULL, NULL, NULL FROM c WHERE iv_id NOT IN (SELECT iv_id FROM pairs)"))
def truth_matches(spark, sf_dir):
    truth = p.region(spark, sf_dir).withColumnRenamed("region_id", "truth_id")
    return matching.truth_matches(p.interval(spark, sf_dir), truth, ["chrom"], 64)


@query("SELECT c_custkey AS family, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F') AS in_second FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def families_in_both(spark, sf_dir):
    orders = p.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("family"), "o_orderstatus")
    first = p.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("family")).join(orders.where("o_orderstatus = 'O'").select("family"), "family", "left_semi")
    second = orders.where("o_orderstatus = 'F'").select("family")
    both = first.join(second, "family", "left_semi").withColumn("in_second", F.lit(True))
    return both.unionByName(first.join(second, "family", "left_anti").withColumn("in_second", F.lit(False)))


@query(_sql(p.INTERVAL_SQL, p.REGION_SQL, "h AS (SELECT region_id, sum((least(i.end_pos, r.end_pos) - greatest(i.start_pos, r.start_pos)) / CAST(i.end_pos - i.start_pos AS DOUBLE)) AS w FROM region_ r JOIN interval_ i ON i.chrom = r.chrom AND i.start_pos < r.end_pos AND r.start_pos < i.end_pos GROUP BY region_id)", "SELECT r.region_id AS window_id, round(coalesce(w, 0), 3) AS weight FROM region_ r LEFT JOIN h USING (region_id)"))
def fractional_overlap(spark, sf_dir):
    windows = p.region(spark, sf_dir).withColumnRenamed("region_id", "window_id")
    return matching.fractional_overlap(windows, p.interval(spark, sf_dir), ["chrom"], 256).withColumn("weight", F.round("weight", 3))


@query(_sql(p.INTERVAL_SQL, p.REGION_SQL, "SELECT DISTINCT i.iv_id, r.region_id AS pair_id FROM interval_ i JOIN region_ r ON i.chrom = r.chrom WHERE (i.start_pos >= r.start_pos AND i.start_pos < r.end_pos AND i.end_pos >= r.start_pos + 40 AND i.end_pos < r.end_pos + 40) OR (i.end_pos >= r.start_pos AND i.end_pos < r.end_pos AND i.start_pos >= r.start_pos + 40 AND i.start_pos < r.end_pos + 40)"))
def paired_breakpoints(spark, sf_dir):
    one = p.region(spark, sf_dir).select("chrom", F.col("region_id").alias("pair_id"), F.lit(1).alias("arm"), "start_pos", "end_pos")
    two = one.withColumns({"arm": F.lit(2), "start_pos": F.col("start_pos") + 40, "end_pos": F.col("end_pos") + 40})
    return matching.paired_ends(p.interval(spark, sf_dir), one.unionByName(two), ["chrom"], 16)


@query(_sql(p.INTERVAL_SQL, p.REGION_SQL, "SELECT iv_id FROM interval_ i WHERE EXISTS (SELECT 1 FROM region_ r WHERE r.category = 'Brand#11' AND r.chrom = i.chrom AND i.start_pos < r.end_pos + 30 AND r.start_pos - 30 < i.end_pos)"))
def near_telomeres(spark, sf_dir):
    return matching.near(p.interval(spark, sf_dir), p.region(spark, sf_dir).where("category = 'Brand#11'"), ["chrom"], 128, 30).select("iv_id")


@query(_sql(p.INTERVAL_SQL, "e AS (SELECT iv_id, CAST(floor(sample / 4.0) AS BIGINT) AS family, sample AS child, start_pos, end_pos FROM interval_ WHERE sample % 4 >= 2), kids AS (SELECT CAST(floor(c_custkey / 4.0) AS BIGINT) AS family, count(*) AS n, min(c_custkey) AS first_child FROM customer WHERE c_custkey % 4 >= 2 GROUP BY 1), seen AS (SELECT a.iv_id, a.family, a.child, count(DISTINCT b.child) AS n_seen FROM e a JOIN e b ON a.family = b.family AND a.start_pos < b.end_pos AND b.start_pos < a.end_pos GROUP BY 1, 2, 3)", "SELECT iv_id, CASE WHEN n > 1 AND n_seen = n THEN first_child ELSE child END AS child FROM seen JOIN kids USING (family)"))
def transferred_events(spark, sf_dir):
    events = p.interval(spark, sf_dir).where("sample % 4 >= 2").select("iv_id", F.floor(F.col("sample") / 4).alias("family"), F.lit("all").alias("chrom"), F.col("sample").alias("child"), "start_pos", "end_pos")
    children = p.pedigree(spark, sf_dir).where("role >= 2").select("family", F.col("individual").alias("child"))
    return matching.transferred(events, children, 64)


@query(_sql(p.SEGMENT_SQL, "pieces AS (SELECT family, chrom, mat = mat_other AS code, (family + b) % 2 = 0 AS r_code, least(end_pos, (b + 1) * 50000) - greatest(start_pos, b * 50000) AS n FROM (SELECT *, unnest(range(CAST(floor(start_pos / 50000.0) AS BIGINT), CAST(floor((end_pos - 1) / 50000.0) AS BIGINT) + 1)) AS b FROM segment WHERE start_pos < end_pos) x WHERE b % 5 <> 0)", "SELECT family, chrom, CAST(sum(n) AS BIGINT) AS known_bases, CAST(sum(CASE WHEN code = r_code THEN n ELSE 0 END) AS BIGINT) AS equal_bases, round(sum(CASE WHEN code = r_code THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) AS concordance FROM pieces WHERE code IS NOT NULL GROUP BY family, chrom"))
def track_concordance(spark, sf_dir):
    own = p.segment(spark, sf_dir).where("start_pos < end_pos")
    one = own.withColumn("code", F.col("mat") == F.col("mat_other"))
    grid = own.select(*TRACK).distinct().withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(p.AXIS_END // 50_000))))
    two = grid.select(*TRACK, (F.col("b") * 50_000).alias("start_pos"), ((F.col("b") + 1) * 50_000).alias("end_pos"), F.when(F.col("b") % 5 != 0, (F.col("family") + F.col("b")) % 2 == 0).alias("code"))
    return matching.track_concordance(one, two, TRACK, 100_000)


@query(_sql(p.INTERVAL_SQL, p.REGION_SQL, "c AS (SELECT DISTINCT iv_id, category, is_mat AS m FROM interval_ i JOIN region_ r ON i.chrom = r.chrom AND i.start_pos < r.end_pos AND r.start_pos < i.end_pos), s AS (SELECT category, count(*) AS n, CAST(sum(m) AS BIGINT) AS k FROM c GROUP BY category), q AS (SELECT *, n + 3.8414588206941245 AS mo, (k + 1.9207294103470622) / (n + 3.8414588206941245) AS ce FROM s)", "SELECT category, n, k, round(k / CAST(n AS DOUBLE), 5) AS precision_, round(greatest(ce - 1.959963984540054 * sqrt(ce * (1 - ce) / mo), 0), 5) AS low, round(least(ce + 1.959963984540054 * sqrt(ce * (1 - ce) / mo), 1), 5) AS high FROM q"))
def precision_by_class(spark, sf_dir):
    called = p.interval(spark, sf_dir).withColumn("is_match", F.col("is_mat"))
    found = matching.class_rates(called, p.region(spark, sf_dir), ["chrom"], 256)
    return found.withColumns({c: F.round(c, 5) for c in ("precision_", "low", "high")})


@query(_sql(p.INTERVAL_SQL, p.REGION_SQL, "SELECT i.iv_id, r.region_id AS r_iv_id FROM interval_ i JOIN region_ r ON i.chrom = r.chrom AND 2 * (least(i.end_pos, r.end_pos) - greatest(i.start_pos, r.start_pos)) > i.end_pos - i.start_pos AND 2 * (least(i.end_pos, r.end_pos) - greatest(i.start_pos, r.start_pos)) > r.end_pos - r.start_pos"))
def half_overlapping(spark, sf_dir):
    return matching.half_overlapping(p.interval(spark, sf_dir), p.region(spark, sf_dir).withColumnRenamed("region_id", "iv_id"), ["chrom"])


@query(_sql(p.INTERVAL_SQL, "steps AS (SELECT chrom, pos, sum(n) AS n, sum(m) AS m FROM (SELECT chrom, start_pos AS pos, 1 AS n, is_mat AS m FROM interval_ UNION ALL SELECT chrom, end_pos, -1, -is_mat FROM interval_) x GROUP BY chrom, pos), s AS (SELECT lead(pos) OVER w - pos AS len, sum(n) OVER w AS n, sum(m) OVER w AS m FROM steps WINDOW w AS (PARTITION BY chrom ORDER BY pos))", "SELECT CAST(n AS BIGINT) AS n_children, CAST(sum(len) AS BIGINT) AS bases, CAST(sum(len * m) AS BIGINT) AS inherited, CAST(sum(len * (n - m)) AS BIGINT) AS not_inherited FROM s WHERE len IS NOT NULL AND n > 0 GROUP BY n"))
def inheritance_by_children(spark, sf_dir):
    return summaries.inheritance_by_children(p.interval(spark, sf_dir).withColumn("is_inherited", F.col("is_mat") == 1), ["chrom"], 256)


@query(_sql(p.INTERVAL_SQL, "c AS (SELECT is_mat, greatest(start_pos - 9131, 0) AS s, least(end_pos - 9131, 500) AS e, end_pos - start_pos AS len FROM interval_), d AS (SELECT *, unnest(range(CAST(floor(s / 50.0) AS BIGINT), CAST(floor((e - 1) / 50.0) AS BIGINT) + 1)) AS bin FROM c WHERE s < e), b AS (SELECT is_mat, bin, sum(floor(1000000 * (least(e, (bin + 1) * 50) - greatest(s, bin * 50)) / CAST(len AS DOUBLE))) AS w FROM d GROUP BY is_mat, bin)", "SELECT is_mat, bin, CAST(w AS BIGINT) AS weight, CAST(sum(w) OVER (PARTITION BY is_mat ORDER BY bin ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM b"))
def telomere_density(spark, sf_dir):
    return summaries.distance_density(p.interval(spark, sf_dir), 9131, 500, 50, ["is_mat"])


def _siblings(spark, sf_dir):
    return p.segment(spark, sf_dir).withColumnsRenamed({"mat": "mat_1", "mat_other": "mat_2", "pat": "pat_1", "pat_other": "pat_2"})


@query(_sql(p.SEGMENT_SQL, p.PEDIGREE_SQL, PAIRS_SQL, "k AS (SELECT n_affected, mat = mat_other AS m, pat = pat_other AS q, end_pos - start_pos AS n FROM segment JOIN pairs USING (family) WHERE mat = mat_other IS NOT NULL AND (pat = pat_other) IS NOT NULL)", "SELECT n_affected, CAST(sum(CASE WHEN m AND q THEN n ELSE 0 END) AS BIGINT) AS \"both\", CAST(sum(CASE WHEN m AND NOT q THEN n ELSE 0 END) AS BIGINT) AS maternal_only, CAST(sum(CASE WHEN NOT m AND q THEN n ELSE 0 END) AS BIGINT) AS paternal_only, CAST(sum(CASE WHEN NOT m AND NOT q THEN n ELSE 0 END) AS BIGINT) AS neither FROM k WHERE m IS NOT NULL AND q IS NOT NULL GROUP BY n_affected"))
def sibling_concordance(spark, sf_dir):
    return summaries.sibling_concordance(_siblings(spark, sf_dir), _pairs(spark, sf_dir))


@query(_sql(p.SEGMENT_SQL, "d AS (SELECT *, unnest(range(CAST(floor(start_pos / 300000.0) AS BIGINT), CAST(floor((end_pos - 1) / 300000.0) AS BIGINT) + 1)) AS bin FROM segment WHERE mat IS NOT NULL AND start_pos < end_pos), s AS (SELECT family, chrom, bin, mat, sum(least(end_pos, (bin + 1) * 300000) - greatest(start_pos, bin * 300000)) AS b FROM d GROUP BY 1, 2, 3, 4), t AS (SELECT *, sum(b) OVER (PARTITION BY family, chrom, bin) AS k FROM s)", "SELECT family, chrom, bin, mat, CAST(b AS BIGINT) AS bases, CAST(k AS BIGINT) AS known_bases FROM t WHERE b > 0.9 * k"))
def majority_state(spark, sf_dir):
    return summaries.majority_state(p.segment(spark, sf_dir), TRACK, "mat", 300_000, 0.9)


RELATED_SQL = "k AS (SELECT family, mat = mat_other AS m, pat = pat_other AS q, end_pos - start_pos AS n FROM segment), r AS (SELECT family, round(sum(CASE WHEN m AND q THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) AS share_both, round(sum(CASE WHEN m <> q THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) AS share_one, round(sum(CASE WHEN m OR q THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) AS share_any FROM k WHERE m IS NOT NULL AND q IS NOT NULL AND n > 0 GROUP BY family)"


@query(_sql(p.SEGMENT_SQL, RELATED_SQL, "SELECT * FROM r"))
def relatedness(spark, sf_dir):
    return summaries.relatedness(_siblings(spark, sf_dir), ["family"])


@query(_sql(p.SEGMENT_SQL, RELATED_SQL, "SELECT round(median(share_both), 6) AS share_both, round(median(share_one), 6) AS share_one, round(median(share_any), 6) AS share_any FROM r"))
def median_relatedness(spark, sf_dir):
    return relatedness(spark, sf_dir).agg(*[F.round(F.median(c), 6).alias(c) for c in ("share_both", "share_one", "share_any")])


@query(_sql(p.GENOTYPE_SQL, "SELECT gt, (pos * 7 + sample * 13) % 60 AS dp, count(*) AS n FROM genotype WHERE (pos + sample) % 4 <> 0 GROUP BY 1, 2"))
def depth_by_class(spark, sf_dir):
    calls = p.genotype(spark, sf_dir)
    return summaries.depth_by_class(calls, calls.where("(pos + sample) % 4 <> 0").select("chrom", "pos", "sample", ((F.col("pos") * 7 + F.col("sample") * 13) % 60).alias("dp")))


@query(_sql(p.GENOTYPE_SQL, p.PEDIGREE_SQL, "m AS (SELECT chrom, pos, family, avg(CASE WHEN phenotype = 2 THEN gt END) - avg(CASE WHEN phenotype = 1 THEN gt END) AS d FROM genotype JOIN pedigree ON sample = individual WHERE gt >= 0 GROUP BY chrom, pos, family)", "SELECT chrom, pos, count(*) FILTER (WHERE d > 0) AS n_more, count(*) FILTER (WHERE d < 0) AS n_fewer FROM m WHERE d IS NOT NULL GROUP BY chrom, pos"))
def sibling_difference(spark, sf_dir):
    children = p.pedigree(spark, sf_dir).select("family", F.col("individual").alias("sample"), "phenotype")
    return summaries.sibling_difference(p.genotype(spark, sf_dir), children)


@query(_sql(p.INTERVAL_SQL, p.REGION_SQL, "s AS (SELECT iv_id, list_sort(list(DISTINCT region_id)) AS m FROM interval_ i JOIN region_ r ON i.chrom = r.chrom AND i.start_pos < r.end_pos AND r.start_pos < i.end_pos GROUP BY iv_id)", "SELECT min(iv_id) AS first_owner, CAST(len(m) AS BIGINT) AS n_members, count(*) AS n_equal FROM s GROUP BY m"))
def equal_collections(spark, sf_dir):
    return summaries.equal_overlaps(p.interval(spark, sf_dir), p.region(spark, sf_dir), ["chrom"], 256)


ARM_SQL = "arm AS (SELECT concat('chr', CAST(chrom AS VARCHAR)) AS chrom, max(CASE WHEN category < 'Brand#3' THEN end_pos END) AS p_end, max(end_pos) AS q_end FROM region_ WHERE chrom <= 3 GROUP BY chrom)"


def _arms(spark, sf_dir):
    bands = p.region(spark, sf_dir).where("chrom <= 3").select(F.concat(F.lit("chr"), F.col("chrom").cast("string")).alias("chrom"), "end_pos", F.when(F.col("category") < "Brand#3", "p1").otherwise("q1").alias("name"))
    return chromosome_arms(bands)


@query(_sql(p.REGION_SQL, ARM_SQL, "SELECT * FROM arm"))
def chromosome_arm_bounds(spark, sf_dir):
    return _arms(spark, sf_dir)


@query(_sql(p.SEGMENT_SQL, p.REGION_SQL, ARM_SQL, "c AS (SELECT family, chrom, mat = mat_other AS m, least(end_pos, p_end * 100) - start_pos AS n FROM segment JOIN arm USING (chrom)), s AS (SELECT family, chrom, CAST(sum(CASE WHEN m THEN n ELSE 0 END) AS BIGINT) AS match, CAST(sum(CASE WHEN NOT m THEN n ELSE 0 END) AS BIGINT) AS mismatch, CAST(sum(CASE WHEN m IS NULL THEN n ELSE 0 END) AS BIGINT) AS unknown FROM c WHERE n > 0 GROUP BY family, chrom)", "SELECT *, CASE WHEN match + mismatch > 0 THEN match > mismatch END AS mostly_matches FROM s"))
def arm_identity(spark, sf_dir):
    arms = _arms(spark, sf_dir).select("chrom", (F.col("p_end") * 100).alias("p_end"))
    return summaries.arm_identity(_siblings(spark, sf_dir), arms, TRACK)


@query(_sql(p.INTERVAL_SQL, "SELECT is_mat, CASE WHEN iv_id % 3 = 0 AND iv_id % 2 = 0 THEN 'both' WHEN iv_id % 3 = 0 THEN 'first_only' WHEN iv_id % 2 = 0 THEN 'second_only' ELSE 'none' END AS shared_by, count(*) AS n, CAST(sum(end_pos - start_pos) AS BIGINT) AS bases FROM interval_ GROUP BY 1, 2"))
def sharing_classes(spark, sf_dir):
    own = p.interval(spark, sf_dir).withColumns({"in_first": F.col("iv_id") % 3 == 0, "in_second": F.col("iv_id") % 2 == 0})
    return summaries.sharing_classes(own, ["is_mat"])


@query(_sql(p.INTERVAL_SQL, "w AS (SELECT chrom, start_pos, end_pos, CAST(floor(1000000.0 / (end_pos - start_pos)) AS BIGINT) AS w FROM interval_), steps AS (SELECT chrom, pos, sum(w) AS w FROM (SELECT chrom, start_pos AS pos, w FROM w UNION ALL SELECT chrom, end_pos, -w FROM w) x GROUP BY chrom, pos), s AS (SELECT chrom, pos AS start_pos, lead(pos) OVER v AS end_pos, CAST(sum(w) OVER v AS BIGINT) AS weight FROM steps WINDOW v AS (PARTITION BY chrom ORDER BY pos))", "SELECT chrom, start_pos, end_pos, weight, round(weight / (1000000.0::DOUBLE * 84), 9) AS rate FROM s WHERE end_pos IS NOT NULL AND weight > 0"))
def meiosis_rate(spark, sf_dir):
    return summaries.meiosis_rate(p.interval(spark, sf_dir), ["chrom"], F.lit(84), 256)


@query(_sql(p.SEGMENT_SQL, "k AS (SELECT chrom, CAST(mat IS NOT NULL AS INT) + CAST(mat_other IS NOT NULL AS INT) AS n_known, mat <> mat_other AS b, end_pos - start_pos AS n FROM segment)", "SELECT chrom, n_known, CAST(sum(n) AS BIGINT) AS bases, CAST(sum(CASE WHEN b THEN n ELSE 0 END) AS BIGINT) AS bases_both, pow(0.5, n_known - 1) AS expected FROM k WHERE n_known > 0 GROUP BY chrom, n_known"))
def haplotypes_seen(spark, sf_dir):
    return summaries.haplotypes_seen(_siblings(spark, sf_dir))


TRANSMISSION_SQL = DELETION_SQL.replace("SELECT family, chrom, start_pos, nx AS end_pos", ", del AS (SELECT family, chrom, start_pos, nx AS end_pos") + """), named AS (SELECT *, row_number() OVER () AS k FROM del
), kids AS (SELECT family, chrom, start_pos, end_pos, 1 AS child, {one} AS phase FROM segment UNION ALL SELECT family, chrom, start_pos, end_pos, 2, {two} FROM segment
), pieces AS (SELECT d.k, d.family, d.chrom, d.start_pos, c.child, phase, least(d.end_pos, c.end_pos) - greatest(d.start_pos, c.start_pos) AS n FROM named d JOIN kids c ON d.family = c.family AND d.chrom = c.chrom AND d.start_pos < c.end_pos AND c.start_pos < d.end_pos WHERE phase IS NOT NULL
) SELECT family, chrom, start_pos, child, CAST(sum(n) AS BIGINT) AS known_bases, CAST(sum(CASE WHEN phase = {hap} THEN n ELSE 0 END) AS BIGINT) AS carried_bases, sum(CASE WHEN phase = {hap} THEN n ELSE 0 END) > 0.9 * sum(n) AS is_transmitted FROM pieces GROUP BY k, family, chrom, start_pos, child"""


def _transmissions(spark, sf_dir, side, haplotype):
    own = p.segment(spark, sf_dir)
    found = deletions.deletions(own, TRACK, "m1_del").where("start_pos < end_pos").withColumn("iv_id", F.struct(*TRACK, "start_pos"))
    tracks = [own.select(*TRACK, "start_pos", "end_pos", F.lit(k).alias("child"), F.col(c).alias("phase")) for k, c in ((1, side), (2, f"{side}_other"))]
    told = summaries.transmissions(found, tracks[0].unionByName(tracks[1]), TRACK, haplotype, 100_000)
    return told.select("iv_id.*", "child", "known_bases", "carried_bases", "is_transmitted")


@query(TRANSMISSION_SQL.format(one="mat", two="mat_other", hap=0))
def maternal_transmissions(spark, sf_dir):
    return _transmissions(spark, sf_dir, "mat", 0)


@query(TRANSMISSION_SQL.format(one="pat", two="pat_other", hap=2))
def paternal_transmissions(spark, sf_dir):
    return _transmissions(spark, sf_dir, "pat", 2)


@query(_sql(p.SEGMENT_SQL, "m AS (SELECT *, v % 5 < 3 AS f, lag(v % 5 < 3) OVER (PARTITION BY family, chrom ORDER BY start_pos, seg_id) AS g FROM segment), r AS (SELECT *, sum(CASE WHEN f <> g THEN 1 ELSE 0 END) OVER (PARTITION BY family, chrom ORDER BY start_pos, seg_id ROWS UNBOUNDED PRECEDING) AS run FROM m)", "SELECT family, chrom, min(start_pos) AS start_pos, max(end_pos) AS end_pos, CAST(sum(end_pos - start_pos) AS BIGINT) AS bases FROM r WHERE f GROUP BY family, chrom, run HAVING sum(end_pos - start_pos) >= 200000"))
def long_runs(spark, sf_dir):
    return summaries.long_runs(p.segment(spark, sf_dir), F.col("v") % 5 < 3, TRACK, ["start_pos", "seg_id"], 200_000)


@query(_sql(p.SITE_SQL, "d AS (SELECT DISTINCT chrom, pos FROM site)", "SELECT chrom, pos, pos - lag(pos) OVER (PARTITION BY chrom ORDER BY pos) AS distance FROM d"))
def site_distances(spark, sf_dir):
    return summaries.distances(p.site(spark, sf_dir).select("chrom", "pos").distinct(), ["chrom"])


@query(_sql(p.INTERVAL_SQL, "c AS (SELECT is_mat, CAST(floor(start_pos / 100.0) AS BIGINT) AS bin, count(*) AS n FROM interval_ GROUP BY 1, 2)", "SELECT *, CAST(sum(n) OVER (PARTITION BY is_mat ORDER BY bin ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative FROM c"))
def cumulative_events(spark, sf_dir):
    return summaries.cumulative(p.interval(spark, sf_dir), F.col("start_pos"), 100, ["is_mat"])


@query(_sql(p.SEGMENT_SQL, "l AS (SELECT family, chrom, start_pos, end_pos, 0 AS child, 0 AS side, coalesce(mat, 7) AS letter FROM segment UNION ALL SELECT family, chrom, start_pos, end_pos, 0, 1, coalesce(pat, 7) FROM segment UNION ALL SELECT family, chrom, start_pos, end_pos, 1, 0, coalesce(mat_other, 7) FROM segment UNION ALL SELECT family, chrom, start_pos, end_pos, 1, 1, coalesce(pat_other, 7) FROM segment), b AS (SELECT *, lag(letter) OVER w AS o, lag(end_pos) OVER w AS e FROM l WHERE start_pos < end_pos WINDOW w AS (PARTITION BY family, chrom, child, side ORDER BY start_pos, end_pos))", "SELECT family, chrom, child, side, e AS start_pos, start_pos AS end_pos FROM b WHERE letter <> o"))
def vector_switches(spark, sf_dir):
    def pair(a, b):
        return F.concat(F.coalesce(F.col(a), F.lit(7)).cast("string"), F.coalesce(F.col(b), F.lit(7)).cast("string"))

    rows = p.segment(spark, sf_dir).where("start_pos < end_pos").select(*TRACK, "start_pos", "end_pos", F.array(pair("mat", "pat"), pair("mat_other", "pat_other")).alias("letters"))
    return summaries.vector_switches(rows, TRACK)


@query(_sql(p.INTERVAL_SQL, p.REGION_SQL, "steps AS (SELECT chrom, pos, sum(n) AS n FROM (SELECT chrom, start_pos AS pos, 1 AS n FROM interval_ UNION ALL SELECT chrom, end_pos, -1 FROM interval_) x GROUP BY chrom, pos), s AS (SELECT chrom, pos AS start_pos, lead(pos) OVER v AS end_pos, CAST(sum(n) OVER v AS BIGINT) AS score FROM steps WINDOW v AS (PARTITION BY chrom ORDER BY pos)), h AS (SELECT *, lag(end_pos) OVER (PARTITION BY chrom ORDER BY start_pos) AS e FROM s WHERE end_pos IS NOT NULL AND score >= (SELECT quantile_disc(score, 0.9) FROM s WHERE end_pos IS NOT NULL)), r AS (SELECT *, sum(CASE WHEN start_pos <> e THEN 1 ELSE 0 END) OVER (PARTITION BY chrom ORDER BY start_pos ROWS UNBOUNDED PRECEDING) AS g FROM h), k AS (SELECT chrom, min(start_pos) AS start_pos, max(end_pos) AS end_pos, max(score) AS score FROM r GROUP BY chrom, g), q AS (SELECT chrom, start_pos, max(region_id) AS region_id FROM region_ GROUP BY chrom, start_pos), a AS (SELECT k.chrom, k.start_pos, arg_max(q.region_id, q.start_pos) AS band FROM k JOIN q ON q.chrom = k.chrom AND q.start_pos <= k.start_pos GROUP BY 1, 2)", "SELECT k.chrom, k.start_pos, k.end_pos, k.score, band FROM k LEFT JOIN a ON k.chrom = a.chrom AND k.start_pos = a.start_pos"))
def peak_intervals(spark, sf_dir):
    scores = intervals.sweep(p.interval(spark, sf_dir), ["chrom"], {"score": F.lit(1)}, 256)
    cutoff = scores.agg(F.expr("percentile_disc(0.9) within group (order by score)")).first()[0] or 0
    bands = p.region(spark, sf_dir).groupBy("chrom", "start_pos").agg(F.max("region_id").alias("band"))
    return summaries.peak_intervals(scores, ["chrom"], int(cutoff), bands)


@query(_sql(p.SEGMENT_SQL, "k AS (SELECT family, chrom, mat = mat_other AS m, lag(mat = mat_other) OVER (PARTITION BY family, chrom ORDER BY start_pos, seg_id) AS o FROM segment WHERE mat IS NOT NULL AND mat_other IS NOT NULL)", "SELECT family, chrom, CAST(sum(CASE WHEN m <> o THEN 1 ELSE 0 END) AS BIGINT) AS n_changes FROM k GROUP BY family, chrom"))
def match_changes(spark, sf_dir):
    return summaries.match_changes(_siblings(spark, sf_dir), TRACK)


@query(TRIO_SQL + ", kid AS (SELECT s_suppkey AS child, 1 + s_nationkey % 2 AS phenotype, 1 + CAST(floor(s_nationkey / 2.0) AS INT) % 2 AS sex FROM supplier) SELECT m AS mother_gt, f AS father_gt, c AS child_gt, phenotype, sex, count(*) AS n FROM calls JOIN kid USING (child) GROUP BY m, f, c, phenotype, sex")
def dosage_states(spark, sf_dir):
    kids = p.table(spark, sf_dir, "supplier").selectExpr("s_suppkey as child", "1 + s_nationkey % 2 as phenotype", "cast(1 + cast(floor(s_nationkey / 2) as int) % 2 as int) as sex")
    return summaries.dosage_states(genotypes.trio_calls(p.genotype(spark, sf_dir), p.trios(spark, sf_dir)), kids)


@query(_sql(p.SEGMENT_SQL, "t AS (SELECT family, round(-2 * sum(ln((v % 100 + 1) / 101.0)), 6) AS statistic, count(*) AS k FROM segment GROUP BY family), s AS (SELECT family, statistic, k, unnest(range(0, k)) AS i FROM t)", "SELECT family, statistic, k, round(sum(exp(i * ln(statistic / 2) - lgamma(i + 1) - statistic / 2)), 6) AS p FROM s GROUP BY family, statistic, k"))
def combined_p_values(spark, sf_dir):
    tests = p.segment(spark, sf_dir).select("family", ((F.col("v") % 100 + 1) / 101.0).alias("p"))
    return stats.fisher_combined(tests, "p", ["family"]).withColumn("p", F.round("p", 6))


@query(_sql(p.SEGMENT_SQL, "n AS (SELECT count(*) AS n FROM (SELECT DISTINCT family, chrom FROM segment) d)", "SELECT n AS n_tests, round(0.05 / n, 9) AS threshold FROM n"))
def bonferroni_threshold(spark, sf_dir):
    return p.segment(spark, sf_dir).select(*TRACK).distinct().agg(F.count("*").alias("n_tests")).withColumn("threshold", F.round(0.05 / F.col("n_tests"), 9))
