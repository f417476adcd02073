"""The domain tables as projections of the driver tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: End of the axis on which events lie, in seconds.
AXIS_END = 2592000
FIRST_SECOND = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def day(ts: str) -> Column:
    return F.datediff(F.to_date(ts), F.lit("1970-01-01").cast("date")).cast("long")


def second(ts: str) -> Column:
    """Seconds since 1970 of a timestamp without zone, whatever the session's zone."""
    return day(ts) * 86400 + F.expr(f"cast(hour({ts}) * 3600 + minute({ts}) * 60 + floor(second({ts})) as bigint)")


def segment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State tracks per family and chromosome; half-open, a second sibling beside the first."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("family"),
        F.concat(F.lit("chr"), (F.col("event_id") % 3 + 1).cast("string")).alias("chrom"),
        F.col("event_id").alias("seg_id"),
        (second("ts") - FIRST_SECOND).alias("start_pos"),
        F.round(F.col("value") * 100).cast("long").alias("v"),
        "event_type",
    )
    events.createOrReplaceTempView("kinspan_events")
    return spark.sql(f"""
        select family, chrom, seg_id, start_pos, end_pos,
          nullif(v % 3 - 1, -1) as mat, case when v % 4 = 3 then null else 2 + v % 2 end as pat,
          nullif(cast(floor(v / 7) as bigint) % 3 - 1, -1) as mat_other, case when cast(floor(v / 5) as bigint) % 4 = 3 then null else 2 + cast(floor(v / 11) as bigint) % 2 end as pat_other,
          event_type = 'error' as is_hard,
          case when rn = 1 or nx is null then 1 when v % 7 < 2 then 0 when v % 11 = 0 then null else 1 end as m1_del, v
        from (select e.*, lead(start_pos) over w as nx, row_number() over w as rn, coalesce(lead(start_pos) over w, {AXIS_END}) as end_pos
              from kinspan_events e window w as (partition by family, chrom order by start_pos, seg_id)) t""")


SEGMENT_SQL = f"""segment AS (
  SELECT family, chrom, seg_id, start_pos, end_pos,
    nullif(v % 3 - 1, -1) AS mat, CASE WHEN v % 4 = 3 THEN NULL ELSE 2 + v % 2 END AS pat,
    nullif(CAST(floor(v / 7.0) AS BIGINT) % 3 - 1, -1) AS mat_other, CASE WHEN CAST(floor(v / 5.0) AS BIGINT) % 4 = 3 THEN NULL ELSE 2 + CAST(floor(v / 11.0) AS BIGINT) % 2 END AS pat_other,
    event_type = 'error' AS is_hard,
    CASE WHEN rn = 1 OR nx IS NULL THEN 1 WHEN v % 7 < 2 THEN 0 WHEN v % 11 = 0 THEN NULL ELSE 1 END AS m1_del, v
  FROM (SELECT e.*, lead(start_pos) OVER w AS nx, row_number() OVER w AS rn, coalesce(lead(start_pos) OVER w, {AXIS_END}) AS end_pos
        FROM (SELECT user_id AS family, concat('chr', CAST(event_id % 3 + 1 AS VARCHAR)) AS chrom, event_id AS seg_id,
                     CAST(floor(epoch_us(ts) / 1000000.0) AS BIGINT) - {FIRST_SECOND} AS start_pos, CAST(round(value * 100) AS BIGINT) AS v, event_type FROM events) e
        WINDOW w AS (PARTITION BY family, chrom ORDER BY start_pos, seg_id)) t)"""


def pedigree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quads of four customers: mother, father and two children."""
    return table(spark, sf_dir, "customer").selectExpr(
        "cast(floor(c_custkey / 4) as bigint) as family",
        "c_custkey as individual",
        "cast(c_custkey % 4 as int) as role",
        "case when c_custkey % 4 < 2 then null else c_custkey - c_custkey % 4 end as mother",
        "case when c_custkey % 4 < 2 then null else c_custkey - c_custkey % 4 + 1 end as father",
        "case when c_custkey % 4 = 0 then 2 when c_custkey % 4 = 1 then 1 else 1 + c_nationkey % 2 end as sex",
        "case when c_mktsegment in ('BUILDING', 'HOUSEHOLD') then 2 else 1 end as phenotype",
    )


PEDIGREE_SQL = """pedigree AS (
  SELECT CAST(floor(c_custkey / 4.0) AS BIGINT) AS family, c_custkey AS individual, CAST(c_custkey % 4 AS INT) AS role,
    CASE WHEN c_custkey % 4 < 2 THEN NULL ELSE c_custkey - c_custkey % 4 END AS mother,
    CASE WHEN c_custkey % 4 < 2 THEN NULL ELSE c_custkey - c_custkey % 4 + 1 END AS father,
    CASE WHEN c_custkey % 4 = 0 THEN 2 WHEN c_custkey % 4 = 1 THEN 1 ELSE 1 + c_nationkey % 2 END AS sex,
    CASE WHEN c_mktsegment IN ('BUILDING', 'HOUSEHOLD') THEN 2 ELSE 1 END AS phenotype
  FROM customer)"""


def interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletion-like intervals per sample, in days."""
    orders = table(spark, sf_dir, "orders")
    start = day("o_orderdate")
    return orders.select(
        F.col("o_orderkey").alias("iv_id"),
        F.col("o_custkey").alias("sample"),
        (F.col("o_custkey") % 22 + 1).cast("int").alias("chrom"),
        start.alias("start_pos"),
        (start + 1 + F.floor(F.col("o_totalprice") / 5000).cast("long")).alias("end_pos"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("is_mat"),
    )


INTERVAL_SQL = """interval_ AS (
  SELECT o_orderkey AS iv_id, o_custkey AS sample, CAST(o_custkey % 22 + 1 AS INT) AS chrom,
    CAST(floor(epoch_us(o_orderdate) / 86400000000.0) AS BIGINT) AS start_pos,
    CAST(floor(epoch_us(o_orderdate) / 86400000000.0) AS BIGINT) + 1 + CAST(floor(o_totalprice / 5000) AS BIGINT) AS end_pos,
    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_mat
  FROM orders)"""


def genotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse calls: chrom, pos, sample, gt in -1, 0, 1, 2."""
    items = table(spark, sf_dir, "lineitem")
    calls = items.groupBy("l_partkey", "l_suppkey").agg(F.max(F.col("l_linenumber") % 4 - 1).alias("gt"))
    return calls.select((F.col("l_partkey") % 3 + 1).cast("int").alias("chrom"), F.col("l_partkey").alias("pos"), F.col("l_suppkey").alias("sample"), "gt")


GENOTYPE_SQL = """genotype AS (
  SELECT CAST(l_partkey % 3 + 1 AS INT) AS chrom, l_partkey AS pos, l_suppkey AS sample, max(l_linenumber % 4 - 1) AS gt
  FROM lineitem GROUP BY l_partkey, l_suppkey)"""


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of sites: some positions have several, some fail."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey as rec", "cast(p_partkey % 3 + 1 as int) as chrom", "cast(floor(p_partkey * 3 / 4) as bigint) as pos", "p_size % 5 <> 0 as is_snp", "p_size % 7 <> 0 as is_pass")


SITE_SQL = """site AS (
  SELECT p_partkey AS rec, CAST(p_partkey % 3 + 1 AS INT) AS chrom, CAST(floor(p_partkey * 3 / 4.0) AS BIGINT) AS pos, p_size % 5 <> 0 AS is_snp, p_size % 7 <> 0 AS is_pass FROM part)"""


def region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotated regions on the axis of the intervals."""
    return table(spark, sf_dir, "part").selectExpr("p_partkey as region_id", "cast(p_partkey % 22 + 1 as int) as chrom", "9131 + p_partkey * 37 % 2400 as start_pos", "9131 + p_partkey * 37 % 2400 + p_size as end_pos", "p_brand as category")


REGION_SQL = """region_ AS (
  SELECT p_partkey AS region_id, CAST(p_partkey % 22 + 1 AS INT) AS chrom, 9131 + p_partkey * 37 % 2400 AS start_pos, 9131 + p_partkey * 37 % 2400 + p_size AS end_pos, p_brand AS category FROM part)"""


def trios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers in quads: two trios each, over the samples of the genotypes."""
    return table(spark, sf_dir, "supplier").where("s_suppkey % 4 >= 2").selectExpr("cast(floor(s_suppkey / 4) as bigint) as family", "s_suppkey as child", "s_suppkey - s_suppkey % 4 as mother", "s_suppkey - s_suppkey % 4 + 1 as father")


TRIOS_SQL = """trios AS (
  SELECT CAST(floor(s_suppkey / 4.0) AS BIGINT) AS family, s_suppkey AS child, s_suppkey - s_suppkey % 4 AS mother, s_suppkey - s_suppkey % 4 + 1 AS father FROM supplier WHERE s_suppkey % 4 >= 2)"""
