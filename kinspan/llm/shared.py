"""Folders that driver and executors share, and tables cut from their lineage."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``.

    On a cluster the session names the shared store. Only where the setting is
    absent and Spark runs on one machine (tests) is a local folder taken.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def arrow_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a folder as Spark spells it, and the path there."""
    scheme, mark, rest = folder.partition(":")
    if mark and scheme in ("s3a", "s3n"):
        folder = "s3:" + rest
    elif scheme == "file" and not rest.startswith("//"):
        folder = "file://" + rest
    return pafs.FileSystem.from_uri(folder)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: its lineage
    ends there, so a lost executor costs a read and not a recomputation."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(columns: list[str], name: str) -> str:
    """``name``, with underscores behind it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, column: str, buckets: int) -> list:
    """At most ``buckets - 1`` ascending values of ``column`` that cut it into
    ranges of about equal row counts (a quantile sketch of fixed size)."""
    shares = [i / buckets for i in range(1, buckets)]
    if not shares:
        return []
    row = df.agg(F.percentile_approx(column, shares, max(10_000, 20 * buckets)).alias("b")).first()
    return sorted(set(row.b or []))


def range_bucket(column, bounds: list):
    """Index of the range of ``bounds`` that holds the value, by binary search:
    the number of bounds below it. Null goes to bucket 0."""
    if not bounds:
        return F.lit(0)
    cuts = F.array(*[F.lit(b) for b in bounds])
    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(acc, _):
        mid = F.shiftright(acc.lo + acc.hi, 1)
        done = acc.lo >= acc.hi
        below = F.get(cuts, mid) < column
        return F.struct(
            F.when(done | ~below, acc.lo).otherwise(mid + 1).alias("lo"),
            F.when(done | below, acc.hi).otherwise(mid).alias("hi"),
        )

    return F.when(column.isNull(), F.lit(0)).otherwise(F.aggregate(steps, start, halve, lambda acc: acc.lo))
