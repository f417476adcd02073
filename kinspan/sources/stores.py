"""Folders that driver and executors share, and files of any store by range."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The Arrow file system of a path as Spark spells it, and the path there."""
    scheme, mark, rest = path.partition(":")
    if mark and scheme in ("s3a", "s3n"):
        path = "s3:" + rest
    elif scheme == "file" and not rest.startswith("//"):
        path = "file://" + rest
    return pafs.FileSystem.from_uri(path) if mark else (pafs.LocalFileSystem(), path)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``; where that is unset, a local master
    gets a folder of its own and a cluster is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written in the shared folder: what is used several times is worked out
    once, rounds don't pile up, and a lost executor costs a read."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
