"""Pedigree files: tab-separated family, individual, father, mother, sex, phenotype."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import PEDIGREE
from .stores import settled


def read_pedigree(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a pedigree file, "." in ids as "_", unknown parents ("0") as null.

    Lines with fewer than four fields are left out; sex and phenotype may be missing.
    """
    raw = spark.read.csv(path, sep="\t", schema=PEDIGREE, mode="PERMISSIVE")
    ids = {c: F.translate(F.trim(c), ".", "_") for c in ("family", "individual", "father", "mother")}
    rows = raw.where("mother is not null").withColumns(ids)
    return rows.withColumns({c: F.when(F.col(c) != "0", F.col(c)) for c in ("father", "mother")})


def children_of(pedigree: DataFrame) -> DataFrame:
    """Rows with both parents."""
    return pedigree.where("father is not null and mother is not null")


def nuclear_families(pedigree: DataFrame) -> DataFrame:
    """One row per family and couple: mother, father and the sorted children."""
    return children_of(pedigree).groupBy("family", "mother", "father").agg(F.array_sort(F.collect_set("individual")).alias("children"))


def prune(pedigree: DataFrame, samples: DataFrame) -> DataFrame:
    """Without members that have no ``sample`` row and are nobody's parent."""
    known = samples.select(F.col("sample").alias("individual")).distinct()
    parents = pedigree.select(F.explode(F.array("father", "mother")).alias("individual")).where("individual is not null").distinct()
    return pedigree.join(known.union(parents).distinct(), "individual", "left_semi")


def missing_parent(pedigree: DataFrame, samples: DataFrame, parent: str = "father") -> DataFrame:
    """Trios of which the child and the other parent have samples and ``parent`` has none."""
    other = "mother" if parent == "father" else "father"
    own = samples.select("sample").distinct()
    rows = children_of(pedigree)
    for column, how in (("individual", "left_semi"), (other, "left_semi"), (parent, "left_anti")):
        rows = rows.join(own.withColumnRenamed("sample", column), column, how)
    return rows.select(*pedigree.columns)


def shuffled_children(pedigree: DataFrame, seed: int = 0) -> DataFrame:
    """A reproducible random order of the children of each family."""
    over = Window.partitionBy("family").orderBy(F.xxhash64("family", "individual", F.lit(seed)), "individual")
    return children_of(pedigree).withColumn("child_order", F.row_number().over(over) - 1)


def with_descendants(pedigree: DataFrame) -> DataFrame:
    """Members of families with a child of both parents at least."""
    return pedigree.join(children_of(pedigree).select("family").distinct(), "family", "left_semi")


def attributes(pedigree: DataFrame) -> DataFrame:
    """Sex and phenotype of each individual, one row each."""
    return pedigree.groupBy("individual").agg(F.max("sex").alias("sex"), F.max("phenotype").alias("phenotype"))


def disjoint_pairs(children: DataFrame, seed: int = 0) -> DataFrame:
    """Random disjoint pairs of children of one family and phenotype, and of two children
    of different phenotypes that are left over (phenotype is null then)."""
    over = Window.partitionBy("family", "phenotype").orderBy(F.xxhash64("family", "individual", F.lit(seed)), "individual")
    dealt = children.withColumn("pair", F.floor((F.row_number().over(over) - 1) / 2))
    pairs = dealt.groupBy("family", "phenotype", "pair").agg(F.array_sort(F.collect_list("individual")).alias("members"))
    left = pairs.where("size(members) = 1").groupBy("family").agg(F.array_sort(F.flatten(F.collect_list("members"))).alias("members")).where("size(members) = 2")
    whole = pairs.where("size(members) = 2").select("family", "phenotype", "members").unionByName(left.withColumn("phenotype", F.lit(None).cast(dict(children.dtypes)["phenotype"])))
    return whole.select("family", "phenotype", F.col("members")[0].alias("sibling1"), F.col("members")[1].alias("sibling2"))


def quads(pedigree: DataFrame) -> DataFrame:
    """Pedigree rows of one quad for every two siblings of a family."""
    one = children_of(pedigree)
    two = one.select("family", "mother", "father", F.col("individual").alias("second"))
    pairs = one.join(two, ["family", "mother", "father"]).where("individual < second")
    name = F.concat_ws("_", "family", "individual", "second")
    pairs = pairs.select(name.alias("quad"), "mother", "father", F.explode(F.array("individual", "second")).alias("individual"))
    return pairs.select(F.col("quad").alias("family"), "individual", "father", "mother")


def write_pedigree(pedigree: DataFrame, path: str) -> None:
    columns = [c for c in ("family", "individual", "father", "mother", "sex", "phenotype") if c in pedigree.columns]
    pedigree.select(*columns).na.fill("0", ["father", "mother"]).write.csv(path, sep="\t")


def prune_generations(pedigree: DataFrame, samples: DataFrame) -> DataFrame:
    """``pedigree`` without the individuals that have no sample and whose descendants have none
    either: unsampled leaves go, then parents that have become leaves, and so on.

    Who stays is who has a sample (``samples``: sample) or is an ancestor of one who stays; a
    round takes one generation of parents upwards. An ancestor without a row of its own in
    the pedigree ends the way; rows of circular descent are followed once.
    """
    up = settled(pedigree.select(F.col("individual").alias("child"), F.explode(F.array("mother", "father")).alias("individual")).where("individual is not null and child is not null").distinct(), "parents")
    kept = settled(pedigree.select("individual").join(samples.select(F.col("sample").alias("individual")).distinct(), "individual", "left_semi").distinct(), "kept")
    front = kept
    while not front.isEmpty():
        parents = up.join(front.withColumnRenamed("individual", "child"), "child", "left_semi").select("individual").distinct()
        front = settled(parents.join(kept, "individual", "left_anti"), "front")
        kept = settled(kept.unionByName(front), "kept")
    return pedigree.join(kept, "individual", "left_semi").select(*pedigree.columns)
