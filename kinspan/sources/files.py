"""Readers and writers of genotypes, phases, error profiles, regions and results."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas

#: Genotype strings of VCF files, unphased and phased.
GENOTYPE_CODES = {"./.": -1, ".|.": -1, ".": -1, "0/0": 0, "0|0": 0, "0/1": 1, "1/0": 1, "0|1": 1, "1|0": 1, "1/1": 2, "1|1": 2}


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """samples.json, an array of ids: idx (the row of the genotype matrix) and sample."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.posexplode(F.from_json("value", "array<string>")).alias("idx", "sample"))


def read_info(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("info"))


def read_genotype_matrices(spark: SparkSession, folder: str) -> DataFrame:
    """Non-zero cells of chr.<c>.<batch>.gen.npz files (CSC or CSR): chrom, batch, idx, site, gt.

    Each file is one task's work: it is unpacked by NumPy and leaves as rows.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "chr.*.gen.npz").load(folder)
    named = files.select(F.regexp_extract("path", r"chr\.(\w+)\.\d+\.gen\.npz$", 1).alias("chrom"), F.regexp_extract("path", r"chr\.\w+\.(\d+)\.gen\.npz$", 1).cast("int").alias("batch"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                with np.load(io.BytesIO(row.content), allow_pickle=False) as parts:
                    kind, data, inner, pointer = (parts[k] for k in ("format", "data", "indices", "indptr"))
                outer = np.repeat(np.arange(len(pointer) - 1), np.diff(pointer))
                by_column = bytes(kind.item() if kind.shape == () else kind).decode().startswith("csc")
                idx, site = (inner, outer) if by_column else (outer, inner)
                keep = data != 0
                yield pd.DataFrame({"chrom": row.chrom, "batch": row.batch, "idx": idx[keep], "site": site[keep], "gt": np.maximum(data[keep], -1)})

    return named.mapInPandas(run, "chrom string, batch int, idx int, site int, gt int")


def read_site_arrays(spark: SparkSession, folder: str) -> DataFrame:
    """chr.<c>.<batch>.gen.coordinates.npy: chrom, batch, site, pos, is_snp, is_pass."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "chr.*.gen.coordinates.npy").load(folder)
    named = files.select(F.regexp_extract("path", r"chr\.(\w+)\.\d+\.gen", 1).alias("chrom"), F.regexp_extract("path", r"chr\.\w+\.(\d+)\.gen", 1).cast("int").alias("batch"), "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                table = np.load(io.BytesIO(row.content), allow_pickle=False)
                yield pd.DataFrame({"chrom": row.chrom, "batch": row.batch, "site": np.arange(len(table)), "pos": table[:, 1], "is_snp": table[:, 2] == 1, "is_pass": table[:, 3] == 1})

    return named.mapInPandas(run, "chrom string, batch int, site int, pos int, is_snp boolean, is_pass boolean")


def genotype_table(cells: DataFrame, sites: DataFrame, samples: DataFrame) -> DataFrame:
    """Long genotypes (chrom, pos, sample, gt) from matrix cells and their two axes."""
    return cells.join(sites.select("chrom", "batch", "site", "pos"), ["chrom", "batch", "site"]).join(samples, "idx").select("chrom", "pos", "sample", "gt")


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    """Long calls of VCF files: chrom, pos, ref, alt, filter, info (map), sample, gt, dp.

    A missing field is null; the chromosome loses its "chr". Each file's own header names
    its samples, so that several files with different ones can be read together.
    """
    lines = spark.read.text(path).select("value", F.input_file_name().alias("_file"))
    # A row a file, with the names of its samples.
    headers = lines.where(F.startswith("value", F.lit("#CHROM"))).select("_file", F.slice(F.split("value", "\t"), 10, 1 << 30).alias("_names"))
    rows = lines.where(~F.startswith("value", F.lit("#"))).select("_file", F.split("value", "\t").alias("c")).join(headers, "_file")
    fixed = rows.select(
        F.regexp_replace(F.col("c")[0], "^chr", "").alias("chrom"),
        F.col("c")[1].try_cast("int").alias("pos"),
        F.col("c")[3].alias("ref"),
        F.col("c")[4].alias("alt"),
        F.col("c")[6].alias("filter"),
        F.str_to_map(F.col("c")[7], F.lit(";"), F.lit("=")).alias("info"),
        F.split(F.col("c")[8], ":").alias("format"),
        "_names",
        F.posexplode(F.slice("c", 10, 1 << 30)).alias("k", "call"),
    )
    codes = F.create_map(*[F.lit(x) for pair in GENOTYPE_CODES.items() for x in pair])

    def part(field: str) -> Column:
        return F.get(F.split("call", ":"), F.array_position("format", field).cast("int") - 1)

    calls = fixed.withColumns({"sample": F.get("_names", F.col("k")), "gt": F.try_element_at(codes, part("GT")), "dp": part("DP").try_cast("int")})
    return calls.drop("format", "k", "call", "_names")


def capped_depths(calls: DataFrame, cap: int = 100) -> tuple[DataFrame, DataFrame]:
    """Depths cut at ``cap`` (chrom, pos, sample, dp; -1 missing), and missing ones by site."""
    capped = calls.select("chrom", "pos", "sample", F.coalesce(F.least(F.col("dp"), F.lit(cap)), F.lit(-1)).alias("dp"))
    return capped, calls.groupBy("chrom", "pos").agg(F.count_if(F.col("dp").isNull()).alias("n_failed"))


def read_variants(spark: SparkSession, path: str) -> DataFrame:
    """Variant lists (the first nine columns of VCF lines, no header): chrom, pos, ref, alt, info."""
    cells = spark.read.text(path).where(~F.startswith("value", F.lit("#"))).select(F.split("value", "\t").alias("c"))
    return cells.select(F.regexp_replace(F.col("c")[0], "^chr", "").alias("chrom"), F.col("c")[1].try_cast("int").alias("pos"), F.col("c")[3].alias("ref"), F.col("c")[4].alias("alt"), F.str_to_map(F.col("c")[7], F.lit(";"), F.lit("=")).alias("info"))


def frequencies_in_range(variants: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """(chrom, pos, ref, alt, af) of variants at start .. end, of files that write the
    chromosome with or without "chr"; several alternative alleles have no single frequency."""
    here = variants.where(F.regexp_replace("chrom", "^chr", "") == chrom.removeprefix("chr")).where(F.col("pos").between(start, end))
    return here.select(F.regexp_replace("chrom", "^chr", "").alias("chrom"), "pos", "ref", "alt", F.try_element_at("info", F.lit("AF")).try_cast("double").alias("af"))


def read_array_genotypes(spark: SparkSession, path: str, reference: DataFrame) -> DataFrame:
    """Consumer-array text (rsid, chromosome, position, genotype; # comments) as codes by the
    ``reference`` base (chrom, pos, base): the letters that differ from it, -1 if unread."""
    raw = spark.read.csv(path, sep="\t", schema="rsid string, chrom string, pos int, letters string", comment="#")
    known = raw.join(reference, ["chrom", "pos"])
    unlike = F.size(F.filter(F.split("letters", ""), lambda c: c != F.col("base")))
    code = F.when(F.col("letters").rlike("^[ACGT]{2}$") & F.col("base").rlike("^[ACGT]$"), unlike).otherwise(-1)
    return known.select("rsid", "chrom", "pos", code.alias("gt"))


def read_family_list(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated lists with a header: family and the ids behind it."""
    lines = spark.read.csv(path, sep="\n", header=True, schema="line string").select(F.split("line", "\t").alias("c"))
    return lines.select(F.col("c")[0].alias("family"), F.filter(F.slice("c", 2, 1 << 30), lambda m: m != "").alias("members"))


def phased_families(spark: SparkSession, folder: str) -> DataFrame:
    """Families of a folder that have both a phase file and an info file."""
    paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.{phased.bed,info.json}").load(folder).select("path")
    one, two = (paths.select(F.regexp_extract("path", rf"([^/]+)\.{kind}$", 1).alias("family")).where("family <> ''") for kind in (r"phased\.bed", r"info\.json"))
    return one.intersect(two)


def read_transmissions(spark: SparkSession, path: str) -> DataFrame:
    """Transmission tables (chrom, start, end, two letters a child; with header): chrom,
    start_pos, end_pos, letters."""
    raw = spark.read.csv(path, sep="\t", header=True)
    chrom, start, end, *children = raw.columns
    return raw.select(F.regexp_replace(chrom, "^chr", "").alias("chrom"), F.col(start).try_cast("int").alias("start_pos"), F.col(end).try_cast("int").alias("end_pos"), F.array(*[F.col(f"`{c}`") for c in children]).alias("letters"))


def read_runtimes(spark: SparkSession, path: str) -> DataFrame:
    """Seconds that log lines tell: path, sweep (Forward or Backward), seconds."""
    lines = spark.read.text(path).select(F.input_file_name().alias("path"), "value")
    found = F.regexp_extract("value", r"(Forward|Backward) sweep complete\D*([0-9.]+) sec", 1)
    return lines.select("path", found.alias("sweep"), F.regexp_extract("value", r"sweep complete\D*([0-9.]+) sec", 1).try_cast("double").alias("seconds")).where("sweep <> ''")


def keyed_variants(df: DataFrame, column: str) -> DataFrame:
    """``df`` and chrom, pos, ref, alt, build of a key like 1_1000_A_G_b38."""
    cells = F.split(column, "_")
    return df.withColumns({"chrom": F.regexp_replace(cells[0], "^chr", ""), "pos": cells[1].try_cast("int"), "ref": cells[2], "alt": cells[3], "build": cells[4]})


def depth_cells(calls: DataFrame, cutoff: int) -> DataFrame:
    """Depths at most ``cutoff`` as depth + 1 (0 stays implicit), missing as -1."""
    value = F.when(F.col("dp").isNull(), -1).when(F.col("dp") <= cutoff, F.col("dp") + 1)
    return calls.select("chrom", "pos", "sample", value.alias("dp")).where("dp is not null")


def read_error_profiles(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Costs of each region class: individual, region, true_gt, obs_gt, cost; only
    individuals that all classes have. Hemizygous calls share the homozygous costs."""
    parts = []
    for region, path in enumerate(paths):
        text = spark.read.text(path, wholetext=True)
        rows = text.select(F.explode(F.from_json("value", "map<string,map<string,double>>")).alias("individual", "costs"))
        rows = rows.select("individual", F.lit(region).alias("region"), F.explode("costs").alias("name", "cost"))
        parts.append(rows.select("individual", "region", F.regexp_extract("name", r"true_gen=([01]/[01])", 1).alias("true_gt"), F.regexp_extract("name", r"obs=([01.]/[01.])", 1).alias("obs_gt"), "cost").where("true_gt <> ''"))
    profiles = parts[0]
    for part in parts[1:]:
        profiles = profiles.unionByName(part)
    everywhere = profiles.groupBy("individual").agg(F.count_distinct("region").alias("n")).where(F.col("n") == len(paths))
    return profiles.join(everywhere.select("individual"), "individual", "left_semi")


def read_phase_bed(spark: SparkSession, path: str, chroms: list[str] | None = None) -> DataFrame:
    """Segments of <family>.phased.bed files, or of what write_phase_bed wrote: family, chrom,
    seg_idx, start_pos, end_pos, dels, phases (individual, mat, pat), loss_region. -1
    becomes null; every file has its header."""
    # Paths come as URIs; folder names that Spark wrote are escaped once more.
    path_ = F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))
    folder = F.regexp_extract(path_, r"/family=([^/]+)/[^/]+$", 1)
    family = F.when(folder != "", F.url_decode(F.replace(F.url_decode(folder), F.lit("+"), F.lit("%2B")))).otherwise(F.url_decode(F.regexp_extract(path_, r"([^/]+)\.phased\.bed$", 1)))
    lines = spark.read.option("recursiveFileLookup", "true").text(path).select("value", family.alias("family"))
    headers = lines.where(F.startswith("value", F.lit("#"))).distinct().select("family", F.split(F.regexp_replace("value", "^#", ""), "\t").alias("names"))
    rows = lines.where(~F.startswith("value", F.lit("#")))
    if chroms:
        rows = rows.where(F.substring_index("value", "\t", 1).isin([f"chr{c}" for c in chroms]))
    both = rows.join(headers, "family").withColumn("cells", F.map_from_arrays("names", F.split("value", "\t")))

    def number(name: Column) -> Column:
        value = F.try_element_at("cells", name).try_cast("int")
        return F.when(value >= 0, value)

    people = F.array_distinct(F.transform(F.filter("names", lambda n: n.rlike("_(mat|pat)$")), lambda n: F.regexp_replace(n, "_(mat|pat)$", "")))
    phases = F.transform(people, lambda n: F.struct(n.alias("individual"), number(F.concat(n, F.lit("_mat"))).alias("mat"), number(F.concat(n, F.lit("_pat"))).alias("pat")))
    out = both.select(
        "family",
        F.regexp_replace(F.col("cells")["chrom"], "^chr", "").alias("chrom"),
        F.col("cells")["chrom_start"].try_cast("int").alias("start_pos"),
        F.col("cells")["chrom_end"].try_cast("int").alias("end_pos"),
        F.transform(F.filter("names", lambda n: n.endswith("_del")), number).alias("dels"),
        phases.alias("phases"),
        number(F.lit("loss_region")).alias("loss_region"),
    )
    over = Window.partitionBy("family", "chrom").orderBy("start_pos")
    return out.withColumn("seg_idx", F.row_number().over(over) - 1)


def write_phase_bed(segments: DataFrame, path: str) -> None:
    """Segments (family, chrom, start_pos, end_pos, dels of four, phases, loss_region) as text
    files with a header, a folder a family; null entries become -1."""
    people = F.transform("phases", lambda x: x.individual)
    columns = F.flatten(F.transform(people, lambda n: F.array(F.concat(n, F.lit("_mat")), F.concat(n, F.lit("_pat")))))
    fixed = [F.lit(n) for n in ("#chrom", "chrom_start", "chrom_end", "m1_del", "m2_del", "p1_del", "p2_del")]
    header = F.concat(F.array(*fixed), columns, F.array(F.lit("loss_region")))

    def number(x: Column) -> Column:
        return F.coalesce(x, F.lit(-1)).cast("string")

    phases = F.flatten(F.transform("phases", lambda x: F.array(number(x.mat), number(x.pat))))
    cells = F.concat(F.array(F.concat(F.lit("chr"), "chrom"), F.col("start_pos").cast("string"), F.col("end_pos").cast("string")), F.transform("dels", number), phases, F.array(number(F.col("loss_region"))))
    body = segments.select("family", F.lit(1).alias("_order"), "chrom", "start_pos", F.array_join(cells, "\t").alias("value"))
    heads = segments.groupBy("family").agg(F.first(F.array_join(header, "\t")).alias("value")).select("family", F.lit(0).alias("_order"), F.lit("").alias("chrom"), F.lit(0).alias("start_pos"), "value")
    lines = heads.unionByName(body).repartition("family").sortWithinPartitions("family", "_order", "chrom", "start_pos")
    lines.select("family", "value").write.partitionBy("family").text(path)


def write_denovo(candidates: DataFrame, path: str) -> None:
    """De-novo candidates (child and the site's columns) as tab-separated lines."""
    candidates.select("child", *[c for c in candidates.columns if c != "child"]).write.csv(path, sep="\t")


def write_run_info(spark: SparkSession, settings: dict, path: str) -> None:
    """The settings of a run as one JSON object."""
    spark.createDataFrame([{k: str(v) for k, v in settings.items()}]).coalesce(1).write.json(path)


def with_frequencies(sites: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Sites and their allele frequency, null where none is known."""
    return sites.join(frequencies.select("chrom", "pos", "af").dropDuplicates(["chrom", "pos"]), ["chrom", "pos"], "left")


def read_regions(spark: SparkSession, path: str, category: str, one_based: bool = False) -> DataFrame:
    """BED-like regions (chrom, start, end, name?) as 0-based half-open ``region`` rows."""
    raw = spark.read.csv(path, sep="\t", schema="chrom string, start_pos int, end_pos int, name string", comment="#")
    shift = 1 if one_based else 0
    return raw.select(F.lit(category).alias("category"), "name", F.regexp_replace("chrom", "^chr", "").alias("chrom"), (F.col("start_pos") - shift).alias("start_pos"), "end_pos")


def chromosome_arms(cytobands: DataFrame) -> DataFrame:
    """End of the short arm and of the chromosome from cytobands (chrom, end_pos, name)."""
    return cytobands.groupBy("chrom").agg(F.max(F.when(F.startswith("name", F.lit("p")), F.col("end_pos"))).alias("p_end"), F.max("end_pos").alias("q_end"))


def read_fasta_bases(spark: SparkSession, path: str, positions: DataFrame, block: int = 1 << 16) -> DataFrame:
    """The reference base at each (chrom, pos), 1-based, null beyond a sequence's end.

    Sequences are cut into blocks of ``block`` bases, and positions are joined to theirs.
    """
    records = spark.read.text(path, lineSep=">").where("length(value) > 0")
    name = F.regexp_replace(F.split(F.substring_index("value", "\n", 1), r"\s")[0], "^chr", "")
    bases = records.select(name.alias("chrom"), F.regexp_replace(F.expr("substring(value, instr(value, '\n') + 1)"), r"\s", "").alias("sequence"))
    starts = F.sequence(F.lit(0), F.greatest(F.floor((F.length("sequence") - 1) / block), F.lit(0)))
    blocks = bases.select("chrom", "sequence", F.explode(starts).alias("_block")).select("chrom", "_block", F.substring("sequence", F.col("_block").cast("int") * block + 1, F.lit(block)).alias("_bases"))
    asked = positions.withColumn("_block", F.floor((F.col("pos") - 1) / block))
    base = F.upper(F.substring("_bases", ((F.col("pos") - 1) % block + 1).cast("int"), F.lit(1)))
    return asked.join(blocks, ["chrom", "_block"]).select(*positions.columns, F.when(base != "", base).alias("base"))


def read_results(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """JSON arrays of results: kind is event, deletion or sibpair."""
    return spark.read.schema({"event": schemas.EVENT, "deletion": schemas.DELETION, "sibpair": schemas.SIBPAIR}[kind]).json(path, multiLine=True)


def write_results(df: DataFrame, path: str) -> None:
    df.write.json(path)


def swapped_frequencies(sites: DataFrame, reference: DataFrame) -> DataFrame:
    """Allele frequency of (chrom, pos, ref, alt), or one less that of the swapped
    alleles, 0 if neither is known."""
    direct = reference.select("chrom", "pos", "ref", "alt", F.col("af").alias("_af"), F.lit(0).alias("_rank"))
    turned = reference.select("chrom", "pos", F.col("alt").alias("ref"), F.col("ref").alias("alt"), (1 - F.col("af")).alias("_af"), F.lit(1).alias("_rank"))
    best = direct.union(turned).groupBy("chrom", "pos", "ref", "alt").agg(F.min_by("_af", "_rank").alias("af"))
    return sites.join(best, ["chrom", "pos", "ref", "alt"], "left").na.fill(0.0, ["af"])
