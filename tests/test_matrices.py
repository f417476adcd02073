import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspan.sources.matrices import MANIFEST, BlockMatrix, Npz, read_genotypes, read_matrix, register, write_matrix

SAMPLES = [f"S{i}" for i in range(7)]


def genotype_folder(folder, packed, by_column=True):
    """Three chromosomes of three batches; the cells as tuples."""
    r = np.random.default_rng(4)
    cells = []
    (folder / "samples.json").write_text(json.dumps(SAMPLES))
    for chrom in ("1", "2", "X"):
        for batch in range(3):
            n = 40 if batch < 2 else 0
            pos = np.sort(r.integers(1000 * batch, 1000 * batch + 900, n))
            flags = r.integers(0, 2, (2, n))
            gt = r.choice([-2, -1, 0, 0, 0, 1, 2], (len(SAMPLES), n)).astype(np.int8)
            at = np.argwhere(gt.T != 0)[:, ::-1] if by_column else np.argwhere(gt != 0)
            outer, inner = (at[:, 1], at[:, 0]) if by_column else (at[:, 0], at[:, 1])
            size = n if by_column else len(SAMPLES)
            pointer = np.concatenate([[0], np.cumsum(np.bincount(outer, minlength=size))])
            arrays = {"data": gt[at[:, 0], at[:, 1]], "indices": inner.astype(np.int32), "indptr": pointer.astype(np.int32), "shape": np.array(gt.shape), "format": np.array(b"csc" if by_column else b"csr")}
            (np.savez_compressed if packed else np.savez)(folder / f"chr.{chrom}.{batch}.gen.npz", **arrays)
            np.save(folder / f"chr.{chrom}.{batch}.gen.coordinates.npy", np.stack([np.full(n, 9), pos, *flags], axis=1).astype(np.int64) if n else np.zeros((0, 4), np.int64))
            cells += [(chrom, batch, s, int(pos[s]), bool(flags[0, s]), bool(flags[1, s]), SAMPLES[i], max(int(gt[i, s]), -1)) for i in range(len(SAMPLES)) for s in range(n)]
    return cells


@pytest.mark.parametrize(("packed", "by_column"), [(False, True), (True, True), (False, False)])
def test_ranges_of_genotypes(spark, tmp_path, packed, by_column):
    cells = genotype_folder(tmp_path, packed, by_column)
    stored = read_genotypes(spark, str(tmp_path), sites_per_task=16)
    whole = read_genotypes(spark, str(tmp_path), cells="all", sites_per_task=16)
    assert sorted(map(tuple, stored.collect())) == sorted(c for c in cells if c[-1])
    assert sorted(map(tuple, whole.collect())) == sorted(cells)
    asked = (F.col("chrom") == "2") & F.col("pos").between(300, 1200) & F.col("sample").isin("S1", "S4")
    expected = sorted(c for c in cells if c[0] == "2" and 300 <= c[3] <= 1200 and c[6] in ("S1", "S4"))
    assert sorted(map(tuple, whole.where(asked).collect())) == expected
    assert sorted(map(tuple, stored.where(asked).collect())) == [c for c in expected if c[-1]]
    # What a filter cannot follow stays with Spark.
    odd = whole.where("chrom > '1' and pos % 2 = 0 and pos > 100 and pos < 1100 and is_pass")
    assert sorted(map(tuple, odd.collect())) == sorted(c for c in cells if c[0] > "1" and c[3] % 2 == 0 and 100 < c[3] < 1100 and c[5])
    assert whole.where("chrom = '7'").count() == 0 and whole.where("sample = 'nobody'").count() == 0


def test_files_outside_the_range_are_not_opened(spark, tmp_path):
    cells = genotype_folder(tmp_path, False)
    rows = read_genotypes(spark, str(tmp_path), sites_per_task=16)
    for name in ("chr.1.0.gen.npz", "chr.2.1.gen.npz", "chr.X.0.gen.npz"):
        (tmp_path / name).write_bytes(b"broken")
    asked = rows.where("chrom = '2' and pos < 900")
    assert sorted(map(tuple, asked.collect())) == sorted(c for c in cells if c[0] == "2" and c[3] < 900 and c[-1])
    # A task a slice that meets the range: of three of batch 0, those that begin below.
    firsts = sorted(c[3] for c in cells if c[0] == "2" and c[1] == 0 and c[6] == "S0")
    asked = rows.where(f"chrom = '2' and pos <= {firsts[3]}")
    assert asked.rdd.getNumPartitions() == 1


def test_arrays_are_read_by_range(tmp_path):
    np.savez(tmp_path / "a.npz", x=np.arange(1000), y=np.arange(30).reshape(10, 3))

    class Counting:
        def __init__(self, file):
            self.file, self.bytes = file, 0

        def read(self, n=-1):
            out = self.file.read(n)
            self.bytes += len(out)
            return out

        def __getattr__(self, name):
            return getattr(self.file, name)

    with open(tmp_path / "a.npz", "rb") as f:
        npz = Npz(counting := Counting(f))
        counting.bytes = 0
        assert npz.read("x", 500, 510).tolist() == list(range(500, 510))
        assert counting.bytes < 400
        assert npz.read("y", 2, 4).tolist() == [[6, 7, 8], [9, 10, 11]]
        assert npz.read("x").tolist() == list(range(1000))


KIND = "chrom string, pos long, sample string, gt int"


def some_cells(n=2000):
    r = random.Random(8)
    rows = {(r.choice("12X"), r.randint(-50, 3000), f"s{r.randint(0, 20)}"): r.choice([None, -1, 0, 1, 2]) for _ in range(n)}
    return [(*k, v) for k, v in rows.items()]


def test_matrix_comes_back(spark, tmp_path):
    path, cells = str(tmp_path / "m"), some_cells()
    df = spark.createDataFrame([*cells, (None, 1, "a", 1), ("1", None, "a", 1), ("1", 1, None, 1)], KIND)
    write_matrix(df.selectExpr("*", "1 as extra"), path, "gt", width=256)
    back = read_matrix(spark, path, sites_per_task=100)
    assert back.dtypes == [("chrom", "string"), ("pos", "bigint"), ("sample", "string"), ("gt", "int")]
    key = str
    assert sorted(map(tuple, back.collect()), key=key) == sorted(cells, key=key)
    asked = back.where("chrom = 'X' and pos >= 100 and pos <= 700 and sample in ('s3', 's7')")
    assert sorted(map(tuple, asked.collect()), key=key) == sorted((c for c in cells if c[0] == "X" and 100 <= c[1] <= 700 and c[2] in ("s3", "s7")), key=key)
    assert asked.rdd.getNumPartitions() < back.rdd.getNumPartitions() / 4
    # A second write adds, an overwrite replaces, and old blocks go.
    write_matrix(spark.createDataFrame([("Y", 5, "z", 2)], KIND), path, "gt", width=256)
    assert read_matrix(spark, path).count() == len(cells) + 1
    write_matrix(spark.createDataFrame([("Y", 5, "z", 2)], KIND), path, "gt", width=256, mode="overwrite")
    assert [tuple(r) for r in read_matrix(spark, path).collect()] == [("Y", 5, "z", 2)]
    assert len(list((tmp_path / "m").glob("*.npz"))) == 1


def test_other_kinds_of_values(spark, tmp_path):
    df = spark.createDataFrame([(1, 10, 100, 0.5), (1, 10, 101, None), (2, 11, 100, 0.0), (1, 10, 100, 0.5)], "chrom int, pos int, sample long, p double")
    write_matrix(df, str(tmp_path / "m"), "p")
    back = read_matrix(spark, str(tmp_path / "m"))
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert back.where("chrom = 2").count() == 1
    write_matrix(df.where("false"), str(tmp_path / "none"), "p")
    assert read_matrix(spark, str(tmp_path / "none")).count() == 0


def test_only_committed_blocks_count(spark, tmp_path):
    path, cells = tmp_path / "m", some_cells(300)
    write_matrix(spark.createDataFrame(cells, KIND), str(path), "gt", width=512)
    manifest = (path / MANIFEST).read_bytes()
    # A task that ran twice: its first attempt's blocks lie there, uncommitted.
    for k, file in enumerate(list(path.glob("*.npz"))):
        (path / f"{file.stem}-again{k}.npz").write_bytes(file.read_bytes())
    assert read_matrix(spark, str(path)).count() == len(cells)
    # A job that fails leaves the manifest as it was, and none of its own blocks.
    before = set(path.glob("*.npz"))
    broken = spark.createDataFrame(cells, KIND).withColumn("gt", F.when(F.col("pos") > 1500, F.raise_error(F.lit("lost"))).otherwise(F.col("gt")).cast("int"))
    register(spark)
    with pytest.raises(Exception, match="lost"):
        broken.coalesce(1).sortWithinPartitions("chrom", "pos").write.format("kinspan_matrix").option("path", str(path)).mode("append").save()
    assert (path / MANIFEST).read_bytes() == manifest and set(path.glob("*.npz")) == before
    with pytest.raises(Exception, match="other columns"):
        write_matrix(spark.createDataFrame([("1", 1, "a", 0.5)], "chrom string, pos long, sample string, p double"), str(path), "p")
    assert BlockMatrix.name() == "kinspan_matrix"
