"""Matrices of samples by positions in files, as data sources that read ranges and as a sink.

``kinspan_genotypes`` reads folders of ``chr.<c>.<batch>.gen.npz`` (sparse matrices, a row a
sample and a column a site), ``chr.<c>.<batch>.gen.coordinates.npy`` and ``samples.json``.
``kinspan_matrix`` writes (chrom, pos, sample, value) as blocks of the same kind and reads
them back. Both take filters on chrom, pos and sample into the plan: files of other
chromosomes or ranges are not opened, and of a file that was stored uncompressed only the
bytes of the asked columns are read. A file is dealt into several tasks by its columns.

A block's name is new for each attempt of a task. Blocks count once the driver has put them
into the manifest, which it does in one rename after all tasks have ended, so that lost
executors and repeated tasks leave no block twice.
"""

from __future__ import annotations

import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from .stores import file_system

MANIFEST = "_manifest.json"
#: Columns of a file that one task reads, and rows of a batch that it hands on.
SITES_A_TASK = 1 << 16
BATCH_ROWS = 1 << 16
#: Positions of a block that is written.
BLOCK_WIDTH = 1 << 16


class Npz:
    """Arrays of a .npz file, by range where they were stored as they are."""

    def __init__(self, file):
        self.file, self.zip = file, zipfile.ZipFile(file)
        self.names = {n.removesuffix(".npy") for n in self.zip.namelist()}

    def read(self, name: str, lo: int = 0, hi: int | None = None) -> np.ndarray:
        info = self.zip.getinfo(f"{name}.npy")
        if info.compress_type != zipfile.ZIP_STORED or hi is None:
            with self.zip.open(info) as member:
                return np.lib.format.read_array(member, allow_pickle=False)[() if hi is None else slice(lo, hi)]
        self.file.seek(info.header_offset)
        name_size, extra_size = struct.unpack("<26x2H", self.file.read(30))
        self.file.seek(info.header_offset + 30 + name_size + extra_size)
        return npy_rows(self.file, lo, hi)


def npy_header(file) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, whether in column order, and type of an array whose file stands at its begin."""
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}
    return read[np.lib.format.read_magic(file)](file)


def npy_rows(file, lo: int, hi: int) -> np.ndarray:
    """Rows lo .. hi - 1 of an array whose file stands at its begin."""
    shape, by_column, dtype = npy_header(file)
    at, width = file.tell(), int(np.prod(shape[1:], dtype=np.int64))
    if by_column and len(shape) > 1:
        return np.frombuffer(file.read(), dtype).reshape(shape, order="F")[lo:hi]
    file.seek(at + lo * width * dtype.itemsize)
    return np.frombuffer(file.read((hi - lo) * width * dtype.itemsize), dtype).reshape(-1, *shape[1:])


@dataclass
class Wanted:
    """What filters ask for: chromosomes and samples (None: all), and a range of positions."""

    chroms: set | None = None
    samples: set | None = None
    first: float = -np.inf
    last: float = np.inf

    def take(self, f: Filter) -> bool:
        """Whether a filter is one of those that are followed exactly."""
        name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
        if name in ("chrom", "sample") and isinstance(f, EqualTo | In):
            values = {f.value} if isinstance(f, EqualTo) else set(f.value)
            old = self.chroms if name == "chrom" else self.samples
            values = values if old is None else values & old
            if name == "chrom":
                self.chroms = values
            else:
                self.samples = values
            return True
        if name != "pos" or not isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual):
            return False
        # Positions are whole numbers.
        if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual):
            self.first = max(self.first, f.value + isinstance(f, GreaterThan))
        if isinstance(f, EqualTo | LessThan | LessThanOrEqual):
            self.last = min(self.last, f.value - isinstance(f, LessThan))
        return True

    def has(self, chrom, first: float, last: float) -> bool:
        return (self.chroms is None or chrom in self.chroms) and first <= self.last and last >= self.first


@dataclass
class Part(InputPartition):
    """Columns lo .. hi - 1 of a file."""

    file: str
    lo: int
    hi: int
    about: dict = field(default_factory=dict)


class RangeReader(DataSourceReader):
    """What both readers share: filters, and cells of some columns of a sparse matrix."""

    def __init__(self, options: dict):
        self.path, self.wanted = options["path"], Wanted()
        self.sites_a_task = int(options.get("sitesPerTask", SITES_A_TASK))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def cells(self, npz: Npz, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Row, column, value and number of the stored cells in columns lo .. hi - 1."""
        kind = npz.read("format")
        by_column = bytes(kind.item() if kind.shape == () else kind).decode().startswith("csc")
        if by_column:
            pointer = npz.read("indptr", lo, hi + 1).astype(np.int64)
            a, b = int(pointer[0]), int(pointer[-1])
            return npz.read("indices", a, b), np.repeat(np.arange(lo, hi), np.diff(pointer)), npz.read("data", a, b), np.arange(a, b)
        pointer, column, data = npz.read("indptr"), npz.read("indices"), npz.read("data")
        row = np.repeat(np.arange(len(pointer) - 1), np.diff(pointer))
        at = np.flatnonzero((column >= lo) & (column < hi))
        return row[at], column[at], data[at], at

    def chosen(self, samples: list | np.ndarray) -> np.ndarray:
        """Which rows are asked for."""
        if self.wanted.samples is None:
            return np.ones(len(samples), bool)
        return np.array([s in self.wanted.samples for s in samples], bool)


class GenotypeReader(RangeReader):
    def __init__(self, options: dict):
        super().__init__(options)
        self.dense = options.get("cells", "stored") == "all"

    def partitions(self) -> list[Part]:
        """Slices of the batches whose positions meet the asked range. Of a batch's sites the
        shape and the positions at the slices' ends are read, nothing else."""
        fs, root = file_system(self.path)
        names = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.path.endswith(".gen.coordinates.npy")]
        batches = []
        for name in names:
            chrom, batch = name.rsplit("/", 1)[-1].split(".")[1:3]
            if self.wanted.chroms is None or chrom in self.wanted.chroms:
                batches.append((chrom, int(batch), name))

        def slices(job: tuple[str, int, str]) -> list[Part]:
            chrom, batch, name = job
            with fs.open_input_file(name) as file:
                (n, *_), _, _ = npy_header(file)
                out = []
                for lo in range(0, n, self.sites_a_task):
                    hi = min(n, lo + self.sites_a_task)
                    ends = []
                    for k in (lo, hi - 1):
                        file.seek(0)
                        ends.append(int(npy_rows(file, k, k + 1)[0, 1]))
                    if self.wanted.has(chrom, *ends):
                        out.append(Part(name, lo, hi, {"chrom": chrom, "batch": batch}))
            return out

        with ThreadPoolExecutor(16) as pool:
            return [p for parts in pool.map(slices, sorted(batches, key=lambda b: b[:2])) for p in parts]

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # so Spark reads a plan without partitions
            return
        fs, root = file_system(self.path)
        with fs.open_input_file(f"{root}/samples.json") as file:
            samples = json.loads(file.read())
        rows = self.chosen(samples)
        with fs.open_input_file(part.file) as file:
            sites = npy_rows(file, part.lo, part.hi)
        inside = (sites[:, 1] >= self.wanted.first) & (sites[:, 1] <= self.wanted.last)
        at = np.flatnonzero(inside)
        if not len(at) or not rows.any():
            return
        lo, hi = int(at[0]) + part.lo, int(at[-1]) + part.lo + 1
        with fs.open_input_file(part.file.replace(".coordinates.npy", ".npz")) as file:
            idx, site, gt, _ = self.cells(Npz(file), lo, hi)
        keep = rows[idx] & inside[site - part.lo]
        idx, site, gt = idx[keep], site[keep], np.maximum(gt[keep], -1)
        if self.dense:
            # All cells of some sites at a time.
            step = max(1, BATCH_ROWS // int(rows.sum()))
            for own in (at[k : k + step] for k in range(0, len(at), step)):
                whole = np.zeros((len(own), len(samples)), np.int32)
                here = (site >= own[0] + part.lo) & (site <= own[-1] + part.lo)
                whole[np.searchsorted(own, site[here] - part.lo), idx[here]] = gt[here]
                yield from self._batches(part, sites, samples, np.tile(np.flatnonzero(rows), len(own)), np.repeat(own, int(rows.sum())), whole[:, rows].ravel())
            return
        some = gt != 0
        yield from self._batches(part, sites, samples, idx[some], site[some] - part.lo, gt[some])

    @staticmethod
    def _batches(part: Part, sites: np.ndarray, samples: list, idx: np.ndarray, at: np.ndarray, gt: np.ndarray) -> Iterator[pa.RecordBatch]:
        names = pa.array(samples, pa.string())
        for k in range(0, len(gt), BATCH_ROWS):
            i, a, n = idx[k : k + BATCH_ROWS], at[k : k + BATCH_ROWS], len(gt[k : k + BATCH_ROWS])
            own = sites[a]
            columns = [pa.array([part.about["chrom"]] * n, pa.string()), pa.array(np.full(n, part.about["batch"]), pa.int32()), pa.array(a + part.lo, pa.int32()), pa.array(own[:, 1], pa.int32()), pa.array(own[:, 2] == 1), pa.array(own[:, 3] == 1), names.take(pa.array(i, pa.int64())), pa.array(gt[k : k + BATCH_ROWS], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, ["chrom", "batch", "site", "pos", "is_snp", "is_pass", "sample", "gt"])


class GenotypeMatrices(DataSource):
    """Options: path, sitesPerTask, and cells: ``stored`` (all but 0) or ``all``."""

    @classmethod
    def name(cls) -> str:
        return "kinspan_genotypes"

    def schema(self) -> str:
        return "chrom string, batch int, site int, pos int, is_snp boolean, is_pass boolean, sample string, gt int"

    def reader(self, schema: StructType) -> GenotypeReader:
        return GenotypeReader(dict(self.options))


def read_manifest(path: str) -> dict:
    fs, root = file_system(path)
    with fs.open_input_file(f"{root}/{MANIFEST}") as file:
        return json.loads(file.read())


class MatrixReader(RangeReader):
    """Reads the blocks that the manifest names."""

    def __init__(self, options: dict, schema: StructType):
        super().__init__(options)
        self.arrow = pa.schema([(f.name, {"integer": pa.int32(), "long": pa.int64(), "double": pa.float64(), "string": pa.string(), "float": pa.float32()}[f.dataType.typeName()]) for f in schema])

    def partitions(self) -> list[Part]:
        out = []
        for block in read_manifest(self.path)["blocks"]:
            if self.wanted.has(block["chrom"], block["first"], block["last"]):
                for lo in range(0, block["sites"], self.sites_a_task):
                    out.append(Part(block["file"], lo, min(block["sites"], lo + self.sites_a_task), {"chrom": block["chrom"]}))
        return out

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # so Spark reads a plan without partitions
            return
        fs, root = file_system(self.path)
        with fs.open_input_file(f"{root}/{part.file}") as file:
            npz = Npz(file)
            pos = npz.read("positions", part.lo, part.hi)
            inside = (pos >= self.wanted.first) & (pos <= self.wanted.last)
            at = np.flatnonzero(inside)
            samples = npz.read("samples")
            rows = self.chosen(samples.tolist())
            if not len(at) or not rows.any():
                return
            idx, site, value, number = self.cells(npz, part.lo + int(at[0]), part.lo + int(at[-1]) + 1)
            empty = np.isin(number, npz.read("empty"))
        keep = np.flatnonzero(rows[idx] & inside[site - part.lo])
        for k in range(0, len(keep), BATCH_ROWS):
            own = keep[k : k + BATCH_ROWS]
            columns = (np.full(len(own), part.about["chrom"]), pos[site[own] - part.lo], samples[idx[own]], pa.array(value[own], mask=empty[own]))
            yield pa.RecordBatch.from_arrays([pa.array(c).cast(f.type) for c, f in zip(columns, self.arrow, strict=True)], schema=self.arrow)


@dataclass
class Blocks(WriterCommitMessage):
    found: list[dict]


class MatrixWriter(DataSourceArrowWriter):
    """Lays out rows that come ordered by chrom, block of positions, position and sample."""

    def __init__(self, path: str, schema: StructType, width: int, overwrite: bool):
        self.path, self.width, self.overwrite = path, width, overwrite
        self.columns = [(f.name, f.dataType.simpleString()) for f in schema]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Blocks:
        found: list[dict] = []
        held: list[pa.RecordBatch] = []
        key = None
        for batch in iterator:
            chrom, block = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False) // self.width
            cuts = np.flatnonzero((chrom[1:] != chrom[:-1]) | (block[1:] != block[:-1])) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if lo < hi:
                    here = (chrom[lo], block[lo])
                    if held and here != key:
                        found.append(self._block(key[0], pa.Table.from_batches(held)))
                        held = []
                    key = here
                    held.append(batch.slice(lo, hi - lo))
        if held:
            found.append(self._block(key[0], pa.Table.from_batches(held)))
        return Blocks(found)

    def _block(self, chrom, rows: pa.Table) -> dict:
        """Writes one block: a matrix by columns whose rows are the block's samples."""
        pos, where = np.unique(rows.column(1).to_numpy(), return_inverse=True)
        samples, idx = np.unique(rows.column(2).to_numpy().astype("U" if pa.types.is_string(rows.schema.types[2]) else np.int64), return_inverse=True)
        value = rows.column(3).combine_chunks()
        empty = np.flatnonzero(value.is_null().to_numpy(zero_copy_only=False))
        data = value.fill_null(0).to_numpy(zero_copy_only=False)
        pointer = np.concatenate([[0], np.cumsum(np.bincount(where, minlength=len(pos)))])
        out = io.BytesIO()
        np.savez(out, data=data, indices=idx.astype(np.int32), indptr=pointer.astype(np.int64), shape=np.array([len(samples), len(pos)]), format=np.array(b"csc"), positions=pos, samples=samples, empty=empty)
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        name = f"chr.{chrom}.{int(pos[0]) // self.width}.{uuid.uuid4().hex}.npz"
        with fs.open_output_stream(f"{root}/{name}", compression=None) as file:
            file.write(out.getbuffer())
        plain = chrom.item() if hasattr(chrom, "item") else chrom
        return {"file": name, "chrom": plain, "first": int(pos[0]), "last": int(pos[-1]), "sites": len(pos), "cells": len(data)}

    def commit(self, messages: list[Blocks | None]) -> None:
        """The manifest with the new blocks beside (or in place of) the old ones, by a rename."""
        fs, root = file_system(self.path)
        fs.create_dir(root, recursive=True)
        old = []
        if fs.get_file_info(f"{root}/{MANIFEST}").type == pafs.FileType.File:
            held = read_manifest(self.path)
            if not self.overwrite and held["columns"] != [list(c) for c in self.columns]:
                raise ValueError("the folder holds a matrix of other columns")
            old = held["blocks"]
        new = sorted((b for m in messages if m for b in m.found), key=lambda b: (str(b["chrom"]), b["first"]))
        latest = f"{root}/{MANIFEST}.{uuid.uuid4().hex}"
        with fs.open_output_stream(latest, compression=None) as file:
            file.write(json.dumps({"columns": self.columns, "blocks": new if self.overwrite else old + new}).encode())
        fs.move(latest, f"{root}/{MANIFEST}")
        if self.overwrite:
            for block in old:
                fs.delete_file(f"{root}/{block['file']}")

    def abort(self, messages: list[Blocks | None]) -> None:
        fs, root = file_system(self.path)
        for block in (b for m in messages if m for b in m.found):
            fs.delete_file(f"{root}/{block['file']}")


class BlockMatrix(DataSource):
    """Options: path, blockWidth (writing), sitesPerTask (reading)."""

    @classmethod
    def name(cls) -> str:
        return "kinspan_matrix"

    def schema(self) -> str:
        return ", ".join(f"`{name}` {kind}" for name, kind in read_manifest(self.options["path"])["columns"])

    def reader(self, schema: StructType) -> MatrixReader:
        return MatrixReader(dict(self.options), schema)

    def writer(self, schema: StructType, overwrite: bool) -> MatrixWriter:
        return MatrixWriter(self.options["path"], schema, int(self.options.get("blockWidth", BLOCK_WIDTH)), overwrite)


def register(spark: SparkSession) -> None:
    """Makes both sources known to a session, and lets filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(GenotypeMatrices)
    spark.dataSource.register(BlockMatrix)


def read_genotypes(spark: SparkSession, path: str, cells: str = "stored", sites_per_task: int = SITES_A_TASK) -> DataFrame:
    """Cells of a folder of genotype matrices: chrom, batch, site, pos, is_snp, is_pass, sample,
    gt (missing codes are -1). Filters on chrom, pos and sample reach the files."""
    register(spark)
    return spark.read.format("kinspan_genotypes").option("path", path).option("cells", cells).option("sitesPerTask", sites_per_task).load()


def write_matrix(cells: DataFrame, path: str, value: str, width: int = BLOCK_WIDTH, mode: str = "append") -> None:
    """Writes (chrom, pos, sample, ``value``) as blocks of ``width`` positions.

    Rows without chrom, pos or sample are no cells; of several rows of one cell all stay;
    null values stay null. A block holds the cells of its positions and is made in one task's
    memory, so that ``width`` times the samples bounds what a task holds. Values are numbers.
    """
    register(cells.sparkSession)
    rows = cells.select("chrom", F.col("pos").cast("long").alias("pos"), "sample", value).where("chrom is not null and pos is not null and sample is not null")
    dealt = rows.repartition("chrom", F.floor(F.col("pos") / width)).sortWithinPartitions("chrom", "pos", "sample")
    dealt.write.format("kinspan_matrix").option("path", path).option("blockWidth", width).mode(mode).save()


def read_matrix(spark: SparkSession, path: str, sites_per_task: int = SITES_A_TASK) -> DataFrame:
    """What write_matrix wrote; filters on chrom, pos and sample choose blocks and columns."""
    register(spark)
    return spark.read.format("kinspan_matrix").option("path", path).option("sitesPerTask", sites_per_task).load()
