"""Position ranges of block-compressed, indexed text (VCF and the like), as a data source.

The file is a row of gzip blocks of at most 64 KB; the index beside it (.tbi) says for each
sequence in which block, and where within it, the lines of a stretch of positions begin. A
filter on chrom and pos reaches the plan: the driver reads the index alone and deals the
blocks of the asked range into tasks, which read only those bytes.
"""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter
from pyspark.sql.types import StructType

from .matrices import Part, Wanted
from .stores import file_system

#: Fixed values of the format: positions of one entry of the linear index, and the pseudo-bin
#: that holds no lines.
LINEAR_SHIFT, META_BIN = 14, 37450
#: Bytes of a file that one task reads, and lines that it hands on at once.
TASK_BYTES = 32 << 20
BATCH_LINES = 1 << 13


class Index:
    """What a .tbi file tells: for each sequence its linear index and the end of its lines."""

    def __init__(self, raw: bytes):
        raw = gzip.decompress(raw)
        if raw[:4] != b"TBI\1":
            raise ValueError("no index of this kind")
        n, self.format, self.column, self.begin, self.end, self.meta, self.skip, size = struct.unpack_from("<8i", raw, 4)
        names, at = raw[36 : 36 + size].split(b"\0")[:n], 36 + size
        self.linear: dict[str, list[int]] = {}
        self.ends: dict[str, int] = {}
        for name in names:
            (bins,) = struct.unpack_from("<i", raw, at)
            at, last = at + 4, 0
            for _ in range(bins):
                number, chunks = struct.unpack_from("<Ii", raw, at)
                ends = struct.unpack_from(f"<{2 * chunks}Q", raw, at + 8)[1::2]
                at += 8 + 16 * chunks
                if number != META_BIN:
                    last = max(last, *ends)
            (intervals,) = struct.unpack_from("<i", raw, at)
            self.linear[name.decode()] = list(struct.unpack_from(f"<{intervals}Q", raw, at + 4))
            self.ends[name.decode()] = last
            at += 4 + 8 * intervals

    def spans(self, name: str, first: float, last: float, task_bytes: int) -> list[tuple[int, int]]:
        """Virtual offsets (block << 16 | place in it) between which lines of the range begin,
        in stretches of about ``task_bytes`` of the file. Lines are looked for by where they
        begin, so that the stretch ends where positions beyond ``last`` begin."""
        places, end = self.linear[name], self.ends[name]
        lo = max(0, int(first) - 1) >> LINEAR_SHIFT if first > 1 else 0
        if not places or lo >= len(places) or last < 1:
            return []
        hi = len(places) if last == float("inf") else min(len(places), ((int(last) - 1) >> LINEAR_SHIFT) + 1)
        # An empty stretch has the place of an earlier one, or none.
        start = next((p for p in places[lo::-1] if p), next((p for p in places if p), 0))
        stop = next((p for p in places[hi:] if p > start), end)
        cuts, out = [start], []
        for p in places[lo:hi]:
            if (p >> 16) - (cuts[-1] >> 16) >= task_bytes and p < stop:
                cuts.append(p)
        for a, b in zip(cuts, [*cuts[1:], stop], strict=True):
            if a < b:
                out.append((a, b))
        return out


def lines(file, start: int, stop: int) -> Iterator[bytes]:
    """Lines that begin from virtual offset ``start`` on and before ``stop``."""
    at, skip, held, line_at = start >> 16, start & 0xFFFF, b"", start
    file.seek(at)
    while True:
        head = file.read(18)
        if len(head) < 18:
            break
        # Extra fields: the block's size is in the one called BC.
        (extra,) = struct.unpack_from("<H", head, 10)
        fields = head[12:] + file.read(extra - 6)
        k, size = 0, None
        while k < extra:
            length = struct.unpack_from("<H", fields, k + 2)[0]
            if fields[k : k + 2] == b"BC":
                size = struct.unpack_from("<H", fields, k + 4)[0] + 1
            k += 4 + length
        body = file.read(size - 12 - extra)
        data = zlib.decompress(body[:-8], -15)
        pos = skip
        while (cut := data.find(b"\n", pos)) >= 0:
            if line_at >= stop:
                return
            yield held + data[pos:cut]
            held, pos = b"", cut + 1
            line_at = at << 16 | pos
        if pos < len(data):
            if not held and line_at >= stop:
                return
            held += data[pos:]
        elif not held:
            line_at = (at + size) << 16
        skip, at = 0, at + size
        if not held and line_at >= stop:
            return
    if held and line_at < stop:
        yield held


class TabixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.wanted = options["path"], Wanted()
        self.task_bytes = int(options.get("taskBytes", TASK_BYTES))
        self.index: Index | None = None

    def _index(self) -> Index:
        fs, path = file_system(self.path)
        with fs.open_input_file(f"{path}.tbi") as file:
            return Index(file.read())

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if f.attribute[0] == "sample" or not self.wanted.take(f):
                yield f

    def partitions(self) -> list[Part]:
        index, out = self._index(), []
        for name in index.linear:
            # Files write the chromosome with or without "chr".
            plain = name.removeprefix("chr")
            if self.wanted.has(plain, 1, float("inf")):
                out += [Part(self.path, a, b, {"name": name, "column": index.column, "begin": index.begin, "meta": chr(index.meta)}) for a, b in index.spans(name, self.wanted.first, self.wanted.last, self.task_bytes)]
        return out

    def read(self, part: Part | None) -> Iterator[pa.RecordBatch]:
        if part is None:
            return
        fs, path = file_system(part.file)
        name, meta = part.about["name"].encode(), part.about["meta"].encode()
        at, place = part.about["column"] - 1, part.about["begin"] - 1
        found: tuple[list, list] = ([], [])
        with fs.open_input_file(path) as file:
            for line in lines(file, part.lo, part.hi):
                if not line or line.startswith(meta):
                    continue
                cells = line.split(b"\t", max(at, place) + 1)
                pos = int(cells[place])
                if cells[at] == name and self.wanted.first <= pos <= self.wanted.last:
                    found[0].append(pos)
                    found[1].append(line.decode())
                    if len(found[0]) == BATCH_LINES:
                        yield self._batch(part, *found)
                        found = ([], [])
        if found[0]:
            yield self._batch(part, *found)

    @staticmethod
    def _batch(part: Part, pos: list[int], text: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part.about["name"].removeprefix("chr")] * len(pos), pa.string()), pa.array(pos, pa.int32()), pa.array(text, pa.string())], ["chrom", "pos", "line"])


class TabixLines(DataSource):
    """Options: path (of the compressed text; its index lies beside it), taskBytes."""

    @classmethod
    def name(cls) -> str:
        return "kinspan_tabix"

    def schema(self) -> str:
        return "chrom string, pos int, line string"

    def reader(self, schema: StructType) -> TabixReader:
        return TabixReader(dict(self.options))


def read_tabix(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(chrom without "chr", pos, line) of an indexed file; filters on chrom and pos reach it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TabixLines)
    return spark.read.format("kinspan_tabix").option("path", path).option("taskBytes", task_bytes).load()


def indexed_variants(spark: SparkSession, path: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """Variants of an indexed VCF as read_variants gives them: chrom, pos, ref, alt, info."""
    cells = F.split("line", "\t", 9)
    rows = read_tabix(spark, path, task_bytes)
    return rows.select("chrom", "pos", cells[3].alias("ref"), cells[4].alias("alt"), F.str_to_map(cells[7], F.lit(";"), F.lit("=")).alias("info"))
