"""Packing documents into training windows by best-fit decreasing.

A document's ids are cut into full windows first; what is left of it is one piece. Pieces
are dealt into groups by their numbers, and each group passes through one task in order of
falling length: a piece goes into the open window with the least room that still holds it,
which a segment tree over the remaining capacities finds in a few steps, or opens one. A
piece's place is known when it arrives, so that a task streams its pieces and holds the
open windows alone.

Sequences are padded to the window, but for those whose length is a power of two. Groups
have at most GROUP_PIECES pieces, whatever the corpus: each leaves a few windows with room,
so that padding beyond that of one packing of everything is in the order of one window in
a hundred thousand pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import read_table, written
from .wavelet import collector_at_rest, library_encoder

WINDOW = 1024
#: The id that ends a document, and pads a sequence.
END_ID = 0
#: Pieces of a group, on average: what one task packs.
GROUP_PIECES = 1 << 18


class OpenWindows:
    """Open windows by their room, under a segment tree that counts those of each range of rooms."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.held: list[list[int]] = [[] for _ in range(self.leaves)]

    def _step(self, room: int, by: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += by
            at >>= 1

    def add(self, room: int, sequence: int) -> None:
        self.held[room].append(sequence)
        self._step(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """The window of the least room from ``least`` on, of equal ones that opened or
        filled last, as (room, sequence); it is no longer held."""
        count, at = self.count, self.leaves + least
        if not count[at]:
            # Up to the first range to the right that has a window, then down to its left end.
            while at & 1 or not count[at + 1]:
                at >>= 1
                if at <= 1:
                    return None
            at += 1
            while at < self.leaves:
                at = 2 * at if count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._step(room, -1)
        return room, self.held[room].pop()


class BestFit:
    """Places pieces that come in order of falling length."""

    def __init__(self, window: int = WINDOW):
        self.window, self.open = window, OpenWindows(window)

    def place(self, piece: int, length: int) -> tuple[int, int]:
        """The sequence (the number of its first piece) and the offset there."""
        found = self.open.take(length)
        room, sequence = (self.window, piece) if found is None else found
        if room > length:
            self.open.add(room - length, sequence)
        return sequence, self.window - room


def padded(total: Column, window: int = WINDOW) -> Column:
    """Padding of a sequence of so many ids: none at a power of two."""
    return F.when(F.bit_count(total) <= 1, F.lit(0)).otherwise(window - total)


def cut_documents(docs: DataFrame, path: str, window: int = WINDOW, end_id: int | None = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces of each text: piece (a number of its own), doc_id, start, length, ids_crc32,
    doc_tokens and, ``with_ids``, ids.

    A document's ids (with ``end_id`` behind them) are cut into full windows and one rest.
    Null text counts as empty and has the end id alone (without one, no piece); a null doc_id
    stays null; rows of one id are documents of their own; texts of any length are cut whole;
    an empty table gives no rows; other columns are not read.
    """
    fields = [("piece", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())]
    schema = pa.schema([*fields, *([("ids", pa.list_(pa.int32()))] if with_ids else [])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path)
        number = TaskContext.get().partitionId() << 33
        tail = np.array([] if end_id is None else [end_id], "<u4")
        with collector_at_rest():
            for batch in batches:
                at, names = 0, batch.column("doc_id").to_pylist()
                for texts in encoder.encode_column(batch.column("text")):
                    columns: list[list] = [[] for _ in schema]
                    for ids in texts:
                        ids = np.concatenate([ids, tail], dtype="<u4")
                        for start in range(0, len(ids), window):
                            own = ids[start : start + window]
                            row = (number, names[at], start, len(own), zlib.crc32(own), len(ids), own.view("<i4"))
                            for c, v in zip(columns, row, strict=False):
                                c.append(v)
                            number += 1
                        at += 1
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    kinds = "piece long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, kinds)


def pack(pieces: DataFrame, window: int = WINDOW, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` (piece, length and whatever else) and the sequence_id and offset of each.

    ``pieces`` is a written table, so that piece numbers are the same at each reading. A
    sequence is named by its first piece. Full windows are sequences as they stand; the
    others are packed group by group. Pieces of equal length come in order of their numbers.
    """
    full = F.col("length") == window
    alone = pieces.where(full).withColumns({"sequence_id": F.col("piece"), "offset": F.lit(0).cast("long")})
    rest = pieces.where(~full)
    groups = max(1, -(-rest.count() // group_pieces))
    dealt = rest.repartition(groups, "piece").sortWithinPartitions(F.desc("length"), "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = BestFit(window)
        for batch in batches:
            places = list(map(best.place, batch.column("piece").to_pylist(), batch.column("length").to_pylist()))
            sequences, offsets = zip(*places, strict=True) if places else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sequences, pa.int64()), pa.array(offsets, pa.int64())], [*batch.schema.names, "sequence_id", "offset"])

    schema = ", ".join(f"`{c}` {kind}" for c, kind in rest.dtypes) + ", sequence_id long, offset long"
    return alone.unionByName(dealt.mapInArrow(run, schema))


def sequences(packed: DataFrame, window: int = WINDOW, pad_id: int = END_ID) -> DataFrame:
    """(sequence_id, ids, n_tokens) of packed pieces with their ids: pieces one behind the
    other, padded to the window but at a power of two. A sequence has a window of ids at most."""
    parts = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_tokens"))
    ids = F.flatten(F.transform("parts", lambda x: x.ids))
    return parts.select("sequence_id", F.concat(ids, F.array_repeat(F.lit(pad_id), padded(F.col("n_tokens"), window).cast("int"))).alias("ids"), "n_tokens")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in windows of 1,024 ids: a row a piece."""
    pieces = cut_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)
    return pack(written(pieces, "pieces")).drop("piece")
