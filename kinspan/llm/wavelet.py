"""Token ids as wavelet matrices: one compressed file a shard, with look-ups.

A wavelet matrix keeps the bits of the ids plane by plane, highest first; within
a plane the ids stand in the order that sorting stably by the planes above gives.
With counts of ones every plane answers rank and select, hence the matrix answers
"the id at i", "how often does t occur before i" and "where is the k-th t" without
the ids themselves being stored.

A shard file is one wavelet matrix. Its planes are cut into frames of FRAME_BITS bits
that are compressed one by one; the directory behind them holds each frame's place
and the ones before it, the planes' zeros and the documents' ends. A look-up reads
one or two frames a plane by range. Files are written through ``pyarrow.fs`` so that
any store it knows can be the shared folder; a file's name is new for each attempt
of a task and only names in the returned index count, so a repeated task does no harm.
"""

from __future__ import annotations

import gc
import json
import os
import uuid
import zlib
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .bpe import Known, RunWise, batches_of, byte_characters
from .runs import RunTable, blocks_of, different_runs
from .shared import arrow_folder, n_partitions, read_table, shared_folder, written
from .words import CHUNK_BYTES, chunks

#: Ids after which a shard ends (with the document that reaches them).
SHARD_TOKENS = 1 << 22
FRAME_BITS = 1 << 16
#: Decompressed frames that a reader keeps.
FRAMES_KEPT = 256
#: Runs that a worker keeps (about 50 bytes each): the library takes long over a new word.
KNOWN_RUNS = 1 << 21
END_ID = 2
MAGIC = b"WAVELET2"
_word = np.uint32


def _kind(bits: int) -> type:
    return np.uint16 if bits <= 16 else _word


class WaveletMatrix:
    """The planes of some ids (packed bits, lowest bit first) and the zeros of each."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros

    @classmethod
    def of(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        ids = ids.astype(_kind(bits))
        planes, zeros = [], []
        for k in range(bits - 1, -1, -1):
            ones = (ids & ids.dtype.type(1 << k)).astype(bool)
            planes.append(np.packbits(ones, bitorder="little"))
            low = np.compress(~ones, ids)
            zeros.append(len(low))
            ids = np.concatenate([low, np.compress(ones, ids)])
        return cls(len(ids), planes, zeros)

    def ids(self) -> np.ndarray:
        """All ids, from the lowest plane up."""
        kind = _kind(len(self.planes))
        value, other = np.zeros(self.n, kind), np.empty(self.n, kind)
        for k, (packed, zeros) in enumerate(zip(self.planes[::-1], self.zeros[::-1], strict=True)):
            ones = np.unpackbits(packed, count=self.n, bitorder="little").view(bool)
            value[zeros:] |= kind(1 << k)
            other[np.flatnonzero(~ones)] = value[:zeros]
            other[np.flatnonzero(ones)] = value[zeros:]
            value, other = other, value
        return value


class ShardWriter:
    """Collects the documents of one shard and writes its matrix; memory grows with
    SHARD_TOKENS (or the one document that is longer)."""

    def __init__(self, folder: str, part: int, number: int, bits: int):
        self.folder, self.part, self.number, self.bits = folder, part, number, bits
        self.waiting: list[np.ndarray] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.n_tokens = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.lengths.append(len(ids))
        self.waiting.append(ids)
        self.n_tokens += len(ids)

    def close(self) -> dict:
        fs, root = arrow_folder(self.folder)
        fs.create_dir(root, recursive=True)
        path = f"{root}/shard-{self.part:06d}-{self.number:06d}-{uuid.uuid4().hex}.wm"
        matrix = WaveletMatrix.of(np.concatenate([np.zeros(0, _kind(self.bits)), *self.waiting]), self.bits)
        self.waiting = []
        pack, step, at = zstandard.ZstdCompressor(1), FRAME_BITS // 8, 0
        places, before = [], []
        with fs.open_output_stream(path, compression=None) as out:
            for plane in matrix.planes:
                ones = 0
                for lo in range(0, len(plane), step):
                    frame = plane[lo : lo + step]
                    raw = pack.compress(frame.tobytes())
                    out.write(raw)
                    places.append(at)
                    before.append(ones)
                    at += len(raw)
                    ones += int(np.bitwise_count(frame).sum())
            known = [d is not None for d in self.docs]
            arrays = [("places", [*places, at]), ("before", before), ("zeros", matrix.zeros), ("docs", [d or 0 for d in self.docs]), ("known", known), ("lengths", self.lengths)]
            head = json.dumps({"n": matrix.n, "bits": self.bits, "arrays": [(name, len(x)) for name, x in arrays]}).encode()
            foot = pack.compress(len(head).to_bytes(4, "little") + head + b"".join(np.array(x, "<i8").tobytes() for _, x in arrays))
            out.write(foot + len(foot).to_bytes(8, "little") + MAGIC)
        return {"part": self.part, "number": self.number, "path": path, "n_tokens": self.n_tokens, "n_docs": len(self.docs)}


class ShardReader:
    """Look-ups in one shard file; frames are read by range and some of them kept."""

    def __init__(self, folder: str, path: str):
        fs, _ = arrow_folder(folder)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        tail = self.file.read_at(16, size - 16)
        if tail[8:] != MAGIC:
            raise ValueError(f"{path} is no shard file")
        length = int.from_bytes(tail[:8], "little")
        foot = zstandard.decompress(self.file.read_at(length, size - 16 - length))
        at = 4 + int.from_bytes(foot[:4], "little")
        head = json.loads(foot[4:at])
        held = {}
        for name, n in head["arrays"]:
            held[name] = np.frombuffer(foot, "<i8", n, at)
            at += 8 * n
        self.n_tokens, self.bits = head["n"], head["bits"]
        self.places, self.before, self.zeros = held["places"], held["before"], held["zeros"].tolist()
        self.docs = [d if k else None for d, k in zip(held["docs"].tolist(), held["known"].tolist(), strict=True)]
        self.ends = np.cumsum(held["lengths"]).tolist()
        self.frames = -(-self.n_tokens // FRAME_BITS)
        self.frame = lru_cache(maxsize=FRAMES_KEPT)(self._frame)

    def _frame(self, k: int) -> np.ndarray:
        at, end = int(self.places[k]), int(self.places[k + 1])
        return np.frombuffer(zstandard.decompress(self.file.read_at(end - at, at)), np.uint8)

    def _ones_before(self, plane: int, i: int) -> int:
        """Ones of a plane before place i, from the stored counts and one frame."""
        if i == self.n_tokens:
            return self.n_tokens - self.zeros[plane]
        k = plane * self.frames + i // FRAME_BITS
        i %= FRAME_BITS
        found = int(self.before[k])
        if i:
            frame = self.frame(k)
            found += int(np.bitwise_count(frame[: i // 8]).sum())
            if i % 8:
                found += (int(frame[i // 8]) & ((1 << i % 8) - 1)).bit_count()
        return found

    def access(self, i: int) -> int:
        """The id at place i."""
        value = 0
        for plane, zeros in enumerate(self.zeros):
            at = i % FRAME_BITS
            bit = int(self.frame(plane * self.frames + i // FRAME_BITS)[at // 8]) >> (at % 8) & 1
            ones = self._ones_before(plane, i)
            value = value << 1 | bit
            i = zeros + ones if bit else i - ones
        return value

    def _range(self, token: int, i: int) -> tuple[int, int]:
        """Where the ids equal to ``token`` of the first i stand below the last plane."""
        lo, hi, top = 0, i, self.bits - 1
        for plane, zeros in enumerate(self.zeros):
            a, b = self._ones_before(plane, lo), self._ones_before(plane, hi)
            lo, hi = (zeros + a, zeros + b) if token >> (top - plane) & 1 else (lo - a, hi - b)
        return lo, hi

    def count(self, token: int, i: int | None = None) -> int:
        """Occurrences of a token before place i, or in all."""
        if token >> self.bits:
            return 0
        lo, hi = self._range(token, self.n_tokens if i is None else i)
        return hi - lo

    def select(self, token: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence of a token, or -1."""
        if token >> self.bits:
            return -1
        lo, hi = self._range(token, self.n_tokens)
        if not 0 <= k < hi - lo:
            return -1
        at = lo + k
        for plane in range(self.bits - 1, -1, -1):
            one = token >> (self.bits - 1 - plane) & 1
            at = self._place(plane, one, at - self.zeros[plane] if one else at)
        return at

    def _place(self, plane: int, bit: int, k: int) -> int:
        """Place of the k-th bit of this kind in a plane: the frame by the stored counts, then within it."""
        first = plane * self.frames
        ones = self.before[first : first + self.frames]
        before = ones if bit else np.arange(self.frames) * FRAME_BITS - ones
        f = int(np.searchsorted(before, k, "right")) - 1
        size = min(FRAME_BITS, self.n_tokens - f * FRAME_BITS)
        bits = np.unpackbits(self.frame(first + f), count=size, bitorder="little")
        return f * FRAME_BITS + int(np.flatnonzero(bits == bit)[k - int(before[f])])

    def ids(self) -> np.ndarray:
        """All ids of the shard."""
        planes = [np.concatenate([np.zeros(0, np.uint8), *(self._frame(p * self.frames + k) for k in range(self.frames))]) for p in range(self.bits)]
        return WaveletMatrix(self.n_tokens, planes, self.zeros).ids()

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Every document in order: id, tokens before it in the shard, its ids."""
        ids, start = self.ids(), 0
        for doc, end in zip(self.docs, self.ends, strict=True):
            yield doc, start, ids[start:end]
            start = end


def run_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where the runs of some texts (UTF-8 bytes and their n + 1 offsets) begin: at each
    text's begin and at single spaces between two visible characters of a text."""
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    at = np.flatnonzero(data == 32)
    at = at[~first[at] & ~first[at + 1]]
    before, after = data[at - 1], data[at + 1]
    hidden = _BLANK[before] | _BLANK[after]
    # White space of two or three bytes, before or after.
    for lo, mask in ((-3, before >= 0x80), (1, after >= 0x80)):
        some = np.flatnonzero(mask)
        x = [data[np.clip(at[some] + lo + k, 0, len(data) - 1)] for k in range(3)]
        two = (x[1], x[2]) if lo < 0 else (x[0], x[1])
        blank = (two[0] == 0xC2) & ((two[1] == 0x85) | (two[1] == 0xA0))
        blank |= (x[0] == 0xE2) & (x[1] == 0x80) & ((x[2] <= 0x8A) | (x[2] == 0xA8) | (x[2] == 0xA9) | (x[2] == 0xAF))
        blank |= (x[0] == 0xE2) & (x[1] == 0x81) & (x[2] == 0x9F) | (x[0] == 0xE1) & (x[1] == 0x9A) & (x[2] == 0x80) | (x[0] == 0xE3) & (x[1] == 0x80) & (x[2] == 0x80)
        hidden[some] |= blank
    cuts = np.zeros(len(data) + 1, bool)
    cuts[at[~hidden]] = True
    cuts[offsets[:-1]] = True
    return np.flatnonzero(cuts[: len(data)])


#: Bytes that are, alone, white space (or may be taken for it).
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True


class LibraryEncoder(RunWise):
    """Encodes with the tokenizers library; texts of a byte-level vocabulary by the runs between
    their spaces, each once, of other vocabularies as they stand.

    Runs are found, hashed and looked up as arrays over a batch's bytes; strings are made of
    new ones alone, which the library encodes. New pieces go to it in long strings: those that
    begin with a space one behind the other, words without one with a line feed before each.
    Neither joins what follows it, so that the ids can be cut at tokens that begin with a
    space, or are a line feed. As these strings are cut already, the library has only to cut
    them at that character, and gets them in the vocabulary's own characters for bytes.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        cut = spec["pre_tokenizer"] or {}
        self.apart = spec["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        vocabulary = self.library.get_vocab(True)
        n = 1 + max(vocabulary.values())
        self.bits = max(1, (n - 1).bit_length())
        self.kind = np.dtype(_kind(self.bits))
        self.spaced = np.zeros(n, bool)
        self.spaced[[i for token, i in vocabulary.items() if token[0] == "Ġ"]] = True
        self.feed = np.zeros(n, bool)
        self.feed[vocabulary.get("Ċ", 0)] = "Ċ" in vocabulary
        super().__init__({t["content"]: t["id"] for t in spec["added_tokens"]})
        self.spelled = str.maketrans({b: c for c, b in byte_characters().items()})
        self.cutters = []
        for mark, behaviour in (("Ġ", "merged_with_next"), ("Ċ", "isolated")):
            cutter = Tokenizer(self.library.model)
            cutter.pre_tokenizer = pre_tokenizers.Split(mark, behaviour)
            self.cutters.append(cutter)
        self.known = RunTable(self.kind, KNOWN_RUNS)

    def _each(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.kind) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _cut(self, text: str, cutter: Tokenizer, marks: np.ndarray, skip: int) -> list[bytes]:
        """Ids of the pieces of a text, each of which begins with a token of ``marks``, of
        which ``skip`` (0 or 1) is left out."""
        spelled = text.encode().decode("latin-1").translate(self.spelled)
        ids = np.array(cutter.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, self.kind)
        raw, size = ids.tobytes(), self.kind.itemsize
        at = (np.flatnonzero(marks[ids]) * size).tolist()
        return [raw[lo + skip * size : hi] for lo, hi in zip(at, [*at[1:], len(raw)][: len(at)], strict=True)]

    def encode_pieces(self, words: list[str], pieces: list[str]) -> tuple[list[bytes], dict[str, bytes]]:
        spaced = [p for p in pieces if p[0] == " " and len(p) > 1 and not p[1].isspace()]
        bare = [p for p in pieces if p.isalpha()] if self.feed.any() else []
        found = self._cut("".join(words) + "".join(spaced), self.cutters[0], self.spaced, 0)
        out = dict(zip(spaced, found[len(words) :], strict=True))
        out.update(zip(bare, self._cut("".join(["\n" + w for w in bare]), self.cutters[1], self.feed, 1), strict=True))
        rest = [p for p in pieces if p not in out]
        out.update((p, ids.tobytes()) for p, ids in zip(rest, self._each(rest), strict=True))
        return found[: len(words)], out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [ids for batch in self.encode_column(pa.array(texts, pa.large_string())) for ids in batch]

    def encode_column(self, column: pa.Array) -> Iterator[list[np.ndarray]]:
        """The ids of a column's texts (null is empty), some texts at a time."""
        if not self.apart:
            yield from map(self._each, batches_of(column))
            return
        for _, _, data, offsets in chunks(column):
            starts = run_starts(data, offsets)
            ends = np.append(starts[1:], len(data))[: len(starts)]
            sizes, parts = np.zeros(len(starts), np.int64), [np.zeros(0, self.kind)]
            # A text that is longer than a chunk comes in blocks of runs.
            for lo, hi in blocks_of(starts, ends, CHUNK_BYTES):
                flat, sizes[lo:hi] = self._runs(data[starts[lo] : ends[hi - 1]], starts[lo:hi] - starts[lo], ends[lo:hi] - starts[lo])
                parts.append(flat)
            ids = np.concatenate(parts)
            before = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, offsets)].tolist()
            yield [ids[a:b] for a, b in zip(before, before[1:], strict=False)]

    def _runs(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of runs one behind the other, and how many each has."""
        key, check, at, which = different_runs(data, starts, ends)
        if self.known.n + len(at) > KNOWN_RUNS:
            self.known = RunTable(self.kind, max(KNOWN_RUNS, len(at)))
        entry = self.known.find(key, check)
        new = np.flatnonzero(entry < 0)
        if len(new):
            raw = data.tobytes()
            texts = [raw[a:b].decode() for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)]
            simple = [t[0] == " " and t[1:].split() == [t[1:]] for t in texts]
            runs = [t[1:] for t, s in zip(texts, simple, strict=True) if s]
            known = Known(1 << 40)
            others = iter(self._learn(runs, [], [t for t, s in zip(texts, simple, strict=True) if not s], known))
            ids = [known.new[t[1:]] if s else next(others) for t, s in zip(texts, simple, strict=True)]
            entry[new] = self.known.add(key[new], check[new], ids)
        return self.known.gather(entry[which])


@contextmanager
def collector_at_rest() -> Iterator[None]:
    """No garbage collection meanwhile: millions of strings and no cycles among them."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_shards(docs: DataFrame, tokenizer: str, folder: str, end_id: int | None = END_ID) -> DataFrame:
    """Writes the ids of ``docs`` (doc_id, text) in ascending doc_id order.

    Returns the index: part, number, path, n_tokens, n_docs, base (tokens of all shards
    before). Parts are ranges of doc_id, and each is cut into shards by SHARD_TOKENS.
    Null text counts as empty; null ids come first; rows of one id, or without one, stand
    in order of a hash of their texts, by which they are dealt over tasks too. A text of
    any length is one document of one shard. An empty table gives no shards.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(n_partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, writer, done = library_encoder(tokenizer), None, 0
        part = TaskContext.get().partitionId()
        tail = np.array([] if end_id is None else [end_id], encoder.kind)
        with collector_at_rest():
            for batch in batches:
                at, ids = 0, batch.column("doc_id").to_pylist()
                for texts in encoder.encode_column(batch.column("text")):
                    for tokens in texts:
                        if writer and writer.n_tokens >= SHARD_TOKENS:
                            yield pa.RecordBatch.from_pylist([writer.close()])
                            writer, done = None, done + 1
                        writer = writer or ShardWriter(folder, part, done, encoder.bits)
                        writer.add(ids[at], np.concatenate([tokens, tail]))
                        at += 1
        if writer:
            yield pa.RecordBatch.from_pylist([writer.close()])

    index = written(rows.select("doc_id", "text").mapInArrow(run, "part long, number long, path string, n_tokens long, n_docs long"), "shards")
    # Tokens before a part (a row a task), then before a shard within its part.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = index.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_base"))
    within = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    index = index.withColumn("own_base", F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).join(parts, "part")
    return index.withColumn("base", F.col("part_base") + F.col("own_base")).drop("part_base", "own_base")


def read_shards(index: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32."""
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in batch.to_pylist():
                rows: list[tuple] = []
                for doc, start, ids in ShardReader(folder, shard["path"]).documents():
                    rows.append((doc, shard["base"] + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    spread = index.select("path", "base").repartition(2 * n_partitions(index.sparkSession), "path")
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op5_wavelet_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes all documents as shards and reads every one back; see write_shards for odd rows."""
    folder = shared_folder(spark, "wavelet")
    index = write_shards(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return read_shards(index, folder)
