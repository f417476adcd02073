"""WARC archives with a two-level capture index.

Pages are written as WARC records (one gzip member a record) in the order of
their URL keys: the host's labels reversed, then the path. Of pages with equal
payloads one is a response and the others revisit it. Each task writes one
archive and, beside it, the first level of the index: blocks of BLOCK_ENTRIES
sorted captures, each block compressed, and a second level, the sparse directory
with each block's first key and place. A look-up bisects the directory, reads and
bisects one block and then reads the record's range of the archive.

Files are written through ``pyarrow.fs`` under names that are new for each
attempt; only the names in the returned catalogue count.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_folder, n_partitions, read_table, shared_folder, written

LEAST_REVISIT_BYTES = 1000
BLOCK_ENTRIES = 256
GZIP_LEVEL = 1
#: Revisits up to which their list is broadcast (about 60 bytes each); beyond it it is joined by shuffle.
MAX_BROADCAST_REVISITS = 200_000
#: Bytes of records that are read at once when neighbours are wanted.
READ_BYTES = 4 << 20
#: A fixed date, so that the same pages give the same archives.
DATE = "2024-01-01T00:00:00Z"


def url_key(url: Column) -> Column:
    """"com,example,www)/path?query" of a URL, lowered host without port or user;
    a URL without host keeps its text, null is empty."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", ""), "#.*$", "")
    return F.when(host == "", url).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest))


def url_key_of(url: str | None) -> str:
    """The same for one URL."""
    url = url or ""
    try:
        parts = urlsplit(url)
        host = parts.netloc.rpartition("@")[2].split(":")[0].lower() if parts.scheme else ""
    except ValueError:
        host = ""
    if not host:
        return url
    return ",".join(host.split(".")[::-1]) + ")" + url.partition("#")[0].split("://", 1)[1][len(parts.netloc) :]


def _block(headers: list[tuple[str, object]], body: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + f"Content-Length: {len(body)}\r\n\r\n"
    return gzip.compress(head.encode() + body + b"\r\n\r\n", GZIP_LEVEL, mtime=0)


def _b32(hexadecimal: str) -> str:
    return base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit record whose HTTP head still tells the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    kind = "response" if refers_to is None else "revisit"
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join(c for c in url or "" if c not in "\r\n")),
        ("WARC-Payload-Digest", f"sha1:{_b32(digest)}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers_to is not None:
        headers += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    return _block(headers, http + (payload if refers_to is None else b""))


def parse_record(raw: bytes) -> dict:
    """Fields of one decompressed record; a response's digest is taken from its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    kind, named = fields["WARC-Type"], base64.b32decode(fields["WARC-Payload-Digest"][5:]).hex()
    if kind == "response" and (length != len(payload) or named != hashlib.sha1(payload).hexdigest()):
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")

    def page(name: str) -> int | None:
        number = fields.get(name, "<urn:page:>")[10:-1]
        return int(number) if number else None

    return {"page_id": page("WARC-Record-ID"), "url": fields["WARC-Target-URI"], "payload_bytes": length, "payload_digest": named, "record_type": kind, "refers_to": page("WARC-Refers-To"), "payload": payload if kind == "response" else None}


class ArchiveWriter:
    """One archive and its index, written side by side in key order."""

    def __init__(self, folder: str, shard: int):
        self.fs, root = arrow_folder(folder)
        self.fs.create_dir(root, recursive=True)
        self.shard, self.stem = shard, f"{root}/pages-{shard:08d}-{uuid.uuid4().hex}"
        self.archive = self.fs.open_output_stream(self.stem + ".warc.gz", compression=None)
        self.index = self.fs.open_output_stream(self.stem + ".idx", compression=None)
        self.at = self.index_at = self.n = 0
        self.entries: list[tuple[str, int | None, int, int]] = []
        self.directory: list[tuple[str, int, int]] = []
        self.first = self.last = ""

    def add(self, key: str, page_id: int | None, record: bytes) -> None:
        if not self.n:
            self.first = key
        self.last = key
        self.archive.write(record)
        self.entries.append((key, page_id, self.at, len(record)))
        self.at += len(record)
        self.n += 1
        if len(self.entries) == BLOCK_ENTRIES:
            self._flush()

    def _flush(self) -> None:
        raw = zlib.compress(json.dumps(self.entries, ensure_ascii=False).encode(), 6)
        self.index.write(raw)
        self.directory.append((self.entries[0][0], self.index_at, len(raw)))
        self.index_at += len(raw)
        self.entries = []

    def close(self) -> dict:
        if self.entries:
            self._flush()
        raw = zlib.compress(json.dumps(self.directory, ensure_ascii=False).encode(), 6)
        self.index.write(raw + len(raw).to_bytes(8, "little"))
        self.archive.close()
        self.index.close()
        return {"shard": self.shard, "stem": self.stem, "first_key": self.first, "last_key": self.last, "n_records": self.n}


class ArchiveReader:
    def __init__(self, folder: str, stem: str):
        fs, _ = arrow_folder(folder)
        self.archive, self.index = fs.open_input_file(stem + ".warc.gz"), fs.open_input_file(stem + ".idx")
        size = self.index.size()
        length = int.from_bytes(self.index.read_at(8, size - 8), "little")
        self.directory = json.loads(zlib.decompress(self.index.read_at(length, size - 8 - length)))
        self.firsts = [d[0] for d in self.directory]

    def block(self, k: int) -> list[list]:
        _, at, length = self.directory[k]
        return json.loads(zlib.decompress(self.index.read_at(length, at)))

    def captures(self, key: str) -> Iterator[list]:
        """Index entries of a key: bisection in the directory, then in its block."""
        k = max(bisect.bisect_left(self.firsts, key) - 1, 0)
        while k < len(self.directory) and self.firsts[k] <= key:
            entries = self.block(k)
            i = bisect.bisect_left(entries, key, key=lambda e: e[0])
            while i < len(entries) and entries[i][0] == key:
                yield entries[i]
                i += 1
            if i < len(entries):
                return
            k += 1

    def read(self, entries: list[list]) -> Iterator[dict]:
        """The records of index entries; neighbours in the archive are read together."""
        lo = 0
        while lo < len(entries):
            hi, start = lo + 1, entries[lo][2]
            end = start + entries[lo][3]
            while hi < len(entries) and entries[hi][2] == end and end + entries[hi][3] - start <= READ_BYTES:
                end += entries[hi][3]
                hi += 1
            raw = self.archive.read_at(end - start, start)
            for _, _, at, length in entries[lo:hi]:
                yield parse_record(gzip.decompress(raw[at - start : at - start + length]))
            lo = hi


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes ``pages`` (page_id, url, html) and returns the catalogue of archives:
    shard, stem, first_key, last_key, n_records.

    Null html is an empty payload. A page without page_id is never referred to;
    repeated rows are records of their own, of which the last stays the response.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumns({"key": url_key(F.col("url")), "digest": F.sha1("html"), "size": F.octet_length("html")})
    keyed = rows.select("page_id", "digest").where(F.col("size") >= LEAST_REVISIT_BYTES)
    twice = keyed.groupBy("digest").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1 and response is not null")
    referred = keyed.join(twice, "digest").where("page_id <> response or page_id is null").select("page_id", "digest", "response")
    referred = referred.groupBy("page_id", "digest").agg(F.max("response").alias("response"))
    referred = written(referred, "revisits")
    if referred.count() <= MAX_BROADCAST_REVISITS:
        referred = F.broadcast(referred)
    joined = rows.join(referred, rows.page_id.eqNullSafe(referred.page_id) & (rows.digest == referred.digest), "left").select(rows.page_id, "url", "key", "html", rows.digest, "response")
    dealt = joined.repartitionByRange(n_partitions(spark), "key", "page_id").sortWithinPartitions("key", "page_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = None
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "key", "html", "digest", "response")]
            for page_id, url, key, html, digest, response in zip(*columns, strict=True):
                writer = writer or ArchiveWriter(folder, TaskContext.get().partitionId())
                payload = html.as_py().encode()
                writer.add(key.as_py(), page_id.as_py(), make_record(page_id.as_py(), url.as_py(), payload, digest.as_py(), response.as_py()))
        if writer:
            yield pa.RecordBatch.from_pylist([writer.close()])

    schema = "shard long, stem string, first_key string, last_key string, n_records long"
    return written(dealt.select("page_id", "url", "key", "html", "digest", "response").mapInArrow(run, schema), "catalogue")


_RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_RESULT_ARROW = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read_archives(catalogue: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives, by way of the index blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for stem in batch.column("stem").to_pylist():
                reader = ArchiveReader(folder, stem)
                for k in range(len(reader.directory)):
                    found = [{c: r[c] for c in _RESULT_ARROW.names} for r in reader.read(reader.block(k))]
                    yield pa.RecordBatch.from_pylist(found, schema=_RESULT_ARROW)

    return catalogue.select("stem").repartition(2 * n_partitions(catalogue.sparkSession), "stem").mapInArrow(run, _RESULT)


def look_up(catalogue: DataFrame, folder: str, urls: DataFrame) -> DataFrame:
    """Captures of ``urls`` (url): url, page_id, record_type, payload_digest.

    URLs go to the archives whose key range holds them; those of one archive are dealt
    into up to 1024 parts by their key, each a group of its own that reads the archive's
    directory, the index blocks it needs and the records. Keys that no archive's range
    holds, null URLs and empty tables give no rows; repeated URLs repeat their captures.
    """
    wanted = urls.select("url", url_key(F.col("url")).alias("key")).withColumn("part", F.pmod(F.xxhash64("key"), F.lit(1024)))
    dealt = wanted.join(F.broadcast(catalogue.select("stem", "first_key", "last_key")), (F.col("key") >= F.col("first_key")) & (F.col("key") <= F.col("last_key")))

    def run(_: tuple, group: pa.Table) -> pa.Table:
        reader = ArchiveReader(folder, group["stem"][0].as_py())
        rows = []
        for url, key in zip(group["url"].to_pylist(), group["key"].to_pylist(), strict=True):
            rows += [{"url": url, **{c: r[c] for c in ("page_id", "record_type", "payload_digest")}} for r in reader.read(list(reader.captures(key)))]
        schema = pa.schema([("url", pa.string()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_digest", pa.string())])
        return pa.Table.from_pylist(rows, schema=schema)

    return dealt.groupBy("stem", "part").applyInArrow(run, "url string, page_id long, record_type string, payload_digest string")


def op8_warc_capture_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark, "warc")
    return read_archives(write_archives(read_table(spark, sf_dir, "pages"), folder), folder)


ORACLE_SQL = """
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes,
         sha1(coalesce(html, '')) AS payload_digest
  FROM pages
), named AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS response FROM payloads
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> response THEN response END AS refers_to
FROM named
"""
