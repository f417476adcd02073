"""Exact k-means over integer vectors, with heap-ordered bounds.

The vectors are written once, in blocks that can be read by ranges of rows. Of each block
and cluster a heap is kept: an entry is a vector with its gap, the distance to the second
nearest centroid less that to its own, plus what the cluster had drifted when the gap was
taken. A cluster's drift grows each round by how far its own centroid moved and by the
longest way that another one moved, so that a vector cannot change its cluster while its
entry is above the drift. Only what lies below is popped, read from its block and scanned
against all centroids; the rest of the heap isn't looked at. Bounds are kept a little too
tight for rounding; scans are in whole numbers.

A round is one job over the blocks' state (heaps, sums), which is written anew, so that a
lost executor costs the blocks it held and no vectors travel between rounds; the driver
holds the centroids alone.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import arrow_folder, read_table, shared_folder, written

DIMENSIONS = 64
SCALE = 1024
#: Components beyond this (in whole numbers) would give squared distances beyond a long.
LARGEST = 1 << 27
BLOCK_ROWS = 1 << 13
#: Popped rows of a block that lie no further apart are read at once.
READ_GAP = 16
#: By so much of their size bounds are tighter, for rounding.
SLACK = 1e-9

_STATE = "path string, place long, n int, heaps binary, sums array<long>, counts array<long>"
_STATE_ARROW = pa.schema([("path", pa.string()), ("place", pa.int64()), ("n", pa.int32()), ("heaps", pa.binary()), ("sums", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, dimensions: int, scale: int) -> DataFrame:
    """(id, v): vectors of so many components, none null or non-finite, as whole numbers.

    A component of more than LARGEST has no squared distance within a long; its row is left
    out like one that is not finite.
    """
    x = F.col(vector_col).cast("array<double>")
    sound = (F.size(x) == dimensions) & F.forall(x, lambda c: c.isNotNull() & (F.abs(c) * scale < LARGEST))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), x.alias("x")).where(F.coalesce(sound, F.lit(False)))
    return rows.select("id", F.transform("x", lambda c: F.floor(c * scale).cast("int")).alias("v"))


def first_centroids(rows: DataFrame, k: int, seed: str) -> list[list[int]]:
    """Vectors of the ``k`` smallest SHA-256 of ``seed``:id, in that order; equal ids by
    their vectors. Rows without id come last, and fewer rows give fewer centroids."""
    named = rows.withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256))
    return [list(r.v) for r in named.orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()]


def distances(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances, a column a centroid, exactly."""
    out = np.empty((len(v), len(centroids)), np.int64)
    for c, centre in enumerate(centroids):
        d = v - centre
        out[:, c] = np.einsum("ij,ij->i", d, d)
    return out


def assigned(v: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector (of equal ones the first), and its gap."""
    squared = distances(v, centroids)
    nearest = squared.argmin(1)
    if len(centroids) == 1:
        return nearest, np.full(len(v), np.inf)
    two = np.sqrt(np.partition(squared, 1, axis=1)[:, :2].astype(float))
    return nearest, (two[:, 1] - two[:, 0]) - SLACK * (1 + two[:, 1])


class Block:
    """The state of a block: for each cluster a heap of (gap plus drift then, row)."""

    def __init__(self, heaps: list[list[tuple[float, int]]], sums: np.ndarray, counts: np.ndarray):
        self.heaps, self.sums, self.counts = heaps, sums, counts

    @classmethod
    def of(cls, v: np.ndarray, centroids: np.ndarray) -> Block:
        k = len(centroids)
        block = cls([[] for _ in range(k)], np.zeros((k, v.shape[1]), np.int64), np.zeros(k, np.int64))
        nearest, gaps = assigned(v, centroids)
        for c in range(k):
            mine = np.flatnonzero(nearest == c)
            order = mine[np.argsort(gaps[mine], kind="stable")]  # in rising order: a heap
            block.heaps[c] = list(zip(gaps[order].tolist(), order.tolist(), strict=True))
            block.sums[c], block.counts[c] = v[mine].sum(0), len(mine)
        return block

    def expired(self, drift: list[float]) -> list[list[int]]:
        """Pops the rows of each cluster whose gaps its drift has used up."""
        out = []
        for heap, used in zip(self.heaps, drift, strict=True):
            rows = []
            while heap and heap[0][0] <= used:
                rows.append(heapq.heappop(heap)[1])
            out.append(rows)
        return out

    def rescan(self, rows: list[list[int]], v: np.ndarray, centroids: np.ndarray, drift: list[float]) -> None:
        """Scans popped rows (``v``: their vectors, in order) and puts each into its heap."""
        was = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        flat = [r for own in rows for r in own]
        nearest, gaps = assigned(v, centroids)
        for row, c, gap in zip(flat, nearest.tolist(), gaps.tolist(), strict=True):
            heapq.heappush(self.heaps[c], (gap + drift[c], row))
        moved = np.flatnonzero(was != nearest)
        np.subtract.at(self.sums, was[moved], v[moved])
        np.add.at(self.sums, nearest[moved], v[moved])
        self.counts += np.bincount(nearest[moved], minlength=len(self.counts)) - np.bincount(was[moved], minlength=len(self.counts))

    def clusters(self) -> np.ndarray:
        """The cluster of each row."""
        out = np.zeros(sum(map(len, self.heaps)), np.int32)
        for c, heap in enumerate(self.heaps):
            out[[row for _, row in heap]] = c
        return out

    def to_bytes(self) -> bytes:
        """Sizes of the heaps, then all gaps, then all rows, in heap order."""
        flat = [e for heap in self.heaps for e in heap]
        sizes = struct.pack(f"<{len(self.heaps) + 1}i", len(self.heaps), *map(len, self.heaps))
        return sizes + np.array([g for g, _ in flat], "<f8").tobytes() + np.array([r for _, r in flat], "<i4").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes, sums: np.ndarray, counts: np.ndarray) -> Block:
        (k,) = struct.unpack_from("<i", raw)
        sizes = struct.unpack_from(f"<{k}i", raw, 4)
        n, at = sum(sizes), 4 * (k + 1)
        gaps, rows = np.frombuffer(raw, "<f8", n, at).tolist(), np.frombuffer(raw, "<i4", n, at + 8 * n).tolist()
        ends = np.cumsum(sizes).tolist()
        return cls([list(zip(gaps[e - s : e], rows[e - s : e], strict=True)) for s, e in zip(sizes, ends, strict=True)], sums, counts)


class BlockFile:
    """Reads vectors of a block: its ids, a byte each whether they are known, its rows."""

    def __init__(self, path: str, place: int, n: int, dimensions: int):
        fs, at = arrow_folder(path)
        self.file, self.place, self.n, self.width = fs.open_input_file(at), place, n, 4 * dimensions

    def ids(self) -> list[int | None]:
        raw = self.file.read_at(9 * self.n, self.place)
        known = np.frombuffer(raw, np.uint8, self.n, 8 * self.n)
        return [i if k else None for i, k in zip(np.frombuffer(raw, "<i8", self.n).tolist(), known.tolist(), strict=True)]

    def rows(self, lo: int, hi: int) -> np.ndarray:
        raw = self.file.read_at((hi - lo) * self.width, self.place + 9 * self.n + lo * self.width)
        return np.frombuffer(raw, "<i4").reshape(hi - lo, -1).astype(np.int64)

    def some(self, rows: np.ndarray) -> np.ndarray:
        """Vectors of ``rows``, in their order; neighbours are read at once."""
        order = np.sort(rows)
        cuts = np.flatnonzero(np.diff(order) > READ_GAP) + 1
        out = np.empty((len(rows), self.width // 4), np.int64)
        where = np.argsort(rows, kind="stable")
        at = 0
        for own in np.split(order, cuts):
            if len(own):
                lo = int(own[0])
                out[where[at : at + len(own)]] = self.rows(lo, int(own[-1]) + 1)[own - lo]
                at += len(own)
        return out


def write_blocks(rows: DataFrame, folder: str, centroids: list[list[int]]) -> DataFrame:
    """Writes the vectors of ``rows`` (id, v), a file a task, and assigns them: the state.

    A file's name is new for each attempt, and only names in the written state count.
    """
    centres = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = arrow_folder(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{uuid.uuid4().hex}.vectors"
        out, place = None, 0
        try:
            for batch in batches:
                for lo in range(0, batch.num_rows, BLOCK_ROWS):
                    part = batch.slice(lo, BLOCK_ROWS)
                    ids = part.column(0)
                    v = part.column(1).flatten().to_numpy(zero_copy_only=False).astype("<i4").reshape(len(ids), -1)
                    raw = ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes() + np.asarray(ids.is_valid()).astype(np.uint8).tobytes() + v.tobytes()
                    out = out or fs.open_output_stream(f"{root}/{name}", compression=None)
                    out.write(raw)
                    block = Block.of(v.astype(np.int64), centres)
                    yield _state_row(f"{folder}/{name}", place, len(ids), block)
                    place += len(raw)
        finally:
            if out:
                out.close()

    return written(rows.mapInArrow(run, _STATE), "clusters")


def _state_row(path: str, place: int, n: int, block: Block) -> pa.RecordBatch:
    values = (path, place, n, block.to_bytes(), block.sums.ravel(), block.counts)
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(values, _STATE_ARROW, strict=True)], schema=_STATE_ARROW)


def _blocks(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[dict, Block]]:
    for batch in batches:
        for i in range(batch.num_rows):
            (row,) = batch.slice(i, 1).to_pylist()
            yield row, Block.from_bytes(row["heaps"], np.array(row["sums"], np.int64).reshape(-1, dimensions), np.array(row["counts"], np.int64))


def advance(state: DataFrame, centroids: list[list[int]], drift: list[float]) -> DataFrame:
    """The state after a round's move: expired vectors in the clusters of their nearest centroids."""
    centres = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _blocks(batches, centres.shape[1]):
            rows = block.expired(drift)
            flat = np.array([r for own in rows for r in own], np.int64)
            if len(flat):
                file = BlockFile(row["path"], row["place"], row["n"], centres.shape[1])
                block.rescan(rows, file.some(flat), centres, drift)
            yield _state_row(row["path"], row["place"], row["n"], block)

    return written(state.mapInArrow(run, _STATE), "clusters")


def totals(state: DataFrame, k: int, dimensions: int) -> tuple[list[list[int]], list[int]]:
    """Sums and counts of all clusters: a few numbers a cluster, added up by Spark."""
    flat = state.select(F.posexplode(F.concat("sums", "counts")).alias("at", "x"))
    found = {r["at"]: int(r["x"]) for r in flat.groupBy("at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()}
    whole = [found.get(i, 0) for i in range(k * (dimensions + 1))]
    return [whole[c * dimensions : (c + 1) * dimensions] for c in range(k)], whole[k * dimensions :]


def members(state: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(id, cluster, distance) of every vector, read and measured exactly."""
    centres = np.array(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, block in _blocks(batches, centres.shape[1]):
            file = BlockFile(row["path"], row["place"], row["n"], centres.shape[1])
            clusters = block.clusters()
            d = file.rows(0, row["n"]) - centres[clusters]
            yield pa.RecordBatch.from_arrays([pa.array(file.ids(), pa.int64()), pa.array(clusters, pa.int32()), pa.array(np.einsum("ij,ij->i", d, d), pa.int64())], ["id", "cluster", "distance"])

    return state.mapInArrow(run, "id long, cluster int, distance long")


def k_means(vectors: DataFrame, k: int = 8, rounds: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE, seed: str = "3") -> tuple[DataFrame, list[list[int]]]:
    """(id, cluster, distance) of each vector, and the centroids.

    Vectors of another length, or with null or non-finite components, are left out. A null
    id stays null, rows of one id are vectors of their own; of equally near centroids the
    first one counts; a cluster without vectors keeps its centroid; fewer vectors than ``k``
    give as many centroids; without any there are no rows. Rounds end early once no
    centroid moves, as nothing would change in those left.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, id_col, vector_col, dimensions, scale)
    centroids = first_centroids(rows, k, seed)
    if not centroids:
        return spark.createDataFrame([], f"{id_col} long, cluster int, distance long"), []
    state = write_blocks(rows, shared_folder(spark, "vectors"), centroids)
    drift = [0.0] * len(centroids)
    for _ in range(rounds):
        sums, counts = totals(state, len(centroids), dimensions)
        moved = [[s // n for s in own] if n else old for own, n, old in zip(sums, counts, centroids, strict=True)]
        ways = [math.dist(a, b) * (1 + SLACK) for a, b in zip(moved, centroids, strict=True)]
        if not any(ways):
            break
        centroids = moved
        drift = [d + own + max([w for j, w in enumerate(ways) if j != c], default=0.0) for c, (d, own) in enumerate(zip(drift, ways, strict=True))]
        state = advance(state, centroids, drift)
    return members(state, centroids).withColumnRenamed("id", id_col), centroids


def fingerprint(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def _long(x: Column) -> Column:
    return x.try_cast("long")


def op12_heap_bound_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight clusters of all vectors of 64 components, and how tight they are."""
    found, centroids = k_means(read_table(spark, sf_dir, "embeddings"))
    found = written(found, "members")
    # A row a cluster.
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("own"))
    whole = sums.agg(_long(F.sum("own")).alias("inertia"))
    names = spark.createDataFrame([(c, fingerprint(x)) for c, x in enumerate(centroids)], "cluster int, centroid_sha256 string")
    about = sums.select("cluster", _long(F.col("own")).alias("cluster_inertia")).crossJoin(F.broadcast(whole)).join(F.broadcast(names), "cluster")
    return found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 8, rounds: int = 10) -> str:
    """The same rounds, one CTE each, over components as rows of their own."""
    parts = [
        f"""WITH x AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda c: CAST(c AS DOUBLE)) AS e FROM embeddings WHERE len(embedding) = {DIMENSIONS}
), v AS MATERIALIZED (SELECT r, vec_id, list_transform(e, lambda c: CAST(floor({SCALE} * c) AS BIGINT)) AS w FROM x WHERE len(list_filter(e, lambda c: c IS NOT NULL AND isfinite(c))) = {DIMENSIONS}
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256(concat('3:', vec_id)), w) - 1 AS c, w FROM v ORDER BY sha256(concat('3:', vec_id)), w LIMIT {k})"""
    ]
    for i in range(rounds + 1):
        between = "CAST(list_sum(list_transform(list_zip(v.w, c.w), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
        parts.append(f"a{i} AS MATERIALIZED (SELECT r, arg_min(c, d * {k} + c) AS c, min(d) AS d FROM (SELECT v.r, c.c, {between} AS d FROM v CROSS JOIN c{i} c) q GROUP BY r)")
        if i < rounds:
            parts.append(f"m{i} AS (SELECT c, p, CAST(floor(sum(x) / count(*)) AS BIGINT) AS x FROM (SELECT a.c, unnest(v.w) AS x, unnest(range({DIMENSIONS})) AS p FROM a{i} a JOIN v ON v.r = a.r) z GROUP BY c, p)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.w, c.w) AS w FROM c{i} c LEFT JOIN (SELECT c, list(x ORDER BY p) AS w FROM m{i} GROUP BY c) m ON m.c = c.c)")
    return ", ".join(parts) + f" SELECT v.vec_id, CAST(a.c AS INT) AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.w, ',')) AS centroid_sha256 FROM a{rounds} a JOIN v ON v.r = a.r JOIN c{rounds} c ON c.c = a.c"


ORACLE_SQL = _oracle()
