import hashlib
import math
import random

import duckdb
import numpy as np
import pytest

from kinspan.llm.centroids import ORACLE_SQL, Block, assigned, k_means, op12_heap_bound_clusters, whole_vectors

KIND = "vec_id long, embedding array<double>, label int, cluster int, id long"


def plain(rows, k=8, rounds=10):
    """All distances of all rounds, in whole numbers of Python."""
    kept = [(i, [math.floor(1024 * c) for c in v]) for i, v in rows if v is not None and len(v) == 64 and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    centres = [v for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centres)]
    found = [(i, *nearest(v)) for i, v in kept]
    inertia = {n: sum(d for _, d, m in found if m == n) for _, _, n in found}
    return sorted(((-1 if i is None else i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[n])).encode()).hexdigest()) for i, d, n in found))


def run(spark, folder, rows):
    data = [(i, v, 0, 1, 2) for i, v in rows]
    spark.createDataFrame(data, KIND).repartition(3).write.parquet(str(folder / "embeddings.parquet"))
    out = op12_heap_bound_clusters(spark, str(folder))
    return sorted((-1 if r.vec_id is None else r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in out.collect())


def clusters(seed, n, spread):
    r = np.random.default_rng(seed)
    centres = r.normal(0, 1, (12, 64))
    return [(i, (centres[i % 12] + r.normal(0, spread, 64)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("seed", "spread"), [(1, 0.1), (2, 1.0)])
def test_equals_plain_rounds(spark, tmp_path, seed, spread):
    rows = clusters(seed, 400, spread)
    v = rows[0][1]
    odd = [(900, v[:63]), (901, [*v, 0.0]), (902, None), (903, [None, *v[1:]]), (904, [math.nan, *v[1:]]), (905, [math.inf, *v[1:]]), (906, [])]
    same = [(None, v), (None, v), (5, rows[5][1]), (5, rows[5][1]), *[(1000 + i, v) for i in range(150)]]
    assert run(spark, tmp_path, rows + odd + same) == plain(rows + odd + same)


def test_ties_and_few_vectors(spark, tmp_path):
    r = random.Random(4)
    rows = [(i, [float(r.randint(0, 1)) if k < 2 else 0.0 for k in range(64)]) for i in range(40)]
    (tmp_path / "a").mkdir()
    assert run(spark, tmp_path / "a", rows) == plain(rows)
    (tmp_path / "b").mkdir()
    assert run(spark, tmp_path / "b", rows[:3]) == plain(rows[:3])
    (tmp_path / "c").mkdir()
    assert run(spark, tmp_path / "c", []) == []
    (tmp_path / "d").mkdir()
    assert run(spark, tmp_path / "d", [(1, None)]) == []


def test_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql("create view embeddings as select * from '/root/testdata/sf0.01/embeddings.parquet'")
    expected = sorted(con.sql(f"select vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 from ({ORACLE_SQL}) q").fetchall())
    assert sorted(map(tuple, op12_heap_bound_clusters(spark, "/root/testdata/sf0.01").collect())) == expected


def test_only_expired_rows_are_popped():
    r = np.random.default_rng(7)
    v = np.concatenate([r.integers(-20, 20, (500, 64)) + 1000 * k for k in range(4)])
    centres = np.array([v[0], v[500], v[1000], v[1500]])
    block = Block.of(v, centres)
    for heap in block.heaps:
        assert all(heap[(i - 1) // 2] <= heap[i] for i in range(1, len(heap)))
    assert block.expired([1.0] * 4) == [[], [], [], []]
    again = Block.from_bytes(block.to_bytes(), block.sums, block.counts)
    assert again.heaps == block.heaps
    # Centroids wander, the drift grows: what wasn't popped is still right.
    drift, popped = [0.0] * 4, 0
    for _ in range(30):
        moved = centres + r.integers(-60, 60, centres.shape)
        ways = np.sqrt(((moved - centres) ** 2).sum(1))
        centres = moved
        drift = [d + w + max(np.delete(ways, c)) for c, (d, w) in enumerate(zip(drift, ways, strict=True))]
        rows = block.expired(drift)
        flat = [x for own in rows for x in own]
        popped += len(flat)
        if flat:
            block.rescan(rows, v[flat], centres, drift)
        expected = assigned(v, centres)[0]
        assert (block.clusters() == expected).all()
        assert all((block.sums[c] == v[expected == c].sum(0)).all() and block.counts[c] == (expected == c).sum() for c in range(4))
    assert 0 < popped < 30 * len(v) / 2


def test_components_beyond_a_long_are_left_out(spark):
    rows = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-131071.0, 3.0]), (3, [131073.0, 0.0])], "vec_id long, embedding array<double>")
    assert [r.id for r in whole_vectors(rows, "vec_id", "embedding", 2, 1024).collect()] == [2]
    found, centres = k_means(rows, k=3, dimensions=2)
    assert [tuple(r) for r in found.collect()] == [(2, 0, 0)] and centres == [[-131071 * 1024, 3072]]
