import gzip
import math
import random
import struct
import zlib
from bisect import bisect_left

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinspan.operators.clusters import components, density_clusters
from kinspan.operators.deletions import transmitted_deletions
from kinspan.operators.inference import bootstrap_logistic, poisson_weight
from kinspan.sources.pedigree import prune_generations
from kinspan.sources.tabix import indexed_variants, read_tabix


@pytest.mark.parametrize("seed", [1, 2])
def test_components_as_by_walking(spark, seed):
    r = random.Random(seed)
    links = [(r.randrange(80), r.randrange(80)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(60)] + [(5, 5)]
    nodes = sorted({x for p in links for x in p} | set(range(80)) | {900})
    label = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    found = components(spark.createDataFrame([(n,) for n in nodes], "node long"), spark.createDataFrame(links, "one long, two long"))
    assert {x.node: x.component for x in found.collect()} == label


@pytest.mark.parametrize(("reach", "least"), [(3.0, 4), (1.0, 3), (2.5, 1)])
def test_density_clusters_as_by_all_distances(spark, reach, least):
    r = random.Random(3)
    points = [(r.gauss(c, 2), r.gauss(-c, 2)) for c in (0, 12, 30) for _ in range(60)] + [(r.uniform(-20, 50), r.uniform(-50, 20)) for _ in range(60)] + [(40.0, 10.0)] * 9 + [(k * 0.9, 18.0) for k in range(40)]
    points = [(round(x, 1), round(y, 1)) for x, y in points]
    near = [[j for j, q in enumerate(points) if (p[0] - q[0]) ** 2 + (p[1] - q[1]) ** 2 <= reach * reach] for p in points]
    core = [len(n) >= least for n in near]
    label = list(range(len(points)))
    for _ in points:
        for i, n in enumerate(near):
            if core[i]:
                label[i] = min([label[i], *(label[j] for j in n if core[j])])
    rows = [(i, *p) for i, p in enumerate(points)] + [(-1, None, 1.0)]
    found = {x.i: x for x in density_clusters(spark.createDataFrame(rows, "i int, x double, y double"), "x", "y", reach, least).collect()}
    assert len(found) == len(rows) and found[-1].component is None
    names = {}
    for i, n in enumerate(near):
        assert found[i].is_core == core[i]
        if core[i]:
            assert names.setdefault(label[i], found[i].component) == found[i].component
        elif any(core[j] for j in n):
            away = lambda j: (points[i][0] - points[j][0]) ** 2 + (points[i][1] - points[j][1]) ** 2  # noqa: B023, E731
            least_way = min(away(j) for j in n if core[j])
            assert found[i].component in {found[j].component for j in n if core[j] and away(j) <= least_way + 1e-9}
        else:
            assert found[i].component is None
    assert len(set(names.values())) == len(names) > 1


def test_pruning_over_generations(spark):
    r = random.Random(4)
    people = [("F", i, r.randrange(i) if i > 3 and r.random() < 0.8 else None, r.randrange(i) if i > 3 and r.random() < 0.8 else None) for i in range(120)]
    people.append(("F", 500, 999, None))  # a parent without a row
    samples = {i for _, i, _, _ in people if r.random() < 0.15}
    left = {i for _, i, _, _ in people}
    while True:
        parents = {x for _, i, m, f in people if i in left for x in (m, f)}
        gone = {i for i in left if i not in samples and i not in parents}
        if not gone:
            break
        left -= gone
    df = spark.createDataFrame(people, "family string, individual int, mother int, father int")
    found = prune_generations(df, spark.createDataFrame([(s,) for s in samples] + [(None,)], "sample int"))
    assert sorted(x.individual for x in found.collect()) == sorted(left) and found.columns == df.columns
    assert prune_generations(df, spark.createDataFrame([], "sample int")).count() == 0


def test_bootstrap_as_by_weights(spark):
    r = random.Random(5)
    rows = [(i, x := r.choice([0.0, 0.5, 1.0]), z := r.randint(0, 1), int(r.random() < 1 / (1 + math.exp(-(0.3 + x - 0.8 * z)))), i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "i int, x double, z int, y int, s int")
    found = bootstrap_logistic(df, ["i"], ["x", "z"], "y", ["s"], replicates=40, seed=9)
    drawn = df.select("i", F.explode(F.sequence(F.lit(1), F.lit(40))).alias("r")).withColumn("w", poisson_weight(["i"], F.col("r"), 9)).collect()
    weight = np.zeros((40, len(rows)))
    for x in drawn:
        weight[x.r - 1, x.i] = x.w
    assert abs(weight.mean() - 1) < 0.03 and abs(weight.var() - 1) < 0.06
    data, y, s = np.array([[1, x, z] for _, x, z, _, _ in rows]), np.array([x[3] for x in rows]), np.array([x[4] for x in rows])

    def fit(w):
        b = np.zeros(3)
        for _ in range(30):
            p = 1 / (1 + np.exp(-data @ b))
            b = b + np.linalg.solve((data * (w * p * (1 - p))[:, None]).T @ data, data.T @ (w * (y - p)))
        return b

    betas = []
    for w in weight:
        for k in range(3):
            w[s == k] *= (s == k).sum() / w[s == k].sum()
        betas.append(fit(w))
    low, high = np.percentile(betas, [2.5, 97.5], axis=0)
    for x, b, lo, hi in zip(found, fit(np.ones(len(rows))), low, high, strict=True):
        assert np.allclose([x["coefficient"], x["low"], x["high"], x["odds_ratio"]], [b, lo, hi, math.exp(b)], atol=1e-6)


def test_fathers_x_and_unknown_phases(spark):
    kind = "family int, seg_id int, start_pos int, end_pos int, dels array<int>, phases array<struct<individual:string,mat:int,pat:int>>, is_hard boolean"
    both = [("a", 0, 2), ("b", 1, 3)]
    track = [([1, 1, 1, 1], both, False), ([0, 1, 0, 0], both, False), ([0, 1, 0, 0], both, False), ([1, 1, 1, 1], both, False), ([1, 0, 1, 1], [("a", 0, 2), ("b", None, 3)], False), ([1, 1, 1, 1], both, False), ([1, 0, 1, 1], both, True), ([1, 1, 1, 1], both, False), ([0, 1, 1, 1], [("a", 1, 2), ("b", 1, 3)], False), ([1, 1, 1, 1], both, False)]
    rows = [(1, k, 10 * k, 10 * k + 9, dels, phases, hard) for k, (dels, phases, hard) in enumerate(track)]
    df = spark.createDataFrame(rows, kind)
    found = sorted(transmitted_deletions(df, ["family"]).collect(), key=lambda x: x.haplotype)
    assert [(x.haplotype, x.start_pos, x.end_pos, x.length, x.opt_start_pos, x.is_double, x.trans, x.notrans) for x in found] == [(0, 10, 29, 20, 10, False, ["a"], ["b"]), (2, 10, 29, 20, 10, True, ["a"], ["b"]), (3, 10, 29, 20, 10, True, ["b"], ["a"])]
    only = transmitted_deletions(df, ["family"], spark.createDataFrame([(1, 3)], "family int, haplotype int"))
    assert sorted(x.haplotype for x in only.collect()) == [0, 3]


def bgzip(chunks):
    """Blocks of the format, and where each begins."""
    out, places = b"", []
    for data in [*chunks, b""]:
        places.append(len(out))
        packer = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = packer.compress(data) + packer.flush()
        out += b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\0\xff" + struct.pack("<H2sHH", 6, b"BC", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))
    return out, places


def indexed_file(folder, rows, block, prefix):
    """A sorted file of (chrom, pos) lines with its index."""
    header = b"##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\n"
    texts = [f"{prefix}{c}\t{p}\t.\tA\tC\t.\tPASS\tAF={k / 1000};N={'x' * (k % 90)}\n".encode() for k, (c, p) in enumerate(rows)]
    whole = header + b"".join(texts)
    chunks = [whole[i : i + block] for i in range(0, len(whole), block)]
    packed, places = bgzip(chunks)
    virtual = lambda at: places[at // block] << 16 | at % block
    at, linear, last = len(header), {}, {}
    for (c, p), text in zip(rows, texts, strict=True):
        windows = linear.setdefault(prefix + c, [])
        while len(windows) <= (p - 1) >> 14:
            windows.append(0)
        windows[(p - 1) >> 14] = windows[(p - 1) >> 14] or virtual(at)
        at += len(text)
        last[prefix + c] = virtual(at) if at < len(whole) else places[-1] << 16
    names = b"".join(n.encode() + b"\0" for n in linear)
    tbi = b"TBI\1" + struct.pack("<8i", len(linear), 2, 1, 2, 0, ord("#"), 0, len(names)) + names
    for name, windows in linear.items():
        first = next(w for w in windows if w)
        tbi += struct.pack("<iIiQQ", 1, 0, 1, first, last[name]) + struct.pack(f"<i{len(windows)}Q", len(windows), *windows)
    (folder / "v.vcf.gz").write_bytes(packed)
    (folder / "v.vcf.gz.tbi").write_bytes(gzip.compress(tbi))
    return str(folder / "v.vcf.gz"), [(c, p, t.decode().rstrip("\n")) for (c, p), t in zip(rows, texts, strict=True)]


@pytest.mark.parametrize(("block", "prefix"), [(700, "chr"), (65280, ""), (37, "")])
def test_ranges_of_an_indexed_file(spark, tmp_path, block, prefix):
    r = random.Random(7)
    rows = [(c, p) for c in ("1", "2", "X") for p in sorted(r.choices([*range(1, 3000), *range(60_000, 61_000), *range(200_000, 200_300)], k=250))]
    path, expected = indexed_file(tmp_path, rows, block, prefix)
    with gzip.open(path) as f:
        assert f.read().count(b"\n") == len(rows) + 2
    lines = read_tabix(spark, path, task_bytes=2000)
    assert sorted(map(tuple, lines.collect())) == sorted(expected)
    for c, lo, hi in (("1", 1, 10), ("2", 2500, 60_500), ("X", 200_100, 10**6), ("2", 30_000, 40_000), ("X", 400_000, 500_000), ("2", 60_200, 60_200)):
        asked = lines.where(f"chrom = '{c}' and pos between {lo} and {hi}")
        assert sorted(map(tuple, asked.collect())) == sorted(x for x in expected if x[0] == c and lo <= x[1] <= hi)
    assert lines.where("chrom = '9'").count() == 0
    got = indexed_variants(spark, path).where("chrom = '2' and pos <= 3000").select("pos", F.col("info")["AF"].alias("af")).collect()
    assert sorted((x.pos, float(x.af)) for x in got) == sorted((p, k / 1000) for k, (c, p) in enumerate(rows) if c == "2" and p <= 3000)


def test_bytes_outside_the_range_are_not_read(spark, tmp_path):
    rows = [("1", 20 * k + 1) for k in range(20_000)]
    path, expected = indexed_file(tmp_path, rows, 4000, "")
    raw = bytearray((tmp_path / "v.vcf.gz").read_bytes())
    raw[: len(raw) // 3] = b"\0" * (len(raw) // 3)
    (tmp_path / "v.vcf.gz").write_bytes(raw)
    asked = read_tabix(spark, path).where("chrom = '1' and pos > 300000 and pos < 310000")
    assert sorted(map(tuple, asked.collect())) == [x for x in expected if 300_000 < x[1] < 310_000]
    assert bisect_left([x[1] for x in expected], 300_000) > len(expected) / 3


def test_transmitted_deletions_in_one_order(spark):
    import random

    from kinspan.operators.deletions import transmission_contingency

    r = random.Random(18)
    rows = []
    for family in range(40):
        at = 0
        for seg in range(r.randint(1, 25)):
            begin, at = at, at + r.randint(1, 9)
            dels = [r.choice([0, 0, 0, 1, 1, None]) for _ in range(4)]
            phases = [(10 * family + k, r.choice([0, 0, 0, 1, None] if r.random() < 0.3 else [0]), r.choice([2, 3, None] if r.random() < 0.3 else [3])) for k in range(2)]
            rows.append((family, seg, begin, at, dels, phases, r.choice([False] * 8 + [True, None])))
    df = spark.createDataFrame(rows, "family int, seg_id int, start_pos long, end_pos long, dels array<int>, phases array<struct<individual: int, mat: int, pat: int>>, is_hard boolean")
    expected = []
    for family in range(40):
        track = [x for x in rows if x[0] == family]
        for h in range(4):
            pair, side = ((0, 1), 1) if h < 2 else ((2, 3), 2)
            both = [all(x[4][k] == 0 for k in pair) for x in track]
            state = [x[4][h] if b or any(c[side] == h for c in x[5]) else None for x, b in zip(track, both, strict=True)]
            k = 0
            while k < len(track):
                end = k
                while end < len(track) and state[end] == 0:
                    end += 1
                run = track[k:end]
                own = [[(c[0], c[side]) for c in x[5]] for x in run]
                told = [False if any(c[1] is None for c in o) else None if x[6] is None else not x[6] for x, o in zip(run, own, strict=True)]
                if run and k > 0 and end < len(track) and True in told and False not in told and all(o == own[0] for o in own):
                    intact = [i for i in range(k) if state[i] == 1]
                    trans, other = ([i for i, c in own[0] if (c == h) == has] for has in (True, False))
                    if trans:
                        s, e = run[0][2], run[-1][3]
                        expected.append((family, h, s, e, e - s + 1, track[intact[-1] + 1][2] if intact else track[1][2], both[k], trans, other))
                k = max(end, k + 1)
    found = transmitted_deletions(df, ["family"])
    # One order of the segments tells all four haplotypes.
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and plan.count("Sort [") == 1
    assert len(expected) > 50 and sorted(map(tuple, found.collect())) == sorted(expected)
    # Both tables of children come from one pass.
    people = spark.range(400).selectExpr("cast(id as int) as individual", "cast(1 + id % 2 as int) as phenotype")
    table = transmission_contingency(found, people, [])
    assert table._jdf.queryExecution().optimizedPlan().toString().count("explode(filter") == 1
    counts = {p: [sum(i % 2 == p - 1 for x in expected for i in x[k]) for k in (7, 8)] for p in (1, 2)}
    assert {x.phenotype: [x.n_transmitted, x.n_not_transmitted] for x in table.collect()} == counts
    unknown = spark.createDataFrame([([1], None), (None, [2]), ([3], [])], "trans array<int>, notrans array<int>")
    assert sorted(map(tuple, transmission_contingency(unknown, people, []).collect())) == [(1, 0, 1), (2, 2, 0)]
