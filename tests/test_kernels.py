"""Family model and statistics against enumeration and known values."""

from itertools import product
from math import comb

import numpy as np
import pandas as pd
import pytest

from kinspan.config import PhaseConfig
from kinspan.functions import stats
from kinspan.operators import hmm


@pytest.mark.parametrize("children,regions,count", [(1, 1, 5), (2, 1, 20), (2, 2, 40), (3, 1, 80)])
def test_state_counts(children, regions, count):
    assert len(hmm.states(children, PhaseConfig(n_regions=regions))) == count


def test_states_leave_with_the_rest_of_their_probability():
    before, cost = hmm.transitions(2, PhaseConfig())
    for row_before, row_cost in zip(before, cost, strict=True):
        assert np.isfinite(row_cost).sum() == len(set(row_before[np.isfinite(row_cost)]))


def brute(loss, weights, config, n_children, start):
    before, cost = hmm.transitions(n_children, config)
    step = {(int(b), k): c for k in range(len(before)) for b, c in zip(before[k], cost[k], strict=True) if np.isfinite(c)}
    best = np.inf
    for path in product(range(loss.shape[1]), repeat=len(loss)):
        if not start[path[0]]:
            continue
        total = sum(weights[j] * loss[j, s] for j, s in enumerate(path))
        total += sum(step.get((a, b), np.inf) for a, b in zip(path, path[1:], strict=False))
        best = min(best, total)
    return best


def test_viterbi_is_the_best_path():
    config, rng = PhaseConfig(deletion=2.0, maternal_crossover=1.5, paternal_crossover=1.7), np.random.default_rng(1)
    loss, weights = rng.random((5, 5)) * 4, np.array([1, 2, 1, 3, 1.0])
    before, cost = hmm.transitions(1, config)
    s = hmm.states(1, config)
    start = s.deleted.sum(1) == 0
    v = hmm.viterbi(loss, weights, before, cost, start)
    assert v[-1].min() == pytest.approx(brute(loss, weights, config, 1, start))


def family(n, crossover_at, deletion=None, seed=0):
    """Clean genotypes of a quad whose second child's maternal chromosome switches."""
    rng, rows = np.random.default_rng(seed), []
    for i in range(n):
        a = rng.integers(0, 2, 4)
        gone = [deletion is not None and deletion[0] <= i < deletion[1], False, False, False]
        second = 0 if i < crossover_at else 1

        def call(x, y, a=a, gone=gone):
            return 2 * a[y] if gone[x] else 2 * a[x] if gone[y] else a[x] + a[y]

        rows.append((10 * i + 1, 10 * i + 2, 1, [call(0, 1), call(2, 3), call(0, 2), call(second, 3)]))
    return pd.DataFrame(rows, columns=["start_pos", "end_pos", "weight", "gts"])


def test_a_crossover_is_found_where_it_is():
    found = hmm.phase_family(family(60, 30), hmm.uniform_costs(4, 1), 2, PhaseConfig())
    mats = [tuple(int(x) for x in m) for m in found["mat"]]
    assert mats[0] == (0, 0) and mats[-1] == (0, 1)
    assert [tuple(map(int, m)) for m in found["pat"]][-1] == (2, 3)
    switch = found.loc[[m[1] == 1 for m in mats], "start_pos"].min()
    assert 250 <= switch <= 360


def test_a_deletion_is_found():
    found = hmm.phase_family(family(80, 80, (20, 60), 3), hmm.uniform_costs(4, 1), 2, PhaseConfig())
    gone = found[[d[0] == 0 for d in found["dels"]]]
    assert len(gone) and gone["start_pos"].min() <= 350 and gone["end_pos"].max() >= 450
    assert hmm.deletion_quality(family(40, 40, (0, 40), 3), hmm.uniform_costs(4, 1), 2, PhaseConfig()) > 0


def test_exact_tests_equal_enumeration():
    for k, n, p in ((3, 10, 0.5), (0, 7, 0.2), (9, 9, 0.7)):
        mass = [comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(n + 1)]
        assert stats.binomial_p(pd.Series([k]), pd.Series([n]), pd.Series([p]))[0] == pytest.approx(sum(m for m in mass if m <= mass[k] * (1 + 1e-7)))
    a, b, c, d = 3, 1, 2, 6
    mass = {i: comb(a + b, i) * comb(c + d, a + c - i) / comb(a + b + c + d, a + c) for i in range(0, 5)}
    assert stats.fisher_p(*(pd.Series([x]) for x in (a, b, c, d)))[0] == pytest.approx(sum(m for m in mass.values() if m <= mass[a] * (1 + 1e-7)))
    assert stats.hypergeometric_sf(*(pd.Series([x]) for x in (3, 12, 4, 5)))[0] == pytest.approx(mass[3] + mass[4])


def test_tails_of_known_distributions():
    assert stats.chi2_p(pd.Series([3.841458820694124]), pd.Series([1]))[0] == pytest.approx(0.05)
    assert stats.chi2_p(pd.Series([5.991464547107979]), pd.Series([2]))[0] == pytest.approx(0.05)
    assert stats.t_p(pd.Series([2.2281388519649385]), pd.Series([10]))[0] == pytest.approx(0.05)


def test_equal_inputs_are_tested_once_and_joined_back(spark):
    df = spark.createDataFrame([(1, 3, 10), (2, 3, 10), (3, None, 10)], "id int, k int, n int").withColumn("p", __import__("pyspark").sql.functions.lit(0.5))
    seen = stats.on_distinct(df.where("k is not null"), ["k", "n", "p"], "pv", stats.binomial_p).collect()
    assert len(seen) == 2 and len({r.pv for r in seen}) == 1


def test_density_is_the_sum_of_gaussians(spark):
    from kinspan.operators.inference import gaussian_density

    points = [(1, 2), (1, 2), (3, 2), (9, 9)]
    got = {(r.x, r.y): r.density for r in gaussian_density(spark.createDataFrame(points, "x long, y long"), "x", "y", 2.0).collect()}
    for x, y in set(points):
        expected = sum(np.exp(-((x - a) ** 2 + (y - b) ** 2) / 8) for a, b in points) / (4 * 2 * np.pi * 4)
        assert got[x, y] == pytest.approx(expected, rel=1e-3)


def test_logistic_meets_its_equations(spark):
    from kinspan.operators.inference import logistic

    rng = np.random.default_rng(3)
    x = rng.normal(size=300)
    y = (rng.random(300) < 1 / (1 + np.exp(-(0.5 + 1.5 * x)))).astype(int)
    fit = logistic(spark.createDataFrame(list(zip(x.tolist(), y.tolist(), strict=True)), "x double, y int"), ["x"], "y")
    p = 1 / (1 + np.exp(-(fit[0]["coefficient"] + fit[1]["coefficient"] * x)))
    assert abs((y - p).sum()) < 1e-6 and abs((x * (y - p)).sum()) < 1e-6 and fit[1]["p"] < 1e-6


def test_permutations_keep_family_totals(spark):
    from kinspan.operators.inference import permutation_test

    people = spark.createDataFrame([(1, 1, 2, 5.0), (1, 2, 1, 1.0), (2, 3, 2, 4.0), (2, 4, 1, 2.0)], "family long, individual long, phenotype int, value double")
    out = {r.replicate: r.difference for r in permutation_test(people, 50).collect()}
    assert out[0] == 3.0 and set(out.values()) <= {3.0, -3.0, 1.0, -1.0} and len(set(out.values())) > 1


def test_replicates_are_neither_joined_nor_broadcast(spark):
    from kinspan.operators.inference import permutation_test

    rows = [(f, 10 * f + i, 1 + (f + i) % 2, (7 * f + 3 * i) % 11) for f in range(40) for i in range(1 + f % 5)]
    people = spark.createDataFrame(rows, "family long, individual long, phenotype int, value long")
    tested = permutation_test(people, 20)
    assert "Join" not in tested._jdf.queryExecution().optimizedPlan().toString()
    out = {r.replicate: r.difference for r in tested.collect()}
    mean = {k: np.mean([v for _, _, p, v in rows if p == k]) for k in (1, 2)}
    assert len(out) == 21 and out[0] == pytest.approx(mean[2] - mean[1])


def test_first_fit_within_islands(spark):
    from kinspan.operators.greedy import first_fit_clusters

    rows = [(1, 1, 0, 10), (2, 1, 1, 11), (3, 1, 8, 18), (4, 1, 40, 50), (5, 2, 0, 10)]
    found = dict(first_fit_clusters(spark.createDataFrame(rows, "iv_id long, chrom int, start_pos long, end_pos long"), ["chrom"]).collect())
    assert found == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}


def test_union_coverage_counts_all_partners(spark, monkeypatch):
    import random

    from kinspan.plans import registry

    r = random.Random(12)
    rows = [(i, f"chr{i % 2}", i // 2 % 2, b, b + r.randint(1, 60)) for i in range(240) for b in [r.randint(0, 3000)]]
    monkeypatch.setattr(registry.p, "interval", lambda *_: spark.createDataFrame(rows, "iv_id long, chrom string, is_mat int, start_pos long, end_pos long"))
    found = {x.iv_id: (x.covered, x.share) for x in registry.QUERIES["union_coverage_all"](spark, "").collect()}
    held = {(c, b) for _, c, m, s, e in rows if m == 0 for b in range(s, e)}
    covered = {i: sum((c, b) in held for b in range(s, e)) for i, c, m, s, e in rows if m == 1}
    assert found == {i: (covered[i], round(covered[i] / (e - s), 6)) for i, _, m, s, e in rows if m == 1}
    assert any(covered.values())


def test_families_side_by_side_are_as_one_by_one(spark, monkeypatch):
    rng, config, costs = np.random.default_rng(3), PhaseConfig(deletion=2.0, maternal_crossover=1.5, paternal_crossover=1.7), hmm.uniform_costs(4, 1)
    monkeypatch.setattr(hmm, "CELLS_AT_ONCE", 1500)
    rows = [(k // 2, f"chr{k % 2}", 3 * i, 3 * i + 2, int(rng.integers(1, 4)), [int(x) for x in rng.integers(-1, 3, 4)]) for k in range(14) for i in range(int(rng.integers(1, 40)))]
    bad = [(99, "chr1", 5, 6, 1, [1, 2])]
    table = spark.createDataFrame(rows + bad, "family long, chrom string, start_pos long, end_pos long, weight long, gts array<int>")
    found = sorted(map(tuple, hmm.phase(table.repartition(3), costs, 2, config).collect()), key=lambda x: (x[0], x[1], x[2] or 0))
    columns = ["start_pos", "end_pos", "dels", "mat", "pat", "loss_region"]
    expected = []
    for key, group in pd.DataFrame(rows, columns=["family", "chrom", "start_pos", "end_pos", "weight", "gts"]).groupby(["family", "chrom"]):
        told = hmm.phase_family(group.reset_index(drop=True), costs, 2, config)
        expected += [(str(key[0]), key[1], int(x.seg_idx), *[[int(v) for v in x[c]] if isinstance(x[c], np.ndarray) else int(x[c]) for c in columns], None) for _, x in told.iterrows()]
    assert [x for x in found if x[0] != "99"] == expected
    assert [x[-1] is not None for x in found if x[0] == "99"] == [True]
