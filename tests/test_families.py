import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from kinspan.functions.intervals import last_known, stabbed
from kinspan.operators.deletions import imprinting_partners
from kinspan.operators.error_rates import GENOTYPES, confusion, error_profiles, true_genotypes, write_error_profiles, zygosity
from kinspan.operators.greedy import dedupe_collections, similar_collections
from kinspan.operators.recombination import known_state_changes, spread_evenly
from kinspan.sources.files import read_error_profiles


def by_loop(sets, weights, share):
    """One collection after the other, largest first."""
    order = sorted(sets, key=lambda c: (-weights[c], c))
    gone = set()
    for c in order:
        if c not in gone:
            for d in sets:
                if d != c and (d in sets[c] or c in sets[d]):
                    n = len(sets[c] & sets[d])
                    if n >= share * len(sets[c]) and n >= share * len(sets[d]) and order.index(d) > order.index(c):
                        gone.add(d)
    return {c: c not in gone for c in sets}


@pytest.mark.parametrize(("seed", "share"), [(1, 0.8), (2, 0.8), (3, 0.5)])
def test_collections_stay_as_in_the_loop(spark, seed, share):
    r = random.Random(seed)
    sets = {}
    for c in range(120):
        if c and r.random() < 0.7:
            old = sets[r.randrange(c)]
            sets[c] = {m for m in old if r.random() > 0.06} | {c} | {r.randrange(120) for _ in range(r.randint(0, 1))}
        else:
            sets[c] = {c} | {r.randrange(120) for _ in range(r.randint(0, 25))}
    weights = {c: r.randint(1, 6) for c in sets}
    rows = [(c, m) for c, s in sets.items() for m in s]
    members = spark.createDataFrame(rows + rows[:50] + [(None, 1), (1, None)], "collection long, member long")
    pairs = {tuple(p) for p in similar_collections(members, share).collect()}
    for a, b in itertools.combinations(sets, 2):
        n = len(sets[a] & sets[b])
        near = (b in sets[a] or a in sets[b]) and n >= share * len(sets[a]) and n >= share * len(sets[b])
        assert ((a, b) in pairs) == near
    table = spark.createDataFrame(list(weights.items()), "collection long, weight long")
    kept = {x.collection: x.is_kept for x in dedupe_collections(table, similar_collections(members, share)).collect()}
    assert kept == by_loop(sets, weights, share) and not all(kept.values())


def test_no_similar_collections(spark):
    table = spark.createDataFrame([(1, 2), (2, 2)], "collection long, weight long")
    none = spark.createDataFrame([], "one long, two long")
    assert [x.is_kept for x in dedupe_collections(table, none).collect()] == [True, True]


def family_calls(seed):
    r = random.Random(seed)
    masks = {"m": 3, "f": 12, "a": 5, "b": 9, "c": 6}
    out = []
    for site in range(120):
        truth = r.randrange(16)
        for name, mask in masks.items():
            gt = (mask & truth).bit_count()
            gt = -1 if r.random() < 0.05 else r.randint(0, 2) if r.random() < 0.1 else gt
            out.append(("F", site, name, mask if site != 7 or name != "a" else None, gt, site % 2))
    return out


def test_error_profiles_as_by_plain_counts(spark, tmp_path):
    calls = family_calls(3)
    df = spark.createDataFrame(calls, "family string, pos int, individual string, mask int, gt int, region int")
    found = true_genotypes(df, ["family", "pos"])
    expected, num = [], {}
    for site in sorted({c[1] for c in calls} - {7}):
        rows = [c for c in calls if c[1] == site]
        scores = [sum(c[4] >= 0 and (c[3] & a).bit_count() != c[4] for c in rows) for a in range(16)]
        best, fits = scores.index(min(scores)), scores.count(min(scores))
        for c in rows:
            true = (c[3] & best).bit_count()
            expected.append((site, c[2], c[4], true, fits))
            key = (c[2], c[5], true, c[4])
            num[key] = num.get(key, 0) + 1 / fits
    assert sorted((r.pos, r.individual, r.gt, r.true_gt, r.n_fits) for r in found.collect()) == sorted(expected)
    profiles = error_profiles(confusion(found))
    costs = {(r.individual, r.region, r.true_gt, r.obs_gt): r.cost for r in profiles.collect()}
    people = "mfabc"

    def n(ind, region, g, o):
        return num.get((ind, region, g, o), 0)

    for ind, region, g in itertools.product(people, (0, 1), range(3)):
        made = lambda i, t: sum(n(i, region, t, o) for o in range(3))  # noqa: E731, B023
        shares = {3: sum(n(ind, region, t, -1) for t in range(3)) / sum(made(ind, t) for t in range(3))}
        for o in set(range(3)) - {g}:
            if n(ind, region, g, o) == 0:
                whole = sum(made(i, g) for i in people)
                shares[o] = sum(n(i, region, g, o) for i in people) / whole if whole else None
            else:
                shares[o] = n(ind, region, g, o) / made(ind, g)
        shares[g] = None if None in shares.values() or sum(shares.values()) >= 1 else 1 - sum(shares.values())
        for o, p in shares.items():
            cost = costs[ind, region, GENOTYPES[g], [*GENOTYPES, "./."][o]]
            assert cost is None if p is None else cost == math.inf if p == 0 else math.isclose(cost, -math.log10(p), abs_tol=1e-9)
    # Written, they are what the reader of profiles reads.
    paths = []
    for region in (0, 1):
        paths.append(str(tmp_path / f"r{region}"))
        write_error_profiles(profiles.where(F.col("region") == region), paths[-1], files=2)
    back = {(r.individual, r.region, r.true_gt, r.obs_gt): r.cost for r in read_error_profiles(spark, paths).collect()}
    assert back == {k: v for k, v in costs.items() if v is not None and v < math.inf}


def test_zygosity_as_over_all_configurations(spark):
    r, rows = random.Random(5), []
    for family in range(150):
        n = r.randint(0, 4)
        for k, mask in enumerate([3, 12, *[r.choice([5, 6, 9, 10]) for _ in range(n)]]):
            rows.append((family, k, mask, r.random() < (0.15 if family % 3 else 0.0)))
    rows += [(900, 0, None, True), (900, 1, 12, None), (901, 0, 3, True), (901, 1, 12, True), (901, 2, 5, True)]
    df = spark.createDataFrame(rows, "family long, k int, mask int, is_double boolean")
    found = {(x.family, x.k): x for x in zygosity(df, ["family"]).collect()}
    assert len(found) == len(rows)
    seen = set()
    for family, k, mask, double in rows:
        options = [a for a in range(16) if all(((m & a).bit_count() == 2) == d for f, _, m, d in rows if f == family and m is not None and d is not None)]
        x = found[family, k]
        assert x.n_options == len(options)

        def agreed(bits, names):
            doses = {(bits & a).bit_count() for a in options}  # noqa: B023
            return "maybe" if len(doses) > 1 else names[doses.pop()]

        if mask is None or double is None or not options:
            assert (x.zygosity, x.maternal, x.paternal) == (None, None, None)
            continue
        assert x.zygosity == agreed(mask, ["none", "single", "double"])
        assert x.maternal == (agreed(mask & 3, ["no", "yes", "yes"]) if mask & 3 else None)
        assert x.paternal == (agreed(mask & 12, ["no", "yes", "yes"]) if mask & 12 else None)
        seen.add(x.zygosity)
    assert seen == {"none", "single", "double", "maybe"}


def test_known_states_are_handed_on(spark):
    r = random.Random(6)
    rows = []
    for family in range(6):
        at = r.randint(0, 30)
        for _ in range(150):
            end = at + r.choice([1, 3, 40, 900])
            rows.append((family, at, end, r.choice([None, None, 0, 1])))
            at = end + r.choice([0, 0, 5, 400])
    df = spark.createDataFrame(rows, "family int, start_pos long, end_pos long, state int")
    expected = []
    for family in range(6):
        state = end = None
        for _, a, b, s in sorted(x for x in rows if x[0] == family):
            if s is not None:
                if state is not None and s != state:
                    expected.append((family, end, a, state, s))
                state, end = s, b
    for width in (64, 1 << 20):
        changes = known_state_changes(df, ["family"], "state", width)
        assert sorted(map(tuple, changes.collect())) == sorted(expected)
        assert last_known(df, ["family"], "state", width).count() == sum(x[3] is not None for x in rows)
        weights = {}
        for _, a, b, _, _ in expected:
            for p in range(a, b):
                weights[p] = weights.get(p, 0) + 1 / (b - a)
        spread = spread_evenly(changes.withColumn("chrom", F.lit(1)), ["chrom"], width).collect()
        assert math.isclose(sum(x.weight for x in spread), sum(b > a for _, a, b, _, _ in expected), rel_tol=1e-9)
        for x in r.sample(spread, 60):
            assert math.isclose(x.weight, sum(weights[p] for p in range(x.start_pos, x.end_pos)), rel_tol=1e-7)


def intervals_of(r, n, longest):
    return [(k, r.randint(1, 3), s := r.randint(-100, 4000), s + int(r.paretovariate(0.4)) % longest, r.randint(0, 1), r.random() < 0.5) for k in range(n)]


def test_disomies_agree_with_those_that_share_half(spark):
    r = random.Random(7)
    upds, dels = intervals_of(r, 90, 3000), intervals_of(r, 200, 100_000)
    u = spark.createDataFrame(upds, "upd_id long, chrom int, start_pos long, end_pos long, is_mat int, is_iso boolean")
    d = spark.createDataFrame([x[:5] for x in dels], "iv_id long, chrom int, start_pos long, end_pos long, is_mat int")
    expected = []
    for i, chrom, a, b, mat, iso in upds:
        def shares(x):
            return x[1] == chrom and min(b, x[3]) - max(a, x[2]) > 0.5 * (b - a)  # noqa: B023

        others = [x for x in upds if x[0] > i and x[4] == mat and shares(x)]
        n = sum(x[4] != mat and shares(x) for x in dels)
        if others or n:
            expected.append((i, sum(x[5] for x in others) + iso, sum(not x[5] for x in others) + (not iso), n))
    assert sorted(map(tuple, imprinting_partners(u, d, ["chrom"]).collect())) == sorted(expected)


def test_partners_of_half_are_counted_without_pairs(spark):
    import numpy as np

    from kinspan.operators.deletions import _sums_of_half

    r = np.random.default_rng(3)
    for n, q, longest, axis in ((0, 5, 5, 50), (7, 0, 9, 50), (300, 200, 40, 100), (400, 300, 400, 300)):
        t, s, i, j, w = r.integers(-axis, axis, n), r.integers(-axis, axis, q), r.integers(0, 99, n), r.integers(0, 99, q), r.integers(0, 5, (n, 2))
        f, e = t + r.integers(1, longest + 1, n), s + r.integers(1, longest + 1, q)
        met = 2 * (np.minimum(e[:, None], f) - np.maximum(s[:, None], t)) > (e - s)[:, None]
        assert (_sums_of_half(t, f, w, s, e, [], []) == met.astype(int) @ w).all()
        assert (_sums_of_half(t, f, w, s, e, [i], [j + 1]) == (met & (i > j[:, None])).astype(int) @ w).all()
    # 800 million pairs at one place; an axis or bound that is unknown meets none.
    u = spark.range(20_000).selectExpr("id as upd_id", "if(id = 7, null, 1) as chrom", "10L as start_pos", "if(id = 9, null, 50L) as end_pos", "1 as is_mat", "id % 2 = 0 as is_iso")
    d = spark.range(40_000).selectExpr("id as iv_id", "if(id = 0, null, 1) as chrom", "30L - id % 2 as start_pos", "if(id = 2, null, 80L) as end_pos", "0 as is_mat")
    found = imprinting_partners(u, d, ["chrom"])
    assert "SortMergeJoin" not in (plan := found._jdf.queryExecution().executedPlan().toString()) and "HashJoin" not in plan
    rows = {x.upd_id: tuple(x)[1:] for x in found.collect()}
    assert len(rows) == 19_998 and rows[0] == (10_000, 9_998, 20_000) and rows[19_999] == (0, 1, 20_000) and rows[19_998] == (1, 1, 20_000)


def test_siblings_are_compared_without_a_table_by_family(spark):
    import re

    from kinspan.operators.summaries import sibling_difference

    r = random.Random(21)
    people = [(s // 5 if s < 95 else None, s, r.choice([1, 1, 2, 2, None])) for s in range(100)]
    calls = [(c, p, s, r.randint(-1, 2)) for c in (1, 2) for p in range(12) for s in range(100) if r.random() < 0.6]
    found = sibling_difference(spark.createDataFrame(calls, "chrom int, pos long, sample long, gt int"), spark.createDataFrame(people, "family long, sample long, phenotype int"))
    by = {}
    for c, p, s, gt in calls:
        family, _, phenotype = people[s]
        if gt >= 0:
            by.setdefault((c, p, family), {}).setdefault(phenotype, []).append(gt)
    expected = {}
    for (c, p, _), kinds in by.items():
        if 1 in kinds and 2 in kinds:
            a, b = (sum(kinds[k]) / len(kinds[k]) for k in (2, 1))
            n = expected.setdefault((c, p), [0, 0])
            n[0] += a > b
            n[1] += a < b
    assert {(x.chrom, x.pos): [x.n_more, x.n_fewer] for x in found.collect()} == expected
    # Each family's few calls of a site are met in order: no hash table of all calls is held.
    assert not re.search(r"Aggregate\(keys=\[[^\]]*family", found._jdf.queryExecution().executedPlan().toString())


def test_long_intervals_fall_into_two_bins_at_most(spark):
    r = random.Random(8)
    rows = [(k, a := r.randint(-10_000, 10_000), a + r.choice([0, 1, 7, 900, 10**9, 10**12])) for k in range(150)]
    points = [(k, r.randint(-12_000, 2 * 10**12) if k % 2 else r.randint(-12_000, 12_000)) for k in range(150)]
    one = spark.createDataFrame([(*x, "c") for x in points], "k int, pos long, chrom string")
    two = spark.createDataFrame([(*x, "c") for x in rows], "iv int, start_pos long, end_pos long, chrom string")
    pairs = stabbed(one, two, ["chrom"])
    assert sorted((x.k, x.r_iv) for x in pairs.collect()) == sorted((k, i) for k, p in points for i, a, b in rows if a <= p < b)
    assert stabbed(one, two.where("false"), ["chrom"]).count() == 0


def test_near_collections_by_enumeration(spark):
    from kinspan.operators.deletions import near_collections
    from kinspan.operators.greedy import keep_first

    r = random.Random(17)
    rows = [(k, r.choice([1, 1, 2, None]), s, s + r.choice([0, 3, 40, 44, 90, 100, 104]), r.randint(1, 2)) for k in range(220) for s in [r.randint(-30, 60)]]
    table = spark.createDataFrame(rows, "iv_id long, chrom int, start_pos long, end_pos long, n_children int")
    named, sizes, similar = near_collections(table, ["chrom"], 0.9, 0.8)
    found = named.join(keep_first(sizes, similar), "collection").collect()

    def meets(x, y):
        n = min(x[3], y[3]) - max(x[2], y[2]) + 1
        return x[0] == y[0] or (x[1] is not None and x[1] == y[1] and x[2] < y[3] and y[2] < x[3] and n >= 0.9 * (x[3] - x[2] + 1) and n >= 0.9 * (y[3] - y[2] + 1))

    sets = {x[0]: {y[0] for y in rows if meets(x, y)} for x in rows}
    weights = {k: sum(rows[m][4] for m in s) for k, s in sets.items()}
    kept = by_loop(sets, weights, 0.8)
    assert {x.iv_id: (x.n_members, x.weight, x.is_kept and x.iv_id == x.collection) for x in found} == {k: (len(sets[k]), weights[k], kept[k]) for k in sets}
    assert not all(kept.values())
    # Neither members nor pairs of members are rows: equal intervals are one place.
    many = spark.createDataFrame([(k, 1, 5, 50, 1) for k in range(3000)], table.schema)
    _, sizes, similar = near_collections(many, ["chrom"], 0.9, 0.8)
    assert [tuple(x) for x in sizes.collect()] == [(0, 3000, 3000)] and similar.isEmpty()
