"""The family model: inheritance states along a chromosome by the Viterbi algorithm.

A nuclear family has four ancestral chromosomes m1, m2, p1, p2. A state says which
of them are deleted (at most one), which maternal and which paternal chromosome
each child has, and which region class (error profile) the position lies in. The
first child's chromosomes are fixed as m1 and p1, which removes the mirror images.
Costs are -log10 of probabilities. The state tables of a family shape are small
arrays made once in each worker; families are independent, so that they are dealt by
(family, chromosome) and swept side by side on NumPy rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..config import PhaseConfig

OBSERVED = (-1, 0, 1, 2)


@dataclass(frozen=True)
class States:
    """deleted (n, 4) 0 or 1 where deleted; mat, pat (n, children) in 0..3; region (n,)."""

    deleted: np.ndarray
    mat: np.ndarray
    pat: np.ndarray
    region: np.ndarray

    def __len__(self) -> int:
        return len(self.region)


@lru_cache(maxsize=64)
def states(n_children: int, config: PhaseConfig) -> States:
    gone = [tuple(int(i == k) for i in range(4)) for k in (range(-1, 4) if config.allow_deletions else (-1,))]
    phases = [((0, 2), *rest) for rest in product(product((0, 1), (2, 3)), repeat=n_children - 1)]
    if config.allow_upd:
        # One child at most has both chromosomes from one parent, and no deletion with it.
        for base, child in product(list(phases), range(n_children)):
            for pair in ((0, 1), (1, 0), (0, 0), (1, 1), (2, 3), (3, 2), (2, 2), (3, 3)):
                phases.append(tuple(pair if i == child else p for i, p in enumerate(base)))
        phases = list(dict.fromkeys(phases))
    rows = []
    for d, ph, r in product(gone, phases, range(config.n_regions)):
        odd = [m > 1 or q < 2 for m, q in ph]
        if any(odd) and (sum(d) or sum(odd) > 1):
            continue
        rows.append((d, [m for m, _ in ph], [q for _, q in ph], r))
    return States(*(np.array([r[k] for r in rows], np.int8) for k in range(4)))


@lru_cache(maxsize=64)
def transitions(n_children: int, config: PhaseConfig) -> tuple[np.ndarray, np.ndarray]:
    """For each state the states before it (padded with itself) and their costs.

    One change at a time: one chromosome's deletion begins or ends, one child's
    maternal or paternal chromosome switches (for the fixed first child all others
    switch), a region class changes, an uniparental pair begins or ends.
    """
    s = states(n_children, config)
    same_gone = (s.deleted[:, None] == s.deleted[None]).all(-1)
    same_mat, same_pat = ((x[:, None] == x[None]) for x in (s.mat, s.pat))
    same_region = s.region[:, None] == s.region[None]
    normal = ((s.mat < 2) & (s.pat > 1)).all(-1)
    both_normal = normal[:, None] & normal[None]
    n_mat, n_pat = (~same_mat).sum(-1), (~same_pat).sum(-1)
    cost = np.full((len(s), len(s)), np.inf)

    def allow(where: np.ndarray, price: float) -> None:
        np.minimum(cost, np.where(where, price, np.inf), out=cost)

    flips = (s.deleted[:, None] != s.deleted[None]).sum(-1)
    allow((flips == 1) & (n_mat + n_pat == 0) & same_region, config.deletion)
    for n_changed, n_kept, same, price in ((n_mat, n_pat, same_mat, config.maternal_crossover), (n_pat, n_mat, same_pat, config.paternal_crossover)):
        one = n_changed == 1
        all_others = (n_changed == n_children - 1) & ~same[..., 1:].any(-1) if n_children > 1 else np.zeros_like(one)
        allow((one | all_others) & (n_kept == 0) & same_gone & same_region & both_normal, price)
    allow(same_gone & (n_mat + n_pat == 0) & ~same_region, config.region_switch)
    if config.allow_upd:
        allow(same_gone & same_region & (normal[:, None] != normal[None]) & ((~same_mat | ~same_pat).sum(-1) == 1), config.upd)
    np.fill_diagonal(cost, np.inf)
    leave = np.where(np.isfinite(cost), 10.0**-cost, 0.0).sum(0)
    stay = -np.log10(np.maximum(1 - leave, 1e-300))
    np.fill_diagonal(cost, stay)
    width = int(np.isfinite(cost).sum(0).max())
    before = np.argsort(cost, axis=0, kind="stable")[:width].T
    return before.astype(np.int32), np.take_along_axis(cost, before.T, axis=0).T


@lru_cache(maxsize=64)
def predictions(n_children: int, config: PhaseConfig) -> np.ndarray:
    """(state, assignment, person): genotypes for all 16 assignments of alleles to the
    ancestral chromosomes; a person with one chromosome left shows it twice."""
    s = states(n_children, config)
    alleles = np.array(list(product((0, 1), repeat=4)), np.int8)
    first = np.concatenate([np.tile([0, 2], (len(s), 1)), s.mat], axis=1)
    second = np.concatenate([np.tile([1, 3], (len(s), 1)), s.pat], axis=1)
    a, b = alleles[:, first].transpose(1, 0, 2), alleles[:, second].transpose(1, 0, 2)
    gone_a, gone_b = (np.take_along_axis(s.deleted, x, 1)[:, None, :] for x in (first, second))
    return np.where(gone_a & gone_b, 0, np.where(gone_a, 2 * b, np.where(gone_b, 2 * a, a + b))).astype(np.int8)


def emission(observed: np.ndarray, costs: np.ndarray, n_children: int, config: PhaseConfig) -> np.ndarray:
    """Cost of an observed genotype vector (-1 missing) in each state: that of the best
    assignment. ``costs`` is (region, person, true 0..2, observed -1..2)."""
    s = states(n_children, config)
    if not (observed > 0).any():
        return np.zeros(len(s))
    p = predictions(n_children, config)
    seen = observed + 1
    person = np.arange(len(observed))
    return costs[s.region[:, None, None], person, p, seen].sum(-1).min(-1)


def viterbi(loss: np.ndarray, weights: np.ndarray, before: np.ndarray, cost: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(positions, states): least cost of paths that end in each state."""
    v = np.empty_like(loss)
    v[0] = np.where(start, weights[0] * loss[0], np.inf)
    for j in range(1, len(loss)):
        v[j] = (v[j - 1][before] + cost).min(1) + weights[j] * loss[j]
    return v


def best_states(v: np.ndarray, before: np.ndarray, cost: np.ndarray, tie: float) -> np.ndarray:
    """(positions, states): whether a path within ``tie`` of the best one passes there."""
    on = np.zeros(v.shape, bool)
    on[-1] = v[-1] <= v[-1].min() + tie
    for j in range(len(v) - 1, 0, -1):
        for k in np.flatnonzero(on[j]):
            total = v[j - 1][before[k]] + cost[k]
            on[j - 1, before[k][total <= total.min() + tie]] = True
    return on


def phase_family(positions: pd.DataFrame, costs: np.ndarray, n_children: int, config: PhaseConfig) -> pd.DataFrame:
    """Segments of one family and chromosome. ``positions`` has start_pos, end_pos, weight
    and gts (parents first); ties between states give null entries."""
    s = states(n_children, config)
    before, cost = transitions(n_children, config)
    known: dict[bytes, np.ndarray] = {}
    loss = np.empty((len(positions), len(s)))
    for i, gts in enumerate(positions["gts"]):
        vector = np.asarray(gts, np.int8)
        key = vector.tobytes()
        if key not in known:
            known[key] = emission(vector, costs, n_children, config)
        loss[i] = known[key]
    normal = (s.deleted.sum(1) == 0) & ((s.mat < 2) & (s.pat > 1)).all(1)
    v = viterbi(loss, positions["weight"].to_numpy(float), before, cost, normal)
    on = best_states(v, before, cost, config.tie)
    parts = np.concatenate([1 - s.deleted, s.mat, s.pat, s.region[:, None]], axis=1).astype(int)
    rows = np.empty((len(v), parts.shape[1]), int)
    for j in range(len(v)):
        mine = parts[on[j]]
        rows[j] = np.where((mine == mine[0]).all(0), mine[0], -1)
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:] != rows[:-1]).any(1)
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(rows)) - 1
    c = n_children
    return pd.DataFrame({
        "seg_idx": np.arange(len(at)),
        "start_pos": positions["start_pos"].to_numpy()[at],
        "end_pos": positions["end_pos"].to_numpy()[last],
        "dels": list(rows[at, :4]),
        "mat": list(rows[at, 4 : 4 + c]),
        "pat": list(rows[at, 4 + c : 4 + 2 * c]),
        "loss_region": rows[at, -1],
    })


SEGMENTS = "family string, chrom string, seg_idx int, start_pos long, end_pos long, dels array<int>, mat array<int>, pat array<int>, loss_region int, error string"


#: Rows times states of the families that a task sweeps side by side.
CELLS_AT_ONCE = 1 << 20


@lru_cache(maxsize=64)
def followers(n_children: int, config: PhaseConfig) -> tuple[np.ndarray, np.ndarray]:
    """``transitions`` the other way: for each state those after it and their costs."""
    before, cost = transitions(n_children, config)
    dense = np.full((len(before), len(before)), np.inf)
    np.minimum.at(dense, (np.arange(len(before))[:, None], before), cost)
    width = int(np.isfinite(dense).sum(0).max())
    after = np.argsort(dense, axis=0, kind="stable")[:width].T
    return after, np.take_along_axis(dense, after.T, axis=0).T


def paths_of_many(codes: np.ndarray, table: np.ndarray, weights: np.ndarray, first: np.ndarray, n_children: int, config: PhaseConfig) -> np.ndarray:
    """``best_states`` of several sequences at once. Their rows lie one sequence after another
    from ``first`` on; ``table[codes]`` are the rows' losses. Step j is one for all that are
    longer than j."""
    s = states(n_children, config)
    before, cost = transitions(n_children, config)
    after, cost_after = followers(n_children, config)
    start = (s.deleted.sum(1) == 0) & ((s.mat < 2) & (s.pat > 1)).all(1)
    length = np.diff(np.append(first, len(codes)))
    order = np.argsort(-length, kind="stable")
    length, first = length[order], first[order]
    v, low = [], []
    for j in range(length[0]):
        row = first[: np.searchsorted(-length, -j)] + j
        loss = weights[row][:, None] * table[codes[row]]
        low.append((v[-1][: len(row)][:, before] + cost).min(-1) if j else np.where(start, 0.0, np.inf)[None])
        v.append(low[-1] + loss if j else np.where(start, loss, np.inf))
    on = np.empty((len(codes), len(s)), bool)
    later = np.empty((0, len(s)), bool)
    for j in range(length[0] - 1, -1, -1):
        now, k = np.empty(v[j].shape, bool), len(later)
        now[k:] = v[j][k:] <= v[j][k:].min(1, keepdims=True) + config.tie
        if k:
            now[:k] = (later[:, after] & (v[j][:k, :, None] + cost_after <= (low[j + 1] + config.tie)[:, after])).any(-1)
        on[first[: len(now)] + j] = now
        later = now
    return on


def phase_many(rows: pa.Table, costs: np.ndarray, n_children: int, config: PhaseConfig, known: dict[bytes, np.ndarray]) -> pa.Table:
    """``phase_family`` of whole families that lie one after another; ``known`` are losses of
    vectors met before."""
    s = states(n_children, config)
    gts = np.asarray(rows["gts"].combine_chunks().flatten(), np.int8).reshape(len(rows), -1)
    vectors, codes = np.unique(gts, axis=0, return_inverse=True)
    if len(known) > 1 << 16:
        known.clear()
    for vector in vectors:
        if vector.tobytes() not in known:
            known[vector.tobytes()] = emission(vector, costs, n_children, config)
    table = np.stack([known[x.tobytes()] for x in vectors])
    begins = _begins(rows)
    on = paths_of_many(codes.ravel(), table, rows["weight"].to_numpy().astype(float), begins, n_children, config)
    parts = np.concatenate([1 - s.deleted, s.mat, s.pat, s.region[:, None]], axis=1).astype(np.int32)
    told = np.empty((len(on), parts.shape[1]), np.int32)
    for k, part in enumerate(parts.T):
        least, most = np.where(on, part, 127).min(1), np.where(on, part, -127).max(1)
        told[:, k] = np.where(least == most, least, -1)
    new = np.ones(len(told), bool)
    new[1:] = (told[1:] != told[:-1]).any(1)
    new[begins] = True
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(told)) - 1
    index = np.arange(len(at)) - np.searchsorted(at, begins)[np.searchsorted(begins, at, "right") - 1]

    def lists(x: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel(), pa.int32()))

    c, told = n_children, told[at]
    return pa.table({
        "family": rows["family"].take(at), "chrom": rows["chrom"].take(at), "seg_idx": pa.array(index, pa.int32()),
        "start_pos": rows["start_pos"].take(at), "end_pos": rows["end_pos"].take(last),
        "dels": lists(told[:, :4]), "mat": lists(told[:, 4 : 4 + c]), "pat": lists(told[:, 4 + c : 4 + 2 * c]),
        "loss_region": pa.array(told[:, -1], pa.int32()), "error": pa.nulls(len(at), pa.string()),
    })


def _begins(rows: pa.Table) -> np.ndarray:
    """Where the sequences of (family, chrom) begin."""
    new = np.ones(len(rows), bool)
    for c in ("family", "chrom"):
        x = rows[c].combine_chunks()
        here = pc.not_equal(x[1:], x[:-1]).to_numpy(zero_copy_only=False)
        new[1:] = here if c == "family" else new[1:] | here
    return np.flatnonzero(new)


def phase(observations: DataFrame, costs: np.ndarray, n_children: int, config: PhaseConfig) -> DataFrame:
    """Segments of all families of one size. ``observations`` has family, chrom,
    start_pos, end_pos, weight, gts; a family that fails gives one row with its error.

    Families pass through a task in order, and some of them are swept side by side: a step of
    the model costs about as much for many as for one.
    """
    schema = to_arrow_schema(StructType.fromDDL(SEGMENTS))

    def one_by_one(rows: pa.Table) -> Iterator[pa.Table]:
        begins = _begins(rows)
        for lo, hi in zip(begins, np.append(begins[1:], len(rows)), strict=True):
            group = rows.slice(lo, hi - lo).to_pandas()
            try:
                found = phase_family(group, costs, n_children, config).to_dict("records")
            except Exception as failed:  # one family must not end the job
                found = [{"error": repr(failed)}]
            named = {"family": group["family"].iloc[0], "chrom": group["chrom"].iloc[0]}
            yield pa.Table.from_pylist([named | row for row in found], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}

        def swept(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            try:
                found = [phase_many(rows, costs, n_children, config, known)]
            except Exception:  # a family that fails is found by itself
                found = one_by_one(rows)
            for x in found:
                yield from x.to_batches()

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) * len(states(n_children, config)) >= CELLS_AT_ONCE:
                rows = pa.Table.from_batches(held)
                # The last sequence may go on.
                whole = int(_begins(rows)[-1])
                if whole:
                    yield from swept(rows.slice(0, whole))
                    held = rows.slice(whole).to_batches()
        if sum(map(len, held)):
            yield from swept(pa.Table.from_batches(held))

    named = observations.select(*[F.coalesce(F.col(c).cast("string"), F.lit("None")).alias(c) for c in ("family", "chrom")], *[F.col(c).cast("long").alias(c) for c in ("start_pos", "end_pos")], "weight", "gts")
    dealt = named.repartition("family", "chrom").sortWithinPartitions("family", "chrom", "start_pos")
    return dealt.mapInArrow(run, SEGMENTS)


def observations(genotypes: DataFrame, members: DataFrame, keys: list[str] = ["chrom"]) -> DataFrame:  # noqa: B006
    """Genotype vectors (absent 0) of each family at the sites where a member has a
    call, with equal neighbours merged: their number is the weight.

    ``members`` has family, sample and place (0 mother, 1 father, then children).
    """
    from ..functions.intervals import merge_runs

    calls = genotypes.join(members, "sample").groupBy("family", *keys, "pos").agg(F.map_from_entries(F.collect_list(F.struct("place", "gt"))).alias("m"))
    size = members.agg((F.max("place") + 1).alias("n")).first().n or 0
    vectors = calls.select("family", *keys, F.col("pos").alias("start_pos"), (F.col("pos") + 1).alias("end_pos"), F.array(*[F.coalesce(F.col("m")[k], F.lit(0)).cast("int") for k in range(size)]).alias("gts"))
    merged = merge_runs(vectors, ["family", *keys], ["gts"], ["start_pos"])
    return merged.withColumnRenamed("n_rows", "weight")


def uniform_costs(n_people: int, n_regions: int, errors: tuple[float, ...] = (1e-3,), missing: float = 1e-2) -> np.ndarray:
    """Error profiles of one rate for each region class."""
    out = np.empty((n_regions, n_people, 3, 4))
    for r in range(n_regions):
        e = errors[min(r, len(errors) - 1)]
        p = np.full((3, 4), e)
        p[:, 0] = missing
        p[np.arange(3), np.arange(3) + 1] = 1 - missing - 2 * e
        out[r] = -np.log10(p)
    return out


def uniparental(segments: DataFrame) -> DataFrame:
    """Runs where a child has both chromosomes from one parent: isodisomy if the same one twice."""
    child = segments.select("family", "chrom", "start_pos", "end_pos", F.posexplode(F.arrays_zip("mat", "pat")).alias("child", "pair"))
    odd = child.select("*", (F.col("pair.mat") > 1).alias("is_pat"), ((F.col("pair.pat") < 2) & (F.col("pair.pat") >= 0)).alias("is_mat"), (F.col("pair.mat") == F.col("pair.pat")).alias("is_isodisomy"))
    return odd.where("is_mat or is_pat").drop("pair")


def deletion_quality(positions: pd.DataFrame, costs: np.ndarray, n_children: int, config: PhaseConfig) -> float:
    """Best cost without deletions less the best cost with them over an interval."""
    from dataclasses import replace

    best = []
    for allowed in (False, True):
        setting = replace(config, allow_deletions=allowed)
        before, cost = transitions(n_children, setting)
        loss = np.array([emission(np.asarray(g, np.int8), costs, n_children, setting) for g in positions["gts"]])
        v = viterbi(loss, positions["weight"].to_numpy(float), before, cost, np.ones(loss.shape[1], bool))
        best.append(v[-1].min())
    return float(best[0] - best[1])
