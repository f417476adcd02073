"""Estimates that iterate or resample, as aggregations over the data."""

from __future__ import annotations

from math import erfc, exp, sqrt

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.stores import settled


def gaussian_density(points: DataFrame, x: str, y: str, bandwidth: float, at: DataFrame | None = None) -> DataFrame:
    """Kernel density of ``points`` at each different pair of whole numbers (x, y) of ``at``
    (of the points themselves), with the count n of the points there.

    Equal points are counted first; the Gaussian is applied along one axis and then
    along the other, out to four bandwidths, so that no pairs of points are formed.
    """
    reach = int(4 * bandwidth) + 1
    pair = [F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y")]
    counts = points.groupBy(*pair).agg(F.count("*").alias("n"))
    wanted = counts.select("x", "y") if at is None else at.select(*pair).distinct()
    weights = [exp(-0.5 * (k / bandwidth) ** 2) for k in range(-reach, reach + 1)]
    kernel = F.array(*[F.struct(F.lit(k - reach).alias("step"), F.lit(w).alias("w")) for k, w in enumerate(weights)])
    rows = counts.select("x", "y", "n", F.explode(kernel).alias("k")).groupBy((F.col("x") + F.col("k.step")).alias("x"), "y").agg(F.sum(F.col("n") * F.col("k.w")).alias("m"))
    rows = rows.join(wanted.select("x").distinct(), "x", "left_semi")
    cells = rows.select("x", "y", "m", F.explode(kernel).alias("k")).groupBy("x", (F.col("y") + F.col("k.step")).alias("y")).agg(F.sum(F.col("m") * F.col("k.w")).alias("d"))
    total = counts.agg(F.sum("n").alias("total"))
    scaled = wanted.join(counts, ["x", "y"], "left").join(cells, ["x", "y"], "left").crossJoin(F.broadcast(total))  # one row
    density = F.coalesce(F.col("d"), F.lit(0.0)) / (F.col("total") * 2 * np.pi * bandwidth**2)
    return scaled.select("x", "y", F.coalesce("n", F.lit(0)).alias("n"), density.alias("density"))


def density_outliers(points: DataFrame, x: str, y: str, bandwidth: float, bins: int = 10, at: DataFrame | None = None) -> DataFrame:
    """Pairs whose log density lies below where a line through the log counts of an
    equal-width histogram of the points' log densities (at the bins' left edges) meets
    zero. Pairs out of reach of all points have no log density and are outliers."""
    density = gaussian_density(points, x, y, bandwidth, at).withColumn("log_density", F.when(F.col("density") > 0, F.log10("density")))
    own = gaussian_density(points, x, y, bandwidth).withColumn("log_density", F.log10("density"))
    low, high = own.agg(F.min("log_density"), F.max("log_density")).first()
    if low is None or low == high:
        return density.withColumn("is_outlier", F.lit(False))
    step = (high - low) / bins
    number = F.least(F.floor((F.col("log_density") - low) / step), F.lit(bins - 1))
    counts = own.groupBy(number.alias("bin")).agg(F.sum("n").alias("n"))
    fit = counts.select((F.lit(low) + F.col("bin") * step).alias("edge"), F.log10("n").alias("log_n")).agg(F.expr("regr_slope(log_n, edge)").alias("m"), F.expr("regr_intercept(log_n, edge)").alias("b")).first()
    cutoff = -fit.b / fit.m if fit.m else None
    return density.withColumn("is_outlier", F.lit(False) if cutoff is None else F.coalesce(F.col("log_density") < cutoff, F.lit(True)))


def crossover_outliers(counts: DataFrame) -> DataFrame:
    """Pairs of maternal and paternal crossover counts and whether they are outliers.

    Counts of fewer than five or more than three times the median on a side don't enter
    the density; its bandwidth is 10 where the maternal median exceeds 10, else 1. With
    five rows or fewer there are no outliers.
    """
    n, mat, pat = counts.agg(F.count("*"), F.median("maternal_crossovers"), F.median("paternal_crossovers")).first()
    usual = counts.where((F.col("maternal_crossovers") >= 5) & (F.col("paternal_crossovers") >= 5) & (F.col("maternal_crossovers") <= 3 * F.lit(mat)) & (F.col("paternal_crossovers") <= 3 * F.lit(pat)))
    found = density_outliers(usual, "maternal_crossovers", "paternal_crossovers", 10.0 if (mat or 0) > 10 else 1.0, at=counts)
    return found.select("x", "y", F.lit(n > 5) & F.col("is_outlier").alias("is_outlier")).toDF("maternal_crossovers", "paternal_crossovers", "is_outlier")


def permutation_test(people: DataFrame, replicates: int, seed: int = 0) -> DataFrame:
    """Difference of the mean value of affected and unaffected members, for the data
    (replicate 0) and for phenotypes shuffled within families.

    ``people`` has family, individual, phenotype (1, 2) and value. The shuffles follow
    from hashes, so that they are the same on every run and cluster. A family is one row
    that is dealt again within its task for each replicate: replicates are never shuffled,
    joined or broadcast, and only their sums leave a task.
    """
    member = F.struct("individual", "phenotype", "value")
    families = people.where("family is not null").groupBy("family").agg(F.array_sort(F.collect_list(member)).alias("_members"))
    dealt = families.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates))))

    def place(m: Column) -> Column:
        key = F.when(F.col("replicate") == 0, F.lit(0)).otherwise(F.xxhash64(m.individual, F.col("replicate"), F.lit(seed)))
        return F.struct(key.alias("key"), m.individual.alias("individual"), m.value.alias("value"))

    shuffled = dealt.withColumn("_values", F.array_sort(F.transform("_members", place)))
    pairs = F.zip_with("_members", "_values", lambda m, v: F.struct(m.phenotype.alias("phenotype"), v.value.alias("value")))
    joined = shuffled.select("replicate", F.explode(pairs).alias("_p")).select("replicate", "_p.*")
    means = joined.groupBy("replicate").agg(F.avg(F.when(F.col("phenotype") == 2, F.col("value"))).alias("affected"), F.avg(F.when(F.col("phenotype") == 1, F.col("value"))).alias("unaffected"))
    return means.select("replicate", (F.col("affected") - F.col("unaffected")).alias("difference"))


def transmission_posterior(counts: DataFrame, grid: int = 200) -> DataFrame:
    """Posterior of the transmission rate over a grid with a Beta(2, 2) prior: its mean
    and its mass above one half. ``counts`` has k (transmitted) and n."""
    points = F.sequence(F.lit(1), F.lit(grid - 1))
    rate = F.transform(points, lambda i: i / grid)
    logs = F.transform(rate, lambda t: (F.col("k") + 1) * F.ln(t) + (F.col("n") - F.col("k") + 1) * F.ln(1 - t))
    out = counts.withColumns({"_rate": rate, "_log": logs}).withColumn("_mass", F.transform("_log", lambda v: F.exp(v - F.array_max("_log"))))

    def total(column):
        return F.aggregate(column, F.lit(0.0), lambda a, v: a + v)

    mean = total(F.zip_with("_rate", "_mass", lambda t, m: t * m)) / total(F.col("_mass"))
    above = total(F.zip_with("_rate", "_mass", lambda t, m: F.when(t > 0.5, m).otherwise(0.0))) / total(F.col("_mass"))
    return out.withColumns({"posterior_mean": F.round(mean, 6), "above_half": F.round(above, 6)}).drop("_rate", "_log", "_mass")


def logistic(df: DataFrame, features: list[str], label: str, steps: int = 25) -> list[dict]:
    """Logistic regression by Newton's method with Wald p-values.

    A step is one aggregation over the rows: the sums behind the gradient and the
    information matrix; only these leave the executors.
    """
    names = ["intercept", *features]
    rows = df.select(F.lit(1.0).alias("intercept"), *[F.col(f).cast("double") for f in features], F.col(label).cast("double").alias("_y")).na.drop()
    beta = np.zeros(len(names))
    for _ in range(steps):
        z = sum((F.col(n) * F.lit(float(b)) for n, b in zip(names, beta, strict=True)), F.lit(0.0))
        p = 1 / (1 + F.exp(-z))
        scored = rows.withColumn("_p", p)
        w = F.col("_p") * (1 - F.col("_p"))
        sums = [F.sum(F.col(a) * (F.col("_y") - F.col("_p"))).alias(f"g{i}") for i, a in enumerate(names)]
        sums += [F.sum(F.col(a) * F.col(b) * w).alias(f"h{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
        got = scored.agg(*sums).first().asDict()
        gradient = np.array([got[f"g{i}"] or 0.0 for i in range(len(names))])
        information = np.array([[got[f"h{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(len(names))] for i in range(len(names))])
        move = np.linalg.lstsq(information, gradient, rcond=None)[0]
        beta = beta + move
        if np.abs(move).max() < 1e-10:
            break
    error = np.sqrt(np.maximum(np.diag(np.linalg.pinv(information)), 0))
    return [{"term": n, "coefficient": float(b), "std_error": float(e), "p": erfc(abs(b / e) / sqrt(2)) if e else float("nan")} for n, b, e in zip(names, beta, error, strict=True)]


def emission_costs(profiles: DataFrame, members: DataFrame, n_regions: int) -> DataFrame:
    """Costs (individual, region, true_gt, obs_gt, cost) of each member (family, individual).

    A profile is looked up as family.individual, then as individual; hemizygous true
    genotypes (-/0, -/1) cost what the homozygous ones do. A member without a profile was
    not sequenced: nothing but an unseen call costs nothing for it.
    """
    keyed = profiles.select(F.col("individual").alias("_name"), "region", "true_gt", "obs_gt", "cost")
    both = members.withColumn("_full", F.concat_ws(".", "family", "individual"))
    names = keyed.select("_name").distinct()
    full = both.join(names.withColumnRenamed("_name", "_full"), "_full", "left_semi").withColumn("_name", F.col("_full"))
    plain = both.join(names.withColumnRenamed("_name", "_full"), "_full", "left_anti").withColumn("_name", F.col("individual"))
    found = full.unionByName(plain).join(keyed, "_name", "left").drop("_full", "_name")
    known = found.where("cost is not null")
    half = known.where("true_gt in ('0/0', '1/1')").withColumn("true_gt", F.when(F.col("true_gt") == "0/0", "-/0").otherwise("-/1"))
    silent = found.where("cost is null").select("family", "individual").distinct().select("family", "individual", F.explode(F.sequence(F.lit(0), F.lit(n_regions - 1))).alias("region"))
    calls = F.explode(F.array(*[F.struct(F.lit(o).alias("obs_gt"), F.lit(0.0 if o == "0/0" else float("inf")).alias("cost")) for o in ("0/0", "0/1", "1/1", "./.")]))
    trues = F.explode(F.array(*[F.lit(t) for t in ("0/0", "0/1", "1/1", "-/0", "-/1")]))
    silent = silent.withColumn("true_gt", trues).select("*", calls.alias("_c")).select("family", "individual", "region", "true_gt", "_c.*")
    columns = ["family", "individual", "region", "true_gt", "obs_gt", "cost"]
    return known.select(*columns).unionByName(half.select(*columns)).unionByName(silent.select(*columns))


def unsound_profiles(profiles: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """(individual, region, true_gt) whose probabilities don't add up to one."""
    total = F.sum(F.pow(F.lit(10.0), -F.col("cost")))
    return profiles.groupBy("individual", "region", "true_gt").agg(total.alias("total")).where(F.abs(F.col("total") - 1) > tolerance)


def poisson_weight(key: list[str], replicate: Column, seed: int) -> Column:
    """A Poisson number of mean 1 from a hash: how often a replicate draws a row."""
    share = F.pmod(F.xxhash64(*key, replicate, F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    steps, term, total = [], exp(-1), 0.0
    for k in range(1, 13):
        total += term
        steps.append(total)
        term /= k
    return sum((F.when(share >= s, 1).otherwise(0) for s in steps), F.lit(0))


def bootstrap_logistic(df: DataFrame, key: list[str], features: list[str], label: str, strata: list[str], replicates: int = 1000, seed: int = 0, steps: int = 25) -> list[dict]:
    """Logistic coefficients with bootstrap intervals, resampled within strata.

    A replicate weighs each row by a Poisson number of its ``key`` (scaled so that every
    stratum keeps its size), which needs no draw over the whole table. Rows that are alike are
    counted first; then a Newton step of all replicates is one aggregation, and only its sums
    (a row a replicate) leave the executors. Per term: coefficient (of the rows as they are),
    low and high (2.5 and 97.5 per cent of the replicates), odds_ratio with its bounds.
    """
    names = ["intercept", *features]
    rows = df.select(*key, *strata, F.lit(1.0).alias("intercept"), *[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias("_y")).na.drop()
    drawn = rows.withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(replicates))))
    # Replicate 0 is the table itself.
    weight = F.when(F.col("_r") == 0, 1).otherwise(poisson_weight(key, F.col("_r"), seed))
    kinds = drawn.groupBy("_r", *strata, *names, "_y").agg(F.sum(weight).alias("_w"), F.count("*").alias("_n"))
    sizes = kinds.groupBy("_r", *strata).agg((F.sum("_n") / F.sum("_w")).alias("_scale"))
    scaled = kinds.join(sizes, ["_r", *strata]).groupBy("_r", *names, "_y").agg(F.sum(F.col("_w") * F.col("_scale")).alias("_w"))
    scaled = settled(scaled.where("_w > 0"), "bootstrap")
    p = len(names)
    beta = np.zeros((replicates + 1, p))
    for _ in range(steps):
        betas = df.sparkSession.createDataFrame([(r, b) for r, b in enumerate(beta.tolist())], "_r int, _b array<double>")
        z = sum((F.col(n) * F.col("_b")[i] for i, n in enumerate(names)), F.lit(0.0))
        scored = scaled.join(F.broadcast(betas), "_r").withColumn("_p", 1 / (1 + F.exp(-z)))
        w = F.col("_w") * F.col("_p") * (1 - F.col("_p"))
        sums = [F.sum(F.col(a) * F.col("_w") * (F.col("_y") - F.col("_p"))).alias(f"g{i}") for i, a in enumerate(names)]
        pairs = [(i, j) for i in range(p) for j in range(i, p)]
        sums += [F.sum(F.col(names[i]) * F.col(names[j]) * w).alias(f"h{i}_{j}") for i, j in pairs]
        moves = np.zeros_like(beta)
        for row in scored.groupBy("_r").agg(*sums).collect():
            information = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)])
            moves[row["_r"]] = np.linalg.lstsq(information, np.array([row[f"g{i}"] for i in range(p)]), rcond=None)[0]
        beta = beta + moves
        if np.abs(moves).max() < 1e-9:
            break
    low, high = np.percentile(beta[1:], [2.5, 97.5], axis=0)
    return [{"term": n, "coefficient": float(b), "low": float(lo), "high": float(hi), "odds_ratio": exp(b), "odds_low": exp(lo), "odds_high": exp(hi)} for n, b, lo, hi in zip(names, beta[0], low, high, strict=True)]
