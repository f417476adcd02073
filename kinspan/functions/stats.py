"""Tests and intervals on aggregated counts.

Special functions come from the log-gamma function and continued fractions over
NumPy arrays; exact tests run on the distinct rows of their inputs and are joined
back, so that a table of many equal contingencies is computed once each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import erfc, lgamma, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

_lgamma = np.vectorize(lgamma, otypes=[float])
_erfc = np.vectorize(erfc, otypes=[float])


def log_choose(n: np.ndarray, k: np.ndarray) -> np.ndarray:
    return _lgamma(n + 1.0) - _lgamma(k + 1.0) - _lgamma(n - k + 1.0)


def _binomial_one(k: int, n: int, p: float, side: str) -> float:
    i = np.arange(n + 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        mass = np.exp(log_choose(np.full(n + 1, n), i) + np.where(i > 0, i * np.log(p), 0.0) + np.where(n - i > 0, (n - i) * np.log1p(-p), 0.0))
    if side == "greater":
        return float(min(1.0, mass[k:].sum()))
    if side == "less":
        return float(min(1.0, mass[: k + 1].sum()))
    return float(min(1.0, mass[mass <= mass[k] * (1 + 1e-7)].sum()))


def binomial_p(k: pd.Series, n: pd.Series, p: pd.Series, side: str = "two-sided") -> pd.Series:
    """Exact binomial test; the two-sided one sums all outcomes that are no likelier."""
    return pd.Series([_binomial_one(int(a), int(b), float(c), side) for a, b, c in zip(k, n, p, strict=True)], dtype=float)


def fisher_p(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
    """Two-sided Fisher test of 2x2 tables."""
    out = []
    for w, x, y, z in zip(a.astype(int), b.astype(int), c.astype(int), d.astype(int), strict=True):
        lo, hi = max(0, w - z), min(w + x, w + y)
        i = np.arange(lo, hi + 1)
        row1, row2, col = w + x, y + z, w + y
        mass = np.exp(log_choose(np.full(len(i), row1), i) + log_choose(np.full(len(i), row2), col - i) - log_choose(np.array([row1 + row2]), np.array([col])))
        out.append(float(min(1.0, mass[mass <= mass[w - lo] * (1 + 1e-7)].sum())))
    return pd.Series(out, dtype=float)


def hypergeometric_sf(k: pd.Series, total: pd.Series, marked: pd.Series, drawn: pd.Series) -> pd.Series:
    """P(X >= k) of marked items among those drawn."""
    out = []
    for a, t, m, d in zip(k.astype(int), total.astype(int), marked.astype(int), drawn.astype(int), strict=True):
        i = np.arange(max(a, 0, d - (t - m)), min(m, d) + 1)
        terms = log_choose(np.full(len(i), m), i) + log_choose(np.full(len(i), t - m), d - i) - log_choose(np.array([t]), np.array([d]))
        out.append(float(min(1.0, np.exp(terms).sum())))
    return pd.Series(out, dtype=float)


def upper_gamma(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function Q(a, x): series below, continued fraction above."""
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-15:
            k += 1
            term *= x / k
            total += term
        return 1 - total * np.exp(-x + a * np.log(x) - lgamma(a))
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return float(np.exp(-x + a * np.log(x) - lgamma(a)) * h)


def chi2_p(statistic: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([upper_gamma(k / 2, x / 2) if x == x else np.nan for x, k in zip(statistic, dof, strict=True)], dtype=float)


def beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_tail(b, a, 1 - x)
    tiny, front = 1e-300, np.exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for m in range(1, 1000):
        for numerator in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + numerator * d or tiny)
            c = 1 + numerator / c or tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return float(front * h)


def t_p(t: pd.Series, dof: pd.Series) -> pd.Series:
    """Two-sided p of Student's t."""
    return pd.Series([beta_tail(v / 2, 0.5, v / (v + x * x)) if x == x else np.nan for x, v in zip(t, dof, strict=True)], dtype=float)


def on_distinct(df: DataFrame, columns: list[str], name: str, test: Callable[..., pd.Series]) -> DataFrame:
    """``df`` with a test's p-value, computed once for each different row of ``columns``."""
    inputs = df.select(*columns).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch.copy()
            out[name] = test(*[batch[c] for c in columns]).to_numpy() if len(batch) else np.zeros(0)
            yield out

    schema = T.StructType([*inputs.schema.fields, T.StructField(name, T.DoubleType())])
    found = inputs.mapInPandas(run, schema)
    same = None
    renamed = found.select(*[F.col(c).alias(f"_{c}") for c in columns], name)
    for c in columns:
        term = F.col(c).eqNullSafe(F.col(f"_{c}"))
        same = term if same is None else same & term
    return df.join(renamed, same, "left").drop(*[f"_{c}" for c in columns])


def chi2_2x2(a: Column, b: Column, c: Column, d: Column, yates: bool = False) -> Column:
    """Chi-square statistic of a 2x2 table, null if a margin is 0."""
    n = a + b + c + d
    away = F.abs(a * d - b * c)
    if yates:
        away = F.greatest(away - n / 2, F.lit(0.0))
    return F.try_divide(n * away * away, (a + b) * (c + d) * (a + c) * (b + d))


def two_proportion_z(k1: Column, n1: Column, k2: Column, n2: Column) -> Column:
    pooled = (k1 + k2) / (n1 + n2)
    return F.try_divide(k1 / n1 - k2 / n2, F.sqrt(pooled * (1 - pooled) * (1 / n1 + 1 / n2)))


def agresti_coull(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """Interval of a proportion, cut to 0 .. 1."""
    more = n + z * z
    centre = (k + z * z / 2) / more
    half = z * F.sqrt(centre * (1 - centre) / more)
    return F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    share = k / n
    centre = (share + z * z / (2 * n)) / (1 + z * z / n)
    half = z / (1 + z * z / n) * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))
    return centre - half, centre + half


def fisher_combined(df: DataFrame, p: str, by: list[str]) -> DataFrame:
    """-2 sum(ln p) and its chi-square p of 2 k degrees of freedom, as the closed
    form exp(-x/2) sum (x/2)**i / i! for i below k."""
    totals = df.where(F.col(p) > 0).groupBy(*by).agg(F.round(-2 * F.sum(F.ln(p)), 6).alias("statistic"), F.count("*").alias("k"))
    half = F.col("statistic") / 2
    terms = F.aggregate(F.sequence(F.lit(1), F.col("k").cast("int")), F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")), lambda acc, i: F.struct((acc.term * half / i).alias("term"), (acc["sum"] + acc.term).alias("sum")), lambda acc: acc["sum"])
    return totals.withColumn("p", F.exp(-half) * terms)


def normal_tail(z: float) -> float:
    return erfc(abs(z) / sqrt(2))


def welch(df: DataFrame, value: str, group: str) -> DataFrame:
    """Welch's t and degrees of freedom of the two groups 0 and 1."""
    parts = [F.expr(f"{f}(case when {group} = {g} then {value} end)").alias(f"{n}{g}") for g in (0, 1) for n, f in (("n", "count"), ("m", "avg"), ("v", "var_samp"))]
    s0, s1 = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    out = df.agg(*parts).withColumns({"t": F.try_divide(F.col("m1") - F.col("m0"), F.sqrt(s0 + s1)), "dof": F.try_divide((s0 + s1) ** 2, s0 * s0 / (F.col("n0") - 1) + s1 * s1 / (F.col("n1") - 1))})
    return out.select("n0", "n1", "t", "dof")


def whole_order(df: DataFrame, value: str, sums: list[str], pieces: int = 64) -> DataFrame:
    """``df`` (one row a value) and, for each of ``sums``, its sum over the rows with values
    up to the row's (name_upto), all over the table.

    Values are dealt into ranges of about equal rows; only a row a range passes one task.
    """
    cuts = df.agg(F.percentile_approx(value, [i / pieces for i in range(1, pieces)])).first()[0] or []
    bounds = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<double>")
    dealt = df.withColumn("_block", F.size(F.filter(bounds, lambda c: c < F.col(value))))
    totals = dealt.groupBy("_block").agg(*[F.sum(c).alias(c) for c in sums])  # ``pieces`` rows at most
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select("_block", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"_{c}") for c in sums])
    inner = Window.partitionBy("_block").orderBy(value)
    steps = dealt.join(F.broadcast(carried), "_block").withColumns({f"{c}_upto": F.sum(c).over(inner) + F.col(f"_{c}") for c in sums})
    return steps.drop("_block", *[f"_{c}" for c in sums])


def ks_statistic(df: DataFrame, value: str, group: str) -> DataFrame:
    """Largest distance of two groups' distribution functions, from counts per value."""
    counts = df.groupBy(value).agg(F.count_if(F.col(group) == 0).alias("a"), F.count_if(F.col(group) == 1).alias("b"))
    total = counts.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    steps = whole_order(counts, value, ["a", "b"]).crossJoin(F.broadcast(total))  # one row
    away = F.abs(F.col("a_upto") / F.col("n_a") - F.col("b_upto") / F.col("n_b"))
    return steps.select(away.alias("d")).agg(F.max("d").alias("ks"))


def roc_points(df: DataFrame, score: str, label: str) -> DataFrame:
    """True and false positives at each score as threshold, highest first."""
    counts = df.groupBy((F.lit(0.0) - F.col(score)).alias("_turned")).agg(F.sum(label).alias("tp"), F.sum(1 - F.col(label)).alias("fp"))
    steps = whole_order(counts, "_turned", ["tp", "fp"])
    return steps.select((F.lit(0.0) - F.col("_turned")).alias(score), F.col("tp_upto").alias("tp"), F.col("fp_upto").alias("fp"))
