"""p-values, intervals and resampling with nothing but the standard library and numpy."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import struct


def binomial_two_sided(k: int, n: int) -> float:
    """Exact two-sided p of k successes in n fair trials."""
    if not n:
        return 1.0
    tail = sum(math.comb(n, i) for i in range(min(k, n - k) + 1))
    return min(1.0, 2 * tail / 2**n)


def _gamma_shares(a: float, x: float) -> tuple[float, float]:
    """Regularised lower and upper incomplete gamma functions: a series below a + 1, a continued fraction above, so that the small one of the two is exact."""
    if x <= 0:
        return 0.0, 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= x / n
            total += term
        return total * scale, 1 - total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b if abs(an * d + b) > tiny else tiny)
        c = b + an / c if abs(b + an / c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return 1 - scale * h, scale * h


def _gamma_lower_share(a: float, x: float) -> float:
    return _gamma_shares(a, x)[0]


def chi2_sf(x: float, df: int) -> float:
    return math.erfc(math.sqrt(x / 2)) if df == 1 else _gamma_shares(df / 2, x / 2)[1]


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def f_sf(x: float, d1: float, d2: float) -> float:
    return 1.0 if x <= 0 else beta_share(d2 / 2, d1 / 2, d2 / (d2 + d1 * x))


def _solve(f: Callable[[float], float], target: float, lo: float, hi: float) -> float:
    """Where a rising function meets target."""
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < target else (lo, mid)
    return (lo + hi) / 2


def clopper_pearson(k: int, n: int, confidence: float = 0.95) -> tuple[float, float]:
    half = (1 - confidence) / 2
    lo = 0.0 if k == 0 else _solve(lambda p: beta_share(k, n - k + 1, p), half, 0, 1)
    hi = 1.0 if k == n else _solve(lambda p: beta_share(k + 1, n - k, p), 1 - half, 0, 1)
    return lo, hi


def poisson_rate_ci(count: int, hours: float, confidence: float = 0.95) -> tuple[float, float]:
    """Exact interval of events an hour."""
    half = (1 - confidence) / 2
    top = 10 * count + 50
    lo = 0.0 if count == 0 else _solve(lambda m: _gamma_lower_share(count, m), half, 0, top)
    hi = _solve(lambda m: _gamma_lower_share(count + 1, m), 1 - half, 0, top)
    return lo / hours, hi / hours


def studentised_range_sf(q: float, k: int, df: float) -> float:
    """P(range of k standard normals / their independent scale > q), integrated numerically."""
    if q <= 0:
        return 1.0
    z = np.linspace(-8, 8, 1601)
    pdf = np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    low = max(1e-6, 1 - 10 / math.sqrt(2 * df))
    s = np.linspace(low, 1 + 10 / math.sqrt(2 * df), 401)
    log_density = (df / 2) * math.log(df / 2) - math.lgamma(df / 2) + math.log(2) + (df - 1) * np.log(s) - df * s * s / 2
    inner = np.array([np.trapezoid(k * pdf * np.maximum(cdf - np.interp(z - q * v, z, cdf, left=0.0), 0) ** (k - 1), z) for v in s])
    return float(min(1.0, max(0.0, 1 - np.trapezoid(np.exp(log_density) * inner, s))))


#: McNemar: below this many discordant pairs the exact binomial decides.
EXACT_BELOW = 25


@F.pandas_udf(struct(statistic="double", p_value="double", p_exact="double", p_chi2="double", test="string"))
def mcnemar_test(b: pd.Series, c: pd.Series) -> pd.DataFrame:
    """Of discordant counts b and c: chi-square with continuity correction, its p, the exact p, and the one that counts."""
    rows = []
    for x, y in zip(b, c, strict=True):
        x, y = int(x), int(y)
        n = x + y
        statistic = max(0, abs(x - y) - 1) ** 2 / n if n else 0.0
        exact, chi2 = binomial_two_sided(x, n), chi2_sf(statistic, 1) if n else 1.0
        rows.append((statistic, exact if n < EXACT_BELOW else chi2, exact, chi2, "exact" if n < EXACT_BELOW else "chi2"))
    return pd.DataFrame(rows, columns=["statistic", "p_value", "p_exact", "p_chi2", "test"])


@F.pandas_udf(T.DoubleType())
def chi2_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else chi2_sf(float(a), int(b)) for a, b in zip(x, df, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def f_p(x: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) else f_sf(float(a), float(b), float(c)) for a, b, c in zip(x, d1, d2, strict=True)], dtype="float64")


@F.pandas_udf(struct(lo="double", hi="double"))
def binomial_ci(k: pd.Series, n: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([clopper_pearson(int(a), int(b)) if b else (None, None) for a, b in zip(k, n, strict=True)], columns=["lo", "hi"])


@F.pandas_udf(struct(lo="double", hi="double"))
def poisson_ci(count: pd.Series, hours: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([poisson_rate_ci(int(a), float(b)) for a, b in zip(count, hours, strict=True)], columns=["lo", "hi"])


@F.pandas_udf(T.DoubleType())
def range_p(q: pd.Series, k: pd.Series, df: pd.Series) -> pd.Series:
    """p of a studentised range q over k groups."""
    return pd.Series([None if pd.isna(a) else studentised_range_sf(float(a), int(b), float(c)) for a, b, c in zip(q, k, df, strict=True)], dtype="float64")


#: Cumulative shares of a Poisson variable of mean 1, as bounds of a 64-bit number.
_POISSON = np.array([min((1 << 64) - 1, int(sum(math.exp(-1) / math.factorial(j) for j in range(n + 1)) * (1 << 64))) for n in range(15)], np.uint64)


def poisson_counts(seeds: np.ndarray, resamples: int) -> np.ndarray:
    """How often each row (a 64-bit seed) is in each resample: the same for a row wherever it is computed."""
    x = seeds.astype(np.uint64)[:, None] + (np.arange(1, resamples + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None]
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return np.searchsorted(_POISSON, x ^ (x >> np.uint64(31)), side="right")


def poisson_sums(seeds: np.ndarray, times: np.ndarray, resamples: int) -> np.ndarray:
    """What poisson_counts() of `times` rows each add up to (a Poisson variable of mean `times`); one draw for each resample, however many rows they are."""
    out = np.empty((len(seeds), resamples))
    once = times == 1
    out[once] = poisson_counts(seeds[once], resamples)
    for k in np.flatnonzero(~once):
        out[k] = np.random.default_rng(int(seeds[k])).poisson(float(times[k]), resamples)
    return out


def poisson_bootstrap(df: DataFrame, keys: list[str], ratios: dict[str, tuple[Column, Column]], seed: int, unit: str, resamples: int = 10_000, confidence: float = 0.95) -> DataFrame:
    """Per group and measure: n, ratio of sums, and the nearest-rank percentile interval of that ratio over Poisson resamples (lo, hi; null for fewer than two rows).

    ratios: measure to (numerator, denominator); a row whose denominator isn't positive drops out of that
    measure. Each row joins each resample a Poisson number of times (mean 1) that its unit (an id; rows
    with one id are drawn together) and the seed fix, the same for all measures, so a resample's sums
    are plain partial sums: tasks send one pair of sums a group, measure and resample, and no group's rows meet.
    Units of a group whose sums are equal are one draw of their number's Poisson variable, so the work follows
    the distinct sums and not the rows where there are fewer of them.
    """
    measures = list(ratios)
    cells = [x for a, b in ratios.values() for x in (F.when(b > 0, a).otherwise(0).cast("double"), F.when(b > 0, b).otherwise(0).cast("double"))]
    rows = df.select(*keys, F.xxhash64(F.lit(seed), F.col(unit)).alias("u"), *[F.coalesce(c, F.lit(0.0)).alias(f"_x{k}") for k, c in enumerate(cells)])
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keys)])
    columns = [f"_x{k}" for k in range(len(cells))]
    units = rows.groupBy(*keys, "u").agg(*[F.sum(c).alias(c) for c in columns])
    alike = units.groupBy(*keys, *columns).agg(F.min("u").alias("u"), F.count("*").alias("_n"))

    def resampled(it):
        sums: dict[tuple, np.ndarray] = {}
        for pdf in it:
            for key, part in pdf.groupby(keys, dropna=False):
                total = sums.setdefault(key, np.zeros((len(columns), resamples)))
                values = part[columns].to_numpy().T
                seeds, times = part["u"].to_numpy().view(np.uint64), part["_n"].to_numpy()
                for at in range(0, len(seeds), 64):
                    total += values[:, at : at + 64] @ poisson_sums(seeds[at : at + 64], times[at : at + 64], resamples)
        for key, total in sums.items():
            for k, name in enumerate(measures):
                yield pd.DataFrame(dict(zip(keys, key, strict=True)) | {"measure": name, "i": np.arange(resamples), "a": total[2 * k], "b": total[2 * k + 1]})

    drawn = alike.repartition("u").mapInPandas(resampled, f"{fields}, measure string, i bigint, a double, b double")
    group = [*keys, "measure"]
    each = drawn.groupBy(*group, "i").agg((F.sum("a") / F.nullif(F.sum("b"), F.lit(0.0))).alias("x"))
    half = (1 - confidence) / 2
    ends = each.groupBy(*group).agg(*[F.expr(f"percentile_disc({p}) within group (order by x)").alias(name) for name, p in (("lo", half), ("hi", 1 - half))])
    whole = rows.select(*keys, F.inline(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(f"_x{2 * k}").alias("a"), F.col(f"_x{2 * k + 1}").alias("b")) for k, m in enumerate(measures)]))).where("b > 0")
    whole = whole.groupBy(*group).agg(F.count("*").alias("n"), (F.sum("a") / F.sum("b")).alias("value"))
    same = [F.col(f"w.{k}").eqNullSafe(F.col(f"e.{k}")) for k in group]
    joined = whole.alias("w").join(ends.alias("e"), reduce(and_, same))
    return joined.select(*[f"w.{k}" for k in group], "n", F.col("value").alias("ratio"), *[F.when(F.col("n") > 1, F.col(c)).alias(c) for c in ("lo", "hi")])


def percentile(value: Column | str, p: float) -> Column:
    """Nearest-rank percentile of a group: a member, never an interpolation."""
    name = value if isinstance(value, str) else None
    if name is None:
        raise TypeError("percentile takes a column name")
    return F.expr(f"percentile_disc({p}) within group (order by {name})")


def bonferroni(alpha: float, comparisons: int) -> float:
    if comparisons < 1:
        raise ValueError("at least one comparison")
    return alpha / comparisons
