"""Rank tests, correlations and their tail probabilities."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkaudit.functions.ranks import average_ranks


def _series(a: float, x: float) -> float:
    term = total = 1 / a
    k = a
    for _ in range(1000):
        k += 1
        term *= x / k
        total += term
        if abs(term) < abs(total) * 1e-16:
            break
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def _fraction(a: float, x: float) -> float:
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        d = 1 / (d if abs(d) > 1e-300 else 1e-300)
        c = b + an / c
        c = c if abs(c) > 1e-300 else 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi2_tail(x: float, df: float) -> float:
    """P(X >= x) of a chi-squared variable."""
    if x <= 0:
        return 1.0
    a, x = df / 2, x / 2
    return 1 - _series(a, x) if x < a + 1 else _fraction(a, x)


def _beta(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > 1e-300 else 1e-300)
    h = d
    for m in range(1, 1000):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > 1e-300 else 1e-300)
            c = 1 + num / c
            c = c if abs(c) > 1e-300 else 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_share(df / 2, 0.5, df / (df + t * t)) if df > 0 else float("nan")


def f_tail(f: float, d1: float, d2: float) -> float:
    return beta_share(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f > 0 else 1.0


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


def _tail(function, *columns: Column) -> Column:
    @F.pandas_udf("double")
    def tails(*series: pd.Series) -> pd.Series:
        rows = zip(*series, strict=True)
        return pd.Series([None if any(v is None or v != v for v in r) else function(*map(float, r)) for r in rows], dtype="float64")

    p = tails(*columns)
    return F.when(F.isnan(p), None).otherwise(p)


def chi2_p(x: Column, df: Column) -> Column:
    return _tail(chi2_tail, x, df.cast("double"))


def t_p(t: Column, df: Column) -> Column:
    return _tail(t_two_sided, t, df.cast("double"))


def f_p(f: Column, d1: Column, d2: Column) -> Column:
    return _tail(f_tail, f, d1.cast("double"), d2.cast("double"))


def normal_p(z: Column) -> Column:
    return _tail(normal_two_sided, z)


def kruskal(df: DataFrame, keys: list[str], group: str, value: str, least: int = 2) -> DataFrame:
    """h with tie correction, the number of groups and of values, by keys; groups of fewer than ``least`` values are left out."""
    known = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(*keys, group, value)
    large = known.groupBy(*keys, group).count().where(F.col("count") >= least).select(*keys, group)
    known = known.join(large, [*keys, group])
    ranked = average_ranks(known, value, keys, "_r", "_n")
    per = ranked.groupBy(*keys, group).agg(F.sum("_r").alias("_s"), F.count("*").cast("double").alias("_m"), F.first("_n").cast("double").alias("_n"))
    h = per.groupBy(*keys).agg(F.sum(F.col("_s") ** 2 / F.col("_m")).alias("_q"), F.first("_n").alias("_n"), F.count("*").alias("n_groups"))
    ties = known.groupBy(*keys, value).agg(F.count("*").cast("double").alias("_t")).groupBy(*keys).agg(F.sum(F.col("_t") ** 3 - F.col("_t")).alias("_ties"))
    h = h.join(ties, keys) if keys else h.crossJoin(F.broadcast(ties))  # one row
    n = F.col("_n")
    raw = 12 / (n * (n + 1)) * F.col("_q") - 3 * (n + 1)
    return h.where("n_groups > 1").select(*keys, F.try_divide(raw, 1 - F.col("_ties") / (n**3 - n)).alias("h"), "n_groups", n.cast("long").alias("n"))


def mann_whitney(df: DataFrame, keys: list[str], first: str, value: str) -> DataFrame:
    """u of the rows where the boolean column ``first`` holds, cliffs_delta and z (ties and continuity corrected), by keys."""
    known = df.where(F.col(value).isNotNull() & F.col(first).isNotNull()).select(*keys, first, value)
    ranked = average_ranks(known, value, keys, "_r", "_n")
    g = ranked.groupBy(*keys).agg(
        F.sum(F.when(F.col(first), F.col("_r"))).alias("_s"),
        F.sum(F.when(F.col(first), 1.0).otherwise(0.0)).alias("_a"),
        F.sum(F.when(F.col(first), 0.0).otherwise(1.0)).alias("_b"),
    )
    ties = known.groupBy(*keys, value).agg(F.count("*").cast("double").alias("_t")).groupBy(*keys).agg(F.sum(F.col("_t") ** 3 - F.col("_t")).alias("_ties"))
    g = g.join(ties, keys) if keys else g.crossJoin(F.broadcast(ties))  # one row
    a, b = F.col("_a"), F.col("_b")
    n = a + b
    g = g.withColumn("u", F.col("_s") - a * (a + 1) / 2)
    sd = F.sqrt(a * b / 12 * ((n + 1) - F.try_divide(F.col("_ties"), n * (n - 1))))
    shift = F.greatest(F.abs(F.col("u") - a * b / 2) - 0.5, F.lit(0.0))
    return g.select(*keys, a.cast("long").alias("n_1"), b.cast("long").alias("n_2"), "u", (F.try_divide(2 * F.col("u"), a * b) - 1).alias("cliffs_delta"), F.try_divide(shift, sd).alias("z"))


def spearman(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """rho and n of the rows where both are known, by keys."""
    both = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    ranked = average_ranks(average_ranks(both, x, keys, "_x", "_n"), y, keys, "_y", "_m")
    return ranked.groupBy(*keys).agg(F.corr("_x", "_y").alias("rho"), F.count("*").alias("n"))


def with_rho_p(df: DataFrame) -> DataFrame:
    t = F.col("rho") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("rho") ** 2))
    return df.withColumn("p_value", t_p(t, F.col("n") - 2))


def pairwise(df: DataFrame, keys: list[str], group: str, value: str, least: int = 10) -> DataFrame:
    """u, cliffs_delta and sizes of every pair of groups of at least ``least`` values, by keys; group_1 < group_2.

    Groups are states, of which there are few; each row meets one copy of itself for every other group.
    """
    known = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).select(*keys, F.col(group).alias("_g"), value)
    large = known.groupBy(*keys, "_g").count().where(F.col("count") >= least).select(*keys, "_g")
    pairs = large.withColumnRenamed("_g", "group_1")
    other = large.withColumnRenamed("_g", "group_2")
    pairs = (pairs.join(other, keys) if keys else pairs.crossJoin(other)).where("group_1 < group_2")
    sides = pairs.select(*keys, "group_1", "group_2", F.explode(F.array("group_1", "group_2")).alias("_g"))
    both = known.join(sides, [*keys, "_g"]).withColumn("_first", F.col("_g") == F.col("group_1"))
    return mann_whitney(both, [*keys, "group_1", "group_2"], "_first", value)


def flip_contrasts(tests: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted pairs (group_1, group_2) in the wanted order: stored the other way round, sizes swap and delta changes its sign."""
    kept = tests.join(wanted, ["group_1", "group_2"]).withColumn("flipped", F.lit(False))
    back = tests.join(wanted.select(F.col("group_2").alias("group_1"), F.col("group_1").alias("group_2")), ["group_1", "group_2"])
    back = back.select(
        *[F.col({"group_1": "group_2", "group_2": "group_1", "n_1": "n_2", "n_2": "n_1"}.get(c, c)).alias(c) if c not in ("cliffs_delta", "u") else
          (-F.col("cliffs_delta") if c == "cliffs_delta" else F.col("n_1") * F.col("n_2") - F.col("u")).alias(c) for c in tests.columns]
    )
    return kept.unionByName(back.withColumn("flipped", F.lit(True)))
