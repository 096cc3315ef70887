"""Ranks, cuts, tiers and corrections with the semantics of the usual data-frame libraries.

Ranks over a partition key run as windows. Ranks over all rows first count equal values, then
run in ranges of values, so that no task gets all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkaudit.functions.lineage import cut as cut_lineage

RANGES = 64
#: Distinct values that one window takes; more are split into RANGES ranges.
ONE_WINDOW = 200_000


def _ranged(counts: DataFrame, value: str) -> DataFrame:
    """``counts`` (value, same) with ``rng``, a range of values, and ``before``: rows with smaller values.

    Up to ONE_WINDOW values are one range, and so one window.
    """
    counts = cut_lineage(counts)  # read for their number, range bounds, sums and windows
    edges = []
    if counts.count() > ONE_WINDOW:
        edges = sorted(set(counts.approxQuantile(value, [i / RANGES for i in range(1, RANGES)], 0.005)))
    w = Window.partitionBy("rng").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    if not edges:
        return counts.withColumn("rng", F.lit(0)).withColumn("before", F.coalesce(F.sum("same").over(w), F.lit(0)))
    counts = counts.withColumn("rng", F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col(value))))
    sums = counts.groupBy("rng").agg(F.sum("same").alias("words"))
    sums = sums.withColumn("start", F.coalesce(F.sum("words").over(Window.orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inner = counts.withColumn("inner", F.coalesce(F.sum("same").over(w), F.lit(0)))
    return inner.join(sums.select("rng", "start"), "rng").withColumn("before", F.col("inner") + F.col("start")).drop("inner", "start")


def _cumulated(counts: DataFrame, value: str, keys: list[str]) -> DataFrame:
    """``before``: rows with smaller values, for each (keys, value) of ``counts``."""
    if keys:
        w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
        return counts.withColumn("before", F.coalesce(F.sum("same").over(w), F.lit(0)))
    return _ranged(counts, value).drop("rng")


def places(distinct: DataFrame, value: str, name: str = "place") -> DataFrame:
    """Adds the place of each row by a numeric column without repeats, from 0 on."""
    return _ranged(distinct.withColumn("same", F.lit(1)), value).withColumn(name, F.col("before").cast("long")).drop("same", "rng", "before")


def average_ranks(df: DataFrame, value: str, keys: list[str] | None = None, name: str = "avg_rank", total: str = "rank_n") -> DataFrame:
    """Adds the average rank of ``value`` within ``keys`` and the number of ranked rows; nulls get null."""
    keys = keys or []
    if not keys:
        df = cut_lineage(df)  # read for range bounds, ranks, totals and the join: once is enough to make it
        if df.count() <= ONE_WINDOW:
            known, alike = F.col(value).isNotNull(), F.count("*").over(Window.partitionBy(value))
            rank = F.rank().over(Window.orderBy(F.col(value).asc_nulls_last())) + (alike - 1) / 2
            return df.withColumn(name, F.when(known, rank)).withColumn(total, F.when(known, F.count(value).over(Window.partitionBy())))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("same"))
    ranked = _cumulated(counts, value, keys)
    totals = counts.groupBy(*keys).agg(F.sum("same").alias(total))
    ranked = ranked.withColumn(name, F.col("before") + (F.col("same") + 1) / 2)
    ranked = ranked.join(totals, keys) if keys else ranked.crossJoin(F.broadcast(totals))  # one row
    return df.join(ranked.select(*keys, value, name, total), [*keys, value], "left")


def rank_pct(df: DataFrame, value: str, keys: list[str] | None = None, name: str = "pct") -> DataFrame:
    """Adds the average rank as a share of the ranked rows."""
    out = average_ranks(df, value, keys, "_rank", "_n")
    return out.withColumn(name, F.col("_rank") / F.col("_n")).drop("_rank", "_n")


def first_rank(keys: list[str], *order: Column) -> Column:
    """Rank without ties; ``order`` has to be total."""
    return F.row_number().over(Window.partitionBy(*keys).orderBy(*order))


def min_rank(keys: list[str], *order: Column) -> Column:
    return F.rank().over(Window.partitionBy(*keys).orderBy(*order))


def minmax(value: str, keys: list[str]) -> Column:
    """Scaled to 0..1 within ``keys``; 0.5 where all are equal."""
    w = Window.partitionBy(*keys)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(F.col(value).isNull(), None).when(high <= low, 0.5).otherwise((F.col(value) - low) / F.nullif(high - low, F.lit(0.0)))


def cut(value: Column, edges: list[float], labels: list[str], lowest: bool = True) -> Column:
    """Right-closed bins: labels[i] for edges[i] < value <= edges[i+1]; the lowest edge counts in if ``lowest``."""
    out = F.when(value.isNull(), None)
    out = out.when((value < edges[0]) if lowest else (value <= edges[0]), None)
    for edge, label in zip(edges[1:], labels, strict=True):
        out = out.when(value <= edge, label)
    return out


def tiers(value: Column, q75: Column, q90: Column, strict: bool = False) -> Column:
    """high from the 90 % quantile on, moderate from the 75 % one; ``strict``: beyond it."""
    reach = (lambda q: value > q) if strict else (lambda q: value >= q)
    return F.when(value.isNull(), None).when(reach(q90), "high").when(reach(q75), "moderate").otherwise("low")


def bh_fdr(df: DataFrame, p: str, keys: list[str] | None = None, name: str = "fdr") -> DataFrame:
    """Adds Benjamini-Hochberg corrected values within ``keys``; null p stay null and do not count.

    Equal values are corrected alike. Without keys the values run in ranges, of which only the
    least corrected value of each is compared with the others'.
    """
    keys = keys or []
    if not keys:
        df = cut_lineage(df)
    counts = df.where(F.col(p).isNotNull()).groupBy(*keys, p).agg(F.count("*").alias("same"))
    totals = counts.groupBy(*keys).agg(F.sum("same").alias("_n"))
    ranked = _cumulated(counts, p, keys).join(totals, keys) if keys else _ranged(counts, p).crossJoin(F.broadcast(totals))  # one row
    ranked = ranked.withColumn("_q", F.col(p) * F.col("_n") / (F.col("before") + F.col("same")))
    down = Window.partitionBy(*keys or ["rng"]).orderBy(p).rowsBetween(Window.currentRow, Window.unboundedFollowing)
    ranked = ranked.withColumn("_q", F.min("_q").over(down))
    if not keys:
        later = Window.orderBy("rng").rowsBetween(1, Window.unboundedFollowing)  # one row a range
        least = ranked.groupBy("rng").agg(F.min("_q").alias("_m")).select("rng", F.min("_m").over(later).alias("_later"))
        ranked = ranked.join(F.broadcast(least), "rng").withColumn("_q", F.least("_q", "_later"))
    return df.join(ranked.select(*keys, p, F.least(F.lit(1.0), F.col("_q")).alias(name)), [*keys, p], "left")


def top_k(df: DataFrame, k: int, keys: list[str], *order: Column, name: str = "rank") -> DataFrame:
    """The first k rows of each group by a total order, with their rank."""
    return df.withColumn(name, first_rank(keys, *order)).where(F.col(name) <= k)


def sign_changes(df: DataFrame, value: str, keys: list[str], order: str, name: str = "sign_changes") -> DataFrame:
    """Changes of sign along ``order`` within ``keys``, zeros left out."""
    w = Window.partitionBy(*keys).orderBy(order)
    s = df.where(F.col(value) != 0).withColumn("_s", F.signum(value)).withColumn("_b", F.lag("_s").over(w))
    counted = s.groupBy(*keys).agg(F.sum(F.when(F.col("_s") != F.col("_b"), 1).otherwise(0)).alias(name))
    return df.select(*keys).distinct().join(counted, keys, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def effect_label(delta: Column) -> Column:
    size = F.abs(delta)
    return F.when(delta.isNull(), None).when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large")


def minus_log10(p: Column) -> Column:
    return -F.log10(F.greatest(p, F.lit(1e-300)))
