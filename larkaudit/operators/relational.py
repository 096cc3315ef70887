"""Joins, dedupes, grids and audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkaudit.functions.lineage import cut
from larkaudit.functions.quantiles import exact_quantiles


#: Values of an axis that are broadcast at most.
SHORT = 100_000


class AuditError(ValueError):
    """An invariant does not hold."""


def assert_unique(df: DataFrame, keys: list[str], what: str = "table") -> DataFrame:
    """The table itself, if no key repeats."""
    again = df.groupBy(*keys).count().where("count > 1").limit(1)
    if not again.isEmpty():
        raise AuditError(f"{what}: repeated key {again.first().asDict()}")
    return df


def first_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row a key, the first by a total order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def match_audit(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """metric, value: keys in both, left only and right only."""
    both = left.select(key).distinct().withColumn("l", F.lit(1)).join(right.select(key).distinct().withColumn("r", F.lit(1)), key, "full_outer")
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    one = both.agg(
        n(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("matched"), n(F.col("r").isNull()).alias("left_only"), n(F.col("l").isNull()).alias("right_only")
    )
    return metric_rows(one)


def metric_rows(one: DataFrame) -> DataFrame:
    """metric, value from a table of one row of numbers."""
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one.columns])).alias("_m")).select("_m.*")


def label_conflicts(df: DataFrame, key: str, label: str) -> DataFrame:
    """Keys with more than one label, and how many."""
    return df.groupBy(key).agg(F.countDistinct(label).alias("n_labels")).where("n_labels > 1")


def collapse_mean(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(value))


def densify(facts: DataFrame, axes: list[DataFrame], keys: list[str], measures: list[str]) -> DataFrame:
    """All combinations of the axes with 0 where no fact is: the first of any length, the others lists of distinct values, broadcast up to SHORT of them."""
    grid = axes[0]
    for a in map(cut, axes[1:]):
        grid = grid.crossJoin(F.broadcast(a) if a.count() <= SHORT else a)
    out = grid.join(facts, keys, "left")
    return out.select(*keys, *[F.coalesce(m, F.lit(0.0)).alias(m) for m in measures])


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """a, b, n with zero cells; a and b are states of which there are few."""
    n = df.groupBy(a, b).agg(F.count("*").alias("n"))
    grid = n.select(a).distinct().crossJoin(n.select(b).distinct())
    return grid.join(n, [a, b], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def fallback_join(left: DataFrame, right: DataFrame, key: str, least: int = 100) -> DataFrame:
    """An inner join by key; if it matches fewer than ``least`` rows, by the key without blanks if that matches more."""
    exact = left.join(right, key)
    n = exact.count()
    if n >= least:
        return exact
    squeezed = left.withColumn("_s", F.regexp_replace(key, r"\s", "")).join(right.withColumn("_s", F.regexp_replace(key, r"\s", "")).drop(key), "_s").drop("_s")
    return squeezed if squeezed.count() > n else exact


def describe(df: DataFrame, keys: list[str], value: str, tails: dict[str, float] | None = None) -> DataFrame:
    """n, mean, sd, median, q25, q75, least, most by keys, null keys kept; ``tails`` are further quantiles by name."""
    df = cut(df.select(*keys, value))
    named = {c: F.struct(F.col(k)).alias(c) for c, k in zip((f"_k{i}" for i in range(len(keys))), keys, strict=True)}  # a struct joins where its field is null
    spread = df.groupBy(*named.values()).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.min(value).alias("least"), F.max(value).alias("most"))
    q = exact_quantiles(df, value, {"median": 0.5, "q25": 0.25, "q75": 0.75} | (tails or {}), keys)
    q = q.select(*named.values(), *[F.round(c, 9).alias(c) for c in q.columns if c not in keys])
    out = spread.join(q, list(named)) if keys else spread.crossJoin(q)  # one row each
    return out.select(*[F.col(c)[k].alias(k) for c, k in zip(named, keys, strict=True)], "n", "mean", "sd", "median", "q25", "q75", "least", "most", *(tails or {}))


def column_diagnostics(df: DataFrame) -> DataFrame:
    """column, n_known, n_missing, n_distinct for each column, in one pass."""
    cols = [c for c, _ in df.dtypes]
    one = df.agg(*[F.struct(F.count(c).alias("k"), F.count("*").alias("n"), F.countDistinct(c).alias("d")).alias(c) for c in cols])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c)["k"].alias("n_known"), (F.col(c)["n"] - F.col(c)["k"]).alias("n_missing"), F.col(c)["d"].alias("n_distinct")) for c in cols])
    return one.select(F.explode(rows).alias("_r")).select("_r.*")
