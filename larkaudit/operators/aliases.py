"""Samples known by several names: audits of their records, aliases that one sample owns, and columns matched by them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkaudit.functions.ranks import first_rank
from larkaudit.functions.text import normalize_identifier


def joined_set(value: Column, between: str = " | ") -> Column:
    """The distinct values of a group in order, as one text."""
    return F.array_join(F.array_sort(F.collect_set(value.cast("string"))), between)


def record_audit(records: DataFrame, key: str, value: str, told: dict[str, str]) -> DataFrame:
    """By key: n_records, n_values, value (the only one; null where records conflict), conflicting, and the set of each column of ``told`` (name: column).

    Records without a value do not count; keys without any are left out.
    """
    known = records.where(F.col(value).isNotNull())
    g = known.groupBy(key).agg(
        F.count("*").alias("n_records"), F.countDistinct(value).alias("n_values"), F.min(value).alias("_v"), *[joined_set(F.col(c)).alias(name) for name, c in told.items()]
    )
    agreed = F.col("n_values") == 1
    return g.select(key, "n_records", "n_values", F.when(agreed, F.col("_v")).alias(value), (~agreed).alias("conflicting"), *told)


def aliases(samples: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, alias_rank (of ``columns``), alias_type, alias_raw, alias: a row for each column that names a sample."""
    each = [F.struct(F.lit(i).alias("alias_rank"), F.lit(c).alias("alias_type"), F.col(c).cast("string").alias("alias_raw")) for i, c in enumerate(columns, 1)]
    rows = samples.select(key, F.explode(F.array(*each)).alias("_a")).select(key, "_a.*")
    rows = rows.withColumn("alias", normalize_identifier(F.col("alias_raw")))
    return rows.where("alias is not null and alias <> ''")


def owned_aliases(named: DataFrame, key: str) -> DataFrame:
    """The aliases that only one key has, each once: of the column of the smallest rank, the first by raw text."""
    owners = named.groupBy("alias").agg(F.countDistinct(key).alias("_n")).where("_n = 1").select("alias")
    kept = named.join(owners, "alias")
    return kept.withColumn("_k", first_rank(["alias"], F.asc("alias_rank"), F.asc("alias_raw"))).where("_k = 1").drop("_k")


def matched_columns(columns: DataFrame, owned: DataFrame, key: str, name: str = "column", order: str = "at") -> DataFrame:
    """key, column, alias, alias_type, alias_raw: columns (name, and at, their order) that an alias names, each column and each key once, first by order."""
    c = columns.withColumn("alias", normalize_identifier(F.col(name)))
    hit = c.join(owned, "alias").withColumn("_c", first_rank([name], F.asc(order), F.asc(key))).where("_c = 1")
    return hit.withColumn("_k", first_rank([key], F.asc(order), F.asc(name))).where("_k = 1").select(key, name, order, "alias", "alias_type", "alias_raw")
