"""Checks of the audit's inputs, each in one pass, and the aligned inputs that come out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class SchemaError(ValueError):
    """An input does not have the form that it should."""


def require_columns(df: DataFrame, names: set[str], what: str) -> None:
    missing = sorted(names - set(df.columns))
    if missing:
        raise SchemaError(f"{what}: missing required column(s) {', '.join(missing)}")


def require(found: bool, message: str) -> None:
    if not found:
        raise SchemaError(message)


def check_expression(wide: DataFrame, gene: str, least_samples: int = 6) -> None:
    require_columns(wide, {gene}, "expression")
    samples = [c for c in wide.columns if c != gene]
    require(len(samples) >= least_samples, f"expression: at least {least_samples} patient columns are needed")
    bad = sum((F.when(F.col(f"`{c}`").cast("string").try_cast("double").isNull(), 1).otherwise(0) for c in samples), F.lit(0))
    odd = sum((F.when(F.isnan(F.col(f"`{c}`").cast("string").try_cast("double")) | (F.abs(F.col(f"`{c}`").cast("string").try_cast("double")) == float("inf")), 1).otherwise(0) for c in samples), F.lit(0))
    one = wide.agg(
        F.count("*").alias("n"), F.count(F.when(F.col(gene).isNull() | (F.trim(F.col(gene).cast("string")) == ""), 1)).alias("blank"),
        F.countDistinct(gene).alias("distinct"), F.coalesce(F.sum(bad), F.lit(0)).alias("bad"), F.coalesce(F.sum(F.coalesce(odd, F.lit(0))), F.lit(0)).alias("odd"),
    ).first()
    require(one["n"] > 0, "expression: the table is empty")
    require(one["blank"] == 0, "expression: blank gene id")
    require(one["distinct"] == one["n"], "expression: duplicate gene id")
    require(one["bad"] == 0, "expression: values must be numeric")
    require(one["odd"] == 0, "expression: values must be finite")


def check_clinical(clinical: DataFrame, patient: str, endpoint: str, allowed: set[str]) -> None:
    require_columns(clinical, {patient, endpoint}, "clinical")
    one = clinical.agg(F.count("*").alias("n"), F.countDistinct(patient).alias("d"), F.collect_set(F.when(F.col(endpoint).isin(*allowed), F.col(endpoint))).alias("seen"), F.count(F.when(~F.coalesce(F.col(endpoint).isin(*allowed), F.lit(False)), 1)).alias("bad")).first()
    require(one["n"] > 0, "clinical: the table is empty")
    require(one["d"] == one["n"], "clinical: duplicate patient id")
    require(one["bad"] == 0, "clinical: invalid endpoint label")
    require(len(one["seen"]) >= 2, "clinical: at least two classes are needed")


def check_sets(sets: DataFrame) -> None:
    require_columns(sets, {"process_id", "gene_id"}, "gene sets")
    one = sets.agg(F.count("*").alias("n"), F.count(F.when(F.col("process_id").isNull() | F.col("gene_id").isNull(), 1)).alias("nulls")).first()
    require(one["n"] > 0, "gene sets: the table is empty")
    require(one["nulls"] == 0, "gene sets: null entries")


@dataclass
class Inputs:
    """Expression and clinical rows of the patients in both, the sets, and the patients that only expression has."""

    expression: DataFrame
    clinical: DataFrame
    sets: DataFrame
    excluded: DataFrame


def aligned(expression: DataFrame, clinical: DataFrame, sets: DataFrame, gene: str, patient: str, endpoint: str, classes: dict[str, int]) -> Inputs:
    require_columns(expression, {gene}, "expression")
    require_columns(clinical, {patient, endpoint}, "clinical")
    in_rows = clinical.select(F.col(patient).alias("p")).distinct().join(expression.select(F.col(gene).alias("p")).distinct(), "p", "left_anti")
    require(clinical.isEmpty() or not in_rows.isEmpty(), "expression: orientation appears invalid, patients are in rows")
    check_expression(expression, gene)
    check_clinical(clinical, patient, endpoint, set(classes))
    check_sets(sets)
    columns = [c for c in expression.columns if c != gene]
    spark = expression.sparkSession
    named = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias(patient))
    lost = clinical.select(patient).join(named, patient, "left_anti")
    require(lost.isEmpty(), "clinical: patients missing from expression")
    return Inputs(expression, clinical, sets, named.join(clinical.select(patient), patient, "left_anti").withColumn("reason", F.lit("no clinical row")))


def check_output(df: DataFrame, names: list[str], what: str) -> DataFrame:
    require(df.columns == names, f"{what}: columns are {df.columns}, not {names}")
    return df


def require_few_rescued(harmonized: DataFrame, most: int = 100) -> DataFrame:
    """The table of ``attribution.harmonize`` itself, if at most ``most`` symbols came from alias or synonym tables."""
    n = harmonized.where(F.col("status").isin("alias", "synonym")).count()
    if n > most:
        raise ValueError(f"{n} symbols rescued, {most} at most")
    return harmonized


def require_classes(df: DataFrame, label: str, least_rows: int = 300, least_class: int = 30) -> DataFrame:
    """The table itself, if it has enough rows, and enough of each of two classes."""
    sizes = {r[0]: r[1] for r in df.groupBy(label).count().limit(100).collect()}
    if sum(sizes.values()) < least_rows or len(sizes) < 2 or min(sizes.values()) < least_class:
        raise ValueError(f"too few rows by class: {sizes}")
    return df
