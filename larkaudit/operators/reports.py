"""Reports by patient: labels of genes, subsets in a given order, counts of recommendations, and texts from templates."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from larkaudit.functions.text import ordered_join

#: Written where a value is missing, and where no gene is named. Fixed values.
MISSING, NO_GENES = "NA", "No gene-level target passed the current support and ranking thresholds."
NO_NAME = ["", "nan", "none", "null", "na"]
RULE = "-" * 60


def gene_texts(genes: DataFrame, raw: str, harmonized: str, core: str, rank: str) -> DataFrame:
    """patient_id, recommended_gap_genes and their number: raw[core], or raw->harmonized[core] where that names another gene, by rank."""
    other = F.col(harmonized).cast("string")
    known = other.isNotNull() & ~F.lower(other).isin(NO_NAME) & (other != F.col(raw).cast("string"))
    label = F.concat(F.col(raw).cast("string"), F.when(known, F.concat(F.lit("->"), other)).otherwise(""), F.lit("["), F.col(core).cast("string"), F.lit("]"))
    return genes.groupBy("patient_id").agg(ordered_join(label, F.col(rank)).alias("recommended_gap_genes"), F.count("*").alias("n_recommended_gap_genes"))


def with_texts(patients: DataFrame, texts: DataFrame) -> DataFrame:
    """``patients`` with the texts of ``gene_texts`` in place of older ones; patients without any have an empty one and 0."""
    kept = patients.drop("recommended_gap_genes", "n_recommended_gap_genes").join(texts, "patient_id", "left")
    return kept.na.fill("", ["recommended_gap_genes"]).na.fill(0, ["n_recommended_gap_genes"])


def in_order(patients: DataFrame, ranked: DataFrame, name: str = "boundary_priority_rank") -> DataFrame:
    """The patients that ``ranked`` (patient_id, rank) lists, with their rank, sorted by it."""
    return patients.join(ranked.select("patient_id", F.col("rank").alias(name)), "patient_id").orderBy(name)


def type_counts(patients: DataFrame, flags: dict[str, str]) -> DataFrame:
    """recommendation_type, n_patients: in how many patients each flag (type: column) is set; 0 for a flag that none has."""
    sums = patients.agg(*[F.coalesce(F.sum(F.when(F.col(c).cast("boolean"), 1).otherwise(0)), F.lit(0)).cast("long").alias(t) for t, c in flags.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(t).alias("recommendation_type"), F.col(t).alias("n_patients")) for t in flags])).alias("_f")).select("_f.*")


def core_counts(rows: DataFrame, keys: list[str], measures: dict[str, str]) -> DataFrame:
    """By keys: n_patient_core_records and the mean of each measure (name: column)."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n_patient_core_records"), *[F.avg(c).alias(n) for n, c in measures.items()])


def shown(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(MISSING))


@F.arrow_udf(StringType())
def _four_places(value: pa.Array) -> pa.Array:
    return pa.array([MISSING if v is None or v != v else f"{v:.4f}" for v in value.to_pylist()], pa.string())


def number(value: Column) -> Column:
    """Four places, by the double's exact value, halves to even: Spark's own format rounds its shortest decimal, halves up."""
    return _four_places(value.cast("double"))


def genes_or_note(genes: Column) -> Column:
    text = F.trim(F.coalesce(genes, F.lit("")))
    return F.when(F.lower(text).isin("", "nan", "none"), NO_GENES).otherwise(text)


def report(title: str, patient: Column, facts: dict[str, Column], sections: dict[str, list[Column]], note: str) -> Column:
    """One text: title, patient, labelled facts, and sections under headings; ``note`` closes it."""
    lines: list[Column] = [F.lit(title), F.lit("=" * 60), F.lit(""), F.concat(F.lit("Patient: "), shown(patient))]
    lines += [F.concat(F.lit(f"{label}: "), value) for label, value in facts.items()]
    for heading, body in sections.items():
        lines += [F.lit(""), F.lit(heading), F.lit(RULE), *body]
    return F.concat_ws("\n", *lines, F.lit(""), F.lit("INTERPRETATION BOUNDARY"), F.lit(RULE), F.lit(note))


def write_texts(texts: DataFrame, path: str, key: str = "patient_id", text: str = "report") -> None:
    """One folder a key, key=..., with one file that holds the key's text; keys are written where their rows lie."""
    texts.select(F.col(key).cast("string").alias(key), F.col(text).alias("value")).repartition(key).write.mode("overwrite").partitionBy(key).text(path)
