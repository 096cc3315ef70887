"""One whole audit run: inputs to reliability, representation and manifest."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkaudit.operators import linear, metrics, models
from larkaudit.sources.config import RunConfig
from larkaudit.sources.readers import read_delimited, unpivot_matrix
from larkaudit.sources.validate import Inputs, SchemaError, aligned, check_output

OOF = ["patient_id", "repeat", "fold", "model", "true_label", "oof_probability", "predicted_label"]
RELIABILITY = ["patient_id", "true_label", "mean_prob_logistic", "mean_prob_extratrees", "cross_model_difference", "resampling_sd_logistic", "resampling_sd_extratrees", "model_disagreement"]
REPRESENTATION = ["n_genes", "n_represented_genes", "n_gap_genes", "absolute_contribution_coverage", "signed_residual"]


def reliability(oof: DataFrame) -> DataFrame:
    """Mean and spread of both models by patient, their difference, and whether they name different classes."""
    w = oof.groupBy("patient_id", "true_label").pivot("model", ["logistic", "extratrees"]).agg(F.avg("oof_probability").alias("m"), F.stddev_samp("oof_probability").alias("s"))
    w = w.select(
        "patient_id", "true_label", F.col("logistic_m").alias("mean_prob_logistic"), F.col("extratrees_m").alias("mean_prob_extratrees"),
        (F.col("logistic_m") - F.col("extratrees_m")).alias("cross_model_difference"), F.col("logistic_s").alias("resampling_sd_logistic"), F.col("extratrees_s").alias("resampling_sd_extratrees"),
    )
    return w.withColumn("model_disagreement", (F.col("mean_prob_logistic") >= 0.5) != (F.col("mean_prob_extratrees") >= 0.5))


def representation(long: DataFrame, labels: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row of coverage, and mean contributions of each gene without a set; contributions are scaled values times the coefficients of a fitted model."""
    shap = linear.whole_fit(long.select(F.col("patient_id").alias("sample_id"), F.col("gene_id").alias("gene"), "value"), labels.select(F.col("patient_id").alias("sample_id"), F.col("label").alias("y")))
    has = sets.select("gene_id").distinct().withColumn("represented", F.lit(True))
    c = shap.select(F.col("gene").alias("gene_id"), F.col("shap").alias("c")).join(has, "gene_id", "left").withColumn("represented", F.coalesce("represented", F.lit(False)))
    per = c.groupBy("gene_id", "represented").agg(F.avg(F.abs("c")).alias("mean_absolute_contribution"), F.avg("c").alias("mean_signed_contribution"), F.sum(F.abs("c")).alias("_a"), F.sum("c").alias("_c"))
    covered = lambda v: F.sum(F.when(F.col("represented"), F.col(v)).otherwise(0.0))
    one = per.agg(
        F.count("*").alias("n_genes"), F.sum(F.when(F.col("represented"), 1).otherwise(0)).alias("n_represented_genes"), F.sum(F.when(F.col("represented"), 0).otherwise(1)).alias("n_gap_genes"),
        F.coalesce(F.try_divide(covered("_a"), F.sum("_a")), F.lit(0.0)).alias("absolute_contribution_coverage"), (F.sum("_c") - covered("_c")).alias("signed_residual"),
    )
    return one, per.where(~F.col("represented")).select("gene_id", "represented", "mean_absolute_contribution", "mean_signed_contribution")


def _tables(inputs: Inputs, config: RunConfig) -> dict[str, DataFrame]:
    code = F.create_map(*[F.lit(x) for pair in config.classes for x in pair])
    labels = inputs.clinical.select(F.col(config.patient_id).alias("patient_id"), F.col(config.endpoint).alias("endpoint_label"), code[F.col(config.endpoint)].alias("endpoint_code"))
    long = unpivot_matrix(inputs.expression, config.gene_id, "gene_id", "patient_id")
    coded = labels.select("patient_id", F.col("endpoint_code").alias("label"))
    numbered = coded.withColumn("sample_id", F.abs(F.xxhash64("patient_id")))
    vectors = long.join(numbered, "patient_id").groupBy("sample_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("gene_id", "value"))), lambda s: s["value"]).alias("x"))
    folds = models.stratified_folds(numbered.select("sample_id", F.col("label").alias("y")), "sample_id", "y", config.folds, config.repeats)
    fitted = models.out_of_fold(vectors, folds, trees=80, leaf=2, k=1 << 30, seed=config.seed)
    oof = fitted.join(numbered, "sample_id").select(
        "patient_id", F.col("repeat_id").alias("repeat"), F.col("fold_id").alias("fold"), "model", F.col("label").alias("true_label"),
        F.col("p").alias("oof_probability"), F.when(F.col("p") >= 0.5, 1).otherwise(0).alias("predicted_label"),
    )
    one, gaps = representation(long, coded, inputs.sets)
    scored = oof.select("repeat", "fold", "model", F.col("true_label").alias("y"), F.col("oof_probability").alias("p"))
    n = scored.groupBy("repeat", "fold", "model").agg(F.count("*").alias("n_test"))
    return {
        "matched_samples": labels, "exclusion_log": inputs.excluded, "oof_probabilities": check_output(oof, OOF, "oof_probabilities"),
        "fold_metrics": metrics.auc(scored, ["repeat", "fold", "model"]).join(n, ["repeat", "fold", "model"]),
        "patient_reliability": check_output(reliability(oof), RELIABILITY, "patient_reliability"),
        "representation_audit": check_output(one, REPRESENTATION, "representation_audit"), "representation_gap_genes": gaps,
    }


def run(spark: SparkSession, config: RunConfig) -> dict:
    """Writes every table as Parquet and a manifest; a failed run leaves a failure log and a failed manifest, and raises."""

    def write(name: str, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(f"{config.output}/{name}")

    def manifest(payload: dict) -> None:
        one = spark.range(1).select(F.lit(json.dumps(payload, sort_keys=True)).alias("value"))
        one.write.mode("overwrite").text(f"{config.output}/run_manifest")

    try:
        inputs = aligned(
            read_delimited(spark, config.expression), read_delimited(spark, config.clinical), read_delimited(spark, config.gene_sets),
            config.gene_id, config.patient_id, config.endpoint, dict(config.classes),
        )
        tables = _tables(inputs, config)
        for name, df in tables.items():
            write(name, df)
        back = spark.read.parquet(f"{config.output}/oof_probabilities").select("model", F.col("true_label").alias("y"), F.col("oof_probability").alias("p"))
        disagree = spark.read.parquet(f"{config.output}/patient_reliability").where("model_disagreement").count()
        summary = {
            "status": "complete", "seed": config.seed, "n_oof_rows": back.count(), "model_disagreement_count": disagree,
            "model_auc": {r["model"]: round(r["roc_auc"], 6) for r in metrics.auc(back, ["model"]).collect()}, "files": sorted(tables),
        }
        manifest(summary)
        return summary
    except Exception as error:
        code, module = ("SCHEMA_VALIDATION_FAILED", "M0") if isinstance(error, SchemaError) else ("RUN_FAILED", "RUN")
        row = spark.range(1).select(F.lit(module).alias("module"), F.lit(code).alias("failure_code"), F.lit("error").alias("severity"), F.lit(str(error)[:2000]).alias("message"), F.lit(1).alias("affected_count"))
        write("failure_log", row)
        manifest({"status": "failed", "failure_code": code})
        raise


def latest(spark: SparkSession, runs: list[str], required: set[str]) -> str | None:
    """The last of the runs, in order of name, whose manifest is complete and lists all required tables."""
    for path in sorted(runs, reverse=True):
        try:
            told = json.loads(spark.read.text(f"{path}/run_manifest").first()["value"])
        except Exception:  # a run without a manifest is none
            continue
        if told.get("status") == "complete" and required <= set(told.get("files", [])):
            return path
    return None


