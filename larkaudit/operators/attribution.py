"""Attributions by feature: allocation to overlapping sets, coverage, top-k mass, stability."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkaudit.functions.lineage import cut
from larkaudit.functions.quantiles import exact_quantiles
from larkaudit.functions.ranks import cut as classes
from larkaudit.functions.ranks import first_rank, min_rank
from larkaudit.functions.text import clean_symbol

UNIT = ["sample_id", "repeat_id"]


def edges(memberships: DataFrame, least: int = 1) -> DataFrame:
    """term, gene, weight: 1 / (number of the gene's sets), over sets of at least ``least`` genes."""
    m = memberships.select("term", "gene").distinct()
    large = m.groupBy("term").count().where(F.col("count") >= least).select("term")
    m = m.join(large, "term", "left_semi")
    return m.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("gene")))


def allocate(attribution: DataFrame, weighted: DataFrame) -> DataFrame:
    """term attribution of each unit: every gene's value split over its sets."""
    return attribution.join(weighted, "gene").groupBy(*UNIT, "term").agg(F.sum(F.col("shap") * F.col("weight")).alias("term_shap"))


def completeness(attribution: DataFrame, weighted: DataFrame) -> DataFrame:
    """n_genes, n_mapped, coverage (absolute share of mapped genes; 0 of nothing) and the signed residual of unmapped ones."""
    mapped = weighted.select("gene").distinct().withColumn("_m", F.lit(1.0))
    a = attribution.join(mapped, "gene", "left").withColumn("_m", F.coalesce("_m", F.lit(0.0)))
    g = a.groupBy(*UNIT).agg(
        F.count("*").alias("n_genes"), F.sum("_m").cast("long").alias("n_mapped"), F.sum(F.abs("shap") * F.col("_m")).alias("_c"), F.sum(F.abs("shap")).alias("_a"),
        F.sum(F.col("shap") * (1 - F.col("_m"))).alias("residual"), F.sum("shap").alias("total"),
    )
    return g.withColumn("coverage", F.when(F.col("_a") == 0, 0.0).otherwise(F.try_divide("_c", "_a"))).drop("_c", "_a")


def reconstruction_error(attribution: DataFrame, weighted: DataFrame) -> DataFrame:
    """Largest and mean absolute difference of the total and sets plus residual, over all units."""
    sets = allocate(attribution, weighted).groupBy(*UNIT).agg(F.sum("term_shap").alias("in_sets"))
    c = completeness(attribution, weighted).join(sets, UNIT, "left")
    d = F.abs(F.col("total") - F.coalesce("in_sets", F.lit(0.0)) - F.col("residual"))
    return c.agg(F.max(d).alias("max_error"), F.avg(d).alias("mean_error"), F.count("*").alias("n"))


def topk_mass(attribution: DataFrame, ks: list[int], item: str = "gene", value: str = "shap") -> DataFrame:
    """Share of the absolute mass, and signed sum, of the k largest items of each unit, for each k."""
    r = attribution.withColumn("_k", first_rank(UNIT, F.desc(F.abs(value)), F.asc(item)))
    aggs = [F.sum(F.abs(value)).alias("_a")]
    for k in ks:
        aggs += [F.sum(F.when(F.col("_k") <= k, F.abs(value))).alias(f"_m{k}"), F.sum(F.when(F.col("_k") <= k, F.col(value))).alias(f"top{k}_signed")]
    g = r.groupBy(*UNIT).agg(*aggs)
    for k in ks:
        g = g.withColumn(f"top{k}_mass", F.coalesce(F.try_divide(f"_m{k}", "_a"), F.lit(0.0))).drop(f"_m{k}")
    return g.drop("_a")


def stability(attribution: DataFrame, item: str, value: str, folds: str, n_folds: int) -> DataFrame:
    """By item: folds, mean, median and sd of absolute values, mean signed value, frequency and variation."""
    per = attribution.groupBy(item, folds).agg(F.avg(F.abs(value)).alias("_a"), F.avg(value).alias("_s"))
    g = per.groupBy(item).agg(
        F.count("*").alias("n_folds"), F.avg("_a").alias("mean_abs"), F.median("_a").alias("median_abs"), F.stddev_samp("_a").alias("sd_abs"), F.avg("_s").alias("mean_signed")
    )
    return g.withColumn("frequency", F.col("n_folds") / float(n_folds)).withColumn("cv", F.try_divide("sd_abs", "mean_abs"))


def signs(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, sd, shares of positive and negative values, their larger one and the direction it has."""
    g = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("frac_pos"), F.avg(F.when(F.col(value) < 0, 1.0).otherwise(0.0)).alias("frac_neg"),
    )
    g = g.withColumn("sign_consistency", F.greatest("frac_pos", "frac_neg"))
    return g.withColumn("direction", F.when(F.col("frac_pos") > F.col("frac_neg"), "toward_advanced").when(F.col("frac_neg") > F.col("frac_pos"), "toward_early").otherwise("mixed"))


def harmonize(symbols: DataFrame, approved: DataFrame, aliases: DataFrame, synonyms: DataFrame) -> DataFrame:
    """raw, symbol, status: a cascade over approved symbols, alias and synonym tables (alias, symbol); ambiguous ones give null."""

    def looked_up(table: DataFrame, name: str) -> DataFrame:
        pairs = table.select(clean_symbol(F.col("alias")).alias("alias"), clean_symbol(F.col("symbol")).alias("symbol")).where("alias is not null and symbol is not null")
        return pairs.groupBy("alias").agg(F.countDistinct("symbol").alias(f"{name}_n"), F.min("symbol").alias(f"{name}_symbol")).withColumnRenamed("alias", "clean")

    known = approved.select(clean_symbol(F.col("symbol")).alias("clean")).where("clean is not null").distinct().withColumn("approved", F.lit(True))
    s = symbols.select(F.col("raw"), clean_symbol(F.col("raw")).alias("clean"))
    s = s.join(known, "clean", "left").join(looked_up(aliases, "a"), "clean", "left").join(looked_up(synonyms, "s"), "clean", "left")
    status = (
        F.when(F.col("clean").isNull(), "invalid").when(F.col("approved"), "approved").when(F.col("a_n") > 1, "alias_ambiguous").when(F.col("a_n") == 1, "alias")
        .when(F.col("s_n") > 1, "synonym_ambiguous").when(F.col("s_n") == 1, "synonym").otherwise("unresolved_retained")
    )
    s = s.withColumn("status", status)
    symbol = F.when(F.col("status").isin("approved", "unresolved_retained"), F.col("clean")).when(F.col("status") == "alias", F.col("a_symbol")).when(F.col("status") == "synonym", F.col("s_symbol"))
    return s.select("raw", symbol.alias("symbol"), "status")


def gap_tiers(genes: DataFrame, least_folds: int = 5, stable_folds: int = 10) -> DataFrame:
    """Adds a tier from folds, sign consistency and the quantiles of ``pipeline`` over supported genes."""
    genes = cut(genes)
    q = exact_quantiles(genes.where(F.col("n_folds") >= least_folds), "pipeline", {"_q75": 0.75, "_q90": 0.9})
    g = genes.crossJoin(F.broadcast(q))  # one row
    tier = (
        F.when((F.col("n_folds") >= stable_folds) & (F.col("pipeline") >= F.col("_q90")) & (F.col("sign_consistency") >= 0.8), "high")
        .when((F.col("n_folds") >= least_folds) & (F.col("pipeline") >= F.col("_q75")), "moderate")
        .otherwise("low")
    )
    return g.withColumn("tier", tier).drop("_q75", "_q90")


#: Right edges of the classes of set sizes, and their names. Fixed values.
SIZES, SIZE_NAMES = [0.0, 50.0, 200.0, 500.0, 1000.0, float("inf")], ["10_to_50", "51_to_200", "201_to_500", "501_to_1000", "greater_than_1000"]


def size_adjusted(sets: DataFrame) -> DataFrame:
    """``sets`` (term, size, mean_abs, cv) with what their size does not explain, and ranks before and after.

    per_gene, per_sqrt_gene; residual of log10 mean_abs on log10 size, fitted to sets with a mean above 0;
    size_class; weight 1 / (1 + cv), a missing cv being the median; score, their product; raw_rank,
    adjusted_rank and rank_change, equal ones alike. A row a set: its windows are as long as the collection of sets.
    """
    s = cut(sets.withColumn("_x", F.log10(F.greatest(F.col("size"), F.lit(1)).cast("double"))))
    y = F.when(F.col("mean_abs") > 0, F.log10("mean_abs"))
    fit = s.agg(F.regr_slope(y, "_x").alias("_slope"), F.regr_intercept(y, "_x").alias("_intercept"))
    middle = exact_quantiles(s, "cv", {"_cv": 0.5}).select(F.round("_cv", 9).alias("_cv"))
    s = s.crossJoin(F.broadcast(fit)).crossJoin(F.broadcast(middle))  # one row each
    s = s.withColumn("per_gene", F.col("mean_abs") / F.col("size")).withColumn("per_sqrt_gene", F.col("mean_abs") / F.sqrt("size"))
    s = s.withColumn("residual", F.round(F.log10(F.greatest(F.col("mean_abs"), F.lit(1e-15))) - (F.col("_intercept") + F.col("_slope") * F.col("_x")), 9))
    s = s.withColumn("size_class", classes(F.col("size").cast("double"), SIZES, SIZE_NAMES)).withColumn("weight", F.round(1 / (1 + F.coalesce("cv", "_cv")), 9))
    s = s.withColumn("score", F.round(F.col("residual") * F.col("weight"), 9))
    s = s.withColumn("raw_rank", min_rank([], F.desc("mean_abs"))).withColumn("adjusted_rank", min_rank([], F.desc("score")))
    return s.withColumn("rank_change", F.col("adjusted_rank") - F.col("raw_rank")).drop("_x", "_slope", "_intercept", "_cv")
