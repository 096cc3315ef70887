"""Summaries over repeats and folds, candidate and priority scores, and scores of whole target pools."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkaudit.functions.lineage import cut as cut_lineage
from larkaudit.functions.lineage import written
from larkaudit.functions.quantiles import exact_quantiles
from larkaudit.functions.ranks import cut, first_rank, minmax, rank_pct, tiers
from larkaudit.operators.relational import describe
from larkaudit.operators.scores import ATTRIBUTION, CORE, PERCENTILE, SPECIFIC, SUPPORT

#: Least share of repeats, of folds, and of values of one sign, of a target that takes part. Fixed values.
LEAST_SUPPORT = {"repeat_support": 0.4, "fold_frequency": 0.2, "sign_support": 0.6}


def r9(c: Column) -> Column:
    """Rounded to nine places, so that equal values stay equal in every order of summation."""
    return F.round(c, 9)


def long_metrics(df: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """keys, metric, value: a row for each of the metrics."""
    cells = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return df.select(*keys, F.explode(cells).alias("_m")).select(*keys, "_m.metric", "_m.value")


def spread(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """n, mean, sd, median, least, most, q025 and q975 by keys, null keys kept."""
    return describe(df, keys, value, {"q025": 0.025, "q975": 0.975}).drop("q25", "q75")


def over_repeats(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Mean and sd over repeats of each measure, and the number of repeats."""
    aggs = [f(c).alias(f"{name}_{c}") for c in measures for name, f in (("mean", F.avg), ("sd", F.stddev_samp))]
    return df.groupBy(*keys).agg(F.count("*").alias("n_repeats"), *aggs)


def top_items(df: DataFrame, unit: list[str], item: str, value: str, k: int) -> DataFrame:
    """The k items of each unit with the largest absolute values, with their rank."""
    return df.withColumn("rank", first_rank(unit, F.desc(r9(F.abs(value))), F.asc(item))).where(F.col("rank") <= k)


def item_stability(top: DataFrame, keys: list[str], value: str, repeats: int) -> DataFrame:
    """How often and how strongly an item is among the largest: by ``keys`` over repeats."""
    return top.groupBy(*keys).agg(
        F.countDistinct("repeat_id").alias("n_repeats"), F.avg(F.abs(value)).alias("mean_abs"), r9(F.median(F.abs(value))).alias("median_abs"), F.avg(value).alias("mean_signed"),
        F.median("rank").alias("median_rank"), F.avg(F.when(F.col(value) > 0, 1.0).otherwise(0.0)).alias("frac_positive"), (F.countDistinct("repeat_id") / repeats).alias("frequency"),
    )


def fold_selection(attribution: DataFrame, folds: DataFrame, k: int) -> DataFrame:
    """repeat_id, fold_id, gene, importance: the k genes of largest mean absolute value in each fold."""
    by = attribution.join(folds.select("sample_id", "repeat_id", "fold_id"), ["sample_id", "repeat_id"]).groupBy("repeat_id", "fold_id", "gene").agg(r9(F.avg(F.abs("shap"))).alias("importance"))
    return by.withColumn("rank", first_rank(["repeat_id", "fold_id"], F.desc("importance"), F.asc("gene"))).where(F.col("rank") <= k)


def represented(selected: DataFrame, members: DataFrame) -> DataFrame:
    """``selected`` with in_set: whether a set holds the gene."""
    m = members.select("gene").distinct().withColumn("_m", F.lit(True))
    return selected.join(m, "gene", "left").withColumn("in_set", F.coalesce("_m", F.lit(False))).drop("_m")


def gap_summary(selected: DataFrame) -> DataFrame:
    """By fold: genes selected, those in no set, and their shares."""
    gap = F.when(F.col("in_set"), 0).otherwise(1)
    g = selected.groupBy("repeat_id", "fold_id").agg(F.count("*").alias("n_selected"), F.sum(gap).alias("n_gap"))
    return g.withColumn("n_represented", F.col("n_selected") - F.col("n_gap")).withColumn("gap_fraction", F.col("n_gap") / F.col("n_selected")).withColumn("fraction", 1 - F.col("gap_fraction"))


def directions(members: DataFrame) -> DataFrame:
    """By core: mean memberships and the shares of units on either side."""
    p, n = F.col("positive"), F.col("negative")
    return members.groupBy("core").agg(
        F.count("*").alias("n"), F.avg(p).alias("mean_positive"), F.avg(n).alias("mean_negative"), F.avg("magnitude").alias("mean_magnitude"),
        F.avg(F.when(p > n, 1.0).otherwise(0.0)).alias("frac_positive"), F.avg(F.when(n > p, 1.0).otherwise(0.0)).alias("frac_negative"),
    )


def portability(a_threshold: Column, b_threshold: Column, near: float = 0.05) -> Column:
    """State of a sample (y, a_p, b_p) under two models, each with its own threshold; ambiguous where both are within ``near`` of theirs."""
    sides = [(F.col("a_p"), a_threshold), (F.col("b_p"), b_threshold)]
    first, second = (F.when(p >= at, 1).otherwise(0) for p, at in sides)
    close = [F.round(F.abs(p - at), 9) <= near for p, at in sides]
    return (
        F.when(first != second, "model_dependent").when(close[0] & close[1], "intermediate_ambiguous").when((F.col("y") == 0) & (first == 1), "clinical_early_molecular_advanced_like")
        .when((F.col("y") == 1) & (first == 0), "clinical_advanced_molecular_early_like").otherwise("clinical_molecular_concordant")
    )


def candidate_scores(units: DataFrame) -> DataFrame:
    """Score and tier of residual candidates: ranks, weighted .25 unmapped mass, .2 low coverage, .2 sign consistency, .15 sd of the residual, .2 dependence.

    ``units``: unit, unmapped, coverage, sign_consistency, residual_sd, dependence. Low coverage is one
    minus the rank of coverage. A tier's bins are closed on the right, so a score has to exceed its quantile.
    """
    u = units
    for c in ("unmapped", "coverage", "sign_consistency", "residual_sd", "dependence"):
        u = rank_pct(u, c, name=f"_p{c}")
    score = 0.25 * F.col("_punmapped") + 0.2 * (1 - F.col("_pcoverage")) + 0.2 * F.col("_psign_consistency") + 0.15 * F.col("_presidual_sd") + 0.2 * F.col("_pdependence")
    u = u.withColumn("score", r9(score))
    u = cut_lineage(u)
    q = exact_quantiles(u, "score", {"_q75": 0.75, "_q90": 0.9}).select(*[r9(F.col(c)).alias(c) for c in ("_q75", "_q90")])
    u = u.crossJoin(F.broadcast(q)).withColumn("tier", tiers(F.col("score"), F.col("_q75"), F.col("_q90"), strict=True))  # one row
    return u.drop("_punmapped", "_pcoverage", "_psign_consistency", "_presidual_sd", "_pdependence", "_q75", "_q90")


def residual_priority(units: DataFrame) -> DataFrame:
    """Half the rank of size and half that of instability; then .7 of that and .3 of the flags over the most flags."""
    u = rank_pct(rank_pct(units, "size", name="_s"), "instability", name="_i")
    u = u.withColumn("score", r9(0.5 * F.col("_s") + 0.5 * F.col("_i")))
    most = units.agg(F.greatest(F.max("n_flags"), F.lit(1)).alias("_most"))
    return u.crossJoin(F.broadcast(most)).withColumn("priority", r9(0.7 * F.col("score") + 0.3 * F.col("n_flags") / F.col("_most"))).drop("_s", "_i", "_most")  # one row


def fuzzy_priority(units: DataFrame) -> DataFrame:
    """.4 of the largest membership, .25 of inconsistency, .2 and .15 of the ranks of the null priority and of uncertainty."""
    u = rank_pct(rank_pct(units, "null_priority", name="_pn"), "uncertainty", name="_pu")
    return u.withColumn("priority", r9(0.4 * F.col("most") + 0.25 * (1 - F.col("consistency")) + 0.2 * F.col("_pn") + 0.15 * F.col("_pu"))).drop("_pn", "_pu")


def null_priority(units: DataFrame) -> DataFrame:
    """.4 of the rank of the absolute residual excess, .3 of that of the coverage's shortfall to the null, .3 of that of the top excess."""
    u = units.withColumn("_a", F.abs("residual_excess")).withColumn("_c", -F.col("coverage_excess"))
    for c in ("_a", "_c", "top_excess"):
        u = rank_pct(u, c, name=f"_p{c}")
    return u.withColumn("priority", r9(0.4 * F.col("_p_a") + 0.3 * F.col("_p_c") + 0.3 * F.col("_ptop_excess"))).drop("_a", "_c", "_p_a", "_p_c", "_ptop_excess")


def pool_scores(pool: DataFrame, k: int = 20) -> DataFrame:
    """Scores of the supported targets of every patient in two passes.

    ``pool``: patient_id, gene, core, size (of the patient's attribution), repeat_support, fold_frequency,
    sign_support, margin (of the gene's consensus). Targets below LEAST_SUPPORT take no part, but their
    patients count. The first pass weighs the scaled size, its rank within the patient, support and scaled
    margin, renormalised; how many patients' first k hold a gene gives its frequency, class and specificity, which the second pass adds.
    """
    pool = written(pool)
    p = pool.where(" and ".join(f"{c} >= {v}" for c, v in LEAST_SUPPORT.items()))
    # Ranked in windows of the patient's own rows, for which one shuffle does.
    mine, alike = Window.partitionBy("patient_id"), Window.partitionBy("patient_id", "size")
    rank = F.rank().over(mine.orderBy(F.col("size").asc_nulls_last())) + (F.count("*").over(alike) - 1) / 2
    p = p.withColumn("scaled", minmax("size", ["patient_id"])).withColumn("size_pct", F.when(F.col("size").isNotNull(), rank / F.count("size").over(mine)))
    support = 0.5 * F.col("repeat_support") + 0.25 * F.col("sign_support") + 0.25 * F.col("fold_frequency")
    low, high = p.agg(F.min("margin"), F.max("margin")).first()
    core = F.lit(0.5) if low is None or high <= low else (F.col("margin") - low) / (high - low)
    first = ATTRIBUTION * F.col("scaled") + PERCENTILE * F.col("size_pct") + SUPPORT * support + CORE * core
    p = written(p.withColumn("_f", first).withColumn("first_score", r9(F.col("_f") / (ATTRIBUTION + PERCENTILE + SUPPORT + CORE))))
    top = p.withColumn("_k", first_rank(["patient_id"], F.desc("first_score"), F.asc("gene"))).where(F.col("_k") <= k)
    n = pool.agg(F.countDistinct("patient_id").alias("_n"))
    f = p.select("gene").distinct().join(top.groupBy("gene").agg(F.count("*").alias("n_top")), "gene", "left").withColumn("n_top", F.coalesce("n_top", F.lit(0)))
    f = f.crossJoin(F.broadcast(n)).withColumn("frequency", F.col("n_top") / F.col("_n")).withColumn("idf", r9(F.log((1.0 + F.col("_n")) / (1.0 + F.col("n_top"))) + 1))  # one row
    f = cut_lineage(f)
    lim = f.agg(F.min("idf").alias("_lo"), F.max("idf").alias("_hi"))
    idf01 = F.when(F.col("_hi") <= F.col("_lo"), 0.5).otherwise((F.col("idf") - F.col("_lo")) / F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0)))
    kind = F.when(F.col("frequency") >= 0.25, "generic").when(F.col("frequency") >= 0.1, "recurrent").otherwise("specific")
    f = f.crossJoin(F.broadcast(lim)).select("gene", "n_top", "frequency", idf01.alias("idf01"), kind.alias("class"))  # one row
    return p.join(f, "gene").withColumn("score", r9(F.col("_f") + SPECIFIC * F.col("idf01"))).drop("_f")


def patient_targets(layered: DataFrame, patients: DataFrame) -> DataFrame:
    """By patient, of the targets of all layers: counts by class, means, the core that most belong to, shares, specificity and its tier.

    ``layered``: patient_id, gene, core, class, score, idf01. Specificity weighs the share of specific
    targets, the mean idf and the share of targets that are not generic. ``patients`` without targets have counts of 0 and nulls.
    """
    count = lambda c: F.sum(F.when(F.col("class") == c, 1).otherwise(0))
    g = layered.groupBy("patient_id").agg(
        F.count("*").alias("n_targets"), *[count(c).alias(f"n_{c}") for c in ("generic", "recurrent", "specific")], F.avg("score").alias("mean_score"), F.max("score").alias("most_score"),
        F.avg("idf01").alias("mean_idf"),
    )
    cores = layered.groupBy("patient_id", "core").agg(F.count("*").alias("_c"))
    cores = cores.withColumn("_r", first_rank(["patient_id"], F.desc("_c"), F.asc("core"))).where("_r = 1").select("patient_id", F.col("core").alias("dominant_core"))
    g = g.join(cores, "patient_id").withColumn("specific_fraction", F.col("n_specific") / F.col("n_targets")).withColumn("generic_fraction", F.col("n_generic") / F.col("n_targets"))
    g = g.withColumn("specificity", r9(0.5 * F.col("specific_fraction") + 0.3 * F.col("mean_idf") + 0.2 * (1 - F.col("generic_fraction"))))
    g = g.withColumn("tier", cut(F.col("specificity"), [0.0, 0.35, 0.6, 2.0], ["low", "moderate", "high"]))
    return patients.select("patient_id").distinct().join(g, "patient_id", "left").na.fill(0, ["n_targets", "n_generic", "n_recurrent", "n_specific"])
