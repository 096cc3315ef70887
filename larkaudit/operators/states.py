"""States of patients: model disagreement, taxonomy, fuzzy memberships, anchors and borders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkaudit.functions.lineage import cut as cut_lineage
from larkaudit.functions.quantiles import exact_quantiles
from larkaudit.functions.ranks import cut, first_rank, rank_pct, tiers


def patient_summary(oof: DataFrame) -> DataFrame:
    """By model and sample: mean, median, sd, least and most p, shares predicted advanced and correct, n."""
    hit = F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0)
    return oof.groupBy("model", "sample_id", "y").agg(
        F.avg("p").alias("mean_p"), F.median("p").alias("median_p"), F.stddev_samp("p").alias("sd_p"), F.min("p").alias("min_p"), F.max("p").alias("max_p"),
        F.avg(hit).alias("frac_advanced"), F.avg(F.when(hit == F.col("y"), 1.0).otherwise(0.0)).alias("frac_correct"), F.count("*").alias("n"),
    )


def uncertainty(summary: DataFrame) -> DataFrame:
    """Adds label, margin, border uncertainty and prediction state."""
    s = summary.withColumn("label", F.when(F.col("mean_p") >= 0.5, 1).otherwise(0)).withColumn("margin", F.abs(F.col("mean_p") - 0.5))
    s = s.withColumn("uncertainty", F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - 2 * F.col("margin"))))
    name = F.concat(F.when(F.col("y") == 1, "advanced").otherwise("early"), F.when(F.col("y") == F.col("label"), "_correct").otherwise("_wrong"))
    return s.withColumn("state", name)


def disagreement(summary: DataFrame) -> DataFrame:
    """One row a sample: both models' means, sds, difference and who is right."""
    w = summary.groupBy("sample_id", "y").pivot("model", ["a", "b"]).agg(F.first("mean_p").alias("p"), F.first("sd_p").alias("sd"))
    ca = F.when(F.col("a_p") >= 0.5, 1).otherwise(0) == F.col("y")
    cb = F.when(F.col("b_p") >= 0.5, 1).otherwise(0) == F.col("y")
    state = F.when(ca & cb, "both_correct").when(~ca & ~cb, "both_wrong").when(ca, "only_a").otherwise("only_b")
    labels = (F.col("a_p") >= 0.5) != (F.col("b_p") >= 0.5)
    return w.withColumn("difference", F.col("a_p") - F.col("b_p")).withColumn("abs_difference", F.abs(F.col("a_p") - F.col("b_p"))).withColumn("labels_differ", labels).withColumn("cross_model_state", state)


def taxonomy(d: DataFrame, near: float = 0.05) -> DataFrame:
    """Percentiles, rank state, tiers, integrated state and number of flags of each sample of ``disagreement``."""
    d = rank_pct(rank_pct(d, "a_p", name="a_pct"), "b_p", name="b_pct")
    d = d.withColumn("mean_pct", (F.col("a_pct") + F.col("b_pct")) / 2).withColumn("instability", F.greatest("a_sd", "b_sd"))
    d = cut_lineage(d)
    for c in ("abs_difference", "instability"):
        d = d.crossJoin(F.broadcast(exact_quantiles(d, c, {f"q75_{c}": 0.75, f"q90_{c}": 0.9})))  # one row
    d = d.withColumn("rank_state", cut(F.col("mean_pct"), [0.0, 0.25, 0.75, 1.0], ["early_like", "intermediate", "advanced_like"]))
    d = d.withColumn("dependence", tiers(F.col("abs_difference"), F.col("q75_abs_difference"), F.col("q90_abs_difference")))
    d = d.withColumn("instability_tier", tiers(F.col("instability"), F.col("q75_instability"), F.col("q90_instability")))
    d = d.withColumn("direction", F.when(F.col("difference") > near, "a_higher").when(F.col("difference") < -near, "b_higher").otherwise("agree"))
    early, advanced = F.col("rank_state") == "early_like", F.col("rank_state") == "advanced_like"
    state = (
        F.when(F.col("dependence") == "high", "model_dependent").when(F.col("instability_tier") == "high", "resampling_unstable")
        .when((F.col("y") == 0) & advanced, "early_discordant").when((F.col("y") == 1) & early, "advanced_discordant")
        .when(((F.col("y") == 0) & early) | ((F.col("y") == 1) & advanced), "concordant").otherwise("intermediate_ambiguous")
    )
    flag = lambda c: F.when(c, 1).otherwise(0)
    flags = flag(F.col("dependence") == "high") + flag(F.col("instability_tier") == "high") + flag(((F.col("y") == 0) & advanced) | ((F.col("y") == 1) & early))
    return d.withColumn("integrated_state", state).withColumn("n_flags", flags).drop("q75_abs_difference", "q90_abs_difference", "q75_instability", "q90_instability")


def residual_state(signs: DataFrame, zero: float = 0.01, stable: float = 0.8) -> Column:
    return (
        F.when(F.abs("mean") <= zero, "near_zero").when(F.col("frac_pos") >= stable, "stable_toward_advanced").when(F.col("frac_neg") >= stable, "stable_toward_early").otherwise("mixed")
    )


def fuzzy_memberships(core: DataFrame) -> DataFrame:
    """Adds by repeat and core: the value centred on the median, its positive and negative membership and its magnitude's."""
    keys = ["repeat_id", "core"]
    core = cut_lineage(core)
    middle = exact_quantiles(core, "signed", {"_m": 0.5}, keys)
    c = core.join(middle, keys).withColumn("centred", F.round(F.col("signed") - F.col("_m"), 9)).withColumn("_abs", F.abs("centred")).drop("_m")
    c = rank_pct(rank_pct(c, "centred", keys, "positive"), "_abs", keys, "magnitude")
    return c.withColumn("negative", 1 - F.col("positive")).drop("_abs")


def fuzzy_states(members: DataFrame, keys: list[str], member: str = "positive", high: float = 0.75, low: float = 0.25, margin: float = 0.15) -> DataFrame:
    """One state for the cores of each unit: shared_high, dominant, shared_low or blended_intermediate."""
    best = Window.partitionBy(*keys).orderBy(F.desc(member), "core")
    m = members.withColumn("_k", F.row_number().over(best))
    g = m.groupBy(*keys).agg(
        F.sum(F.when(F.col(member) >= high, 1).otherwise(0)).alias("n_high"), F.max(member).alias("most"), F.max(F.when(F.col("_k") == 2, F.col(member))).alias("second"),
        F.max(F.when(F.col("_k") == 1, F.col("core"))).alias("_top"), F.array_join(F.array_sort(F.collect_list(F.when(F.col(member) >= high, F.col("core")))), "__").alias("_names"),
    )
    state = (
        F.when(F.col("n_high") >= 2, F.concat(F.lit("shared_high__"), "_names"))
        .when((F.col("n_high") == 1) & (F.col("most") - F.coalesce("second", F.lit(0.0)) >= margin), F.concat(F.lit("dominant__"), "_top"))
        .when(F.col("most") <= low, "shared_low")
        .otherwise("blended_intermediate")
    )
    return g.withColumn("state", state).drop("_top", "_names")


def repeat_consistency(states: DataFrame, key: str) -> DataFrame:
    """Modal state of each unit over repeats, ties by name, its share and a tier."""
    n = states.groupBy(key, "state").agg(F.count("*").alias("_n"))
    g = n.withColumn("_k", first_rank([key], F.desc("_n"), F.asc("state"))).groupBy(key).agg(
        F.count("*").alias("n_states"), F.max(F.when(F.col("_k") == 1, F.col("state"))).alias("modal_state"), F.max(F.col("_n") * 1.0).alias("_m"), F.sum("_n").alias("n_repeats")
    )
    g = g.withColumn("consistency", (F.col("_m") / F.col("n_repeats")).cast("double")).drop("_m")
    return g.withColumn("tier", F.when(F.col("consistency") >= 0.8, "stable").when(F.col("consistency") >= 0.6, "moderately_stable").otherwise("unstable"))


def anchors(members: DataFrame, consistency: DataFrame, reliability: DataFrame, k: int = 25) -> DataFrame:
    """By core the k patients that stand for it: membership of 0.75 or more, consistency of 0.6, uncertainty of 0.15 at most, above all other cores.

    ``members`` patient_id, core, magnitude by repeat; ``consistency`` patient_id, consistency;
    ``reliability`` core, mean_rho. Score: .35 membership, .25 consistency, .2 certainty, .15 margin, .05 reliability over the largest.
    """
    m = members.groupBy("patient_id", "core").agg(F.round(F.avg("magnitude"), 9).alias("membership"), F.round(F.coalesce(F.stddev_samp("magnitude"), F.lit(0.0)), 9).alias("sd"))
    best = Window.partitionBy("patient_id").orderBy(F.desc("membership"), "core")
    m = m.withColumn("_k", F.row_number().over(best)).withColumn("_next", F.max(F.when(F.col("_k") == 2, F.col("membership"))).over(Window.partitionBy("patient_id")))
    m = m.where("_k = 1").withColumn("dominance", F.round(F.col("membership") - F.coalesce("_next", F.lit(0.0)), 9))
    most = reliability.agg(F.max("mean_rho").alias("_most"))
    r = reliability.crossJoin(F.broadcast(most)).select("core", F.coalesce(F.try_divide("mean_rho", "_most"), F.lit(0.0)).alias("_r"))  # one row
    m = m.join(consistency.select("patient_id", "consistency"), "patient_id").join(r, "core").where("membership >= 0.75 and consistency >= 0.6 and sd <= 0.15 and dominance > 0")
    score = 0.35 * F.col("membership") + 0.25 * F.col("consistency") + 0.2 * (1 - F.col("sd")) + 0.15 * F.greatest("dominance", F.lit(0.0)) + 0.05 * F.col("_r")
    m = m.withColumn("score", F.round(score, 9))
    return m.withColumn("rank", first_rank(["core"], F.desc("score"), F.asc("patient_id"))).where(F.col("rank") <= k).select("patient_id", "core", "membership", "dominance", "score", "rank")


def border_scores(patients: DataFrame, k: int = 100) -> DataFrame:
    """The k patients that an audit should look at first.

    ``patients``: patient_id, discordant, dependent, unstable (0/1), uncertainty (of core memberships),
    consistency (over repeats) and null_gap (the null-corrected priority). Score: .25, .15 and .15 for the flags,
    .2 for the rank of uncertainty, .15 for inconsistency, .1 for the rank of the gap; equal ones by gap, then uncertainty.
    """
    p = rank_pct(rank_pct(patients, "uncertainty", name="uncertainty_pct"), "null_gap", name="null_pct")
    score = 0.25 * F.col("discordant") + 0.15 * F.col("dependent") + 0.15 * F.col("unstable") + 0.2 * F.col("uncertainty_pct") + 0.15 * (1 - F.col("consistency")) + 0.1 * F.col("null_pct")
    return p.withColumn("score", F.round(score, 9)).orderBy(F.desc("score"), F.desc("null_gap"), F.desc("uncertainty"), "patient_id").limit(k)


def recommendation_confidence(consistency: Column, uncertainty: Column, core_priority: Column, n_targets: Column, most: int = 20) -> tuple[Column, Column]:
    """Confidence from state consistency, certainty, core priority and number of targets, and its class."""
    c = 0.3 * consistency + 0.25 * (1 - uncertainty) + 0.25 * core_priority + 0.2 * F.least(n_targets, F.lit(most)) / most
    return c, F.when(c.isNull(), None).when(c <= 0.55, "low").when(c <= 0.7, "moderate").otherwise("high")
