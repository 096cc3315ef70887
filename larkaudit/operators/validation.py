"""Tests of measures between the groups of states that do not come from them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkaudit.functions.lineage import cut
from larkaudit.functions.provenance import require_independent
from larkaudit.functions.ranks import bh_fdr, effect_label
from larkaudit.operators.stats import chi2_p, kruskal, normal_p, pairwise

KEYS = ["state_variable", "metric"]
LEAST = 10


def long_states(patients: DataFrame, states: list[str], metrics: list[str]) -> DataFrame:
    """state_variable, state, metric, value for each patient, state and metric; refuses a state that shares a source with a metric."""
    require_independent(patients, states, metrics)
    s = F.explode(F.array(*[F.struct(F.lit(c).alias("state_variable"), F.col(c).cast("string").alias("state")) for c in states]))
    m = F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in metrics]))
    rows = patients.select(s.alias("_s"), *metrics).select("_s.*", m.alias("_m")).select("state_variable", "state", "_m.*")
    return rows.where("state is not null and value is not null")


def omnibus(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """Kruskal-Wallis by state variable and metric over the groups of ``least`` values or more, with their names and the corrected p over all tests."""
    rows = cut(rows)
    names = rows.groupBy(*KEYS, "state").count().where(F.col("count") >= least).groupBy(*KEYS).agg(F.array_join(F.array_sort(F.collect_list("state")), " | ").alias("groups"))
    found = kruskal(rows, KEYS, "state", "value", least).join(names, KEYS)
    return bh_fdr(found.withColumn("p_value", chi2_p(F.col("h"), F.col("n_groups") - 1)), "p_value")


def pairs(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """Mann-Whitney of each pair of groups, with means, their difference, effect size and the p corrected within state variable and metric."""
    rows = cut(rows)
    means = cut(rows.groupBy(*KEYS, "state").agg(F.avg("value").alias("_m")))
    found = pairwise(rows, KEYS, "state", "value", least)
    for side in ("group_1", "group_2"):
        found = found.join(means.withColumnRenamed("state", side).withColumnRenamed("_m", f"mean_{side}"), [*KEYS, side])
    found = found.withColumn("mean_difference", F.col("mean_group_1") - F.col("mean_group_2")).withColumn("effect_size", effect_label(F.col("cliffs_delta")))
    return bh_fdr(found.withColumn("p_value", normal_p(F.col("z"))), "p_value", KEYS)
