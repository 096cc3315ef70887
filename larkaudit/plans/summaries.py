"""Queries of summaries, candidate scores, target pools and audits of records, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkaudit.functions import permute
from larkaudit.operators import attribution as at
from larkaudit.operators import metrics, scores
from larkaudit.operators import summaries as su
from larkaudit.plans import catalog as c
from larkaudit.plans import facts
from larkaudit.plans.catalog import query, r6, t

SPREAD = """count(value) as n, round(avg(value), 6) + 0.0 as mean, round(stddev_samp(value), 6) as sd, round(round(median(value), 9), 6) + 0.0 as median, round(min(value), 6) + 0.0 as least, round(max(value), 6) + 0.0 as most,
       round(round(quantile_cont(value, 0.025), 9), 6) + 0.0 as q025, round(round(quantile_cont(value, 0.975), 9), 6) + 0.0 as q975"""


def n6(df):
    """As ``r6``, halves at the sixth place upwards on both sides: a tenth of a billionth is added first."""
    return r6(df.select(*[(F.col(x) + 1e-10).alias(x) if kind == "double" else F.col(x) for x, kind in df.dtypes]))


@query("""with """ + c._at("model, repeat_id, fold_id", "oof", "0.5") + """, br as (select model, repeat_id, fold_id, avg((p - y) * (p - y)) as brier from oof group by all),
       w as (select model, round(recall, 9) as recall, round(specificity, 9) as specificity, round(accuracy, 9) as accuracy, round(brier, 9) as brier from rates join br using (model, repeat_id, fold_id)),
       l as (select model, 'recall' as metric, recall as value from w union all select model, 'specificity', specificity from w union all select model, 'accuracy', accuracy from w union all select model, 'brier', brier from w)
       select model, metric, """ + SPREAD + " from l group by all")
def fold_metric_summary(spark, d):
    """Measures of each fold, summed up by model."""
    keys, measures = ["model", "repeat_id", "fold_id"], ["recall", "specificity", "accuracy", "brier"]
    o = facts.oof(spark, d)
    by = metrics.at_threshold(o.withColumn("threshold", F.lit(0.5)), keys).join(metrics.losses(o, keys), keys)
    return r6(su.spread(su.long_metrics(by.select("model", *[su.r9(F.col(m)).alias(m) for m in measures]), ["model"], measures), ["model", "metric"], "value"))


COVER = """mp as (select distinct gene from memberships), cover as (select sample_id, repeat_id, round(sum(case when gene in (select gene from mp) then abs(shap) else 0 end) / sum(abs(shap)), 9) as coverage,
       round(sum(case when gene in (select gene from mp) then 0 else shap end), 9) as residual, round(sum(shap), 9) as total from attribution group by all)"""


def _cover(spark, d):
    u = at.completeness(facts.attribution(spark, d), at.edges(facts.memberships(spark)))
    return u.select("sample_id", "repeat_id", *[su.r9(F.col(x)).alias(x) for x in ("coverage", "residual", "total")])


@query("with " + COVER + """ select sample_id, count(*) as n_repeats, round(avg(coverage), 6) as mean_coverage, round(stddev_samp(coverage), 6) as sd_coverage, round(avg(residual), 6) + 0.0 as mean_residual,
       round(stddev_samp(residual), 6) as sd_residual, round(avg(total), 6) + 0.0 as mean_total, round(stddev_samp(total), 6) as sd_total, round(max(abs(residual)), 6) as max_abs_residual from cover group by sample_id""")
def patient_completeness(spark, d):
    u = _cover(spark, d)
    most = u.groupBy("sample_id").agg(F.max(F.abs("residual")).alias("max_abs_residual"))
    return r6(su.over_repeats(u, ["sample_id"], ["coverage", "residual", "total"]).join(most, "sample_id"))


@query("with " + COVER + """ select sample_id, count(*) as n, round(avg(residual), 6) + 0.0 as mean, round(stddev_samp(residual), 6) as sd, round(round(median(residual), 9), 6) + 0.0 as median, round(min(residual), 6) + 0.0 as least, round(max(residual), 6) + 0.0 as most,
       round(avg(case when residual > 0 then 1.0 else 0.0 end), 6) as frac_positive, round(avg(case when residual < 0 then 1.0 else 0.0 end), 6) as frac_negative, cast(max(ch) as integer) as sign_changes from
       (select *, coalesce((select sum(case when s <> b then 1 else 0 end) from (select sign(residual) as s, lag(sign(residual)) over (order by repeat_id) as b from cover i where i.sample_id = o.sample_id and residual <> 0)), 0) as ch from cover o) group by sample_id""")
def patient_residuals(spark, d):
    from larkaudit.functions import ranks

    u = _cover(spark, d)
    g = u.groupBy("sample_id").agg(
        F.count("*").alias("n"), F.avg("residual").alias("mean"), F.stddev_samp("residual").alias("sd"), su.r9(F.median("residual")).alias("median"), F.min("residual").alias("least"), F.max("residual").alias("most"),
        F.avg(F.when(F.col("residual") > 0, 1.0).otherwise(0.0)).alias("frac_positive"), F.avg(F.when(F.col("residual") < 0, 1.0).otherwise(0.0)).alias("frac_negative"),
    )
    return r6(g.join(ranks.sign_changes(u, "residual", ["sample_id"], "repeat_id"), "sample_id").withColumn("sign_changes", F.col("sign_changes").cast("int")))


TERMS = """wt as (select term, gene, 1.0::double / count(*) over (partition by gene) as weight from memberships),
       terms as (select sample_id, repeat_id, term, round(sum(shap * weight), 9) as term_shap from attribution join wt using (gene) group by all)"""


def _terms(spark, d):
    a = at.allocate(facts.attribution(spark, d), at.edges(facts.memberships(spark)))
    return a.withColumn("term_shap", su.r9(F.col("term_shap")))


@query("with " + TERMS + """, per as (select term, repeat_id, avg(abs(term_shap)) as a, avg(term_shap) as s from terms group by all)
       select term, count(*) as n_folds, round(avg(a), 6) as mean_abs, round(round(median(a), 9), 6) as median_abs, round(stddev_samp(a), 6) as sd_abs, round(avg(s), 6) + 0.0 as mean_signed, round(count(*) / 5.0::double, 6) as frequency,
       round(stddev_samp(a) / avg(a), 6) as cv from per group by term""")
def global_set_stability(spark, d):
    return r6(at.stability(_terms(spark, d), "term", "term_shap", "repeat_id", 5).withColumn("median_abs", su.r9(F.col("median_abs"))))


ITEM = """count(distinct repeat_id) as n_repeats, round(avg(abs({v})) + 1e-10, 6) as mean_abs, round(round(median(abs({v})), 9) + 1e-10, 6) as median_abs, round(avg({v}) + 1e-10, 6) + 0.0 as mean_signed, round(median(rank), 6) as median_rank,
       round(avg(case when {v} > 0 then 1.0 else 0.0 end), 6) as frac_positive, round(count(distinct repeat_id) / 5.0::double, 6) as frequency"""


@query("with " + TERMS + """, k as (select *, row_number() over (partition by sample_id, repeat_id order by abs(term_shap) desc, term) as rank from terms)
       select sample_id, term, """ + ITEM.format(v="term_shap") + " from k where rank <= 5 group by all")
def patient_set_stability(spark, d):
    """Sets among the five largest of a patient, over repeats."""
    top = su.top_items(_terms(spark, d), at.UNIT, "term", "term_shap", 5)
    return n6(su.item_stability(top, ["sample_id", "term"], "term_shap", 5))


@query("""with k as (select sample_id, repeat_id, gene, round(shap, 9) as shap from attribution where gene not in (select gene from memberships)), r as (select *, row_number() over (partition by sample_id, repeat_id order by abs(shap) desc, gene) as rank from k),
       g as (select sample_id, gene, """ + ITEM.format(v="shap") + """, avg(abs(shap)) * count(distinct repeat_id) / 5.0::double as pl, greatest(avg(case when shap > 0 then 1.0 else 0.0 end), avg(case when shap < 0 then 1.0 else 0.0 end)) as sc from r where rank <= 10 group by all)
       select * exclude (pl, sc), round(pl + 1e-10, 6) as pipeline, n_repeats >= 2 and sc >= 0.8 as stable from g""")
def patient_gap_stability(spark, d):
    """Genes of no set among the ten largest of a patient, over repeats; stable from two repeats and four fifths of one sign on."""
    gap = facts.attribution(spark, d).join(facts.memberships(spark).select("gene").distinct(), "gene", "left_anti").withColumn("shap", su.r9(F.col("shap")))
    top = su.top_items(gap, at.UNIT, "gene", "shap", 10)
    g = su.item_stability(top, ["sample_id", "gene"], "shap", 5).join(at.signs(top, ["sample_id", "gene"], "shap").select("sample_id", "gene", "sign_consistency"), ["sample_id", "gene"])
    stable = (F.col("n_repeats") >= 2) & (F.col("sign_consistency") >= 0.8)
    return n6(g.withColumn("pipeline", F.col("mean_abs") * F.col("frequency")).withColumn("stable", stable).drop("sign_consistency"))


@query(c.TAXONOMY + """, w as (select rank_state, a_p, b_p, ad, ins from taxonomy), l as (select rank_state, 'a_p' as metric, a_p as value from w union all select rank_state, 'b_p', b_p from w union all select rank_state, 'abs_difference', ad from w union all select rank_state, 'instability', ins from w)
       select rank_state, metric, """ + SPREAD + " from l group by all")
def metrics_by_state(spark, d):
    measures = ["a_p", "b_p", "abs_difference", "instability"]
    return r6(su.spread(su.long_metrics(c._taxonomy(spark, d), ["rank_state"], measures), ["rank_state", "metric"], "value"))


SELECTED = """imp as (select a.repeat_id, f.fold_id, gene, round(avg(abs(shap)), 9) as importance from attribution a join folds f on a.sample_id = f.sample_id and a.repeat_id = f.repeat_id group by all),
       rk as (select *, row_number() over (partition by repeat_id, fold_id order by importance desc, gene) as rank from imp), sel as (select *, gene in (select gene from memberships) as in_set from rk where rank <= 20)"""


def _selected(spark, d):
    return su.represented(su.fold_selection(facts.attribution(spark, d), facts.folds(spark, d), 20), facts.memberships(spark))


@query("with " + SELECTED + """ select repeat_id, fold_id, count(*) as n_selected, count(*) filter (where not in_set) as n_gap, count(*) filter (where in_set) as n_represented,
       round(count(*) filter (where not in_set) / count(*)::double, 6) as gap_fraction, round(count(*) filter (where in_set) / count(*)::double, 6) as fraction from sel group by all""")
def fold_gap_summary(spark, d):
    return r6(su.gap_summary(_selected(spark, d)))


@query("with " + SELECTED + " select gene, count(*) as n_folds, round(count(*) / 25.0::double, 6) as frequency from sel group by gene")
def selected_gene_frequency(spark, d):
    return r6(_selected(spark, d).groupBy("gene").agg(F.count("*").alias("n_folds"), (F.count("*") / 25.0).alias("frequency")))


@query("with " + SELECTED + " select gene, in_set, count(*) as n_folds, round(avg(importance), 6) as mean_importance, round(round(median(importance), 9), 6) as median_importance from sel where rank <= 10 group by all")
def importance_gap(spark, d):
    """Genes among the ten most important of a fold, and whether a set holds them."""
    g = _selected(spark, d).where("rank <= 10").groupBy("gene", "in_set")
    return r6(g.agg(F.count("*").alias("n_folds"), F.avg("importance").alias("mean_importance"), su.r9(F.median("importance")).alias("median_importance")))


MODULES = """mods as (select sample_id, repeat_id, gene % 5 as module, round(sum(shap), 9) as signed, round(sum(abs(shap)), 9) as absolute from attribution where gene not in (select gene from memberships) group by all)"""


def _modules(spark, d):
    gap = facts.attribution(spark, d).join(facts.memberships(spark).select("gene").distinct(), "gene", "left_anti")
    return gap.groupBy("sample_id", "repeat_id", (F.col("gene") % 5).alias("module")).agg(su.r9(F.sum("shap")).alias("signed"), su.r9(F.sum(F.abs("shap"))).alias("absolute"))


@query("with " + MODULES + " select sample_id, repeat_id, module, round(signed, 6) + 0.0 as signed, round(absolute, 6) as absolute from mods")
def patient_module_sums(spark, d):
    return r6(_modules(spark, d))


@query("with " + MODULES + """ select module, count(*) as n, round(avg(signed), 6) + 0.0 as mean_signed, round(round(median(signed), 9), 6) + 0.0 as median_signed, round(avg(absolute), 6) as mean_abs, round(avg(case when signed > 0 then 1.0 else 0.0 end), 6) as frac_positive from mods group by module""")
def module_summary(spark, d):
    g = _modules(spark, d).groupBy("module")
    return r6(g.agg(F.count("*").alias("n"), F.avg("signed").alias("mean_signed"), su.r9(F.median("signed")).alias("median_signed"), F.avg("absolute").alias("mean_abs"), F.avg(F.when(F.col("signed") > 0, 1.0).otherwise(0.0)).alias("frac_positive")))


@query("""with s as (select core, gene, count(distinct patient_id) as n from targets group by all), k as (select core, count(*) as n_genes, count(*) filter (where n >= 2) as n_eligible, avg(n) as mean_patients from s group by core)
       select core, n_genes, n_eligible, round(mean_patients, 6) as mean_patients, round(n_eligible / n_genes::double, 6) as fraction from k where n_eligible >= 5""")
def core_sizes(spark, d):
    """Genes of each core, those that several patients have, and cores with five of them."""
    s = facts.targets(spark, d).groupBy("core", "gene").agg(F.countDistinct("patient_id").alias("n"))
    k = s.groupBy("core").agg(F.count("*").alias("n_genes"), F.count(F.when(F.col("n") >= 2, 1)).alias("n_eligible"), F.avg("n").alias("mean_patients"))
    return r6(k.withColumn("fraction", F.col("n_eligible") / F.col("n_genes")).where("n_eligible >= 5"))


@query(c.FUZZY + """ select patient_id, core, count(*) as n_repeats, round(avg(round(signed, 9)), 4) + 0.0 as mean_signed, round(stddev_samp(round(signed, 9)), 4) as sd_signed, round(avg(positive), 6) as mean_positive, round(stddev_samp(positive), 6) as sd_positive,
       round(avg(magnitude), 6) as mean_magnitude, round(stddev_samp(magnitude), 6) as sd_magnitude from fuzzy group by all""")
def patient_core_summary(spark, d):
    s = su.over_repeats(c._fuzzy(spark, d), ["patient_id", "core"], ["signed", "positive", "magnitude"])
    return r6(s.withColumn("mean_signed", F.round("mean_signed", 4)).withColumn("sd_signed", F.round("sd_signed", 4)))


@query(c.FUZZY + c.RELIABLE + " select core, count(*) as n, round(avg(round(rho, 6)) + 1e-10, 6) + 0.0 as mean_rho, round(round(median(round(rho, 6)), 9) + 1e-10, 6) + 0.0 as median_rho, round(min(rho), 6) + 0.0 as min_rho, round(max(rho), 6) + 0.0 as max_rho from rho group by core")
def core_reliability(spark, d):
    g = c.repeat_reliability(spark, d).groupBy("core")
    return n6(g.agg(F.count("*").alias("n"), F.avg("rho").alias("mean_rho"), su.r9(F.median("rho")).alias("median_rho"), F.min("rho").alias("min_rho"), F.max("rho").alias("max_rho")))


@query(c.STATES + """, n as (select patient_id, state, count(*) as n from fstate group by all), md as (select *, row_number() over (partition by patient_id order by n desc, state) as k, sum(n) over (partition by patient_id) as t from n), x as (select state, n / t::double as cs from md where k = 1)
       select state as modal_state, count(*) as n, round(avg(cs), 6) as mean_consistency, round(median(cs), 6) as median_consistency, round(avg(case when cs >= 0.8 then 1.0 else 0.0 end), 6) as frac_stable, round(avg(case when cs < 0.6 then 1.0 else 0.0 end), 6) as frac_unstable from x group by state""")
def consistency_by_state(spark, d):
    g = c.repeat_consistency(spark, d).groupBy("modal_state")
    is_tier = lambda x: F.avg(F.when(F.col("tier") == x, 1.0).otherwise(0.0))
    return r6(g.agg(F.count("*").alias("n"), F.avg("consistency").alias("mean_consistency"), F.median("consistency").alias("median_consistency"), is_tier("stable").alias("frac_stable"), is_tier("unstable").alias("frac_unstable")))


@query(c.FUZZY + """ select core, count(*) as n, round(avg(positive), 6) as mean_positive, round(avg(1 - positive), 6) as mean_negative, round(avg(magnitude), 6) as mean_magnitude, round(avg(case when round(positive, 9) > round(1 - positive, 9) then 1.0 else 0.0 end), 6) as frac_positive,
       round(avg(case when round(1 - positive, 9) > round(positive, 9) then 1.0 else 0.0 end), 6) as frac_negative from fuzzy group by core""")
def core_directions(spark, d):
    f = c._fuzzy(spark, d)
    return r6(su.directions(f.withColumn("positive", su.r9(F.col("positive"))).withColumn("negative", su.r9(F.col("negative")))))


# --- records -------------------------------------------------------------------------------------


@query("""with r as (select l_orderkey, case when count(*) filter (where l_linestatus <> 'F') = 0 then 'F' when count(*) filter (where l_linestatus <> 'O') = 0 then 'O' else 'P' end as rebuilt from lineitem group by all)
       select o_orderkey, o_orderstatus as given, rebuilt from orders join r on l_orderkey = o_orderkey where o_orderstatus is distinct from rebuilt""", base=False)
def label_definition_conflicts(spark, d):
    """Orders whose status is not the one that their lines give."""
    n = lambda s: F.count(F.when(F.col("l_linestatus") != s, 1))
    r = t(spark, d, "lineitem").groupBy("l_orderkey").agg(n("F").alias("f"), n("O").alias("o"))
    r = r.select("l_orderkey", F.when(F.col("f") == 0, "F").when(F.col("o") == 0, "O").otherwise("P").alias("rebuilt"))
    both = t(spark, d, "orders").join(r, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.where(~F.col("o_orderstatus").eqNullSafe(F.col("rebuilt"))).select("o_orderkey", F.col("o_orderstatus").alias("given"), "rebuilt")


@query("select o_custkey as patient_id, count(*) as n_records, count(distinct o_orderkey) as n_ids, count(distinct o_orderstatus) as n_labels, count(*) > 1 as has_multiple from orders group by all", base=False)
def record_counts(spark, d):
    g = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("patient_id"))
    return g.agg(F.count("*").alias("n_records"), F.countDistinct("o_orderkey").alias("n_ids"), F.countDistinct("o_orderstatus").alias("n_labels"), (F.count("*") > 1).alias("has_multiple"))


@query("select l_partkey, l_suppkey, count(*) as n_occurrences from lineitem group by all having count(*) > 1", base=False)
def duplicate_ids(spark, d):
    return t(spark, d, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n_occurrences")).where("n_occurrences > 1")


@query("""with p as (select model, sample_id, count(*) as n from oof group by all) select model, cast(sum(n) as bigint) as n_rows, count(*) as n_patients, count(*) * 5 as expected_rows, count(*) filter (where n <> 5) as n_wrong, sum(n) = count(*) * 5 and count(*) filter (where n <> 5) = 0 as holds from p group by model""")
def row_count_invariants(spark, d):
    """Rows are patients times repeats, and each patient has every repeat."""
    p = facts.oof(spark, d).groupBy("model", "sample_id").agg(F.count("*").alias("n"))
    g = p.groupBy("model").agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_patients"), (F.count("*") * 5).alias("expected_rows"), F.count(F.when(F.col("n") != 5, 1)).alias("n_wrong"))
    return g.withColumn("holds", (F.col("n_rows") == F.col("expected_rows")) & (F.col("n_wrong") == 0))


@query("""with g as (select gene, count(*) as n, count(value) filter (where isfinite(value)) as n_known from features group by gene) select gene, n, n_known, n_known >= greatest(10, ceil(0.8 * n)) as supported, n_known = 0 as all_missing from g""")
def feature_support(spark, d):
    """Known values of each feature: at least ten and four fifths of all, or none."""
    known = F.col("value").isNotNull() & ~F.isnan("value") & (F.abs("value") < float("inf"))
    g = facts.features(spark, d).groupBy("gene").agg(F.count("*").alias("n"), F.count(F.when(known, 1)).alias("n_known"))
    return g.withColumn("supported", F.col("n_known") >= F.greatest(F.lit(10), F.ceil(0.8 * F.col("n")))).withColumn("all_missing", F.col("n_known") == 0)


# --- scores --------------------------------------------------------------------------------------


@query(c.RANKED + " select model, round(roc_auc, 6) as raw_auc, round(greatest(roc_auc, 1 - roc_auc), 6) as oriented_auc, roc_auc < 0.5 as flipped from auc")
def oriented_auc(spark, d):
    a = metrics.auc(facts.oof(spark, d), ["model"])
    return r6(a.select("model", F.col("roc_auc").alias("raw_auc"), F.greatest("roc_auc", 1 - F.col("roc_auc")).alias("oriented_auc"), (F.col("roc_auc") < 0.5).alias("flipped")))


@query(c.WIDE + ", swept as (select model, y, p, threshold from oof, " + c.GRID_SQL + "), " + c._at("model, threshold", "swept", "threshold") + """, bt as (select model, threshold as bar from rates qualify row_number() over (partition by model order by round((recall + specificity) / 2, 9) desc, threshold) = 1),
       two as (select max(bar) filter (where model = 'a') as ta, max(bar) filter (where model = 'b') as tb from bt)
       select sample_id, case when (a_p >= ta) <> (b_p >= tb) then 'model_dependent' when round(abs(a_p - ta), 9) <= 0.05 and round(abs(b_p - tb), 9) <= 0.05 then 'intermediate_ambiguous'
              when y = 0 and a_p >= ta then 'clinical_early_molecular_advanced_like' when y = 1 and a_p < ta then 'clinical_advanced_molecular_early_like' else 'clinical_molecular_concordant' end as state from wide, two""")
def portability_state(spark, d):
    """States by each model's own best threshold."""
    swept = metrics.threshold_sweep(facts.oof(spark, d), ["model"], c.GRID).withColumn("balanced_accuracy", F.round("balanced_accuracy", 9))
    best = metrics.best_threshold(swept, ["model"], "balanced_accuracy")
    two = best.agg(*[F.max(F.when(F.col("model") == m, F.col("threshold"))).alias(f"_{m}") for m in ("a", "b")])
    return c._wide(spark, d).crossJoin(F.broadcast(two)).select("sample_id", su.portability(F.col("_a"), F.col("_b")).alias("state"))  # one row


UNITS = c.TAXONOMY + ", " + COVER + """, res as (select sample_id, round(abs(avg(residual)), 9) as size, round(avg(residual), 9) as residual, round(avg(coverage), 9) as coverage, greatest(avg(case when residual > 0 then 1.0 else 0.0 end), avg(case when residual < 0 then 1.0 else 0.0 end)) as sign_consistency from cover group by sample_id),
       units as (select sample_id, size, residual, coverage, sign_consistency, ins as instability, ad as dependence, n_flags from res join taxonomy using (sample_id))"""
PCT = "(rank() over (order by {0}) + (count(*) over (partition by {0}) - 1) / 2.0::double) / count(*) over ()"


def _units(spark, d):
    u = _cover(spark, d)
    r = at.signs(u, ["sample_id"], "residual").select("sample_id", su.r9(F.abs("mean")).alias("size"), su.r9(F.col("mean")).alias("residual"), "sign_consistency")
    r = r.join(u.groupBy("sample_id").agg(su.r9(F.avg("coverage")).alias("coverage")), "sample_id")
    tax = c._taxonomy(spark, d).select("sample_id", "instability", F.col("abs_difference").alias("dependence"), "n_flags")
    return r.join(tax, "sample_id")


@query(UNITS + f""", um as (select sample_id, round(avg(a), 9) as unmapped from (select sample_id, repeat_id, sum(case when gene in (select gene from mp) then 0 else abs(shap) end) as a from attribution group by all) group by sample_id),
       rs as (select sample_id, round(stddev_samp(residual), 9) as residual_sd from cover group by sample_id), cu as (select * from units join um using (sample_id) join rs using (sample_id)),
       p as (select sample_id, unmapped, coverage, round(0.25 * {PCT.format("unmapped")} + 0.2 * (1 - {PCT.format("coverage")}) + 0.2 * {PCT.format("sign_consistency")} + 0.15 * {PCT.format("residual_sd")} + 0.2 * {PCT.format("dependence")}, 9) as score from cu),
       qq as (select round(quantile_cont(score, 0.75), 9) as q75, round(quantile_cont(score, 0.9), 9) as q90 from p)
       select sample_id, round(unmapped, 6) as unmapped, round(coverage, 6) as coverage, round(score, 6) as score, case when score > q90 then 'high' when score > q75 then 'moderate' else 'low' end as tier from p, qq""")
def residual_candidates(spark, d):
    """Residual candidates by the ranks of their unmapped mass, low coverage, consistency, spread of the residual and model dependence."""
    a = facts.attribution(spark, d).join(c._mapped(spark), "gene", "left_anti")
    unmapped = a.groupBy(*at.UNIT).agg(F.sum(F.abs("shap")).alias("a")).groupBy("sample_id").agg(su.r9(F.avg("a")).alias("unmapped"))
    spread = _cover(spark, d).groupBy("sample_id").agg(su.r9(F.stddev_samp("residual")).alias("residual_sd"))
    u = _units(spark, d).join(unmapped, "sample_id", "left").na.fill(0.0, ["unmapped"]).join(spread, "sample_id")
    return r6(su.candidate_scores(u).select("sample_id", "unmapped", "coverage", "score", "tier"))


@query(UNITS + f""", p as (select sample_id, n_flags, round(0.5 * {PCT.format("size")} + 0.5 * {PCT.format("instability")}, 9) as score from units)
       select sample_id, cast(n_flags as integer) as n_flags, round(score, 6) as score, round(round(0.7 * score + 0.3 * n_flags / greatest((select max(n_flags) from units), 1), 9), 6) as priority from p""")
def residual_priority(spark, d):
    return r6(su.residual_priority(_units(spark, d)).select("sample_id", "n_flags", "score", "priority"))


NULLS = c.NULL.replace("{n}", "200") + c.EXCESS + """, nu as (select sample_id, round(avg(excess) filter (where metric = 'residual'), 9) as residual_excess, round(avg(excess) filter (where metric = 'coverage'), 9) as coverage_excess,
       round(avg(excess) filter (where metric = 'top_fraction'), 9) as top_excess from ex group by sample_id),
       np as (select *, round(0.4 * """ + PCT.format("abs(residual_excess)") + " + 0.3 * " + PCT.format("(-coverage_excess)") + " + 0.3 * " + PCT.format("top_excess") + """, 9) as priority from nu)"""


@query(NULLS + " select sample_id, round(residual_excess, 6) + 0.0 as residual_excess, round(coverage_excess, 6) + 0.0 as coverage_excess, round(top_excess, 6) + 0.0 as top_excess, round(priority, 6) as priority from np")
def null_corrected_priority(spark, d):
    """Residual, coverage and mass of the largest sets above their null means over two hundred permutations, and the priority they give."""
    return r6(_null_priority(spark, d))


def _null_priority(spark, d):
    from larkaudit.operators import nulls

    p = nulls.null_patients(c._patient_null(spark, d), ["sample_id"])
    value = lambda m: su.r9(F.max(F.when(F.col("metric") == m, F.col("excess_mean"))))
    wide = p.groupBy("sample_id").agg(value("residual").alias("residual_excess"), value("coverage").alias("coverage_excess"), value("top_fraction").alias("top_excess"))
    return su.null_priority(wide)


@query(c.NULL.replace("{n}", "200") + c.EXCESS + """ select sample_id, metric, count(*) as n_repeats, round(avg(observed), 6) + 0.0 as observed_mean, round(avg(null_mean), 6) + 0.0 as null_mean_mean, round(avg(excess), 6) + 0.0 as excess_mean,
       round(stddev_samp(excess), 6) as excess_sd, round(median(excess), 6) + 0.0 as excess_median, round(avg(case when sd < 1e-9 then null else excess / sd end), 4) + 0.0 as z_mean from ex group by all""")
def null_corrected_patients(spark, d):
    """Observed, null and excess of each measure by patient, over repeats."""
    from larkaudit.operators import nulls

    p = nulls.null_patients(c._patient_null(spark, d), ["sample_id"]).withColumn("z_mean", F.round("z_mean", 4))
    return r6(p.select("sample_id", "metric", "n_repeats", "observed_mean", "null_mean_mean", "excess_mean", "excess_sd", "excess_median", "z_mean"))


@query(c.STATES + c.CONSISTENT + """, am as (select patient_id, core, round(avg(positive), 9) as m, coalesce(stddev_samp(positive), 0) as s from fuzzy group by all), u0 as (select patient_id, max(m) as most, round(avg(s), 9) as uncertainty from am group by patient_id),
       mag as (select patient_id, round(avg(magnitude), 9) as null_priority from fuzzy group by patient_id), fu as (select * from u0 join cs using (patient_id) join mag using (patient_id))
       select patient_id, round(most, 6) as most, round(consistency, 6) as consistency, round(uncertainty, 6) as uncertainty, round(null_priority, 6) as null_priority, round(round(0.4 * most + 0.25 * (1 - consistency) + 0.2 * """ + PCT.format("null_priority") + " + 0.15 * " + PCT.format("uncertainty") + ", 9), 6) as priority from fu")
def fuzzy_priority(spark, d):
    from larkaudit.operators import states

    f = c._fuzzy(spark, d)
    m = f.groupBy("patient_id", "core").agg(su.r9(F.avg("positive")).alias("m"), F.coalesce(F.stddev_samp("positive"), F.lit(0.0)).alias("s"))
    u = m.groupBy("patient_id").agg(F.max("m").alias("most"), su.r9(F.avg("s")).alias("uncertainty"))
    u = u.join(states.repeat_consistency(c._states(spark, d), "patient_id").select("patient_id", "consistency"), "patient_id")
    u = u.join(f.groupBy("patient_id").agg(su.r9(F.avg("magnitude")).alias("null_priority")), "patient_id")
    return r6(su.fuzzy_priority(u).select("patient_id", "most", "consistency", "uncertainty", "null_priority", "priority"))


POOL = c.ENTRIES + """, pool0 as (select patient_id, ent.gene, core, absolute as size, rep, sgn, ff, g0.margin from ent join g0 on g0.gene = ent.gene), pool as (select * from pool0 where rep >= 0.4 and ff >= 0.2 and sgn >= 0.6), pl as (select min(margin) as ml2, max(margin) as mh2 from pool),
       p1 as (select *, (rank() over (partition by patient_id order by size) + (count(*) over (partition by patient_id, size) - 1) / 2.0::double) / count(*) over (partition by patient_id) as size_pct,
              case when max(size) over w <= min(size) over w then 0.5 else (size - min(size) over w) / (max(size) over w - min(size) over w) end as scaled from pool window w as (partition by patient_id)),
       p2 as (select *, 0.35 * scaled + 0.2 * size_pct + 0.2 * (0.5 * rep + 0.25 * sgn + 0.25 * ff) + 0.1 * case when mh2 <= ml2 then 0.5 else (margin - ml2) / (mh2 - ml2) end as f from p1, pl),
       tops as (select *, row_number() over (partition by patient_id order by round(f / 0.85, 9) desc, gene) as k from p2), np as (select count(distinct patient_id) as n from pool0),
       fr as (select gene, count(*) filter (where k <= 20) as n_top, count(*) filter (where k <= 20) / max(n)::double as frequency, round(ln((1.0::double + max(n)) / (1.0::double + count(*) filter (where k <= 20))) + 1, 9) as idf from tops, np group by gene), lm as (select min(idf) as lo, max(idf) as hi from fr),
       cl as (select gene, n_top, frequency, case when hi <= lo then 0.5 else (idf - lo) / (hi - lo) end as idf01, case when frequency >= 0.25 then 'generic' when frequency >= 0.1 then 'recurrent' else 'specific' end as class from fr, lm),
       scored2 as (select p2.patient_id, p2.gene, core, n_top, frequency, idf01, class, round(f / 0.85, 9) as first_score, round(f + 0.15 * idf01, 9) as score from p2 join cl using (gene))"""


def _pool(spark, d):
    e, genes = facts.target_tables(spark, d)
    return su.pool_scores(e.join(genes.select("gene", "fold_frequency", "margin"), "gene").withColumnRenamed("absolute", "size")), e


@query(POOL + " select patient_id, gene, n_top, round(frequency, 6) as frequency, class, round(first_score + 1e-10, 6) as first_score, round(score + 1e-10, 6) as score from scored2", base=False)
def full_pool_scores(spark, d):
    """Scores of the supported targets in two passes, with the frequency and class of their genes."""
    return n6(_pool(spark, d)[0].select("patient_id", "gene", "n_top", "frequency", "class", "first_score", "score"))


@query(POOL + """, l0 as (select *, row_number() over (partition by patient_id, class order by score desc, gene) as lr from scored2), l1 as (select * from l0 where (class = 'generic' and lr <= 5) or (class = 'recurrent' and lr <= 5) or (class = 'specific' and lr <= 10)),
       b as (select * from l1 qualify row_number() over (partition by patient_id order by score desc, gene) <= 20),
       g as (select patient_id, count(*) as n_targets, count(*) filter (where class = 'generic') as n_generic, count(*) filter (where class = 'recurrent') as n_recurrent, count(*) filter (where class = 'specific') as n_specific, avg(score) as mean_score, max(score) as most_score, avg(idf01) as mi from b group by patient_id),
       co as (select patient_id, core, row_number() over (partition by patient_id order by count(*) desc, core) as r from b group by patient_id, core),
       z as (select g.*, core as dominant_core, round(0.5 * n_specific / n_targets + 0.3 * mi + 0.2 * (1 - n_generic / n_targets), 9) as specificity from g join co using (patient_id) where r = 1)
       select p.patient_id, coalesce(n_targets, 0) as n_targets, coalesce(n_generic, 0) as n_generic, coalesce(n_recurrent, 0) as n_recurrent, coalesce(n_specific, 0) as n_specific, round(mean_score, 6) as mean_score, round(most_score, 6) as most_score, dominant_core,
       round(specificity, 6) as specificity, case when specificity <= 0.35 then 'low' when specificity <= 0.6 then 'moderate' when specificity > 0.6 then 'high' end as tier from (select distinct patient_id from pool0) p left join z using (patient_id)""", base=False)
def patient_target_summary(spark, d):
    """The layered targets of each patient summed up, with their specificity."""
    from larkaudit.operators import targets

    pool, entries = _pool(spark, d)
    layered = targets.layers(pool.withColumn("adjusted", F.col("score")), {"generic": 5, "recurrent": 5, "specific": 10})
    out = su.patient_targets(layered, entries)
    return r6(out.select("patient_id", "n_targets", "n_generic", "n_recurrent", "n_specific", "mean_score", "most_score", "dominant_core", "specificity", "tier"))


@query(c.ENTRIES + ", src as (select ent.*, row_number() over (partition by patient_id, core order by gene) - 1 as place, count(*) over (partition by patient_id, core) as n from ent), pp as (select * from src, " + c.PERMS + "), "
       + permute.sql_permuted("mv", "pp", "patient_id * 1000003 + core", "perm, patient_id, core, absolute, rep, sgn") + """, nul as (select perm, mv.patient_id, src.gene, mv.core, mv.absolute, mv.rep, mv.sgn from mv join src on src.patient_id = mv.patient_id and src.core = mv.core and src.place = mv.moved)"""
       + c.SCORED_NULL.format(k="perm,", s="nul") + c.NULL_SUMS, base=False)
def target_null_b(spark, d):
    """The twenty best targets when each patient's values are dealt anew within a core, for a hundred permutations, in sums."""
    return c._null_sums(spark, d, "within_patient_and_core")


@query(NULLS + ", " + c.TAXONOMY.replace("with ", "", 1) + ", " + c.STATES.replace("with ", "", 1) + c.CONSISTENT + """, un as (select patient_id, round(avg(s), 9) as uncertainty from (select patient_id, core, coalesce(stddev_samp(positive), 0) as s from fuzzy group by all) group by patient_id),
       bp as (select cs.patient_id, ((y = 0 and rank_state = 'advanced_like') or (y = 1 and rank_state = 'early_like'))::integer as discordant, (dependence = 'high')::integer as dependent, (instability_tier = 'high')::integer as unstable, uncertainty, round(consistency, 9) as consistency, priority as null_gap
              from cs join un using (patient_id) join taxonomy on taxonomy.sample_id = cs.patient_id join np on np.sample_id = cs.patient_id),
       sc as (select *, round(0.25::double * discordant + 0.15::double * dependent + 0.15::double * unstable + 0.2 * """ + PCT.format("uncertainty") + " + 0.15 * (1 - consistency) + 0.1 * " + PCT.format("null_gap") + """, 9) as score from bp)
       select patient_id, discordant, dependent, unstable, round(uncertainty, 6) as uncertainty, round(consistency, 6) as consistency, round(null_gap, 6) as null_gap, round(score, 6) as score from sc order by score desc, sc.null_gap desc, sc.uncertainty desc, patient_id limit 100""")
def boundary_score(spark, d):
    """The hundred patients at the border: flags of the taxonomy, spread of core memberships, consistency over repeats, and null-corrected priority."""
    from larkaudit.operators import states

    f = c._fuzzy(spark, d)
    u = f.groupBy("patient_id", "core").agg(F.coalesce(F.stddev_samp("positive"), F.lit(0.0)).alias("s")).groupBy("patient_id").agg(su.r9(F.avg("s")).alias("uncertainty"))
    u = u.join(states.repeat_consistency(c._states(spark, d), "patient_id").select("patient_id", su.r9(F.col("consistency")).alias("consistency")), "patient_id")
    gap = _null_priority(spark, d).select(F.col("sample_id").alias("patient_id"), F.col("priority").alias("null_gap"))
    return r6(states.border_scores(c._flags(spark, d).join(u, "patient_id").join(gap, "patient_id")).drop("uncertainty_pct", "null_pct"))
