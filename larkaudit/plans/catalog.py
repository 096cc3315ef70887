"""All queries of the audit by name, each over its whole tables, with the SQL to compare them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkaudit.functions import permute, ranks, text
from larkaudit.functions.lineage import cut
from larkaudit.operators import attribution as at
from larkaudit.operators import metrics, models, relational, scores, states, stats, targets
from larkaudit.plans import facts
from larkaudit.plans.facts import BASE_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
GRID = [round(0.05 + 0.01 * i, 2) for i in range(91)]
GRID_SQL = "(select unnest(range(5, 96)) / 100.0::double as threshold)"


def query(sql: str | None = None, base: bool = True):
    """Registers a function under its name; with ``base`` the SQL may use the fact tables."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            head = f"with {BASE_SQL}"
            body = sql.strip()
            SQL[f.__name__] = body if not base else f"{head}, {body[5:]}" if body.startswith("with ") else f"{head} {body}"
        return f

    return add


def r6(df: DataFrame) -> DataFrame:
    """Doubles rounded to six places, without negative zeros and NaN."""
    return df.select(*[(F.round(F.when(~F.isnan(c), F.col(c)), 6) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


t = facts.table

# --- ingest and audits ---------------------------------------------------------------------------


@query("select sample_id, gene, round(value, 6) + 0.0 as value from features")
def unpivot_features(spark, d):
    return r6(facts.features(spark, d).select("sample_id", "gene", "value"))


@query("""select gene, count(*) - count(value) as n_missing, count(distinct value) as n_unique, round(avg(value), 6) + 0.0 as mean, round(stddev_samp(value), 6) as sd,
       round(min(value), 6) as least, round(max(value), 6) as most,
       case when count(distinct value) < 2 then 'constant' when var_samp(value) <= 0 then 'zero_variance' else 'retained' end as status from features group by gene""")
def gene_audit(spark, d):
    g = facts.features(spark, d).groupBy("gene").agg(
        (F.count("*") - F.count("value")).alias("n_missing"), F.countDistinct("value").alias("n_unique"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"),
        F.min("value").alias("least"), F.max("value").alias("most"), F.var_samp("value").alias("_v"),
    )
    status = F.when(F.col("n_unique") < 2, "constant").when(F.col("_v") <= 0, "zero_variance").otherwise("retained")
    return r6(g.withColumn("status", status).drop("_v"))


@query("select source, count(distinct lang) as n_labels from documents group by source having count(distinct lang) > 1", base=False)
def label_conflicts(spark, d):
    return relational.label_conflicts(t(spark, d, "documents"), "source", "lang")


@query("select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey) = 1", base=False)
def first_sample_per_patient(spark, d):
    return relational.first_per_key(t(spark, d, "orders"), ["o_custkey"], F.desc("o_orderdate"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""with l as (select distinct doc_id from documents), r as (select distinct doc_id from labels),
       j as (select l.doc_id as a, r.doc_id as b from l full join r on l.doc_id = r.doc_id)
       select 'matched' as metric, cast(count(*) filter (where a is not null and b is not null) as double) as value from j
       union all select 'left_only', cast(count(*) filter (where b is null) as double) from j
       union all select 'right_only', cast(count(*) filter (where a is null) as double) from j""", base=False)
def match_audit(spark, d):
    return relational.match_audit(t(spark, d, "documents"), t(spark, d, "labels"), "doc_id")


@query("select c_custkey, c_name from customer where c_custkey not in (select o_custkey from orders)", base=False)
def anti_left(spark, d):
    return t(spark, d, "customer").join(t(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey", "c_name")


@query("select doc_id, source from documents where doc_id in (select doc_id from labels)", base=False)
def semi_join(spark, d):
    return t(spark, d, "documents").select("doc_id", "source").join(t(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("select coalesce(d.doc_id, l.doc_id) as doc_id, d.lang, l.quality, l.toxic from documents d full join labels l on d.doc_id = l.doc_id", base=False)
def full_outer_metadata(spark, d):
    return t(spark, d, "documents").select("doc_id", "lang").join(t(spark, d, "labels"), "doc_id", "full_outer").select("doc_id", "lang", "quality", "toxic")


@query("select p_brand, l_suppkey, round(avg(l_quantity), 6) as l_quantity from lineitem join part on l_partkey = p_partkey group by all", base=False)
def dup_collapse_mean(spark, d):
    l = t(spark, d, "lineitem").join(t(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return r6(relational.collapse_mean(l, ["p_brand", "l_suppkey"], "l_quantity"))


@query("""with v as (select p_brand, l_partkey, var_samp(l_quantity) as variance from lineitem join part on l_partkey = p_partkey group by all)
       select p_brand, l_partkey, round(variance, 6) as variance from v qualify row_number() over (partition by p_brand order by round(variance, 6) desc nulls last, l_partkey) = 1""", base=False)
def max_variance_rows(spark, d):
    l = t(spark, d, "lineitem").join(t(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    v = l.groupBy("p_brand", "l_partkey").agg(F.round(F.var_samp("l_quantity"), 6).alias("variance"))
    return relational.first_per_key(v, ["p_brand"], F.desc_nulls_last("variance"), F.asc("l_partkey"))


@query("select gene, round(var_samp(value), 6) as variance from features group by gene order by round(var_samp(value), 6) desc, gene limit 20")
def top_variance_features(spark, d):
    g = facts.features(spark, d).groupBy("gene").agg(F.round(F.var_samp("value"), 6).alias("variance"))
    return g.orderBy(F.desc("variance"), "gene").limit(20)


@query("select 'doc_id' as \"column\", count(doc_id) as n_known, count(*) - count(doc_id) as n_missing, count(distinct doc_id) as n_distinct from documents union all select 'lang', count(lang), count(*) - count(lang), count(distinct lang) from documents union all select 'source', count(source), count(*) - count(source), count(distinct source) from documents union all select 'n_chars', count(n_chars), count(*) - count(n_chars), count(distinct n_chars) from documents", base=False)
def column_diagnostics(spark, d):
    return relational.column_diagnostics(t(spark, d, "documents").select("doc_id", "lang", "source", "n_chars"))


@query("""with k as (select event_id, props from events where props is not null)
       select event_id, lower(trim(substr(props, 1, instr(props, ':') - 1))) as key, trim(substr(props, instr(props, ':') + 1)) as value from k where instr(props, ':') > 0
       union all select event_id, 'props', trim(props) from k where instr(props, ':') = 0""", base=False)
def kv_split(spark, d):
    e = t(spark, d, "events").where("props is not null")
    return e.select("event_id", text.key_value(F.col("props"), F.lit("props")).alias("kv")).select("event_id", "kv.*")


@query("""select p_partkey, upper(trim(p_type)) as symbol, regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') as identifier,
       array_to_string(list_filter(list_transform(string_split_regex(p_name, '[|,; ]'), lambda x: upper(trim(x))), lambda x: x not in ('', '-', 'NA', 'NAN', 'NONE', 'NULL')), ';') as parts from part""", base=False)
def symbol_cleaning(spark, d):
    p = t(spark, d, "part")
    parts = text.split_symbols(F.translate("p_name", " ", ";"))
    return p.select("p_partkey", text.clean_symbol(F.col("p_type")).alias("symbol"), text.normalize_identifier(F.col("p_brand")).alias("identifier"), F.array_join(parts, ";").alias("parts"))


@query("""with p as (select o_orderkey, case o_orderkey % 6 when 0 then 'Stage IIIA' when 1 then 'stage ii' when 2 then 'Stage IV' when 3 then 'T' || (o_orderkey % 5) when 4 then 'Not Available' else 'Stage I' end as raw from orders)
       select o_orderkey, case when upper(raw) = 'NOT AVAILABLE' then null when upper(raw) like 'STAGE III%' or upper(raw) like 'STAGE IV%' then 'Advanced' when upper(raw) like 'STAGE I%' then 'Early' end as stage_group,
       cast(case when regexp_matches(upper(raw), '\\b(IV|III)[ABC]?\\b') then 1 when regexp_matches(upper(raw), '\\b(II|I)[ABC]?\\b') then 0
            when regexp_extract(raw, '([0-9])', 1) in ('1', '2') then 0 when regexp_extract(raw, '([0-9])', 1) in ('3', '4') then 1 end as integer) as stage_binary from p""", base=False)
def stage_parse(spark, d):
    k = F.col("o_orderkey")
    raw = F.when(k % 6 == 0, "Stage IIIA").when(k % 6 == 1, "stage ii").when(k % 6 == 2, "Stage IV").when(k % 6 == 3, F.concat(F.lit("T"), k % 5)).when(k % 6 == 4, "Not Available").otherwise("Stage I")
    return t(spark, d, "orders").select("o_orderkey", text.stage_group(raw).alias("stage_group"), text.stage_binary(raw).alias("stage_binary"))


NODE_TEXTS = ["Node negative", "N2", "lymph nodes: ", "{n} positive nodes", "no positive lymph nodes", "{n} of 12 nodes", "lymph_node_positive", "count {n}", "unknown", "n0 (i-)"]


@query(r"""with v as (select c_custkey as id, list_value('Node negative', 'N2', 'lymph nodes: ', '{n} positive nodes', 'no positive lymph nodes', '{n} of 12 nodes', 'lymph_node_positive', 'count {n}', 'unknown', 'n0 (i-)')[c_custkey % 10 + 1] as v, c_nationkey % 4 as n, c_mktsegment as m from customer),
       k as (select id, lower(replace(v, '{n}', cast(n as varchar)) || case when v like '%: ' then cast(n as varchar) else ' ' || m end) as raw from v), f as (select *, regexp_extract_all(raw, '[0-9]+') as numbers from k),
       w as (select *, regexp_extract_all(regexp_replace(raw, '[_-]', ' ', 'g'), '[a-z0-9]+') as words, regexp_replace(raw, '[_-]', ' ', 'g') as plain from f)
       select id, cast(case when list_contains(words, 'negative') or list_contains(words, 'n0') or regexp_matches(plain, '(^|[^a-z0-9])(0 *|no +)(positive *)?(lymph )?nodes?([^a-z0-9]|$)') then 0
                            when list_contains(words, 'positive') or len(list_filter(words, lambda x: regexp_full_match(x, 'n[1-9]'))) > 0 or regexp_matches(plain, '(^|[^a-z0-9])[1-9][0-9]* *(positive *)?(lymph )?nodes?([^a-z0-9]|$)') then 1
                            when len(numbers) = 1 then case when try_cast(numbers[1] as bigint) > 0 then 1 else 0 end end as integer) as status from w""", base=False)
def node_parse(spark, d):
    v, n = F.element_at(F.array(*map(F.lit, NODE_TEXTS)), (F.col("c_custkey") % 10 + 1).cast("int")), (F.col("c_nationkey") % 4).cast("string")
    raw = F.concat(F.replace(v, F.lit("{n}"), n), F.when(v.endswith(": "), n).otherwise(F.concat(F.lit(" "), "c_mktsegment")))
    return t(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.node_status(raw).alias("status"))


@query("""with a as (select distinct p_type as alias, p_brand as symbol from part), u as (select alias, count(distinct symbol) as n, min(symbol) as symbol from a group by alias)
       select alias, n as n_symbols, case when n = 1 then symbol end as symbol from u""", base=False)
def alias_table(spark, d):
    u = t(spark, d, "part").select(F.col("p_type").alias("alias"), F.col("p_brand").alias("symbol")).groupBy("alias").agg(F.countDistinct("symbol").alias("n_symbols"), F.min("symbol").alias("symbol"))
    return u.withColumn("symbol", F.when(F.col("n_symbols") == 1, F.col("symbol")))


@query("""with raw as (select distinct p_name as raw from part), s as (select raw, upper(trim(raw)) as clean from raw),
       al as (select upper(trim(p_name)) as alias, upper(trim(p_brand)) as symbol from part where p_partkey % 3 = 0), au as (select alias, count(distinct symbol) as n, min(symbol) as symbol from al group by alias),
       sy as (select upper(trim(p_name)) as alias, upper(trim(p_type)) as symbol from part where p_partkey % 3 = 1), su as (select alias, count(distinct symbol) as n, min(symbol) as symbol from sy group by alias),
       ap as (select distinct upper(trim(p_name)) as symbol from part where p_partkey % 5 = 0)
       select raw, case when ap.symbol is not null then clean when au.n > 1 then null when au.n = 1 then au.symbol when su.n > 1 then null when su.n = 1 then su.symbol else clean end as symbol,
       case when ap.symbol is not null then 'approved' when au.n > 1 then 'alias_ambiguous' when au.n = 1 then 'alias' when su.n > 1 then 'synonym_ambiguous' when su.n = 1 then 'synonym' else 'unresolved_retained' end as status
       from s left join ap on s.clean = ap.symbol left join au on s.clean = au.alias left join su on s.clean = su.alias""", base=False)
def harmonize_cascade(spark, d):
    p = t(spark, d, "part")
    pair = lambda rest, c: p.where(F.col("p_partkey") % 3 == rest).select(F.col("p_name").alias("alias"), F.col(c).alias("symbol"))
    approved = p.where(F.col("p_partkey") % 5 == 0).select(F.col("p_name").alias("symbol"))
    return at.harmonize(p.select(F.col("p_name").alias("raw")).distinct(), approved, pair(0, "p_brand"), pair(1, "p_type"))


# --- folds, selection, predictions ---------------------------------------------------------------


@query("select sample_id, cast(y as integer) as y, repeat_id, fold_id from folds")
def fold_assignment(spark, d):
    return facts.folds(spark, d)


@query("select repeat_id, fold_id, cast(y as integer) as y, count(*) as n from folds group by all")
def fold_balance(spark, d):
    return facts.folds(spark, d).groupBy("repeat_id", "fold_id", "y").agg(F.count("*").alias("n"))


ANOVA_SQL = """with per as (select repeat_id, fold_id, gene, f.y, count(*)::double as n, sum(value) as s, sum(value * value) as q from features f join folds k on f.sample_id = k.sample_id group by all),
       g as (select repeat_id, fold_id, gene, sum(n) as n, count(*)::double as k, sum(q) as q, sum(s) as s, sum(s * s / n) as b from per group by all),
       f as (select repeat_id, fold_id, gene, round(((b - s * s / n) / (k - 1)) / nullif((q - b) / (n - k), 0), 6) as f from g)"""


@query(ANOVA_SQL + """ select repeat_id, fold_id, gene, f, row_number() over (partition by repeat_id, fold_id order by f desc nulls last, gene) as rank from f
       qualify row_number() over (partition by repeat_id, fold_id order by f desc nulls last, gene) <= 15""")
def anova_f_topk(spark, d):
    rows = facts.features(spark, d).drop("y").join(facts.folds(spark, d), "sample_id")
    f = models.anova_f(rows, ["repeat_id", "fold_id", "gene"]).withColumn("f", F.round("f", 6))
    return models.select_features(f, ["repeat_id", "fold_id"], "gene", 15).select("repeat_id", "fold_id", "gene", "f", F.col("rank").cast("long"))


@query("select model, sample_id, repeat_id, fold_id, cast(y as integer) as y, p from oof")
def oof_long(spark, d):
    return facts.oof(spark, d)


SUMMARY_SQL = """with summary as (select model, sample_id, y, avg(p) as mean_p, median(p) as median_p, stddev_samp(p) as sd_p, min(p) as min_p, max(p) as max_p,
       avg(case when p >= 0.5 then 1.0 else 0.0 end) as frac_advanced, avg(case when (p >= 0.5) = (y = 1) then 1.0 else 0.0 end) as frac_correct, count(*) as n from oof group by all)"""


@query(SUMMARY_SQL + """ select model, sample_id, cast(y as integer) as y, round(mean_p, 6) as mean_p, round(median_p, 6) as median_p, round(sd_p, 6) as sd_p, round(min_p, 6) as min_p,
       round(max_p, 6) as max_p, round(frac_advanced, 6) as frac_advanced, round(frac_correct, 6) as frac_correct, n from summary""")
def oof_patient_summary(spark, d):
    return r6(states.patient_summary(facts.oof(spark, d)))


@query(SUMMARY_SQL + """ select model, case when y = 1 then 'advanced' else 'early' end || case when (mean_p >= 0.5) = (y = 1) then '_correct' else '_wrong' end as state, count(*) as n,
       round(avg(least(1.0, greatest(0.0, 1 - 2 * abs(mean_p - 0.5)))), 6) as mean_uncertainty from summary group by all""")
def prediction_state_counts(spark, d):
    u = states.uncertainty(states.patient_summary(facts.oof(spark, d)))
    return r6(u.groupBy("model", "state").agg(F.count("*").alias("n"), F.avg("uncertainty").alias("mean_uncertainty")))


RANKED = """with c as (select model, y, p, count(*) over (partition by model, p) as same, rank() over (partition by model order by p) as r from oof),
       auc as (select model, (sum(case when y = 1 then r + (same - 1) / 2.0::double end) - sum(y) * (sum(y) + 1) / 2.0::double) / (sum(y)::double * sum(1 - y)) as roc_auc from c group by model)"""
CURVE = """with g as (select model, p as threshold, sum(y) as a, sum(1 - y) as b from oof group by all),
       curve as (select model, threshold, sum(a) over w as tp, sum(b) over w as fp, (sum(a) over w)::double / sum(a) over (partition by model) as tpr, (sum(b) over w)::double / sum(b) over (partition by model) as fpr
                 from g window w as (partition by model order by threshold desc))"""


@query(RANKED + " select model, round(roc_auc, 6) as roc_auc from auc")
def auc_by_model(spark, d):
    return r6(metrics.auc(facts.oof(spark, d), ["model"]))


@query(CURVE + """ select model, threshold, cast(tp as bigint) as tp, cast(fp as bigint) as fp, round(tpr, 6) as tpr, round(fpr, 6) as fpr, round(1 - fpr, 6) as specificity, round(tpr - fpr, 6) + 0.0 as youden from curve""")
def roc_points(spark, d):
    return r6(metrics.roc_points(facts.oof(spark, d), ["model"]))


@query(CURVE + """ select model, round(sum(step * tp / (tp + fp)), 6) as average_precision from
       (select model, tp, fp, tpr - coalesce(lag(tpr) over (partition by model order by threshold desc), 0) as step from curve) group by model""")
def average_precision(spark, d):
    return r6(metrics.average_precision(facts.oof(spark, d), ["model"]))


def _at(keys: str, source: str, threshold: str) -> str:
    return f"""confusion as (select {keys}, count(*) filter (where y = 0 and p < {threshold}) as tn, count(*) filter (where y = 0 and p >= {threshold}) as fp,
       count(*) filter (where y = 1 and p < {threshold}) as fn, count(*) filter (where y = 1 and p >= {threshold}) as tp from {source} group by {keys}),
       rates as (select *, tp / nullif(tp + fn, 0)::double as recall, tn / nullif(tn + fp, 0)::double as specificity, tp / nullif(tp + fp, 0)::double as precision,
       tn / nullif(tn + fn, 0)::double as npv, (tp + tn) / nullif(tp + tn + fp + fn, 0)::double as accuracy, 2 * tp / nullif(2 * tp + fp + fn, 0)::double as f1 from confusion)"""


AT_COLUMNS = """tn, fp, fn, tp, round(recall, 6) as recall, round(specificity, 6) as specificity, round(precision, 6) as precision, round(npv, 6) as npv, round(accuracy, 6) as accuracy,
       round((recall + specificity) / 2, 6) as balanced_accuracy, round(f1, 6) as f1, round(recall + specificity - 1, 6) + 0.0 as youden"""


@query("with " + RANKED[5:] + ", " + CURVE[5:] + """, ap as (select model, sum(step * tp / (tp + fp)) as average_precision from
       (select model, tp, fp, tpr - coalesce(lag(tpr) over (partition by model order by threshold desc), 0) as step from curve) group by model), """ + _at("model", "oof", "0.5") + """,
       ls as (select model, avg((p - y) * (p - y)) as brier, avg(-(y * ln(least(greatest(p, 1e-7), 1 - 1e-7)) + (1 - y) * ln(1 - least(greatest(p, 1e-7), 1 - 1e-7)))) as log_loss, count(*) as n from oof group by model)
       select model, round(roc_auc, 6) as roc_auc, round(average_precision, 6) as average_precision, """ + AT_COLUMNS + """, round(brier, 6) as brier, round(log_loss, 6) as log_loss, n, 0.5::double as threshold
       from auc join ap using (model) join rates using (model) join ls using (model)""")
def binary_metrics(spark, d):
    return r6(metrics.binary_metrics(facts.oof(spark, d), ["model"]))


@query("with swept as (select model, y, p, threshold from oof, " + GRID_SQL + "), " + _at("model, threshold", "swept", "threshold") + " select model, round(threshold, 6) as threshold, " + AT_COLUMNS + " from rates")
def threshold_sweep(spark, d):
    return r6(metrics.threshold_sweep(facts.oof(spark, d), ["model"], GRID))


@query("with swept as (select model, y, p, threshold from oof, " + GRID_SQL + "), " + _at("model, threshold", "swept", "threshold") + """ select model, round(threshold, 6) as threshold, round((recall + specificity) / 2, 6) as balanced_accuracy from rates
       qualify row_number() over (partition by model order by round((recall + specificity) / 2, 9) desc, threshold) = 1""")
def best_threshold(spark, d):
    swept = metrics.threshold_sweep(facts.oof(spark, d), ["model"], GRID).withColumn("balanced_accuracy", F.round("balanced_accuracy", 9))
    return r6(metrics.best_threshold(swept, ["model"], "balanced_accuracy").select("model", "threshold", "balanced_accuracy"))


@query("""with e as (select model, quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as edges from oof group by model),
       b as (select o.model, y, p, len(list_filter(edges, lambda x: x < p - 1e-12)) as bin from oof o join e on o.model = e.model)
       select model, bin, count(*) as n, round(avg(p), 6) as mean_p, round(avg(y), 6) as observed, round(avg(y) - avg(p), 6) + 0.0 as residual from b group by all""")
def calibration_bins(spark, d):
    return r6(metrics.calibration_bins(facts.oof(spark, d).withColumn("p", F.col("p")), ["model"]))


@query("""select model, cast(y as integer) as y, count(p) as n, round(avg(p), 6) as mean, round(stddev_samp(p), 6) as sd, round(round(median(p), 9), 6) as median, round(round(quantile_cont(p, 0.25), 9), 6) as q25,
       round(round(quantile_cont(p, 0.75), 9), 6) as q75, round(round(quantile_cont(p, 0.025), 9), 6) as q025, round(round(quantile_cont(p, 0.975), 9), 6) as q975, round(min(p), 6) as least, round(max(p), 6) as most from oof group by model, y""")
def distribution_by_class(spark, d):
    return r6(relational.describe(facts.oof(spark, d), ["model", "y"], "p", {"q025": 0.025, "q975": 0.975}))


@query("""select model, repeat_id, fold_id, round(avg((p - y) * (p - y)), 6) as brier, round(avg(-(y * ln(least(greatest(p, 1e-7), 1 - 1e-7)) + (1 - y) * ln(1 - least(greatest(p, 1e-7), 1 - 1e-7)))), 6) as log_loss, count(*) as n from oof group by all""")
def fold_losses(spark, d):
    return r6(metrics.losses(facts.oof(spark, d), ["model", "repeat_id", "fold_id"]))


WIDE = SUMMARY_SQL + """, wide as (select sample_id, y, round(max(mean_p) filter (where model = 'a'), 9) as a_p, round(max(mean_p) filter (where model = 'b'), 9) as b_p,
       round(max(sd_p) filter (where model = 'a'), 9) as a_sd, round(max(sd_p) filter (where model = 'b'), 9) as b_sd from summary group by sample_id, y)"""


def _wide(spark, d):
    s = states.patient_summary(facts.oof(spark, d)).withColumn("mean_p", F.round("mean_p", 9)).withColumn("sd_p", F.round("sd_p", 9))
    return states.disagreement(s)


CROSS = "case when (a_p >= 0.5) = (y = 1) and (b_p >= 0.5) = (y = 1) then 'both_correct' when (a_p >= 0.5) <> (y = 1) and (b_p >= 0.5) <> (y = 1) then 'both_wrong' when (a_p >= 0.5) = (y = 1) then 'only_a' else 'only_b' end"


@query(WIDE + f" select sample_id, cast(y as integer) as y, round(a_p, 6) as a_p, round(b_p, 6) as b_p, round(a_p - b_p, 6) + 0.0 as difference, (a_p >= 0.5) <> (b_p >= 0.5) as labels_differ, {CROSS} as cross_model_state from wide")
def model_disagreement(spark, d):
    return r6(_wide(spark, d).select("sample_id", "y", "a_p", "b_p", "difference", "labels_differ", "cross_model_state"))


@query(WIDE + f" select {CROSS} as cross_model_state, count(*) as n from wide group by all")
def cross_model_state_counts(spark, d):
    return _wide(spark, d).groupBy("cross_model_state").agg(F.count("*").alias("n"))


TAXONOMY = WIDE + """, ranked as (select *, (rank() over (order by a_p) + (count(*) over (partition by a_p) - 1) / 2.0::double) / count(*) over () as a_pct,
       (rank() over (order by b_p) + (count(*) over (partition by b_p) - 1) / 2.0::double) / count(*) over () as b_pct, round(abs(a_p - b_p), 9) as ad, greatest(a_sd, b_sd) as ins from wide),
       q as (select round(quantile_cont(ad, 0.75), 9) as d75, round(quantile_cont(ad, 0.9), 9) as d90, round(quantile_cont(ins, 0.75), 9) as i75, round(quantile_cont(ins, 0.9), 9) as i90 from ranked),
       s as (select *, round((a_pct + b_pct) / 2, 9) as mp, case when round((a_pct + b_pct) / 2, 9) <= 0.25 then 'early_like' when round((a_pct + b_pct) / 2, 9) <= 0.75 then 'intermediate' else 'advanced_like' end as rank_state,
             case when ad >= d90 - 1e-9 then 'high' when ad >= d75 - 1e-9 then 'moderate' else 'low' end as dependence, case when ins >= i90 - 1e-9 then 'high' when ins >= i75 - 1e-9 then 'moderate' else 'low' end as instability_tier from ranked, q),
       taxonomy as (select *, case when dependence = 'high' then 'model_dependent' when instability_tier = 'high' then 'resampling_unstable' when y = 0 and rank_state = 'advanced_like' then 'early_discordant'
             when y = 1 and rank_state = 'early_like' then 'advanced_discordant' when (y = 0 and rank_state = 'early_like') or (y = 1 and rank_state = 'advanced_like') then 'concordant' else 'intermediate_ambiguous' end as integrated_state,
             (dependence = 'high')::integer + (instability_tier = 'high')::integer + ((y = 0 and rank_state = 'advanced_like') or (y = 1 and rank_state = 'early_like'))::integer as n_flags from s)"""


def _taxonomy(spark, d):
    return states.taxonomy(_wide(spark, d).withColumn("abs_difference", F.round("abs_difference", 9)))


@query(TAXONOMY + " select sample_id, cast(y as integer) as y, round(a_pct, 6) as a_pct, round(b_pct, 6) as b_pct, rank_state, dependence, instability_tier, integrated_state, cast(n_flags as integer) as n_flags from taxonomy")
def patient_taxonomy(spark, d):
    return r6(_taxonomy(spark, d).select("sample_id", "y", "a_pct", "b_pct", "rank_state", "dependence", "instability_tier", "integrated_state", "n_flags"))


@query(TAXONOMY + " select integrated_state, count(*) as n from taxonomy group by all")
def integrated_state_counts(spark, d):
    return _taxonomy(spark, d).groupBy("integrated_state").agg(F.count("*").alias("n"))


@query(TAXONOMY + " select sample_id, cast(n_flags as integer) as n_flags, ad as abs_difference from taxonomy order by n_flags desc, ad desc, sample_id limit 50")
def priority_patients(spark, d):
    return _taxonomy(spark, d).orderBy(F.desc("n_flags"), F.desc("abs_difference"), "sample_id").limit(50).select("sample_id", "n_flags", "abs_difference")


@query(TAXONOMY + """, g as (select distinct rank_state as a from taxonomy), h as (select distinct dependence as b from taxonomy)
       select a as rank_state, b as dependence, count(t.sample_id) as n from g cross join h left join taxonomy t on t.rank_state = a and t.dependence = b group by all""")
def state_crosstab(spark, d):
    return relational.crosstab(_taxonomy(spark, d), "rank_state", "dependence")


# --- attribution ---------------------------------------------------------------------------------


@query("select sample_id, repeat_id, gene, round(shap, 6) + 0.0 as shap from attribution")
def linear_attribution(spark, d):
    return r6(facts.attribution(spark, d))


@query("""select sample_id, repeat_id, gene, round(shap, 6) + 0.0 as shap, row_number() over (partition by sample_id, repeat_id order by abs(shap) desc, gene) as rank from attribution
       qualify row_number() over (partition by sample_id, repeat_id order by abs(shap) desc, gene) <= 5""")
def attribution_topk(spark, d):
    top = ranks.top_k(facts.attribution(spark, d), 5, at.UNIT, F.desc(F.abs("shap")), F.asc("gene"))
    return r6(top.select("sample_id", "repeat_id", "gene", "shap", F.col("rank").cast("long")))


@query("""with per as (select gene, repeat_id, avg(abs(shap)) as a, avg(shap) as s from attribution group by all)
       select gene, count(*) as n_folds, round(avg(a), 6) as mean_abs, round(median(a), 6) as median_abs, round(stddev_samp(a), 6) as sd_abs, round(avg(s), 6) + 0.0 as mean_signed,
       round(count(*) / 5.0::double, 6) as frequency, round(stddev_samp(a) / nullif(avg(a), 0), 6) as cv from per group by gene""")
def global_attr_stability(spark, d):
    return r6(at.stability(facts.attribution(spark, d), "gene", "shap", "repeat_id", 5))


@query("select term, count(*) as n_genes from memberships group by term having count(*) >= 5")
def set_universe(spark, d):
    """Sets of at least five of the features that the table has."""
    present = facts.features(spark, d).select("gene").distinct()
    return facts.memberships(spark).join(present, "gene", "left_semi").groupBy("term").agg(F.count("*").alias("n_genes")).where("n_genes >= 5")


W_SQL = "with weighted as (select term, gene, 1.0::double / count(*) over (partition by gene) as weight from memberships)"


@query("select gene, count(m.term) as degree from (select distinct gene from features) left join memberships m using (gene) group by gene")
def set_degree(spark, d):
    present = facts.features(spark, d).select("gene").distinct()
    return present.join(facts.memberships(spark), "gene", "left").groupBy("gene").agg(F.count("term").alias("degree"))


@query(W_SQL + " select sample_id, repeat_id, term, round(sum(shap * weight), 6) + 0.0 as term_shap from attribution join weighted using (gene) group by all")
def set_allocation(spark, d):
    return r6(at.allocate(facts.attribution(spark, d), at.edges(facts.memberships(spark))))


@query("""with m as (select distinct gene, 1.0::double as m from memberships), c as (select sample_id, repeat_id, count(*) as n_genes, cast(sum(coalesce(m, 0)) as bigint) as n_mapped,
       sum(abs(shap) * coalesce(m, 0)) as ca, sum(abs(shap)) as aa, sum(shap * (1 - coalesce(m, 0))) as residual, sum(shap) as total from attribution left join m using (gene) group by all)
       select sample_id, repeat_id, n_genes, n_mapped, round(residual, 6) + 0.0 as residual, round(total, 6) + 0.0 as total, round(case when aa = 0 then 0 else ca / aa end, 6) as coverage from c""")
def completeness(spark, d):
    return r6(at.completeness(facts.attribution(spark, d), at.edges(facts.memberships(spark))))


@query(W_SQL + """, st as (select sample_id, repeat_id, sum(shap * weight) as in_sets from attribution join weighted using (gene) group by all),
       un as (select sample_id, repeat_id, sum(shap) as total, sum(case when gene in (select gene from weighted) then 0 else shap end) as residual from attribution group by all)
       select round(max(abs(total - coalesce(in_sets, 0) - residual)), 6) as max_error, round(avg(abs(total - coalesce(in_sets, 0) - residual)), 6) as mean_error, count(*) as n from un left join st using (sample_id, repeat_id)""")
def exact_reconstruction(spark, d):
    return r6(at.reconstruction_error(facts.attribution(spark, d), at.edges(facts.memberships(spark))))


@query("""with r as (select sample_id, repeat_id, shap, row_number() over (partition by sample_id, repeat_id order by abs(shap) desc, gene) as k from attribution)
       select sample_id, repeat_id, round(sum(shap) filter (where k <= 5), 6) + 0.0 as top5_signed, round(sum(abs(shap)) filter (where k <= 5) / sum(abs(shap)), 6) as top5_mass,
       round(sum(shap) filter (where k <= 20), 6) + 0.0 as top20_signed, round(sum(abs(shap)) filter (where k <= 20) / sum(abs(shap)), 6) as top20_mass from r group by all""")
def topk_mass(spark, d):
    return r6(at.topk_mass(facts.attribution(spark, d), [5, 20]))


@query("""with per as (select gene, count(*) as n_folds, avg(shap) as mean, stddev_samp(shap) as sd, avg(case when shap > 0 then 1.0 else 0.0 end) as fp, avg(case when shap < 0 then 1.0 else 0.0 end) as fn
       from attribution where gene >= 50 group by gene) select gene, n_folds as n, round(mean, 6) + 0.0 as mean, round(sd, 6) as sd, round(fp, 6) as frac_pos, round(fn, 6) as frac_neg, round(greatest(fp, fn), 6) as sign_consistency,
       case when fp > fn then 'toward_advanced' when fn > fp then 'toward_early' else 'mixed' end as direction from per""")
def gap_gene_stability(spark, d):
    mapped = at.edges(facts.memberships(spark)).select("gene").distinct()
    return r6(at.signs(facts.attribution(spark, d).where("gene >= 50").join(mapped, "gene", "left_anti"), ["gene"], "shap"))


RES = """with m as (select distinct gene, 1.0::double as m from memberships), res as (select sample_id, repeat_id, round(sum(shap * (1 - coalesce(m, 0))), 9) as residual from attribution left join m using (gene) group by all),
       sg as (select sample_id, count(*) as n, avg(residual) as mean, avg(case when residual > 0 then 1.0 else 0.0 end) as fp, avg(case when residual < 0 then 1.0 else 0.0 end) as fn from res group by sample_id)"""


def _residuals(spark, d):
    return at.completeness(facts.attribution(spark, d), at.edges(facts.memberships(spark))).withColumn("residual", F.round("residual", 9))


@query(RES + " select sample_id, n, round(mean, 6) + 0.0 as mean, case when abs(mean) <= 0.01 then 'near_zero' when fp >= 0.8 then 'stable_toward_advanced' when fn >= 0.8 then 'stable_toward_early' else 'mixed' end as state from sg")
def residual_direction(spark, d):
    s = at.signs(_residuals(spark, d), ["sample_id"], "residual")
    return r6(s.withColumn("state", states.residual_state(s)).select("sample_id", "n", "mean", "state"))


@query(RES + """, z as (select sample_id, sign(residual) as s, lag(sign(residual)) over (partition by sample_id order by repeat_id) as b from res where residual <> 0),
       c as (select sample_id, count(*) filter (where s <> b) as k from z group by all) select r.sample_id, cast(coalesce(k, 0) as bigint) as sign_changes from (select distinct sample_id from res) r left join c using (sample_id)""")
def sign_changes(spark, d):
    return ranks.sign_changes(_residuals(spark, d), "residual", ["sample_id"], "repeat_id")


@query("""with s as (select term, avg(abs(ts)) as m from (select sample_id, repeat_id, term, sum(shap * weight) as ts from attribution join (select term, gene, 1.0::double / count(*) over (partition by gene) as weight from memberships) using (gene) group by all) group by term),
       z as (select term, count(*)::double as size from memberships group by term), j as (select log10(m) as y, log10(size) as x from s join z using (term))
       select round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 6) as intercept, count(*) as n from j""")
def size_bias_regression(spark, d):
    w = at.edges(facts.memberships(spark))
    m = at.allocate(facts.attribution(spark, d), w).groupBy("term").agg(F.avg(F.abs("term_shap")).alias("m"))
    j = m.join(w.groupBy("term").agg(F.count("*").cast("double").alias("size")), "term").select(F.log10("m").alias("y"), F.log10("size").alias("x"))
    return r6(j.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.count("*").alias("n")))


@query(W_SQL + """, ts as (select sample_id, repeat_id, term, sum(shap * weight) as v from attribution join weighted using (gene) group by all), pr as (select term, repeat_id, avg(abs(v)) as a from ts group by all),
       z as (select term, count(*)::double as size, log10(count(*)) as x from memberships group by term), st as (select term, size, x, round(avg(a), 9) as mean_abs, round(stddev_samp(a) / nullif(avg(a), 0), 9) as cv from pr join z using (term) group by all),
       fit as (select regr_slope(log10(mean_abs), x) as slope, regr_intercept(log10(mean_abs), x) as intercept from st where mean_abs > 0), md as (select round(median(cv), 9) as mc from st),
       ad as (select term, cast(size as bigint) as size, mean_abs, mean_abs / size as per_gene, mean_abs / sqrt(size) as per_sqrt_gene, round(log10(greatest(mean_abs, 1e-15)) - (intercept + slope * x), 9) as residual, case when size <= 50 then '10_to_50' else '51_to_200' end as size_class,
              round(1 / (1 + coalesce(cv, mc)), 9) as weight from st, fit, md), sc as (select *, round(residual * weight, 9) as score from ad)
       select term, size, round(mean_abs, 6) as mean_abs, round(per_gene, 6) as per_gene, round(per_sqrt_gene, 6) as per_sqrt_gene, round(residual, 6) + 0.0 as residual, size_class, round(weight, 6) as weight, round(score, 6) + 0.0 as score,
       rank() over (order by mean_abs desc) as raw_rank, rank() over (order by score desc) as adjusted_rank, rank() over (order by score desc) - rank() over (order by mean_abs desc) as rank_change from sc""")
def size_adjusted_sets(spark, d):
    """Sets without what their size explains: residual of the regression on size, weighed by stability, with ranks before and after."""
    w = at.edges(facts.memberships(spark))
    stable = at.stability(at.allocate(facts.attribution(spark, d), w), "term", "term_shap", "repeat_id", 5)
    stable = stable.select("term", F.round("mean_abs", 9).alias("mean_abs"), F.round("cv", 9).alias("cv"))
    a = at.size_adjusted(stable.join(w.groupBy("term").agg(F.count("*").alias("size")), "term"))
    return r6(a.select("term", "size", "mean_abs", "per_gene", "per_sqrt_gene", "residual", "size_class", "weight", "score", *[F.col(c).cast("long") for c in ("raw_rank", "adjusted_rank", "rank_change")]))


# --- statistics ----------------------------------------------------------------------------------


@query("""with r as (select event_type, value, rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0::double as r, count(*) over () as n from events where value is not null and event_type is not null),
       g as (select event_type, sum(r) as s, count(*)::double as m, max(n)::double as n from r group by event_type), ti as (select sum(t * t * t - t) as ties from (select count(*)::double as t from r group by value))
       select round((12 / (n * (n + 1)) * sum(s * s / m) - 3 * (n + 1)) / (1 - max(ties) / (n * n * n - n)), 4) as h, count(*) as n_groups, cast(n as bigint) as n from g, ti group by n""", base=False)
def kruskal_h(spark, d):
    return stats.kruskal(t(spark, d, "events"), [], "event_type", "value").withColumn("h", F.round("h", 4))


@query("""with e as (select event_type, user_id % 2 = 0 as f, value from events where value is not null and event_type is not null and user_id is not null),
       r as (select event_type, f, rank() over (partition by event_type order by value) + (count(*) over (partition by event_type, value) - 1) / 2.0::double as r from e),
       g as (select event_type, sum(r) filter (where f) as s, count(*) filter (where f) as a, count(*) filter (where not f) as b from r group by event_type)
       select event_type, a as n_1, b as n_2, round(s - a * (a + 1) / 2.0::double, 3) as u, round(2 * (s - a * (a + 1) / 2.0::double) / (a * b)::double - 1, 6) + 0.0 as cliffs_delta,
       case when abs(2 * (s - a * (a + 1) / 2.0::double) / (a * b)::double - 1) < 0.147 then 'negligible' when abs(2 * (s - a * (a + 1) / 2.0::double) / (a * b)::double - 1) < 0.33 then 'small'
       when abs(2 * (s - a * (a + 1) / 2.0::double) / (a * b)::double - 1) < 0.474 then 'medium' else 'large' end as effect from g""", base=False)
def mannwhitney_u(spark, d):
    e = t(spark, d, "events").withColumn("f", F.col("user_id") % 2 == 0).where("event_type is not null")
    m = stats.mann_whitney(e, ["event_type"], "f", "value").drop("z")
    return r6(m.withColumn("u", F.round("u", 3)).withColumn("effect", ranks.effect_label(F.col("cliffs_delta"))))


@query("""with r as (select l_returnflag, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0::double as a,
       rank() over (partition by l_returnflag order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2.0::double as b from lineitem)
       select l_returnflag, round(corr(a, b), 6) as rho, count(*) as n from r group by l_returnflag""", base=False)
def spearman_rho(spark, d):
    return r6(stats.spearman(t(spark, d, "lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"))


BH = """with p as (select p_partkey as test, p_brand, round((p_retailprice * 7919 % 1000) / 1000.0::double, 6) as p from part where p_retailprice is not null),
       r as (select *, p * count(*) over {w} / row_number() over ({v} order by p, test) as q from p)
       select test, p_brand, p, round(least(1.0, min(q) over ({v} order by p, test rows between current row and unbounded following)), 6) as fdr from r"""


def _p_values(spark, d):
    p = t(spark, d, "part").where("p_retailprice is not null")
    return p.select(F.col("p_partkey").alias("test"), "p_brand", F.round((F.col("p_retailprice") * 7919 % 1000) / 1000.0, 6).alias("p"))


@query(BH.format(w="()", v=""), base=False)
def bh_fdr(spark, d):
    return r6(ranks.bh_fdr(_p_values(spark, d), "p"))


@query(BH.format(w="(partition by p_brand)", v="partition by p_brand"), base=False)
def bh_fdr_within(spark, d):
    return r6(ranks.bh_fdr(_p_values(spark, d), "p", ["p_brand"]))


@query("""with x as (select gene, value, sample_id from features), z as (select gene, sample_id, (value - avg(value) over (partition by gene)) / nullif(stddev_samp(value) over (partition by gene), 0) as z from x),
       n as (select count(distinct sample_id)::double as n from x)
       select a.gene as gene_1, b.gene as gene_2, round(coalesce(sum(a.z * b.z) / (max(n) - 1), 0), 6) + 0.0 as r from z a join z b on a.sample_id = b.sample_id and a.gene < b.gene, n group by all""")
def gene_correlation(spark, d):
    from larkaudit.operators.gram import gene_correlation as correlated

    return r6(correlated(facts.features(spark, d)))


# --- cores, fuzzy states, targets ----------------------------------------------------------------


@query("""with p as (select distinct patient_id from core_attribution), r as (select distinct repeat_id from core_attribution), c as (select distinct core from core_attribution)
       select p.patient_id, r.repeat_id, c.core, round(coalesce(a.signed, 0), 6) + 0.0 as signed, round(coalesce(a.absolute, 0), 6) as absolute from p cross join r cross join c
       left join core_attribution a on a.patient_id = p.patient_id and a.repeat_id = r.repeat_id and a.core = c.core""")
def core_grid_densify(spark, d):
    a = facts.core_attribution(spark, d)
    return r6(relational.densify(a, [a.select(c).distinct() for c in ("patient_id", "repeat_id", "core")], ["patient_id", "repeat_id", "core"], ["signed", "absolute"]))


FUZZY = """with m as (select repeat_id, core, median(round(signed, 9)) as m from core_attribution group by all), c as (select a.*, round(round(signed, 9) - m, 9) as centred from core_attribution a join m using (repeat_id, core)),
       fuzzy as (select *, (rank() over (partition by repeat_id, core order by centred) + (count(*) over (partition by repeat_id, core, centred) - 1) / 2.0::double) / count(*) over (partition by repeat_id, core) as positive,
       (rank() over (partition by repeat_id, core order by abs(centred)) + (count(*) over (partition by repeat_id, core, abs(centred)) - 1) / 2.0::double) / count(*) over (partition by repeat_id, core) as magnitude from c)"""


def _fuzzy(spark, d):
    return states.fuzzy_memberships(facts.core_attribution(spark, d).withColumn("signed", F.round("signed", 9)))


@query(FUZZY + " select patient_id, repeat_id, core, round(positive, 6) as positive, round(1 - positive, 6) as negative, round(magnitude, 6) as magnitude from fuzzy")
def fuzzy_membership(spark, d):
    return r6(_fuzzy(spark, d).select("patient_id", "repeat_id", "core", "positive", "negative", "magnitude"))


STATES = FUZZY + """, k as (select *, row_number() over (partition by patient_id, repeat_id order by positive desc, core) as k from fuzzy),
       fs as (select patient_id, repeat_id, count(*) filter (where positive >= 0.75) as n_high, max(positive) as most, max(positive) filter (where k = 2) as second, max(core) filter (where k = 1) as top,
              string_agg(core, '__' order by core) filter (where positive >= 0.75) as names from k group by all),
       fstate as (select patient_id, repeat_id, n_high, most, case when n_high >= 2 then 'shared_high__' || names when n_high = 1 and most - coalesce(second, 0) >= 0.15 then 'dominant__' || top when most <= 0.25 then 'shared_low' else 'blended_intermediate' end as state from fs)"""


def _states(spark, d):
    return states.fuzzy_states(_fuzzy(spark, d), ["patient_id", "repeat_id"])


@query(STATES + " select patient_id, repeat_id, n_high, round(most, 6) as most, state from fstate")
def fuzzy_state(spark, d):
    return r6(_states(spark, d).select("patient_id", "repeat_id", "n_high", "most", "state"))


@query(STATES + """, n as (select patient_id, state, count(*) as n from fstate group by all), modal as (select *, row_number() over (partition by patient_id order by n desc, state) as k, sum(n) over (partition by patient_id) as t, count(*) over (partition by patient_id) as c from n)
       select patient_id, c as n_states, state as modal_state, cast(t as bigint) as n_repeats, round(n / t::double, 6) as consistency, case when n / t::double >= 0.8 then 'stable' when n / t::double >= 0.6 then 'moderately_stable' else 'unstable' end as tier from modal where k = 1""")
def repeat_consistency(spark, d):
    return r6(states.repeat_consistency(_states(spark, d), "patient_id"))


@query(FUZZY + """, w as (select a.core, a.repeat_id as r1, b.repeat_id as r2, a.positive as x, b.positive as y from fuzzy a join fuzzy b on a.core = b.core and a.patient_id = b.patient_id and a.repeat_id < b.repeat_id),
       r as (select core, r1, r2, rank() over (partition by core, r1, r2 order by x) + (count(*) over (partition by core, r1, r2, x) - 1) / 2.0::double as x, rank() over (partition by core, r1, r2 order by y) + (count(*) over (partition by core, r1, r2, y) - 1) / 2.0::double as y from w)
       select core, r1, r2, round(corr(x, y), 6) + 0.0 as rho, count(*) as n from r group by all""")
def repeat_reliability(spark, d):
    f = _fuzzy(spark, d).select("core", "patient_id", "repeat_id", "positive")
    a = f.select("core", "patient_id", F.col("repeat_id").alias("r1"), F.col("positive").alias("x"))
    b = f.select("core", "patient_id", F.col("repeat_id").alias("r2"), F.col("positive").alias("y"))
    return r6(stats.spearman(a.join(b, ["core", "patient_id"]).where("r1 < r2"), ["core", "r1", "r2"], "x", "y"))


RELIABLE = """, w as (select a.core, a.repeat_id as r1, b.repeat_id as r2, a.positive as x, b.positive as y from fuzzy a join fuzzy b on a.core = b.core and a.patient_id = b.patient_id and a.repeat_id < b.repeat_id),
       r as (select core, r1, r2, rank() over (partition by core, r1, r2 order by x) + (count(*) over (partition by core, r1, r2, x) - 1) / 2.0::double as x, rank() over (partition by core, r1, r2 order by y) + (count(*) over (partition by core, r1, r2, y) - 1) / 2.0::double as y from w),
       rho as (select core, r1, r2, round(corr(x, y), 9) as rho from r group by all)"""
CONSISTENT = """, n2 as (select patient_id, state, count(*) as n from fstate group by all), cs as (select patient_id, max(n) / sum(n)::double as consistency from n2 group by patient_id)"""


def _reliability(spark, d):
    return repeat_reliability(spark, d).groupBy("core").agg(F.avg("rho").alias("mean_rho"))


@query(STATES + CONSISTENT + RELIABLE + """, rel as (select core, avg(round(rho, 6)) as m from rho group by core), rl as (select core, coalesce(m / (select max(m) from rel), 0) as r from rel),
       am as (select patient_id, core, round(avg(magnitude), 9) as membership, round(coalesce(stddev_samp(magnitude), 0), 9) as sd from fuzzy group by all), ak as (select *, row_number() over (partition by patient_id order by membership desc, core) as k from am),
       x as (select *, max(membership) filter (where k = 2) over (partition by patient_id) as nxt from ak), dm as (select *, round(membership - coalesce(nxt, 0), 9) as dominance from x where k = 1),
       s as (select patient_id, core, membership, dominance, round(0.35 * membership + 0.25 * consistency + 0.2 * (1 - sd) + 0.15 * greatest(dominance, 0) + 0.05 * r, 9) as score from dm join cs using (patient_id) join rl using (core)
             where membership >= 0.75 and consistency >= 0.6 and sd <= 0.15 and dominance > 0)
       select patient_id, core, round(membership, 6) as membership, round(dominance, 6) as dominance, round(score, 6) as score, row_number() over (partition by core order by score desc, patient_id) as rank from s
       qualify row_number() over (partition by core order by score desc, patient_id) <= 25""")
def anchors(spark, d):
    a = states.anchors(_fuzzy(spark, d), states.repeat_consistency(_states(spark, d), "patient_id"), _reliability(spark, d))
    return r6(a.withColumn("rank", F.col("rank").cast("long")))


IDF = """with everyone as (select count(distinct patient_id) as n from targets), f as (select gene, count(distinct patient_id) as c, count(distinct patient_id) / max(n)::double as fraction, ln((1.0::double + max(n)) / (1.0::double + count(distinct patient_id))) + 1 as idf from targets, everyone group by gene),
       idf as (select *, case when fraction >= 0.25 then 'generic' when fraction >= 0.1 then 'recurrent' else 'specific' end as class from f)"""


@query(IDF + " select gene, c as n, round(fraction, 6) as fraction, round(idf, 6) as idf, class from idf")
def target_idf(spark, d):
    return r6(targets.frequency_idf(facts.targets(spark, d)))


SCORED = IDF + """, lim as (select min(idf) as lo, max(idf) as hi from idf), sc as (select t.*, fraction, idf, class, case when hi <= lo then 0.5 else (idf - lo) / (hi - lo) end as idf01,
       case when max(priority) over w <= min(priority) over w then 0.5 else (priority - min(priority) over w) / (max(priority) over w - min(priority) over w) end as base from targets t join idf using (gene), lim window w as (partition by patient_id)),
       scored as (select *, round(base * (0.5 + 0.5 * idf01), 9) as adjusted from sc)"""


@query(SCORED + """, r as (select patient_id, gene, round(adjusted, 6) as adjusted, n_lines, row_number() over (partition by patient_id order by adjusted desc, gene) as rank from scored)
       select patient_id, gene, adjusted, rank from r where rank <= 20 and n_lines >= 2""")
def specificity_rerank(spark, d):
    r = targets.rerank(targets.specificity(facts.targets(spark, d)), 20, "n_lines >= 2")
    return r6(r.select("patient_id", "gene", "adjusted", F.col("rank").cast("long")))


@query(SCORED + """, a as (select unnest([0.0, 0.25, 0.5, 0.75, 1.0])::double as alpha), v as (select alpha, patient_id, gene, row_number() over (partition by alpha, patient_id order by round(base * (1 - alpha + alpha * (0.5 + 0.5 * idf01)), 9) desc, gene) as k from scored, a),
       top as (select * from v where k <= 20), b as (select patient_id, gene from top where alpha = 0), n as (select patient_id, count(*) as n from b group by all),
       h as (select alpha, t.patient_id, count(b.gene) / max(n.n)::double as s from top t left join b on t.patient_id = b.patient_id and t.gene = b.gene join n on n.patient_id = t.patient_id group by all)
       select alpha, round(avg(s), 6) as kept, count(*) as n_patients from h group by alpha""")
def alpha_sensitivity(spark, d):
    return r6(targets.alpha_sensitivity(facts.targets(spark, d), [0.0, 0.25, 0.5, 0.75, 1.0]))


@query(SCORED + """, l as (select *, row_number() over (partition by patient_id, class order by adjusted desc, gene) as lr from scored), k as (select * from l where (class = 'generic' and lr <= 5) or (class = 'recurrent' and lr <= 5) or (class = 'specific' and lr <= 10))
       select patient_id, gene, class, lr as layer_rank, row_number() over (partition by patient_id order by adjusted desc, gene) as rank from k qualify row_number() over (partition by patient_id order by adjusted desc, gene) <= 20""")
def three_layer_targets(spark, d):
    l = targets.layers(targets.specificity(facts.targets(spark, d)), {"generic": 5, "recurrent": 5, "specific": 10})
    return l.select("patient_id", "gene", "class", F.col("layer_rank").cast("long"), F.col("rank").cast("long"))


TOP5 = SCORED + ", sets as (select patient_id, gene from scored qualify row_number() over (partition by patient_id order by adjusted desc, gene) <= 5)"
METRICS = """sz as (select {k} patient_id, count(*) as size from {s} group by {k} patient_id), pr as (select {ak} a.patient_id as p, b.patient_id as q, count(*) as i from {s} a join {s} b on {jk} a.gene = b.gene and a.patient_id < b.patient_id group by {ak} p, q),
       jc as (select {pk} sum(i / (x.size + y.size - i)::double) as j from pr join sz x on {xk} x.patient_id = p join sz y on {yk} y.patient_id = q {gk}), n as (select {k} count(*) as n, avg(size) as mean_size from sz {gk2}),
       it as (select {k} max(c) as m, count(*) as n_items from (select {k} gene, count(*) as c from {s} group by {k} gene) {gk2})"""


def _sets(spark, d):
    return targets.rerank(targets.specificity(facts.targets(spark, d)), 5).select("patient_id", "gene")


@query(TOP5 + ", " + METRICS.format(k="", s="sets", ak="", jk="", pk="", xk="", yk="", gk="", gk2="")
       + " select round(coalesce(j, 0) / (n * (n - 1) / 2.0::double), 6) as mean_jaccard, round(1 - coalesce(j, 0) / (n * (n - 1) / 2.0::double), 6) as dissimilarity, round(m / n::double, 6) as max_recurrence, round(mean_size, 6) as mean_size, n_items from n, it, jc")
def target_jaccard(spark, d):
    return r6(targets.set_metrics(_sets(spark, d)))


ENTRIES = """with li as (select * from lineitem join orders on l_orderkey = o_orderkey),
       ent as (select o_custkey as patient_id, l_partkey as gene, l_partkey % 4 as core, max(l_extendedprice)::double as absolute, least(1.0, max(l_quantity) / 50.0::double) as rep,
               greatest(avg(case when l_returnflag = 'N' then 1.0 else 0.0 end), 1 - avg(case when l_returnflag = 'N' then 1.0 else 0.0 end)) as sgn from li group by o_custkey, l_partkey),
       g0 as (select l_partkey as gene, count(distinct o_custkey) as n, count(distinct l_linenumber) / 7.0::double as ff, round(avg(l_quantity), 9) as margin from li group by l_partkey),
       gx as (select max(n) as hi, min(n) as lo, min(margin) as ml, max(margin) as mh, count(*) as n_genes, (select count(distinct o_custkey) from li) as total from g0),
       gen as (select gene, ff, n_genes, row_number() over (order by gene) - 1 as gplace, case when hi <= lo then 0.5 else (ln((1.0::double + total) / (1 + n)) - ln((1.0::double + total) / (1 + hi))) / (ln((1.0::double + total) / (1 + lo)) - ln((1.0::double + total) / (1 + hi))) end as idf,
               case when mh <= ml then 0.5 else (margin - ml) / (mh - ml) end as margin from g0, gx)"""
#: Scores of present genes only: no absent gene is above a present one, as prices are positive.
SCORED_NULL = """, rk as (select *, n_genes - count(*) over w + row_number() over (partition by {k} patient_id order by absolute, gplace) as pos, max(absolute) over w as high,
       case when count(*) over w < n_genes then 0 else min(absolute) over w end as low from {s} join gen using (gene) window w as (partition by {k} patient_id)),
       scn as (select {k} patient_id, gene, round(0.35 * case when high > low then (absolute - low) / (high - low) else 0 end + 0.2 * pos / n_genes + 0.2 * (0.5 * rep + 0.25 * sgn + 0.25 * ff) + 0.1 * margin + 0.15 * idf, 9) as score from rk),
       best as (select * from scn qualify row_number() over (partition by {k} patient_id order by score desc, gene) <= 20)"""
NULL_SUMS = " select perm, patient_id, count(*) as n_targets, cast(sum(gene) as bigint) as gene_sum, round(sum(score), 6) as score_sum from best group by perm, patient_id"


def _null_sums(spark, d, kind):
    from larkaudit.operators import target_nulls

    best = target_nulls.null_best(*facts.target_tables(spark, d), kind, 100)
    return r6(best.select("perm", "patient_id", "n_targets", "gene_sum", "score_sum"))


@query(ENTRIES + """, grid as (select p.patient_id, gen.*, coalesce(absolute, 0) as absolute, coalesce(rep, 0) as rep, coalesce(sgn, 0) as sgn, ent.gene is not null as present
               from (select distinct patient_id from ent) p cross join gen left join ent on ent.patient_id = p.patient_id and ent.gene = gen.gene),
       sc as (select *, 0.35 * case when max(absolute) over w > min(absolute) over w then (absolute - min(absolute) over w) / (max(absolute) over w - min(absolute) over w) else 0 end
                       + 0.2 * row_number() over (partition by patient_id order by absolute, gplace) / n_genes + 0.2 * (0.5 * rep + 0.25 * sgn + 0.25 * ff) + 0.1 * margin + 0.15 * idf as score from grid window w as (partition by patient_id))
       select patient_id, count(*) as n_genes, count(*) filter (where present) as n_present, round(sum(score), 6) as total, round(sum(score * gplace) / count(*), 6) as by_place, round(min(score), 6) as least, round(max(score), 6) as most,
       round(sum(score) filter (where present), 6) as present_total from sc group by patient_id""", base=False)
def dense_scores(spark, d):
    """Scores over the whole matrix of patients and genes, summed up by patient: in all, by place, and of present genes."""
    return r6(scores.dense_sums(*facts.target_tables(spark, d)))


@query(ENTRIES + SCORED_NULL.format(k="", s="ent") + " select patient_id, gene, score, row_number() over (partition by patient_id order by score desc, gene) as rank from best", base=False)
def dense_targets(spark, d):
    """The twenty best targets of each patient by the scores of the whole matrix."""
    best = scores.best_present(*facts.target_tables(spark, d))
    return best.select("patient_id", "gene", "score", F.col("rank").cast("long"))


PERMS = "(select unnest(range(1, 101)) as perm)"


@query(ENTRIES + ", src as (select ent.*, row_number() over (partition by gene order by patient_id) - 1 as place, count(*) over (partition by gene) as n from ent), pp as (select * from src, " + PERMS + "), "
       + permute.sql_permuted("mv", "pp", "gene", "perm, gene, core, absolute, rep, sgn") + """, nul as (select perm, src.patient_id, mv.gene, mv.core, mv.absolute, mv.rep, mv.sgn from mv join src on src.gene = mv.gene and src.place = mv.moved)"""
       + SCORED_NULL.format(k="perm,", s="nul") + NULL_SUMS, base=False)
def target_null_a(spark, d):
    """The twenty best targets when each gene's values are dealt anew to its patients, for a hundred permutations: how many, which and how good, in sums."""
    return _null_sums(spark, d, "within_gene")


@query()
def target_null_compare(spark, d):
    """Overlap of the observed target sets against a hundred permutations of either kind."""
    from larkaudit.operators import target_nulls

    def long(df, keys):
        return df.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in ("mean_jaccard", "dissimilarity", "max_recurrence")])).alias("_m")).select(*keys, "_m.*")

    e, genes = facts.target_tables(spark, d)
    genes = cut(genes)
    observed, out = cut(long(target_nulls.observed_metrics(scores.best_present(e, genes)), [])), None
    for name in ("within_gene", "within_patient_and_core"):
        found = targets.null_compare(cut(long(target_nulls.null_metrics(e, genes, name, 100), ["perm"])), observed).withColumn("null_type", F.lit(name))
        out = found if out is None else out.unionByName(found)
    return out


@query(IDF + """ select patient_id, string_agg(gene || '[' || core || ']', '; ' order by priority desc, gene) as report, count(*) as n_targets from
       (select * from targets qualify row_number() over (partition by patient_id order by priority desc, gene) <= 5) group by patient_id""")
def report_text(spark, d):
    top = ranks.top_k(facts.targets(spark, d), 5, ["patient_id"], F.desc("priority"), F.asc("gene"))
    label = F.concat(F.col("gene").cast("string"), F.lit("["), F.col("core").cast("string"), F.lit("]"))
    return top.groupBy("patient_id").agg(text.ordered_join(label, F.col("rank")).alias("report"), F.count("*").alias("n_targets"))


@query("""with z as (select gene, sample_id, y, (value - avg(value) over (partition by gene)) / nullif(stddev_samp(value) over (partition by gene), 0) as z from features), s as (select m.term, sample_id, y, avg(z) as score from z join memberships m using (gene) group by all)
       select term, round(avg(score) filter (where y = 0), 6) + 0.0 as mean_early, round(avg(score) filter (where y = 1), 6) + 0.0 as mean_advanced, count(*) as n from s group by term""")
def core_projection(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("gene")
    z = facts.features(spark, d).withColumn("z", F.try_divide(F.col("value") - F.avg("value").over(w), F.stddev_samp("value").over(w)))
    s = z.join(facts.memberships(spark), "gene").groupBy("term", "sample_id", "y").agg(F.avg("z").alias("score"))
    return r6(s.groupBy("term").agg(F.avg(F.when(F.col("y") == 0, F.col("score"))).alias("mean_early"), F.avg(F.when(F.col("y") == 1, F.col("score"))).alias("mean_advanced"), F.count("*").alias("n")))


@query("""with a as (select distinct l_partkey as k from lineitem), b as (select p_partkey as k from part where p_size > 25)
       select count(*) filter (where a.k is not null and b.k is not null) as both, count(*) filter (where b.k is null) as only_a, count(*) filter (where a.k is null) as only_b from a full join b on a.k = b.k""", base=False)
def overlap_summary(spark, d):
    a = t(spark, d, "lineitem").select(F.col("l_partkey").alias("k")).distinct().withColumn("a", F.lit(1))
    b = t(spark, d, "part").where("p_size > 25").select(F.col("p_partkey").alias("k")).withColumn("b", F.lit(1))
    j = a.join(b, "k", "full_outer")
    return j.agg(F.count(F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1)).alias("both"), F.count(F.when(F.col("b").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("a").isNull(), 1)).alias("only_b"))


# --- nulls, models, clusters ---------------------------------------------------------------------

#: Labels of the columns in each permutation of a repeat; observed labels are permutation 0.
NULL = W_SQL + """, mp as (select distinct gene from memberships), pl as (select gene, row_number() over (order by gene) - 1 as place, count(*) over () as n from (select distinct gene from features)),
       src as (select r as repeat_id, pl.*, perm from pl, (select unnest(range(1, 6)) as r), (select unnest(range(1, {n} + 1)) as perm)), """ + permute.sql_permuted("mv", "src", "repeat_id", "repeat_id, perm, gene") + """,
       lb as (select repeat_id, perm, mv.gene, pl.gene as label from mv join pl on pl.place = moved union all select r, 0, gene, gene from pl, (select unnest(range(1, 6)) as r)),
       cv as (select perm, sample_id, repeat_id, sum(shap * case when mp.gene is null then 1.0 else 0.0 end) as residual, coalesce(sum(abs(shap) * case when mp.gene is null then 0.0 else 1.0 end) / nullif(sum(abs(shap)), 0), 0) as coverage
              from attribution join lb using (repeat_id, gene) left join mp on mp.gene = label group by all),
       ts as (select perm, sample_id, repeat_id, term, abs(sum(shap * weight)) as mass from attribution join lb using (repeat_id, gene) join weighted on weighted.gene = label group by all),
       tr as (select *, row_number() over (partition by perm, sample_id, repeat_id order by mass desc) as k from ts), tf as (select perm, sample_id, repeat_id, coalesce(sum(mass) filter (where k <= 3) / nullif(sum(mass), 0), 0) as top_fraction from tr group by all),
       nv as (select * from cv join tf using (perm, sample_id, repeat_id))"""
#: Each unit's place in the null of each measure.
EXCESS = """, lg as (select perm, sample_id, repeat_id, 'residual' as metric, residual as v from nv union all select perm, sample_id, repeat_id, 'coverage', coverage from nv union all select perm, sample_id, repeat_id, 'top_fraction', top_fraction from nv),
       ob as (select sample_id, repeat_id, metric, v as observed from lg where perm = 0),
       ex as (select sample_id, repeat_id, metric, max(observed) as observed, count(*) as n, avg(v) as null_mean, max(observed) - avg(v) as excess, stddev_pop(v) as sd, (1.0::double + count(*) filter (where v <= observed + 1e-9)) / (1 + count(*)) as p_lower,
              (1.0::double + count(*) filter (where v >= observed - 1e-9)) / (1 + count(*)) as p_upper from lg join ob using (sample_id, repeat_id, metric) where perm > 0 group by all)"""
def _mapped(spark):
    return at.edges(facts.memberships(spark)).select("gene").distinct()


#: Sets that count as the largest ones: there are ten in all.
TOP_SETS = 3


@query(NULL.replace("{n}", "100") + " select perm, sample_id, repeat_id, round(residual, 6) + 0.0 as residual, round(coverage, 6) as coverage, round(top_fraction, 6) as top_fraction from nv where perm > 0")
def mapping_null(spark, d):
    from larkaudit.operators import nulls

    return r6(nulls.mapping_null(facts.attribution(spark, d), at.edges(facts.memberships(spark)), 100, TOP_SETS))


@query("""select perm, sample_id, repeat_id, round(sum(abs(shap) * case when ((sample_id * 7919 + gene * 104729 + repeat_id * 1299709 + perm * 15485863) % 1000003) % 2 = 0 then 1.0::double else -1.0::double end), 6) + 0.0 as total
       from attribution, (select unnest(range(1, 101)) as perm) group by all""")
def signflip_null(spark, d):
    from larkaudit.operators import nulls

    return r6(nulls.signflip_null(facts.attribution(spark, d), 100))


@query(NULL.replace("{n}", "200") + EXCESS + """ select sample_id, repeat_id, metric, round(observed, 6) + 0.0 as observed, n, round(null_mean, 6) + 0.0 as null_mean, round(sd, 6) as null_sd, round(excess, 6) + 0.0 as excess,
       round(case when sd < 1e-9 then null else excess / sd end, 4) + 0.0 as z, round(p_lower, 6) as p_lower, round(p_upper, 6) as p_upper, round(least(1.0, 2 * least(p_lower, p_upper)), 6) as p_value from ex""")
def patient_null_excess(spark, d):
    return r6(_patient_null(spark, d).withColumn("z", F.round("z", 4)))


def _patient_null(spark, d):
    from larkaudit.operators import nulls

    return nulls.patient_null(facts.attribution(spark, d), at.edges(facts.memberships(spark)), 200, TOP_SETS)


def _vectors(spark, d):
    e = t(spark, d, "embeddings").where("embedding is not null")
    return e.select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("x"))


@query()
def model_oof(spark, d):
    """Held-out predictions of both models; fits are beyond SQL."""
    return models.out_of_fold(_vectors(spark, d), facts.folds(spark, d))


@query()
def tree_shap_additivity(spark, d):
    """By fold the largest difference of the prediction and expected value plus Shapley values."""
    s = models.out_of_fold(_vectors(spark, d), facts.folds(spark, d).where("repeat_id = 1"), trees=5, leaf=20, k=8, explain=True)
    g = s.groupBy("repeat_id", "fold_id", "sample_id").agg(F.first("p").alias("p"), F.first("expected").alias("e"), F.sum("shap").alias("s"))
    return g.groupBy("repeat_id", "fold_id").agg(F.max(F.abs(F.col("p") - F.col("e") - F.col("s"))).alias("max_error"), F.count("*").alias("n"))


def _consensus(spark, d):
    """Consensus of 100 bootstraps at 3 to 12 modules, and the modules of each k."""
    from larkaudit.operators import cluster

    pairs = cut(cluster.consensus(_vectors(spark, d), list(range(3, 13)), bootstraps=100))
    return pairs, cut(cluster.all_modules(pairs))


def _selected(pairs, found):
    """The pairs and modules of the selected k."""
    from larkaudit.operators import cluster

    k = cluster.select_k(cluster.module_metrics(pairs, found)).where("selected").select("k")
    return pairs.join(F.broadcast(k), "k"), found.join(F.broadcast(k), "k")  # one row


@query()
def consensus_audit(spark, d):
    """By number of modules the measures of the bootstrap consensus of features, their ranks, and which number is selected."""
    from larkaudit.operators import cluster

    return cluster.select_k(cluster.module_metrics(*_consensus(spark, d)))


@query()
def consensus_modules(spark, d):
    """Modules of the selected k, numbered along the tree."""
    from larkaudit.operators import cluster

    return _selected(*_consensus(spark, d))[1].withColumn("name", cluster.module_name(F.col("module")))


@query()
def module_stability(spark, d):
    from larkaudit.operators import cluster

    return cluster.module_stability(*_selected(*_consensus(spark, d)))


def _cores(spark, d):
    from larkaudit.operators import cluster

    pairs, found = _selected(*_consensus(spark, d))
    found = cut(found.select("gene", "module"))
    return cut(cluster.stable_cores(pairs, found)), found


@query()
def core_refine(spark, d):
    """Consensus of each gene with its module and others, how many folds select it, its module's tier, and the core that retains it."""
    from larkaudit.operators import cluster
    from larkaudit.plans import summaries

    pairs, found = _selected(*_consensus(spark, d))
    cores = cluster.stable_cores(pairs, found.select("gene", "module"))
    return cluster.refined_cores(cores, summaries.selected_gene_frequency(spark, d), cluster.module_stability(pairs, found))


@query()
def core_concordance(spark, d):
    """Patients' sums over the stable core of each module against those over the whole module."""
    from larkaudit.operators import cluster

    cores, found = _cores(spark, d)
    return cluster.core_concordance(cores, facts.attribution(spark, d).groupBy("sample_id", "gene").agg(F.avg("shap").alias("shap")), found)


# --- tiers, contrasts, reports -------------------------------------------------------------------


@query("""with z as (select term, count(*) as size from memberships group by term) select term, size as n_genes, case when size <= 6 then 'small' when size <= 12 then 'medium' when size <= 25 then 'large' end as size_class from z""")
def size_classes(spark, d):
    present = facts.features(spark, d).select("gene").distinct()
    g = facts.memberships(spark).join(present, "gene", "left_semi").groupBy("term").agg(F.count("*").alias("n_genes"))
    return g.withColumn("size_class", ranks.cut(F.col("n_genes"), [0, 6, 12, 25], ["small", "medium", "large"]))


@query("""with per as (select gene, repeat_id, avg(abs(shap)) as a, avg(shap) as s from attribution where gene >= 50 group by all),
       g as (select gene, count(*) as n_folds, round(avg(a) * count(*) / 5.0::double, 9) as pipeline, greatest(avg(case when s > 0 then 1.0 else 0.0 end), avg(case when s < 0 then 1.0 else 0.0 end)) as sc from per group by gene),
       q as (select round(quantile_cont(pipeline, 0.75), 9) as q75, round(quantile_cont(pipeline, 0.9), 9) as q90 from g where n_folds >= 5)
       select gene, n_folds, round(pipeline, 6) as pipeline, case when n_folds >= 5 and pipeline >= q90 - 1e-12 and sc >= 0.8 then 'high' when n_folds >= 5 and pipeline >= q75 - 1e-12 then 'moderate' else 'low' end as tier from g, q""")
def gap_tiers(spark, d):
    a = facts.attribution(spark, d).where("gene >= 50")
    per = a.groupBy("gene", "repeat_id").agg(F.avg(F.abs("shap")).alias("a"), F.avg("shap").alias("s"))
    g = at.signs(per, ["gene"], "s").select("gene", F.col("n").alias("n_folds"), "sign_consistency")
    g = g.join(per.groupBy("gene").agg(F.round(F.avg("a") * F.count("*") / 5.0, 9).alias("pipeline")), "gene")
    return r6(at.gap_tiers(g, least_folds=5, stable_folds=5).select("gene", "n_folds", "pipeline", "tier"))


@query("""select sample_id, round(avg(shap) filter (where gene = 50), 6) + 0.0 as g50, round(avg(shap) filter (where gene = 51), 6) + 0.0 as g51, round(avg(shap) filter (where gene = 52), 6) + 0.0 as g52 from attribution where gene between 50 and 52 group by sample_id""")
def patient_gap_matrix(spark, d):
    a = facts.attribution(spark, d).where("gene between 50 and 52")
    w = a.groupBy("sample_id").pivot("gene", [50, 51, 52]).agg(F.avg("shap"))
    return r6(w.toDF("sample_id", "g50", "g51", "g52"))


@query("""with g as (select event_type as s, value from events where value is not null and event_type is not null), mm as (select max(s) as g1, min(s) as g2 from g), e as (select s = g1 as f, value, g1, g2 from g, mm where s in (g1, g2)),
       r as (select f, g1, g2, rank() over (order by value) + (count(*) over (partition by value) - 1) / 2.0::double as r from e), k as (select g1, g2, sum(r) filter (where f) as s, count(*) filter (where f) as a, count(*) filter (where not f) as b from r group by all)
       select g1 as group_1, g2 as group_2, a as n_1, b as n_2, round(s - a * (a + 1) / 2.0::double, 3) as u, round(2 * (s - a * (a + 1) / 2.0::double) / (a * b)::double - 1, 6) + 0.0 as cliffs_delta, true as flipped from k""", base=False)
def contrast_flip(spark, d):
    e = t(spark, d, "events")
    wanted = e.agg(F.max("event_type").alias("group_1"), F.min("event_type").alias("group_2"))
    f = stats.flip_contrasts(stats.pairwise(e, [], "event_type", "value").drop("z"), wanted)
    return r6(f.withColumn("u", F.round("u", 3)))


def _flags(spark, d):
    """patient_id, discordant, dependent and unstable (0 or 1) of each sample."""
    flag = lambda c: F.when(c, 1).otherwise(0)
    discordant = ((F.col("y") == 0) & (F.col("rank_state") == "advanced_like")) | ((F.col("y") == 1) & (F.col("rank_state") == "early_like"))
    marks = {"discordant": discordant, "dependent": F.lower("dependence").contains("high"), "unstable": F.lower("instability_tier").contains("high")}
    return _taxonomy(spark, d).select(F.col("sample_id").alias("patient_id"), *[flag(c).alias(name) for name, c in marks.items()])


@query(TAXONOMY + """ select rank_state, count(ad) as n, round(avg(ad), 6) as mean, round(stddev_samp(ad), 6) as sd, round(round(median(ad), 9), 6) as median, round(round(quantile_cont(ad, 0.25), 9), 6) as q25, round(round(quantile_cont(ad, 0.75), 9), 6) as q75,
       round(min(ad), 6) as least, round(max(ad), 6) as most from taxonomy group by rank_state""")
def state_descriptives(spark, d):
    return r6(relational.describe(_taxonomy(spark, d), ["rank_state"], "abs_difference"))


from larkaudit.plans import summaries  # noqa: E402, F401  (registers its queries)


# --- aliases, independent tests, reports, models of folds ------------------------------------------


@query("""with k as (select l_orderkey, count(*) as n_records, count(distinct l_linestatus) as n_values, min(l_linestatus) as v, string_agg(distinct l_returnflag, ' | ' order by l_returnflag) as flags,
       string_agg(distinct cast(l_linenumber as varchar), ' | ' order by cast(l_linenumber as varchar)) as lines from lineitem where l_linestatus is not null group by l_orderkey)
       select l_orderkey, n_records, n_values, case when n_values = 1 then v end as l_linestatus, n_values > 1 as conflicting, flags, lines from k""", base=False)
def node_record_audit(spark, d):
    """Records of each order: how many, whether they agree on the status, and the sets of their flags and numbers."""
    from larkaudit.operators import aliases

    return aliases.record_audit(t(spark, d, "lineitem"), "l_orderkey", "l_linestatus", {"flags": "l_returnflag", "lines": "l_linenumber"})


ALIASES = """sm as (select c_custkey as accession, c_name as title, c_mktsegment || '-' || (c_custkey % 40) as source, 'C ' || (c_custkey % 300) as description from customer),
       al as (select accession, 1 as alias_rank, 'accession' as alias_type, cast(accession as varchar) as alias_raw from sm union all select accession, 2, 'title', title from sm
              union all select accession, 3, 'source', source from sm union all select accession, 4, 'description', description from sm),
       an as (select *, regexp_replace(upper(alias_raw), '[^A-Z0-9]', '', 'g') as alias from al), ow as (select alias from an group by alias having count(distinct accession) = 1),
       ua as (select * from an semi join ow using (alias) where alias <> '' qualify row_number() over (partition by alias order by alias_rank, alias_raw) = 1)"""


def _owned(spark, d):
    from larkaudit.operators import aliases

    s = t(spark, d, "customer").select(
        F.col("c_custkey").alias("accession"), F.col("c_name").alias("title"), F.concat_ws("-", "c_mktsegment", (F.col("c_custkey") % 40).cast("string")).alias("source"),
        F.concat(F.lit("C "), (F.col("c_custkey") % 300).cast("string")).alias("description"),
    )
    return aliases.owned_aliases(aliases.aliases(s, "accession", ["accession", "title", "source", "description"]), "accession")


@query("with " + ALIASES + " select accession, alias_rank, alias_type, alias_raw, alias from ua", base=False)
def sample_aliases(spark, d):
    """The names of samples that one sample alone has, of four that each sample has."""
    return _owned(spark, d)


@query("with " + ALIASES + """, co as (select o_orderkey as place, case o_orderkey % 3 when 0 then 'customer ' || lpad(cast(o_custkey as varchar), 9, '0') when 1 then cast(o_custkey as varchar) else 'C-' || (o_custkey % 300) end as name from orders),
       fc as (select * from (select name, min(place) as place from co group by name) c join ua on regexp_replace(upper(c.name), '[^A-Z0-9]', '', 'g') = ua.alias)
       select accession, name, place, alias, alias_type, alias_raw from fc qualify row_number() over (partition by accession order by place, name) = 1""", base=False)
def alias_matches(spark, d):
    """Columns that the names of samples find, each column and each sample once."""
    from larkaudit.operators import aliases

    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    name = F.when(k % 3 == 0, F.concat(F.lit("customer "), F.lpad(c, 9, "0"))).when(k % 3 == 1, c).otherwise(F.concat(F.lit("C-"), (F.col("o_custkey") % 300).cast("string")))
    return aliases.matched_columns(t(spark, d, "orders").select(k.alias("place"), name.alias("name")), _owned(spark, d), "accession", "name", "place")


def _state_rows(spark, d):
    """Customers' balances and spending by states that come from neither."""
    from larkaudit.functions.provenance import derived
    from larkaudit.operators import validation

    spent = t(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    p = t(spark, d, "customer").join(spent, "c_custkey", "left").withColumn("zone", (F.col("c_nationkey") % 3).cast("string"))
    p = derived(p, "region", F.concat(F.lit("r"), "zone"), ["zone"])
    p = derived(p, "price", F.round(F.col("c_acctbal"), 2), ["c_acctbal"])
    return validation.long_states(p, ["region", "c_mktsegment"], ["price", "spent"])


STATE_ROWS = """sp as (select o_custkey, round(sum(o_totalprice), 2) as spent from orders group by o_custkey), pt as (select *, round(c_acctbal, 2) as price, 'r' || (c_nationkey % 3) as region from customer left join sp on o_custkey = c_custkey),
       lr as (select 'region' as state_variable, region as state, 'price' as metric, price as value from pt union all select 'region', region, 'spent', spent from pt
              union all select 'c_mktsegment', c_mktsegment, 'price', price from pt union all select 'c_mktsegment', c_mktsegment, 'spent', spent from pt),
       lk as (select * from lr where state is not null and value is not null qualify count(*) over (partition by state_variable, metric, state) >= 10)"""


@query("with " + STATE_ROWS + """, rk as (select *, rank() over w + (count(*) over (partition by state_variable, metric, value) - 1) / 2.0::double as r, count(*) over (partition by state_variable, metric)::double as n from lk window w as (partition by state_variable, metric order by value)),
       tie as (select state_variable, metric, sum(m * m * m - m)::double as ties from (select state_variable, metric, value, count(*)::double as m from lk group by all) group by all),
       gs as (select state_variable, metric, state, sum(r) as s, count(*)::double as m, max(n) as n from rk group by all),
       h as (select state_variable, metric, (12 / (max(n) * (max(n) + 1)) * sum(s * s / m) - 3 * (max(n) + 1)) / (1 - max(ties) / (max(n) * max(n) * max(n) - max(n))) as h, count(*) as n_groups, cast(max(n) as bigint) as n, string_agg(state, ' | ' order by state) as groups
             from gs join tie using (state_variable, metric) group by all),
       pv as (select *, case n_groups when 3 then exp(-h / 2) else exp(-h / 2) * (1 + h / 2) end as p_value from h), ad as (select *, p_value * count(*) over () / count(*) over (order by p_value) as q from pv)
       select state_variable, metric, round(h, 6) as h, n_groups, n, groups, round(p_value, 6) as p_value, round(least(1.0, min(q) over (order by p_value rows between current row and unbounded following)), 6) as fdr from ad""", base=False)
def noncircular_omnibus(spark, d):
    """Do measures differ between the groups of states that do not come from them? Corrected over all tests."""
    from larkaudit.operators import validation

    return r6(validation.omnibus(_state_rows(spark, d)))


@query("with " + STATE_ROWS + """, pr as (select a.state_variable, a.metric, a.state as group_1, b.state as group_2, count(*)::double as n, sum(case when a.value > b.value then 1.0 when a.value = b.value then 0.5 else 0 end) as u from lk a join lk b on a.state_variable = b.state_variable and a.metric = b.metric and a.state < b.state group by all),
       ms as (select state_variable, metric, state, avg(value) as m, count(*) as n from lk group by all)
       select pr.state_variable, pr.metric, group_1, group_2, x.n as n_1, y.n as n_2, round(u, 6) as u, round(2 * u / pr.n - 1, 6) + 0.0 as cliffs_delta, round(x.m, 6) as mean_group_1, round(y.m, 6) as mean_group_2, round(x.m - y.m, 6) + 0.0 as mean_difference,
       case when abs(2 * u / pr.n - 1) < 0.147 then 'negligible' when abs(2 * u / pr.n - 1) < 0.33 then 'small' when abs(2 * u / pr.n - 1) < 0.474 then 'medium' else 'large' end as effect_size
       from pr join ms x on (pr.state_variable, pr.metric, group_1) = (x.state_variable, x.metric, x.state) join ms y on (pr.state_variable, pr.metric, group_2) = (y.state_variable, y.metric, y.state)""", base=False)
def noncircular_pairs(spark, d):
    """The same measures between each pair of groups."""
    from larkaudit.operators import validation

    p = validation.pairs(_state_rows(spark, d))
    return r6(p.select("state_variable", "metric", "group_1", "group_2", "n_1", "n_2", "u", "cliffs_delta", "mean_group_1", "mean_group_2", "mean_difference", "effect_size"))


REPORTS = """gn as (select t.*, case when gene % 3 = 0 then p_brand else cast(gene as varchar) end as harmonized, row_number() over (partition by patient_id order by priority desc, gene) as rank from targets t left join part on p_partkey = gene),
       gt as (select patient_id, string_agg(gene || case when harmonized is not null and harmonized <> cast(gene as varchar) then '->' || harmonized else '' end || '[' || core || ']', '; ' order by rank) as genes, count(*) as n from gn where rank <= 5 group by patient_id),
       cs as (select patient_id, core, sum(priority) as s, count(*) as n_core from targets group by patient_id, core), cp as (select *, round(s / sum(s) over (partition by patient_id), 9) as core_priority, row_number() over (partition by patient_id order by round(s, 2) desc, core) as k from cs),
       pp as (select c_custkey as patient_id, c_mktsegment as true_group, core, core_priority, coalesce(genes, '') as genes, coalesce(n, 0) as n_genes, c_acctbal < 0 as expansion, coalesce(core_priority, 0) > 0.3 as arbitration, n_core from customer left join gt on gt.patient_id = c_custkey left join cp on cp.patient_id = c_custkey and k = 1)"""


def _reports(spark, d):
    """Customers as patients: the genes they bought most dearly, the core they spent most on, and flags by balance and share."""
    from larkaudit.operators import reports

    g = facts.targets(spark, d).join(t(spark, d, "part").select(F.col("p_partkey").alias("gene"), "p_brand"), "gene", "left")
    g = g.withColumn("harmonized", F.when(F.col("gene") % 3 == 0, F.col("p_brand")).otherwise(F.col("gene").cast("string")))
    top = ranks.top_k(g, 5, ["patient_id"], F.desc("priority"), F.asc("gene"))
    c = facts.targets(spark, d).groupBy("patient_id", "core").agg(F.sum("priority").alias("s"), F.count("*").alias("n_core"))
    c = c.join(c.groupBy("patient_id").agg(F.sum("s").alias("_all")), "patient_id").withColumn("core_priority", F.round(F.col("s") / F.col("_all"), 9))
    c = ranks.top_k(c, 1, ["patient_id"], F.desc(F.round("s", 2)), F.asc("core")).select("patient_id", "core", "core_priority", "n_core")
    p = t(spark, d, "customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_mktsegment").alias("true_group"), (F.col("c_acctbal") < 0).alias("expansion")).join(c, "patient_id", "left")
    p = p.withColumn("arbitration", F.coalesce("core_priority", F.lit(0.0)) > 0.3)
    return reports.with_texts(p, reports.gene_texts(top, "gene", "harmonized", "core", "rank"))


@query("with " + BASE_SQL + ", " + REPORTS + """ select patient_id, genes as recommended_gap_genes, n_genes as n_recommended_gap_genes, concat_ws(chr(10), 'PATIENT-SPECIFIC MEASUREMENT AUDIT', repeat('=', 60), '', 'Patient: ' || patient_id, 'Clinical group: ' || true_group, '', 'PRIMARY UNRESOLVED EXPLANATORY AXIS', repeat('-', 60),
       'Core: ' || coalesce(cast(core as varchar), 'NA'), 'Core priority: ' || case when core_priority is null then 'NA' else format('{:.4f}', core_priority) end, '', 'REPRESENTATION-GAP GENE TARGETS', repeat('-', 60),
       case when genes = '' then 'No gene-level target passed the current support and ranking thresholds.' else genes end, '', 'INTERPRETATION BOUNDARY', repeat('-', 60), 'Priorities within this audit only.') as report from pp""", base=False)
def patient_reports(spark, d):
    """One text a patient: group, core and gene targets."""
    from larkaudit.operators import reports

    p = _reports(spark, d)
    text = reports.report(
        "PATIENT-SPECIFIC MEASUREMENT AUDIT", F.col("patient_id"), {"Clinical group": reports.shown(F.col("true_group"))},
        {"PRIMARY UNRESOLVED EXPLANATORY AXIS": [F.concat(F.lit("Core: "), reports.shown(F.col("core"))), F.concat(F.lit("Core priority: "), reports.number(F.col("core_priority")))],
         "REPRESENTATION-GAP GENE TARGETS": [reports.genes_or_note(F.col("recommended_gap_genes"))]}, "Priorities within this audit only.",
    )
    return p.select("patient_id", "recommended_gap_genes", "n_recommended_gap_genes", text.alias("report"))


@query("with " + BASE_SQL + ", " + REPORTS + """ select 'representation_expansion' as recommendation_type, count(*) filter (where expansion) as n_patients from pp union all select 'model_arbitration', count(*) filter (where arbitration) from pp""", base=False)
def recommendation_types(spark, d):
    """In how many patients each kind of recommendation is made."""
    from larkaudit.operators import reports

    return reports.type_counts(_reports(spark, d), {"representation_expansion": "expansion", "model_arbitration": "arbitration"})


@query("with " + BASE_SQL + ", " + REPORTS + " select core, arbitration, count(*) as n_patient_core_records, round(avg(core_priority), 6) as mean_core_priority, round(avg(n_core), 6) as mean_targets from pp group by all", base=False)
def core_recommendations(spark, d):
    """Records, mean priority and mean number of targets by core and recommendation."""
    from larkaudit.operators import reports

    return r6(reports.core_counts(_reports(spark, d), ["core", "arbitration"], {"mean_core_priority": "core_priority", "mean_targets": "n_core"}))


@query("with " + BASE_SQL + ", " + REPORTS + ", bo as (select patient_id, row_number() over (order by core_priority desc nulls last, patient_id) as rank from pp) select pp.patient_id, rank as boundary_priority_rank, core from pp join bo using (patient_id) where rank <= 100", base=False)
def boundary_reports(spark, d):
    """The hundred patients whose first core weighs most, in order."""
    from larkaudit.operators import reports

    p = _reports(spark, d)
    best = p.select("patient_id", "core_priority").orderBy(F.desc_nulls_last("core_priority"), "patient_id").limit(100)
    ranked = best.withColumn("rank", ranks.first_rank([], F.desc_nulls_last("core_priority"), F.asc("patient_id")))  # a hundred rows
    return reports.in_order(p, ranked).select("patient_id", F.col("boundary_priority_rank").cast("long"), "core")


def _net(spark, d):
    """Elastic-net models of 25 folds over the 15 best genes of each."""
    from larkaudit.operators import linear

    return linear.ElasticNetAudit(facts.features(spark, d).select("sample_id", "gene", "value"), facts.folds(spark, d), 15)


@query()
def elastic_net_folds(spark, d):
    """Measures of each fold's held-out rows, with the numbers of training and test rows."""
    return _net(spark, d).metrics


@query()
def elastic_net_genes(spark, d):
    """Selected genes of each fold with F, p, coefficient and mean absolute attribution over held-out rows."""
    run = _net(spark, d)
    size = run.attributions.groupBy("repeat_id", "held", "gene").agg(F.avg(F.abs("shap")).alias("mean_absolute"))
    return run.genes.join(run.coefficients, ["repeat_id", "held", "rank"]).join(size, ["repeat_id", "held", "gene"]).drop("mean", "sd")
