"""The audit's fact tables, derived from the given tables.

Samples are vectors, features their coordinates, a sample's class is 1 for labels from 5 on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkaudit.functions.lineage import written
from larkaudit.operators import models


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def y() -> F.Column:
    return F.when(F.col("label") >= 5, 1).otherwise(0)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, gene, value, y in long form."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), y().alias("y"), F.posexplode("embedding").alias("gene", "value"))
    return e.select("sample_id", "y", F.col("gene").cast("long"), F.col("value").cast("double"))


def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), y().alias("y"))
    return models.stratified_folds(e, "sample_id", "y", 5, 5)


def oof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, sample_id, repeat_id, fold_id, y, p: two models' held-out scores from two coordinates a repeat."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("sample_id"), "embedding")
    rows = folds(spark, sf_dir).join(e, "sample_id")

    def score(shift: int, slope: float):
        x = 8.0 * F.element_at("embedding", (F.col("repeat_id") + shift).cast("int")).cast("double") + slope * (F.col("y") - 0.5)
        return F.round(1 / (1 + F.exp(-x)), 6)

    both = F.explode(F.array(F.struct(F.lit("a").alias("model"), score(0, 1.2).alias("p")), F.struct(F.lit("b").alias("model"), score(10, 1.0).alias("p"))))
    return rows.withColumn("_m", both).select("_m.model", "sample_id", "repeat_id", "fold_id", "y", "_m.p")


def attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sample_id, repeat_id, gene, shap: coordinate times difference of class means, with a fixed jitter by repeat."""
    f = features(spark, sf_dir)
    weights = f.groupBy("gene").agg((F.avg(F.when(F.col("y") == 1, F.col("value"))) - F.avg(F.when(F.col("y") == 0, F.col("value")))).alias("w"))
    rows = f.join(weights, "gene").withColumn("repeat_id", F.explode(F.sequence(F.lit(1), F.lit(5))))
    jitter = 0.001 * ((F.col("sample_id") * 31 + F.col("gene") * 17 + F.col("repeat_id") * 7) % 11 - 5)
    return rows.select("sample_id", F.col("repeat_id").cast("long"), "gene", (F.col("value") * F.col("w") + jitter).alias("shap"))


def memberships(spark: SparkSession) -> DataFrame:
    """term, gene: ten overlapping sets over the first fifty genes."""
    return spark.range(10).select(F.col("id").alias("term"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(49).cast("long"))).alias("gene")).where("gene % (term + 2) = 0")


def core_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patient_id, repeat_id, core, signed, absolute from events: users, five repeats, event types."""
    e = table(spark, sf_dir, "events").where("user_id is not null and event_type is not null and value is not null")
    sign = F.when(F.col("event_id") % 2 == 0, 1.0).otherwise(-1.0)
    return e.groupBy(F.col("user_id").alias("patient_id"), (F.col("event_id") % 5).alias("repeat_id"), F.col("event_type").alias("core")).agg(
        F.sum(F.col("value") * sign).alias("signed"), F.sum(F.abs("value")).alias("absolute")
    )


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patient_id, gene, core, priority: what customers bought, by part, brand of the first line, and highest price."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    g = l.groupBy(F.col("o_custkey").alias("patient_id"), F.col("l_partkey").alias("gene")).agg(F.max("l_extendedprice").alias("priority"), F.count("*").alias("n_lines"))
    return g.withColumn("core", F.col("gene") % 4)


def _bought(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What customers bought by part, with all that entries and genes need; line numbers, 1 to 7, as bits."""
    l = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    line = F.call_function("shiftleft", F.lit(1), F.col("l_linenumber").cast("int"))
    return l.groupBy(F.col("o_custkey").alias("patient_id"), F.col("l_partkey").alias("gene")).agg(
        F.max("l_extendedprice").cast("double").alias("price"), F.max("l_quantity").alias("quantity"), F.avg(F.when(F.col("l_returnflag") == "N", 1.0).otherwise(0.0)).alias("kept"),
        F.bit_or(line).alias("lines"), F.sum("l_quantity").alias("quantities"), F.count("l_quantity").alias("n_quantities"),
    )


def _entries_of(bought: DataFrame) -> DataFrame:
    return bought.select(
        "patient_id", "gene", F.col("price").alias("absolute"), F.least(F.lit(1.0), F.col("quantity") / 50.0).alias("repeat_support"), F.greatest(F.col("kept"), 1 - F.col("kept")).alias("sign_support"),
        (F.col("gene") % 4).alias("core"),
    )


def _genes_of(bought: DataFrame) -> DataFrame:
    g = bought.groupBy("gene").agg(
        F.count("patient_id").alias("n"), (F.coalesce(F.bit_count(F.bit_or("lines")), F.lit(0)) / 7.0).alias("fold_frequency"),
        F.round(F.try_divide(F.sum("quantities"), F.sum("n_quantities")), 9).alias("margin"),
    )
    most = g.agg(F.max("n").alias("_hi"), F.min("n").alias("_lo"))
    total = bought.where("patient_id is not null").select("patient_id").distinct().agg(F.count("*").alias("_n"))
    g = g.crossJoin(F.broadcast(most)).crossJoin(F.broadcast(total))  # one row each
    idf = lambda c: F.log((1.0 + F.col("_n")) / (1.0 + F.col(c)))
    scaled = F.when(F.col("_hi") <= F.col("_lo"), 0.5).otherwise((idf("n") - idf("_hi")) / F.nullif(idf("_lo") - idf("_hi"), F.lit(0.0)))
    return g.select("gene", scaled.alias("idf"), "fold_frequency", "margin")


def target_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``target_entries`` and ``target_genes`` of one join of the lines, written once."""
    bought = written(_bought(spark, sf_dir))
    return _entries_of(bought), _genes_of(bought)


def target_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """patient_id, gene, core, absolute, repeat_support, sign_support: highest price, largest quantity (of fifty), and the share of the flag that most lines have."""
    return _entries_of(_bought(spark, sf_dir))


def target_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene, idf (0..1 over genes), fold_frequency (line numbers of seven) and margin (mean quantity) of each gene that a patient has."""
    return _genes_of(_bought(spark, sf_dir))


BASE_SQL = """
emb as (select vec_id as sample_id, case when label >= 5 then 1 else 0 end as y, embedding as e from embeddings),
features as (select sample_id, y, unnest(range(0, len(e))) as gene, cast(unnest(e) as double) as value from emb),
folds as (select sample_id, y, r as repeat_id,
          (row_number() over (partition by r, y order by (sample_id * 7919 + r * 104729) % 10007, sample_id) - 1) % 5 as fold_id
          from emb, (select unnest(range(1, 6)) as r)),
oof as (select 'a' as model, f.sample_id, repeat_id, fold_id, f.y, round(1 / (1 + exp(-(8.0::double * cast(e[repeat_id] as double) + 1.2::double * (f.y - 0.5::double)))), 6) as p
        from folds f join emb using (sample_id)
        union all
        select 'b' as model, f.sample_id, repeat_id, fold_id, f.y, round(1 / (1 + exp(-(8.0::double * cast(e[repeat_id + 10] as double) + 1.0::double * (f.y - 0.5::double)))), 6) as p
        from folds f join emb using (sample_id)),
gene_w as (select gene, avg(value) filter (where y = 1) - avg(value) filter (where y = 0) as w from features group by gene),
attribution as (select sample_id, r as repeat_id, gene, value * w + 0.001::double * ((sample_id * 31 + gene * 17 + r * 7) % 11 - 5) as shap
                from features join gene_w using (gene), (select unnest(range(1, 6)) as r)),
memberships as (select term, gene from (select unnest(range(0, 10)) as term), (select unnest(range(0, 50)) as gene) where gene % (term + 2) = 0),
core_attribution as (select user_id as patient_id, event_id % 5 as repeat_id, event_type as core,
                     sum(value * case when event_id % 2 = 0 then 1.0::double else -1.0::double end) as signed, sum(abs(value)) as absolute
                     from events where user_id is not null and event_type is not null and value is not null group by all),
targets as (select o_custkey as patient_id, l_partkey as gene, max(l_extendedprice) as priority, count(*) as n_lines, l_partkey % 4 as core
            from lineitem join orders on l_orderkey = o_orderkey group by o_custkey, l_partkey)
"""
