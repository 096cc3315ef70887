"""Measures of binary predictions (y 0/1, p), by group keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkaudit.functions.lineage import cut
from larkaudit.functions.quantiles import exact_quantiles
from larkaudit.functions.ranks import average_ranks, first_rank


def auc(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """roc_auc by keys from average ranks, so that ties count half; null with one class only."""
    ranked = average_ranks(df.select(*keys, y, p), p, keys, "_r", "_n")
    g = ranked.groupBy(*keys).agg(F.sum(F.when(F.col(y) == 1, F.col("_r"))).alias("_s"), F.sum(y).cast("double").alias("_p"), F.sum(1 - F.col(y)).cast("double").alias("_q"))
    return g.select(*keys, F.try_divide(F.col("_s") - F.col("_p") * (F.col("_p") + 1) / 2, F.col("_p") * F.col("_q")).alias("roc_auc"))


def roc_points(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """Every distinct threshold with tp, fp, tpr, fpr, specificity and youden."""
    g = df.groupBy(*keys, F.col(p).alias("threshold")).agg(F.sum(y).cast("long").alias("_p"), F.sum(1 - F.col(y)).cast("long").alias("_q"))
    down = Window.partitionBy(*keys).orderBy(F.desc("threshold"))
    whole = Window.partitionBy(*keys)
    g = g.withColumn("tp", F.sum("_p").over(down)).withColumn("fp", F.sum("_q").over(down))
    g = g.withColumn("tpr", F.try_divide("tp", F.sum("_p").over(whole))).withColumn("fpr", F.try_divide("fp", F.sum("_q").over(whole)))
    return g.select(*keys, "threshold", "tp", "fp", "tpr", "fpr", (1 - F.col("fpr")).alias("specificity"), (F.col("tpr") - F.col("fpr")).alias("youden"))


def average_precision(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    points = roc_points(df, keys, y, p)
    before = F.coalesce(F.lag("tpr").over(Window.partitionBy(*keys).orderBy(F.desc("threshold"))), F.lit(0.0))
    points = points.withColumn("_d", F.col("tpr") - before)
    return points.groupBy(*keys).agg(F.sum(F.col("_d") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"))


def at_threshold(df: DataFrame, keys: list[str], threshold="threshold", y: str = "y", p: str = "p") -> DataFrame:
    """tn, fp, fn, tp and the rates made of them, with p >= threshold as positive."""
    hit = F.col(p) >= F.col(threshold)
    one = F.col(y) == 1
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    g = df.groupBy(*keys).agg(n(~one & ~hit).alias("tn"), n(~one & hit).alias("fp"), n(one & ~hit).alias("fn"), n(one & hit).alias("tp"))
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    g = g.withColumn("recall", F.try_divide(tp, tp + fn)).withColumn("specificity", F.try_divide(tn, tn + fp)).withColumn("precision", F.try_divide(tp, tp + fp))
    return (
        g.withColumn("npv", F.try_divide(tn, tn + fn))
        .withColumn("accuracy", F.try_divide(tp + tn, tp + tn + fp + fn))
        .withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2)
        .withColumn("f1", F.try_divide(2 * tp, 2 * tp + fp + fn))
        .withColumn("youden", F.col("recall") + F.col("specificity") - 1)
    )


def losses(df: DataFrame, keys: list[str], y: str = "y", p: str = "p") -> DataFrame:
    q = F.least(F.greatest(F.col(p), F.lit(1e-7)), F.lit(1 - 1e-7))
    return df.groupBy(*keys).agg(
        F.avg((F.col(p) - F.col(y)) ** 2).alias("brier"),
        F.avg(-(F.col(y) * F.log(q) + (1 - F.col(y)) * F.log(1 - q))).alias("log_loss"),
        F.count("*").alias("n"),
    )


def binary_metrics(df: DataFrame, keys: list[str], threshold: float = 0.5, y: str = "y", p: str = "p") -> DataFrame:
    """All measures by keys."""
    fixed = df.withColumn("threshold", F.lit(threshold))
    out = auc(df, keys, y, p).join(average_precision(df, keys, y, p), keys).join(at_threshold(fixed, keys, y=y, p=p), keys)
    return out.join(losses(df, keys, y, p), keys).withColumn("threshold", F.lit(threshold))


def threshold_sweep(df: DataFrame, keys: list[str], grid: list[float], y: str = "y", p: str = "p") -> DataFrame:
    """``at_threshold`` for every threshold of a grid, which is a short array in each row."""
    swept = df.select(*keys, y, p, F.explode(F.array(*[F.lit(float(t)) for t in grid])).alias("threshold"))
    return at_threshold(swept, [*keys, "threshold"], y=y, p=p)


def best_threshold(swept: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """The first threshold with the largest measure."""
    return swept.withColumn("_k", first_rank(keys, F.desc_nulls_last(measure), F.asc("threshold"))).where("_k = 1").drop("_k")


def calibration_bins(df: DataFrame, keys: list[str], bins: int = 10, y: str = "y", p: str = "p") -> DataFrame:
    """Quantile bins: mean p and observed share; a p that is equal to an edge stays below it."""
    df = cut(df.select(*keys, y, p))
    q = exact_quantiles(df, p, {f"_e{i}": i / bins for i in range(1, bins)}, keys)
    edges = q.select(*keys, F.array(*[f"_e{i}" for i in range(1, bins)]).alias("_e"))
    b = df.join(F.broadcast(edges), keys).withColumn("bin", F.size(F.filter("_e", lambda e: e < F.col(p))).cast("long"))  # one row a group of keys
    g = b.groupBy(*keys, "bin").agg(F.count("*").alias("n"), F.avg(p).alias("mean_p"), F.avg(F.col(y).cast("double")).alias("observed"))
    return g.withColumn("residual", F.col("observed") - F.col("mean_p"))
