"""Exact quantiles of groups of any size, by selection in narrowing ranges of values.

A group of up to LIMIT values goes through Spark's own exact aggregate, which holds its distinct values.
Of a larger group only a range is looked at: approximate quantiles bound the one asked for, the values
below are counted, and the range narrows until what is left in it fits LIMIT. No task ever holds more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkaudit.functions.lineage import cut

#: Distinct values that one task holds at most.
LIMIT = 1_000_000
#: Approximate quantiles are off by one in ACCURACY of the values at most.
ACCURACY = 5_000


def _narrowed(rows: DataFrame, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """``ranges`` (keys, q, low, high, at: the place looked for) of which each holds the place, a few thousandths as wide where they were wide."""
    hit = F.broadcast(ranges)  # as many rows as there are groups beyond LIMIT, times the quantiles: fewer than rows / LIMIT
    within = rows.join(hit, keys).where("_v >= low and _v <= high")
    slack = 2.0 / ACCURACY
    # Quantiles of a range at fixed shares of it: the place is between two neighbouring ones, or their neighbours.
    shares = [i * slack for i in range(int(1 / slack) + 1)]
    edges = within.groupBy(*keys, "q").agg(F.percentile_approx("_v", shares, ACCURACY).alias("_e"), F.count("*").alias("_n"))
    told = ranges.join(edges, [*keys, "q"])
    share = (F.col("at") - F.col("below")) / F.col("_n")
    first = F.floor(share / slack).cast("int")  # element_at counts from 1: this is the edge before it
    low = F.when(first < 1, F.col("low")).otherwise(F.element_at("_e", first))
    high = F.when(first + 3 > len(shares), F.col("high")).otherwise(F.element_at("_e", F.least(first + 3, F.lit(len(shares)))))
    told = cut(told.select(*keys, "q", F.greatest("low", low).alias("low"), F.least("high", high).alias("high"), "at"))
    below = rows.join(F.broadcast(told), keys).where("_v <= high").groupBy(*keys, "q").agg(
        F.sum(F.when(F.col("_v") < F.col("low"), 1).otherwise(0)).alias("below"), F.count("*").alias("_upto"),
        F.approx_count_distinct(F.when(F.col("_v") >= F.col("low"), F.col("_v"))).alias("held"),
    )
    found = told.join(below, [*keys, "q"])
    # The place, and the next one, have to be inside; an approximation that missed them leaves the range as it was.
    fits = (F.col("below") <= F.col("at")) & (F.col("_upto") > F.col("at"))
    return cut(found.withColumn("fits", fits))


def _selected(rows: DataFrame, sizes: DataFrame, qs: list[float], keys: list[str]) -> DataFrame:
    """keys, q, value: the exact values at the places of the quantiles of large groups."""
    asked = F.explode(F.array(*[F.lit(float(q)) for q in qs]))
    h = sizes.withColumn("q", asked).withColumn("_h", (F.col("_n") - 1) * F.col("q"))
    both = F.explode(F.array(F.floor("_h"), F.ceil("_h")))
    places = cut(h.withColumn("at", both).select(*keys, F.col("at").cast("double").alias("q"), F.col("at").cast("long").alias("at")).distinct())
    infinite = float("inf")
    ranges = places.withColumn("low", F.lit(-infinite)).withColumn("high", F.lit(infinite)).withColumn("below", F.lit(0).cast("long"))
    done, rows = [], rows.join(F.broadcast(sizes.select(*keys)), keys, "left_semi") if keys else rows
    for _ in range(20):
        told = _narrowed(rows, ranges, keys)
        ready = told.where(F.col("fits") & ((F.col("held") <= LIMIT) | (F.col("low") == F.col("high"))))
        done.append(ready.select(*keys, "q", "low", "high", "below", "at"))
        left = told.join(ready.select(*keys, "q"), [*keys, "q"], "left_anti")
        missed = left.where(~F.col("fits")).count()
        if left.isEmpty():
            break
        if missed:  # cannot happen within the stated error; look at the whole again rather than answer wrongly
            raise ArithmeticError("an approximate quantile was further off than its stated error")
        ranges = left.select(*keys, "q", "low", "high", "at", "below")
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    held = rows.join(F.broadcast(found), keys).where("_v >= low and _v <= high").groupBy(*keys, "q", "at", "below", "_v").agg(F.count("*").alias("_c"))
    upto = F.col("below") + F.sum("_c").over(Window.partitionBy(*keys, "q").orderBy("_v"))
    at = held.withColumn("_upto", upto).where((F.col("_upto") > F.col("at")) & (F.col("_upto") - F.col("_c") <= F.col("at"))).select(*keys, "at", F.col("_v").alias("value")).distinct()
    low = h.withColumn("at", F.floor("_h")).join(at, [*keys, "at"]).select(*keys, F.col("q"), "_h", F.col("at").alias("_f"), F.col("value").alias("_a"))
    high = h.withColumn("at", F.ceil("_h")).join(at, [*keys, "at"]).select(*keys, "q", F.col("value").alias("_b"))
    value = F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_h") - F.col("_f"))
    return low.join(high, [*keys, "q"]).select(*keys, "q", value.alias("value"))


def exact_quantiles(df: DataFrame, value: str, qs: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """keys and one column for each of ``qs`` (name: share): linear between the two nearest values, as sorting would give.

    Null values do not count; a group without any has nulls. Keys may be null.
    """
    keys = keys or []
    names = [f"_k{i}" for i in range(len(keys))]
    rows = cut(df.select(*[F.struct(F.col(k)).alias(n) for k, n in zip(keys, names, strict=True)], F.col(value).cast("double").alias("_v")))
    sizes = rows.groupBy(*names).agg(F.count("_v").alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    back = [F.col(n)[k].alias(k) for k, n in zip(keys, names, strict=True)]
    whole = rows.groupBy(*names).agg(*[F.percentile("_v", q).alias(c) for c, q in qs.items()])
    if most <= LIMIT:
        return whole.select(*back, *qs)
    sizes = cut(sizes)
    large, known = sizes.where(F.col("_n") > LIMIT), rows.where(F.col("_v").isNotNull())
    if not keys:
        large, known, names = large.withColumn("_k", F.lit(0)), known.withColumn("_k", F.lit(0)), ["_k"]
    picked = _selected(known, large, list(qs.values()), names)
    wide = picked.groupBy(*names).agg(*[F.max(F.when(F.col("q") == float(q), F.col("value"))).alias(c) for c, q in qs.items()])
    if not keys:
        return wide.select(*qs)
    small = rows.join(F.broadcast(large.select(*names)), names, "left_anti").groupBy(*names).agg(*[F.percentile("_v", q).alias(c) for c, q in qs.items()])
    return wide.unionByName(small).select(*back, *qs)
