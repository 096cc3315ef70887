"""Removing lines that many sites share, by HyperLogLog sketches of the sites of each line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkaudit.llm.common import cut, fresh, shuffled, spread_join

#: Distinct sites from which a line is boilerplate.
LEAST_SITES = 10
#: Registers of a sketch as a power of two; its relative error is about 1.04 / sqrt(2 ** 11) = 2.3 %.
LOG_REGISTERS = 11
#: Estimates within this part of the threshold, and one more, are counted exactly: over eight standard errors.
NEAR = 0.2


def line_table(docs: DataFrame) -> DataFrame:
    """key (of the document row), doc_id, site, pos, h for each line that is not blank."""
    key = F.xxhash64("doc_id", "text")
    lines = docs.select(key.alias("key"), "doc_id", F.col("source").alias("site"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(F.col("line").rlike(r"\S")).select("key", "doc_id", "site", "pos", F.xxhash64("line").alias("h"))


def boilerplate(lines: DataFrame, least: int = LEAST_SITES) -> DataFrame:
    """h, sites and n (lines) of the lines that at least ``least`` sites have; sites is exact near the threshold, else estimated."""
    sketches = lines.groupBy("h").agg(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS)).alias("sketch"), F.count("*").alias("n"))
    estimates = sketches.where("sketch is not null").select("h", F.hll_sketch_estimate("sketch").alias("sites"), "n").where(F.col("sites") >= least * (1 - NEAR) - 1)
    estimates = cut(estimates)
    far = F.col("sites") > least * (1 + NEAR) + 1
    near = spread_join(lines.where("site is not null").select("h", "site"), cut(estimates.where(~far).select("h", "n")), "h")
    exact = near.distinct().groupBy("h").agg(F.count("*").alias("sites")).where(F.col("sites") >= least)
    return estimates.where(far).unionByName(exact.join(shuffled(estimates.select("h", "n")), "h"))


def clean_lines(docs: DataFrame, least: int = LEAST_SITES) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with boilerplate lines taken out of ``text``, and n_lines and n_removed.

    A line stays where it occurs first, by doc_id and then by place, so that every text survives
    once. Blank lines are never boilerplate; a null source is no site; a null text stays null and
    has 0 lines. Repeated rows are treated alike; an empty table gives no rows. Columns of the
    names n_lines and n_removed are replaced, all others are kept.
    """
    lines = line_table(docs)
    bad = cut(boilerplate(lines, least).select("h", "n"))
    hit = cut(spread_join(lines.select("key", "doc_id", "pos", "h"), bad, "h"))
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "pos")
    first = cut(hit.groupBy("h").agg(F.min(place).alias("first"), F.count("*").alias("n")))
    rest = spread_join(hit, first, "h").where(~((F.col("doc_id").eqNullSafe(F.col("first.doc_id"))) & (F.col("pos") == F.col("first.pos"))))
    key, out = fresh(docs, "_key"), fresh(docs, "_out")
    removed = rest.groupBy("key").agg(F.sort_array(F.collect_set("pos")).alias(out)).withColumnRenamed("key", key)
    joined = docs.drop("n_lines", "n_removed").withColumn(key, F.xxhash64("doc_id", "text")).join(shuffled(removed), key, "left")
    # What is left of a text are the runs of lines between those taken out, so the work is linear in its lines.
    split = F.split("text", "\n")
    ends = F.concat(F.array(F.lit(-1)), F.col(out), F.array(F.size(split)))
    runs = F.zip_with(F.slice(ends, 1, F.size(ends) - 1), F.slice(ends, 2, F.size(ends) - 1), lambda a, b: F.slice(split, a + 2, b - a - 1))
    kept = F.array_join(F.flatten(runs), "\n")
    return (
        joined.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(split)))
        .withColumn("n_removed", F.when(F.col(out).isNull(), 0).otherwise(F.size(out)))
        .withColumn("text", F.when(F.col(out).isNull(), F.col("text")).otherwise(kept))
        .drop(key, out)
    )


def oracle(least: int = LEAST_SITES) -> str:
    return rf"""
    with l as (select doc_id, source, unnest(ls) as line, unnest(range(0, len(ls))) as pos
               from (select doc_id, source, string_split(text, chr(10)) as ls from documents)),
    b as (select line from l where regexp_matches(line, '\S') group by line having count(distinct source) >= {least}),
    f as (select l.*, b.line is not null as bad,
                 row_number() over (partition by l.line order by doc_id, pos) as k from l left join b on l.line = b.line)
    select d.doc_id, cast(coalesce(count(f.pos), 0) as integer) as n_lines,
           cast(count(*) filter (where bad and k > 1) as integer) as n_removed,
           case when d.text is null then null else coalesce(string_agg(f.line, chr(10) order by f.pos) filter (where not (bad and k > 1)), '') end as text
    from documents d left join f on d.doc_id = f.doc_id group by d.doc_id, d.text
    """
