"""Runs over parts (such as folds) that can be taken up again: what is whole stays, what is half-written is made anew.

Each table of a part is one partition of a Parquet table. Once all of a part's tables are written,
their rows are counted from what was written, and the counts go to a manifest table. A part is whole if the manifest
has a count for each of its tables, and each partition still holds as many rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_parts"


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _rows(spark: SparkSession, path: str, part: dict) -> DataFrame:
    df = spark.read.parquet(path)
    for k, v in part.items():
        df = df.where(F.col(k) == v)
    return df


def _put(df: DataFrame, path: str, part: dict) -> None:
    """Writes the rows of one part in place of what its partition holds; other partitions stay."""
    rows = df.drop(*part).select("*", *[F.lit(v).alias(k) for k, v in part.items()])
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*part).parquet(path)


def whole_parts(spark: SparkSession, path: str, tables: list[str], keys: list[str]) -> set[tuple]:
    """The parts whose tables are all there with the rows that the manifest tells."""
    folder = f"{path}/{MANIFEST}"
    if not _exists(spark, folder) or not all(_exists(spark, f"{path}/{t}") for t in tables):
        return set()
    told = spark.read.parquet(folder).where(F.col("table").isin(tables))
    there = None
    for t in tables:
        n = spark.read.parquet(f"{path}/{t}").groupBy(*keys).agg(F.count("*").alias("found")).withColumn("table", F.lit(t))
        there = n if there is None else there.unionByName(n)
    # A table of no rows has no partition, so its count is 0 where it is not found.
    both = told.join(there, [*keys, "table"], "left").where(F.coalesce("found", F.lit(0)) == F.col("n_rows"))
    done = both.groupBy(*keys).agg(F.countDistinct("table").alias("n")).where(F.col("n") == len(tables))
    return {tuple(r[k] for k in keys) for r in done.collect()}


def run_parts(spark: SparkSession, path: str, parts: Iterable[dict], tables: list[str], make: Callable[[dict], dict[str, DataFrame]]) -> list[dict]:
    """Makes and writes the tables of each part that is not whole yet, and returns those parts; all parts have the same keys."""
    parts = list(parts)
    if not parts:
        return []
    keys = list(parts[0])
    whole, made = whole_parts(spark, path, tables, keys), []
    for part in parts:
        if tuple(part[k] for k in keys) in whole:
            continue
        found = make(part)
        if sorted(found) != sorted(tables):
            raise ValueError(f"{part}: tables {sorted(found)}, {sorted(tables)} expected")
        for name, df in found.items():
            _put(df, f"{path}/{name}", part)
        counts = [(name, _rows(spark, f"{path}/{name}", part).count()) for name in tables]
        _put(spark.createDataFrame(counts, "table string, n_rows long").coalesce(1), f"{path}/{MANIFEST}", part)
        made.append(part)
    return made
