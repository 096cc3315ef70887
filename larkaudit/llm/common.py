"""Helpers that several operators of this package share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words in the contracts of this package: blank, tab and the line ends of ASCII.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows and bytes that Python workers get at once; with long texts Spark's defaults take too much memory.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20

#: A key with more than one in HUBS of all rows is hot.
HUBS = 200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_batches(spark: SparkSession) -> None:
    """Bounds what Python workers get at once, for the whole session: an operator that sends texts to them calls this."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; a temporary one only where all is one process."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not given:
        given = sc._jsc.sc().getCheckpointDir()
        if given.isDefined():
            given = given.get()
        elif sc.master.startswith("local"):
            given = tempfile.mkdtemp(prefix="larkaudit-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(given)
    return given


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, kept in the shared folder so that lost executors cost nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def new_path(spark: SparkSession) -> str:
    """A path of its own in the shared folder."""
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}.parquet"


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The same rows from a Parquet table in the shared folder: columns that a reader leaves out are not read."""
    path = path or new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Removes a table that ``written`` made, once nothing reads it any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is done by shuffling both: for tables that grow with the input.

    Left to itself Spark broadcasts such a table as long as it takes it for small: the driver then
    holds it, and at a join after a join several of them at once.
    """
    return df.hint("merge")


def spread_join(rows: DataFrame, told: DataFrame, key: str | list[str]) -> DataFrame:
    """``rows`` joined with ``told`` (written already), which has each ``key`` once and in n how many rows have it.

    Keys with more than one in HUBS of all rows, fewer than HUBS whatever the size, are broadcast to
    where their rows lie; the others are joined by shuffling, so that no task gets a hot key's rows.
    """
    total, most = told.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    bar = total // HUBS
    if most <= bar:
        return rows.join(shuffled(told.drop("n")), key)
    hubs = F.broadcast(told.where(F.col("n") > bar).drop("n"))
    calm = rows.join(hubs.select(key), key, "left_anti").join(shuffled(told.where(F.col("n") <= bar).drop("n")), key)
    return calm.unionByName(rows.join(hubs, key))


def salted_join(rows: DataFrame, told: DataFrame, key: str | list[str]) -> DataFrame:
    """``spread_join`` without a broadcast: a hot key's rows are dealt into HUBS parts, each of which gets that key's row of ``told``.

    For joins that are made again and again, as in rounds: a broadcast of a few keys takes a page of the
    driver's memory, up to 64 MB, until the driver happens to collect its garbage. Key columns are of the same types on both sides.
    """
    keys = [key] if isinstance(key, str) else key
    total, most = told.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    bar = total // HUBS
    if most <= bar:
        return rows.join(shuffled(told.drop("n")), keys)
    # Fewer than HUBS numbers; a key with the hash of a hot one is dealt likewise, on both sides.
    hot = F.xxhash64(*keys).isin([r[0] for r in told.where(F.col("n") > bar).select(F.xxhash64(*keys)).collect()])
    part = fresh(rows.join(told, keys), "_part")
    dealt = rows.withColumn(part, F.when(hot, F.pmod(F.xxhash64(*rows.columns), F.lit(HUBS))).otherwise(0).cast("int"))
    every = F.when(hot, F.sequence(F.lit(0), F.lit(HUBS - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(shuffled(told.drop("n").withColumn(part, F.explode(every))), [*keys, part]).drop(part)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name in taken:
        name = "_" + name
    return name


def word_count(text: Column) -> Column:
    """Words of a text (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
