"""Cutting the lineage of a table that several later steps read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(df: DataFrame) -> str:
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        given = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not given and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(given or tempfile.mkdtemp(prefix="larkaudit-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage, in the folder that spark.checkpoint.dir names; a temporary one only where all is one process."""
    _folder(df)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """The same rows from a compressed Parquet table in that folder: columns that a reader leaves out are not read."""
    path = f"{_folder(df)}/{uuid.uuid4().hex}.parquet"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
