"""Reading embedding columns into packed double-precision vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(df: DataFrame, key: str = "vec_id", column: str = "embedding", unit: bool = False) -> tuple[DataFrame, int]:
    """key and v (binary of doubles) for each row with a usable vector, and the length of vectors.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do those
    of another length than most have, nor rows without a key. With ``unit`` they have length 1.
    """
    v = F.col(column)
    known = df.select(F.col(key), v.cast("array<double>").alias("x")).where(F.col(key).isNotNull() & F.col("x").isNotNull())
    fine = F.forall("x", lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))) & F.exists("x", lambda c: c != 0)
    known = known.where(fine)
    most = known.groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    length = int(most["n"]) if most else 1

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = np.stack(pdf["x"].to_list()).astype(np.float64) if len(pdf) else np.zeros((0, length))
            if unit and len(rows):
                rows = rows / np.abs(rows).max(axis=1, keepdims=True)  # so that no square overflows or vanishes
                rows = rows / np.sqrt((rows**2).sum(axis=1, keepdims=True))
            yield pd.DataFrame({key: pdf[key], "v": [r.tobytes() for r in rows]})

    return known.where(F.size("x") == length).mapInPandas(pack, f"{key} long, v binary"), length


def matrix(column: pd.Series, length: int) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.float64).reshape(-1, length)
