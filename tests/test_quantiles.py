"""Exact quantiles of large groups by narrowing ranges, against sorting."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkaudit.functions import quantiles

QS = {"q025": 0.025, "q25": 0.25, "half": 0.5, "q75": 0.75, "most": 1.0}


def made_values():
    r = random.Random(7)
    rows = [("a", r.gauss(0, 1)) for _ in range(4000)] + [("b", float(r.randrange(3))) for _ in range(900)] + [("c", 5.0)] * 700
    rows += [("d", r.random()) for _ in range(30)] + [("e", None)] * 5 + [(None, r.choice([1e300, -1e300, 0.0, r.random()])) for _ in range(1500)]
    return [*rows, ("a", None), ("f", -0.5)]


@pytest.mark.parametrize("limit, accuracy", [(1_000_000, 5000), (60, 40), (60, 500)])
def test_quantiles_of_groups_equal_sorting(spark, monkeypatch, limit, accuracy):
    monkeypatch.setattr(quantiles, "LIMIT", limit)
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rows = made_values()
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r for r in quantiles.exact_quantiles(df, "v", QS, ["g"]).collect()}
    assert got.keys() == {g for g, _ in rows}
    for g in got:
        values = [v for k, v in rows if k == g and v is not None]
        for name, q in QS.items():
            assert got[g][name] is None if not values else got[g][name] == pytest.approx(np.quantile(values, q), abs=1e-12)


@pytest.mark.parametrize("limit", [1_000_000, 100])
def test_quantiles_of_all_rows(spark, monkeypatch, limit):
    monkeypatch.setattr(quantiles, "LIMIT", limit)
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("v"))
    got = quantiles.exact_quantiles(df, "v", {"low": 0.0, "q1": 0.1, "half": 0.5}).first()
    want = sorted(i * 7919 % 5003 for i in range(5000))
    assert (got["low"], got["q1"], got["half"]) == pytest.approx(tuple(np.quantile(want, [0, 0.1, 0.5])))
    empty = quantiles.exact_quantiles(df.limit(0), "v", {"half": 0.5})
    assert empty.collect() in ([], [(None,)])
