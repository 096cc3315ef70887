import os
import sys

import pytest
from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    folder = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.local.dir", str(folder / "local")).config("spark.checkpoint.dir", str(folder / "shared"))
        .config("spark.sql.warehouse.dir", str(folder / "warehouse")).config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf():
    return SF


def canon(df):
    """Rows of a pandas frame, columns by name, floats rounded, in a fixed order."""
    import pandas as pd

    df = df[sorted(df.columns)]

    def value(x):
        if hasattr(x, "tolist"):
            x = x.tolist()
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        return round(x, 5) + 0.0 if isinstance(x, float) else x

    return sorted([tuple(value(x) for x in r) for r in df.itertuples(index=False)], key=repr)


def duck(sf, sql):
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(sf):
        c.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{sf}/{f}')")
    return c.sql(sql).df()


def close(a, b):
    """Equal but for floats within 2e-5, as roundings at the last place may differ."""
    if len(a) != len(b):
        return False
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            if u == v:
                continue
            if u is None or v is None or isinstance(u, (str, bool)) or abs(float(u) - float(v)) > 2e-5:
                return False
    return True
