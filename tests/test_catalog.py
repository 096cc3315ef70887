"""Every query of the audit against its SQL on the smallest tables."""

import pytest
from conftest import canon, close, duck

from larkaudit.plans import catalog

NO_SQL = sorted(set(catalog.queries()) - set(catalog.oracle_sql()))


@pytest.fixture(scope="module", autouse=True)
def made_once():
    """The consensus and the models of folds are made once for all queries that read them."""
    kept, before = {}, {name: getattr(catalog, name) for name in ("_consensus", "_net")}

    def once(name):
        return lambda spark, d: kept[name] if name in kept else kept.setdefault(name, before[name](spark, d))

    for name in before:
        setattr(catalog, name, once(name))
    yield
    for name, f in before.items():
        setattr(catalog, name, f)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    ours = catalog.queries()[name](spark, sf).toPandas()
    theirs = duck(sf, catalog.oracle_sql()[name])
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert close(canon(ours), canon(theirs))


#: The given vectors are too random for stable cores; tests/test_cluster.py has rows that form some.
WITHOUT_CORES = {"core_concordance"}


@pytest.mark.parametrize("name", sorted(set(NO_SQL) - WITHOUT_CORES))
def test_query_without_sql_gives_rows(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


@pytest.mark.parametrize("name", sorted(WITHOUT_CORES))
def test_query_without_cores_keeps_its_columns(spark, sf, name):
    assert catalog.queries()[name](spark, sf).columns == ["module", "mean_parent", "mean_core", "mean_abs_difference", "rho", "n", "p_value"]


def test_shapley_values_add_up(spark, sf):
    assert catalog.queries()["tree_shap_additivity"](spark, sf).agg({"max_error": "max"}).first()[0] < 1e-9


def test_null_comparison(spark):
    from larkaudit.operators import targets

    nulls = spark.createDataFrame([("m", float(v)) for v in (1, 2, 3, 4)], "metric string, value double")
    r = targets.null_compare(nulls, spark.createDataFrame([("m", 3.0)], "metric string, value double")).first()
    assert (r["p_upper"], r["p_lower"]) == (pytest.approx(0.6), pytest.approx(0.8))
