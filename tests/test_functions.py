import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkaudit.functions import ranks, text
from larkaudit.operators import attribution, cluster, metrics, models, relational, states, stats, targets


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).orderBy(*cols).collect()]


def test_average_ranks(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 2.0, 3.0, None])], "id long, v double")
    assert rows(ranks.rank_pct(df, "v"), "id", "pct") == [(0, 0.25), (1, 0.625), (2, 0.625), (3, 1.0), (4, None)]
    keyed = df.withColumn("k", F.col("id") % 2)
    assert rows(ranks.rank_pct(keyed, "v", ["k"]), "id", "pct") == [(0, 0.5), (1, 0.5), (2, 1.0), (3, 1.0), (4, None)]


def test_global_ranks_equal_sorting(spark):
    values = [float((i * 7919) % 101) for i in range(500)]
    got = dict(rows(ranks.average_ranks(spark.createDataFrame(list(enumerate(values)), "id long, v double"), "v"), "id", "avg_rank"))
    order = sorted(values)
    for i, v in enumerate(values):
        assert got[i] == order.index(v) + (order.count(v) + 1) / 2


def test_cut_is_right_closed(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.25, 0.250001, 0.75, 1.0)], "v double")
    assert [r[0] for r in df.select(ranks.cut(F.col("v"), [0.0, 0.25, 0.75, 1.0], ["lower", "mid", "upper"])).collect()] == ["lower", "lower", "mid", "mid", "upper"]


def test_bh(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.005, None])], "test long, p double")
    assert [r[1] if r[1] is None else round(r[1], 9) for r in rows(ranks.bh_fdr(df, "p"), "test", "fdr")] == [0.02, 0.04, 0.04, 0.02, None]


def test_minmax_of_equal_values(spark):
    df = spark.createDataFrame([(1, 3.0), (1, 3.0), (2, 0.0), (2, 4.0)], "k long, v double")
    assert sorted(r[0] for r in df.select(ranks.minmax("v", ["k"])).collect()) == [0.0, 0.5, 0.5, 1.0]


def test_sign_changes(spark):
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate([1, 0, -1, -1, 1])] + [(2, 0, 0.0)], "k long, o long, v double")
    assert rows(ranks.sign_changes(df, "v", ["k"], "o"), "k", "sign_changes") == [(1, 2), (2, 0)]


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0, 0.1), (1, 0, 0.5), (1, 1, 0.5), (1, 1, 0.9)], "k long, y int, p double")
    assert metrics.auc(df, ["k"]).first()["roc_auc"] == 0.875


def test_identifiers(spark):
    df = spark.createDataFrame([(" tcga.ab.1234.01a ", " na ", "a|b, -;c"), (None, None, None)], "b string, s string, l string")
    c = F.col("b")
    r = df.select(text.barcode(c), text.patient_of(c), text.sample_type(c), text.is_primary(c), text.clean_symbol(F.col("s")), text.split_symbols(F.col("l"))).collect()
    assert tuple(r[0]) == ("TCGA-AB-1234-01A", "TCGA-AB-1234", "01", True, None, ["A", "B", "C"])
    assert tuple(r[1])[:3] == (None, None, None)


def test_key_values(spark):
    df = spark.createDataFrame([("Node: N1=x",), ("a = b",), ("plain",)], "t string")
    assert [tuple(r[0]) for r in df.select(text.key_value(F.col("t"), F.lit("c1"))).collect()] == [("node", "N1=x"), ("a", "b"), ("c1", "plain")]


def test_provenance(spark):
    v, s = text.coalesce_with_source(existing=F.col("a"), reconstructed=F.col("b"))
    df = spark.createDataFrame([("x", "y"), (None, "y"), (None, None)], "a string, b string")
    assert [tuple(r) for r in df.select(v, s).collect()] == [("x", "existing"), ("y", "reconstructed"), (None, "unresolved")]


def test_allocation(spark):
    sets = spark.createDataFrame([("A", 1), ("B", 1), ("A", 2)], "term string, gene long")
    shap = spark.createDataFrame([(1, 1, 1, 0.4), (1, 1, 2, -0.2), (1, 1, 3, 0.1)], "sample_id long, repeat_id long, gene long, shap double")
    w = attribution.edges(sets)
    assert [(t, round(v, 9) + 0.0) for t, v in rows(attribution.allocate(shap, w), "term", "term_shap")] == [("A", 0.0), ("B", 0.2)]
    c = attribution.completeness(shap, w).first()
    assert c["residual"] == pytest.approx(0.1) and c["coverage"] == pytest.approx(0.6 / 0.7)
    assert attribution.reconstruction_error(shap, w).first()["max_error"] < 1e-12


def test_fuzzy_states(spark):
    data = [(1, "a", 0.9), (1, "b", 0.8), (1, "c", 0.1), (2, "a", 0.9), (2, "b", 0.5), (2, "c", 0.1), (3, "a", 0.8), (3, "b", 0.7), (3, "c", 0.1), (4, "a", 0.2), (4, "b", 0.1), (4, "c", 0.25)]
    got = states.fuzzy_states(spark.createDataFrame(data, "u long, core string, positive double"), ["u"])
    assert rows(got, "u", "state") == [(1, "shared_high__a__b"), (2, "dominant__a"), (3, "blended_intermediate"), (4, "shared_low")]


def test_jaccard_counts_pairs_without_overlap(spark):
    s = spark.createDataFrame([(1, 1), (1, 2), (2, 2), (2, 3), (3, 9)], "patient_id long, gene long")
    r = targets.set_metrics(s).first()
    assert r["mean_jaccard"] == pytest.approx(1 / 9) and r["max_recurrence"] == pytest.approx(2 / 3)


def test_densify_and_unique(spark):
    f = spark.createDataFrame([(1, "a", 2.0)], "p long, c string, v double")
    grid = relational.densify(f, [spark.createDataFrame([(1,), (2,)], "p long"), spark.createDataFrame([("a",), ("b",)], "c string")], ["p", "c"], ["v"])
    assert rows(grid, "p", "c", "v") == [(1, "a", 2.0), (1, "b", 0.0), (2, "a", 0.0), (2, "b", 0.0)]
    with pytest.raises(relational.AuditError):
        relational.assert_unique(f.unionByName(f), ["p"])


def test_fallback_join(spark):
    a, b = spark.createDataFrame([("x 1", 1)], "k string, l long"), spark.createDataFrame([("x1", 2)], "k string, r long")
    assert relational.fallback_join(a, b, "k").select("l", "r").first() == (1, 2)


def test_tail_probabilities():
    assert stats.chi2_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert stats.chi2_tail(18.307038053275146, 10) == pytest.approx(0.05)
    assert stats.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05)
    assert stats.f_tail(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert stats.normal_two_sided(1.959963984540054) == pytest.approx(0.05)


def test_cliffs_delta(spark):
    df = spark.createDataFrame([(True, 3.0), (True, 4.0), (False, 1.0), (False, 2.0)], "f boolean, v double")
    r = stats.mann_whitney(df, [], "f", "v").first()
    assert (r["u"], r["cliffs_delta"]) == (4.0, 1.0)


def test_tests_have_p_values(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    k = stats.kruskal(e, [], "event_type", "value", least=10)
    p = k.select(stats.chi2_p(F.col("h"), F.col("n_groups") - 1)).first()[0]
    assert 0 <= p <= 1
    s = stats.with_rho_p(stats.spearman(e, ["event_type"], "value", "user_id"))
    assert all(0 <= r["p_value"] <= 1 for r in s.collect())


def test_tree_shapley_values_equal_brute_force():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((60, 4))
    y = (x[:, 0] + x[:, 1] * x[:, 2] > 0).astype(float)
    tree = models.Tree(x, y, np.ones(60), rng, 5, 4)

    def value(node, row, known):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        left, right = tree.left[node], tree.right[node]
        if f in known:
            return value(left if row[f] <= tree.cut[node] else right, row, known)
        return (tree.cover[left] * value(left, row, known) + tree.cover[right] * value(right, row, known)) / tree.cover[node]

    for row in x[:5]:
        want = np.zeros(4)
        for f in range(4):
            rest = [g for g in range(4) if g != f]
            for n in range(4):
                for known in itertools.combinations(rest, n):
                    share = math.factorial(n) * math.factorial(3 - n) / math.factorial(4)
                    want[f] += share * (value(0, row, {*known, f}) - value(0, row, {*known}))
        assert np.allclose(tree.shap(row), want, atol=1e-9)


def test_average_linkage():
    d = np.array([[0, 1, 6, 7], [1, 0, 5, 8], [6, 5, 0, 2], [7, 8, 2, 0]], float)
    merges = cluster.average_linkage(d)
    assert merges == [(0, 1, 1.0), (2, 3, 2.0), (4, 5, 6.5)]
    assert cluster.cut_tree(merges, 4, 2).tolist() == [0, 0, 1, 1]
    assert cluster.cut_tree(merges, 4, 3).tolist() == [0, 0, 1, 2]


def test_logistic_separates():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((200, 3))
    y = (x[:, 0] > 0).astype(float)
    coef, c = models.fit_logistic(x, y, 0.001, 0.001)
    assert (((x @ coef + c) > 0) == (y == 1)).mean() > 0.95


def test_median_fill(spark):
    df = spark.createDataFrame([("g", True, 1.0), ("g", True, 3.0), ("g", False, None), ("g", False, float("inf"))], "gene string, train boolean, value double")
    assert sorted(r["value"] for r in models.training_median(df, ["gene"]).collect()) == [1.0, 2.0, 2.0, 3.0]


def test_recommendation_confidence(spark):
    df = spark.createDataFrame([(1.0, 0.0, 1.0, 40), (0.5, 0.5, 0.5, 5), (None, 0.5, 0.5, 5)], "c double, u double, p double, n long")
    score, label = states.recommendation_confidence(F.col("c"), F.col("u"), F.col("p"), F.col("n"))
    got = df.select(score.alias("s"), label.alias("l")).collect()
    assert [(r["s"] and round(r["s"], 9), r["l"]) for r in got] == [(1.0, "high"), (0.45, "low"), (None, None)]


def test_flipped_contrasts(spark):
    e = spark.createDataFrame([("a", float(i)) for i in range(10)] + [("b", float(i) + 5) for i in range(12)], "g string, v double")
    tests = stats.pairwise(e, [], "g", "v").drop("z")
    one = tests.first()
    back = stats.flip_contrasts(tests, spark.createDataFrame([("b", "a")], "group_1 string, group_2 string")).first()
    assert (back["n_1"], back["n_2"], back["cliffs_delta"], back["flipped"]) == (12, 10, -one["cliffs_delta"], True)
    assert back["u"] == 120 - one["u"]


def test_size_adjusted_sets(spark):
    sets = [("a", 10, 1.0, 0.5), ("b", 100, 10.0, None), ("c", 1000, 100.0, 1.0), ("d", 60, 60.0, 0.0), ("e", 2000, 0.0, 1.0)]
    got = {r["term"]: r for r in attribution.size_adjusted(spark.createDataFrame(sets, "term string, size long, mean_abs double, cv double")).collect()}
    x, y = np.log10([10, 100, 1000, 60]), np.log10([1, 10, 100, 60])
    slope, intercept = np.polyfit(x, y, 1)
    assert [got[t]["residual"] for t in "abcd"] == pytest.approx(y - (intercept + slope * x), abs=1e-8)
    assert got["e"]["residual"] == pytest.approx(-15 - (intercept + slope * np.log10(2000)), abs=1e-8)
    assert [got[t]["size_class"] for t in "abcde"] == ["10_to_50", "51_to_200", "501_to_1000", "51_to_200", "greater_than_1000"]
    assert [got[t]["weight"] for t in "abcd"] == pytest.approx([1 / 1.5, 1 / 1.75, 0.5, 1], abs=1e-8)
    assert [got[t]["raw_rank"] for t in "abcde"] == [4, 3, 1, 2, 5] and got["d"]["adjusted_rank"] == 1
    assert all(r["rank_change"] == r["adjusted_rank"] - r["raw_rank"] for r in got.values())


@pytest.mark.parametrize("most", [12, 2])
def test_shapley_values_of_many_rows_equal_those_of_each(monkeypatch, most):
    from larkaudit.operators import models

    monkeypatch.setattr(models, "MOST_PATTERN", most)
    monkeypatch.setattr(models, "SHAP_ROWS", 17)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 6)).round(1)
    y = (x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=200) > 0).astype(float)
    tree = models.Tree(x, y, np.ones(200), rng, 3, 3)
    assert np.allclose(tree.shap_rows(x[:50]), [tree.shap(row) for row in x[:50]], atol=1e-12)
    assert tree.shap_rows(x[:0]).shape == (0, 6)


def test_out_of_fold_ships_chosen_features_and_equals_plain_fits(spark):
    r = np.random.default_rng(5)
    y = np.arange(60) % 2
    x = r.normal(size=(60, 7))
    x[:, 1] += y
    x[:, 4] -= 2 * y
    x[:, 6] = 0.1
    x[r.random(x.shape) < 0.05] = np.nan
    vectors = spark.createDataFrame([(i, [None if np.isnan(v) else float(v) for v in row]) for i, row in enumerate(x)], "sample_id long, x array<double>")
    folds = models.stratified_folds(spark.createDataFrame(list(enumerate(y.tolist())), "sample_id long, y int"), "sample_id", "y", 3, 1)
    fold = np.array([row["fold_id"] for row in folds.orderBy("sample_id").collect()])
    made = models.out_of_fold(vectors, folds, trees=3, k=3)
    assert "FlatMapGroupsInArrow" in made._jdf.queryExecution().executedPlan().toString()  # k numbers a row, not whole vectors
    found = {(row["model"], row["sample_id"]): row["p"] for row in made.collect()}
    assert len(found) == 120
    for held in range(3):
        out = fold == held
        m = np.where(np.isnan(x), np.nanmedian(x[~out], axis=0), x)
        a, b = m[~out & (y == 1)], m[~out & (y == 0)]
        f = (a.mean(axis=0) - b.mean(axis=0)) ** 2 / (a.var(axis=0) * len(a) + b.var(axis=0) * len(b) + 1e-12)
        m = m[:, np.sort(np.argsort(-f, kind="stable")[:3])]
        forest = models.fit_forest(m[~out], y[~out], 3, 3, 20260701 + 100 + held)
        z = (m - m[~out].mean(axis=0)) / (m[~out].std(axis=0) + 1e-12)
        coef, c = models.fit_logistic(z[~out], y[~out].astype(float), 0.005, 0.005)
        p, q = np.mean([t.predict(m[out]) for t in forest], axis=0), 1 / (1 + np.exp(-(z[out] @ coef + c)))
        assert [found["extratrees", int(i)] for i in np.flatnonzero(out)] == pytest.approx(p.tolist())
        assert [found["logistic", int(i)] for i in np.flatnonzero(out)] == pytest.approx(q.tolist())
