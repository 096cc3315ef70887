"""Modules of features against plain recomputation, and corrections over ranges."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkaudit.functions import ranks
from larkaudit.operators import cluster


def consensus(n=12, ks=(2, 3, 4)):
    r = random.Random(5)
    rows, tables = [], {}
    for k in ks:
        t = np.eye(n)
        for i in range(n):
            for j in range(i + 1, n):
                same = i % k == j % k
                t[i, j] = t[j, i] = round(r.uniform(0.6, 1.0) if same else r.uniform(0.0, 0.3 + 0.1 * k), 3)
                rows.append((k, i, j, float(t[i, j])))
        tables[k] = t
    return rows, tables


@pytest.fixture(scope="module")
def pairs(spark):
    return spark.createDataFrame(consensus()[0], "k int, gene_1 long, gene_2 long, together double")


@pytest.fixture(scope="module")
def found(pairs):
    return cluster.all_modules(pairs)


def labels(found, k):
    return np.array([r["module"] for r in found.where(F.col("k") == k).orderBy("gene").collect()])


def test_modules_are_numbered_along_the_tree(found):
    for k in (2, 3):
        label = labels(found, k)
        assert set(label) == set(range(1, k + 1))
        assert all((label[i] == label[j]) == (i % k == j % k) for i in range(12) for j in range(12))
    assert cluster.leaf_order([(2, 3, 0.1), (0, 1, 0.2), (4, 5, 0.9)], 4) == [2, 3, 0, 1]


def test_measures_equal_plain_sums(pairs, found):
    got = {r["k"]: r for r in cluster.module_metrics(pairs, found).collect()}
    for k, t in consensus()[1].items():
        label = labels(found, k)
        i, j = np.triu_indices(12, 1)
        same = label[i] == label[j]
        widths = []
        for g in range(12):
            means = {m: np.mean([1 - t[g, h] for h in range(12) if h != g and label[h] == m]) for m in set(label) if any(h != g and label[h] == m for h in range(12))}
            a = means.pop(label[g], None)
            widths.append(0.0 if a is None or not means else (min(means.values()) - a) / max(a, min(means.values())))
        sizes = [int((label == m).sum()) for m in set(label)]
        want = (t[i, j][same].mean(), t[i, j][~same].mean(), np.mean((t[i, j] > 0.1) & (t[i, j] < 0.9)), np.mean(widths))
        assert [got[k][c] for c in ("within", "between", "pac", "silhouette")] == pytest.approx(want)
        assert (got[k]["n_small"], got[k]["min_size"]) == (sum(s < 5 for s in sizes), min(sizes))


def test_stability_and_cores_equal_plain_sums(pairs, found):
    t, label = consensus()[1][3], labels(found, 3)
    stable = {r["module"]: r for r in cluster.module_stability(pairs.where("k = 3"), found.where("k = 3")).collect()}
    cores = {r["gene"]: r for r in cluster.stable_cores(pairs.where("k = 3"), found.where("k = 3").select("gene", "module")).collect()}
    for m in (1, 2, 3):
        own = [t[i, j] for i in range(12) for j in range(i) if label[i] == label[j] == m]
        others = [t[i, j] for i in range(12) for j in range(12) if label[i] == m != label[j]]
        assert (stable[m]["within"], stable[m]["least_within"], stable[m]["between"]) == pytest.approx((np.mean(own), min(own), np.mean(others)))
        assert (stable[m]["name"], stable[m]["tier"]) == (f"GapModule_0{m}", "high" if np.mean(own) >= 0.8 and np.mean(own) - np.mean(others) >= 0.5 else "moderate")
    for g in range(12):
        own = [t[g, h] for h in range(12) if h != g and label[h] == label[g]]
        between = max(np.mean([t[g, h] for h in range(12) if label[h] == m]) for m in (1, 2, 3) if m != label[g])
        r = cores[g]
        assert (r["within"], r["median_within"], r["least_within"], r["between"]) == pytest.approx((np.mean(own), np.median(own), min(own), between))
        assert r["eligible"] == bool(np.mean(own) >= 0.6 and between <= 0.25 and np.mean(own) - between >= 0.35)


def test_selection(spark):
    columns = "k int, silhouette double, separation double, pac double, n_small int, min_size int"
    best = lambda rows: cluster.select_k(spark.createDataFrame(rows, columns)).where("selected").first()["k"]
    rows = [(3, 0.9, 0.9, 0.1, 0, 4), (4, 0.5, 0.5, 0.2, 0, 5), (5, 0.6, 0.4, 0.2, 0, 6)]
    assert best(rows) == 5  # 3 has a module of four genes; 4 and 5 have equal sums, 5 the larger silhouette
    assert best([(*r[:5], 2) for r in rows]) == 3
    assert best([(7, None, None, 0.5, 1, 9), (8, None, None, 0.5, 1, 9)]) == 7


def test_concordance(spark):
    a = spark.createDataFrame([(s, g, float(s * (g + 1))) for s in range(1, 5) for g in range(4)], "sample_id long, gene long, shap double")
    found = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 2)], "gene long, module int")
    cores = spark.createDataFrame([(0, 1, True), (1, 1, False), (2, 2, False)], "gene long, module int, eligible boolean")
    (r,) = cluster.core_concordance(cores, a, found).collect()
    assert (r["module"], r["rho"], r["n"]) == (1, pytest.approx(1.0), 4)
    assert (r["mean_parent"], r["mean_core"], r["mean_abs_difference"]) == pytest.approx((7.5, 2.5, 5.0))


def test_correction_over_ranges(spark):
    r = random.Random(3)
    p = [round(r.random() ** 2, 2) for _ in range(3000)]
    got = {x["test"]: x["fdr"] for x in ranks.bh_fdr(spark.createDataFrame([*enumerate(p), (3000, None)], "test long, p double"), "p").collect()}
    order = sorted(range(3000), key=lambda i: p[i])
    least, want = 1.0, {3000: None}
    for i in range(2999, -1, -1):
        least = min(least, p[order[i]] * 3000 / (i + 1))
        want[order[i]] = least
    assert got.keys() == want.keys() and got.pop(3000) is want.pop(3000)
    assert [got[i] for i in range(3000)] == pytest.approx([want[i] for i in range(3000)])


def test_places_and_empty_tables(spark):
    ids = random.Random(4).sample(range(10**6), 500)
    got = {r["v"]: r["place"] for r in ranks.places(spark.createDataFrame([(i,) for i in ids], "v long"), "v").collect()}
    assert got == {v: i for i, v in enumerate(sorted(ids))}
    assert ranks.places(spark.createDataFrame([], "v long"), "v").count() == 0
    assert ranks.bh_fdr(spark.createDataFrame([], "test long, p double"), "p").count() == 0


def test_cores_are_retained_by_folds_tier_and_size(spark):
    genes = [(g, m, 0.9, 0.1, e) for m, n in ((1, 6), (2, 5), (3, 7), (5, 6)) for g, e in [(10 * m + i, i != 0 or m != 2) for i in range(n)]]
    cores = spark.createDataFrame(genes, "gene long, module int, within double, between double, eligible boolean")
    frequency = spark.createDataFrame([(g, 0.1 if g in (10, 50, 51) else 0.2) for g, *_ in genes if g != 36], "gene long, frequency double")
    stability = spark.createDataFrame([(1, "high", 6), (2, "high", 5), (3, "moderate", 7), (5, "low", 6)], "module int, tier string, n_genes long")
    got = {r["gene"]: r["core"] for r in cluster.refined_cores(cores, frequency, stability).collect()}
    # module 1 loses a gene that few folds select and keeps five; module 2 has four; module 3 loses one that no fold selects; module 5 is of a low tier
    assert {g: c for g, c in got.items() if c} == {**{10 + i: "GapCore_01" for i in range(1, 6)}, **{30 + i: "GapCore_02" for i in range(6)}}


def test_consensus_by_blocks_equals_whole_matrices(spark, monkeypatch):
    """Sums over blocks of rows give the modules that resampled whole matrices give; no block holds more than its rows."""
    from larkaudit.operators import cluster

    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 3))
    x = np.hstack([base[:, [i % 3]] + 0.7 * rng.normal(size=(60, 1)) + 100 * i for i in range(8)] + [np.full((60, 1), 0.1)])
    frame = spark.createDataFrame([(5 * i + 2, v.tolist()) for i, v in enumerate(x)], "sample_id long, x array<double>").repartition(5)
    for name, value in (("BLOCK_ROWS", 7), ("BLOCKS_SUMMED", 2), ("DRAWS_AT_ONCE", 5), ("PART_BYTES", 9 * 9 * 8 * 3)):
        monkeypatch.setattr(cluster, name, value)
    got = {(r["k"], r["gene_1"], r["gene_2"]): r["together"] for r in cluster.consensus(frame, [2, 3, 4], 6).collect()}
    want = {}
    for b in range(1, 7):
        g = np.random.default_rng([20260701, b])
        merges = cluster.average_linkage(cluster.distance_of(x[g.integers(0, 60, 48)]))
        for k in (2, 3, 4):
            label = cluster.cut_tree(merges, 9, k)
            for i in range(9):
                for j in range(i + 1, 9):
                    want[k, i, j] = want.get((k, i, j), 0) + (label[i] == label[j]) / 6
    assert got == pytest.approx(want)
