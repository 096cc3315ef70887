"""Keyed permutations, scores over dense rows, permutation nulls and overlap of sets: against plain loops and by chi-square."""

import collections
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from larkaudit.functions import permute
from larkaudit.operators import attribution, nulls, scores, targets

# --- permutations --------------------------------------------------------------------------------


def images(n, seeds):
    """Rows of permutations, a column for each place."""
    return np.stack([permute.permuted(np.full(len(seeds), i), n, seeds) for i in range(n)], axis=1)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_each_permutation_is_one(n):
    for perm in range(6):
        assert sorted(permute.permuted(np.arange(n), n, permute.seed(17, perm)).tolist()) == list(range(n))


@pytest.mark.parametrize("n", [2, 3, 4])
def test_all_permutations_are_equally_likely(n):
    rows = 24_000
    found = collections.Counter(map(tuple, images(n, permute.seed(np.full(rows, 5), np.arange(1, rows + 1))).tolist()))
    kinds = list(itertools.permutations(range(n)))
    chi = sum((found[k] - rows / len(kinds)) ** 2 / (rows / len(kinds)) for k in kinds)
    free = len(kinds) - 1
    assert chi < free + 4 * (2 * free) ** 0.5 + 4


@pytest.mark.parametrize("seeds", [permute.seed(np.full(5000, 9), np.arange(5000)), permute.seed(np.arange(5000), 3)])
def test_places_and_pairs_of_places_are_uniform(seeds):
    n = 50
    to = images(n, seeds)
    each = np.stack([np.bincount(c, minlength=n) for c in to.T])
    free, want = (n - 1) ** 2, len(seeds) / n
    assert abs(((each - want) ** 2 / want).sum() - free) < 5 * (2 * free) ** 0.5
    pairs = np.bincount((to[:, 0] - to[:, 1]) % n, minlength=n)[1:]  # neighbours do not stay neighbours
    want = len(seeds) / (n - 1)
    assert ((pairs - want) ** 2 / want).sum() < n - 2 + 5 * (2 * (n - 2)) ** 0.5


def test_places_within_groups_of_any_size(spark, monkeypatch):
    monkeypatch.setattr(permute, "STRIDE", 16)
    r = random.Random(1)
    ids = r.sample(range(10**6), 900)
    rows = [(0 if i % 3 else r.randrange(50), v) for i, v in enumerate(ids)] + [(r.randrange(60, 70), v) for v in ids[:200]]
    got = {(x["g"], x["v"]): (x["place"], x["n"]) for x in permute.local_places(spark.createDataFrame(rows, "g long, v long"), ["g"], "v").collect()}
    want = collections.defaultdict(list)
    for g, v in rows:
        want[g].append(v)
    assert got == {(g, v): (i, len(vs)) for g, vs in want.items() for i, v in enumerate(sorted(vs))}
    assert permute.local_places(spark.createDataFrame([], "g long, v long"), ["g"], "v").count() == 0


# --- scores --------------------------------------------------------------------------------------

GENES = [(g, round(g % 7 / 7, 3), round(g % 5 / 5, 3), float(g % 4)) for g in range(3, 40, 2)]
ENTRY = "patient_id long, gene long, core long, absolute double, repeat_support double, sign_support double"


def made_entries():
    """Patients with some genes, all of them, zeros, equal values, and only zeros."""
    r, genes = random.Random(4), [g for g, *_ in GENES]
    rows = []
    for p in range(14):
        own = genes if p in (1, 2) else r.sample(genes, r.randint(1, len(genes) - 1))
        for g in own:
            value = {2: 1.0, 3: 0.0, 4: r.choice([0.0, 1.0])}.get(p, r.choice([0.0, 0.5, r.random()]))
            rows.append((p, g, g % 3, value, round(r.random(), 3), round(r.random(), 3)))
    return rows


def plain_scores(rows):
    """(patient, gene) -> score over the whole matrix, gene by gene."""
    genes = sorted(GENES)
    low, high = min(g[3] for g in genes), max(g[3] for g in genes)
    out = {}
    for p in {r[0] for r in rows}:
        has = {r[1]: r[3:] for r in rows if r[0] == p}
        values = [has.get(g[0], (0.0, 0, 0))[0] for g in genes]
        order = sorted(range(len(genes)), key=lambda i: (values[i], i))
        for i, (gene, idf, fold, margin) in enumerate(genes):
            absolute, rep, sign = has.get(gene, (0.0, 0.0, 0.0))
            wide = max(values) - min(values)
            scaled = (absolute - min(values)) / wide if wide else 0
            support = 0.5 * rep + 0.25 * sign + 0.25 * fold
            out[p, gene] = 0.35 * scaled + 0.2 * (order.index(i) + 1) / len(genes) + 0.2 * support + 0.1 * (margin - low) / (high - low) + 0.15 * idf
    return out


def test_dense_rows_and_present_scores_equal_plain_ones(spark):
    rows = made_entries()
    e, genes = spark.createDataFrame(rows, ENTRY), spark.createDataFrame(GENES, "gene long, idf double, fold_frequency double, margin double")
    want, names = plain_scores(rows), sorted(g for g, *_ in GENES)
    dense = {(r["patient_id"], names[i]): s for r in scores.dense_rows(e, genes).collect() for i, s in enumerate(r["scores"])}
    assert dense == pytest.approx(want)
    present = {(r["patient_id"], r["gene"]): r["score"] for r in scores.present_scores(e, genes).collect()}
    assert present == pytest.approx({k: want[k] for k in ((r[0], r[1]) for r in rows)}, abs=1e-8)
    keyed = scores.present_scores(e.withColumn("perm", F.explode(F.array(F.lit(1), F.lit(2)))), genes, ["perm"])
    assert keyed.count() == 2 * len(rows) and {(r["patient_id"], r["gene"]): r["score"] for r in keyed.where("perm = 2").collect()} == present
    assert scores.dense_rows(e.limit(0), genes).count() == 0 and scores.present_scores(e.limit(0), genes).count() == 0


def test_best_targets_of_one_sort_equal_those_of_windows(spark):
    rows = made_entries()
    e, genes = spark.createDataFrame(rows, ENTRY), spark.createDataFrame(GENES, "gene long, idf double, fold_frequency double, margin double")
    odd = e.unionByName(e.where("patient_id = 1").withColumn("patient_id", F.lit(None).cast("long"))).unionByName(
        e.withColumn("patient_id", F.col("patient_id") + 100).withColumn("absolute", F.when(F.col("gene") % 3 > 0, F.col("absolute") * (F.col("gene") % 2)))
    )
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")  # patients go on over batches
    try:
        for table, k in ((e, 4), (odd, 2), (odd, 20), (e.limit(0), 4)):
            best = scores.best_present(table, genes, k)
            want = scores.best_targets(scores.present_scores(table, genes), k).select(best.columns)
            key = lambda r: (r["patient_id"] is None, r["patient_id"] or 0, r["rank"])
            assert sorted(best.collect(), key=key) == sorted(want.collect(), key=key)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    plan = scores.best_present(e, genes)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Sort [") == 1


def test_too_many_genes_are_an_error(spark, monkeypatch):
    monkeypatch.setattr(scores, "MOST_GENES", 5)
    with pytest.raises(ValueError, match="present genes"):
        scores.dense_rows(spark.createDataFrame(made_entries(), ENTRY), spark.createDataFrame(GENES, "gene long, idf double, fold_frequency double, margin double"))


@pytest.mark.parametrize("null, group", [(scores.null_within_genes, lambda r: r["gene"]), (scores.null_within_cores, lambda r: (r["patient_id"], r["core"]))])
def test_nulls_deal_values_within_their_groups(spark, null, group):
    e = spark.createDataFrame(made_entries(), ENTRY)
    before, moved = e.collect(), null(e, 30).collect()
    values = lambda rows: {g: sorted(tuple(r)[-3:] for r in rows if group(r) == g) for g in {group(r) for r in rows}}
    changed = set()
    for perm in range(1, 31):
        now = [r for r in moved if r["perm"] == perm]
        assert sorted((r["patient_id"], r["gene"], r["core"]) for r in now) == sorted((r["patient_id"], r["gene"], r["core"]) for r in before)
        assert values(now) == values(before)
        changed.add(tuple(sorted((r["patient_id"], r["gene"], r["sign_support"]) for r in now)))
    assert len(changed) == 30


# --- nulls of attributions -----------------------------------------------------------------------


def made_units(n_genes=9):
    r = random.Random(6)
    shap = [(s, k, g * 3, round(r.uniform(-1, 1), 4)) for s in range(5) for k in (1, 2) for g in range(n_genes)] + [(9, 1, g * 3, 0.0) for g in range(n_genes)]
    edges = [(t, g * 3) for t in range(4) for g in range(n_genes - 2) if (g + t) % (t + 2) == 0]
    return shap, edges


def plain_measures(shap, edges, label, top):
    """residual, coverage and top fraction of each unit when column g bears label(repeat, g)."""
    degree, out = collections.Counter(g for _, g in edges), {}
    for unit in {u[:2] for u in shap}:
        mass = collections.Counter()
        own = [(label(unit[1], g), v) for s, k, g, v in shap if (s, k) == unit]
        for g, v in own:
            for t, e in edges:
                if e == g:
                    mass[t] += v / degree[g]
        size, sets = sum(abs(v) for _, v in own), sorted((abs(m) for m in mass.values()), reverse=True)
        covered = sum(abs(v) for g, v in own if degree[g])
        out[unit] = (sum(v for g, v in own if not degree[g]), covered / size if size else 0, sum(sets[:top]) / sum(sets) if sum(sets) else 0)
    return out


@pytest.mark.parametrize("numbers", [4_000_000, 20])
def test_mapping_nulls_equal_plain_ones(spark, monkeypatch, numbers):
    monkeypatch.setattr(nulls, "BLOCK_NUMBERS", numbers)
    shap, edges = made_units()
    genes = sorted({g for *_, g, _ in shap})
    a = spark.createDataFrame(shap, "sample_id long, repeat_id long, gene long, shap double")
    weighted = attribution.edges(spark.createDataFrame(edges, "term long, gene long"))
    got = {(r["perm"], r["sample_id"], r["repeat_id"]): (r["residual"], r["coverage"], r["top_fraction"]) for r in nulls.mapping_null(a, weighted, 12, 2).collect()}
    want = {}
    for perm in range(1, 13):
        to = {k: permute.permuted(np.arange(len(genes)), len(genes), permute.seed(k, perm)) for k in (1, 2)}
        for unit, m in plain_measures(shap, edges, lambda k, g, to=to: genes[to[k][genes.index(g)]], 2).items():
            want[perm, *unit] = m
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)

    observed = plain_measures(shap, edges, lambda k, g: g, 2)
    for r in nulls.patient_null(a, weighted, 12, 2).collect():
        i, unit = nulls.METRICS.index(r["metric"]), (r["sample_id"], r["repeat_id"])
        null = np.array([want[perm, *unit][i] for perm in range(1, 13)])
        lower, upper = (1 + (null <= observed[unit][i] + 1e-9).sum()) / 13, (1 + (null >= observed[unit][i] - 1e-9).sum()) / 13
        assert (r["observed"], r["null_mean"], r["null_sd"]) == pytest.approx((observed[unit][i], null.mean(), null.std()), abs=1e-9)
        assert (r["n"], r["p_lower"], r["p_upper"], r["p_value"]) == pytest.approx((12, lower, upper, min(1, 2 * min(lower, upper))))
        assert r["z"] is None if null.std() < 1e-9 else r["z"] == pytest.approx((observed[unit][i] - null.mean()) / null.std())


def test_sign_flips(spark):
    shap, _ = made_units()
    a = spark.createDataFrame(shap, "sample_id long, repeat_id long, gene long, shap double")
    got = {(r["perm"], r["sample_id"], r["repeat_id"]): r["total"] for r in nulls.signflip_null(a, 3).collect()}
    sign = lambda s, g, k, p: 1 if (s * 7919 + g * 104729 + k * 1299709 + p * 15485863) % 1000003 % 2 == 0 else -1
    want = {(p, s, k): sum(abs(v) * sign(s, g, k, p) for x, y, g, v in shap if (x, y) == (s, k)) for p in (1, 2, 3) for s, k in {u[:2] for u in shap}}
    assert got == pytest.approx(want)


def test_patients_of_the_null_are_summed_over_repeats(spark):
    rows = [(1, k, "coverage", v, 0.5, v - 0.5, z) for k, v, z in ((1, 0.6, 1.0), (2, 0.8, None), (3, 0.7, 2.0))]
    got = nulls.null_patients(spark.createDataFrame(rows, "sample_id long, repeat_id long, metric string, observed double, null_mean double, excess double, z double"), ["sample_id"]).first()
    assert (got["observed_mean"], got["observed_sd"], got["excess_median"], got["z_mean"], got["n_repeats"]) == pytest.approx((0.7, 0.1, 0.2, 1.5, 3))


# --- overlap of sets -----------------------------------------------------------------------------


@pytest.mark.parametrize("sizes", [(1024, 4_000_000), (4, 7)])
def test_overlap_by_blocks_equals_all_pairs(spark, monkeypatch, sizes):
    monkeypatch.setattr(targets, "BLOCK_ENTITIES", sizes[0])
    monkeypatch.setattr(targets, "PAIRS_AT_ONCE", sizes[1])
    r = random.Random(2)
    sets = {(k, p): {0, *(r.randrange(30) for _ in range(r.randint(0, 6)))} if p % 4 else {1, 2, 3} for k in (1, 2) for p in range(23 - k)}
    rows = [(k, p, g) for (k, p), s in sets.items() for g in s] + [(1, 1, 0)]
    got = {x["perm"]: x for x in targets.set_metrics(spark.createDataFrame(rows, "perm long, patient_id long, gene long"), keys=["perm"]).collect()}
    for k in (1, 2):
        own = [s for (x, _), s in sets.items() if x == k]
        pairs = list(itertools.combinations(own, 2))
        assert got[k]["mean_jaccard"] == pytest.approx(sum(len(a & b) / len(a | b) for a, b in pairs) / len(pairs))
        assert got[k]["max_recurrence"] == max(collections.Counter(g for s in own for g in s).values()) / len(own)
        assert got[k]["mean_size"] == pytest.approx(sum(map(len, own)) / len(own))


def _null_fixture(spark):
    import random

    rng = random.Random(5)
    rows = [(p, g, g % 3, float(rng.choice([0, 1, 2, 5, 9])), rng.randint(1, 50) / 50, rng.choice([0.5, 0.75, 1.0])) for p in range(1, 41) for g in range(60) if rng.random() < 0.4 or g == 7]
    entries = spark.createDataFrame(rows, "patient_id long, gene long, core long, absolute double, repeat_support double, sign_support double")
    genes = spark.createDataFrame([(g, rng.random(), rng.random(), rng.random()) for g in range(60)], "gene long, idf double, fold_frequency double, margin double")
    return entries, genes


@pytest.mark.parametrize("kind", ["within_gene", "within_patient_and_core"])
def test_nulls_by_patient_rows_equal_nulls_by_moved_entries(spark, kind):
    """The values found by undoing a permutation are those that a row for each permutation gets, for crowded genes too."""
    from larkaudit.operators import scores, target_nulls

    entries, genes = _null_fixture(spark)
    null = scores.null_within_genes if kind == "within_gene" else scores.null_within_cores
    best = scores.best_targets(scores.present_scores(null(entries, 6), genes, ["perm"]), 5, ["perm"])
    plain = {}
    for r in best.collect():
        plain.setdefault((r["patient_id"], r["perm"]), []).append((r["rank"], r["gene"], r["score"]))
    sums = {key: (len(x), sum(g for _, g, _ in x), round(sum(s for _, _, s in x), 6)) for key, x in plain.items()}
    for most in (None, 12):
        got = target_nulls.null_best(entries, genes, kind, 6, 5, most=most).collect()
        assert {(r["patient_id"], r["perm"]): (r["n_targets"], r["gene_sum"], round(r["score_sum"], 6)) for r in got} == sums
        sets = target_nulls.null_best(entries, genes, kind, 6, 5, sets=True, most=most).collect()
        assert {(r["patient_id"], r["perm"]): r["genes"] for r in sets} == {key: [g for _, g, _ in sorted(x)] for key, x in plain.items()}


def test_null_b_explodes_nothing(spark, sf):
    """A patient's permutations are worked out in its own row: no entry is multiplied by them before a shuffle."""
    from larkaudit.plans import catalog

    plan = catalog.queries()["target_null_b"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan


def test_restored_undoes_permuted():
    import numpy as np

    from larkaudit.functions import permute

    for n in (1, 2, 7, 100, 12345):
        for key in range(4):
            s = permute.seed(np.full(1, key), 3)
            assert (permute.restored(permute.permuted(np.arange(n), n, s), n, s) == np.arange(n)).all()


def test_restored_by_groups_and_where_a_round_meets_the_prime():
    """Groups share a permutation's numbers; a sum that is the modulus itself counts as 0."""
    import numpy as np

    from larkaudit.functions import permute

    size = np.arange(1, 40)
    group, place = np.repeat(np.arange(39), size), np.concatenate([np.arange(n) for n in size])
    seeds = permute.seed(np.arange(39)[None, :], np.arange(1, 8)[:, None])
    found = permute.restored(place, size, seeds, group)
    assert (permute.permuted(found, size[group][None, :], seeds[:, group]) == place).all()
    for rounds in range(1, permute.ROUNDS + 1):
        for j in range(9):
            s = permute.PRIME - j if j else 0
            for _ in range(rounds):
                s = (s - 12345) * pow(permute.FACTOR, -1, permute.PRIME) % permute.PRIME
            s = np.full(9, s)
            assert (permute.restored(permute.permuted(np.arange(9), 9, s), 9, s) == np.arange(9)).all()


def test_values_of_a_gene_are_packed_exactly_and_in_few_bytes():
    import numpy as np

    from larkaudit.operators import target_nulls

    rng = np.random.default_rng(4)
    plain = np.stack([np.round(rng.uniform(900, 105000, 30), 2), rng.integers(1, 51, 30) / 50, np.ones(30)])
    odd = [np.array([[-0.0, 1.0], [np.nan, 2.0], [np.inf, 1e300]]), rng.random((3, 7)), np.array([[0.29], [1e11], [-5.25]]), plain]
    heads, data, start = [], b"", []
    for v in odd:
        kinds, packed = target_nulls.pack(v)
        heads += target_nulls._head(1, 2, 0.5, np.array([0]), v.shape[1], kinds)
        start.append(len(data))
        data += packed
    assert len(packed) == 4 * 30  # three bytes a price, one a quantity
    got = target_nulls.unpack(np.frombuffer(b"".join(heads), target_nulls.TOLD), np.array(start), np.frombuffer(data, np.uint8))
    assert got.tobytes() == np.concatenate(odd, axis=1).tobytes()


def test_null_a_numbers_and_joins_no_entries(spark, sf):
    """A gene's rows meet in one list: no window over entries, and no join that brings values back to them."""
    from larkaudit.plans import catalog

    plan = catalog.queries()["target_null_a"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 1 and plan.count("MapInArrow") == 2


def test_null_b_of_values_that_all_differ_equals_moved_entries(spark):
    """Ranks and ranges stay in a patient's row: what is sorted is one number an entry."""
    from larkaudit.operators import scores, target_nulls

    entries, genes = _null_fixture(spark)
    entries = entries.withColumn("absolute", 1.0 + (F.col("patient_id") * 61 + F.col("gene") * 7919) % 1009)
    best = scores.best_targets(scores.present_scores(scores.null_within_cores(entries, 6), genes, ["perm"]), 5, ["perm"])
    plain = {}
    for r in best.collect():
        plain.setdefault((r["patient_id"], r["perm"]), []).append((r["rank"], r["gene"], round(r["score"], 9)))
    sets = target_nulls.null_best(entries, genes, "within_patient_and_core", 6, 5, sets=True).collect()
    assert {(r["patient_id"], r["perm"]): r["genes"] for r in sets} == {key: [g for _, g, _ in sorted(x)] for key, x in plain.items()}


@pytest.mark.parametrize("kind", ["within_gene", "within_patient_and_core"])
def test_overlap_of_null_sets_by_masks_equals_overlap_by_blocks(spark, monkeypatch, kind):
    """A bit a permutation on each entry gives what whole sets give, and no set is made or goes to blocks."""
    from larkaudit.operators import mask_overlap, target_nulls

    entries, genes = _null_fixture(spark)
    columns = ("perm", "mean_jaccard", "dissimilarity", "max_recurrence")
    by = lambda df: [pytest.approx(tuple(r), rel=1e-12) for r in df.select(*columns).orderBy("perm").collect()]
    monkeypatch.setattr(mask_overlap, "MOST_PATIENTS", 1)
    want = by(target_nulls.null_metrics(entries, genes, kind, 11, 5))
    assert len(want) == 11
    monkeypatch.setattr(mask_overlap, "MOST_PATIENTS", 2_000)
    monkeypatch.setattr(targets, "_by_blocks", None)
    monkeypatch.setattr(targets, "_by_subsets", None)
    for pairs, bits in ((4_000_000, 50_000_000), (300, 200)):
        monkeypatch.setattr(mask_overlap, "PAIRS", pairs)
        monkeypatch.setattr(mask_overlap, "BITS", bits)
        got = target_nulls.null_metrics(entries, genes, kind, 11, 5).select(*columns).orderBy("perm").collect()
        assert [tuple(r) for r in got] == want


def test_overlap_of_observed_sets_goes_to_no_blocks(spark, monkeypatch):
    """Sets of different sizes, too many items for subsets."""
    from larkaudit.operators import target_nulls

    rng = random.Random(5)
    best = spark.createDataFrame([(p, g) for p in range(60) for g in rng.sample(range(40), rng.randint(1, 15))], "patient_id long, gene long")
    columns = ["mean_jaccard", "dissimilarity", "max_recurrence"]
    want = pytest.approx(tuple(targets.set_metrics(best).select(*columns).first()), rel=1e-12)
    monkeypatch.setattr(targets, "_by_blocks", None)
    assert tuple(target_nulls.observed_metrics(best).first()) == want


@pytest.mark.parametrize("most", [3, 6, 9])
def test_overlap_of_sets_by_subsets_and_by_blocks_equals_pairs(spark, most):
    """Small sets are never paired: a hundred entities that share an item give no row for a pair."""
    import itertools
    import random

    from larkaudit.operators import targets

    rng = random.Random(most)
    sets = {(k, p): {0, *rng.sample(range(1, 15), rng.randint(0, most - 1))} for k in (1, 2) for p in range(100)}
    rows = [(k, p, g) for (k, p), s in sets.items() for g in s]
    got = {r["perm"]: r["mean_jaccard"] for r in targets.set_metrics(spark.createDataFrame(rows, "perm long, patient_id long, gene long"), keys=["perm"]).collect()}
    for k in (1, 2):
        own = [s for (j, _), s in sets.items() if j == k]
        assert got[k] == pytest.approx(sum(len(a & b) / len(a | b) for a, b in itertools.combinations(own, 2)) / 4950, abs=1e-12)
    made = spark.createDataFrame([(p, 5, list(range(5))) for p in range(3000)], "patient_id long, size int, items array<long>")
    assert targets._by_subsets(made, []).first()[0] == pytest.approx(3000 * 2999 / 2)


def test_sums_of_dense_scores_need_no_dense_rows(spark, monkeypatch):
    """The sums equal those over whole rows, and no row or block of all genes is made."""
    import random

    from larkaudit.operators import scores

    rng = random.Random(9)
    genes = spark.createDataFrame([(3 * g, rng.random(), rng.random(), rng.random()) for g in range(300)], "gene long, idf double, fold_frequency double, margin double")
    kept = lambda p: range(300) if p == 1 else sorted(rng.sample(range(300), rng.choice([1, 2, 40, 299])))
    rows = [(p, 3 * g, float(rng.choice([0, 0, 1, 2, 7])) if p != 2 else 0.0, rng.random(), rng.random()) for p in range(1, 25) for g in kept(p)]
    entries = spark.createDataFrame(rows, "patient_id long, gene long, absolute double, repeat_support double, sign_support double")
    want = {}
    for r in scores.dense_rows(entries, genes).collect():
        s = r["scores"]
        want[r["patient_id"]] = (300, len(r["present"]), sum(s), sum(i * x for i, x in enumerate(s)) / 300, min(s), max(s), sum(s[i] for i in r["present"]))
    monkeypatch.setattr(scores, "MOST_GENES", 10)
    monkeypatch.setattr(scores, "SUMMED_ROWS", 5)
    got = {r["patient_id"]: tuple(r)[1:] for r in scores.dense_sums(entries, genes).collect()}
    assert got.keys() == want.keys()
    for p in want:
        assert got[p] == pytest.approx(want[p], rel=1e-11)
