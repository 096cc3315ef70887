"""Aliases and record audits, tests that may not be circular, reports as files, runs taken up again, strict decoding."""

import pathlib
import random

import pytest
from pyspark.sql import functions as F

from larkaudit.functions import ranks
from larkaudit.functions.provenance import CircularTest, derived, marked, require_independent, roots
from larkaudit.operators import aliases, reports, stats, summaries, validation
from larkaudit.sources import cohorts, readers, resumable

# --- names and records ---------------------------------------------------------------------------


def test_record_audit(spark):
    rows = [("a", 0, "k2", "n0"), ("a", 0, "k1", "neg"), ("b", 0, "k1", "x"), ("b", 1, "k1", "y"), ("c", None, "k1", "z"), ("a", 0, "k1", None)]
    got = {r[0]: tuple(r)[1:] for r in aliases.record_audit(spark.createDataFrame(rows, "id string, status int, key string, raw string"), "id", "status", {"keys": "key", "raws": "raw"}).collect()}
    assert got == {"a": (3, 1, 0, False, "k1 | k2", "n0 | neg"), "b": (2, 2, None, True, "k1", "x | y")}


def test_only_aliases_of_one_sample_stay_and_match_once(spark):
    samples = spark.createDataFrame(
        [("G1", "Tumour 1", "T-1", "shared"), ("G2", "Tumour 2", None, "shared"), ("G3", "T1", "  ", "own 3"), ("G4", "g-4", "G4", "x")], "id string, title string, source string, description string"
    )
    named = aliases.aliases(samples, "id", ["id", "title", "source", "description"])
    owned = aliases.owned_aliases(named, "id")
    got = {r["alias"]: (r["id"], r["alias_type"], r["alias_raw"]) for r in owned.collect()}
    # T1 belongs to G1 by its source and to G3 by its title; G4 has three spellings of one alias, of which the first column's stays
    assert got == {
        "G1": ("G1", "id", "G1"), "G2": ("G2", "id", "G2"), "G3": ("G3", "id", "G3"), "G4": ("G4", "id", "G4"), "TUMOUR1": ("G1", "title", "Tumour 1"), "TUMOUR2": ("G2", "title", "Tumour 2"),
        "OWN3": ("G3", "description", "own 3"), "X": ("G4", "description", "x"),
    }
    columns = spark.createDataFrame([(1, "tumour_2"), (2, "g2"), (3, "T1"), (4, "OWN-3"), (5, "own 3"), (6, "X"), (7, "X"), (8, "gene")], "at long, column string")
    matched = aliases.matched_columns(columns, owned, "id").collect()
    assert sorted((r["id"], r["column"], r["at"]) for r in matched) == [("G2", "tumour_2", 1), ("G3", "OWN-3", 4), ("G4", "X", 6)]


# --- provenance ----------------------------------------------------------------------------------


def patients(spark):
    r = random.Random(9)
    rows = [(i, r.gauss(0, 1), r.gauss(0, 1), "xyz"[i % 3] if i % 40 else None) for i in range(120)]
    return spark.createDataFrame(rows, "id long, membership double, other double, stated string")


def test_provenance_stays_with_columns(spark):
    p = derived(patients(spark), "state", F.when(F.col("membership") > 0, "high").otherwise("low"), ["membership"])
    p = derived(p, "twice", F.concat("state", "stated"), ["state", "stated"])
    p = p.join(spark.range(200), "id").where("id > 3").select("id", "membership", "other", "stated", "state", "twice")
    assert roots(p, "state") == {"membership"} and roots(p, "twice") == {"membership", "stated"} and roots(p, "other") == {"other"}
    require_independent(p, ["stated", "state"], ["other"])
    with pytest.raises(CircularTest, match="state and membership both come from membership"):
        require_independent(p, ["stated", "state"], ["other", "membership"])
    told = marked(patients(spark), {"stated": ["membership"]})
    with pytest.raises(CircularTest):
        validation.long_states(told, ["stated"], ["membership"])


def test_independent_tests_equal_plain_ones(spark):
    rows = validation.long_states(patients(spark), ["stated"], ["membership", "other"])
    got = {r["metric"]: r for r in validation.omnibus(rows).collect()}
    people = [r for r in patients(spark).collect() if r["stated"] is not None]
    for metric in ("membership", "other"):
        order = sorted(people, key=lambda r: r[metric])
        n = len(order)
        sums = {s: [i + 1 for i, r in enumerate(order) if r["stated"] == s] for s in "xyz"}
        h = 12 / (n * (n + 1)) * sum(sum(v) ** 2 / len(v) for v in sums.values()) - 3 * (n + 1)
        assert (got[metric]["h"], got[metric]["n_groups"], got[metric]["groups"]) == (pytest.approx(h), 3, "x | y | z")
        assert got[metric]["p_value"] == pytest.approx(stats.chi2_tail(h, 2))
    small, large = sorted(r["p_value"] for r in got.values())
    assert sorted(r["fdr"] for r in got.values()) == pytest.approx(sorted([min(2 * small, large), large]))
    pair = {(r["metric"], r["group_1"], r["group_2"]): r for r in validation.pairs(rows).collect()}
    assert len(pair) == 6
    for (metric, a, b), r in pair.items():
        x, y = ([q[metric] for q in people if q["stated"] == s] for s in (a, b))
        u = sum((v > w) + 0.5 * (v == w) for v in x for w in y)
        assert (r["u"], r["mean_difference"]) == pytest.approx((u, sum(x) / len(x) - sum(y) / len(y)))
        same = sorted(q["p_value"] for k, q in pair.items() if k[0] == metric)
        assert r["fdr"] == pytest.approx(min(min(3 * p / (i + 1) for i, p in enumerate(same) if p >= r["p_value"]), 1))


# --- reports -------------------------------------------------------------------------------------


def test_texts_are_written_a_file_a_patient(spark, tmp_path):
    genes = spark.createDataFrame([(1, "g1", "H1", "c", 2), (1, "g2", "g2", "c", 1), (2, "g3", "None", "d", 1)], "patient_id long, raw string, harmonized string, core string, rank int")
    people = spark.createDataFrame([(1, "a", 0.5, "old"), (2, None, None, "old"), (3, "b", float("nan"), "old")], "patient_id long, true_group string, priority double, recommended_gap_genes string")
    p = reports.with_texts(people, reports.gene_texts(genes, "raw", "harmonized", "core", "rank"))
    assert {r["patient_id"]: (r["recommended_gap_genes"], r["n_recommended_gap_genes"]) for r in p.collect()} == {1: ("g2[c]; g1->H1[c]", 2), 2: ("g3[d]", 1), 3: ("", 0)}
    text = reports.report("AUDIT", F.col("patient_id"), {"Clinical group": reports.shown(F.col("true_group"))}, {"CORE": [F.concat(F.lit("Core priority: "), reports.number(F.col("priority")))], "GENES": [reports.genes_or_note(F.col("recommended_gap_genes"))]}, "A note.")
    for _ in range(2):  # a second run leaves the same files
        reports.write_texts(p.select("patient_id", text.alias("report")).repartition(5), str(tmp_path / "out"))
    found = {f.parent.name: f.read_text() for f in pathlib.Path(tmp_path / "out").glob("*/part-*.txt")}
    rule, line = "-" * 60, "=" * 60

    def want(patient, group, priority, genes):
        return f"AUDIT\n{line}\n\nPatient: {patient}\nClinical group: {group}\n\nCORE\n{rule}\nCore priority: {priority}\n\nGENES\n{rule}\n{genes}\n\nINTERPRETATION BOUNDARY\n{rule}\nA note.\n"

    assert found == {"patient_id=1": want(1, "a", "0.5000", "g2[c]; g1->H1[c]"), "patient_id=2": want(2, "NA", "NA", "g3[d]"), "patient_id=3": want(3, "b", "NA", reports.NO_GENES)}


def test_counts_and_order_of_reports(spark):
    p = spark.createDataFrame([(1, True, 1, "c", 0.5), (2, False, None, "c", 0.7), (3, None, 0, "d", 0.1)], "patient_id long, a boolean, b int, core string, priority double")
    assert {tuple(r) for r in reports.type_counts(p, {"first": "a", "second": "b"}).collect()} == {("first", 1), ("second", 1)}
    assert {tuple(r) for r in reports.type_counts(p.limit(0), {"first": "a"}).collect()} == {("first", 0)}
    assert {r["core"]: (r["n_patient_core_records"], r["mean"]) for r in reports.core_counts(p, ["core"], {"mean": "priority"}).collect()} == {"c": (2, pytest.approx(0.6)), "d": (1, 0.1)}
    ranked = spark.createDataFrame([(3, 1), (1, 2), (9, 3)], "patient_id long, rank int")
    assert [(r["patient_id"], r["boundary_priority_rank"]) for r in reports.in_order(p, ranked).collect()] == [(3, 1), (1, 2)]


# --- runs taken up again -------------------------------------------------------------------------


def test_a_killed_run_is_finished_without_redoing_whole_folds(spark, tmp_path):
    path, calls = str(tmp_path / "run"), []

    def make(part, fail_at=None):
        calls.append(part["fold"])
        rows = spark.range(part["fold"] * 3).select("id", (F.col("id") * part["fold"]).alias("v"))
        broken = rows.select("id", F.raise_error(F.lit("killed")).cast("long").alias("v")) if part["fold"] == fail_at else rows
        return {"values": rows, "more": broken}

    folds = [{"repeat": 1, "fold": f} for f in range(1, 6)]
    with pytest.raises(Exception, match="killed"):
        resumable.run_parts(spark, path, folds, ["values", "more"], lambda p: make(p, 4))
    assert calls == [1, 2, 3, 4]  # of fold 4 one table is there, and no count
    calls.clear()
    made = resumable.run_parts(spark, path, folds, ["values", "more"], make)
    assert calls == [4, 5] and made == folds[3:]
    for table in ("values", "more"):
        got = spark.read.parquet(f"{path}/{table}").groupBy("fold").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()
        assert {r["fold"]: (r["n"], r["s"]) for r in got} == {f: (3 * f, f * sum(range(3 * f))) for f in range(1, 6)}
    calls.clear()
    assert resumable.run_parts(spark, path, folds, ["values", "more"], make) == [] and calls == []

    for f in pathlib.Path(path, "values", "repeat=1", "fold=2").glob("*.parquet"):
        f.unlink()  # a partition that has lost its files is made again
    assert resumable.run_parts(spark, path, folds, ["values", "more"], make) == [folds[1]]
    with pytest.raises(ValueError, match="expected"):
        resumable.run_parts(spark, path, [{"repeat": 1, "fold": 9}], ["values"], make)
    assert resumable.run_parts(spark, path, [], ["values"], make) == []


# --- strict decoding -----------------------------------------------------------------------------


@pytest.mark.parametrize(
    "name, letter, found",
    [("utf-8", "é", "UTF-8"), ("cp1252", "é", "windows-1252"), ("cp1252", "€", "windows-1252"), ("latin-1", "é\x81", "ISO-8859-1"), ("utf-16-le", "é", "UTF-16LE"), ("utf-16-be", "é", "UTF-16BE"), ("utf-16", "é", "UTF-16LE"), ("utf-8-sig", "é", "UTF-8")],
)
def test_the_whole_file_decides_its_encoding(spark, tmp_path, name, letter, found):
    lines = ["gene\ts1\ts2"] + [f"g{i}\t1\t2" for i in range(120_000)] + [f"last{letter}\t3\t4"]  # the first letter beyond ASCII comes after a megabyte
    path = tmp_path / "x.tsv"
    path.write_bytes("\n".join(lines).encode(name))
    assert path.stat().st_size > 1_000_000
    assert readers.candidates(spark, str(path), readers.head(spark, str(path)))[0] == found
    df = readers.read_delimited(spark, str(path))
    assert df.columns == ["gene", "s1", "s2"] and df.count() == 120_001
    assert df.where("gene like 'last%'").first()["gene"] == f"last{letter}"


# --- external cohorts ----------------------------------------------------------------------------


def test_expression_of_either_orientation(spark):
    genes = spark.createDataFrame([("A", "1", "2", "x"), ("B", "3", None, "y"), ("A", "5", "6", "z"), ("C", "bad", "8", None), ("D", "0", "0", "w")], "Hugo_Symbol string, s1 string, s2 string, note string")
    got = {(r["gene_id"], r["sample_id"]): r["value"] for r in cohorts.expression(genes).collect()}
    assert got == {("A", "s1"): 3.0, ("A", "s2"): 4.0, ("B", "s1"): 3.0, ("B", "s2"): None, ("C", "s1"): None, ("C", "s2"): 8.0, ("D", "s1"): 0.0, ("D", "s2"): 0.0}
    samples = spark.createDataFrame([("s1", "1", "2", "3"), ("s2", "4", "5", "6")], "sample string, A string, B string, C string")
    got = {(r["gene_id"], r["sample_id"]): r["value"] for r in cohorts.expression(samples).collect()}
    assert got == {(g, s): float(i * 3 + j + 1) for i, s in enumerate(("s1", "s2")) for j, g in enumerate("ABC")}


def test_stage_labels_and_gene_names(spark, tmp_path):
    rows = [("p1", None, "II"), ("p1", "x", "Stage IV"), ("p1", "x", "I"), ("p2", "x", "unknown"), ("p3", "x", "3")]
    got = cohorts.stage_labels(spark.createDataFrame(rows, "Patient string, other string, `Tumor Stage X` string").coalesce(1)).collect()
    assert sorted(tuple(r) for r in got) == [("p1", "II", 0), ("p3", "3", 1)]
    with pytest.raises(KeyError):
        cohorts.stage_labels(spark.createDataFrame([("a", 1)], "id string, grade int"))
    path = tmp_path / "names.tsv"
    path.write_text('symbol\talias_symbol\tprev_symbol\nTP53\t"p53|LFS1"\t\nBRCA1\t\t"BRCC1"\nX\t-\tp53\n')
    approved, names = cohorts.read_gene_names(spark, str(path))
    assert sorted(r["symbol"] for r in approved.collect()) == ["BRCA1", "TP53", "X"]
    assert sorted(tuple(r) for r in names.collect()) == [("BRCC1", "BRCA1", "previous"), ("LFS1", "TP53", "alias"), ("P53", "TP53", "alias"), ("P53", "X", "previous")]


# --- ranks and scores ----------------------------------------------------------------------------


def test_ranks_beyond_one_window_run_in_ranges(spark, monkeypatch):
    values = [float((i * 7919) % 101) for i in range(500)]
    df = spark.createDataFrame([*enumerate(values), (500, None)], "id long, v double")
    small = {r["id"]: (r["avg_rank"], r["rank_n"]) for r in ranks.average_ranks(df, "v").collect()}
    small_fdr = {r["id"]: r["fdr"] for r in ranks.bh_fdr(df.withColumn("v", F.col("v") / 200), "v").collect()}
    small_places = {r["id"]: r["place"] for r in ranks.places(df.select("id"), "id").collect()}
    monkeypatch.setattr(ranks, "ONE_WINDOW", 20)
    assert {r["id"]: (r["avg_rank"], r["rank_n"]) for r in ranks.average_ranks(df, "v").collect()} == small
    assert {r["id"]: r["fdr"] for r in ranks.bh_fdr(df.withColumn("v", F.col("v") / 200), "v").collect()} == pytest.approx(small_fdr)
    assert {r["id"]: r["place"] for r in ranks.places(df.select("id"), "id").collect()} == small_places == {i: i for i in range(501)}


def test_candidate_scores(spark):
    rows = [(1, 4.0, 0.9, 1.0, 0.1, 0.2), (2, 3.0, 0.5, 0.8, 0.3, 0.1), (3, 2.0, 0.7, 0.8, 0.2, 0.4), (4, 1.0, 0.6, 0.6, 0.4, 0.3)]
    got = summaries.candidate_scores(spark.createDataFrame(rows, "sample_id long, unmapped double, coverage double, sign_consistency double, residual_sd double, dependence double")).collect()
    want = {
        1: 0.25 * 1 + 0.2 * 0 + 0.2 * 1 + 0.15 * 0.25 + 0.2 * 0.5, 2: 0.25 * 0.75 + 0.2 * 0.75 + 0.2 * 0.625 + 0.15 * 0.75 + 0.2 * 0.25,
        3: 0.25 * 0.5 + 0.2 * 0.25 + 0.2 * 0.625 + 0.15 * 0.5 + 0.2 * 1, 4: 0.25 * 0.25 + 0.2 * 0.5 + 0.2 * 0.25 + 0.15 * 1 + 0.2 * 0.75,
    }
    assert {r["sample_id"]: r["score"] for r in got} == pytest.approx(want)


def test_numbers_in_reports_round_the_exact_double(spark, sf):
    from conftest import duck

    given = [0.28125, 0.21875, 0.00005, 0.33335, 0.12345, 2.5e-5, 1.0, None, float("nan")]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i int, v double")
    found = [r["t"] for r in rows.select("i", reports.number(F.col("v")).alias("t")).orderBy("i").collect()]
    assert found == [*("%.4f" % v for v in given[:-2]), "NA", "NA"]
    theirs = duck(sf, "select format('{:.4f}', v) as t from (values " + ", ".join(f"({i}, {v!r}::double)" for i, v in enumerate(given[:-2])) + ") x(i, v) order by i")
    assert found[:-2] == theirs["t"].tolist()
