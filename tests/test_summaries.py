"""Summaries, scores, stages, readers and guards on rows worked out by hand."""

import pytest
from pyspark.sql import functions as F

from larkaudit.functions import ranks, stages, text
from larkaudit.operators import states, summaries
from larkaudit.sources import readers, validate


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "v string").select(f(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "raw, want",
    [
        ("Node negative", 0), ("0 positive nodes", 0), ("no positive lymph nodes", 0), ("N0", 0), ("3 positive nodes", 1), ("N2", 1), ("node-positive", 1), ("3 of 12 nodes", 1),
        ("count 0", 0), ("count 4", 1), ("4 and 7", None), ("unknown", None), ("", None), (None, None),
        ("lymph_node_negative", 0), ("lymph_node_positive", 1), ("nodenegative", 0), ("nodal_positive", 1), ("tumor_negative", None), ("no nodes", 0), ("10 lymph nodes", 1), ("n10", 1),
    ],
)
def test_node_status(spark, raw, want):
    assert one(spark, raw, text.node_status) == want


@pytest.mark.parametrize(
    "raw, code, group",
    [
        ("Stage IVA", "IVA", "Advanced"), ("stage iii", "III", "Advanced"), ("T2 stage IIB", "IIB", "Early"), ("stage 3", "III", "Advanced"), ("12", None, None), ("I", "I", "Early"), ("unknown", None, None), (None, None, None),
        ("StageII", "II", "Early"), ("Stage_IIA", "IIA", "Early"), ("pathologic-stage-IS", "IS", "Early"), ("I or IV", "IV", "Advanced"), ("T3 N1", "III", "Advanced"), ("2b", "II", "Early"), ("x5 y12", None, None),
    ],
)
def test_stage_codes(spark, raw, code, group):
    assert one(spark, raw, stages.stage_code) == code
    assert one(spark, raw, lambda c: stages.code_group(stages.stage_code(c))) == group


def test_stated_groups(spark):
    assert [one(spark, v, stages.stated_group) for v in ("Early stage", "III/IV", "x", None)] == ["Early", "Advanced", None, None]


def test_stage_columns_and_sources(spark):
    df = spark.createDataFrame([("x", "Stage II", "IV", "1"), ("Stage III", None, "I", "2"), (None, None, None, "3")], "pathologic_stage string, stage_clinical string, my_tumor_stage string, stage_date string")
    assert stages.stage_columns(df) == ["pathologic_stage", "stage_clinical", "my_tumor_stage"]
    got = stages.require_sources(stages.with_stage(df)).select("stage_code", "stage_group", "stage_source").collect()
    assert [tuple(r) for r in got] == [("II", "Early", "stage_clinical"), ("III", "Advanced", "pathologic_stage"), (None, None, "unresolved")]
    with pytest.raises(ValueError):
        stages.require_sources(spark.createDataFrame([("stage_date",)], "stage_source string"))
    with pytest.raises(ValueError):
        stages.with_stage(spark.createDataFrame([("a",)], "other string"))


def test_anchors_need_all_four_conditions(spark):
    rows = [(p, c, r, m) for p, c, ms in [(1, "a", (0.9, 0.92)), (1, "b", (0.5, 0.5)), (2, "a", (0.7, 0.7)), (2, "b", (0.1, 0.1)), (3, "a", (0.99, 0.6)), (3, "b", (0.1, 0.1)), (4, "a", (0.95, 0.95)), (4, "b", (0.2, 0.2))] for r, m in enumerate(ms)]
    members = spark.createDataFrame(rows, "patient_id long, core string, repeat_id int, magnitude double")
    consistency = spark.createDataFrame([(1, 0.8), (2, 1.0), (3, 1.0), (4, 0.5)], "patient_id long, consistency double")
    got = states.anchors(members, consistency, spark.createDataFrame([("a", 0.4), ("b", 0.8)], "core string, mean_rho double")).collect()
    assert [(r["patient_id"], r["core"], r["rank"]) for r in got] == [(1, "a", 1)]
    sd = ((0.9 - 0.91) ** 2 + (0.92 - 0.91) ** 2) ** 0.5
    assert got[0]["score"] == pytest.approx(0.35 * 0.91 + 0.25 * 0.8 + 0.2 * (1 - sd) + 0.15 * 0.41 + 0.05 * 0.5, abs=1e-8)


def test_border_scores(spark):
    rows = [(1, 1, 0, 0, 0.2, 1.0, 0.5), (2, 0, 1, 1, 0.4, 0.6, 0.1)]
    got = states.border_scores(spark.createDataFrame(rows, "patient_id long, discordant int, dependent int, unstable int, uncertainty double, consistency double, null_gap double")).collect()
    assert {r["patient_id"]: r["score"] for r in got} == pytest.approx({1: 0.25 + 0.2 * 0.5 + 0.1, 2: 0.3 + 0.2 + 0.15 * 0.4 + 0.1 * 0.5})



def test_competition_rank_and_log(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (3.0,)], "v double")
    assert sorted(r[0] for r in df.select(ranks.min_rank([], F.asc("v"))).collect()) == [1, 1, 3]
    assert [round(r[0], 6) for r in spark.createDataFrame([(0.01,), (0.0,)], "p double").select(ranks.minus_log10(F.col("p"))).collect()] == [2.0, 300.0]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.tsv").write_text(f"a\tb\n{i}\tx\n")
    assert readers.head(spark, str(tmp_path / "in"), 3) == b"a\tb"
    assert readers.read_parts(spark, str(tmp_path / "in"), 3).select("source_file").distinct().count() == 3
    with pytest.raises(ValueError):
        readers.read_parts(spark, str(tmp_path / "in"), 4)
    (tmp_path / "j.json").write_text('[{"k": 1}, {"k": 2}]')
    assert sorted(r["k"] for r in readers.read_json_rows(spark, str(tmp_path / "j.json")).collect()) == [1, 2]
    assert readers.read_wide_features(spark, str(tmp_path / "in" / "0.tsv"), ["b", "missing", "a"]).columns == ["b", "a"]
    audit = {r["name"]: (r["found"], r["bytes"]) for r in readers.audit_files(spark, {"in": str(tmp_path / "in"), "no": str(tmp_path / "no")}).collect()}
    assert audit == {"in": (True, 24), "no": (False, None)}
    readers.write_delimited(spark.createDataFrame([(1, 0.5, None)], "i int, v double, s string").coalesce(1), str(tmp_path / "out"))
    assert [p.read_text() for p in (tmp_path / "out").glob("part-*")] == ["i\tv\ts\n1\t0.5000000000\t\n"]


def test_guards(spark):
    h = spark.createDataFrame([("a", "alias")] * 3, "raw string, status string")
    assert validate.require_few_rescued(h).count() == 3
    with pytest.raises(ValueError):
        validate.require_few_rescued(h, 2)
    labels = spark.range(100).select((F.col("id") % 2).alias("y"))
    assert validate.require_classes(labels, "y", 100, 50).count() == 100
    with pytest.raises(ValueError):
        validate.require_classes(labels, "y")


def test_portability_goes_by_each_models_threshold(spark):
    rows = [(1, 0, 0.5, 0.2), (2, 0, 0.41, 0.62), (3, 0, 0.8, 0.9), (4, 1, 0.1, 0.2), (5, 1, 0.8, 0.9), (6, 1, 0.36, 0.56)]
    df = spark.createDataFrame(rows, "id long, y int, a_p double, b_p double")
    got = {r["id"]: r["s"] for r in df.select("id", summaries.portability(F.lit(0.4), F.lit(0.6)).alias("s")).collect()}
    assert got == {
        1: "model_dependent", 2: "intermediate_ambiguous", 3: "clinical_early_molecular_advanced_like", 4: "clinical_advanced_molecular_early_like", 5: "clinical_molecular_concordant", 6: "intermediate_ambiguous"
    }


def test_patient_targets_weigh_specific_shares(spark):
    rows = [(1, 10, 0, "generic", 0.9, 0.0), (1, 11, 1, "specific", 0.7, 1.0), (1, 12, 1, "specific", 0.5, 0.8), (1, 13, 0, "recurrent", 0.3, 0.4), (2, 10, 3, "generic", 0.2, 0.0)]
    layered = spark.createDataFrame(rows, "patient_id long, gene long, core long, class string, score double, idf01 double")
    got = {r["patient_id"]: r for r in summaries.patient_targets(layered, spark.createDataFrame([(1,), (2,), (3,), (3,)], "patient_id long")).collect()}
    assert (got[1]["specificity"], got[1]["tier"], got[1]["dominant_core"], got[1]["most_score"]) == (pytest.approx(0.5 * 0.5 + 0.3 * 0.55 + 0.2 * 0.75), "moderate", 0, 0.9)
    assert (got[2]["specificity"], got[2]["tier"], got[2]["n_generic"]) == (0.0, "low", 1)
    assert (got[3]["n_targets"], got[3]["n_specific"], got[3]["specificity"], got[3]["tier"]) == (0, 0, None, None)


def test_targets_without_support_take_no_part_but_their_patients_count(spark):
    rows = [(1, 10, 0, 4.0, 0.8, 1.0, 1.0, 2.0), (1, 11, 0, 2.0, 0.4, 0.2, 0.6, 1.0), (1, 12, 0, 9.0, 0.3, 1.0, 1.0, 9.0), (2, 10, 0, 5.0, 0.5, 1.0, 1.0, 2.0), (3, 11, 0, 7.0, 0.9, 0.1, 1.0, 1.0), (4, 11, 0, 7.0, 0.9, 0.9, 0.5, 1.0)]
    pool = spark.createDataFrame(rows, "patient_id long, gene long, core long, size double, repeat_support double, fold_frequency double, sign_support double, margin double")
    got = {(r["patient_id"], r["gene"]): r for r in summaries.pool_scores(pool).collect()}
    assert got.keys() == {(1, 10), (1, 11), (2, 10)}
    assert (got[1, 10]["frequency"], got[1, 10]["class"], got[1, 11]["frequency"]) == (0.5, "generic", 0.25)
    first = 0.35 * 1 + 0.2 * 1 + 0.2 * (0.5 * 0.8 + 0.25 + 0.25) + 0.1 * 1
    assert (got[1, 10]["first_score"], got[1, 10]["score"]) == pytest.approx((first / 0.85, first), abs=1e-8)
    assert got[1, 11]["score"] == pytest.approx(0.2 * 0.5 + 0.2 * (0.5 * 0.4 + 0.25 * 0.6 + 0.25 * 0.2) + 0.15, abs=1e-8)
