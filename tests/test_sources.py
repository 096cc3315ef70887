import json
import random

import pytest
from pyspark.sql import functions as F

from larkaudit.plans import audit_run
from larkaudit.sources import readers
from larkaudit.sources.config import RunConfig
from larkaudit.sources.validate import SchemaError


def put(path, content, name="utf-8"):
    path.write_bytes(content.encode(name))
    return str(path)


def test_encodings_and_separators(spark, tmp_path):
    body = "gene\ts1\ts2\nA\t1\t2\nB\té\t4\n"
    for name in ("utf-8", "utf-8-sig", "utf-16", "latin-1"):
        df = readers.read_delimited(spark, put(tmp_path / f"{name}.tsv", body, name))
        assert df.columns == ["gene", "s1", "s2"] and df.count() == 2
    assert readers.read_delimited(spark, put(tmp_path / "c.csv", "# note\na,b\n1,2\n")).columns == ["a", "b"]
    with pytest.raises(ValueError):
        readers.read_delimited(spark, put(tmp_path / "bad.txt", "only one\n"))


def test_collections_and_headers(spark, tmp_path):
    gmt = readers.read_gmt(spark, put(tmp_path / "x.gmt", "T1\tfirst\tg1\tg2\tg2\nshort\tline\nT2\td\t-\tg3\n"))
    assert sorted((r["term"], r["gene"]) for r in gmt.collect()) == [("T1", "G1"), ("T1", "G2"), ("T2", "G3")]
    info = readers.read_hash_header(spark, put(tmp_path / "i.tsv", "#tax_id\tSymbol\tSynonyms\n9606\tA\tB|C\n"))
    assert info.columns == ["tax_id", "Symbol", "Synonyms"] and info.count() == 1


def test_series_matrix(spark, tmp_path):
    text = '!Series_title\t"x"\n!Sample_geo_accession\t"G1"\t"G2"\n!Sample_characteristics_ch1\t"age: 5"\t"age: 6"\n!Sample_characteristics_ch1\t"node: N0"\t"node: N1"\n'
    got = {(r["sample"], r["key"]): r["value"] for r in readers.read_series_matrix(spark, put(tmp_path / "s.txt", text)).collect()}
    assert got[0, "geo_accession"] == "G1" and got[1, "characteristics_ch1_2"] == "node: N1" and len(got) == 6


def test_orientation_and_unpivot(spark):
    assert readers.orientation(["g", "TCGA-1", "TCGA-2"], ["A"], "TCGA-") == "genes_by_samples"
    assert readers.orientation(["id", "A", "B"], ["TCGA-1"], "TCGA-") == "samples_by_genes"
    assert readers.orientation(["id", "A"], ["x"], "TCGA-") == "uncertain"
    long = readers.unpivot_matrix(spark.createDataFrame([("A", "1.5", "x"), ("B", "NaN", None)], "g string, s1 string, s2 string"), "g")
    assert sorted((r["gene_id"], r["sample_id"], r["value"]) for r in long.where("value is not null").collect()) == [("A", "s1", 1.5)]


def inputs(tmp_path, change=None):
    rng = random.Random(7)
    genes, patients = [f"G{i:02}" for i in range(12)], [f"P{i:02}" for i in range(30)]
    label = {p: "advanced" if i % 2 else "early" for i, p in enumerate(patients)}
    tables = {
        "expression": [["gene_id", *patients]] + [[g, *[f"{rng.gauss(1.5 * (label[p] == 'advanced') if i < 4 else 0, 1):.4f}" for p in patients]] for i, g in enumerate(genes)],
        "clinical": [["patient_id", "stage_group"]] + [[p, label[p]] for p in patients],
        "gene_sets": [["process_id", "gene_id"]] + [[f"S{i % 3}", g] for i, g in enumerate(genes[:9])],
    }
    if change:
        change(tables)
    (tmp_path / "demo").mkdir(exist_ok=True)
    for name, body in tables.items():
        (tmp_path / "demo" / f"{name}.csv").write_text("\n".join(",".join(r) for r in body) + "\n")
    config = {"expression": "demo/expression.csv", "clinical": "demo/clinical.csv", "gene_sets": "demo/gene_sets.csv", "output": "out"}
    (tmp_path / "demo" / "config.json").write_text(json.dumps(config))
    return RunConfig.load(str(tmp_path / "demo" / "config.json"))


def test_whole_run_is_complete_and_repeatable(spark, tmp_path):
    config = inputs(tmp_path)
    one = audit_run.run(spark, config)
    assert one["n_oof_rows"] == 30 * 2 * 2 and one["status"] == "complete"
    assert all(a > 0.6 for a in one["model_auc"].values())
    assert audit_run.run(spark, config) == one
    r = spark.read.parquet(f"{config.output}/representation_audit").first()
    assert (r["n_genes"], r["n_represented_genes"], r["n_gap_genes"]) == (12, 9, 3) and 0 <= r["absolute_contribution_coverage"] <= 1
    assert spark.read.parquet(f"{config.output}/patient_reliability").columns == audit_run.RELIABILITY
    assert audit_run.latest(spark, [config.output, str(tmp_path / "none")], {"oof_probabilities"}) == config.output


def drop_column(t):
    t["clinical"] = [[r[0], "x"] if i else [r[0], "other"] for i, r in enumerate(t["clinical"])]


def duplicate(t):
    t["clinical"].append(t["clinical"][1])


def stranger(t):
    t["clinical"].append(["P99", "early"])


def label(t):
    t["clinical"][1][1] = "unknown"


def word(t):
    t["expression"][1][1] = "not_numeric"


def turned(t):
    t["expression"] = [list(x) for x in zip(*t["expression"], strict=True)]
    t["expression"][0][0] = "gene_id"


@pytest.mark.parametrize(
    ("change", "message"),
    [(drop_column, "missing required column"), (duplicate, "duplicate patient"), (stranger, "missing from expression"), (label, "invalid endpoint"), (word, "must be numeric"), (turned, "orientation appears invalid")],
)
def test_bad_inputs_are_named(spark, tmp_path, change, message):
    config = inputs(tmp_path, change)
    with pytest.raises(SchemaError, match=message):
        audit_run.run(spark, config)
    log = spark.read.parquet(f"{config.output}/failure_log").first()
    assert log["failure_code"] == "SCHEMA_VALIDATION_FAILED" and json.loads(spark.read.text(f"{config.output}/run_manifest").first()[0])["status"] == "failed"


def test_without_the_subpackage(tmp_path):
    """The entry module works where the corpus operators are left out."""
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/larkaudit", tmp_path / "larkaudit", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 70 and not any(n.startswith('op') and n[2].isdigit() for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=120, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_row_of_numbers(spark):
    from larkaudit.operators.relational import metric_rows

    assert metric_rows(spark.range(1).select(F.lit(3).alias("a"))).collect() == [("a", 3.0)]
