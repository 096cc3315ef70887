"""External cohorts: expression in either orientation, stage labels, and the approved, former and alias names of genes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkaudit.functions.ranks import first_rank
from larkaudit.functions.text import clean_symbol, first_existing, split_symbols, stage_binary
from larkaudit.sources.readers import read_delimited, unpivot_matrix

#: Names of the columns that are looked for, in order. Fixed values.
GENE_COLUMNS = ["gene", "gene_symbol", "hugo_symbol", "symbol", "id", "entity"]
SAMPLE_COLUMNS = ["sample_id", "patient_id", "sample", "patient", "sample identifier", "patient identifier"]
STAGE_COLUMNS = ["stage", "tumor_stage", "pathologic_stage", "clinical_stage", "stage at diagnosis", "neoplasm disease stage american joint committee on cancer code"]
#: A table of fewer rows than columns, and fewer than this, has a row a sample. Fixed value.
LEAST_GENES = 5000


def expression(wide: DataFrame) -> DataFrame:
    """gene_id, sample_id, value of a wide table of either orientation; columns without a number are no data, repeated genes are averaged.

    The name column is one of GENE_COLUMNS, in the order of the table, else the first. Rows are samples where there
    are fewer of them than data columns, and fewer than LEAST_GENES.
    """
    name = next((c for c in wide.columns if c.strip().lower() in GENE_COLUMNS), wide.columns[0])
    long = unpivot_matrix(wide, name, "_row", "_column")
    some = long.groupBy("_column").agg(F.count("value").alias("_n")).where("_n > 0").select("_column")
    n_columns, n_rows = some.count(), wide.count()
    long = long.join(some, "_column", "left_semi")
    gene, sample = ("_column", "_row") if n_rows < n_columns and n_rows < LEAST_GENES else ("_row", "_column")
    return long.groupBy(F.col(gene).alias("gene_id"), F.col(sample).alias("sample_id")).agg(F.avg("value").alias("value"))


def read_expression(spark: SparkSession, path: str) -> DataFrame:
    return expression(read_delimited(spark, path))


def stage_labels(clinical: DataFrame) -> DataFrame:
    """sample_id, stage_raw, stage_binary: the first row of each sample, in the table's order, whose stage can be read.

    Columns go by SAMPLE_COLUMNS and STAGE_COLUMNS; else the first is the sample, and the first with
    stage in its name the stage. A table without one is an error.
    """
    sample = first_existing(clinical.columns, SAMPLE_COLUMNS, required=False) or clinical.columns[0]
    stage = first_existing(clinical.columns, STAGE_COLUMNS, required=False) or next((c for c in clinical.columns if "stage" in c.lower()), None)
    if stage is None:
        raise KeyError("no column with stage in its name")
    rows = clinical.select(F.col(f"`{sample}`").cast("string").alias("sample_id"), F.col(f"`{stage}`").cast("string").alias("stage_raw"), F.monotonically_increasing_id().alias("_at"))
    rows = rows.withColumn("stage_binary", stage_binary(F.col("stage_raw"))).where("stage_binary is not null")
    return rows.withColumn("_k", first_rank(["sample_id"], F.asc("_at"))).where("_k = 1").select("sample_id", "stage_raw", "stage_binary")


def read_stage_labels(spark: SparkSession, path: str) -> DataFrame:
    return stage_labels(read_delimited(spark, path))


def read_gene_names(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Approved symbols (symbol), and alias, symbol, kind (alias or previous) of a tab-separated table with symbol, alias_symbol and prev_symbol."""
    table = read_delimited(spark, path, comment=None)
    symbol = clean_symbol(F.col("symbol"))
    kinds = {"alias": "alias_symbol", "previous": "prev_symbol"}

    def named(kind: str, column: str) -> Column:
        found = F.coalesce(split_symbols(F.regexp_replace(column, '"', "")), F.array())
        return F.transform(found, lambda s: F.struct(s.alias("alias"), F.lit(kind).alias("kind")))

    each = [named(kind, column) for kind, column in kinds.items()]
    names = table.select(symbol.alias("symbol"), F.explode(F.concat(*each)).alias("_n")).select("_n.alias", "symbol", "_n.kind").where("symbol is not null").distinct()
    return table.select(symbol.alias("symbol")).where("symbol is not null").distinct(), names
