"""A corpus pipeline: each stage works on all rows that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the
shared folder and rereads it as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkaudit.llm.codec import encode_documents
from larkaudit.llm.common import cut, discard, fresh, new_path, shuffled, table, written
from larkaudit.llm.jaccard import jaccard_components
from larkaudit.llm.line_dedup import clean_lines
from larkaudit.llm.mixing import mixed_documents
from larkaudit.llm.quality import grade_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose probability of the best grade reaches the classifier's limit."""
    return grade_documents(docs, table(spark, sf_dir, "labels")).where("selected").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes boilerplate lines out; documents of nothing else go."""
    cleaned = clean_lines(docs).where(r"n_removed = 0 or text rlike '\\S'")
    return cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group, and one of rows that are equal throughout.

    Rows go by two hashes of all their columns, as ids may be null or repeated; rows without words
    are in no group, and all of them stay.
    """
    row = fresh(docs, "_row")
    both = F.concat_ws(".", F.hex(F.xxhash64(*docs.columns)), F.hex(F.xxhash64(F.lit("row"), *docs.columns)))
    named = docs.withColumn(row, both)
    groups = jaccard_components(named.select(F.col(row).alias("doc_id"), "text"), "string").where("n_shingles > 0").select(F.col("doc_id").alias(row), "component_id")
    groups = cut(groups.groupBy(row, "component_id").count().join(shuffled(named.select(row, "doc_id").distinct()), row))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row))
    stay = groups.groupBy("component_id").agg(first.alias("first")).select(f"first.{row}")
    kept = named.join(shuffled(cut(groups.join(shuffled(stay), row, "left_anti").select(row))), row, "left_anti")
    repeated = cut(groups.where("count > 1").select(row))
    if not repeated.isEmpty():
        kept = kept.join(shuffled(repeated), row, "left_anti").unionByName(kept.join(shuffled(repeated), row, "left_semi").dropDuplicates([row]))
    return kept.select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixes sources to their target weights; a document comes once for each pass that takes words of it."""
    return mixed_documents(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and the digest of what they decode to; a null or empty text has no ids."""
    return encode_documents(docs.select("doc_id", "source", "text")).select("doc_id", "source", "n_tokens", "ids", "decoded_sha256")


STAGES = [
    ("quality", quality),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("mixing", mixing),
    ("encoding", encoding),
]
#: Fitting a classifier and byte-pair merging are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        path = new_path(spark)
        docs = written(stage(spark, docs, sf_dir), path)
        if before is not None:
            discard(spark, before)  # the table that the stage has read
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
