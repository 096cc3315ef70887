"""Exact duplicates by a tree-merge of sorted digest runs, in DataFrame operations only.

Each partition of the table is a run: its digests, sorted, each once, with the identifier to keep and
the number of rows. Runs merge in binomial rounds: in each round FAN_IN neighbouring runs become one,
so what is left after r rounds stands for FAN_IN ** r partitions, and every round retains one entry a
digest. A run is spread over tasks by digest, so that neither a round nor the root of the tree is the
work of one task, and a digest that a third of all rows have is one entry a run from the first round on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkaudit.llm.common import cut, fresh, spread_join

#: Runs that one round merges into one.
FAN_IN = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What entries must agree in to be merged: SHA-256, and length and a second hash that verify it.
KEYS = ["digest", "n_bytes", "check"]


def normalised(text: Column) -> Column:
    """The text (null: empty) with A to Z in lower case; other letters stay as they are."""
    text = F.coalesce(text, F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)  # there, and only there, lower() changes no more than A to Z
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def entries(docs: DataFrame) -> DataFrame:
    """row (a number of its own), run (its partition), doc_id and KEYS of each row; cut, so that numbers stay as they are."""
    text = docs.select("doc_id", normalised(F.col("text")).alias("text"))
    keys = [F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("n_bytes"), F.xxhash64("text").alias("check")]
    return cut(text.select(F.monotonically_increasing_id().alias("row"), F.spark_partition_id().alias("run"), "doc_id", *keys))


def merged_runs(rows: DataFrame, keep: str = "largest", fan_in: int = FAN_IN) -> DataFrame:
    """KEYS, id (a struct of doc_id and row) and n: the root of the merge tree over ``rows`` of ``entries``."""
    if keep == "largest":
        entry, better = F.struct(F.lit(False).alias("none"), "doc_id", (-F.col("row")).alias("row")), F.max
    elif keep == "smallest":
        entry, better = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"), F.min
    else:
        raise ValueError(f"keep is largest or smallest, not {keep}")
    last = rows.agg(F.max("run")).first()[0] or 0
    runs = rows.select(*KEYS, "run", entry.alias("id"), F.lit(1).cast("long").alias("n"))
    while True:
        merged = F.floor(F.col("run") / fan_in).cast("int").alias("run")
        # The aggregate sorts each run where it lies, and after the exchange merges what several runs have.
        runs = runs.groupBy(*KEYS, merged).agg(better("id").alias("id"), F.sum("n").alias("n"))
        last //= fan_in
        if not last:
            return runs.select(*KEYS, "id.doc_id", F.abs("id.row").alias("row"), "n")


def exact_classes(docs: DataFrame, keep: str = "largest", fan_in: int = FAN_IN) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 for each row of ``docs`` (doc_id, text).

    Texts are equal when they are so with A to Z in lower case; null counts as empty. Of equal texts
    the row with the largest (or smallest) doc_id stays; of repeated rows with that id one stays, and
    null ids stay only where there is no other. An empty table gives no rows; other columns are not read.
    """
    rows = entries(docs)
    best = cut(merged_runs(rows, keep, fan_in).select(*KEYS, F.col("doc_id").alias("keep_id"), F.col("row").alias("_stays"), "n", F.col("n").alias("group_size")))
    out = spread_join(rows, best, KEYS)
    return out.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("_stays")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The rows of ``docs`` that ``exact_classes`` keeps, with all their columns."""
    key, own = fresh(docs, "_digest"), fresh(docs, "_id")
    stay = exact_classes(docs, keep).where("kept").select(F.unhex("text_sha256").alias(key), F.col("doc_id").alias(own))
    named = docs.withColumn(key, F.unhex(F.sha2(normalised(F.col("text")), 256)))
    stay = cut(stay)
    kept = named.join(stay, (named[key] == stay[key]) & named["doc_id"].eqNullSafe(stay[own]), "left_semi")
    repeated = cut(kept.groupBy(key).count().where("count > 1").select(key))  # rows with the id and the text of the one that stays
    if not repeated.isEmpty():
        kept = kept.join(repeated, key, "left_anti").unionByName(kept.join(repeated, key, "left_semi").dropDuplicates([key]))
    return kept.select(docs.columns)


def oracle() -> str:
    return f"""
    with t as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') as text from documents)
    select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = max(doc_id) over g as kept, sha256(text) as text_sha256
    from t window g as (partition by text)
    """
