"""Queries of this package, each over its whole table, and the SQL to compare them with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkaudit.llm.common import table


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkaudit.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkaudit.llm.mixing import taken_words

    return taken_words(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkaudit.llm.licenses import scan_lines

    return scan_lines(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkaudit.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkaudit.llm.html_text import extract_pages

    return extract_pages(table(spark, sf_dir, "pages"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkaudit.llm.line_dedup import clean_lines

    return clean_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkaudit.llm.quality import grade_documents

    docs = grade_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return docs.select("doc_id", "expected_grade", "tail_probability", "selected")


def op7_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkaudit.llm.codec import encoding_digests

    return encoding_digests(table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkaudit.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"))


def op10_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkaudit.llm.near_vectors import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"))


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkaudit.llm.exact import exact_classes

    return exact_classes(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkaudit.llm.divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from larkaudit.llm.periodic import run_digests

    return run_digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": op1_token_counts,
        "op2_mix_sources": op2_mix_sources,
        "op3_license_scan": op3_license_scan,
        "op4_jaccard_join": op4_jaccard_join,
        "op5_html_text": op5_html_text,
        "op6_line_dedup": op6_line_dedup,
        "op7_bpe_codec": op7_bpe_codec,
        "op8_quality": op8_quality,
        "op9_nearest": op9_nearest,
        "op10_near_vectors": op10_near_vectors,
        "op11_exact_dedup": op11_exact_dedup,
        "op12_source_divergence": op12_source_divergence,
        "op13_periodic_runs": op13_periodic_runs,
    }


def oracle_sql() -> dict[str, str]:
    from larkaudit.llm import divergence, exact, licenses, line_dedup

    return {
        "op3_license_scan": licenses.oracle(),
        "op6_line_dedup": line_dedup.oracle(),
        "op11_exact_dedup": exact.oracle(),
        "op12_source_divergence": divergence.oracle(),
    }
