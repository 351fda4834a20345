"""Registered queries of this subpackage over the given tables, with SQL where DuckDB can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from evalgrain.llm.common import table
from evalgrain.llm.oracles import centroids_sql, minhash_sql, vector_codes_sql


def op1_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    from evalgrain.llm.simhash_pivot import groups

    return groups(table(spark, folder, "documents"))


def op2_language(spark: SparkSession, folder: str) -> DataFrame:
    from evalgrain.llm.ppm_language import identify

    return identify(table(spark, folder, "documents"))


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from evalgrain.llm.token_transducer import token_counts

    return token_counts(table(spark, folder, "documents"))


def op4_main_text(spark: SparkSession, folder: str) -> DataFrame:
    from evalgrain.llm.html_region import extract

    return extract(table(spark, folder, "pages"))


def op5_contamination(spark: SparkSession, folder: str) -> DataFrame:
    from evalgrain.llm.spaced_seed import contamination

    return contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op6_nearest(spark: SparkSession, folder: str) -> DataFrame:
    from evalgrain.llm.kmeans_tree import nearest

    return nearest(table(spark, folder, "embeddings"))


def op7_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from evalgrain.llm.suffix_levels import report

    return report(table(spark, folder, "documents"))


def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    from evalgrain.llm.url_model import filter_urls

    return filter_urls(table(spark, folder, "pages"))


def op9_licenses(spark: SparkSession, folder: str) -> DataFrame:
    from evalgrain.llm.license_index import license_scan

    return license_scan(table(spark, folder, "documents"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    from evalgrain.llm.best_fit import pack

    return pack(table(spark, folder, "documents"), added=True)


def op11_vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    from evalgrain.llm.cover_tree import codes

    return codes(table(spark, folder, "embeddings"))


def op12_centroids(spark: SparkSession, folder: str) -> DataFrame:
    from evalgrain.llm.va_file import clusters

    return clusters(table(spark, folder, "embeddings"))


def op13_minhash(spark: SparkSession, folder: str) -> DataFrame:
    from evalgrain.llm.minhash_bands import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


QUERIES = {f.__name__: f for f in (
    op1_simhash_groups, op2_language, op3_token_counts, op4_main_text, op5_contamination, op6_nearest, op7_suffix_dedup,
    op8_url_filter, op9_licenses, op10_packing, op11_vector_codes, op12_centroids, op13_minhash, pipeline)}
ORACLES: dict[str, str] = {
    "op11_vector_codes": vector_codes_sql(), "op12_centroids": centroids_sql(), "op13_minhash": minhash_sql()}
