"""The opN_<name> queries and the pipeline, over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, chatformat, decontaminate, langid, licenses, merkle, mixing, pii, sharding, simhash, tokenfiles, urlfilter, variants

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatformat.format_chats(table(spark, sf_dir, "conversations"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("row_key")


def op3_merkle_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.compare_edited(table(spark, sf_dir, "documents"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"), weights=(1, 2, 3), most=3, seed=0)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op6_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), pii.session_key(spark))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.predict_languages(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link_fingerprints(table(spark, sf_dir, "documents"), shingle=4, seed=42, radius=4)


def op10_sampled_splitter_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), shards=8)


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digests(table(spark, sf_dir, "documents"), kind="ends")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.written_digests(table(spark, sf_dir, "documents"), end_id=0)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.group_variants(table(spark, sf_dir, "documents"), letters=6, least=5, every=199, times=5)


QUERIES: dict[str, Query] = {
    "op1_chat_formatting": op1_chat_formatting,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_merkle_fingerprints": op3_merkle_fingerprints,
    "op4_source_mixing": op4_source_mixing,
    "op5_license_scan": op5_license_scan,
    "op6_pii_pseudonyms": op6_pii_pseudonyms,
    "op7_language_id": op7_language_id,
    "op8_url_filter": op8_url_filter,
    "op9_simhash_near_dedup": op9_simhash_near_dedup,
    "op10_sampled_splitter_shards": op10_sampled_splitter_shards,
    "op11_token_alignment": op11_token_alignment,
    "op12_token_files": op12_token_files,
    "op13_spelling_variants": op13_spelling_variants,
}

#: Hashes, models and components of the others have no counterpart in DuckDB.
ORACLE: dict[str, str] = {"op5_license_scan": licenses.duckdb_sql(), "op8_url_filter": urlfilter.duckdb_sql()}
