"""One query for each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import ann, arc, langid, mixing, ngram_join, packing, pii, quality, secrets, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_jaccard_join(_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_findings(_table(spark, sf_dir, "documents"))


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_spans(_table(spark, sf_dir, "documents"))


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100, among all vectors."""
    return ann.nearest_neighbours(_table(spark, sf_dir, "embeddings"), every=100)


def op9_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, put into ARC archives, as WARC records."""
    return arc.convert_arcs(arc.archives_of_pages(_table(spark, sf_dir, "pages")))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_id(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_token_counts": op1_token_counts,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
    "op4_secret_scan": op4_secret_scan,
    "op5_pii_spans": op5_pii_spans,
    "op6_source_mixing": op6_source_mixing,
    "op7_quality_rules": op7_quality_rules,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_arc_to_warc": op9_arc_to_warc,
    "op10_language_id": op10_language_id,
}

ORACLE_SQL = {
    "op3_ngram_jaccard_join": ngram_join.oracle_sql(),
    "op7_quality_rules": quality.oracle_sql(),
}
