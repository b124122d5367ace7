"""A training corpus from raw documents: rules, near duplicates, personal data, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and is given what the stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lattica.llm.dedup import keep_one
from lattica.llm.mixing import mix_sources
from lattica.llm.ngram_join import ngram_jaccard_join
from lattica.llm.packing import best_fit_packing
from lattica.llm.pii import mask_pii
from lattica.llm.quality import quality_filter
from lattica.llm.shared import drop_tables, tables, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no certified quality rule rejects."""
    return quality_filter(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group that n-gram Jaccard similarity connects."""
    return keep_one(docs, ngram_jaccard_join(docs))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Identifiers masked in the texts, disguised ones too; ``n_chars`` follows."""
    return mask_pii(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or drawn so that all sources have the same weight; a document may come several times."""
    return mix_sources(docs).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bins of documents and their pieces."""
    return best_fit_packing(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("source_mix", source_mix), ("packed", packed)]

#: SQL can't express the masking of disguised personal data; tests hold the result against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows.  A stage's tables are deleted when the next one's input is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), set(tables())
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline_{name}")
        drop_tables(spark, [t for t in tables()[:-1] if t not in before])
    return STAGES[-1][1](spark, docs, sf_dir)
