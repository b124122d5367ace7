"""Mixing sources to target weights by repetition and hash-seeded sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import fresh, written
from .tokens import TOKENIZER, token_sizes

SMALL = 100_000


def source_rates(
    docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, budget: float = 1.0, source_col: str = "source", text_col: str = "text", size: Column | None = None, tokenizer: str = TOKENIZER
) -> DataFrame:
    """``source, n_tokens, rate``: how often each source's documents must come for its share to be its weight.

    The mix is to hold ``budget`` times the tokens of all documents: tokens as ``token_counts`` counts them, or the
    whole numbers of ``size``.  A source not in ``weights`` has ``default_weight``; weights count against their sum
    over the sources present.  A source without tokens has rate 1: it can't reach any share, and its documents are
    kept as they are.
    """
    if default_weight < 0 or any(w < 0 for w in (weights or {}).values()) or budget < 0:
        raise ValueError("weights and budget must not be negative")
    sized = docs.select(F.col(source_col).alias("source"), F.col(text_col).alias("text") if size is None else size.cast("bigint").alias("n"))
    sized = token_sizes(sized, "n", tokenizer) if size is None else sized
    found = sized.groupBy("source").agg(F.sum("n").alias("n_tokens"))
    weight = F.lit(float(default_weight))
    for name, w in (weights or {}).items():
        weight = F.when(F.col("source") == name, F.lit(float(w))).otherwise(weight)
    found = written(found.withColumn("weight", F.when(F.col("n_tokens") > 0, weight).otherwise(0.0)), "mix_sources")  # a row a source, used twice
    whole = found.agg(F.sum("weight").alias("all_weight"), F.sum("n_tokens").alias("all_tokens"))
    rate = F.when((F.col("n_tokens") > 0) & (F.col("all_weight") > 0), F.col("weight") * F.lit(float(budget)) * F.col("all_tokens") / F.col("all_weight") / F.col("n_tokens"))
    return found.crossJoin(F.broadcast(whole)).select("source", "n_tokens", F.coalesce(rate, F.when(F.col("n_tokens") > 0, 0.0).otherwise(1.0)).alias("rate"))


def mix_sources(
    docs: DataFrame, weights: dict[str, float] | None = None, default_weight: float = 1.0, budget: float = 1.0, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size: Column | None = None,
    tokenizer: str = TOKENIZER,
) -> DataFrame:
    """Emit each document floor(rate) times, and once more with probability rate - floor(rate); see ``source_rates``.

    The chance is a hash of ``seed``, id and source, so a rerun draws the same and rows that repeat an id draw
    alike.  Returns the columns of ``docs``, whatever their names, and ``copy_no``, 0 for a document's first copy; an
    input column of that name is replaced.  A null source is a source of its own; a null id draws as the empty string;
    a null or empty text has no tokens and is drawn at its source's rate.  An empty table gives no rows.
    """
    names = [c for c in docs.columns if c != "copy_no"]
    source, of, copies = fresh([*names, "copy_no"], "source", "rate", "copies")
    # One small row a source, computed once: the texts are not shuffled to meet it unless there are very many.
    rates = written(source_rates(docs, weights, default_weight, budget, source_col, text_col, size, tokenizer).select(F.col("source").alias(source), F.col("rate").alias(of)), "mix_rates")
    if rates.count() <= SMALL:
        rates = F.broadcast(rates)
    drawn = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(source_col), F.lit("")))), 1, 8), 16, 10).cast("bigint") / 4294967296.0
    joined = docs.join(rates, F.col(source_col).eqNullSafe(F.col(source)))
    n = (F.floor(of) + F.when(drawn < F.col(of) - F.floor(of), 1).otherwise(0)).cast("int")
    joined = joined.withColumn(copies, n).where(F.col(copies) > 0)
    return joined.select(*names, F.explode(F.sequence(F.lit(0), F.col(copies) - 1)).alias("copy_no"))


def oracle_sql(table: str = "documents", columns: str = "doc_id, text, lang, source, n_chars", seed: str = "mix") -> str:
    """DuckDB SQL for mix_sources with equal weights, a budget of 1 and words as tokens (SQL has no byte-pair merging)."""
    return f"""
WITH counted AS (SELECT {columns}, len(regexp_extract_all(coalesce(text, ''), '[^\\t\\n\\f\\r ]+')) AS n FROM {table}),
per AS (SELECT source, sum(n) AS tokens FROM counted GROUP BY source),
rates AS (
  SELECT source, CASE WHEN tokens = 0 THEN 1.0::DOUBLE
    ELSE 1.0::DOUBLE * (SELECT sum(tokens) FROM per)::DOUBLE / (SELECT count(*) FROM per WHERE tokens > 0)::DOUBLE / tokens::DOUBLE END AS rate FROM per),
drawn AS (
  SELECT {", ".join("c." + x.strip() for x in columns.split(","))}, floor(rate)::INT + CASE WHEN ('0x' || substr(md5('{seed}|' || coalesce(doc_id::VARCHAR, '') || '|' || coalesce(c.source, '')), 1, 8))::BIGINT / 4294967296.0::DOUBLE
    < rate - floor(rate) THEN 1 ELSE 0 END AS copies
  FROM counted c JOIN rates r ON c.source IS NOT DISTINCT FROM r.source)
SELECT {columns}, unnest(range(copies))::INT AS copy_no FROM drawn"""
