"""Retrieval building blocks: several collections, de-duplication, grouping of chunks, history, context."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .search import ranked, scored

_OVERVIEW = re.compile(r"\b(?:overview|summary|summari[sz]e|everything|all (?:the )?(?:documents|files|data)|list all|what do you (?:have|know)|in general|tell me about)\b", re.I)


def _some(c: Column) -> Column:
    return F.when(F.length(c) > 0, c)


def dedup_key(columns: list[str]) -> Column:
    """file name and chunk number; else URL and title; else title, source and time, as far as such columns exist."""
    has = lambda *names: all(n in columns for n in names)
    s = lambda n: _some(F.col(n).cast("string")) if n in columns else F.lit(None).cast("string")
    by_file = F.when(s("filename").isNotNull() & s("chunk_index").isNotNull(), F.concat_ws("|", F.lit("f"), s("filename"), s("chunk_index")))
    by_url = F.when(s("url").isNotNull(), F.concat_ws("|", F.lit("u"), s("url"), F.coalesce(s("title"), F.lit("")))) if has("url") else F.lit(None).cast("string")
    rest = F.concat_ws("|", F.lit("t"), *[F.coalesce(s(n), F.lit("")) for n in ("title", "source", "timestamp")])
    return F.coalesce(by_file, by_url, rest)


def dedup_best(results: DataFrame, key: Column | None = None, score: str = "score", id_col: str = "id") -> DataFrame:
    """Of the results with one key the best; ties go to the smaller id."""
    w = Window.partitionBy("__key").orderBy(F.desc(score), id_col)
    return results.withColumn("__key", dedup_key(results.columns) if key is None else key).withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__key")


def expand_overview(query: str, limit: int, min_score: float) -> tuple[int, float]:
    """More results, and weaker ones, for a question about everything: ten times as many, 50 at most."""
    return (min(50, 10 * limit), max(0.1, min_score - 0.2)) if _OVERVIEW.search(query) else (limit, min_score)


def multi_search(collections: dict[str, DataFrame], query: Column, metric, limit: int = 10, min_score: float = 0.3, id_col: str = "id", vector_col: str = "vector", dedup: bool = True) -> DataFrame:
    """The best results of all collections, each with its ``collection``: each collection's top, united, without repeats, cut."""
    parts = [ranked(scored(df, query, metric, vector_col).where(F.col("score") >= min_score).drop(vector_col).withColumn("collection", F.lit(name)), limit, id_col=id_col) for name, df in collections.items()]
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return ranked(dedup_best(found, id_col=id_col) if dedup else found, limit, id_col=id_col)


def multi_source(results: dict[str, DataFrame], limit: int = 10, min_score: float = 0.3, id_col: str = "id") -> DataFrame:
    """Results of several sources with ``source_type`` and 1-based ``rank``: the top of all first, then the threshold."""
    found = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn("source_type", F.lit(name)) for name, df in results.items()])
    top = ranked(found, limit, id_col=id_col).where(F.col("score") >= min_score)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), id_col)))  # one window over at most ``limit`` rows


def group_chunks(chunks: DataFrame, content_col: str = "content", order_col: str = "position", time_col: str | None = None) -> DataFrame:
    """Documents of chunks: ``document, total_chunks, total_size, chunks`` (each with a 200-character preview).

    A document is the first that isn't empty of document_id, content_hash, filename and id.
    """
    key = F.coalesce(*[_some(F.col(c).cast("string")) for c in ("document_id", "content_hash", "filename", "id") if c in chunks.columns])
    piece = F.struct(F.col(order_col).alias("position"), F.substring(content_col, 1, 200).alias("preview"))
    extra = [F.max(time_col).alias("newest")] if time_col else []
    out = chunks.groupBy(key.alias("document")).agg(F.count("*").alias("total_chunks"), F.sum(F.length(content_col)).alias("total_size"), F.sort_array(F.collect_list(piece)).alias("chunks"), *extra)
    return out.orderBy(F.desc("newest"), "document") if time_col else out


def number_chunks(chunks: DataFrame, doc_col: str = "doc_id", position_col: str = "position") -> DataFrame:
    """``chunks`` with ``chunk_index, total_chunks, is_chunk, original_doc_id``."""
    total = F.count("*").over(Window.partitionBy(doc_col))
    return chunks.withColumns({"chunk_index": F.col(position_col), "total_chunks": total, "is_chunk": total > 1, "original_doc_id": F.col(doc_col)})


def history(messages: DataFrame, session, offset: int = 0, limit: int = 50, session_col: str = "conv_id", order_col: str = "turn") -> DataFrame:
    """A page of a session's messages, oldest first."""
    out = messages.where(F.col(session_col) == session).orderBy(order_col)
    return (out.offset(offset) if offset else out).limit(limit)


def sessions(messages: DataFrame, session_col: str = "conv_id", order_col: str = "turn") -> DataFrame:
    """One row a session: ``messages``, its first user message and its last turn."""
    first = F.min_by("text", F.when(F.col("role") == "user", F.col(order_col)))
    return messages.groupBy(session_col).agg(F.count("*").alias("messages"), first.alias("opening"), F.max(order_col).alias("last_turn"))


def last_messages(messages: DataFrame, n: int = 5, session_col: str = "conv_id", order_col: str = "turn") -> DataFrame:
    """Each session's last ``n`` messages."""
    rank = F.row_number().over(Window.partitionBy(session_col).orderBy(F.desc(order_col)))
    return messages.withColumn("__n", rank).where(F.col("__n") <= n).drop("__n")


def fit_context(results: DataFrame, budget: int, group_col: str | None = None, content_col: str = "content", score: str = "score", id_col: str = "id") -> DataFrame:
    """The best results whose estimated tokens (a quarter of the characters) together stay within ``budget``, for each group."""
    tokens = F.floor(F.length(content_col) / 4)
    w = Window.partitionBy(*([group_col] if group_col else [F.lit(0)])).orderBy(F.desc(score), id_col).rowsBetween(Window.unboundedPreceding, 0)
    return results.withColumn("tokens", tokens).withColumn("running_tokens", F.sum("tokens").over(w)).where(F.col("running_tokens") <= budget)


def prompt_context(results: DataFrame, title_col: str = "title", content_col: str = "content", score: str = "score", id_col: str = "id") -> DataFrame:
    """``context``: each result under a line that names its source and score, best first."""
    part = F.concat(F.lit("--- Source: "), F.coalesce(F.col(title_col), F.lit("unknown")), F.lit(" (Score: "), F.replace(F.format_number(F.col(score), 3), F.lit(","), F.lit("")), F.lit(") ---\n"), F.coalesce(F.col(content_col), F.lit("")))
    held = F.sort_array(F.collect_list(F.struct((-F.col(score)).alias("a"), F.col(id_col).alias("b"), part.alias("part"))))
    return results.agg(F.array_join(F.transform(held, lambda x: x["part"]), "\n\n").alias("context"))


def new_urls(found: DataFrame, known: DataFrame, url_col: str = "url") -> DataFrame:
    """Rows of ``found`` whose URL isn't known yet, the fragment and a closing slash aside; one for each."""
    key = lambda c: F.regexp_replace(F.regexp_replace(c, "#.*$", ""), "/$", "")
    w = Window.partitionBy("__url").orderBy(url_col)
    fresh = found.withColumn("__url", key(F.col(url_col))).join(known.select(key(F.col(url_col)).alias("__url")).distinct(), "__url", "left_anti")
    return fresh.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n", "__url")
