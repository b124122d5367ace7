"""Structured Streaming ingestion into collections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.chunking import ChunkConfig
from ..operators.embed import VectorizerConfig
from ..sources.catalog import Collection
from ..sources.documents import ingest, process_documents


def vectors_to_collection(stream: DataFrame, collection: Collection, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Upsert a stream of ``id, vector[, metadata]``, batch by batch; a batch that is repeated after a failure changes nothing."""

    def write(batch: DataFrame, _: int) -> None:
        collection.insert_dataframe(batch)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def files_to_collection(spark: SparkSession, path: str, collection: Collection, checkpoint: str, strategy: str = "sentence", config: ChunkConfig | None = None, trigger: dict | None = None) -> StreamingQuery:
    """Process, chunk, embed and upsert the files that appear in a folder; ids follow from contents, so none comes twice."""
    vectorizer = VectorizerConfig(**{"dimensions": collection.meta.dimensions} | (collection.meta.vectorizer or {}))
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").load(path)

    def write(batch: DataFrame, _: int) -> None:
        rows = ingest(process_documents(batch), vectorizer, strategy, config)
        collection.insert_dataframe(rows.where("error IS NULL").drop("error"))

    return files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**trigger or {"availableNow": True}).start()


def distinct_events(stream: DataFrame, keys: list[str], time_col: str = "ts", delay: str = "1 hour") -> DataFrame:
    """A stream without repeats of the keys; state older than ``delay`` is let go."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(keys)
