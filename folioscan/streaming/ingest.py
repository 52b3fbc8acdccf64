"""Streaming ingest: new files replace their sources in the index, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from folioscan.functions.vectors import HashingEmbedder
from folioscan.operators.index import ChunkIndex
from folioscan.plans.pipeline import embedded_chunks, prepare_chunks
from folioscan.plans.settings import Settings
from folioscan.runtime import materialise
from folioscan.sources.files import indexable, read_sections


def file_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Files as they arrive, by the rules of ``discover_files``: path, source (relative path), format, content."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return indexable(spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder), folder)


def ingest_batch(index: ChunkIndex, settings: Settings, errors: Callable[[DataFrame], None] | None = None) -> Callable[[DataFrame, int], None]:
    """Handler of one micro-batch. Replacing a source twice gives the same table, so a repeated batch does no harm. Sections and rows are written once."""
    embedder = HashingEmbedder(settings.hashing_dim)

    def handle(batch: DataFrame, _: int) -> None:
        sections = materialise(read_sections(batch), "sections")
        if errors is not None:
            errors(sections.where(F.col("error").isNotNull()))
        good = sections.where(F.col("error").isNull())
        docs = good.groupBy("source").agg(F.first("format").alias("format"), F.lit("").alias("title"), F.collect_set(F.when(F.col("ocr"), F.col("page"))).alias("ocr_pages"))
        rows = materialise(embedded_chunks(prepare_chunks(good, settings), docs, embedder), "rows")
        if not rows.isEmpty():
            index.replace_all(rows)

    return handle


def start(spark: SparkSession, folder: str, index: ChunkIndex, checkpoint: str, settings: Settings = Settings(), *, available_now: bool = True) -> StreamingQuery:
    """Start the stream; with ``available_now`` it ends when all present files are in."""
    writer = file_stream(spark, folder).writeStream.foreachBatch(ingest_batch(index, settings)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
