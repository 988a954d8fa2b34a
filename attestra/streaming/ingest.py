"""Incremental ingest: new Markdown files to chunk records, each file once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from attestra.operators.corpus import chunk_documents
from attestra.sources.readers import ref_id


def ingest(spark: SparkSession, folder: str, chunks: str, checkpoint: str) -> StreamingQuery:
    """Chunk all files of a folder that no earlier run has seen, and append them; the stream's own log
    of files is the resume set."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.md").load(folder)
    docs = files.select(ref_id(), F.col("value").alias("markdown"))

    def add(batch: DataFrame, number: int) -> None:
        chunk_documents(batch).write.mode("overwrite").parquet(f"{chunks}/batch={number}")

    return docs.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
