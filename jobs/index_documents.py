"""Keep the sparse search index in step with a folder of documents that grows.

    python jobs/index_documents.py --config jobs/index_documents.json --documents DOCS --output INDEX --checkpoint MARK

A stream of files takes what earlier runs have not seen, ``files`` at a time, and ends when there is nothing more.  Each
part becomes a batch of the index (attestra/operators/inverted.py): postings by batch and bucket, ids and sums.  Statistics
add up, so the index is the same whether documents came in one run or in many.  A document is indexed once: rows with an id
that the index holds are left out.  A run that broke off is started again: Spark gives the open part the same number, and its
batch, which is known by the stream's id and that number, is written anew.  If the mark is lost, all files are read
again, and nothing is indexed twice.
"""

from __future__ import annotations

import json
import logging

if __name__ == "__main__":
    import command  # noqa: F401  finds the package
from pyspark.sql import DataFrame, SparkSession

from attestra.operators import inverted

log = logging.getLogger(__name__)


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, id: str = "doc_id", text: str = "text", files: int = 64, zone: int = inverted.ZONE) -> dict:
    """Index the documents (Parquet: a file, or a folder that grows) that are new; what was read and written."""
    schema = spark.read.parquet(documents).schema
    above, _, name = documents.rstrip("/").rpartition("/")
    # a stream takes a folder or a pattern; as a pattern a single file will do as well
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{above}/{{{name}}}").select(id, text)
    done = {"read": 0, "written": 0, "batches": 0}

    def add(rows: DataFrame, number: int) -> None:
        stream_id = json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]
        read, written = rows.count(), inverted.add(rows, id, text, output, zone, f"{stream_id}/{number}")
        log.info("part %d: read %d documents of %s, wrote %d to %s", number, read, documents, written, output)
        for name, n in (("read", read), ("written", written), ("batches", 1)):
            done[name] += n

    query = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    n, average = inverted.statistics(spark, output)
    log.info("read %d, wrote %d; the index has %d documents of %.1f tokens", done["read"], done["written"], n, average)
    return done | {"documents": n}


if __name__ == "__main__":
    command.start(run, {"documents": "Parquet file or folder", "output": "folder of the index", "checkpoint": "folder of the stream's mark"})
