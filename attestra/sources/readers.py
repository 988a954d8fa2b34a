"""Sources: Markdown folders, chunk files, workbooks, parse results, mapping files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.functions import text
from attestra.operators.claims import trimmed

CHUNK_SCHEMA = """
sent_id string, ref_id string, rt_id string, ref_category string, reference_type_name string, text string, section string,
segment_type string, chunk_index int, approx_tokens int, embeddable boolean, numeric_tokens array<struct<value: string, context: string>>,
source_table_html string, vector array<float>,
doc_metadata struct<title: string, authors: array<string>, journal: string, year: int, doi: string, volume: string, issue: string,
page_range: string, publisher: string, trial_id: string, authors_str: string>
"""
PARSE_SCHEMA = """
chunks array<struct<id: string, type: string, markdown: string, grounding: struct<page: int, box: map<string, double>>>>,
grounding map<string, struct<confidence: double>>, markdown string
"""
#: Places of a workbook's columns.
WORKBOOK = {0: "document", 1: "page", 2: "source_type", 4: "claim", 5: "ref_num", 6: "references", 10: "category", 11: "refers_to", 12: "ct_id"}


def stem(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]+$", "")


def ref_id() -> Column:
    """The key of a file that is read: its name without the ending, as it is in the folder (paths come
    percent-encoded; a plus sign is one).  Batch and stream share it, so their ids are the same."""
    return F.url_decode(F.replace(stem(F.col("_metadata.file_path")), F.lit("+"), F.lit("%2B"))).alias("ref_id")


def read_markdown(spark: SparkSession, folder: str) -> DataFrame:
    """ref_id (the file's stem), markdown: one row per file."""
    files = spark.read.option("pathGlobFilter", "*.md").text(folder, wholetext=True)
    return files.select(ref_id(), F.col("value").alias("markdown"))


def read_pages(spark: SparkSession, folder: str, pages: Callable[[bytes], list[str]], glob: str = "*.pdf") -> DataFrame:
    """ref_id, page (from 1), text: pages of binary files without a parse reply, by a given extractor.  A file that
    it cannot read has one row, its page and text null.  Pages without text are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for ref, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    found = pages(content)
                except Exception:  # whatever the extractor raises, the other files go on
                    rows.append((ref, None, None))
                    continue
                rows += [(ref, n, t.strip()) for n, t in enumerate(found, 1) if t and t.strip()]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.string()), strict=True)], ["ref_id", "page", "text"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
    return files.select(ref_id(), "content").mapInArrow(run, "ref_id string, page int, text string")


def read_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """Chunk records of all files of a folder, each a JSON array."""
    return spark.read.schema(CHUNK_SCHEMA).option("multiLine", True).option("pathGlobFilter", "*.chunks.json").json(folder)


def read_workbook(spark: SparkSession, path: str) -> DataFrame:
    """Claims of a workbook saved as CSV, by the place of its columns; row numbers as the sheet has them."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    names = [raw.columns[i] for i in WORKBOOK]
    rows = raw.select(*[trimmed(F.col(f"`{n}`")).alias(WORKBOOK[i]) for i, n in zip(WORKBOOK, names, strict=True)], F.monotonically_increasing_id().alias("_at"))
    numbered = rows.withColumn("row", (F.row_number().over(Window.orderBy("_at")) + 1).cast("int")).drop("_at")
    return numbered.withColumn("source_type", F.lower("source_type"))


def parsed_chunks(replies: DataFrame, body: str) -> DataFrame:
    """Chunks of parse replies (JSON): anchors gone, empty ones left out, page, box and confidence attached."""
    reply = F.from_json(body, PARSE_SCHEMA)
    rows = replies.withColumn("r", reply).select("*", F.posexplode("r.chunks").alias("place", "c"))
    out = rows.withColumn("text", text.strip_anchors(F.col("c.markdown"))).where("text <> ''")
    return out.select(
        *[c for c in replies.columns if c != body], "place", F.col("c.id").alias("chunk_id"), F.coalesce("c.type", F.lit("text")).alias("chunk_type"), "text",
        F.coalesce("c.grounding.page", F.lit(0)).alias("page"), F.col("c.grounding.box").alias("bbox"), F.element_at("r.grounding", F.col("c.id"))["confidence"].alias("confidence"),
    )


def uncached(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """What a cache does not hold; rows that could not be read (null body) count as not there."""
    return wanted.join(cache.where("body is not null").select(key).distinct(), key, "left_anti")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no, line of one text file."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.posexplode(F.split("value", "\n")).alias("line_no", "line"))
