"""Documents to chunk records, and what is kept of a corpus."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra.functions import markdown, numbers, text
from attestra.operators import quality
from attestra.session import spread


def preprocess(c: Column) -> Column:
    """Markdown without page furniture, uncaptioned tables, images and runs of blank lines."""
    return text.collapse_blank_lines(text.strip_images(markdown.without_fake_tables(text.strip_page_furniture(c))))


def sent_id(ref_id: Column, index: Column) -> Column:
    number = index.cast("string")
    return F.concat(ref_id, F.lit("::chunk-"), F.lpad(number, F.greatest(F.lit(4), F.length(number)), F.lit("0")))  # lpad cuts what is longer


def registered(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """Documents with type and category, PENDING where the registry has none."""
    joined = docs.join(registry.withColumnRenamed("ref_id", "_r"), F.col("ref_id") == F.col("_r"), "left").drop("_r")
    return joined.withColumn("rt_id", F.coalesce("rt_id", F.lit("PENDING"))).withColumn("ref_category", F.coalesce("ref_category", F.lit("PENDING")))


def chunk_documents(docs: DataFrame) -> DataFrame:
    """docs (ref_id, markdown, further columns) to chunk records: sent_id, text, section, segment_type,
    chunk_index, approx_tokens, embeddable, numeric_tokens, source_table_html and doc_metadata."""
    docs = spread(docs)
    md = F.col("markdown")
    meta = F.struct(text.title(md, F.col("ref_id")).alias("title"), text.year(md).alias("year"), text.doi(md).alias("doi"), text.trial_id(md).alias("trial_id")).alias("doc_metadata")
    cut = docs.withColumn("doc_metadata", meta).withColumn("c", F.explode(markdown.markdown_chunks(preprocess(md)))).drop("markdown")
    rows = cut.select("*", "c.*").drop("c", "char_count")
    rows = rows.withColumn("source_table_html", F.when(F.col("segment_type") == "table", F.col("text")))
    body = F.when(F.col("segment_type") == "table", text.strip_html(F.col("text"))).otherwise(F.col("text"))
    rows = rows.withColumn("text", text.normalize_unicode(body)).withColumn("embeddable", quality.embeddable(F.col("segment_type")))
    tokens = F.transform(numbers.numeric_tokens(F.when(F.col("embeddable"), F.col("text"))), lambda t: F.struct(t["value"].alias("value"), t["context"].alias("context")))
    return rows.withColumn("numeric_tokens", tokens).withColumn("sent_id", sent_id(F.col("ref_id"), F.col("chunk_index")))


def kept_chunks(chunks: DataFrame) -> DataFrame:
    """Without text under three tokens (tables stay), numbered anew from 0."""
    kept = chunks.where((numbers.approx_tokens(F.col("text")) >= 3) | (F.col("segment_type") == "table"))
    return kept.withColumn("chunk_index", F.row_number().over(Window.partitionBy("ref_id").orderBy("chunk_index")) - 1)


def next_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("next_index", F.lead("chunk_index").over(Window.partitionBy("ref_id").orderBy("chunk_index")))


def bibliography(chunks: DataFrame) -> DataFrame:
    """ref_id, doc_references: entries with their number, else their place, and 500 characters."""
    place = F.row_number().over(Window.partitionBy("ref_id").orderBy("chunk_index"))
    number = F.regexp_extract(F.trim("text"), r"^(\d+)\.\s+", 1).try_cast("int")
    rows = chunks.where("segment_type = 'reference'").withColumn("place", place).select("ref_id", "place", F.struct(F.coalesce(number, F.col("place")).alias("index"), F.substring(F.trim("text"), 1, 500).alias("text")).alias("entry"))
    return rows.groupBy("ref_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "entry"))), lambda x: x["entry"]).alias("doc_references"))


def with_references(chunks: DataFrame) -> DataFrame:
    return chunks.join(bibliography(chunks), "ref_id", "left").withColumn("doc_references", F.coalesce("doc_references", F.from_json(F.lit("[]"), "array<struct<index: int, text: string>>")))


def patched(points: DataFrame, patch: DataFrame, key: str, field: str) -> DataFrame:
    """Points with one payload field rewritten where the patch (key, field) has a row for them."""
    new = patch.select(F.col(key).alias("_k"), F.col(field).alias("_new"), F.lit(True).alias("_hit"))
    joined = points.join(new, F.col(key) == F.col("_k"), "left")
    return joined.withColumn(field, F.when(F.col("_hit"), F.col("_new")).otherwise(F.col(field))).drop("_k", "_new", "_hit")


def passages(chunks: DataFrame, by: str) -> DataFrame:
    """by, prompt: the passages (n, ref_id, rt_id, text) of a group in one text, each with its head lines.
    A group is what a judge reads, so its passages are few."""
    head = F.concat_ws("\n", F.concat(F.lit("### Passage "), F.col("n")), F.concat(F.lit("- **ref_id:** "), F.col("ref_id")), F.concat(F.lit("- **RT-ID:** "), F.col("rt_id")))
    one = F.concat(head, F.lit("\n\n**Evidence Text:**\n"), text.clean_passage(F.col("text")))
    return chunks.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", one.alias("p")))), lambda x: x["p"]), "\n\n---\n\n").alias("prompt"))


def typed_by_cues(name: Column, cues: list[tuple[str, str]], other: str) -> Column:
    """The type of the first cue that a name holds, in any case of letters."""
    rule = F
    for cue, rt in cues:
        rule = rule.when(F.lower(name).contains(cue), rt)
    return rule.otherwise(other)


def _point_ids(sent_ids: pd.Series) -> pd.Series:
    return sent_ids.map(lambda s: None if s is None else str(uuid.uuid5(uuid.NAMESPACE_DNS, s)))


def point_id(sent_id_: Column) -> Column:
    """Name-based identifier (version 5) of a chunk."""
    return F.pandas_udf(_point_ids, "string")(sent_id_)


def sources(chunks: DataFrame) -> DataFrame:
    """ref_id, rt_id (of the first chunk), chunk_count."""
    return chunks.groupBy("ref_id").agg(F.min_by("rt_id", "chunk_index").alias("rt_id"), F.count("*").alias("chunk_count"))
