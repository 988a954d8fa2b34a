"""Sinks: chunk tables, result logs, audit records, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.functions import text
from attestra.operators import inverted
from attestra.operators.corpus import point_id
from attestra.session import exists, kept


#: Payload fields that searches filter by, in the order in which rows are laid.
LAID_BY = ["rt_id", "ref_category", "ref_id", "sent_id"]


def write_index(chunks: DataFrame, path: str, dim: int | None = None) -> int:
    """Replace the index table: chunks with vectors of one size, with their point ids, a folder for each segment
    type.  Rows lie in ranges of their payload fields, so files and row groups that a filter on type, category,
    source or sentence rules out are not read; sentence ids have a bloom filter besides.
    Returns the number written, which must equal the number there should be."""
    valid = chunks.where(F.size("vector") > 0) if dim is None else chunks.where(F.size("vector") == dim)
    laid = [c for c in LAID_BY if c in chunks.columns]
    rows = valid.withColumn("point_id", point_id(F.col("sent_id"))).repartitionByRange("segment_type", *laid).sortWithinPartitions("segment_type", *laid)
    rows.write.mode("overwrite").option("parquet.bloom.filter.enabled#sent_id", "true").partitionBy("segment_type").parquet(path)
    n, there = valid.count(), chunks.sparkSession.read.parquet(path).count()
    if n != there:
        raise RuntimeError(f"{there} of {n} points are in the index")
    return n


def write_sparse(chunks: DataFrame, path: str) -> int:
    """The second, sparse collection of chunks (sent_id, text): term frequencies and lengths of those that it does not hold
    yet, as one more batch of a kept inverted index.  Nothing stored depends on the other chunks, so running again after a
    break, or when there are more chunks, goes on with what is missing.  Returns the number of chunks there."""
    inverted.add(chunks, "sent_id", "text", path)
    return inverted.statistics(chunks.sparkSession, path)[0]


def sparse_points(spark: SparkSession, path: str) -> DataFrame:
    """point_id, sent_id, indices, values (token numbers and BM25 weights without idf, by the corpus as it is now) under
    the ids of the dense collection.  Idf is the searcher's part.  Chunks without an indexed token have no point."""
    weights = inverted.postings(spark, path).select(F.col("id").alias("sent_id"), text.token_index(F.col("token")).alias("index"), "weight")
    # tokens whose numbers collide are one entry
    entries = weights.groupBy("sent_id", "index").agg(F.sum("weight").alias("value"))
    points = entries.groupBy("sent_id").agg(F.sort_array(F.collect_list(F.struct("index", "value"))).alias("e"))
    return points.select(point_id(F.col("sent_id")).alias("point_id"), "sent_id", F.col("e.index").alias("indices"), F.col("e.value").alias("values"))


def upsert(rows: DataFrame, path: str, key: list[str], at: str, buckets: int = 64) -> list[int]:
    """Put rows into a table that has one row for each key: the one with the greatest ``at``, of the new ones if two are as great.

    The table lies in folders by hash of the key.  Only folders that a new row belongs to are read, and replaced by Spark's
    dynamic overwrite; the others keep their files.  Putting the same rows in again, as after a run that broke off, gives the
    same table.  Rows with a null in their key are one key; of new rows alike in key and ``at`` the one with the greater hash
    counts.  Returns the folders that were replaced.
    """
    spark, names = rows.sparkSession, rows.columns
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
    touched = sorted(r[0] for r in dealt.select("bucket").distinct().collect())
    if not touched:
        return []
    both = dealt.withColumn("_new", F.lit(1))
    if exists(spark, path):
        both = both.unionByName(spark.read.parquet(path).where(F.col("bucket").isin(touched)).withColumn("_new", F.lit(0)), allowMissingColumns=True)
    hashed = F.xxhash64(*[c for c, kind in both.dtypes if not kind.startswith("map") and c != "_new"])
    order = Window.partitionBy("bucket", *key).orderBy(F.desc_nulls_last(at), F.desc("_new"), F.desc(hashed))
    # computed before the folders that it was read from are replaced
    last = kept(both.withColumn("_n", F.row_number().over(order)).where("_n = 1").select(*names, *[c for c in both.columns if c not in {*names, "_new", "_n", "bucket"}], "bucket"))
    laid = last.repartition("bucket").sortWithinPartitions("bucket", *key)
    laid.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    return touched


def append_new(rows: DataFrame, path: str, key: str) -> None:
    """Append rows whose key the log does not hold yet; running it again changes nothing."""
    spark = rows.sparkSession
    if exists(spark, path):
        rows = rows.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    rows.write.mode("append").parquet(path)


def write_audit(records: DataFrame, folder: str, at: str = "audited_at") -> None:
    """Audit records as JSON, one file for each, in a folder audit_{claim type}_{time}: Spark names folders, not
    files.  Records of one type and time get numbers, after those that are there.  A record that is there already
    (``record_key``, of its content) is not written again.  Without a time column, the time of writing."""
    spark = records.sparkSession
    time = F.col(at) if at in records.columns else F.current_timestamp()
    name = F.concat_ws("_", F.lit("audit"), F.coalesce("ct_id", F.lit("none")), F.date_format(time, "yyyyMMdd_HHmmss"))
    content = F.sha2(F.to_json(F.struct(*records.columns)), 256)
    named = records.withColumn("record_key", content).withColumn("_name", name).dropDuplicates(["record_key"])
    held = F.lit(0)
    if exists(spark, folder):
        there = spark.read.schema("record_key string, audit string").json(folder)
        counts = there.groupBy(F.regexp_extract("audit", r"^(audit_.*?_\d{8}_\d{6})", 1).alias("_name")).agg(F.count("*").alias("_held"))
        named = named.join(there.select("record_key"), "record_key", "left_anti").join(counts, "_name", "left")
        held = F.coalesce("_held", F.lit(0))
    number = F.row_number().over(Window.partitionBy("_name").orderBy("record_key")) + held
    audit = F.when(number == 1, F.col("_name")).otherwise(F.concat_ws("_", "_name", number))
    named.withColumn("audit", audit).drop("_name", "_held").repartition("audit").write.mode("append").partitionBy("audit").json(folder)


def write_report(lines: DataFrame, folder: str) -> None:
    """A report's lines in order, in one file: a report has one line per document and claim type."""
    lines.orderBy("line_no").coalesce(1).select("line").write.mode("overwrite").text(folder)
