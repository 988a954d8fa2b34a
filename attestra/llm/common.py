"""What the operators of this folder share: inputs, materialising, components."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.session import checkpoints, kept, spread

#: Words of the contracts: runs of bytes that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Stands for a null doc_id inside the operators: larger than every real id.
NO_ID = 2**63 - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table, over all cores."""
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def by_place(docs: DataFrame) -> tuple[DataFrame, Callable[[str], str]]:
    """docs with its columns renamed by place, so that no name of its own clashes with ours; and the
    new name of a column."""
    names = docs.columns
    return docs.toDF(*[f"c{i}" for i in range(len(names))]), lambda name: f"c{names.index(name)}"


def bound_batches(spark: SparkSession, rows: int = 4096, megabytes: int = 8) -> None:
    """Arrow batches to Python hold few rows and few bytes, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(megabytes << 20))


def shared_path(spark: SparkSession) -> str:
    """The shared folder itself, for tables that are written and read again."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    checkpoints(spark)
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialise(df: DataFrame) -> DataFrame:
    """Compute once, into the shared checkpoint folder: later reads survive lost executors."""
    return kept(df)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of ours, in whatever store it is."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def runs_of_key(batches: Iterable[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Re-cut batches that are sorted by key: pieces of about so many rows, no key in two pieces."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if n >= rows:
            whole = pa.Table.from_batches(held)
            last = whole[key][-1]
            if batch[key][0] != last:
                yield whole
                held, n = [], 0
            elif batch[key][-1] != last:
                codes = batch[key].to_numpy(zero_copy_only=False)
                cut = int((codes != codes[0]).argmax())
                held.append(batch.slice(0, cut))
                yield pa.Table.from_batches(held)
                held, n, batch = [], 0, batch.slice(cut)
        held.append(batch)
        n += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)


def joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels of rows, each the first row of its piece so far, after the pieces of pairs a, b are joined."""
    apart = label[a] != label[b]
    a, b = a[apart], b[apart]
    while len(a):
        low, before = np.minimum(label[a], label[b]), label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(up := label[label], label):
            label = up
        if np.array_equal(before, label):
            break
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def first_by_hash(rows: DataFrame, by: str, each: int) -> DataFrame:
    """At most ``each`` rows of every value of ``by``: the first by hash of their ``id``.

    Values are counted first, and only about four times the wanted rows of a value are ranked, so a
    value that most rows have is no one task's work.  There are few values (labels, or languages up to
    a bound), so their counts go to every task.
    """
    order, span = F.pmod(F.xxhash64("id"), F.lit(1 << 40)), float(1 << 40)
    counts = rows.groupBy(by).agg(F.count("*").alias("_all"))
    near = rows.withColumn("_order", order).join(F.broadcast(counts), by).where(F.col("_order") < F.lit(span * (4 * each + 40)) / F.col("_all"))
    place = F.row_number().over(Window.partitionBy(by).orderBy("_order", "id"))
    return near.withColumn("_place", place).where(F.col("_place") <= each).drop("_place", "_order", "_all")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of an edge table (a long, b long): (node, component), the
    component being the smallest node in it.  Nodes without an edge do not appear.

    Alternating large-star and small-star steps.  Each step is one minimum per node and one
    equi-join, so a node of any degree is summed by partial aggregation and its join may be
    split by AQE; no neighbour list is ever collected.  Every round is checkpointed.
    """

    def distinct(df: DataFrame) -> DataFrame:
        return df.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    def star(sym: DataFrame, least: DataFrame) -> DataFrame:
        return sym.join(least, "u")

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        return tuple(row)

    now = materialise(distinct(edges))
    seen = mark(now)
    for _ in range(rounds):
        if not seen[0]:
            break
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = distinct(star(both, least).where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")))
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        low = down.groupBy("u").agg(F.min("v").alias("m"))
        joined = star(down, low)
        small = distinct(joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(low.select(F.col("u").alias("a"), F.col("m").alias("b"))))
        now = materialise(small)
        before, seen = seen, mark(now)
        if seen == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
