"""Mixing sources to target weights by a low-discrepancy schedule (native)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.llm.common import WORD, by_place, materialise, table

GOLDEN = 0.6180339887498949
#: Cells of the unit interval by which slots meet sources; hash ranges that split a source's running sums.
CELLS, RANGES = 4096, 4096
#: Slots whose ranks in a source are counted together.
CHUNK = 65536


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, key (its source; null sorts last), size in words, h (shuffling hash)."""
    return docs.select(
        "doc_id",
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("t")).alias("key"),
        F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("doc_id", "text").alias("h"),
    )


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """key, s (words of the source), target: the weights' share of all words, filled up to
    cap * s; what is above is shared again by weight.

    The fixed point has a closed form.  With sources ordered by cap * s / weight, those before
    the first one that the common level (rest of words / rest of weight) does not fill are full,
    and all others stand at that level.  One row per source takes part.
    """
    per = sizes.groupBy("key").agg(F.sum("size").alias("s"))
    whole = Window.partitionBy()
    before = Window.orderBy("r", "key").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("i", F.row_number().over(Window.orderBy("key")) - 1)
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("i") % len(weights) + 1).cast("int")))
    per = per.withColumn("r", cap * F.col("s") / F.col("w"))
    full = F.coalesce(F.sum(cap * F.col("s")).over(before), F.lit(0))
    gone = F.coalesce(F.sum("w").over(before), F.lit(0.0))
    per = per.withColumn("level", (F.sum("s").over(whole) - full) / (F.sum("w").over(whole) - gone))
    per = per.withColumn("level", F.max(F.when(F.col("level") <= F.col("r"), F.col("level"))).over(whole))
    return per.select("key", "s", F.least((cap * F.col("s")).cast("double"), F.coalesce(F.col("level") * F.col("w"), F.lit(0.0))).alias("target"))


def schedule(spark: SparkSession, plan: DataFrame, slots: int) -> DataFrame:
    """slot, key, rank: the source of each slot in the order of the mix, and its how-manieth it is.

    Slot t stands at frac(t * golden ratio); sources own intervals of the unit line as long as
    their share of slots.  Slots and intervals meet by cell, an equi-join without any broadcast.
    """
    owned = plan.select("key", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell")).where("hi > lo")
    points = spark.range(slots).select(F.col("id").alias("slot"), F.pmod(F.col("id") * GOLDEN, F.lit(1.0)).alias("u")).withColumn("cell", F.floor(F.col("u") * CELLS))
    drawn = points.join(owned, "cell").where("u >= lo and u < hi").select("slot", "key", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = drawn.groupBy("key", "chunk").agg(F.count("*").alias("n"))
    first = counts.select("key", "chunk", F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("key", "chunk").orderBy("slot")) - 1
    return drawn.withColumn("rank", rank.cast("long")).join(first, ["key", "chunk"]).select("slot", "key", (F.col("base") + F.col("rank")).alias("rank"))


def mix_sources(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block: int = 1024) -> DataFrame:
    """doc_id, source, size, source_size, target, taken and h for every document.

    Each source's documents, shuffled by hash, are laid end to end and cut into blocks of equal
    tokens; the k-th slot of a source takes block k modulo their number, so a source is
    gone through once before a block repeats.  A source stops at its target; its last
    slot takes part of a block.  Blocks have at most ``block`` words, and fewer when all words
    together would fill under 20,000 of them.

    Running sums and ranks go by (source, hash range) and (source, chunk of slots), so a
    source that holds most rows is spread over many tasks.  Null text: size 0; null source: a
    source of its own, last; size 0: taken 0.  Repeated rows count as often as they are there.
    Documents whose hashes tie are laid by doc_id, then size.  A text is counted whole, however long: one longer than a block is
    cut over several.  Extra columns are not read.  No rows: no rows.
    """
    spark = docs.sparkSession
    sizes = materialise(sized(docs))
    plan = targets(sizes, weights, cap).withColumn("quota", F.round("target").cast("long"))
    total = plan.agg(F.sum("s")).first()[0] or 0
    words = max(1, min(block, total // 20_000))
    # b: words of a block; n: blocks of the source; need: slots up to its quota
    plan = plan.withColumn("b", F.when(F.col("s") > 0, F.ceil(F.col("s") / F.ceil(F.col("s") / words))).otherwise(F.lit(1)))
    plan = plan.withColumn("n", F.ceil(F.col("s") / F.col("b")))
    plan = plan.withColumn("need", F.when(F.col("s") > 0, F.floor(F.col("quota") / F.col("s")) * F.col("n") + F.ceil((F.col("quota") % F.col("s")) / F.col("b"))).otherwise(F.lit(0)))
    # a few slots more than needed, as the sequence may be some short of a source's share
    plan = plan.withColumn("share", F.when(F.col("need") > 0, F.col("need") * 1.01 + 6).otherwise(F.lit(0.0)))
    upto = F.sum("share").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    plan = plan.withColumn("hi", upto).withColumn("all", F.greatest(F.lit(1.0), F.sum("share").over(Window.partitionBy())))
    plan = materialise(plan.withColumn("lo", (F.col("hi") - F.col("share")) / F.col("all")).withColumn("hi", F.col("hi") / F.col("all")))
    slots = int(plan.agg(F.ceil(F.max("all"))).first()[0] or 0)

    taken = schedule(spark, plan.where("need > 0"), slots).join(plan.select("key", "s", "b", "n", "quota"), "key")
    begin = F.floor(F.col("rank") / F.col("n")) * F.col("s") + (F.col("rank") % F.col("n")) * F.col("b")
    size_of = F.least(F.col("b"), F.col("s") - F.col("block") * F.col("b"))
    taken = taken.withColumn("block", F.col("rank") % F.col("n")).withColumn("left", F.col("quota") - begin).where("left > 0")
    visits = taken.groupBy("key", "block").agg(
        F.sum((F.col("left") >= size_of).cast("long")).alias("whole"),
        F.max(F.when(F.col("left") < size_of, F.col("left")).otherwise(F.lit(0))).alias("part"),
    )

    laid = sizes.where("size > 0").withColumn("range", F.shiftrightunsigned("h", 52))
    per = laid.groupBy("key", "range").agg(F.sum("size").alias("words"))
    base = per.select("key", "range", F.coalesce(F.sum("words").over(Window.partitionBy("key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    inside = F.coalesce(F.sum("size").over(Window.partitionBy("key", "range").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    laid = laid.withColumn("inside", inside).join(base, ["key", "range"]).withColumn("at", F.col("base") + F.col("inside"))
    laid = laid.join(plan.select("key", "s", "b", "target"), "key")
    cut = laid.withColumn("block", F.explode(F.sequence(F.floor(F.col("at") / F.col("b")), F.floor((F.col("at") + F.col("size") - 1) / F.col("b")))))
    low, high = F.greatest("at", F.col("block") * F.col("b")), F.least(F.col("at") + F.col("size"), (F.col("block") + 1) * F.col("b"))
    cut = cut.join(visits, ["key", "block"], "left")
    got = F.coalesce(F.col("whole"), F.lit(0)) * (high - low) + F.greatest(F.lit(0), F.least(high, F.col("block") * F.col("b") + F.coalesce(F.col("part"), F.lit(0))) - low)
    mixed = cut.groupBy("key", "at", "doc_id", "h", "size", "s", "target").agg(F.sum(got).alias("taken"))
    rest = sizes.where("size = 0").join(plan.select("key", "s", "target"), "key").withColumn("taken", F.lit(0).cast("long"))
    columns = ["doc_id", F.when(F.col("key") != "t", F.substring("key", 2, 2**31 - 1)).alias("source"), "size", F.col("s").alias("source_size"), "target", F.col("taken").cast("long").alias("taken"), "h"]
    return mixed.select(*columns).union(rest.select(*columns))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix, each as often as the mix takes its words (rounded)."""
    share = mix_sources(docs, **options).groupBy("doc_id", "h").agg(F.sum("taken").alias("t"), F.sum("size").alias("z")).where("z > 0")
    share = share.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), F.round(F.col("t") / F.col("z")).cast("int").alias("_copies")).where("_copies > 0")
    placed, name = by_place(docs)
    i, text = F.col(name("doc_id")), F.col(name("text"))
    joined = placed.join(share, i.eqNullSafe(F.col("_id")) & (F.xxhash64(i, text) == F.col("_h")))
    return joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*placed.columns).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
