"""Dense search by cosine."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.functions import scores
from attestra.operators.lexical import SCORES, ranked
from attestra.operators.ranking import Best
from attestra.session import in_blocks

#: Claims that one pass over the chunks compares, the bound of what is sent to every task; chunks that they meet at once, at most (and no more than give SCORES scores).
BLOCK, SLICE = 2048, 1024


def unit_rows(rows: list) -> np.ndarray:
    x = np.array(rows, dtype=np.float64)
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, n, out=np.full_like(x, np.nan), where=n > 0)


def dense_search(claims: DataFrame, chunks: DataFrame, k: int = 150) -> DataFrame:
    """claim_id, id, score, rank: the k most similar chunks of every claim, in double precision.

    claims: claim_id, vector; chunks: id, vector.  Each pass sends at most BLOCK claims to the tasks,
    which read the chunks once, multiply in blocks and keep their own k best; the final ranks come
    from these.  Zero vectors have no similarity and are not found.
    """
    spark = claims.sparkSession
    asked = claims.where(F.col("vector").isNotNull()).withColumn("vector", F.col("vector").cast("array<double>"))
    found = spark.createDataFrame([], "claim_id long, id long, score double")
    for rows in in_blocks(asked.select("claim_id", "vector"), "claim_id", BLOCK):
        sent = spark.sparkContext.broadcast(([r[0] for r in rows], unit_rows([r[1] for r in rows])))

        def best(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            names, q = sent.value
            held, step = Best(len(names), k), max(1, min(SLICE, SCORES // len(names)))
            for b in batches:
                for start in range(0, b.num_rows, step):
                    part = b.slice(start, step)
                    held.add(q @ unit_rows(part.column(1).to_pylist()).T, part.column(0).to_numpy(zero_copy_only=False))
            yield from held.rows(np.array(names))

        vectors = chunks.where(F.col("vector").isNotNull()).select(F.col("id").cast("long"), F.col("vector").cast("array<double>"))
        found = found.union(vectors.mapInArrow(best, "claim_id long, id long, score double"))
    return ranked(found, k)


def vector_quality(vectors: DataFrame) -> DataFrame:
    """One row: vectors, dimensions, zero norms, vectors with NaN, and the norms' range, mean and deviation."""
    norm = scores.norm(F.col("vector"))
    nan = F.exists("vector", F.isnan)
    per = vectors.select(F.size("vector").alias("dim"), norm.alias("norm"), nan.cast("int").alias("nan"))
    return per.agg(
        F.count("*").alias("n"), F.countDistinct("dim").alias("n_dims"), F.min("dim").cast("long").alias("dim"), F.sum((F.col("norm") < 1e-6).cast("int")).alias("n_zero"),
        F.sum("nan").alias("n_nan"), F.min("norm").alias("norm_min"), F.max("norm").alias("norm_max"), F.avg("norm").alias("norm_mean"), F.stddev_pop("norm").alias("norm_std"),
    )


def valid_vectors(vectors: DataFrame, dim: int) -> DataFrame:
    return vectors.where((F.size("vector") > 0) & (F.size("vector") == dim))
