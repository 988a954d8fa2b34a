"""Exact top-k inner products by norm-bucketed retrieval."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.llm.common import bound_batches, materialise, table
from attestra.llm.vectors import rectangle, usable

#: Lengths of one bucket differ by a factor of 2 ** (1 / STEPS); vectors of a block.
STEPS, BLOCK = 8, 4096
#: Bytes of queries that are sent to all tasks at once.
SENT_BYTES = 8 << 20
#: Longest vectors whose products give each query its first bound.
FIRST = 1024
#: Local cosine thresholds from which one coordinate prunes better than the length does.
STEEP = 0.5


def integers(vectors: DataFrame, scale: int) -> DataFrame:
    """vec_id, v (floor(scale * x) as longs in bytes), length of the vectors that take part."""
    bound_batches(vectors.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = usable(b.column(1))
            whole = [np.floor(scale * v).astype(np.int64) for v in found]
            lengths = [float(np.linalg.norm(w.astype(np.float64))) for w in whole]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows)), pa.array([w.tobytes() for w in whole], pa.binary()), pa.array(lengths, pa.float64())], ["vec_id", "v", "length"])

    found = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id is not null").mapInArrow(run, "vec_id long, v binary, length double")
    return found.dropDuplicates(["vec_id", "v"])


def _matrix(blobs: Iterable[bytes]) -> np.ndarray:
    return rectangle([np.frombuffer(x, dtype=np.int64) for x in blobs])


def products(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact inner products of rows: by doubles while these hold every sum, else by Python's integers."""
    width = max(q.shape[1], p.shape[1])
    q, p = (np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (q, p))
    top = float(np.abs(q).max(initial=0)) * float(np.abs(p).max(initial=0)) * width
    if top < 2**53:
        return np.rint(q.astype(np.float64) @ p.T.astype(np.float64)).astype(np.int64)
    if top < 2**62:
        return q @ p.T
    return q.astype(object) @ p.T.astype(object)


def search_block(q: np.ndarray, qids: np.ndarray, bound: np.ndarray, p: np.ndarray, pids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """query's place, vectors, scores: each query's k best of a block, without those under its bound.

    p is ordered by decreasing length.  A query's local cosine threshold is its bound over the
    product of its length and the block's largest.  Over 1: the block has nothing for it.
    Steep: only vectors whose value at the query's largest coordinate lets them reach it; else
    only vectors that are long enough.  What is left is verified by its product.
    """
    qf, pf = q.astype(np.float64), p.astype(np.float64)
    ql, pl = np.linalg.norm(qf, axis=1), np.linalg.norm(pf, axis=1)
    width = min(q.shape[1], p.shape[1])
    safe = np.where(pl > 0, pl, 1.0)
    unit: dict[int, np.ndarray] = {}
    slack = 1e-9
    for i in range(len(q)):
        rows = None
        if bound[i] > 0 and ql[i] > 0 and len(p):
            local = bound[i] / (ql[i] * pl[0]) if pl[0] > 0 else 2.0
            if local > 1 + slack:
                continue
            if local >= STEEP and width:
                f = int(np.abs(qf[i, :width]).argmax())
                if f not in unit:
                    unit[f] = pf[:, f] / safe
                x = qf[i, f] / ql[i]
                reach = np.sqrt(max(0.0, 1 - local**2) * max(0.0, 1 - x**2)) + 1e-6
                low, high = x * local - reach, 1.0 if x >= local else x * local + reach
                if x < 0:
                    low, high = (-1.0 if -x >= local else x * local - reach), x * local + reach
                rows = np.flatnonzero((unit[f] >= low) & (unit[f] <= high) if abs(x) > 0 else np.ones(len(p), dtype=bool))
            else:
                rows = np.arange(int(np.searchsorted(-pl, -(bound[i] / ql[i]) * (1 - slack), side="right")))
        ids, part = (pids, p) if rows is None else (pids[rows], p[rows])
        score = products(q[i : i + 1], part)[0]
        good = np.flatnonzero((ids != qids[i]) & (score >= bound[i]))
        best = good[np.lexsort((ids[good], -score[good]))[:k]]
        if len(best):
            yield i, ids[best], score[best]


def _blocks(rows: DataFrame) -> DataFrame:
    """One row per block: its ids and vectors by decreasing length, packed, and its greatest length."""
    kind = pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("longest", pa.float64()), ("ids", pa.binary()), ("m", pa.binary())])

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by([("length", "descending"), ("vec_id", "ascending")])
        one = {c: [t[c][0].as_py()] for c in ("bucket", "block")} | {"longest": [t["length"][0].as_py()], "ids": [t["vec_id"].to_numpy().astype(np.int64).tobytes()]}
        return pa.table(one | {"m": [np.ascontiguousarray(_matrix(t["v"].to_pylist())).tobytes()]}, schema=kind)

    return rows.groupBy("bucket", "block").applyInArrow(pack, "bucket long, block long, longest double, ids binary, m binary")


def _searched(blocks: DataFrame, asked: list, k: int) -> DataFrame:
    """query_id, vec_id, score: the k best of each query among the blocks of every task.

    The queries go to the tasks, not the vectors to the queries, so no vector is copied.  Blocks that are
    too short for all of them are not read.  A task goes from long to short and raises each query's
    bound by what it has found.
    """
    spark = blocks.sparkSession
    q, qids = _matrix(bytes(r["v"]) for r in asked), np.array([r["vec_id"] for r in asked], dtype=np.int64)
    bound, length = np.array([r["bound"] for r in asked]), np.array([r["length"] for r in asked])
    sent = spark.sparkContext.broadcast((q, qids, bound))
    # no product with a vector shorter than this reaches any bound
    least = float(np.where((bound > 0) & (length > 0), bound / np.where(length > 0, length, 1.0), 0.0).min()) * (1 - 1e-9)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, qids, bound = sent.value
        bound = bound.copy()
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for ids, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                pids = np.frombuffer(ids, np.int64)
                for i, vecs, score in search_block(q, qids, bound, np.frombuffer(m, np.int64).reshape(len(pids), -1), pids, k):
                    if i in best:
                        vecs, score = np.concatenate((best[i][0], vecs)), np.concatenate((best[i][1], score))
                    first = np.lexsort((vecs, -score))[:k]
                    best[i] = vecs[first], score[first]
                    if len(first) == k:  # ties are wanted, so the bound stays just under
                        bound[i] = max(bound[i], np.nextafter(float(score[first[-1]]), -np.inf))
        for i, (vecs, score) in best.items():
            clipped = pa.array([max(-(2**63), min(2**63 - 1, int(x))) for x in score], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(vecs), qids[i])), pa.array(vecs), clipped], ["query_id", "vec_id", "score"])

    long_enough = blocks.where(F.col("longest") >= least) if least > 0 else blocks
    return long_enough.select("ids", "m").mapInArrow(score, "query_id long, vec_id long, score long")


def top_products(vectors: DataFrame, every: int = 100, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank, vec_id, score: exact k best of every query, ties to the smaller vec_id.

    Queries: rows whose vec_id is divisible by ``every``.  Null vectors and those with null or non-finite
    components take no part; neither do null ids.  Rows that repeat both id and vector count once.
    Vectors of different size are compared as if the shorter ended in zeros.  Products beyond a long
    rank exactly within a block and are reported as the long's limit.  Extra columns are not read.
    No rows: no rows.

    Vectors are shuffled once, to their blocks; queries are sent to all tasks, at most SENT_BYTES at a
    time, those with like thresholds together.
    """
    spark = vectors.sparkSession
    whole = materialise(integers(vectors, scale))
    # the longest vectors: at most FIRST rows, whatever the input
    longest = whole.orderBy(F.desc("length"), "vec_id").limit(FIRST).select("vec_id", "v").collect()
    sent = spark.sparkContext.broadcast((_matrix(bytes(r["v"]) for r in longest), np.array([r["vec_id"] for r in longest], dtype=np.int64)))

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p, pids = sent.value
        for b in batches:
            bound = np.full(b.num_rows, -np.inf)
            if b.num_rows:
                score = products(_matrix(b.column(1).to_pylist()), p)
                for i, own in enumerate(b.column(0).to_pylist()):
                    others = np.sort(score[i][pids != own])
                    if len(others) >= k:
                        bound[i] = np.nextafter(float(others[-k]), -np.inf)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(bound)], ["vec_id", "v", "length", "bound"])

    bucket = F.when(F.col("length") > 0, F.floor(F.log2("length") * STEPS)).otherwise(F.lit(-(10**6))).cast("long")
    placed = whole.withColumn("bucket", bucket)
    sizes = placed.groupBy("bucket").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    placed = placed.join(sizes, "bucket").withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.col("blocks")))
    blocks = _blocks(placed.select("bucket", "block", "vec_id", "v", "length"))
    # long blocks first in every task
    blocks = materialise(blocks.repartition(F.xxhash64("bucket", "block")).sortWithinPartitions(F.desc("longest")))

    asked = materialise(whole.where(F.col("vec_id") % every == 0).mapInArrow(first, "vec_id long, v binary, length double, bound double"))
    n, size = asked.agg(F.count("*"), F.max(F.length("v"))).first()
    kind = "query_id long, vec_id long, score long"
    parts = -(-(n * (size or 1)) // SENT_BYTES)
    need = F.when(F.col("length") > 0, F.col("bound") / F.col("length")).otherwise(F.lit(0.0))
    found = spark.createDataFrame([], kind)
    if parts:
        # queries of one part want about the same length; the cuts come from a bounded sketch
        cuts = asked.select(need.alias("need")).approxQuantile("need", [j / parts for j in range(1, parts)], 0.01) if parts > 1 else []
        for low, high in zip([None, *cuts], [*cuts, None], strict=True):
            some = asked.where((F.lit(True) if low is None else need >= low) & (F.lit(True) if high is None else need < high))
            m = max(1, -(-(some.count() * size) // SENT_BYTES)) if parts > 1 else 1
            for j in range(m):  # the sketch may be coarse: no more is sent at once all the same
                rows = (some if m == 1 else some.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(m)) == j)).collect()
                if rows:
                    found = found.union(_searched(blocks, rows, k))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_products(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(1024 * x) AS BIGINT) FOR x IN CAST(embedding AS DOUBLE[])] AS e FROM embeddings
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_dot_product(CAST(q.e AS DOUBLE[]), CAST(c.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM p
)
SELECT * FROM r WHERE rank <= 10
"""
