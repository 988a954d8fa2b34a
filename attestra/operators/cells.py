"""A kept vector index: vectors in the cells of their nearest pivots, and exact search that reads the cells within reach.

Under one path lie two plain tables: ``pivots`` (cell, pivot, radius, n: a row for each cell) and ``vectors`` (cell as a folder, id,
angle to the pivot, v: the vector with length 1), rows by angle.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.operators.dense import BLOCK, SLICE, unit_rows
from attestra.operators.lexical import ranked
from attestra.operators.ranking import Best
from attestra.session import in_blocks, kept

#: Pivots at most: the square root of the number of vectors, up to this.  More than rounding makes of an angle.
PIVOTS, SLACK = 1024, 1e-6


def _angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ y.T, -1, 1))


def write_cells(chunks: DataFrame, path: str, pivots: int = PIVOTS) -> int:
    """Write the index of chunks (id, vector), anew; the number of vectors in it.  Null and zero vectors, and such with a
    component that is no finite number, are not found by any search and are left out.  All vectors have one length.

    Pivots are the vectors that are first by hash of their id, as many as the square root of all, PIVOTS at most.
    """
    spark = chunks.sparkSession
    there = chunks.where(F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    sound = F.forall("vector", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    there = there.where(sound)
    many = min(pivots, max(1, int(there.count() ** 0.5)))
    first = [r[0] for r in there.orderBy(F.xxhash64("id"), "id").limit(many).select("vector").collect()]
    sent = spark.sparkContext.broadcast(unit_rows(first) if first else None)

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = unit_rows(b.column(1).to_pylist())
            angle = _angles(x, sent.value)
            cell = angle.argmin(axis=1)
            v = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(x.reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), b.column(0), pa.array(angle[np.arange(len(cell)), cell]), v], ["cell", "id", "angle", "v"])

    placed = there.mapInArrow(place, "cell int, id long, angle double, v array<double>")
    placed.repartitionByRange("cell", "angle").sortWithinPartitions("cell", "angle", "id").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/vectors")
    kind = "cell int, pivot array<double>"
    centres = spark.createDataFrame([(c, [float(v) for v in p]) for c, p in enumerate(sent.value if first else [])], kind)
    sizes = spark.read.schema("id long, angle double, cell int").parquet(f"{path}/vectors").groupBy("cell").agg(F.max("angle").alias("radius"), F.count("*").alias("n"))
    centres.join(sizes, "cell").coalesce(1).write.mode("overwrite").parquet(f"{path}/pivots")
    sent.unpersist()
    return sum(r[0] for r in spark.read.parquet(f"{path}/pivots").select("n").collect())


def search_cells(claims: DataFrame, path: str, k: int = 150, read: dict | None = None) -> DataFrame:
    """claim_id, id, score, rank: the k most similar vectors of every claim (claim_id, vector), exactly as
    ``dense.dense_search`` finds them among all.

    A claim's angle to a cell's pivot less the cell's radius bounds how near any of its vectors is.  Each claim first
    meets its nearest cells, until they hold k vectors; after that only cells whose bound reaches its k-th best score so
    far.  Folders of other cells are not read.  ``read`` gets the vectors of the index and those that were read in both steps.
    """
    spark = claims.sparkSession
    found = spark.createDataFrame([], "claim_id long, id long, score double")
    cells = spark.read.parquet(f"{path}/pivots").orderBy("cell").collect()  # PIVOTS rows at most
    asked = claims.where(F.col("vector").isNotNull()).withColumn("vector", F.col("vector").cast("array<double>"))
    if cells:
        for rows in in_blocks(asked.select("claim_id", "vector"), "claim_id", BLOCK):
            found = found.union(_search_block(spark, rows, cells, path, k, {} if read is None else read))
    return ranked(found, k)


def _search_block(spark: SparkSession, rows: list, cells: list, path: str, k: int, read: dict) -> DataFrame:
    names, q = np.array([r[0] for r in rows]), unit_rows([r[1] for r in rows])
    ok = ~np.isnan(q).any(axis=1)
    names, q = names[ok], q[ok]
    number, size = np.array([c["cell"] for c in cells]), np.array([c["n"] for c in cells])
    if not len(names):
        return spark.createDataFrame([], "claim_id long, id long, score double")
    least = np.maximum(_angles(q, np.array([c["pivot"] for c in cells])) - np.array([c["radius"] for c in cells]), 0)  # claims x cells
    order = np.argsort(least, axis=1, kind="stable")
    before = np.cumsum(size[order], axis=1) - size[order]
    first = np.zeros(least.shape, dtype=bool)
    np.put_along_axis(first, order, before < k, axis=1)

    def meet(wanted: np.ndarray) -> DataFrame:
        """Best lists of the claims over the cells that each wants."""
        some = np.flatnonzero(wanted.any(axis=0))
        read["vectors"], read["read"] = int(size.sum()), read.get("read", 0) + int(size[some].sum())
        sent = spark.sparkContext.broadcast((names, q, {int(number[c]): np.flatnonzero(wanted[:, c]) for c in some}))

        def best(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, q, claims_of = sent.value
            held = Best(len(names), k)
            for b in batches:
                for start in range(0, b.num_rows, SLICE):
                    part = b.slice(start, SLICE)
                    cell, ids = part.column(0).to_numpy(), part.column(1).to_numpy()
                    x = part.column(2).flatten().to_numpy().reshape(len(ids), -1)
                    for c in np.unique(cell).tolist():
                        at, who = np.flatnonzero(cell == c), claims_of[c]
                        scores = np.full((len(names), len(at)), np.nan)
                        scores[who] = q[who] @ x[at].T
                        held.add(scores, ids[at])
            yield from held.rows(names)

        vectors = spark.read.parquet(f"{path}/vectors").where(F.col("cell").isin(number[some].tolist()))
        return vectors.select("cell", "id", "v").mapInArrow(best, "claim_id long, id long, score double")

    near = kept(ranked(meet(first), k))
    full = near.groupBy("claim_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).collect()  # a row for each of BLOCK claims at most
    reach = {r["claim_id"]: r["least"] for r in full}
    bar = np.array([np.arccos(np.clip(reach.get(n, -1.0) - 1e-8, -1, 1)) for n in names.tolist()]) + SLACK
    rest = ~first & (least <= bar[:, None])
    out = near.select("claim_id", "id", "score")
    return out.union(meet(rest)) if rest.any() else out
