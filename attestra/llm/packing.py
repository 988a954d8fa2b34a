"""Best-fit packing of documents into sequences, with conflicts."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import WORD, materialise, table

#: Pieces that are packed together: the search over open bins stays short at any size of the input.
SHARD = 8192


class Bins:
    """Open bins by residual room.

    ``levels[r]`` lists the open bins with r tokens left and ``some`` has bit r set when there
    are any.  A bin carries two bitmaps: the sources it may take no more of, and the
    duplicate clusters it holds.
    """

    def __init__(self, capacity: int, limits: list[int]) -> None:
        self.capacity, self.limits = capacity, limits  # pieces that a bin takes of each source
        self.levels: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.some = 0
        self.room: list[int] = []
        self.sources: list[int] = []
        self.clusters: list[int] = []
        self.count: list[dict[int, int]] = []

    def place(self, size: int, source: int, cluster: int) -> int:
        """The tightest compatible bin, or a new one.  Cluster bit 0: no conflicts."""
        bit = 1 << source
        level = size
        while rest := self.some >> level:
            level += (rest & -rest).bit_length() - 1
            for k, b in enumerate(self.levels[level]):
                if not self.sources[b] & bit and not self.clusters[b] & cluster:
                    at = self.levels[level]
                    at[k] = at[-1]
                    at.pop()
                    if not at:
                        self.some &= ~(1 << level)
                    self._put(b, size, source, cluster)
                    return b
            level += 1
        b = len(self.room)
        self.room.append(self.capacity)
        self.sources.append(0)
        self.clusters.append(0)
        self.count.append({})
        self._put(b, size, source, cluster)
        return b

    def _put(self, b: int, size: int, source: int, cluster: int) -> None:
        self.room[b] -= size
        self.clusters[b] |= cluster
        n = self.count[b][source] = self.count[b].get(source, 0) + 1
        if n >= self.limits[source]:
            self.sources[b] |= 1 << source
        if self.room[b]:
            self.levels[self.room[b]].append(b)
            self.some |= 1 << self.room[b]


def pack_shard(pieces: pd.DataFrame, capacity: int, per_source: int) -> pd.DataFrame:
    """bin (from 0) and its offset for each piece; best fit by decreasing size."""
    order = ["n_tokens", "doc_id", "piece", "cluster", "source"]
    pieces = pieces.sort_values(order, ascending=[False, *[True] * 4], kind="stable", ignore_index=True)
    source = pd.factorize(pieces["source"].fillna("\0none"))[0]
    # a source that has more pieces than so many to a bin has room for twice its even share
    bins_needed = max(1, -(-int(pieces["n_tokens"].sum()) // capacity))
    limits = [max(per_source, -(-2 * n // bins_needed)) for n in pd.Series(source).value_counts().sort_index().tolist()]
    sizes = pieces["cluster"].map(pieces["cluster"].value_counts())
    cluster = pd.factorize(pieces["cluster"].where(sizes > 1))[0]  # -1: alone in its shard
    bins, used = Bins(capacity, limits), []
    for n, s, c in zip(pieces["n_tokens"].tolist(), source.tolist(), cluster.tolist(), strict=True):
        used.append(bins.place(n, s, 1 << c if c >= 0 else 0))
    pieces["bin"] = pd.array(used, dtype="int64")
    ends = pieces.groupby("bin")["n_tokens"].cumsum()
    pieces["bin_offset"] = ends - pieces["n_tokens"]
    return pieces


def best_fit_pack(docs: DataFrame, capacity: int = 2048, per_source: int = 4, cluster: str | None = None, shard: int = SHARD) -> DataFrame:
    """One row per piece: doc_id, piece, start_token, n_tokens, source, cluster, bin_id, bin_offset.

    Documents are cut into pieces of at most ``capacity`` words; so long ones become many pieces.  A bin
    holds at most ``capacity`` words, at most ``per_source`` pieces of one source (or twice what the source has
    for each full bin of a shard, where that is more: one source must not leave bins empty), and no two
    pieces of the same duplicate cluster (the column ``cluster``, else equal texts without regard to case; the pieces of
    one document are of one cluster only at equal places).  Pieces are dealt to shards by hash of the
    document, whatever its source or cluster, so large groups spread over all shards; each shard is
    packed by itself, best fit first in decreasing size.  The bins depend on the rows alone, not on how they
    are partitioned.

    Null or wordless texts: one row with no tokens and null bin.  Null doc_id: packed like others, last among pieces of its
    size; ids come back as they are, whatever their size.  Null source: a source of its own.
    Repeated rows are packed as often as they are there.  Pieces of equal size go by doc_id, place, cluster and
    source.  Extra columns are not read.  No rows: no rows.
    """
    spark = docs.sparkSession
    key = F.col(cluster).cast("long") if cluster else F.xxhash64(F.lower("text"))
    sized = docs.select("doc_id", F.col("source").cast("string").alias("source"), F.coalesce(key, F.lit(0)).alias("cluster"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    cut = sized.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / capacity)))))
    cut = cut.withColumn("start_token", F.col("piece") * capacity).withColumn("n_tokens", F.least(F.lit(capacity).cast("long"), F.col("size") - F.col("start_token")))
    cut = cut.select("doc_id", "source", F.xxhash64("cluster", "piece").alias("cluster"), "piece", "start_token", "n_tokens")
    # equal rows are summed and numbered, so that each is dealt by itself and always alike
    same = cut.groupBy(*cut.columns).agg(F.count("*").alias("_n"))
    cut = materialise(same.withColumn("_again", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).drop("_n"))
    shards = max(1, -(-cut.count() // shard))
    dealt = cut.where("n_tokens > 0").withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "cluster", "source", "_again"), F.lit(shards))).drop("_again")

    def pack(pieces: pa.Table) -> pa.Table:
        # whole numbers that may be null: a null must not make floats of ids
        out = pack_shard(pieces.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get), capacity, per_source)
        out["bin_id"] = out["shard"] * 2**32 + out["bin"]
        kinds = [(c, pa.string() if c == "source" else pa.int64()) for c in ("doc_id", "piece", "start_token", "n_tokens", "source", "cluster", "bin_id", "bin_offset")]
        return pa.Table.from_pandas(out, pa.schema(kinds), preserve_index=False)

    schema = "doc_id long, piece long, start_token long, n_tokens long, source string, cluster long, bin_id long, bin_offset long"
    packed = dealt.groupBy("shard").applyInArrow(pack, schema)
    none = F.lit(None).cast("long")
    return packed.union(cut.where("n_tokens = 0").select("doc_id", "piece", "start_token", "n_tokens", "source", "cluster", none, none))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_pack(table(spark, sf_dir, "documents"))
