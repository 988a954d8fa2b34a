"""Embedding near-duplicates by sorted projection passes."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import bound_batches, components, joined, materialise, partitions, runs_of_key, table
from attestra.llm.vectors import packed, rectangle, units, unpacked, usable

#: Bytes of vectors that every vector meets at once in the exact way; the bound of what is sent to every task.
SENT_BYTES = 8 << 20
#: Vectors whose planted partners tell how many links the passes find; rounds of passes at most, each with a window twice as wide.
PROBES, ROUNDS = 2048, 6
#: Rows that are multiplied with what follows them; members of a piece that are counted together.
ROWS, TOGETHER = 512, 1024
#: Pieces that are sent to every task; more are joined by shuffle.
SENT = 100_000
#: Pivots at most, and pairs that are multiplied at once.
PIVOTS, PAIRS = 1024, 1 << 21


def planes(passes: int, dim: int, bits: int = 63, seed: int = 5) -> np.ndarray:
    """passes x bits random hyperplanes; the same for the first components whatever dim is."""
    out = np.empty((passes, bits, dim))
    for j in range(dim):
        out[:, :, j] = np.random.default_rng((seed, j)).standard_normal((passes, bits))
    return out


def usable_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, v (the vector, packed) of the vectors that take part."""
    bound_batches(vectors.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, found = usable(b.column(1))
            keep = [(i, packed(v)) for i, v in zip(rows.tolist(), found, strict=True) if v.any()]
            ids = b.column(0).take(pa.array([k[0] for k in keep], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array([k[1] for k in keep], pa.binary())], ["vec_id", "v"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).where("vec_id is not null").mapInArrow(run, "vec_id long, v binary")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit vectors in double precision."""
    return units(rectangle([unpacked(x) for x in column.to_pylist()]))


def close_pairs(x: np.ndarray, single: np.ndarray, a: slice, b: slice, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of slice a and of slice b that are at ``cosine`` or nearer: products in single precision, those within its error
    decided in double precision."""
    slack = (x.shape[1] + 8) * 2.0**-22
    s = single[a] @ single[b].T
    i, j = np.divmod(np.flatnonzero(s >= cosine - slack), s.shape[1])
    open_ = np.flatnonzero(s[i, j] < cosine + slack)
    keep = np.ones(len(i), dtype=bool)
    for k in range(0, len(open_), 1 << 16):
        at = open_[k : k + (1 << 16)]
        keep[at] = np.einsum("ij,ij->i", x[i[at] + a.start], x[j[at] + b.start]) >= cosine
    return i[keep] + a.start, j[keep] + b.start


def planted(vectors: DataFrame, cosine: float) -> list[tuple[int, bytes]]:
    """For the first PROBES vectors by hash a partner each, under the same id, at ``cosine``: the links that are the hardest to
    find, as crowded as the vectors are.  Vectors of one dimension have none."""
    out = []
    for node, v in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PROBES).select("vec_id", "v").collect():
        u = units(unpacked(v)[None])[0]
        z = np.random.default_rng((9, node % 2**32)).standard_normal(len(u))
        z -= (z @ u) * u
        if (size := np.linalg.norm(z)) > 1e-9:
            near = cosine + (1 - cosine) * 1e-3
            out.append((node, packed(near * u + np.sqrt(1 - near * near) * z / size)))
    return out


def pass_links(vectors: DataFrame, first: int, passes: int, window: int, cosine: float, rows: int) -> DataFrame:
    """a, b, probe: what passes ``first`` to ``first + passes`` join up.  vectors: vec_id, v, probe.

    Each pass orders all vectors by the concatenated signs of its own hyperplanes and compares
    each with its ``window`` successors.  Pairs that are near enough are joined where they meet, so a row names the first of
    its piece there, not each of its links; a probe only says whether it met the vector whose partner it is.  The order is
    cut by range over (pass, code, vec_id), so many vectors with one code are spread like others.  Rows on either side of a
    cut are not compared in that pass; the other passes cut elsewhere.
    """
    spark = vectors.sparkSession

    def code(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, np.ndarray] = {}
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(1))
            if x.shape[1] not in known:
                known[x.shape[1]] = planes(first + passes, x.shape[1])[first:]
            place = np.int64(1) << np.arange(62, -1, -1, dtype=np.int64)
            for p, h in enumerate(known[x.shape[1]]):
                signs = (x @ h.T > 0).astype(np.int64) @ place
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), p), pa.int32()), pa.array(signs, pa.int64()), *b.columns], ["pass", "code", "vec_id", "v", "probe"])

    def sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tail: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            fresh = 0
            if tail is not None:
                fresh = tail.num_rows
                t = pa.concat_tables([tail, t])
            n, ids, which, probe = t.num_rows, t["vec_id"].to_numpy(), t["pass"].to_numpy(), t["probe"].to_numpy()
            x = _matrix(t["v"])
            single, label, met = x.astype(np.float32), np.arange(n), []
            for start in range(0, n, ROWS):
                a, z = slice(start, min(start + ROWS, n)), slice(max(start, fresh), min(start + ROWS + window, n))  # before fresh: seen with the batch before
                if z.start >= z.stop:
                    continue
                i, j = close_pairs(x, single, a, z, cosine)
                some = (j > i) & (j - i <= window) & (which[i] == which[j])
                i, j = i[some], j[some]
                real = ~(probe[i] | probe[j])
                met.append(ids[i[~real]][(ids[i[~real]] == ids[j[~real]]) & (probe[i[~real]] != probe[j[~real]])])
                label = joined(label, i[real], j[real])
            far = np.flatnonzero(label != np.arange(n))
            met_ids = np.concatenate(met) if met else ids[:0]
            tail = t.slice(max(0, n - window))
            yield pa.RecordBatch.from_arrays([pa.array(np.append(ids[far], met_ids)), pa.array(np.append(ids[label[far]], met_ids)), pa.array(np.arange(len(far) + len(met_ids)) >= len(far))], ["a", "b", "probe"])

    coded = vectors.select("vec_id", "v", "probe").mapInArrow(code, "pass int, code long, vec_id long, v binary, probe boolean")
    # ranges of many windows, so that few rows stand at a cut
    ranges = max(1, min(partitions(spark), rows * passes // (16 * window)))
    ranged = coded.repartitionByRange(ranges, "pass", "code", "vec_id").sortWithinPartitions("pass", "code", "vec_id")
    return ranged.mapInArrow(sweep, "a long, b long, probe boolean")


def candidate_links(vectors: DataFrame, cosine: float, recall: float, passes: int, window: int) -> tuple[DataFrame, float]:
    """a, b of vectors (vec_id, v) that rounds of passes join up, and the share of planted partners that they found.

    After each round the next has fresh hyperplanes and a window twice as wide, until ``recall`` of the partners is found.  So
    passes and window follow the number of rows and how crowded they are, whatever links there are.
    """
    spark = vectors.sparkSession
    rows, partners = vectors.count(), planted(vectors, cosine)
    extra = spark.createDataFrame(partners, "vec_id long, v binary").withColumn("probe", F.lit(True))
    every = materialise(vectors.select("vec_id", "v", F.lit(False).alias("probe")).union(extra))
    found, met = None, set()
    for k in range(ROUNDS):
        part = materialise(pass_links(every, k * passes, passes, window << k, cosine, rows))
        met |= {r[0] for r in part.where("probe").select("a").distinct().collect()}  # PROBES at most
        links = part.where("not probe and a <> b").select("a", "b")
        found = links if found is None else found.union(links)
        if len(met) >= recall * len(partners) or window << k >= rows:
            break
    return found, len(met) / len(partners) if partners else 1.0


def piece_counts(members: DataFrame, cosine: float) -> DataFrame:
    """vec_id, n: how many other vectors of its piece are at ``cosine`` or nearer, copies counted.

    members: component, vec_id, v, copies.  A piece of more than TOGETHER is cut in blocks by hash, and each pair of its blocks is
    a group of its own, so the largest piece is spread over all tasks; products are summed there.
    """
    sizes = members.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    blocks = materialise(sizes.select("component", F.ceil(F.col("size") / TOGETHER).cast("long").alias("blocks")))
    few = blocks.limit(SENT + 1).count() <= SENT
    rows = members.join(F.broadcast(blocks) if few else blocks, "component").withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("component", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "vec_id", "v", "copies")
    rows = rows.withColumn("key", F.xxhash64("component", "low", "high")).repartition(F.xxhash64("key")).sortWithinPartitions("key", "component", "low", "high")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of_key(batches, "key", 8 * TOGETHER):
            group = np.stack([t[c].to_numpy() for c in ("component", "low", "high")])
            edge = np.append(np.flatnonzero(np.append(True, (group[:, 1:] != group[:, :-1]).any(axis=0))), t.num_rows)
            cuts = [0]
            for e, z in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):  # some small groups at once
                if e > cuts[-1] and z - cuts[-1] > TOGETHER:
                    cuts.append(e)
            run = np.repeat(np.arange(len(edge) - 1), np.diff(edge))
            across, own = group[1] != group[2], t["own"].to_numpy()
            for lo, hi in zip(cuts, [*cuts[1:], t.num_rows], strict=True):
                x = _matrix(t["v"].slice(lo, hi - lo))
                single, ids, copies = x.astype(np.float32), t["vec_id"].to_numpy()[lo:hi], t["copies"].to_numpy()[lo:hi]
                r, o, c = run[lo:hi], own[lo:hi], across[lo:hi]
                n = np.zeros(hi - lo, dtype=np.int64)
                for start in range(0, hi - lo, ROWS):
                    i, j = close_pairs(x, single, slice(start, min(start + ROWS, hi - lo)), slice(0, hi - lo), cosine)
                    pair = (i != j) & (r[i] == r[j]) & (~c[i] | (o[i] != o[j]))
                    np.add.at(n, i[pair], copies[j[pair]])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n)], ["vec_id", "n"])

    return rows.mapInArrow(count, "vec_id long, n long").groupBy("vec_id").agg(F.sum("n").alias("n"))


def in_cells(members: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """members with cell and angle: the nearest of some pivots (vectors, the first by hash) and how far
    it is; and the pivots."""
    spark = members.sparkSession
    many = int(min(PIVOTS, max(1, members.count()) ** 0.5))
    pivots = units(rectangle([unpacked(r[0]) for r in members.orderBy(F.xxhash64("vec_id"), "vec_id").limit(many).select("v").collect()]))
    sent = spark.sparkContext.broadcast(pivots)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            angle = angles(_matrix(b.column("v")), sent.value)
            cell = angle.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(angle[np.arange(len(cell)), cell])], [*b.schema.names, "cell", "angle"])

    return members.mapInArrow(run, "component long, vec_id long, v binary, copies long, cell int, angle double"), pivots


def angles(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Angles of unit vectors; those of different size are compared as if the shorter ended in zeros."""
    width = min(x.shape[1], y.shape[1])
    return np.arccos(np.clip(x[:, :width] @ y[:, :width].T, -1, 1))


def all_links(members: DataFrame, cosine: float) -> DataFrame:
    """vec_id, a, b, n: n other vectors of piece b are at ``cosine`` or nearer to vec_id, which is of piece a.

    members: component, vec_id, v, copies.  Exact.  Vectors stand in the cell of their nearest pivot.  Each
    pass sends the vectors of some cells to the tasks, at most SENT_BYTES; nothing is shuffled or
    repeated.  By the angles between pivots and the cells' radii only rows of cells within reach are
    read, and of those a vector is multiplied with the cells within its own reach.  Products are in
    single precision; those within its error of ``cosine`` are decided in double precision.
    """
    spark = members.sparkSession
    kind = "vec_id long, a long, b long, n long"
    found = spark.createDataFrame([], kind)
    if members.isEmpty():
        return found
    placed, pivots = in_cells(members)
    placed = materialise(placed)
    # one row for each of a bounded number of pivots
    cells = {r[0]: (r[1], r[2]) for r in placed.groupBy("cell").agg(F.sum(F.length("v") + 24).alias("size"), F.max("angle")).collect()}
    reach = float(np.arccos(cosine)) + 1e-6
    names = sorted(cells, key=lambda c: (angles(pivots[:1], pivots[c : c + 1])[0, 0], c))
    apart, radius = angles(pivots, pivots), np.array([cells[c][1] if c in cells else 0.0 for c in range(len(pivots))])
    blocks: list[tuple[list[int], int, int]] = []  # cells, part, parts: large cells are cut by hash
    room = 0
    for c in names:
        parts = -(-cells[c][0] // SENT_BYTES)
        if parts > 1:
            blocks += [([c], k, parts) for k in range(parts)]
            room = 0
        elif cells[c][0] <= room:
            blocks[-1][0].append(c)
            room -= cells[c][0]
        else:
            blocks.append(([c], 0, 1))
            room = SENT_BYTES - cells[c][0]
    for some, k, parts in blocks:
        rows = placed.where(F.col("cell").isin(some))
        rows = rows if parts == 1 else rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(parts)) == k)
        rows = sorted(rows.select("cell", "vec_id", "component", "copies", "v").collect(), key=lambda r: (r[0], r[1]))
        if not rows:
            continue
        cell = np.array([r[0] for r in rows])
        edge = np.flatnonzero(np.diff(cell, prepend=-1, append=-1))
        here = cell[edge[:-1]]
        pieces, piece = np.unique(np.array([r[2] for r in rows]), return_inverse=True)
        sent = spark.sparkContext.broadcast((np.array([r[1] for r in rows]), pieces, piece, np.array([r[3] for r in rows]), rectangle([unpacked(r[4]) for r in rows]), edge, pivots[here], radius[here]))
        near = np.flatnonzero((apart[here] <= radius[here][:, None] + radius[None, :] + reach).any(axis=0)).tolist()

        def meet(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, pieces, piece, copies, y, edge, centre, radius = sent.value
            y = units(y)
            single = y.astype(np.float32)
            for b in batches:
                if not b.num_rows:
                    continue
                own, mine = b.column(0).to_numpy(), b.column(1).to_numpy()
                x = _matrix(b.column(2))
                width = min(x.shape[1], y.shape[1])  # beyond it one of them is zero
                slack = (width + 8) * 2.0**-22
                within = angles(x, centre) <= radius + reach
                out = []
                for c in np.flatnonzero(within.any(axis=0)).tolist():
                    lo, hi = int(edge[c]), int(edge[c + 1])
                    rows, step = np.flatnonzero(within[:, c]), max(1, PAIRS // (hi - lo))
                    for start in range(0, len(rows), step):
                        at_ = rows[start : start + step]
                        part = x[at_, :width]
                        s = part.astype(np.float32) @ single[lo:hi, :width].T
                        i, j = np.divmod(np.flatnonzero(s >= cosine - slack), hi - lo)
                        close = np.flatnonzero(s[i, j] < cosine + slack)
                        j += lo
                        keep = own[at_[i]] != ids[j]
                        for k in range(0, len(close), 1 << 16):
                            at = close[k : k + (1 << 16)]
                            keep[at] &= np.einsum("ij,ij->i", part[i[at]], y[j[at], :width]) >= cosine
                        i, j = i[keep], j[keep]
                        if not len(i):
                            continue
                        there = np.flatnonzero(np.bincount(piece[j], minlength=len(pieces)))
                        place = np.zeros(len(pieces), dtype=np.int64)
                        place[there] = np.arange(len(there))
                        code, code_of = np.unique(i * len(there) + place[piece[j]], return_inverse=True)
                        n = np.bincount(code_of, weights=copies[j]).astype(np.int64)
                        out.append((own[at_[code // len(there)]], mine[at_[code // len(there)]], pieces[there[code % len(there)]], n))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out, strict=True)], ["vec_id", "a", "b", "n"])

        part = materialise(placed.where(F.col("cell").isin(near)).select("vec_id", "component", "v").mapInArrow(meet, kind))
        sent.unpersist()
        found = found.union(part)
    return found


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, recall: float = 0.98, passes: int = 8, window: int = 512, exact: bool = False) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Equal vectors are one, with their number; they link with each other.  Passes sort the vectors by random projections and verify
    neighbours by their cosine in double precision; pairs of all passes are united to components.  Passes are added until they
    find ``recall`` of planted partners at the least cosine that links; nearer links are found more often.  In its component each vector's links
    are counted exactly.  A link that no pass joins up is lost, which is rarer than for a partner, as there are other ways
    through a component.

    Where ROUNDS rounds do not reach ``recall``, and with ``exact``, vectors meet all others that the angles to common pivots do not
    rule out (``all_links``): then every link is found, at a cost that grows with the square of the rows.

    Vectors that are null, zero, or hold null or non-finite components link with nothing.  A vec_id that
    comes with several rows gets one row for each, all of one node of the smallest such vector; a null
    vec_id links with nothing.  Vectors of other length are compared as if the shorter ended in zeros.  Extra columns are not
    read.  No rows: no rows.
    """
    found = usable_vectors(vectors)
    held = materialise(found.groupBy("vec_id").agg(F.min("v").alias("v")))
    classes = materialise(held.groupBy("v").agg(F.min("vec_id").alias("node"), F.count("*").alias("copies")))
    links, share = candidate_links(classes.select(F.col("node").alias("vec_id"), "v"), cosine, recall, passes, window)
    joined_ = components(links)
    members = materialise(classes.join(joined_, "node", "left").select(F.coalesce("component", "node").alias("component"), F.col("node").alias("vec_id"), "v", "copies"))
    if exact or share < recall:
        links = all_links(members, cosine)
        counts = links.groupBy("vec_id").agg(F.sum("n").alias("n"))
        whole = components(links.select("a", "b")).select(F.col("node").alias("component"), F.col("component").alias("whole"))
        members = members.join(whole, "component", "left").withColumn("component", F.coalesce("whole", "component")).drop("whole")
    else:
        counts = piece_counts(members, cosine)
    per = members.join(counts, "vec_id", "left").select("v", F.col("component").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    found = held.join(per, "v").select(F.col("vec_id").alias("_id"), "n_links", "component_id")
    ids = vectors.select(F.col("vec_id").cast("long").alias("vec_id"))
    out = ids.join(found, F.col("vec_id") == F.col("_id"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), usable AS (
  SELECT vec_id, e FROM v WHERE e IS NOT NULL AND list_dot_product(e, e) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT v.vec_id, CAST((SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS BIGINT) AS n_links,
       c.c AS component_id, v.vec_id = c.c AS kept
FROM v JOIN comp c ON v.vec_id = c.a
"""
