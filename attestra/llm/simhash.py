"""SimHash near-duplicates by a byte-position index with count filtering."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import bound_batches, by_place, components, joined, materialise, runs_of_key, table

#: A pair within 3 bits differs in 3 of 8 bytes at most, so it agrees in 5, and in 3 of one half.
BITS, AGREE = 3, 5
#: Byte positions that a block of the index shares, as bits: all triples of either half, one of which each such pair shares.
TRIPLES = [sum(1 << p for p in t) for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in combinations(half, 3)]
#: Fingerprints of a block, about, over which it is split by a further byte; one in SAMPLE is counted for that.
BLOCK, SAMPLE = 512, 16
#: Of so many shared positions, the others of each set of them.
REST = {n: np.array([[p for p in range(8) if not m >> p & 1] if m.bit_count() == n else [0] * (8 - n) for m in range(256)]) for n in (3, 4, 5)}
#: Pairs that blocks which are tallied together may have.
PAIRS = 1 << 21


def fingerprint(text: str | None, width: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of the text's word shingles, ASCII lower case."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) < width:
        hashes = [xxhash.xxh64_intdigest(joined, 42)]
    else:
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths + 1) - 1
        starts = ends - lengths
        digest = xxhash.xxh64_intdigest
        hashes = [digest(joined[a:z], 42) for a, z in zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)]
    h = np.array(hashes, dtype="<u8")
    votes = np.zeros(64, dtype=np.int64)
    for k in range(0, len(h), 1 << 16):
        votes += np.unpackbits(h[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, width) for t in b.column(1).to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def _some_pairs(code: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows with one code, the smaller row first, about PAIRS at a time."""
    order = np.argsort(code, kind="stable")
    code, n, d = code[order], len(code), 1
    live = np.flatnonzero(code[1:] == code[:-1])
    held, size = [], 0
    while len(live):
        held.append((order[live], order[live + d]))
        size += len(live)
        if size >= PAIRS:
            yield _paired(held)
            held, size = [], 0
        d += 1
        live = live[live + d < n]
        live = live[code[live] == code[live + d]]
    if held:
        yield _paired(held)


def _paired(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
    return np.minimum(a, b), np.maximum(a, b)


def _pairs(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows with one code, the smaller row first."""
    none = np.zeros(0, dtype=np.int64)
    return _paired([(none, none), *_some_pairs(code)])


def tallied(key: np.ndarray, mask: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one block and the number of positional bytes that they share, summed over the
    postings of the block: lists of its rows by position and byte.  Rows are sorted by key; all masks have as
    many positions."""
    n, have = len(key), int(mask[0]).bit_count()
    block = np.cumsum(np.append(False, key[1:] != key[:-1]))
    if have >= AGREE:  # what the block shares is enough
        a, b = _pairs(block)
        return a, b, np.full(len(a), have)
    rest, data = REST[have][mask], fp.view(np.uint8).reshape(-1, 8)
    found = []
    for c in range(8 - have):
        a, b = _pairs(block * 256 + data[np.arange(n), rest[:, c]])
        found.append(a * n + b)
    pair, count = np.unique(np.concatenate(found), return_counts=True)
    return pair // n, pair % n, count + have


def linked(key: np.ndarray, mask: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows joined to the first row of their component: of pairs by their tally, those with the guaranteed
    number of bytes are verified by their bits.  Where the block itself shares as many, pairs are made, verified and joined
    some at a time, so a block of any size takes the memory of its rows."""
    label, bits = np.arange(len(key)), fp.view(np.uint64)
    if int(mask[0]).bit_count() >= AGREE:
        parts = _some_pairs(np.cumsum(np.append(False, key[1:] != key[:-1])))
    else:
        a, b, tally = tallied(key, mask, fp)
        parts = iter([(a[tally >= AGREE], b[tally >= AGREE])])
    for a, b in parts:
        near = (label[a] != label[b]) & (np.bitwise_count(bits[a] ^ bits[b]) <= BITS)
        label = joined(label, a[near], b[near])
    far = np.flatnonzero(label != np.arange(len(key)))
    return far, label[far]


def _by_block(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in runs_of_key(batches, "key", 100_000):
        key, mask, fp, node = (t[c].to_numpy() for c in ("key", "mask", "fp", "node"))
        same = np.flatnonzero(key[1:] == key[:-1])
        some = np.unique(np.concatenate((same, same + 1)))
        key, mask, fp, node = key[some], mask[some], fp[some], node[some]
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else some
        size = np.diff(np.append(edge, len(key)))
        part = np.cumsum(size * size) // PAIRS
        cuts = [*edge[np.flatnonzero(np.diff(part, prepend=-1))].tolist(), len(key)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            x, y = linked(key[a:z], mask[a:z], fp[a:z])
            yield pa.RecordBatch.from_arrays([pa.array(node[a:z][x]), pa.array(node[a:z][y])], ["a", "b"])


def _posted(rows: DataFrame, masks) -> DataFrame:
    """fp, node, mask, key: rows in the blocks of these sets of positions.  Blocks whose keys collide are
    compared together, which adds pairs that the verification drops."""
    spread = rows.select("fp", "node", F.explode(masks).alias("mask"))
    shared = [F.when(F.col("mask").bitwiseAND(F.lit(1 << p)) != 0, F.shiftright("fp", 8 * p).bitwiseAND(F.lit(255))) for p in range(8)]
    return spread.select("fp", "node", "mask", F.xxhash64("mask", *shared).alias("key"))


def links(nodes: DataFrame) -> DataFrame:
    """a, b: node ids that join up all fingerprints within reach.  nodes: fp (distinct), node.

    The index of byte positions is cut into blocks that share three of them; each pair within reach
    meets in one.  There the other positional bytes that two fingerprints share are tallied by their
    postings, pairs under the guaranteed five are dropped, the rest verified by their bits.  Blocks
    that a sample shows to be long are split by a fourth, then a fifth position: of five others a
    pair shares two at least, so any four of these hold one; then one of all that are left.
    Only joined components leave a block.
    """
    blocks = _posted(nodes, F.array(*[F.lit(m) for m in TRIPLES]))
    found = None
    for have in (3, 4, 5):
        short, long = blocks, None
        if have < AGREE:
            counts = blocks.where(F.pmod(F.xxhash64("fp"), F.lit(SAMPLE)) == 0).groupBy("key").agg(F.count("*").alias("n"))
            keys = materialise(counts.where(F.col("n") > BLOCK / SAMPLE).select("key"))
            if not keys.isEmpty():
                short, long = blocks.join(keys, "key", "left_anti"), blocks.join(keys, "key", "left_semi")
        # by a hash of the key: an exchange by the key itself is left out after a join by it, which may lose that order as it runs
        short = short.select("key", "mask", "fp", "node").repartition(F.xxhash64("key")).sortWithinPartitions("key").mapInArrow(_by_block, "a long, b long")
        found = short if found is None else found.union(short)
        if long is None:
            break
        others = F.filter(F.array(*[F.lit(1 << p) for p in range(8)]), lambda bit: F.col("mask").bitwiseAND(bit) == 0)
        blocks = _posted(long, F.transform(F.slice(others, 1, 4), lambda bit: F.col("mask") + bit))
    return found


def simhash(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every document.

    Equal fingerprints are one node, named by its smallest doc_id, so groups of copies are
    summed before anything is compared.  Null or wordless texts have fingerprint zero and are linked
    like others.  Whole texts are hashed, 65,536 shingles' bits at a time; extra columns are not read.  Rows with a null doc_id get a fingerprint, link nothing and have a null
    component.  Repeated rows stay; no rows: no rows.
    """
    prints = materialise(fingerprints(docs, width))
    nodes = materialise(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")))
    joined = components(links(nodes))
    named = nodes.join(joined, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    out = prints.join(named, "fp", "left").select("doc_id", hexed, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return out


def keep_first(docs: DataFrame, width: int = 3) -> DataFrame:
    """The documents without those whose component has an earlier one.  Documents
    without an id stay."""
    gone = simhash(docs, width).where("component_id < doc_id").select(F.col("doc_id").alias("gone")).distinct()
    placed, name = by_place(docs)
    return placed.join(gone, F.col(name("doc_id")) == F.col("gone"), "left_anti").toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash(table(spark, sf_dir, "documents"))
