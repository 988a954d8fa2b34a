import random
import re

import numpy as np
import pytest
import xxhash

from attestra.llm import simhash as module
from attestra.llm.simhash import AGREE, TRIPLES, fingerprint, keep_first, linked, links, simhash, tallied
from tests.llm.helpers import documents, frame, union_find

LOW = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def plain(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    h = [xxhash.xxh64(" ".join(s).encode(), seed=42).intdigest() for s in ([w[i : i + 3] for i in range(len(w) - 2)] or ([w] if w else []))]
    return sum(1 << b for b in range(64) if h and 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", "  ", "A", "A b", "Ab É C d E", "x y z " * 50, "\x0b a\x0cb c d e f"])
def test_fingerprint(text):
    assert fingerprint(text) == plain(text)


def components_of(rows):
    f = [plain(r[1]) for r in rows]
    n = len(f)
    return f, union_find(n, [(i, j) for i in range(n) for j in range(i) if (f[i] ^ f[j]).bit_count() <= 3])


def test_components_against_all_pairs(spark):
    rows = documents(9, 150)
    f, want = components_of(rows)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash(frame(spark, rows)).collect()}
    for i, r in enumerate(rows):
        assert got[r[0]] == (f"{f[i]:016x}", rows[want[i]][0])


def skewed(seed, near=40, apart=60):
    """Fingerprints around few centres, a third around one, and unlike ones."""
    rng = random.Random(seed)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = {b ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) & (2**64 - 1) for b in [*base, *base[:1] * 5] for _ in range(near)}
    return sorted(fps | {rng.getrandbits(64) for _ in range(apart)})


def within(fps):
    n = len(fps)
    return [(i, j) for i in range(n) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3]


@pytest.mark.parametrize("positions", [3, 4, 5])
@pytest.mark.parametrize("seed", range(3))
def test_tallies_of_a_block(seed, positions):
    fps = [f | (1 << 8 * positions) - 1 for f in skewed(seed)]
    fps = sorted(set(fps))
    a = np.array(fps, dtype=np.uint64).view(np.int64)
    key, mask = np.zeros(len(a), dtype=np.int64), np.full(len(a), (1 << positions) - 1)
    x, y, tally = tallied(key, mask, a)
    shared = {(i, j): sum(fps[i] >> 8 * p & 255 == fps[j] >> 8 * p & 255 for p in range(8)) for j in range(len(fps)) for i in range(j)}
    got = dict(zip(zip(x.tolist(), y.tolist(), strict=True), tally.tolist(), strict=True))
    if positions == AGREE:  # more is not needed, so it is not counted
        assert got == dict.fromkeys(shared, AGREE)
    else:
        assert got == {p: n for p, n in shared.items() if n > positions}
    if positions == 3:  # the filter drops pairs before any is verified
        assert sum(n < AGREE for n in got.values()) > 0.2 * len(got) > 0
    edges = list(zip(*(e.tolist() for e in linked(key, mask, a)), strict=True))
    assert union_find(len(fps), edges) == union_find(len(fps), within(fps)) and len(edges) < len(fps)


@pytest.mark.parametrize("block", [10**6, 8, 0])
def test_long_blocks_are_split(spark, monkeypatch, block):
    monkeypatch.setattr(module, "BLOCK", block)
    monkeypatch.setattr(module, "SAMPLE", 1)
    monkeypatch.setattr(module, "PAIRS", 5000)
    fps = skewed(5, 30, 100)
    nodes = spark.createDataFrame([(f - 2**64 if f >> 63 else f, i) for i, f in enumerate(fps)], "fp long, node long")
    edges = [(r["a"], r["b"]) for r in links(nodes).collect()]
    assert union_find(len(fps), edges) == union_find(len(fps), within(fps))
    assert len(TRIPLES) == 8


def test_a_block_that_is_never_split(monkeypatch):
    """Five shared positions: all pairs, some at a time, joined as they come."""
    monkeypatch.setattr(module, "PAIRS", 50)
    rng = np.random.default_rng(3)
    fps = np.unique(rng.integers(0, 1 << 12, 300)).astype(np.int64)
    edges = list(zip(*(e.tolist() for e in linked(np.zeros(len(fps), dtype=np.int64), np.full(len(fps), 0b11111000), fps)), strict=True))
    assert union_find(len(fps), edges) == union_find(len(fps), within(fps.tolist())) and len(edges) < len(fps)


def test_null_ids_empty_and_repeated(spark):
    assert simhash(frame(spark, [])).count() == 0
    row = documents(1, 10)[8]
    rows = [row, row, (None, *row[1:])]
    out = simhash(frame(spark, rows)).toPandas()
    assert len(out) == 3 and out.fingerprint.nunique() == 1 and out.component_id.isna().sum() == 1


def test_keep_first(spark):
    rows = documents(9, 100)
    _, want = components_of(rows)
    docs = frame(spark, rows)
    out = keep_first(docs)
    assert out.columns == docs.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted({rows[i][0] for i in want})
