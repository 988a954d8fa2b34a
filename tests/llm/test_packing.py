import random
from collections import Counter, defaultdict

import pandas as pd
import pytest

from attestra.llm.packing import best_fit_pack, pack_shard
from tests.llm.helpers import documents, frame


@pytest.mark.parametrize("seed", range(5))
def test_best_fit_is_the_tightest_compatible_bin(seed):
    rng = random.Random(seed)
    pieces = pd.DataFrame({"doc_id": range(200), "piece": 0, "n_tokens": [rng.randrange(1, 60) for _ in range(200)], "source": [rng.choice("aaab") for _ in range(200)], "cluster": [rng.choice([1, 2, 3, *range(10, 300)]) for _ in range(200)]})
    got = pack_shard(pieces, 64, 3)
    full = -(-pieces.n_tokens.sum() // 64)
    most = {s: max(3, -(-2 * n // full)) for s, n in pieces.source.value_counts().items()}
    bins: dict[int, list] = defaultdict(list)
    for r in got.itertuples():
        room = {b: 64 - sum(x.n_tokens for x in v) for b, v in bins.items()}
        fits = [b for b, v in bins.items() if room[b] >= r.n_tokens and all(x.cluster != r.cluster for x in v) and sum(x.source == r.source for x in v) < most[r.source]]
        if fits:
            assert r.bin in fits and room[r.bin] == min(room[b] for b in fits)
        else:
            assert r.bin not in bins
        bins[r.bin].append(r)


def test_pack(spark):
    rows = documents(7, 120) * 2
    out = best_fit_pack(frame(spark, rows), capacity=100, per_source=2, shard=64).toPandas()
    size = Counter()
    for r in rows:
        size[r[0]] += len((r[1] or "").split())
    assert out.groupby("doc_id").n_tokens.sum().to_dict() == dict(size)
    packed = out.dropna(subset=["bin_id"])
    assert (out[out.bin_id.isna()].n_tokens == 0).all() and (packed.n_tokens > 0).all()
    for shard, s in packed.groupby(packed.bin_id // 2**32):
        full = -(-s.n_tokens.sum() // 100)
        most = {name: max(2, -(-2 * n // full)) for name, n in s.source.fillna("~").value_counts().items()}
        for _, b in s.groupby("bin_id"):
            assert b.n_tokens.sum() <= 100 and b.cluster.is_unique
            assert all(n <= most[name] for name, n in b.source.fillna("~").value_counts().items()), shard
    for _, b in packed.groupby("bin_id"):
        ends = b.sort_values("bin_offset")
        assert (ends.bin_offset.iloc[1:].to_numpy() == (ends.bin_offset + ends.n_tokens).iloc[:-1].to_numpy()).all()
    assert out[out.doc_id == rows[9][0]].piece.max() + 1 == max(1, -(-len(rows[9][1].split()) // 100))


def test_empty(spark):
    assert best_fit_pack(frame(spark, [])).count() == 0


def test_clusters_from_a_column(spark):
    rows = documents(8, 40)
    out = best_fit_pack(frame(spark, rows), capacity=500, cluster="size").toPandas().dropna(subset=["bin_id"])
    assert out.bin_id.is_unique  # all rows are of cluster 7


def test_bins_do_not_depend_on_partitions(spark):
    rows = documents(7, 90) * 3
    both = [sorted(map(tuple, best_fit_pack(frame(spark, rows).repartition(n), capacity=120, shard=50).collect()), key=repr) for n in (1, 7)]
    assert both[0] == both[1]


def test_one_source_fills_its_bins():
    rng = random.Random(5)
    pieces = pd.DataFrame({"doc_id": range(3000), "piece": 0, "n_tokens": [rng.randrange(40, 80) for _ in range(3000)], "source": "a", "cluster": range(3000)})
    got = pack_shard(pieces, 2048, 4)
    assert got.n_tokens.sum() / (2048 * got.bin.nunique()) > 0.95


def test_large_and_null_ids_come_back(spark):
    """One shard with a null id and ids that floats cannot tell apart."""
    ids = [2**53 + 1, None, 2**53 + 3, 2**53 + 5, -(2**63), 2**63 - 1, None]
    rows = [(i, f"text number {n}", "en", "a" if n % 2 else None, 1, 7, "x", 0.5, "y", "z", None) for n, i in enumerate(ids)]
    got = [r.doc_id for r in best_fit_pack(frame(spark, rows)).where("bin_id is not null").collect()]
    assert Counter(got) == Counter(ids)
