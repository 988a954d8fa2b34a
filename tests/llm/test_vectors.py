import numpy as np
import pytest

from attestra.llm import neardup, topk
from attestra.llm.neardup import near_duplicates
from attestra.llm.topk import top_products
from tests.llm.helpers import union_find

SCHEMA = "vec_id long, embedding array<float>, label int, n long, component string"


def vectors(seed=1, n=300, dim=8):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, dim))
    for i in range(20, n, 3):  # near copies, copies, scaled copies
        x[i] = x[i % 20] + rng.standard_normal(dim) * 0.05
    x[7] = x[5]
    x[8] = 3 * x[5]
    x[9] = x[5]
    rows = [(i * 5, [float(v) for v in x[i]], 0, 1, "q") for i in range(n)]
    odd = [(1, None, 0, 1, "q"), (2, [0.0] * dim, 0, 1, "q"), (3, [None, *[1.0] * (dim - 1)], 0, 1, "q"), (4, [float("nan")] * dim, 0, 1, "q"), (6, [float("inf"), *[0.0] * (dim - 1)], 0, 1, "q"), (7, [], 0, 1, "q")]
    return rows + odd


def unit(rows):
    out = {}
    for i, v, *_ in rows:
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            a = np.array(np.array(v, dtype=np.float32), dtype=np.float64)
            out[i] = a / np.linalg.norm(a)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = vectors(seed)
    u = unit(rows)
    ids = sorted(u)
    m = np.stack([u[i] for i in ids])
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    comp = union_find(len(ids), [(int(a), int(b)) for a, b in np.argwhere(near)])
    want = {i: (int(near[k].sum()), ids[comp[k]]) for k, i in enumerate(ids)} | {r[0]: (0, r[0]) for r in rows if r[0] not in u}
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out} == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out)


@pytest.mark.parametrize("sent", [200, 2000])
def test_near_duplicates_by_cells(spark, monkeypatch, sent):
    monkeypatch.setattr(neardup, "SENT_BYTES", sent)
    rng = np.random.default_rng(sent)
    centres = rng.standard_normal((6, 8))
    x = centres[rng.integers(0, 6, 120)] + rng.standard_normal((120, 8)) * 0.3
    rows = [(i, [float(v) for v in x[i]], 0, 0, "") for i in range(120)]
    m = np.stack([unit(rows)[i] for i in range(120)])
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), passes=1, window=1).toPandas().sort_values("vec_id")
    assert out.n_links.tolist() == near.sum(1).tolist()
    assert out.component_id.tolist() == union_find(120, np.argwhere(near).tolist())


def test_near_duplicates_of_few(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    one = near_duplicates(spark.createDataFrame([(3, [1.0, 0.0], 0, 0, ""), (None, [1.0, 0.0], 0, 0, "")], SCHEMA)).collect()
    assert sorted((str(r["vec_id"]), r["n_links"]) for r in one) == [("3", 0), ("None", 0)]


def test_one_large_group(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal(16)
    rows = [(i, [float(v) for v in base + rng.standard_normal(16) * 0.01], 0, 0, "") for i in range(700)]
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert (out.n_links == 699).all() and (out.component_id == 0).all() and out.kept.sum() == 1


def test_crowded_cone(spark):
    """Pairs at cosine 0.905 among vectors that are at 0.8 to each other, which no window of a pass parts."""
    rng = np.random.default_rng(7)
    x = rng.standard_normal((2000, 64))
    x[:, 0] = 0
    x = np.sqrt(0.2) * x / np.linalg.norm(x, axis=1, keepdims=True)
    x[:, 0] = np.sqrt(0.8)
    for i in range(150):
        z = rng.standard_normal(64)
        z -= (z @ x[i]) * x[i]
        x[1999 - i] = 0.905 * x[i] + np.sqrt(1 - 0.905**2) * z / np.linalg.norm(z)
    rows = [(i, [float(v) for v in x[i]], 0, 0, "") for i in range(2000)]
    u = unit(rows)
    m = np.stack([u[i] for i in range(2000)])
    near = m @ m.T >= 0.9
    np.fill_diagonal(near, False)
    out = near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).toPandas().sort_values("vec_id")
    assert out.n_links.tolist() == near.sum(1).tolist()
    assert out.component_id.tolist() == union_find(2000, np.argwhere(near).tolist())


def test_links_come_from_the_passes(spark, monkeypatch):
    """Without what the passes find there is no link, but by the exact way."""
    df = spark.createDataFrame(vectors(4), SCHEMA).repartition(3)
    links = lambda **options: sum(r.n_links for r in near_duplicates(df, **options).collect())
    want = links()
    assert want > 100 and links(exact=True) == want
    monkeypatch.setattr(neardup, "pass_links", lambda v, *_: v.select(neardup.F.col("vec_id").alias("a"), neardup.F.col("vec_id").alias("b"), "probe"))
    assert links() < 10  # equal vectors alone
    assert links(exact=True) == want


def test_rounds_go_on_until_partners_are_found(spark, monkeypatch):
    """A narrow window in a cone: partners are missed at first, so passes are added."""
    monkeypatch.setattr(neardup, "PROBES", 200)
    rng = np.random.default_rng(2)
    x = rng.standard_normal((600, 32)) * 0.5
    x[:, 0] = 4
    df = spark.createDataFrame([(i, [float(v) for v in x[i]], 0, 0, "") for i in range(600)], SCHEMA)
    found = neardup.usable_vectors(df)
    rounds = []
    kept = neardup.pass_links
    monkeypatch.setattr(neardup, "pass_links", lambda *a: rounds.append(a[3]) or kept(*a))
    _, share = neardup.candidate_links(found, 0.95, 0.95, 2, 4)
    assert len(rounds) > 1 and rounds == [4 << k for k in range(len(rounds))] and (share >= 0.95 or len(rounds) == neardup.ROUNDS)


def test_pieces_are_counted_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TOGETHER", 16)
    monkeypatch.setattr(neardup, "ROWS", 7)
    rows = vectors(6)
    u = unit(rows)
    m = np.stack([u[i] for i in sorted(u)])
    near = m @ m.T >= 0.9
    want = dict(zip(sorted(u), (near.sum(1) - 1).tolist(), strict=True))
    for sent in (100_000, 0):
        monkeypatch.setattr(neardup, "SENT", sent)
        got = {r.vec_id: r.n_links for r in near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
        assert {i: got[i] for i in want} == want


def best(rows, every=100, k=10):
    v = {}
    for i, x, *_ in rows:
        if x is not None and all(c is not None and np.isfinite(c) for c in x):
            v[i] = [int(np.floor(1024.0 * float(np.float32(c)))) for c in x]
    out = []
    for q in sorted(v):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v[q], v[p], strict=False)), p) for p in v if p != q)
            out += [(q, r, p, -s) for r, (s, p) in enumerate(scored[:k], 1)]
    return out


@pytest.mark.parametrize("seed,scale,n", [(1, 1.0, 300), (2, 100.0, 300), (3, 1e4, 60), (4, -1.0, 40)])
def test_top_products(spark, seed, scale, n):
    rows = [(r[0], None if r[1] is None else [c if c is None else c * scale * (1 + r[0] % 7) for c in r[1]], *r[2:]) for r in vectors(seed, n)]
    out = top_products(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out.collect()) == best(rows)


@pytest.mark.parametrize("sent,block", [(300, 4096), (100, 20), (8 << 20, 7)])
def test_top_products_in_parts(spark, monkeypatch, sent, block):
    monkeypatch.setattr(topk, "SENT_BYTES", sent)
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "FIRST", 12)
    rows = [(r[0], None if r[1] is None else [c if c is None else c * (1 + r[0] % 7) for c in r[1]], *r[2:]) for r in vectors(5, 160)]
    out = top_products(spark.createDataFrame(rows, SCHEMA).repartition(3), every=25)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out.collect()) == best(rows, 25)


def test_top_products_of_few_and_ties(spark):
    assert top_products(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(i, [1.0, -1.0], 0, 0, "") for i in (0, 9, 4, 100)] * 2
    got = sorted((r["query_id"], r["rank"], r["vec_id"]) for r in top_products(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(0, 1, 4), (0, 2, 9), (0, 3, 100), (100, 1, 0), (100, 2, 4), (100, 3, 9)]
    many = [(i, [0.001 * (i % 3), 0.5], 0, 0, "") for i in range(400)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_products(spark.createDataFrame(many, SCHEMA)).collect()) == best(many)
