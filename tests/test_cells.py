"""The index of cells against the search of all vectors."""

import numpy as np
import pytest

from attestra.operators import cells, dense


def table(spark, x, name="id", start=0):
    rows = [(start + i, None if v is None else [float(a) for a in v]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, f"{name} long, vector array<double>").repartition(3)


def clustered(n, seed=1, dim=16, centres=12):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((centres, dim))[rng.integers(0, centres, n)] + rng.standard_normal((n, dim)) * 0.05


def hits(df):
    return sorted((r.claim_id, r.id, r["rank"], round(r.score, 9)) for r in df.collect())


@pytest.mark.parametrize("k", [1, 10, 5000])
@pytest.mark.parametrize("kind", ["clusters", "random", "equal"])
def test_as_among_all(spark, tmp_path, k, kind):
    x = {"clusters": clustered(700), "random": np.random.default_rng(2).standard_normal((500, 8)), "equal": np.ones((60, 4))}[kind]
    chunks, claims = table(spark, [*x, None, np.zeros(x.shape[1])]), table(spark, [*x[:9], None, np.zeros(x.shape[1])], "claim_id", 1000)
    assert cells.write_cells(chunks, str(tmp_path)) == len(x)
    assert hits(cells.search_cells(claims, str(tmp_path), k)) == hits(dense.dense_search(claims, chunks, k))


def test_cells_out_of_reach_are_not_read(spark, tmp_path):
    x = clustered(3000, centres=30)
    cells.write_cells(table(spark, x), str(tmp_path))
    read = {}
    cells.search_cells(table(spark, x[:2], "claim_id", 9000), str(tmp_path), 5, read).collect()
    assert read["vectors"] == 3000 and read["read"] < 1500


def test_claims_in_blocks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", 4)
    x = clustered(200)
    cells.write_cells(table(spark, x), str(tmp_path))
    claims = table(spark, x[:15], "claim_id", 1000)
    assert hits(cells.search_cells(claims, str(tmp_path), 7)) == hits(dense.dense_search(claims, table(spark, x), 7))


def test_none(spark, tmp_path):
    path, claims = str(tmp_path), table(spark, np.ones((2, 3)), "claim_id")
    odd = spark.createDataFrame([(1, None), (2, [float("nan"), 1.0]), (None, [1.0, 1.0]), (3, [0.0, 0.0])], "id long, vector array<double>")
    assert cells.write_cells(odd, path) == 0 and not hits(cells.search_cells(claims, path))
