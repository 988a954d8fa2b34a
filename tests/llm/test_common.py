import random

import pyarrow as pa
import pytest

from attestra.llm.common import components, runs_of_key
from tests.llm.helpers import union_find


@pytest.mark.parametrize("seed,n,m", [(1, 40, 30), (2, 60, 80), (3, 30, 29)])
def test_components(spark, seed, n, m):
    rng = random.Random(seed)
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(m)] if seed != 3 else [(i, i + 1) for i in range(29)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union_find(n, edges)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {i: want[i] for i in linked}


def test_components_of_nothing(spark):
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_runs_of_key(size):
    keys = [1, 1, 2, 3, 3, 3, 3, 4, 5, 5]
    batches = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + 3])], ["k"]) for i in range(0, len(keys), 3)]
    parts = [t["k"].to_pylist() for t in runs_of_key(batches, "k", size)]
    assert sum(parts, []) == keys
    assert all(a[-1] != b[0] for a, b in zip(parts, parts[1:], strict=False))
