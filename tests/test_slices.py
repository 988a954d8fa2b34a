"""What Python holds at once of a batch."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestra.functions import markdown, numbers, text
from attestra.operators import dense, lexical
from attestra.operators.ranking import Best
from attestra.session import in_slices


def test_slices_are_the_batch():
    rows = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["x" * (i % 97) for i in range(1000)])], ["k", "t"])
    parts = list(in_slices([rows, rows.slice(0, 0), rows.slice(990)], 2_000))
    assert len(parts) > 20 and max(p.nbytes for p in parts) < 4_000
    assert pa.Table.from_batches(parts) == pa.Table.from_batches([rows, rows.slice(990)])
    assert pa.concat_arrays(list(in_slices([rows.column(1)], 2_000))) == rows.column(1)


def test_texts_come_a_few_at_a_time(spark):
    """No expression of a text takes Arrow batches, which Spark fills with up to 10,000 texts or 64 MB."""
    c = F.col("t")
    for made in (text.nfkc(c), numbers.numeric_tokens(c), markdown.markdown_chunks(c), markdown.without_fake_tables(c)):
        d = spark.createDataFrame([("x",)], "t string").select(made.alias("m"))
        plan = d._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_expressions_keep_nulls(spark):
    d = spark.createDataFrame([(1, "ﬁve 12 mg"), (2, None)], "id int, t string")
    rows = d.select("id", text.nfkc(F.col("t")).alias("n"), F.size(numbers.numeric_tokens(F.col("t"))).alias("k")).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, "five 12 mg", 1), (2, None, 0)]


@pytest.mark.parametrize("waiting", [0, 7, 1 << 14])
def test_best_lists_that_wait(monkeypatch, waiting):
    from attestra.operators import ranking

    monkeypatch.setattr(ranking, "WAITING", waiting)
    rng = np.random.default_rng(waiting)
    table = rng.integers(0, 40, (5, 300)) / 8
    table[rng.random(table.shape) < 0.3] = np.nan
    ids = rng.permutation(300)
    best = Best(5, 11)
    for start in range(0, 300, 13):
        best.add(table[:, start : start + 13], ids[start : start + 13])
    (got,) = best.rows(np.arange(5))
    want = [(c, i, -s) for c in range(5) for s, i in sorted((-s, i) for s, i in zip(table[c], ids, strict=True) if s == s)[:11]]
    assert sorted(zip(*(x.to_pylist() for x in got), strict=True)) == sorted(want)


def test_a_block_of_claims_meets_few_scores_at_once():
    """2,048 claims met 1,024 vectors at once, and BM25 two million scores."""
    assert lexical.SCORES * 8 <= 4 << 20 and dense.BLOCK * max(1, min(dense.SLICE, lexical.SCORES // dense.BLOCK)) <= lexical.SCORES
