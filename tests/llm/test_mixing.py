import random
import re

import pytest
from pyspark.sql import functions as F

from attestra.llm.mixing import mix_sources, mixed_documents, targets
from tests.llm.helpers import DOCS, documents, frame, rows_of


def reshared(sizes, weights=(5, 2, 1), cap=3):
    """The rule step by step: share by weight, cut what is above, share the excess again."""
    w = [weights[i % len(weights)] for i in range(len(sizes))]
    total, full = sum(sizes), set()
    while True:
        rest = total - sum(cap * sizes[i] for i in full)
        base = sum(w[i] for i in range(len(sizes)) if i not in full)
        t = [cap * s if i in full else rest * w[i] / base for i, s in enumerate(sizes)]
        over = {i for i, s in enumerate(sizes) if t[i] > cap * s + 1e-9}
        if not over:
            return t
        full |= over


@pytest.mark.parametrize("seed", range(6))
def test_targets_equal_the_stepwise_rule(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 5, 40, 300, 5000]) + rng.randrange(10) for _ in range(rng.randrange(1, 9))]
    rows = [(f"s{i:02d}", s) for i, s in enumerate(sizes)]
    got = {r["key"]: r["target"] for r in targets(spark.createDataFrame(rows, "key string, size long")).collect()}
    for (k, _), want in zip(rows, reshared(sizes), strict=True):
        assert got[k] == pytest.approx(want)


@pytest.mark.parametrize("block", [1024, 5])
def test_mix(spark, block):
    rows = documents(4, 80)
    out = mix_sources(frame(spark, rows), block=block).toPandas()
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    assert sorted(out.doc_id) == sorted(size) and all(size[i] == s for i, s in zip(out.doc_id, out["size"], strict=True))
    assert (out.taken <= 3 * out["size"]).all()
    for _, g in out.groupby(out.source.fillna("~")):
        assert g["size"].sum() == g.source_size.iloc[0]
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 1
    assert sum(g.target.iloc[0] for _, g in out.groupby(out.source.fillna("~"))) == pytest.approx(sum(size.values()))
    again = mix_sources(frame(spark, rows[::-1]), block=block)
    assert rows_of(again, "doc_id", "taken") == rows_of(spark.createDataFrame(out[["doc_id", "taken"]]), "doc_id", "taken")


def test_empty_and_wordless(spark):
    assert mix_sources(frame(spark, [])).count() == 0
    rows = [(1, None, "en", "a", None, 1, "", 0.0, "", "", ""), (2, " ", "en", None, 1, 1, "", 0.0, "", "", "")]
    assert rows_of(mix_sources(frame(spark, rows)), "doc_id", "taken") == [(1, 0), (2, 0)]


def test_repeated_rows_count_each(spark):
    rows = documents(5, 20)
    out = mix_sources(frame(spark, rows + rows[6:9] + rows[6:9]))
    assert out.count() == 26


def test_no_python_in_the_plan(spark):
    plan = mix_sources(frame(spark, documents()))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_mixed_documents_keep_columns(spark):
    docs = frame(spark, documents(6, 60))
    out = mixed_documents(docs)
    assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
    n = out.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    assert 1 <= n <= 3
    assert mixed_documents(frame(spark, [], DOCS)).count() == 0
