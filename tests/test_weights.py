"""Weights of all words against counts by hand."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from attestra import fixed
from attestra.functions import text
from attestra.operators import lexical

ROWS = [(1, "trial dose dose"), (2, "placebo trial"), (3, "trial"), (4, None), (5, "the of"), (6, "dose " * 12_000 + "trial " * 30_000), (7, "rare")]


def by_hand(rows):
    """Rows with one id are one document."""
    counts = {}
    for i, t in rows:
        counts.setdefault(i, Counter()).update(w for w in (t or "").split() if w not in ("the", "of"))
    df = Counter(w for c in counts.values() for w in c)
    n, average = len(rows), sum(c.total() for c in counts.values()) / len(rows)
    weight = lambda tf, dl: tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / average))
    return sorted((i, w, tf, df[w], round(weight(tf, c.total()), 9), round(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1), 9)) for i, c in counts.items() for w, tf in c.items())


def weights(docs):
    rows = lexical.weighted(docs, "id", "text").select("id", "token", "tf", "df", F.round("weight", 9), F.round("idf", 9))
    return sorted(tuple(r) for r in rows.collect())


@pytest.mark.parametrize("frequent", [0, 2, 100])
def test_frequent_and_other_words(spark, monkeypatch, frequent):
    monkeypatch.setattr(lexical, "FREQUENT", frequent)
    assert weights(spark.createDataFrame(ROWS, "id long, text string")) == by_hand(ROWS)


def test_rows_with_one_id_are_one_document(spark):
    rows = [*ROWS, (1, "dose"), (2, "trial rare"), (3, "trial")]
    assert weights(spark.createDataFrame(rows, "id long, text string").repartition(3)) == by_hand(rows)


def test_counts_need_no_exchange(spark):
    held = lexical.counted(spark.createDataFrame(ROWS, "id long, text string").coalesce(4), "id", "text")
    assert {r.id: (r.dl, dict(zip(r.words.split(), r.tfs, strict=True))) for r in held.collect()} == {
        1: (3, {"trial": 1, "dose": 2}), 2: (2, {"placebo": 1, "trial": 1}), 3: (1, {"trial": 1}), 6: (42_000, {"dose": 12_000, "trial": 30_000}), 7: (1, {"rare": 1}),
    }
    assert "Exchange" not in held._jdf.queryExecution().executedPlan().toString()


def test_all_forms_of_a_word(spark):
    """Each token that is stemmed to a word is among the word's forms, and no other is."""
    roots = ["trial", "treat", "rel", "nat", "agr", "hop", "x", "ab", "stat", *fixed.IRREGULAR_STEMS, *fixed.IRREGULAR_STEMS.values()]
    raws = {r + e for r in roots for e in ["", *(s for s, _ in fixed.SUFFIXES), *(n for _, n in fixed.SUFFIXES)]} | {"the", "during", "1.5%", "a"}
    pairs = spark.createDataFrame([(r,) for r in sorted(raws)], "raw string").where(text.index_token(F.col("raw"))).select("raw", text.stem("raw").alias("token"))
    found = {tuple(r) for r in lexical.raw_forms(pairs.select("token").distinct()).collect()}
    assert {tuple(r) for r in pairs.collect()} <= found
    told = spark.createDataFrame(sorted(found), "raw string, token string")
    assert told.where((text.stem("raw") != F.col("token")) | ~text.index_token(F.col("raw"))).isEmpty()
