"""The kept inverted index against the search that reads the texts."""

import random

import pytest
from pyspark.sql import functions as F

from attestra.operators import inverted, lexical

WORDS = "trial placebo dose injection frozen warmed patients outcome ratio 12% 3.5 response adverse reaction treating treated safely stable the of and".split()


def corpus(spark, n=300, seed=4):
    rng = random.Random(seed)
    weight = [1 / (i + 1) for i in range(len(WORDS))]
    rows = [(i, None if i % 50 == 7 else " ".join(rng.choices(WORDS, weight, k=rng.randrange(1, 60)))) for i in range(n)]
    rows += [(n, ""), (n + 1, "the of and"), (n + 2, "trial " * 3000), (n + 3, rows[5][1]), (n + 4, "É ß unknown")]
    return spark.createDataFrame(rows, "id long, text string").repartition(3)


def claims(spark, n=12, seed=9):
    rng = random.Random(seed)
    return spark.createDataFrame([(100 + i, " ".join(rng.choices(WORDS + ["absent"], k=rng.randrange(1, 5)))) for i in range(n)] + [(1, ""), (2, None), (3, "the")], "claim_id long, text string")


def hits(df):
    return sorted((r.claim_id, r.id, r["rank"], round(r.score, 9)) for r in df.collect())


def weights(spark, path):
    return sorted((r.id, r.token, r.tf, r.dl, r.df, round(r.weight, 9), round(r.idf, 9)) for r in inverted.postings(spark, path).collect())


@pytest.fixture(scope="module")
def paths(spark, tmp_path_factory):
    """The same documents in one batch, and in three that overlap and came twice."""
    docs, top = corpus(spark), tmp_path_factory.mktemp("inverted")
    one, three = f"{top}/one", f"{top}/three"
    assert inverted.add(docs, "id", "text", one) == docs.count()
    for n, part in enumerate([docs.where("id % 3 = 0"), docs.where("id % 3 <> 1"), docs.where("id < 50"), docs]):
        inverted.add_batch(part, "id", "text", three, n, zone=8)
        inverted.add_batch(part, "id", "text", three, n, zone=8)
    return docs, one, three


def test_batches_add_up(spark, paths):
    docs, one, three = paths
    assert weights(spark, one) == weights(spark, three)
    assert inverted.statistics(spark, one) == inverted.statistics(spark, three)
    want = lexical.weighted(docs, "id", "text").select("id", "token", F.col("tf").cast("int"), "df", "weight", "idf")
    assert [(w[0], w[1], w[2], *w[4:]) for w in weights(spark, one)] == sorted((r[0], r[1], r[2], r[3], round(r[4], 9), round(r[5], 9)) for r in want.collect())


@pytest.mark.parametrize("k", [1, 5, 1000])
def test_search_equals_reading_the_texts(spark, paths, k, monkeypatch):
    docs, one, three = paths
    monkeypatch.setattr(inverted, "SCORES", 100)  # zones are scored in many pieces
    want = hits(lexical.bm25_search(claims(spark), "claim_id", "text", docs, "id", "text", k))
    assert want and hits(inverted.search(claims(spark), "claim_id", "text", one, k)) == want
    assert hits(inverted.search(claims(spark), "claim_id", "text", three, k)) == want


def test_claims_in_blocks(spark, paths, monkeypatch):
    monkeypatch.setattr(inverted, "SEARCHED", 5)
    docs, _, three = paths
    assert hits(inverted.search(claims(spark), "claim_id", "text", three, 3)) == hits(lexical.bm25_search(claims(spark), "claim_id", "text", docs, "id", "text", 3))


def test_zones_are_skipped(spark, tmp_path, monkeypatch):
    """Zones whose bound is under the best score so far are not read: a claim's word is in all, often in few."""
    rows = [(i, "trial " * (40 if i < 6 else 1) + "filler " * 60) for i in range(400)]
    docs = spark.createDataFrame(rows, "id long, text string")
    inverted.add_batch(docs, "id", "text", str(tmp_path), 0, zone=4)
    read = spark.sparkContext.accumulator(0)
    zones = inverted._zones

    def counted(batches):
        for t in zones(batches):
            if "claims" in t.schema.names:
                read.add(1)
            yield t

    monkeypatch.setattr(inverted, "_zones", counted)
    asked = spark.createDataFrame([(1, "trial")], "claim_id long, text string")
    got = hits(inverted.search(asked, "claim_id", "text", str(tmp_path), 3))
    assert [h[1] for h in got] == [0, 1, 2]
    there = spark.read.parquet(f"{tmp_path}/postings").select("zone").distinct().count()
    assert there > 50 and read.value < there / 5


def test_only_folders_of_the_words_are_read(spark, paths):
    _, one, _ = paths
    plan = inverted.table(spark, one, "postings").where(F.col("bucket").isin([3])).select("token")
    scan = plan._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in scan.split("PartitionFilters: [")[1].split("]")[0] and "ids" not in scan.split("ReadSchema")[1]


def test_a_batch_that_broke_off(spark, tmp_path, paths):
    """Postings without their row of sums are not read; writing the batch again makes it whole."""
    docs, one, _ = paths
    path = str(tmp_path)
    inverted.add_batch(docs.where("id < 100"), "id", "text", path, 0)
    spark.read.parquet(f"{one}/postings/batch=0").write.partitionBy("bucket").parquet(f"{path}/postings/batch=1")
    assert inverted.statistics(spark, path)[0] == 100 and all(w[0] < 100 for w in weights(spark, path))
    inverted.add_batch(docs, "id", "text", path, 1)
    assert weights(spark, path) == weights(spark, one)


def test_a_frequent_word_is_dealt_over_tasks(spark, tmp_path, paths, monkeypatch):
    """A task takes a bounded part of the texts: blocks of one word lie in several files, and long texts share a zone with few others."""
    docs, one, _ = paths
    monkeypatch.setattr(inverted, "PART", 400)
    monkeypatch.setattr(inverted, "CHARACTERS", 2000)
    inverted.add_batch(docs, "id", "text", str(tmp_path), 0, zone=8)
    blocks = spark.read.parquet(f"{tmp_path}/postings")
    assert blocks.where("token = 'trial'").select(F.input_file_name()).distinct().count() > 1
    assert weights(spark, str(tmp_path)) == weights(spark, one)
    zones = blocks.groupBy("zone").agg(F.sum("tokens").alias("tokens"), F.max("n").alias("n"))
    assert zones.where("tokens > 1000 and n > 1").isEmpty()


def test_rows_with_one_id(spark, tmp_path):
    """Of texts with one id the one with the smallest hash is indexed, whatever stands beside it."""
    rows = [(1, "trial dose"), (1, "placebo"), (2, "dose dose"), (3, "trial"), (3, "trial"), (None, "dose")]
    docs = spark.createDataFrame(rows, "id long, text string")
    assert inverted.add(docs, "id", "text", str(tmp_path)) == 3
    first = {r.id: r.text for r in docs.where("id is not null").orderBy(F.xxhash64("text").desc(), F.desc("text")).collect()}
    want = sorted((i, w, t.split().count(w)) for i, t in first.items() for w in set(t.split()))
    assert [w[:3] for w in weights(spark, str(tmp_path))] == want


def test_nothing_there(spark, tmp_path):
    path = str(tmp_path)
    none = spark.createDataFrame([], "id long, text string")
    assert inverted.add(none, "id", "text", path) == 0 and inverted.corpus(spark, path) == []
    assert not hits(inverted.search(claims(spark), "claim_id", "text", path)) and not weights(spark, path)
    empty = spark.createDataFrame([(1, None), (1, None), (2, ""), (None, "trial")], "id long, text string")
    assert inverted.add(empty, "id", "text", path) == 2 and inverted.statistics(spark, path) == (2, 1.0)
    assert not weights(spark, path) and inverted.add(empty, "id", "text", path) == 0
