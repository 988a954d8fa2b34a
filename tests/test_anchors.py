from attestra.plans import catalog


def test_a_shared_beginning_is_no_anchor(spark, tmp_path):
    claim = "the river and the stone " * 6
    spark.createDataFrame([(1, claim)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = [(10, f"before {claim} after"), (11, f"before {claim[:80]} another end"), (12, "nothing of it")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalog.queries()["j13_verbatim_anchors"](spark, str(tmp_path)).collect()
    assert [(r["item_id"], r["doc_id"]) for r in got] == [(1, 10)]
