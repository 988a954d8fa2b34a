import random

import corpus_pipeline
from attestra.llm.simhash import fingerprint
from tests.llm.helpers import documents, frame, prose


def folder(spark, tmp_path, rows):
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows[::2]] or [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_stages(spark, tmp_path):
    rng = random.Random(1)
    passage = prose(rng, 60)
    tail = documents()[9][2:]
    rows = [(i, f"{prose(rng, 40)} n{i} {prose(rng, 40)}", *tail) for i in range(30)]
    rows += [(100, rows[0][1], *tail), (101, f"{prose(rng, 50)} {passage}", *tail), (102, f"{passage} {prose(rng, 50)}", *tail)]
    rows += [(200, prose(rng, 40) + ". You idiot, you stupid moron, worthless scum! " + prose(rng, 40), *tail)]
    sf = folder(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(seen["toxicity"]) == {r[0] for r in rows} - {200}
    left = {}
    for r in rows[:-1]:
        left.setdefault(fingerprint(r[1]), r[0])
    assert set(seen["simhash"]) == set(left.values()) and 100 not in seen["simhash"]
    assert passage in seen["substrings"][101] and passage not in seen["substrings"][102]
    assert set(seen["mixing"]) <= set(seen["substrings"])
    packed = corpus_pipeline.run(spark, sf).toPandas()
    assert set(packed.doc_id) == set(seen["mixing"])
    assert packed.groupby("bin_id").n_tokens.sum().max() <= 2048


def test_folders_go(spark, tmp_path):
    from pathlib import Path

    from attestra.llm.common import shared_path

    sf = folder(spark, tmp_path, documents(4, 60))
    there = lambda: set(Path(shared_path(spark).removeprefix("file:")).glob("pipeline-*"))
    before = there()
    out = corpus_pipeline.run(spark, sf)
    assert there() <= before and out.count() > 0


def test_empty(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path, [])).count() == 0


def test_folders_go_when_a_stage_fails(spark, tmp_path, monkeypatch):
    from pathlib import Path

    import pytest

    from attestra.llm.common import shared_path

    def broken(*_):
        raise RuntimeError("broken")

    monkeypatch.setattr(corpus_pipeline, "STAGES", [corpus_pipeline.STAGES[0], ("broken", broken), *corpus_pipeline.STAGES[2:]])
    there = lambda: set(Path(shared_path(spark).removeprefix("file:")).glob("pipeline-*"))
    before = there()
    with pytest.raises(RuntimeError, match="broken"):
        corpus_pipeline.run(spark, folder(spark, tmp_path, documents(4, 20)))
    assert there() <= before
