"""The jobs over copies that grow, from their command lines, and run again."""

import json
import subprocess
import sys
from pathlib import Path

import pytest

from attestra.operators import inverted, lexical
from attestra.plans import bindings, jobs as plans
from jobs import index_documents, substantiate_claims

ROOT, SF = Path(__file__).resolve().parent.parent, "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables here")


def found(df):
    return sorted((r.claim_id, r.id, r["rank"], round(r.score, 9)) for r in df.collect())


def test_index_grows_with_the_folder(spark, tmp_path):
    docs, folder, index, mark = spark.read.parquet(f"{SF}/documents.parquet"), f"{tmp_path}/docs", f"{tmp_path}/index", f"{tmp_path}/mark"
    docs.where("doc_id % 3 = 0").repartition(4).write.parquet(folder)
    given = {"documents": folder, "output": index, "checkpoint": mark, "files": 3}
    first = index_documents.run(spark, **given)
    assert first["batches"] == 2 and first["written"] == first["documents"] == docs.where("doc_id % 3 = 0").count()
    files = {p: p.stat().st_mtime_ns for p in Path(index).rglob("*.parquet")}
    docs.where("doc_id % 3 <> 1").coalesce(1).write.mode("append").parquet(folder)  # a third came before
    second = index_documents.run(spark, **given)
    assert second == {"read": docs.where("doc_id % 3 <> 1").count(), "written": docs.where("doc_id % 3 = 2").count(), "batches": 1, "documents": docs.where("doc_id % 3 <> 1").count()}
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    docs.where("doc_id % 3 = 1").write.mode("append").parquet(folder)
    index_documents.run(spark, **given)
    assert index_documents.run(spark, **given) == {"read": 0, "written": 0, "batches": 0, "documents": docs.count()}
    asked = bindings.claims(spark, SF)
    assert found(inverted.search(asked, "claim_id", "text", index, 20)) == found(lexical.bm25_search(asked, "claim_id", "text", docs, "doc_id", "text", 20))


def test_index_without_its_mark(spark, tmp_path):
    """All files come again, in another number of parts: ids that are there are left out."""
    docs, folder, index = spark.read.parquet(f"{SF}/documents.parquet").limit(60), f"{tmp_path}/docs", f"{tmp_path}/index"
    docs.repartition(3).write.parquet(folder)
    index_documents.run(spark, folder, index, f"{tmp_path}/mark", files=1)
    want = sorted(tuple(r) for r in inverted.postings(spark, index).collect())
    index_documents.run(spark, folder, index, f"{tmp_path}/other", files=2)
    assert sorted(tuple(r) for r in inverted.postings(spark, index).collect()) == want and inverted.statistics(spark, index)[0] == 60


def test_claims_by_type(spark, tmp_path):
    output = f"{tmp_path}/out"
    given = plans.settings("substantiate_claims") | {"claims": f"{SF}/benchmark.parquet", "documents": f"{SF}/documents.parquet", "vectors": f"{SF}/embeddings.parquet", "output": output}
    substantiate_claims.run(spark, **given)
    rows = lambda: sorted((tuple(r) for r in spark.read.parquet(output).collect()), key=repr)
    files = lambda ct: {p.name for p in Path(output, f"ct_id={ct}").glob("*.parquet")}
    want, others = rows(), files("CT-301")
    assert {r.claim_id for r in spark.read.parquet(output).collect()} == {r.claim_id for r in bindings.claims(spark, SF).collect()}
    substantiate_claims.run(spark, **given, only=["CT-201"])
    assert rows() == want and files("CT-301") == others
    none = spark.read.parquet(output).where("verdict = 'PASS' and (covered = 0 or score < 80)")
    assert none.isEmpty() and spark.read.parquet(output).where("rank > 20 or anchors > sentences").isEmpty()


def test_claim_without_evidence(spark):
    claims = spark.createDataFrame([(1, "One thing holds. Another does not.", "CT-1"), (2, "Nothing here", "CT-1"), (3, None, "CT-1")], "claim_id long, text string, ct_id string")
    hits = spark.createDataFrame([(1, 7, "C"), (1, 8, "C")], "claim_id long, id long, tier string")
    chunks = spark.createDataFrame([(7, "x One thing holds. y"), (8, "Another does not. One thing holds.")], "id long, text string")
    anchors, verdicts = substantiate_claims.judged(claims, hits, chunks, 80, 60)
    assert {tuple(r) for r in anchors.collect()} == {(1, 7, 1), (1, 8, 2)}
    assert {tuple(r) for r in verdicts.collect()} == {(1, "CT-1", 2, 2, 60.0, "SOFT_FLAG"), (2, "CT-1", 1, 0, 0.0, "BLOCK"), (3, "CT-1", 0, 0, 0.0, "BLOCK")}


@pytest.mark.parametrize("name", ["index_documents", "substantiate_claims"])
def test_command_line(tmp_path, name):
    """The job from its file, in a process of its own."""
    config = plans.settings(name) | {k: f"{SF}/{v}.parquet" for k, v in {"documents": "documents", "claims": "benchmark", "vectors": "embeddings"}.items() if k in plans.settings(name)}
    config |= {"output": f"{tmp_path}/none"} | ({"checkpoint": f"{tmp_path}/mark"} if "checkpoint" in config else {})
    (tmp_path / "config.json").write_text(json.dumps(config))
    line = [sys.executable, str(ROOT / "jobs" / f"{name}.py"), "--config", str(tmp_path / "config.json"), "--output", f"{tmp_path}/out"]
    done = subprocess.run(line, capture_output=True, text=True, timeout=300, cwd=tmp_path, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert json.loads(done.stdout.strip().splitlines()[-1]) and list((tmp_path / "out").rglob("*.parquet")) and not (tmp_path / "none").exists()
    assert "read" in done.stderr and "wrote" in done.stderr
