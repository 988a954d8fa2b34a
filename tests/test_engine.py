import json

import pytest
from pyspark.sql import functions as F

from attestra.operators import claims, corpus, fusion, gate, lexical, policy, quality, registry
from attestra.plans.verdicts import JUDGED, KINDS, as_judged
from attestra.sources import readers, writers
from attestra.streaming.ingest import ingest


def test_bm25_mini_corpus(spark):
    docs = spark.createDataFrame([(1, "Do not freeze the vial"), (2, "Store in a refrigerator, never frozen"), (3, "Wash hands with soap before injection"), (4, "Dose is 10 mg weekly")], "id long, t string")
    asked = spark.createDataFrame([(1, "freezing the syringe"), (2, "washing with soap"), (3, "the of and")], "c long, t string")
    got = {(r["claim_id"], r["rank"]): r["id"] for r in lexical.bm25_search(asked, "c", "t", docs, "id", "t").collect()}
    assert got == {(1, 1): 1, (1, 2): 2, (2, 1): 3}


def relaxed(kws, texts, enough=3):
    """The relaxation step by step."""
    level = {}
    for n in range(len(kws), 0, -1):
        hits = [i for i, t in texts.items() if all(k in t for k in kws[:n])]
        for i in hits:
            level.setdefault(i, n)
        if len(hits) >= enough:
            break
    return level


@pytest.mark.parametrize("words", [["alpha", "beta", "gamma"], ["alpha"], ["gamma", "alpha", "beta", "delta"], ["none", "alpha"]])
def test_all_keyword_search_equals_the_loop(spark, words):
    texts = {i: " ".join(w for k, w in enumerate(["alpha", "beta", "gamma", "delta"]) if i >> k & 1) or "x" for i in range(16)}
    chunks = spark.createDataFrame([(i, t) for i, t in texts.items()], "id long, text string")
    one = spark.createDataFrame([(1, words)], "claim_id long, words array<string>")
    got = {r["id"]: r["level"] for r in lexical.all_keyword_search(one, F.col("words"), chunks).collect()}
    assert got == relaxed(words, texts)


def test_fusion_weights(spark):
    hit = lambda rows: spark.createDataFrame(rows, "claim_id long, id long, score double, rank int")
    f = fusion.fuse(hit([(1, 7, 0.9, 1), (2, 7, 0.9, 1)]), hit([(1, 7, 2.0, 2), (2, 8, 1.0, 1)]), hit([(1, 9, 1.0, 1)]))
    got = {(r["claim_id"], r["id"]): r["rrf_score"] for r in f.collect()}
    assert got[1, 7] == pytest.approx(0.5 / 61 + 0.25 / 62) and got[1, 9] == pytest.approx(0.25 / 61)
    assert got[2, 7] == pytest.approx(0.7 / 61) and got[2, 8] == pytest.approx(0.3 / 61)


def test_payload_filter_keeps_rows_without_type(spark):
    c = spark.createDataFrame([(1, "a", None), (2, "a", "RT-310"), (3, "b", "RT-101")], "id long, ref_id string, rt_id string")
    assert [r["id"] for r in fusion.payload_filter(c, blocked=["RT-310"], excluded=["b"]).collect()] == [1]


def judged(spark):
    return as_judged(spark.createDataFrame(JUDGED, KINDS.replace("id int", "claim_id int", 1)))


def test_gate(spark):
    got = {r["claim_id"]: r for r in gate.gate(judged(spark)).collect()}
    verdicts = {i: got[i]["verdict"] for i, *_ in JUDGED}
    assert verdicts == {1: "PASS", 2: "SOFT_FLAG", 3: "BLOCK", 4: "SOFT_FLAG", 5: "PASS", 6: "BLOCK", 7: "PASS", 8: "PASS", 9: "PASS", 10: "PASS", 11: "PASS", 12: "BLOCK", 13: "PASS", 14: "SOFT_FLAG", 15: "BLOCK"}
    assert got[2]["flags"] == ["Coverage score 70% is below pass threshold (80.0%)"]
    assert got[12]["flags"][0] == "PICOT mismatch on: comparator, timeframe" and len(got[12]["blockers"]) == 2
    strict = gate.gate(judged(spark), passes=70, soft=40).where("claim_id = 2").first()
    assert strict["verdict"] == "PASS" and strict["flags"] == []


def test_policy_flags(spark):
    c = spark.createDataFrame([("CT-204",), ("CT-405",), ("CT-B01",), ("CT-D03",), ("CT-2019",), (None,)], "ct_id string")
    got = [(r["is_modifier"], r["mapping_pending"], r["audience"], r["claim_group"]) for r in policy.flags(c).collect()]
    assert got[0] == (True, False, "unrestricted", "A2") and got[1][2:] == ("payer_only", "A4") and got[2][2:] == ("hcp_only", "A10") and got[3][1:] == (True, "unrestricted", "A11") and got[4][3] == "A2"


def test_queue_states(spark):
    q = spark.createDataFrame([(s,) for s in ("queued", "rewriting", "retrieving", "judging", "done", "error")], "status string")
    assert [r[0] for r in claims.recovered(q).collect()] == ["queued"] * 4 + ["done", "error"]


def test_upsert_and_report(spark, tmp_path):
    a = spark.createDataFrame([(1, 1, 1, "PASS"), (2, 1, 2, "BLOCK")], "k int, ts int, i int, v string")
    b = spark.createDataFrame([(2, 2, 3, "PASS"), (3, 1, 4, "BLOCK")], "k int, ts int, i int, v string")
    assert {r["k"]: r["v"] for r in registry.upsert(a, b, "k", "ts", "i").collect()} == {1: "PASS", 2: "PASS", 3: "BLOCK"}
    runs = spark.createDataFrame([(1, "d1", "CT-1", 90.0, "PASS"), (2, "d1", "CT-2", 50.0, "BLOCK"), (3, "d" * 60, "CT-1", 70.0, "SOFT_FLAG")], "row int, document string, ct_id string, coverage double, verdict string")
    lines = registry.report_lines(runs)
    writers.write_report(lines, f"{tmp_path}/report")
    body = [r["line"] for r in lines.orderBy("line_no").collect()]
    assert body[4] == "| Total claims | **3** |" and body[5] == "| Fully covered (≥80%) | **1** (33%) |" and body[8] == "| Mean coverage score | **70.0%** |"
    assert "| d1 | 2 | 1 | 0 | 1 | 70% |" in body and any(x.startswith("| " + "d" * 50 + "...") for x in body)
    assert [r["value"] for r in spark.read.text(f"{tmp_path}/report").collect()] == body


def test_violations(spark):
    schema = "sent_id string, text string, section string, segment_type string, embeddable boolean, approx_tokens int"
    good = spark.createDataFrame([("a::1", "good text", "S", "text", True, 9)], schema)
    bad = spark.createDataFrame([("x", "\x01", "", "odd", True, 600), ("a::2", "<td>x</td>", "S", "table", True, 9), ("a::3", None, None, "reference", False, 0)], schema)
    assert quality.violations(good).count() == 0 and quality.release(good).first()["decision"] == "GO"
    got = {(r["sent_id"], r["rule"]) for r in quality.violations(bad).collect()}
    assert got == {("x", r) for r in ("empty_embeddable", "control_characters", "wrong_embeddable", "bad_sent_id", "no_section", "unknown_segment", "oversized")} | {("a::2", "raw_html_table"), ("a::3", "empty_text"), ("a::3", "no_section")}
    assert quality.release(bad).first()["decision"] == "HOLD"


MD = "# Title\nSee doi:10.1000/abc. In 2020.\n\n## Results\nRelapse in 26 (46%) patients was seen over the whole study.\n\nTable 1\n<table>\n<tr><td>12%</td></tr>\n</table>\n"


def test_ingest_once(spark, tmp_path):
    src = tmp_path / "md"
    src.mkdir()
    (src / "a b.md").write_text(MD)
    (src / "note.txt").write_text("no")
    docs = readers.read_markdown(spark, str(src))
    assert [r["ref_id"] for r in docs.collect()] == ["a b"]
    c = corpus.chunk_documents(docs).orderBy("chunk_index").collect()
    assert [r["segment_type"] for r in c] == ["text", "text", "table"] and c[0]["sent_id"] == "a b::chunk-0000"
    assert c[2]["text"] == "12%" and "<td>" in c[2]["source_table_html"] and c[0]["doc_metadata"]["doi"] == "10.1000/abc"
    assert [n["value"] for n in c[1]["numeric_tokens"]] == ["26", "46%", "1"]
    out, log = f"{tmp_path}/chunks", f"{tmp_path}/log"
    ingest(spark, str(src), out, log).awaitTermination()
    n = spark.read.parquet(out).count()
    (src / "c.md").write_text(MD)
    ingest(spark, str(src), out, log).awaitTermination()
    ingest(spark, str(src), out, log).awaitTermination()
    assert n == 3 and spark.read.parquet(out).count() == 6


def test_chunk_files_and_index(spark, tmp_path):
    rows = [{"sent_id": f"a::{i}", "ref_id": "a", "segment_type": "text", "vector": [1.0, 2.0] if i else [], "numeric_tokens": [{"value": "6", "context": "c"}]} for i in range(3)]
    (tmp_path / "a.chunks.json").write_text(json.dumps(rows))
    c = readers.read_chunks(spark, str(tmp_path))
    assert c.count() == 3 and c.first()["numeric_tokens"][0]["value"] == "6"
    assert writers.write_index(c, f"{tmp_path}/index", 2) == 2
    ids = {r["point_id"] for r in spark.read.parquet(f"{tmp_path}/index").collect()}
    assert len(ids) == 2 and all(len(i) == 36 for i in ids)


def test_append_once(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "row int, v string")
    for _ in range(2):
        writers.append_new(rows, f"{tmp_path}/log", "row")
    writers.append_new(rows.union(spark.createDataFrame([(3, "c")], "row int, v string")), f"{tmp_path}/log", "row")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 3


def test_workbook(spark, tmp_path):
    header = ",".join(f"c{i}" for i in range(13))
    (tmp_path / "w.csv").write_text(f'{header}\nDoc,1,Text,x," A claim, quoted ",5,Ref,x,x,x,Claim,x,CT-201\nDoc,,Figure,x,,,,,,,,,\n')
    got = readers.read_workbook(spark, str(tmp_path / "w.csv")).orderBy("row").collect()
    assert [(r["row"], r["claim"], r["source_type"], r["ct_id"]) for r in got] == [(2, "A claim, quoted", "text", "CT-201"), (3, "", "figure", "")]


def test_audit(spark, tmp_path):
    p = spark.createDataFrame([(1, 1, "src", "RT-209", "ev", "R", 3, ["A B"], "T", "J", 2020, None)], "claim_id int, rank int, ref_id string, rt_id string, text string, section string, page int, authors array<string>, title string, journal string, year int, doi string")
    a = gate.audit_records(gate.gate(judged(spark)), p)
    row = a.where("claim_id = 1").first()
    assert row["citations"][0]["full_citation"] == "A B. T. J 2020." and row["citations"][0]["data_on_file"] and row["fair_balance_linked"]
    assert not a.where("claim_id = 9").first()["fair_balance_linked"]
    writers.write_audit(a.drop("picot_alignment"), f"{tmp_path}/audit")
    assert spark.read.json(f"{tmp_path}/audit").count() == len(JUDGED)
