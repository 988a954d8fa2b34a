"""Queries without SQL against versions of their own, over all rows of the smallest tables."""

import hashlib
import math
import re
import unicodedata
import uuid
from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from attestra import fixed
from attestra.functions import numbers
from attestra.operators import corpus, dense, fusion, gate, lexical, quality
from attestra.operators.ranking import Best
from attestra.plans import catalog
from attestra.plans.verdicts import judged
from attestra.sources import readers, writers
from attestra.streaming.ingest import ingest

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables here")


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def result(spark, name, key):
    return {r[key]: r.asDict() for r in catalog.queries()[name](spark, SF).collect()}


@needs_tables
def test_s09_point_ids(spark):
    got = result(spark, "s09_point_ids", "doc_id")
    assert {i: r["point_id"] for i, r in got.items()} == {r["doc_id"]: str(uuid.uuid5(uuid.NAMESPACE_DNS, f"{r['source']}::chunk-{r['doc_id']:04d}")) for r in rows("documents")}


@needs_tables
def test_w08_packed_lines(spark):
    want = {}
    for r in rows("documents"):
        groups, size = [], 0
        for line in r["text"].split("\n"):
            if groups and size and size + len(line) > 1600:
                groups.append([])
                size = 0
            if not groups:
                groups.append([])
            groups[-1].append(line)
            size += len(line)
        want[r["doc_id"]] = len(groups)
    assert {i: r["groups"] for i, r in result(spark, "w08_packed_lines", "doc_id").items()} == want


@needs_tables
def test_l07_sample(spark):
    there = {r["source"] for r in rows("documents")}
    one, two = ([r["source"] for r in catalog.queries()["l07_sample"](spark, SF).collect()] for _ in range(2))
    assert one == two and len(set(one)) == 3 and set(one) <= there


@needs_tables
def test_f30_passages(spark):
    def clean(t):
        t = re.sub(fixed.FORMAT_TAG, "", t)
        for p in fixed.EMPHASIS_PAIRS:
            t = re.sub(p, r"\1", t)
        return re.sub(r"  +", " ", re.sub(fixed.HEADING_MARK, "", t)).strip(" \t\n\x0b\f\r")

    types = ["RT-101", "RT-102", "RT-201", "RT-212", "RT-301", "RT-304", "RT-310", "RT-402"]
    by: dict = {}
    for r in sorted(rows("documents"), key=lambda r: r["doc_id"]):
        by.setdefault(r["source"], []).append(r)
    want = {}
    for source, docs in by.items():
        parts = []
        for n, r in enumerate(docs[:5], 1):
            rt = types[int(re.search(r"\d+", source).group()) % len(types)]
            parts.append(f"### Passage {n}\n- **ref_id:** {source}\n- **RT-ID:** {rt}\n\n**Evidence Text:**\n{clean(r['text'])}")
        want[source] = hashlib.md5("\n\n---\n\n".join(parts).encode()).hexdigest()
    assert {i: r["digest"] for i, r in result(spark, "f30_passages", "ref_id").items()} == want


@needs_tables
def test_s15_report_lines(spark):
    from attestra.plans.registries import runs

    lines = [r["line"] for r in catalog.queries()["s15_report_lines"](spark, SF).orderBy("line_no").collect()]
    done = [r.asDict() for r in runs(spark, SF).collect()]
    assert f"| Total claims | **{len(done)}** |" in lines
    mean = sum(r["coverage"] for r in done) / len(done)
    (told,) = [x for x in lines if x.startswith("| Mean coverage score")]
    assert abs(float(re.search(r"([\d.]+)%", told).group(1)) - mean) <= 0.0500001
    for name in {r["document"][:50] for r in done if len(r["document"]) <= 50}:
        of = [r for r in done if r["document"] == name]
        counts = [sum(r["verdict"] == v for r in of) for v in ("PASS", "SOFT_FLAG", "BLOCK")]
        assert any(x.startswith(f"| {name} | {len(of)} | {counts[0]} | {counts[1]} | {counts[2]} |") for x in lines)


@needs_tables
def test_c08_audit_records(spark):
    got = result(spark, "c08_audit_records", "claim_id")
    gated = {r["claim_id"]: r for r in gate.gate(judged(spark, SF)).collect()}
    assert set(got) == {r["doc_id"] for r in rows("documents")} and {r["verdict"] for r in got.values()} == {"PASS", "SOFT_FLAG", "BLOCK"}
    for i, r in got.items():
        assert r["verdict"] == gated[i]["verdict"] and r["n_citations"] == 2
        assert r["first_citation"] == "A B. T. J 2020." and r["data_on_file"] is True
        assert r["evidence_types"] == "RT-209,RT-402"


UNITS = r"(?:p\s*[<>=≤≥]\s*0?\.\d+|\d+\.?\d*\s*%|(?:OR|HR|RR)\s*[=:]\s*\d+\.?\d*|n\s*=\s*\d+|\d+\.?\d*)"


@needs_tables
def test_m02_numeric_tokens_stand_where_they_say(spark):
    for r in rows("documents"):
        found, at = numbers.tokens_of(r["text"]), 0
        for t in found:
            assert t["start"] >= at and r["text"][t["start"] : t["end"]].strip() == t["raw"] and re.search(r"\d", t["raw"])
            assert t["context"] == r["text"][max(0, t["start"] - 40) : t["end"] + 40].strip()
            assert not re.fullmatch(r"(19|20)\d\d", t["raw"]) or re.search("|".join(fixed.YEAR_CONTEXT), r["text"][max(0, t["start"] - 10) : t["start"]].lower())
            at = t["end"]
        # what is not found is a year or cites: it stands bare
        covered = {k for t in found for k in range(t["start"], t["end"])}
        for m in re.finditer(r"\d+%", r["text"]):
            assert m.start() in covered


#: before, number, after, and whether it cites: each heuristic at its bounds.
CITES = [
    ("therapy.", "12", " was", True), ("0.", "12", " was", False), ("cell", "12", " was", True), ("a, 3,", "4", " was", False), ("a.3,", "4", " was", True), ("of 3 ", "4", " was", False),
    ("it.1,", "999", ". We", True), ("dose,", "12", ", mg of", False), ("Smith, MD,", "99", " and", True), ("Smith, MD,", "100", " and", False), ("Intro . . . . . ", "199", " x", True),
    ("Intro . . . . . ", "200", " x", False), ("Box (", "19", ") x", True), ("Box (", "20", ") x", False), ("n (", "4", ") x", False), ("x ", "12345", " y", False),
]


@pytest.mark.parametrize("before,number,after,cites", CITES)
def test_m03_citation_marks(before, number, after, cites):
    text = before + number + after
    assert numbers.is_citation(text, number, len(before), len(before) + len(number)) is cites


@needs_tables
def test_f20_chunks_keep_all_words_in_order(spark):
    got: dict = {}
    d = spark.read.parquet(f"{SF}/documents.parquet").where("not text rlike '[|<#]'")
    md = d.select(F.col("doc_id").cast("string").alias("ref_id"), F.concat(F.lit("# Results\n## Part\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("markdown"))
    for r in corpus.chunk_documents(md).collect():
        got.setdefault(r["ref_id"], []).append(r)
    assert got
    texts = {str(r["doc_id"]): r["text"] for r in rows("documents")}
    for i, chunks in got.items():
        chunks.sort(key=lambda r: r["chunk_index"])
        assert [r["chunk_index"] for r in chunks] == list(range(len(chunks)))
        assert [r["sent_id"] for r in chunks] == [f"{i}::chunk-{n:04d}" for n in range(len(chunks))]
        want = unicodedata.normalize("NFKC", texts[i]).translate(str.maketrans("—–·", "--.")).split()
        words: list[str] = []
        for r in chunks:  # parts of a long paragraph begin with the last sentence of the part before
            body = re.sub(r"^\[[^\]]*\]\n?", "", r["text"]).split()
            again = next((n for n in range(len(body) - 1, 0, -1) if words[-n:] == body[:n] and words + body != want[: len(words) + len(body)]), 0)
            words += body[again:]
        assert words == want
        for r in chunks:  # a sentence is never cut
            assert r["approx_tokens"] <= fixed.MAX_TOKENS + fixed.PREFIX or not re.search(r"[.?!]\s+[A-ZÀ-Þ]", r["text"])


def test_m16_product_boost_fires(spark):
    """An own product's source gains the boost, another's does not, and trial-led claims have none."""
    claims = spark.createDataFrame([(1, "Zeluxa relieves pain", "CT-101"), (2, "Zeluxa relieves pain", fixed.TRIAL_PRIMARY[0])], "claim_id long, text string, ct_id string")
    chunks = spark.createDataFrame([(1, "zeluxa-label", "RT-301", "zeluxa text"), (2, "other-label", "RT-301", "text")], "id long, ref_id string, rt_id string, text string")
    policy = spark.createDataFrame([("CT-101", "RT-301", "P")], "ct_id string, rt_id string, tier string")
    hit = lambda rows: spark.createDataFrame(rows, "claim_id long, id long, score double, rank int")
    lists = hit([(c, i, 0.9 - i / 10, i) for c in (1, 2) for i in (1, 2)]), hit([]), hit([])
    got = {(r["claim_id"], r["id"]): r for r in fusion.hybrid_search(claims, chunks, policy, *lists).collect()}
    assert got[1, 1]["product_boost"] and not got[1, 2]["product_boost"] and not got[2, 1]["product_boost"]
    base = 0.7 / (60 + 1)
    assert got[1, 1]["final_score"] == pytest.approx(base * 3.0 * fixed.PRODUCT_BOOST)
    assert got[1, 2]["final_score"] == pytest.approx(0.7 / 62 * 3.0)


@pytest.mark.parametrize("name", ["a b.md", "a+b.md", "ä%20c.md", "d.e f+.md"])
def test_stream_and_batch_have_the_same_ids(spark, tmp_path, name):
    src = tmp_path / "md"
    src.mkdir()
    (src / name).write_text("# T\n\nWords of a text that is long enough to stay.\n")
    batch = [r["ref_id"] for r in readers.read_markdown(spark, str(src)).collect()]
    ingest(spark, str(src), f"{tmp_path}/out", f"{tmp_path}/log").awaitTermination()
    stream = {r["sent_id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert batch == [name.removesuffix(".md")] and stream == {f"{batch[0]}::chunk-0000"}


def test_pages_by_an_extractor(spark, tmp_path):
    (tmp_path / "a b.pdf").write_bytes(b"one\x0c \x0cthree")
    (tmp_path / "bad.pdf").write_bytes(b"\xff")
    got = readers.read_pages(spark, str(tmp_path), lambda raw: raw.decode().split("\x0c")).collect()
    assert {tuple(r) for r in got} == {("a b", 1, "one"), ("a b", 3, "three"), ("bad", None, None)}


def test_sparse_collection_goes_on_where_it_stopped(spark, tmp_path):
    chunks = spark.createDataFrame([("a::1", "dose of a drug"), ("a::2", "drug drug trial"), ("a::3", "the of")], "sent_id string, text string")
    path, some = f"{tmp_path}/sparse", f"{tmp_path}/some"
    assert writers.write_sparse(chunks, path) == 3
    whole = {r["sent_id"]: r for r in writers.sparse_points(spark, path).collect()}
    assert writers.write_sparse(chunks.where("sent_id = 'a::1'"), some) == 1
    alone = writers.sparse_points(spark, some).first()
    assert writers.write_sparse(chunks, some) == 3 and writers.write_sparse(chunks, some) == 3
    # weights are of the corpus as it is: two batches equal one
    assert {r["sent_id"]: r for r in writers.sparse_points(spark, some).collect()} == whole and whole["a::1"] != alone and set(whole) == {"a::1", "a::2"}
    index = int(hashlib.md5(b"drug").hexdigest()[:8], 16)
    two = dict(zip(whole["a::2"]["indices"], whole["a::2"]["values"], strict=True))
    assert two[index] == pytest.approx(2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / (5 / 3))))
    assert whole["a::2"]["point_id"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, "a::2"))


def test_index_is_laid_by_its_payload(spark, tmp_path):
    made = [(f"r{i % 7}::{i}", f"r{i % 7}", f"RT-{i % 3}", "B1", "text" if i % 2 else "table", [1.0, float(i)]) for i in range(40)]
    chunks = spark.createDataFrame(made, "sent_id string, ref_id string, rt_id string, ref_category string, segment_type string, vector array<float>")
    assert writers.write_index(chunks, f"{tmp_path}/index", 2) == 40
    back = spark.read.parquet(f"{tmp_path}/index").where("rt_id = 'RT-1' and segment_type = 'text'")
    assert {r["sent_id"] for r in back.collect()} == {m[0] for m in made if m[2] == "RT-1" and m[4] == "text"}
    for file in (tmp_path / "index").rglob("*.parquet"):
        t = pq.read_table(file, partitioning=None)
        laid = list(zip(*(t[c].to_pylist() for c in ("rt_id", "ref_category", "ref_id", "sent_id")), strict=True))
        assert laid == sorted(laid)


def test_one_audit_file_a_record(spark, tmp_path):
    made = spark.createDataFrame([("CT-1", "a", "2024-01-02 03:04:05"), ("CT-1", "b", "2024-01-02 03:04:05"), ("CT-2", "c", "2024-01-02 03:04:06")], "ct_id string, claim string, at string")
    writers.write_audit(made.withColumn("audited_at", F.col("at").cast("timestamp")), f"{tmp_path}/audit")
    folders = {p.name.removeprefix("audit="): list(p.glob("*.json")) for p in (tmp_path / "audit").glob("audit=*")}
    assert set(folders) == {"audit_CT-1_20240102_030405", "audit_CT-1_20240102_030405_2", "audit_CT-2_20240102_030406"}
    assert all(len(f) == 1 and len(f[0].read_text().splitlines()) == 1 for f in folders.values())


def test_running_best_lists():
    rng = np.random.default_rng(1)
    scores = np.round(rng.random((5, 400)), 2)  # many ties
    scores[0, ::3] = np.nan
    ids = rng.permutation(400)
    best = Best(5, 12)
    for a in range(0, 400, 37):
        best.add(scores[:, a : a + 37], ids[a : a + 37])
    (batch,) = best.rows(np.arange(5) * 10)
    got = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
    want = [(c * 10, int(ids[j]), float(scores[c, j])) for c in range(5) for j in sorted((j for j in range(400) if not math.isnan(scores[c, j])), key=lambda j: (-scores[c, j], ids[j]))[:12]]
    assert got == want


def test_bm25_against_a_loop(spark):
    import random

    rng = random.Random(2)
    vocabulary = [f"w{i}x" for i in range(60)]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 40))) if i % 9 else None) for i in range(150)]
    claims = [(i, " ".join(rng.choice(vocabulary) for _ in range(6))) for i in range(12)] + [(12, "nowhere"), (13, None)]
    n, lengths = len(docs), {i: len((t or "").split()) for i, t in docs}
    average = sum(lengths.values()) / n
    df = {w: sum(w in (t or "").split() for _, t in docs) for w in vocabulary}
    want = {}
    for c, text in claims:
        scored = {}
        for i, t in docs:
            words = (t or "").split()
            for w in set((text or "").split()) & set(words):
                f = words.count(w)
                scored[i] = scored.get(i, 0) + f * 2.5 / (f + 1.5 * (0.25 + 0.75 * lengths[i] / average)) * math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1)
        for rank, i in enumerate(sorted(scored, key=lambda i: (-round(scored[i], 9), i))[:7], 1):
            want[c, rank] = (i, round(scored[i], 7))
    frame = lambda r: spark.createDataFrame(r, "i long, t string").repartition(3)
    got = lexical.bm25_search(frame(claims), "i", "t", frame(docs), "i", "t", 7)
    assert {(r["claim_id"], r["rank"]): (r["id"], round(r["score"], 7)) for r in got.collect()} == want


def test_dense_search_leaves_no_tie_out(spark):
    chunks = spark.createDataFrame([(i, [1.0, float(i % 3)]) for i in range(60)], "id long, vector array<double>").repartition(4)
    claims = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0])], "claim_id long, vector array<double>")
    got = [(r["claim_id"], r["rank"], r["id"]) for r in dense.dense_search(claims, chunks, 25).orderBy("claim_id", "rank").collect()]
    order = sorted(range(60), key=lambda i: (i % 3, i))[:25]
    assert got == [(1, n, i) for n, i in enumerate(order, 1)]


def test_verbatim_and_links(spark):
    c = spark.createDataFrame([(1, "River stone"), (2, ""), (3, None), (4, "River stone")], "claim_id long, text string")
    d = spark.createDataFrame([(7, "a River stone."), (8, "river stone"), (9, None)], "id long, text string")
    assert {tuple(r) for r in lexical.verbatim(c, d).collect()} == {(1, 7), (4, 7)}
    t = spark.createDataFrame([(1, "dose 12 mg of x"), (2, "the dose x 12"), (3, "dose 13 x")], "id long, text string")
    assert {tuple(r) for r in quality.number_and_word_links(t, t, ["of", "the"], F.col("a") < F.col("b")).collect()} == {(1, 2, 3)}


def test_audit_goes_on_numbering(spark, tmp_path):
    one = spark.createDataFrame([("CT-1", "a", "2024-01-02 03:04:05")], "ct_id string, claim string, at string").withColumn("audited_at", F.col("at").cast("timestamp"))
    two = spark.createDataFrame([("CT-1", "b", "2024-01-02 03:04:05"), ("CT-1", "a", "2024-01-02 03:04:05")], "ct_id string, claim string, at string").withColumn("audited_at", F.col("at").cast("timestamp"))
    for rows in (one, two, one, two):
        writers.write_audit(rows, f"{tmp_path}/audit")
    folders = {p.name.removeprefix("audit="): [x.read_text().splitlines() for x in p.glob("*.json")] for p in (tmp_path / "audit").glob("audit=*")}
    assert set(folders) == {"audit_CT-1_20240102_030405", "audit_CT-1_20240102_030405_2"} and all(len(f) == 1 and len(f[0]) == 1 for f in folders.values())


UPSERT = "claim string, verdict string, at int"


def test_upsert_keeps_the_last_of_each_key(spark, tmp_path):
    path = f"{tmp_path}/results"
    frame = lambda *rows: spark.createDataFrame(rows, UPSERT)
    table = lambda: sorted(((r.claim, r.verdict, r.at) for r in spark.read.parquet(path).collect()), key=repr)
    files = lambda: {str(p) for p in (tmp_path / "results").rglob("*.parquet")}
    first = frame(("a", "PASS", 1), ("b", "BLOCK", 1), ("a", "BLOCK", 2), (None, "PASS", 1), ("c", "PASS", None))
    writers.upsert(first, path, ["claim"], "at", 8)
    held, before = [("a", "BLOCK", 2), ("b", "BLOCK", 1), ("c", "PASS", None), (None, "PASS", 1)], files()
    assert table() == held
    more = frame(("b", "PASS", 1), ("a", "PASS", 1), ("d", "PASS", 3))  # as new as what is there; older; another key
    for _ in range(2):
        touched = writers.upsert(more, path, ["claim"], "at", 8)
        assert table() == sorted([("a", "BLOCK", 2), ("b", "PASS", 1), ("c", "PASS", None), ("d", "PASS", 3), (None, "PASS", 1)], key=repr)
    untouched = {f for f in before if int(f.split("bucket=")[1].split("/")[0]) not in touched}
    assert untouched and untouched <= files()
    assert writers.upsert(frame(), path, ["claim"], "at", 8) == []


def test_upsert_after_a_break(spark, tmp_path, monkeypatch):
    """A run that fails before it writes, or is run again, leaves the table as it would be."""
    path = f"{tmp_path}/results"
    rows = spark.createDataFrame([(str(i), "PASS", 1) for i in range(20)], UPSERT)
    writers.upsert(rows, path, ["claim"], "at", 8)
    later = spark.createDataFrame([(str(i), "BLOCK", 2) for i in range(10, 30)], UPSERT)
    with monkeypatch.context() as m:
        m.setattr(writers, "kept", lambda df: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            writers.upsert(later, path, ["claim"], "at", 8)
    assert spark.read.parquet(path).where("verdict = 'PASS'").count() == 20
    writers.upsert(later, path, ["claim"], "at", 8)
    assert sorted((r[0], r[1]) for r in spark.read.parquet(path).groupBy("verdict").count().collect()) == [("BLOCK", 20), ("PASS", 10)]
