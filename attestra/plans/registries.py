"""Queries of the claim registry, claim lists and reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.functions import scores
from attestra.operators import claims, quality, registry
from attestra.plans import bindings as b
from attestra.plans.catalog import query
from attestra.session import shared_folder
from attestra.sources import writers

# Registry from events: a user is a claim, purchases are results, errors are overrides.
_VERDICT_SQL = "CASE WHEN value >= 80 THEN 'PASS' WHEN value >= 60 THEN 'SOFT_FLAG' ELSE 'BLOCK' END"
REGISTRY_SQL = f"""
 c AS (SELECT user_id AS claim_id, 'claim ' || user_id AS text, {b.list_item(b.CLAIM_TYPES, 'user_id')} AS ct_id, CASE WHEN user_id % 4 = 0 THEN '' ELSE 'Company' || (user_id % 4) END AS source, max(ts) AS updated_at FROM events GROUP BY user_id),
 res AS (SELECT user_id AS claim_id, event_id, value AS coverage_score, {_VERDICT_SQL} AS verdict FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE event_type = 'purchase' AND user_id % 5 <> 0) WHERE k = 1),
 ov AS (SELECT event_id AS override_id, user_id AS claim_id, ts, (['PASS', 'SOFT_FLAG', 'BLOCK'])[event_id % 3 + 1] AS new_verdict FROM events WHERE event_type = 'error' AND user_id % 3 = 0),
 lov AS (SELECT claim_id, new_verdict FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY ts DESC, override_id DESC) AS k FROM ov) WHERE k = 1),
 v AS (SELECT c.*, r.coverage_score, coalesce(r.verdict, 'PENDING') AS raw_verdict, coalesce(l.new_verdict, r.verdict, 'PENDING') AS effective_verdict,
   CASE WHEN coalesce(r.coverage_score, 0) > 1 THEN coalesce(r.coverage_score, 0) / 100 ELSE coalesce(r.coverage_score, 0) END AS score FROM c LEFT JOIN res r USING (claim_id) LEFT JOIN lov l USING (claim_id))"""


def registry_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("claim_id")).agg(F.max("ts").alias("updated_at"))
    source = F.when(F.col("claim_id") % 4 == 0, "").otherwise(F.concat(F.lit("Company"), F.col("claim_id") % 4))
    return e.select("claim_id", F.concat(F.lit("claim "), F.col("claim_id")).alias("text"), b.pick(b.CLAIM_TYPES, F.col("claim_id")).alias("ct_id"), source.alias("source"), "updated_at")


def all_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.table(spark, sf_dir, "events").where("event_type = 'purchase' and user_id % 5 <> 0")
    return e.select(F.col("user_id").alias("claim_id"), "event_id", "ts", F.col("value").alias("coverage_score"), scores.verdict(F.col("value")).alias("verdict"))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = all_results(spark, sf_dir)
    early, late = rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1")
    return registry.upsert(early, late, "claim_id", "ts", "event_id")


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.table(spark, sf_dir, "events").where("event_type = 'error' and user_id % 3 = 0")
    return e.select(F.col("event_id").alias("override_id"), F.col("user_id").alias("claim_id"), "ts", b.pick(["PASS", "SOFT_FLAG", "BLOCK"], F.col("event_id")).alias("new_verdict"))


def view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.registry_view(registry_claims(spark, sf_dir), results(spark, sf_dir), overrides(spark, sf_dir))


@query("s18_result_upsert", f"WITH {REGISTRY_SQL} SELECT claim_id, event_id, verdict, coverage_score FROM res")
def result_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last result of every claim, whichever batch it came in."""
    return results(spark, sf_dir).select("claim_id", "event_id", "verdict", "coverage_score")


@query("s18_result_table", f"WITH {REGISTRY_SQL} SELECT claim_id, event_id, verdict, coverage_score FROM res")
def result_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a table in folders by claim: results come in two batches, the second of them twice."""
    path, rows = f"{shared_folder(spark)}/results-{uuid.uuid4().hex}", all_results(spark, sf_dir).withColumn("at", F.struct("ts", "event_id"))
    for odd in (1, 0, 0):
        writers.upsert(rows.where(F.col("event_id") % 2 == odd), path, ["claim_id"], "at")
    return spark.read.parquet(path).select("claim_id", "event_id", "verdict", "coverage_score")


@query("s19_override_insert", f"WITH {REGISTRY_SQL} SELECT o.override_id, o.claim_id, o.new_verdict, coalesce(lag(o.new_verdict) OVER (PARTITION BY o.claim_id ORDER BY o.ts, o.override_id), r.verdict, 'PENDING') AS previous_verdict FROM ov o LEFT JOIN res r USING (claim_id)")
def override_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = registry.with_previous(overrides(spark, sf_dir), results(spark, sf_dir))
    return o.select("override_id", "claim_id", "new_verdict", "previous_verdict")


@query("w03_latest_override", f"WITH {REGISTRY_SQL} SELECT claim_id, new_verdict FROM lov")
def latest_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.latest(overrides(spark, sf_dir), "claim_id", "ts", "override_id").select("claim_id", "new_verdict")


@query("j12_registry_view", f"WITH {REGISTRY_SQL} SELECT claim_id, ct_id, source, raw_verdict, effective_verdict, round(score, 6) AS score FROM v")
def registry_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir).select("claim_id", "ct_id", "source", "raw_verdict", "effective_verdict", F.round("score", 6).alias("score"))


@query("s17_claim_page", f"WITH {REGISTRY_SQL} SELECT claim_id, effective_verdict FROM v WHERE contains(text, '1') ORDER BY updated_at DESC, claim_id LIMIT 50 OFFSET 50")
def claim_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second page of 50 of the claims whose text holds a 1."""
    return registry.page(view(spark, sf_dir), 2, 50, "1").select("claim_id", "effective_verdict")


@query("s17_deleted_log", f"WITH {REGISTRY_SQL} SELECT claim_id, ct_id, source, effective_verdict AS verdict, round(score, 6) AS score FROM v WHERE claim_id % 7 = 0")
def deleted_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = registry_claims(spark, sf_dir).where("claim_id % 7 = 0").select("claim_id")
    return registry.deleted(view(spark, sf_dir), ids)[1].withColumn("score", F.round("score", 6))


@query("s17_after_delete", f"WITH {REGISTRY_SQL} SELECT claim_id FROM v WHERE claim_id % 7 <> 0")
def after_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = registry_claims(spark, sf_dir).where("claim_id % 7 = 0").select("claim_id")
    return registry.deleted(view(spark, sf_dir), ids)[0].select("claim_id")


_FIGURES = "CAST(count(*) AS BIGINT) AS total, CAST(count(*) FILTER (WHERE {0} = 'PASS') AS BIGINT) AS pass, CAST(count(*) FILTER (WHERE {0} = 'SOFT_FLAG') AS BIGINT) AS soft_flag, CAST(count(*) FILTER (WHERE {0} = 'BLOCK') AS BIGINT) AS block, CAST(count(*) FILTER (WHERE {0} = 'PENDING') AS BIGINT) AS pending"


@query("a05_dashboard", f"WITH {REGISTRY_SQL} SELECT {_FIGURES.format('raw_verdict')}, round(avg(score) FILTER (WHERE raw_verdict <> 'PENDING'), 6) AS avg_score, (SELECT string_agg(source, ',' ORDER BY source) FROM (SELECT DISTINCT source FROM c WHERE source <> '')) AS companies FROM v")
def dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.dashboard(view(spark, sf_dir)).withColumn("avg_score", F.round("avg_score", 6))


@query("a06_filtered_figures", f"WITH {REGISTRY_SQL} SELECT {_FIGURES.format('effective_verdict')}, round(avg(score), 6) AS avg_score FROM v WHERE source = 'Company1' AND updated_at >= TIMESTAMP '2024-01-01' AND updated_at < TIMESTAMP '2024-02-01'")
def filtered_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One company, days up to and with 31 January."""
    return registry.key_figures(registry.filtered(view(spark, sf_dir), "Company1", None, "2024-01-01", "2024-01-31")).withColumn("avg_score", F.round("avg_score", 6))


@query("p08_verdict_filter", f"WITH {REGISTRY_SQL} SELECT claim_id FROM v WHERE effective_verdict = 'BLOCK'")
def verdict_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.filtered(view(spark, sf_dir), verdict="BLOCK").select("claim_id")


@query("a07_score_series", f"WITH {REGISTRY_SQL} SELECT round(avg(100 * score), 6) AS avg_coverage, CAST(count(*) FILTER (WHERE 100 * score >= 70) AS BIGINT) AS above FROM v")
def score_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = 100 * F.col("score")
    return view(spark, sf_dir).agg(F.round(F.avg(s), 6).alias("avg_coverage"), F.sum((s >= 70).cast("int")).alias("above"))


@query("l05_recent", f"WITH {REGISTRY_SQL} SELECT claim_id FROM v ORDER BY updated_at DESC, claim_id LIMIT 6")
def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.page(view(spark, sf_dir), 1, 6).select("claim_id")


# Claim runs from events: every event is a claim's result.
_RUNS_SQL = f"(SELECT event_id AS row, 'doc' || (user_id % 12) AS document, {b.list_item(b.CLAIM_TYPES, 'user_id')} AS ct_id, value AS coverage, {_VERDICT_SQL} AS verdict FROM events)"
_CUT = "CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE verdict = 'PASS') AS BIGINT) AS pass, CAST(count(*) FILTER (WHERE verdict = 'SOFT_FLAG') AS BIGINT) AS soft, CAST(count(*) FILTER (WHERE verdict = 'BLOCK') AS BIGINT) AS block, round(avg(coverage), 6) AS mean_coverage"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("row"), F.concat(F.lit("doc"), F.col("user_id") % 12).alias("document"), b.pick(b.CLAIM_TYPES, F.col("user_id")).alias("ct_id"), F.col("value").alias("coverage"), scores.verdict(F.col("value")).alias("verdict"))


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("mean_coverage", F.round("mean_coverage", 6))


@query("a03_verdict_counts", f"SELECT *, CAST(floor(pass * 100 / greatest(n, 1)) AS BIGINT) AS pass_pct, CAST(floor(soft * 100 / greatest(n, 1)) AS BIGINT) AS soft_pct, CAST(floor(block * 100 / greatest(n, 1)) AS BIGINT) AS block_pct FROM (SELECT {_CUT} FROM {_RUNS_SQL})")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(registry.portfolio(runs(spark, sf_dir)))


@query("a04_by_document", f"SELECT document, {_CUT} FROM {_RUNS_SQL} GROUP BY document")
def by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(registry.portfolio(runs(spark, sf_dir), "document"))


@query("a04_by_claim_type", f"SELECT ct_id, {_CUT} FROM {_RUNS_SQL} GROUP BY ct_id")
def by_claim_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(registry.portfolio(runs(spark, sf_dir), "ct_id"))


@query("s15_report_lines")
def report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole report in Markdown; its figures are those of A3 and A4."""
    return registry.report_lines(runs(spark, sf_dir))


@query("l06_first_blocked", f"SELECT row, ct_id, document FROM {_RUNS_SQL} WHERE verdict = 'BLOCK' ORDER BY row LIMIT 100")
def first_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs(spark, sf_dir).where("verdict = 'BLOCK'").orderBy("row").limit(100).select("row", "ct_id", "document")


@query("l07_sample")
def sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded sample of three sources by hash order."""
    return b.table(spark, sf_dir, "documents").select("source").distinct().orderBy(F.xxhash64("source", F.lit(7)), "source").limit(3)


@query("a24_seconds_per_claim", "SELECT user_id % 12 AS part, CAST(count(*) AS BIGINT) AS n, round(avg(value), 6) AS seconds FROM events GROUP BY ALL")
def seconds_per_claim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "events").groupBy((F.col("user_id") % 12).alias("part")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("seconds"))


# A workbook: documents as claims, some without labels, some that point to others.
_BOOK_SQL = f"""(SELECT CAST(doc_id AS INT) AS row, trim(text) AS claim, CASE WHEN doc_id % 11 = 0 THEN 'Non-claim' WHEN doc_id % 5 = 1 THEN 'Duplicate of row ' || (doc_id - 1) WHEN doc_id % 5 = 2 THEN 'Variation of row ' || (doc_id - 1) ELSE 'Claim' END AS category,
 CASE WHEN doc_id % 5 IN (1, 2) THEN '' WHEN doc_id % 5 = 3 THEN {b.list_item(b.CLAIM_TYPES, 'doc_id')} || '; CT-A08' WHEN doc_id % 5 = 4 THEN NULL ELSE {b.list_item(b.CLAIM_TYPES, 'doc_id')} END AS ct_id, CASE WHEN doc_id % 3 = 0 THEN 'text' ELSE 'figure' END AS source_type FROM documents)"""
_WORTH = "length(claim) >= 20 AND category <> 'Non-claim'"


def workbook(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = b.table(spark, sf_dir, "documents"), F.col("doc_id")
    label = b.pick(b.CLAIM_TYPES, i)
    category = F.when(i % 11 == 0, "Non-claim").when(i % 5 == 1, F.concat(F.lit("Duplicate of row "), i - 1)).when(i % 5 == 2, F.concat(F.lit("Variation of row "), i - 1)).otherwise("Claim")
    ct = F.when((i % 5).isin(1, 2), "").when(i % 5 == 3, F.concat(label, F.lit("; CT-A08"))).when(i % 5 == 4, F.lit(None).cast("string")).otherwise(label)
    return d.select(i.cast("int").alias("row"), claims.trimmed(F.col("text")).alias("claim"), category.alias("category"), ct.alias("ct_id"), F.when(i % 3 == 0, "text").otherwise("figure").alias("source_type"))


_GIVEN_SQL = f"(SELECT CAST(doc_id AS INT) AS row, CASE WHEN doc_id % 10 = 4 THEN 'FAILED' ELSE {b.list_item(b.CLAIM_TYPES, 'doc_id + 1')} END AS ct_id FROM documents WHERE doc_id % 5 IN (2, 4))"


def given(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    return b.table(spark, sf_dir, "documents").where(i % 5 == 2).union(b.table(spark, sf_dir, "documents").where(i % 5 == 4)).select(i.cast("int").alias("row"), F.when(i % 10 == 4, "FAILED").otherwise(b.pick(b.CLAIM_TYPES, i + 1)).alias("ct_id"))


@query("s03_workbook_rows", "SELECT item_id, trim(coalesce(text, '')) AS claim FROM benchmark")
def workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "benchmark").select("item_id", claims.trimmed(F.col("text")).alias("claim"))


_LABELLED = f"""SELECT w.row, trim(split_part(CASE WHEN length(w.ct_id) >= 3 THEN w.ct_id ELSE g.ct_id END, ';', 1)) AS ct_id, w.claim, w.source_type
 FROM {_BOOK_SQL} w LEFT JOIN (SELECT * FROM {_GIVEN_SQL} WHERE ct_id <> 'FAILED') g USING (row) WHERE {_WORTH} AND (length(w.ct_id) >= 3 OR g.ct_id IS NOT NULL)"""


@query("j05_labelled_claims", f"SELECT row, ct_id FROM ({_LABELLED})")
def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible claims with their first label, from the workbook or the classifier."""
    return claims.with_labels(claims.worth_checking(workbook(spark, sf_dir)), given(spark, sf_dir)).select("row", "ct_id")


_CHILD = f"SELECT row, CAST(regexp_extract(category, '(?:Duplicate|Variation) of row (\\d+)', 1) AS INT) AS parent FROM {_BOOK_SQL} WHERE {_WORTH} AND coalesce(length(ct_id), 0) < 3 AND regexp_matches(category, '(?:Duplicate|Variation) of row \\d+')"
_INHERITED = f"SELECT c.row, p.ct_id, c.parent FROM ({_CHILD}) c JOIN {_BOOK_SQL} p ON p.row = c.parent WHERE length(p.ct_id) >= 3"


@query("j06_inherited_labels", _INHERITED)
def inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return claims.inherited(workbook(spark, sf_dir))


@query("j07_classify_once", f"""
WITH t AS (SELECT row, claim FROM {_BOOK_SQL} WHERE {_WORTH} AND coalesce(length(ct_id), 0) < 3 AND row NOT IN (SELECT row FROM ({_INHERITED}))),
 u AS (SELECT claim, min(row) AS first_row, count(*) AS n FROM t GROUP BY claim)
SELECT t.row, u.first_row, CAST(u.n AS BIGINT) AS n FROM t JOIN u USING (claim)""")
def classify_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text to classify once, and its answer on all rows with it."""
    todo = claims.to_classify(workbook(spark, sf_dir)).select("row", "claim")
    return claims.spread_back(todo, claims.unique_texts(todo)).select("row", "first_row", "n")


@query("w04_c10_claim_batch", f"WITH o AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY row) AS k FROM ({_LABELLED})), m AS (SELECT row, ct_id, row_number() OVER (ORDER BY row) AS number FROM o WHERE k = 1) SELECT row, ct_id, CAST(number - 200 AS INT) AS number FROM m WHERE number BETWEEN 201 AND 300")
def claim_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct texts 201 to 300."""
    rows = claims.with_labels(claims.worth_checking(workbook(spark, sf_dir)), given(spark, sf_dir))
    return claims.batch(rows, 200, 100).select("row", "ct_id", "number")


@query("w05_best_per_type", f"SELECT ct_id, row FROM (SELECT *, row_number() OVER (PARTITION BY ct_id ORDER BY (source_type = 'text') DESC, length(claim) DESC, row) AS k FROM ({_LABELLED})) WHERE k = 1")
def best_per_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = claims.with_labels(claims.worth_checking(workbook(spark, sf_dir)), given(spark, sf_dir))
    return claims.best_per_type(rows).select("ct_id", "row")


@query("u05_s14_remaining", "SELECT event_id FROM events WHERE event_id NOT IN (SELECT event_id FROM events WHERE event_type = 'purchase')")
def remaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = b.table(spark, sf_dir, "events").select("event_id", "event_type")
    return claims.remaining(e, e.where("event_type = 'purchase'"), "event_id").select("event_id")


_LINE = "(SELECT doc_id, unnest(p) - 1 AS line_no, trim(unnest(l)) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l, range(1, len(string_split(text, chr(10))) + 1) AS p FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ct-301 | ' || text WHEN doc_id % 3 = 1 THEN 'see | ' || text ELSE text END AS text FROM documents)))"


@query("s21_claim_queue", f"""SELECT doc_id, CAST(line_no AS INT) AS line_no, CASE WHEN own THEN head ELSE 'CT-101' END AS ct_id, CASE WHEN own THEN trim(substr(line, strpos(line, '|') + 1)) ELSE line END AS text
FROM (SELECT *, contains(line, '|') AND regexp_full_match(head, 'CT-[A-Z0-9]+') AS own FROM (SELECT *, upper(trim(split_part(line, '|', 1))) AS head FROM {_LINE} WHERE line <> ''))""")
def claim_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = b.table(spark, sf_dir, "documents"), F.col("doc_id")
    body = F.when(i % 3 == 0, F.concat(F.lit("ct-301 | "), F.col("text"))).when(i % 3 == 1, F.concat(F.lit("see | "), F.col("text"))).otherwise(F.col("text"))
    return claims.queue_lines(d.select("doc_id", body.alias("body")), "body", "CT-101").select("doc_id", "line_no", "ct_id", "text")


@query("c11_recovered_queue", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'queued' WHEN event_type = 'error' THEN 'error' ELSE 'done' END AS status FROM events")
def recovered_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    status = F.when(t == "click", "retrieving").when(t == "view", "judging").when(t == "error", "error").otherwise("done")
    return claims.recovered(b.table(spark, sf_dir, "events").select("event_id", status.alias("status")))


@query("s20_all_passages", "SELECT doc_id, source AS ref_id, false AS custom FROM documents UNION ALL SELECT doc_id, 'label' || quality, true FROM labels")
def all_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieved passages, and those that were added by hand, which have fewer columns."""
    found = b.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("ref_id"), "lang", F.lit(False).alias("custom"))
    added = b.table(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("label"), F.col("quality")).alias("ref_id"), F.lit(True).alias("custom"))
    return found.unionByName(added, allowMissingColumns=True).select("doc_id", "ref_id", "custom")


ASSESSED = [(1, "supported by Passage 2, RT-101", "0.1,0.9,0.3"), (2, "passage 9 says", "0.1,0.9,0.9"), (3, "nothing", ""), (4, "", "0.2"), (5, "Passage 0", "0.5,0.1")]


@query("w10_key_passage", f"""SELECT id, CASE WHEN n BETWEEN 0 AND len(s) - 1 THEN n WHEN len(s) > 0 THEN list_position(s, list_max(s)) - 1 ELSE -1 END::INT AS key FROM (SELECT id, TRY_CAST(regexp_extract(a, '[Pp]assage\\s+(\\d+)', 1) AS INT) - 1 AS n, CASE WHEN p = '' THEN CAST([] AS DOUBLE[]) ELSE CAST(string_split(p, ',') AS DOUBLE[]) END AS s FROM (SELECT * REPLACE (CASE WHEN p = '' THEN '' ELSE p || ',0.' || n_chars % 10 END AS p) FROM {b.dealt_sql(ASSESSED, 'id a p')}))""")
def key_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.dealt(spark, sf_dir, ASSESSED, "id int, a string, p string")
    d = d.withColumn("p", F.when(F.col("p") == "", "").otherwise(F.concat(F.col("p"), F.lit(",0."), F.col("n_chars") % 10)))
    passages = F.transform(F.when(F.col("p") != "", F.split("p", ",")).otherwise(F.array().cast("array<string>")), lambda x: F.struct(x.cast("double").alias("score")))
    return d.select("id", registry.key_passage(F.col("a"), passages).cast("int").alias("key"))


_AGE = "epoch(TIMESTAMP '2024-02-15 00:00:00') - epoch(date_trunc('second', ts))"


@query("f_time_ago", f"SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN CAST(floor(s / 60) AS BIGINT) || 'm ago' WHEN s < 86400 THEN CAST(floor(s / 3600) AS BIGINT) || 'h ago' ELSE CAST(floor(s / 86400) AS BIGINT) || 'd ago' END AS age FROM (SELECT event_id, {_AGE} AS s FROM events)")
def time_ago(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "events").select("event_id", scores.time_ago(F.col("ts"), F.lit("2024-02-15 00:00:00").cast("timestamp")).alias("age"))


@query("c12_typing_changes", "SELECT doc_id AS ref_id, CASE WHEN doc_id % 9 <> 0 THEN 'RT-30' || (doc_id % 3) END AS old, CASE WHEN doc_id % 10 <> 0 THEN 'RT-30' || (doc_id % 4) END AS new FROM documents WHERE (CASE WHEN doc_id % 9 <> 0 THEN doc_id % 3 END) IS DISTINCT FROM (CASE WHEN doc_id % 10 <> 0 THEN doc_id % 4 END)")
def typing_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, i = b.table(spark, sf_dir, "documents"), F.col("doc_id")
    old = d.where(i % 9 != 0).select(i.alias("ref_id"), F.concat(F.lit("RT-30"), i % 3).alias("rt_id"))
    new = d.where(i % 10 != 0).select(i.alias("ref_id"), F.concat(F.lit("RT-30"), i % 4).alias("rt_id"))
    return quality.registry_changes(old, new, "ref_id", "rt_id")


@query("c13_corrections", "SELECT doc_id, CASE WHEN doc_id % 50 = 0 THEN 'RT-311' ELSE 'RT-301' END AS rt_id, CASE WHEN doc_id % 50 = 0 THEN 1.0::DOUBLE WHEN doc_id % 2 = 0 THEN NULL ELSE 0.8::DOUBLE END AS confidence FROM documents")
def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections by hand win; a confidence of 0.95 says nothing."""
    i = F.col("doc_id")
    d = b.table(spark, sf_dir, "documents").select("doc_id", F.lit("RT-301").alias("rt_id"), F.when(i % 2 == 0, 0.95).otherwise(0.8).alias("confidence"))
    fixes = d.where(i % 50 == 0).select(i.alias("_id"), F.lit("RT-311").alias("_rt"))
    j = d.join(fixes, i == F.col("_id"), "left")
    confidence = F.when(F.col("_rt").isNotNull(), 1.0).otherwise(F.nullif("confidence", F.lit(0.95)))
    return j.select("doc_id", F.coalesce("_rt", "rt_id").alias("rt_id"), confidence.alias("confidence"))


@query("w01_rank", "SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS INT) AS rank FROM documents")
def rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "doc_id")
    return b.table(spark, sf_dir, "documents").select("doc_id", "lang", F.row_number().over(order).alias("rank"))
