"""Queries of coverage, the gate and its rules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra import fixed
from attestra.functions import scores, text
from attestra.operators import gate
from attestra.plans import bindings as b
from attestra.plans.catalog import query

#: One row for each rule of the gate alone, and some together: id, score, type, failed parts, secondary, statistics, note, numbers.
JUDGED = [
    (1, 85.0, "CT-201", "", False, True, "", ""), (2, 70.0, "CT-201", "", False, True, "", ""), (3, 40.0, "CT-606", "", False, True, "", ""),
    (4, 90.0, "CT-606", "timeframe", False, True, "", ""), (5, 90.0, "CT-606", "population", False, True, "", ""), (6, 95.0, "CT-101", "", True, True, "", ""),
    (7, 92.0, "CT-202", "", False, False, "", ""), (8, 92.0, "CT-606", "", False, False, "", ""), (9, 88.0, "CT-501", "", False, True, "No safety data given", ""),
    (10, 88.0, "CT-606", "", False, True, "not found", ""), (11, 99.0, "CT-101", "", False, True, "", "rounded 32.6 to 33"), (12, 50.0, "CT-203", "comparator,timeframe", True, False, "Not Found", "a"),
    (13, 80.0, "CT-101", "", None, None, None, ""), (14, 60.0, "CT-101", "comparator", False, True, "", ""), (15, 59.5, "CT-101", "outcome", False, True, "", ""),
]
NAMES = ("claim_id", "coverage_score", "ct_id", "failed_parts", "secondary", "stats", "note", "numbers")


KINDS = "id int, coverage_score double, ct_id string, failed_parts string, secondary boolean, stats boolean, note string, numbers string"
#: Every document as a judged claim: the row of its number, its score less by a little.
JUDGED_SQL = f"(SELECT id AS claim_id, * EXCLUDE (id) REPLACE (coverage_score - n_chars % 7 AS coverage_score) FROM {b.dealt_sql(JUDGED, ' '.join(('id', *NAMES[1:])))})"


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.dealt(spark, sf_dir, JUDGED, KINDS)
    return as_judged(d.withColumnRenamed("id", "claim_id").withColumn("coverage_score", F.col("coverage_score") - F.col("n_chars") % 7))


def as_judged(rows: DataFrame) -> DataFrame:
    """Rows with a judge's answers as the gate reads them."""
    dims = F.array(*[F.lit(x) for x in ("comparator", "intervention", "outcome", "population", "timeframe")])
    parts = F.split("failed_parts", ",")
    return rows.select(
        "claim_id", "coverage_score", "ct_id", F.map_from_arrays(dims, F.transform(dims, lambda d: ~F.array_contains(parts, d))).alias("picot_alignment"),
        F.col("secondary").alias("secondary_citation_detected"), F.col("stats").alias("statistical_context_present"), F.col("note").alias("fair_balance_note"),
        F.when(F.col("numbers") != "", F.array("numbers")).otherwise(F.array().cast("array<string>")).alias("numerical_transformations"),
    )


_EFF = f"ct_id IN ({b.quoted(fixed.GATE_EFFICACY)})"
_GATE_SQL = f"""
WITH j AS (SELECT * FROM %s),
 f AS (SELECT claim_id, CAST(coverage_score AS DOUBLE) AS s, ct_id, failed_parts <> '' AS failed, contains(failed_parts, 'timeframe') OR contains(failed_parts, 'comparator') AS serious,
   coalesce(secondary, false) AS sec, {_EFF} AND NOT coalesce(stats, true) AS nostat, {_EFF} AND (contains(lower(coalesce(note, '')), 'no safety') OR contains(lower(coalesce(note, '')), 'not found')) AS fair,
   numbers <> '' AS nums FROM j)
SELECT claim_id, CASE WHEN s < 60 OR sec THEN 'BLOCK' WHEN serious THEN 'SOFT_FLAG' WHEN s >= 80 THEN 'PASS' ELSE 'SOFT_FLAG' END AS verdict,
 CAST((s >= 60 AND s < 80)::INT + failed::INT + serious::INT + nostat::INT + fair::INT + nums::INT AS INT) AS n_flags, CAST((s < 60)::INT + sec::INT AS INT) AS n_blockers, NOT fair AS fair_balance_linked
FROM f"""


@query("c05_logic_gate", _GATE_SQL % JUDGED_SQL)
def logic_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(judged(spark, sf_dir))


#: Every document as a judged claim: all answers by its number, in all combinations over 4,620 of them.
_TYPES = [*fixed.GATE_EFFICACY[:2], "CT-606", "CT-101"]
_ANSWERS = """doc_id AS claim_id, CAST(n_chars % 101 AS DOUBLE) AS coverage_score, {ct} AS ct_id, CASE doc_id % 5 WHEN 0 THEN 'timeframe' WHEN 1 THEN 'population' WHEN 2 THEN 'comparator,outcome' ELSE '' END AS failed_parts,
 CASE WHEN doc_id % 7 = 0 THEN true WHEN doc_id % 7 < 5 THEN false END AS secondary, CASE WHEN doc_id % 3 = 0 THEN false WHEN doc_id % 3 = 1 THEN true END AS stats,
 CASE doc_id % 11 WHEN 0 THEN 'No Safety data' WHEN 1 THEN 'it was not found' WHEN 2 THEN 'fine' ELSE '' END AS note, CASE WHEN lang = 'fr' THEN 'rounded' ELSE '' END AS numbers"""


@query("c05_gate_of_documents", _GATE_SQL % f"(SELECT {_ANSWERS.format(ct=b.list_item(_TYPES, 'doc_id'))} FROM documents)")
def gate_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gate over a whole table."""
    ct = f"element_at(array({b.quoted(_TYPES)}), CAST(doc_id % {len(_TYPES)} AS INT) + 1)"
    return _gated(as_judged(b.table(spark, sf_dir, "documents").selectExpr(*_split(_ANSWERS.format(ct=ct)))))


def _split(columns: str) -> list[str]:
    """A select list by its top-level commas."""
    out, depth, quoted = [""], 0, False
    for c in columns:
        quoted ^= c == "'"
        depth += 0 if quoted else (c in "([") - (c in ")]")
        if c == "," and not depth and not quoted:
            out.append("")
        else:
            out[-1] += c
    return out


def _gated(rows: DataFrame) -> DataFrame:
    g = gate.gate(rows)
    linked = ~F.exists("flags", lambda f: F.lower(f).contains("fair balance"))
    return g.select("claim_id", "verdict", F.size("flags").alias("n_flags"), F.size("blockers").alias("n_blockers"), linked.alias("fair_balance_linked"))


#: Labels as judged sub-assertions: three for each document of a claim.
ASSERT_SQL = "(SELECT doc_id // 10 AS claim_id, doc_id % 3 AS sub_assertion, doc_id % 7 AS ref_id, quality = 1 AND toxic = 0 AS is_covered FROM labels)"


def assertions(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = b.table(spark, sf_dir, "labels")  # noqa: E741
    return l.select(F.floor(F.col("doc_id") / 10).alias("claim_id"), (F.col("doc_id") % 3).alias("sub_assertion"), (F.col("doc_id") % 7).alias("ref_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("is_covered"))


COVERAGE_SQL = f"(SELECT claim_id, CAST(sum(c) AS BIGINT) AS covered, CAST(count(*) AS BIGINT) AS total, 100 * avg(c) AS coverage FROM (SELECT claim_id, sub_assertion, max(is_covered::INT) AS c FROM {ASSERT_SQL} GROUP BY ALL) GROUP BY claim_id)"


@query("a14_coverage", f"SELECT claim_id, covered, total, round(coverage, 6) AS coverage FROM {COVERAGE_SQL}")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = gate.coverage(assertions(spark, sf_dir))
    return c.withColumn("coverage", F.round("coverage", 6))


@query("g06_redundant_sources", f"""
WITH h AS (SELECT DISTINCT claim_id, sub_assertion, ref_id FROM {ASSERT_SQL} WHERE is_covered),
 a AS (SELECT claim_id, min(ref_id) AS ref_id FROM h GROUP BY claim_id, sub_assertion HAVING count(*) = 1)
SELECT DISTINCT claim_id, ref_id FROM {ASSERT_SQL} s WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.claim_id = s.claim_id AND a.ref_id = s.ref_id)""")
def redundant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.redundant_sources(assertions(spark, sf_dir))


@query("a15_portfolio_coverage", f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE coverage >= 80) AS BIGINT) AS full_cover, CAST(count(*) FILTER (WHERE coverage >= 60 AND coverage < 80) AS BIGINT) AS part_cover, CAST(count(*) FILTER (WHERE coverage < 60) AS BIGINT) AS low_cover, round(avg(coverage), 6) AS mean_coverage FROM {COVERAGE_SQL}")
def portfolio_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = scores.verdict(F.col("coverage"))
    n = lambda x: F.sum((v == x).cast("int"))
    return gate.coverage(assertions(spark, sf_dir)).agg(F.count("*").alias("n"), n("PASS").alias("full_cover"), n("SOFT_FLAG").alias("part_cover"), n("BLOCK").alias("low_cover"), F.round(F.avg("coverage"), 6).alias("mean_coverage"))


@query("c07_no_evidence", f"SELECT b.item_id AS claim_id, round(coalesce(c.coverage, 0), 6) AS coverage_score, CASE WHEN c.coverage >= 80 THEN 'PASS' WHEN c.coverage >= 60 THEN 'SOFT_FLAG' ELSE 'BLOCK' END AS verdict FROM benchmark b LEFT JOIN {COVERAGE_SQL} c ON c.claim_id = b.item_id * 2")
def no_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims without any judged evidence are blocked."""
    judged_ = gate.coverage(assertions(spark, sf_dir)).where("claim_id % 2 = 0")
    rows = judged_.select((F.col("claim_id") / 2).cast("long").alias("claim_id"), F.col("coverage").alias("coverage_score"), scores.verdict(F.col("coverage")).alias("verdict"))
    out = gate.with_missing_evidence(b.claims(spark, sf_dir).select("claim_id"), rows)
    return out.withColumn("coverage_score", F.round("coverage_score", 6))


@query("m19_unit_scores", """SELECT event_id, round(greatest(0.0, least(1.0, CASE WHEN value > 1 THEN value / 100 ELSE value END)), 6) AS score,
 CASE WHEN greatest(0.0, least(1.0, CASE WHEN value > 1 THEN value / 100 ELSE value END)) >= 0.7 THEN 'PASS' WHEN greatest(0.0, least(1.0, CASE WHEN value > 1 THEN value / 100 ELSE value END)) >= 0.4 THEN 'SOFT_FLAG' ELSE 'BLOCK' END AS verdict FROM events""")
def unit_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interface's scale: shares, thresholds 70 and 40 per cent."""
    s = scores.unit_score(F.col("value"), clamp=True)
    return b.table(spark, sf_dir, "events").select("event_id", F.round(s, 6).alias("score"), scores.verdict(s, 0.7, 0.4).alias("verdict"))


SCORES = ["85%", " 70 % ", "n/a", "", "0.5", "100", "1e2", "-3%"]


@query("f29_parsed_scores", f"SELECT id, s, coalesce(TRY_CAST(trim(replace(s, '%', '')) AS DOUBLE), 0.0) AS score FROM (SELECT id, CASE WHEN id % 3 = 0 THEN s ELSE replace(s, '5', CAST(n_chars % 10 AS VARCHAR)) END AS s FROM {b.dealt_sql([(s,) for s in SCORES], 's')})")
def parsed_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.dealt(spark, sf_dir, [(s,) for s in SCORES], "s string")
    d = d.withColumn("s", F.when(F.col("id") % 3 == 0, F.col("s")).otherwise(F.replace("s", F.lit("5"), (F.col("n_chars") % 10).cast("string"))))
    return d.select("id", "s", scores.parsed_score(F.col("s")).alias("score"))


REPLIES = ['```json\n{"a": 1}\n```', 'Sure: {"a": 2, "b": {"c": 3}} done', "none", '{"a": 4}', '```\n{"a": 5}\n```']


@query("f28_json_in_replies", f"""SELECT id, r, CAST(json_extract_string(j, '$.a') AS INT) AS a FROM (SELECT id, r, CASE WHEN starts_with(x, '{{') THEN x ELSE nullif(regexp_extract(x, '\\{{[^{{}}]*(?:\\{{[^{{}}]*\\}}[^{{}}]*)*\\}}'), '') END AS j
 FROM (SELECT id, r, trim(regexp_replace(r, '(?s)^\\s*```(?:json)?\\s*|\\s*```\\s*$', '', 'g')) AS x FROM (SELECT id, replace(r, '"a": ', '"a": ' || n_chars) AS r FROM {b.dealt_sql([(r,) for r in REPLIES], 'r')})))""")
def json_in_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.dealt(spark, sf_dir, [(r,) for r in REPLIES], "r string").withColumn("r", F.replace("r", F.lit('"a": '), F.concat(F.lit('"a": '), F.col("n_chars"))))
    return d.select("id", "r", F.get_json_object(text.json_object(F.col("r")), "$.a").cast("int").alias("a"))


@query("g01_conditional_cap", f"""WITH s AS (SELECT claim_id, coverage, claim_id % 3 = 0 AS only_c FROM {COVERAGE_SQL}) SELECT claim_id, round(CASE WHEN only_c THEN least(coverage, 60) ELSE coverage END, 6) AS score FROM s""")
def conditional_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiers = F.when(F.col("claim_id") % 3 == 0, F.array(F.lit("C"), F.lit("C"))).otherwise(F.array(F.lit("P"), F.lit("C")))
    c = gate.coverage(assertions(spark, sf_dir))
    return c.select("claim_id", F.round(gate.conditional_only_cap(F.col("coverage"), tiers), 6).alias("score"))


@query("g04_rounding_bands", "SELECT event_id, CASE WHEN d = 0 THEN 'ok' WHEN d <= 2 THEN 'flag' WHEN d <= 5 THEN 'review' ELSE 'block' END AS band FROM (SELECT event_id, abs(value - floor(value / 10) * 10) AS d FROM events)")
def rounding_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.abs(F.col("value") - F.floor(F.col("value") / 10) * 10)
    return b.table(spark, sf_dir, "events").select("event_id", gate.rounding_band(d).alias("band"))


CITED = [
    (1, "Smith A", "A trial", "Lancet", 2021, "10.1/x", "s1"), (2, "A B;C D;E F;G H", "", "", 2020, "", "s2"), (3, "", "", "", None, "", "s3"), (4, "", "Only title", "Journal", None, None, "s4"),
]


@query("f25_citations", f"""
SELECT id, CASE WHEN p = '' THEN ref ELSE p || '.' END AS citation FROM (SELECT id, ref, concat_ws('. ', CASE WHEN au = '' THEN NULL ELSE array_to_string((string_split(au, ';'))[1:3], ', ') || CASE WHEN len(string_split(au, ';')) > 3 THEN ' et al.' ELSE '' END END,
  nullif(ti, ''), CASE WHEN nullif(jo, '') IS NOT NULL AND ye IS NOT NULL THEN jo || ' ' || ye ELSE CAST(ye AS VARCHAR) END, 'doi:' || nullif(doi, '')) AS p FROM (SELECT * REPLACE (CASE WHEN ti = '' THEN '' ELSE ti || ' ' || n_chars END AS ti), source AS ref FROM {b.dealt_sql(CITED, 'id au ti jo ye doi s')}))""")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.dealt(spark, sf_dir, CITED, "id int, au string, ti string, jo string, ye int, doi string, s string").withColumn("ref", F.col("source"))
    d = d.withColumn("ti", F.when(F.col("ti") == "", "").otherwise(F.concat_ws(" ", "ti", "n_chars")))
    authors = F.when(F.col("au") != "", F.split("au", ";")).otherwise(F.array().cast("array<string>"))
    return d.select("id", text.citation(authors, F.col("ti"), F.col("jo"), F.col("ye"), F.col("doi"), F.col("ref")).alias("citation"))


@query("c08_audit_records")
def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C8 over every document as a judged claim, with two passages of its text."""
    two = F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(t).alias("rt_id")) for r, t in ((1, "RT-209"), (2, "RT-402"))])).alias("two")
    said = {"section": "Results", "title": "T", "journal": "J"}
    p = b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("claim_id"), two, F.col("source").alias("ref_id"), "text", *[F.lit(v).alias(k) for k, v in said.items()])
    p = p.select("*", "two.*", F.lit(3).alias("page"), F.array(F.lit("A B")).alias("authors"), F.lit(2020).alias("year"), F.lit(None).cast("string").alias("doi"))
    a = gate.audit_records(gate.gate(judged(spark, sf_dir)), p)
    return a.select("claim_id", "ct_id", "verdict", "evidence_types", F.size("citations").alias("n_citations"), F.col("citations")[0]["full_citation"].alias("first_citation"), F.col("citations")[0]["data_on_file"].alias("data_on_file"), "fair_balance_linked")
