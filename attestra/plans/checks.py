"""Queries of corpus quality and of rules that are stated in text only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra import fixed
from attestra.functions import numbers, text
from attestra.operators import corpus, lexical, quality
from attestra.plans import bindings as b
from attestra.plans.catalog import query
from attestra.plans.texts import _PARA, paragraphs

_KIND = "CASE WHEN no % 5 = 4 THEN 'table' ELSE 'text' END"


@query("a10_segments", f"SELECT {_KIND} AS segment_type, CAST(count(*) AS BIGINT) AS n FROM {_PARA} GROUP BY ALL")
def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraphs(spark, sf_dir).groupBy("segment_type").agg(F.count("*").alias("n"))


@query("a11_size_buckets", "SELECT CASE WHEN t < 100 THEN '<100' WHEN t < 300 THEN '100-300' WHEN t < 500 THEN '300-500' ELSE '500+' END AS bucket, CAST(count(*) AS BIGINT) AS n FROM (SELECT length(text) // 4 AS t FROM documents) GROUP BY ALL")
def size_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").groupBy(quality.size_bucket(numbers.approx_tokens(F.col("text"))).alias("bucket")).agg(F.count("*").alias("n"))


@query("a09_corpus_stats", f"SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE {_KIND} = 'table') AS BIGINT) AS tables, CAST(count(*) FILTER (WHERE trim(line) = '') AS BIGINT) AS empty, CAST(sum(len(regexp_extract_all(line, '\\d+\\.?\\d*'))) AS BIGINT) AS numerics FROM {_PARA}")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paragraphs(spark, sf_dir)
    return p.agg(F.count("*").alias("n"), F.sum((F.col("segment_type") == "table").cast("int")).alias("tables"), F.sum((F.trim("text") == "").cast("int")).alias("empty"), F.sum(F.regexp_count("text", F.lit(fixed.NUMBER))).alias("numerics"))


@query("a21_key_sets", "SELECT k AS key_set, CAST(count(*) AS BIGINT) AS n FROM (SELECT array_to_string(list_sort(json_keys(props)), ',') AS k FROM events) GROUP BY k")
def key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "events").groupBy(quality.key_sets(F.col("props")).alias("key_set")).agg(F.count("*").alias("n"))


@query("a22_number_overlap", "WITH n AS (SELECT DISTINCT doc_id % 2 AS side, unnest(regexp_extract_all(text, '\\d+\\.?\\d*')) AS v FROM documents) SELECT CAST(count(*) FILTER (WHERE s = 1) AS BIGINT) AS both_sides, CAST(count(*) FILTER (WHERE s = 0) AS BIGINT) AS one_side FROM (SELECT v, max(side) - min(side) AS s FROM n GROUP BY v)")
def number_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = b.table(spark, sf_dir, "documents").select((F.col("doc_id") % 2).alias("side"), F.explode(quality.numbers_in(F.col("text"))).alias("v")).distinct()
    s = n.groupBy("v").agg((F.max("side") - F.min("side")).alias("s"))
    return s.agg(F.sum((F.col("s") == 1).cast("int")).alias("both_sides"), F.sum((F.col("s") == 0).cast("int")).alias("one_side"))


@query("a23_number_types", "SELECT CASE WHEN regexp_full_match(v, '(19|20)\\d\\d') THEN 'years' WHEN regexp_full_match(v, '\\d{1,4}') AND regexp_matches(c, 'vol|pp|page|;|:') THEN 'page_ranges' ELSE 'other' END AS kind, CAST(count(*) AS BIGINT) AS n FROM (SELECT lower(line) AS c, unnest(regexp_extract_all(line, '\\d+\\.?\\d*')) AS v FROM " + _PARA + ") GROUP BY ALL")
def number_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = paragraphs(spark, sf_dir).select("text", F.explode(F.regexp_extract_all("text", F.lit(fixed.NUMBER), F.lit(0))).alias("v"))
    return n.groupBy(quality.number_type(F.col("v"), F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


PATTERNS = [(1, "licen[cs]ed under"), (2, "[Tt]rash|idiot"), (3, "no such text anywhere"), (4, "CC BY")]


@query("a26_pattern_search", f"SELECT id, CAST(count(m) AS BIGINT) AS n, min(doc_id) FILTER (WHERE m IS NOT NULL) AS first_doc FROM (SELECT p.id, d.doc_id, CASE WHEN regexp_matches(d.text, p.p) THEN 1 END AS m FROM {b.values(PATTERNS, 'id', 'p')} AS p, documents d) GROUP BY id".replace("AS t(id, p) AS p", "AS p(id, p)"))
def pattern_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All patterns in one pass over the documents."""
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(p), F.lit(i)) for i, p in PATTERNS]))
    found = b.table(spark, sf_dir, "documents").select("doc_id", F.explode(hits).alias("id")).groupBy("id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    asked = spark.createDataFrame([(i,) for i, _ in PATTERNS], "id int")
    return asked.join(found, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), "first_doc")


@query("f31_table_text", "SELECT page_id, CASE WHEN regexp_matches(html, '(?i)</?t[dhrab]') THEN 'html' ELSE 'sentences' END AS raw, CASE WHEN regexp_matches(t, '(?i)</?t[dhrab]') THEN 'html' WHEN NOT (contains(t, '.') AND length(t) > 30) AND len(string_split_regex(t, '\\s+')) > 3 THEN 'stripped' ELSE 'sentences' END AS kind FROM (SELECT page_id, html, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM pages)")
def table_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("html").rlike(fixed.TABLE_TAG), "html").otherwise("sentences")
    return b.table(spark, sf_dir, "pages").select("page_id", raw.alias("raw"), quality.looks_linearised(text.strip_html(F.col("html"))).alias("kind"))


@query("f32_text_faults", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')) AS INT) AS control, regexp_matches(rtrim(text, E' '), '[.!?:;)\\]”\"''0-9%–—-]$') AS clean_end, CAST(len(regexp_extract_all(text, '[a-z]-\\n[a-z]')) AS INT) AS hyphens FROM documents")
def text_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return b.table(spark, sf_dir, "documents").select("doc_id", F.regexp_count(t, F.lit(fixed.CONTROL)).alias("control"), quality.clean_ending(t).alias("clean_end"), F.regexp_count(t, F.lit(r"[a-z]-\n[a-z]")).alias("hyphens"))


_NUMS = "list_distinct(regexp_extract_all({0}, '\\d+\\.?\\d*'))"


@query("m20_number_loss", f"SELECT page_id, CAST(len([x FOR x IN k IF NOT list_contains(l, x)]) AS INT) AS missing, CAST(len(k) AS INT) AS key_numbers, len([x FOR x IN k IF NOT list_contains(l, x)]) > 0.3 * len(k) AS lost FROM (SELECT page_id, [x FOR x IN {_NUMS.format('html')} IF length(x) >= 2] AS k, {_NUMS.format('t')} AS l FROM (SELECT page_id, html, regexp_replace(html, '<[^>]+>', ' ', 'g') AS t FROM pages))")
def number_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of a page's source that its text does not have."""
    missing, key = quality.number_loss(F.col("html"), F.regexp_replace("html", "<[^>]+>", " "))
    return b.table(spark, sf_dir, "pages").select("page_id", missing.alias("missing"), key.alias("key_numbers"), (missing > 0.3 * key).alias("lost"))


@query("m22_text_fidelity", f"""WITH c AS (SELECT doc_id, source, regexp_replace(line, '(?s)^\\[.*?\\]\\s*', '') AS t FROM {_PARA}), m AS (SELECT doc_id, t, trim(substr(t, greatest(0, length(t) // 2 - 25) + 1, length(t) // 2 + 25 - greatest(0, length(t) // 2 - 25))) AS s FROM c)
SELECT m.doc_id AS ref_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(contains(regexp_replace(d.text, '\\s+', ' ', 'g'), regexp_replace(CASE WHEN length(s) < 10 THEN trim(substr(t, 1, 50)) ELSE s END, '\\s+', ' ', 'g'))::INT) AS BIGINT) AS found FROM m JOIN documents d USING (doc_id) GROUP BY m.doc_id""")
def text_fidelity(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref_id"), F.col("text").alias("source_text"))
    return quality.text_fidelity(paragraphs(spark, sf_dir).select("ref_id", "text"), d)


@query("m21_paragraph_coverage", """
WITH s AS (SELECT doc_id AS ref_id, replace(text, chr(10), chr(10) || chr(10)) AS t FROM documents),
 a AS (SELECT doc_id AS ref_id, regexp_replace(array_to_string([x FOR x, i IN string_split(text, chr(10)) IF i % 4 <> 0], ' '), '\\s+', ' ', 'g') AS w FROM documents),
 p AS (SELECT ref_id, trim(unnest(string_split(t, chr(10) || chr(10)))) AS p FROM s)
SELECT ref_id, CAST(count(*) AS BIGINT) AS paragraphs, CAST(sum((starts_with(p, '#') OR contains(lower(p), '<table') OR contains(w, regexp_replace(substr(p, 1, 60), '\\s+', ' ', 'g')))::INT) AS BIGINT) AS covered FROM p JOIN a USING (ref_id) WHERE length(p) > 60 GROUP BY ref_id""")
def paragraph_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth line left out of the chunks: its paragraph is not covered."""
    d = b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref_id"), F.replace("text", F.lit("\n"), F.lit("\n\n")).alias("source_text"))
    c = paragraphs(spark, sf_dir).where("(chunk_index + 1) % 4 <> 0")
    return quality.paragraph_coverage(d, c)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk records with faults by the document's number."""
    i = F.col("doc_id")
    kind = b.pick(["text", "table", "figure", "reference", "odd"], i)
    return b.table(spark, sf_dir, "documents").select(
        F.concat(F.col("source"), F.when(i % 13 == 0, "-").otherwise("::"), i).alias("sent_id"), F.when(i % 17 == 0, "").otherwise(F.col("text")).alias("text"),
        F.when(i % 19 == 0, F.lit(None).cast("string")).otherwise("Results").alias("section"), kind.alias("segment_type"), (i % 3 != 0).alias("embeddable"), numbers.approx_tokens(F.col("text")).alias("approx_tokens"),
    )


_RULES = {
    "empty_text": "trim(t) = ''", "empty_embeddable": "emb AND length(trim(t)) < 5", "control_characters": "emb AND regexp_matches(t, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]')",
    "wrong_embeddable": "emb <> (kind IN ('text', 'table'))", "bad_sent_id": "NOT contains(sid, '::')", "no_section": "doc_id % 19 = 0", "unknown_segment": "kind = 'odd'",
    "oversized": "emb AND tok > 512", "raw_html_table": "kind = 'table' AND regexp_matches(t, '(?i)</?t[dhrab]')",
}
_RECORDS = f"(SELECT doc_id, source || CASE WHEN doc_id % 13 = 0 THEN '-' ELSE '::' END || doc_id AS sid, CASE WHEN doc_id % 17 = 0 THEN '' ELSE text END AS t, {b.list_item(['text', 'table', 'figure', 'reference', 'odd'], 'doc_id')} AS kind, doc_id % 3 <> 0 AS emb, length(text) // 4 AS tok FROM documents)"
_VIOLATIONS = " UNION ALL ".join(f"SELECT sid AS sent_id, '{n}' AS rule FROM {_RECORDS} WHERE {c}" for n, c in _RULES.items())


@query("c09_violations", _VIOLATIONS)
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.violations(records(spark, sf_dir))


@query("c09_release", f"SELECT CAST(count(*) FILTER (WHERE c) AS BIGINT) AS critical, CAST(count(*) FILTER (WHERE NOT c) AS BIGINT) AS warnings, CASE WHEN count(*) FILTER (WHERE c) = 0 THEN 'GO' ELSE 'HOLD' END AS decision FROM (SELECT rule IN ('empty_embeddable', 'control_characters', 'wrong_embeddable') AS c FROM ({_VIOLATIONS}))")
def release(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.release(records(spark, sf_dir))


_SYM = "list_sort(list_concat([x FOR x IN a IF NOT list_contains(b, x)], [x FOR x IN b IF NOT list_contains(a, x)]))"
SETS = [(1, "a,b,c", "b,c,d"), (2, "a", "a"), (3, "x,y", "z")]


@query("u04_symmetric_difference", f"SELECT id, array_to_string({_SYM}, ',') AS diff FROM (SELECT id, string_split(l || ',' || source, ',') AS a, string_split(r || ',src' || n_chars % 20, ',') AS b FROM {b.dealt_sql(SETS, 'id l r')})")
def symmetric_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.dealt(spark, sf_dir, SETS, "id int, l string, r string")
    d = d.withColumns({"l": F.concat_ws(",", "l", "source"), "r": F.concat(F.col("r"), F.lit(",src"), F.col("n_chars") % 20)})
    return d.select("id", F.array_join(quality.symmetric_difference(F.split("l", ","), F.split("r", ",")), ",").alias("diff"))


_WORDS = "list_distinct([w FOR w IN string_split(lower({0}), ' ') IF w NOT IN ('the', 'of', 'in', 'a', 'and', 'was', 'by')])"


@query("j11_u02_number_and_words", f"""
WITH n AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\\d+\\.?\\d*%?')) AS v FROM documents), w AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents)
SELECT x.a, x.b, CAST(len(list_intersect(p.w, q.w)) AS INT) AS words FROM (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM n a JOIN n b ON a.v = b.v AND a.doc_id < b.doc_id) x JOIN w p ON p.doc_id = x.a JOIN w q ON q.doc_id = x.b WHERE len(list_intersect(p.w, q.w)) >= 2""")
def number_and_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that share a number and two words."""
    d = b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = quality.number_and_word_links(d, d, ["the", "of", "in", "a", "and", "was", "by"], once=True)
    return found.select("a", "b", "words")


@query("j13_verbatim_anchors", "SELECT b.item_id, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, b.text)")
def verbatim_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims whose whole text stands word for word in a document."""
    q = b.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), "text")
    d = b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return lexical.verbatim(q, d).select(F.col("claim_id").alias("item_id"), F.col("id").alias("doc_id"))


@query("g03_secondary_citations", "SELECT doc_id, regexp_matches(text, '(?i)as (cited|reported) (in|by)|licen[cs]ed under') AND 'RT-' || (doc_id % 400) NOT IN ('RT-101', 'RT-311') AS flagged FROM documents")
def secondary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rt = F.concat(F.lit("RT-"), F.col("doc_id") % 400)
    return b.table(spark, sf_dir, "documents").select("doc_id", quality.secondary_citation(F.col("text"), rt, "(?i)as (cited|reported) (in|by)|licen[cs]ed under").alias("flagged"))


COUNTS = [(1, "12 (21%) and 26 [46 %]"), (2, "none (x)"), (3, "7 (3.5%)")]


@query("g05_counts_with_percent", f"SELECT id, array_to_string([replace(x, ' ', '') FOR x IN regexp_extract_all(t, '\\d+\\s*[(\\[]\\s*(\\d+\\.?\\d*\\s*%)\\s*[)\\]]', 1)], ',') AS shares FROM {b.dealt_sql(COUNTS, 'id t', 't')}")
def counts_with_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.dealt(spark, sf_dir, COUNTS, "id int, t string", "t").select("id", F.array_join(numbers.shares_of_counts(F.col("t")), ",").alias("shares"))


@query("g02_authority", f"SELECT c.claim_id, bool_or(p.tier = 'P') AS has_primary, bool_or(p.tier IN ('P', 'A')) AS has_acceptable FROM {b.CLAIMS_SQL} c JOIN {b.POLICY_SQL} p USING (ct_id) GROUP BY c.claim_id")
def authority(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = b.claims(spark, sf_dir).join(b.policy(spark), "ct_id")
    return j.groupBy("claim_id").agg(F.bool_or(F.col("tier") == "P").alias("has_primary"), F.bool_or(F.col("tier").isin("P", "A")).alias("has_acceptable"))


@query("g07_mandatory_fields", "SELECT doc_id, CAST((lang = 'en')::INT + (source = 'src0')::INT AS INT) AS missing FROM documents WHERE lang = 'en' OR source = 'src0'")
def mandatory_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations with a missing mandatory field, and how many."""
    d = b.table(spark, sf_dir, "documents").select("doc_id", F.nullif("lang", F.lit("en")).alias("page"), F.nullif("source", F.lit("src0")).alias("file_name"))
    missing = F.col("page").isNull().cast("int") + F.col("file_name").isNull().cast("int")
    return d.select("doc_id", missing.alias("missing")).where("missing > 0")


@query("g08_revalidation", "SELECT event_id, o_date < TIMESTAMP '2021-01-15' AS due FROM (SELECT event_id, ts - to_days(CAST(event_id % 2000 AS INT)) AS o_date FROM events)")
def revalidation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources older than three years on 15 January 2024."""
    seen = F.col("ts") - F.make_dt_interval((F.col("event_id") % 2000).cast("int"))
    return b.table(spark, sf_dir, "events").select("event_id", (seen < F.add_months(F.lit("2024-01-15").cast("date"), -36).cast("timestamp")).alias("due"))


_REFS = "(SELECT user_id AS claim, event_type AS material, 'src' || (event_id % 3) AS ref FROM events)"


@query("g09_inconsistent_references", f"SELECT claim FROM (SELECT claim, material, string_agg(DISTINCT ref, ',' ORDER BY ref) AS refs FROM {_REFS} GROUP BY claim, material) GROUP BY claim HAVING count(DISTINCT refs) > 1")
def inconsistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event is a use of a claim in a material."""
    e = b.table(spark, sf_dir, "events").select(F.col("user_id").alias("claim"), F.col("event_type").alias("material"), F.concat(F.lit("src"), F.col("event_id") % 3).alias("ref"))
    sets = e.groupBy("claim", "material").agg(F.array_join(F.sort_array(F.collect_set("ref")), ",").alias("refs"))
    return sets.groupBy("claim").agg(F.countDistinct("refs").alias("n")).where("n > 1").select("claim")


@query("g10_safety_link", f"SELECT claim_id, EXISTS (SELECT 1 FROM {b.CLAIMS_SQL} s WHERE s.ct_id = 'CT-301' AND s.claim_id // 4 = c.claim_id // 4) AS linked FROM {b.CLAIMS_SQL} c WHERE ct_id IN ('CT-201', 'CT-203')")
def safety_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Efficacy claims with a safety claim in the same group of four."""
    c = b.claims(spark, sf_dir).withColumn("g", F.floor(F.col("claim_id") / 4))
    safe = c.where("ct_id = 'CT-301'").select("g").distinct().withColumn("linked", F.lit(True))
    return c.where(F.col("ct_id").isin("CT-201", "CT-203")).join(safe, "g", "left").select("claim_id", F.coalesce("linked", F.lit(False)).alias("linked"))


@query("g11_no_reference", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def no_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").join(b.table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id")


CUES = [("prescribing information", "RT-101"), ("clinical study report", "RT-209"), ("poster", "RT-402"), ("guideline", "RT-311"), ("preprint", "RT-310")]
NAMES = [(1, "Drug Prescribing Information 2024"), (2, "A GUIDELINE poster"), (3, "Smith 2020"), (4, "preprint server copy")]


@query("f33_typing_cues", f"SELECT id, CASE {' '.join(f'WHEN contains(lower(n), {chr(39)}{c}{chr(39)}) THEN {chr(39)}{r}{chr(39)}' for c, r in CUES)} ELSE 'RT-301' END AS rt_id FROM {b.dealt_sql(NAMES, 'id n', 'n')}")
def typing_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.dealt(spark, sf_dir, NAMES, "id int, n string", "n").select("id", corpus.typed_by_cues(F.col("n"), CUES, "RT-301").alias("rt_id"))
