"""Queries of retrieval: tokens, BM25, dense and keyword search, fusion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra import fixed
from attestra.functions import scores, text
from attestra.operators import cells, dense, fusion, inverted, lexical, paging
from attestra.plans import bindings as b
from attestra.plans.catalog import query
from attestra.session import shared_folder

DOC_TERMS = b.terms_sql("documents", "doc_id", "text")
CLAIM_TERMS = b.terms_sql("benchmark", "item_id", "text")
POSTINGS = f"""
  post AS (SELECT id, token, CAST(count(*) AS BIGINT) AS tf FROM {DOC_TERMS} GROUP BY id, token),
  lens AS (SELECT id, CAST(sum(tf) AS BIGINT) AS dl FROM post GROUP BY id),
  stats AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(tf) FROM post) / greatest((SELECT count(*) FROM documents), 1)::DOUBLE AS avgdl),
  freq AS (SELECT token, count(*) AS df FROM post GROUP BY token)"""
WEIGHT = "tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / greatest(avgdl, 1.0)))"
IDF = "ln((n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE) + 1.0::DOUBLE)"


def _capitals(c: str) -> str:
    """Accented letters are letters at a word's end, too; DuckDB's patterns need to be told."""
    return f"regexp_extract_all(regexp_replace({c}, '[À-ÖØ-öø-ÿ]', '_', 'g'), '\\b[A-Z][A-Za-z]+\\b')"


def _rank(score: str, by: str = "claim_id") -> str:
    return f"CAST(row_number() OVER (PARTITION BY {by} ORDER BY round({score}, 9) DESC, id) AS INT)"


@query("f09_tokens", f"SELECT token, CAST(count(*) AS BIGINT) AS n FROM {DOC_TERMS} GROUP BY token")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indexed, stemmed tokens of all documents with their number."""
    return lexical.terms(b.table(spark, sf_dir, "documents"), "doc_id", "text").groupBy("token").agg(F.count("*").alias("n"))


@query("f10_stems", f"SELECT word, {b.stem_sql('word')} AS stem FROM (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{fixed.TOKEN}')) AS word FROM documents)")
def stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stem of every word of the documents."""
    words = b.table(spark, sf_dir, "documents").select(F.explode(text.raw_tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", text.stem("word").alias("stem"))


@query("f14_token_index", f"SELECT token, CAST(('0x' || substr(md5(token), 1, 8)) AS BIGINT) AS idx FROM (SELECT DISTINCT token FROM {DOC_TERMS})")
def token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lexical.terms(b.table(spark, sf_dir, "documents"), "doc_id", "text").select("token").distinct()
    return t.select("token", text.token_index(F.col("token")).alias("idx"))


@query("a01_bm25_fit", f"WITH {POSTINGS} SELECT CAST(n AS BIGINT) AS n, round(avgdl, 6) AS avgdl, (SELECT CAST(count(*) AS BIGINT) FROM freq) AS vocabulary FROM stats")
def bm25_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = b.table(spark, sf_dir, "documents")
    post = lexical.postings(docs, "doc_id", "text")
    vocabulary = post.agg(F.countDistinct("token").alias("vocabulary"))
    return lexical.corpus_stats(docs, post).join(F.broadcast(vocabulary)).select("n", F.round("avgdl", 6).alias("avgdl"), "vocabulary")


@query("a01_document_frequency", f"WITH {POSTINGS} SELECT token, CAST(df AS BIGINT) AS df FROM freq")
def doc_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.document_frequency(lexical.postings(b.table(spark, sf_dir, "documents"), "doc_id", "text"))


@query("a02_term_frequency", f"WITH {POSTINGS} SELECT id, token, tf, dl FROM post JOIN lens USING (id)")
def term_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.postings(b.table(spark, sf_dir, "documents"), "doc_id", "text")


@query("m08_m09_weights", f"WITH {POSTINGS} SELECT id, token, round({WEIGHT}, 6) AS weight, round({IDF}, 6) AS idf FROM post JOIN lens USING (id) JOIN freq USING (token), stats")
def weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sparse collection (S10): weight of every posting, and the token's idf."""
    docs = b.table(spark, sf_dir, "documents")
    w = lexical.weighted(docs, "doc_id", "text")
    return w.select("id", "token", F.round("weight", 6).alias("weight"), F.round("idf", 6).alias("idf"))


@query("m10_query_vector", f"WITH {POSTINGS}, asked AS (SELECT DISTINCT id AS claim_id, token FROM {CLAIM_TERMS}) SELECT claim_id, token, round({IDF}, 4) AS weight FROM asked JOIN freq USING (token), stats")
def query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique terms of every claim with their idf, where they have one."""
    docs = b.table(spark, sf_dir, "documents")
    asked = lexical.terms(b.table(spark, sf_dir, "benchmark"), "item_id", "text").distinct().withColumnRenamed("id", "claim_id")
    df = lexical.frequency_of(asked.select("token").distinct(), docs, "doc_id", "text")
    return asked.join(df, "token").join(F.broadcast(docs.agg(F.count("*").alias("n")))).select("claim_id", "token", F.round(scores.bm25_idf(F.col("n"), F.col("df")), 4).alias("weight"))


BM25 = f"""{POSTINGS},
  asked AS (SELECT DISTINCT id AS claim_id, token FROM {CLAIM_TERMS}),
  bm AS (SELECT claim_id, id, sum({WEIGHT} * {IDF}) AS score FROM asked JOIN freq USING (token) JOIN post USING (token) JOIN lens USING (id), stats GROUP BY claim_id, id),
  bm25 AS (SELECT claim_id, id, score, rank FROM (SELECT *, {_rank('score')} AS rank FROM bm) WHERE rank <= 100)"""


def bm25_hits(spark: SparkSession, sf_dir: str, k: int = 100) -> DataFrame:
    return lexical.bm25_search(b.table(spark, sf_dir, "benchmark"), "item_id", "text", b.table(spark, sf_dir, "documents"), "doc_id", "text", k)


@query("m11_bm25_search", f"WITH {BM25} SELECT claim_id, id, rank, round(score, 6) AS score FROM bm25")
def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25_hits(spark, sf_dir).select("claim_id", "id", "rank", F.round("score", 6).alias("score"))


@query("s10_index_search", f"WITH {BM25} SELECT claim_id, id, rank, round(score, 6) AS score FROM bm25")
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search by a kept index, whose documents came in two batches."""
    path, docs = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}", b.table(spark, sf_dir, "documents")
    for part in ("doc_id % 2 = 0", "true"):
        inverted.add(docs.where(part), "doc_id", "text", path)
    found = inverted.search(b.table(spark, sf_dir, "benchmark"), "item_id", "text", path)
    return found.select("claim_id", "id", "rank", F.round("score", 6).alias("score"))


DENSE = f"""
  q AS (SELECT vec_id AS claim_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0),
  c AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
  sims AS (SELECT claim_id, id, list_cosine_similarity(q.v, c.v) AS score FROM q JOIN c ON id <> claim_id),
  dense AS (SELECT claim_id, id, score, rank FROM (SELECT *, {_rank('score')} AS rank FROM sims) WHERE rank <= 150)"""


def dense_hits(spark: SparkSession, sf_dir: str, k: int = 150) -> DataFrame:
    """Every twentieth vector asks all others; its own row, found with one more, is left out."""
    found = dense.dense_search(b.claim_vectors(spark, sf_dir), b.chunk_vectors(spark, sf_dir), k + 1)
    return lexical.ranked(found.where("id <> claim_id").drop("rank"), k)


@query("j10_dense_search", f"WITH {DENSE} SELECT claim_id, id, rank, round(score, 6) AS score FROM dense")
def dense_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense_hits(spark, sf_dir).select("claim_id", "id", "rank", F.round("score", 6).alias("score"))


@query("j10_cell_search", f"WITH {DENSE} SELECT claim_id, id, rank, round(score, 6) AS score FROM dense")
def cell_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search by a kept index of cells."""
    path = f"{shared_folder(spark)}/cells-{uuid.uuid4().hex}"
    cells.write_cells(b.chunk_vectors(spark, sf_dir), path)
    found = cells.search_cells(b.claim_vectors(spark, sf_dir), path, 151)
    return lexical.ranked(found.where("id <> claim_id").drop("rank"), 150).select("claim_id", "id", "rank", F.round("score", 6).alias("score"))


@query("m07_cosine_by_label", "WITH f AS (SELECT label, min(vec_id) AS m FROM embeddings GROUP BY label) SELECT e.vec_id, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(g.embedding AS DOUBLE[])), 6) AS cosine FROM embeddings e JOIN f USING (label) JOIN embeddings g ON g.vec_id = f.m")
def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector against the first of its label."""
    e = b.table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return e.join(first, "label").select("vec_id", F.round(scores.cosine(F.col("embedding"), F.col("first")), 6).alias("cosine"))


@query("a16_vector_quality", """
SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT len(embedding)) AS BIGINT) AS n_dims, CAST(min(len(embedding)) AS BIGINT) AS dim,
  CAST(count(*) FILTER (WHERE norm < 1e-6) AS BIGINT) AS n_zero, CAST(0 AS BIGINT) AS n_nan, round(min(norm), 6) AS norm_min, round(max(norm), 6) AS norm_max,
  round(avg(norm), 6) AS norm_mean, round(stddev_pop(norm), 6) AS norm_std
FROM (SELECT embedding, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS norm FROM embeddings)""")
def vector_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = dense.vector_quality(b.table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector"))
    return q.select(*[F.round(c, 6).alias(c) if c.startswith("norm") else c for c in q.columns])


@query("p07_valid_vectors", "SELECT vec_id FROM embeddings WHERE len(embedding) = 64")
def valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dense.valid_vectors(b.table(spark, sf_dir, "embeddings").withColumnRenamed("embedding", "vector"), 64).select("vec_id")


KEYWORDS = b.keywords_sql("benchmark", "item_id", "text", 30)


@query("f11_keywords", f"SELECT id AS claim_id, string_agg(kw, ' ' ORDER BY pos) AS keywords FROM {b.keywords_sql('benchmark', 'item_id', 'text', 10)} GROUP BY id")
def keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), F.array_join(text.keywords(F.col("text")), " ").alias("keywords"))


ALL_KEYWORDS = f"""
  kept AS (SELECT id AS claim_id, kw, row_number() OVER (PARTITION BY id ORDER BY pos) AS pos FROM {KEYWORDS} WHERE kw NOT IN ({b.quoted(fixed.ALL_KEYWORD_NOISE)}) AND length(kw) >= 3),
  picked AS (SELECT claim_id, kw, pos FROM kept WHERE pos <= 8 UNION ALL SELECT id, kw, pos FROM {KEYWORDS} WHERE pos <= 5 AND id NOT IN (SELECT claim_id FROM kept))"""


@query("f12_all_keywords", f"WITH {ALL_KEYWORDS} SELECT claim_id, string_agg(kw, ' ' ORDER BY pos) AS keywords FROM picked GROUP BY claim_id")
def all_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), F.array_join(text.all_keywords(text.keywords(F.col("text"), 30)), " ").alias("keywords"))


EXACT = f"""{ALL_KEYWORDS},
  size_of AS (SELECT claim_id, count(*) AS n FROM picked GROUP BY claim_id),
  low AS (SELECT doc_id AS id, lower(text) AS t FROM documents),
  miss AS (SELECT p.claim_id, l.id, min(CASE WHEN NOT contains(l.t, p.kw) THEN p.pos END) AS m FROM picked p, low l GROUP BY p.claim_id, l.id),
  leveled AS (SELECT claim_id, id, CAST(coalesce(m - 1, n) AS INT) AS level, n FROM miss JOIN size_of USING (claim_id) WHERE coalesce(m - 1, n) >= 1),
  reach AS (SELECT a.claim_id, a.level, (SELECT count(*) FROM leveled x WHERE x.claim_id = a.claim_id AND x.level >= a.level) AS c FROM (SELECT DISTINCT claim_id, level FROM leveled) a),
  stops AS (SELECT claim_id, max(level) AS stop FROM reach WHERE c >= 3 GROUP BY claim_id),
  exact_all AS (SELECT claim_id, id, level, level / n::DOUBLE AS score FROM leveled LEFT JOIN stops USING (claim_id) WHERE level >= coalesce(stop, 1)),
  exact AS (SELECT claim_id, id, level, score, rank FROM (SELECT *, {_rank('score')} AS rank FROM exact_all) WHERE rank <= 50)"""


def exact_hits(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    return lexical.all_keyword_search(b.claims(spark, sf_dir), text.all_keywords(text.keywords(F.col("text"), 30)), b.chunks(spark, sf_dir), k)


@query("c02_all_keyword_search", f"WITH {EXACT} SELECT claim_id, id, level, rank, round(score, 6) AS score FROM exact")
def all_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_hits(spark, sf_dir).select("claim_id", "id", "level", "rank", F.round("score", 6).alias("score"))


def _forms_sql(c: str) -> str:
    cut = lambda n, *e: ", ".join(f"left({c}, length({c}) - {n}) || '{x}'" for x in e)
    return f"""list_concat(list_concat([{c}], CASE WHEN suffix({c}, 'ed') THEN [{cut(2, '', 'e', 'ing')}, {cut(1, '')}]
      WHEN {c} = 'frozen' THEN [{cut(2, '', 'e')}, {cut(1, 'ing')}, 'freeze'] WHEN suffix({c}, 'en') THEN [{cut(2, '', 'e')}, {cut(1, 'ing')}]
      WHEN suffix({c}, 'ing') THEN [{cut(3, '', 'e', 'ed')}] WHEN suffix({c}, 's') AND NOT suffix({c}, 'ss') THEN [{cut(1, '')}]
      WHEN suffix({c}, 'tion') THEN [{cut(4, 't', 'ted')}] ELSE CAST([] AS VARCHAR[]) END),
      CASE WHEN length({c}) >= 4 AND NOT suffix({c}, 'e') THEN [{c} || 'e'] ELSE CAST([] AS VARCHAR[]) END)"""


ANY_KEYWORDS = f"""
  ks AS (SELECT id AS claim_id, kw, pos, kw IN ({b.quoted(fixed.COMMON_CLINICAL)}) AS common, kw IN ({b.quoted(fixed.REWRITER_NOISE)}) AS noise FROM {KEYWORDS}),
  sp AS (SELECT claim_id, kw, row_number() OVER (PARTITION BY claim_id ORDER BY pos) AS o FROM ks WHERE NOT common AND NOT noise AND length(kw) > 2),
  co AS (SELECT claim_id, kw, 100 + row_number() OVER (PARTITION BY claim_id ORDER BY pos) AS o FROM ks WHERE common AND NOT noise),
  un AS (SELECT * FROM sp WHERE o <= 12 UNION ALL SELECT * FROM co WHERE o <= 104),
  somes AS (SELECT claim_id, kw, row_number() OVER (PARTITION BY claim_id ORDER BY o) AS o FROM un),
  fall AS (SELECT claim_id, kw, row_number() OVER (PARTITION BY claim_id ORDER BY pos) AS o FROM ks WHERE NOT noise AND claim_id NOT IN (SELECT claim_id FROM somes)),
  search AS (SELECT claim_id, kw, o FROM somes WHERE o <= 14 UNION ALL SELECT claim_id, kw, o FROM fall WHERE o <= 6)"""


@query("f13_any_keywords", f"WITH {ANY_KEYWORDS}, forms AS (SELECT DISTINCT claim_id, unnest({_forms_sql('kw')}) AS form FROM search) SELECT claim_id, form FROM forms WHERE length(form) >= 3")
def any_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All forms that the any-keyword search looks for."""
    k = text.any_keywords(text.keywords(F.col("text"), 30))
    c = b.claims(spark, sf_dir).select("claim_id", F.explode(k).alias("kw"))
    return c.select("claim_id", F.explode(text.inflections(F.col("kw"))).alias("form")).distinct()


ANY = f"""{ANY_KEYWORDS},
  n_kw AS (SELECT claim_id, count(*) AS n FROM search GROUP BY claim_id),
  forms AS (SELECT DISTINCT claim_id, unnest({_forms_sql('kw')}) AS form FROM search),
  low AS (SELECT doc_id AS id, lower(text) AS t FROM documents),
  hit AS (SELECT f.form, l.id FROM (SELECT DISTINCT form FROM forms WHERE length(form) >= 3) f JOIN low l ON contains(l.t, f.form)),
  cnt AS (SELECT claim_id, id, CAST(count(*) AS BIGINT) AS matched FROM forms JOIN hit USING (form) GROUP BY claim_id, id),
  anyk AS (SELECT claim_id, id, matched, score, rank FROM (SELECT *, {_rank('score')} AS rank FROM (SELECT claim_id, id, matched, matched / n::DOUBLE AS score FROM cnt JOIN n_kw USING (claim_id))) WHERE rank <= 100)"""


@query("a13_any_keyword_search", f"WITH {ANY} SELECT claim_id, id, matched, rank, round(score, 6) AS score FROM anyk")
def any_keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = text.any_keywords(text.keywords(F.col("text"), 30))
    found = lexical.any_keyword_search(b.claims(spark, sf_dir), k, b.chunks(spark, sf_dir))
    return found.select("claim_id", "id", "matched", "rank", F.round("score", 6).alias("score"))


@query("c04_keyword_fallback", f"""
WITH q AS (SELECT id, kw, pos FROM {b.keywords_sql('benchmark', 'item_id', "'Does the evidence support that ' || text", 10)}),
     c AS (SELECT id, kw, 100 + pos AS pos FROM {KEYWORDS})
SELECT id AS claim_id, kw, CAST(row_number() OVER (PARTITION BY id ORDER BY p) AS INT) AS pos FROM (SELECT id, kw, min(pos) AS p FROM (SELECT * FROM q UNION ALL SELECT * FROM c) GROUP BY id, kw)""")
def keyword_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a BM25 model: ten keywords of the question, then unseen ones of the claim."""
    asked = F.concat(F.lit("Does the evidence support that "), F.col("text"))
    kws = F.array_distinct(F.concat(text.keywords(asked), text.keywords(F.col("text"), 30)))
    return b.claims(spark, sf_dir).select("claim_id", F.posexplode(kws).alias("p", "kw")).select("claim_id", "kw", (F.col("p") + 1).alias("pos"))



#: The dense list of the hybrid queries: vector n stands for document n, and vector n for claim n.
FUSED = f"""{BM25}, {EXACT.replace('low AS', 'elow AS').replace('low l', 'elow l')},
  dv AS (SELECT e.vec_id AS id, CAST(e.embedding AS DOUBLE[]) AS v FROM embeddings e JOIN documents d ON d.doc_id = e.vec_id),
  qv AS (SELECT b.item_id AS claim_id, CAST(e.embedding AS DOUBLE[]) AS v FROM embeddings e JOIN benchmark b ON b.item_id = e.vec_id),
  dsim AS (SELECT claim_id, id, list_cosine_similarity(qv.v, dv.v) AS score FROM qv, dv),
  dense AS (SELECT claim_id, id, score, rank FROM (SELECT *, {_rank('score')} AS rank FROM dsim) WHERE rank <= 150),
  signals AS (SELECT claim_id, id, 'd' AS s, rank, score FROM dense UNION ALL SELECT claim_id, id, 't', rank, score FROM bm25 UNION ALL SELECT claim_id, id, 'e', rank, score FROM exact),
  merged AS (SELECT claim_id, id, max(rank) FILTER (WHERE s = 'd') AS dr, max(rank) FILTER (WHERE s = 't') AS tr, max(rank) FILTER (WHERE s = 'e') AS er FROM signals GROUP BY claim_id, id),
  flagged AS (SELECT *, max(er IS NOT NULL) OVER (PARTITION BY claim_id) AS x FROM merged),
  fused AS (SELECT claim_id, id, dr, tr, er,
    coalesce((CASE WHEN x THEN 0.5::DOUBLE ELSE 0.7::DOUBLE END) / (60 + dr), 0) + coalesce((CASE WHEN x THEN 0.25::DOUBLE ELSE 0.3::DOUBLE END) / (60 + tr), 0)
    + coalesce((CASE WHEN x THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END) / (60 + er), 0) AS rrf FROM flagged)"""


def three_lists(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = b.table(spark, sf_dir, "embeddings")
    asked = e.join(b.claims(spark, sf_dir), F.col("vec_id") == F.col("claim_id")).select("claim_id", F.col("embedding").alias("vector"))
    there = e.join(b.chunks(spark, sf_dir).select("id"), F.col("vec_id") == F.col("id")).select("id", F.col("embedding").alias("vector"))
    return dense.dense_search(asked, there), bm25_hits(spark, sf_dir), exact_hits(spark, sf_dir)


@query("m12_rank_fusion", f"WITH {FUSED} SELECT claim_id, id, dr AS dense_rank, tr AS text_rank, er AS exact_rank, round(rrf, 9) AS rrf_score FROM fused")
def rank_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three lists, one row per claim and chunk."""
    f = fusion.fuse(*three_lists(spark, sf_dir))
    return f.select("claim_id", "id", "dense_rank", "text_rank", "exact_rank", F.round("rrf_score", 9).alias("rrf_score"))


TIERED = f"""{FUSED},
  tiers AS (SELECT ct_id, rt_id, min(CASE tier WHEN 'P' THEN 1 WHEN 'A' THEN 2 ELSE 3 END) AS o FROM {b.POLICY_SQL} WHERE tier <> 'N' GROUP BY ct_id, rt_id),
  tiered AS (SELECT f.claim_id, f.id, f.er, c.ct_id, c.text AS claim, d.ref_id, d.rt_id, d.text, f.rrf, CASE o WHEN 1 THEN 'P' WHEN 2 THEN 'A' WHEN 3 THEN 'C' ELSE '?' END AS tier,
    f.rrf * (1 + CASE o WHEN 1 THEN 2.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END) AS s1
    FROM fused f JOIN {b.CLAIMS_SQL} c USING (claim_id) JOIN {b.CHUNKS_SQL} d USING (id) LEFT JOIN tiers t ON t.ct_id = c.ct_id AND t.rt_id = d.rt_id)"""


@query("m13_tier_boost", f"WITH {TIERED} SELECT claim_id, id, tier, round(s1, 9) AS final_score FROM tiered")
def tier_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 and M13."""
    f = fusion.fuse(*three_lists(spark, sf_dir)).join(b.claims(spark, sf_dir).select("claim_id", "ct_id"), "claim_id").join(b.chunks(spark, sf_dir).select("id", "rt_id"), "id")
    t = fusion.with_tier(f, b.policy(spark))
    return t.select("claim_id", "id", "tier", F.round(F.col("rrf_score") * (1 + F.col("tier_boost")), 9).alias("final_score"))


HYBRID = f"""{TIERED},
  caps AS (SELECT DISTINCT claim_id, lower(unnest({_capitals('claim')})) AS brand FROM (SELECT DISTINCT claim_id, claim FROM tiered)),
  words AS (SELECT * FROM caps WHERE length(brand) >= 3),
  brands AS (SELECT w.claim_id, w.brand FROM words w JOIN tiered t USING (claim_id) WHERE w.brand NOT IN ({b.quoted(fixed.BRAND_STOPWORDS)}) GROUP BY w.claim_id, w.brand
    HAVING max(contains(lower(t.ref_id), w.brand)) OR sum(contains(lower(t.text), w.brand)::INT) >= 3),
  owned AS (SELECT t.*, ct_id IN ({b.quoted(fixed.TRIAL_PRIMARY)}) AS led, (SELECT max(contains(lower(t.ref_id), x.brand)) FROM brands x WHERE x.claim_id = t.claim_id) AS own FROM tiered t),
  penal AS (SELECT *, s1 * CASE WHEN led AND rt_id IN ('RT-101', 'RT-102') AND NOT coalesce(own, true) THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS s2 FROM owned),
  capped AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY claim_id, ref_id ORDER BY round(s2, 12) DESC, id) AS k FROM penal) WHERE k <= 5),
  med AS (SELECT claim_id, (list(s2 ORDER BY s2))[count(*) // 2 + 1] AS m FROM capped GROUP BY claim_id),
  anch AS (SELECT c.*, s2 * CASE WHEN er IS NOT NULL AND tier IN ('P', 'A') AND s2 >= m THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS s3 FROM capped c JOIN med USING (claim_id)),
  prods AS (SELECT DISTINCT w.claim_id, w.brand FROM words w JOIN anch a USING (claim_id) WHERE w.brand NOT IN ({b.quoted(fixed.PRODUCT_STOPWORDS)}) AND contains(lower(a.ref_id), w.brand)),
  prod AS (SELECT a.*, NOT led AND EXISTS (SELECT 1 FROM prods p WHERE p.claim_id = a.claim_id AND contains(lower(a.ref_id), p.brand)) AS pb FROM anch a),
  final AS (SELECT claim_id, id, ref_id, tier, pb, s3 * CASE WHEN pb THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END AS s4 FROM prod),
  hybrid AS (SELECT *, {_rank('s4')} AS rank FROM final)"""


def hybrid_hits(spark: SparkSession, sf_dir: str, k: int = 50) -> DataFrame:
    return fusion.hybrid_search(b.claims(spark, sf_dir), b.chunks(spark, sf_dir), b.policy(spark), *three_lists(spark, sf_dir), k=k)


@query("c01_hybrid_search", f"WITH {HYBRID} SELECT claim_id, id, ref_id, tier, pb AS product_boost, rank, round(s4, 9) AS final_score FROM hybrid WHERE rank <= 50")
def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search for a batch of claims: fusion, boosts, penalty, cap, final rank."""
    h = hybrid_hits(spark, sf_dir)
    return h.select("claim_id", "id", "ref_id", "tier", "product_boost", "rank", F.round("final_score", 9).alias("final_score"))


@query("a12_source_diversity", f"WITH {HYBRID}, n AS (SELECT claim_id, ref_id, CAST(count(*) AS BIGINT) AS n FROM hybrid WHERE rank <= 15 GROUP BY claim_id, ref_id) SELECT claim_id, ref_id, n FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY n DESC, ref_id) AS k FROM n) WHERE k <= 5")
def source_diversity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five commonest sources among the first 15 hits of each claim (L2: the judge's slice)."""
    n = hybrid_hits(spark, sf_dir, 15).groupBy("claim_id", "ref_id").agg(F.count("*").alias("n"))
    order = Window.partitionBy("claim_id").orderBy(F.desc("n"), "ref_id")
    return n.withColumn("k", F.row_number().over(order)).where("k <= 5").drop("k")


TRUTH = "truth AS (SELECT b.item_id AS claim_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"


@query("a25_retrieval_ranks", f"WITH {BM25}, {TRUTH} SELECT b.item_id AS claim_id, CAST(min(r.rank) AS INT) AS first_rank, CAST(count(r.rank) AS BIGINT) AS found, coalesce(min(r.rank) <= 10, false) AS hit FROM benchmark b LEFT JOIN (SELECT claim_id, rank FROM bm25 JOIN truth USING (claim_id, id)) r ON r.claim_id = b.item_id GROUP BY b.item_id")
def retrieval_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks at which documents that hold a claim's own text are found."""
    c, d = b.claims(spark, sf_dir), b.chunks(spark, sf_dir)
    truth = lexical.verbatim(c, d)
    found = bm25_hits(spark, sf_dir).join(truth, ["claim_id", "id"]).groupBy("claim_id").agg(F.min("rank").alias("first_rank"), F.count("*").alias("found"))
    joined = c.select("claim_id").join(found, "claim_id", "left")
    return joined.select("claim_id", "first_rank", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce(F.col("first_rank") <= 10, F.lit(False)).alias("hit"))


@query("m17_rerank", f"""WITH {BM25}, g AS (SELECT claim_id, id, score, (id * 37 % 101)::DOUBLE AS ce FROM bm25),
  w AS (SELECT *, min(score) OVER p AS s0, max(score) OVER p AS s1, min(ce) OVER p AS c0, max(ce) OVER p AS c1 FROM g WINDOW p AS (PARTITION BY claim_id))
SELECT claim_id, id, round(0.4::DOUBLE * (ce - c0) / (CASE WHEN c1 > c0 THEN c1 - c0 ELSE 1 END) + 0.6::DOUBLE * (score - s0) / (CASE WHEN s1 > s0 THEN s1 - s0 ELSE 1 END), 6) AS rerank_score FROM w""")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A19 and M17, with a given encoder score."""
    h = bm25_hits(spark, sf_dir).select("claim_id", "id", F.col("score").alias("rrf_score"), (F.col("id") * 37 % 101).cast("double").alias("ce_score"))
    return fusion.rerank(h).select("claim_id", "id", F.round("rerank_score", 6).alias("rerank_score"))


@query("w02_diversity_cap", f"WITH {BM25} SELECT claim_id, id, ref_id FROM (SELECT b.claim_id, b.id, d.source AS ref_id, row_number() OVER (PARTITION BY claim_id, d.source ORDER BY round(score, 12) DESC, id) AS k FROM bm25 b JOIN documents d ON d.doc_id = b.id) WHERE k <= 5")
def diversity_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = bm25_hits(spark, sf_dir).join(b.chunks(spark, sf_dir).select("id", "ref_id"), "id")
    return fusion.diversity_cap(h, score="score").select("claim_id", "id", "ref_id")


@query("a20_upper_median", f"WITH {BM25} SELECT claim_id, round((list(score ORDER BY score))[count(*) // 2 + 1], 6) AS median FROM bm25 GROUP BY claim_id")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = bm25_hits(spark, sf_dir).withColumn("median", F.round(fusion.upper_median(F.col("score")), 6))
    return h.select("claim_id", "median").distinct()


BRAND = f"b AS (SELECT DISTINCT claim_id, brand FROM (SELECT item_id AS claim_id, lower(unnest({_capitals('text')})) AS brand FROM benchmark) WHERE length(brand) >= 3 AND brand NOT IN ({b.quoted(fixed.BRAND_STOPWORDS)}))"


@query("f15_brand_names", f"WITH {BM25}, {BRAND} SELECT b.claim_id, b.brand FROM b JOIN bm25 h USING (claim_id) JOIN documents d ON d.doc_id = h.id GROUP BY b.claim_id, b.brand HAVING max(contains(lower(d.source), b.brand)) OR sum(contains(lower(d.text), b.brand)::INT) >= 3")
def brand_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = b.claims(spark, sf_dir)
    h = bm25_hits(spark, sf_dir).join(b.chunks(spark, sf_dir), "id")
    return fusion.brand_names(c, h)


@query("j04_unblocked", f"WITH {BM25} SELECT h.claim_id, h.id FROM bm25 h JOIN {b.CLAIMS_SQL} c USING (claim_id) JOIN {b.CHUNKS_SQL} d USING (id) WHERE NOT EXISTS (SELECT 1 FROM {b.POLICY_SQL} p WHERE p.ct_id = c.ct_id AND p.rt_id = d.rt_id AND p.tier = 'N')")
def unblocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of the search that the policy allows."""
    c, d = b.claims(spark, sf_dir).select("claim_id", "ct_id"), b.chunks(spark, sf_dir).select("id", "rt_id")
    hits = bm25_hits(spark, sf_dir).select("claim_id", "id").join(c, "claim_id").join(d, "id")
    return fusion.unblocked(hits, b.policy(spark)).select("claim_id", "id")


@query("p04_payload_filter", f"SELECT id, ref_id, rt_id FROM {b.CHUNKS_SQL} WHERE rt_id IN ('RT-101', 'RT-301', 'RT-310') AND rt_id <> 'RT-310' AND ref_id <> 'src4'")
def payload_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.payload_filter(b.chunks(spark, sf_dir), rt_ids=["RT-101", "RT-301", "RT-310"], blocked=["RT-310"], excluded=["src4"]).select("id", "ref_id", "rt_id")


@query("p05_contains", "SELECT doc_id FROM documents WHERE contains(lower(text), 'license')")
def contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").where(F.lower("text").contains("license")).select("doc_id")


@query("s12_scroll", "SELECT doc_id, source FROM documents WHERE source = 'src3' ORDER BY doc_id LIMIT 64")
def scroll(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first page of 64 of a source, by id."""
    return b.table(spark, sf_dir, "documents").where("source = 'src3'").select("doc_id", "source").orderBy("doc_id").limit(64)


@query("s12_scroll_by_key", "SELECT doc_id, source FROM documents ORDER BY source DESC, doc_id LIMIT 64 OFFSET 128")
def scroll_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of 64, each asked for by the last key of the one before."""
    docs, order, last = b.table(spark, sf_dir, "documents").select("doc_id", "source"), [("source", True), ("doc_id", False)], None
    for _ in range(2):
        last = paging.key_of(paging.page_after(docs, order, last, 64).collect(), order)
    return paging.page_after(docs, order, last, 64)


@query("c03_strip_brands", f"WITH {ALL_KEYWORDS}, {BM25}, {BRAND}, br AS (SELECT b.claim_id, b.brand FROM b JOIN bm25 h USING (claim_id) JOIN documents d ON d.doc_id = h.id GROUP BY b.claim_id, b.brand HAVING max(contains(lower(d.source), b.brand)) OR sum(contains(lower(d.text), b.brand)::INT) >= 3) SELECT p.claim_id, p.kw FROM picked p WHERE p.kw NOT IN (SELECT brand FROM br WHERE br.claim_id = p.claim_id)")
def strip_brands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All-keyword search words without the claim's brands."""
    c = b.claims(spark, sf_dir)
    words = c.select("claim_id", F.explode(text.all_keywords(text.keywords(F.col("text"), 30))).alias("kw"))
    return words.join(brand_names(spark, sf_dir).withColumnRenamed("brand", "kw"), ["claim_id", "kw"], "left_anti")
