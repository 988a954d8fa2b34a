"""The jobs as queries: each is run twice into a new shared folder, and its output read back."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import jobs
from attestra.operators import inverted
from attestra.plans import bindings as b
from attestra.plans.catalog import query
from attestra.plans.retrieval import HYBRID, IDF, POSTINGS, WEIGHT
from attestra.session import shared_folder
from jobs import index_documents, substantiate_claims


def settings(name: str) -> dict:
    return json.loads((Path(jobs.__file__).parent / f"{name}.json").read_text())


@query("job1_index_documents", f"WITH {POSTINGS} SELECT id, token, CAST(tf AS INT) AS tf, CAST(dl AS INT) AS dl, CAST(df AS BIGINT) AS df, round({WEIGHT}, 6) AS weight, round({IDF}, 6) AS idf FROM post JOIN lens USING (id) JOIN freq USING (token), stats")
def index_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream of documents into the index; the second run finds nothing new."""
    folder = f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}"
    given = settings("index_documents") | {"documents": f"{sf_dir}/documents.parquet", "output": f"{folder}/index", "checkpoint": f"{folder}/mark"}
    for _ in range(2):
        index_documents.run(spark, **given)
    rows = inverted.postings(spark, given["output"])
    return rows.select("id", "token", "tf", "dl", "df", F.round("weight", 6).alias("weight"), F.round("idf", 6).alias("idf"))


_LISTS = "FROM dense UNION ALL SELECT claim_id, id, 't', rank, score FROM bm25 UNION ALL SELECT claim_id, id, 'e', rank, score FROM exact)"
_OK = f"""_ok AS (SELECT l.claim_id, l.id, l.score, row_number() OVER (PARTITION BY l.claim_id ORDER BY l.rank) AS rank FROM {{0}} l JOIN {b.CLAIMS_SQL} c USING (claim_id) JOIN {b.CHUNKS_SQL} d USING (id)
    WHERE NOT EXISTS (SELECT 1 FROM {b.POLICY_SQL} p WHERE p.ct_id = c.ct_id AND p.rt_id = d.rt_id AND p.tier = 'N')),"""
_ALLOWED = HYBRID.replace(_LISTS, _LISTS.replace("FROM dense", "FROM dense_ok").replace("FROM bm25", "FROM bm25_ok").replace("FROM exact", "FROM exact_ok")).replace(
    "signals AS (", " ".join(f"{name}{_OK.format(name)}" for name in ("dense", "bm25", "exact")) + " signals AS ("
)


@query("job2_substantiate_claims", f"""WITH {_ALLOWED},
  best AS (SELECT claim_id, id, ref_id, tier, rank, s4 FROM hybrid WHERE rank <= 20),
  split AS (SELECT claim_id, ct_id, [regexp_replace(x, '^\\s+|\\s+$', '', 'g') FOR x IN string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) IF length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) >= 5] AS s FROM {b.CLAIMS_SQL}),
  parts AS (SELECT claim_id, unnest(s) AS part, unnest(range(len(s))) AS sub FROM split),
  held AS (SELECT p.claim_id, p.sub, h.id, h.tier FROM parts p JOIN best h USING (claim_id) JOIN documents d ON d.doc_id = h.id WHERE contains(d.text, p.part)),
  anchors AS (SELECT claim_id, id, count(*) AS n FROM held GROUP BY claim_id, id),
  per AS (SELECT claim_id, count(DISTINCT sub) AS covered, bool_and(tier = 'C') AS conditional FROM held GROUP BY claim_id),
  scored AS (SELECT s.claim_id, s.ct_id, len(s.s) AS sentences, coalesce(p.covered, 0) AS covered,
    coalesce(CASE WHEN p.conditional THEN least(100.0 * p.covered / len(s.s), 60) ELSE 100.0 * p.covered / len(s.s) END, 0)::DOUBLE AS score FROM split s LEFT JOIN per p USING (claim_id))
SELECT s.claim_id, CAST(s.sentences AS BIGINT) AS sentences, CAST(s.covered AS BIGINT) AS covered, round(s.score, 6) AS score,
  CASE WHEN s.score >= 80 THEN 'PASS' WHEN s.score >= 60 THEN 'SOFT_FLAG' ELSE 'BLOCK' END AS verdict, h.id, h.ref_id, h.tier, h.rank, round(h.s4, 9) AS final_score, CAST(coalesce(a.n, 0) AS BIGINT) AS anchors, s.ct_id
FROM scored s LEFT JOIN best h USING (claim_id) LEFT JOIN anchors a USING (claim_id, id)""")
def claims_job(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch of claims; the second run writes the same."""
    output = f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}"
    given = settings("substantiate_claims") | {"claims": f"{sf_dir}/benchmark.parquet", "documents": f"{sf_dir}/documents.parquet", "vectors": f"{sf_dir}/embeddings.parquet", "output": output}
    for _ in range(2):
        substantiate_claims.run(spark, **given)
    return spark.read.parquet(output)
