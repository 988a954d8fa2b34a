"""Substantiate a batch of claims against the documents, and write the evidence and the verdict of each.

    python jobs/substantiate_claims.py --config jobs/substantiate_claims.json --claims CLAIMS --documents DOCS --vectors VECTORS --output OUT

Every claim is searched for by vector, by words and by all of its keywords; the lists are fused and boosted by the policy.
Sources that the policy forbids for the claim's type leave the lists before they are fused.  A claim's sentences are its sub-assertions: one is covered by
a hit whose text holds it word for word.  Coverage from conditional sources alone stays at 60; no evidence is a block.

One row for each claim and hit (one without a hit where there is none), a folder for each claim type.  ``only`` names the
types to work on: their folders are replaced, the others stay.  Without it the whole output is replaced.  Runs over the same
tables write the same rows.
"""

from __future__ import annotations

import logging

if __name__ == "__main__":
    import command  # noqa: F401  finds the package
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.functions import scores, text
from attestra.operators import dense, fusion, gate, lexical
from attestra.session import kept

log = logging.getLogger(__name__)


def _typed(number: Column, types: list[str]) -> Column:
    """Types go round by number, as the general tables have none of their own."""
    return F.element_at(F.array(*[F.lit(t) for t in types]), (number % len(types) + 1).cast("int"))


def judged(claims: DataFrame, hits: DataFrame, chunks: DataFrame, passes: float, soft: float) -> tuple[DataFrame, DataFrame]:
    """Anchors (claim_id, id, anchors: sentences of the claim that a hit holds), and a row for each claim: claim_id, sentences, covered,
    score, verdict.  A claim has a few sentences and hits, so each is held against each."""
    parts = claims.select("claim_id", F.posexplode(text.plain_sentences(F.col("text"))).alias("sub_assertion", "part"))
    held = parts.join(hits.select("claim_id", "id", "tier"), "claim_id").join(chunks.select("id", F.col("text").alias("body")), "id")
    held = kept(held.where(F.col("body").contains(F.col("part"))).select("claim_id", "sub_assertion", "id", "tier"))
    anchors = held.groupBy("claim_id", "id").agg(F.count("*").alias("anchors"))
    covering = held.select("claim_id", "sub_assertion").distinct().withColumn("is_covered", F.lit(True))
    found = parts.join(covering, ["claim_id", "sub_assertion"], "left").withColumn("is_covered", F.coalesce("is_covered", F.lit(False)))
    tiers = held.groupBy("claim_id").agg(F.collect_set("tier").alias("tiers"))
    per = gate.coverage(found).join(tiers, "claim_id", "left").withColumn("coverage_score", gate.conditional_only_cap(F.col("coverage"), F.coalesce("tiers", F.array().cast("array<string>"))))
    per = per.where("covered > 0").select("claim_id", "covered", "coverage_score", scores.verdict(F.col("coverage_score"), passes, soft).alias("verdict"))
    sentences = parts.groupBy("claim_id").agg(F.count("*").alias("sentences"))
    out = gate.with_missing_evidence(claims.select("claim_id", "ct_id").join(sentences, "claim_id", "left"), per)
    zero = F.lit(0).cast("long")
    return anchors, out.select("claim_id", "ct_id", F.coalesce("sentences", zero).alias("sentences"), F.coalesce("covered", zero).alias("covered"), F.round("coverage_score", 6).alias("score"), "verdict")


def run(
    spark: SparkSession, claims: str, documents: str, vectors: str, output: str, policy: list, claim_types: list[str], source_types: list[str],
    hits: int = 20, passes: float = 80, soft: float = 60, only: list[str] | None = None,
) -> dict:
    """Search, judge and write; what was read and written."""
    asked = spark.read.parquet(claims).select(F.col("item_id").alias("claim_id"), "text", _typed(F.col("item_id"), claim_types).alias("ct_id"))
    asked = asked if only is None else asked.where(F.col("ct_id").isin(only))
    number = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    chunks = spark.read.parquet(documents).select(F.col("doc_id").alias("id"), F.col("source").alias("ref_id"), _typed(number, source_types).alias("rt_id"), "text")
    rules = spark.createDataFrame([tuple(r) for r in policy], "ct_id string, rt_id string, tier string")
    embedded = spark.read.parquet(vectors).select("vec_id", F.col("embedding").alias("vector"))
    log.info("read %d claims of %s, %d documents of %s", asked.count(), claims, chunks.count(), documents)

    near = dense.dense_search(asked.join(embedded, F.col("claim_id") == F.col("vec_id")).select("claim_id", "vector"), chunks.select("id").join(embedded, F.col("id") == F.col("vec_id")).select("id", "vector"))
    words = lexical.bm25_search(asked, "claim_id", "text", chunks, "id", "text")
    exact = lexical.all_keyword_search(asked, text.all_keywords(text.keywords(F.col("text"), 30)), chunks)
    types = chunks.select("id", "rt_id")

    def allowed(found: DataFrame) -> DataFrame:
        typed = found.join(asked.select("claim_id", "ct_id"), "claim_id").join(types, "id")
        order = F.row_number().over(Window.partitionBy("claim_id").orderBy("rank"))
        return fusion.unblocked(typed, rules).select("claim_id", "id", "score", order.alias("rank"))

    best = kept(fusion.hybrid_search(asked, chunks, rules, *(allowed(d) for d in (near, words, exact)), k=hits))
    anchors, verdicts = judged(asked, best, chunks, passes, soft)
    rows = best.select("claim_id", "id", "ref_id", "tier", "rank", F.round("final_score", 9).alias("final_score")).join(anchors, ["claim_id", "id"], "left")
    rows = verdicts.join(rows, "claim_id", "left").withColumn("anchors", F.coalesce("anchors", F.lit(0).cast("long")))
    writer = rows.repartition("ct_id", "claim_id").sortWithinPartitions("ct_id", "claim_id", "rank").write.mode("overwrite")
    writer = writer if only is None else writer.option("partitionOverwriteMode", "dynamic")
    writer.partitionBy("ct_id").parquet(output)

    there = spark.read.parquet(output)
    there = there if only is None else there.where(F.col("ct_id").isin(only))
    told = there.select("claim_id", "verdict").distinct().groupBy("verdict").count().collect()  # three verdicts
    done = {"rows": there.count(), "verdicts": {r[0]: r[1] for r in told}}
    log.info("wrote %s to %s", done, output)
    return done


if __name__ == "__main__":
    command.start(run, {"claims": "claims", "documents": "documents", "vectors": "vectors of both by id", "output": "folder of the result"})
