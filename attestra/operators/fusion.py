"""Fusion of ranked lists, boosts and caps: the hybrid search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra import fixed
from attestra.functions import scores, text
from attestra.operators import lexical
from attestra.session import kept


def fuse(dense: DataFrame, lexical_: DataFrame, exact: DataFrame) -> DataFrame:
    """claim_id, id, ranks and scores in each list, rrf_score.

    One union and one aggregate instead of two full outer joins.  The weights of a claim depend on
    whether it has any exact hit.
    """
    lists = [("dense", dense), ("text", lexical_), ("exact", exact)]
    rows = [d.select("claim_id", "id", F.lit(n).alias("signal"), F.col("rank").cast("int").alias("rank"), F.col("score").cast("double").alias("score")) for n, d in lists]
    union = rows[0].union(rows[1]).union(rows[2])
    pick = lambda n, c: F.max(F.when(F.col("signal") == n, F.col(c)))
    merged = union.groupBy("claim_id", "id").agg(*[pick(n, c).alias(f"{n}_{c}") for n, _ in lists for c in ("rank", "score")])
    some = F.max(F.col("exact_rank").isNotNull()).over(Window.partitionBy("claim_id"))
    weight = [F.when(some, a).otherwise(b) for a, b in zip(fixed.WEIGHTS_EXACT, fixed.WEIGHTS, strict=True)]
    total = sum((scores.rrf_part(F.col(f"{n}_rank"), w) for (n, _), w in zip(lists, weight, strict=True)), F.lit(0.0))
    return merged.withColumn("rrf_score", total)


def with_tier(hits: DataFrame, policy: DataFrame) -> DataFrame:
    """Hits (claim_id, ct_id, rt_id) with tier and tier_boost; no entry: '?'.

    An entry that stands more than once counts by its strictest-preferred tier: P, A, then C.
    """
    order = F.when(F.col("tier") == "P", 1).when(F.col("tier") == "A", 2).when(F.col("tier") == "C", 3)
    best = policy.withColumn("o", order).where("o is not null").groupBy("ct_id", "rt_id").agg(F.min("o").alias("o"))
    joined = hits.join(best, ["ct_id", "rt_id"], "left")
    tier = F.when(F.col("o") == 1, "P").when(F.col("o") == 2, "A").when(F.col("o") == 3, "C").otherwise("?")
    return joined.withColumn("tier", tier).drop("o").withColumn("tier_boost", scores.tier_boost(F.col("tier")))


def brand_names(claims: DataFrame, hits: DataFrame, stopwords: list[str] = fixed.BRAND_STOPWORDS, texts: bool = True, enough: int = 3) -> DataFrame:
    """claim_id, brand: capitalised words of a claim that stand in a hit's source id, or else in
    ``enough`` hits' texts.  claims: claim_id, text; hits: claim_id, ref_id, text."""
    words = claims.select("claim_id", F.explode(text.capitalised(F.col("text"), stopwords)).alias("brand"))
    pairs = words.join(hits.select("claim_id", F.lower("ref_id").alias("ref"), F.lower("text").alias("low")), "claim_id")
    in_ref, in_text = F.col("ref").contains(F.col("brand")), F.col("low").contains(F.col("brand"))
    found = pairs.groupBy("claim_id", "brand").agg(F.max(F.coalesce(in_ref, F.lit(False))).alias("ref"), F.sum(F.coalesce(in_text, F.lit(False)).cast("int")).alias("n"))
    return found.where(F.col("ref") | (F.lit(texts) & (F.col("n") >= enough))).select("claim_id", "brand")


def own_product(hits: DataFrame, brands: DataFrame) -> DataFrame:
    """Hits with ``own``: their source id holds a brand of the claim; null where the claim has none."""
    sets = brands.groupBy("claim_id").agg(F.collect_set("brand").alias("_brands"))
    joined = hits.join(sets, "claim_id", "left")
    return joined.withColumn("own", F.exists("_brands", lambda b: F.lower("ref_id").contains(b))).drop("_brands")


def diversity_cap(hits: DataFrame, most: int = fixed.PER_SOURCE, score: str = "final_score") -> DataFrame:
    """At most so many hits of one source for each claim, the best first."""
    order = Window.partitionBy("claim_id", "ref_id").orderBy(F.desc(F.round(score, 12)), "id")
    return hits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def upper_median(score: Column, by: str = "claim_id") -> Column:
    """Element n div 2, from 0, of the ascending values."""
    return F.element_at(F.array_sort(F.collect_list(score).over(Window.partitionBy(by))), (F.floor(F.count(score).over(Window.partitionBy(by)) / 2) + 1).cast("int"))


def hybrid_search(
    claims: DataFrame, chunks: DataFrame, policy: DataFrame, dense: DataFrame, lexical_: DataFrame, exact: DataFrame, k: int = 50,
) -> DataFrame:
    """claim_id, id, final_score, tier, product_boost, rank and the signals, for a batch of claims.

    claims: claim_id, text, ct_id; chunks: id, ref_id, rt_id, text; policy: ct_id, rt_id, tier; the
    three lists: claim_id, id, score, rank, of chunks the policy does not block.
    In order: fusion, tier boost, penalty of other products' labels for trial-led claim types,
    cap per source, boost of exact hits at the median or above, boost of the own product for other types.
    """
    fused = fuse(dense, lexical_, exact)
    hits = fused.join(claims.select("claim_id", "ct_id"), "claim_id").join(chunks.select("id", "ref_id", "rt_id", "text"), "id")
    # read four times below: a few hundred rows for each claim, kept and not searched for again
    hits = kept(with_tier(hits, policy).withColumn("final_score", F.col("rrf_score") * (1 + F.col("tier_boost"))))
    led = F.coalesce(F.upper(F.trim("ct_id")).isin(fixed.TRIAL_PRIMARY), F.lit(False))
    brands = brand_names(claims, hits)
    hits = own_product(hits, brands)
    off = led & F.col("rt_id").isin(fixed.LABEL_TYPES) & ~F.coalesce("own", F.lit(True))
    hits = hits.withColumn("final_score", F.when(off, F.col("final_score") * fixed.OFF_PRODUCT).otherwise(F.col("final_score"))).drop("own")
    hits = diversity_cap(hits)
    anchor = F.col("exact_rank").isNotNull() & F.col("tier").isin("P", "A") & (F.col("final_score") >= upper_median(F.col("final_score")))
    hits = hits.withColumn("_anchor", anchor).withColumn("final_score", F.when(F.col("_anchor"), F.col("final_score") * fixed.ANCHOR_BOOST).otherwise(F.col("final_score"))).drop("_anchor")
    products = brand_names(claims, hits, fixed.PRODUCT_STOPWORDS, texts=False)
    hits = own_product(hits, products).withColumn("product_boost", ~led & F.coalesce("own", F.lit(False)))
    hits = hits.withColumn("final_score", F.when(F.col("product_boost"), F.col("final_score") * fixed.PRODUCT_BOOST).otherwise(F.col("final_score"))).drop("own", "text")
    return lexical.ranked(hits, k, "final_score")


def rerank(hits: DataFrame, encoder: str = "ce_score", part: float = 0.4) -> DataFrame:
    """rerank_score: a blend of the given encoder's score and rrf_score, both scaled to the claim's range."""
    w = Window.partitionBy("claim_id")

    def scaled(c: str) -> Column:
        low, high = F.min(c).over(w), F.max(c).over(w)
        return (F.col(c) - low) / F.when(high > low, high - low).otherwise(1.0)

    return hits.withColumn("rerank_score", part * scaled(encoder) + (1 - part) * scaled("rrf_score"))


def payload_filter(chunks: DataFrame, ref_id: str | None = None, rt_ids: list[str] | None = None, blocked: list[str] | None = None, excluded: list[str] | None = None) -> DataFrame:
    """Chunks of a source and of allowed types; chunks without a type survive the exclusions."""
    out = chunks
    if ref_id:
        out = out.where(F.col("ref_id") == ref_id)
    if rt_ids:
        out = out.where(F.col("rt_id").isin(rt_ids))
    if blocked:
        out = out.where(~F.coalesce(F.col("rt_id").isin(blocked), F.lit(False)))
    if excluded:
        out = out.where(~F.coalesce(F.col("ref_id").isin(excluded), F.lit(False)))
    return out


def unblocked(pairs: DataFrame, policy: DataFrame) -> DataFrame:
    """Pairs (ct_id, rt_id) without those the policy marks N; unknown claim types keep all."""
    return pairs.join(policy.where("tier = 'N'").select("ct_id", "rt_id").distinct(), ["ct_id", "rt_id"], "left_anti")
