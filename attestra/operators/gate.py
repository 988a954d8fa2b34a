"""The deterministic gate: coverage, rules, verdicts, audit records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra import fixed
from attestra.functions import text


def coverage(assertions: DataFrame, key: str = "claim_id") -> DataFrame:
    """key, covered, total, coverage: a sub-assertion is covered when any source covers it."""
    per = assertions.groupBy(key, "sub_assertion").agg(F.max(F.col("is_covered").cast("int")).alias("c"))
    return per.groupBy(key).agg(F.sum("c").alias("covered"), F.count("*").alias("total"), (100 * F.avg("c")).alias("coverage"))


def redundant_sources(assertions: DataFrame, key: str = "claim_id") -> DataFrame:
    """key, ref_id of sources that cover no sub-assertion which no other source covers."""
    hit = assertions.where("is_covered").select(key, "sub_assertion", "ref_id").distinct()
    alone = hit.groupBy(key, "sub_assertion").agg(F.count("*").alias("n"), F.min("ref_id").alias("ref_id")).where("n = 1").select(key, "ref_id").distinct()
    return assertions.select(key, "ref_id").distinct().join(alone, [key, "ref_id"], "left_anti")


def failed_dimensions(picot: Column) -> Column:
    """Names that a map marks false, sorted."""
    return F.sort_array(F.map_keys(F.map_filter(picot, lambda _, v: ~v)))


def gate(judged: DataFrame, passes: float = 80.0, soft: float = 60.0, fair_balance: bool = True, efficacy: list[str] = fixed.GATE_EFFICACY, nested_numbers: bool = False) -> DataFrame:
    """judged with verdict, flags, blockers, failed.

    judged: coverage_score, ct_id, picot_alignment (map of booleans), secondary_citation_detected,
    statistical_context_present, fair_balance_note, numerical_transformations (array), and, with
    ``nested_numbers``, numerical_accuracy.transformations.
    A blocker forces BLOCK.  A failed timeframe or comparator sets the base verdict to SOFT_FLAG, up or
    down.  Nulls stand for what the judge left out: no citation, statistics present.
    """
    s = F.col("coverage_score")
    failed = F.coalesce(failed_dimensions(F.col("picot_alignment")), F.array().cast("array<string>"))
    serious = F.array_contains(failed, "timeframe") | F.array_contains(failed, "comparator")
    second = F.coalesce("secondary_citation_detected", F.lit(False))
    about = F.coalesce(F.col("ct_id").isin(efficacy), F.lit(False))
    note = F.lower(F.coalesce("fair_balance_note", F.lit("")))
    numbers = F.col("numerical_transformations")
    if nested_numbers:
        numbers = F.coalesce(numbers, F.col("numerical_accuracy.transformations"))
    rounded = F.bround(s, 0).cast("long").cast("string")
    shown = lambda x: F.lit(str(float(x)))
    flags = F.array_compact(
        F.array(
            F.when((s < passes) & (s >= soft), F.concat(F.lit(fixed.SCORE), rounded, F.lit(fixed.BELOW_PASS), shown(passes), F.lit("%)"))),
            F.when(F.size(failed) > 0, F.concat(F.lit(fixed.MISMATCH), F.array_join(failed, ", "))),
            F.when(serious, F.lit(fixed.SERIOUS)),
            F.when(about & ~F.coalesce("statistical_context_present", F.lit(True)), F.lit(fixed.NO_STATISTICS)),
            F.when(F.lit(fair_balance) & about & text.one_of(note, ["no safety", "not found"]), F.lit(fixed.NO_BALANCE)),
            F.when(F.size(numbers) > 0, F.concat(F.lit(fixed.TRANSFORMED), F.array_join(numbers, ", "))),
        )
    )
    blockers = F.array_compact(
        F.array(
            F.when(s < soft, F.concat(F.lit(fixed.SCORE), rounded, F.lit(fixed.BELOW_SOFT), shown(soft), F.lit("%)"))),
            F.when(second, F.lit(fixed.SECONDARY)),
        )
    )
    base = F.when(serious, "SOFT_FLAG").when(s >= passes, "PASS").when(s >= soft, "SOFT_FLAG").otherwise("BLOCK")
    out = judged.withColumns({"failed": failed, "flags": flags, "blockers": blockers})
    return out.withColumn("verdict", F.when(F.size("blockers") > 0, "BLOCK").otherwise(base))


def with_missing_evidence(claims: DataFrame, judged: DataFrame, key: str = "claim_id") -> DataFrame:
    """Claims that nothing was retrieved for are blocked with score 0."""
    out = claims.join(judged.withColumnRenamed(key, "_k"), F.col(key) == F.col("_k"), "left")
    return out.withColumn("coverage_score", F.coalesce("coverage_score", F.lit(0.0))).withColumn("verdict", F.coalesce("verdict", F.lit("BLOCK"))).drop("_k")


def conditional_only_cap(score: Column, tiers: Column, most: float = 60.0) -> Column:
    """A score from conditional sources alone stays at 60 at most.  tiers: array."""
    return F.when((F.size(tiers) > 0) & F.forall(tiers, lambda t: t == "C"), F.least(score, F.lit(most))).otherwise(score)


def rounding_band(difference: Column, flag: float = 2.0, block: float = 5.0) -> Column:
    """ok for equal values, flag up to two points, review up to five, block beyond."""
    return F.when(difference == 0, "ok").when(difference <= flag, "flag").when(difference <= block, "review").otherwise("block")


def audit_records(gated: DataFrame, passages: DataFrame, key: str = "claim_id") -> DataFrame:
    """One record per claim with its citations as an array of structs.

    passages: key, rank, ref_id, rt_id, text, section, page, authors, title, journal, year, doi.
    """
    cite = F.struct(
        "rank",
        text.citation(F.col("authors"), F.col("title"), F.col("journal"), F.col("year"), F.col("doi"), F.col("ref_id")).alias("full_citation"),
        F.concat(F.coalesce("ref_id", F.lit("unknown")), F.lit(".pdf")).alias("file_name"),
        F.coalesce("page", F.lit(0)).alias("page_number"),
        F.coalesce("text", F.lit("")).alias("verbatim_anchor_text"),
        "doi", F.col("section").alias("section_heading"),
        (F.col("rt_id") == "RT-209").alias("data_on_file"),
        (F.col("rt_id") == "RT-402").alias("preliminary_data"),
    )
    per = passages.groupBy(key).agg(F.sort_array(F.collect_list(cite)).alias("citations"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", F.coalesce("rt_id", F.lit("")).alias("rt")))), lambda x: x["rt"]), ",").alias("evidence_types"))
    linked = ~F.exists("flags", lambda f: F.lower(f).contains("fair balance"))
    return gated.join(per, key, "left").withColumn("fair_balance_linked", linked)
