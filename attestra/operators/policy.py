"""The policy matrix: parsing, tiers, audiences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra import fixed


def _cells(line: Column) -> Column:
    """Cells of a table row.  Empty ones fall out, which moves the later ones up."""
    return F.filter(F.transform(F.split(line, r"\|"), lambda c: F.trim(c)), lambda c: c != "")


def _cell(i: int) -> Column:
    return F.get("cells", i)


def current_type(rt_id: Column) -> Column:
    out = F
    for old, new in fixed.RETIRED_TYPES.items():
        out = out.when(rt_id == old, new)
    return out.otherwise(rt_id)


def parse_flat(lines: DataFrame, *file: str) -> DataFrame:
    """line_no, ct_id, rt_id, tier, note, ok from the long table of a mapping file.  lines: line_no, line, and for many files
    the columns that tell them, which come first.

    Rows count from the rule under the header of the sheet to the next sheet.  The state of a line is
    the last sheet title or rule above it.
    """
    t = F.trim("line")
    sheet = F.when(t.contains(fixed.MATRIX_SHEET), 1).when(t.startswith(fixed.ANY_SHEET), 0)
    up_to = Window.partitionBy(*file).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    state = lines.select(*file, "line_no", t.alias("line"), sheet.alias("sheet"))
    state = state.withColumn("on", F.coalesce(F.last("sheet", True).over(up_to), F.lit(0))).withColumn("starts", F.sum((F.coalesce("sheet", F.lit(0)) == 1).cast("int")).over(up_to))
    ruled = F.max((F.col("line").rlike(fixed.MATRIX_RULE)).cast("int")).over(Window.partitionBy(*file, "starts").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1))
    rows = state.withColumn("ruled", ruled).where((F.col("on") == 1) & (F.col("ruled") == 1) & F.col("line").startswith("|") & ~F.col("line").rlike(fixed.MATRIX_RULE))
    rows = rows.withColumn("cells", _cells(F.col("line"))).where(F.size("cells") >= 7)
    tier = F.upper(_cell(6))
    ok = tier.isin("P", "A", "C", "N") & _cell(0).startswith("CT-") & _cell(3).startswith("RT-")
    return rows.select(*file, "line_no", _cell(0).alias("ct_id"), current_type(_cell(3)).alias("rt_id"), tier.alias("tier"), F.coalesce(_cell(7), F.lit("")).alias("note"), ok.alias("ok"))


def parse_grouped(lines: DataFrame, *file: str) -> DataFrame:
    """As parse_flat, from a file with a headed table for each claim type: the header above a row
    gives its claim type.  A text line ends a table."""
    t = F.trim("line")
    ct = F.nullif(F.regexp_extract(t, fixed.MATRIX_HEAD, 1), F.lit(""))
    event = F.when(ct.isNotNull(), 0).when(t.rlike(fixed.MATRIX_RULE), 1).when(~t.startswith("|") & (t != ""), 0)
    up_to = Window.partitionBy(*file).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    state = lines.select(*file, "line_no", t.alias("line"), ct.alias("head"), event.alias("event"))
    state = state.withColumn("ct_id", F.last("head", True).over(up_to)).withColumn("on", F.last("event", True).over(up_to))
    rows = state.where(F.col("ct_id").isNotNull() & (F.col("on") == 1) & F.col("line").startswith("|") & ~F.col("line").rlike(fixed.MATRIX_RULE))
    rows = rows.withColumn("cells", _cells(F.col("line"))).where(F.size("cells") >= 4)
    tier = F.upper(_cell(3))
    ok = tier.isin("P", "A", "C", "N") & _cell(0).startswith("RT-")
    return rows.select(*file, "line_no", "ct_id", current_type(_cell(0)).alias("rt_id"), tier.alias("tier"), F.coalesce(_cell(4), F.lit("")).alias("note"), ok.alias("ok"))


def usable(parsed: DataFrame) -> DataFrame:
    return parsed.where("ok").drop("line_no", "ok")


def rejected(parsed: DataFrame) -> DataFrame:
    return parsed.where(~F.coalesce("ok", F.lit(False))).drop("note", "ok")


def tier_sets(policy: DataFrame) -> DataFrame:
    """ct_id and its types: primary, acceptable, conditional, blocked, allowed; comma-joined, sorted."""

    def of(*tiers: str) -> Column:
        return F.array_join(F.sort_array(F.collect_set(F.when(F.col("tier").isin(*tiers), F.col("rt_id")))), ",")

    return policy.groupBy("ct_id").agg(of("P").alias("primary_types"), of("A").alias("acceptable"), of("C").alias("conditional"), of("N").alias("blocked"), of("P", "A", "C").alias("allowed"))


def without_primary(policy: DataFrame) -> DataFrame:
    return policy.groupBy("ct_id").agg(F.max((F.col("tier") == "P").cast("int")).alias("p")).where("p = 0").select("ct_id")


def preferred(policy: DataFrame) -> DataFrame:
    """ct_id, preferred, n: the primary types of each claim type."""
    p = F.when(F.col("tier") == "P", F.col("rt_id"))
    return policy.groupBy("ct_id").agg(F.array_join(F.sort_array(F.collect_set(p)), "; ").alias("preferred"), F.countDistinct(p).alias("n"))


def combined(labels: DataFrame, policy: DataFrame) -> DataFrame:
    """claim_id, rt_id, tier: types allowed for all of a claim's types, with the strictest tier.
    labels: claim_id, ct_id."""
    order = F.when(F.col("tier") == "P", 1).when(F.col("tier") == "A", 2).when(F.col("tier") == "C", 3).otherwise(4)
    n = labels.distinct().withColumn("n", F.count("*").over(Window.partitionBy("claim_id")))
    per = n.join(policy, "ct_id").groupBy("claim_id", "rt_id", "n").agg(F.countDistinct("ct_id").alias("k"), F.max(order).alias("o"))
    tier = F.when(F.col("o") == 1, "P").when(F.col("o") == 2, "A").otherwise("C")
    return per.where((F.col("k") == F.col("n")) & (F.col("o") < 4)).select("claim_id", "rt_id", tier.alias("tier"))


def audience(ct_id: Column, given: Column | None = None) -> Column:
    out = F.when(ct_id.isin(fixed.PAYER_ONLY), "payer_only").when(ct_id.isin(fixed.HCP_ONLY), "hcp_only")
    if given is not None:
        out = out.when(given.isin("payer_only", "hcp_only"), given)
    return out.otherwise("unrestricted")


def group_of(ct_id: Column) -> Column:
    """Claim group of the known claim type that an id is or begins with; null for none."""
    known = F.substring(ct_id, 1, 6)
    out = F.when(ct_id.isNull(), F.lit(None).cast("string"))
    for group, types in fixed.GROUPS.items():
        out = out.when(known.isin(types), group)
    return out


def flags(claims: DataFrame) -> DataFrame:
    """With is_modifier, is_study_design, mapping_pending, audience and claim_group."""
    ct = F.col("ct_id")
    return claims.withColumns({"is_modifier": ct.isin(fixed.MODIFIERS), "is_study_design": ct.isin(fixed.PENDING), "mapping_pending": ct.isin(fixed.PENDING), "audience": audience(ct), "claim_group": group_of(ct)})
