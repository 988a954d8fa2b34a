"""Queries of the policy matrix."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra import fixed
from attestra.operators import fusion, policy
from attestra.plans import bindings as b
from attestra.plans.catalog import query

FLAT = """# Mapping
## Sheet: Mapping (Long)
| CT-ID | Claim Group | Claim Type | RT-ID | Ref Cat | Ref Type | Tier | Note |
|---|---|---|---|---|---|---|---|
| CT-201 | A2 | Primary endpoint | RT-201 | B2 | Pivotal trial | P | main |
| CT-201 | A2 | Primary endpoint | RT-602 | B6 | Old report | a | retired |
| CT-201 | A2 | Primary endpoint | RT-310 | B3 | Preprint | N |
| CT-203 | A2 | Post hoc |  | RT-301 | B3 | Journal | C | shifted |
| CT-301 | A3 | Safety | RT-101 | B1 | Label | TC | corrupt |
| XX-1 | A3 | Safety | RT-101 | B1 | Label | P | prefix |
| short | row |
text
## Sheet: Other
| CT-999 | A9 | None | RT-101 | B1 | Label | P | next sheet |"""
GROUPED = """# Mapping
| RT-000 | x | y | P |
### CT-201 — Primary endpoint
| RT-ID | Cat | Type | Tier | Note |
|---|---|---|---|---|
| RT-201 | B2 | Pivotal trial | P | main |
| RT-602 | B6 | Old report | A | retired |
| RT-310 | B3 | Preprint | TCN | corrupt |

| RT-304 | B3 | Network | C |
A closing line
| RT-101 | B1 | Label | P | after the table |
### CT-A01 - Real world
|---|---|---|---|
| RT-501 | B5 | Claims data | p | |
| RT-101 |  | Label | C | shifted |"""


def _lines(spark: SparkSession, sf_dir: str, body: str) -> DataFrame:
    """Every document as a mapping file: the lines of a body, its source in the place of the word note."""
    lines = F.posexplode(F.split(F.replace(F.lit(body), F.lit("main"), F.col("source")), "\n")).alias("line_no", "line")
    return b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), lines)


def _lines_sql(body: str) -> str:
    rows = b.values(list(enumerate(body.split(chr(10)))), "line_no", "raw")
    return f"(SELECT file, line_no, line, [x FOR x IN [trim(y) FOR y IN string_split(line, '|')] IF x <> ''] AS c FROM (SELECT d.doc_id AS file, line_no, trim(replace(raw, 'main', d.source)) AS line FROM documents d, {rows}))"


_RULE = r"regexp_full_match(line, '\|[-\s|]+\|')"
_TYPE = "CASE {0} WHEN 'RT-602' THEN 'RT-601' ELSE {0} END"
_FLAT = f"""
WITH l AS {_lines_sql(FLAT)},
 m AS (SELECT *, CASE WHEN contains(line, 'Sheet: Mapping (Long)') THEN 1 WHEN starts_with(line, '## Sheet:') THEN 0 END AS sheet, {_RULE} AS rule FROM l),
 s AS (SELECT *, last_value(sheet IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no) AS lit, (SELECT min(line_no) FROM m x WHERE x.rule AND x.line_no > (SELECT min(line_no) FROM m y WHERE y.sheet = 1)) AS begin FROM m),
 r AS (SELECT file, line_no, c[1] AS ct_id, {_TYPE.format('c[4]')} AS rt_id, upper(c[7]) AS tier, coalesce(c[8], '') AS note FROM s WHERE lit = 1 AND line_no > begin AND NOT rule AND starts_with(line, '|') AND len(c) >= 7)
"""
_OK = "tier IN ('P', 'A', 'C', 'N') AND starts_with(rt_id, 'RT-')"


@query("s07_policy_flat", f"{_FLAT} SELECT file, ct_id, rt_id, tier, note FROM r WHERE {_OK} AND starts_with(ct_id, 'CT-')")
def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.usable(policy.parse_flat(_lines(spark, sf_dir, FLAT), "file"))


@query("s07_policy_rejected", f"{_FLAT} SELECT file, line_no, ct_id, rt_id, tier FROM r WHERE NOT ({_OK} AND starts_with(ct_id, 'CT-'))")
def flat_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.rejected(policy.parse_flat(_lines(spark, sf_dir, FLAT), "file"))


@query("s08_policy_grouped", f"""
WITH l AS {_lines_sql(GROUPED)},
 m AS (SELECT *, {_RULE} AS rule, nullif(regexp_extract(line, '^###\\s+(CT-[A-Z0-9]+(?:-[A-Z0-9]+)?)\\s*[—–-]', 1), '') AS head FROM l),
 e AS (SELECT *, CASE WHEN head IS NOT NULL THEN 0 WHEN rule THEN 1 WHEN NOT starts_with(line, '|') AND line <> '' THEN 0 END AS ev FROM m),
 s AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no) AS ct_id, last_value(ev IGNORE NULLS) OVER (PARTITION BY file ORDER BY line_no) AS lit FROM e),
 r AS (SELECT file, ct_id, {_TYPE.format('c[1]')} AS rt_id, upper(c[4]) AS tier, coalesce(c[5], '') AS note FROM s WHERE ct_id IS NOT NULL AND lit = 1 AND starts_with(line, '|') AND NOT rule AND len(c) >= 4)
SELECT file, ct_id, rt_id, tier, note FROM r WHERE {_OK}""")
def grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header above carried down."""
    return policy.usable(policy.parse_grouped(_lines(spark, sf_dir, GROUPED), "file"))


#: Every document as an entry of a policy: types by its source and language, tiers by its length.  Two languages have no primary type.
_ENTRY = "'CT-' || lang || {0} AS ct_id, 'RT-' || source AS rt_id, CASE WHEN n_chars % 4 = 0 AND lang IN ('en', 'de') THEN 'P' WHEN n_chars % 4 < 2 THEN 'A' WHEN n_chars % 4 = 2 THEN 'C' ELSE 'N' END AS tier"
_ENTRIES_SQL = f"(SELECT {_ENTRY.format('doc_id % 3')} FROM documents)"


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b.table(spark, sf_dir, "documents").createOrReplaceTempView(view := f"entries_{uuid.uuid4().hex}")
    try:
        return spark.sql(f"SELECT {_ENTRY.format('doc_id % 3')} FROM {view}")
    finally:
        spark.catalog.dropTempView(view)


def _set(*tiers: str) -> str:
    return f"coalesce(string_agg(DISTINCT CASE WHEN tier IN ({b.quoted(list(tiers))}) THEN rt_id END, ',' ORDER BY CASE WHEN tier IN ({b.quoted(list(tiers))}) THEN rt_id END), '')"


@query("j02_tier_sets", f"SELECT ct_id, {_set('P')} AS primary_types, {_set('A')} AS acceptable, {_set('C')} AS conditional, {_set('N')} AS blocked, {_set('P', 'A', 'C')} AS allowed FROM {_ENTRIES_SQL} GROUP BY ct_id")
def tier_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.tier_sets(entries(spark, sf_dir))


@query("j03_tier_join", f"""SELECT d.id, c.ct_id, CASE min(CASE tier WHEN 'P' THEN 1 WHEN 'A' THEN 2 WHEN 'C' THEN 3 END) WHEN 1 THEN 'P' WHEN 2 THEN 'A' WHEN 3 THEN 'C' ELSE '?' END AS tier
FROM {b.CHUNKS_SQL} d JOIN (SELECT DISTINCT ct_id FROM {b.CLAIMS_SQL}) c ON true LEFT JOIN {b.POLICY_SQL} p ON p.ct_id = c.ct_id AND p.rt_id = d.rt_id GROUP BY d.id, c.ct_id""")
def tier_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk under every claim type there is."""
    types = F.explode(F.array(*[F.lit(t) for t in b.CLAIM_TYPES]))
    return fusion.with_tier(b.chunks(spark, sf_dir).select("id", "rt_id", types.alias("ct_id")), b.policy(spark)).select("id", "ct_id", "tier")


@query("a17_without_primary", f"SELECT ct_id FROM {_ENTRIES_SQL} GROUP BY ct_id HAVING NOT bool_or(tier = 'P')")
def without_primary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.without_primary(entries(spark, sf_dir))


@query("a18_preferred", f"SELECT ct_id, coalesce(string_agg(DISTINCT CASE WHEN tier = 'P' THEN rt_id END, '; ' ORDER BY CASE WHEN tier = 'P' THEN rt_id END), '') AS preferred, CAST(count(DISTINCT CASE WHEN tier = 'P' THEN rt_id END) AS BIGINT) AS n FROM {_ENTRIES_SQL} GROUP BY ct_id")
def preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.preferred(entries(spark, sf_dir))


@query("u06_combined_labels", f"""
WITH l AS (SELECT claim_id, ct_id FROM {b.CLAIMS_SQL} UNION SELECT claim_id, {b.list_item(b.CLAIM_TYPES[:5], 'claim_id')} FROM {b.CLAIMS_SQL}),
 n AS (SELECT claim_id, count(*) AS n FROM l GROUP BY claim_id),
 k AS (SELECT claim_id, rt_id, count(DISTINCT ct_id) AS k, max(CASE tier WHEN 'P' THEN 1 WHEN 'A' THEN 2 WHEN 'C' THEN 3 ELSE 4 END) AS o FROM l JOIN {b.POLICY_SQL} USING (ct_id) GROUP BY claim_id, rt_id)
SELECT claim_id, rt_id, CASE o WHEN 1 THEN 'P' WHEN 2 THEN 'A' ELSE 'C' END AS tier FROM k JOIN n USING (claim_id) WHERE k = n AND o < 4""")
def combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims with two labels: what both allow, by the stricter tier."""
    c = b.claims(spark, sf_dir)
    two = c.select("claim_id", "ct_id").union(c.select("claim_id", b.pick(b.CLAIM_TYPES[:5], F.col("claim_id"))))
    return policy.combined(two, b.policy(spark))


TYPES = [t for t in ("CT-101 CT-110 CT-111 CT-201 CT-204 CT-2041 CT-405 CT-901 CT-909 CT-A01 CT-A08 CT-B01 CT-B02 CT-B03 CT-B04 CT-D01 CT-D06 CT-D07 CT-505 CT-606 CT-706 CT-807 XX").split()]
_GROUPS = [(t, group) for group, types in fixed.GROUPS.items() for t in types]


@query("c06_f27_claim_flags", f"""
SELECT id, ct_id, ct_id IN ({b.quoted(fixed.MODIFIERS)}) AS is_modifier, ct_id IN ({b.quoted(fixed.PENDING)}) AS mapping_pending,
 CASE WHEN ct_id IN ({b.quoted(fixed.PAYER_ONLY)}) THEN 'payer_only' WHEN ct_id IN ({b.quoted(fixed.HCP_ONLY)}) THEN 'hcp_only' ELSE 'unrestricted' END AS audience,
 (SELECT arg_max(g, length(k)) FROM {b.values(_GROUPS, 'k', 'g')} WHERE starts_with(ct_id, k)) AS claim_group
FROM {b.dealt_sql([(t,) for t in TYPES], 'ct_id')}""")
def claim_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = b.dealt(spark, sf_dir, [(t,) for t in TYPES], "ct_id string")
    return policy.flags(c).select("id", "ct_id", "is_modifier", "mapping_pending", "audience", "claim_group")
