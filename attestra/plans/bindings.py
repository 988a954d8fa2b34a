"""How the engine's entities are read from the general tables, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra import fixed

TYPES = ["RT-101", "RT-102", "RT-201", "RT-212", "RT-301", "RT-304", "RT-310", "RT-402"]
CLAIM_TYPES = ["CT-201", "CT-301", "CT-606", "CT-101", "CT-203", "CT-999"]
POLICY = [
    ("CT-201", "RT-201", "P"), ("CT-201", "RT-101", "P"), ("CT-201", "RT-102", "A"), ("CT-201", "RT-301", "A"), ("CT-201", "RT-304", "C"), ("CT-201", "RT-310", "N"),
    ("CT-301", "RT-101", "P"), ("CT-301", "RT-301", "P"), ("CT-301", "RT-212", "A"), ("CT-301", "RT-402", "C"), ("CT-301", "RT-310", "N"),
    ("CT-606", "RT-101", "P"), ("CT-606", "RT-102", "A"), ("CT-606", "RT-301", "N"),
    ("CT-101", "RT-101", "P"), ("CT-101", "RT-201", "A"), ("CT-101", "RT-402", "N"),
    ("CT-203", "RT-301", "A"), ("CT-203", "RT-304", "C"), ("CT-203", "RT-101", "N"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], n):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (n % len(values) + 1).cast("int"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, ref_id, rt_id, text: every document is a chunk of its source."""
    number = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("ref_id"), pick(TYPES, number).alias("rt_id"), "text")


def claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """claim_id, text, ct_id: every benchmark item is a claim."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim_id"), "text", pick(CLAIM_TYPES, F.col("item_id")).alias("ct_id"))


def policy(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(POLICY, "ct_id string, rt_id string, tier string")


def claim_vectors(spark: SparkSession, sf_dir: str, every: int = 20) -> DataFrame:
    """Every twentieth vector asks."""
    return table(spark, sf_dir, "embeddings").where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("claim_id"), F.col("embedding").alias("vector"))


def chunk_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def quoted(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def values(rows: list[tuple], *names: str) -> str:
    """A SQL table of literal rows."""
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


def list_item(items: list[str], n: str) -> str:
    return f"([{quoted(items)}])[CAST({n} AS INT) % {len(items)} + 1]"


def dealt(spark: SparkSession, sf_dir: str, cases: list[tuple], schema: str, *texts: str) -> DataFrame:
    """Every document with the case of its number (one of a few, in turn): its id, source, n_chars and body, and the case's fields but its own id.
    Fields named in ``texts`` are followed by the document's whole text."""
    few = spark.createDataFrame([(n, *row) for n, row in enumerate(cases)], f"_case int, {schema}").drop("id")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", "n_chars", F.col("text").alias("body"))
    out = docs.join(F.broadcast(few), F.col("id") % len(cases) == F.col("_case")).drop("_case")
    return out.withColumns({t: F.concat(t, F.lit("\n"), F.col("body")) for t in texts})


def dealt_sql(cases: list[tuple], names: str, *texts: str) -> str:
    """The same in SQL; names: the fields of a case, its own id among them or not."""
    fields = names.split()
    mine = ", ".join(f"c.{f} || chr(10) || d.text AS {f}" if f in texts else f"c.{f}" for f in fields if f != "id")
    listed = values([(n, *row) for n, row in enumerate(cases)], "case_no", *fields)
    return f"(SELECT d.doc_id AS id, d.source, d.n_chars, d.text AS body, {mine} FROM documents d JOIN (SELECT * FROM {listed}) c ON c.case_no = d.doc_id % {len(cases)})"


CHUNKS_SQL = f"(SELECT doc_id AS id, source AS ref_id, {list_item(TYPES, 'substr(source, 4)')} AS rt_id, text FROM documents)"
CLAIMS_SQL = f"(SELECT item_id AS claim_id, text, {list_item(CLAIM_TYPES, 'item_id')} AS ct_id FROM benchmark)"
POLICY_SQL = f"(SELECT * FROM {values(POLICY, 'ct_id', 'rt_id', 'tier')})"


def stem_sql(c: str) -> str:
    whens = [f"WHEN {c} = '{w}' THEN '{r}'" for w, r in fixed.IRREGULAR_STEMS.items()]
    whens += [f"WHEN suffix({c}, '{s}') AND length({c}) >= {len(s) + 2} THEN left({c}, length({c}) - {len(s)}) || '{n}'" for s, n in fixed.SUFFIXES]
    return f"CASE WHEN length({c}) <= 3 THEN {c} {' '.join(whens)} ELSE {c} END"


def terms_sql(source: str, id_: str, body: str) -> str:
    """id, token: one row per occurrence."""
    raw = f"SELECT {id_} AS id, unnest(regexp_extract_all(lower({body}), '{fixed.TOKEN}')) AS raw FROM {source}"
    return f"(SELECT id, {stem_sql('raw')} AS token FROM ({raw}) WHERE length(raw) >= 2 AND raw NOT IN ({quoted(fixed.INDEX_STOPWORDS)}))"


def keywords_sql(source: str, id_: str, body: str, most: int) -> str:
    """id, kw, pos (from 1): the first distinct keywords."""
    raw = f"SELECT {id_} AS id, regexp_extract_all(lower({body}), '{fixed.TOKEN}') AS r FROM {source}"
    each = f"SELECT id, unnest(r) AS kw, unnest(range(1, len(r) + 1)) AS spot FROM ({raw})"
    first = f"SELECT id, kw, min(spot) AS spot FROM ({each}) WHERE length(kw) >= 2 AND kw NOT IN ({quoted(fixed.KEYWORD_STOPWORDS)}) GROUP BY id, kw"
    return f"(SELECT id, kw, pos FROM (SELECT id, kw, row_number() OVER (PARTITION BY id ORDER BY spot) AS pos FROM ({first})) WHERE pos <= {most})"
