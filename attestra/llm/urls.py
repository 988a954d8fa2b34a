"""URL filters: rules by host and path, and trust and distrust spread over links between hosts (native)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import materialise, table

#: verdict, host, path.
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The place that a link goes to: what follows href=, in quotes or not.
LINK = r"""(?i)[\x09-\x0D\x20"'/]href[\x09-\x0D\x20]*=[\x09-\x0D\x20]*["']?[\x09-\x0D\x20]*([^"'\x09-\x0D\x20>]+)"""
#: A mark of a host that stands for all of its pages; scores are whole numbers, so that reruns agree to the last bit.
UNIT = 1_000_000
#: Hosts that are sent to every task; more are joined by shuffle, the pages of a host over SALTS tasks.  Links of a host in one task.
SENT, SALTS, LINKS = 100_000, 64, 100_000


def host_of(url: Column) -> Column:
    """What follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def judged(pages: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """pages with r: the longest rule (struct of length, host's length, rule, verdict) that fits, or null.  A rule fits its host
    and all subdomains, where the path starts with its own."""
    fits = [
        F.when(
            ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path),
            F.struct(F.lit(len(host) + len(path)).alias("length"), F.lit(len(host)).alias("host_length"), F.lit(host + path).alias("rule"), F.lit(verdict).alias("verdict")),
        )
        for verdict, host, path in rules
    ]
    return pages.withColumn("r", F.array_max(F.array_compact(F.array(*fits))))


def link_host(link: Column, own: Column) -> Column:
    """The host that a link leads to: its own, or for relative links that of the page; null if it leads to none
    (mail, scripts, data)."""
    rest = F.regexp_extract(link, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)
    other = F.regexp_extract(link, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(//)", 1) != ""
    scheme = F.regexp_extract(link, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1) != ""
    return F.when(other, F.when(rest != "", F.translate(rest, UPPER, LOWER))).when(~scheme, own)


def host_links(pages: DataFrame) -> DataFrame:
    """src, dst, n: links from the pages of one host to another, by their number.  Links within a host and pages without a
    host say nothing and are left out; sums are made in the tasks first."""
    found = pages.where("host <> ''").select(F.col("host").alias("src"), F.explode(F.regexp_extract_all("html", F.lit(LINK), 1)).alias("link"))
    found = found.select("src", link_host(F.col("link"), F.col("src")).alias("dst"))
    return found.where("dst is not null and dst <> src").groupBy("src", "dst").agg(F.count("*").alias("n"))


def edges(links: DataFrame) -> DataFrame:
    """kind, src, dst, n, total, part, parts: links forward for trust (kind 0) and back for distrust (kind 1), with
    the sum of n over all edges of src; a host with many edges has them in so many parts."""
    both = links.select(F.lit(0).alias("kind"), "src", "dst", "n").union(links.select(F.lit(1), F.col("dst"), F.col("src"), "n"))
    totals = both.groupBy("kind", "src").agg(F.sum("n").alias("total"), F.ceil(F.count("*") / LINKS).cast("int").alias("parts"))
    joined = both.join(totals, ["kind", "src"])
    return joined.withColumn("part", F.pmod(F.xxhash64("dst"), F.col("parts")).cast("int"))


def spread_marks(seeds: DataFrame, links: DataFrame, rounds: int, damping: int) -> DataFrame:
    """host, trust, distrust: personalised PageRank from the seeds (host, trust, distrust), trust along the links and
    distrust against them; ``damping`` hundredths of each score come by links, the rest from the seed.

    What a host without links (in that direction) would pass on it keeps.  Scores are whole numbers: each round is one join of hosts with
    edges and one sum, and ends early when nothing changes any more.
    """
    hosts = seeds.select("host").union(links.select("src")).union(links.select("dst")).distinct()
    full = materialise(hosts.join(seeds, "host", "left").na.fill(0, ["trust", "distrust"]))
    out = materialise(edges(links))
    degree = out.groupBy("kind", "src").agg(F.max("parts").alias("parts"))
    start = full.select(F.lit(0).alias("kind"), "host", F.col("trust").alias("seed")).union(full.select(F.lit(1), F.col("host"), F.col("distrust")))
    start = start.join(degree.withColumnRenamed("src", "host"), ["kind", "host"], "left")
    seeded = materialise(start.withColumn("parts", F.coalesce("parts", F.lit(0))))
    now = seeded.withColumn("score", F.col("seed"))
    flow = F.expr("(cast(score as decimal(19,0)) * cast(n as decimal(19,0))) div cast(total as decimal(19,0))")
    for _ in range(rounds):
        sent = now.where("parts > 0 and score > 0").select("kind", F.col("host").alias("src"), "score", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        moved = sent.join(out, ["kind", "src", "part"]).select("kind", F.col("dst").alias("host"), flow.alias("got"))
        none, zero = F.lit(None).cast("long"), F.lit(0).cast("long")
        stays = F.when(F.col("parts") == 0, F.col("score")).otherwise(zero)
        parts = moved.select("kind", "host", "got", none.alias("seed"), none.alias("parts"), none.alias("score")).union(now.select("kind", "host", stays, "seed", F.col("parts").cast("long"), "score"))
        summed = parts.groupBy("kind", "host").agg(F.sum("got").alias("got"), F.max("seed").alias("seed"), F.max("parts").cast("int").alias("parts"), F.max("score").alias("before"))
        score = F.expr(f"({100 - damping} * seed + {damping} * got) div 100")
        now = materialise(summed.select("kind", "host", "seed", "parts", score.alias("score"), (score != F.col("before")).alias("changed")))
        if now.where("changed").isEmpty():
            break
    marks = [F.max(F.when(F.col("kind") == k, F.col("score"))).alias(name) for k, name in enumerate(("trust", "distrust"))]
    return now.groupBy("host").agg(*marks)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, rounds: int = 20, damping: int = 85, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust (of the host, 1 for a host all of whose pages a rule names).

    The longest rule that fits a page (host and path together; then the longer host) decides it.  Else its host does: hosts are
    seeds of trust and distrust by the share of their pages that rules allow and block, both spread over the links between
    hosts, and a host is blocked whose distrust is ``threshold`` at least and more than its trust.

    Few rules are given, as a list.  Null urls and such without ``://`` have empty host and path, and are allowed; pages with an empty host
    make no host; null html has no links; repeated rows and null page ids are judged alike, and links of repeated rows count again.
    Extra columns are not read.  No rows: no rows.
    """
    url = F.col("url").cast("string")
    read = judged(pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string").alias("html")), rules)
    counts = read.where("host <> ''").groupBy("host").agg(F.count("*").alias("n"), *(F.count(F.when(F.col("r.verdict") == v, 1)).alias(v) for v in ("allow", "block")))
    seeds = counts.select("host", F.expr(f"({UNIT} * allow) div n").alias("trust"), F.expr(f"({UNIT} * block) div n").alias("distrust"))
    links = materialise(host_links(read))
    marks = materialise(spread_marks(materialise(seeds), links, rounds, damping))
    known = marks.where("trust > 0 or distrust > 0")
    ready = read.select("page_id", "host", "path", "r.rule", F.col("r.verdict").alias("by_rule"))
    if known.limit(SENT + 1).count() <= SENT:
        joined = ready.join(F.broadcast(known), "host", "left")
    else:
        salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        joined = ready.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left").drop("salt")
    trust, distrust = (F.coalesce(c, F.lit(0)) for c in ("trust", "distrust"))
    blocked = (distrust >= round(threshold * UNIT)) & (distrust > trust)
    verdict = F.coalesce("by_rule", F.when(blocked, F.lit("block")).otherwise(F.lit("allow")))
    return joined.select("page_id", "host", "path", "rule", verdict.alias("verdict"), (trust / UNIT).alias("trust"), (distrust / UNIT).alias("distrust"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql(rules: Sequence[tuple[str, str, str]], rounds: int, damping: int, threshold: float) -> str:
    lower = lambda c: f"translate({c}, '{UPPER}', '{LOWER}')"
    listed = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    steps = ""
    for k in range(rounds):
        steps += f"""
, s{k + 1} AS MATERIALIZED (
  SELECT h.kind, h.host, h.seed, h.leads, ({100 - damping} * h.seed + {damping} * (CASE WHEN h.leads THEN 0 ELSE h.score END + coalesce(m.got, 0))) // 100 AS score
  FROM s{k} h LEFT JOIN (
    SELECT e.kind, e.dst AS host, sum((s.score * e.n) // e.total) AS got FROM s{k} s JOIN edge e ON e.kind = s.kind AND e.src = s.host GROUP BY ALL
  ) m USING (kind, host)
)"""
    return f"""
WITH read AS (
  SELECT row_number() OVER () AS row, page_id, {lower("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages
), rules(verdict, host, path) AS (VALUES {listed}
), best AS (
  SELECT p.row, max_by(r.host || r.path, length(r.host || r.path) * 1000 + length(r.host)) AS rule,
         max_by(r.verdict, length(r.host || r.path) * 1000 + length(r.host)) AS verdict
  FROM read p JOIN rules r ON (p.host = r.host OR suffix(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY p.row
), judged AS MATERIALIZED (
  SELECT p.row, p.page_id, p.host, p.path, b.rule, b.verdict FROM read p LEFT JOIN best b USING (row)
), seed AS (
  SELECT host, ({UNIT} * count(*) FILTER (verdict = 'allow')) // count(*) AS trust, ({UNIT} * count(*) FILTER (verdict = 'block')) // count(*) AS distrust
  FROM judged WHERE host <> '' GROUP BY host
), link AS (
  SELECT host AS src, unnest(regexp_extract_all(html, '{LINK.replace("'", "''")}', 1)) AS link FROM read WHERE host <> ''
), led AS (
  SELECT src, CASE WHEN regexp_matches(link, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//')
                   THEN nullif({lower("regexp_extract(link, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)")}, '')
                   WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN NULL ELSE src END AS dst FROM link
), links AS MATERIALIZED (
  SELECT src, dst, CAST(count(*) AS HUGEINT) AS n FROM led WHERE dst <> src GROUP BY src, dst
), way AS (
  SELECT 0 AS kind, src, dst, n FROM links UNION ALL SELECT 1, dst, src, n FROM links
), edge AS MATERIALIZED (
  SELECT *, sum(n) OVER (PARTITION BY kind, src) AS total FROM way
), node AS (
  SELECT host FROM seed UNION SELECT src FROM links UNION SELECT dst FROM links
), s0 AS MATERIALIZED (
  SELECT k.kind, n.host, CAST(coalesce(CASE WHEN k.kind = 0 THEN s.trust ELSE s.distrust END, 0) AS HUGEINT) AS seed,
         EXISTS (SELECT 1 FROM edge e WHERE e.kind = k.kind AND e.src = n.host) AS leads,
         CAST(coalesce(CASE WHEN k.kind = 0 THEN s.trust ELSE s.distrust END, 0) AS HUGEINT) AS score
  FROM node n CROSS JOIN (VALUES (0), (1)) k(kind) LEFT JOIN seed s USING (host)
){steps}
, mark AS (
  SELECT host, max(score) FILTER (kind = 0) AS trust, max(score) FILTER (kind = 1) AS distrust FROM s{rounds} GROUP BY host
)
SELECT j.page_id, j.host, j.path, j.rule,
       coalesce(j.verdict, CASE WHEN m.distrust >= {round(threshold * UNIT)} AND m.distrust > m.trust THEN 'block' ELSE 'allow' END) AS verdict
FROM judged j LEFT JOIN mark m USING (host)
"""


SQL = _sql(RULES, 20, 85, 0.5)
