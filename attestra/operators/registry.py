"""The claim registry: results, overrides, listings, key figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra import fixed
from attestra.functions import scores


def latest(rows: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The last row of every key."""
    order = Window.partitionBy(key).orderBy(F.desc(ts), F.desc(tie))
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def upsert(table: DataFrame, changes: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Latest row of each key of table and changes together."""
    return latest(table.unionByName(changes, allowMissingColumns=True), key, ts, tie)


def with_previous(overrides: DataFrame, results: DataFrame) -> DataFrame:
    """Overrides (claim_id, ts, override_id, new_verdict) with the verdict that held before each."""
    before = F.lag("new_verdict").over(Window.partitionBy("claim_id").orderBy("ts", "override_id"))
    joined = overrides.withColumn("_b", before).join(results.select("claim_id", F.col("verdict").alias("_raw")), "claim_id", "left")
    return joined.withColumn("previous_verdict", F.coalesce("_b", "_raw", F.lit("PENDING"))).drop("_b", "_raw")


def registry_view(claims: DataFrame, results: DataFrame, overrides: DataFrame) -> DataFrame:
    """Claims with raw_verdict (of the result), effective_verdict (the last override's before it), score (a share)."""
    last = latest(overrides, "claim_id", "ts", "override_id").select("claim_id", F.col("new_verdict").alias("_new"))
    joined = claims.join(results.select("claim_id", "verdict", "coverage_score"), "claim_id", "left").join(last, "claim_id", "left")
    raw = F.coalesce("verdict", F.lit("PENDING"))
    return joined.withColumns({"raw_verdict": raw, "effective_verdict": F.coalesce("_new", raw), "score": scores.unit_score(F.coalesce("coverage_score", F.lit(0.0)))}).drop("verdict", "_new")


def page(claims: DataFrame, number: int = 1, size: int = 50, contains: str | None = None) -> DataFrame:
    """A page of the listing, last change first."""
    out = claims.where(F.col("text").contains(contains)) if contains else claims
    return out.orderBy(F.desc("updated_at"), "claim_id").offset((number - 1) * size).limit(size)


def deleted(view: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What stays, and the log of what goes (id, type, source, verdict, score)."""
    log = view.join(ids, "claim_id", "left_semi").select("claim_id", "ct_id", "source", F.col("effective_verdict").alias("verdict"), "score")
    return view.join(ids, "claim_id", "left_anti"), log


def filtered(view: DataFrame, company: str | None = None, verdict: str | None = None, begin: str | None = None, end: str | None = None) -> DataFrame:
    """By company, effective verdict and days (both included)."""
    out = view
    if company:
        out = out.where(F.coalesce("source", F.lit("")) == company)
    if verdict:
        out = out.where(F.col("effective_verdict") == verdict)
    if begin:
        out = out.where(F.col("updated_at") >= F.lit(begin).cast("timestamp"))
    if end:
        out = out.where(F.col("updated_at") < F.lit(end).cast("timestamp") + F.expr("interval 1 day"))
    return out


def counts(verdict: str, score: Column) -> list[Column]:
    n = lambda v: F.sum((F.col(verdict) == v).cast("int")).alias(v.lower())
    return [F.count("*").alias("total"), n("PASS"), n("SOFT_FLAG"), n("BLOCK"), n("PENDING"), F.avg(score).alias("avg_score")]


def key_figures(view: DataFrame, verdict: str = "effective_verdict") -> DataFrame:
    """total, pass, soft_flag, block, pending, avg_score of a view; the average is over all its rows."""
    return view.agg(*counts(verdict, F.col("score")))


def dashboard(view: DataFrame) -> DataFrame:
    """Key figures by raw verdict; the average is over rows with a result; companies, sorted."""
    scored = F.when(F.col("raw_verdict") != "PENDING", F.col("score"))
    companies = F.array_join(F.sort_array(F.collect_set(F.nullif("source", F.lit("")))), ",").alias("companies")
    return view.agg(*counts("raw_verdict", scored), companies)


def portfolio(results: DataFrame, by: str | None = None) -> DataFrame:
    """n, pass, soft, block, whole percentages and mean coverage, over all or by a column."""
    n = lambda v: F.sum((F.col("verdict") == v).cast("int"))
    cols = [F.count("*").alias("n"), n("PASS").alias("pass"), n("SOFT_FLAG").alias("soft"), n("BLOCK").alias("block"), F.avg("coverage").alias("mean_coverage")]
    if by:
        return results.groupBy(by).agg(*cols)
    out = results.agg(*cols)
    return out.withColumns({f"{c}_pct": F.floor(F.col(c) * 100 / F.greatest("n", F.lit(1))) for c in ("pass", "soft", "block")})


def key_passage(assessment: Column, passages: Column) -> Column:
    """0-based place of the key passage: the one an assessment names, else the first with the best score,
    else -1.  passages: array of structs with score."""
    named = F.regexp_extract(assessment, fixed.KEY_PASSAGE, 1).try_cast("int") - 1
    scored = F.transform(passages, lambda p: F.coalesce(p["score"], F.lit(0.0)))
    best = F.array_position(scored, F.array_max(scored)).cast("int") - 1
    return F.when(named.between(0, F.size(passages) - 1), named).otherwise(F.when(F.size(passages) > 0, best).otherwise(-1))


def report_lines(results: DataFrame) -> DataFrame:
    """line_no, line of the portfolio report in Markdown: totals, documents, claim types, blocked claims."""
    share = lambda c: F.concat(F.lit("**"), F.col(c), F.lit("** ("), F.col(f"{c}_pct"), F.lit("%) |"))
    total = portfolio(results)
    rows = [
        F.lit("# Portfolio Coverage Report"), F.lit("## Overall Summary"), F.lit("| Metric | Value |"), F.lit("|--------|-------|"),
        F.concat(F.lit("| Total claims | **"), F.col("n"), F.lit("** |")),
        F.concat(F.lit("| Fully covered (≥80%) | "), share("pass")),
        F.concat(F.lit("| Partially covered (60-79%) | "), share("soft")),
        F.concat(F.lit("| Uncovered (<60%) | "), share("block")),
        F.concat(F.lit("| Mean coverage score | **"), F.format_number("mean_coverage", 1), F.lit("%** |")),
    ]
    head = total.select(F.posexplode(F.array(*rows)).alias("o", "line")).select(F.lit(0).alias("part"), F.lit("").alias("key"), "o", "line")

    def cut(part: int, by: str, title: str, label: str) -> DataFrame:
        rule = [title, f"| {label} | Claims | Pass | Soft | Block | Mean |", "|----------|-------:|-----:|-----:|------:|-----:|"]
        top = results.sparkSession.createDataFrame([(part, "", i, x) for i, x in enumerate(rule)], "part int, key string, o int, line string")
        short = F.when(F.length(by) > 50, F.concat(F.substring(by, 1, 50), F.lit("..."))).otherwise(F.col(by))
        cells = F.concat_ws(" | ", short, "n", "pass", "soft", "block", F.concat(F.bround("mean_coverage", 0).cast("long").cast("string"), F.lit("%")))
        rows = portfolio(results, by).select(F.lit(part).alias("part"), F.col(by).alias("key"), F.lit(9).alias("o"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
        return top.union(rows)

    lines = head.union(cut(1, "document", "## Per-Document Breakdown", "Document")).union(cut(2, "ct_id", "## Per-Claim-Type Breakdown", "CT-ID"))
    blocked = results.where("verdict = 'BLOCK'").orderBy("row").limit(100)
    cells = F.concat_ws(" | ", F.col("row").cast("string"), "ct_id", F.substring("document", 1, 30), F.concat(F.bround("coverage", 0).cast("long").cast("string"), F.lit("%")))
    last = blocked.select(F.lit(3).alias("part"), F.lpad(F.col("row").cast("string"), 20, "0").alias("key"), F.lit(9).alias("o"), F.concat(F.lit("| "), cells, F.lit(" |")).alias("line"))
    order = Window.orderBy("part", F.when(F.col("o") == 9, 1).otherwise(0), "key", "o")
    return lines.union(last).select((F.row_number().over(order) - 1).alias("line_no"), "line")
