"""Claim lists: eligibility, labels, duplicates, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestra import fixed


def trimmed(c: Column) -> Column:
    """A cell as text: null is empty, white space at the ends falls."""
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


def first_label(ct_id: Column) -> Column:
    return F.trim(F.split_part(ct_id, F.lit(";"), F.lit(1)))


def labelled(ct_id: Column) -> Column:
    return F.coalesce(F.length(ct_id) >= 3, F.lit(False))


def worth_checking(claims: DataFrame, least: int = 20) -> DataFrame:
    """Claims with some text that are not marked as none."""
    return claims.where((F.length("claim") >= least) & (F.coalesce("category", F.lit("")) != "Non-claim"))


def with_labels(claims: DataFrame, classified: DataFrame) -> DataFrame:
    """Claims with the workbook's label, else the classifier's; without either they go.
    classified: row, ct_id."""
    given = classified.where(F.col("ct_id").isNotNull() & (F.col("ct_id") != "FAILED")).select(F.col("row").alias("_row"), F.col("ct_id").alias("_ct"))
    joined = claims.join(given, F.col("row") == F.col("_row"), "left")
    label = F.when(labelled(F.col("ct_id")), F.col("ct_id")).otherwise(F.col("_ct"))
    return joined.withColumn("ct_id", first_label(label)).where("ct_id is not null").drop("_row", "_ct")


def parent_row(category: Column) -> Column:
    return F.regexp_extract(category, fixed.PARENT_ROW, 1).try_cast("int")


def inherited(claims: DataFrame) -> DataFrame:
    """row, ct_id, parent: unlabelled claims whose parent row has a label."""
    child = worth_checking(claims).where(~labelled(F.col("ct_id"))).select("row", parent_row(F.col("category")).alias("parent")).where("parent is not null")
    parents = claims.where(labelled(F.col("ct_id"))).select(F.col("row").alias("parent"), "ct_id")
    return child.join(parents, "parent").select("row", "ct_id", "parent")


def to_classify(claims: DataFrame) -> DataFrame:
    """Unlabelled claims that inherit nothing."""
    return worth_checking(claims).where(~labelled(F.col("ct_id"))).join(inherited(claims).select("row"), "row", "left_anti")


def unique_texts(claims: DataFrame) -> DataFrame:
    """claim, first_row, n: each text once."""
    return claims.groupBy("claim").agg(F.min("row").alias("first_row"), F.count("*").alias("n"))


def spread_back(claims: DataFrame, found: DataFrame) -> DataFrame:
    """What was found for a text, on every row with it."""
    return claims.join(found, "claim")


def batch(claims: DataFrame, skip: int, size: int) -> DataFrame:
    """First rows of distinct texts with a label; the skip-th on, so many, numbered from 1."""
    first = Window.partitionBy("claim").orderBy("row")
    once = claims.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n").where(labelled(F.col("ct_id")))
    numbered = once.withColumn("number", F.row_number().over(Window.orderBy("row")))
    return numbered.where(F.col("number").between(skip + 1, skip + size)).withColumn("number", F.col("number") - skip)


def best_per_type(claims: DataFrame) -> DataFrame:
    """One claim of each type: text sources first, then the longest, then the first row."""
    order = Window.partitionBy("ct_id").orderBy(F.desc(F.col("source_type") == "text"), F.desc(F.length("claim")), "row")
    return claims.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def queue_lines(texts: DataFrame, body: str, default: str) -> DataFrame:
    """line_no, ct_id, text: one claim per line with text; a line may begin with its own type and a bar."""
    lines = texts.select("*", F.posexplode(F.split(body, "\n")).alias("line_no", "line")).withColumn("line", F.trim("line")).where("line <> ''")
    head = F.upper(F.trim(F.substring_index("line", "|", 1)))
    own = F.col("line").contains("|") & head.rlike(fixed.QUEUE_TYPE)
    rest = F.trim(F.expr("substring(line, instr(line, '|') + 1)"))
    return lines.withColumn("ct_id", F.when(own, head).otherwise(default)).withColumn("text", F.when(own, rest).otherwise(F.col("line")))


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a run that was broken off still has to do."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def recovered(queue: DataFrame) -> DataFrame:
    """States of a queue after a break: what was under way is queued again."""
    return queue.withColumn("status", F.when(F.col("status").isin("rewriting", "retrieving", "judging"), "queued").otherwise(F.col("status")))
