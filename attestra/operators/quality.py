"""Quality checks of chunks, tables, vectors and corpora."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra import fixed
from attestra.operators import links, passages
from attestra.session import kept


def numbers_in(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(fixed.NUMBER), F.lit(0)))


def number_loss(source: Column, text: Column, large: bool = False) -> tuple[Column, Column]:
    """Missing and key numbers of a table's source; key: two characters and more, or, with ``large``, ten and more too."""
    key = F.filter(numbers_in(source), lambda n: (F.length(n) >= 2) | (F.lit(large) & (n.cast("double") >= 10)))
    return F.size(F.array_except(key, numbers_in(text))), F.size(key)


def embeddable(segment_type: Column) -> Column:
    return segment_type.isin("text", "table")


def looks_linearised(c: Column) -> Column:
    """html, stripped or sentences: what a table became."""
    return F.when(c.rlike(fixed.TABLE_TAG), "html").when(~(c.contains(".") & (F.length(c) > 30)) & (F.size(F.split(F.trim(c), r"\s+")) > 3), "stripped").otherwise("sentences")


def size_bucket(tokens: Column) -> Column:
    return F.when(tokens < 100, "<100").when(tokens < 300, "100-300").when(tokens < 500, "300-500").otherwise("500+")


def number_type(value: Column, context: Column) -> Column:
    """years, page_ranges or other."""
    near = reduce(lambda a, b: a | b, (F.lower(context).contains(w) for w in ("vol", "pp", "page", ";", ":")))
    return F.when(value.rlike(r"^(19|20)\d\d$"), "years").when(value.rlike(r"^\d{1,4}$") & near, "page_ranges").otherwise("other")


def clean_ending(c: Column) -> Column:
    return F.rtrim(c).rlike("[.!?:;)\\]”\"'0-9%\\-–—]$")


def middle_snippet(c: Column) -> Column:
    """Fifty characters from the middle of a text without its section prefix; the first fifty of short ones."""
    bare = F.regexp_replace(c, r"(?s)^\[.*?\]\s*", "")
    mid = F.floor(F.length(bare) / 2).cast("int")
    start = F.greatest(F.lit(0), mid - 25)
    part = F.trim(F.substring(bare, start + 1, mid + 25 - start))
    return F.when(F.length(part) < 10, F.trim(F.substring(bare, 1, 50))).otherwise(part)


def collapsed(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def text_fidelity(chunks: DataFrame, sources: DataFrame, key: str = "ref_id") -> DataFrame:
    """key, n, found: chunks whose middle stands in their source.  sources: key, source_text, one for each key.  No chunk takes its source's
    text along (``passages.standing``)."""
    there = sources.select(F.col(key).alias("k"), collapsed(F.col("source_text")).alias("t"))
    asked = chunks.select(F.col(key).alias("k"), collapsed(middle_snippet(F.col("text"))).alias("t")).join(there.select("k"), "k", "left_semi").groupBy("k", "t").agg(F.count("*").alias("n"))
    hit = passages.standing(asked, there).withColumn("hit", F.lit(1))
    joined = asked.join(hit, ["k", "t"], "left")
    return joined.groupBy(F.col("k").alias(key)).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("hit") == 1, F.col("n")).otherwise(0)).alias("found"))


def paragraph_coverage(sources: DataFrame, chunks: DataFrame, key: str = "ref_id", least: int = 60) -> DataFrame:
    """key, paragraphs, covered: long paragraphs whose beginning some chunk of the source holds;
    headings and tables count as covered (``passages.standing``)."""
    para = sources.select(F.col(key).alias("k"), F.explode(F.split("source_text", "\n\n")).alias("p")).withColumn("p", F.trim("p")).where(F.length("p") > least)
    auto = F.col("p").startswith("#") | F.lower("p").contains("<table")
    para = para.groupBy("k", collapsed(F.substring("p", 1, 60)).alias("t"), auto.alias("auto")).agg(F.count("*").alias("n"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "text"))), lambda x: x["text"])
    whole = chunks.groupBy(F.col(key).alias("k")).agg(collapsed(F.array_join(ordered, " ")).alias("t"))
    hit = passages.standing(para.where("not auto"), whole).withColumn("hit", F.lit(True))
    joined = para.join(hit, ["k", "t"], "left")
    covered = F.when(F.col("auto") | F.coalesce("hit", F.lit(False)), F.col("n")).otherwise(0)
    return joined.groupBy(F.col("k").alias(key)).agg(F.sum("n").alias("paragraphs"), F.sum(covered).alias("covered"))


def violations(chunks: DataFrame) -> DataFrame:
    """sent_id, rule: every broken rule of every chunk, from one pass over the chunks."""
    text, emb = F.col("text"), F.col("embeddable")
    rules = {
        "empty_text": F.coalesce(F.trim(text), F.lit("")) == "",
        "empty_embeddable": emb & (F.length(F.trim(F.coalesce(text, F.lit("")))) < 5),
        "control_characters": emb & text.rlike(fixed.CONTROL),
        "wrong_embeddable": emb != embeddable(F.col("segment_type")),
        "bad_sent_id": ~F.coalesce(F.col("sent_id").contains("::"), F.lit(False)),
        "no_section": F.coalesce("section", F.lit("")) == "",
        "unknown_segment": ~F.coalesce(F.col("segment_type").isin("text", "table", "reference", "figure"), F.lit(False)),
        "oversized": emb & (F.col("approx_tokens") > 512),
        "raw_html_table": (F.col("segment_type") == "table") & text.rlike(fixed.TABLE_TAG),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), n) for n, c in rules.items()]))
    return chunks.select("sent_id", F.explode(found).alias("rule"))


#: Rules that stop a release.
CRITICAL = ["empty_embeddable", "control_characters", "wrong_embeddable"]


def release(chunks: DataFrame) -> DataFrame:
    """One row: critical, warnings, decision GO or HOLD."""
    critical = F.col("rule").isin(CRITICAL)
    sums = violations(chunks).agg(F.coalesce(F.sum(critical.cast("int")), F.lit(0)).alias("critical"), F.coalesce(F.sum((~critical).cast("int")), F.lit(0)).alias("warnings"))
    return sums.withColumn("decision", F.when(F.col("critical") == 0, "GO").otherwise("HOLD"))


def secondary_citation(c: Column, rt_id: Column, cues: str) -> Column:
    """Whether a text cites at second hand, by a pattern; types whose task that is are not flagged."""
    return c.rlike(cues) & ~rt_id.isin("RT-101", "RT-311")


def number_and_word_links(left: DataFrame, right: DataFrame, stopwords: list[str], pair: Column | None = None, least: int = 2, once: bool = False) -> DataFrame:
    """a, b, words: ids of a left and a right text (id, text; one row for each id) that share a number and ``least`` words.  With ``once``
    left and right are the same table, and each pair of two texts stands once, a < b.

    Texts meet by number, never all with all, but a number that many texts have gives all pairs of them: that is the rule's own
    output.  No pair takes its texts along: the texts of a number are cut in blocks (``links.blocks``), two blocks are compared in one
    task (``links.compared``), and a pair is counted at the smallest number that it shares.
    """
    same = once or right is left
    numbers = F.array_distinct(F.regexp_extract_all("text", F.lit(r"\d+\.?\d*%?"), F.lit(0)))
    values = lambda d: kept(d.select("id", F.length("text").alias("chars"), F.explode(numbers).alias("v")))
    l_values = values(left)
    r_values = l_values if same else values(right)
    sizes = lambda d, n: d.groupBy("v").agg(F.count("*").alias(f"n{n}"), F.sum("chars").alias(f"c{n}"), F.min("id").alias(n))
    if once:
        met = sizes(l_values, "a").where("na > 1").withColumns({"nb": F.col("na"), "cb": F.col("ca")})
    else:
        met = sizes(l_values, "a").join(sizes(r_values, "b"), "v")
        if pair is not None:
            met = met.where((F.col("na") * F.col("nb") > 1) | pair)  # numbers of one text alone go no further
    met = kept(met.select("v", "na", "nb", "ca", "cb"))
    met = links.blocks(met)

    def side(docs: DataFrame, found: DataFrame, right_: bool) -> DataFrame:
        shared = found.join(met, "v").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("v", "na", "nb"))).alias("m"))
        words = F.array_except(F.split(F.lower("text"), " "), F.array(*[F.lit(x) for x in stopwords]))
        rows = docs.where(F.col("text").rlike(r"\d")).select("id", links.joined(words).alias("words")).join(shared, "id")
        rows = rows.select("id", "words", F.col("m.v").alias("numbers"), F.posexplode("m").alias("at", "m"))
        mine, other = ("nb", "na") if right_ else ("na", "nb")
        own = F.pmod(F.xxhash64("id"), F.col(f"m.{mine}"))
        below = links.joined(F.slice("numbers", 1, F.col("at")))
        rows = rows.select("id", "words", below.alias("numbers"), "m.v", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col(f"m.{other}") - 1)).alias("other"))
        place = (F.least("own", "other"), F.greatest("own", "other")) if once else ("other", "own") if right_ else ("own", "other")
        is_right = F.col("own") > F.col("other") if once else F.lit(right_)
        return rows.select(F.concat_ws(" ", "v", *place).alias("task"), is_right.alias("right"), "id", "numbers", "words")

    rows = side(left, l_values, False)
    if not once:
        rows = rows.union(side(right, r_values, True))
    pairs = links.compared(rows, least, once)
    return (pairs if pair is None else pairs.where(pair)).select("a", "b", "words")


def key_sets(json: Column) -> Column:
    """Sorted names of a JSON object's fields."""
    return F.array_join(F.sort_array(F.json_object_keys(json)), ",")


def symmetric_difference(a: Column, b: Column) -> Column:
    return F.sort_array(F.array_union(F.array_except(a, b), F.array_except(b, a)))


def registry_changes(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, old, new where the two differ, or one is missing."""
    joined = old.select(key, F.col(value).alias("old")).join(new.select(key, F.col(value).alias("new")), key, "full_outer")
    return joined.where(~F.col("old").eqNullSafe(F.col("new")))
