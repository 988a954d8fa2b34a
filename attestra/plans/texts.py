"""Queries of text cleaning, metadata, numbers and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra import fixed
from attestra.functions import markdown, numbers, text
from attestra.operators import corpus, quality
from attestra.plans import bindings as b
from attestra.plans.catalog import query
from attestra.sources import readers

RAW = [
    (1, "A — b – c  d e · f\n\n g"), (2, "32·6 %  and more"), (3, ""), (4, None), (5, "  plain  "),
]


@query("f01_plain_unicode", f"SELECT id, coalesce(trim(regexp_replace(regexp_replace(translate(t, '—–·', '--.'), '[  -​  　]', ' ', 'g'), '\\s+', ' ', 'g')), '') AS t FROM {b.dealt_sql(RAW, 'id t', 't')}")
def plain_unicode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalisation but for NFKC, which DuckDB does not have."""
    return b.dealt(spark, sf_dir, RAW, "id int, t string", "t").select("id", text.plain_unicode(F.col("t")).alias("t"))


@query("f01_normalized_documents")
def normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(text.normalize_unicode(F.col("text"))).alias("digest"))


PAGES = [
    (1, "a<page_header>J\n1</page_header>b"), (2, "<page_footer>x</page_footer>c<page_header>y</page_footer>"), (3, "plain\n\n\n\nend"), (4, "![A long description of a figure](p_1.jpg) x"),
    (5, "![short](a.PNG)y"), (6, "![The logo of the company logo](l.svg)z"), (7, "![ padded description here ok ](i.webp?x=1)"), (8, "![keep](a.pdf)"),
]


@query("f02_page_furniture", f"SELECT id, regexp_replace(regexp_replace(t, '(?s)<page_header>.*?</page_header>', '', 'g'), '(?s)<page_footer>.*?</page_footer>', '', 'g') AS t FROM {b.dealt_sql(PAGES, 'id t', 't')}")
def page_furniture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.dealt(spark, sf_dir, PAGES, "id int, t string", "t").select("id", text.strip_page_furniture(F.col("t")).alias("t"))


_END = r"\]\([^)]+\.(?:jpg|png|jpeg|gif|svg|webp)[^)]*\)"
_ALT = "trim(regexp_extract(t, '!\\[([^\\]]*)', 1))"


@query("f04_images", f"SELECT id, CASE WHEN regexp_matches(t, '(?i)!\\[[^\\]]*{_END}') THEN regexp_replace(t, '(?i)!\\[[^\\]]*{_END}', CASE WHEN length({_ALT}) > 20 AND NOT suffix({_ALT}, 'logo') THEN '[Figure: ' || {_ALT} || ']' ELSE '' END, 'g') ELSE t END AS t FROM {b.dealt_sql(PAGES, 'id t', 't')}")
def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.dealt(spark, sf_dir, PAGES, "id int, t string", "t").select("id", text.strip_images(F.col("t")).alias("t"))


@query("f05_blank_lines", "SELECT doc_id, regexp_replace(replace(text, chr(10), chr(10) || chr(10) || chr(10)), '\\n{3,}', chr(10) || chr(10), 'g') AS t FROM documents")
def blank_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").select("doc_id", text.collapse_blank_lines(F.replace("text", F.lit("\n"), F.lit("\n\n\n"))).alias("t"))


ANCHORS = [(1, "<a id='x-1'></a>\n\nText"), (2, '<a id="y"></a> and <A ID="z"></A>'), (3, "none"), (4, '<a href="k">l</a>')]


@query("f06_anchors", f"SELECT id, regexp_replace(regexp_replace(t, '(?i)<a id=[''\"][^''\"]*[''\"]></a>', '', 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM {b.dealt_sql(ANCHORS, 'id t', 't')}")
def anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.dealt(spark, sf_dir, ANCHORS, "id int, t string", "t").select("id", text.strip_anchors(F.col("t")).alias("t"))


@query("f07_html_strip", "SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g')) AS t FROM pages")
def html_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "pages").select("page_id", text.strip_html(F.col("html")).alias("t"))


@query("f08_clean_evidence", r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\*{1,2}([^*]+)\*{1,2}', '\1', 'g'), '_{1,2}([^_]+)_{1,2}', '\1', 'g'), ' {2,}', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM pages""")
def clean_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "pages").select("page_id", text.clean_evidence(F.col("html")).alias("t"))


@query("f08_clean_passage", r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '</?(?:sup|sub|u|b|i|em|strong|br|p|div|span|a|img|mark)[^>]*>', '', 'g'), '\*\*(.+?)\*\*', '\1', 'g'), '\*(.+?)\*', '\1', 'g'), '__(.+?)__', '\1', 'g'), '(?m)^#{1,6}\s*', '', 'g'), '  +', ' ', 'g'), '^\s+|\s+$', '', 'g') AS t FROM pages""")
def clean_passage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "pages").select("page_id", text.clean_passage(F.col("html")).alias("t"))


_KEPT = f"regexp_replace(text, '(^|\\s)({'|'.join(fixed.ABBREVIATIONS)})([.!? ]*[.?!])\\s+([A-Z])', '\\1\\2\\3' || chr(2) || '\\4', 'g')"
_MARKED = f"string_split(regexp_replace({_KEPT}, '([.?!])\\s+([A-Z])', '\\1' || chr(1) || '\\2', 'g'), chr(1))"


@query("f16_sentences", f"SELECT doc_id, CAST(len(s) AS INT) AS n, replace(s[1], chr(2), ' ') AS first FROM (SELECT doc_id, {_MARKED} AS s FROM documents)")
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = text.sentences(F.col("text"))
    return b.table(spark, sf_dir, "documents").select("doc_id", F.size(s).alias("n"), s[0].alias("first"))


@query("f17_plain_sentences", "SELECT doc_id, CAST(len([x FOR x IN string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) IF length(regexp_replace(x, '^\\s+|\\s+$', '', 'g')) >= 5]) AS INT) AS n FROM documents")
def plain_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").select("doc_id", F.size(text.plain_sentences(F.col("text"))).alias("n"))


HEADS = [
    (1, "# A *bold* Title\nSee doi: 10.1056/NEJMoa123, 2021. NCT01234567.", "file one"), (2, "No head. https://doi.org/10.1/x short 10.1234/abc.def). 1999", "file two"),
    (3, "", "file three"), (4, "## Second\nIn 1975 and 2035 nothing, 2029 yes NCT123", ""), (5, "x\n# Late_title\nDOI10.5555/12345678;", "five"),
]


@query("f22_f23_metadata", f"""
SELECT id, nullif(regexp_replace(coalesce(nullif(regexp_extract(substr(t, 1, 8000), '(?i)(?:doi\\.org/|doi:?\\s*)(10\\.\\d{{4,9}}/[^\\s,]+)', 1), ''), regexp_extract(substr(t, 1, 8000), '(10\\.\\d{{4,9}}/[^\\s,]+)', 1)), '[.,;)]+$', ''), '') AS doi,
 TRY_CAST(nullif(regexp_extract(substr(t, 1, 2000), '\\b(19[89]\\d|20[012]\\d)\\b', 1), '') AS INT) AS year, nullif(regexp_extract(substr(t, 1, 5000), 'NCT\\d{{7,8}}'), '') AS trial_id,
 coalesce(nullif(trim(regexp_replace(regexp_extract(substr(t, 1, 2000), '(?m)^#\\s+(.+)$', 1), '[*_`]', '', 'g')), ''), nullif(f, '')) AS title FROM {b.dealt_sql(HEADS, 'id t f', 't')}""")
def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, t = b.dealt(spark, sf_dir, HEADS, "id int, t string, f string", "t"), F.col("t")
    return d.select("id", text.doi(t).alias("doi"), text.year(t).alias("year"), text.trial_id(t).alias("trial_id"), text.title(t, F.col("f")).alias("title"))


_HEADED = "'# Report *' || source || '*' || chr(10) || CASE WHEN doc_id % 3 = 0 THEN 'In ' || (1960 + doc_id % 90) || ' ' ELSE '' END || CASE doc_id % 4 WHEN 0 THEN 'doi: 10.' || (1000 + doc_id) || '/x' || doc_id || '); ' WHEN 1 THEN 'see 10.5555/' || doc_id || ', ' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN 'NCT' || (10000000 + doc_id) ELSE '' END || chr(10) || text"


@query("f22_f23_documents", f"""
SELECT doc_id, nullif(regexp_replace(coalesce(nullif(regexp_extract(substr(t, 1, 8000), '(?i)(?:doi\\.org/|doi:?\\s*)(10\\.\\d{{4,9}}/[^\\s,]+)', 1), ''), regexp_extract(substr(t, 1, 8000), '(10\\.\\d{{4,9}}/[^\\s,]+)', 1)), '[.,;)]+$', ''), '') AS doi,
 TRY_CAST(nullif(regexp_extract(substr(t, 1, 2000), '\\b(19[89]\\d|20[012]\\d)\\b', 1), '') AS INT) AS year, nullif(regexp_extract(substr(t, 1, 5000), 'NCT\\d{{7,8}}'), '') AS trial_id,
 coalesce(nullif(trim(regexp_replace(regexp_extract(substr(t, 1, 2000), '(?m)^#\\s+(.+)$', 1), '[*_`]', '', 'g')), ''), source) AS title FROM (SELECT doc_id, source, {_HEADED} AS t FROM documents)""")
def document_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules of F22 and F23 over all documents, each under a heading with what its number gives."""
    t = F.col("t")
    d = b.table(spark, sf_dir, "documents").selectExpr("doc_id", "source", _HEADED.replace("chr(10)", "char(10)") + " AS t")
    return d.select("doc_id", text.doi(t).alias("doi"), text.year(t).alias("year"), text.trial_id(t).alias("trial_id"), text.title(t, F.col("source")).alias("title"))


AUTHORS = [(1, "A;B;C", None, 2020, 2019), (2, "A;B;C;D", "10.1/a", None, 2018), (3, "", "10.1/b", None, None), (4, "X", None, 1999, 2001)]


@query("f24_merged_metadata", f"SELECT id, CASE WHEN au <> '' THEN array_to_string((string_split(au, ';'))[1:3], ', ') || CASE WHEN len(string_split(au, ';')) > 3 THEN ' et al.' ELSE '' END END AS authors_str, coalesce(found, 'given') AS doi, coalesce(year, other) AS year FROM (SELECT * REPLACE (CASE WHEN au <> '' THEN au || ';' || source ELSE '' END AS au, other + n_chars % 5 AS other) FROM {b.dealt_sql(AUTHORS, 'id au found year other')})")
def merged_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pattern's DOI wins over the given one, its year only stands in."""
    d = b.dealt(spark, sf_dir, AUTHORS, "id int, au string, found string, year int, other int").withColumn("other", (F.col("other") + F.col("n_chars") % 5).cast("int"))
    d = d.withColumn("au", F.when(F.col("au") != "", F.concat("au", F.lit(";"), "source")).otherwise(F.lit("")))
    authors = F.when(F.col("au") != "", F.split("au", ";")).otherwise(F.array().cast("array<string>"))
    return d.select("id", text.authors_line(authors).alias("authors_str"), F.coalesce("found", F.lit("given")).alias("doi"), F.coalesce("year", "other").alias("year"))


@query("f26_sentence_ids", "SELECT doc_id, source || '::chunk-' || lpad(CAST(doc_id AS VARCHAR), CAST(greatest(4, length(CAST(doc_id AS VARCHAR))) AS INT), '0') AS sent_id FROM documents")
def sentence_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").select("doc_id", corpus.sent_id(F.col("source"), F.col("doc_id")).alias("sent_id"))


@query("p10_previews", "SELECT doc_id, CASE WHEN length(text) > 150 THEN substr(text, 1, 150) || '...' ELSE text END AS preview FROM documents")
def previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").select("doc_id", text.preview(F.col("text"), 150).alias("preview"))


NUMBERS = [
    (1, "12 (21%) and 26 (46%) relapsed; HR = 0.39, CI: 0.19-0.77; p=0.006"), (2, "32.6 % at p < .001, n = 450, 10mg and 4-fold, 2x"), (3, "none"), (4, "OR: 5.3 RR=1.5 µg 3 kg"), (5, "p ≤ 0.05 in 2021"),
]
_NUMERIC = numbers.PATTERN.replace("'", "''")
_NORMAL = r"lower(regexp_replace(regexp_replace(regexp_replace(trim(v), '\s*([<>=≤≥:])\s*', '\1', 'g'), '\s+%', '%', 'g'), '([<>=≤≥])\.(\d)', '\10.\2', 'g'))"


@query("m01_m04_numeric_values", f"SELECT id, pos, v, {_NORMAL} AS value FROM (SELECT id, unnest(r) AS v, CAST(unnest(range(0, len(r))) AS INT) AS pos FROM (SELECT id, [trim(x) FOR x IN regexp_extract_all(t, '(?i){_NUMERIC}')] AS r FROM {b.dealt_sql(NUMBERS, 'id t', 't')}))")
def numeric_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.dealt(spark, sf_dir, NUMBERS, "id int, t string", "t").select("id", F.posexplode(numbers.numeric_values(F.col("t"))).alias("pos", "v"))
    return d.select("id", "pos", "v", numbers.normalize_value(F.col("v")).alias("value"))


@query("m02_m03_numeric_tokens")
def numeric_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of all documents with place and context; citation marks and years are left out."""
    d = b.table(spark, sf_dir, "documents").select("doc_id", F.explode(numbers.numeric_tokens(F.col("text"))).alias("t"))
    return d.select("doc_id", "t.raw", "t.value", "t.start", "t.end", "t.context")


@query("m05_values_match", "SELECT event_id, abs(value - round(value)) <= 0.25 AS same FROM events")
def values_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, c = F.concat(F.col("value").cast("string"), F.lit("%")), F.round("value").cast("string")
    return b.table(spark, sf_dir, "events").select("event_id", numbers.values_match(a, c, 0.25).alias("same"))


@query("m06_approx_tokens", "SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents")
def approx_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").select("doc_id", numbers.approx_tokens(F.col("text")).alias("tokens"))


_PARA = "(SELECT doc_id, source, CAST(unnest(range(0, len(l))) AS INT) AS no, unnest(l) AS line FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents))"


def paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as chunks: ref_id is the document."""
    d = b.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref_id"), "source", F.posexplode(F.split("text", "\n")).alias("chunk_index", "text"))
    return d.withColumn("segment_type", F.when(F.col("chunk_index") % 5 == 4, "table").otherwise("text"))


@query("p06_kept_chunks", f"SELECT doc_id AS ref_id, line AS text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY no) - 1 AS INT) AS chunk_index FROM {_PARA} WHERE length(line) // 4 >= 3 OR no % 5 = 4")
def kept_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6 and W6."""
    return corpus.kept_chunks(paragraphs(spark, sf_dir)).select("ref_id", "text", F.col("chunk_index").cast("int").alias("chunk_index"))


@query("w06_next_chunks", f"SELECT doc_id AS ref_id, no AS chunk_index, lead(no) OVER (PARTITION BY doc_id ORDER BY no) AS next_index FROM {_PARA}")
def next_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.next_chunks(paragraphs(spark, sf_dir)).select("ref_id", "chunk_index", "next_index")


@query("p03_embeddable", f"SELECT doc_id AS ref_id, no AS chunk_index, (['text', 'table', 'figure', 'reference'])[no % 4 + 1] IN ('text', 'table') AS embeddable FROM {_PARA}")
def embeddable(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = b.pick(["text", "table", "figure", "reference"], F.col("chunk_index"))
    return paragraphs(spark, sf_dir).select("ref_id", "chunk_index", quality.embeddable(kind).alias("embeddable"))


@query("j01_registered", "SELECT doc_id, CASE WHEN CAST(substr(source, 4) AS INT) % 3 = 0 THEN 'PENDING' ELSE 'RT-30' || (CAST(substr(source, 4) AS INT) % 3) END AS rt_id FROM documents")
def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("ref_id"))
    n = F.regexp_extract("ref_id", r"(\d+)", 1).cast("int") % 3
    registry = d.select("ref_id").distinct().where(n != 0).select("ref_id", F.concat(F.lit("RT-30"), n).alias("rt_id"), F.lit("B3").alias("ref_category"))
    return corpus.registered(d, registry).select("doc_id", "rt_id")


@query("j09_w09_bibliography", f"""
WITH r AS (SELECT doc_id, no, trim(CASE WHEN no % 2 = 0 THEN (no + 7) || '. ' || line ELSE line END) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS place FROM {_PARA})
SELECT doc_id AS ref_id, CAST(place AS INT) AS place, CAST(coalesce(TRY_CAST(regexp_extract(t, '^(\\d+)\\.\\s+', 1) AS INT), place) AS INT) AS idx, substr(t, 1, 500) AS entry FROM r""")
def bibliography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries by their number, else by their place."""
    p = paragraphs(spark, sf_dir).withColumn("segment_type", F.lit("reference"))
    p = p.withColumn("text", F.when(F.col("chunk_index") % 2 == 0, F.concat(F.col("chunk_index") + 7, F.lit(". "), F.col("text"))).otherwise(F.col("text")))
    e = corpus.bibliography(p).select("ref_id", F.posexplode("doc_references").alias("place", "e"))
    return e.select("ref_id", (F.col("place") + 1).alias("place"), F.col("e.index").alias("idx"), F.col("e.text").alias("entry"))


@query("a08_sources", "SELECT source AS ref_id, arg_min('RT-' || (doc_id % 5), doc_id) AS rt_id, CAST(count(*) AS BIGINT) AS chunk_count FROM documents GROUP BY source")
def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.table(spark, sf_dir, "documents").select(F.col("source").alias("ref_id"), F.concat(F.lit("RT-"), F.col("doc_id") % 5).alias("rt_id"), F.col("doc_id").alias("chunk_index"))
    return corpus.sources(d)


@query("w08_packed_lines")
def packed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy groups of a document's lines, begun anew at 1,600 characters: a fold that Spark has as aggregate()."""
    groups = text.packed_groups(F.split("text", "\n"), fixed.TARGET_TOKENS * fixed.CHARS_PER_TOKEN)
    return b.table(spark, sf_dir, "documents").select("doc_id", groups.alias("groups"))


@query("f20_f21_chunks")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunker over all documents, each under a heading."""
    d = b.table(spark, sf_dir, "documents").select(F.concat_ws("-", "source", "doc_id").alias("ref_id"), F.concat(F.lit("# Results\n## "), F.col("lang"), F.lit("\n\n"), F.replace("text", F.lit("\n"), F.lit("\n\n"))).alias("markdown"))
    c = corpus.chunk_documents(d)
    return c.select("sent_id", "section", "segment_type", "chunk_index", "approx_tokens", "embeddable", F.size("numeric_tokens").alias("n_numbers"), F.md5("text").alias("digest"))


@query("s04_parsed_chunks", """
SELECT doc_id AS id, 'c' || doc_id AS chunk_id, CASE WHEN doc_id % 3 = 0 THEN 'table' ELSE 'text' END AS chunk_type, t AS text, CAST(CASE WHEN doc_id % 4 = 0 THEN 0 ELSE doc_id % 100 END AS INT) AS page, CASE WHEN doc_id % 2 = 0 THEN 0.75::DOUBLE END AS confidence
FROM (SELECT *, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS t FROM documents) WHERE t <> ''""")
def parsed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies made of the documents: a chunk with an anchor and the text, and one of an anchor alone."""
    c, n, none = F.concat(F.lit("c"), F.col("doc_id")), F.col("doc_id"), F.lit(None)
    anchor = F.concat(F.lit("<a id='"), c, F.lit("'></a>"))
    ground = F.when(n % 4 != 0, F.struct((n % 100).cast("int").alias("page"), F.create_map(F.lit("left"), F.lit(0.5)).alias("box")))
    first = F.struct(c.alias("id"), F.when(n % 3 == 0, "table").alias("type"), F.concat(anchor, F.lit(" "), F.col("text")).alias("markdown"), ground.alias("grounding"))
    second = F.struct(F.lit("x").alias("id"), none.cast("string").alias("type"), anchor.alias("markdown"), F.when(F.lit(False), ground).alias("grounding"))
    sure = F.when(n % 2 == 0, F.create_map(c, F.struct(F.lit(0.75).alias("confidence"))))
    replies = b.table(spark, sf_dir, "documents").select(n.alias("id"), F.to_json(F.struct(F.array(first, second).alias("chunks"), sure.alias("grounding"))).alias("r"))
    return readers.parsed_chunks(replies, "r").select("id", "chunk_id", "chunk_type", "text", "page", "confidence")


@query("s05_uncached", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def uncached(spark: SparkSession, sf_dir: str) -> DataFrame:
    cache = b.table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("quality") == 1, "{}").alias("body"))
    return readers.uncached(b.table(spark, sf_dir, "documents").select("doc_id"), cache, "doc_id")


@query("s09_point_ids")
def point_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return b.table(spark, sf_dir, "documents").select("doc_id", corpus.point_id(corpus.sent_id(F.col("source"), F.col("doc_id"))).alias("point_id"))


@query("s13_patched", "SELECT doc_id, CASE WHEN doc_id % 100 = 42 THEN 'src|patched' ELSE 'src' END AS tokens FROM documents")
def patched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload field of some points rewritten."""
    d = b.table(spark, sf_dir, "documents").select("doc_id", F.lit("src").alias("tokens"))
    patch = d.where("doc_id % 100 = 42").select("doc_id", F.lit("src|patched").alias("tokens"))
    return corpus.patched(d, patch, "doc_id", "tokens")


@query("p09_payload_fields", "SELECT doc_id, coalesce(nullif(lang, 'en'), nullif(source, '')) AS author, coalesce(NULL, CAST(n_chars AS VARCHAR)) AS page, concat_ws(', ', source, lang) AS label FROM documents")
def payload_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.table(spark, sf_dir, "documents").select("doc_id", F.struct(F.nullif("lang", F.lit("en")).alias("authors_str"), F.array("source", "lang").alias("authors"), F.lit(None).cast("string").alias("page_range")).alias("doc_metadata"), "source", "n_chars")
    return d.select("doc_id", F.coalesce("doc_metadata.authors_str", F.nullif("source", F.lit(""))).alias("author"), F.coalesce("doc_metadata.page_range", F.col("n_chars").cast("string")).alias("page"), F.array_join("doc_metadata.authors", ", ").alias("label"))


@query("f30_passages")
def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of each source in one prompt text: head lines, then the cleaned text."""
    c = b.chunks(spark, sf_dir).withColumn("n", F.row_number().over(Window.partitionBy("ref_id").orderBy("id"))).where("n <= 5")
    per = corpus.passages(c, "ref_id")
    return per.select("ref_id", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("digest"))


@query("s01_file_stems", "SELECT page_id, regexp_replace(regexp_extract(url, '([^/]+)$', 1), '\\.[^.]+$', '') AS stem FROM pages")
def file_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of a file is its name without the ending."""
    return b.table(spark, sf_dir, "pages").select("page_id", readers.stem(F.col("url")).alias("stem"))


#: Golden cases: a document, and what must come out.
TABLES = [
    (1, "Table 2 Doses\n<table>\n1\n</table>\nend", "Table 2 Doses\n<table>\n1\n</table>\nend"),
    (2, "Figure 2\n<table>\n1\n</table>\nend", "Figure 2\nend"),
    (3, "table 9\n\n\nx\n<TABLE>1</TABLE>\n<table>\n2\n</table>", "table 9\n\n\nx\n<TABLE>1</TABLE>\n<table>\n2\n</table>"),
    (4, "Table 1\na\nb\nc\nd\ne\nf\ng\nh\n<table>\n1\n</table>", "Table 1\na\nb\nc\nd\ne\nf\ng\nh"),
]


@query("f03_real_tables", f"SELECT id, kept FROM {b.dealt_sql(TABLES, 'id t kept', 'kept')}")
def real_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = b.dealt(spark, sf_dir, [r[:2] for r in TABLES], "id int, t string", "t")
    return d.select("id", markdown.without_fake_tables(F.col("t")).alias("kept"))


DEEP = "# " + "A" * 30 + "\n# Empty\n## " + "B" * 30 + "\nwords of a text\n### " + "C" * 30 + "\nwords of the text\n#### " + "D" * 90 + "\nmore words of text"
PARTS = [
    (1, "# References\n1. Smith A. One. 2. Jones B. Two.", [("reference", "References", "1. Smith A. One."), ("reference", "References", "2. Jones B. Two.")]),
    (2, "# Notes\n1. Smith A. One. 2. Jones B. Two.", [("text", "Notes", "[Notes]\n1. Smith A. One. 2. Jones B. Two.")]),
    (3, DEEP, [("text", "B" * 30, f"[{'B' * 30}]\nwords of a text"), ("text", f"{'B' * 30} > {'C' * 30}", f"[{'B' * 30} > {'C' * 30}]\nwords of the text"), ("text", f"{'B' * 30} > {'C' * 30} > {'D' * 90}", f"[{'D' * 77}...]\nmore words of text")]),
]
_GOLD = [(i, n, kind, section, t) for i, _, out in PARTS for n, (kind, section, t) in enumerate(out)]


@query("f18_f19_entries_and_prefixes", f"SELECT d.doc_id AS id, chunk_index, segment_type, section, replace(replace(g.text, 'One', 'One' || d.source), 'words', 'words' || d.source) AS text FROM documents d JOIN (SELECT * FROM {b.values(_GOLD, 'id', 'chunk_index', 'segment_type', 'section', 'text')}) g ON g.id = d.doc_id % {len(PARTS)} + 1")
def entries_and_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bibliography entries of one paragraph; headings without text drop out of paths, which are cut to 80
    characters."""
    d = b.dealt(spark, sf_dir, [r[:2] for r in PARTS], "id int, t string")
    for word in ("One", "words"):
        d = d.withColumn("t", F.replace("t", F.lit(word), F.concat(F.lit(word), F.col("source"))))
    return d.select("id", F.explode(markdown.markdown_chunks(F.col("t"))).alias("c")).select("id", "c.chunk_index", "c.segment_type", "c.section", "c.text")


_ROWS = [f"<tr><td>{'x' * 390}{i}</td></tr>" for i in range(6)]
_HEAD = "<table><thead><tr><th>H</th></tr></thead>"
SPLIT = [(1, _HEAD + "<tbody>" + "".join(_ROWS) + "</tbody></table>", [3, 3]), (2, "| h |\n|---|\n" + "\n".join(f"| {'y' * 390} |" for _ in range(6)), [4, 2]), (3, _HEAD + "</table>", [0])]


@query("f21_table_splits", f"SELECT d.doc_id AS id, part, n_rows FROM documents d JOIN (SELECT * FROM {b.values([(i, n, k) for i, _, out in SPLIT for n, k in enumerate(out)], 'id', 'part', 'n_rows')}) g ON g.id = d.doc_id % {len(SPLIT)} + 1")
def table_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large tables by groups of rows: data rows in each part."""
    d = b.dealt(spark, sf_dir, [r[:2] for r in SPLIT], "id int, t string")
    for head in ("<th>H", "| h"):
        d = d.withColumn("t", F.replace("t", F.lit(head), F.concat(F.lit(head), F.col("source"))))
    c = d.select("id", F.explode(markdown.markdown_chunks(F.col("t"))).alias("c"))
    return c.select("id", F.col("c.chunk_index").alias("part"), F.regexp_count("c.text", F.lit("<td>|y{390}")).alias("n_rows"))
