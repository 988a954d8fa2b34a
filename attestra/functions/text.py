"""Text expressions: cleaning, tokens, stems, keywords, metadata."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from attestra import fixed
from attestra.functions.mapped import of_texts

SPACES = r"[\xa0 -​  　]"


def plain_unicode(c: Column) -> Column:
    """Dashes, spaces and middle dots made plain, white space collapsed; what NFKC leaves over."""
    c = F.regexp_replace(F.translate(c, "—–·", "--."), SPACES, " ")
    return F.coalesce(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(""))


def nfkc(c: Column) -> Column:
    """Compatibility composition; Spark has no function for it."""
    return of_texts(lambda t: None if t is None else unicodedata.normalize("NFKC", t), "string")(c)


def normalize_unicode(c: Column) -> Column:
    """NFKC first: it turns unbreakable spaces into spaces."""
    return plain_unicode(nfkc(c))


def strip_page_furniture(c: Column) -> Column:
    return F.regexp_replace(c, fixed.PAGE_FURNITURE, "")


def strip_images(c: Column) -> Column:
    """Image references with over 20 characters of description, not of a logo, become figures; others go."""
    told = F.regexp_replace(c, r"(?i)!\[\s*((?=[^\]]{21,})(?![^\]]*logo\s*\])[^\]\s](?:[^\]]{19,}[^\]\s]))\s*" + fixed.IMAGE_END, r"[Figure: $1]")
    return F.regexp_replace(told, r"(?i)!\[[^\]]*" + fixed.IMAGE_END, "")


def collapse_blank_lines(c: Column) -> Column:
    return F.regexp_replace(c, fixed.BLANK_LINES, "\n\n")


def strip_anchors(c: Column) -> Column:
    """Without empty anchor tags, trimmed."""
    return F.regexp_replace(F.regexp_replace(c, fixed.ANCHOR, ""), r"^\s+|\s+$", "")


def strip_html(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(c, fixed.TAG, " "), r"\s+", " "))


def clean_evidence(c: Column) -> Column:
    """Without tags and emphasis; blanks collapsed."""
    c = F.regexp_replace(c, fixed.TAG, "")
    for pattern in fixed.EMPHASIS:
        c = F.regexp_replace(c, pattern, "$1")
    return F.regexp_replace(F.regexp_replace(c, r" {2,}", " "), r"^\s+|\s+$", "")


def clean_passage(c: Column) -> Column:
    """Without formatting tags, emphasis and heading marks; blanks collapsed."""
    c = F.regexp_replace(c, fixed.FORMAT_TAG, "")
    for pattern in fixed.EMPHASIS_PAIRS:
        c = F.regexp_replace(c, pattern, "$1")
    c = F.regexp_replace(c, fixed.HEADING_MARK, "")
    return F.regexp_replace(F.regexp_replace(c, r"  +", " "), r"^\s+|\s+$", "")


def packed_groups(parts: Column, most: int) -> Column:
    """Number of greedy groups of an array of texts: a group is begun anew when a part would bring it over
    ``most`` characters."""
    start = F.struct(F.lit(0).alias("size"), F.lit(0).alias("groups"))

    def add(acc: Column, part: Column) -> Column:
        full = (acc["size"] > 0) & (acc["size"] + F.length(part) > most)
        return F.struct(F.when(full, F.length(part)).otherwise(acc["size"] + F.length(part)).alias("size"), (acc["groups"] + F.when(full | (acc["groups"] == 0), 1).otherwise(0)).alias("groups"))

    return F.aggregate(parts, start, add, lambda a: a["groups"])


def raw_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(fixed.TOKEN), F.lit(0))


def stem(name: str) -> Column:
    """The irregular form of a word, or its first suffix that fits replaced, of a column by its name.

    Suffixes stand under their last letter, in their order, and irregular words in one set, so most words are
    told by a few comparisons of one byte.  As text it is parsed at once; built call by call it takes a second.
    """
    words = ", ".join(f"'{w}'" for w in fixed.IRREGULAR_STEMS)
    roots = " ".join(f"WHEN '{w}' THEN '{root}'" for w, root in fixed.IRREGULAR_STEMS.items())
    by_letter: dict[str, list[str]] = {}
    for suffix, new in fixed.SUFFIXES:
        rule = f"WHEN endswith({name}, '{suffix}') AND length({name}) >= {len(suffix) + 2} THEN concat(left({name}, length({name}) - {len(suffix)}), '{new}')"
        by_letter.setdefault(suffix[-1], []).append(rule)
    letters = " ".join(f"WHEN endswith({name}, '{c}') THEN CASE {' '.join(rules)} ELSE {name} END" for c, rules in by_letter.items())
    return F.expr(f"CASE WHEN length({name}) <= 3 THEN {name} WHEN {name} IN ({words}) THEN CASE {name} {roots} END {letters} ELSE {name} END")


def unstemmed(c: Column) -> Column:
    """What may have been stemmed to a word: itself, irregular words, and its root with each suffix.  ``stem`` tells which of them are."""
    root = lambda new: F.when(c.endswith(new), c.substr(F.lit(1), F.length(c) - len(new)))
    forms = [F.concat(root(new), F.lit(suffix)) for suffix, new in fixed.SUFFIXES] + [F.when(c == r, F.lit(w)) for w, r in fixed.IRREGULAR_STEMS.items()]
    return F.array_distinct(F.array_compact(F.array(c, *forms)))


def index_token(c: Column) -> Column:
    """Whether a raw token is indexed."""
    return (F.length(c) >= 2) & ~c.isin(fixed.INDEX_STOPWORDS)


def keywords(c: Column, most: int = 10) -> Column:
    """The first distinct keywords in their order."""
    kept = F.filter(raw_tokens(c), lambda t: (F.length(t) >= 2) & ~t.isin(fixed.KEYWORD_STOPWORDS))
    return F.slice(F.array_distinct(kept), 1, most)


def _without(c: Column, words: list[str]) -> Column:
    return F.filter(c, lambda t: ~t.isin(words))


def all_keywords(c: Column) -> Column:
    """At most eight words of an array for the all-keyword search; the first five if all are noise."""
    kept = F.filter(c, lambda t: ~t.isin(fixed.ALL_KEYWORD_NOISE) & (F.length(t) >= 3))
    return F.slice(F.when(F.size(kept) > 0, kept).otherwise(F.slice(c, 1, 5)), 1, 8)


def any_keywords(c: Column) -> Column:
    """Up to 14 words for the any-keyword search: twelve specific ones, then four common ones."""
    noise = fixed.REWRITER_NOISE + fixed.COMMON_CLINICAL
    specific = F.filter(c, lambda t: ~t.isin(noise) & (F.length(t) > 2))
    common = F.filter(c, lambda t: t.isin(fixed.COMMON_CLINICAL) & ~t.isin(fixed.REWRITER_NOISE))
    picked = F.slice(F.concat(F.slice(specific, 1, 12), F.slice(common, 1, 4)), 1, 14)
    return F.when(F.size(picked) > 0, picked).otherwise(F.slice(_without(c, fixed.REWRITER_NOISE), 1, 6))


def inflections(t: Column) -> Column:
    """A word and its other forms, by its ending; shorter than three letters: none."""

    def cut(n: int, *ends: str) -> list[Column]:
        root = t.substr(F.lit(1), F.length(t) - n)
        return [F.concat(root, F.lit(e)) for e in ends]

    none = F.array().cast("array<string>")
    forms = (
        F.when(t.endswith("ed"), F.array(*cut(2, "", "e", "ing"), *cut(1, "")))
        .when(t == "frozen", F.array(*cut(2, "", "e"), *cut(1, "ing"), F.lit("freeze")))
        .when(t.endswith("en"), F.array(*cut(2, "", "e"), *cut(1, "ing")))
        .when(t.endswith("ing"), F.array(*cut(3, "", "e", "ed")))
        .when(t.endswith("s") & ~t.endswith("ss"), F.array(*cut(1, "")))
        .when(t.endswith("tion"), F.array(*cut(4, "t", "ted")))
        .otherwise(none)
    )
    silent = F.when((F.length(t) >= 4) & ~t.endswith("e"), F.array(F.concat(t, F.lit("e")))).otherwise(none)
    return F.filter(F.concat(F.array(t), forms, silent), lambda x: F.length(x) >= 3)


def capitalised(c: Column, stopwords: list[str]) -> Column:
    """Distinct lower-cased words that begin with a capital and may name a product."""
    found = F.transform(F.regexp_extract_all(c, F.lit(fixed.CAPITALISED), F.lit(0)), F.lower)
    return F.array_distinct(F.filter(found, lambda t: (F.length(t) >= 3) & ~t.isin(stopwords)))


def token_index(c: Column) -> Column:
    """The first 32 bits of a token's MD5."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def sentences(c: Column) -> Column:
    """Parts that end with a stop before white space and a capital, joined again after abbreviations."""
    parts = F.split(c, fixed.SENTENCE_END)
    last_word = lambda s: F.regexp_extract(F.regexp_replace(s, r"[.!? ]+$", ""), r"(\S+)\s*$", 1)

    def add(acc: Column, part: Column) -> Column:
        glue = (F.size(acc) > 0) & last_word(F.element_at(acc, -1)).isin(fixed.ABBREVIATIONS)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", F.element_at(acc, -1), part)))
        return F.when(F.coalesce(glue, F.lit(False)), joined).otherwise(F.concat(acc, F.array(part)))

    return F.aggregate(parts, F.array().cast("array<string>"), add)


def plain_sentences(c: Column) -> Column:
    """Parts that end with a stop before white space, trimmed, of five characters and more."""
    parts = F.transform(F.split(c, fixed.PLAIN_SENTENCE_END), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(parts, lambda s: F.length(s) >= 5)


def _first(c: Column, reach: int, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(F.substring(c, 1, reach), pattern, group), F.lit(""))


def doi(c: Column) -> Column:
    told = _first(c, 8000, fixed.DOI_TOLD, 1)
    return F.regexp_replace(F.coalesce(told, _first(c, 8000, fixed.DOI_BARE, 1)), fixed.DOI_END, "")


def year(c: Column) -> Column:
    return _first(c, 2000, fixed.YEAR, 1).cast("int")


def trial_id(c: Column) -> Column:
    return _first(c, 5000, fixed.TRIAL_ID, 0)


def title(c: Column, fallback: Column) -> Column:
    found = F.trim(F.regexp_replace(_first(c, 2000, fixed.TITLE, 1), fixed.TITLE_MARKS, ""))
    return F.coalesce(F.nullif(found, F.lit("")), F.nullif(fallback, F.lit("")))


def authors_line(authors: Column) -> Column:
    """The first three authors, and others."""
    some = F.array_join(F.slice(authors, 1, 3), ", ")
    return F.when(F.size(authors) > 0, F.when(F.size(authors) > 3, F.concat(some, F.lit(" et al."))).otherwise(some))


def citation(authors: Column, title_: Column, journal: Column, year_: Column, doi_: Column, ref_id: Column) -> Column:
    """Authors. Title. Journal Year. doi:..., or the source's id when there is none of these."""
    full = lambda c: F.nullif(c.cast("string"), F.lit(""))
    when_ = F.when(full(journal).isNotNull() & full(year_).isNotNull(), F.concat_ws(" ", journal, year_.cast("string"))).otherwise(full(year_))
    parts = F.concat_ws(". ", authors_line(authors), full(title_), when_, F.concat(F.lit("doi:"), full(doi_)))
    return F.when(parts != "", F.concat(parts, F.lit("."))).otherwise(F.coalesce(ref_id, F.lit("Unknown")))


def preview(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit("..."))).otherwise(c)


def json_object(c: Column) -> Column:
    """The JSON in a reply: without its code fence, else its first object."""
    bare = F.trim(F.regexp_replace(c, r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", ""))
    return F.when(bare.startswith("{"), bare).otherwise(F.nullif(F.regexp_extract(bare, fixed.JSON_OBJECT, 0), F.lit("")))


def one_of(c: Column, words: list[str]) -> Column:
    """Whether a text holds any of the words."""
    return reduce(lambda a, b: a | b, (c.contains(w) for w in words))
