"""Source divergence audit: how each source's words differ from its language and from other sources."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.llm.common import bound_batches, materialise, runs_of_key, table

#: Runs of ASCII letters and of characters beyond ASCII, as UTF-8 bytes.
TERM = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCALE, SMOOTH = 1_000_000_000, 5
#: Bytes of a text that are matched at once; counts that a task holds before it passes them on.
PIECE, HELD = 1 << 20, 200_000
#: Rows of one per group that are sent to every task; more are joined by shuffle.
SENT = 100_000
#: Bits of a value that one histogram is over.
DIGIT = 10


def _pieces(text: bytes) -> Iterator[bytes]:
    """A text in pieces that cut no term, so that a long one is not a list of all its words at once."""
    start = 0
    while len(text) - start > PIECE:
        cut = start + PIECE
        gap = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]").search(text, cut)
        if not gap:
            break
        yield text[start : gap.start()]
        start = gap.start()
    yield text[start:]


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it); summed in each task first, so one language or
    source with most rows leaves a task as its vocabulary only."""
    bound_batches(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = {}
        d: dict[tuple, Counter] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for group, c in n.items():
                terms, k = list(c), len(c)
                cols = [pa.array([group[0]] * k, pa.string()), pa.array([group[1]] * k, pa.string()), pa.array(terms, pa.binary())]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(list(c.values()), pa.int64()), pa.array([d[group][t] for t in terms], pa.int64())], ["lang", "source", "term", "n", "docs"])
            n.clear()
            d.clear()

        for b in batches:
            for text, lang, source in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own: Counter = Counter()
                for piece in _pieces(text.lower()):  # bytes.lower changes A-Z alone
                    own.update(TERM.findall(piece))
                if own:
                    n.setdefault((lang, source), Counter()).update(own)
                    d.setdefault((lang, source), Counter()).update(own.keys())
            if sum(map(len, n.values())) > HELD:
                yield from out()
        yield from out()

    read = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    read = read.select(F.col("text").cast("binary").alias("text"), "lang", "source")
    parts = read.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    # one exchange serves this sum and the window over (lang, term) that follows
    return parts.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(docs: DataFrame, least: int) -> DataFrame:
    """lang, source, term, n, n_lang, first (1 in one row of each lang's term): terms in ``least`` documents of
    their language or more."""
    of_term = Window.partitionBy("lang", "term")
    counted = term_counts(docs).withColumn("n_lang", F.sum("n").over(of_term)).withColumn("docs", F.sum("docs").over(of_term))
    counted = counted.withColumn("first", (F.col("source") == F.min("source").over(of_term)).cast("int"))
    return counted.where(F.col("docs") >= least).select("lang", "source", F.col("term").cast("string").alias("term"), "n", "n_lang", "first")


def share(count: str, total: str, terms: str) -> Column:
    """1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)), exactly; null where there are no terms."""
    up, over = f"cast({count} + {SMOOTH} as decimal(19,0)) * {SCALE}", f"cast({total} + {SMOOTH} * {terms} as decimal(19,0))"
    return F.expr(f"1 + ({up}) div nullif({over}, 0)")


def attach(rows: DataFrame, per_group: DataFrame, keys: list[str], small: bool) -> DataFrame:
    """rows with what there is for their group.  Groups are sent to every task if they were counted and are few."""
    return rows.join(F.broadcast(per_group) if small else per_group, keys)


def group_sizes(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, source, total (occurrences of kept terms), held (kept terms that occur), terms (of the language), lang_total and
    base (the share of a kept term that does not occur) of every group, with kept terms or without."""
    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source"))).distinct()
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"), F.sum("first").alias("first"))
    langs = sums.groupBy("lang").agg(F.sum("first").alias("terms"), F.sum("total").alias("lang_total"))
    joined = groups.join(sums.drop("first"), ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "held", "terms", "lang_total"])
    return joined.withColumn("base", share("0", "total", "terms"))


def radix_top(rows: DataFrame, keys: list[str], value: str, item: str, k: int, small: bool) -> DataFrame:
    """Of each group the k rows with the greatest values, ties to the smaller item by UTF-8 bytes.

    Radix selection: a histogram over DIGIT bits of the values, summed in the tasks first, shows in which of its
    cells each group's k-th value lies; the next is over the next bits of that cell alone.  Where more rows than
    are wanted have the k-th value itself, histograms over the bytes of their items go on in the same way, past what
    all of a cell have in common.  So no group is sorted or gathered, whatever its size.
    Values are longs from 0; items of a group differ.  Rows are read once for each histogram: materialise them.
    """
    top = rows.agg(F.max(value)).first()[0]
    if top is None:
        return rows
    state = done = None
    for shift in reversed(range(0, max(1, top.bit_length()), DIGIT)):
        if state is None:
            inside = rows.withColumn("_low", F.lit(0).cast("long")).withColumn("_need", F.lit(k).cast("long"))
        else:
            inside = attach(rows, state.select(*keys, "_low", "_need"), keys, small).where(F.col(value).between(F.col("_low"), F.col("_low") + (1 << (shift + DIGIT)) - 1))
        cells = inside.groupBy(*keys, "_low", "_need", F.shiftright(F.col(value) - F.col("_low"), shift).alias("_cell")).agg(F.count("*").alias("_n"))
        down = Window.partitionBy(*keys).orderBy(F.desc("_cell")).rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("_above", F.coalesce(F.sum("_n").over(down), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))
        cells = cells.where((F.col("_above") < F.col("_need")) & (F.col("_above") + F.col("_n") >= F.least("_need", "_all")))
        few = F.col("_all") <= F.col("_need")
        low = F.when(few, F.col("_low")).otherwise(F.col("_low") + F.shiftleft(F.col("_cell"), shift))
        need = F.col("_need") - F.col("_above")
        found = materialise(cells.select(*keys, low.alias("_low"), need.alias("_need"), (~few & (F.col("_n") > need)).alias("_open")))
        ready = found.where("not _open").select(*keys, "_low")
        done = ready if done is None else done.union(ready)
        state = found.where("_open")
        if state.isEmpty():
            break
    # what is still open has more rows of its k-th value than it needs
    ends = done.withColumn("_last", F.lit(None).cast("binary"))
    bytes_ = F.col(item).cast("binary")
    tied = materialise(attach(rows, state.select(*keys, "_low", "_need"), keys, small).where(F.col(value) == F.col("_low")).select(*keys, bytes_.alias("_item"), "_low"))
    state = state.select(*keys, "_low", "_need", F.lit(b"").alias("_prefix"))
    while not state.isEmpty():
        size = F.length("_prefix")
        inside = attach(tied, state.drop("_low"), keys, small).where(F.substring("_item", F.lit(1), size) == F.col("_prefix"))
        cells = inside.groupBy(*keys, "_low", "_need", "_prefix", F.substring("_item", size + 1, F.lit(1)).alias("_cell")).agg(F.count("*").alias("_n"), F.min("_item").alias("_from"), F.max("_item").alias("_to"))
        up = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
        cells = cells.withColumn("_below", F.coalesce(F.sum("_n").over(up), F.lit(0))).where((F.col("_below") < F.col("_need")) & (F.col("_below") + F.col("_n") >= F.col("_need")))
        shorter = F.least(F.length("_from"), F.length("_to"))
        differ = F.array_position(F.transform(F.sequence(F.lit(1), shorter), lambda i: F.substring("_from", i, F.lit(1)) == F.substring("_to", i, F.lit(1))), F.lit(False))
        common = F.substring("_from", F.lit(1), F.when(differ == 0, shorter).otherwise(differ - 1).cast("int"))
        need = F.col("_need") - F.col("_below")
        found = materialise(cells.select(*keys, "_low", need.alias("_need"), common.alias("_prefix"), F.col("_to").alias("_last"), (F.col("_n") > need).alias("_open")))
        ends = ends.union(found.where("not _open").select(*keys, "_low", "_last"))
        state = found.where("_open").drop("_open", "_last")
    joined = attach(rows, ends, keys, small)
    in_tie = F.col("_last").isNull() | (bytes_ <= F.col("_last"))
    return joined.where((F.col(value) > F.col("_low")) | ((F.col(value) == F.col("_low")) & in_tie)).drop("_low", "_last")


def shared_corrections(entries: DataFrame) -> DataFrame:
    """lang, a, b, value: over the terms that occur in both sources a < b, what |p - p'| is more than the parts that
    each source's own terms give (``own_parts``).  Rows of a term meet in one task, as many as there are sources of its
    language; pairs are summed there, so pairs of sources leave it, not pairs for every term."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs_of_key(batches, "key", 100_000):
            t = t.combine_chunks()
            lang, term, source = (t[c].chunk(0).dictionary_encode() if t[c].num_chunks else pa.array([], pa.string()).dictionary_encode() for c in ("lang", "term", "source"))
            code = [x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (lang, term, source)]
            run_ = np.cumsum(np.append(True, (code[0][1:] != code[0][:-1]) | (code[1][1:] != code[1][:-1])))
            group, who = np.unique(code[0] * len(source.dictionary) + code[2], return_inverse=True)
            p, base = t["p"].to_numpy(), t["base"].to_numpy()
            names, sums = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            live, d = np.flatnonzero(run_[1:] == run_[:-1]), 1
            while len(live):
                i, j = live, live + d
                more = np.abs(p[i] - p[j]) - np.abs(p[i] - base[j]) - np.abs(p[j] - base[i]) + np.abs(base[i] - base[j])
                names, at = np.unique(np.concatenate((names, who[i] * len(group) + who[j])), return_inverse=True)
                summed = np.zeros(len(names), dtype=np.int64)
                np.add.at(summed, at, np.concatenate((sums, more)))
                sums, d = summed, d + 1
                live = live[live + d < len(run_)]
                live = live[run_[live] == run_[live + d]]
            a, b = group[names // len(group)], group[names % len(group)]
            many = len(source.dictionary)
            cols = [lang.dictionary.take(pa.array(a // many)), source.dictionary.take(pa.array(a % many)), source.dictionary.take(pa.array(b % many)), pa.array(sums)]
            yield pa.RecordBatch.from_arrays(cols, ["lang", "a", "b", "value"])

    keyed = entries.select(F.xxhash64("lang", "term").alias("key"), "lang", "term", "source", "p", "base")
    return keyed.repartition("key").sortWithinPartitions("key", "lang", "term", "source").mapInArrow(run, "lang string, a string, b string, value long")


def source_pairs(groups: DataFrame, small: bool) -> DataFrame:
    """lang, a, b and what their groups have: every ordered pair of sources of a language, as many as the result has."""
    one = groups.select("lang", F.col("source").alias("a"), F.col("base").alias("base_a"), "held", "terms")
    other = groups.select("lang", F.col("source").alias("b"), F.col("base").alias("base_b"))
    if small:
        return one.join(F.broadcast(other), "lang").where("a <> b")
    one = one.withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(64)))
    return one.join(other.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(63)).cast("array<long>"))), ["lang", "salt"]).where("a <> b").drop("salt")


def own_parts(entries: DataFrame, pairs: DataFrame) -> DataFrame:
    """lang, a, b, value: sum of |p - b's base| over the terms of a, less what as many terms that neither has would give.
    Running sums over a's distinct shares, in which the bases of the other sources are looked up."""
    shares = entries.groupBy("lang", F.col("source").alias("a"), F.col("p").alias("at")).agg(F.count("*").alias("n"))
    none = F.lit(None)
    shares = shares.select("lang", "a", "at", "n", none.cast("string").alias("b"), none.cast("long").alias("base_a"))
    asked = pairs.where("held > 0").select("lang", "a", F.col("base_b").alias("at"), F.lit(0).cast("long").alias("n"), "b", "base_a")
    of_a = Window.partitionBy("lang", "a")
    upto = of_a.orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    amount = F.col("n") * F.col("at")
    both = shares.union(asked).withColumn("n_to", F.sum("n").over(upto)).withColumn("s_to", F.sum(amount).over(upto)).withColumn("n_all", F.sum("n").over(of_a)).withColumn("s_all", F.sum(amount).over(of_a))
    far = F.col("at") * (2 * F.col("n_to") - F.col("n_all")) + F.col("s_all") - 2 * F.col("s_to")
    return both.where("b is not null").select("lang", "a", "b", (far - F.col("n_all") * F.abs(F.col("base_a") - F.col("at"))).alias("value"))


def divergence(docs: DataFrame, least: int = 30, top: int = 50) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: for every other source of the language, how far the shares of all kept terms are apart in sum.
    Part ``term``: the ``top`` terms of which a source has more than its language.  Shares are exact integers of
    SCALE; kept terms are in ``least`` documents of the language.

    Pairs are sparse: a term that neither source has adds the distance of their two bases, so only terms that occur are
    looked at, once for each source and once for sources that share them.  Ranks of terms by ``radix_top``.

    Null text, lang and source are empty strings; a document without a term still makes its group, whose pairs have value
    by its base, or 0 where the language keeps no term.  Repeated rows count as often as they are there; extra columns are
    not read; long texts are matched in pieces that cut no term.  Ties go to the smaller item.  No rows: no rows.
    """
    kept = materialise(kept_terms(docs, least))
    groups = materialise(group_sizes(docs, kept))
    small = groups.limit(SENT + 1).count() <= SENT
    keys = ["lang", "source"]
    sized = attach(kept.drop("first"), groups, keys, small).withColumn("p", share("n", "total", "terms")).withColumn("q", share("n_lang", "lang_total", "terms"))
    entries = materialise(sized.select("lang", "source", "term", "p", "q", "base"))

    pairs = source_pairs(groups, small)
    apart = F.abs(F.col("base_a") - F.col("base_b")) * F.col("terms")
    parts = pairs.where("a < b").select("lang", "a", "b", F.coalesce(apart, F.lit(0)).alias("value"))
    parts = parts.union(shared_corrections(entries))
    own = own_parts(entries, pairs).select("lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "value")
    summed = parts.union(own).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pair = summed.withColumn("w", ways).select("lang", "w.source", F.lit("pair").alias("part"), "w.item", "value")

    more = materialise(entries.where("p > q").select(*keys, (F.col("p") - F.col("q")).alias("value"), F.col("term").alias("item")))
    term = radix_top(more, keys, "value", "item", top, small).select(*keys, F.lit("term").alias("part"), "item", "value")
    rank = F.row_number().over(Window.partitionBy(*keys, "part").orderBy(F.desc("value"), "item"))
    return pair.union(term).withColumn("rank", rank)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents
), occurrence AS (
  SELECT row, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*) AS n FROM occurrence GROUP BY lang, term HAVING count(DISTINCT row) >= 30
), size AS (
  SELECT lang, CAST(count(*) AS HUGEINT) AS v, CAST(sum(n) AS HUGEINT) AS total FROM kept GROUP BY lang
), found AS (
  SELECT lang, source, term, count(*) AS n FROM occurrence SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), grp AS (
  SELECT g.lang, g.source, coalesce(sum(f.n), 0) AS total
  FROM (SELECT DISTINCT lang, source FROM d) g LEFT JOIN found f USING (lang, source) GROUP BY g.lang, g.source
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(f.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(f.n, 0) + 5)) // (g.total::HUGEINT + 5 * s.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 5)) // (s.total + 5 * s.v) AS q
  FROM grp g JOIN kept k USING (lang) JOIN size s USING (lang) LEFT JOIN found f USING (lang, source, term)
), pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(e.value, 0) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS a, y.source AS b, sum(abs(x.p - y.p)) AS value
             FROM dense x JOIN dense y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) e
  ON e.lang = a.lang AND e.a = a.source AND e.b = b.source
), term AS (
  SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM dense WHERE n > 0 AND p > q
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
  FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""
