"""Lexical search: postings, BM25, all-keyword and any-keyword matching."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from attestra import fixed
from attestra.functions import scores, text
from attestra.operators.ranking import Best
from attestra.session import in_blocks, in_slices, kept, spread


def terms(docs: DataFrame, id_: str, body: str) -> DataFrame:
    """id, token: one row per occurrence of an indexed token, stemmed."""
    raw = docs.select(F.col(id_).alias("id"), F.explode(text.raw_tokens(F.col(body))).alias("raw"))
    return raw.where(text.index_token(F.col("raw"))).select("id", text.stem("raw").alias("token"))


def _read(docs: DataFrame, id_: str, body: str, *more: str) -> DataFrame:
    """row (a number), id, more columns, raw (tokens as they stand): one pass, nothing is gathered."""
    rows = spread(docs.select(F.col(id_).alias("id"), *more, F.col(body).alias("body")))
    return rows.select(F.monotonically_increasing_id().alias("row"), "id", *more, text.raw_tokens(F.col("body")).alias("raw"))


def _occurrences(read: DataFrame, *more: str) -> DataFrame:
    """row, id, more columns, token: one row per occurrence of an indexed token, documents one after the other."""
    rows = read.select("row", "id", *more, F.explode("raw").alias("raw")).where(text.index_token(F.col("raw")))
    return rows.select("row", "id", *more, text.stem("raw").alias("token"))


def _documents(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Occurrences as tables of whole documents: the last of a batch may go on in the next."""
    waiting: list[pa.RecordBatch] = []
    name = -1
    for b in batches:
        row = b.column(0).to_numpy()
        if not len(row):
            continue
        if waiting and row[-1] == name:
            waiting.append(b)
            continue
        cut = int(np.searchsorted(row, row[-1]))
        if waiting or cut:
            yield pa.Table.from_batches([*waiting, b.slice(0, cut)]).combine_chunks()
        waiting, name = [b.slice(cut)], row[-1]
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def counted(docs: DataFrame, id_: str, body: str, *more: str) -> DataFrame:
    """id, more columns, dl, words (the document's indexed tokens, each once, joined by blanks), tfs: a row for each document that has a token.

    A document's tokens are counted where it is read, some documents at a time, so nothing is exchanged and a task holds no table of counts.
    """
    rows = _occurrences(_read(docs, id_, body, *more), *more)
    names = ["id", *more]
    kind = StructType([*(rows.schema[c] for c in names), StructField("dl", LongType()), StructField("words", StringType()), StructField("tfs", ArrayType(IntegerType()))])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _documents(batches):
            row = t["row"].to_numpy()
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            dl = np.diff(np.append(first, len(row)))
            doc = np.repeat(np.arange(len(first)), dl)
            coded = t["token"].chunk(0).dictionary_encode()
            size = len(coded.dictionary)
            code, tf = np.unique(doc * size + coded.indices.to_numpy(), return_counts=True)
            edge = pa.array(np.searchsorted(code, np.arange(len(first) + 1) * size).astype(np.int32))
            words = pc.binary_join(pa.ListArray.from_arrays(edge, coded.dictionary.take(pa.array(code % size))), " ")
            one = t.select(names).take(pa.array(first)).combine_chunks()
            tfs = pa.ListArray.from_arrays(edge, pa.array(tf.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*(one[c].chunk(0) for c in names), pa.array(dl), words, tfs], [*names, "dl", "words", "tfs"])

    return rows.mapInArrow(count, kind)


def each_word(held: DataFrame) -> DataFrame:
    """id, token, tf, dl: one row for each word of the counted documents."""
    one = held.select("id", "dl", F.explode(F.arrays_zip(F.split("words", " ").alias("token"), F.col("tfs").alias("tf"))).alias("w"))
    return one.select("id", F.col("w.token").alias("token"), F.col("w.tf").cast("long").alias("tf"), "dl")


#: Words that go to every task with what is known of them; the most frequent ones.
FREQUENT = 100_000


def with_frequency(rows: DataFrame, frequency: DataFrame) -> DataFrame:
    """Rows (token, others) with df.  frequency: token, df; it is read some times, so it should be kept.

    The most frequent words, at most FREQUENT, go to the rows; only rows of the others are exchanged.  So most rows stay where
    they are, and no word with many rows comes together in one task.
    """
    power = F.floor(F.log2("df")).cast("int")
    sizes = {r[0]: r[1] for r in frequency.groupBy(power.alias("power")).count().collect()}  # a row for each power of two
    total, least = 0, max(sizes, default=0) + 1
    while least > 0 and (total := total + sizes.get(least - 1, 0)) <= FREQUENT:
        least -= 1
    often = F.broadcast(frequency.where(power >= least))
    found = rows.join(often, "token")
    if least == 0:
        return found
    return found.union(rows.join(often, "token", "left_anti").join(frequency.where(power < least), "token").select(found.columns))


def raw_forms(words: DataFrame) -> DataFrame:
    """raw, token: every indexed token, as it stands in a text, that is stemmed to one of the words (token, distinct)."""
    may = words.select("token", F.explode(text.unstemmed(F.col("token"))).alias("raw")).where(text.index_token(F.col("raw")))
    return may.where(text.stem("raw") == F.col("token")).select("raw", "token")


def postings(docs: DataFrame, id_: str, body: str) -> DataFrame:
    """id, token, tf, dl: term frequency and document length.  The length is taken before tokens
    are spread, so there is one exchange."""
    read = _read(docs, id_, body).withColumn("dl", F.size(F.filter("raw", text.index_token)).cast("long"))
    return _occurrences(read, "dl").groupBy("id", "token", "dl").agg(F.count("*").alias("tf")).select("id", "token", "tf", "dl")


def corpus_stats(docs: DataFrame, post: DataFrame) -> DataFrame:
    """One row: n documents, avgdl; from the postings, so no text is read for it."""
    total = post.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("total"))
    return docs.agg(F.count("*").alias("n")).join(F.broadcast(total)).select("n", (F.col("total") / F.greatest("n", F.lit(1))).alias("avgdl"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("token").agg(F.count("*").alias("df"))


def frequency_of(words: DataFrame, docs: DataFrame, id_: str, body: str) -> DataFrame:
    """token, df: documents that hold each of the given words (token, distinct).  A document's equal tokens are one before they are stemmed, and
    others than the words go no further."""
    rows = spread(docs.select(F.col(id_).alias("id"), F.col(body).alias("body")))
    raw = rows.select("id", F.explode(F.array_distinct(text.raw_tokens(F.col("body")))).alias("raw")).where(text.index_token(F.col("raw")))
    held = raw.select("id", text.stem("raw").alias("token")).join(words, "token", "left_semi")
    return document_frequency(held.distinct())


def weighted(docs: DataFrame, id_: str, body: str) -> DataFrame:
    """id, token, tf, df, weight, idf.  Texts are read once, and only rows of rare words are exchanged.  Rows with one id are one document."""
    held = kept(counted(docs, id_, body))
    post = each_word(held)
    if not held.groupBy("id").count().where("count > 1").isEmpty():
        post = post.groupBy("id", "token").agg(F.sum("tf").alias("tf"))
        post = kept(post.join(post.groupBy("id").agg(F.sum("tf").alias("dl")), "id"))
    n, total = docs.count(), held.agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]
    weight = scores.bm25_weight(F.col("tf"), F.col("dl"), F.lit(max(total / max(n, 1), 1.0)))
    return with_frequency(post, kept(document_frequency(post))).select("id", "token", "tf", "df", weight.alias("weight"), scores.bm25_idf(F.lit(n), F.col("df")).alias("idf"))


#: Words of claims that one pass over the documents looks for, the bound of what is sent to every task; scores held at once.
SEARCHED, SCORES = 100_000, 1 << 19
#: Bytes of a text's tokens that are looked up at once.
TOKENS_AT_ONCE = 1 << 24


def bm25_search(claims: DataFrame, claim_id: str, claim_text: str, docs: DataFrame, doc_id: str, body: str, k: int = 100) -> DataFrame:
    """claim_id, id, score, rank: the k best documents of every claim.

    Claims go to the documents, about SEARCHED of their words at a time, as all forms that are stemmed to them, so
    tokens of the texts are neither spread to rows nor stemmed.  The first pass over the texts keeps one row
    for each document, with the claims' words that it holds; frequencies come from these rows.  The second
    pass reads them, adds up the weights of a block of documents for all claims, and keeps each
    claim's best.  So nothing is shuffled but best lists, and no row is made for a claim, a document and a
    word that they share.
    """
    spark = claims.sparkSession
    asked = terms(claims, claim_id, claim_text).where("id is not null").select(F.col("id").cast("long").alias("id"), "token").distinct()
    found = spark.createDataFrame([], "claim_id long, id long, score double")
    for rows in in_blocks(asked, "id", SEARCHED):
        found = found.union(_bm25_block(rows, docs, doc_id, body, k))
    return ranked(found, k)


def _bm25_block(asked: list, docs: DataFrame, doc_id: str, body: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    names, place = np.unique([r["id"] for r in asked], return_inverse=True)
    vocabulary = sorted({r["token"] for r in asked})
    number = {w: i for i, w in enumerate(vocabulary)}
    claims_of: list[list[int]] = [[] for _ in vocabulary]
    for c, r in zip(place.tolist(), asked, strict=True):
        claims_of[number[r["token"]]].append(c)
    forms = raw_forms(spark.createDataFrame([(w,) for w in vocabulary], "token string")).collect()
    looked_for = spark.sparkContext.broadcast(([r["raw"] for r in forms], np.array([number[r["token"]] for r in forms], np.int64), len(vocabulary)))

    def hold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raws, word_of, size = looked_for.value
        known, common = pa.array(raws, pa.string()), pa.array(fixed.INDEX_STOPWORDS, pa.string())
        for b in in_slices(batches, TOKENS_AT_ONCE):
            raw = b.column(1)
            flat, doc = raw.flatten(), np.repeat(np.arange(len(raw)), pc.fill_null(raw.value_lengths(), 0).to_numpy())
            indexed = pc.and_not(pc.greater(pc.utf8_length(flat), 1), pc.is_in(flat, value_set=common)).to_numpy(zero_copy_only=False)
            dl = np.bincount(doc[indexed], minlength=len(raw))
            at = pc.fill_null(pc.index_in(flat, value_set=known), -1).to_numpy()
            code, tf = np.unique(doc[at >= 0] * size + word_of[at[at >= 0]], return_counts=True)
            edge = pa.array(np.searchsorted(code, np.arange(len(raw) + 1) * size).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edge, pa.array(x.astype(np.int32))) for x in (code % size, tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(dl.astype(np.int64)), *lists], ["id", "dl", "words", "tfs"]).filter(pa.array(dl > 0))

    read = _read(docs, doc_id, body).select(F.col("id").cast("long").alias("id"), "raw")
    held = kept(read.mapInArrow(hold, "id long, dl long, words array<int>, tfs array<int>"))
    n, total = docs.count(), held.agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]
    average = max(total / max(n, 1), 1.0)
    idf = np.zeros(len(vocabulary))
    frequency = held.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    for r in frequency.select("word", scores.bm25_idf(F.lit(n), F.col("df")).alias("idf")).collect():  # a row for each of the claims' words at most
        idf[r["word"]] = r["idf"]
    sent = spark.sparkContext.broadcast((names, [np.array(c) for c in claims_of], idf))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, claims_of, idf = sent.value
        best, step = Best(len(names), k), max(1, SCORES // len(names))
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                b = whole.slice(start, step)
                ids, dl, held = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
                word, tf = held.flatten().to_numpy(), b.column(3).flatten().to_numpy().astype(np.float64)
                doc = np.repeat(np.arange(len(ids)), held.value_lengths().to_numpy())
                weight = scores.bm25_weight(tf, dl[doc], average) * idf[word]
                table = np.zeros((len(ids), len(names)))
                order = np.argsort(word, kind="stable")
                edge = np.flatnonzero(np.diff(word[order], prepend=-1, append=-1))
                for a, z in zip(edge.tolist(), edge[1:].tolist(), strict=False):
                    some = order[a:z]
                    table[doc[some][:, None], claims_of[word[some[0]]]] += weight[some][:, None]
                best.add(np.where(table > 0, table, np.nan).T, ids)
        yield from best.rows(names)

    return held.mapInArrow(score, "claim_id long, id long, score double")


def ranked(found: DataFrame, k: int | None, score: str = "score") -> DataFrame:
    """With rank by score, ties (within 1e-9) to the smaller id; the first k of each claim."""
    order = Window.partitionBy("claim_id").orderBy(F.desc(F.round(score, 9)), "id")
    out = found.withColumn("rank", F.row_number().over(order))
    return out if k is None else out.where(F.col("rank") <= k)


#: Words that one pass over the chunks looks for, and characters of them; the bound of what is sent to every task.
WORDS_AT_ONCE, CHARACTERS_AT_ONCE = 50_000, 1 << 20
#: As many claims with at most eight keywords each.
CLAIMS_AT_ONCE = 5_000


def _finder(words: list[str]) -> Callable[[str], Iterable[str]]:
    """All of the words that a text holds, in one pass over it."""
    automaton = ahocorasick.Automaton()
    for w in words:
        automaton.add_word(w, w)
    automaton.make_automaton()
    return lambda t: {w for _, w in automaton.iter(t)} if words else ()


def words_held(words: DataFrame, chunks: DataFrame, fold: bool = True) -> DataFrame:
    """id, words: those of the given words (distinct; in lower case if texts are folded) that each chunk's
    text holds anywhere.  One pass over the texts for each 50,000 words, however many claims ask."""
    spark = words.sparkSession
    size = words.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    blocks = max(1, -(-size[0] // WORDS_AT_ONCE), -(-size[1] // CHARACTERS_AT_ONCE))
    body = F.lower("text") if fold else F.col("text")
    texts = spread(chunks.select(F.col("id").cast("long").alias("id"), body.alias("body")).where("body is not null"))
    found = spark.createDataFrame([], "id long, words array<string>")
    for i in range(blocks):
        part = words if blocks == 1 else words.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == i)
        sent = spark.sparkContext.broadcast([r[0] for r in part.select("word").collect()])

        def find(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held_by = _finder(sent.value)
            for b in in_slices(batches):
                held = [sorted(held_by(t)) for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held, pa.list_(pa.string()))], ["id", "words"])

        found = found.union(texts.mapInArrow(find, "id long, words array<string>"))
    if blocks > 1:
        found = found.groupBy("id").agg(F.flatten(F.collect_list("words")).alias("words"))
    return found.where(F.size("words") > 0)


def verbatim(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """claim_id, id: claims (claim_id, text) whose whole text stands word for word in a chunk (id, text).  All
    claims are looked for in one pass over each text, and joined by text after.  Empty claims stand nowhere."""
    asked = claims.select("claim_id", F.col("text").alias("word")).where("word <> ''")
    held = words_held(asked.select("word").distinct(), chunks, fold=False)
    return held.select("id", F.explode("words").alias("word")).join(asked, "word").select("claim_id", "id")


def leading_words(claims: DataFrame, chunks: DataFrame) -> DataFrame:
    """claim_id, id, level, n: how many leading keywords of a claim a chunk holds, where it holds the
    first.  claims: claim_id, kws.

    Each pass sends at most CLAIMS_AT_ONCE claims to the tasks.  A text's words are found in one pass
    over it, and only claims whose first keyword is among them are looked at.
    """
    spark = claims.sparkSession
    texts = spread(chunks.select(F.col("id").cast("long").alias("id"), F.lower("text").alias("low")).where("low is not null"))
    found = spark.createDataFrame([], "claim_id long, id long, level int, n int")
    for part in in_blocks(claims.select("claim_id", "kws"), "claim_id", CLAIMS_AT_ONCE):
        sent = spark.sparkContext.broadcast([(r[0], list(r[1])) for r in part])

        def find(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            held_by = _finder(sorted({w for _, kws in sent.value for w in kws}))
            by_first: dict[str, list] = {}
            for claim, kws in sent.value:
                by_first.setdefault(kws[0], []).append((claim, kws))
            for b in in_slices(batches):
                rows: list[tuple] = []
                for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    held = set(held_by(t))
                    for word in held & by_first.keys():
                        for claim, kws in by_first[word]:
                            level = next((k for k, w in enumerate(kws) if w not in held), len(kws))
                            rows.append((claim, i, level, len(kws)))
                cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["claim_id", "id", "level", "n"])

        found = found.union(texts.mapInArrow(find, "claim_id long, id long, level int, n int"))
    return found


def all_keyword_search(claims: DataFrame, keywords: Column, chunks: DataFrame, k: int = 50, enough: int = 3) -> DataFrame:
    """claim_id, id, level, score, rank: chunks that hold the first n keywords of a claim.

    n falls from all keywords until ``enough`` chunks hold the first n.  In closed form: each
    chunk has a level, the number of leading keywords it holds; the search stops at the largest
    level that so many chunks reach, or at one.
    claims: claim_id; chunks: id, text.
    """
    asked = claims.select("claim_id", keywords.alias("kws")).where(F.size("kws") > 0)
    # read twice: for the level at which a claim stops, and for its hits
    leveled = kept(leading_words(asked, chunks))
    per = leveled.groupBy("claim_id", "level").agg(F.count("*").alias("c"))
    reach = F.sum("c").over(Window.partitionBy("claim_id").orderBy(F.desc("level")))
    stop = per.withColumn("reach", reach).where(F.col("reach") >= enough).groupBy("claim_id").agg(F.max("level").alias("stop"))
    stay = leveled.join(stop, "claim_id", "left").where(F.col("level") >= F.coalesce("stop", F.lit(1)))
    return ranked(stay.select("claim_id", "id", "level", (F.col("level") / F.col("n")).alias("score")), k)


def any_keyword_search(claims: DataFrame, keywords: Column, chunks: DataFrame, k: int = 100) -> DataFrame:
    """claim_id, id, matched, score, rank: distinct forms of a claim's keywords that a chunk holds,
    over the number of keywords.  Forms that several claims share are looked for once."""
    asked = claims.select("claim_id", keywords.alias("kws")).where(F.size("kws") > 0)
    forms = asked.select("claim_id", F.size("kws").alias("n"), F.explode(F.array_distinct(F.flatten(F.transform("kws", text.inflections)))).alias("word"))
    held = words_held(forms.select("word").distinct(), chunks).select("id", F.explode("words").alias("word"))
    counts = forms.join(held, "word").groupBy("claim_id", "id", "n").agg(F.count("*").alias("matched"))
    return ranked(counts.select("claim_id", "id", "matched", (F.col("matched") / F.col("n")).alias("score")), k)
