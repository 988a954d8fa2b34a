"""A kept inverted index: postings in blocks, statistics that add up over batches, search that skips blocks.

Under one path lie three plain tables, each with a folder ``batch=N`` for every batch of documents:

    documents   id
    postings    bucket (of the token; a folder), token, zone, ids, tfs, dls, n, tokens, top_tf, least_dl
    corpus      documents, tokens, label: one row, written last; a batch without it is not read

Nothing that is stored depends on the rest of the corpus: document frequency, average length and weights are summed up and
worked out when the index is read, so batches in any order give what one batch gives.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.functions import scores
from attestra.operators.lexical import SCORES, SEARCHED, counted, ranked, terms, with_frequency
from attestra.operators.ranking import Best
from attestra.session import exists, in_blocks, in_slices, kept

#: Documents of a zone, about: a token's postings of one zone are one block.  Folders over which tokens are dealt.
ZONE, BUCKETS = 1024, 32
#: Characters of a zone's texts, about, where its documents are long; of the texts whose counts or blocks one task takes.
CHARACTERS, PART = 1 << 22, 1 << 24
#: Zones that a search reads at first for each claim; they give the score that blocks must reach afterwards.
AHEAD = 2
#: More than rounding can make of a score.
SLACK = 1e-8


def bucket(token: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def corpus(spark: SparkSession, path: str) -> list[tuple[int, int, int]]:
    """batch, documents, tokens of the batches that are there as a whole: a row for each run that wrote one."""
    if not exists(spark, f"{path}/corpus"):
        return []
    return [tuple(r) for r in spark.read.parquet(f"{path}/corpus").select("batch", "documents", "tokens").collect()]


def table(spark: SparkSession, path: str, name: str, but: int | None = None) -> DataFrame | None:
    """Rows of the whole batches but one; None if there is none."""
    some = [b for b, documents, tokens in corpus(spark, path) if b != but and (tokens if name == "postings" else documents)]
    return spark.read.parquet(f"{path}/{name}").where(F.col("batch").isin(some)) if some else None


def new_documents(docs: DataFrame, path: str, batch: int) -> DataFrame:
    """Rows whose id no other batch holds; without an id: none.  A batch that is written again takes its own anew."""
    fresh, known = docs.where("id is not null"), table(docs.sparkSession, path, "documents", but=batch)
    return fresh if known is None else fresh.join(known.select("id"), "id", "left_anti")


def add_batch(docs: DataFrame, id_: str, body: str, path: str, batch: int, zone: int = ZONE, label: str | None = None) -> int:
    """Write the documents that are new as one batch; how many there are.  Writing a batch again replaces it, so a run that
    broke off is just run again.  Of rows with one id the one with the smallest hash of its text counts; null texts are
    documents without a token.

    Documents of like length share zones: short ones weigh more, and the best weight of a block is nearer to what its
    other documents have.  Zones are dealt by hash, so a document's zone depends on nothing but itself and the number
    and size of documents of its length in the batch.

    Words are counted where texts are read; counted documents go to their zone, and its blocks to their folder.  Both exchanges have
    as many parts as the texts ask for, so a task's memory does not grow with the batch, nor with a frequent word.
    """
    spark = docs.sparkSession
    held = [b for b, *_ in corpus(spark, path)]
    rows = docs.select(F.col(id_).alias("id"), F.col(body).cast("string").alias("body"))
    length = F.coalesce(F.length("body"), F.lit(0))
    size = F.floor(F.log2(length + F.lit(1.0)) * 2)
    sizes = rows.groupBy(size.alias("size")).agg(F.count("*"), F.sum(length)).collect()  # one row for each half power of two
    new_documents(rows.select("id").distinct(), path, batch).write.mode("overwrite").parquet(f"{path}/documents/batch={batch}")
    n = spark.read.parquet(f"{path}/documents/batch={batch}").count()
    tokens = 0
    if n:
        fresh = new_documents(rows, path, batch)
        if not rows.where("id is not null").groupBy("id").count().where("count > 1").isEmpty():
            first = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("body"), "body"))
            fresh = fresh.withColumn("first", first).where("first = 1")
        slots = F.expr(f"CASE size {' '.join(f'WHEN {s} THEN {max(-(-c // zone), -(-chars // CHARACTERS))}' for s, c, chars in sizes)} END")
        spot = F.lit(batch * (1 << 40)) + F.col("size") * (1 << 32) + F.pmod(F.xxhash64("id"), slots)
        parts = max(spark.sparkContext.defaultParallelism, -(-sum(r[2] for r in sizes) // PART))
        texts = counted(fresh.withColumn("size", size).withColumn("zone", spot), "id", "body", "zone")
        blocks = _blocks(texts.repartition(parts, F.xxhash64("zone")).sortWithinPartitions("zone", "id"))
        blocks = blocks.withColumn("bucket", bucket(F.col("token")))
        slices, together = -(-parts // BUCKETS), max(1, BUCKETS // parts)  # parts of a folder, or folders of a part
        parts = -(-BUCKETS // together) * slices
        place = F.floor(F.col("bucket") / together) * slices + F.pmod(F.xxhash64("token", "zone"), F.lit(slices))
        laid = blocks.repartitionById(parts, place.cast("int")).sortWithinPartitions("bucket", "token", "zone")
        laid.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={batch}")
        tokens = spark.read.schema("tokens long").parquet(f"{path}/postings/batch={batch}").agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    if n or batch in held:
        spark.createDataFrame([(n, tokens, label)], "documents long, tokens long, label string").coalesce(1).write.mode("overwrite").parquet(f"{path}/corpus/batch={batch}")
    return n


def _blocks(texts: DataFrame) -> DataFrame:
    """Blocks of counted documents (id, zone, dl, words, tfs) that come zone by zone, by id."""
    id_ = texts.schema["id"].dataType.simpleString()

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _zones(batches):
            t = t.combine_chunks()
            words, tf = pc.split_pattern(t["words"].chunk(0), " "), t["tfs"].chunk(0).flatten().to_numpy()
            doc = np.repeat(np.arange(len(t)), words.value_lengths().to_numpy())
            coded = words.flatten().dictionary_encode()
            code = coded.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            tf, doc = tf[order], doc[order]
            n = np.bincount(code, minlength=len(coded.dictionary))
            first = np.cumsum(n) - n
            dl = t["dl"].to_numpy().astype(np.int32)[doc]
            edge = pa.array(np.append(first, len(doc)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(edge, x) for x in (t["id"].chunk(0).take(pa.array(doc)), pa.array(tf), pa.array(dl))]
            sums = [n.astype(np.int64), np.add.reduceat(tf, first, dtype=np.int64), np.maximum.reduceat(tf, first), np.minimum.reduceat(dl, first)]
            zone = pa.array(np.full(len(n), t["zone"][0].as_py(), np.int64))
            whole = pa.RecordBatch.from_arrays([coded.dictionary, zone, *lists, *map(pa.array, sums)], ["token", "zone", "ids", "tfs", "dls", "n", "tokens", "top_tf", "least_dl"])
            yield from in_slices([whole])

    return texts.mapInArrow(pack, f"token string, zone long, ids array<{id_}>, tfs array<int>, dls array<int>, n long, tokens long, top_tf int, least_dl int")


def add(docs: DataFrame, id_: str, body: str, path: str, zone: int = ZONE, label: str | None = None) -> int:
    """Write the documents that are new as the next batch; how many there are.  If none are, nothing changes.  A batch that is
    there under the label is written again instead."""
    spark = docs.sparkSession
    batch = max((b for b, *_ in corpus(spark, path)), default=-1) + 1
    if batch and label:
        same = spark.read.parquet(f"{path}/corpus").where(F.col("label") == label).select("batch").first()
        batch = same[0] if same else batch
    return add_batch(docs, id_, body, path, batch, zone, label)


def statistics(spark: SparkSession, path: str) -> tuple[int, float]:
    """Documents, and their average length in tokens (1 at least)."""
    rows = corpus(spark, path)
    n = sum(r[1] for r in rows)
    return n, max(sum(r[2] for r in rows) / max(n, 1), 1.0)


def postings(spark: SparkSession, path: str) -> DataFrame:
    """id, token, tf, dl, df, weight, idf: every posting, weighed by the corpus as it is now."""
    n, average = statistics(spark, path)
    blocks = table(spark, path, "postings")
    if blocks is None:
        return spark.createDataFrame([], "id long, token string, tf int, dl int, df long, weight double, idf double")
    df = kept(blocks.groupBy("token").agg(F.sum("n").alias("df")))
    rows = with_frequency(blocks.select("token", "ids", "tfs", "dls"), df).select("token", "df", F.explode(F.arrays_zip("ids", "tfs", "dls")).alias("p"))
    weight = scores.bm25_weight(F.col("p.tfs"), F.col("p.dls"), F.lit(average))
    return rows.select(F.col("p.ids").alias("id"), "token", F.col("p.tfs").alias("tf"), F.col("p.dls").alias("dl"), "df", weight.alias("weight"), scores.bm25_idf(F.lit(n), F.col("df")).alias("idf"))


def search(claims: DataFrame, claim_id: str, claim_text: str, path: str, k: int = 100) -> DataFrame:
    """claim_id, id, score, rank: the k best documents of every claim, exactly as ``lexical.bm25_search`` finds them in the
    texts.  Long ids.

    Only folders and row groups of the claims' tokens are read, and of these first the few columns that bound the
    weights of a block.  From them each claim has a bound for every zone.  Its best zones are searched first; after that
    only those whose bound reaches its k-th best score so far.
    """
    spark = claims.sparkSession
    found = spark.createDataFrame([], "claim_id long, id long, score double")
    blocks = table(spark, path, "postings")
    if blocks is None:
        return ranked(found, k)
    asked = terms(claims, claim_id, claim_text).where("id is not null").select(F.col("id").cast("long").alias("id"), "token").distinct()
    for rows in in_blocks(asked, "id", SEARCHED):
        found = found.union(_search_block(rows, blocks, statistics(spark, path), k))
    return ranked(found, k)


def _search_block(asked: list, blocks: DataFrame, stats: tuple[int, float], k: int) -> DataFrame:
    spark, (n, average) = blocks.sparkSession, stats
    names, place = np.unique([r["id"] for r in asked], return_inverse=True)
    vocabulary = sorted({r["token"] for r in asked})
    number = {w: i for i, w in enumerate(vocabulary)}
    claims_of: list[list[int]] = [[] for _ in vocabulary]
    for c, r in zip(place.tolist(), asked, strict=True):
        claims_of[number[r["token"]]].append(c)
    words = spark.createDataFrame(list(enumerate(vocabulary)), "word int, token string").withColumn("bucket", bucket(F.col("token")))
    folders = sorted({r[0] for r in words.select("bucket").distinct().collect()})
    held = blocks.where(F.col("bucket").isin(folders)).join(F.broadcast(words), ["bucket", "token"])  # at most SEARCHED words

    bounds = kept(held.select("zone", "word", "n", "top_tf", "least_dl"))
    idf = np.zeros(len(vocabulary))
    for r in bounds.groupBy("word").agg(F.sum("n").alias("df")).select("word", scores.bm25_idf(F.lit(n), F.col("df")).alias("idf")).collect():
        idf[r["word"]] = r["idf"]
    sent = spark.sparkContext.broadcast((names, [np.array(c) for c in claims_of], idf))

    def reach(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, claims_of, idf = sent.value
        for t in _zones(batches):
            word, tf, dl = (t[c].to_numpy() for c in ("word", "top_tf", "least_dl"))
            most = np.zeros(len(names))
            for w, bound in zip(word.tolist(), scores.bm25_weight(tf.astype(np.float64), dl, average) * idf[word], strict=True):
                most[claims_of[w]] += bound
            claim = np.flatnonzero(most)
            yield pa.RecordBatch.from_arrays([pa.array(claim, pa.int32()), pa.array(np.full(len(claim), t["zone"][0].as_py()), pa.int64()), pa.array(most[claim])], ["claim", "zone", "bound"])

    by_zone = bounds.repartition(F.xxhash64("zone")).sortWithinPartitions("zone", "word")
    wanted = by_zone.mapInArrow(reach, "claim int, zone long, bound double")
    order = F.row_number().over(Window.partitionBy("claim").orderBy(F.desc("bound"), "zone"))
    wanted = kept(wanted.withColumn("place", order))

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, claims_of, idf = sent.value
        best = Best(len(names), k)
        for t in _zones(batches):
            t = t.combine_chunks()
            claim = np.zeros(len(names), dtype=bool)
            claim[t["claims"][0].values.to_numpy()] = True  # the zone's first row
            word, lists = t["word"].to_numpy()[1:], t.slice(1)
            edge = np.append(0, np.cumsum(lists["n"].to_numpy()))
            ids, tf, dl = (lists[c].combine_chunks().flatten().to_numpy() for c in ("ids", "tfs", "dls"))
            spot = np.repeat(np.arange(len(word)), np.diff(edge))
            weight = scores.bm25_weight(tf.astype(np.float64), dl, average) * idf[word][spot]
            docs, column = np.unique(ids, return_inverse=True)
            step = max(1, SCORES // len(names))
            for start in range(0, len(docs), step):
                some = min(step, len(docs) - start)
                table_ = np.zeros((len(names), some))
                for i, w in enumerate(word.tolist()):
                    who = claims_of[w][claim[claims_of[w]]]
                    col = column[edge[i] : edge[i + 1]] - start
                    here = (col >= 0) & (col < some)
                    table_[who[:, None], col[here]] += weight[edge[i] : edge[i + 1]][here]
                best.add(np.where(table_ > 0, table_, np.nan), docs[start : start + some])
        yield from best.rows(names)

    def hits(pairs: DataFrame) -> DataFrame:
        zones = pairs.groupBy("zone").agg(F.collect_list("claim").alias("claims"))
        lists = held.join(zones.select("zone"), "zone", "left_semi").select("zone", "word", "n", "ids", "tfs", "dls", F.lit(None).cast("array<int>").alias("claims"))
        none = [F.lit(None).cast(kind).alias(c) for c, kind in (("n", "long"), ("ids", "array<long>"), ("tfs", "array<int>"), ("dls", "array<int>"))]
        rows = lists.union(zones.select("zone", F.lit(-1).alias("word"), *none, "claims"))
        # by a hash of the zone: Spark leaves out an exchange by the column itself, as the joins are by it, and may turn those
        # into joins that keep no such order when they run
        return rows.repartition(F.xxhash64("zone")).sortWithinPartitions("zone", "word").mapInArrow(score, "claim_id long, id long, score double")

    first = kept(ranked(hits(wanted.where(F.col("place") <= AHEAD)), k))
    index = spark.createDataFrame(list(enumerate(names.tolist())), "claim int, claim_id long")
    least = first.groupBy("claim_id").agg(F.count("*").alias("found"), F.min("score").alias("least")).where(F.col("found") == k)
    least = least.join(F.broadcast(index), "claim_id").select("claim", "least")
    rest = wanted.where(F.col("place") > AHEAD).join(least, "claim", "left").where(F.col("bound") >= F.coalesce("least", F.lit(0.0)) - SLACK)
    return first.select("claim_id", "id", "score").union(hits(rest.select("claim", "zone")))


def _zones(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows zone by zone, of batches sorted by zone: a zone has a row for each of the claims' words at most."""
    parts: list[pa.Table] = []
    for b in batches:
        zone = b.column(b.schema.get_field_index("zone")).to_numpy()
        if not len(zone):
            continue
        cuts = [0, *(np.flatnonzero(zone[1:] != zone[:-1]) + 1).tolist(), len(zone)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            if parts and parts[-1]["zone"][0].as_py() != zone[a]:
                yield pa.concat_tables(parts)
                parts = []
            parts.append(pa.Table.from_batches([b.slice(a, z - a)]))
    if parts:
        yield pa.concat_tables(parts)
