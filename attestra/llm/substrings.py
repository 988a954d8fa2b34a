"""Substring dedup by super-k-mer partitioning."""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import bytehash as bh
from attestra.llm.common import NO_ID, bound_batches, by_place, partitions, table

#: Words of a window, and of the pieces of it whose smallest hash is its minimiser.
WINDOW, PIECE = 13, 3
#: Bytes of text that are hashed at once, and that a task gathers before it sends super-k-mers on; entries that it gathers.
CHUNK, FLUSH, ENTRIES = 1 << 20, 8 << 20, 300_000
#: Buckets for each shuffle partition at least: one bucket is sorted at a time.
FINER = 12
#: Bytes of strings that a bucket is to hold, and over which it is read in several passes by content.
BUCKET, MOST = 6 << 20, 24 << 20
#: Bytes of strings for each byte of text, about, and such bytes for each shuffle partition at most.
COPIES, PART = 3.3, 1 << 30
#: A span is its first place << SHIFT | its length; longer ones are several spans.
SHIFT = 28
LONGEST = (1 << SHIFT) - 1


def buffer_of(texts: list[str | bytes | None]) -> tuple[bytes, np.ndarray]:
    """Texts as one buffer, a line break after each, and where each starts (and the end)."""
    raw = [t if isinstance(t, bytes) else (t or "").encode("utf-8", "surrogatepass") for t in texts]
    at = np.zeros(len(raw) + 1, dtype=np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=at[1:])
    return b"\n".join(raw) + b"\n", at


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Words with one blank after each, and where each begins (and the end).  A gap follows each word."""
    keep = ~bh.SPACE[data]
    keep[ends] = True
    out = data[keep]
    at = np.zeros(len(starts) + 1, dtype=np.int64)
    np.cumsum(ends - starts + 1, out=at[1:])
    out[at[1:] - 1] = 32
    return out.tobytes(), at


@dataclass
class SuperKmers:
    """Runs of windows of one document that share a minimiser, over the words of a buffer."""

    doc: np.ndarray  # document
    start: np.ndarray  # first word in the document
    word: np.ndarray  # first word in the buffer
    count: np.ndarray  # windows
    least: np.ndarray  # minimiser
    starts: np.ndarray  # of the buffer's words
    ends: np.ndarray
    hashes: np.ndarray  # running sums of the words' hashes


def super_kmers(buffer: bytes, at: np.ndarray, window: int, piece: int) -> SuperKmers:
    data = np.frombuffer(buffer, dtype=np.uint8)
    starts, ends = bh.words(data)
    n = len(starts) - window + 1
    pre = bh.prefix(bh.word_hashes(data, starts, ends))
    if n <= 0:
        z = np.zeros(0, dtype=np.int64)
        return SuperKmers(z, z, z, z, z.view(np.uint64), starts, ends, pre)
    doc = np.searchsorted(at, starts, side="right") - 1
    first = np.searchsorted(starts, at[:-1])
    least = bh.sliding_min(bh.fixed(pre, piece), window - piece + 1)[:n]
    whole = doc[:n] == doc[window - 1 :]
    new = np.ones(n, dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | ~whole[:-1] | (doc[1:n] != doc[: n - 1])
    begin = np.flatnonzero(new & whole)
    # a run goes on to where the next begins, or windows stop being whole
    stop = np.append(np.flatnonzero(new | ~whole), n)
    end = stop[np.searchsorted(stop, begin, side="right")]
    return SuperKmers(doc[begin], begin - first[doc[begin]], begin, end - begin, least[begin], starts, ends, pre)


def word_pieces(ids: list[int], texts: list[str | None], window: int, size: int) -> tuple[list[int], list[bytes], np.ndarray]:
    """ids, bytes and first words of texts; long ones in pieces that overlap so that each window is in
    one piece.  A window's minimiser depends on the window alone, so pieces change nothing."""
    out: tuple[list, list, list] = ([], [], [])
    for i, t in zip(ids, texts, strict=True):
        raw, at, word = (t or "").encode("utf-8", "surrogatepass"), 0, 0
        while len(raw) - at > size:
            starts, ends = bh.words(np.frombuffer(raw, dtype=np.uint8, count=size, offset=at))
            if len(starts) <= window:  # words of such length: all that is left at once
                break
            n = len(starts) - 1  # the last word may go on
            for one, x in zip(out, (i, raw[at : at + int(ends[n - 1])], word), strict=True):
                one.append(x)
            word += n - window + 1
            at += int(starts[n - window + 1])
        for one, x in zip(out, (i, raw[at:] if at else raw, word), strict=True):
            one.append(x)
    return out[0], out[1], np.array(out[2], dtype=np.int64)


def pack_parts(parts: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=6).compress(b"".join(struct.pack("<q", len(p)) + p for p in parts))


def unpack_parts(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    parts, at = [], 0
    while at < len(raw):
        (n,) = struct.unpack_from("<q", raw, at)
        parts.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return parts


def _pack(ids: np.ndarray, many: np.ndarray, counts: np.ndarray, starts: np.ndarray, strings: bytes) -> bytes:
    return pack_parts([np.diff(ids, prepend=np.int64(0)).tobytes(), many.astype(np.int32).tobytes(), counts.astype(np.int32).tobytes(), starts.tobytes(), strings])


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    p = unpack_parts(blob)
    return np.cumsum(np.frombuffer(p[0], np.int64)), np.frombuffer(p[1], np.int32), np.frombuffer(p[2], np.int32), np.frombuffer(p[3], np.int64), p[4]


def encoded(ids: np.ndarray, first: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ids and spans; runs of any length."""
    times = np.maximum(1, -(-length // LONGEST))
    nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    first, left = np.repeat(first, times) + nth * LONGEST, np.repeat(length, times) - nth * LONGEST
    return np.repeat(ids, times), first << SHIFT | np.minimum(left, LONGEST)


def merged(spans: list[tuple[int, int, int]] | np.ndarray) -> np.ndarray:
    """Rows of ids, first places and lengths of the union of (id, first place, length)."""
    a = np.array(spans, dtype=np.int64).reshape(-1, 3)
    a = a[np.lexsort((a[:, 1], a[:, 0]))]
    ids, group = np.unique(a[:, 0], return_inverse=True)
    shift = group * (int((a[:, 1] + a[:, 2]).max(initial=0)) + 2)
    start, end = a[:, 1] + shift, np.maximum.accumulate(a[:, 1] + a[:, 2] + shift)
    new = np.ones(len(a), dtype=bool)
    new[1:] = start[1:] > end[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(a)) - 1
    return np.stack((a[first, 0], a[first, 1], (end[last] - start[first]) if len(a) else first))


def known_rows(known: np.ndarray, buckets: int) -> list[tuple[int, int, bytes]]:
    """Packed rows of kind 1, spread over the buckets, of rows of ids, first places and lengths."""
    if not known.size:
        return []
    k = merged(known.T)
    return [((int(k[1, j]) + j) % buckets, 1, zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(k[:, j : j + 50_000]).tobytes())) for j in range(0, k.shape[1], 50_000)]


def equal_runs(text: bytes, bucket: np.ndarray, h: np.ndarray, ids: np.ndarray, start: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows by bucket, string, id and start, and whether each is the first of its string.  Hashes
    find equal strings, bytes confirm them; where they differ nothing is joined."""
    order = np.lexsort((start, ids, h, bucket))
    b, hs = bucket[order], h[order]
    head = np.ones(len(order), dtype=bool)
    head[1:] = (b[1:] != b[:-1]) | (hs[1:] != hs[:-1])
    lead = np.flatnonzero(head)[np.cumsum(head) - 1]
    rest = np.flatnonzero(~head)
    bad: list[int] = []
    for k in range(0, len(rest), 50_000):
        part = rest[k : k + 50_000]
        here, there = order[part], order[lead[part]]
        places = (x.tolist() for x in (part, begin[here], end[here], begin[there], end[there]))
        bad += [r for r, a, z, c, d in zip(*places, strict=True) if text[a:z] != text[c:d]]
    if bad:
        head[np.isin(lead, lead[bad])] = True
    return order, head


class Gathered:
    """Super-k-mers of a task until they are sent: numbers in arrays over the words of its chunks, no
    object for each.

    Equal ones travel once, with the smallest id; the others are known to be repeats and go
    straight to the answer.  So copies of a passage reach its bucket at most once from each
    task, however many there are.  Windows of hot minimisers go one by one, to the bucket of
    their own hash.
    """

    def __init__(self, buckets: int, window: int, piece: int, hot: frozenset[int]) -> None:
        self.buckets, self.window, self.piece, self.hot = buckets, window, piece, np.array(sorted(hot), dtype=np.uint64)
        self.clear()

    def clear(self) -> None:
        self.size = self.entries = 0
        self.chunks: list[bytes] = []
        self.columns: list[tuple[np.ndarray, ...]] = []

    def full(self) -> bool:
        return self.size >= FLUSH or self.entries >= ENTRIES

    def add(self, ids: list[int], texts: list[str | None]) -> None:
        ids, raw, shift = word_pieces(ids, texts, self.window, 4 * CHUNK)
        buffer, at = buffer_of(raw)
        found = super_kmers(buffer, at, self.window, self.piece)
        words, place = spaced(np.frombuffer(buffer, dtype=np.uint8), found.starts, found.ends)
        doc, start, word, count = found.doc, found.start, found.word, found.count
        key = bh.ranges(found.hashes, word, word + count + self.window - 1)
        spot = found.least
        if len(self.hot) and (hot := np.isin(found.least, self.hot)).any():
            each = np.where(hot, count, 1)
            inside = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
            hot, doc, start, word, count, key, spot = (np.repeat(x, each) for x in (hot, doc, start, word, count, key, spot))
            start, word, count = start + inside, word + inside, np.where(hot, 1, count)
            own = np.flatnonzero(hot)
            key[own] = spot[own] = bh.ranges(found.hashes, word[own], word[own] + self.window)
        begin, end = place[word] + self.size, place[word + count + self.window - 1] + self.size
        owner = np.array(ids, dtype=np.int64)[doc]
        self.columns.append((owner, start + shift[doc], count.astype(np.int32), begin, end, key, (spot % np.uint64(self.buckets)).astype(np.int32)))
        self.chunks.append(words)
        self.size += len(words)
        self.entries += len(owner)

    def rows(self) -> Iterator[pa.RecordBatch]:
        owner, start, count, begin, end, key, bucket = (np.concatenate(c) for c in zip(*self.columns, strict=True))
        text = b"".join(self.chunks)
        self.clear()
        order, head = equal_runs(text, bucket, key, owner, start, begin, end)
        first, sorted_ids = np.flatnonzero(head), owner[order]
        own = sorted_ids == sorted_ids[first][np.cumsum(head) - 1]
        later = order[~own]
        known = known_rows(np.stack((owner[later], start[later], count[later] + self.window - 1)), self.buckets)
        many = np.add.reduceat(own.astype(np.int64), first) if len(first) else first
        flat, at = start[order][own], np.cumsum(many) - many
        lead = order[first]
        by = np.lexsort((start[lead], owner[lead], bucket[lead]))
        lead, many, at = lead[by], many[by], at[by]
        flat = flat[np.arange(int(many.sum())) + np.repeat(at - (np.cumsum(many) - many), many)]
        upto = np.append(0, np.cumsum(many))
        edge = np.flatnonzero(np.diff(bucket[lead], prepend=-1, append=-1))
        packed = []
        for a, z in zip(edge.tolist(), edge[1:].tolist(), strict=False):
            some = lead[a:z]
            strings = b"".join([text[i:j] for i, j in zip(begin[some].tolist(), end[some].tolist(), strict=True)])
            packed.append((int(bucket[some[0]]), 0, _pack(owner[some], many[a:z], count[some], flat[upto[a] : upto[z]], strings)))
        yield rows_batch(packed + known)


def rows_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], ["bucket", "kind", "packed"])


def in_chunks(batches: Iterable[pa.RecordBatch], size: int = CHUNK) -> Iterator[tuple[list[int], list[str | None]]]:
    """ids and texts of about so many characters at a time."""
    ids: list[int] = []
    texts: list[str | None] = []
    n = 0
    for b in batches:
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(t)
            n += len(t or "")
            if n >= size:
                yield ids, texts
                ids, texts, n = [], [], 0
    if ids:
        yield ids, texts


def _scatter(buckets: int, window: int, piece: int, hot: frozenset[int]):
    """Texts to packed super-k-mers (kind 0) by bucket, and known repeats (kind 1)."""
    hot = np.array(sorted(hot), dtype=np.uint64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Gathered(buckets, window, piece, hot)
        for ids, texts in in_chunks(batches):
            held.add(ids, texts)
            if held.full():
                yield from held.rows()
        if held.size:
            yield from held.rows()

    return run


def text_sizes(docs: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of all texts."""
    row = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return int(row[0]), int(row[1])


def layout(spark: SparkSession, size: int, copies: float = COPIES) -> tuple[int, int]:
    """Shuffle partitions and buckets for so many bytes of text.  A bucket is what a task holds at once,
    so its bytes stay the same however large the input is."""
    n = max(partitions(spark), int(size * copies / PART) + 1)
    return n, max(FINER * n, int(size * copies / BUCKET) + 1)


def hot_keys(docs: DataFrame, keys, total: int, size: int, documents: int = 20_000, share: float = 0.01, least: int = 50, most: int = 1_000_000) -> frozenset[int]:
    """Minimisers that stand in over ``share`` of a bounded sample of documents (the first by hash), or
    that ``most`` keys of equal weight would not reach: so no key that travels whole has many more than
    a ``most``-th of all super-k-mers, and at most about ``most`` keys are sent to the tasks.

    They only decide the way that windows take to a bucket, never the result: windows of hot
    minimisers travel one by one.  keys(texts) gives the minimisers of some texts.
    """
    if not total:
        return frozenset()
    # super-k-mers have some 36 bytes of text of their own; one key is to have as many, by estimate
    bound = max(20_000, size // 36 // most)
    part = min(1.0, max(documents / total, 2 * least / bound))
    some = docs.where(F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1_000_000)) < int(1_000_000 * part))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in in_chunks(batches):
            doc, key = keys(texts)
            pair = np.unique(np.stack((doc.astype(np.uint64), key), axis=1), axis=0)
            k, n = np.unique(pair[:, 1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n, pa.int64())], ["key", "n"])

    counted = some.mapInArrow(run, "key long, n long")
    at = max(least, int(min(share * min(total, documents), bound * part)))
    return frozenset(r["key"] % 2**64 for r in counted.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= at).collect())


def repeats(ids: np.ndarray, count: np.ndarray, joined: bytes, window: int) -> list[tuple[int, int, int]]:
    """super-k-mer, offset in it and words of each run of its windows that a smaller id has too.

    Windows are sorted by hash, then id; neighbours of equal hash are compared as bytes, so the
    count is exact.
    """
    data = np.frombuffer(joined, dtype=np.uint8)
    starts, ends = bh.words(data)
    total = int(count.sum())
    own = np.repeat(np.arange(len(ids)), count)
    inside = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
    first = np.cumsum(count + (window - 1)) - (count + (window - 1))
    word = first[own] + inside
    h = bh.ranges(bh.prefix(bh.word_hashes(data, starts, ends, 23)), word, word + window)
    order = np.lexsort((ids[own], h))
    hs, os = h[order], own[order]
    same = np.flatnonzero(hs[1:] == hs[:-1]) + 1
    equal = np.empty(len(same), dtype=bool)
    for k in range(0, len(same), 50_000):
        here, other = word[order[same[k : k + 50_000]]], word[order[same[k : k + 50_000] - 1]]
        places = (x.tolist() for x in (starts[here], ends[here + window - 1], starts[other], ends[other + window - 1]))
        equal[k : k + 50_000] = [joined[a:z] == joined[c:d] for a, z, c, d in zip(*places, strict=True)]
    if not equal.all():  # two windows of one hash: sort that hash's windows as strings
        bad = np.unique(hs[same[~equal]])
        for value in bad.tolist():
            rows = np.flatnonzero(hs == np.uint64(value))
            rows = rows[np.argsort(np.array([joined[starts[word[o]] : ends[word[o] + window - 1]].hex() for o in order[rows]]), kind="stable")]
            order[np.sort(rows)] = order[rows]
        os = own[order]
        strings = [joined[starts[word[o]] : ends[word[o] + window - 1]] for o in order]
        head = np.array([True, *[a != b for a, b in zip(strings[1:], strings, strict=False)]])
    else:
        head = np.ones(total, dtype=bool)
        head[same] = False
    group = np.cumsum(head) - 1
    least = ids[os[np.flatnonzero(head)]][group] if total else ids[:0]
    gone = np.zeros(total, dtype=bool)
    gone[order[ids[os] > least]] = True
    cut = np.ones(total, dtype=bool)
    cut[1:] = (own[1:] != own[:-1]) | ~gone[:-1]
    begin = np.flatnonzero(gone & cut)
    stop = np.append(np.flatnonzero(~gone | (own != np.roll(own, 1))), total)
    end = stop[np.searchsorted(stop, begin, side="right")]
    return list(zip(own[begin].tolist(), inside[begin].tolist(), (end - begin + window - 1).tolist(), strict=True))


def residues(count: np.ndarray, joined: bytes, window: int, piece: int, hot: np.ndarray, passes: int) -> np.ndarray:
    """Of each super-k-mer the pass that reads it: by its minimiser or, where that is hot, its only window."""
    data = np.frombuffer(joined, dtype=np.uint8)
    pre = bh.prefix(bh.word_hashes(data, *bh.words(data)))
    size = count.astype(np.int64) + window - 1
    word = np.cumsum(size) - size
    pieces = np.append(bh.fixed(pre, piece), np.uint64(0))
    edges = np.stack((word, word + size - piece + 1), axis=1).ravel()
    least = np.minimum.reduceat(pieces, edges)[::2]
    key = np.where(np.isin(least, hot), bh.ranges(pre, word, word + window), least)
    return (bh.mix(key) % np.uint64(passes)).astype(np.int64)


def by_bucket(batches: Iterable[pa.RecordBatch], solve: Callable[[list[bytes]], Iterator[tuple[np.ndarray, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
    """doc_id, span of known repeats as they are, and of what ``solve`` finds in each bucket's packets."""

    def batch(found: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for ids, spans in found:
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, pa.int64())], ["doc_id", "span"])

    held: list[bytes] = []
    bucket = None
    for b in batches:
        for m, kind, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if kind:
                yield from batch([encoded(*np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.int64).reshape(3, -1))])
                continue
            if m != bucket and held:
                yield from batch(solve(held))
                held = []
            bucket = m
            held.append(blob)
    if held:
        yield from batch(solve(held))


def passes_of(blobs: list[bytes], most: int) -> int:
    """In how many passes packets are read so that each holds about ``most`` bytes."""
    return -(-sum(zstandard.frame_content_size(b) for b in blobs) // most)


def _answer(window: int, piece: int, hot: frozenset[int], most: int = MOST):
    """Rows of a bucket to the runs of words to remove: doc_id, span.  Large buckets are read several
    times, each time for the super-k-mers of some minimisers."""
    hot_ = np.array(sorted(hot), dtype=np.uint64)

    def solve(blobs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        passes = passes_of(blobs, most)
        for p in range(passes):
            parts = [_unpack(b) if passes == 1 else chosen(b, p, passes) for b in blobs]
            ids, many, count, flat = (np.concatenate([x[k] for x in parts]) for k in range(4))
            joined = b"".join(x[4] for x in parts)
            del parts
            found = np.array(repeats(ids, count.astype(np.int64), joined, window), dtype=np.int64).reshape(-1, 3)
            k, times = found[:, 0], many[found[:, 0]]
            at = (np.cumsum(many) - many)[k]
            nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
            start = flat[np.repeat(at, times) + nth] + np.repeat(found[:, 1], times)
            yield encoded(np.repeat(ids[k], times), start, np.repeat(found[:, 2], times))

    def chosen(blob: bytes, p: int, passes: int):
        ids, many, count, flat, joined = _unpack(blob)
        mine = residues(count, joined, window, piece, hot_, passes) == p
        data = np.frombuffer(joined, dtype=np.uint8)
        ends = bh.words(data)[1][np.cumsum(count.astype(np.int64) + window - 1) - 1] + 1
        size = np.diff(ends, prepend=0)
        return ids[mine], many[mine], count[mine], flat[np.repeat(mine, many)], data[np.repeat(mine, size)].tobytes()

    return lambda batches: by_bucket(batches, solve)


def repeated_spans(docs: DataFrame, window: int = WINDOW, piece: int = PIECE) -> DataFrame:
    """doc_id, span: runs of words that windows cover which a smaller doc_id has too.  A null
    doc_id stands as NO_ID, after all others."""
    spark = docs.sparkSession
    bound_batches(spark, 1024)
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.col("text").cast("string").alias("text"))
    total, size = text_sizes(texts)
    n, buckets = layout(spark, size)

    def minimisers(some: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        found = super_kmers(*buffer_of(some), window, piece)
        return found.doc, found.least

    hot = hot_keys(texts, minimisers, total=total, size=size)
    sent = texts.mapInArrow(_scatter(buckets, window, piece, hot), "bucket int, kind int, packed binary")
    return sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer(window, piece, hot), "doc_id long, span long")


def removed_words(n: int, spans: list[int] | None) -> np.ndarray:
    gone = np.zeros(n + 1, dtype=np.int32)
    for s in spans or ():
        gone[min(n, s >> SHIFT)] += 1
        gone[min(n, (s >> SHIFT) + (s & LONGEST))] -= 1
    return np.cumsum(gone[:n]) > 0


def with_spans(docs: DataFrame, spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with their spans as ``_spans`` (null: none).  A document's spans are bounded by its own length."""
    per = spans.groupBy(F.col("doc_id").alias("_of")).agg(F.collect_list("span").alias("_spans"))
    return docs.join(per, F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)) == F.col("_of"), "left").drop("_of")


def kept_words(raw: bytes, spans: list[int] | None) -> tuple[int, int, str]:
    """Words, removed words, and the digest of the kept ones joined by blanks."""
    if not spans and len(raw) <= CHUNK:
        words = raw.split()
        return len(words), 0, hashlib.sha256(b" ".join(words)).hexdigest()
    data = np.frombuffer(raw + b"\n", dtype=np.uint8)
    starts, ends = bh.words(data)
    gone = removed_words(len(starts), spans)
    text, _ = spaced(data, starts, ends)
    left = np.frombuffer(text, dtype=np.uint8)[np.repeat(~gone, ends - starts + 1)]
    return len(starts), int(gone.sum()), hashlib.sha256(left[:-1].data).hexdigest()


def dedup_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row.

    Words that a window of 13 covers which starts in a document with a smaller id too are removed.
    Null and empty texts have no words; their digest is that of the empty string.  Rows with the same
    id are one document for the order of ids, so none of them counts as earlier; the places of words
    that any of them loses are lost in all of them, whether or not their texts are equal.  A null id is
    the largest.  Long texts are hashed in pieces.  Extra columns are not read.  No rows: no rows.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = with_spans(slim, repeated_spans(slim, window))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            total, removed, digest = [], [], []
            for text, spans in zip(b.column("text").to_pylist(), b.column("_spans").to_pylist(), strict=True):
                got = kept_words((text or "").encode("utf-8", "surrogatepass"), spans)
                for one, x in zip((total, removed, digest), got, strict=True):
                    one.append(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest)], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cut_text(text: str, spans: list[int]) -> str:
    """The text without the words of the spans; what stands between kept words stays."""
    raw = text.encode("utf-8", "surrogatepass")
    starts, ends = bh.words(np.frombuffer(raw, dtype=np.uint8))
    gone = removed_words(len(starts), spans)
    out, at = [], 0
    edge = np.flatnonzero(np.diff(gone, prepend=False, append=False))
    for a, z in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        out.append(raw[at : starts[a]])
        at = int(starts[z]) if z < len(starts) else len(raw)
    out.append(raw[at:])
    return b"".join(out).decode("utf-8", "surrogatepass")


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents with all their columns: repeated passages are cut from ``text``, and ``n_chars``,
    where there is one, follows.  Every row stays."""
    placed, name = by_place(docs)
    joined = with_spans(placed, repeated_spans(docs, window), name("doc_id"))
    body, size = name("text"), name("n_chars") if "n_chars" in docs.columns else None
    columns = placed.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t if t is None or not s else cut_text(t, s) for t, s in zip(b.column(body).to_pylist(), b.column("_spans").to_pylist(), strict=True)]
            cols = {n: b.column(n) for n in columns} | {body: pa.array(texts, pa.string())}
            if size:
                cols[size] = pa.array([None if t is None else len(t) for t in texts], pa.int64()).cast(b.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(list(cols.values()), columns)

    return joined.mapInArrow(run, placed.schema).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_digest(table(spark, sf_dir, "documents"))


SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), starts AS (
  SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i : i + 12], ' ')) AS h FROM starts
), gone AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY h) AS m FROM windows) WHERE m < doc_id
), covered AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS j FROM gone
), each AS (
  SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS j FROM words
), kept AS (
  SELECT e.doc_id, count(*) FILTER (WHERE c.j IS NULL) AS k,
         string_agg(e.word, ' ' ORDER BY e.j) FILTER (WHERE c.j IS NULL) AS t
  FROM each e LEFT JOIN covered c ON e.doc_id = c.doc_id AND e.j = c.j GROUP BY e.doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words,
       CAST(len(w.w) - coalesce(k.k, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(k.t, '')) AS kept_sha256
FROM words w LEFT JOIN kept k ON w.doc_id = k.doc_id
"""
