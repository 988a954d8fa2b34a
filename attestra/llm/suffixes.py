"""Suffix-array dedup of byte strings with deep-shallow sorting."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import bytehash as bh
from attestra.llm.common import NO_ID, bound_batches, table
from attestra.llm.substrings import (
    ENTRIES, FLUSH, LONGEST, MOST, SHIFT, buffer_of, by_bucket, encoded, equal_runs, hot_keys, in_chunks, known_rows, layout, merged, pack_parts, passes_of, rows_batch, text_sizes,
    unpack_parts, with_spans,
)

#: Bytes of a repeated string, and of the anchors: the piece with the smallest hash in it.  Windows whose
#: anchor is frequent are told apart by the next, longer one.
WIDTH, ANCHORS = 400, (32, 192)
#: Depth behind the anchor to which multikey quicksort goes, and the bytes that it compares at once.
SHALLOW, SYMBOL = 32, 8
#: Windows of a long text that are hashed at once.
SLICE = 1 << 20
#: Bytes of strings for each byte of text, about.
COPIES = 3.3
_PLACE = np.uint64((1 << 34) - 1)


def anchored(texts: list[str | bytes | None], width: int, anchor: int):
    """Runs of windows of one document that share the place of their anchor.

    Returns the buffer, and of each run its document, first byte in it, number of windows, place in
    the buffer, offset of the anchor, the anchor's hash, and the hash of the whole run.
    """
    buffer, at = buffer_of(texts)
    data = np.frombuffer(buffer, dtype=np.uint8)
    n = len(data) - width + 1
    if n <= 0:
        z = np.zeros(0, dtype=np.int64)
        return buffer, z, z, z, z, z, z.view(np.uint64), z.view(np.uint64)
    pre = bh.prefix(bh.coded(data, 31))
    hashes = bh.fixed(pre, anchor)
    # the upper bits of the hash, then the place: the leftmost of equals
    keyed = (hashes & ~_PLACE) | np.arange(len(hashes), dtype=np.uint64)
    pick = (bh.sliding_min(keyed, width - anchor + 1)[:n] & _PLACE).astype(np.int64)
    del keyed
    n = len(pick)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))[:n]
    whole = np.arange(n) + width < at[doc + 1]  # the line break at the end is not text
    new = np.ones(n, dtype=bool)
    new[1:] = (pick[1:] != pick[:-1]) | (doc[1:] != doc[:-1]) | ~whole[:-1]
    begin = np.flatnonzero(new & whole)
    stop = np.append(np.flatnonzero(new | ~whole), n)
    end = stop[np.searchsorted(stop, begin, side="right")]
    run = bh.ranges(pre, begin, end + width - 1)
    return buffer, doc[begin], begin - at[doc[begin]], end - begin, begin, pick[begin] - begin, hashes[pick[begin]], run


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n  # a[:low] agrees, a[:high] does not
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class BlindTrie:
    """Orders strings that agree for long: branches hold a depth and the byte there, and each
    insertion compares with one leaf only."""

    def __init__(self, strings: list[bytes]) -> None:
        self.strings, self.root = strings, None

    def _symbol(self, i: int, depth: int) -> int:
        s = self.strings[i]
        return s[depth] if depth < len(s) else -1

    def insert(self, i: int) -> None:
        if self.root is None:
            self.root = [None, [i]]  # a leaf: no depth, the equal strings
            return
        node = self.root
        while node[0] is not None:
            node = node[1].get(self._symbol(i, node[0])) or next(iter(node[1].values()))
        leaf = node[1][0]
        depth = common(self.strings[i], self.strings[leaf])
        if depth == len(self.strings[i]) == len(self.strings[leaf]):
            node[1].append(i)
            return
        above, node = None, self.root
        while node[0] is not None and node[0] < depth:
            above, node = node, node[1][self._symbol(i, node[0])]
        if node[0] == depth:
            node[1][self._symbol(i, depth)] = [None, [i]]
            return
        branch = [depth, {self._symbol(leaf, depth): node, self._symbol(i, depth): [None, [i]]}]
        if above is None:
            self.root = branch
        else:
            above[1][self._symbol(i, above[0])] = branch

    def order(self) -> list[int]:
        out, stack = [], [self.root] if self.root else []
        while stack:
            node = stack.pop()
            if node[0] is None:
                out += node[1]
            else:
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
        return out


def deep_shallow(strings: list[bytes]) -> list[int]:
    """Order of the strings: multikey quicksort to a shallow depth, blind tries beyond."""
    out: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        ids, depth = stack.pop()
        if len(ids) < 2:
            out += ids
        elif depth >= SHALLOW:
            trie = BlindTrie(strings)
            for i in ids:
                trie.insert(i)
            out += trie.order()
        else:
            keys = [strings[i][depth : depth + SYMBOL] for i in ids]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            less = [i for i, k in zip(ids, keys, strict=True) if k < pivot]
            same = [i for i, k in zip(ids, keys, strict=True) if k == pivot]
            more = [i for i, k in zip(ids, keys, strict=True) if k > pivot]
            stack.append((more, depth))
            if len(pivot) < SYMBOL:  # all of them end here
                stack += [([i], depth) for i in reversed(same)]
            else:
                stack.append((same, depth + SYMBOL))
            stack.append((less, depth))
    return out


def shared(strings: list[bytes], anchors: list[int], width: int, anchor: int = 0) -> list[list[tuple[int, int]]]:
    """Of each string, the distances s from a window's start to the anchor, as (least, most), for
    which another string has the same window.  The strings differ and share their anchor of
    ``anchor`` bytes.

    A window at s repeats when some other string agrees s bytes to the left of the anchor and
    width - s to the right of it.  Suffixes from behind the anchor are sorted, and so are the
    prefixes read backwards; the tree of common lengths of the latter gives the strings that
    agree to the left, and in each of its nodes the best partner to the right is a neighbour in
    the suffix order.
    """
    right = [s[a + anchor :] for s, a in zip(strings, anchors, strict=True)]
    left = [s[:a][::-1] for s, a in zip(strings, anchors, strict=True)]
    width -= anchor
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    if len(strings) == 2:
        r, l = common(*right), common(*left)  # noqa: E741
        if r + l >= width:
            out[0].append((max(0, width - r), l))
            out[1].append((max(0, width - r), l))
        return out
    rank = [0] * len(strings)
    for k, i in enumerate(deep_shallow(right)):
        rank[i] = k
    order = deep_shallow(left)
    deep = [common(left[a], left[b]) for a, b in zip(order, order[1:], strict=False)]
    stack = [(0, len(order), -1)]
    while stack:
        lo, hi, above = stack.pop()
        part = deep[lo : hi - 1]
        depth = min(part)
        members = sorted(order[lo:hi], key=rank.__getitem__)
        best = [common(right[a], right[b]) for a, b in zip(members, members[1:], strict=False)]
        for k, i in enumerate(members):
            r = max(best[k - 1] if k else 0, best[k] if k < len(best) else 0)
            if width - r <= depth:
                out[i].append((max(above + 1, width - r), depth))
        if max(best) + max(part) < width:
            continue  # no deeper node can reach the width
        begin = lo
        for k, d in enumerate([*part, depth]):
            if d == depth:
                if lo + k + 1 - begin > 1:
                    stack.append((begin, lo + k + 1, depth))
                begin = lo + k + 1
    return [[x for x in spans if x[0] <= x[1]] for spans in out]


def pieces(ids: list[int], texts: list[str | None], width: int) -> tuple[list[int], list[bytes], list[int]]:
    """ids, bytes and first places of texts; long ones in pieces, which overlap so that each window
    is in one piece.  A window's anchor depends on the window alone, so pieces change nothing."""
    out: tuple[list, list, list] = ([], [], [])
    for i, t in zip(ids, texts, strict=True):
        raw = (t or "").encode("utf-8", "surrogatepass")
        for k in range(0, max(1, len(raw) - width + 1), SLICE):
            for one, x in zip(out, (i, raw[k : k + SLICE + width - 1], k), strict=True):
                one.append(x)
    return out


class _Gathered:
    """Runs of windows of a task until they are sent: numbers in arrays, no object for each.

    Equal runs travel once, as a partner only: that they repeat is known where they meet.  Windows of
    a hot anchor are cut anew by the next longer anchor; those of the longest one, if that is hot
    too, go one by one as digests, to the bucket of the digest.
    """

    def __init__(self, buckets: int, width: int, anchors: tuple[int, ...], hot: frozenset[int]) -> None:
        self.buckets, self.width, self.anchors, self.hot = buckets, width, anchors, np.array(sorted(hot), dtype=np.uint64)
        self.clear()

    def clear(self) -> None:
        self.size = self.entries = 0
        self.chunks: list[bytes] = []
        self.columns: list[tuple[np.ndarray, ...]] = []
        self.whole: dict[bytes, tuple[int, int] | None] = {}  # of runs that go as digests, where one stands that is not known yet
        self.known: list[tuple[int, int, int]] = []

    def full(self) -> bool:
        return self.size >= FLUSH or self.entries >= ENTRIES

    def _keep(self, owner, start, count, offset, begin, end, key, bucket, text: bytes) -> None:
        self.columns.append((owner, start, count, offset, begin + self.size, end + self.size, key, (bucket % np.uint64(self.buckets)).astype(np.int32)))
        self.chunks.append(text)
        self.size += len(text)
        self.entries += len(owner)

    def add(self, ids: list[int], texts: list[str | None]) -> None:
        ids, raw, shift = pieces(ids, texts, self.width)
        self._level(np.array(ids, dtype=np.int64), raw, np.array(shift, dtype=np.int64), 0)

    def _level(self, ids: np.ndarray, raw: list[bytes], shift: np.ndarray, level: int) -> None:
        buffer, doc, start, count, begin, offset, h, run = anchored(raw, self.width, self.anchors[level])
        owner, start, end = ids[doc], start + shift[doc], begin + count + self.width - 1
        hot = np.isin(h, self.hot) if len(self.hot) else np.zeros(len(h), dtype=bool)
        cold = ~hot
        # the level is told by the offset's upper bits
        self._keep(owner[cold], start[cold], count[cold], offset[cold] | level << 32, begin[cold], end[cold], run[cold], h[cold], buffer)
        if not hot.any():
            return
        strings = [buffer[a:z] for a, z in zip(begin[hot].tolist(), end[hot].tolist(), strict=True)]
        if level + 1 < len(self.anchors):
            self._level(owner[hot], strings, start[hot], level + 1)
        else:
            self._single(owner[hot].tolist(), start[hot].tolist(), strings)

    def _single(self, owner: list[int], start: list[int], strings: list[bytes]) -> None:
        """Windows one by one as digests, but for runs that are here already: all of those repeats."""
        fresh, digests, n = [], [], self.width
        for i, s, string in zip(owner, start, strings, strict=True):
            if string in self.whole:
                self.known.append((i, s, len(string)))
                if first := self.whole[string]:
                    self.known.append((*first, len(string)))
                    self.whole[string] = None
                continue
            self.whole[string] = (i, s)
            fresh.append((i, s, len(string) - n + 1))
            digests.append(b"".join([hashlib.blake2b(string[k : k + n], digest_size=16).digest() for k in range(len(string) - n + 1)]))
        i, s, many = np.array(fresh, dtype=np.int64).reshape(-1, 3).T
        at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        first, text = np.arange(len(at)) * 16, b"".join(digests)
        key = np.frombuffer(text, dtype=np.uint64)[::2]
        self._keep(np.repeat(i, many), np.repeat(s, many) + at, np.ones(len(at), dtype=np.int64), np.full(len(at), -1), first, first + 16, key, key, text)

    def rows(self) -> Iterator[pa.RecordBatch]:
        owner, start, count, offset, begin, end, key, bucket = (np.concatenate(c) for c in zip(*self.columns, strict=True))
        text, met = b"".join(self.chunks), np.array(self.known, dtype=np.int64).reshape(-1, 3)
        self.clear()
        order, head = equal_runs(text, bucket, key, owner, start, begin, end)
        first = np.flatnonzero(head)
        size = np.diff(np.append(first, len(order)))
        twice = np.repeat(size > 1, size)
        again = order[twice]
        known = known_rows(np.concatenate((met, np.stack((owner[again], start[again], count[again] + self.width - 1), axis=1))).T, self.buckets)
        lead, many = order[first], size > 1
        by = np.lexsort((start[lead], owner[lead], bucket[lead]))
        lead, many = lead[by], many[by]
        edge = np.flatnonzero(np.diff(bucket[lead], prepend=-1, append=-1))
        packed = []
        for a, z in zip(edge.tolist(), edge[1:].tolist(), strict=False):
            some = lead[a:z]
            strings = b"".join([text[i:j] for i, j in zip(begin[some].tolist(), end[some].tolist(), strict=True)])
            numbers = (np.where(many[a:z], -1, owner[some]), many[a:z], start[some], count[some], offset[some])
            packed.append((int(bucket[some[0]]), 0, pack_parts([*(x.tobytes() for x in numbers), strings])))
        yield rows_batch(packed + known)


def _scatter(buckets: int, width: int, anchors: tuple[int, ...], hot: frozenset[int]):
    hot = np.array(sorted(hot), dtype=np.uint64)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Gathered(buckets, width, anchors, hot)
        for ids, texts in in_chunks(batches):
            held.add(ids, texts)
            if held.full():
                yield from held.rows()
        if held.size:
            yield from held.rows()

    return run


def bucket_spans(blobs: list[bytes], width: int, anchors: tuple[int, ...], part: int = 0, passes: int = 1) -> Iterator[tuple[int, int, int]]:
    """id, first byte and bytes of the runs to remove that a bucket finds; of several passes, those
    of the anchors that this one reads."""
    groups: dict[bytes, dict[bytes, list]] = {}
    for blob in blobs:
        parts = unpack_parts(blob)
        ids, starts, counts, offsets = (np.frombuffer(parts[k], dtype=np.int64).tolist() for k in (0, 2, 3, 4))
        twice = np.frombuffer(parts[1], dtype=np.bool_).tolist()
        text, at = parts[5], 0
        for i, two, s, c, o in zip(ids, twice, starts, counts, offsets, strict=True):
            size = 16 if o < 0 else c + width - 1
            a = o & 0xFFFFFFFF
            n = 0 if o < 0 else anchors[o >> 32]
            key = text[at + a : at + a + n] if n else text[at : at + size]
            if passes == 1 or zlib.crc32(key) % passes == part:
                string = text[at : at + size]
                got = groups.setdefault(key, {}).setdefault(string, [0, a, c, []])
                got[0] += 1 + two
                if not two:
                    got[3].append((i, s))
            at += size
    for key, members in groups.items():
        for n, _, c, places in members.values():
            if n > 1:
                for i, s in places:
                    yield i, s, c + width - 1
        if len(members) < 2:
            continue
        strings = list(members)
        found = shared(strings, [members[s][1] for s in strings], width, len(key))
        for string, spans in zip(strings, found, strict=True):
            n, a, c, places = members[string]
            if n == 1 and places:
                for low, high in spans:
                    high, low = min(high, a), max(low, a - c + 1)
                    if low <= high:
                        yield places[0][0], places[0][1] + a - high, high - low + width


def _answer(width: int, anchors: tuple[int, ...], most: int = MOST):
    """Rows of a bucket to the runs of bytes to remove: doc_id, span.  Large buckets are read several
    times, each time for some anchors."""

    def solve(blobs: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        passes = passes_of(blobs, most)
        for p in range(passes):
            yield encoded(*merged(list(bucket_spans(blobs, width, anchors, p, passes))))

    return lambda batches: by_bucket(batches, solve)


def repeated_bytes(docs: DataFrame, width: int = WIDTH, anchors: tuple[int, ...] = ANCHORS) -> DataFrame:
    """doc_id, span: runs that repeated strings of ``width`` bytes cover.

    docs: doc_id (a key of the row), text.
    """
    spark = docs.sparkSession
    bound_batches(spark, 1024)
    total, size = text_sizes(docs)
    n, buckets = layout(spark, size, COPIES)

    def keys(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        ids, raw, _ = pieces(list(range(len(texts))), texts, width)
        found = [anchored(raw, width, a) for a in anchors]
        return np.array(ids, dtype=np.int64)[np.concatenate([f[1] for f in found])], np.concatenate([f[6] for f in found])

    hot = hot_keys(docs, keys, total=total, size=size)
    sent = docs.mapInArrow(_scatter(buckets, width, anchors, hot), "bucket int, kind int, packed binary")
    return sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(_answer(width, anchors), "doc_id long, span long")


def union(n: int, spans: list[int] | None) -> list[tuple[int, int]]:
    """Maximal runs (begin, end) of the bytes that spans cover."""
    out: list[list[int]] = []
    for s in sorted(spans or ()):
        a, z = s >> SHIFT, (s >> SHIFT) + (s & LONGEST)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, min(z, n)) for a, z in out]


def dedup_bytes(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row.

    Null and empty texts have no bytes and the digest of nothing.  A string that stands twice
    is removed at both places, in one document or two.  Rows with the same id are told apart by
    nothing else: equal ones are repeats of each other, and the places of bytes that any of them loses
    are lost in all of them.  A null id is one more id.  Long texts are hashed in pieces.  Extra
    columns are not read.  No rows: no rows.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    joined = with_spans(slim, repeated_bytes(slim.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))), width))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for text, spans in zip(b.column("text").to_pylist(), b.column("_spans").to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                runs = union(len(raw), spans)
                digest, at = hashlib.sha256(), 0
                for a, z in runs:
                    digest.update(raw[at:a])
                    at = z
                digest.update(raw[at:])
                for col, x in zip(cols, (len(raw), sum(z - a for a, z in runs), len(runs), digest.hexdigest()), strict=True):
                    col.append(x)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents"))
