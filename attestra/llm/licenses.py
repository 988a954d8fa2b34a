"""Fuzzy search for short license notices."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import bound_batches, table

#: Phrases of the contract and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
#: Short notices and the labels that the fuzzy search gives them.
NOTICES = {
    "licensed under the apache license, version 2.0": "apache-2.0",
    "licensed under the gnu general public license, version 2": "gpl-2.0",
    "licensed under the gnu general public license, version 3": "gpl-3.0",
    "licensed under the gnu lesser general public license": "lgpl",
    "licensed under the gnu affero general public license": "agpl",
    "licensed under the mozilla public license, version 2.0": "mpl-2.0",
    "licensed under the bsd 3-clause license": "bsd-3-clause",
    "released under the mit license": "mit",
    "permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
    "licensed under cc by 4.0": "cc-by-4.0",
    "licensed under cc by-nc 4.0": "cc-by-nc-4.0",
    "licensed under cc by-sa 4.0": "cc-by-sa-4.0",
    "licensed under cc by-nd 4.0": "cc-by-nd-4.0",
    "licensed under a creative commons attribution 4.0 international license": "cc-by-4.0",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
#: One edit is allowed for so many characters of a notice.
PER_EDIT = 12

#: Bytes of words: digits, a-z, and all beyond ASCII.
_W, _GAP = rb"0-9a-z\x80-\xff", rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]"
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


@lru_cache(maxsize=1)
def _phrases() -> list[tuple[re.Pattern[bytes], str, bytes]]:
    out = []
    for phrase, label in PHRASES.items():
        words = [re.escape(w.encode()) for w in phrase.split()]
        pattern = rb"(?<![" + _W + rb"])" + (_GAP + rb"+").join(words) + rb"(?![" + _W + rb"])"
        out.append((re.compile(pattern), label, phrase.split()[0].encode()))
    return out


def allowed(notice: str) -> int:
    return max(1, len(notice) // PER_EDIT)


@lru_cache(maxsize=1)
def _seeds() -> tuple[dict[bytes, list[tuple[int, int]]], list]:
    """Pigeonhole: of k + 1 pieces of a notice, one is whole wherever the notice stands with k
    edits.  seed -> (notice, its offset there); the verifying patterns."""
    seeds: dict[bytes, list[tuple[int, int]]] = {}
    patterns = []
    for i, notice in enumerate(NOTICES):
        raw, k = notice.encode(), allowed(notice)
        cuts = [len(raw) * j // (k + 1) for j in range(k + 2)]
        for a, z in zip(cuts, cuts[1:], strict=False):
            seeds.setdefault(raw[a:z], []).append((i, a))
        patterns.append(regex.compile(rb"(?b)(?:" + regex.escape(raw) + rb"){e<=" + str(k).encode() + rb"}"))
    return seeds, patterns


def _parts(a: int, z: int, longest: int) -> Iterator[tuple[int, int]]:
    """A region in parts of a few lengths of a place, each of which overlaps the next by one: every place is whole in some part, and
    searching again around a hit never goes far."""
    while z - a > 8 * longest:
        yield a, a + 8 * longest
        a += 7 * longest
    yield a, z


@lru_cache(maxsize=4096)
def _places(i: int, part: bytes) -> list[tuple[int, int, int]]:
    """start, end, edits of places of a notice in a part of a text.  A search returns the best place of all that it is
    given, so what lies before it is searched like what lies behind.  Parts that come again are remembered."""
    pattern, least, out = _seeds()[1][i], len(_names()[i]) - allowed(_names()[i]), []
    parts = [(0, len(part))]
    while parts:
        a, z = parts.pop()
        if z - a >= least and (m := pattern.search(part, a, z)):
            out.append((m.start(), m.end(), sum(m.fuzzy_counts)))
            parts += [(a, m.start()), (m.end(), z)]
    return out


@lru_cache(maxsize=1)
def _names() -> list[str]:
    return list(NOTICES)


def notices(flat: bytes) -> list[tuple[int, int, int, int]]:
    """notice, start, end, edits of verified places in a text whose white space is single blanks."""
    seeds, names = _seeds()[0], _names()
    starts: dict[int, list[int]] = {}
    for seed, uses in seeds.items():
        at = flat.find(seed)
        while at >= 0:
            for i, offset in uses:
                starts.setdefault(i, []).append(at - offset)
            at = flat.find(seed, at + 1)
    out = []
    for i, found in starts.items():
        # the seeds of one place tell of starts that are twice the edits apart at most
        size, k = len(names[i]), allowed(names[i])
        found.sort()
        edge = [0, *(n for n in range(1, len(found)) if found[n] - found[n - 1] > 2 * k), len(found)]
        for first, last in zip(edge, edge[1:], strict=False):
            a, z = max(0, found[first] - k), min(found[last - 1] + size + k, len(flat))
            for lo, hi in _parts(a, z, size + k):
                out += [(i, lo + start, lo + end, edits) for start, end, edits in _places(i, flat[lo:hi])]
    out = list(dict.fromkeys(out))  # what stands where two parts overlap is found in both
    # of notices that overlap, the one with the smallest share of edits
    kept: list[tuple[int, int, int]] = []  # start, end, place in out; none overlap
    for n, x in sorted(enumerate(out), key=lambda e: (e[1][3] / len(names[e[1][0]]), -len(names[e[1][0]]), e[1][1], e[1][0])):
        at = bisect_left(kept, (x[1], x[2], n))
        if (at == 0 or kept[at - 1][1] <= x[1]) and (at == len(kept) or x[2] <= kept[at][0]):
            kept.insert(at, (x[1], x[2], n))
    return [out[n] for _, _, n in kept]


def scan(text: str | None) -> dict:
    """All columns of one text but its id."""
    low = (text or "").encode("utf-8", "surrogatepass").lower()
    codes = IS_WORD[np.frombuffer(low, dtype=np.uint8)]
    starts = codes.copy()
    starts[1:] &= ~codes[:-1]
    word_at = np.flatnonzero(starts)
    n_words = len(word_at)
    places, labels = [], set()
    for pattern, label, first in _phrases():
        if first in low:
            for m in pattern.finditer(low):
                places.append(int(np.searchsorted(word_at, m.start())))
                labels.add(label)
    words = low.split()
    found = notices(b" ".join(words))
    spans, best = [], 1.0 if places else 0.0
    names = list(NOTICES)
    if found:
        at, pos = 0, []  # start of each word in the flat text
        for w in words:
            pos.append(at)
            at += len(w) + 1
        begins = np.array(pos)
        origin, where = [], 0
        for w in words:
            where = low.index(w, where)
            origin.append(where)
            where += len(w)

        def back(x: int) -> int:
            k = int(np.searchsorted(begins, x, side="right")) - 1
            return origin[k] + min(x - pos[k], len(words[k]))

        for i, a, z, edits in found:
            spans.append({"label": NOTICES[names[i]], "start_byte": back(a), "end_byte": back(z), "edits": edits})
            best = max(best, 1.0 - edits / len(names[i]))
    more = labels | {s["label"] for s in spans}
    return {
        "n_words": n_words,
        "n_base": len(places),
        "first_word": min(places, default=None),
        "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(labels)),
        "labels": ",".join(sorted(more)),
        "score": best,
        "spans": spans,
    }


SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label: string, start_byte: long, end_byte: long, edits: long>>"


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans for every row.

    Places of the base phrases are exact; notices are searched with up to one edit for each
    12 characters and reported with byte spans of the text.  score: 1 with a base phrase, else
    1 - edits / length of the best notice, else 0.  Of notices that overlap the one with the smallest share of
    edits is kept, then the longer, the first.  Null and empty texts have no words, no labels (""), no spans
    and score 0.  Whole texts are read, however long; the cost grows with length and hits, each of which is searched for in a
    few lengths of its notice.  Only doc_id
    and text are read of the columns.  One row in, one row out, repeated rows and null ids included.
    """
    bound_batches(docs.sparkSession)
    kind = pa.schema(
        [
            ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
            ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
            ("spans", pa.list_(pa.struct([("label", pa.string()), ("start_byte", pa.int64()), ("end_byte", pa.int64()), ("edits", pa.int64())]))),
        ]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [scan(t) | {"doc_id": i} for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, {SCHEMA}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))
