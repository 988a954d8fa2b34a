"""Which short passages stand in long texts, and grams that windows choose (winnowing)."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestra.session import in_slices

#: Characters of a gram; grams of a window.  A passage of GRAM + WINDOW - 1 characters holds a whole window.
GRAM, WINDOW = 8, 9
#: Passages up to which a text is searched for each; passages that one automaton holds.  PIECE: characters of
#: a text that fingerprints once took together; nothing here reads it.
FEW, LISTED, PIECE = 8, 50_000, 1 << 20
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(codes: np.ndarray) -> np.ndarray:
    """A hash of the characters of each gram, by its content alone."""
    n = len(codes) - GRAM + 1
    h = np.zeros(max(n, 0), dtype=np.uint64)
    for j in range(GRAM if n > 0 else 0):
        h = h * _BASE + codes[j : j + n].astype(np.uint64) + np.uint64(1)
    h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def chosen(codes: np.ndarray, text: np.ndarray | None = None) -> np.ndarray:
    """Places of the grams that are the smallest of some window of WINDOW grams, the leftmost of equal ones.  text: the number of
    the text of each character, where there are many; windows stand in one text."""
    h = gram_hashes(codes)
    if len(h) < WINDOW:
        return np.zeros(0, dtype=np.int64)
    every = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
    start = np.arange(len(every))
    if text is not None:
        start = np.flatnonzero(text[: len(every)] == text[GRAM + WINDOW - 2 :])
        every = every[start]
    return np.unique(every.argmin(axis=1) + start) if len(start) else start


def standing(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """k, t: the passages (k, t), each once, that stand in the text (k, t) of their key, which has one.

    Only texts and passages are shuffled, once each: a key's passages come to its text as a list, and all of them are looked
    for in one pass over it (an automaton), so the work grows with the lengths of texts and passages, not with their
    product.  A text with more than LISTED passages is read once for each part of them.  Empty passages stand
    everywhere; null ones nowhere.
    """
    asked = passages.where("t is not null").select("k", "t").distinct()
    bodies = texts.where("t is not null").select("k", F.col("t").alias("body"))
    parts = F.ceil(F.count("*").over(Window.partitionBy("k")) / LISTED)
    lists = asked.withColumn("part", F.pmod(F.xxhash64("t"), parts)).groupBy("k", "part").agg(F.collect_list("t").alias("ts"))
    joined = lists.join(bodies, "k").select("k", "body", "ts")

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in in_slices(batches):
            at, here = [], []
            for n, (body, ts) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                found = [t for t in ts if t in body] if len(ts) <= FEW else held_in(body, ts)
                at += [n] * len(found)
                here += found
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(here, pa.string())], ["k", "t"])

    return joined.mapInArrow(find, f"k {joined.schema['k'].dataType.simpleString()}, t string")


def held_in(body: str, passages: list[str]) -> list[str]:
    """The passages that a text holds, in one pass over it."""
    automaton = ahocorasick.Automaton()
    for t in passages:
        if t:
            automaton.add_word(t, t)
    empty = [""] if "" in passages else []
    if not len(automaton):
        return empty
    automaton.make_automaton()
    return empty + list({t for _, t in automaton.iter(body)})
