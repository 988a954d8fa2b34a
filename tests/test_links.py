"""Pairs by number and words against plain Python, and what they move."""

import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attestra.operators import links, quality


def moved(spark) -> int:
    """Bytes shuffled so far."""
    return spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()


def plain(left, right, stop, pair, least=2):
    read = lambda t: (set(re.findall(r"\d+\.?\d*%?", t)), set(t.lower().split(" ")) - set(stop))
    l_, r_ = ({i: read(t) for i, t in d if t is not None} for d in (left, right))
    return {(a, b, len(x[1] & y[1])) for a, x in l_.items() for b, y in r_.items() if pair(a, b) and x[0] & y[0] and len(x[1] & y[1]) >= least}


def texts(seed, n, first=0):
    rng = random.Random(seed)
    words = "dose Dose trial arm the of 5% 3.5 12 7 12. été x  y".split(" ")
    return [(first + i, None if i % 11 == 3 else " ".join(rng.choice(words) for _ in range(rng.randrange(9)))) for i in range(n)]


@pytest.mark.parametrize("block, columns", [(1024, 2048), (3, 2)])
def test_as_plain(spark, monkeypatch, block, columns):
    monkeypatch.setattr(links, "BLOCK", block)
    monkeypatch.setattr(links, "COLUMNS", columns)
    one, two = texts(1, 60), texts(2, 40, first=30)
    frame = lambda rows: spark.createDataFrame(rows, "id long, text string").repartition(3)
    t = frame(one)
    got = [tuple(r) for r in quality.number_and_word_links(t, t, ["the", "of"], F.col("a") < F.col("b")).collect()]
    want = plain(one, one, ["the", "of"], lambda a, b: a < b)
    assert len(got) == len(want) > 50 and set(got) == want
    got = [tuple(r) for r in quality.number_and_word_links(t, frame(two), ["the"]).collect()]
    want = plain(one, two, ["the"], lambda a, b: True)
    assert len(got) == len(want) > 50 and set(got) == want


def test_pairs_do_not_take_their_texts_along(spark):
    """400 texts of one number are 79,800 pairs; their texts are 0.6 MB."""
    rng = random.Random(5)
    rows = [(i, "7 same words " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))) for i in range(400)]
    t = spark.createDataFrame(rows, "id long, text string")
    before = moved(spark)
    assert quality.number_and_word_links(t, t, [], F.col("a") < F.col("b")).count() == 79_800
    assert moved(spark) - before < 30_000_000


def test_shuffle_grows_with_the_texts_not_with_their_pairs(spark):
    """Four times the texts of one number are sixteen times the pairs, and four times the bytes."""

    def of(n):
        rng = random.Random(6)
        rows = [(i, "7 " + " ".join("".join(rng.choices(string.ascii_lowercase, k=10)) for _ in range(25))) for i in range(n)]
        t = spark.createDataFrame(rows, "id long, text string")
        before = moved(spark)
        assert quality.number_and_word_links(t, t, [], F.col("a") < F.col("b")).count() == 0
        return moved(spark) - before

    assert of(8400) < 5 * of(2100)


@pytest.mark.parametrize("tasks, chars, block", [(64, 1 << 25, 1024), (10**6, 1 << 25, 4), (1, 60, 1024), (2, 1 << 25, 3)])
def test_each_pair_once(spark, monkeypatch, tasks, chars, block):
    """Blocks of few texts, of few characters, and one block; ids are strings whose order is not that of the rows."""
    for name, value in (("TASKS", tasks), ("CHARS", chars), ("BLOCK", block), ("LEAST", 1)):
        monkeypatch.setattr(links, name, value)
    rows = [(f"t{i * 7919 % 1000}", t) for i, t in [*texts(3, 70), (70, "5%"), (71, "5% 5%"), (72, ""), (73, "12  12"), (74, "12  y")]]
    t = spark.createDataFrame(rows, "id string, text string").repartition(3)
    for stop, least in ((["the", "of"], 2), (["5%", "12"], 0)):
        got = [tuple(r) for r in quality.number_and_word_links(t, t, stop, least=least, once=True).collect()]
        want = plain(rows, rows, stop, lambda a, b: a < b, least)
        assert len(got) == len(want) > 50 and set(got) == want


@pytest.mark.parametrize("dense", [-1, 0.1, 2])
def test_shared_values(monkeypatch, dense):
    """All values by products, some, and none; tiles that do not divide the rows; few pairs at once."""
    for name, value in (("DENSE", dense), ("AT_ONCE", 9)):
        monkeypatch.setattr(links, name, value)
    rng = random.Random(7)
    lists = [rng.sample(range(40), rng.choice([0, 1, 5, 30])) for _ in range(45)]
    words = pa.array([" ".join(map(str, x)) or None for x in lists])
    for one, two in ((range(0, 45, 2), range(1, 45, 2)), (range(45), range(45))):
        got = links.Shared([words[:10], words[10:]], (np.array(one), np.array(two)), 7, 5)
        for x in range(len(got.tiles[0])):
            for y in range(len(got.tiles[1])):
                for (i, j), n in np.ndenumerate(got.of(x, y)):
                    a, b = one[7 * x + i], two[7 * y + j]
                    assert a == b or n == len({*lists[a]} & {*lists[b]})
