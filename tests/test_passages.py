"""Passages by fingerprints against plain containment."""

import random

import numpy as np
import pytest

from attestra.operators import passages, quality
from attestra.session import kept


def texts_and_passages(seed):
    rng = random.Random(seed)
    letters = "ab é\U0001f600c"
    texts = [(k, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 900)))) for k in range(12)]
    texts += [(50, "abc " * 400), (51, ""), (52, None), (53, "x" * 700)]
    asked = []
    for k, t in texts:
        for _ in range(12):
            size = rng.randrange(0, 70)
            at = rng.randrange(max(1, len(t or "") - size))
            part = (t or "abcdefgh")[at : at + size]
            if rng.random() < 0.5 and part:
                spot = rng.randrange(len(part))
                part = part[:spot] + rng.choice("azé") + part[spot + 1 :]
            asked.append((k, part))
        asked += [(k, None), (k, "abc abc abc abc abc "), (k, "x" * 40)]
    return texts, asked + [(99, "no text of this key")]


@pytest.mark.parametrize("piece", [1 << 20, 40])
@pytest.mark.parametrize("seed", range(3))
def test_as_contained(spark, monkeypatch, seed, piece):
    monkeypatch.setattr(passages, "PIECE", piece)
    texts, asked = texts_and_passages(seed)
    body = dict(texts)
    want = {(k, p) for k, p in asked if p is not None and body.get(k) is not None and p in body[k]}
    frame = lambda rows: spark.createDataFrame(rows, "k int, t string").repartition(3)
    got = [tuple(r) for r in passages.standing(frame(asked), frame(texts)).collect()]
    assert set(got) == want and len(got) == len(want)


def test_a_window_chooses_alike_wherever_it_stands():
    rng = np.random.default_rng(1)
    size = passages.GRAM + passages.WINDOW - 1
    text = rng.integers(97, 101, 5000).astype(np.uint32)
    whole = set(passages.chosen(text).tolist())
    for at in range(0, 5000 - size, 7):
        (one,) = passages.chosen(text[at : at + size]).tolist()
        assert at + one in whole
    assert len(whole) < 0.35 * len(text)


def test_long_source_of_many_paragraphs(spark):
    """Ten thousand paragraphs in one source, every tenth left out of the chunks."""
    paras = [f"paragraph {i} " + f"tells of {i * i} and {i * 7919} things that are counted in it at some length" for i in range(10_000)]
    source = spark.createDataFrame([("a", "\n\n".join(paras)), ("b", "# " + "x" * 80)], "ref_id string, source_text string")
    chunks = spark.createDataFrame([("a", i, p) for i, p in enumerate(paras) if i % 10], "ref_id string, chunk_index int, text string")
    assert {tuple(r) for r in quality.paragraph_coverage(source, chunks).collect()} == {("a", 10_000, 9_000), ("b", 1, 1)}
    assert {tuple(r) for r in quality.text_fidelity(chunks, source).collect()} == {("a", 9_000, 9_000)}


def test_none(spark):
    none = spark.createDataFrame([], "k int, t string")
    assert not passages.standing(none, none).collect()


def test_texts_are_shuffled_once(spark):
    """A text and its passages: 3 MB and less; grams of it took over ten times as much."""
    rng = random.Random(3)
    rows = [(k, "".join(rng.choice("abcdefghij klmnop") for _ in range(5_000))) for k in range(600)]
    asked = [(k, t[at : at + 50]) for k, t in rows for at in range(0, 5_000, 500)]
    frame = lambda r: spark.createDataFrame(r, "k int, t string").repartition(3)
    texts, passages_ = kept(frame(rows)), kept(frame(asked))
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    before = written()
    assert passages.standing(passages_, texts).count() == len(set(asked))
    assert written() - before < 6_000_000


def test_many_passages_in_parts(spark, monkeypatch):
    monkeypatch.setattr(passages, "LISTED", 7)
    texts, asked = texts_and_passages(4)
    body = dict(texts)
    frame = lambda rows: spark.createDataFrame(rows, "k int, t string")
    got = [tuple(r) for r in passages.standing(frame(asked), frame(texts)).collect()]
    want = {(k, p) for k, p in asked if p is not None and body.get(k) is not None and p in body[k]}
    assert set(got) == want and len(got) == len(want)
