import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from attestra.llm import divergence
from tests.llm.helpers import DOCS, documents, frame

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, top):
    """All pairs and terms, densely."""
    count, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for row in rows:
        text, lang, source = (x or "" for x in row[1:4])
        terms = TERM.findall(text.translate(LOWER))
        groups.add((lang, source))
        count[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)

        def shares(of, kept=kept, v=v):
            n = sum(of[t] for t in kept)
            return {t: 1 + 10**9 * (of[t] + 5) // (n + 5 * v) for t in kept}

        mine, whole = shares(count[lang, source]), shares(sum((count[g] for g in groups if g[0] == lang), Counter()))
        pairs = []
        for other in (s for g, s in groups if g == lang and s != source):
            theirs = shares(count[lang, other])
            pairs.append((-sum(abs(mine[t] - theirs[t]) for t in kept), other.encode()))
        terms = [(whole[t] - mine[t], t.encode()) for t in kept if count[lang, source][t] and mine[t] > whole[t]]
        for part, found in (("pair", pairs), ("term", sorted(terms)[:top])):
            out |= {(lang, source, part, item.decode(), -value, i) for i, (value, item) in enumerate(sorted(found), 1)}
    return out


def result(df):
    got = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    return set(got)


@pytest.mark.parametrize("sent", [100_000, 0])
@pytest.mark.parametrize("least, top", [(1, 3), (4, 50), (1000, 5)])
def test_all_pairs_and_terms(spark, monkeypatch, sent, least, top):
    monkeypatch.setattr(divergence, "SENT", sent)
    rows = documents(7, 90)
    rows += [(1000 + i, "éA Éa zz ZZ, ünï-x1y", "en", s, 1, 7, "x", 0.5, "y", "z", None) for i, s in enumerate(["a", "ß", "zz", None, "a"])]
    rows += [(2000, "1 2 3 -- _", "xx", "only", 1, 7, "x", 0.5, "y", "z", None), rows[9], rows[9]]
    assert result(divergence.divergence(frame(spark, rows), least, top)) == brute(rows, least, top)


def test_no_rows(spark):
    assert not result(divergence.divergence(frame(spark, []), 1))


def test_long_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 50)
    monkeypatch.setattr(divergence, "HELD", 5)
    rng = random.Random(2)
    words = ["a", "bb", "é" * 40, "x" * 120, "D", "ee"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(200)), "en", f"s{i % 3}", 1, 7, "x", 0.5, "y", "z", None) for i in range(8)]
    assert result(divergence.divergence(frame(spark, rows, DOCS), 1, 4)) == brute(rows, 1, 4)


@pytest.mark.parametrize("small", [True, False])
@pytest.mark.parametrize("k", [1, 7, 40])
def test_radix_top(spark, small, k):
    """Groups of one value, of long common beginnings, of items that begin others, of large values."""
    rng = random.Random(k)
    rows = []
    for g in range(6):
        items = {"".join(rng.choice("aé\U0001f600z") for _ in range(rng.randrange(6))) for _ in range(60)} | {"long" * 30 + c for c in "abé"} | {"q" * n for n in range(30)}
        values = [[5], [0, 1], [2**40, 2**40 - 1, 3], list(range(2000)), [1023, 1024, 1025], [0]][g]
        rows += [(g, rng.choice(values), i) for i in items]
    rows += [(9, 3, "alone")]
    table = spark.createDataFrame(rows, "g int, v long, i string").repartition(3)
    want = {r for g in {r[0] for r in rows} for r in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[1], r[2].encode()))[:k]}
    assert {tuple(r) for r in divergence.radix_top(table, ["g"], "v", "i", k, small).select("g", "v", "i").collect()} == want


def test_term_counts_leave_tasks_summed(spark):
    """A group with most rows leaves a task as its vocabulary."""
    docs = spark.range(4000).select(F.lit("one two two").alias("text"), F.lit("en").alias("lang"), F.lit("hot").alias("source")).coalesce(2)
    assert {(r.term.decode(), r.n, r.docs) for r in divergence.term_counts(docs).collect()} == {("one", 4000, 4000), ("two", 8000, 4000)}
