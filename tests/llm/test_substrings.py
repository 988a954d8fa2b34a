import hashlib
import random

import numpy as np
import pytest

from attestra.llm import substrings
from attestra.llm.substrings import Gathered, _answer, cut_text, dedup_digest, encoded, layout, merged, removed_words, repeats, super_kmers, buffer_of, without_repeats, word_pieces
from tests.llm.helpers import documents, frame, prose


def plain(rows, width=13):
    first, out = {}, {}
    words = {r[0]: (r[1] or "").encode().split() for r in rows}
    for i in sorted(words):
        for k in range(len(words[i]) - width + 1):
            first.setdefault(tuple(words[i][k : k + width]), i)
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - width + 1):
            if first[tuple(w[k : k + width])] < i:
                gone |= set(range(k, k + width))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def result(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


def every_minimiser(docs, keys, **_):
    texts = [r["text"] for r in docs.collect()]
    return frozenset(keys(texts)[1].tolist())


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed, hot):
    if hot:
        monkeypatch.setattr(substrings, "hot_keys", every_minimiser)
    rows = documents(seed, 120)
    rng = random.Random(seed)
    rng.shuffle(rows)
    assert result(dedup_digest(frame(spark, rows))) == plain(rows)


def test_same_passage_again_and_again_in_one_document(spark):
    p = prose(random.Random(3), 14)
    rows = [(i, t, *documents()[9][2:]) for i, t in ((5, f"{p} {p} {p}"), (2, f"x {p} y"), (9, "same " * 50), (3, "same " * 13))]
    assert result(dedup_digest(frame(spark, rows))) == plain(rows)


def test_null_id_is_the_last_and_repeated_rows_agree(spark):
    p = prose(random.Random(4), 20)
    tail = documents()[9][2:]
    out = dedup_digest(frame(spark, [(1, p, *tail), (1, p, *tail), (None, p, *tail)])).toPandas()
    assert out[out.doc_id == 1].n_removed.tolist() == [0, 0] and out[out.doc_id.isna()].n_removed.tolist() == [20]


def test_empty(spark):
    assert dedup_digest(frame(spark, [])).count() == 0 and without_repeats(frame(spark, [])).count() == 0


def test_cut_text_keeps_the_rest_as_it_is():
    text = "a  b\nc d\te  f "
    assert cut_text(text, [1 << 28 | 2]) == "a  d\te  f "
    assert cut_text(text, [4 << 28 | 2, 4 << 28 | 1]) == "a  b\nc d\t"
    assert cut_text(text, [0 << 28 | 6]) == ""


def test_without_repeats(spark):
    rows = documents(5, 60)
    docs = frame(spark, rows)
    out = without_repeats(docs)
    assert out.columns == docs.columns and out.count() == 60
    want = plain(rows)
    for r in out.collect():
        kept = b" ".join((r["text"] or "").encode().split())
        assert hashlib.sha256(kept).hexdigest() == want[r["doc_id"]][2]
        assert r["n_chars"] == (None if r["text"] is None else len(r["text"]))


def test_colliding_hashes_are_told_apart(monkeypatch):
    monkeypatch.setattr(substrings.bh, "ranges", lambda pre, start, end, base=0: np.zeros(len(start), dtype=np.uint64))
    lines = [b"a b c d", b"b c d e", b"x y z w", b"a b c q"]
    ids, count = np.array([4, 2, 1, 3]), np.array([2, 2, 2, 2])
    got = repeats(ids, count, b"\n".join(lines) + b"\n", 3)
    assert sorted(got) == [(0, 0, 3), (0, 1, 3)] or sorted(got) == [(0, 0, 4)]


def test_merged():
    spans = [(5, 0, 3), (5, 3, 2), (5, 9, 1), (2, 0, 4), (2, 1, 1)]
    assert merged(spans).T.tolist() == [[2, 0, 4], [5, 0, 5], [5, 9, 1]]
    assert merged([]).shape == (3, 0)


def test_rows_with_one_id_and_different_texts_lose_the_same_places(spark):
    p, q = prose(random.Random(4), 20), prose(random.Random(5), 26)
    tail = documents()[9][2:]
    out = dedup_digest(frame(spark, [(1, p, *tail), (2, p, *tail), (2, q, *tail)])).toPandas().sort_values(["doc_id", "n_words"])
    assert out.n_removed.tolist() == [0, 20, 20]


def test_runs_of_any_length():
    ids, spans = encoded(np.array([7, 8]), np.array([3, 5]), np.array([2 * substrings.LONGEST + 1, 4]))
    assert ids.tolist() == [7, 7, 7, 8]
    assert [(s >> 28, s & substrings.LONGEST) for s in spans.tolist()] == [(3, substrings.LONGEST), (3 + substrings.LONGEST, substrings.LONGEST), (3 + 2 * substrings.LONGEST, 1), (5, 4)]
    assert removed_words(9, [2 << 28 | 3, 8 << 28 | 9]).tolist() == [False, False, True, True, True, False, False, False, True]


@pytest.mark.parametrize("hot", [False, True])
@pytest.mark.parametrize("most", [1 << 30, 3000])
@pytest.mark.parametrize("cut", [1 << 22, 300])
def test_pieces_and_passes_change_nothing(monkeypatch, hot, most, cut):
    rows = [r for r in documents(7, 80) if r[1]]
    monkeypatch.setattr(substrings, "word_pieces", lambda ids, texts, window, size: word_pieces(ids, texts, window, cut))
    keys = frozenset(super_kmers(*buffer_of([r[1] for r in rows]), 13, 3).least.tolist()[::2]) if hot else frozenset()
    held = Gathered(1, 13, 3, keys)
    held.add([r[0] for r in rows], [r[1] for r in rows])
    spans = {}
    for batch in _answer(13, 3, keys, most)(held.rows()):
        for i, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            spans.setdefault(i, []).append(s)
    want = plain(rows)
    for r in rows:
        assert int(removed_words(len(r[1].split()), spans.get(r[0])).sum()) == want[r[0]][1]


def test_word_pieces_overlap_by_a_window():
    text = " ".join(f"w{i}" for i in range(100)) + " " + "x" * 500 + " y"
    ids, raw, first = word_pieces([4, 5], [text, None], 5, 60)
    words = text.encode().split()
    assert set(ids) == {4, 5} and raw[-1] == b"" and len(ids) > 5
    starts = [(int(f) + k) for f, r in zip(first[:-1], raw[:-1], strict=True) for k in range(len(r.split()) - 4)]
    assert starts == list(range(len(words) - 4))
    assert all(r.split() == words[f : f + len(r.split())] for f, r in zip(first[:-1].tolist(), raw[:-1], strict=True))


def test_buckets_follow_the_input(spark):
    n, small = layout(spark, 1 << 20)
    m, large = layout(spark, 1 << 40)
    assert n == substrings.partitions(spark) and small == substrings.FINER * n
    assert (1 << 40) * substrings.COPIES / large <= substrings.BUCKET and (1 << 40) * substrings.COPIES / m <= substrings.PART
