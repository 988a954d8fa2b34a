import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import zstandard

from attestra.llm import suffixes
from attestra.llm.suffixes import BlindTrie, common, dedup_bytes, deep_shallow, repeated_bytes, shared, union
from attestra.llm.substrings import with_spans
from tests.llm.helpers import documents, frame, prose


@pytest.mark.parametrize("seed", range(8))
def test_sorting(seed):
    rng = random.Random(seed)
    head = bytes(rng.choice(b"ab") for _ in range(rng.choice([0, 10, 40, 90])))
    strings = list({head + bytes(rng.choice(b"abc"[: 1 + seed % 3]) for _ in range(rng.randrange(60))) for _ in range(80)})
    rng.shuffle(strings)
    assert [strings[i] for i in deep_shallow(strings)] == sorted(strings)
    trie = BlindTrie(strings)
    for i in range(len(strings)):
        trie.insert(i)
    assert [strings[i] for i in trie.order()] == sorted(strings)


def test_sorting_keeps_equal_strings():
    strings = [b"x" * 50, b"x" * 50, b"x" * 49, b"", b"", b"x" * 33 + b"a"]
    assert [strings[i] for i in deep_shallow(strings)] == sorted(strings)
    assert sorted(deep_shallow(strings)) == list(range(6))


def test_common():
    assert [common(b"abc", b"abd"), common(b"abc", b"ab"), common(b"", b"x"), common(b"q" * 99 + b"a", b"q" * 99 + b"b")] == [2, 2, 0, 99]


@pytest.mark.parametrize("seed", range(12))
def test_shared_windows(seed):
    rng = random.Random(seed)
    width, core = 20, b"ANCHOR"
    made = set()
    while len(made) < rng.choice([2, 3, 12, 30]):
        left, right = (bytes(rng.choice(b"ab") for _ in range(rng.randrange(3, 14))) for _ in range(2))
        made.add((left + core + right + b"z" * rng.randrange(8), len(left)))
    strings, anchors = [m[0] for m in made], [m[1] for m in made]
    got = shared(strings, anchors, width, len(core))
    assert shared(strings, anchors, width) == got
    for i, (s, a) in enumerate(zip(strings, anchors, strict=True)):
        have = {d for low, high in got[i] for d in range(low, high + 1) if d <= a and a - d + width <= len(s)}
        want = set()
        for d in range(a + 1):
            w = s[a - d : a - d + width]
            others = (t[b - d : b - d + width] for j, (t, b) in enumerate(made) if j != i and b >= d)
            if len(w) == width and w in others:
                want.add(d)
        assert have == want


def plain(rows, width):
    raw = {r[0]: (r[1] or "").encode() for r in rows}
    seen = Counter(t[k : k + width] for t in raw.values() for k in range(len(t) - width + 1))
    out = {}
    for i, t in raw.items():
        gone = set()
        for k in range(len(t) - width + 1):
            if seen[t[k : k + width]] > 1:
                gone |= set(range(k, k + width))
        kept = bytes(c for k, c in enumerate(t) if k not in gone)
        spans = sum(k in gone and k - 1 not in gone for k in range(len(t)))
        out[i] = (len(t), len(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def every_anchor(docs, keys, **_):
    return frozenset(keys([r["text"] for r in docs.collect()])[1].tolist())


def some_anchors(docs, keys, **_):
    return frozenset(sorted(every_anchor(docs, keys))[::2])


def test_long_texts_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "SLICE", 150)
    rows = documents(3, 60)
    ids, raw, shift = suffixes.pieces([7, 8], ["ab" * 400, None], 400)
    assert ids == [7, 7, 7, 8] and shift == [0, 150, 300, 0] and [len(r) for r in raw] == [549, 549, 500, 0]
    seen = suffixes._Gathered(4, 400, (32,), frozenset())
    monkeypatch.undo()
    got = {r["doc_id"]: tuple(r)[1:] for r in dedup_bytes(frame(spark, rows)).collect()}
    assert got == plain(rows, 400) and seen.size == 0


@pytest.mark.parametrize("slice_", [40, 333, 1 << 20])
def test_pieces_give_the_same_spans(monkeypatch, slice_):
    monkeypatch.setattr(suffixes, "SLICE", slice_)
    rows = [r for r in documents(3, 60) if r[1]]
    held = suffixes._Gathered(1, 60, (16,), frozenset())
    held.add([r[0] for r in rows], [r[1] for r in rows])
    spans: dict[int, list[int]] = {}
    for batch in held.rows():
        for kind, blob in zip(batch["kind"].to_pylist(), batch["packed"].to_pylist(), strict=True):
            found = suffixes.bucket_spans([blob], 60, (16,))
            if kind:
                found = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=np.int64).reshape(3, -1).T.tolist()
            for i, a, n in found:
                spans.setdefault(i, []).append(a << 28 | n)
    want = plain(rows, 60)
    for r in rows:
        runs = union(len(r[1].encode()), spans.get(r[0]))
        assert (sum(z - a for a, z in runs), len(runs)) == want[r[0]][1:3]


@pytest.mark.parametrize("hot", [None, some_anchors, every_anchor])
@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, monkeypatch, seed, hot):
    if hot:
        monkeypatch.setattr(suffixes, "hot_keys", hot)
    rows = documents(seed, 90)
    got = {r["doc_id"]: tuple(r)[1:] for r in dedup_bytes(frame(spark, rows)).collect()}
    assert got == plain(rows, 400)


@pytest.mark.parametrize("seed", range(3))
def test_short_strings_and_repetitive_texts(spark, seed):
    rng = random.Random(seed)
    part = "".join(rng.choice("ab") for _ in range(30))
    texts = [part * 3, "a" * 70, "a" * 45, "b" + part + "c", prose(rng, 30) + part, "é" * 25 + part, part[5:] + "é" * 30, ""]
    rows = [(i, t, *documents()[9][2:]) for i, t in enumerate(texts)]
    docs = frame(spark, rows).select("doc_id", "text")
    spans = {r["doc_id"]: r["_spans"] for r in with_spans(docs, repeated_bytes(docs, 24, (6, 12))).collect()}
    want = plain(rows, 24)
    for i, t in enumerate(texts):
        runs = union(len(t.encode()), spans[i])
        assert (sum(z - a for a, z in runs), len(runs)) == want[i][1:3]


def test_null_ids_repeated_rows_and_empty(spark):
    assert dedup_bytes(frame(spark, [])).count() == 0
    t, tail = prose(random.Random(1), 150), documents()[9][2:]
    out = dedup_bytes(frame(spark, [(1, t, *tail), (1, t, *tail), (None, t, *tail)])).toPandas()
    assert (out.n_removed == len(t)).all() and (out.n_spans == 1).all()


@pytest.mark.parametrize("step", [0, 1, 2])
@pytest.mark.parametrize("most", [1 << 30, 2000])
def test_passes_change_nothing(step, most):
    rows = [r for r in documents(6, 70) if r[1]]
    _, found, *_, keys, _ = suffixes.anchored([r[1] for r in rows], 60, 16)
    hot = frozenset(keys.tolist()[::step]) if step else frozenset()
    held = suffixes._Gathered(1, 60, (16, 30), hot)
    held.add([r[0] for r in rows], [r[1] for r in rows])
    spans: dict[int, list[int]] = {}
    for batch in suffixes._answer(60, (16, 30), most)(held.rows()):
        for i, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            spans.setdefault(i, []).append(s)
    want = plain(rows, 60)
    for r in rows:
        runs = union(len(r[1].encode()), spans.get(r[0]))
        assert (sum(z - a for a, z in runs), len(runs)) == want[r[0]][1:3]


def test_the_quicksort_splits_what_an_anchor_shares(monkeypatch):
    rng = random.Random(1)
    strings = [b"l" * 10 + b"A" * 32 + bytes(rng.randrange(256) for _ in range(400)) for _ in range(300)]
    in_tries = []
    monkeypatch.setattr(suffixes.BlindTrie, "insert", lambda self, i, insert=BlindTrie.insert: (in_tries.append(len(self.strings[i])), insert(self, i))[1])
    shared(strings, [10] * 300, 400, 32)
    assert not [n for n in in_tries if n == 400]
