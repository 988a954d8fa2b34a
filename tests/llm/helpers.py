"""Small tables with what real ones hold: nulls, empties, copies, repeated rows, clashing columns."""

from __future__ import annotations

import random

import pandas as pd

WORDS = "the of river stone and light under seven hollow green letters walk over quiet field morning to in glass paper window north".split()
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, span string, fp double, c0 string, h string, key string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    """Rows for DOCS: exact and near copies, shared passages, nulls, empty and long texts, extra columns."""
    rng = random.Random(seed)
    texts: list[str | None] = [None, "", " \n\t ", "one", "two words", "É\x0bÀ ß"]
    passage = prose(rng, 30)
    while len(texts) < n:
        kind = rng.randrange(6)
        if kind == 0 and len(texts) > 8:
            texts.append(rng.choice(texts))
        elif kind == 1 and len(texts) > 8 and (t := rng.choice(texts)):
            words = t.split()
            if words:
                words[rng.randrange(len(words))] = "changed"
            texts.append(" ".join(words))
        elif kind == 2:
            texts.append(f"{prose(rng, rng.randrange(20))}\n{passage} {prose(rng, rng.randrange(20))}")
        elif kind == 3:
            texts.append(prose(rng, 400))
        else:
            texts.append(prose(rng, rng.randrange(5, 80)))
    rows = []
    for i, t in enumerate(texts):
        rows.append((i * 3, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", "é", None]), None if t is None else len(t), 7, "x", 0.5, "y", "z", None))
    return rows


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema).repartition(3) if rows else spark.createDataFrame([], schema)


def rows_of(df, *order) -> list[tuple]:
    p = df.toPandas()
    return sorted((tuple(None if pd.isna(v) else v for v in r) for r in p[list(order) or list(p.columns)].itertuples(index=False)), key=repr)


def union_find(n: int, edges) -> list[int]:
    p = list(range(n))

    def find(i):
        while p[i] != i:
            i = p[i]
        return i

    for a, b in edges:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]
