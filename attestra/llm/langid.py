"""Language identification by error-correcting output codes."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm.common import bound_batches, first_by_hash, table

#: Slots of hashed byte n-grams; the first 256 are single bytes.
DIM = 4096
#: Bytes whose n-grams are counted at once.
SLICE = 1 << 20
LETTER = re.compile(r"[^\W\d_]")
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
#: ASCII digits, signs and white space are all one blank: they say nothing of the language.
_LOW[[x for x in range(128) if not (65 <= x <= 90 or 97 <= x <= 122)]] = 32


def features(text: str | None) -> np.ndarray:
    """Square roots of the counts of byte n-grams of length 1 to 3, of unit length."""
    raw = (" " + (text or "") + " ").encode("utf-8", "surrogatepass")
    x = _LOW[np.frombuffer(raw, dtype=np.uint8)]
    blank = x == 32
    x = x[~(blank & np.concatenate(([False], blank[:-1])))]
    count = np.bincount(x, minlength=DIM)
    count[32] = 0
    span = np.uint32(DIM - 256)
    for k in range(0, len(x) - 1, SLICE):  # long texts piece by piece; a piece sees the next two bytes
        y = x[k : k + SLICE + 2].astype(np.uint32)
        two = y[:-1] | (y[1:] << np.uint32(8))
        three = two[:-1] | (y[2:] << np.uint32(16))
        h2 = ((two[:SLICE] * np.uint32(2654435761)) >> np.uint32(7)) % span + np.uint32(256)
        h3 = ((three * np.uint32(2246822519)) >> np.uint32(7)) % span + np.uint32(256)
        count += np.bincount(h2, minlength=DIM) + np.bincount(h3, minlength=DIM)
    v = np.sqrt(count.astype(np.float32))
    return v / max(float(np.linalg.norm(v)), 1e-6)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """A row of +1 and -1 per language.  Up to five languages: all different splits; more: the
    columns of the best of many drawn matrices by smallest distance between rows."""
    if n < 2:
        return np.zeros((n, 0), dtype=np.float32)
    if n <= 5:
        cols = [(1, *c) for c in product((1, -1), repeat=n - 1)][1:]
        return np.array(cols, dtype=np.float32).T
    rng, bits, best = np.random.default_rng(seed), max(15, 4 * int(np.ceil(np.log2(n)))), None
    for _ in range(200):
        m = rng.choice(np.array([1, -1], dtype=np.float32), (n, bits))
        apart = (bits - m @ m.T) / 2 + np.eye(n) * bits
        usable = (np.abs(m.sum(0)) < n).all()
        if usable and (best is None or apart.min() > best[0]):
            best = (apart.min(), m)
    return best[1] if best else m


@dataclass
class Model:
    langs: list[str]
    code: np.ndarray  # languages x bits
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # of each bit

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Of each language: the trusted logistic losses of its codeword's bits."""
        margin = x @ self.weights + self.bias
        return np.stack([(np.logaddexp(0, -margin * c) * self.trust).sum(1) for c in self.code], axis=1)


def fit(x: np.ndarray, y: np.ndarray, langs: list[str], steps: int = 150) -> Model:
    """One logistic classifier per bit, all at once, by accelerated gradient steps; a fifth of
    the rows is kept from a first fit to see how far each bit can be trusted."""
    code = codewords(len(langs))
    goal = code[y]
    n = np.bincount(y, minlength=len(langs)).astype(np.float32)
    weight = (1.0 / n[y])[:, None] / len(langs)

    def solve(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        w, b = np.zeros((x.shape[1], code.shape[1]), dtype=np.float32), np.zeros(code.shape[1], dtype=np.float32)
        vw, vb = np.zeros_like(w), np.zeros_like(b)
        xs, gs, ws = x[rows], goal[rows], weight[rows] / weight[rows].sum()
        for _ in range(steps):
            g = -gs * ws / (1 + np.exp(np.clip(gs * (xs @ w + b), -30, 30)))
            vw = 0.9 * vw - 4.0 * (xs.T @ g + 1e-5 * w)
            vb = 0.9 * vb - 4.0 * g.sum(0)
            w, b = w + vw, b + vb
        return w, b

    held = np.arange(len(y)) % 5 == 0
    trust = np.ones(code.shape[1], dtype=np.float32)
    if code.shape[1] and (~held).sum() >= 10:
        w, b = solve(np.flatnonzero(~held))
        right = ((x[held] @ w + b) * goal[held] > 0).mean(0)
        trust = np.clip(2 * right - 1, 0.05, 1).astype(np.float32)
    w, b = solve(np.arange(len(y)))
    return Model(langs, code, w * 4, b * 4, trust)


def sample(docs: DataFrame, learn, rows: int, most: int) -> tuple[DataFrame, list[str]]:
    """lang, text of at most ``rows`` learnable documents, as many of each language as there are,
    the first by hash of their id; and the languages there are to learn: at most ``most``, those with the
    most documents."""
    known = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    known = known.select(F.col("doc_id").cast("long").alias("id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    langs = sorted(r[0] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect())
    known = known.where(F.col("lang").isin(langs))
    ids = first_by_hash(known.select("id", "lang"), "lang", max(1, rows // max(1, len(langs)))).select("id").distinct()
    # at most `rows` ids (or one for each language): small enough for every executor
    return known.join(F.broadcast(ids), "id", "left_semi"), langs


def train(docs: DataFrame, learn, rows: int = 1600, most: int = 400) -> Model:
    """rows bounds the documents that are learned from, most the languages; each document gives its whole
    text and two short parts of it, so that short texts are known too."""
    texts, langs = sample(docs, learn, rows, most)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, names, vectors = [], [], []
            for i, lang, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not text or not LETTER.search(text):
                    continue
                n = len(text)
                for part in (text, text[n // 3 : n // 3 + 120], text[n // 2 : n // 2 + 30]):
                    if LETTER.search(part):
                        ids.append(i)
                        names.append(lang)
                        vectors.append(features(part).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(names, pa.string()), pa.array(vectors, pa.binary())], ["id", "lang", "v"])

    bound_batches(docs.sparkSession)
    got = sorted((r["id"], r["lang"], bytes(r["v"])) for r in texts.mapInArrow(run, "id long, lang string, v binary").collect())
    langs = sorted({r[1] for r in got}) or langs
    place = {name: i for i, name in enumerate(langs)}
    y = np.array([place[r[1]] for r in got], dtype=np.int64)
    x = np.frombuffer(b"".join(r[2] for r in got), dtype=np.float16).astype(np.float32).reshape(-1, DIM)
    if not len(y):
        return Model(langs, codewords(0), np.zeros((DIM, 0)), np.zeros(0), np.zeros(0))
    return fit(x, y, langs)


def identify(docs: DataFrame, model: Model, gap: float = 0.2) -> DataFrame:
    """doc_id, lang_pred, score, ambiguous, runner_up for every row.

    The language whose codeword has the least weighted loss; score is its share of exp(-loss).
    ambiguous: the next language's share is within ``gap``.  Null texts, texts without a letter,
    and all texts when nothing could be learned: ``und``, score 0.  Of languages that are equally near
    the first by name.  Long texts are counted piece by piece.  Only doc_id and text are read of the
    columns.  One row in, one row out, repeated rows and null ids included; no rows: no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in batches:
            texts = b.column(1).to_pylist()
            pred, score, unsure, second = ["und"] * len(texts), [0.0] * len(texts), [False] * len(texts), [None] * len(texts)
            known = [i for i, t in enumerate(texts) if t and LETTER.search(t)] if m.langs else []
            for k in range(0, len(known), 256):
                part = known[k : k + 256]
                loss = m.losses(np.stack([features(texts[i]) for i in part]))
                p = np.exp(loss.min(1, keepdims=True) - loss)
                p /= p.sum(1, keepdims=True)
                order = np.argsort(-p, axis=1, kind="stable")
                for i, row, o in zip(part, p, order, strict=True):
                    pred[i], score[i] = m.langs[o[0]], float(row[o[0]])
                    if len(o) > 1:
                        second[i], unsure[i] = m.langs[o[1]], bool(row[o[0]] - row[o[1]] < gap)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred), pa.array(score), pa.array(unsure, pa.bool_()), pa.array(second, pa.string())], ["doc_id", "lang_pred", "score", "ambiguous", "runner_up"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, lang_pred string, score double, ambiguous boolean, runner_up string")


def remainder(of: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs, remainder(4) != 2))
    return found.withColumn("held_out", F.coalesce(remainder(4) == 2, F.lit(False)))
