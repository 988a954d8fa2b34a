"""Toxicity by a grammar of weighted finite-state transducers."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import bytehash as bh
from attestra.llm.common import bound_batches, by_place, first_by_hash, materialise, table

#: Word classes that are known beforehand; words of all classes are learned besides, in any language.
INSULTS = "idiot moron stupid imbecile dumb loser trash garbage scum vermin clown worthless pathetic disgusting filthy retard bastard bitch asshole jerk parasite".split()
THREATS = "kill hurt murder shoot stab beat burn destroy crush hang strangle punch".split()
TARGETS = "you your yours u ya they them he him she her everyone people".split()
NEGATIONS = "not no never isn aren wasn don doesn didn nobody without nor hardly".split()
REPORTS = "said says say wrote writes called quoted claims claimed reported according tweeted".split()

#: Letters of a class string: other word, insult, threat, target, negation, report.
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = "oityne"


class Transducer:
    """Deterministic, weighted: step(state, letter) gives the next state and a factor."""

    def __init__(self, step, start=0) -> None:
        self.step, self.start = step, start

    def __mul__(self, other: Transducer) -> Transducer:
        """Both read the same letters; states pair up and factors multiply."""

        def step(state, letter):
            (a, x), (b, y) = self.step(state[0], letter), other.step(state[1], letter)
            return (a, b), x * y

        return Transducer(step, (self.start, other.start))


#: What an insult weighs that is aimed at nobody, and how much more an aimed one; factors of what is negated and reported.
ALONE, AIMED, NEGATED, REPORTED = 0.4, 2.5, 0.3, 0.4
#: Words over which a target reaches, and a negation.
REACH, NEAR = 4, 3


def _hits(state: int, letter: str):
    """Insults count a little by themselves, threats when a target follows or precedes in four words."""
    near = REACH if letter == TARGET else max(0, state % 10 - 1)
    due = REACH if letter == THREAT else max(0, state // 10 - 1)
    if letter == INSULT:
        return near + 10 * due, ALONE
    if letter == THREAT and near or letter == TARGET and due:
        return near, 1.0
    return near + 10 * due, 0.0


def _aimed(state: int, letter: str):
    """An insult within four words of a target weighs more."""
    return (REACH if letter == TARGET else max(0, state - 1)), AIMED if letter == INSULT and state else 1.0


def _negated(state: int, letter: str):
    """Less weight up to three words after a negation."""
    return (NEAR if letter == NEGATION else max(0, state - 1)), NEGATED if letter in (INSULT, THREAT, TARGET) and state else 1.0


def _reported(state: int, letter: str):
    """Less weight in what someone is reported to have said."""
    return (1 if letter == REPORT else state), REPORTED if state else 1.0


GRAMMAR = Transducer(_hits) * Transducer(_aimed) * Transducer(_negated) * Transducer(_reported)
_table: dict = {}


def clause_score(letters: list[str], weights: list[float]) -> float:
    """Sum of what the composed transducer puts out, each by the weight of its word."""
    state, total = GRAMMAR.start, 0.0
    for letter, weight in zip(letters, weights, strict=True):
        key = (state, letter)
        got = _table.get(key)
        if got is None:
            got = _table[key] = GRAMMAR.step(*key)
        state, factor = got
        if factor:
            total += factor * weight
    return total


WORDS = re.compile(rb"[a-z\x80-\xff]+")
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes of a text that are read at once, to the end of a clause.
SLICE = 1 << 20
_CLAUSE_END = re.compile(rb"[.!?;\n]")
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".!?;\n"]] = True
#: Learned entries: whole words, and beginnings of so many bytes.
SHORT, LONG = 4, 7


def entries(word: bytes) -> list[bytes]:
    return [word + b"$", *(word[:n] for n in range(SHORT, LONG + 1) if len(word) >= n)]


@dataclass
class Model:
    lexicon: dict[bytes, float]
    bias: float = -3.0
    slope: float = 3.5
    threats: dict[bytes, float] = field(default_factory=dict)
    roles: dict[bytes, str] = field(default_factory=dict)
    classes: dict[bytes, str] = field(default_factory=dict)
    keys: np.ndarray | None = None
    memo: dict[bytes, tuple[str, float]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.classes |= self.roles | dict.fromkeys(self.threats, THREAT)
        for letter, words in ((THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            self.classes |= dict.fromkeys((w.encode() for w in words), letter)
        begins = {e[:-1][:4] if e.endswith(b"$") else e[:4] for e in self.lexicon} | {w[:4] for w, x in self.classes.items() if x == THREAT}
        self.keys = np.array(sorted(int.from_bytes(b.ljust(4, b"\0"), "little") for b in begins), dtype=np.uint32)

    def weight(self, word: bytes) -> float:
        return max((self.lexicon.get(e, 0.0) for e in entries(word)), default=0.0)

    def known(self, word: bytes) -> tuple[str, float]:
        """Class and weight of a word, remembered for a while."""
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > 200_000:
                self.memo.clear()
            letter, value = self.classes.get(word), self.threats.get(word, 1.0)
            if letter is None:
                value = self.weight(word)
                letter = INSULT if value > 0 else OTHER
            got = self.memo[word] = (letter, value)
        return got

    def read(self, low: bytes) -> float:
        """Total of the scores of the clauses that match."""
        return sum(clause_score(letters, weights) for _, letters, weights in self.clauses(low))

    def clauses(self, low: bytes) -> Iterator[tuple[list[bytes], list[str], list[float]]]:
        """Words, classes and weights of the clauses that hold an insult or a threat."""
        at = 0
        while at < len(low):  # long texts piece by piece, cut where a clause ends
            end = _CLAUSE_END.search(low, at + SLICE)
            stop = end.end() if end else len(low)
            yield from self._clauses(low[at:stop] if at or end else low)
            at = stop

    def _clauses(self, low: bytes) -> Iterator[tuple[list[bytes], list[str], list[float]]]:
        data = np.frombuffer(low, dtype=np.uint8)
        text = _LETTER[data]
        edge = np.flatnonzero(np.diff(text, prepend=False, append=False))
        starts, ends = edge[::2], edge[1::2]
        if not len(starts) or not len(self.keys):
            return
        padded = np.concatenate((np.where(text, data, 0), np.zeros(4, dtype=np.uint8))).astype(np.uint32)
        size = np.minimum(ends - starts, 4)
        code = padded[starts]
        for j in (1, 2, 3):
            code |= np.where(size > j, padded[starts + j] << np.uint32(8 * j), np.uint32(0))
        at = np.minimum(np.searchsorted(self.keys, code), len(self.keys) - 1)
        near = np.flatnonzero(self.keys[at] == code)
        spots = [a for a, z in zip(starts[near].tolist(), ends[near].tolist(), strict=True) if self.known(low[a:z])[0] in (INSULT, THREAT)]
        if not spots:
            return
        stops = np.flatnonzero(_ENDS[data])
        done = -1
        for spot in spots:
            if spot < done:
                continue
            k = int(np.searchsorted(stops, spot))
            begin = int(stops[k - 1]) + 1 if k else 0
            done = int(stops[k]) if k < len(stops) else len(low)
            words = WORDS.findall(low, begin, done)
            known = [self.known(w) for w in words]
            yield words, [k[0] for k in known], [k[1] for k in known]

    def curve(self, total: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.bias + self.slope * np.log1p(total), -30, 30))))

    def score(self, text: str | None) -> float:
        return self.curve(self.read(_low(text)))


def _low(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def lexicon(counts: list[tuple[bytes, float, float]], toxic: int, clean: int, known: Iterable[str] = INSULTS) -> dict[bytes, float]:
    """Weights of insult entries: log odds of documents, scaled to about 1, less for little evidence.

    counts: entry, toxic and clean documents with it.  An entry is learned when it is in
    three toxic documents at least, oftener than by chance, and over 12 times as
    likely there.  Insults known beforehand stay unless the rows speak against them.
    """
    base = (toxic + 1) / (toxic + clean + 2)
    seen = {e: (t, c) for e, t, c in counts if not e.endswith(AT)}
    alone: dict[bytes, float] = {}  # of each beginning, the toxic documents with its commonest word
    for e, (t, _) in seen.items():
        if e.endswith(b"$"):
            for n in range(SHORT, min(LONG, len(e) - 1) + 1):
                alone[e[:n]] = max(alone.get(e[:n], 0), t)
    out = {}
    for e, (t, c) in seen.items():
        if not e.endswith(b"$") and alone.get(e, 0) >= 0.8 * t:
            continue  # one word, not a family
        odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
        lift = t / max(1e-9, (t + c) * base)
        surprise = 2 * t * np.log(lift) if lift > 1 else 0.0
        if t >= 3 and odds > np.log(12) and surprise >= 15:
            out[e] = float(min(odds, 6.0) / 4 * min(1.0, surprise / 40))
    for w in known:
        t, c = seen.get(w.encode() + b"$", (0, 0))
        if t + c < 3 or t > 3 * base * (t + c):
            out.setdefault(w.encode() + b"$", 1.0)
    return out


def aimed_words(low: bytes) -> set[bytes]:
    """Words that stand within four words of a known target, in its clause."""
    out: set[bytes] = set()
    for m in _TARGET.finditer(low):
        begin = max((low.rfind(c, max(0, m.start() - 200), m.start()) + 1 for c in (b".", b"!", b"?", b";", b"\n")), default=0)
        end = _CLAUSE_END.search(low, m.end())
        before = WORDS.findall(low, max(begin, m.start() - 200), m.start())
        after = WORDS.findall(low, m.end(), min(end.start() if end else len(low), m.end() + 200))
        out.update(before[-REACH:], after[:REACH])
    return out


_TARGET = re.compile(rb"(?<![a-z\x80-\xff])(?:" + b"|".join(w.encode() for w in TARGETS) + rb")(?![a-z\x80-\xff])")
#: Ends the entry of a word near a target.
AT = b"@"


def threats(counts: list[tuple[bytes, float, float]], toxic: int, clean: int) -> dict[bytes, float]:
    """Weights of words that are toxic near a target and not by themselves: the entries of lexicon() for
    words near a target whose words are no entries."""
    plain = {e: (t, c) for e, t, c in counts if not e.endswith(AT)}
    near = lexicon([(e[:-1] + b"$", t, c) for e, t, c in counts if e.endswith(AT)], toxic, clean, known=())
    alone = lexicon([(e, t, c) for e, (t, c) in plain.items()], toxic, clean, known=())
    return {e[:-1]: w for e, w in near.items() if e.endswith(b"$") and e not in alone and not any(x in alone for x in entries(e[:-1]))}


#: Clauses with a word near an insult that make it a word of the grammar, how much likelier it must be in one label, and
#: the least evidence (twice the log likelihood ratio).
SEEN, LIKELIER, EVIDENCE = 8, 4.0, 60.0


def contexts(model: Model, low: bytes) -> list[tuple[bytes, str]]:
    """Words of clauses with an insult that are in no class yet, each with where it stands: TARGET (up to four
    words before an insult or after it), NEGATION (up to three before), REPORT (anywhere before).
    Clauses that a text repeats count once."""
    seen: set[tuple[bytes, ...]] = set()
    out: list[tuple[bytes, str]] = []
    for words, letters, _ in model.clauses(low):
        spots = [i for i, x in enumerate(letters) if x == INSULT]
        if not spots or tuple(words) in seen:
            continue
        seen.add(tuple(words))
        found = {(b"", INSULT)}
        for i in spots:
            for place, lo, hi in ((TARGET, i - REACH, i + REACH + 1), (NEGATION, i - NEAR, i), (REPORT, 0, i)):
                found.update((words[j], place) for j in range(max(0, lo), min(hi, len(words))) if letters[j] == OTHER)
        out += found
    return out


def roles(counts: dict[tuple[bytes, str], tuple[int, int]]) -> dict[bytes, str]:
    """Classes of words by the clauses, of toxic and of clean documents, that have them in a place of contexts().

    Words that stand near insults in toxic documents and not in clean ones are targets; words before
    insults in clean documents and not in toxic ones are negations where they stand close, else
    they report.  Words of either label alike, and all where insults stand in one label only, say nothing.
    """
    toxic, clean = counts.get((b"", INSULT), (0, 0))
    if min(toxic, clean) < SEEN:
        return {}
    base = toxic / (toxic + clean)

    def speaks(w: bytes, place: str, y: int) -> bool:
        t, c = counts.get((w, place), (0, 0))
        n, share = (t, base) if y else (c, 1 - base)
        odds = np.log((t + 0.5) / (toxic + 1)) - np.log((c + 0.5) / (clean + 1))
        return n >= SEEN and (odds if y else -odds) > np.log(LIKELIER) and 2 * n * np.log(n / ((t + c) * share)) > EVIDENCE

    out: dict[bytes, str] = {}
    for w in {w for w, _ in counts} - {b""}:
        if speaks(w, TARGET, 1):
            out[w] = TARGET
        elif speaks(w, REPORT, 0):
            close, before = counts.get((w, NEGATION), (0, 0))[1], counts[w, REPORT][1]
            out[w] = NEGATION if close >= 0.8 * before else REPORT
    return out


def calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic curve of log totals, by Newton steps with a small ridge."""
    if len(set(y.tolist())) < 2:
        return Model.bias, Model.slope
    a, w = np.column_stack((np.ones(len(y)), x)), np.zeros(2)
    ridge = np.diag([1e-3, 0.05])
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + ridge, a.T @ (y - p) - ridge @ w)
        w += np.clip(step, -2, 2)
    return float(w[0]), float(w[1])


def signature(text: str | None, bands: int = 4) -> list[int]:
    """Minima of the hashes of the text's 8-word shingles, under several orders."""
    data = np.frombuffer(_low(text), dtype=np.uint8)
    words = bh.ranges(bh.prefix(bh.coded(data)), *bh.words(data))
    shingles = bh.fixed(bh.prefix(words), min(8, max(1, len(words))))
    if not len(shingles):
        return [0] * bands
    return [int(bh.mix(shingles ^ np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)).min().view(np.int64)) for k in range(bands)]


def _one_of_copies(texts: DataFrame) -> DataFrame:
    """The sample without near copies of its documents: words that copies share are no evidence.
    Signatures of the bounded sample are compared on the driver."""

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([signature(t) for t in b.column(1).to_pylist()], pa.list_(pa.int64()))], ["id", "signature"])

    seen: set[tuple[int, int]] = set()
    keep = []
    for row in sorted(texts.select("id", "text").mapInArrow(sign, "id long, signature array<long>").collect()):
        bands = set(enumerate(row["signature"]))
        if not bands & seen:
            keep.append((row["id"],))
        seen |= bands
    kept = texts.sparkSession.createDataFrame(keep, "id long")
    return texts.join(F.broadcast(kept), "id", "left_semi")


def train(docs: DataFrame, labels: DataFrame, learn, rows: int = 12_000) -> Model:
    """Learn the words of the grammar and the score's curve from at most ``rows`` labelled documents, as
    many of either label where there are enough, the first by hash of their id.

    First insults and threats, from the documents that hold a word; then targets, negations and reports, from
    what stands around insults.  Words are counted by half of the sample; each half's surroundings are
    read with the insults of the other, and the curve is fitted on scores that each half gets from the
    other's words.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    known = labels.where(learn & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("y"))
    # at most `rows` pairs of numbers: small enough for every executor
    known = F.broadcast(first_by_hash(known, "y", rows // 2))
    half = (F.crc32(F.col("id").cast("string").cast("binary")) % 2).cast("int")
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")).join(known, "id").select("id", "y", half.alias("half"), "text")
    texts = _one_of_copies(materialise(texts)).select("y", "half", "text")
    kind = "entry binary, place string, y int, half int, n long"

    def counted(of, size: int = 300_000) -> DataFrame:
        """entry, place and how many there are by label and half (n10: toxic, half 0).  of(half, low) gives
        the pairs of a text."""

        def batch(total: Counter) -> pa.RecordBatch:
            cols = list(zip(*total, strict=True)) or [(), (), (), ()]
            arrays = [pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.string(), pa.int32(), pa.int32()), strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array(list(total.values()), pa.int64())], ["entry", "place", "y", "half", "n"])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Counter = Counter()
            for b in batches:
                for y, half, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    total.update((e, place, y, half) for e, place in of(half, _low(text)))
                if len(total) > size:
                    yield batch(total)
                    total.clear()
            yield batch(total)

        n = lambda y, half: F.sum(F.when((F.col("y") == y) & (F.col("half") == half), F.col("n")).otherwise(0)).alias(f"n{y}{half}")
        return texts.mapInArrow(run, kind).groupBy("entry", "place").agg(*[n(y, h) for y in (1, 0) for h in (0, 1)])

    def words(half: int, low: bytes) -> set[tuple[bytes, str]]:
        found = {e for w in set(WORDS.findall(low)) for e in entries(w)}
        return {(e, "") for e in found | {w + AT for w in aimed_words(low)} | {b""}}

    own = F.hex("entry").isin([(w.encode() + b"$").hex().upper() for w in INSULTS])
    likely = (F.col("n10") + F.col("n11") >= 3) & (F.col("n10") + F.col("n11") > 0.5 * (F.col("n00") + F.col("n01")))
    near = F.hex("entry").endswith(AT.hex().upper())
    # of a word near a target its own counts are wanted too: what is no insult may be a threat
    per = materialise(counted(words))
    aimed = per.where(likely & near).select(F.expr("concat(substring(entry, 1, octet_length(entry) - 1), cast('$' as binary))").alias("entry"))
    sums = {bytes(r["entry"]): r for r in per.where(likely | own | (F.hex("entry") == "")).collect()}
    sums |= {bytes(r["entry"]): r for r in per.join(aimed, "entry", "left_semi").collect()}
    n = sums.pop(b"", None)
    if n is None:
        return Model(lexicon([], 0, 0))

    def learned(halves: tuple[int, ...]) -> tuple[dict[bytes, float], dict[bytes, float]]:
        add = lambda r, y: sum(r[f"n{y}{h}"] for h in halves)
        counts = [(e, add(r, 1), add(r, 0)) for e, r in sums.items()]
        return lexicon(counts, add(n, 1), add(n, 0)), threats(counts, add(n, 1), add(n, 0))

    insults = spark.sparkContext.broadcast({h: Model(learned((1 - h,))[0]) for h in (0, 1)})
    around = counted(lambda half, low: contexts(insults.value[half], low))
    around = around.where((F.col("n10") + F.col("n11") >= SEEN) | (F.col("n00") + F.col("n01") >= SEEN)).collect()

    def model(halves: tuple[int, ...]) -> Model:
        of = {(bytes(r["entry"]), r["place"]): tuple(sum(r[f"n{y}{h}"] for h in halves) for y in (1, 0)) for r in around}
        lex, threat = learned(halves)
        return Model(lex, threats=threat, roles=roles(of))

    other = spark.sparkContext.broadcast({h: model((1 - h,)) for h in (0, 1)})

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [(y, other.value[half].read(_low(text))) for y, half, text in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            cols = list(zip(*got, strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.float64())], ["y", "total"])

    got = np.array(sorted((r["y"], r["total"]) for r in texts.mapInArrow(read, "y int, total double").collect()), dtype=np.float64).reshape(-1, 2)
    whole = model((0, 1))
    whole.bias, whole.slope = calibrate(np.log1p(got[:, 1]), got[:, 0])
    return whole


def toxicity(docs: DataFrame, model: Model, at: float = 0.7) -> DataFrame:
    """doc_id, score, predicted, matched for every row: matched is the total of its clauses' scores.

    Null and empty texts and texts that match nothing get the curve's lowest score.  Long texts are read
    piece by piece, cut where a clause ends.  Only doc_id and text are read of the columns.  One row in,
    one row out, repeated rows and null ids included; no rows: no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = sent.value
            total = [m.read(_low(t)) for t in b.column(1).to_pylist()]
            score = [m.curve(x) for x in total]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array([int(s >= at) for s in score], pa.int32()), pa.array(total, pa.float64())], ["doc_id", "score", "predicted", "matched"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double, predicted int, matched double")


def remainder(of: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % of


def clean_documents(docs: DataFrame, labels: DataFrame, at: float = 0.7) -> DataFrame:
    """The documents, with all their columns, that the model does not reject.  Null and empty texts stay, and
    so do repeated rows and null ids whose text is not rejected; no rows: no rows."""
    spark = docs.sparkSession
    model = train(docs.select("doc_id", "text"), labels, remainder(3) != 1)
    bound_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = pa.array([sent.value.score(t) < at for t in b.column(body).to_pylist()], pa.bool_())
            yield b.filter(keep)

    placed, name = by_place(docs)
    body = name("text")
    return placed.mapInArrow(run, placed.schema).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"), remainder(3) != 1)
    return toxicity(docs, model).withColumn("held_out", F.coalesce(remainder(3) == 1, F.lit(False)))
