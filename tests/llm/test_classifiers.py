import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestra.llm import langid, toxicity
from attestra.llm.toxicity import GRAMMAR, aimed_words, clause_score, clean_documents, lexicon, roles, threats
from tests.llm.helpers import DOCS, documents, frame

TONGUES = {"aa": "the this that with and for house".split(), "bb": "der die und nicht ein haus mit".split(), "cc": "le la des une pour maison avec".split(), "dd": "el los una casa con por que".split()}


def tongue_rows(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(TONGUES))
        t = " ".join(rng.choice(TONGUES[lang]) for _ in range(rng.randrange(3, 60)))
        rows.append((i, t, lang, "s", len(t), 1, "", 0.0, "", "", ""))
    rows += [(n, None, "aa", "s", 0, 1, "", 0.0, "", "", ""), (n + 1, "", None, None, 0, 1, "", 0.0, "", "", ""), (n + 2, "12 34 !", "bb", "s", 0, 1, "", 0.0, "", "", ""), (n + 3, "haus", None, "s", 0, 1, "", 0.0, "", "", "")]
    return rows


def test_language_id(spark):
    rows = tongue_rows(1, 400)
    docs = frame(spark, rows)
    model = langid.train(docs, langid.remainder(4) != 2)
    assert model.langs == sorted(TONGUES)
    out = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert len(out) == len(rows)
    held = [r for r in rows[:400] if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert np.mean([out[r[0]]["lang_pred"] == r[2] for r in held]) > 0.97
    assert [out[i]["lang_pred"] for i in (400, 401, 402)] == ["und"] * 3 and out[403]["lang_pred"] == "bb"
    assert all(0 <= r["score"] <= 1 for r in out.values())


def test_language_id_without_rows_or_with_one_language(spark):
    empty = frame(spark, [], DOCS)
    model = langid.train(empty, F.lit(True))
    docs = frame(spark, tongue_rows(2, 10))
    assert {r["lang_pred"] for r in langid.identify(docs, model).collect()} == {"und"}
    assert langid.identify(empty, model).count() == 0
    one = langid.train(docs.where("lang = 'aa' or lang is null"), F.lit(True))
    assert {r["lang_pred"] for r in langid.identify(docs, one).collect()} == {"aa", "und"}


@pytest.mark.parametrize("n", [2, 3, 5, 6, 17])
def test_codewords_are_apart(n):
    c = langid.codewords(n)
    apart = [(c[i] != c[j]).sum() for i in range(n) for j in range(i)]
    assert min(apart) >= (1 if n == 2 else 2 if n < 6 else 3)


@pytest.mark.parametrize(
    "letters,score",
    [
        ("ooo", 0.0), ("i", 0.4), ("ii", 0.8), ("yi", 1.0), ("yoooi", 1.0), ("yooooi", 0.4), ("ni", 0.12), ("nooi", 0.12), ("noooi", 0.4),
        ("t", 0.0), ("ty", 1.0), ("yt", 1.0), ("tooooy", 0.0), ("ei", 0.16), ("eooooooi", 0.16), ("nty", 0.3), ("eyi", 0.4), ("", 0.0),
    ],
)
def test_grammar(letters, score):
    names = {"o": toxicity.OTHER, "i": toxicity.INSULT, "t": toxicity.THREAT, "y": toxicity.TARGET, "n": toxicity.NEGATION, "e": toxicity.REPORT}
    assert clause_score([names[x] for x in letters], [1.0] * len(letters)) == pytest.approx(score)
    assert GRAMMAR.start == (((0, 0), 0), 0)


def test_lexicon_wants_families_and_evidence():
    counts = [(b"idiot$", 50, 0), (b"blorp$", 20, 0), (b"blor", 20, 0), (b"zu", 60, 900), (b"rare$", 2, 0), (b"kraxa$", 6, 0), (b"kraxb$", 6, 0), (b"kraxc$", 6, 0), (b"krax", 18, 0), (b"scum$", 10, 90)]
    lex = lexicon(counts, 100, 900)
    assert {b"idiot$", b"blorp$", b"krax"} <= set(lex) and not {b"blor", b"rare$", b"zu", b"scum$"} & set(lex)


def toxic_rows(seed, n):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(TONGUES["aa"] + [f"w{rng.randrange(300)}"]) for _ in range(60)]
        y = int(rng.random() < 0.2)
        for _ in range(rng.randrange(2, 5) if y else 0):
            words[rng.randrange(60)] = rng.choice(["moron", "grobx", "grobyy", "grobzan", "grobul"])
        rows.append((i, " ".join(words).capitalize() + ".", "aa", "s", 1, 1, "", 0.0, "", "", ""))
        labels.append((i, 1, y, "text"))
    return rows, labels


def test_toxicity(spark):
    rows, labels = toxic_rows(1, 600)
    known = {i: y for i, _, y, _ in labels}
    rows += [(None, "x moron moron idiot.", None, None, None, 1, "", 0.0, "", "", ""), (9000, None, None, None, None, 1, "", 0.0, "", "", ""), (9001, "", None, None, None, 1, "", 0.0, "", "", "")]
    docs = frame(spark, rows)
    table = spark.createDataFrame([*labels, (5, 1, None, "t"), (None, 1, 1, "t")], "doc_id long, quality int, toxic int, text string")
    model = toxicity.train(docs, table, toxicity.remainder(3) != 1)
    out = toxicity.toxicity(docs, model).toPandas()
    assert len(out) == len(rows) and out.score.between(0, 1).all()
    got = {int(i): p for i, p in zip(out.doc_id, out.predicted, strict=True) if i == i}
    held = [i for i in known if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i] == known[i] for i in held]) > 0.97
    assert got[9000] == got[9001] == 0
    clean = clean_documents(docs, table)
    assert clean.columns == docs.columns
    assert {r["doc_id"] for r in clean.collect()} == {int(i) if i == i else None for i, p in zip(out.doc_id, out.predicted, strict=True) if not p}


def structured_rows(seed, n):
    """An unknown tongue: toxic documents aim insults or threats at someone; some clean ones deny or report them."""
    rng = random.Random(seed)
    rows, labels = [], []
    insults, targets = ["grobx", "grobyy", "krassel", "blorpen"], ["zutu", "zoti"]
    for i in range(n):
        kind = rng.choices(["toxic", "denied", "told", "plain"], [18, 2, 2, 78])[0]
        words = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(60)]
        words[rng.randrange(60)] = rng.choice(targets)  # people are spoken of in any document
        clauses = [" ".join(words[k : k + 12]) for k in range(0, 60, 12)]
        for k in rng.sample(range(5), 2) if kind != "plain" else []:
            x, pad = rng.choice(insults), rng.choice(words)
            part = {"toxic": f"{rng.choice(targets)} {pad} {x} {pad}", "denied": f"{pad} nukki {x}", "told": f"dixir {pad} {pad} {pad} {pad} {x}"}[kind]
            clauses[k] = f"{rng.choice(words)} {part}"
        rows.append((i, ". ".join(clauses) + ".", "xx", "s", 1, 1, "", 0.0, "", "", ""))
        labels.append((i, 1, int(kind == "toxic")))
    return rows, labels


def test_the_grammar_decides(spark, monkeypatch):
    """Against a plain sum of insults' weights with a curve of its own: on held-out documents it is better."""
    rows, labels = structured_rows(3, 2400)
    docs, table = frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    known = {i: y for i, _, y in labels}
    held = [i for i in known if zlib.crc32(str(i).encode()) % 3 == 1]

    def predicted():
        model = toxicity.train(docs, table, toxicity.remainder(3) != 1)
        found = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity(docs, model).collect()}
        return model, found, np.mean([found[i] == known[i] for i in held]), np.mean([found[i] for i in held if known[i]])

    model, with_grammar, right, recall = predicted()
    assert model.roles.get(b"zutu") == model.roles.get(b"zoti") == toxicity.TARGET
    assert model.roles.get(b"nukki") == toxicity.NEGATION and model.roles.get(b"dixir") == toxicity.REPORT

    def plain(self, low):
        return sum(w for _, letters, weights in self.clauses(low) for x, w in zip(letters, weights, strict=True) if x == toxicity.INSULT)

    monkeypatch.setattr(toxicity.Model, "read", plain)
    flat = toxicity.Model(model.lexicon)
    rows_y = [(flat.read(r[1].lower().encode()), known[r[0]]) for r in rows if r[0] not in set(held)]
    flat.bias, flat.slope = toxicity.calibrate(np.log1p([x for x, _ in rows_y]), np.array([y for _, y in rows_y], dtype=float))
    without = {r[0]: int(flat.score(r[1]) >= 0.7) for r in rows}
    plain_right, plain_recall = np.mean([without[i] == known[i] for i in held]), np.mean([without[i] for i in held if known[i]])
    assert right > 0.99 and recall > 0.97
    assert right > plain_right + 0.02 and recall >= plain_recall
    assert np.mean([with_grammar[i] != without[i] for i in held]) > 0.02


def test_roles_want_insults_in_either_label():
    alone = {(b"", toxicity.INSULT): (200, 0), (b"du", toxicity.TARGET): (90, 0)}
    assert roles(alone) == {}
    both = {(b"", toxicity.INSULT): (200, 100), (b"du", toxicity.TARGET): (90, 2), (b"der", toxicity.TARGET): (90, 40), (b"der", toxicity.REPORT): (90, 40)}
    both |= {(b"kein", toxicity.NEGATION): (1, 30), (b"kein", toxicity.REPORT): (2, 32), (b"sagt", toxicity.NEGATION): (1, 9), (b"sagt", toxicity.REPORT): (3, 40)}
    assert roles(both) == {b"du": toxicity.TARGET, b"kein": toxicity.NEGATION, b"sagt": toxicity.REPORT}


def test_threats_are_toxic_near_a_target_only():
    assert aimed_words(b"one two three four five you will zapp now. zapp the house") == {b"two", b"three", b"four", b"five", b"will", b"zapp", b"now"}
    counts = [(b"zapp@", 30, 1), (b"zapp$", 30, 200), (b"idiot$", 60, 0), (b"idiot@", 40, 0), (b"the@", 90, 800), (b"the$", 100, 900)]
    assert set(threats(counts, 100, 900)) == {b"zapp"}
    model = toxicity.Model(lexicon([], 0, 0), threats={b"zapp": 1.2})
    assert model.read(b"i zapp you") == pytest.approx(1.2 * 0 + 1.0) and model.read(b"zapp the house") == 0


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = frame(spark, documents(1, 20))
    model = toxicity.train(docs, none, F.lit(True))
    assert toxicity.toxicity(docs, model).where("predicted = 1").count() == 0
    assert clean_documents(frame(spark, [], DOCS), none).count() == 0
    assert model.score("You are an idiot, a moron and a loser. Stupid scum!") > 0.7


def test_long_texts_piece_by_piece(monkeypatch):
    rng = random.Random(1)
    text = " ".join(rng.choice(["the", "you", "idiot", "not", "said", "é", "kill", "house.", "x;"]) for _ in range(400))
    model = toxicity.Model(lexicon([], 0, 0))
    whole, vector = model.read(text.encode()), langid.features(text)
    monkeypatch.setattr(toxicity, "SLICE", 37)
    monkeypatch.setattr(langid, "SLICE", 41)
    assert model.read(text.encode()) == pytest.approx(whole) and np.allclose(langid.features(text), vector)
    assert whole > 5 and model.read(b"") == 0
