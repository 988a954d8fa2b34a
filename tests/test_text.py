import pytest
from pyspark.sql import functions as F

from attestra import fixed
from attestra.functions import numbers, text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()[0]


@pytest.mark.parametrize(
    "raw,want",
    [("ﬁrst ½", "first 1⁄2"), ("a b c", "a b c"), ("32·6 %", "32.6 %"), ("a — b–c", "a - b-c"), ("  x\n\ty ", "x y"), ("", ""), (None, "")],
)
def test_unicode(spark, raw, want):
    assert one(spark, raw, text.normalize_unicode) == want


@pytest.mark.parametrize(
    "word,stem",
    [("freeze", "freez"), ("frozen", "freez"), ("washing", "wash"), ("organization", "organize"), ("treatment", "treat"), ("walking", "walk"), ("tried", "try"), ("gas", "gas"), ("cats", "cat"), ("bes", "bes"), ("sing", "sing"), ("using", "us")],
)
def test_stem(spark, word, stem):
    assert one(spark, word, lambda c: text.stem("t")) == stem


def test_keywords(spark):
    assert one(spark, "The 32.6% rate of the rate was used 5 x-ray Do NOT", text.keywords) == ["32.6%", "rate", "ray"]
    assert one(spark, "", text.keywords) == []


def test_search_words(spark):
    k = lambda t: text.all_keywords(text.keywords(t, 30))
    assert one(spark, "patients treated with freeze dried xy study", k) == ["freeze", "dried"]
    assert one(spark, "patients treated study clinical treatment evidence", k) == ["patients", "treated", "study", "clinical", "treatment"]
    any_ = lambda t: text.any_keywords(text.keywords(t, 30))
    assert one(spark, "evidence dose mg freeze placebo", any_) == ["freeze", "dose", "mg", "placebo"]


@pytest.mark.parametrize(
    "word,forms",
    [("warmed", {"warmed", "warm", "warme", "warming", "warmede"}), ("frozen", {"frozen", "froz", "froze", "frozeing", "freeze", "frozene"}), ("syringes", {"syringes", "syringe", "syringese"}), ("injection", {"injection", "inject", "injected", "injectione"}), ("dose", {"dose"}), ("mg", set())],
)
def test_inflections(spark, word, forms):
    assert set(one(spark, word, text.inflections)) == forms


def test_sentences(spark):
    assert one(spark, "See Fig. Two here. Next one? Yes et al. Then. last", text.sentences) == ["See Fig. Two here.", "Next one?", "Yes et al. Then. last"]
    assert one(spark, "Short. One two three. Ab.", text.plain_sentences) == ["Short.", "One two three."]


def test_citation(spark):
    df = spark.createDataFrame([(["A", "B", "C", "D"], "T", "J", 2020, "10.1/x", "r"), (None, None, None, None, None, "r"), (["A"], "", "J", None, "", "r")], "a array<string>, t string, j string, y int, d string, r string")
    got = [r[0] for r in df.select(text.citation(*map(F.col, "atjydr"))).collect()]
    assert got == ["A, B, C et al.. T. J 2020. doi:10.1/x.", "r", "A."]


NUMERIC = "relapsed in 12 (21%) and 26 (46%) patients; HR = 0.39, 95% CI: 0.19-0.77; p=0.006"


def test_worked_example():
    assert [t["value"] for t in numbers.tokens_of(NUMERIC)] == ["12", "21%", "26", "46%", "hr=0.39", "95%", "ci:0.19-0.77", "p=0.006"]


@pytest.mark.parametrize("raw", ["after treatment.10,11 here", "the condition.A1,A2 was", "weakness.3,4,5 was", "Hughes, MD,1 and", "Intro . . . . . . . . 7 METHODS", "see Box (4) there", "as in 2021 it"])
def test_no_numbers(raw):
    assert numbers.tokens_of(raw) == []


@pytest.mark.parametrize("raw,want", [("rate 2019 of", ["2019"]), ("value 0.47 here", ["0.47"]), ("n = 450 women", ["n=450"]), ("took 10 mg daily", ["10 mg"]), ("a 4-fold rise", ["4-fold"]), ("p < .001", ["p<0.001"]), ("(n=12)", ["n=12"])])
def test_numbers(raw, want):
    assert [t["value"] for t in numbers.tokens_of(raw)] == want


def test_number_places():
    (t,) = numbers.tokens_of("x" * 60 + " é 32.6 % " + "y" * 60)
    assert (t["start"], t["end"], t["raw"]) == (63, 69, "32.6 %") and len(t["context"]) == 86


def test_spark_numbers_equal_python(spark):
    rows = [(NUMERIC,), ("p ≤ .05 and 12 kg",), (None,), ("",)]
    df = spark.createDataFrame(rows, "t string").select("t", numbers.numeric_tokens(F.col("t")).alias("n"))
    for r in df.collect():
        assert [x["value"] for x in r["n"]] == [x["value"] for x in numbers.tokens_of(r["t"])]


@pytest.mark.parametrize("a,b,same", [("32.6%", "33", True), ("10", "12.1", False), ("n/a", "3", False), ("p<0.05", "0.05", True), ("1.2.3", "1", False)])
def test_values_match(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(numbers.values_match(F.col("a"), F.col("b"))).first()[0] is same


def test_fixed_values():
    assert len(fixed.INDEX_STOPWORDS) == len(set(fixed.INDEX_STOPWORDS)) and len(fixed.SUFFIXES) == 25
    assert len(fixed.TRIAL_PRIMARY) == 21 and sum(map(len, fixed.GROUPS.values())) == 94


STEMS = {
    "ational": "ational", "national": "nation", "organization": "organize", "hopefulness": "hopeful", "anxiousness": "anxious", "effectiveness": "effective", "placement": "plac", "treatment": "treat",
    "kindness": "kind", "dating": "dat", "sizing": "siz", "visible": "vis", "readable": "read", "ration": "ra", "tension": "ten", "falling": "fall", "trying": "try", "walking": "walk", "tried": "try",
    "flies": "fly", "walked": "walk", "walker": "walk", "slowly": "slow", "boxes": "box", "cats": "cat", "frozen": "freez", "freezing": "freez", "injection": "inject", "unused": "unus", "as": "as", "gas": "gas",
    "tional": "tional", "bed": "bed", "sings": "sing", "xyz": "xyz", "12%": "12%", "3.5": "3.5", "passes": "pass",
}


def test_stems(spark):
    """The first suffix in their order, whatever letter it is found by."""

    def first(w):
        if len(w) <= 3:
            return w
        if w in fixed.IRREGULAR_STEMS:
            return fixed.IRREGULAR_STEMS[w]
        return next((w[: -len(s)] + new for s, new in fixed.SUFFIXES if w.endswith(s) and len(w) >= len(s) + 2), w)

    words = {*STEMS, *(f"{stem}{s}" for s, _ in fixed.SUFFIXES for stem in ("", "a", "ab", "tion", "rat"))}
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", text.stem("w").alias("s")).collect()}
    assert got == {w: first(w) for w in words}
    assert {w: s for w, s in STEMS.items() if got[w] != s} == {}
