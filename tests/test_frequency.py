"""How many documents hold given words."""

from attestra.operators import lexical


def test_as_all_postings(spark):
    rows = [(i, None if i == 5 else " ".join(w for n, w in enumerate(("dose", "doses", "dosing", "trial", "Trials", "été", "x")) if (i * 7 + n) % 3) * 2) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    every = {r["token"]: r["df"] for r in lexical.document_frequency(lexical.postings(docs, "doc_id", "text")).collect()}
    some = [*list(every)[::2], "nowhere"]
    words = spark.createDataFrame([(w,) for w in some], "token string")
    got = [tuple(r) for r in lexical.frequency_of(words, docs, "doc_id", "text").collect()]
    assert dict(got) == {w: every[w] for w in some if w in every} and len(got) == len(dict(got)) > 1
