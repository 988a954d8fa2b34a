import pytest

from attestra import fixed
from attestra.functions.markdown import Sizes, chunks_of, entries, prefix, real_tables, sentence_parts, table_chunks

LONG = " ".join(f"Sentence number {i} says something of some length here." for i in range(90))


def test_headings_and_prefix():
    got = chunks_of("Before all of it here\n# One\ntext of the first part\n### Skipped *level*\ntext of the second part\n## Two\ntext of the third part")
    assert [c["section"] for c in got] == ["", "One", "One > Skipped level", "One > Two"]
    assert got[1]["text"] == "[One]\ntext of the first part" and [c["chunk_index"] for c in got] == [0, 1, 2, 3]


def test_small_text_goes_and_tables_stay():
    got = chunks_of("x\n\n<table>\n</table>\n\n| a | b |\n|---|---|\n| 1 | 2 |")
    assert [c["segment_type"] for c in got] == ["table", "table"]


def test_paragraphs_are_packed_to_the_target():
    paragraphs = ["word " * 100 for _ in range(10)]
    got = chunks_of("\n\n".join(paragraphs))
    assert [c["char_count"] for c in got] == [499 * 3 + 4] * 3 + [499]


def test_long_text_is_cut_at_sentences_that_overlap():
    got = chunks_of(LONG)
    assert len(got) > 2 and all(c["char_count"] <= 2000 for c in got)
    for a, b in zip(got, got[1:], strict=False):
        assert b["text"].startswith(sentence_parts(a["text"])[-1])


def test_text_that_cannot_be_cut_stays_whole():
    assert len(chunks_of("a" * 5000)) == 1


def test_abbreviations_do_not_end_sentences():
    assert sentence_parts("As Dr. Smith said. See Fig. Two. End") == ["As Dr. Smith said.", "See Fig. Two.", "End"]


def test_references_and_figures():
    got = chunks_of("# References\n1. Smith A. Title. 2020. 2. Jones B. Other. 2021.\n\nFigure 1 The caption\ngoes on\n\n[Figure: something to see]")
    assert [c["segment_type"] for c in got] == ["reference", "reference", "figure", "figure"]
    assert got[0]["text"] == "1. Smith A. Title. 2020." and got[2]["text"] == "Figure 1 The caption\ngoes on"
    assert entries("Smith AB. T. J. 2020; Jones CD. U. K. 2021;") == ["Smith AB. T. J. 2020;", "Jones CD. U. K. 2021;"]
    assert entries("one block") == ["one block"]


def table(rows: int, head: bool = True) -> str:
    h = "<thead><tr><th>A</th></tr></thead>" if head else "<tr><td>First</td></tr>"
    return f"<table>\n<caption>Cap</caption>\n{h}\n<tbody>\n" + "\n".join(f"<tr><td>{'x' * 80}{i}</td></tr>" for i in range(rows)) + "\n</tbody>\n</table>"


def test_large_tables_repeat_their_head():
    got = table_chunks(table(60), Sizes())
    assert len(got) > 2 and all("<thead>" in g and "<caption>Cap</caption>" in g and g.endswith("</table>") for g in got)
    assert sum(g.count("<td>") for g in got) == 60
    assert table_chunks(table(3), Sizes()) == [table(3)]
    plain = "<table>" + "y" * 3000
    assert table_chunks(plain, Sizes()) == [plain]
    got = table_chunks(table(60, head=False), Sizes())
    assert all("First" in g for g in got)


def test_large_pipe_tables():
    rows = ["| h |", "|---|", *(f"| {'x' * 80} {i} |" for i in range(60))]
    got = table_chunks("\n".join(rows), Sizes())
    assert len(got) > 2 and all(g.startswith("| h |\n|---|\n") for g in got)
    assert sum(g.count("x |") + g.count("x ") for g in got) >= 60


def test_tables_without_caption_go():
    md = "Table 1 Results\n<table>\n1\n</table>\n" + "line\n" * 8 + "<TABLE>\n2\n</TABLE>\nend"
    assert real_tables(md) == "Table 1 Results\n<table>\n1\n</table>\n" + "line\n" * 8 + "end"
    assert real_tables("<table>never closed\nx") == ""
    assert real_tables("a\nb") == "a\nb"


@pytest.mark.parametrize("path,want", [(["a", "b"], "a > b"), (["x" * 50, "y" * 40, "z"], "y" * 40 + " > z"), (["q" * 100], "q" * 77 + "..."), ([], "")])
def test_prefix(path, want):
    assert prefix(path) == want and len(prefix(path)) <= fixed.PREFIX


@pytest.mark.parametrize("text", [None, "", "\n\n", "# only a heading"])
def test_nothing(text):
    assert chunks_of(text) == []


def test_no_text_is_lost():
    body = "\n\n".join(f"Paragraph {i} " + "word " * (i % 37) for i in range(80))
    joined = " ".join(c["text"] for c in chunks_of(body))
    assert all(f"Paragraph {i}" in joined for i in range(80))
