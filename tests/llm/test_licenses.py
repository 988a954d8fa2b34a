import random
import re

import pytest

from attestra.llm.licenses import NOTICES, PHRASES, allowed, license_scan, notices, scan
from tests.llm.helpers import documents, frame

LOW = {ord(c): ord(c) + 32 for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
TEXTS = [
    None, "", "MIT License", "mit  LICENSE, mit-license; xmit license mit licensee", "Apache\nLicense 2", "CC BY-NC 4.0 cc-by", "GNU General Public License and gnu  general public license",
    "é mit license é", "a\x7fcc\x7fby\x00z", "Émit license", "Released under the MIT License.", "cc by " * 300,
]


def plain(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    at = [(i, label) for phrase, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in at]
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at}))


@pytest.mark.parametrize("text", TEXTS)
def test_base_columns(text):
    s = scan(text)
    assert tuple(s[k] for k in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == plain(text)
    assert set(filter(None, s["base_labels"].split(","))) <= set(s["labels"].split(",")) and 0 <= s["score"] <= 1


@pytest.mark.parametrize("notice", NOTICES)
def test_notices_are_found_with_edits(notice):
    k = allowed(notice)
    for text in (notice, notice.upper(), notice.replace(" ", "\n\t"), notice[: len(notice) // 2] + "#" + notice[len(notice) // 2 :], notice.replace("e", "3", k) if notice.count("e") >= k else notice):
        s = scan(f"Some words before. {text} And after.")
        assert NOTICES[notice] in s["labels"].split(",")
        assert s["score"] >= 1 - (k + 0.01) / len(notice)


def test_spans_are_places_in_the_text():
    text = "é  before\n\nReleased  under the\tMIT Licence. after"
    (span,) = scan(text)["spans"]
    assert text.encode()[span["start_byte"] : span["end_byte"]].decode() == "Released  under the\tMIT Licence"
    assert span["edits"] == 1 and span["label"] == "mit"


def test_of_overlapping_notices_the_closest_stays():
    found = notices(b"licensed under cc by-nc 4.0 licensed under cc by-nd 4.0")
    assert [(list(NOTICES.values())[i], e) for i, _, _, e in found] == [("cc-by-nc-4.0", 0), ("cc-by-nd-4.0", 0)]
    assert notices(b"permission is granted to copy") == []


def test_an_edited_notice_before_a_better_one_has_its_place():
    edited, whole = "licensed under the apache licence, version 2.0", "licensed under the apache license, version 2.0"
    for text, edits in ((f"{edited} {whole}", [1, 0]), (f"{edited} {edited} {whole} {edited}", [1, 1, 0, 1]), (f"{whole} {edited}", [0, 1])):
        spans = scan(text)["spans"]
        assert [x["edits"] for x in spans] == edits
        assert [text[x["start_byte"] : x["end_byte"]] for x in spans] == [edited if e else whole for e in edits]


def test_table(spark):
    rows = documents(1, 30) + [(None, "mit license", None, None, None, 1, "", 0.0, "", "", "")]
    rows += rows[3:5]
    out = license_scan(frame(spark, rows)).toPandas()
    assert len(out) == 33 and out.n_base.sum() == 1
    assert license_scan(frame(spark, [])).count() == 0


def fewest_edits(notice, flat):
    """Least edits with which the notice stands anywhere in a text, by dynamic programming."""
    row = list(range(len(notice) + 1))
    least = row[-1]
    for c in flat:
        new = [0]
        for j, n in enumerate(notice, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (c != n)))
        row = new
        least = min(least, row[-1])
    return least


@pytest.mark.parametrize("seed", range(6))
def test_fuzzy_search_against_dynamic_programming(seed):
    """A notice within its bound is found, or a better one where it stands; one beyond it is not."""
    rng = random.Random(seed)
    names = list(NOTICES)
    for _ in range(12):
        text = rng.choice(names)
        for _ in range(rng.randrange(9)):
            at = rng.randrange(len(text))
            text = rng.choice([text[:at] + text[at + 1 :], text[:at] + rng.choice("abcx ") + text[at:], text[:at] + rng.choice("abcx") + text[at + 1 :]])
        flat = " ".join(f"words before {text} and behind".split())
        found = notices(flat.encode())
        best = min(((fewest_edits(n, flat), n) for n in names if fewest_edits(n, flat) <= allowed(n)), key=lambda x: x[0] / len(x[1]), default=None)
        assert bool(found) == bool(best)
        for i, a, z, edits in found:
            assert edits <= allowed(names[i]) and fewest_edits(names[i], flat[a:z]) <= edits
        if best:
            assert min(e / len(names[i]) for i, _, _, e in found) <= best[0] / len(best[1]) + 1e-9


def test_very_many_hits_in_a_long_text():
    text = "Released under the MIT Licence. " * 4000 + "mit license " * 4000
    s = scan(text)
    assert s["n_base"] == 4000 and len(s["spans"]) == 4000 and s["first_word"] == 20000 and s["last_word"] == 20000 + 2 * 3999


@pytest.mark.parametrize("gap", ["", "some words between "])
def test_edited_notices_side_by_side(gap):
    """Each place is found by itself, however many there are."""
    rng = random.Random(4)
    texts = [f"released under th{rng.choice('abcdf')} mit licens{rng.choice('abcdf')}" for _ in range(3000)]
    s = scan(" ".join(gap + t for t in texts))
    assert len(s["spans"]) == 3000 and {x["edits"] for x in s["spans"]} == {2}
