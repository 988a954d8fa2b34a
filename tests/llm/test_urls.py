import random
import re
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pytest

from attestra.llm import urls

KEEP = ["page_id", "host", "path", "rule", "verdict"]
SCHEMA = "page_id long, url string, html string, host int, rule string, n int"


def planted(seed: int = 3, n: int = 400) -> list[tuple]:
    """Pages that link to each other, one host with a third of them, nulls, odd urls and links."""
    rng = random.Random(seed)
    hosts = [f"{x}.{t}" for x in "abcdefgh" for t in ("org", "net", "example.com", "www.example.com")] + ["hub.org"] * 16
    rows = []
    for i in range(n):
        link = lambda: f'{rng.choice(["//", "http://", "HTTPS://", "/", "mailto:", "q", "#z", ""])}{rng.choice(hosts)}/{rng.choice("ab")}'
        html = "".join(f'<a class="x"HREF = {q}{link()}{q}>' for q in rng.choices(['"', "'", ""], k=rng.randrange(5)))
        url = rng.choice(["http://", "HTTPS://"]) + rng.choice(hosts) + rng.choice(["/en/", "/es/", "/fr/x", "/de/", "", "/"]) + rng.choice(["", "?a=/es/", "#x"])
        rows.append((i if i % 50 else None, [None, "nohost", "", url.upper()][i // 40 % 4] if i % 40 == 0 else url, None if i % 30 == 0 else html, 5, "x", 1))
    rows += [(n + i, f"http://worst.net/{p}/", None, 5, "x", 1) for i, p in enumerate(["es", "fr", "es", "de"])]
    return rows + rows[-3:]


def test_against_sql(spark):
    rows = planted()
    got = urls.filter_urls(spark.createDataFrame(rows, SCHEMA).repartition(3))
    c = duckdb.connect()
    c.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html", "host", "rule", "n"]).astype({"page_id": "Int64"}))
    assert Counter(tuple(r) for r in got.select(*KEEP).collect()) == Counter(c.execute(urls.SQL).fetchall())
    by_host = {r.host: r for r in got.collect()}
    assert by_host[""].verdict == "allow" and {r.verdict for r in got.where("rule is null").collect()} == {"allow", "block"}


@pytest.mark.parametrize("sent, links", [(100_000, 100_000), (0, 2)])
def test_scores_by_hand(spark, monkeypatch, sent, links):
    """Personalised PageRank of a dict of links, in whole numbers."""
    monkeypatch.setattr(urls, "SENT", sent)
    monkeypatch.setattr(urls, "LINKS", links)
    rows = planted(5)
    got = urls.filter_urls(spark.createDataFrame(rows, SCHEMA), rounds=6)
    pages, edges = defaultdict(list), Counter()
    host_of = lambda u: (re.search(r"^.*?://([^/?#]*)", u or "") or [0, ""])[1].lower()
    rule_of = {(r.host, r.path): r.verdict for r in got.where("rule is not null").collect()}
    for _, url, html, *_ in rows:
        if host := host_of(url):
            path = re.search(r"://[^/?#]*([^?#]*)", url)[1]
            pages[host].append(rule_of.get((host, path)))
            for to in re.findall(r"""(?i)href = ["']?([^"'\s>]+)""", html or ""):
                there = re.search(r"^(?:https?:)?//([^/]*)", to.lower())
                if there and there[1] != host:
                    edges[host, there[1]] += 1
    hosts = {*pages, *(h for e in edges for h in e)}
    for column, word, way in (("trust", "allow", 0), ("distrust", "block", 1)):
        seed = {h: urls.UNIT * pages[h].count(word) // len(pages[h]) if pages[h] else 0 for h in hosts}
        total, score = Counter(), dict(seed)
        for e, n in edges.items():
            total[e[way]] += n
        for _ in range(6):
            got_by = Counter({h: score[h] for h in hosts if not total[h]})
            for e, n in edges.items():
                got_by[e[1 - way]] += score[e[way]] * n // total[e[way]]
            score = {h: (15 * seed[h] + 85 * got_by[h]) // 100 for h in hosts}
        for r in got.where("host <> ''").select("host", column).distinct().collect():
            assert r[1] == score[r[0]] / urls.UNIT, (column, r[0])


def test_distrust_goes_against_links_and_trust_along(spark):
    rows = [
        (1, "http://bad.net/es/", "", 0, "", 0), (2, "http://farm.org/x", '<a href="http://bad.net/">', 0, "", 0), (3, "http://good.com/", '<a href="//friend.org">', 0, "", 0),
        (4, "http://friend.org/x", "", 0, "", 0), (5, "http://bad.net/other", "", 0, "", 0), (6, "http://quiet.org/", '<a href="/es/">', 0, "", 0),
    ]
    got = {r.page_id: r for r in urls.filter_urls(spark.createDataFrame(rows, SCHEMA), threshold=0.3).collect()}
    assert [got[i].verdict for i in range(1, 7)] == ["block", "block", "allow", "allow", "allow", "allow"]
    assert got[4].trust > 0.8 and got[2].distrust > 0.4 and got[6].trust == got[6].distrust == 0


def test_longest_rule_wins(spark):
    rules = [("allow", "com", "/"), ("block", "x.com", "/a"), ("allow", "y.x.com", "/"), ("block", "y.x.com", "/a/b")]
    rows = [(i, u, None, 0, "", 0) for i, u in enumerate(["q://x.com/a", "q://x.com/b", "q://y.x.com/a", "q://Y.X.COM/a/b#", "q://zx.com/a", "q://com", "q://com/?"])]
    got = {r.page_id: (r.rule, r.verdict) for r in urls.filter_urls(spark.createDataFrame(rows, SCHEMA), rules).collect()}
    assert got == {0: ("x.com/a", "block"), 1: ("com/", "allow"), 2: ("y.x.com/", "allow"), 3: ("y.x.com/a/b", "block"), 4: ("com/", "allow"), 5: (None, "allow"), 6: ("com/", "allow")}


def test_no_rows(spark):
    assert not urls.filter_urls(spark.createDataFrame([], SCHEMA)).collect()


def test_native(spark):
    """No Python on the way."""
    plan = urls.filter_urls(spark.createDataFrame(planted(1, 60), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
