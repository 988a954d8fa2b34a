"""Pages by key."""

import pytest

from attestra.operators.paging import key_of, page_after, write_laid

ORDER = [("at", True), ("id", False)]


def rows(n=50):
    return [(i, None if i % 9 == 4 else i // 7 % 4) for i in range(n)]


def all_pages(df, order, size, between=lambda: None):
    out, last = [], None
    while page := page_after(df(), order, last, size).collect():
        out.append(page)
        last = key_of(page, order)
        between()
    return out


@pytest.mark.parametrize("size", [1, 7, 50, 1000])
@pytest.mark.parametrize("order", [ORDER, [("id", False)], [("at", False), ("id", True)]])
def test_pages_make_the_table(spark, size, order):
    df = spark.createDataFrame(rows(20 if size == 1 else 50), "id int, at int").repartition(3).cache()
    pages = all_pages(lambda: df, order, size)
    key = lambda r: tuple((r[n] is None, (-r[n] if down else r[n]) if r[n] is not None else 0) for n, down in order)
    assert [r for p in pages for r in p] == sorted(df.collect(), key=key)
    assert all(len(p) == size for p in pages[:-1])


def test_rows_that_come_between_pages(spark, tmp_path):
    path, order = f"{tmp_path}/t", [("id", False)]
    spark.createDataFrame([(i * 10,) for i in range(20)], "id int").write.parquet(path)
    added = iter([(35,), (5,), (1000,)])  # ahead, behind, at the end

    def put():
        if (r := next(added, None)) is not None:
            spark.createDataFrame([r], "id int").write.mode("append").parquet(path)

    got = [r.id for p in all_pages(lambda: spark.read.parquet(path), order, 3, put) for r in p]
    assert got == sorted([*range(0, 200, 10), 35, 1000])


def test_the_key_reaches_the_scan(spark, tmp_path):
    write_laid(spark.range(0, 100_000, 1, 8), f"{tmp_path}/t", "id")
    page = page_after(spark.read.parquet(f"{tmp_path}/t"), [("id", False)], (90_000,), 5)
    assert [r.id for r in page.collect()] == list(range(90_001, 90_006))
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,90000)" in plan and "TakeOrderedAndProject" in plan


def test_none(spark):
    none = spark.createDataFrame([], "id int, at int")
    assert page_after(none, ORDER, None, 5).collect() == [] and key_of([], ORDER) is None
