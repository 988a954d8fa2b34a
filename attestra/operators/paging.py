"""Pages of a table by the key of the row before, instead of by offset."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _behind(order: Sequence[tuple[str, bool]], last: Sequence) -> Column:
    """Rows that come after a key: later in one column, alike in those before.  Nulls come last, so nothing comes after one."""
    parts = []
    for i, ((name, down), value) in enumerate(zip(order, last, strict=True)):
        if value is None:
            continue
        later = (F.col(name) < F.lit(value)) if down else (F.col(name) > F.lit(value))
        alike = [F.col(n).eqNullSafe(F.lit(v)) for (n, _), v in zip(order[:i], last[:i], strict=True)]
        parts.append(reduce(lambda a, b: a & b, alike, later | F.col(name).isNull()))
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def page_after(rows: DataFrame, order: Sequence[tuple[str, bool]], last: Sequence | None, limit: int) -> DataFrame:
    """The next ``limit`` rows behind the key ``last`` (none: the first).  order: columns, and whether each falls; together they tell rows
    apart.  The key is a filter that reaches the scan: files and row groups before it are not read where rows are laid by it, and
    each task keeps no more than ``limit`` rows.  Rows that are put in between two pages show up if they are behind the key,
    and move no other row to another page."""
    rest = rows if last is None else rows.where(_behind(order, last))
    return rest.orderBy(*[F.desc_nulls_last(n) if down else F.asc_nulls_last(n) for n, down in order]).limit(limit)


def key_of(page: list, order: Sequence[tuple[str, bool]]) -> tuple | None:
    """The key behind which the next page begins: of the last row of a page; None if there is none."""
    return tuple(page[-1][n] for n, _ in order) if page else None


def write_laid(rows: DataFrame, path: str, *by: str) -> None:
    """Write rows in ranges of their key, each file sorted by it."""
    rows.repartitionByRange(*by).sortWithinPartitions(*by).write.mode("overwrite").parquet(path)
