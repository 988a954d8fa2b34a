"""Functions of one text as column expressions, where Spark has none."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def of_texts(f: Callable, kind: str) -> Callable[[Column], Column]:
    """f of each text of a column.  Rows go to Python a hundred at a time: an Arrow batch, of up to 10,000 rows or 64 MB, would be
    held there as objects, with all that f makes of it."""
    return F.udf(f, kind, useArrow=False)
