"""Numeric aggregates that stay defined where a group has no spread."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec


def pearson(x: str | Column, y: str | Column, over: WindowSpec | None = None) -> Column:
    """Correlation of the rows that have both values; null without spread (the built-in one fails there in ANSI mode)."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    on = lambda c: c.over(over) if over is not None else c
    return on(F.covar_pop(x, y)) / F.nullif(on(F.stddev_pop(x)) * on(F.stddev_pop(y)), F.lit(0.0))
