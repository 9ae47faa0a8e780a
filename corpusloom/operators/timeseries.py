"""Index series over calendar periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.numbers import pearson


def stance_index(df: DataFrame, date: str, label: str, period: str, by: list[str] | None = None, up: str = "hawkish", down: str = "dovish", flat: str = "neutral") -> DataFrame:
    """(up - down) / all for each period; rows without a date or a known label do not count, empty periods are absent."""
    by = by or []
    rows = df.where(F.col(label).isin(up, down, flat) & F.col(date).isNotNull())
    count = lambda v: F.count_if(F.col(label) == v)
    out = rows.groupBy(*by, F.to_date(F.date_trunc(period, F.col(date))).alias("period")).agg(count(up).alias("n_up"), count(down).alias("n_down"), count(flat).alias("n_flat"), F.count("*").alias("n"))
    return out.withColumn("stance", (F.col("n_up") - F.col("n_down")) / F.col("n"))


def composition(index: DataFrame) -> DataFrame:
    """Shares of the three labels in each period of a stance index."""
    return index.withColumns({f"share_{k}": F.col(f"n_{k}") / F.col("n") for k in ("up", "down", "flat")})


def calendar(df: DataFrame, column: str, step: str, by: list[str] | None = None) -> DataFrame:
    """Every period from the first to the last one in the table (of each `by`), one row each."""
    span = df.groupBy(*(by or [])).agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    return span.select(*(by or []), F.explode(F.sequence("lo", "hi", F.expr(f"interval {step}"))).alias(column))


def fill_forward(df: DataFrame, order: str, columns: list[str], by: list[str]) -> DataFrame:
    """The last known value of each column, in order, within by."""
    w = W.partitionBy(*(by or [F.lit(1)])).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in columns})


def rolling_corr(df: DataFrame, order: str, a: str, b: str, by: list[str], window: int = 8, at_least: int = 4) -> DataFrame:
    """Pearson correlation over the last `window` rows, from the rows that have both values; null below `at_least`."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(1 - window, 0)
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    n = F.count(x).over(w)
    spread = (F.var_pop(x).over(w) > 1e-18) & (F.var_pop(y).over(w) > 1e-18)
    return df.withColumn("pairs", n).withColumn("r", F.when((n >= at_least) & spread, pearson(x, y, w)))


def pairs(df: DataFrame, name: str, on: list[str], value: str) -> DataFrame:
    """All pairs of named series (a before b) on the same period."""
    one = df.select(*on, F.col(name).alias("a"), F.col(value).alias("va"))
    two = df.select(*on, F.col(name).alias("b"), F.col(value).alias("vb"))
    return one.join(two, on).where("a < b")


def interpolate(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    """Null y between known ones set on the straight line; at the ends, the nearest known value."""
    before = W.partitionBy(*by).orderBy(x).rowsBetween(W.unboundedPreceding, W.currentRow)
    after = W.partitionBy(*by).orderBy(x).rowsBetween(W.currentRow, W.unboundedFollowing)
    known: Column = F.when(F.col(y).isNotNull(), F.struct(F.col(x).alias("x"), F.col(y).alias("y")))
    out = df.withColumn("_p", F.last(known, ignorenulls=True).over(before)).withColumn("_n", F.first(known, ignorenulls=True).over(after))
    line = F.col("_p.y") + (F.col("_n.y") - F.col("_p.y")) * (F.col(x) - F.col("_p.x")) / (F.col("_n.x") - F.col("_p.x"))
    return out.withColumn(y, F.coalesce(F.col(y), line, F.col("_p.y"), F.col("_n.y"))).drop("_p", "_n")
