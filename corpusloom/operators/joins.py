"""Joins with the checks and outcomes that data pipelines rely on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str], must: Column | None = None) -> DataFrame:
    """Left join that fails where the right side has a key twice, or where `must` does not hold on the joined row.

    The check is part of the plan: the right side is grouped by key anyway, and a key that comes twice raises there.
    """
    rest = [c for c in right.columns if c not in keys]
    packed = right.groupBy(*keys).agg(F.count("*").alias("_n"), F.first(F.struct(*rest)).alias("_r"))
    one = packed.select(*keys, F.when(F.col("_n") == 1, F.col("_r")).otherwise(F.raise_error(F.lit("a key of the right side is not unique"))).alias("_r"))
    out = left.join(one, keys, "left").select(*left.columns, *(F.col(f"_r.{c}").alias(c) for c in rest))
    if must is None:
        return out
    return out.where(F.when(F.coalesce(must, F.lit(False)), True).otherwise(F.raise_error(F.lit("a joined row breaks the rule")).cast("boolean")))


def text_key(col: str | Column) -> Column:
    """White space collapsed and trimmed; case kept."""
    return F.trim(F.regexp_replace(F.col(col) if isinstance(col, str) else col, r"[\x20\x09-\x0D]+", " "))


def match_outcome(rows: DataFrame, text: str, corpus: DataFrame, corpus_text: str, date: str) -> DataFrame:
    """Outcome of looking texts up in a dated corpus: text_exact with one date, ambiguous with several, else unmatched."""
    known = corpus.select(text_key(corpus_text).alias("_k"), F.col(date).cast("string").alias("_d")).where("_k <> '' and _d is not null")
    dates = known.groupBy("_k").agg(F.array_sort(F.collect_set("_d")).alias("_dates"))
    out = rows.withColumn("_k", text_key(text)).join(dates, "_k", "left")
    n = F.coalesce(F.size("_dates"), F.lit(0))
    n = F.when(F.col("_dates").isNull(), 0).otherwise(n)
    status = F.when(n == 0, "unmatched").when(n == 1, "text_exact").otherwise("ambiguous")
    return out.withColumns({"n_dates": n, "outcome": status, "matched": F.when(n == 1, F.col("_dates")[0]), "candidates": F.when(n > 1, F.array_join("_dates", "; "))}).drop("_k", "_dates")


def without(left: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(done.select(*keys).distinct(), keys, "left_anti")


def with_zeros(totals: DataFrame, counts: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Totals with counts beside them, 0 where none was counted."""
    return totals.join(counts, keys, "left").na.fill(0, columns)
