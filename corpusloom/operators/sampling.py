"""Seeded samples and splits. The order of a sample is the md5 of seed and key, so it is the same on any cluster."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def draw(seed: int | str, key: str | Column) -> Column:
    """The place of a row in the seeded order."""
    return F.md5(F.concat(F.lit(f"{seed}:"), (F.col(key) if isinstance(key, str) else key).cast("string")))


def holdout(df: DataFrame, key: str, n: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(n rows, the others), by the seeded order. The n rows are found as a top-n, not by sorting the table."""
    ranked = df.withColumn("_draw", draw(seed, key))
    picked = ranked.orderBy("_draw", key).limit(n).select(key)
    return df.join(F.broadcast(picked) if n <= 100_000 else picked, key, "left_semi"), df.join(F.broadcast(picked) if n <= 100_000 else picked, key, "left_anti")


def per_group(df: DataFrame, by: list[str], key: str, k: int, seed: int = 42) -> DataFrame:
    """k rows of each group, all where it has fewer."""
    order = W.partitionBy(*by).orderBy(draw(seed, key), F.col(key))
    return df.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") <= k).drop("_rn")


def equal_share_quotas(counts: DataFrame, group: str, available: str, n: int, seed: int = 42) -> DataFrame:
    """Equal quotas that add up to n (or all rows): what a group lacks is spread over those that have room.

    Each round gives every open group the same level; the level at which the caps sum to n is found in closed form by
    sorting groups by size. The rest, one each, goes to the open groups in the seeded order. One row for each group.
    """
    by_size = W.orderBy(available, group)
    upto = by_size.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = counts.withColumn("_i", F.row_number().over(by_size)).withColumn("_sum", F.sum(available).over(upto))
    rows = rows.withColumn("_g", F.count("*").over(W.partitionBy(F.lit(1)))).withColumn("_total", F.sum(available).over(W.partitionBy(F.lit(1))))
    target = F.least(F.lit(n).cast("long"), F.col("_total"))
    # filling all smaller groups whole and the rest to this group's size takes this many rows
    need = F.col("_sum") + (F.col("_g") - F.col("_i")) * F.col(available)
    full = F.when(need <= target, 1).otherwise(0)
    rows = rows.withColumn("_full", full).withColumn("_target", target)
    every = W.partitionBy(F.lit(1))
    rows = rows.withColumn("_spent", F.sum(F.when(F.col("_full") == 1, F.col(available)).otherwise(0)).over(every)).withColumn("_open", F.sum(1 - F.col("_full")).over(every))
    level = F.when(F.col("_open") > 0, F.floor((F.col("_target") - F.col("_spent")) / F.col("_open"))).otherwise(0)
    extra = F.when(F.col("_open") > 0, (F.col("_target") - F.col("_spent")) % F.col("_open")).otherwise(0)
    order = F.row_number().over(W.partitionBy("_full").orderBy(draw(seed, group), F.col(group)))
    quota = F.when(F.col("_full") == 1, F.col(available)).otherwise(level + F.when(order <= extra, 1).otherwise(0))
    return rows.select(group, F.col(available), quota.cast("long").alias("quota"))


def equal_share(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """A sample of n rows with equal shares of the groups, as far as they have rows."""
    quotas = equal_share_quotas(df.groupBy(group).agg(F.count("*").alias("available")), group, "available", n, seed).select(group, "quota")
    ranked = df.withColumn("_rn", F.row_number().over(W.partitionBy(group).orderBy(draw(seed, key), F.col(key))))
    return ranked.join(quotas, group).where(F.col("_rn") <= F.col("quota")).drop("_rn", "quota")


def boosted(df: DataFrame, group: str, boost: str, key: str, quota: int, share: float, seed: int = 42) -> DataFrame:
    """quota rows of each group; the first floor(share * quota) from its boosted rows as far as it has them."""
    order = W.partitionBy(group, boost).orderBy(draw(seed, key), F.col(key))
    ranked = df.withColumn("_b", F.row_number().over(order))
    first = (F.col(boost) & (F.col("_b") <= int(share * quota))).cast("int")
    ranked = ranked.withColumn("_rn", F.row_number().over(W.partitionBy(group).orderBy(F.desc(first), draw(seed, key), F.col(key))))
    return ranked.where(F.col("_rn") <= quota).drop("_b", "_rn")


def balanced_quota(df: DataFrame, group: str, key: str, n: int, seed: int = 42) -> DataFrame:
    """ceil(n / groups) rows of each group, topped up from the rest, cut to n."""
    quota = df.select(F.ceil(F.lit(n) / F.count_distinct(group)).alias("_q"))
    ranked = df.withColumn("_rn", F.row_number().over(W.partitionBy(group).orderBy(draw(seed, key), F.col(key))))
    placed = ranked.crossJoin(F.broadcast(quota)).withColumn("_late", (F.col("_rn") > F.col("_q")).cast("int"))
    return placed.orderBy("_late", draw(seed, key), key).limit(n).drop("_rn", "_q", "_late")


def first_of_group(df: DataFrame, by: list[str | Column], key: str, quota: Callable[[Column], Column], name: str, seed: int = 42) -> DataFrame:
    """Column `name`: whether a row is among the first quota(n) of its group of n in the seeded order.

    No group meets in one task: rows are counted by the first four digits of their draws, and only the rows of the cell in
    which the quota ends are ranked. df is read twice.
    """
    groups = [f"_g{i}" for i in range(len(by))]
    rows = df.withColumns({g: F.col(b) if isinstance(b, str) else b for g, b in zip(groups, by, strict=True)}).withColumn("_draw", draw(seed, key)).withColumn("_cell", F.substring("_draw", 1, 4))
    cells = rows.groupBy(*groups, "_cell").agg(F.count("*").alias("_m"))
    whole = W.partitionBy(*groups)
    upto = F.sum("_m").over(whole.orderBy("_cell").rowsBetween(W.unboundedPreceding, W.currentRow))
    cells = cells.withColumn("_upto", upto).withColumn("_q", quota(F.sum("_m").over(whole)))
    # the last cell that the quota reaches, and how many of its rows are in
    reached = F.col("_upto") - F.col("_m") < F.col("_q")
    ends = cells.where(reached).groupBy(*(F.col(g).alias(f"_e{g}") for g in groups)).agg(F.max(F.struct("_cell", (F.col("_q") - F.col("_upto") + F.col("_m")).alias("left"))).alias("_end"))
    met = [F.col(g).eqNullSafe(F.col(f"_e{g}")) for g in groups]
    both = rows.join(F.broadcast(ends), reduce(lambda a, b: a & b, met), "left")
    at = F.col("_cell") == F.col("_end._cell")
    # rows of other cells are spread by their own cells, which no rank is needed for
    rank = F.row_number().over(W.partitionBy(*groups, "_cell").orderBy("_draw", F.col(key)))
    chosen = F.when(F.col("_end").isNull(), False).when(at, rank <= F.col("_end.left")).otherwise(F.col("_cell") < F.col("_end._cell"))
    return both.withColumn(name, chosen).select(*df.columns, name)


def stratified_split(df: DataFrame, label: str, key: str, fraction: float = 0.15, seed: int = 42, at_least: int = 1) -> DataFrame:
    """Column split: of each label, max(at_least, round(fraction * n)) rows are 'val', the others 'train'."""
    rows = first_of_group(df, [label], key, lambda n: F.greatest(F.lit(at_least), F.rint(n * fraction)), "_val", seed)
    return rows.withColumn("split", F.when(F.col("_val"), "val").otherwise("train")).drop("_val")


def chronological_split(df: DataFrame, date: str, label: str, key: str, cutoff: Column, test_share: float = 0.67, seed: int = 42) -> DataFrame:
    """Column split: 'train' before cutoff; of each label after it, `test_share` 'test' and the others 'val'."""
    late = F.col(date) >= cutoff
    rows = first_of_group(df, [late, label], key, lambda n: F.rint(n * test_share), "_test", seed)
    return rows.withColumn("split", F.when(~late, "train").when(F.col("_test"), "test").otherwise("val")).drop("_test")


def date_quantile(df: DataFrame, date: str, q: float) -> DataFrame:
    """One row: the date at quantile q, fractions of a day cut off."""
    return df.agg(F.percentile(F.unix_date(F.col(date).cast("date")), F.lit(q)).alias("day")).select(F.date_from_unix_date(F.floor("day").cast("int")).alias("cutoff"))
