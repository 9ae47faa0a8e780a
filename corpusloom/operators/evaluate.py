"""Evaluation of predictions: scores, confusion counts, votes, error rates, decompositions, sweeps.

Predictions are long tables with y_true and y_pred; `by` names the columns of a run or cell. Rows without a truth or a
prediction are not scored. Classes are given, so a class that never occurs still counts with a score of 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CLASSES = (0, 1, 2)


def scored(preds: DataFrame) -> DataFrame:
    return preds.where(F.col("y_true").isNotNull() & F.col("y_pred").isNotNull())


def ratio(a: Column, b: Column) -> Column:
    """a / b, and 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a.cast("double") / b)


def class_counts(preds: DataFrame, by: list[str], classes: tuple[int, ...] = CLASSES) -> DataFrame:
    """One row for each cell and class: tp, fp, fn, support. All classes come from one aggregate, without a join."""
    rows = scored(preds)
    sums = []
    for c in classes:
        t, p = F.col("y_true") == c, F.col("y_pred") == c
        sums += [F.count_if(t & p).alias(f"tp{c}"), F.count_if(~t & p).alias(f"fp{c}"), F.count_if(t & ~p).alias(f"fn{c}")]
    wide = rows.groupBy(*by).agg(*sums, F.count("*").alias("n"))
    cells = F.array(*(F.struct(F.lit(c).alias("class"), F.col(f"tp{c}").alias("tp"), F.col(f"fp{c}").alias("fp"), F.col(f"fn{c}").alias("fn")) for c in classes))
    return wide.select(*by, "n", F.inline(cells)).withColumn("support", F.col("tp") + F.col("fn"))


def class_scores(preds: DataFrame, by: list[str], classes: tuple[int, ...] = CLASSES) -> DataFrame:
    """Precision, recall and F1 for each cell and class."""
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("support"))
    f1 = ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return class_counts(preds, by, classes).withColumn("precision", p).withColumn("recall", r).withColumn("f1", f1)


def run_scores(preds: DataFrame, by: list[str], classes: tuple[int, ...] = CLASSES) -> DataFrame:
    """accuracy, macro_f1 and weighted_f1 for each cell."""
    scores = class_scores(preds, by, classes)
    return scores.groupBy(*by).agg(F.max("n").alias("n"), (F.sum("tp") / F.max("n")).alias("accuracy"), F.avg("f1").alias("macro_f1"), (F.sum(F.col("f1") * F.col("support")) / F.max("n")).alias("weighted_f1"))


def spread(df: DataFrame, by: list[str], metrics: list[str], population: bool = False) -> DataFrame:
    """Mean and standard deviation of metrics over runs; one run alone has the deviation 0."""
    sd = F.stddev_pop if population else F.stddev_samp
    aggs = [a for m in metrics for a in (F.avg(m).alias(f"{m}_mean"), F.coalesce(sd(m), F.lit(0.0)).alias(f"{m}_sd"))]
    return df.groupBy(*by).agg(F.count("*").alias("runs"), *aggs)


def confusion(preds: DataFrame, by: list[str], classes: tuple[int, ...] = CLASSES) -> DataFrame:
    """Counts for every pair of classes, with 0 where none occurs, and their percentage of the true class."""
    sums = [F.count_if((F.col("y_true") == t) & (F.col("y_pred") == p)).alias(f"c{t}_{p}") for t in classes for p in classes]
    wide = scored(preds).groupBy(*by).agg(*sums)
    cells = F.array(*(F.struct(F.lit(t).alias("y_true"), F.lit(p).alias("y_pred"), F.col(f"c{t}_{p}").alias("n")) for t in classes for p in classes))
    row = F.sum("n").over(W.partitionBy(*by, "y_true"))
    return wide.select(*by, F.inline(cells)).withColumn("row_pct", 100 * ratio(F.col("n"), row))


def confusion_wide(preds: DataFrame, by: list[str], classes: tuple[int, ...] = CLASSES) -> DataFrame:
    return confusion(preds, by, classes).groupBy(*by, "y_true").pivot("y_pred", list(classes)).agg(F.first("n")).select(*by, "y_true", *(F.col(str(c)).alias(f"pred_{c}") for c in classes))


def vote_table(preds: DataFrame, item: list[str], voter: str = "model", classes: tuple[int, ...] = CLASSES) -> DataFrame:
    """Votes of all fits for each item: counts by class, the majority (lowest class on a tie), its share, a tie flag, and
    a breakdown by voter."""
    rows = scored(preds)
    per = rows.groupBy(*item, voter).agg(F.first("y_true").alias("y_true"), *(F.count_if(F.col("y_pred") == c).alias(f"v{c}") for c in classes))
    parts = F.array_join(F.filter(F.array(*(F.when(F.col(f"v{c}") > 0, F.format_string(f"{c}:%d", F.col(f"v{c}"))) for c in classes)), lambda x: x.isNotNull()), ",")
    per = per.withColumn("said", F.concat_ws("=", F.col(voter), parts))
    out = per.groupBy(*item).agg(F.first("y_true").alias("y_true"), *(F.sum(f"v{c}").alias(f"votes_{c}") for c in classes), F.array_join(F.array_sort(F.collect_list("said")), "; ").alias("by_voter"))
    return _decided(out, classes)


def majorities(preds: DataFrame, item: list[str], classes: tuple[int, ...] = CLASSES) -> DataFrame:
    """As vote_table, without the breakdown by voter: one aggregate for each item."""
    counts = (F.count_if(F.col("y_pred") == c).alias(f"votes_{c}") for c in classes)
    return _decided(scored(preds).groupBy(*item).agg(F.first("y_true").alias("y_true"), *counts), classes)


def _decided(out: DataFrame, classes: tuple[int, ...]) -> DataFrame:
    votes = [F.col(f"votes_{c}") for c in classes]
    best, fits = F.greatest(*votes), reduce(lambda a, b: a + b, votes)
    major = F.coalesce(*(F.when(v == best, F.lit(c)) for c, v in zip(classes, votes, strict=True)))
    ties = reduce(lambda a, b: a + b, ((v == best).cast("int") for v in votes))
    return out.withColumn("majority", major).withColumn("share", F.round(best / fits, 3)).withColumn("tie", ties > 1)


def miss_rates(preds: DataFrame, by: list[str]) -> DataFrame:
    """Totals, misses and miss rate of every cell, cells without a miss included."""
    return scored(preds).groupBy(*by).agg(F.count("*").alias("total"), F.count_if(F.col("y_true") != F.col("y_pred")).alias("misses")).withColumn("rate", F.col("misses") / F.col("total"))


def miss_rollup(preds: DataFrame, columns: list[str]) -> DataFrame:
    """Misses at every prefix of columns, the grand total included; level is the number of columns that hold."""
    rows = scored(preds).rollup(*columns).agg(F.count("*").alias("total"), F.count_if(F.col("y_true") != F.col("y_pred")).alias("misses"), F.grouping_id().alias("g"))
    return rows.withColumn("level", F.lit(len(columns)) - F.bit_count("g")).drop("g")


def demean(df: DataFrame, value: str, by: list[str], name: str, median: bool = False) -> DataFrame:
    """value less its mean (or median) within by."""
    middle = (F.median if median else F.avg)(value).over(W.partitionBy(*by))
    return df.withColumn(name, F.col(value) - middle)


def pivot_mean(df: DataFrame, rows: list[str], column: str, values: list, value: str, median: bool = False) -> DataFrame:
    agg = F.median(value) if median else F.avg(value)
    return df.groupBy(*rows).pivot(column, values).agg(agg)


def best_with_runner_up(df: DataFrame, by: list[str], option: str, score: str, sd: str) -> DataFrame:
    """The best option of each group, the second, their margin, and whether it exceeds the pooled deviation."""
    order = W.partitionBy(*by).orderBy(F.desc(score), F.asc(option))
    ranked = df.select(*by, F.col(option).alias("best"), F.col(score).alias("best_score"), F.col(sd).alias("best_sd"), F.lead(option).over(order).alias("second"), F.lead(score).over(order).alias("second_score"), F.lead(sd).over(order).alias("second_sd"), F.row_number().over(order).alias("rn")).where("rn = 1").drop("rn")
    pooled = F.sqrt((F.col("best_sd") ** 2 + F.col("second_sd") ** 2) / 2)
    out = ranked.withColumn("margin", F.col("best_score") - F.col("second_score")).withColumn("pooled_sd", pooled)
    return out.withColumn("margin_in_sd", F.when(F.col("pooled_sd") > 0, F.col("margin") / F.col("pooled_sd"))).withColumn("separable", F.coalesce(F.col("margin") > F.col("pooled_sd"), F.lit(False)))


def average_rank(value: Column, by: list[str]) -> Column:
    """Rank from 1 by value, ascending, ties at their mean rank. Over an empty `by`, all rows are ranked in one task."""
    parts = [F.col(c) for c in by] or [F.lit(1)]
    return F.rank().over(W.partitionBy(*parts).orderBy(value)) + (F.count("*").over(W.partitionBy(*parts, value)) - 1) / 2.0


def shared_option(df: DataFrame, by: str, option: str, group: str, score: str) -> DataFrame:
    """For each `by`, options scored in all groups: joint mean, minimum, and sum of descending ranks within the group."""
    ranks = df.withColumn("rank", average_rank(-F.col(score), [by, group]))
    groups = df.select(by, group).distinct().groupBy(by).agg(F.count("*").alias("g"))
    joint = ranks.groupBy(by, option).agg(F.count_distinct(group).alias("have"), F.avg(score).alias("mean"), F.min(score).alias("minimum"), (-F.sum("rank")).alias("rank_score"))
    return joint.join(groups, by).where("have = g").drop("have", "g")


def classify_difference(delta: Column, tolerance: float = 1e-9) -> Column:
    """IDENTICAL, nearly equal, different or missing."""
    return F.when(delta.isNull(), "missing").when(delta == 0, "identical").when(F.abs(delta) < tolerance, "equal").otherwise("differs")


def weighted_mean(df: DataFrame, by: list[str], value: str, weight: str, name: str) -> DataFrame:
    return df.groupBy(*by).agg((F.sum(F.col(value) * F.col(weight)) / F.sum(weight)).alias(name))
