"""Statistics from grouped aggregates; distribution functions run on the few result rows."""

from __future__ import annotations

import math
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.functions.numbers import pearson
from corpusloom.operators.evaluate import average_rank


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function."""
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    out = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            out *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return out


def incomplete_beta(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return incomplete_beta(df / 2, 0.5, df / (df + t * t))


def t_quantile(p: float, df: float) -> float:
    """The two-sided critical value: P(|T| > t) = 1 - p."""
    lo, hi = 0.0, 1e4
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if t_two_sided(mid, df) > 1 - p else (lo, mid)
    return hi


@F.pandas_udf(T.DoubleType())
def t_p_value(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b <= 0 else t_two_sided(a, b) for a, b in zip(t, df, strict=True)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def t_critical(df: pd.Series) -> pd.Series:
    known: dict[float, float] = {}
    return pd.Series([None if pd.isna(d) or d <= 0 else known.setdefault(d, t_quantile(0.95, d)) for d in df], dtype="float64")


def paired_t(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """n, mean difference and t of b - a; t is null where it has no spread."""
    d = F.col(b) - F.col(a)
    out = df.where(d.isNotNull()).groupBy(*by).agg(F.count("*").alias("n"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("sd_diff"))
    return out.withColumn("t", F.when(F.col("sd_diff") > 0, F.col("mean_diff") / (F.col("sd_diff") / F.sqrt("n"))))


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Pearson correlation of average ranks within each group."""
    rows = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    ranked = rows.withColumn("ra", average_rank(F.col(a), by)).withColumn("rb", average_rank(F.col(b), by))
    return ranked.groupBy(*by).agg(F.count("*").alias("n"), pearson("ra", "rb").alias("rho"))


def mann_whitney(df: DataFrame, by: list[str], group: str, first: str, value: str) -> DataFrame:
    """U of the rows whose group is `first` against the others, from the sum of average ranks: no pairs are made."""
    ranked = df.withColumn("r", average_rank(F.col(value), by))
    one = F.col(group) == first
    out = ranked.groupBy(*by).agg(F.count_if(one).alias("n1"), F.count_if(~one).alias("n2"), F.sum(F.when(one, F.col("r"))).alias("rank_sum"))
    return out.withColumn("u", F.col("rank_sum") - F.col("n1") * (F.col("n1") + 1) / 2.0)


def mann_whitney_exact(x: list[float], y: list[float]) -> float:
    """One-sided p of U at least as large as seen, by all ways to deal the values (small samples)."""
    both = x + y

    def u(ix: tuple[int, ...]) -> float:
        rest = [k for k in range(len(both)) if k not in ix]
        return sum((both[i] > both[k]) + 0.5 * (both[i] == both[k]) for i in ix for k in rest)

    seen = u(tuple(range(len(x))))
    ways = list(combinations(range(len(both)), len(x)))
    return sum(u(w) >= seen - 1e-12 for w in ways) / len(ways)


def logit_interaction(df: DataFrame, outcome: str, a: str, b: str) -> DataFrame:
    """Saturated logit of outcome on two 0/1 columns in closed form: the coefficients and the interaction's plain error."""
    cell = {(i, j): (F.col(a) == i) & (F.col(b) == j) for i in (0, 1) for j in (0, 1)}
    sums = [F.count_if(c).alias(f"n{i}{j}") for (i, j), c in cell.items()] + [F.sum(F.when(c, F.col(outcome).cast("double"))).alias(f"s{i}{j}") for (i, j), c in cell.items()]
    odds = {k: F.log(F.col(f"s{k}") / (F.col(f"n{k}") - F.col(f"s{k}"))) for k in ("00", "01", "10", "11")}
    var = sum((1 / F.col(f"s{k}") + 1 / (F.col(f"n{k}") - F.col(f"s{k}")) for k in odds), F.lit(0.0))
    return df.agg(*sums).select(odds["00"].alias("intercept"), (odds["10"] - odds["00"]).alias("b_a"), (odds["01"] - odds["00"]).alias("b_b"), (odds["11"] - odds["10"] - odds["01"] + odds["00"]).alias("interaction"), F.sqrt(var).alias("se"))


def clustered_interaction(df: DataFrame, outcome: str, a: str, b: str, cluster: str) -> DataFrame:
    """The interaction of logit_interaction with its cluster-robust error.

    In the saturated model each cell's log odds has its own score, so the sandwich needs, for each cluster, only the sum
    of residuals in each cell: one aggregate by cluster, one over clusters.
    """
    cells = ["00", "01", "10", "11"]
    key = F.concat(F.col(a).cast("string"), F.col(b).cast("string"))
    rows = df.select(F.col(cluster).alias("g"), key.alias("k"), F.col(outcome).cast("double").alias("y"))
    means = rows.groupBy("k").agg(F.avg("y").alias("p"), F.count("*").alias("m"))
    sign = F.when(F.col("k").isin("01", "10"), -1.0).otherwise(1.0)
    part = rows.join(F.broadcast(means), "k").withColumn("r", sign * (F.col("y") - F.col("p")) / (F.col("m") * F.col("p") * (1 - F.col("p"))))
    by = part.groupBy("g").agg(F.sum("r").alias("s")).agg(F.sum(F.col("s") ** 2).alias("v"), F.count("*").alias("c"))
    effect = means.agg(F.sum(F.when(F.col("k").isin(cells), sign * F.log(F.col("p") / (1 - F.col("p"))))).alias("interaction"))
    se = F.sqrt(F.col("v") * F.col("c") / (F.col("c") - 1))
    return effect.crossJoin(F.broadcast(by)).select("interaction", se.alias("cluster_se"), (F.col("interaction") / se).alias("z"), F.col("c").alias("clusters"))


def bootstrap_means(df: DataFrame, by: list[str], value: str, key: str, rounds: int = 200, seed: int = 0) -> DataFrame:
    """Mean and percentile interval of the mean over resamples with Poisson(1) weights drawn by hash.

    Each row carries its own weights for all rounds, so a resample needs no row to be picked and no join; partial sums
    combine before the shuffle.
    """
    cut = [0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119]
    rows = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("x"), F.col(key).alias("key"))
    drawn = rows.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))))
    u = F.pmod(F.xxhash64(F.lit(seed), "b", "key"), F.lit(1 << 53)).cast("double") / float(1 << 53)
    weight = sum((F.when(u >= c, 1).otherwise(0) for c in cut), F.lit(0))
    sums = drawn.withColumn("w", weight).groupBy(*by, "b").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("m"))
    spread = sums.groupBy(*by).agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    return rows.groupBy(*by).agg(F.avg("x").alias("mean"), F.count("*").alias("n")).join(spread, by)
