"""Sets of ids, dated series in one order, movements between neighbours, and filters on titles and speakers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Abbreviations after which a full stop ends no sentence.
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Prof", "St", "No", "vs", "etc", "e.g", "i.e", "U.S", "U.K")
_DOT = "\u2024"


def shared_keys(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """The distinct keys that both tables have; null keys meet none."""
    return a.select(*key).distinct().join(b.select(*key).distinct(), key, "left_semi")


def is_subset(a: DataFrame, b: DataFrame, key: list[str]) -> DataFrame:
    """One row: n, the distinct keys of a; missing, those that b does not have; subset, whether none is missing."""
    mine = a.select(*key).distinct()
    left = mine.join(b.select(*key).distinct().withColumn("_there", F.lit(True)), key, "left")
    missing = F.count_if(F.col("_there").isNull())
    return left.agg(F.count("*").alias("n"), missing.alias("missing"), (missing == 0).alias("subset"))


def chronological(tables: dict[str, DataFrame], day: str, key: str) -> DataFrame:
    """(day, kind, key, pos): rows of several dated tables, numbered within each day by kind and key; rows without a day go."""
    rows = None
    for kind, df in tables.items():
        one = df.select(F.col(day).alias("day"), F.lit(kind).alias("kind"), F.col(key).alias("key")).where("day is not null")
        rows = one if rows is None else rows.unionAll(one)
    return rows.withColumn("pos", F.row_number().over(W.partitionBy("day").orderBy("kind", "key")))


def movements(df: DataFrame, group: list[str], order: str, value: str) -> DataFrame:
    """For each group: steps, the mean absolute change between neighbours in the order, and where the largest change is (the
    first of several)."""
    change = F.abs(F.col(value) - F.lag(value).over(W.partitionBy(*group).orderBy(order)))
    rows = df.withColumn("_d", change).where("_d is not null")
    at = F.min_by(F.col(order), F.struct((-F.col("_d")).alias("d"), F.col(order).alias("o")))
    return rows.groupBy(*group).agg(F.count("*").alias("steps"), F.avg("_d").alias("mean_abs"), at.alias("at_largest"), F.max("_d").alias("largest"))


def title_boost(text: Column, pattern: str, boost: float, most: int = 120) -> Column:
    """`boost` where the first line, as a title of at most `most` characters, matches the pattern (Java); else 1."""
    title = F.substring_index(text, "\n", 1)
    return F.when((F.length(title) <= most) & title.rlike(pattern), F.lit(boost)).otherwise(F.lit(1.0))


def only_speakers(turns: DataFrame, speaker: str, names: list[str]) -> DataFrame:
    """The turns of the named speakers, whatever their case."""
    return turns.where(F.lower(speaker).isin([n.lower() for n in names]))


def all_caps(line: Column, least: int = 4) -> Column:
    """A line of at least `least` letters, none of them small."""
    return (F.length(F.regexp_replace(line, r"[^\p{L}]", "")) >= least) & ~line.rlike(r"\p{Ll}")


def split_with_abbreviations(text: Column, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> Column:
    """Sentences as an array, cut at white space after . ! or ? except where an abbreviation or a single capital (an
    initial) holds the full stop."""
    held = "|".join(a.replace(".", r"\.") for a in sorted(abbreviations, key=lambda a: (-len(a), a)))
    kept = F.regexp_replace(text, rf"(^|[^\p{{L}}\p{{N}}])({held}|\p{{Lu}})\.", "$1$2" + _DOT)
    return F.transform(F.split(F.regexp_replace(kept, r"([.!?])[ \t-\r]+", "$1\u241f"), "\u241f"), lambda s: F.replace(s, F.lit(_DOT), F.lit(".")))
