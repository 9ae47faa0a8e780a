"""Training logs, run metadata in paths, retries, dry runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STATE = "log_history array<struct<epoch:double,step:bigint,loss:double,eval_loss:double,eval_f1_macro:double,learning_rate:double>>, best_global_step bigint, num_train_epochs double"


def read_state(df: DataFrame, json: str, keep: list[str]) -> DataFrame:
    """One row for each entry of a trainer's log: kind is 'eval' where it has an eval_loss, else 'train'."""
    state = F.from_json(F.col(json), STATE)
    rows = df.select(*keep, state.alias("s")).select(*keep, F.col("s.best_global_step").alias("best_step"), F.explode("s.log_history").alias("e")).select(*keep, "best_step", "e.*")
    kind = F.when(F.col("eval_loss").isNotNull(), "eval").when(F.col("loss").isNotNull(), "train")
    return rows.withColumn("kind", kind).where("kind is not null")


def best_epochs(entries: DataFrame, by: list[str]) -> DataFrame:
    """The epoch of the lowest eval loss of each run, the first on ties."""
    return entries.where("kind = 'eval'").groupBy(*by).agg(F.min_by("epoch", F.struct("eval_loss", "epoch")).alias("best_epoch"), F.min("eval_loss").alias("best_loss"), F.exp(F.min("eval_loss")).alias("perplexity"), F.count("*").alias("evals"))


def path_part(path: str | Column, pattern: str, last: bool = True) -> Column:
    """The last (nearest) or first match of a pattern's first group in a path, else null."""
    found = F.regexp_extract_all(F.col(path) if isinstance(path, str) else path, F.lit(pattern), F.lit(1))
    return F.try_element_at(found, F.lit(-1 if last else 1))


def learning_rate(path: str | Column) -> Column:
    """A rate such as 3e-5 in a folder's name, also where the sign slipped before the digit (5-e5)."""
    found = F.coalesce(path_part(path, r"(\d(?:\.\d+)?e-?\d+)"), F.regexp_replace(path_part(path, r"(\d(?:\.\d+)?-e\d+)"), "-e", "e-"))
    return found.cast("double")


def normalise_columns(df: DataFrame, columns: list[str], lower_is_better: tuple[str, ...] = ()) -> DataFrame:
    """Columns set to 0..1 over the table, turned round where lower is better; a column without spread is 0."""
    every = W.partitionBy(F.lit(1))
    out = {}
    for c in columns:
        lo, hi = F.min(c).over(every), F.max(c).over(every)
        x = F.when(hi > lo, (F.col(c) - lo) / (hi - lo)).otherwise(F.lit(0.0))
        out[f"{c}_norm"] = 1 - x if c in lower_is_better else x
        best = lo if c in lower_is_better else hi
        out[f"{c}_best"] = F.col(c) == best
    return df.withColumns(out)


def median_quadrant(df: DataFrame, x: str, y: str, name: str = "quadrant") -> DataFrame:
    """high/low by the medians of two columns over the table."""
    every = W.partitionBy(F.lit(1))
    side = lambda c: F.when(F.col(c) > F.median(c).over(every), "high").otherwise("low")
    return df.withColumn(name, F.concat_ws("-", side(x), side(y)))


def to_retry(log: DataFrame, retry_unparsed: bool = True) -> DataFrame:
    """Records to run again: those with an error, and those whose reply gave no label."""
    bad = F.col("error").isNotNull()
    return log.where(bad | F.col("y_pred").isNull() if retry_unparsed else bad)


def dry_run(text: str | Column, classes: int = 3) -> Column:
    """A class decided by the text alone, in the place of a model."""
    c = F.col(text) if isinstance(text, str) else text
    return F.pmod(F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(classes)).cast("int")


def speaker_known(speaker: str | Column, names: list[str]) -> Column:
    """Whether a speaker, titles and marks dropped, holds a known name."""
    c = F.lower(F.col(speaker) if isinstance(speaker, str) else speaker)
    plain = F.regexp_replace(F.regexp_replace(c, r"\b(mr|mrs|ms|dr|prof|president|governor|chair|the honourable)\b\.?", " "), r"[^\p{L} ]+", " ")
    return F.exists(F.array(*(F.lit(n.lower()) for n in names)), lambda n: F.contains(plain, n))


def has_topic(topics: str | Column, topic: str) -> Column:
    """Whether a semicolon list has a topic, ignoring case and blanks."""
    c = F.col(topics) if isinstance(topics, str) else topics
    return F.array_contains(F.transform(F.split(c, ";"), lambda t: F.lower(F.trim(t))), topic.strip().lower())
