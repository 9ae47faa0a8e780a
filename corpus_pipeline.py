"""The training-data pipeline: stages over `documents`, each written as Parquet and read again by the next.

Every stage takes null texts as empty ones and a null doc_id as a key of its own, reads very long texts whole, judges rows
that agree in doc_id and text alike (deduplication keeps one of them), keeps further columns whatever their names but the
few kept for the pipeline, and gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import content_id, discard, materialise, read, text_of
from corpusloom.llm.op1_quality import classify
from corpusloom.llm.op6_mixing import mix_sources
from corpusloom.llm.op7_jaccard import near_duplicate_groups
from corpusloom.llm.op8_shards import assign_shards
from corpusloom.llm.op9_decontaminate import decontaminate


#: Names of helper columns, which no column of docs may have.
KEY, TIMES, COPY, ONE = ["__pipeline_id", "__pipeline_text"], "__pipeline_times", "__pipeline_copy", "__pipeline_one"


def _with_key(docs: DataFrame) -> DataFrame:
    """docs with the columns KEY, by which decisions are joined to rows: doc_id (a number in the place of null) and text."""
    if clash := {c.lower() for c in docs.columns} & {*KEY, TIMES, COPY, ONE}:
        raise ValueError(f"column names kept for the pipeline: {sorted(clash)}")
    return docs.withColumns({KEY[0]: _id("doc_id"), KEY[1]: content_id(text_of())})


def _id(col: str) -> Column:
    return F.coalesce(F.col(col).cast("long"), F.lit(-(2**63)))


def _decided(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.select(_id("doc_id").alias(KEY[0]), F.col("text_id").alias(KEY[1]), *more)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier rejects go: toxic ones, and those of low quality."""
    bad = _decided(classify(docs, read(spark, sf_dir, "labels")).where("not keep")).distinct()
    return _with_key(docs).join(bad, KEY, "left_anti").select(*docs.columns)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates, the row with the smallest doc_id stays; rows without words all stay."""
    groups = materialise(near_duplicate_groups(docs), "groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_id")).alias("first")
    kept = groups.where("n_shingles > 0").groupBy("group_id").agg(first).select("first.*")
    kept = _decided(kept, F.lit(True).alias(ONE)).unionAll(_decided(groups.where("n_shingles = 0"), F.lit(False)).distinct())
    found = _with_key(docs).join(kept, KEY)
    return found.where(F.col(ONE)).dropDuplicates(KEY).unionAll(found.where(~F.col(ONE))).select(*docs.columns)


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a window of a benchmark item go."""
    bad = _decided(decontaminate(docs, read(spark, sf_dir, "benchmark")).where("contaminated")).distinct()
    return _with_key(docs).join(bad, KEY, "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row stays as often as the mix takes it, to the nearest whole number; a source's rows are taken in a seeded order.

    Rows without words carry no tokens to mix, and stay once.
    """
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(1)).cast("int")
    taken = _decided(mix_sources(docs), times.alias(TIMES)).groupBy(*KEY).agg(F.max(TIMES).alias(TIMES)).where(F.col(TIMES) > 0)
    return _with_key(docs).join(taken, KEY).withColumn(COPY, F.explode(F.sequence(F.lit(1), F.col(TIMES)))).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row with its shard and its slot there."""
    return assign_shards(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", clean_of_benchmark),
    ("mixing sources", mix),
    ("sharding", shard),
]

#: No SQL: the stages rest on trained models and hashes that SQL does not have. tests/llm holds
#: what each stage must keep against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    last = None
    for name, stage in STAGES[:-1]:
        done = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            discard(last)
        docs = last = done
    return STAGES[-1][1](spark, docs, sf_dir)
