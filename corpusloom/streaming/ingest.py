"""Structured Streaming: incremental ingestion, deduplication with bounded state, windowed indexes, upserts by key.

Sources are folders of Parquet files; availableNow runs what is there and stops, so a rerun only reads new files.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.dedup import dedup_key


def scratch(spark: SparkSession) -> str:
    """A new folder for checkpoints and results, in the shared folder of the session."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        root = tempfile.mkdtemp(prefix="corpusloom-stream-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_of(spark: SparkSession, folder: str, name: str, files_per_batch: int = 16) -> DataFrame:
    """The files `name` in a folder as a stream, with the schema of the table there; times without zone are in the session's."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", name if name.endswith(".parquet") else "*.parquet").option("recursiveFileLookup", "true").parquet(folder)
    return stream.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def run_to_sink(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Runs a stream over what is there and waits; files written once stay written once when it is run again."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def dedup_within(stream: DataFrame, time: str, delay: str, text: str | None = None, keys: list[str] | None = None) -> DataFrame:
    """First rows of each key within a watermark: state ends with the delay, so it does not grow with the stream."""
    rows = stream.withWatermark(time, delay)
    if text is not None:
        rows = rows.withColumn("_key", dedup_key(text))
        return rows.dropDuplicatesWithinWatermark(["_key"]).drop("_key")
    return rows.dropDuplicatesWithinWatermark(keys)


def windowed_index(stream: DataFrame, time: str, label: str, up: str, down: str, width: str, delay: str, slide: str | None = None) -> DataFrame:
    """(up - down) / all in tumbling or sliding windows, late rows within the delay included."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    out = stream.withWatermark(time, delay).groupBy(w.alias("w")).agg(F.count_if(F.col(label) == up).alias("n_up"), F.count_if(F.col(label) == down).alias("n_down"), F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), "n_up", "n_down", "n", ((F.col("n_up") - F.col("n_down")) / F.col("n")).alias("stance"))


def sessions(stream: DataFrame, time: str, key: str, gap: str, delay: str) -> DataFrame:
    """Sessions of a key: windows that end after a gap without rows."""
    out = stream.withWatermark(time, delay).groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def upsert(path: str, key: list[str], order: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink in which the latest record of a key wins: each batch appends its best rows as a version; the
    reader takes the best of all versions, so a batch that runs twice changes nothing."""

    def write(batch: DataFrame, number: int) -> None:
        best = batch.select(*key, F.struct(*batch.columns).alias("_r"), F.col(order).alias("_o")).groupBy(*key).agg(F.max_by("_r", "_o").alias("_r")).select("_r.*")
        best.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def read_upserted(spark: SparkSession, path: str, key: list[str], order: str) -> DataFrame:
    rows = spark.read.parquet(path).drop("batch")
    return rows.select(*key, F.struct(*rows.columns).alias("_r"), F.col(order).alias("_o")).groupBy(*key).agg(F.max_by("_r", "_o").alias("_r")).select("_r.*")


def append_new(path: str, key: list[str]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink that adds the rows whose key the sink does not have yet; a rerun of a batch replaces it."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark._jvm.org.apache.hadoop.fs
        p = jvm.Path(path)
        fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
        new = batch.dropDuplicates(key)
        if fs.exists(p) and len(fs.listStatus(p)):
            there = spark.read.parquet(path).where(F.col("batch") != number).select(*key).distinct()
            new = new.join(there, key, "left_anti")
        new.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return write


def replace(path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink for complete results: each batch takes the place of the one before."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return write
