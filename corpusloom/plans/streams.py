"""Streaming queries: each runs a stream over the table's files and returns what it wrote, to be held against batch SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.plans.registry import query
from corpusloom.streaming import ingest as Z


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def stream_ingest(spark, sf_dir):
    at = Z.scratch(spark)
    Z.run_to_sink(Z.stream_of(spark, sf_dir, "events.parquet"), f"{at}/out", f"{at}/log")
    return spark.read.parquet(f"{at}/out").groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT count(DISTINCT concat(user_id, '|', event_type)) AS distinct_keys FROM events")
def stream_dedup(spark, sf_dir):
    at = Z.scratch(spark)
    stream = Z.stream_of(spark, sf_dir, "events.parquet")
    stream.writeStream.foreachBatch(Z.append_new(f"{at}/out", ["user_id", "event_type"])).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").agg(F.count("*").alias("distinct_keys"))


@query("""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'purchase') AS n_up, count(*) FILTER (event_type = 'click') AS n_down, count(*) AS n, round((count(*) FILTER (event_type = 'purchase') - count(*) FILTER (event_type = 'click'))::DOUBLE / count(*), 9) AS stance FROM events GROUP BY 1""")
def stream_stance(spark, sf_dir):
    at = Z.scratch(spark)
    index = Z.windowed_index(Z.stream_of(spark, sf_dir, "events.parquet"), "ts", "event_type", "purchase", "click", "1 day", "60 days")
    # a window is told again when it grows: the version with the most rows is the last
    index.writeStream.outputMode("update").foreachBatch(Z.upsert(f"{at}/out", ["start"], "n")).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    rows = Z.read_upserted(spark, f"{at}/out", ["start"], "n")
    return rows.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "n_up", "n_down", "n", F.round("stance", 9).alias("stance"))


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id")
def stream_upsert(spark, sf_dir):
    at = Z.scratch(spark)
    stream = Z.stream_of(spark, sf_dir, "events.parquet")
    stream.writeStream.foreachBatch(Z.upsert(f"{at}/out", ["user_id"], "event_id")).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return Z.read_upserted(spark, f"{at}/out", ["user_id"], "event_id").select("user_id", "event_id")


@query("SELECT user_id, count(*) AS sessions, sum(n)::BIGINT AS events FROM (SELECT user_id, s, count(*) AS n FROM (SELECT user_id, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events)) GROUP BY ALL) GROUP BY user_id")
def stream_sessions(spark, sf_dir):
    at = Z.scratch(spark)
    rows = Z.sessions(Z.stream_of(spark, sf_dir, "events.parquet"), "ts", "user_id", "30 minutes", "1 day")
    rows.writeStream.outputMode("complete").foreachBatch(Z.replace(f"{at}/out")).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{at}/out").groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))
