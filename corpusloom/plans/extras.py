"""Queries over logs and small tables of runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import logs as G
from corpusloom.plans.evaluation import LLM, generative
from corpusloom.plans.registry import query, table

_LOG = """j AS (SELECT l_orderkey AS run, l_linenumber AS epoch, l_extendedprice / 10000 AS eval_loss, round(l_discount, 4) AS f1 FROM lineitem)"""


@query(f"WITH {_LOG} SELECT run, arg_min(epoch::DOUBLE, {{'l': eval_loss, 'e': epoch}}) AS best_epoch, round(min(eval_loss), 6) AS best_loss, round(exp(min(eval_loss)), 6) AS perplexity, count(*) AS evals FROM j GROUP BY run")
def trainer_log(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run"), F.col("l_linenumber").cast("double").alias("epoch"), (F.col("l_extendedprice") / 10000).alias("eval_loss"), F.round("l_discount", 4).alias("f1"))
    entry = F.struct("epoch", F.lit(None).cast("long").alias("step"), F.lit(None).cast("double").alias("loss"), "eval_loss", F.col("f1").alias("eval_f1_macro"))
    logs = rows.groupBy("run").agg(F.collect_list(entry).alias("log_history")).select("run", F.to_json(F.struct("log_history")).alias("j"))
    out = G.best_epochs(G.read_state(logs, "j", ["run"]), ["run"])
    return out.withColumns({"best_loss": F.round("best_loss", 6), "perplexity": F.round("perplexity", 6)})


@query("""WITH s AS (SELECT n_name AS nation, round(avg(c_acctbal), 4) AS score, count(*) AS loss FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
SELECT nation, round((score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()), 6) AS score_norm, score = max(score) OVER () AS score_best, round(1 - (loss - min(loss) OVER ())::DOUBLE / (max(loss) OVER () - min(loss) OVER ()), 6) AS loss_norm, loss = min(loss) OVER () AS loss_best,
concat(CASE WHEN score > median(score) OVER () THEN 'high' ELSE 'low' END, '-', CASE WHEN loss > median(loss) OVER () THEN 'high' ELSE 'low' END) AS quadrant FROM s""")
def normalised_board(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    board = table(spark, sf_dir, "customer").join(nation, "c_nationkey").groupBy("nation").agg(F.round(F.avg("c_acctbal"), 4).alias("score"), F.count("*").alias("loss"))
    out = G.median_quadrant(G.normalise_columns(board, ["score", "loss"], ("loss",)), "score", "loss")
    return out.select("nation", F.round("score_norm", 6).alias("score_norm"), "score_best", F.round("loss_norm", 6).alias("loss_norm"), "loss_best", "quadrant")


@query("SELECT source, round(quantile_cont(n_chars, 0.025), 4) AS lo, round(median(n_chars), 4) AS mid, round(quantile_cont(n_chars, 0.975), 4) AS hi, min(n_chars) AS least, max(n_chars) AS most FROM documents GROUP BY source")
def size_quantiles(spark, sf_dir):
    q = lambda p: F.round(F.percentile("n_chars", F.lit(p)), 4)
    return table(spark, sf_dir, "documents").groupBy("source").agg(q(0.025).alias("lo"), F.round(F.median("n_chars"), 4).alias("mid"), q(0.975).alias("hi"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most"))


@query(f"WITH {LLM} SELECT model, prompt, count(*) AS again, count(error) AS errors FROM llm WHERE error IS NOT NULL OR y_pred IS NULL GROUP BY model, prompt")
def retry_set(spark, sf_dir):
    return G.to_retry(generative(spark, sf_dir)).groupBy("model", "prompt").agg(F.count("*").alias("again"), F.count("error").alias("errors"))


@query("SELECT doc_id, CAST(('0x' || substr(md5(text), 1, 8))::BIGINT % 3 AS INTEGER) AS label FROM documents")
def dry_run_labels(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", G.dry_run("text").alias("label"))


@query("SELECT concat('runs/lr-', CASE o_orderkey % 3 WHEN 0 THEN '3e-5' WHEN 1 THEN '5-e5' ELSE '2e-5' END, '/v', o_orderkey % 4 + 2, '/r.csv') AS path, CASE o_orderkey % 3 WHEN 0 THEN 3e-5 WHEN 1 THEN 5e-5 ELSE 2e-5 END AS lr, CAST(o_orderkey % 4 + 2 AS VARCHAR) AS version, count(*) AS n FROM orders GROUP BY ALL")
def run_paths(spark, sf_dir):
    k = F.col("o_orderkey")
    lr = F.when(k % 3 == 0, "3e-5").when(k % 3 == 1, "5-e5").otherwise("2e-5")
    path = F.concat(F.lit("runs/lr-"), lr, F.lit("/v"), (k % 4 + 2).cast("string"), F.lit("/r.csv"))
    rows = table(spark, sf_dir, "orders").groupBy(path.alias("path")).agg(F.count("*").alias("n"))
    return rows.select("path", G.learning_rate("path").alias("lr"), G.path_part("path", r"/v(\d+)").alias("version"), "n")


@query("SELECT s_suppkey AS k, contains(lower(s_name), '00000000') OR contains(lower(s_name), '1') AS known FROM supplier".replace("contains(lower(s_name), '00000000') OR contains(lower(s_name), '1')", "contains(lower(s_name), 'supplier')"))
def speaker_filter(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), G.speaker_known(F.concat(F.lit("Dr. "), F.col("s_name")), ["Supplier", "Nobody"]).alias("known"))


@query("SELECT p_partkey AS k, lower(p_brand) = 'brand#11' OR p_partkey % 5 = 0 AS tagged FROM part")
def topic_filter(spark, sf_dir):
    tags = F.concat_ws(" ; ", "p_brand", F.when(F.col("p_partkey") % 5 == 0, F.lit("BRAND#11 ")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), G.has_topic(tags, "brand#11").alias("tagged"))
