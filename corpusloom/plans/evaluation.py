"""Queries over prediction tables, derived from orders on both sides alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import evaluate as E
from corpusloom.operators import stats as S
from corpusloom.plans.registry import query, table

MODELS = ["m1", "m2", "m3", "m4"]
OPEN_MODELS = ["m1", "m3"]
PROMPTS = ["p1", "p2", "p3", "p4", "p5"]

_GOLD = "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"
_SITE = "CASE WHEN o_orderkey % 2 = 0 THEN 'north' ELSE 'south' END"


def _pred_sql(model: str, run: str) -> str:
    return f"(y_true + CASE WHEN (row_idx * 7 + {model} * 13 + {run} * 29) % 10 < 6 + {model} % 2 THEN 0 ELSE 1 + (row_idx + {run}) % 2 END) % 3"


#: Encoder predictions: 2 trained sides x 4 models x 3 runs over every order.
ENC = f"""base AS (SELECT o_orderkey AS row_idx, {_GOLD} AS y_true, {_SITE} AS eval_site, o_orderpriority AS category FROM orders),
enc AS (SELECT train_site, concat('m', CAST(mno AS VARCHAR)) AS model, run, eval_site, row_idx, category, y_true,
  {_pred_sql('mno', '(run + 10 * tno)')} AS y_pred
  FROM base, (VALUES ('north', 0), ('south', 1)) t(train_site, tno), (VALUES (1), (2), (3), (4)) m(mno), (VALUES (1), (2), (3)) r(run))"""

#: Generative predictions: 4 models x 5 prompts; every 97th row failed, every 53rd was not parsed.
LLM = f"""base AS (SELECT o_orderkey AS row_idx, {_GOLD} AS y_true, {_SITE} AS site, o_orderpriority AS category FROM orders),
llm AS (SELECT concat('m', CAST(mno AS VARCHAR)) AS model, concat('p', CAST(run AS VARCHAR)) AS prompt, site, row_idx, category, y_true,
  CASE WHEN row_idx % 53 = 0 OR row_idx % 97 = 0 THEN NULL ELSE {_pred_sql('mno', 'run')} END AS y_pred,
  CASE WHEN row_idx % 97 = 0 THEN 'timeout' END AS error, 100 + row_idx % 50 AS in_tok, 5 + row_idx % 3 AS out_tok
  FROM base, (VALUES (1), (2), (3), (4)) m(mno), (VALUES (1), (2), (3), (4), (5)) r(run))"""

#: Accuracy, macro and weighted F1 of each cell of `src`.
def scores_sql(src: str, by: str) -> str:
    return f"""cls AS (SELECT * FROM (VALUES (0), (1), (2)) c(k)),
cc AS (SELECT {by}, k, count(*) FILTER (y_true = k AND y_pred = k) AS tp, count(*) FILTER (y_true <> k AND y_pred = k) AS fp,
  count(*) FILTER (y_true = k AND y_pred <> k) AS fn, count(*) AS n FROM {src}, cls WHERE y_pred IS NOT NULL GROUP BY {by}, k),
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS r FROM cc),
ff AS (SELECT *, CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1 FROM pr),
sc AS (SELECT {by}, max(n) AS n, sum(tp)::DOUBLE / max(n) AS accuracy, avg(f1) AS macro_f1, sum(f1 * (tp + fn)) / max(n) AS weighted_f1 FROM ff GROUP BY {by})"""


def _base(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1).otherwise(2)
    site = F.when(F.col("o_orderkey") % 2 == 0, "north").otherwise("south")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_idx"), gold.alias("y_true"), site.alias("site"), F.col("o_orderpriority").alias("category"))


def _pred(model: Column, run: Column) -> Column:
    right = (F.col("row_idx") * 7 + model * 13 + run * 29) % 10 < 6 + model % 2
    return ((F.col("y_true") + F.when(right, 0).otherwise(1 + (F.col("row_idx") + run) % 2)) % 3).cast("int")


def _grid(df: DataFrame, **axes: list) -> DataFrame:
    """Every row for every combination: the axes are literals, exploded in place, so nothing is joined or shuffled."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*(F.lit(v) for v in values))))
    return df


def encoder(spark: SparkSession, sf_dir: str, by_item: bool = False) -> DataFrame:
    """by_item: items are dealt out before they are exploded, so that what groups by item needs no shuffle of all predictions."""
    base = _base(spark, sf_dir)
    df = _grid(base.repartition("row_idx") if by_item else base, tno=[0, 1], mno=[1, 2, 3, 4], run=[1, 2, 3])
    return df.select(F.when(F.col("tno") == 0, "north").otherwise("south").alias("train_site"), F.format_string("m%d", "mno").alias("model"), "run", F.col("site").alias("eval_site"), "row_idx", "category", "y_true", _pred(F.col("mno"), F.col("run") + 10 * F.col("tno")).alias("y_pred"))


def generative(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _grid(_base(spark, sf_dir), mno=[1, 2, 3, 4], run=[1, 2, 3, 4, 5])
    bad = (F.col("row_idx") % 53 == 0) | (F.col("row_idx") % 97 == 0)
    return df.select(F.format_string("m%d", "mno").alias("model"), F.format_string("p%d", "run").alias("prompt"), "site", "row_idx", "category", "y_true", F.when(~bad, _pred(F.col("mno"), F.col("run"))).alias("y_pred"), F.when(F.col("row_idx") % 97 == 0, "timeout").alias("error"), (100 + F.col("row_idx") % 50).alias("in_tok"), (5 + F.col("row_idx") % 3).alias("out_tok"))


def _round(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), places) for n in names})


CELL = ["train_site", "model", "eval_site"]
RUN = [*CELL, "run"]
_CELL, _RUN = ", ".join(CELL), ", ".join(RUN)


@query(f"WITH {ENC}, {scores_sql('enc', _RUN)} SELECT {_RUN}, n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1 FROM sc")
def run_scores(spark, sf_dir):
    return _round(E.run_scores(encoder(spark, sf_dir), RUN), "accuracy", "macro_f1", "weighted_f1")


@query(f"WITH {ENC}, {scores_sql('enc', _RUN)} SELECT {_CELL}, count(*) AS runs, round(avg(accuracy), 6) AS accuracy_mean, round(coalesce(stddev_samp(accuracy), 0), 6) AS accuracy_sd, round(avg(macro_f1), 6) AS macro_f1_mean, round(coalesce(stddev_samp(macro_f1), 0), 6) AS macro_f1_sd FROM sc GROUP BY {_CELL}")
def score_spread(spark, sf_dir):
    return _round(E.spread(E.run_scores(encoder(spark, sf_dir), RUN), CELL, ["accuracy", "macro_f1"]), "accuracy_mean", "accuracy_sd", "macro_f1_mean", "macro_f1_sd")


@query(f"""WITH {ENC}, {scores_sql('enc', _RUN)} SELECT train_site, model, k AS class, round(avg(p), 6) AS precision_mean, round(stddev_samp(p), 6) AS precision_sd, round(avg(r), 6) AS recall_mean,
round(stddev_samp(r), 6) AS recall_sd, round(avg(f1), 6) AS f1_mean, round(stddev_samp(f1), 6) AS f1_sd, count(*) AS runs FROM ff GROUP BY train_site, model, k""")
def per_class_prf(spark, sf_dir):
    out = E.spread(E.class_scores(encoder(spark, sf_dir), RUN), ["train_site", "model", "class"], ["precision", "recall", "f1"])
    return _round(out, *(f"{m}_{s}" for m in ("precision", "recall", "f1") for s in ("mean", "sd")))


_CONF = f"""grid AS (SELECT * FROM (SELECT DISTINCT {_CELL} FROM enc), (VALUES (0), (1), (2)) t(y_true), (VALUES (0), (1), (2)) p(y_pred)),
cnt AS (SELECT {_CELL}, y_true, y_pred, count(*) AS c FROM enc GROUP BY ALL), cm AS (SELECT grid.*, coalesce(c, 0) AS n FROM grid LEFT JOIN cnt USING ({_CELL}, y_true, y_pred))"""


@query(f"WITH {ENC}, {_CONF} SELECT {_CELL}, y_true, y_pred, n, round(CASE WHEN sum(n) OVER w = 0 THEN 0 ELSE 100.0 * n / sum(n) OVER w END, 6) AS row_pct FROM cm WINDOW w AS (PARTITION BY {_CELL}, y_true)")
def confusion_long(spark, sf_dir):
    return _round(E.confusion(encoder(spark, sf_dir), CELL), "row_pct")


@query(f"WITH {ENC}, {_CONF} SELECT {_CELL}, y_true, sum(n) FILTER (y_pred = 0)::BIGINT AS pred_0, sum(n) FILTER (y_pred = 1)::BIGINT AS pred_1, sum(n) FILTER (y_pred = 2)::BIGINT AS pred_2 FROM cm GROUP BY {_CELL}, y_true")
def confusion_matrix(spark, sf_dir):
    return E.confusion_wide(encoder(spark, sf_dir), CELL)


@query(f"""WITH {ENC}, {scores_sql('enc', _RUN)}, ms AS (SELECT {_CELL}, avg(accuracy) AS m, stddev_samp(accuracy) AS s FROM sc GROUP BY {_CELL})
SELECT model, max(CASE WHEN train_site = 'north' AND eval_site = 'north' THEN printf('%.4f ± %.4f', m, s) END) AS north_north, max(CASE WHEN train_site = 'north' AND eval_site = 'south' THEN printf('%.4f ± %.4f', m, s) END) AS north_south,
max(CASE WHEN train_site = 'south' AND eval_site = 'north' THEN printf('%.4f ± %.4f', m, s) END) AS south_north, max(CASE WHEN train_site = 'south' AND eval_site = 'south' THEN printf('%.4f ± %.4f', m, s) END) AS south_south FROM ms GROUP BY model""")
def cross_eval_matrix(spark, sf_dir):
    cells = E.spread(E.run_scores(encoder(spark, sf_dir), RUN), CELL, ["accuracy"])
    cells = cells.withColumn("pair", F.concat_ws("_", "train_site", "eval_site")).withColumn("cell", F.format_string("%.4f ± %.4f", "accuracy_mean", "accuracy_sd"))
    return cells.groupBy("model").pivot("pair", ["north_north", "north_south", "south_north", "south_south"]).agg(F.first("cell"))


@query(f"""WITH {ENC}, {scores_sql('enc', _RUN)}, d AS (SELECT train_site, model, run, max(accuracy) FILTER (eval_site = train_site) - max(accuracy) FILTER (eval_site <> train_site) AS gap FROM sc GROUP BY train_site, model, run)
SELECT train_site, model, round(avg(gap), 6) AS gap_mean, round(stddev_samp(gap), 6) AS gap_sd, count(*) AS runs FROM d GROUP BY train_site, model""")
def accuracy_gap(spark, sf_dir):
    inside = F.col("eval_site") == F.col("train_site")
    gap = E.run_scores(encoder(spark, sf_dir), RUN).groupBy("train_site", "model", "run").agg((F.max(F.when(inside, F.col("accuracy"))) - F.max(F.when(~inside, F.col("accuracy")))).alias("gap"))
    return _round(E.spread(gap, ["train_site", "model"], ["gap"]), "gap_mean", "gap_sd")


_VOTES = f"""WITH {ENC}, per AS (SELECT row_idx, model, count(*) FILTER (y_pred = 0) AS v0, count(*) FILTER (y_pred = 1) AS v1, count(*) FILTER (y_pred = 2) AS v2, any_value(y_true) AS y_true FROM enc GROUP BY row_idx, model),
vt AS (SELECT row_idx, any_value(y_true) AS y_true, sum(v0)::BIGINT AS votes_0, sum(v1)::BIGINT AS votes_1, sum(v2)::BIGINT AS votes_2,
string_agg(concat(model, '=', concat_ws(',', CASE WHEN v0 > 0 THEN concat('0:', v0) END, CASE WHEN v1 > 0 THEN concat('1:', v1) END, CASE WHEN v2 > 0 THEN concat('2:', v2) END)), '; ' ORDER BY model) AS by_voter FROM per GROUP BY row_idx),
vote AS (SELECT *, CASE WHEN votes_0 = greatest(votes_0, votes_1, votes_2) THEN 0 WHEN votes_1 = greatest(votes_0, votes_1, votes_2) THEN 1 ELSE 2 END AS majority,
round(greatest(votes_0, votes_1, votes_2)::DOUBLE / (votes_0 + votes_1 + votes_2), 3) AS share,
(CASE WHEN votes_0 = greatest(votes_0, votes_1, votes_2) THEN 1 ELSE 0 END + CASE WHEN votes_1 = greatest(votes_0, votes_1, votes_2) THEN 1 ELSE 0 END + CASE WHEN votes_2 = greatest(votes_0, votes_1, votes_2) THEN 1 ELSE 0 END) > 1 AS tie FROM vt)"""


@query(_VOTES + " SELECT row_idx, y_true, votes_0, votes_1, votes_2, by_voter, majority, share, tie FROM vote")
def vote_table(spark, sf_dir):
    return E.vote_table(encoder(spark, sf_dir, by_item=True), ["row_idx"])


@query(f"""WITH {ENC}, c AS (SELECT train_site, model, row_idx, y_true, count(*) FILTER (y_pred = 0) AS v0, count(*) FILTER (y_pred = 1) AS v1, count(*) FILTER (y_pred = 2) AS v2 FROM enc GROUP BY ALL),
v AS (SELECT *, CASE WHEN v0 >= v1 AND v0 >= v2 THEN 0 WHEN v1 >= v2 THEN 1 ELSE 2 END AS majority FROM c) SELECT train_site, model, y_true, majority, row_idx, round(greatest(v0, v1, v2) / 3.0, 3)::DOUBLE AS share FROM v WHERE y_true <> majority""")
def error_cells(spark, sf_dir):
    votes = E.majorities(encoder(spark, sf_dir, by_item=True), ["train_site", "model", "row_idx"])
    return votes.where("y_true <> majority").select("train_site", "model", "y_true", "majority", "row_idx", "share")


@query(f"WITH {LLM}, c AS (SELECT row_idx, y_pred, count(*) AS n FROM llm WHERE y_pred IS NOT NULL GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY row_idx ORDER BY n DESC, y_pred) AS k FROM c) SELECT row_idx, y_pred AS majority, n AS votes FROM b WHERE k = 1")
def majority_label(spark, sf_dir):
    counts = E.scored(generative(spark, sf_dir)).groupBy("row_idx", "y_pred").count()
    best = F.max_by(F.struct("y_pred", "count"), F.struct("count", -F.col("y_pred")))
    return counts.groupBy("row_idx").agg(best.alias("b")).select("row_idx", F.col("b.y_pred").alias("majority"), F.col("b.count").alias("votes"))


@query(f"WITH {LLM} SELECT model, prompt, category, count(*) AS total, count(*) FILTER (y_true <> y_pred) AS misses, round(count(*) FILTER (y_true <> y_pred)::DOUBLE / count(*), 6) AS rate FROM llm WHERE y_pred IS NOT NULL GROUP BY ALL")
def miss_rates_by_category(spark, sf_dir):
    return _round(E.miss_rates(generative(spark, sf_dir), ["model", "prompt", "category"]), "rate")


@query(f"WITH {LLM} SELECT model, category, prompt, count(*) AS total, count(*) FILTER (y_true <> y_pred) AS misses, CAST(CASE WHEN grouping(model) = 1 THEN 0 WHEN grouping(category) = 1 THEN 1 WHEN grouping(prompt) = 1 THEN 2 ELSE 3 END AS INTEGER) AS level FROM llm WHERE y_pred IS NOT NULL GROUP BY ROLLUP (model, category, prompt)")
def grouping_sets_misses(spark, sf_dir):
    return E.miss_rollup(generative(spark, sf_dir), ["model", "category", "prompt"])


@query(f"""WITH {LLM}, x AS (SELECT CASE WHEN category IN ('1-URGENT', '2-HIGH') THEN 'hot' ELSE 'cool' END AS canon, site, count(*) AS total, count(*) FILTER (y_true <> y_pred) AS misses FROM llm WHERE y_pred IS NOT NULL GROUP BY ALL)
SELECT canon, a.misses::DOUBLE / a.total AS north_rate, b.misses::DOUBLE / b.total AS south_rate, round(b.misses::DOUBLE / b.total - a.misses::DOUBLE / a.total, 9) AS delta FROM (SELECT * FROM x WHERE site = 'north') a FULL JOIN (SELECT * FROM x WHERE site = 'south') b USING (canon)""")
def canonical_compare(spark, sf_dir):
    canon = F.when(F.col("category").isin("1-URGENT", "2-HIGH"), "hot").otherwise("cool")
    rates = E.miss_rates(generative(spark, sf_dir).withColumn("canon", canon), ["canon", "site"])
    one, two = (rates.where(F.col("site") == s).select("canon", F.col("rate").alias(f"{s}_rate")) for s in ("north", "south"))
    return one.join(two, "canon", "full").withColumn("delta", F.round(F.col("south_rate") - F.col("north_rate"), 9))


@query(f"""WITH {LLM}, o AS (SELECT CASE WHEN model IN ('m1', 'm3') THEN 'open' ELSE 'closed' END AS openness, site, avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END) AS acc, count(*) AS n FROM llm WHERE y_pred IS NOT NULL GROUP BY ALL)
SELECT openness, round(max(acc) FILTER (site = 'north'), 6) AS north, round(max(acc) FILTER (site = 'south'), 6) AS south, round(max(acc) FILTER (site = 'north') - max(acc) FILTER (site = 'south'), 6) AS drop_, max(n) FILTER (site = 'north') AS n_north, max(n) FILTER (site = 'south') AS n_south FROM o GROUP BY openness""")
def group_drop(spark, sf_dir):
    rows = E.scored(generative(spark, sf_dir)).withColumn("openness", F.when(F.col("model").isin(*OPEN_MODELS), "open").otherwise("closed"))
    acc = rows.groupBy("openness", "site").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("acc"), F.count("*").alias("n"))
    wide = acc.groupBy("openness").pivot("site", ["north", "south"]).agg(F.max("acc").alias("acc"), F.max("n").alias("n"))
    return wide.select("openness", F.round("north_acc", 6).alias("north"), F.round("south_acc", 6).alias("south"), F.round(F.col("north_acc") - F.col("south_acc"), 6).alias("drop_"), F.col("north_n").alias("n_north"), F.col("south_n").alias("n_south"))


# Decomposition: score = dataset mean + relative skill, and within a model a prompt lift.
_DEC = f"""{LLM}, {scores_sql('llm', 'site, model, prompt')}, dec AS (SELECT site, model, prompt, macro_f1, n, macro_f1 - avg(macro_f1) OVER (PARTITION BY site, model) AS lift, macro_f1 - avg(macro_f1) OVER (PARTITION BY site) AS skill, macro_f1 - median(macro_f1) OVER (PARTITION BY site) AS median_skill FROM sc)"""


def _decomposed(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = E.run_scores(generative(spark, sf_dir), ["site", "model", "prompt"])
    scores = E.demean(scores, "macro_f1", ["site", "model"], "lift")
    scores = E.demean(scores, "macro_f1", ["site"], "skill")
    return E.demean(scores, "macro_f1", ["site"], "median_skill", median=True)


@query(f"WITH {_DEC} SELECT site, model, prompt, round(macro_f1, 6) AS macro_f1, round(lift, 6) AS lift, round(skill, 6) AS skill, round(median_skill, 6) AS median_skill FROM dec")
def prompt_lift(spark, sf_dir):
    return _round(_decomposed(spark, sf_dir).select("site", "model", "prompt", "macro_f1", "lift", "skill", "median_skill"), "macro_f1", "lift", "skill", "median_skill")


@query(f"WITH {_DEC}, t AS (SELECT model, avg(skill) FILTER (site = 'north') AS north, avg(skill) FILTER (site = 'south') AS south FROM dec GROUP BY model) SELECT model, round(north, 6) AS north, round(south, 6) AS south, round(south - north, 6) AS south_minus_north FROM t")
def relative_skill(spark, sf_dir):
    wide = E.pivot_mean(_decomposed(spark, sf_dir), ["model"], "site", ["north", "south"], "skill").withColumn("south_minus_north", F.col("south") - F.col("north"))
    return _round(wide, "north", "south", "south_minus_north").orderBy(F.desc("south_minus_north"), "model")


@query(f"WITH {_DEC} SELECT site, model, prompt, round(lift, 6) AS lift FROM dec WHERE lift < -0.01")
def tank_screen(spark, sf_dir):
    return _round(_decomposed(spark, sf_dir).where("lift < -0.01").select("site", "model", "prompt", "lift"), "lift")


@query(f"WITH {_DEC} SELECT model, round(sum(macro_f1 * n) / sum(n), 6) AS weighted_f1, round(avg(macro_f1), 6) AS plain_f1 FROM dec GROUP BY model")
def weighted_bank(spark, sf_dir):
    rows = _decomposed(spark, sf_dir)
    return _round(E.weighted_mean(rows, ["model"], "macro_f1", "n", "weighted_f1").join(rows.groupBy("model").agg(F.avg("macro_f1").alias("plain_f1")), "model"), "weighted_f1", "plain_f1")


@query(f"WITH {_DEC}, b AS (SELECT *, row_number() OVER (PARTITION BY site, model ORDER BY macro_f1 DESC, prompt) AS k FROM dec) SELECT site, model, prompt, round(macro_f1, 6) AS macro_f1 FROM b WHERE k = 1")
def best_prompt(spark, sf_dir):
    best = _decomposed(spark, sf_dir).groupBy("site", "model").agg(F.min_by(F.struct("prompt", "macro_f1"), F.struct(-F.col("macro_f1"), "prompt")).alias("b"))
    return _round(best.select("site", "model", "b.prompt", "b.macro_f1"), "macro_f1")


@query(f"WITH {_DEC} SELECT model, round(median(macro_f1) FILTER (prompt = 'p1'), 6) AS p1, round(median(macro_f1) FILTER (prompt = 'p2'), 6) AS p2, round(median(macro_f1) FILTER (prompt = 'p3'), 6) AS p3, round(median(macro_f1) FILTER (prompt = 'p4'), 6) AS p4, round(median(macro_f1) FILTER (prompt = 'p5'), 6) AS p5 FROM dec GROUP BY model")
def pivot_medians(spark, sf_dir):
    return _round(E.pivot_mean(_decomposed(spark, sf_dir), ["model"], "prompt", PROMPTS, "macro_f1", median=True), *PROMPTS)


@query(f"WITH {_DEC} SELECT site, round(abs(sum(skill)), 6) AS skill_sum, round(abs(sum(lift)), 6) AS lift_sum, count(*) AS cells FROM dec GROUP BY site")
def zero_sum_check(spark, sf_dir):
    return _decomposed(spark, sf_dir).groupBy("site").agg(F.round(F.abs(F.sum("skill")), 6).alias("skill_sum"), F.round(F.abs(F.sum("lift")), 6).alias("lift_sum"), F.count("*").alias("cells"))


@query(f"WITH {LLM}, {scores_sql('llm', 'site, model, prompt')} SELECT site, model, count(*) AS runs, round(avg(macro_f1), 6) AS macro_f1_mean, round(stddev_pop(macro_f1), 6) AS macro_f1_sd FROM sc GROUP BY site, model")
def prompt_spread(spark, sf_dir):
    return _round(E.spread(E.run_scores(generative(spark, sf_dir), ["site", "model", "prompt"]), ["site", "model"], ["macro_f1"], population=True), "macro_f1_mean", "macro_f1_sd")


# Sweeps: the three runs stand for three conditions of a model on a site.
_SWEEP = f"{ENC}, {scores_sql('enc', 'eval_site, model, run, train_site')}, sw AS (SELECT eval_site, model, concat('lr', CAST(run AS VARCHAR)) AS lr, avg(macro_f1) AS score, coalesce(stddev_samp(macro_f1), 0) AS sd FROM sc GROUP BY ALL)"


def _sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = E.run_scores(encoder(spark, sf_dir), ["eval_site", "model", "run", "train_site"]).withColumn("lr", F.format_string("lr%d", "run"))
    return E.spread(scores, ["eval_site", "model", "lr"], ["macro_f1"]).select("eval_site", "model", "lr", F.round("macro_f1_mean", 9).alias("score"), F.round("macro_f1_sd", 9).alias("sd"))


@query(f"""WITH {_SWEEP}, s9 AS (SELECT eval_site, model, lr, round(score, 9) AS score, round(sd, 9) AS sd FROM sw), rk AS (SELECT eval_site, model, lr AS best, score AS best_score, sd AS best_sd, lead(lr) OVER w AS second, lead(score) OVER w AS second_score, lead(sd) OVER w AS second_sd, row_number() OVER w AS rn FROM s9 WINDOW w AS (PARTITION BY eval_site, model ORDER BY score DESC, lr)),
x AS (SELECT *, best_score - second_score AS margin, sqrt((best_sd * best_sd + second_sd * second_sd) / 2) AS pooled_sd FROM rk WHERE rn = 1)
SELECT eval_site, model, best, round(best_score, 6) AS best_score, round(best_sd, 6) AS best_sd, second, round(second_score, 6) AS second_score, round(second_sd, 6) AS second_sd, round(margin, 6) AS margin, round(pooled_sd, 6) AS pooled_sd, round(CASE WHEN pooled_sd > 0 THEN margin / pooled_sd END, 4) AS margin_in_sd, coalesce(margin > pooled_sd, false) AS separable FROM x""")
def lr_select_runner_up(spark, sf_dir):
    out = E.best_with_runner_up(_sweep(spark, sf_dir), ["eval_site", "model"], "lr", "score", "sd")
    return _round(_round(out, "best_score", "best_sd", "second_score", "second_sd", "margin", "pooled_sd"), "margin_in_sd", places=4)


@query(f"""WITH {_SWEEP}, s9 AS (SELECT eval_site, model, lr, round(score, 9) AS score FROM sw), r AS (SELECT *, rank() OVER (PARTITION BY model, eval_site ORDER BY -score) + (count(*) OVER (PARTITION BY model, eval_site, -score) - 1) / 2.0 AS rk FROM s9)
SELECT model, lr, round(avg(score), 6) AS mean, round(min(score), 6) AS minimum, CAST(-sum(rk) AS DOUBLE) AS rank_score FROM r GROUP BY model, lr HAVING count(DISTINCT eval_site) = 2""")
def shared_lr(spark, sf_dir):
    return _round(E.shared_option(_sweep(spark, sf_dir), "model", "lr", "eval_site", "score"), "mean", "minimum")


@query(f"WITH {_SWEEP} SELECT lr, count(DISTINCT model) AS models, count(DISTINCT eval_site) AS sites, count(*) AS cells, count(*) > count(DISTINCT concat(model, '|', eval_site)) AS duplicated FROM sw GROUP BY lr")
def lr_integrity(spark, sf_dir):
    cells = _sweep(spark, sf_dir).groupBy("lr").agg(F.count_distinct("model").alias("models"), F.count_distinct("eval_site").alias("sites"), F.count("*").alias("cells"), F.count_distinct(F.concat_ws("|", "model", "eval_site")).alias("u"))
    return cells.withColumn("duplicated", F.col("cells") > F.col("u")).drop("u")


@query(f"""WITH {ENC}, {scores_sql('enc', _RUN)}, a AS (SELECT model, run, eval_site, accuracy FROM sc WHERE train_site = 'north'), b AS (SELECT model, run, eval_site, accuracy FROM sc WHERE train_site = 'south')
SELECT model, run, eval_site, round(b.accuracy - a.accuracy, 6) AS delta, CASE WHEN b.accuracy - a.accuracy IS NULL THEN 'missing' WHEN b.accuracy - a.accuracy = 0 THEN 'identical' WHEN abs(b.accuracy - a.accuracy) < 1e-9 THEN 'equal' ELSE 'differs' END AS verdict FROM a FULL JOIN b USING (model, run, eval_site)""")
def run_identity(spark, sf_dir):
    scores = E.run_scores(encoder(spark, sf_dir), RUN).select(*RUN, "accuracy")
    one, two = (scores.where(F.col("train_site") == s).select("model", "run", "eval_site", F.col("accuracy").alias(s)) for s in ("north", "south"))
    delta = F.col("south") - F.col("north")
    return one.join(two, ["model", "run", "eval_site"], "full").select("model", "run", "eval_site", F.round(delta, 6).alias("delta"), E.classify_difference(delta).alias("verdict"))


@query(f"""WITH {ENC}, {scores_sql('enc', _RUN)}, m AS (SELECT model, eval_site, train_site, avg(accuracy) AS a, stddev_samp(accuracy) AS s FROM sc GROUP BY ALL), w AS (SELECT model, eval_site, max(a) FILTER (train_site = 'north') AS a1, max(a) FILTER (train_site = 'south') AS a2, max(s) FILTER (train_site = 'north') AS s1, max(s) FILTER (train_site = 'south') AS s2 FROM m GROUP BY ALL)
SELECT model, eval_site, round(a2 - a1, 6) AS delta, round(sqrt((s1 * s1 + s2 * s2) / 2), 6) AS pooled_sd, abs(a2 - a1) > sqrt((s1 * s1 + s2 * s2) / 2) AS beyond_noise, rank() OVER (PARTITION BY eval_site ORDER BY round(a1, 9) DESC)::INTEGER AS rank_1, rank() OVER (PARTITION BY eval_site ORDER BY round(a2, 9) DESC)::INTEGER AS rank_2 FROM w""")
def split_compare(spark, sf_dir):
    from pyspark.sql import Window as W

    cells = E.spread(E.run_scores(encoder(spark, sf_dir), RUN), CELL, ["accuracy"])
    wide = cells.groupBy("model", "eval_site").pivot("train_site", ["north", "south"]).agg(F.first("accuracy_mean").alias("a"), F.first("accuracy_sd").alias("s"))
    delta, pooled = F.col("south_a") - F.col("north_a"), F.sqrt((F.col("north_s") ** 2 + F.col("south_s") ** 2) / 2)
    rank = lambda c: F.rank().over(W.partitionBy("eval_site").orderBy(F.desc(F.round(c, 9))))
    return wide.select("model", "eval_site", F.round(delta, 6).alias("delta"), F.round(pooled, 6).alias("pooled_sd"), (F.abs(delta) > pooled).alias("beyond_noise"), rank("north_a").alias("rank_1"), rank("south_a").alias("rank_2"))


def _paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = E.run_scores(encoder(spark, sf_dir), RUN)
    return scores.groupBy("model", "eval_site", "run").agg(F.max(F.when(F.col("train_site") == "north", F.col("accuracy"))).alias("a"), F.max(F.when(F.col("train_site") == "south", F.col("accuracy"))).alias("b"))


_PAIRED = f"{ENC}, {scores_sql('enc', _RUN)}, pa AS (SELECT model, eval_site, run, max(accuracy) FILTER (train_site = 'north') AS a, max(accuracy) FILTER (train_site = 'south') AS b FROM sc GROUP BY ALL)"


@query(f"WITH {_PAIRED} SELECT model, eval_site, count(*) AS n, round(avg(b - a), 6) AS mean_diff, round(stddev_samp(b - a), 6) AS sd_diff, round(CASE WHEN stddev_samp(b - a) > 0 THEN avg(b - a) / (stddev_samp(b - a) / sqrt(count(*))) END, 4) AS t FROM pa GROUP BY model, eval_site")
def paired_t(spark, sf_dir):
    return _round(_round(S.paired_t(_paired(spark, sf_dir), ["model", "eval_site"], "a", "b"), "mean_diff", "sd_diff"), "t", places=4)


@query()
def paired_t_p(spark, sf_dir):
    out = S.paired_t(_paired(spark, sf_dir), ["model", "eval_site"], "a", "b")
    half = S.t_critical((F.col("n") - 1).cast("double")) * F.col("sd_diff") / F.sqrt("n")
    return out.withColumn("p", S.t_p_value("t", (F.col("n") - 1).cast("double"))).withColumn("ci_lo", F.col("mean_diff") - half).withColumn("ci_hi", F.col("mean_diff") + half)


@query(f"""WITH {_PAIRED}, q AS (SELECT eval_site, round(a, 9) AS a, round(b, 9) AS b FROM pa), rk AS (SELECT eval_site, rank() OVER (PARTITION BY eval_site ORDER BY a) + (count(*) OVER (PARTITION BY eval_site, a) - 1) / 2.0 AS ra, rank() OVER (PARTITION BY eval_site ORDER BY b) + (count(*) OVER (PARTITION BY eval_site, b) - 1) / 2.0 AS rb FROM q)
SELECT eval_site, count(*) AS n, round(corr(ra, rb), 6) AS rho FROM rk GROUP BY eval_site""")
def spearman(spark, sf_dir):
    rows = _paired(spark, sf_dir).withColumns({c: F.round(c, 9) for c in "ab"})
    return _round(S.spearman(rows, ["eval_site"], "a", "b"), "rho")


@query(f"""WITH {LLM}, {scores_sql('llm', 'site, model, prompt')}, q AS (SELECT site, CASE WHEN model IN ('m1', 'm3') THEN 'open' ELSE 'closed' END AS g, round(macro_f1, 9) AS v FROM sc), rk AS (SELECT *, rank() OVER (PARTITION BY site ORDER BY v) + (count(*) OVER (PARTITION BY site, v) - 1) / 2.0 AS r FROM q)
SELECT site, count(*) FILTER (g = 'open') AS n1, count(*) FILTER (g <> 'open') AS n2, CAST(sum(r) FILTER (g = 'open') AS DOUBLE) AS rank_sum, CAST(sum(r) FILTER (g = 'open') - count(*) FILTER (g = 'open') * (count(*) FILTER (g = 'open') + 1) / 2.0 AS DOUBLE) AS u FROM rk GROUP BY site""")
def mann_whitney(spark, sf_dir):
    rows = E.run_scores(generative(spark, sf_dir), ["site", "model", "prompt"])
    rows = rows.withColumn("g", F.when(F.col("model").isin(*OPEN_MODELS), "open").otherwise("closed")).withColumn("v", F.round("macro_f1", 9))
    return S.mann_whitney(rows, ["site"], "g", "open", "v")


_LOGIT = f"{LLM}, z AS (SELECT CASE WHEN model IN ('m1', 'm3') THEN 1 ELSE 0 END AS op, CASE WHEN site = 'south' THEN 1 ELSE 0 END AS so, CASE WHEN y_true = y_pred THEN 1 ELSE 0 END AS ok, row_idx FROM llm WHERE y_pred IS NOT NULL)"


def _correct(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = E.scored(generative(spark, sf_dir))
    return rows.select(F.col("model").isin(*OPEN_MODELS).cast("int").alias("op"), (F.col("site") == "south").cast("int").alias("so"), (F.col("y_true") == F.col("y_pred")).cast("int").alias("ok"), "row_idx", "site")


@query(f"""WITH {_LOGIT}, c AS (SELECT op, so, count(*) AS n, sum(ok)::DOUBLE AS s FROM z GROUP BY ALL), l AS (SELECT op, so, ln(s / (n - s)) AS lo, 1 / s + 1 / (n - s) AS v FROM c)
SELECT round(max(lo) FILTER (op = 0 AND so = 0), 6) AS intercept, round(max(lo) FILTER (op = 1 AND so = 0) - max(lo) FILTER (op = 0 AND so = 0), 6) AS b_a, round(max(lo) FILTER (op = 0 AND so = 1) - max(lo) FILTER (op = 0 AND so = 0), 6) AS b_b,
round(max(lo) FILTER (op = 1 AND so = 1) - max(lo) FILTER (op = 1 AND so = 0) - max(lo) FILTER (op = 0 AND so = 1) + max(lo) FILTER (op = 0 AND so = 0), 6) AS interaction, round(sqrt(sum(v)), 6) AS se FROM l""")
def logit_interaction(spark, sf_dir):
    return _round(S.logit_interaction(_correct(spark, sf_dir), "ok", "op", "so"), "intercept", "b_a", "b_b", "interaction", "se")


@query(f"""WITH {_LOGIT}, m AS (SELECT op, so, avg(ok) AS p, count(*) AS m FROM z GROUP BY ALL), r AS (SELECT row_idx AS g, sum((CASE WHEN z.op = z.so THEN 1 ELSE -1 END) * (ok - p) / (m * p * (1 - p))) AS s FROM z JOIN m USING (op, so) GROUP BY row_idx),
v AS (SELECT sqrt(sum(s * s) * count(*) / (count(*) - 1)) AS se, count(*) AS c FROM r), e AS (SELECT sum((CASE WHEN op = so THEN 1 ELSE -1 END) * ln(p / (1 - p))) AS i FROM m)
SELECT round(i, 6) AS interaction, round(se, 6) AS cluster_se, round(i / se, 4) AS z, c AS clusters FROM e, v""")
def clustered_logit(spark, sf_dir):
    return _round(_round(S.clustered_interaction(_correct(spark, sf_dir), "ok", "op", "so", "row_idx"), "interaction", "cluster_se"), "z", places=4)


@query()
def bootstrap_ci(spark, sf_dir):
    per = _correct(spark, sf_dir).groupBy("site", "row_idx", "op").agg(F.avg("ok").alias("x"))
    return S.bootstrap_means(per, ["site", "op"], "x", "row_idx", rounds=100)


# Logs of generative runs.
@query(f"""WITH {LLM} SELECT model, prompt, count(*) AS n, count(*) FILTER (y_pred IS NOT NULL) AS parsed, count(*) FILTER (error IS NOT NULL) AS errors, count(*) FILTER (y_pred IS NULL AND error IS NULL) AS unparsed, round(avg(CASE WHEN y_pred IS NOT NULL AND error IS NULL THEN CASE WHEN y_pred = y_true THEN 1.0 ELSE 0.0 END END), 6) AS accuracy,
sum(in_tok)::BIGINT AS in_tok, sum(out_tok)::BIGINT AS out_tok, round(sum(in_tok) * 0.15 / 1e6 + sum(out_tok) * 0.6 / 1e6, 6) AS cost_usd FROM llm GROUP BY model, prompt""")
def run_summary(spark, sf_dir):
    rows, bad = generative(spark, sf_dir), F.col("error").isNotNull()
    got = F.col("y_pred").isNotNull()
    ok = F.when(got & ~bad, (F.col("y_pred") == F.col("y_true")).cast("double"))
    out = rows.groupBy("model", "prompt").agg(F.count("*").alias("n"), F.count_if(got).alias("parsed"), F.count_if(bad).alias("errors"), F.count_if(~got & ~bad).alias("unparsed"), F.round(F.avg(ok), 6).alias("accuracy"), F.sum("in_tok").alias("in_tok"), F.sum("out_tok").alias("out_tok"))
    return out.withColumn("cost_usd", F.round(F.col("in_tok") * 0.15 / 1e6 + F.col("out_tok") * 0.6 / 1e6, 6))


@query(f"""WITH {LLM}, pres AS (SELECT * FROM llm WHERE NOT (model = 'm4' AND prompt = 'p5') AND row_idx % 11 <> 3), want AS (SELECT count(*) AS want FROM base)
SELECT m AS model, p AS prompt, want, count(row_idx) AS have, want - count(row_idx) AS missing, count(error) AS errors FROM (SELECT unnest(['m1', 'm2', 'm3', 'm4']) AS m), (SELECT unnest(['p1', 'p2', 'p3', 'p4', 'p5']) AS p), want LEFT JOIN pres ON pres.model = m AND pres.prompt = p GROUP BY m, p, want""")
def grid_audit(spark, sf_dir):
    there = generative(spark, sf_dir).where("not (model = 'm4' and prompt = 'p5') and row_idx % 11 <> 3").groupBy("model", "prompt").agg(F.count("*").alias("have"), F.count("error").alias("errors"))
    want = _base(spark, sf_dir).agg(F.count("*").alias("want"))
    grid = _grid(want, model=MODELS, prompt=PROMPTS)
    have = F.coalesce("have", F.lit(0))
    return grid.join(F.broadcast(there), ["model", "prompt"], "left").select("model", "prompt", "want", have.alias("have"), (F.col("want") - have).alias("missing"), F.coalesce("errors", F.lit(0)).alias("errors"))


@query(f"""WITH {LLM} SELECT row_idx, any_value(y_true) AS y_true, {', '.join(f"max(CASE WHEN model = '{m}' AND prompt = '{p}' THEN y_pred END)::DOUBLE AS {m}__{p}" for m in MODELS for p in PROMPTS)} FROM llm GROUP BY row_idx""")
def wide_predictions(spark, sf_dir):
    rows = generative(spark, sf_dir).withColumn("combo", F.concat_ws("__", "model", "prompt"))
    return rows.groupBy("row_idx", "y_true").pivot("combo", [f"{m}__{p}" for m in MODELS for p in PROMPTS]).agg(F.max(F.col("y_pred").cast("double")))


@query(f"WITH {LLM} SELECT model, prompt, count(*) AS n, sum(y_pred)::BIGINT AS total FROM llm WHERE y_pred IS NOT NULL GROUP BY model, prompt")
def unpivot_predictions(spark, sf_dir):
    wide = wide_predictions(spark, sf_dir)
    combos = [c for c in wide.columns if "__" in c]
    long = wide.unpivot(["row_idx"], combos, "combo", "y_pred").where("y_pred is not null")
    name = F.split("combo", "__")
    return long.groupBy(name[0].alias("model"), name[1].alias("prompt")).agg(F.count("*").alias("n"), F.sum(F.col("y_pred").cast("long")).alias("total"))
