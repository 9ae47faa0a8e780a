"""Queries over time, samples and splits, labels, joins and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions.numbers import pearson
from corpusloom.operators import dedup as D
from corpusloom.operators import joins as J
from corpusloom.operators import sampling as X
from corpusloom.operators import timeseries as TS
from corpusloom.plans.registry import query, table

_LABEL = "CASE o_orderstatus WHEN 'F' THEN 'dovish' WHEN 'O' THEN 'hawkish' WHEN 'P' THEN 'neutral' END"


def stances(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("o_orderstatus") == "F", "dovish").when(F.col("o_orderstatus") == "O", "hawkish").when(F.col("o_orderstatus") == "P", "neutral")
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("d"), label.alias("label"), F.col("o_orderpriority").alias("who"))


def _index_sql(period: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return f"idx AS (SELECT {lead}CAST(date_trunc('{period}', o_orderdate) AS DATE) AS period, count(*) FILTER (o_orderstatus = 'O') AS n_up, count(*) FILTER (o_orderstatus = 'F') AS n_down, count(*) FILTER (o_orderstatus = 'P') AS n_flat, count(*) AS n, (count(*) FILTER (o_orderstatus = 'O') - count(*) FILTER (o_orderstatus = 'F'))::DOUBLE / count(*) AS stance FROM (SELECT *, o_orderpriority AS who FROM orders) GROUP BY ALL)"


@query(f"WITH {_index_sql('quarter')} SELECT CAST(period AS VARCHAR) AS period, n_up, n_down, n_flat, n, round(stance, 9) AS stance FROM idx")
def stance_index_quarter(spark, sf_dir):
    return TS.stance_index(stances(spark, sf_dir), "d", "label", "quarter").withColumns({"period": F.col("period").cast("string"), "stance": F.round("stance", 9)})


@query(f"WITH {_index_sql('year')} SELECT CAST(period AS VARCHAR) AS period, n, round(n_up::DOUBLE / n, 9) AS share_up, round(n_down::DOUBLE / n, 9) AS share_down, round(n_flat::DOUBLE / n, 9) AS share_flat FROM idx")
def stance_composition(spark, sf_dir):
    out = TS.composition(TS.stance_index(stances(spark, sf_dir), "d", "label", "year"))
    return out.select(F.col("period").cast("string").alias("period"), "n", *(F.round(f"share_{k}", 9).alias(f"share_{k}") for k in ("up", "down", "flat")))


_CAL = "cal AS (SELECT who, CAST(unnest(generate_series(min(period), max(period), INTERVAL 3 MONTH)) AS DATE) AS period FROM idx GROUP BY who)"


@query(f"WITH {_index_sql('quarter', 'who')}, {_CAL} SELECT who, CAST(period AS VARCHAR) AS period, coalesce(n, 0) AS n, round(stance, 9) AS stance FROM cal LEFT JOIN idx USING (who, period)")
def annotator_calendar(spark, sf_dir):
    index = TS.stance_index(stances(spark, sf_dir), "d", "label", "quarter", ["who"])
    return TS.calendar(index, "period", "3 months", ["who"]).join(index, ["who", "period"], "left").select("who", F.col("period").cast("string").alias("period"), F.coalesce("n", F.lit(0)).alias("n"), F.round("stance", 9).alias("stance"))


_ROLL = """j AS (SELECT x.who AS a, y.who AS b, x.period, round(x.stance, 12) AS va, round(y.stance, 12) AS vb FROM idx x JOIN idx y ON x.period = y.period AND x.who < y.who),
r AS (SELECT a, b, period, count(va) OVER w AS pairs, CASE WHEN count(va) OVER w >= 4 AND var_pop(va) OVER w > 1e-18 AND var_pop(vb) OVER w > 1e-18 THEN corr(va, vb) OVER w END AS r FROM j WINDOW w AS (PARTITION BY a, b ORDER BY period ROWS BETWEEN 7 PRECEDING AND CURRENT ROW))"""


@query(f"WITH {_index_sql('quarter', 'who')}, {_ROLL} SELECT a, b, CAST(period AS VARCHAR) AS period, pairs, round(r, 6) AS r FROM r WHERE r IS NOT NULL")
def rolling_corr(spark, sf_dir):
    index = TS.stance_index(stances(spark, sf_dir), "d", "label", "quarter", ["who"])
    pairs = TS.pairs(index, "who", ["period"], "stance")
    out = TS.rolling_corr(pairs, "period", "va", "vb", ["a", "b"]).where("r is not null")
    return out.select("a", "b", F.col("period").cast("string").alias("period"), "pairs", F.round("r", 6).alias("r"))


@query(f"WITH {_index_sql('quarter', 'who')}, p AS (SELECT x.who AS a, y.who AS b, corr(x.stance, y.stance) AS r, count(*) AS n FROM idx x JOIN idx y ON x.period = y.period AND x.who < y.who GROUP BY ALL) SELECT a, b, round(r, 6) AS r, n FROM p")
def pearson_pairs(spark, sf_dir):
    index = TS.stance_index(stances(spark, sf_dir), "d", "label", "quarter", ["who"])
    return TS.pairs(index, "who", ["period"], "stance").groupBy("a", "b").agg(F.round(pearson("va", "vb"), 6).alias("r"), F.count("*").alias("n"))


_MACRO = "macro AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS month, avg(l_discount) AS discount, avg(l_quantity) AS quantity FROM lineitem GROUP BY 1)"


def macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date(F.date_trunc("month", "l_shipdate")).alias("month")).agg(F.avg("l_discount").alias("discount"), F.avg("l_quantity").alias("quantity"))


@query(f"""WITH {_MACRO}, g AS (SELECT month, CASE WHEN month(month) % 3 = 1 THEN discount END AS discount FROM macro) SELECT CAST(month AS VARCHAR) AS month, round(last_value(discount IGNORE NULLS) OVER (ORDER BY month), 9) AS discount FROM g""")
def macro_ffill(spark, sf_dir):
    sparse = macro(spark, sf_dir).select("month", F.when(F.month("month") % 3 == 1, F.col("discount")).alias("discount"))
    return TS.fill_forward(sparse, "month", ["discount"], []).select(F.col("month").cast("string").alias("month"), F.round("discount", 9).alias("discount"))


@query(f"""WITH {_index_sql('quarter')}, {_MACRO}, q AS (SELECT CAST(date_trunc('quarter', month) AS DATE) AS period, avg(discount) AS discount, avg(quantity) AS quantity FROM macro GROUP BY 1)
SELECT round(corr(stance, discount), 6) AS with_discount, round(corr(stance, quantity), 6) AS with_quantity, count(*) AS n FROM idx JOIN q USING (period)""")
def index_macro_corr(spark, sf_dir):
    quarters = macro(spark, sf_dir).groupBy(F.to_date(F.date_trunc("quarter", "month")).alias("period")).agg(F.avg("discount").alias("discount"), F.avg("quantity").alias("quantity"))
    both = TS.stance_index(stances(spark, sf_dir), "d", "label", "quarter").join(quarters, "period").dropna()
    return both.agg(F.round(pearson("stance", "discount"), 6).alias("with_discount"), F.round(pearson("stance", "quantity"), 6).alias("with_quantity"), F.count("*").alias("n"))


@query(f"SELECT o_orderpriority AS who, {_LABEL} AS label, count(*) AS n, round(100.0 * count(*) / sum(count(*)) FILTER (grouping(o_orderpriority) + grouping({_LABEL}) = 0) OVER (), 6)::DOUBLE AS pct FROM orders GROUP BY ROLLUP (o_orderpriority, {_LABEL})")
def label_rollup(spark, sf_dir):
    rows = stances(spark, sf_dir).rollup("who", "label").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    total = F.sum(F.when(F.col("g") == 0, F.col("n"))).over(W.partitionBy(F.lit(1)))
    return rows.select("who", "label", "n", F.round(100.0 * F.col("n") / total, 6).alias("pct"))


@query(f"WITH c AS (SELECT {_LABEL} AS label, count(*) AS n FROM orders GROUP BY 1) SELECT label, n, round(n::DOUBLE / sum(n) OVER (), 9) AS share, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_id FROM c")
def label_counts(spark, sf_dir):
    counts = stances(spark, sf_dir).groupBy("label").agg(F.count("*").alias("n"))
    every = W.partitionBy(F.lit(1))
    return counts.select("label", "n", F.round(F.col("n") / F.sum("n").over(every), 9).alias("share"), (F.dense_rank().over(every.orderBy("label")) - 1).alias("label_id"))


@query("""WITH g AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS m, avg(l_tax) AS loss FROM lineitem GROUP BY 1), s AS (SELECT m, row_number() OVER (ORDER BY m) AS x, CASE WHEN row_number() OVER (ORDER BY m) % 4 = 1 THEN loss END AS y FROM g),
w AS (SELECT x, y, last_value(CASE WHEN y IS NOT NULL THEN x END IGNORE NULLS) OVER (ORDER BY x) AS px, last_value(y IGNORE NULLS) OVER (ORDER BY x) AS py, first_value(CASE WHEN y IS NOT NULL THEN x END IGNORE NULLS) OVER (ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nx, first_value(y IGNORE NULLS) OVER (ORDER BY x ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ny FROM s)
SELECT x, round(coalesce(y, py + (ny - py) * (x - px) / (nx - px), py, ny), 9) AS y FROM w""")
def interpolated_series(spark, sf_dir):
    months = table(spark, sf_dir, "lineitem").groupBy(F.date_trunc("month", "l_shipdate").alias("m")).agg(F.avg("l_tax").alias("loss"))
    every = W.partitionBy(F.lit(1)).orderBy("m")
    rows = months.withColumn("x", F.row_number().over(every).cast("long")).withColumn("y", F.when(F.col("x") % 4 == 1, F.col("loss"))).select("x", "y", F.lit(1).alias("k"))
    return TS.interpolate(rows, "x", "y", ["k"]).select("x", F.round("y", 9).alias("y"))


# Samples and splits
@query("SELECT id, CASE WHEN rn <= 1000 THEN 'holdout' ELSE 'rest' END AS part FROM (SELECT o_orderkey AS id, row_number() OVER (ORDER BY md5(concat('42:', o_orderkey)), o_orderkey) AS rn FROM orders)")
def holdout_split(spark, sf_dir):
    picked, rest = X.holdout(stances(spark, sf_dir).select("id"), "id", 1000)
    return picked.withColumn("part", F.lit("holdout")).unionByName(rest.withColumn("part", F.lit("rest")))


@query("SELECT id, who FROM (SELECT o_orderkey AS id, o_orderpriority AS who, row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5(concat('42:', o_orderkey)), o_orderkey) AS rn FROM orders) WHERE rn <= 50")
def per_file_sample(spark, sf_dir):
    return X.per_group(stances(spark, sf_dir), ["who"], "id", 50).select("id", "who")


_EQ = """c AS (SELECT k, count(*) AS available FROM pool GROUP BY k), s AS (SELECT k, available, row_number() OVER (ORDER BY available, k) AS i, sum(available) OVER (ORDER BY available, k) AS cum, count(*) OVER () AS g, least(%d, sum(available) OVER ()) AS target FROM c),
f AS (SELECT *, CASE WHEN cum + (g - i) * available <= target THEN 1 ELSE 0 END AS full_ FROM s), t AS (SELECT *, sum(CASE WHEN full_ = 1 THEN available ELSE 0 END) OVER () AS spent, sum(1 - full_) OVER () AS open_ FROM f),
q AS (SELECT k, available, CAST(CASE WHEN full_ = 1 THEN available ELSE (target - spent) // open_ + CASE WHEN row_number() OVER (PARTITION BY full_ ORDER BY md5(concat('42:', k)), k) <= (target - spent) %% open_ THEN 1 ELSE 0 END END AS BIGINT) AS quota FROM t)"""


@query(f"WITH pool AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 10 < 7 THEN year(o_orderdate) ELSE 1900 + o_orderkey % 3 + CASE WHEN o_orderkey % 100 = 7 THEN 50 ELSE 0 END END AS k FROM orders), {_EQ % 3000} SELECT k, available, quota FROM q")
def equal_share_quotas(spark, sf_dir):
    rows = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    year = F.when(k % 10 < 7, F.year("o_orderdate")).otherwise(1900 + k % 3 + F.when(k % 100 == 7, 50).otherwise(0)).cast("long")
    counts = rows.groupBy(year.alias("k")).agg(F.count("*").alias("available"))
    return X.equal_share_quotas(counts, "k", "available", 3000)


@query(f"WITH pool AS (SELECT o_orderkey AS id, year(o_orderdate) AS k FROM orders), {_EQ % 1000} SELECT id, k FROM (SELECT id, pool.k, quota, row_number() OVER (PARTITION BY pool.k ORDER BY md5(concat('42:', id)), id) AS rn FROM pool JOIN q ON pool.k = q.k) WHERE rn <= quota")
def equal_share_sample(spark, sf_dir):
    rows = stances(spark, sf_dir).select("id", F.year("d").cast("long").alias("k"))
    return X.equal_share(rows, "k", "id", 1000).select("id", "k")


@query("""WITH p AS (SELECT o_orderkey AS id, year(o_orderdate) AS k, o_orderpriority = '1-URGENT' AS hot FROM orders), b AS (SELECT *, row_number() OVER (PARTITION BY k, hot ORDER BY md5(concat('42:', id)), id) AS bn FROM p),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN hot AND bn <= 30 THEN 1 ELSE 0 END DESC, md5(concat('42:', id)), id) AS rn FROM b) SELECT id, k, hot FROM r WHERE rn <= 60""")
def boosted_sample(spark, sf_dir):
    rows = stances(spark, sf_dir).select("id", F.year("d").cast("long").alias("k"), (F.col("who") == "1-URGENT").alias("hot"))
    return X.boosted(rows, "k", "hot", "id", 60, 0.5).select("id", "k", "hot")


@query("""WITH p AS (SELECT o_orderkey AS id, o_orderpriority AS k FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY md5(concat('42:', id)), id) AS rn FROM p), q AS (SELECT CAST(ceil(777.0 / count(DISTINCT k)) AS BIGINT) AS q FROM p)
SELECT id, k FROM r, q ORDER BY CASE WHEN rn > q THEN 1 ELSE 0 END, md5(concat('42:', id)), id LIMIT 777""")
def balanced_quota_sample(spark, sf_dir):
    return X.balanced_quota(stances(spark, sf_dir).select("id", F.col("who").alias("k")), "k", "id", 777).select("id", "k")


@query(f"WITH p AS (SELECT o_orderkey AS id, {_LABEL} AS label FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', id)), id) AS rn, count(*) OVER (PARTITION BY label) AS n FROM p) SELECT id, label, CASE WHEN rn <= greatest(1, round_even(n * 0.15, 0)) THEN 'val' ELSE 'train' END AS split FROM r")
def stratified_split(spark, sf_dir):
    return X.stratified_split(stances(spark, sf_dir).select("id", "label"), "label", "id")


_CUT = "cut AS (SELECT DATE '1970-01-01' + CAST(floor(quantile_cont(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)), 0.8)) AS INTEGER) AS cutoff FROM orders)"


@query(f"WITH {_CUT} SELECT CAST(cutoff AS VARCHAR) AS cutoff FROM cut")
def date_cutoff(spark, sf_dir):
    return X.date_quantile(stances(spark, sf_dir), "d", 0.8).select(F.col("cutoff").cast("string").alias("cutoff"))


@query(f"""WITH {_CUT}, p AS (SELECT o_orderkey AS id, {_LABEL} AS label, CAST(o_orderdate AS DATE) >= cutoff AS late FROM orders, cut), r AS (SELECT *, row_number() OVER (PARTITION BY late, label ORDER BY md5(concat('42:', id)), id) AS rn, count(*) OVER (PARTITION BY late, label) AS n FROM p)
SELECT id, label, CASE WHEN NOT late THEN 'train' WHEN rn <= round_even(n * 0.67, 0) THEN 'test' ELSE 'val' END AS split FROM r""")
def chronological_split(spark, sf_dir):
    rows = stances(spark, sf_dir)
    dated = rows.crossJoin(F.broadcast(X.date_quantile(rows, "d", 0.8)))
    return X.chronological_split(dated, "d", "label", "id", F.col("cutoff")).select("id", "label", "split")


# Labels
_RAW = "raw AS (SELECT l.doc_id, CASE WHEN toxic = 1 THEN ' d ' WHEN quality = 1 AND l.doc_id % 3 = 0 THEN 'MH' WHEN quality = 1 THEN 'h' WHEN l.doc_id % 2 = 0 THEN 'N' ELSE '??' END AS raw, text FROM labels l JOIN documents USING (doc_id))"
_NORM = "norm AS (SELECT doc_id, text, CASE upper(trim(raw)) WHEN 'D' THEN 'dovish' WHEN 'MD' THEN 'dovish' WHEN 'H' THEN 'hawkish' WHEN 'MH' THEN 'hawkish' WHEN 'N' THEN 'neutral' END AS label FROM raw)"


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.when(F.col("toxic") == 1, " d ").when((F.col("quality") == 1) & (F.col("doc_id") % 3 == 0), "MH").when(F.col("quality") == 1, "h").when(F.col("doc_id") % 2 == 0, "N").otherwise("??")
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "text", raw.alias("raw"))


@query(f"WITH {_RAW}, {_NORM} SELECT label, count(*) AS n FROM norm GROUP BY label")
def label_normalise(spark, sf_dir):
    from corpusloom.functions.labels import from_letter

    return annotations(spark, sf_dir).withColumn("label", from_letter("raw")).groupBy("label").agg(F.count("*").alias("n"))


@query(f"""WITH {_RAW}, {_NORM}, c AS (SELECT doc_id, trim(regexp_replace(text, '[ \\t-\\r]+', ' ', 'g')) AS sentence, label FROM norm WHERE label IS NOT NULL AND length(text) >= 15), d AS (SELECT *, row_number() OVER (PARTITION BY sentence, label ORDER BY doc_id) AS rn FROM c),
k AS (SELECT *, min(label) OVER (PARTITION BY sentence) AS a, max(label) OVER (PARTITION BY sentence) AS b FROM d WHERE rn = 1), s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(concat('42:', doc_id)), doc_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM k WHERE a = b)
SELECT doc_id, sentence, label, CASE WHEN r <= greatest(1, round_even(n * 0.15, 0)) THEN 'val' ELSE 'train' END AS split FROM s""")
def label_pipeline(spark, sf_dir):
    from corpusloom.functions.labels import from_letter

    rows = annotations(spark, sf_dir).withColumn("label", from_letter("raw")).where("label is not null and length(text) >= 15")
    rows = rows.select("doc_id", J.text_key("text").alias("sentence"), "label")
    rows = D.drop_conflicts(D.first_wins(rows, ["sentence", "label"], ["doc_id"]), ["sentence"], "label")
    return X.stratified_split(rows, "label", "doc_id")


@query("SELECT conv_id, list(struct_pack(role := role, content := coalesce(text, '')) ORDER BY turn)::VARCHAR AS x, count(*) AS turns FROM conversations GROUP BY conv_id".replace("list(struct_pack(role := role, content := coalesce(text, '')) ORDER BY turn)::VARCHAR AS x", "string_agg(concat(role, ': ', text), chr(10) ORDER BY turn) AS chat"))
def conversational_format(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    chats = turns.groupBy("conv_id").agg(said.alias("said"), F.count("*").alias("turns"))
    return chats.select("conv_id", F.array_join(F.transform("said", lambda s: F.concat(s["role"], F.lit(": "), s["text"])), "\n").alias("chat"), "turns")


# Joins
@query("""WITH c AS (SELECT trim(regexp_replace(text, '[ \\t-\\r]+', ' ', 'g')) AS k, CAST(DATE '2020-01-01' + CAST(doc_id % 5 AS INTEGER) AS VARCHAR) AS d FROM documents), m AS (SELECT k, list_sort(list(DISTINCT d)) AS ds FROM c WHERE k <> '' GROUP BY k),
a AS (SELECT doc_id, trim(regexp_replace(CASE WHEN doc_id % 7 = 0 THEN concat(text, ' x') ELSE text END, '[ \\t-\\r]+', ' ', 'g')) AS k FROM documents)
SELECT doc_id, CAST(coalesce(len(ds), 0) AS INTEGER) AS n_dates, CASE WHEN ds IS NULL THEN 'unmatched' WHEN len(ds) = 1 THEN 'text_exact' ELSE 'ambiguous' END AS outcome, CASE WHEN len(ds) = 1 THEN ds[1] END AS matched, CASE WHEN len(ds) > 1 THEN array_to_string(ds, '; ') END AS candidates FROM a LEFT JOIN m USING (k)""")
def text_match_outcome(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    corpus = docs.select("text", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("doc_id") % 5).cast("int")).alias("d"))
    asked = docs.select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(" x"))).otherwise(F.col("text")).alias("t"))
    return J.match_outcome(asked, "t", corpus, "text", "d").select("doc_id", "n_dates", "outcome", "matched", "candidates")


@query("SELECT o_orderkey AS id, c_mktsegment AS segment, o_custkey AS cust FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def validated_join(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("cust"))
    dims = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("segment"))
    return J.many_to_one(orders, dims, ["cust"], must=F.col("segment").isNotNull())


@query("SELECT n_name AS nation, count(c_custkey) AS customers, count(o_orderkey) AS orders FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY n_name".replace("count(c_custkey) AS customers", "count(DISTINCT c_custkey) AS customers"))
def totals_with_zeros(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("nation"))
    customer = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), "c_custkey")
    orders = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("o"))
    counts = customer.join(orders, "c_custkey", "left").groupBy("k").agg(F.count("*").alias("customers"), F.sum(F.coalesce("o", F.lit(0))).alias("orders"))
    return J.with_zeros(nation, counts, ["k"], ["customers", "orders"]).select("nation", "customers", "orders")


@query("SELECT d.doc_id, d.source FROM documents d WHERE md5(lower(trim(regexp_replace(d.text, '[ \\t-\\r]+', ' ', 'g')))) NOT IN (SELECT md5(lower(trim(regexp_replace(x.text, '[ \\t-\\r]+', ' ', 'g')))) FROM documents x JOIN labels l ON x.doc_id = l.doc_id)")
def annotated_exclusion(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", D.dedup_key("text").alias("k"))
    done = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return J.without(docs, done, ["k"]).select("doc_id", "source")


@query("SELECT a.doc_id AS row_id, b.doc_id IS NOT NULL AS known, coalesce(trim(regexp_replace(a.text, '[ \\t-\\r]+', ' ', 'g')) = trim(regexp_replace(b.text, '[ \\t-\\r]+', ' ', 'g')) AND a.text <> '', false) AS same FROM (SELECT doc_id, text, doc_id + CASE WHEN doc_id % 10 = 0 THEN 1 ELSE 0 END AS ref FROM documents) a LEFT JOIN documents b ON a.ref = b.doc_id")
def id_reconcile(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    asked = docs.select(F.col("doc_id").alias("row_id"), J.text_key("text").alias("x"), (F.col("doc_id") + F.when(F.col("doc_id") % 10 == 0, 1).otherwise(0)).alias("ref"))
    known = docs.select(F.col("doc_id").alias("ref"), J.text_key("text").alias("y"), F.lit(True).alias("hit"))
    same = (F.col("x") == F.col("y")) & (F.col("x") != "")
    return asked.join(known, "ref", "left").select("row_id", F.coalesce("hit", F.lit(False)).alias("known"), F.coalesce(same, F.lit(False)).alias("same"))


# Logs: events as an append-only log in which later or better records win.
@query("""WITH e AS (SELECT event_id, user_id, event_type, CASE event_type WHEN 'purchase' THEN 3 WHEN 'click' THEN 2 ELSE 1 END AS rk FROM events), b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rk DESC, event_id DESC) AS rn FROM e) SELECT user_id, event_id, event_type FROM b WHERE rn = 1""")
def log_dedupe(spark, sf_dir):
    rank = F.when(F.col("event_type") == "purchase", 3).when(F.col("event_type") == "click", 2).otherwise(1)
    return D.best_record(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type"), ["user_id"], rank, "event_id").select("user_id", "event_id", "event_type")


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_antijoin(spark, sf_dir):
    done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return J.without(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), done, ["id"])


@query("SELECT count(*) AS items, count(*) FILTER (b.o_orderkey IS NULL) AS beyond, count(*) FILTER (b.o_orderkey IS NOT NULL AND a.cust <> b.o_custkey) AS misaligned FROM (SELECT o_orderkey + CASE WHEN o_orderkey % 50 = 0 THEN 1 ELSE 0 END AS idx, o_custkey AS cust FROM orders) a LEFT JOIN orders b ON a.idx = b.o_orderkey")
def alignment_check(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    log = orders.select((F.col("o_orderkey") + F.when(F.col("o_orderkey") % 50 == 0, 1).otherwise(0)).alias("idx"), F.col("o_custkey").alias("cust"))
    both = log.join(orders.select(F.col("o_orderkey").alias("idx"), F.col("o_custkey").alias("now"), F.lit(1).alias("hit")), "idx", "left")
    return both.agg(F.count("*").alias("items"), F.count_if(F.col("hit").isNull()).alias("beyond"), F.count_if(F.col("hit").isNotNull() & (F.col("cust") != F.col("now"))).alias("misaligned"))


_ITEM = "concat(doc_id, ':', md5(text))"


@query(f"SELECT source, count(*) AS items, sha256(CAST(sum(CAST(CAST(concat('0x', left(md5({_ITEM}), 15)) AS UBIGINT) AS HUGEINT)) AS VARCHAR)) AS fingerprint FROM documents GROUP BY source")
def run_manifest(spark, sf_dir):
    """A fingerprint of each source that no order changes: the hash of the sum of its items' hashes, summed before the shuffle."""
    item = F.md5(F.concat_ws(":", "doc_id", F.md5(F.col("text").cast("binary"))).cast("binary"))
    docs = table(spark, sf_dir, "documents").select("source", F.conv(F.substring(item, 1, 15), 16, 10).cast("decimal(28,0)").alias("h"))
    return docs.groupBy("source").agg(F.count("*").alias("items"), F.sha2(F.sum("h").cast("decimal(38,0)").cast("string"), 256).alias("fingerprint"))
