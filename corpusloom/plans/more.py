"""Queries on sets of ids, dated series, movements, titles, speakers and abbreviations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import merge as M
from corpusloom.plans.registry import query, table


@query("SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels WHERE doc_id IS NOT NULL")
def shared_ids(spark, sf_dir):
    return M.shared_keys(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT count(*) AS n, count(*) FILTER (o IS NULL) AS missing, count(*) FILTER (o IS NULL) = 0 AS subset FROM (SELECT DISTINCT c_custkey FROM customer) LEFT JOIN (SELECT DISTINCT o_custkey AS o FROM orders) ON c_custkey = o")
def customers_all_order(spark, sf_dir):
    return M.is_subset(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("""WITH r AS (SELECT CAST(o_orderdate AS DATE) AS day, 'order' AS kind, o_orderkey AS key FROM orders UNION ALL SELECT CAST(l_shipdate AS DATE), 'shipment', l_orderkey * 10 + l_linenumber FROM lineitem)
SELECT strftime(day, '%Y-%m-%d') AS day, kind, key, row_number() OVER (PARTITION BY day ORDER BY kind, key)::INTEGER AS pos FROM r WHERE day IS NOT NULL""")
def chronological_merge(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d"), F.col("o_orderkey").cast("long").alias("k"))
    shipped = table(spark, sf_dir, "lineitem").select(F.col("l_shipdate").cast("date").alias("d"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("long").alias("k"))
    return M.chronological({"order": orders, "shipment": shipped}, "d", "k").withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("""WITH m AS (SELECT o_custkey AS cust, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n FROM orders GROUP BY ALL), d AS (SELECT cust, month, abs(n - lag(n) OVER (PARTITION BY cust ORDER BY month)) AS d FROM m), r AS (SELECT *, row_number() OVER (PARTITION BY cust ORDER BY d DESC, month) AS k FROM d WHERE d IS NOT NULL)
SELECT cust, count(*) AS steps, round(avg(d), 9) AS mean_abs, min(month) FILTER (k = 1) AS at_largest, max(d) AS largest FROM r GROUP BY cust""")
def largest_movements(spark, sf_dir):
    months = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("cust"), F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"))
    return M.movements(months, ["cust"], "month", "n").withColumn("mean_abs", F.round("mean_abs", 9))


@query("SELECT doc_id, CASE WHEN length(t) <= 120 AND regexp_matches(t, '(^|[^\\p{L}])(of|the|de|la|der|die)([^\\p{L}]|$)') THEN 2.0 ELSE 1.0 END::DOUBLE AS boost FROM (SELECT doc_id, split_part(text, chr(10), 1) AS t FROM documents)")
def title_boosts(spark, sf_dir):
    boost = M.title_boost(F.col("text"), r"(?<!\p{L})(of|the|de|la|der|die)(?!\p{L})", 2.0)
    return table(spark, sf_dir, "documents").select("doc_id", boost.alias("boost"))


@query("SELECT conv_id, turn, length(text) AS n FROM conversations WHERE lower(role) = 'assistant'")
def one_speaker(spark, sf_dir):
    return M.only_speakers(table(spark, sf_dir, "conversations"), "role", ["Assistant"]).select("conv_id", "turn", F.length("text").cast("long").alias("n"))


@query("SELECT doc_id, count(*) AS lines, count(*) FILTER (length(regexp_replace(line, '[^\\p{L}]', '', 'g')) >= 4 AND NOT regexp_matches(line, '\\p{Ll}')) AS capitals FROM (SELECT doc_id, unnest(string_split(upper_some, chr(10))) AS line FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE text END AS upper_some FROM documents)) GROUP BY doc_id")
def all_caps_lines(spark, sf_dir):
    text = F.when(F.col("doc_id") % 3 == 0, F.translate("text", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")).otherwise(F.col("text"))
    lines = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split(text, "\n")).alias("line"))
    return lines.groupBy("doc_id").agg(F.count("*").alias("lines"), F.count_if(M.all_caps(F.col("line"))).alias("capitals"))


_HELD = "|".join(a.replace(".", "\\.") for a in sorted(M.ABBREVIATIONS, key=lambda a: (-len(a), a)))


@query(f"""WITH t AS (SELECT doc_id, concat('Dr. Roe of the U.S. met J. Doe. ', text) AS text FROM documents), k AS (SELECT doc_id, regexp_replace(text, '(^|[^\\p{{L}}\\p{{N}}])({_HELD}|\\p{{Lu}})\\.', '\\1\\2\u2024', 'g') AS text FROM t)
SELECT doc_id, len(string_split(regexp_replace(text, '([.!?])[ \\t-\\r]+', '\\1\u241f', 'g'), '\u241f'))::INTEGER AS n, md5(replace(regexp_replace(text, '([.!?])[ \\t-\\r]+', '\\1\u241f', 'g'), '\u2024', '.')) AS h FROM k""")
def abbreviation_split(spark, sf_dir):
    parts = M.split_with_abbreviations(F.concat(F.lit("Dr. Roe of the U.S. met J. Doe. "), F.col("text")))
    rows = table(spark, sf_dir, "documents").select("doc_id", parts.alias("s"))
    return rows.select("doc_id", F.size("s").alias("n"), F.md5(F.array_join("s", "\u241f").cast("binary")).alias("h"))
