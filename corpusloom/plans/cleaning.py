"""Queries over zones of documents and the document cleaner."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import cleaning as C
from corpusloom.operators import lines as L
from corpusloom.plans.corpus import _LINES, _TEXT, _hashed, docs
from corpusloom.plans.registry import query, table


@query()
def clean_report(spark, sf_dir):
    return C.clean_documents(docs(spark, sf_dir), "doc_id", "text").select(F.col("doc").alias("doc_id"), "chars_in", "chars_out", "pct_kept", "paras_kept", F.to_json("para_drops").alias("para_drops"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"""WITH {_LINES}, e AS (SELECT *, CASE WHEN length(line) >= 160 THEN 0 WHEN length(line) < 40 THEN 1 END AS ev FROM ln), f AS (SELECT *, ev = 1 AND coalesce(last_value(ev IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0, true) AS first_ FROM e),
z AS (SELECT *, last_value(CASE WHEN ev = 0 THEN 0 WHEN first_ THEN pos END IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS z0 FROM f), g AS (SELECT doc, pos, first_, coalesce(z0 > 0 AND pos - z0 <= 3, false) AS ins, line FROM z),
k AS (SELECT doc, pos, CASE WHEN ins THEN '' ELSE line END AS line FROM g WHERE NOT ins OR first_) {_TEXT.format('k')}""")
def zone_drop(spark, sf_dir):
    lines = L.explode_lines(docs(spark, sf_dir), "doc_id", "text")
    return _hashed(C.drop_zone(lines, F.length("line") < 40, F.length("line") >= 160, most=3))


@query(f"""WITH {_LINES}, t AS (SELECT *, coalesce(min(pos) FILTER (length(line) > 100) OVER (PARTITION BY doc), 0) AS t0 FROM ln), d AS (SELECT *, coalesce(min(pos) FILTER (pos > t0 AND length(line) > 80) OVER (PARTITION BY doc), t0) AS d0 FROM t),
x AS (SELECT *, min(pos) FILTER (pos > d0 AND regexp_matches(line, '(?i)^licensed')) OVER (PARTITION BY doc) AS x0 FROM d) {_TEXT.format("(SELECT * FROM x WHERE pos > d0 AND (x0 IS NULL OR pos < x0) AND line <> '')")}""")
def body_isolation(spark, sf_dir):
    lines = L.explode_lines(docs(spark, sf_dir), "doc_id", "text")
    n = F.length("line")
    return _hashed(C.isolate_body(lines, n > 100, n > 80, F.col("line").rlike("(?i)^licensed"), F.col("line") == ""))


_DESC = "CASE WHEN s_suppkey % 3 = 0 THEN concat('Bank of ', n_name, ', Mr. ', s_name) WHEN s_suppkey % 3 = 1 THEN concat('Press release of ', n_name) ELSE concat('Board of ', r_name, ', Dr. X, ', n_name) END"


@query(f"WITH d AS (SELECT s_suppkey AS k, {_DESC} AS d FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), s AS (SELECT k, coalesce(nullif(regexp_extract(d, '^(.*?),\\s*(?:Mr\\.|Ms\\.|Mrs\\.|Dr\\.|Prof\\.)', 1), ''), d) AS segment FROM d) SELECT k, segment, regexp_matches(segment, '(?i)(?:\\bbank\\b|france)') AS banks, regexp_matches(segment, '(?i)(?:europe|france|germany)') AS europe FROM s")
def speech_routing(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    desc = F.when(k % 3 == 0, F.concat(F.lit("Bank of "), "n_name", F.lit(", Mr. "), "s_name")).when(k % 3 == 1, F.concat(F.lit("Press release of "), "n_name")).otherwise(F.concat(F.lit("Board of "), "r_name", F.lit(", Dr. X, "), "n_name"))
    out = C.route(rows.select(k.alias("k"), C.institution_segment(desc).alias("segment")), F.col("segment"), {"banks": [r"\bbank\b", "france"], "europe": ["europe", "france", "germany"]})
    return out.select("k", "segment", "banks", "europe")


@query("SELECT l.doc_id, md5(concat('Below is a sentence. Classify it.', chr(10), '### Input:', chr(10), text, chr(10), '### Response:', chr(10), CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END)) AS prompt_md5 FROM labels l JOIN documents USING (doc_id)")
def instruction_format(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").join(docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    said = F.concat(F.lit("Below is a sentence. Classify it.\n### Input:\n"), "text", F.lit("\n### Response:\n"), F.when(F.col("quality") == 1, "good").otherwise("bad"))
    return rows.select("doc_id", F.md5(said.cast("binary")).alias("prompt_md5"))


@query("WITH m AS (SELECT * FROM (VALUES ('low', 'src0'), ('low', 'src1'), ('mid', 'src5'), ('mid', 'src1')) t(alias, source)) SELECT alias, count(*) AS docs, count(DISTINCT source) AS sources FROM m JOIN documents USING (source) GROUP BY alias")
def source_aliases(spark, sf_dir):
    pairs = F.array(*(F.struct(F.lit(a).alias("alias"), F.lit(s).alias("source")) for a, s in (("low", "src0"), ("low", "src1"), ("mid", "src5"), ("mid", "src1"))))
    names = spark.range(1).select(F.inline(pairs))
    return docs(spark, sf_dir).join(F.broadcast(names), "source").groupBy("alias").agg(F.count("*").alias("docs"), F.count_distinct("source").alias("sources"))
