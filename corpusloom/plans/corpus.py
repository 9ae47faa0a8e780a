"""Queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.functions import lexicons as LX
from corpusloom.functions import predicates as P
from corpusloom.functions import text as TX
from corpusloom.functions.labels import from_free_text, parse_reply
from corpusloom.operators import dedup as D
from corpusloom.operators import folds, lines as L, sentences as S
from corpusloom.plans.registry import query, table
from corpusloom.sources import pages as PG

_WS = "'[ \\t-\\r]+'"
_COL = f"trim(regexp_replace(text, {_WS}, ' ', 'g'))"
_SHARE = "length(regexp_replace(text, '[^\\p{L}]', '', 'g'))::DOUBLE / greatest(length(text), 1)"

# Stand-ins for the panels: the corpora here have no vocabulary of the field.
TOPICS, DIRECTIONS, NEGATIONS, CUTS = ["this", "from", "of the"], ["is", "was", "by"], ["for"], ["and", "that"]


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


@query(f"""WITH k AS (SELECT doc_id, source, text, md5(lower({_COL})) AS k FROM documents), f AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS rn FROM k),
g AS (SELECT source, length(text) AS chars, length(text) >= 200 AND {_SHARE} >= 0.6 AS good, rn = 1 AS first_ FROM f)
SELECT source, count(*) AS docs, count(*) FILTER (good) AS passed, count(*) FILTER (good AND first_) AS kept, coalesce(sum(chars) FILTER (good AND first_), 0)::BIGINT AS kept_chars FROM g GROUP BY source""")
def corpus_exact_dedup(spark, sf_dir):
    rows = docs(spark, sf_dir).select("doc_id", "source", F.length("text").alias("chars"), TX.quality_ok("text").alias("good"), D.dedup_key("text").alias("k"))
    # copies are counted by source before keys meet, so a key has as many rows as sources
    by = rows.groupBy("k", "source").agg(F.count("*").alias("n"), F.count_if("good").alias("passed"), F.min(F.struct("doc_id", "good", "chars")).alias("first"))
    kept = (F.col("first.doc_id") == F.min("first.doc_id").over(W.partitionBy("k"))) & F.coalesce(F.col("first.good"), F.lit(False))
    out = by.select("source", "n", "passed", "first", kept.alias("kept")).groupBy("source")
    return out.agg(F.sum("n").alias("docs"), F.sum("passed").alias("passed"), F.count_if("kept").alias("kept"), F.coalesce(F.sum(F.when(F.col("kept"), F.col("first.chars"))), F.lit(0)).cast("long").alias("kept_chars"))


@query(f"SELECT doc_id, length(text) AS n_chars, len(list_filter(string_split_regex(text, {_WS}), lambda x: x <> ''))::INTEGER AS n_words, length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^0-9]', '', 'g')) AS n_digits, len(string_split(text, chr(10)))::INTEGER AS n_lines, round({_SHARE}, 9) AS letter_share FROM documents")
def doc_text_stats(spark, sf_dir):
    strip = lambda keep: F.length(F.regexp_replace("text", f"[^{keep}]", "")).cast("long")
    return docs(spark, sf_dir).select("doc_id", F.length("text").cast("long").alias("n_chars"), F.size(TX.words("text")).alias("n_words"), strip(r"\p{L}").alias("n_letters"), strip("0-9").alias("n_digits"), F.size(F.split("text", "\n")).alias("n_lines"), F.round(TX.letter_share("text"), 9).alias("letter_share"))


@query(f"SELECT lang, count(*) AS n, count(*) FILTER ({_SHARE} >= 0.6) AS share_ok, count(*) FILTER (length(text) >= 200) AS long_ok, count(*) FILTER (length(text) >= 200 AND {_SHARE} >= 0.6) AS both_ok FROM documents GROUP BY lang")
def alpha_ratio_gate(spark, sf_dir):
    good, long = TX.letter_share("text") >= 0.6, F.length("text") >= 200
    return docs(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("n"), F.count_if(good).alias("share_ok"), F.count_if(long).alias("long_ok"), F.count_if(TX.quality_ok("text")).alias("both_ok"))


@query(f"WITH k AS (SELECT doc_id, md5(lower({_COL})) AS k FROM documents) SELECT doc_id, count(*) OVER (PARTITION BY k) > 1 AS duplicated FROM k")
def duplicate_flags(spark, sf_dir):
    return D.flag_duplicates(docs(spark, sf_dir).select("doc_id", D.dedup_key("text").alias("k")), ["k"]).select("doc_id", "duplicated")


@query()
def near_dup_minhash(spark, sf_dir):
    return D.near_duplicate_classes(docs(spark, sf_dir), "doc_id", "text")


# Lines
_LINES = "ln AS (SELECT doc_id AS doc, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS pos, trim(unnest(string_split(text, chr(10)))) AS line FROM documents)"
_END = """regexp_matches(rtrim(line), '[.!?]["''”’)\\]]*$')"""
_TEXT = "SELECT doc AS doc_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS text_md5, count(*) AS n_lines FROM {} GROUP BY doc"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.explode_lines(docs(spark, sf_dir), "doc_id", "text")


def _hashed(rows: DataFrame) -> DataFrame:
    text = rows.groupBy("doc").agg(F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("x"))
    joined = F.array_join(F.transform("x", lambda s: s["line"]), "\n")
    return text.select(F.col("doc").alias("doc_id"), F.md5(joined.cast("binary")).alias("text_md5"), "n_lines")


@query(f"WITH {_LINES} SELECT doc AS doc_id, line, count(*) AS freq FROM ln WHERE line <> '' GROUP BY doc, line HAVING count(*) > 1")
def line_frequency(spark, sf_dir):
    return _lines(spark, sf_dir).where("line <> ''").groupBy(F.col("doc").alias("doc_id"), "line").agg(F.count("*").alias("freq")).where("freq > 1")


@query(f"WITH {_LINES}, f AS (SELECT *, count(*) OVER (PARTITION BY doc, line) AS freq FROM ln), k AS (SELECT * FROM f WHERE NOT (line <> '' AND freq >= 3 AND length(line) <= 90 AND NOT {_END})) {_TEXT.format('k')}")
def repeated_line_drop(spark, sf_dir):
    return _hashed(L.drop_repeated(_lines(spark, sf_dir)))


@query(f"""WITH {_LINES}, o AS (SELECT *, (regexp_matches(line, '^(Note|Source|Licensed)') OR (regexp_matches(line, '^[A-Z][a-z]+\\.') AND (coalesce(lag(line) OVER w, '') = '' OR coalesce(regexp_matches(rtrim(last_value(nullif(line, '') IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), '[.!?]["''”’)\\]]*$'), true)))) AND line <> '' AS op,
sum(CASE WHEN line = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS blk FROM ln WINDOW w AS (PARTITION BY doc ORDER BY pos)), i AS (SELECT *, bool_or(op) OVER (PARTITION BY doc, blk ORDER BY pos ROWS UNBOUNDED PRECEDING) AND line <> '' AS ins FROM o)
{_TEXT.format('(SELECT * FROM i WHERE NOT ins)')}""")
def note_block_skip(spark, sf_dir):
    return _hashed(L.skip_blocks(_lines(spark, sf_dir), F.col("line").rlike("^(Note|Source|Licensed)"), guarded=F.col("line").rlike(r"^[A-Z][a-z]+\.")))


@query(f"WITH {_LINES}, m AS (SELECT *, min(pos) FILTER (regexp_matches(line, '(?i)^licensed under')) OVER (PARTITION BY doc) AS stop FROM ln) {_TEXT.format('(SELECT * FROM m WHERE stop IS NULL OR pos < stop)')}")
def stop_at_marker(spark, sf_dir):
    return _hashed(L.stop_at(_lines(spark, sf_dir), F.col("line").rlike("(?i)^licensed under")))


@query(f"""WITH {_LINES}, h AS (SELECT *, length(line) < 60 AND line <> '' AS hit FROM ln), r AS (SELECT *, sum(CASE WHEN NOT hit AND line <> '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM h),
k AS (SELECT *, count(*) FILTER (hit) OVER w AS n, min(pos) FILTER (hit) OVER w AS lo, max(pos) FILTER (hit) OVER w AS hi FROM r WINDOW w AS (PARTITION BY doc, run)), g AS (SELECT doc, pos, CASE WHEN n >= 3 AND pos BETWEEN lo AND hi THEN '' ELSE line END AS line, coalesce(n >= 3 AND pos BETWEEN lo AND hi, false) AS gone, lo FROM k)
{_TEXT.format('(SELECT * FROM g WHERE NOT gone OR pos = lo)')}""")
def run_drop(spark, sf_dir):
    return _hashed(L.drop_runs(_lines(spark, sf_dir), F.length("line") < 60, 3))


@query(f"""WITH {_LINES}, h AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY doc) AS n FROM ln), c AS (SELECT *, coalesce(min(i) FILTER (regexp_matches(line, '(?i)^licensed') AND i >= floor(n * 0.7)) OVER (PARTITION BY doc), n) AS cut FROM h),
a AS (SELECT *, coalesce(min(i) FILTER (length(line) < 30 AND i >= floor(n * 0.55) AND i < cut) OVER (PARTITION BY doc), cut) AS fin FROM c) {_TEXT.format('(SELECT * FROM a WHERE i < fin)')}""")
def tail_cut(spark, sf_dir):
    return _hashed(L.strip_tail(_lines(spark, sf_dir), F.col("line").rlike("(?i)^licensed"), F.length("line") < 30))


@query(f"WITH {_LINES}, f AS (SELECT *, least(coalesce(min(pos) FILTER (NOT length(line) < 40 AND line <> '') OVER (PARTITION BY doc), 61), 61) AS f0 FROM ln) {_TEXT.format('(SELECT * FROM f WHERE pos >= f0)')}")
def head_strip(spark, sf_dir):
    return _hashed(L.strip_head(_lines(spark, sf_dir), F.length("line") < 40))


@query(f"""WITH {_LINES}, k AS (SELECT *, CASE WHEN line = '' THEN 0 WHEN length(line) < 40 THEN 1 WHEN length(line) < 160 THEN 2 ELSE 3 END AS kind FROM ln), b AS (SELECT *, sum(CASE WHEN kind IN (1, 3) THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS blk FROM k),
c AS (SELECT *, bool_or(kind = 1) OVER w AS head, count(*) FILTER (kind = 2) OVER w AS m FROM b WINDOW w AS (PARTITION BY doc, blk)) {_TEXT.format('(SELECT * FROM c WHERE NOT (head AND m >= 2 AND kind <> 0))')}""")
def roster_drop(spark, sf_dir):
    return _hashed(L.drop_after_heading(_lines(spark, sf_dir), F.length("line") < 40, F.length("line") < 160, 2))


@query(f"""WITH {_LINES}, n AS (SELECT *, lag(line) OVER (PARTITION BY doc ORDER BY pos) AS p FROM ln WHERE line <> ''), s AS (SELECT *, sum(CASE WHEN p IS NOT NULL AND (regexp_matches(line, '^[,.;:)\\]’”a-z]') OR regexp_matches(p, '(?i)\\b(the|a|an|of|to|in|and|or|for|with|by|on|at|from|that)$') OR regexp_matches(p, '[,\\-–—]$')) THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY pos ROWS UNBOUNDED PRECEDING) AS isl FROM n)
SELECT doc AS doc_id, min(pos) AS pos, md5(regexp_replace(string_agg(line, ' ' ORDER BY pos), ' ([,.;:)\\]])', '\\1', 'g')) AS line_md5 FROM s GROUP BY doc, isl""")
def mend_lines(spark, sf_dir):
    return L.mend(_lines(spark, sf_dir)).select(F.col("doc").alias("doc_id"), F.col("pos").cast("long").alias("pos"), F.md5(F.col("line").cast("binary")).alias("line_md5"))


@query(f"WITH {_LINES} SELECT count(*) FILTER (regexp_matches(line, '^[\\s0-9.,%()+\\-/$€£:]+$')) AS numeric_only, count(*) FILTER (length(regexp_replace(line, '[^\\p{{L}}]', '', 'g')) < 3) AS few_letters, count(*) FILTER (len(list_filter(string_split_regex(line, {_WS}), lambda x: x <> '')) <= 8 AND NOT {_END}) AS headings, count(*) AS n FROM ln WHERE line <> ''")
def line_shapes(spark, sf_dir):
    rows = _lines(spark, sf_dir).where("line <> ''")
    return rows.agg(F.count_if(F.col("line").rlike(r"^[\s0-9.,%()+\-/$€£:]+\z")).alias("numeric_only"), F.count_if(F.length(F.regexp_replace("line", r"[^\p{L}]", "")) < 3).alias("few_letters"), F.count_if(P.is_heading("line")).alias("headings"), F.count("*").alias("n"))


@query()
def paragraph_reasons(spark, sf_dir):
    rows = _lines(spark, sf_dir).where("line <> ''").withColumn("reason", P.paragraph_reason("line"))
    per = rows.groupBy("doc", "reason").agg(F.count("*").alias("n"))
    drops = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("reason").isNotNull(), F.struct("reason", "n")))))
    return per.groupBy(F.col("doc").alias("doc_id")).agg(F.sum("n").alias("paras"), F.sum(F.when(F.col("reason").isNull(), F.col("n")).otherwise(0)).alias("kept"), F.to_json(drops).alias("drops"))


# Sentences
_SENT = "sn AS (SELECT doc_id, lang, unnest(range(0, len(p))) AS sent_pos, trim(unnest(p)) AS sentence FROM (SELECT doc_id, lang, string_split(regexp_replace(text, '([.!?])[ \\t-\\r]+', '\\1␟', 'g'), '␟') AS p FROM documents)), st AS (SELECT * FROM sn WHERE sentence <> '')"


def _sentences(spark: SparkSession, sf_dir: str, **more) -> DataFrame:
    return S.split_sentences(docs(spark, sf_dir).select("doc_id", "lang", "text"), at=r"(?<=[.!?])[ \t-\r]+", **more)


@query(f"WITH {_SENT} SELECT doc_id, sent_pos::INTEGER AS sent_pos, md5(sentence) AS h FROM st")
def sentence_split(spark, sf_dir):
    return _sentences(spark, sf_dir).select("doc_id", "sent_pos", F.md5(F.col("sentence").cast("binary")).alias("h"))


@query("""WITH l AS (SELECT doc_id, unnest(range(0, len(string_split(text, chr(10))))) AS line_pos, unnest(string_split(text, chr(10))) AS line FROM documents), s AS (SELECT doc_id, line_pos, unnest(string_split(regexp_replace(line, '([.!?])[ \\t-\\r]+', '\\1␟', 'g'), '␟')) AS s FROM l)
SELECT doc_id, count(*) AS n, count(DISTINCT line_pos) AS lines, sum(length(trim(s)))::BIGINT AS chars FROM s WHERE trim(s) <> '' GROUP BY doc_id""")
def newline_sentences(spark, sf_dir):
    rows = _sentences(spark, sf_dir, by_line=True)
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("line_pos").alias("lines"), F.sum(F.length("sentence")).alias("chars"))


_A = "(^|[^A-Za-z])({})([^A-Za-z]|$)"
_TOPIC = f"regexp_matches(sentence, '(?i){_A.format('of[ \\t-\\r]+the|this|from')}')"


@query(f"WITH {_SENT} SELECT doc_id, sent_pos::INTEGER AS sent_pos, length(sentence) AS n FROM st WHERE {_TOPIC}")
def target_sentence_filter(spark, sf_dir):
    return _sentences(spark, sf_dir).where(LX.hits("sentence", TOPICS)).select("doc_id", "sent_pos", F.length("sentence").cast("long").alias("n"))


_B = r"(^|[^\p{{L}}\p{{N}}_])({})(e?s)?([^\p{{L}}\p{{N}}_]|$)"


@query(f"WITH {_SENT} SELECT lang, count(*) AS n, count(*) FILTER (regexp_matches(sentence, '(?i){_B.format('of[ \\t-\\r]+the|this|from')}')) AS topic, count(*) FILTER (regexp_matches(sentence, '(?i){_B.format('of[ \\t-\\r]+the|this|from')}') AND regexp_matches(sentence, '(?i){_B.format('is|was|by')}')) AS signal FROM st GROUP BY lang")
def signal_filter(spark, sf_dir):
    rows = _sentences(spark, sf_dir)
    return rows.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(LX.hits("sentence", TOPICS, "inflected")).alias("topic"), F.count_if(LX.signal("sentence", TOPICS, DIRECTIONS)).alias("signal"))


_PL = r"(^|[^\p{{L}}\p{{N}}_])({})([^\p{{L}}\p{{N}}_]|$)"


@query(f"WITH {_SENT} SELECT count(*) FILTER ({_TOPIC}) AS word, count(*) FILTER (regexp_matches(sentence, '(?i){_PL.format('ofs?[ \\t-\\r]+thes?|thiss?|froms?')}')) AS plural, count(*) FILTER (regexp_matches(sentence, '(?i){_B.format('of[ \\t-\\r]+the|this|from')}')) AS inflected, count(*) FILTER (regexp_matches(sentence, '(?i)(this|from|of the)')) AS substring FROM st")
def lexicon_dialects(spark, sf_dir):
    rows = _sentences(spark, sf_dir)
    return rows.agg(*(F.count_if(LX.hits("sentence", TOPICS, d)).alias(d) for d in LX.DIALECTS))


@query(f"""WITH {_SENT}, c AS (SELECT doc_id, sent_pos, sentence, list_filter(list_transform(string_split(regexp_replace(sentence, '(?i)[ \\t-\\r]*;[ \\t-\\r]*|[ \\t-\\r]*,?[ \\t-\\r]*\\b(that|and)\\b[ \\t-\\r]*', '␟', 'g'), '␟'), lambda x: regexp_replace(x, '^[ ,]+|[ ,]+$', '', 'g')), lambda x: x <> '') AS p FROM st),
s AS (SELECT doc_id, sent_pos, CASE WHEN len(p) > 1 AND len(list_filter(p, lambda x: NOT regexp_matches(x, '(?i){_A.format('of[ \\t-\\r]+the|this|from|is|was|by|for')}'))) = 0 THEN p ELSE [sentence] END AS segs FROM c)
SELECT doc_id, sent_pos::INTEGER AS sent_pos, unnest(range(0, len(segs)))::INTEGER AS seg_pos, md5(unnest(segs)) AS h, len(segs) > 1 AS was_split FROM s""")
def connective_split(spark, sf_dir):
    valid = LX.pattern(TOPICS + DIRECTIONS + NEGATIONS)
    segs = S.split_on_connectives(F.col("sentence"), CUTS, valid)
    rows = _sentences(spark, sf_dir).select("doc_id", "sent_pos", segs.alias("segs"))
    return rows.select("doc_id", "sent_pos", (F.size("segs") > 1).alias("was_split"), F.posexplode("segs").alias("seg_pos", "s")).select("doc_id", "sent_pos", "seg_pos", F.md5(F.col("s").cast("binary")).alias("h"), "was_split")


@query(f"WITH {_SENT}, f AS (SELECT *, len(list_filter(string_split_regex(sentence, {_WS}), lambda x: x <> '')) >= 6 AS a, NOT contains(sentence, '?') AS b, length(regexp_replace(sentence, '[^\\p{{L}}]', '', 'g'))::DOUBLE / greatest(length(sentence), 1) >= 0.5 AS c, {_TOPIC} AS d FROM st) SELECT count(*) AS n_all, count(*) FILTER (a) AS n_long, count(*) FILTER (a AND b) AS n_no_question, count(*) FILTER (a AND b AND c) AS n_letters, count(*) FILTER (a AND b AND c AND d) AS n_topic FROM f")
def sentence_funnel(spark, sf_dir):
    s = F.col("sentence")
    return S.funnel(_sentences(spark, sf_dir), [("long", F.size(TX.words(s)) >= 6), ("no_question", ~s.contains("?")), ("letters", TX.letter_share(s) >= 0.5), ("topic", LX.hits(s, TOPICS))])


@query(f"""WITH {_SENT}, w AS (SELECT *, len(list_filter(string_split_regex(sentence, {_WS}), lambda x: x <> '')) >= 6 OR row_number() OVER (PARTITION BY doc_id ORDER BY sent_pos) = 1 AS s FROM st), i AS (SELECT *, sum(CASE WHEN s THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY sent_pos ROWS UNBOUNDED PRECEDING) AS isl FROM w)
SELECT doc_id, min(sent_pos)::INTEGER AS sent_pos, md5(string_agg(sentence, ' ' ORDER BY sent_pos)) AS h FROM i GROUP BY doc_id, isl""")
def fragment_merge(spark, sf_dir):
    rows = _sentences(spark, sf_dir).select("doc_id", "sent_pos", "sentence")
    return L.merge_short(rows, 6, "doc_id", "sent_pos", "sentence").select("doc_id", "sent_pos", F.md5(F.col("sentence").cast("binary")).alias("h"))


# Folds
@query("SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(t, '([\\p{L}\\p{N}_])-[ \\t]*\\n[ \\t]*(and|or|to|the)([^\\p{L}\\p{N}_]|$)', '\\1- \\2\\3', 'g'), '([\\p{L}\\p{N}_])-[ \\t]*\\n[ \\t]*([\\p{Lu}\\p{Nd}])', '\\1-\\2', 'g'), '([\\p{L}\\p{N}_])-[ \\t]*\\n[ \\t]*([\\p{L}\\p{N}_])', '\\1\\2', 'g')) AS h FROM (SELECT doc_id, regexp_replace(text, '([a-z]{3}) ([a-zA-Z])', '\\1-\n\\2', 'g') AS t FROM documents)")
def dehyphenate(spark, sf_dir):
    wrapped = docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", "([a-z]{3}) ([a-zA-Z])", "$1-\n$2").alias("t"))
    return wrapped.select("doc_id", F.md5(TX.dehyphenate("t").cast("binary")).alias("h"))


@query()
def dehyphenate_vocabulary(spark, sf_dir):
    wrapped = docs(spark, sf_dir).select("doc_id", F.regexp_replace("text", r"(\w{3})(\w{3}) ", "$1-\n$2 ").alias("t"))
    return wrapped.select("doc_id", F.length(folds.dehyphenate_by_vocabulary("t")).alias("n"))


@query()
def reflow_paragraphs(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", folds.reflow("text").alias("a"), folds.bridge("text").alias("b")).select("doc_id", F.md5(F.col("a").cast("binary")).alias("reflowed"), F.md5(F.col("b").cast("binary")).alias("bridged"))


@query()
def greedy_chunks(spark, sf_dir):
    return folds.chunks(docs(spark, sf_dir), "doc_id", "text", target=256, least=16, keep=["source"])


@query()
def mlm_blocks(spark, sf_dir):
    return folds.packed_blocks(docs(spark, sf_dir), "doc_id", "text", room=126).select("doc_id", "block", F.size("input_ids").alias("n_ids"), F.aggregate("special_tokens_mask", F.lit(0), lambda a, x: a + x).alias("n_special"))


@query("SELECT coalesce(source, 'ALL') AS source, count(*) AS docs, sum(len(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_ \\t-\\r]')))::BIGINT AS tokens FROM documents GROUP BY ROLLUP (source)")
def token_totals(spark, sf_dir):
    n = F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_ \t-\r]"), F.lit(0)))
    rows = docs(spark, sf_dir).select("source", n.alias("n"))
    return rows.rollup("source").agg(F.count("*").alias("docs"), F.sum("n").alias("tokens")).select(F.coalesce("source", F.lit("ALL")).alias("source"), "docs", "tokens")


@query()
def unicode_repair(spark, sf_dir):
    # a column for each stage: one expression of all would be evaluated again at each place where nfkc and the measures name it
    rows = docs(spark, sf_dir).select("doc_id", F.length("text").alias("n"), TX.repair_characters("text").alias("t"))
    rows = rows.select("doc_id", "n", TX.nfkc("t").alias("t"))
    rows = rows.select("doc_id", "n", F.length(TX.tidy_punctuation(TX.tidy_blocks(TX.fold_characters("t")))).alias("chars_out"))
    return rows.select("doc_id", "chars_out", F.round(100.0 * F.col("chars_out") / F.greatest("n", F.lit(1)), 4).alias("pct_kept"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, 'https?://\\S+', '', 'g'), '[ \\t]+([,.;:!?%])', '\\1', 'g'), '[ \\t-\\r]+', ' ', 'g'))) AS h FROM documents")
def scrub_text(spark, sf_dir):
    t = F.regexp_replace(F.regexp_replace("text", r"https?://\S+", ""), r"[ \t]+([,.;:!?%])", "$1")
    return docs(spark, sf_dir).select("doc_id", F.md5(TX.collapse(t).cast("binary")).alias("h"))


@query("SELECT source, count(*) AS n, count(*) FILTER (regexp_matches(text, '(?i)\\blicensed\\b')) AS licensed, count(*) FILTER (regexp_matches(text, '(?i)\\bcopyright\\b')) AS copyrighted, count(*) FILTER (contains(text, '@')) AS mail FROM documents GROUP BY source")
def source_routing(spark, sf_dir):
    t = F.col("text")
    word = lambda w: t.rlike(rf"(?i)(?<![0-9A-Za-z_]){w}(?![0-9A-Za-z_])")
    return docs(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n"), F.count_if(word("licensed")).alias("licensed"), F.count_if(word("copyright")).alias("copyrighted"), F.count_if(t.contains("@")).alias("mail"))


# Conversations
@query("""WITH s AS (SELECT conv_id, turn, role, text, CASE WHEN lag(role) OVER w IS NULL OR lag(role) OVER w <> role THEN 1 ELSE 0 END AS s FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), i AS (SELECT *, sum(s) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS isl FROM s)
SELECT conv_id, CAST(isl AS BIGINT) AS block, any_value(role) AS speaker, md5(string_agg(coalesce(text, ''), ' ' ORDER BY turn)) AS body_md5, count(*) AS turns FROM i GROUP BY conv_id, isl""")
def role_turns(spark, sf_dir):
    from pyspark.sql import Window as W

    turns = table(spark, sf_dir, "conversations")
    o = W.partitionBy("conv_id").orderBy("turn")
    new = F.when(F.lag("role").over(o).isNull() | (F.lag("role").over(o) != F.col("role")), 1).otherwise(0)
    rows = turns.withColumn("s", new).withColumn("block", F.sum("s").over(o.rowsBetween(W.unboundedPreceding, W.currentRow)))
    said = F.array_sort(F.collect_list(F.struct("turn", F.coalesce("text", F.lit("")).alias("t"))))
    out = rows.groupBy("conv_id", "block").agg(F.first("role").alias("speaker"), said.alias("x"), F.count("*").alias("turns"))
    return out.select("conv_id", "block", "speaker", F.md5(F.array_join(F.transform("x", lambda s: s["t"]), " ").cast("binary")).alias("body_md5"), "turns")


@query()
def speaker_turns(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations")
    lined = turns.select("conv_id", F.col("turn").alias("pos"), F.concat(F.when(F.col("role") == "user", "MR. USER. ").otherwise("CHAIR PERSON. "), F.coalesce(F.regexp_replace("text", r"\s+", " "), F.lit(""))).alias("line"))
    return L.speaker_turns(lined.withColumnRenamed("conv_id", "doc")).select(F.col("doc").alias("conv_id"), "turn", "speaker", F.length("body").alias("n"))


@query("""WITH r AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN concat('{"label": "', turn % 3, '"}') WHEN turn % 5 = 1 THEN concat('The answer is ', turn % 3, '.') WHEN turn % 5 = 2 THEN 'I find it Hawkish' WHEN turn % 5 = 3 THEN 'code 12' END AS reply FROM conversations)
SELECT conv_id, turn, CAST(coalesce(nullif(regexp_extract(coalesce(reply, ''), '"label"\\s*:\\s*"?([012])', 1), ''), nullif(regexp_extract(coalesce(reply, ''), '(^|[^0-9A-Za-z_])([012])($|[^0-9A-Za-z_])', 2), ''), CASE WHEN contains(lower(reply), 'dovish') THEN '0' WHEN contains(lower(reply), 'hawkish') THEN '1' WHEN contains(lower(reply), 'neutral') THEN '2' END, '-1') AS INTEGER) AS label FROM r""")
def reply_parse(spark, sf_dir):
    t = F.col("turn")
    digit = (t % 3).cast("string")
    reply = F.when(t % 5 == 0, F.concat(F.lit('{"label": "'), digit, F.lit('"}'))).when(t % 5 == 1, F.concat(F.lit("The answer is "), digit, F.lit("."))).when(t % 5 == 2, "I find it Hawkish").when(t % 5 == 3, "code 12")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce(parse_reply(reply), F.lit(-1)).alias("label"))


@query("SELECT label, count(*) AS n FROM (SELECT CASE o_orderkey % 6 WHEN 0 THEN 'hawkish' WHEN 1 THEN 'dovish' WHEN 2 THEN 'neutral' WHEN 3 THEN 'hawkish' WHEN 4 THEN 'neutral' ELSE 'none' END AS label FROM orders) GROUP BY label")
def free_text_labels(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    raw = F.when(k == 0, "Very Hawkish").when(k == 1, " D ").when(k == 2, "2.0").when(k == 3, "mh").when(k == 4, "NEUTRAL!").otherwise("who knows")
    return table(spark, sf_dir, "orders").select(F.coalesce(from_free_text(raw), F.lit("none")).alias("label")).groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT item_id, md5(replace(replace('Classify into {labels}: \"{sentence}\"', '{labels}', 'dovish, hawkish, neutral'), '{sentence}', replace(text, '\"', ''''))) AS prompt_md5 FROM benchmark")
def prompt_render(spark, sf_dir):
    template = F.replace(F.lit('Classify into {labels}: "{sentence}"'), F.lit("{labels}"), F.lit("dovish, hawkish, neutral"))
    prompt = F.replace(template, F.lit("{sentence}"), F.replace("text", F.lit('"'), F.lit("'")))
    return table(spark, sf_dir, "benchmark").select("item_id", F.md5(prompt.cast("binary")).alias("prompt_md5"))


@query("SELECT lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents WHERE doc_id NOT IN (SELECT item_id FROM benchmark)) WHERE rn = 1")
def few_shot_pick(spark, sf_dir):
    rest = docs(spark, sf_dir).join(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id")), "doc_id", "left_anti")
    return rest.groupBy("lang").agg(F.min_by(F.struct("doc_id", "n_chars"), "doc_id").alias("b")).select("lang", "b.doc_id", "b.n_chars")


# Pages
@query("""WITH h AS (SELECT page_id, regexp_extract_all(html, '<a\\b[^>]*?\\bhref=["'']([^"''>]+)["'']', 1) AS a FROM pages) SELECT page_id, unnest(range(0, len(a)))::INTEGER AS pos, unnest(a) AS href FROM h""")
def page_links(spark, sf_dir):
    return PG.links(table(spark, sf_dir, "pages"), "page_id", "html")


@query("SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path, CASE WHEN contains(url, '#') THEN 'fragment' WHEN contains(url, '?') THEN 'query' WHEN regexp_matches(url, '\\.html$') THEN 'file' WHEN regexp_matches(url, '/$') THEN 'folder' ELSE 'plain' END AS kind FROM pages")
def url_parse(spark, sf_dir):
    u = F.col("url")
    kind = P.doc_type("url", [("#", "fragment"), (r"\?", "query"), (r"\.html$", "file"), ("/$", "folder")], "plain")
    return table(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract(u, "://([^/?#]*)", 1)).alias("host"), F.regexp_extract(u, "://[^/?#]*([^?#]*)", 1).alias("path"), kind.alias("kind"))


@query("""WITH i AS (SELECT o_orderkey AS k, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%y%m%d') WHEN 1 THEN strftime(o_orderdate, '%Y%m') WHEN 2 THEN strftime(o_orderdate, '%Y') ELSE concat(strftime(o_orderdate, '%Y'), '1', o_orderkey % 9 + 3 - 1) END AS id FROM orders)
SELECT k, CASE WHEN length(id) = 6 AND k % 4 = 0 THEN concat(CASE WHEN substr(id, 1, 2)::INT < 90 THEN '20' ELSE '19' END, substr(id, 1, 2), '-', substr(id, 3, 2), '-', substr(id, 5, 2)) WHEN length(id) = 4 THEN id WHEN length(id) = 6 AND substr(id, 5, 2)::INT BETWEEN 1 AND 12 THEN concat(substr(id, 1, 4), '-', substr(id, 5, 2)) WHEN length(id) = 6 THEN concat(substr(id, 1, 4), '-i', substr(id, 5, 2)) ELSE 'none' END AS shown FROM i""")
def id_parse(spark, sf_dir):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    raw = F.when(k % 4 == 0, F.date_format(d, "yyMMdd")).when(k % 4 == 1, F.date_format(d, "yyyyMM")).when(k % 4 == 2, F.date_format(d, "yyyy")).otherwise(F.concat(F.date_format(d, "yyyy"), F.lit("1"), (k % 9 + 2).cast("string")))
    return table(spark, sf_dir, "orders").select(k.alias("k"), F.coalesce(PG.parse_id(raw)["shown"], F.lit("none")).alias("shown"))


@query("SELECT o_orderkey AS k, CASE WHEN rn = 1 THEN d ELSE concat(d, '-', chr((96 + rn)::INTEGER)) END AS id FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, row_number() OVER (PARTITION BY strftime(o_orderdate, '%Y-%m-%d') ORDER BY o_orderkey) AS rn FROM orders)")
def same_day_suffix(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return PG.letter_suffix(rows, "d", "k", "id").select("k", "id")


@query("SELECT CAST(y AS INTEGER) AS year FROM range(1990, 2006) t(y) WHERE y NOT IN (SELECT year(o_orderdate) FROM orders)")
def index_gap_fill(spark, sf_dir):
    return PG.missing_years(table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("year")), "year", 1990, 2005)


@query("SELECT CAST(CAST(d AS DATE) AS VARCHAR) AS day, printf('/bulletin/%d/%02d.pdf', year(d), month(d)) AS url FROM generate_series(TIMESTAMP '1999-01-01', TIMESTAMP '2014-12-01', INTERVAL 1 MONTH) t(d)")
def constructed_urls(spark, sf_dir):
    return PG.constructed_urls(spark, "/bulletin/%d/%02d.pdf", "1999-01-01", "2014-12-01", "1 month").withColumn("day", F.col("day").cast("string"))


@query("WITH a AS (SELECT p_partkey % 700 AS k, 'first' AS via FROM part WHERE p_partkey % 2 = 0), b AS (SELECT p_partkey % 900 AS k, 'second' AS via FROM part) SELECT k, min(via) AS via FROM (SELECT DISTINCT * FROM a UNION ALL SELECT DISTINCT * FROM b) GROUP BY k")
def merge_routes(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    one = part.where("p_partkey % 2 = 0").select((F.col("p_partkey") % 700).alias("k"), F.lit("first").alias("via"))
    return PG.merge_routes([one, part.select((F.col("p_partkey") % 900).alias("k"), F.lit("second").alias("via"))], "k").select("k", "via")


@query()
def html_main_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", PG.main_text("html").alias("t")).select("page_id", F.length("t").alias("chars"), F.md5(F.col("t").cast("binary")).alias("h"))


@query()
def html_tag_stripped(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.length(PG.tag_stripped("html")).alias("chars"))
