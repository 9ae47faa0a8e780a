"""The queries of the training-data operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusloom.llm.common import read
from corpusloom.llm.op1_quality import classify
from corpusloom.llm.op2_ann import nearest
from corpusloom.llm.op3_secrets import scan_secrets
from corpusloom.llm.op4_lm import good_documents, score
from corpusloom.llm.op5_urls import PATTERNS, SITE_RULES, judge_urls
from corpusloom.llm.op6_mixing import mix_sources
from corpusloom.llm.op7_jaccard import near_duplicate_groups
from corpusloom.llm.op8_shards import assign_shards
from corpusloom.llm.op9_decontaminate import decontaminate
from corpusloom.llm.op10_suffix import remove_repeats


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")).drop("text_id")


def op2_approximate_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(read(spark, sf_dir, "embeddings"))


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(read(spark, sf_dir, "documents"))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return score(docs, good_documents(docs, read(spark, sf_dir, "labels")))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op6_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).drop("source", "shard", "text_id")


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_groups(read(spark, sf_dir, "documents"), links=True).drop("text_id", "group_id")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(read(spark, sf_dir, "documents"))


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("text_id")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_approximate_nearest_neighbours": op2_approximate_nearest_neighbours,
        "op3_secret_scans": op3_secret_scans,
        "op4_lm_scoring": op4_lm_scoring,
        "op5_url_filters": op5_url_filters,
        "op6_mixing_sources": op6_mixing_sources,
        "op7_ngram_jaccard_join": op7_ngram_jaccard_join,
        "op8_sharding": op8_sharding,
        "op9_benchmark_decontamination": op9_benchmark_decontamination,
        "op10_suffix_array_dedup": op10_suffix_array_dedup,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
d AS (SELECT len(e) AS d FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1), u AS (SELECT vec_id, e FROM v, d WHERE len(e) = d),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM u q, u c WHERE q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20"""

_HOST = "translate(coalesce(nullif(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), ''), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _op5() -> str:
    """Every rule tried on every URL; the candidates that a token index fetches are counted by the same rarest tokens."""
    fits = "CASE " + " ".join(f"WHEN (host = '{r.partition('/')[0]}' OR suffix(host, '.{r.partition('/')[0]}')) AND starts_with(path, '/{r.partition('/')[2]}') THEN '{r}'" for r in sorted(SITE_RULES, key=len, reverse=True)) + " END"
    hit = "CASE " + " ".join(f"WHEN regexp_matches(lower(url), '{p.regex}') THEN {k}" for k, p in enumerate(PATTERNS)) + " ELSE -1 END"
    said = "CASE rule " + " ".join(f"WHEN '{r}' THEN '{v}'" for r, v in SITE_RULES.items()) + " ELSE CASE WHEN pattern >= 0 THEN 'block' ELSE 'allow' END END"
    return f"""WITH p AS (SELECT page_id, url, {_HOST} AS host, regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages), r AS (SELECT *, {fits} AS rule, {hit} AS pattern FROM p)
SELECT page_id, host, path, rule, {said} AS verdict FROM r"""


_OP7 = f"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id), b AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM b JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 100 * i >= 75 * (p.n + q.n - i)), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT a AS x, b AS y FROM e UNION SELECT c.x, e.b FROM c JOIN e ON c.y = e.a), m AS (SELECT x, min(y) AS y FROM c GROUP BY x), k AS (SELECT a, count(*) AS k FROM e GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(least(d.doc_id, m.y), d.doc_id) AS component_id, coalesce(k.k, 0) AS n_links FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.x = d.doc_id LEFT JOIN k ON k.a = d.doc_id"""

_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

_OP9 = f"""WITH t AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL), g AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, unnest(list_transform(range(1, greatest(len(w) - 9, 1) + 1), lambda i: array_to_string(w[i:i + 9], ' '))) AS g FROM t WHERE len(w) > 0),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents), k AS (SELECT DISTINCT k FROM g), p AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, k WHERE len(w) >= k),
h AS (SELECT p.doc_id, p.k, p.i, g.item_id FROM p JOIN g ON p.k = g.k AND array_to_string(p.w[p.i:p.i + p.k - 1], ' ') = g.g), c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM h) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN x ON x.doc_id = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_approximate_nearest_neighbours": _OP2,
        "op5_url_filters": _op5(),
        "op7_ngram_jaccard_join": _OP7,
        "op9_benchmark_decontamination": _OP9,
    }
