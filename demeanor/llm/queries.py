"""The text operators' queries and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embeddings, jaccard, langid, mixing, pii, quality, secrets, toxicity, urls
from .common import table

BPE_FILE = "byte_bpe_multi_50k.tiktoken"
PIECES_FILE = "piece_bpe_32k.model"
URL_RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("block", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
MIX_SEED = 20


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"), urls.rules_table(spark, URL_RULES))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_texts(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_digest(table(spark, sf_dir, "documents"), tokenizer(BPE_FILE), pattern())


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"), 0.95)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_digest(table(spark, sf_dir, "documents"))


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.poisson_mix(table(spark, sf_dir, "documents"), temperature=0.5, seed=MIX_SEED)
    return mixed.select("doc_id", "text", "lang", "source", "n_chars", "mix_copy", "mix_order")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = table(spark, sf_dir, "documents"), tokenizer(PIECES_FILE)
    return langid.identify(docs, langid.learn(docs, path), path)


def op10_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets_digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from corpus_pipeline import run

    own = [op1_ngram_jaccard_join, op2_url_filters, op3_toxicity, op4_byte_bpe, op5_quality_rules, op6_embedding_near_dedup, op7_pii, op8_poisson_mix, op9_language_id, op10_secret_scans]
    return {f.__name__: f for f in own} | {"pipeline": run}


_URL_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(verdict, host, path) AS (
  VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('block', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), hit AS (
  SELECT p.page_id, p.host, p.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.page_id ORDER BY length(r.host || r.path) DESC NULLS LAST) AS k
  FROM p LEFT JOIN r ON ('.' || p.host) LIKE ('%.' || r.host) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hit WHERE k = 1
"""


def _quality_sql() -> str:
    stop = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
    rejects = " OR ".join(f"coalesce({r.sql().replace('D)', '::DOUBLE)')}, false)" for r in quality.RULES)
    space = r"[ \t\n\v\f\r]+"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, word, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS i
      FROM (SELECT doc_id, unnest(s) AS word, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, regexp_split_to_array(t, '{space}') AS s FROM d)) WHERE word <> ''),
per_doc AS (SELECT doc_id, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (word IN ({stop})) AS n_stop_words, count(*) FILTER (suffix(word, '!!')) AS n_shouts FROM w GROUP BY doc_id),
win AS (SELECT doc_id, i, word || ' ' || lead(word, 1) OVER o || ' ' || lead(word, 2) OVER o || ' ' || lead(word, 3) OVER o || ' ' || lead(word, 4) OVER o AS x FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS c FROM win WHERE x IS NOT NULL) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (SELECT doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM twice) GROUP BY doc_id),
line AS (SELECT doc_id, l FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^ \t\n\v\f\r]')),
lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines FROM line GROUP BY doc_id),
m AS (
  SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_stop_words, 0) AS n_stop_words, coalesce(n_shouts, 0) AS n_shouts
  FROM d LEFT JOIN per_doc USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({quality.BASE_FAILED}) AS base_failed,
       NOT ({quality.BASE_FAILED}) AND NOT ({rejects}) AS kept FROM m
"""


_MIX_SQL = f"""
WITH n AS (SELECT coalesce(source, chr(0) || 'null') AS s, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT s, sqrt(n::DOUBLE) / (SELECT sum(sqrt(n::DOUBLE)) FROM n) * (SELECT sum(n)::DOUBLE FROM n) / n AS rate FROM n),
k AS (SELECT s, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 40)::BIGINT + 1)) AS k FROM r),
p AS (SELECT s, k, exp(-rate + sum(CASE WHEN k = 0 THEN 0 ELSE ln(rate) - ln(k) END) OVER (PARTITION BY s ORDER BY k)) AS p FROM k),
c AS (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS c FROM p),
u AS (SELECT *, coalesce(source, chr(0) || 'null') AS s, ('0x' || substr(md5('{MIX_SEED}|' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / pow(2, 52) AS u FROM documents),
x AS (SELECT u.doc_id, u.text, u.lang, u.source, u.n_chars, (SELECT count(*) FROM c WHERE c.s = u.s AND c.c <= u.u) AS copies FROM u),
y AS (SELECT doc_id, text, lang, source, n_chars, unnest(range(0, copies)) AS mix_copy FROM x)
SELECT doc_id, text, lang, source, n_chars, mix_copy::INTEGER AS mix_copy, md5('order{MIX_SEED}|' || coalesce(doc_id::VARCHAR, '') || '|' || mix_copy::VARCHAR) AS mix_order FROM y
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": _URL_SQL, "op5_quality_rules": _quality_sql(), "op8_poisson_mix": _MIX_SQL}
