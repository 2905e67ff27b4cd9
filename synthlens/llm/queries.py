"""The operators on the given tables, with production parameters: one query
``opN_<name>`` each, over the whole table, and the DuckDB twin where SQL can
express the result. Queries without a twin are tested against a brute-force
version in ``tests/llm``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from synthlens.llm import (
    alignment,
    divergence,
    lm_mix,
    mixing,
    ngram_join,
    packing,
    quality_fm,
    quality_rules,
    sharding,
    simhash,
    suffix_dedup,
    url_filter,
    va_topk,
)
from synthlens.llm.common import crc_mod, table

SHARDS = tuple(f"shard-{i:02d}" for i in range(64))
# The URL rules (host, path, verdict).
URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block"))
SOURCE_WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
QUALITY_THRESHOLD = 0.7


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"), "doc_id", SHARDS)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality_fm.fit_quality(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("doc_id"), 4) != 2)
    return quality_fm.score_quality(docs, machine).select(
        "doc_id", (crc_mod(F.col("doc_id"), 4) == 2).alias("held_out"), "score",
        (F.col("score") >= QUALITY_THRESHOLD).cast("int").alias("predicted"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_join(table(spark, sf_dir, "documents"))


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_counts(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), SOURCE_WEIGHTS, MAX_EPOCHS)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return va_topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = crc_mod(F.col("doc_id"), 5) == 1
    scores = lm_mix.score_texts(table(spark, sf_dir, "documents"), ~held_out, carry={"held_out": held_out})
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score",
                         "bits_per_byte")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_digest(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"),
                                     tokenizer_path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_ngram_join": op3_ngram_join,
    "op4_url_filters": op4_url_filters,
    "op5_quality_rules": op5_quality_rules,
    "op6_mixing": op6_mixing,
    "op7_exact_topk": op7_exact_topk,
    "op8_lm_scoring": op8_lm_scoring,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_packing": op10_packing,
    "op11_source_divergence": op11_source_divergence,
    "op12_simhash": op12_simhash,
    "op13_alignment": op13_alignment,
}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"


def _url_sql() -> str:
    rules = " UNION ALL ".join(f"SELECT '{h}' AS rh, '{p}' AS rp, '{v}' AS v" for h, p, v in URL_RULES)
    return f"""WITH r AS ({rules}),
 a AS (SELECT page_id, coalesce(CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END, '') AS t
       FROM pages),
 p AS (SELECT page_id, {_LOWER.format("regexp_extract(t, '^([^/?#]*)', 1)")} AS host,
              regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
 f AS (SELECT page_id, host, path, rh || rp AS rule, v,
              row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST) AS n
       FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM f WHERE n = 1"""


def _mixing_sql() -> str:
    return f"""WITH d AS (SELECT doc_id, source, coalesce(len({_WORDS.format("text")}), 0)::BIGINT AS size,
   md5('6:' || coalesce(doc_id::VARCHAR, 'null')) AS k FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS z,
              [{', '.join(map(str, SOURCE_WEIGHTS))}][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(SOURCE_WEIGHTS)} + 1)::INT]::BIGINT AS w
       FROM d GROUP BY source),
 l AS (SELECT *, z * {MAX_EPOCHS} AS cap,
        (sum(z) OVER ())::DOUBLE - coalesce(sum(z * {MAX_EPOCHS}) OVER (ORDER BY (z * {MAX_EPOCHS})::DOUBLE / w, source NULLS LAST
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest,
        sum(w) OVER (ORDER BY (z * {MAX_EPOCHS})::DOUBLE / w, source NULLS LAST
           ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS ws FROM s),
 v AS (SELECT rest, ws FROM l WHERE rest * w <= cap::DOUBLE * ws ORDER BY cap::DOUBLE / w LIMIT 1),
 t AS (SELECT source, z, least(cap::DOUBLE, coalesce((SELECT rest FROM v) * w / (SELECT ws FROM v), cap::DOUBLE)) AS target FROM l),
 c AS (SELECT d.doc_id, d.size, t.z AS source_size, t.target,
        CASE WHEN t.z > 0 THEN least(floor(t.target / t.z), {MAX_EPOCHS}) ELSE 0 END::BIGINT AS e,
        coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
       FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  ((e + CASE WHEN e < {MAX_EPOCHS} AND 2 * before + size < 2 * (target - e * source_size) THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM c"""


def _topk_sql() -> str:
    return """WITH v AS (SELECT vec_id, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS e
   FROM embeddings WHERE embedding IS NOT NULL),
 c AS (SELECT vec_id, unnest(e) AS x, unnest(range(len(e))) AS d FROM v),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
   FROM c AS q JOIN c ON q.d = c.d AND q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""


def _rules_sql() -> str:
    # a phrase between letters of no other word; marks and spaces are doubled, so that neighbouring phrases do not share one
    edge = r"[^0-9a-z\x{80}-\x{10FFFF}]"
    phrases = "|".join(p.decode().replace(" ", "  ") for p in quality_rules.BOILERPLATE)
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
 l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(len(string_split(t, chr(10))))) AS i FROM d),
 m AS (SELECT doc_id, i, line, {_WORDS.format("line")} AS w FROM l),
 o AS (SELECT *, len(w) AS n, row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again FROM m WHERE len(w) > 0),
 x AS (SELECT doc_id, n, again, again
    OR 100 * coalesce(list_sum([len(regexp_extract_all(p, '[^ ]+')) for p in regexp_extract_all(
        regexp_replace({_LOWER.format("line")}, '({edge})', '\1\1', 'g'), '(?:^|{edge})({phrases})(?:$|{edge})', 1)]), 0)
       >= {quality_rules.BOILERPLATE_PERCENT} * n
    OR 100 * len([y for y in w if regexp_matches(y, '[#*$%&|<>]')]) > {quality_rules.MAX_SYMBOL_PERCENT} * n
    OR (n >= {quality_rules.MIN_CAPITAL_WORDS} AND 100 * len([y for y in w if regexp_matches(y, '[A-Z]')
        AND NOT regexp_matches(y, '[a-z]')]) > {quality_rules.MAX_CAPITAL_PERCENT} * n)
    OR (n < {quality_rules.MIN_LINE_WORDS} AND NOT regexp_matches(line, '[.!?:;"'')\]}}][\x20\x09-\x0D]*$')) AS gone FROM o),
 y AS (SELECT doc_id, count(*) FILTER (again) AS dup, count(*) FILTER (gone) AS gone_lines,
              coalesce(sum(n) FILTER (gone), 0)::BIGINT AS gone_words FROM x GROUP BY doc_id),
 a AS (SELECT doc_id, t, {_WORDS.format("t")} AS w FROM d),
 g AS (SELECT doc_id, unnest(w[1:len(w) - 2]) AS p, unnest(w[2:len(w) - 1]) AS q, unnest(w[3:len(w)]) AS r,
              unnest(range(len(w) - 2)) AS i FROM a WHERE len(w) > 2),
 h AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, p, q, r) AS c FROM g) WHERE c > 1),
 rep AS (SELECT doc_id, count(DISTINCT j) AS c FROM (SELECT doc_id, i + k AS j FROM h, (SELECT unnest([0, 1, 2]) AS k)) GROUP BY doc_id),
 b AS (SELECT a.doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(z) for z in w]), 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup, 0)::BIGINT AS n_dup_lines,
    coalesce(rep.c, 0)::BIGINT AS n_repeat_words, coalesce(gone_lines, 0)::BIGINT AS n_lines_removed,
    coalesce(gone_words, 0)::BIGINT AS n_words_removed
   FROM a LEFT JOIN y USING (doc_id) LEFT JOIN rep USING (doc_id))
SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words AS base_failed,
  NOT (n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words)
  AND 100 * n_words_removed <= {quality_rules.MAX_LOST_PERCENT} * n_words AS kept FROM b"""


def _divergence_sql() -> str:
    p = f"(CASE WHEN v = 0 THEN 1 ELSE 1 + {divergence.SCALE}::HUGEINT * (c + 2) // (n + 2 * v) END)"
    f = "((a.p - b.p) * (a.p - b.p) // (a.p + b.p))"
    return rf"""WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
   coalesce(text, '') AS t FROM documents),
 x AS (SELECT r, lang, source, {_LOWER.format("unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'))")} AS term FROM d),
 k AS (SELECT lang, term, count(*)::HUGEINT AS c FROM x GROUP BY ALL HAVING count(DISTINCT r) >= {divergence.MIN_DOCS}),
 g AS (SELECT DISTINCT lang, source FROM d),
 l AS (SELECT g.lang, count(k.term)::HUGEINT AS v, coalesce(sum(k.c), 0)::HUGEINT AS n
       FROM (SELECT DISTINCT lang FROM g) AS g LEFT JOIN k ON g.lang = k.lang GROUP BY ALL),
 y AS (SELECT x.lang, source, x.term, count(*)::HUGEINT AS c FROM x JOIN k ON x.lang = k.lang AND x.term = k.term GROUP BY ALL),
 z AS (SELECT g.lang, g.source, any_value(l.v) AS v, coalesce(sum(y.c), 0)::HUGEINT AS n
       FROM g JOIN l ON g.lang = l.lang LEFT JOIN y ON g.lang = y.lang AND g.source = y.source GROUP BY ALL),
 e AS (SELECT z.lang, z.source, k.term, coalesce(y.c, 0)::HUGEINT AS c, z.v, z.n
       FROM z JOIN k ON z.lang = k.lang LEFT JOIN y ON y.lang = z.lang AND y.source = z.source AND y.term = k.term),
 s AS (SELECT lang, source, term, c, {p} AS p FROM e),
 q AS (SELECT k.lang, k.term, {p} AS p FROM k JOIN l ON k.lang = l.lang),
 pairs AS (SELECT a.lang, a.source, b.source AS item, sum({f}) AS value FROM s AS a JOIN s AS b
           ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
 terms AS (SELECT a.lang, a.source, a.term AS item, {f} AS value FROM s AS a JOIN q AS b
           ON a.lang = b.lang AND a.term = b.term WHERE a.c > 0 AND a.p > b.p),
 o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
       FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
       LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
       UNION ALL SELECT lang, source, 'term', item, value FROM terms)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM o)
WHERE part = 'pair' OR rank <= {divergence.TOP_TERMS}"""


ORACLE_SQL: dict[str, str] = {
    "op4_url_filters": _url_sql(),
    "op5_quality_rules": _rules_sql(),
    "op6_mixing": _mixing_sql(),
    "op7_exact_topk": _topk_sql(),
    "op11_source_divergence": _divergence_sql(),
}
