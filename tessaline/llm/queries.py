"""The queries of this subpackage, as the driver runs them: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessaline.session import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaline.llm.line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaline.llm.language import identify_language, in_fold

    out = identify_language(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return out.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaline.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaline.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op5_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaline.llm.ngram_join import ngram_jaccard_join

    return ngram_jaccard_join(table(spark, sf_dir, "documents"), n=5, percent=80)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaline.llm.substring_dedup import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaline.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), vocabulary="word_bpe_49k.json", max_tokens=2048)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaline.llm.licenses import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op9_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaline.llm.html import extract_main_text

    return extract_main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessaline.llm.quality import quality_rules

    return quality_rules(table(spark, sf_dir, "documents"), vocabulary="piece_bpe_32k.model")


def base_license_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8_license_scan that SQL can express."""
    return op8_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def base_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op10_quality_rules that SQL can express."""
    return op10_quality_rules(spark, sf_dir).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"

#: Distinct 5-word shingles, links by counted overlaps, and the least id reachable over links.
NGRAM_JOIN = f"""
WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, {WORDS.format(LOWER)} AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS both_ FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT x, y FROM common JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * both_ >= 80 * (p.n + q.n - both_)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, links.y FROM r JOIN links ON links.x = r.c)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, d.c AS component_id FROM (SELECT doc_id, min(c) AS c FROM r GROUP BY 1) d LEFT JOIN n USING (doc_id)
"""

#: Windows of 35 words that start at two places or more, and the words under them.
SUBSTRING_DEDUP = f"""
WITH w AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
p AS MATERIALIZED (SELECT r, unnest(CASE WHEN len(w) >= 35 THEN range(1, len(w) - 33) ELSE [] END) AS i, unnest(CASE WHEN len(w) >= 35 THEN list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' '))) ELSE [] END) AS k FROM w),
again AS (SELECT k FROM p GROUP BY k HAVING count(*) > 1),
gone AS MATERIALIZED (SELECT DISTINCT r, unnest(range(i, i + 35)) AS i FROM p WHERE k IN (SELECT k FROM again)),
words AS (SELECT r, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM w),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(g.n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (r) LEFT JOIN (SELECT r, count(*) AS n FROM gone GROUP BY r) g USING (r)
"""

LICENSE_PHRASES = rf"""
WITH w AS MATERIALIZED (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p(label, q) AS (VALUES ('mit', ['under', 'the', 'mit', 'license']), ('apache-2', ['apache', 'license', 'version', '2']), ('cc-by-nc', ['cc', 'by', 'nc'])),
h AS (SELECT doc_id, label, unnest(list_filter(range(1, len(w) + 1), lambda i: w[i] = q[1] AND w[i:i + len(q) - 1] = q)) - 1 AS place FROM w, p),
f AS (SELECT doc_id, count(*) AS n, min(place) AS a, max(place) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM h GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, b::BIGINT AS last_word, coalesce(labels, '') AS base_labels FROM w LEFT JOIN f USING (doc_id)
"""

QUALITY_COUNTS = rf"""
WITH w AS MATERIALIZED (SELECT doc_id, coalesce(text, '') AS t, {WORDS.format("coalesce(text, '')")} AS w FROM documents),
l AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM w),
p AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS k FROM w WHERE len(w) > 2),
again AS (SELECT doc_id, k FROM p GROUP BY 1, 2 HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + 3)) AS j FROM p SEMI JOIN again USING (doc_id, k)) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, (len(w) < 50 OR 100 * coalesce(n, 0) > 50 * len(w)) AS base_failed
FROM w JOIN l USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_language_id": op2_language_id,
        "op3_mix_sources": op3_mix_sources,
        "op4_exact_top_k": op4_exact_top_k,
        "op5_ngram_jaccard_join": op5_ngram_jaccard_join,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_license_scan": op8_license_scan,
        "op9_html_extract": op9_html_extract,
        "op10_quality_rules": op10_quality_rules,
        "base_license_phrases": base_license_phrases,
        "base_quality_counts": base_quality_counts,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express; the others are tested against brute force in tests/llm."""
    from tessaline.llm import mixing, topk

    return {
        "op3_mix_sources": mixing.ORACLE, "op4_exact_top_k": topk.ORACLE, "op5_ngram_jaccard_join": NGRAM_JOIN, "op6_substring_dedup": SUBSTRING_DEDUP,
        "base_license_phrases": LICENSE_PHRASES, "base_quality_counts": QUALITY_COUNTS,
    }
