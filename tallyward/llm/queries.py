"""Queries of the training-data operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyward.llm import html_extract, media, merge_pieces, minhash, mixing, packing, pii, prefix_trie, quality_model, quality_rules, sharding, suffix_dedup, whitening
from tallyward.llm.common import read_table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_model.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "score", "expected_grade", "tail_probability", "kept")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(read_table(spark, sf_dir, "pages"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality_rules.quality_report(read_table(spark, sf_dir, "documents"), with_text=False)
    return report.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_words")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_spans(read_table(spark, sf_dir, "documents"))


def op6_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"), size=4, percent=80)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents")).drop("spans")


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digest(media.media_columns(read_table(spark, sf_dir, "documents")))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.shard_documents(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.components(whitening.whiten(read_table(spark, sf_dir, "embeddings"), k=8))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.conversation_trie(read_table(spark, sf_dir, "conversations"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str, model_path: str | None = None) -> DataFrame:
    if model_path is None:
        import public_tokenizers

        model_path = public_tokenizers.path("piece_bpe_32k.model")
    return merge_pieces.round_trip(read_table(spark, sf_dir, "documents"), model_path)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_classifier": op1_quality_classifier,
        "op2_html_extraction": op2_html_extraction,
        "op3_quality_rules": op3_quality_rules,
        "op4_mixing": op4_mixing,
        "op5_pii": op5_pii,
        "op6_minhash_dedup": op6_minhash_dedup,
        "op7_suffix_dedup": op7_suffix_dedup,
        "op8_media_columns": op8_media_columns,
        "op9_sharding": op9_sharding,
        "op10_packing": op10_packing,
        "op11_whitening": op11_whitening,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_sentencepiece": op13_sentencepiece,
    }


ORACLE_SQL = {
    "op3_quality_rules": r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
base AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols FROM docs),
spread AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM docs),
windows AS (
  SELECT doc_id, i, word, lead(word) OVER w AS word2, lead(word, 2) OVER w AS word3
  FROM spread WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
counted AS (
  SELECT doc_id, i, CASE WHEN word3 IS NULL THEN 0
         ELSE count(*) OVER (PARTITION BY doc_id, word, word2, word3) END AS times FROM windows),
repeats AS (
  SELECT doc_id, CAST(count(*) FILTER (times > 1 OR before1 > 1 OR before2 > 1) AS BIGINT) AS n_repeat_words
  FROM (SELECT doc_id, times, lag(times) OVER w AS before1, lag(times, 2) OVER w AS before2
        FROM counted WINDOW w AS (PARTITION BY doc_id ORDER BY i))
  GROUP BY doc_id),
split AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM docs),
lines AS (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i FROM split),
told AS (
  SELECT doc_id, line,
         row_number() OVER (PARTITION BY doc_id, line ORDER BY i) > 1 AS again,
         len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n,
         length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS chars,
         length(regexp_replace(line, '[^#*$%&|<>]', '', 'g')) AS symbols,
         length(regexp_replace(line, '[^!]', '', 'g')) AS cries,
         length(regexp_replace(line, '[^A-Z]', '', 'g')) AS upper,
         length(regexp_replace(line, '[^A-Za-z]', '', 'g')) AS letters,
         len(list_filter(regexp_extract_all(line, '[^\x20\x09-\x0D]+'),
             lambda w: w IN ('|', '/', '>', '>>', '»', '·', '•', '-', '–'))) AS separators
  FROM lines),
judged AS (
  SELECT doc_id, n, again,
         again OR 100 * symbols > 10 * chars OR 100 * cries > 8 * chars OR (n >= 5 AND 100 * upper > 60 * letters)
         OR (separators >= 2 AND 100 * separators >= 20 * n)
         OR (n <= 40 AND regexp_matches(lower(line), 'accept all cookies|all rights reserved|back to top|click here|cookie policy|enable javascript|log in to|permission is hereby granted|licensed under the|privacy policy|read more|released under the|share this|sign up for|skip to content|subscribe to our|terms of service|terms of use')) AS bad
  FROM told WHERE n > 0),
lost AS (
  SELECT doc_id, CAST(count(*) FILTER (again) AS BIGINT) AS n_dup_lines, CAST(coalesce(sum(n) FILTER (bad), 0) AS BIGINT) AS n_lost_words
  FROM judged GROUP BY doc_id),
everything AS (
  SELECT doc_id, n_words, word_chars, n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(n_lost_words, 0) AS n_lost_words,
         n_words < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * n_words AS base_failed
  FROM base LEFT JOIN repeats USING (doc_id) LEFT JOIN lost USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND 100 * n_lost_words <= 40 * n_words AS kept, n_lost_words
FROM everything
""",
    "op4_mixing": r"""
WITH docs AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR) || ':7'), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u,
         coalesce(greatest(0.05::DOUBLE, 1 - 10 * (length(text) - length(translate(text, '#*$%&|<>', '')))::DOUBLE / greatest(length(text), 1)), 1) AS w
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         list_extract([3.0::DOUBLE, 1.0, 2.0], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)) AS weight
  FROM docs GROUP BY source),
rates AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate
  FROM sources),
targets AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, max(rate) OVER () * weight) AS target FROM rates),
goals AS (
  SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS goal,
         CASE WHEN source_size > 0 THEN CAST(floor(target + 0.5) AS BIGINT) // source_size ELSE 0 END AS epochs FROM targets),
ordered AS (
  SELECT doc_id, size, source_size, target, epochs, goal - epochs * source_size AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY -ln(u) / w, doc_id ROWS UNBOUNDED PRECEDING) - size AS before
  FROM docs d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, CAST(epochs * size + greatest(0, least(size, rest - before)) AS BIGINT) AS taken FROM ordered
""",
    "op6_minhash_dedup": r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM docs),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN sizes p ON p.doc_id = a.doc_id JOIN sizes q ON q.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, p.n, q.n HAVING 100 * count(*) >= 80 * (p.n + q.n - count(*))),
reached AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, l.y FROM reached r JOIN links l ON l.x = r.y),
roots AS (SELECT x, min(y) AS root FROM reached GROUP BY x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, root AS component_id, doc_id = root AS kept
FROM documents JOIN roots ON x = doc_id LEFT JOIN sizes USING (doc_id)
""",
    "op7_suffix_dedup": r"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n FROM documents),
starts AS (SELECT doc_id, h, unnest(range(0, n - 199)) AS s FROM docs WHERE n >= 200),
strings AS (SELECT doc_id, s, md5(substr(h, 2 * s + 1, 400)) AS k FROM starts),
hits AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY k) AS times FROM strings) WHERE times > 1),
cut AS (SELECT doc_id, s, CASE WHEN s - lag(s) OVER (PARTITION BY doc_id ORDER BY s) <= 200 THEN 0 ELSE 1 END AS fresh FROM hits),
spans AS (
  SELECT doc_id, min(s) AS a, max(s) + 200 AS b
  FROM (SELECT doc_id, s, sum(fresh) OVER (PARTITION BY doc_id ORDER BY s) AS g FROM cut) GROUP BY doc_id, g),
pieces AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, a AS q FROM spans
  UNION ALL SELECT doc_id, max(b), NULL FROM spans GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(CASE WHEN q IS NULL THEN substr(h, 2 * p + 1) ELSE substr(h, 2 * p + 1, 2 * (q - p)) END, '' ORDER BY p) AS k
  FROM pieces JOIN docs USING (doc_id) GROUP BY doc_id),
sums AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS gone, CAST(count(*) AS BIGINT) AS runs FROM spans GROUP BY doc_id)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(runs, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM docs LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op9_sharding": r"""
WITH steps AS (
  SELECT list(c ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce(list_prepend(i, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                          lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
docs AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: CAST('0x' || x AS BIGINT)) AS bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key FROM documents),
placed AS (
  SELECT doc_id, size, key,
         xor(list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, b: xor(c // 256, crcs[xor(c % 256, b) + 1])), 4294967295) AS text_crc32,
         CAST(16 * (sum(size) OVER (ORDER BY key) - size) // sum(size) OVER () AS INTEGER) AS shard FROM docs, steps)
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'bytes' AS law, shard,
       CAST(row_number() OVER (PARTITION BY shard ORDER BY key) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed
""",
}

ORACLE_SQL["op12_prefix_trie"] = r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS r,
         coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
steps AS (
  SELECT list(c ORDER BY i) AS crcs FROM (
    SELECT i, list_reduce(list_prepend(i, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
                          lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c
    FROM (SELECT unnest(range(256)) AS i))),
ids AS (
  SELECT conv_id AS c, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
           lambda c, b: xor(c // 256, crcs[xor(c % 256, b) + 1])), 4294967295) % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), steps),
parts AS (
  SELECT c, 0 AS part, r, role, text FROM ids JOIN turns ON conv_id = c - c % 5 AND r < h
  UNION ALL SELECT c, 1, r, role, text FROM ids JOIN turns ON conv_id = c AND r >= h),
rebuilt AS (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, r) AS d, md5(concat(strlen(role), ':', role, text)) AS k, CAST(strlen(text) AS BIGINT) AS b FROM parts),
keyed AS (
  SELECT c, 0 AS d, '' AS prefix, 0::BIGINT AS b FROM ids
  UNION ALL SELECT c, d, string_agg(k, '') OVER (PARTITION BY c ORDER BY d), b FROM rebuilt),
placed AS (SELECT c, d, b, min(c) OVER (PARTITION BY d, prefix) AS m, max(d) OVER (PARTITION BY c) = d AS last FROM keyed),
nodes AS (
  SELECT m, d, count(*) AS n, (count(*) - 1) * max(b) AS saved,
         sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '')) AS ends FROM placed GROUP BY m, d),
linked AS (SELECT n.*, p.m AS parent FROM nodes n LEFT JOIN placed p ON p.c = n.m AND p.d = n.d - 1),
kids AS (SELECT parent AS m, d - 1 AS d, count(*) AS kids FROM linked WHERE parent IS NOT NULL GROUP BY 1, 2),
full_nodes AS (SELECT l.*, coalesce(kids, 0) AS kids FROM linked l LEFT JOIN kids USING (m, d)),
below AS (
  SELECT p.m, p.d, sum(f.saved) AS saved, count(*) FILTER (f.kids = 0) AS leaves
  FROM full_nodes f JOIN placed p ON p.c = f.m AND p.d <= f.d GROUP BY p.m, p.d)
SELECT m AS conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, n AS n_convs, kids AS n_children, leaves AS n_leaves,
       CAST(b.saved AS BIGINT) AS saved_tokens, ends AS ends_sha256
FROM full_nodes f JOIN below b USING (m, d)
"""


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
