"""The registered queries of the operators, over their whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import shared_dir, table


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_texts")


def op2_licence_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.licences import licences

    found = licences(table(spark, sf_dir, "documents"))
    families = F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"]))), ",")
    return found.select("doc_id", F.size("found").cast("long").alias("n_paragraphs"), families.alias("families"), F.transform("found", lambda x: x["paragraph"]).alias("paragraphs"))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.quality import quality

    return quality(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_left_words")


def op4_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger is written for an earlier version of the table, without the other languages, and extended over the whole."""
    from millrace.llm.secrets import findings, update

    docs, ledger = table(spark, sf_dir, "documents"), shared_dir(spark)
    update(docs.filter("lang = 'es'"), ledger)
    docs = docs.select("doc_id", "text")
    spans = F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return findings(docs, update(docs, ledger)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"))


def op5_rank_merge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.rankmerge import token_counts

    return token_counts(table(spark, sf_dir, "documents"))


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.packing import packed

    return packed(table(spark, sf_dir, "documents"))


def op7_page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.pages import main_texts

    return main_texts(table(spark, sf_dir, "pages"))


def op8_bm25_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.decontaminate import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.linededup import deduplicated

    out = deduplicated(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("clean_text", 256).alias("kept_sha256"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.tokenfiles import read, write

    return read(write(table(spark, sf_dir, "documents")))


def op11_line_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.linecrf import fit, held_out, scored

    docs = table(spark, sf_dir, "documents")
    field = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, field, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_lines", "n_bad_lines")


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"), branches=True)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from millrace.llm.negatives import hard_negatives

    moved = lambda df: df.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, relabel=moved)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_near_duplicates, op2_licence_paragraphs, op3_line_quality, op4_secret_ledger, op5_rank_merge_counts, op6_harmonic_packing, op7_page_texts, op8_bm25_leaks, op9_line_dedup, op10_token_files, op11_line_field, op12_conversation_trie, op13_hard_negatives)}
_SPACE = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLE_SQL: dict[str, str] = {
    "op9_line_dedup": f"""
WITH line AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
  keyed AS (SELECT doc_id, k, line, translate(trim(line, ' ' || {_SPACE}), '{_UPPER}', '{_UPPER.lower()}') AS key FROM line),
  frequent AS (SELECT key AS hit FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(hit) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (hit IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN frequent ON key = hit GROUP BY doc_id""",
    "op3_line_quality": f"""
WITH doc AS (SELECT doc_id, source, coalesce(text, '') AS x, list_filter(string_split(translate(coalesce(text, ''), {_SPACE}, '     '), ' '), lambda w: w <> '') AS w FROM documents),
  line AS (SELECT doc_id, source, x, unnest(string_split(x, chr(10))) AS line FROM doc),
  worded AS (SELECT doc_id, source, x, line, trim(translate(line, {_SPACE}, '     ')) AS bare FROM line),
  keyed AS (SELECT *, translate(lower(bare), '123456789', '000000000') AS key FROM worded WHERE bare <> ''),
  host AS (SELECT source, count(*) AS of FROM doc GROUP BY source),
  common AS (SELECT source, key, true AS hit FROM (SELECT source, key, count(DISTINCT doc_id) AS n, count(DISTINCT x) AS texts FROM keyed GROUP BY source, key) JOIN host USING (source) WHERE n >= 5 AND texts >= 2 AND n > 0.1 * of),
  left_ AS (SELECT doc_id, sum(len(list_filter(string_split(bare, ' '), lambda w: w <> ''))) FILTER (hit IS NULL) AS n FROM keyed LEFT JOIN common USING (source, key) GROUP BY doc_id),
  dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM keyed GROUP BY doc_id),
  three AS (SELECT doc_id, k, w[k] || ' ' || w[k + 1] || ' ' || w[k + 2] AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS k FROM doc)),
  twice AS (SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, t) AS c FROM three) WHERE c > 1),
  covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS p FROM twice) GROUP BY doc_id),
  facts AS (SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(x, ' ' || {_SPACE}, '')) AS BIGINT) AS word_chars, CAST(length(x) - length(translate(x, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words, CAST(coalesce(left_.n, 0) AS BIGINT) AS n_left_words
    FROM doc d LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN left_ USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_left_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_left_words >= 0.2 * n_words AS kept FROM facts""",
    "op12_conversation_trie": f"""
WITH turn_ AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS k FROM conversations WHERE conv_id IS NOT NULL),
  crc AS (SELECT conv_id, count(*) AS own, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS UBIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), list_transform(range(8), lambda i: CAST(i AS UBIGINT))), lambda v, i: xor(v >> 1, (v & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT) % 4 AS h FROM turn_ GROUP BY conv_id),
  conv AS (SELECT c.conv_id, c.h, least(c.h, coalesce(b.own, 0)) AS taken FROM crc c LEFT JOIN crc b ON b.conv_id = c.conv_id - c.conv_id % 20),
  path AS (SELECT c.conv_id, k + 1 AS depth, role, text FROM conv c JOIN turn_ t ON t.conv_id = c.conv_id - c.conv_id % 20 AND k < taken
    UNION ALL SELECT c.conv_id, k + 1 - h + taken, role, text FROM conv c JOIN turn_ t ON t.conv_id = c.conv_id AND k >= h),
  named AS (SELECT conv_id, CAST(depth AS BIGINT) AS depth, text, string_agg(sha256(length(role) || ':' || role || text), ',') OVER (PARTITION BY conv_id ORDER BY depth) AS name FROM path
    UNION ALL SELECT conv_id, 0, '', '' FROM conv),
  last_ AS (SELECT conv_id, max(depth) AS n FROM named GROUP BY conv_id),
  node AS (SELECT depth, name, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(text) AS text, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (depth = n), '')) AS ends_sha256 FROM named JOIN last_ USING (conv_id) GROUP BY depth, name),
  child AS (SELECT n.conv_id, n.depth, p.conv_id AS parent FROM node n JOIN named a ON a.conv_id = n.conv_id AND a.depth = n.depth - 1 JOIN node p ON p.depth = a.depth AND p.name = a.name),
  counted AS (SELECT parent AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM child GROUP BY ALL),
  fact AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.depth = 0 THEN 0 ELSE (n_convs - 1) * len(list_filter(string_split(translate(text, {_SPACE}, '     '), ' '), lambda w: w <> '')) END AS saving FROM node n LEFT JOIN counted USING (conv_id, depth)),
  below AS (SELECT a.depth, a.name, count(*) FILTER (n_children = 0) AS n_leaves, sum(saving) AS saved FROM fact f JOIN named a ON a.conv_id = f.conv_id AND a.depth <= f.depth GROUP BY ALL)
SELECT f.conv_id, f.depth, parent AS parent_conv_id, n_convs, n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256 FROM fact f JOIN below USING (depth, name) LEFT JOIN child c ON c.conv_id = f.conv_id AND c.depth = f.depth""",
    "op13_hard_negatives": """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  s AS (SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 100 = 0),
  p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
  n AS (SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5""",
}
