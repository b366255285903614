"""Queries over whole runs: both pipelines scored, structured replies, regenerated answers, ids over two sets of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import word_count
from millrace.jobs import evaluate
from millrace.jobs.answers import BASE, CORRECTIVE, MODELS, TERMS, _hits, _share, analyse, library, questions
from millrace.jobs.documents import WORDS
from millrace.jobs.registry import register, table
from millrace.operators import checks
from millrace.operators import corrective as C
from millrace.operators import evaluation as E
from millrace.operators.analysis import analyser
from millrace.sources.shared import shared_dir


def _among(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b})) / nullif(len({a}), 0)"


@register(
    f"""{CORRECTIVE}, qq AS (SELECT *, '' AS want FROM q), {_hits('hb', 'qq', 5)}, fb AS (SELECT question_id, list(text ORDER BY rank) AS texts FROM hb JOIN d USING (chunk_id) GROUP BY question_id),
    s AS (SELECT 'baseline' AS pipeline, question_id, t AS qt, CASE WHEN texts IS NULL THEN 'No relevant documents found.' ELSE split_part(texts[1], chr(10), 1) END AS answer, coalesce(texts, []) AS texts, false AS off FROM q LEFT JOIN fb USING (question_id)
      UNION ALL SELECT 'corrective', question_id, t, CASE WHEN oos OR texts IS NULL THEN 'I cannot answer this question from the available documents.' ELSE split_part(texts[1], chr(10), 1) END, CASE WHEN oos THEN [] ELSE coalesce(texts, []) END, oos OR texts IS NULL FROM a LEFT JOIN k USING (question_id)),
    c AS (SELECT *, {TERMS.format('answer')} AS aw, {TERMS.format("array_to_string(texts, ' ')")} AS ct, list_transform(texts, lambda x: coalesce({_among('qt', TERMS.format('x'))} >= 0.5, false)) AS useful FROM s),
    v AS (SELECT *, coalesce(list_sum(list_transform(range(1, len(useful) + 1), lambda i: CASE WHEN useful[i] THEN len(list_filter(useful[1:i], lambda y: y)) / i ELSE 0 END)) / nullif(len(list_filter(useful, lambda y: y)), 0), 0) AS precise FROM c),
    m AS (SELECT pipeline, question_id, off, unnest(['faithfulness', 'answer_relevancy', 'context_precision_with_reference', 'context_recall']) AS metric,
      unnest([CASE WHEN len(texts) > 0 THEN {_among('aw', 'ct')} END, {_among('qt', 'aw')}, CASE WHEN len(texts) > 0 THEN precise END, CASE WHEN len(texts) > 0 THEN {_among('qt', 'ct')} END]) AS score FROM v),
    w AS (SELECT question_id, metric, max(CASE WHEN pipeline = 'baseline' THEN score END) AS b, max(CASE WHEN pipeline = 'corrective' THEN score END) AS e, bool_or(off) AS off FROM m GROUP BY ALL)
    SELECT metric, round(avg(b), 6) AS baseline_all, round(avg(e), 6) AS enhanced_all, round(avg(b) FILTER (NOT off), 6) AS baseline_answered, round(avg(e) FILTER (NOT off), 6) AS enhanced_answered,
      round(avg(e - b) FILTER (NOT off), 6) AS mean_delta, count(e - b) FILTER (NOT off) AS n_pairs FROM w GROUP BY metric"""
)
def scored_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The items as questions to both pipelines, the stored results scored, and the scores' means; an item is its own expected answer."""
    asked = questions(spark, sf_dir)
    tests = asked.withColumn("category", F.concat(F.lit("c"), (F.col("question_id") % 3).cast("string"))).withColumn("expected_answer", F.col("question"))
    results, scores = evaluate.evaluated(tests, library(spark, sf_dir), shared_dir(spark), MODELS)
    means = E.means(evaluate.wide(scores), evaluate.abstained(results["corrective"]))
    return means.select("metric", *(F.round(c, 6).alias(c) for c in ("baseline_all", "enhanced_all", "baseline_answered", "enhanced_answered", "mean_delta")), "n_pairs")


def _told(question: str) -> dict | str | None:
    """Replies that hold what they should, are odd, broken or lacking, by the question's length."""
    n = len(question) % 7
    if n == 0:
        raise TimeoutError("no reply")
    return [
        None,
        {"document_type": "FSR", "date": f"2024-{1 + len(question) % 12:02d}", "section_category": "inflation", "speaker": "Dr. Ann B. Lee", "out_of_corpus": False},
        {"document_type": "novel", "date": "spring 2024", "section_category": " voting ", "speaker": "", "out_of_corpus": "no"},
        {"document_type": "MPR", "speaker": "Sir John Hill", "out_of_corpus": True},
        '{"document_type": "MPR", ',
        '{"speaker": "Mr. Cole", "date": 202411, "mood": "plain", "section_category": null}',
        "[]",
    ][n]


@register(
    """WITH q AS (SELECT item_id AS question_id, length(text) AS n FROM benchmark)
    SELECT question_id, CASE n % 7 WHEN 1 THEN 'FSR' END AS document_type, CASE n % 7 WHEN 1 THEN '2024-' || lpad(CAST(1 + n % 12 AS VARCHAR), 2, '0') END AS date, CASE n % 7 WHEN 1 THEN 'inflation' WHEN 2 THEN 'voting' END AS section_category,
      CASE n % 7 WHEN 1 THEN 'Ann Lee' WHEN 5 THEN 'Cole' END AS speaker, n % 7 = 3 AS out_of_corpus FROM q"""
)
def question_analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a model in Python, which fails for some questions and replies oddly to others, says that they ask for."""
    return analyser(_told)(questions(spark, sf_dir)).select("question_id", "document_type", "date", "section_category", "speaker", "out_of_corpus")


@register(
    f"""{CORRECTIVE}, f AS (SELECT question_id, length(question) % 3 AS n, top FROM q JOIN k USING (question_id))
    SELECT question_id, CASE n WHEN 1 THEN 'zzqx' ELSE split_part(top, chr(10), 1) END AS answer, CAST(CASE n WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 0 END AS INTEGER) AS failures, n <> 1 AS is_grounded, n <> 2 AS asked_again FROM f"""
)
def regenerated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of which a third are borne out at once, a third when asked again, and a third never."""

    def generate(question, texts, strict: bool):
        n = F.length(question) % 3
        return F.when((n == 1) | ((n == 0) & F.lit(not strict)), "zzqx").otherwise(F.split_part(F.get(texts, F.lit(0)), F.lit("\n"), F.lit(1)))

    found = C.corrective(questions(spark, sf_dir), library(spark, sf_dir), C.Models(analyse=analyse, relevant=MODELS.relevant, generate=generate))
    again = F.size(F.filter("trace", lambda x: x == "generate")) == 2
    return found.filter("is_grounded is not null").select("question_id", "answer", "failures", "is_grounded", again.alias("asked_again"))


@register(
    f"""{BASE} SELECT count(*) FILTER (len(t) >= 15 AND length(question) % 5 = 0) AS n_added, 0 AS n_removed, 1 AS n_missing, 0 AS n_extra, false AS holds FROM q"""
)
def abstain_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The questions that abstain once a grader turns down all chunks of a fifth of them, against those and one more that were expected."""
    asked, docs = questions(spark, sf_dir), library(spark, sf_dir)
    before = C.corrective(asked, docs, C.Models(analyse=analyse, relevant=lambda question, text: F.lit(True)))
    after = C.corrective(asked, docs, C.Models(analyse=analyse, relevant=lambda question, text: F.length(question) % 5 != 0))
    expected = analyse(asked).filter("not out_of_corpus and length(question) % 5 = 0").select("question_id")
    return E.abstain_invariant(before, after, expected.unionByName(spark.range(-1, 0).select(F.col("id").alias("question_id"))))


@register(
    f"""WITH e AS (SELECT doc_id, 'c_' || doc_id AS chunk_id, {WORDS.format('text')} AS w FROM documents), b AS (SELECT CASE WHEN doc_id % 50 = 0 THEN 'c_' ELSE 'b_' END || doc_id AS chunk_id, {WORDS.format('text')} AS w FROM documents)
    SELECT 'unique_chunk_ids' AS check, CASE WHEN max(n) > 1 THEN 'fail' ELSE 'pass' END AS status FROM (SELECT chunk_id, count(*) AS n FROM (SELECT chunk_id FROM e UNION ALL SELECT chunk_id FROM b) GROUP BY chunk_id)
    UNION ALL SELECT 'corpus_token_balance', CASE WHEN (SELECT sum(w) FROM e) / (SELECT sum(w) FROM b) BETWEEN 0.9 AND 1.1 THEN 'pass' ELSE 'warn' END"""
)
def shared_chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sets of chunks, documents each, of which every fiftieth has one id in both."""
    docs = table(spark, sf_dir, "documents").withColumn("token_count", word_count(F.col("text")))
    name = lambda head: F.concat(head, F.col("doc_id").cast("string")).alias("chunk_id")
    plain = docs.select(name(F.when(F.col("doc_id") % 50 == 0, "c_").otherwise("b_")), "token_count")
    return checks.corpus_checks(docs.select("doc_id", name(F.lit("c_")), "token_count"), plain)
