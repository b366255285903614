"""Queries that answer the benchmark's items from the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.jobs.ask import ask
from millrace.jobs.registry import register, table
from millrace.operators import corrective as C
from millrace.operators.collection import search
from millrace.operators.retrieval import holders, retrieve, share, terms

TERMS = r"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\s]+', ' ', 'g'), '\s+'), lambda w: w <> ''))"
#: Term counts of each question and document, and the documents in order for each question.
BASE = f"""WITH q AS (SELECT item_id AS question_id, text AS question, {TERMS.format('text')} AS t FROM benchmark),
  d AS (SELECT CAST(doc_id AS VARCHAR) AS chunk_id, text, lang, {TERMS.format('text')} AS t FROM documents),
  dt AS (SELECT chunk_id, lang, unnest(t) AS term FROM d)"""


def _hits(name: str, questions: str, k: int, more: str = "") -> str:
    return f"""{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY hits DESC, chunk_id) AS rank FROM (
      SELECT question_id, any_value(n) AS n, chunk_id, count(*) AS hits FROM (SELECT question_id, len(t) AS n, unnest(t) AS term, want FROM {questions}) JOIN dt USING (term) {more} GROUP BY question_id, chunk_id)) WHERE rank <= {k})"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"))


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a chunk; its language stands for a document type."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("chunk_id"), "text", F.col("lang").alias("document_type"))


@register(f"{BASE}, qq AS (SELECT *, '' AS want FROM q), {_hits('h', 'qq', 10)} SELECT question_id, chunk_id, CAST(rank AS INTEGER) AS rank, round(hits / n, 4) AS score FROM h")
def lexical_top_ten(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = questions(spark, sf_dir).withColumn("rewritten", F.lit(None).cast("string"))
    return retrieve(asked, library(spark, sf_dir), 10).select("question_id", "chunk_id", "rank", "score")


@register(
    f"""{BASE}, qq AS (SELECT *, '' AS want FROM q), {_hits('h', 'qq', 5)}, f AS (SELECT question_id, count(*) AS n, max(CASE WHEN rank = 1 THEN text END) AS top FROM h JOIN d USING (chunk_id) GROUP BY question_id)
    SELECT question_id, CASE WHEN n IS NULL THEN 'No relevant documents found.' ELSE split_part(top, chr(10), 1) END AS answer, coalesce(n, 0) AS chunks_retrieved,
    CASE WHEN n IS NULL THEN 'retrieve' ELSE 'retrieve,generate' END AS trace FROM q LEFT JOIN f USING (question_id)"""
)
def baseline_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.baseline(questions(spark, sf_dir), library(spark, sf_dir))
    return found.select("question_id", "answer", "chunks_retrieved", F.array_join("trace", ",").alias("trace"))


def analyse(asked: DataFrame) -> DataFrame:
    """A plain analysis: items that hold a few words are out of scope, others ask for English or any documents."""
    words = terms(F.col("question"))
    return asked.withColumn("out_of_corpus", F.size(words) < 15).withColumn("document_type", F.when(F.array_contains(words, "the"), "en"))


MODELS = C.Models(analyse=analyse, relevant=lambda question, text: share(question, text) >= 0.6)


def _share(a: str, b: str) -> str:
    return f"coalesce(len(list_intersect({a}, {b})) / nullif(len({a}), 0), 0)"


#: The steps of the corrective pipeline under these models: analysis (a), chunks by place (p), what each question rests on (k), and how many it found (n).
CORRECTIVE = f"""{BASE}, a AS (SELECT *, len(t) < 15 AS oos, CASE WHEN list_contains(t, 'the') THEN 'en' ELSE '' END AS want FROM q),
    i AS (SELECT * FROM a WHERE NOT oos), {_hits('h1', 'i', 10, "WHERE want = '' OR want = lang")},
    g1 AS (SELECT h1.question_id, chunk_id, rank, {_share('i.t', 'd.t')} AS value FROM h1 JOIN i USING (question_id) JOIN d USING (chunk_id) WHERE {_share('i.t', 'd.t')} >= 0.6),
    r AS (SELECT question_id, question, want, t AS own, list_filter(t, lambda w: length(w) > 3) AS rt FROM i WHERE question_id NOT IN (SELECT question_id FROM g1)),
    rr AS (SELECT question_id, CASE WHEN len(rt) > 0 THEN rt ELSE rt END AS t, want FROM r), {_hits('h2', 'rr', 10)},
    g2 AS (SELECT h2.question_id, chunk_id, rank, {_share('r.rt', 'd.t')} AS value FROM h2 JOIN r USING (question_id) JOIN d USING (chunk_id) WHERE {_share('r.own', 'd.t')} >= 0.6),
    g AS (SELECT *, 0 AS rewrites FROM g1 UNION ALL SELECT *, 1 FROM g2),
    p AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(value, 6) DESC, rank) AS place FROM g),
    k AS (SELECT question_id, any_value(rewrites) AS rewrites, least(count(*), 5) AS used, max(CASE WHEN place = 1 THEN text END) AS top, max(CASE WHEN place = 1 THEN chunk_id END) AS top_id, list(text ORDER BY place) FILTER (place <= 5) AS texts,
      {TERMS.format("string_agg(text, ' ') FILTER (place <= 5)")} AS ctx FROM p JOIN d USING (chunk_id) GROUP BY question_id),
    n AS (SELECT question_id, count(*) AS got FROM (SELECT question_id, chunk_id FROM h1 WHERE question_id NOT IN (SELECT question_id FROM r) UNION ALL SELECT question_id, chunk_id FROM h2) GROUP BY question_id)"""


@register(
    f"""{CORRECTIVE}
    SELECT question_id, CASE WHEN oos OR used IS NULL THEN 'I cannot answer this question from the available documents.' ELSE split_part(top, chr(10), 1) END AS answer,
    CASE WHEN oos THEN 0 ELSE coalesce(got, 0) END AS chunks_retrieved, coalesce(used, 0) AS chunks_used, CAST(CASE WHEN oos THEN 0 WHEN used IS NULL THEN 1 ELSE rewrites END AS INTEGER) AS rewrites,
    CASE WHEN used IS NOT NULL THEN true END AS is_grounded, top_id,
    CASE WHEN oos THEN 'analyze_query,abstain_out_of_corpus' ELSE 'analyze_query,retrieve,grade_documents,' || CASE WHEN used IS NULL THEN 'rewrite_query,retrieve,grade_documents,abstain'
      ELSE CASE rewrites WHEN 1 THEN 'rewrite_query,retrieve,grade_documents,' ELSE '' END || 'rerank,generate,check_hallucination' END END AS trace
    FROM a LEFT JOIN k USING (question_id) LEFT JOIN n USING (question_id)"""
)
def corrective_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = C.corrective(questions(spark, sf_dir), library(spark, sf_dir), MODELS)
    return found.select("question_id", "answer", "chunks_retrieved", "chunks_used", "rewrites", "is_grounded", F.get("post_rerank_ids", F.lit(0)).alias("top_id"), F.array_join("trace", ",").alias("trace"))


@register(
    """SELECT item_id, count(doc_id) AS n_docs, min(doc_id) AS first_doc FROM (SELECT item_id, b.text FROM benchmark b) q LEFT JOIN documents d ON contains(d.text, q.text) GROUP BY item_id"""
)
def item_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold an item, wherever in their text."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("item"))
    hits = holders(items, docs).groupBy("item_id").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
    return items.select("item_id").join(hits, "item_id", "left").select("item_id", F.coalesce("n", F.lit(0)).alias("n_docs"), "first_doc")


@register(
    f"""{BASE}, v AS (SELECT item_id AS question_id, CASE WHEN item_id % 9 = 0 THEN '' ELSE trim(text) END AS question FROM benchmark),
    qq AS (SELECT question_id, {TERMS.format('question')} AS t, '' AS want FROM v WHERE question <> ''), {_hits('h', 'qq', 5)},
    f AS (SELECT question_id, max(CASE WHEN rank = 1 THEN text END) AS top FROM h JOIN d USING (chunk_id) GROUP BY question_id),
    a AS (SELECT question_id, question, CASE WHEN top IS NULL THEN 'No relevant documents found.' ELSE split_part(top, chr(10), 1) END AS answer FROM v LEFT JOIN f USING (question_id))
    SELECT question_id, CASE WHEN question <> '' THEN substring(answer, 1, 200) END AS answer_preview, CASE WHEN question <> '' THEN false END AS is_abstain, CASE WHEN question = '' THEN 'blank' END AS error FROM a"""
)
def question_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses to the items, some of which were left blank."""
    asked = questions(spark, sf_dir).withColumn("question", F.when(F.col("question_id") % 9 == 0, "  ").otherwise(F.col("question")))
    return ask(asked, library(spark, sf_dir), "baseline").select("question_id", "answer_preview", "is_abstain", "error")


def _odd(question: str, texts: list[str], strict: bool) -> str:
    if len(question) % 5 == 0:
        raise ValueError(f"length {len(question)}")
    return texts[0].split("\n", 1)[0]


@register(
    f"""{BASE}, qq AS (SELECT *, '' AS want FROM q), {_hits('h', 'qq', 5)}, f AS (SELECT question_id, count(*) AS n, max(CASE WHEN rank = 1 THEN text END) AS top FROM h JOIN d USING (chunk_id) GROUP BY question_id),
    a AS (SELECT question_id, n, top, length(question) AS size, n IS NOT NULL AND length(question) % 5 = 0 AS bad FROM q LEFT JOIN f USING (question_id))
    SELECT question_id, CASE WHEN n IS NULL THEN 'No relevant documents found.' WHEN bad THEN '[Pipeline error: ValueError: length ' || size || ']' ELSE split_part(top, chr(10), 1) END AS answer,
    CASE WHEN bad THEN 0 ELSE coalesce(n, 0) END AS chunks_used, CASE WHEN bad THEN 'error' WHEN n IS NULL THEN 'retrieve' ELSE 'retrieve,generate' END AS trace FROM a"""
)
def answers_with_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model in Python that fails for some questions, each of which gets an error row."""
    found = C.baseline(questions(spark, sf_dir), library(spark, sf_dir), C.Models(generate=C.guarded(_odd)))
    return found.select("question_id", "answer", "chunks_used", F.array_join("trace", ",").alias("trace"))


VECTORS = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label, text FROM embeddings JOIN documents ON vec_id = doc_id),
  n AS (SELECT question_id, vec_id, text, question, raw, row_number() OVER (PARTITION BY question_id ORDER BY raw DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS question_id, e.vec_id, e.text, q.text AS question, list_cosine_similarity(e.v, q.v) AS raw FROM e, e q WHERE q.vec_id % 100 = 0{}))"""


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, C.Retriever]:
    """Questions that are documents' texts, the documents with their vectors as records, and search among them."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("label").cast("string").alias("document_type"))
    records = vectors.join(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    asked = records.filter("id % 100 = 0").select(F.col("id").alias("question_id"), F.col("text").alias("question"), "document_type")
    embed = lambda df: df.join(vectors.select(F.col("id").alias("question_id"), "embedding"), "question_id")
    return asked, records, lambda who, k, filters: search(records, embed, who, k, filters)


@register(
    VECTORS.format("") + """ SELECT question_id, split_part(max(CASE WHEN rank = 1 THEN text END), chr(10), 1) AS answer, count(*) AS chunks_used, 'retrieve,generate' AS trace FROM n WHERE rank <= 5 GROUP BY question_id"""
)
def vector_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plain pipeline over vectors."""
    asked, _, search_ = _vectors(spark, sf_dir)
    found = C.baseline(asked, None, search=search_)
    return found.select("question_id", "answer", "chunks_used", F.array_join("trace", ",").alias("trace"))


@register(
    VECTORS.format(" AND e.label = q.label") + f""", t AS (SELECT question_id, vec_id, rank, {TERMS.format('question')} AS qt, {TERMS.format('text')} AS dt FROM n WHERE rank <= 10),
    g AS (SELECT question_id, vec_id, rank, {_share('qt', 'dt')} AS value FROM t WHERE {_share('qt', 'dt')} >= 0.5),
    p AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(value, 6) DESC, rank) AS place FROM g)
    SELECT question_id, max(CASE WHEN place = 1 THEN vec_id END) AS top_id, least(count(*), 5) AS chunks_used, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY place) FILTER (place <= 5) AS ids FROM p GROUP BY question_id"""
)
def corrective_vector_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corrective pipeline over vectors, each question among records of its own label."""
    asked, _, search_ = _vectors(spark, sf_dir)
    labels = asked.select("question_id", "document_type")
    models = C.Models(analyse=lambda df: df.join(labels, "question_id"))
    found = C.corrective(asked, None, models, search_, ["document_type"])
    ids = F.array_join(F.transform("post_rerank_ids", lambda x: x.cast("string")), ",")
    return found.select("question_id", F.get("post_rerank_ids", F.lit(0)).cast("long").alias("top_id"), "chunks_used", ids.alias("ids"))
