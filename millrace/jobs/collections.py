"""Queries over vector collections, batches and stored records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.jobs.documents import WORDS
from millrace.jobs.registry import register, table
from millrace.operators import evaluation, vectors
from millrace.sources.shared import Steps
from millrace.streaming.ingest import sessions as runs

COSINE = "list_cosine_similarity(CAST({0} AS DOUBLE[]), CAST({1} AS DOUBLE[]))"


def _first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter("vec_id = 0").first()["embedding"]


@register(f"SELECT vec_id, round(raw, 4) AS score FROM (SELECT e.vec_id, {COSINE.format('e.embedding', 'q.embedding')} AS raw FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY raw DESC, e.vec_id LIMIT 5)")
def nearest_five(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 5)


@register(f"SELECT vec_id, round(raw, 4) AS score FROM (SELECT e.vec_id, {COSINE.format('e.embedding', 'q.embedding')} AS raw FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3 ORDER BY raw DESC, e.vec_id LIMIT 10)")
def nearest_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.nearest(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 10, {"label": 3, "speaker": None, "date": ""})


@register(
    f"""SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(raw, 4) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id, {COSINE.format('c.embedding', 'q.embedding')} AS raw FROM embeddings c, embeddings q
    WHERE q.vec_id % 100 = 0 AND (q.vec_id % 200 = 0 OR c.label = q.label))) WHERE rank <= 5"""
)
def nearest_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated queries against all vectors; every second one asks for its own label only."""
    all_ = table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("string"))
    own = F.when(F.col("vec_id") % 200 == 0, "").otherwise(F.col("label"))
    queries = all_.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"), own.alias("label"))
    return vectors.nearest_batch(all_, queries, 5, ["label"])


@register(
    f"""SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(raw, 4) AS score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY raw DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, c.vec_id, {COSINE.format('c.embedding', 'q.embedding')} AS raw FROM embeddings c, embeddings q
    WHERE q.vec_id % 100 = 0 AND q.vec_id % 7 <> 0 AND q.vec_id % 11 <> 0 AND c.vec_id % 7 <> 0 AND c.vec_id % 11 <> 0)) WHERE rank <= 3"""
)
def nearest_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of which some are null or have no length, as records and as queries."""
    own = F.when(F.col("vec_id") % 11 == 0, None).when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda x: x * F.lit(0).cast("float"))).otherwise(F.col("embedding"))
    all_ = table(spark, sf_dir, "embeddings").select("vec_id", own.alias("embedding"))
    queries = all_.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    return vectors.nearest_batch(all_, queries, 3)


@register("SELECT (SELECT count(*) FROM embeddings) AS n_rows, (SELECT count(*) FROM embeddings WHERE vec_id % 100 = 0) AS n_queries, true AS enough, true AS all_cells_exact")
def cell_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors in cells, and the stated queries among a part of the cells and among all, against exact search: recall of 0.9, and of 1."""
    rows = table(spark, sf_dir, "embeddings")
    queries = rows.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    cells = vectors.fit_cells(rows)
    with Steps(spark) as steps:
        stored = steps.keep(vectors.in_cells(rows, cells))
        exact = vectors.nearest_batch(rows, queries, 10)
        part = vectors.recall(vectors.nearest_in_cells(stored, cells, queries, 10, max(1, -(-len(cells) * 3 // 4))), exact)
        whole = vectors.recall(vectors.nearest_in_cells(stored, cells, queries, 10, len(cells)), exact)
        counts = stored.agg(F.count("cell").alias("n_rows"))
        return steps.finish(counts.join(F.broadcast(queries.agg(F.count("*").alias("n_queries")))).select("n_rows", "n_queries", F.lit(part >= 0.9).alias("enough"), F.lit(whole == 1.0).alias("all_cells_exact")))


@register(
    """SELECT vec_id, label, sha256(CAST(vec_id AS VARCHAR) || ':' || CAST(label AS VARCHAR)) AS mark FROM (
    SELECT vec_id, label FROM embeddings WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, label + 100 FROM embeddings WHERE vec_id % 3 = 0)"""
)
def upserted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    new = old.filter("vec_id % 3 = 0").withColumn("label", F.col("label") + 100)
    return vectors.upsert(old, new, "vec_id").withColumn("mark", F.sha2(F.concat_ws(":", F.col("vec_id").cast("string"), F.col("label").cast("string")), 256))


@register("SELECT label, count(*) FILTER (vec_id % 4 = 0) AS n_changed FROM embeddings GROUP BY label HAVING count(*) FILTER (vec_id % 4 = 0) > 0")
def changed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    old = new.filter("vec_id % 8 <> 0").withColumn("label", F.when(F.col("vec_id") % 4 == 0, F.col("label") + 1).otherwise(F.col("label")))
    return vectors.changed(old, new, "vec_id", ["label"]).groupBy("label").agg(F.count("*").alias("n_changed"))


@register(
    f"""WITH RECURSIVE r AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k, {WORDS.format('text')} AS w FROM documents),
    fold AS (SELECT source, k, 0 AS batch, w AS size, 1 AS records FROM r WHERE k = 1
    UNION ALL SELECT r.source, r.k, f.batch + CASE WHEN f.size + r.w > 30000 OR f.records >= 100 THEN 1 ELSE 0 END,
      CASE WHEN f.size + r.w > 30000 OR f.records >= 100 THEN r.w ELSE f.size + r.w END, CASE WHEN f.size + r.w > 30000 OR f.records >= 100 THEN 1 ELSE f.records + 1 END
      FROM fold f JOIN r ON r.source = f.source AND r.k = f.k + 1)
    SELECT source, CAST(batch AS INTEGER) AS batch, CAST(max(records) AS INTEGER) AS records, CAST(max(size) AS BIGINT) AS words FROM fold GROUP BY source, batch"""
)
def embedding_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.batches(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


@register("SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) = 1")
def last_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return evaluation.last_write(events, ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@register(
    """SELECT user_id, count(*) AS n_sessions, max(n) AS longest FROM (SELECT user_id, s, count(*) AS n FROM (
    SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
    SELECT user_id, ts, event_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s) GROUP BY user_id"""
)
def user_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs(table(spark, sf_dir, "events"))
    return found.groupBy("user_id").agg(F.count("*").alias("n_sessions"), F.max("n").alias("longest"))
