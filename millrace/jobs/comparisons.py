"""Queries that compare two sides: means, plans, ranks, divergences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.jobs.registry import register, table
from millrace.operators import evaluation, paired


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "doc_id")


@register("SELECT source AS category, avg(quality) AS mean, count(*) AS n FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND source IS NOT NULL GROUP BY source")
def category_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.category_means(_labelled(spark, sf_dir).select(F.col("source").alias("category"), F.col("quality").alias("score")))


@register(
    """SELECT category, greatest(coalesce(nb, 0), coalesce(ne, 0)) AS n, b AS baseline, e AS enhanced, e - b AS delta FROM
    (SELECT lang AS category, avg(quality) AS b, count(*) AS nb FROM labels JOIN documents USING (doc_id) WHERE lang <> 'de' GROUP BY lang) x
    FULL JOIN (SELECT lang AS category, avg(toxic) AS e, count(*) AS ne FROM labels JOIN documents USING (doc_id) WHERE lang <> 'fr' GROUP BY lang) y USING (category)"""
)
def category_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    side = lambda score, without: rows.filter(F.col("lang") != without).select(F.col("lang").alias("category"), F.col(score).alias("score"))
    return evaluation.category_comparison(side("quality", "de"), side("toxic", "fr"))


@register(
    """WITH s AS (SELECT doc_id, lang AS metric, CAST(CASE WHEN doc_id % 7 = 0 THEN NULL ELSE quality END AS DOUBLE) AS b, CAST(CASE WHEN doc_id % 11 = 0 THEN NULL ELSE toxic END AS DOUBLE) AS e FROM labels JOIN documents USING (doc_id))
    SELECT metric, avg(b) AS baseline_all, avg(e) AS enhanced_all, avg(CASE WHEN doc_id % 5 <> 0 THEN b END) AS baseline_answered, avg(CASE WHEN doc_id % 5 <> 0 THEN e END) AS enhanced_answered,
    avg(CASE WHEN doc_id % 5 <> 0 THEN e - b END) AS mean_delta, count(CASE WHEN doc_id % 5 <> 0 THEN e - b END) AS n_pairs FROM s GROUP BY metric"""
)
def answered_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all labelled rows, some of them missing on a side, and the rows that abstained left out."""
    rows = _labelled(spark, sf_dir)
    side = lambda score, k: F.when(F.col("doc_id") % k == 0, None).otherwise(F.col(score)).cast("double")
    scores = rows.select(F.col("doc_id").alias("question_id"), F.col("lang").alias("metric"), side("quality", 7).alias("baseline"), side("toxic", 11).alias("enhanced"))
    return evaluation.means(scores, rows.filter("doc_id % 5 = 0").select(F.col("doc_id").alias("question_id")))


@register(
    """WITH p AS (SELECT doc_id AS question_id, unnest(['faithfulness', 'answer_relevancy', 'context_precision_with_reference', 'context_recall']) AS metric, n_chars > 500 AS ctx FROM documents)
    SELECT metric, skipped, count(*) AS n FROM (SELECT metric, CASE WHEN metric <> 'answer_relevancy' AND NOT ctx THEN 'abstain' END AS skipped FROM p
    WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = p.question_id AND p.metric IN ('faithfulness', 'context_recall'))) GROUP BY metric, skipped"""
)
def scoring_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left to score, by metric: documents without a label, for which two metrics are done."""
    rows = table(spark, sf_dir, "documents").select(F.lit("baseline").alias("pipeline"), F.col("doc_id").alias("question_id"), (F.col("n_chars") > 500).alias("has_context"))
    metrics = F.explode(F.array(F.lit("faithfulness"), F.lit("context_recall")))
    done = table(spark, sf_dir, "labels").select(F.lit("baseline").alias("pipeline"), F.col("doc_id").alias("question_id"), metrics.alias("metric"), F.lit(None).cast("string").alias("err"))
    return evaluation.scoring_plan(rows, evaluation.METRICS, done).groupBy("metric", "skipped").agg(F.count("*").alias("n"))


@register(
    """WITH d AS (SELECT source, CAST(toxic - quality AS DOUBLE) * (1 + n_chars % 3) AS d FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL),
    s AS (SELECT source, abs(d) AS size, count(*) AS t, count(*) FILTER (d < 0) AS below, count(*) FILTER (d = 0) AS zero FROM d GROUP BY source, abs(d)),
    r AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (t + 1) / 2.0 AS rank FROM s)
    SELECT source, CAST(sum(t) AS BIGINT) AS n, CAST(sum(rank * (below + zero / 2.0)) AS DOUBLE) AS w, CAST(sum(t) * (sum(t) + 1) * (2 * sum(t) + 1) / 24.0 - sum(t * t * t - t) / 48.0 AS DOUBLE) AS variance FROM r GROUP BY source"""
)
def signed_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    scaled = _labelled(spark, sf_dir).withColumn("a", F.lit(0.0)).withColumn("b", (F.col("toxic") - F.col("quality")).cast("double") * (1 + F.col("n_chars") % 3))
    found = paired.signed_ranks(paired.differences(scaled, "source", "a", "b"), "source")
    return found.select("source", "n", F.col("w").cast("double").alias("w"), F.col("variance").cast("double").alias("variance"))


@register()
def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the paired difference by source; SQL has no bootstrap."""
    rows = _labelled(spark, sf_dir).withColumn("b", F.col("quality").cast("double")).withColumn("e", F.col("toxic").cast("double"))
    return paired.bootstrap(paired.differences(rows, "source", "b", "e"), "source")


@register(
    """WITH p AS (SELECT source AS name, avg(quality) AS p FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL GROUP BY source),
    s AS (SELECT name, p, (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1) * p AS scaled FROM p)
    SELECT name, p, least(1.0, max(scaled) OVER (ORDER BY p, name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS adjusted FROM s"""
)
def holm_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = _labelled(spark, sf_dir).filter("quality is not null").groupBy(F.col("source").alias("name")).agg(F.avg("quality").alias("p"))
    return evaluation.holm(tests, "name", "p")


@register(
    """WITH d AS (SELECT round(abs(CAST(quality AS DOUBLE) - (n_chars % 10) / 10.0), 4) AS diff FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL),
    o AS (SELECT diff, row_number() OVER (ORDER BY diff) - 1 AS k, count(*) OVER () AS n FROM d)
    SELECT max(n) AS n, max(diff) AS max_diff, avg(diff) AS mean_diff, max(CASE WHEN k = n // 2 THEN diff END) AS median_diff, CASE WHEN max(diff) < 0.15 THEN 'minor' WHEN max(diff) < 0.30 THEN 'moderate' ELSE 'material' END AS verdict FROM o"""
)
def judge_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _labelled(spark, sf_dir)
    a = rows.select("doc_id", F.col("quality").cast("double").alias("score"))
    b = rows.select("doc_id", ((F.col("n_chars") % 10) / 10.0).alias("score"))
    return evaluation.divergence_summary(evaluation.judge_divergence(a, b, ["doc_id"]))


@register(
    """SELECT doc_id, 'added' AS change FROM (SELECT doc_id FROM labels WHERE toxic = 1 EXCEPT SELECT doc_id FROM labels WHERE quality = 0)
    UNION ALL SELECT doc_id, 'removed' FROM (SELECT doc_id FROM labels WHERE quality = 0 EXCEPT SELECT doc_id FROM labels WHERE toxic = 1)"""
)
def abstain_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels")
    return evaluation.set_delta(labels.filter("quality = 0").select("doc_id"), labels.filter("toxic = 1").select("doc_id"), "doc_id")


@register("SELECT quality = 1 AS expected, n_chars > 1000 AS actual, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2")
def scope_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = _labelled(spark, sf_dir).select((F.col("quality") == 1).alias("expected"), (F.col("n_chars") > 1000).alias("actual"))
    return evaluation.confusion(flags, "expected", "actual")


@register(
    """WITH r AS (SELECT doc_id, CAST(doc_id % 5 = 0 AS INTEGER) AS rw, CASE WHEN doc_id % 7 = 0 THEN 1 ELSE 0 END AS fl, CASE WHEN doc_id % 6 = 0 THEN NULL ELSE doc_id % 13 <> 0 END AS ok,
      doc_id % 6 = 0 AS ab, doc_id % 3 = 0 AS flt, n_chars % 11 AS got, n_chars % 6 AS used, doc_id % 4 AS top, doc_id % 12 = 0 AS should FROM documents)
    SELECT count(*) AS n_queries, count(*) FILTER (rw > 0) / count(*) AS rewrite_trigger_rate, count(*) FILTER (rw > 0 AND NOT ab) / nullif(count(*) FILTER (rw > 0), 0) AS rewrite_recovery_rate,
    count(*) FILTER (ok IS NOT DISTINCT FROM false) / count(*) AS hallucination_flag_rate, count(*) FILTER (fl > 0 AND ok IS NOT DISTINCT FROM true) / nullif(count(*) FILTER (fl > 0), 0) AS hallucination_recovery_rate,
    count(*) FILTER (flt) / count(*) AS filter_rate, avg(got) AS mean_chunks_retrieved, avg(used) AS mean_chunks_used, count(*) FILTER (top > 0 AND top <> 1) / nullif(count(*) FILTER (top > 0), 0) AS rerank_top1_change_rate,
    count(*) FILTER (ab) / count(*) AS abstain_rate, count(*) FILTER (ab AND should) / nullif(count(*) FILTER (ab), 0) AS abstain_precision, count(*) FILTER (ab AND should) / nullif(count(*) FILTER (should), 0) AS abstain_recall,
    count(*) FILTER (should AND NOT ab) AS n_missed_abstains FROM r"""
)
def corrective_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loop's rates over results made of each document's numbers."""
    k = F.col("doc_id")
    top = k % 4
    ids = F.array(F.lit("1"), F.lit("2"))
    none = F.array().cast("array<string>")
    results = table(spark, sf_dir, "documents").select(
        k.alias("question_id"), (k % 5 == 0).cast("int").alias("rewrites"), F.when(k % 7 == 0, 1).otherwise(0).alias("failures"), F.when(k % 6 == 0, None).otherwise(k % 13 != 0).alias("is_grounded"),
        F.when(k % 6 == 0, F.array(F.lit("analyze_query"), F.lit("abstain"))).otherwise(F.array(F.lit("generate"))).alias("trace"), F.when(k % 3 == 0, "x").alias("filters"),
        (F.col("n_chars") % 11).alias("chunks_retrieved"), (F.col("n_chars") % 6).alias("chunks_used"), F.when(top > 0, ids).otherwise(none).alias("pre_rerank_ids"), F.when(top > 0, F.array(top.cast("string"))).otherwise(none).alias("post_rerank_ids"),
    )
    return evaluation.corrective_rates(results, results.filter("question_id % 12 = 0").select("question_id"))


TERMS = r"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}\s]+', ' ', 'g'), '\s+'), lambda w: w <> ''))"
_share = lambda a, b: f"len(list_intersect({a}, {b})) / nullif(len({a}), 0)"


@register(
    f"""WITH c AS (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS question, arg_min(text, turn) FILTER (role = 'assistant') AS answer,
      list(text ORDER BY turn) FILTER (role = 'user') AS contexts, arg_max(text, turn) AS reference FROM conversations GROUP BY conv_id),
    r AS (SELECT conv_id, conv_id % 10 = 0 AS bare, contexts, {TERMS.format('question')} AS q, {TERMS.format('answer')} AS a, {TERMS.format("array_to_string(contexts, ' ')")} AS x, {TERMS.format('reference')} AS ref
      FROM c WHERE question IS NOT NULL AND answer IS NOT NULL),
    f AS (SELECT conv_id, i, coalesce({_share('ref', 't')} >= 0.5, false) AS hit FROM (SELECT conv_id, ref, i, {TERMS.format('context')} AS t FROM (SELECT conv_id, ref, unnest(contexts) AS context, generate_subscripts(contexts, 1) AS i FROM r))),
    p AS (SELECT conv_id, avg(so_far / i) FILTER (hit) AS score FROM (SELECT *, sum(CAST(hit AS INT)) OVER (PARTITION BY conv_id ORDER BY i) AS so_far FROM f) GROUP BY conv_id),
    m AS (SELECT conv_id, 'faithfulness' AS metric, bare, {_share('a', 'x')} AS score FROM r UNION ALL SELECT conv_id, 'answer_relevancy', false, {_share('q', 'a')} FROM r
      UNION ALL SELECT conv_id, 'context_precision_with_reference', bare, coalesce(p.score, 0) FROM r JOIN p USING (conv_id) UNION ALL SELECT conv_id, 'context_recall', bare, {_share('ref', 'x')} FROM r)
    SELECT conv_id AS question_id, metric, CASE WHEN NOT bare THEN round(score, 9) END AS score, CASE WHEN bare THEN 'abstain' END AS skipped FROM m"""
)
def metric_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations scored by all four metrics: the first answer to the first question, what the user said as context, the last turn as reference."""
    said = table(spark, sf_dir, "conversations")
    user, reply = F.col("role") == "user", F.col("role") == "assistant"
    ordered = F.array_sort(F.collect_list(F.when(user, F.struct("turn", "text"))))
    rows = said.groupBy("conv_id").agg(
        F.min_by("text", F.when(user, F.col("turn"))).alias("question"), F.min_by("text", F.when(reply, F.col("turn"))).alias("answer"),
        F.transform(ordered, lambda x: x["text"]).alias("contexts"), F.max_by("text", "turn").alias("reference"), F.count_if(user).alias("users"), F.count_if(reply).alias("replies"),
    )
    rows = rows.filter("users > 0 and replies > 0").withColumn("contexts", F.when(F.col("conv_id") % 10 == 0, F.array().cast("array<string>")).otherwise(F.col("contexts")))
    rows = rows.select(F.lit("talk").alias("pipeline"), F.col("conv_id").alias("question_id"), "question", "answer", "contexts", "reference")
    done = rows.limit(0).select("pipeline", "question_id", F.lit("").alias("metric"), F.lit("").alias("err"))
    plan = evaluation.scoring_plan(rows.withColumn("has_context", F.size("contexts") > 0), evaluation.METRICS, done)
    return evaluation.scored(plan, rows, evaluation.LEXICAL).select("question_id", "metric", F.round("score", 9).alias("score"), "skipped")
