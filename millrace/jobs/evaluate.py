"""Runs over a test set: results of both pipelines, scores that can be resumed, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators import evaluation as E
from millrace.operators.corrective import Models, Retriever, baseline, corrective
from millrace.sources.records import append_scores, read_scores, write_csv
from millrace.sources.shared import Steps, exists, remove

RUNS = {"baseline": baseline, "corrective": corrective}


#: Scores that are made and appended at once: what a run that breaks off may lose.
ROUND = 500


def run_pipelines(questions: DataFrame, chunks: DataFrame | None, folder: str, models: Models | None = None, search: Retriever | None = None) -> dict[str, DataFrame]:
    """The results of both pipelines with their sources, written as JSON rows below ``folder`` and read back; a model's failure is an error row."""
    spark, out = questions.sparkSession, {}
    for name, run in RUNS.items():
        results = run(questions, chunks, models, search)
        results.write.mode("overwrite").json(f"{folder}/{name}")
        out[name] = spark.read.schema(results.schema).json(f"{folder}/{name}")
    return out


def run_scores(rows: DataFrame, path: str, metrics: dict[str, E.Metric] | None = None, fresh: bool = False, retry_errors: bool = False, round_rows: int = ROUND) -> DataFrame:
    """The last scores of ``rows`` (pipeline, question_id, question, answer, contexts, reference), of which only those that ``path`` lacks are made.

    Scores are appended in rounds of about ``round_rows``, so a run that
    breaks off is resumed where its last round ended. ``fresh`` begins anew.
    Rows that ended in an error count as done unless ``retry_errors``.
    """
    spark, metrics = rows.sparkSession, metrics or E.LEXICAL
    if fresh:
        remove(spark, path)
    keys = ["pipeline", "question_id", "metric"]

    def done() -> DataFrame:
        return E.last_write(read_scores(spark, path).withColumnRenamed("query_id", "question_id"), keys, "position")

    before = done() if exists(spark, path) else spark.createDataFrame([], "pipeline string, question_id string, metric string, err string")
    with Steps(spark) as steps:
        known = rows.withColumn("question_id", F.col("question_id").cast("string"))
        plan = steps.keep(E.scoring_plan(known.withColumn("has_context", F.size("contexts") > 0), list(metrics), before, retry_errors))
        rounds = -(-plan.count() // round_rows)
        for k in range(rounds):
            own = plan.filter(F.pmod(F.xxhash64(*keys), F.lit(rounds)) == k)
            made = E.scored(own, known, metrics).withColumnRenamed("question_id", "query_id").withColumn("ts", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))
            append_scores(made, path)
    return done()


def evaluated(tests: DataFrame, chunks: DataFrame | None, folder: str, models: Models | None = None, search: Retriever | None = None, metrics: dict[str, E.Metric] | None = None, should_abstain: DataFrame | None = None, fresh: bool = True) -> tuple[dict[str, DataFrame], DataFrame]:
    """A whole run over ``tests`` (question_id, question, category, expected_answer): results of both pipelines, their scores, and reports.

    All of it is below ``folder``: results as JSON rows with the texts that
    the answers rest on, scores as appended records, reports. Gives the
    results by pipeline and the scores.
    """
    results = run_pipelines(tests.select("question_id", "question"), chunks, f"{folder}/results", models, search)
    rows = E.samples(results["baseline"], tests).unionByName(E.samples(results["corrective"], tests))
    scores = run_scores(rows, f"{folder}/scores", metrics, fresh)
    none = tests.select("question_id").filter("false") if should_abstain is None else should_abstain
    write_reports(scores, results["corrective"], tests, none, f"{folder}/reports")
    return results, scores


def wide(scores: DataFrame) -> DataFrame:
    """(question_id, metric, baseline, enhanced) of scores by pipeline."""
    return scores.groupBy("question_id", "metric").agg(*(F.max(F.when(F.col("pipeline") == p, F.col("score"))).alias(c) for p, c in (("baseline", "baseline"), ("corrective", "enhanced"))))


def abstained(results: DataFrame) -> DataFrame:
    """The ids of the questions that were not answered."""
    return results.filter(F.exists("trace", lambda x: x.startswith("abstain"))).select(F.col("question_id").cast("string").alias("question_id"))


def write_reports(scores: DataFrame, results: DataFrame, tests: DataFrame, should_abstain: DataFrame, folder: str) -> None:
    """Means, rates and categories of a run, as JSON and CSV below ``folder``.

    ``scores`` has pipeline (baseline, corrective), question_id, metric and
    score; ``results`` are those of the corrective pipeline; ``tests`` has
    question_id and category.
    """
    means = E.means(wide(scores), abstained(results))
    means.write.mode("overwrite").json(f"{folder}/aggregate")
    write_csv(means, f"{folder}/comparison")
    E.corrective_rates(results, should_abstain).write.mode("overwrite").json(f"{folder}/corrective_metrics")
    known = scores.join(tests.select(F.col("question_id").cast("string").alias("question_id"), "category"), "question_id", "left")
    side = lambda p: known.filter(F.col("pipeline") == p).withColumn("category", F.concat_ws("/", "metric", F.coalesce("category", F.lit(""))))
    write_csv(E.category_comparison(side("baseline"), side("corrective")), f"{folder}/per_category")


def chunk_summary(chunks: DataFrame, plain: DataFrame) -> DataFrame:
    """One row that tells a chunking run: documents, chunks with metadata and baseline chunks."""
    first = chunks.agg(F.count_distinct("doc_id").alias("documents"), F.count("*").alias("enhanced_chunks"), F.sum("token_count").alias("enhanced_tokens"))
    second = plain.agg(F.count("*").alias("baseline_chunks"), F.sum("token_count").alias("baseline_tokens"))
    return first.join(F.broadcast(second))
