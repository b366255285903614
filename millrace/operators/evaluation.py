"""Comparison of two pipelines: joins, plans of what to score, means, rates, divergences."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.corrective import failed
from millrace.operators.retrieval import terms

# The metrics, those that need context, and bounds of a judge's divergence.
METRICS = ["faithfulness", "answer_relevancy", "context_precision_with_reference", "context_recall"]
NEED_CONTEXT = ["faithfulness", "context_precision_with_reference", "context_recall"]
MINOR, MATERIAL = 0.15, 0.30


def contexts(results: DataFrame) -> Column:
    """The texts of a result's sources in order, without empty ones; a source without a text has its preview."""
    fields = results.schema["sources"].dataType.elementType.names
    text = lambda x: F.coalesce(*(F.when(x[c] != "", x[c]) for c in ("text", "text_preview") if c in fields), F.lit(""))
    return F.filter(F.transform("sources", text), lambda t: F.trim(t) != "")


def samples(results: DataFrame, tests: DataFrame) -> DataFrame:
    """(pipeline, question_id, question, answer, contexts, reference) of the results that have a test row, to be scored.

    ``results`` has sources (of text, or text_preview), ``tests`` question_id,
    question and expected_answer; the question is the test's. Results without
    a test, and tests without a result, are left out.
    """
    own = results.select("pipeline", "question_id", F.coalesce("answer", F.lit("")).alias("answer"), F.coalesce(contexts(results), F.array().cast("array<string>")).alias("contexts"))
    return own.join(tests.select("question_id", "question", F.col("expected_answer").alias("reference")), "question_id").select("pipeline", "question_id", "question", "answer", "contexts", "reference")


def scoring_plan(rows: DataFrame, metrics: list[str], done: DataFrame, retry_errors: bool = False) -> DataFrame:
    """(pipeline, question_id, metric, skipped) still to score; metrics that need context skip rows without any.

    Rows that ended in an error count as done unless ``retry_errors``.
    """
    plan = rows.select("pipeline", "question_id", "has_context", F.explode(F.array(*map(F.lit, metrics))).alias("metric"))
    seen = done.filter(F.col("err").isNull()) if retry_errors else done
    left = plan.join(seen.select("pipeline", "question_id", "metric"), ["pipeline", "question_id", "metric"], "left_anti")
    return left.select("pipeline", "question_id", "metric", F.when(F.col("metric").isin(NEED_CONTEXT) & ~F.col("has_context"), "abstain").alias("skipped"))


def _among(mine: Column, others: Column) -> Column:
    """The share of terms that are among others; null for none."""
    return F.try_divide(F.size(F.array_intersect(mine, others)), F.size(mine))


def _precision(contexts: Column, reference: Column) -> Column:
    """Mean precision at each context that holds half of the reference's terms; 0 if none does."""
    own = terms(reference)
    useful = F.transform(contexts, lambda x: F.coalesce(_among(own, terms(x)) >= 0.5, F.lit(False)))

    def mean(flags: Column) -> Column:
        at = F.transform(flags, lambda hit, i: F.when(hit, F.size(F.filter(F.slice(flags, F.lit(1), i + 1), lambda y: y)) / (i + 1)).otherwise(F.lit(0.0)))
        hits = F.size(F.filter(flags, lambda y: y))
        return F.coalesce(F.try_divide(F.aggregate(at, F.lit(0.0), lambda t, x: t + x), hits), F.lit(0.0))

    return F.get(F.transform(F.array(useful), mean), F.lit(0))


#: The metrics as shares of words, which need no judge: of (question, answer, contexts, reference).
LEXICAL = {
    "faithfulness": lambda q, a, c, r: _among(terms(a), terms(F.array_join(c, " "))),
    "answer_relevancy": lambda q, a, c, r: _among(terms(q), terms(a)),
    "context_precision_with_reference": lambda q, a, c, r: _precision(c, r),
    "context_recall": lambda q, a, c, r: _among(terms(r), terms(F.array_join(c, " "))),
}


@dataclass
class Judge:
    """A metric by a Python judge of question, answer, contexts and reference, asked by up to ``calls`` threads of a task and in ``tasks`` tasks at once.

    An exception is an error of at most 500 characters.
    """

    judge: Callable[[str, str, list[str], str], float]
    calls: int = 4
    tasks: int = 4

    def scores(self, rows: DataFrame) -> DataFrame:
        """(pipeline, question_id, metric, score, err) of ``rows``."""
        judge, calls = self.judge, self.calls

        def one(row) -> tuple[float | None, str | None]:
            try:
                return float(judge(row.question, row.answer, list(row.contexts), row.reference)), None
            except Exception as error:
                return None, f"{type(error).__name__}: {error}"[:500]

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            with ThreadPoolExecutor(calls) as pool:
                for frame in frames:
                    out = pd.DataFrame(list(pool.map(one, frame.itertuples(index=False))), columns=["score", "err"]).astype({"score": "float64", "err": "object"})
                    yield pd.concat([frame[["pipeline", "question_id", "metric"]].reset_index(drop=True), out], axis=1)

        kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
        asked = rows.select("pipeline", "question_id", "metric", "question", "answer", "contexts", "reference").repartition(self.tasks, "question_id", "metric")
        return asked.mapInPandas(run, f"pipeline string, question_id {kinds['question_id']}, metric string, score double, err string")


#: A metric is a column of (question, answer, contexts, reference), or a judge.
Metric = Callable[..., Column] | Judge


def scored(plan: DataFrame, rows: DataFrame, metrics: dict[str, Metric]) -> DataFrame:
    """(pipeline, question_id, metric, score, skipped, err) of each row of a ``scoring_plan``.

    ``rows`` has pipeline, question_id, question, answer, contexts and
    reference. What the plan skips has no score and asks no judge: each metric
    runs over its own rows only.
    """
    todo = plan.filter("skipped is null").join(rows.select("pipeline", "question_id", "question", "answer", "contexts", "reference"), ["pipeline", "question_id"])
    none = F.lit(None).cast("string")
    out = plan.filter("skipped is not null").select("pipeline", "question_id", "metric", F.lit(None).cast("double").alias("score"), "skipped", none.alias("err"))
    for name, metric in metrics.items():
        own = todo.filter(F.col("metric") == name)
        if isinstance(metric, Judge):
            made = metric.scores(own)
        else:
            made = own.select("pipeline", "question_id", "metric", metric(F.col("question"), F.col("answer"), F.col("contexts"), F.col("reference")).cast("double").alias("score"), none.alias("err"))
        out = out.unionByName(made.select("pipeline", "question_id", "metric", "score", none.alias("skipped"), "err"))
    return out


def last_write(records: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The last record of each key; a max over structs, combined before the shuffle."""
    rest = [c for c in records.columns if c not in keys]
    best = records.groupBy(*keys).agg(F.max_by(F.struct(*rest), position).alias("x"))
    return best.select(*keys, "x.*")


def means(scores: DataFrame, abstained: DataFrame) -> DataFrame:
    """By metric: each side's mean over all and over answered questions, and the mean paired difference.

    ``scores`` has question_id, metric, baseline and enhanced. Null and NaN
    scores are left out; the mean of nothing is null.
    """
    valid = lambda c: F.when(~F.isnan(c), F.col(c))
    rows = scores.withColumn("baseline", valid("baseline")).withColumn("enhanced", valid("enhanced")).join(abstained.select("question_id", F.lit(True).alias("out")).distinct(), "question_id", "left")
    answered = F.col("out").isNull()
    delta = F.when(answered, F.col("enhanced") - F.col("baseline"))
    return rows.groupBy("metric").agg(
        F.avg("baseline").alias("baseline_all"), F.avg("enhanced").alias("enhanced_all"), F.avg(F.when(answered, F.col("baseline"))).alias("baseline_answered"), F.avg(F.when(answered, F.col("enhanced"))).alias("enhanced_answered"),
        F.avg(delta).alias("mean_delta"), F.count(delta).alias("n_pairs"),
    )


def category_means(scores: DataFrame) -> DataFrame:
    """Mean and count of score by category, without null scores or categories."""
    return scores.filter("score is not null and category is not null").groupBy("category").agg(F.avg("score").alias("mean"), F.count("*").alias("n"))


def category_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """Both sides' category means in one table; n is the larger count, a difference needs both."""
    x, y = category_means(a), category_means(b)
    both = x.select("category", F.col("mean").alias("baseline"), F.col("n").alias("n_b")).join(y.select("category", F.col("mean").alias("enhanced"), F.col("n").alias("n_e")), "category", "full")
    n = F.greatest(F.coalesce("n_b", F.lit(0)), F.coalesce("n_e", F.lit(0)))
    return both.select("category", n.alias("n"), "baseline", "enhanced", (F.col("enhanced") - F.col("baseline")).alias("delta"))


def judge_divergence(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Per pair scored by both judges: scores and absolute difference, rounded to four places."""
    both = a.join(b.select(*keys, F.col("score").alias("other")), keys).filter("score is not null and other is not null")
    return both.select(*keys, "score", "other", F.round(F.abs(F.col("score") - F.col("other")), 4).alias("diff"))


def divergence_summary(rows: DataFrame) -> DataFrame:
    """Count, greatest, mean and upper median of the differences, and the verdict.

    The median comes from the counts of the different values, which are few as
    they have four places.
    """
    totals = rows.agg(F.count("*").alias("n"), F.max("diff").alias("max_diff"), F.avg("diff").alias("mean_diff"))
    so_far = F.sum("count").over(Window.orderBy("diff").rowsBetween(Window.unboundedPreceding, 0))
    values = rows.groupBy("diff").count().withColumn("so_far", so_far).join(F.broadcast(totals))
    median = values.agg(F.min(F.when(F.col("so_far") > F.floor(F.col("n") / 2), F.col("diff"))).alias("median_diff"))
    found = totals.join(median)
    return found.withColumn("verdict", F.when(F.col("max_diff") < MINOR, "minor").when(F.col("max_diff") < MATERIAL, "moderate").otherwise("material"))


def worst(rows: DataFrame, keys: list[str], n: int = 5) -> DataFrame:
    """The n pairs on which the judges differ most, ties by key."""
    return rows.orderBy(F.desc("diff"), *keys).limit(n)


def trace_shifts(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, before, after): how many steps the results took that take another number now."""
    x, y = before.select(key, F.size("trace").alias("before")), after.select(key, F.size("trace").alias("after"))
    return x.join(y, key).filter("before <> after")


def set_delta(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, change): what only one of two sets has."""
    added = after.select(key).distinct().join(before.select(key), key, "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(before.select(key).distinct().join(after.select(key), key, "left_anti").withColumn("change", F.lit("removed")))


def abstain_invariant(before: DataFrame, after: DataFrame, expected: DataFrame) -> DataFrame:
    """Whether exactly the ``expected`` questions abstain now that did not, and none stopped.

    One row: n_added, n_removed, n_missing (expected, but not added), n_extra
    (added, but not expected), and holds, which asks for none of the last three.
    """
    abstaining = lambda df: df.filter(F.exists("trace", lambda x: x.startswith("abstain"))).select("question_id")
    delta = set_delta(abstaining(before), abstaining(after), "question_id")
    wanted = expected.select("question_id", F.lit(True).alias("wanted")).distinct()
    both = delta.join(wanted, "question_id", "full")
    is_ = lambda kind: F.coalesce(F.col("change") == kind, F.lit(False))
    counts = both.agg(
        F.count_if(is_("added")).alias("n_added"), F.count_if(is_("removed")).alias("n_removed"),
        F.count_if(F.col("wanted").isNotNull() & ~is_("added")).alias("n_missing"), F.count_if(F.col("wanted").isNull() & is_("added")).alias("n_extra"),
    )
    return counts.withColumn("holds", F.col("n_removed") + F.col("n_missing") + F.col("n_extra") == 0)


def corrective_rates(results: DataFrame, should_abstain: DataFrame) -> DataFrame:
    """The loop's rates over all results, as one row; a rate over none is null, no results give no row."""
    named = results.join(should_abstain.select("question_id", F.lit(True).alias("should")).distinct(), "question_id", "left")
    count, rate = lambda c: F.count_if(c), lambda a, b: F.try_divide(F.count_if(a), F.count_if(b))
    abstain = F.exists("trace", lambda x: x.startswith("abstain"))
    rewritten, retried, flagged = F.col("rewrites") > 0, F.col("failures") > 0, F.col("is_grounded").eqNullSafe(False)
    has_ranks = (F.size("pre_rerank_ids") > 0) & (F.size("post_rerank_ids") > 0)
    should = F.col("should").eqNullSafe(True)
    every = F.lit(True)
    return named.agg(
        F.count("*").alias("n_queries"),
        rate(rewritten, every).alias("rewrite_trigger_rate"),
        rate(rewritten & ~abstain, rewritten).alias("rewrite_recovery_rate"),
        rate(flagged, every).alias("hallucination_flag_rate"),
        rate(retried & F.col("is_grounded").eqNullSafe(True), retried).alias("hallucination_recovery_rate"),
        rate(F.col("filters").isNotNull(), every).alias("filter_rate"),
        F.avg("chunks_retrieved").alias("mean_chunks_retrieved"),
        F.avg("chunks_used").alias("mean_chunks_used"),
        rate(has_ranks & (F.get("pre_rerank_ids", F.lit(0)) != F.get("post_rerank_ids", F.lit(0))), has_ranks).alias("rerank_top1_change_rate"),
        rate(abstain, every).alias("abstain_rate"),
        rate(abstain & should, abstain).alias("abstain_precision"),
        rate(abstain & should, should).alias("abstain_recall"),
        count(should & ~abstain).alias("n_missed_abstains"),
    ).filter("n_queries > 0")


def run_counters(results: DataFrame) -> DataFrame:
    """Errors, abstentions after retrieval, rewrites and failed checks of a run."""
    return results.agg(
        F.count_if(failed(F.col("answer"))).alias("errors"), F.count_if(F.array_contains("trace", "abstain")).alias("abstains"),
        F.coalesce(F.sum("rewrites"), F.lit(0)).alias("rewrites"), F.coalesce(F.sum("failures"), F.lit(0)).alias("failures"),
    )


def confusion(flags: DataFrame, expected: str, actual: str) -> DataFrame:
    return flags.groupBy(expected, actual).agg(F.count("*").alias("n"))


def holm(tests: DataFrame, name: str, p: str) -> DataFrame:
    """Holm's adjusted p of each test with one; the tests are few, as their order needs them together."""
    defined = tests.filter(F.col(p).isNotNull())
    order = Window.orderBy(p, name)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    scaled: Column = (F.count("*").over(every) - F.row_number().over(order) + 1) * F.col(p)
    grown = defined.withColumn("scaled", scaled).withColumn("adjusted", F.least(F.lit(1.0), F.max("scaled").over(order.rowsBetween(Window.unboundedPreceding, 0))))
    return grown.select(name, p, "adjusted")
