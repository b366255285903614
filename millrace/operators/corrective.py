"""Batches of questions answered by retrieval: a plain pipeline, and one that corrects itself.

The corrective pipeline rewrites a question at most once and generates an
answer at most twice, so it is a finite plan over a DataFrame of questions:
branches are filters and joins, and the result is their union. Models are
column expressions by default; ``Models`` takes others. Both pipelines run
when they are called: what several branches read is written to the shared
folder, and is gone when the result has been written there too.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.prompts import prompt
from millrace.functions.text import ABSTAIN, NOTHING_FOUND, clean, context, says_yes
from millrace.operators.analysis import FILTERS
from millrace.operators.retrieval import retrieve, share, terms
from millrace.sources.shared import Steps

# Chunks that are retrieved and kept, and how often a step is repeated.
BASELINE_K, CORRECTIVE_K, RERANK_N = 5, 10, 5
#: How the answer of a model that failed begins.
FAILED = "[Pipeline error"
RESULT = ["question_id", "question", "answer", "pipeline", "chunks_retrieved", "chunks_used", "rewrites", "failures", "is_grounded", "filters", "trace", "pre_rerank_ids", "post_rerank_ids", "sources"]


@dataclass
class Models:
    """What the pipelines ask of models, as column expressions of question, chunk text, context and answer.

    ``analyse`` adds the filter columns and out_of_corpus to questions; an
    analysis that fails gives nulls and false, and the question goes on.
    """

    analyse: Callable[[DataFrame], DataFrame] | None = None
    relevant: Callable[[Column, Column], Column] = field(default=lambda question, text: share(question, text) >= 0.5)
    rewrite: Callable[[Column], Column] = field(default=lambda question: F.array_join(F.filter(terms(question), lambda w: F.length(w) > 3), " "))
    rerank: Callable[[Column, Column], Column] = field(default=lambda question, text: F.round(share(question, text), 6))
    generate: Callable[[Column, Column, bool], Column] = field(default=lambda question, texts, strict: F.split_part(F.get(texts, F.lit(0)), F.lit("." if strict else "\n"), F.lit(1)))
    grounded: Callable[[Column, Column], Column] = field(default=lambda answer, texts: share(answer, F.array_join(texts, " ")) >= 1.0)


def prompted(reply: Callable[[Column], Column], analyse: Callable[[DataFrame], DataFrame] | None = None) -> Models:
    """Models that all are one model's replies to prompts; a reply is a column of the prompt's."""
    asked = lambda name, **places: reply(prompt(name, **places))
    return Models(
        analyse=analyse,
        relevant=lambda question, text: says_yes(asked("grade", question=question, passage=text)),
        rewrite=lambda question: F.trim(asked("rewrite", question=question)),
        generate=lambda question, texts, strict: asked("answer_strictly" if strict else "answer", context=context(texts), question=question),
        grounded=lambda answer, texts: says_yes(asked("check", context=context(texts), answer=answer)),
    )


def _listed(found: DataFrame, order: str, score: str = "score") -> DataFrame:
    """Each question's chunks in order: ids, texts, and sources (chunk_id, text, score)."""
    own = F.struct(F.col(order).alias("at"), F.struct("chunk_id", "text", F.col(score).cast("double").alias("score")).alias("x"))
    listed = found.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(own)), lambda y: y["x"]).alias("sources"))
    return listed.select("question_id", F.transform("sources", lambda y: y["chunk_id"]).alias("ids"), F.transform("sources", lambda y: y["text"]).alias("texts"), "sources")


def _steps(*names: str) -> Column:
    return F.array(*map(F.lit, names))


def failed(answer: Column) -> Column:
    """Whether a model failed: its answer tells the error."""
    return F.coalesce(answer.startswith(FAILED), F.lit(False))


def with_error_rows(results: DataFrame) -> DataFrame:
    """Results whose model failed as error rows: the error as answer and trace, nothing retrieved, used or grounded."""
    bad, none = failed(F.col("answer")), F.array().cast("array<string>")
    instead = {
        **dict.fromkeys(["chunks_retrieved", "chunks_used", "rewrites", "failures"], F.lit(0)), "is_grounded": F.lit(None).cast("boolean"), "filters": F.lit(None).cast("string"),
        "trace": _steps("error"), "pre_rerank_ids": none, "post_rerank_ids": none, "sources": F.array(),
    }
    kinds = dict(results.dtypes)
    return results.select(*(F.when(bad, instead[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in instead else F.col(c) for c in results.columns))


def guarded(model: Callable[[str, list[str], bool], str]) -> Callable[[Column, Column, bool], Column]:
    """A Python model of question, context texts and strictness for ``Models.generate``; an exception is an answer that tells it."""

    def generate(question: Column, texts: Column, strict: bool) -> Column:
        @F.pandas_udf("string")
        def answers(questions: pd.Series, contexts: pd.Series) -> pd.Series:
            def one(asked: str, found: list[str] | None) -> str:
                try:
                    return model(asked, list(found) if found is not None else [], strict)
                except Exception as error:
                    return f"{FAILED}: {type(error).__name__}: {error}]"

            return pd.Series([one(q, c) for q, c in zip(questions, contexts, strict=True)])

        return answers.asNondeterministic()(question, texts)

    return generate


#: Retrieval by other means: chunks of questions (question_id, question, rewritten, filters), k of each, under the named filters.
Retriever = Callable[[DataFrame, int, list[str]], DataFrame]


def _none(df: DataFrame, column: str) -> Column:
    """An empty array of a column's kind."""
    return F.array().cast(df.schema[column].dataType)


def baseline(questions: DataFrame, chunks: DataFrame | None, models: Models | None = None, search: Retriever | None = None) -> DataFrame:
    """Retrieve the best five, answer from them; without any, say so and ask no model.

    ``search`` takes the place of retrieval by words, such as ``Collection.search``.
    """
    models = models or Models()
    with Steps(questions.sparkSession) as steps:
        plain = questions.select("question_id", "question").withColumn("rewritten", F.lit(None).cast("string"))
        best = search(plain, BASELINE_K, []) if search else retrieve(plain, chunks, BASELINE_K, steps=steps)
        found = steps.keep(plain.join(_listed(best, "rank"), "question_id", "left"))
        none = F.array().cast("array<string>")

        def told(rows: DataFrame, answer: Column, sources: Column, *trace: str) -> DataFrame:
            n = F.size(sources).cast("long")
            return rows.select(
                "question_id", "question", answer.alias("answer"), F.lit("baseline").alias("pipeline"), n.alias("chunks_retrieved"), n.alias("chunks_used"), F.lit(0).alias("rewrites"), F.lit(0).alias("failures"),
                F.lit(None).cast("boolean").alias("is_grounded"), F.lit(None).cast("string").alias("filters"), _steps(*trace).alias("trace"), none.alias("pre_rerank_ids"), none.alias("post_rerank_ids"), sources.alias("sources"),
            )

        some = told(found.filter("ids is not null"), models.generate(F.col("question"), F.col("texts"), False), F.col("sources"), "retrieve", "generate")
        others = told(found.filter("ids is null"), F.lit(NOTHING_FOUND), _none(found, "sources"), "retrieve")
        return steps.finish(with_error_rows(some.unionByName(others)))


def corrective(questions: DataFrame, chunks: DataFrame | None, models: Models | None = None, search: Retriever | None = None, filters: list[str] | None = None) -> DataFrame:
    """Scope gate, filtered retrieval, grading, one rewrite, reranking, generation, check, one regeneration.

    ``questions`` has question_id and question. Grading, generation and its
    check see the question as asked; retrieval and reranking the rewritten
    one. Model results that several branches use are written once, so that no
    model runs twice. ``search`` takes the place of retrieval by words;
    ``filters`` names what it can filter by, if there are no chunks to tell.
    """
    with Steps(questions.sparkSession) as steps:
        return steps.finish(_corrected(steps, questions, chunks, models or Models(), search, filters))


def _analysed(asked: DataFrame, models: Models) -> DataFrame:
    """Questions with their filters, the filters as told, and whether they are out of the corpus."""
    found = models.analyse(asked) if models.analyse else asked
    for c in FILTERS:
        if c not in found.columns:
            found = found.withColumn(c, F.lit(None).cast("string"))
    if "out_of_corpus" not in found.columns:
        found = found.withColumn("out_of_corpus", F.lit(False))
    described = F.to_json(F.struct(*[clean(F.col(c)).alias(c) for c in FILTERS]))
    return found.withColumn("filters", F.when(described != "{}", described)).withColumn("rewritten", F.lit(None).cast("string"))


def _ranked(good: DataFrame, models: Models) -> DataFrame:
    """Each question's graded chunks by the reranker's values; a single one is passed through with its own score."""
    several = F.count("*").over(Window.partitionBy("question_id")) > 1
    counted = good.withColumn("several", several)
    value = models.rerank(F.coalesce("rewritten", "question"), F.col("text")).cast("double")
    scored = counted.filter("several").withColumn("value", value).unionByName(counted.filter("not several").withColumn("value", F.col("score").cast("double")))
    place = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("value"), "rank"))
    scored = scored.withColumn("place", place)
    before = scored.groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda y: y["chunk_id"]).alias("pre_rerank_ids"))
    return before.join(_listed(scored.filter(F.col("place") <= RERANK_N), "place", "value"), "question_id")


def _corrected(steps: Steps, questions: DataFrame, chunks: DataFrame | None, models: Models, search: Retriever | None, filters: list[str] | None) -> DataFrame:
    analysed = steps.keep(_analysed(questions.select("question_id", "question"), models))
    outside = analysed.filter(F.col("out_of_corpus").eqNullSafe(True))
    inside = analysed.filter(~F.col("out_of_corpus").eqNullSafe(True))
    used = filters if filters is not None else [c for c in FILTERS if chunks is not None and c in chunks.columns]

    def graded(who: DataFrame, filters: list[str]) -> tuple[DataFrame, DataFrame]:
        found = steps.keep(search(who, CORRECTIVE_K, filters) if search else retrieve(who, chunks, CORRECTIVE_K, filters, steps))
        counts = found.groupBy("question_id").agg(F.count("*").alias("chunks_retrieved"))
        judged = found.join(who.select("question_id", "question", "rewritten"), "question_id").filter(models.relevant(F.col("question"), F.col("text")))
        return steps.keep(judged), counts

    good1, counts1 = graded(inside, used)
    again = inside.join(good1.select("question_id").distinct(), "question_id", "left_anti").withColumn("rewritten", models.rewrite(F.col("question")))
    again = steps.keep(again)
    good2, counts2 = graded(again, [])
    given_up = again.join(good2.select("question_id").distinct(), "question_id", "left_anti")

    facts = ["question_id", "question", "filters"]
    ranked = steps.keep(_ranked(good1.unionByName(good2), models))
    chosen = inside.select(*facts).join(counts1, "question_id").join(good1.select("question_id").distinct(), "question_id", "left_semi").withColumn("rewrites", F.lit(0))
    chosen = chosen.unionByName(again.select(*facts).join(counts2, "question_id").join(good2.select("question_id").distinct(), "question_id", "left_semi").withColumn("rewrites", F.lit(1)))
    answered = steps.keep(chosen.join(ranked, "question_id").withColumn("answer", models.generate(F.col("question"), F.col("texts"), False)))
    bad = failed(F.col("answer"))  # a failure is not asked again
    checked = steps.keep(answered.filter(~bad).withColumn("ok", F.coalesce(models.grounded(F.col("answer"), F.col("texts")), F.lit(False))).unionByName(answered.filter(bad).withColumn("ok", F.lit(True))))
    first = checked.filter("ok").withColumn("failures", F.lit(0)).withColumn("is_grounded", F.lit(True))
    second = steps.keep(checked.filter("not ok").withColumn("answer", models.generate(F.col("question"), F.col("texts"), True)))
    second = second.withColumn("is_grounded", F.coalesce(models.grounded(F.col("answer"), F.col("texts")), F.lit(False)))
    second = second.withColumn("failures", F.when(F.col("is_grounded"), 1).otherwise(2))

    base, round_ = ["analyze_query", "retrieve", "grade_documents"], ["rewrite_query", "retrieve", "grade_documents"]
    none = F.array().cast("array<string>")
    done = first.unionByName(second).select(
        *facts, "answer", "chunks_retrieved", F.size("ids").cast("long").alias("chunks_used"), "rewrites", "failures", "is_grounded", "pre_rerank_ids", F.col("ids").alias("post_rerank_ids"), "sources",
        F.concat(_steps(*base), F.when(F.col("rewrites") == 1, _steps(*round_)).otherwise(none), _steps("rerank", "generate", "check_hallucination"), F.when(F.col("failures") > 0, _steps("generate", "check_hallucination")).otherwise(none)).alias("trace"),
    )

    def abstained(who: DataFrame, rewrites: int, trace: list[str]) -> DataFrame:
        return who.select(
            *facts, F.lit(ABSTAIN).alias("answer"), "chunks_retrieved", F.lit(0).cast("long").alias("chunks_used"), F.lit(rewrites).alias("rewrites"), F.lit(0).alias("failures"),
            F.lit(None).cast("boolean").alias("is_grounded"), *(_none(done, c).alias(c) for c in ("pre_rerank_ids", "post_rerank_ids", "sources")), _steps(*trace).alias("trace"),
        )

    no_chunks = given_up.join(counts2, "question_id", "left").withColumn("chunks_retrieved", F.coalesce("chunks_retrieved", F.lit(0)).cast("long"))
    out_rows = abstained(outside.withColumn("chunks_retrieved", F.lit(0).cast("long")).withColumn("filters", F.lit(None).cast("string")), 0, ["analyze_query", "abstain_out_of_corpus"])
    result = done.unionByName(abstained(no_chunks, 1, [*base, *round_, "abstain"])).unionByName(out_rows)
    return with_error_rows(result.withColumn("pipeline", F.lit("corrective")).select(RESULT))
