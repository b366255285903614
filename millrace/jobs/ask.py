"""Answers to batches of questions as a service would give them, and the facts of a run."""

from __future__ import annotations

import platform
import subprocess
from datetime import datetime, timezone

import pyspark
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import is_abstain, preview
from millrace.operators.corrective import Models, Retriever, baseline, corrective
from millrace.sources.records import fingerprint

# The longest question, and the pipelines there are.
LONGEST = 2000
PIPELINES = {"baseline": baseline, "corrective": corrective}


def checked(questions: DataFrame) -> DataFrame:
    """``questions`` trimmed, with an error for a blank or too long one."""
    asked = questions.withColumn("question", F.trim(F.coalesce("question", F.lit(""))))
    return asked.withColumn("error", F.when(F.col("question") == "", "blank").when(F.length("question") > LONGEST, "too long"))


def ask(questions: DataFrame, chunks: DataFrame | None, pipeline: str = "corrective", models: Models | None = None, search: Retriever | None = None, filters: list[str] | None = None) -> DataFrame:
    """(question_id, pipeline, answer, is_abstain, answer_preview, trace, error) of each of ``questions``; a bad one is not answered.

    ``search`` takes the place of retrieval by words among ``chunks``, and can
    filter by the ``filters``.
    """
    known = checked(questions)
    more = {"filters": filters} if pipeline == "corrective" else {}
    found = PIPELINES[pipeline](known.filter("error is null").drop("error"), chunks, models, search, **more)
    shown = found.select("question_id", F.lit(pipeline).alias("pipeline"), "answer", is_abstain(F.col("answer")).alias("is_abstain"), preview(F.col("answer")).alias("answer_preview"), "trace", F.lit(None).cast("string").alias("error"))
    none = lambda kind: F.lit(None).cast(kind)
    bad = known.filter("error is not null").select("question_id", F.lit(pipeline).alias("pipeline"), none("string").alias("answer"), none("boolean").alias("is_abstain"), none("string").alias("answer_preview"), none("array<string>").alias("trace"), "error")
    return shown.unionByName(bad)


def subset(questions: DataFrame, ids: list[str] | None = None, first: int | None = None) -> DataFrame:
    """The questions of given ids, which must all be known, or else the first so many by id."""
    if ids:
        found = questions.filter(F.col("question_id").isin(ids))
        lacking = sorted(set(ids) - {r[0] for r in found.select("question_id").distinct().collect()})
        if lacking:
            raise ValueError(f"unknown question ids: {lacking}")
        return found
    return questions.orderBy("question_id").limit(first) if first else questions


def observed(df: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``df`` with its rows and errors counted as it runs."""
    seen = Observation(name)
    return df.observe(seen, F.count("*").alias("rows"), F.count_if(F.col("error").isNotNull()).alias("errors")), seen


def run_facts(spark: SparkSession, tests: DataFrame, models: dict[str, str]) -> DataFrame:
    """One row that tells a run: time, commit, versions, models, the number of tests and a fingerprint of them in their order."""
    git = lambda *a: subprocess.run(["git", *a], capture_output=True, text=True).stdout.strip()
    facts = {"timestamp": datetime.now(timezone.utc).isoformat(), "git_sha": git("rev-parse", "HEAD"), "git_dirty": str(bool(git("status", "--porcelain"))), "spark": pyspark.__version__, "python": platform.python_version(), **models}
    told = fingerprint(tests).join(F.broadcast(tests.agg(F.count("*").alias("n_queries"))))
    return told.select(*[F.lit(v).alias(k) for k, v in facts.items()], "n_queries", "test_set_hash")
