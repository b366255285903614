"""Responses kept between runs: answered questions are joined, only the others are asked; what was used least goes when there is too much.

A store is a folder of builds of responses, and of uses, the keys that a run
has asked for. A run that finds everything writes a line of uses and no
responses; one that asks adds a build. Beyond the cap the builds are merged
into one of the responses that were used last and fit.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import cache_key
from millrace.sources import shared

#: Bytes of responses that a store holds.
CAP = 1 << 30


def _builds(spark: SparkSession, store: str, kind: str) -> list[str]:
    return [f"{store}/{n}" for n in shared.names(spark, store) if n.startswith(f"{kind}-")]


def _put(rows: DataFrame, store: str, kind: str) -> str:
    """A build that appears as a whole, named by its writer."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    aside = f"{store}/_new-{name}"
    rows.write.parquet(aside)
    files, at = shared.place(spark, aside)
    files.rename(at, spark._jvm.org.apache.hadoop.fs.Path(f"{store}/{kind}-{name}"))
    return f"{store}/{kind}-{name}"


def read(spark: SparkSession, store: str) -> DataFrame | None:
    """The responses of a store, one for each key; None if there are none. Two runs at once may have answered the same question."""
    builds = _builds(spark, store, "answers")
    return spark.read.parquet(*builds).dropDuplicates(["key"]) if builds else None


def size(spark: SparkSession, store: str) -> int:
    """The bytes of the responses in a store."""
    total = 0
    for build in _builds(spark, store, "answers"):
        files, at = shared.place(spark, build)
        total += files.getContentSummary(at).getLength()
    return total


def cached(questions: DataFrame, store: str, run: Callable[[DataFrame], DataFrame], pipeline: str, model: str, version: str, cap: int = CAP) -> DataFrame:
    """The results of ``questions`` (question_id, question), from the store or by ``run``, which are then added to it.

    A key is the hash of pipeline, model, prompt version and question, so any
    change of these asks anew. ``run`` isn't called if all are known.
    """
    spark = questions.sparkSession
    keyed = questions.withColumn("key", cache_key(F.lit(pipeline), F.lit(model), F.lit(version), F.col("question")))
    with shared.Steps(spark) as steps:
        keyed = steps.keep(keyed)
        known = read(spark, store)
        misses = keyed if known is None else keyed.join(known.select("key"), "key", "left_anti")
        once = steps.keep(misses.groupBy("key").agg(F.min_by(F.struct("question_id", "question"), "question_id").alias("x")).select("key", "x.*"))
        if once.limit(1).count():
            fresh = run(once.select("question_id", "question")).join(once.select("key", "question_id"), "question_id").drop("question_id", "question")
            _put(fresh, store, "answers")
        _put(keyed.select("key", F.current_timestamp().alias("used")).distinct(), store, "uses")
        answered = read(spark, store)
        found = steps.finish(keyed.join(answered, "key").drop("key"))
    if size(spark, store) > cap:
        evict(spark, store, cap)
    return found


def evict(spark: SparkSession, store: str, cap: int = CAP) -> None:
    """Merge the builds there are into one of the responses that were used last, of at most ``cap`` bytes.

    Sizes are those of the responses as JSON, scaled to the bytes of the
    files. Places in the order of use come from totals by time of use, not
    from all rows in one task. Builds that others add meanwhile stay.
    """
    builds, uses = _builds(spark, store, "answers"), _builds(spark, store, "uses")
    if not builds:
        return
    rows = spark.read.parquet(*builds).dropDuplicates(["key"])
    last = spark.read.parquet(*uses).groupBy("key").agg(F.max("used").alias("used")) if uses else rows.select("key", F.lit(None).cast("timestamp").alias("used"))
    with shared.Steps(spark) as steps:
        sized = steps.keep(rows.join(last, "key", "left").withColumn("bytes_", F.length(F.to_json(F.struct(*rows.columns)))))
        total = sized.agg(F.sum("bytes_")).first()[0] or 1
        share = cap * total / max(1, size(spark, store))
        by_time = sized.groupBy("used").agg(F.sum("bytes_").alias("n"))
        newer = F.coalesce(F.sum("n").over(Window.orderBy(F.desc_nulls_last("used")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        before = by_time.select("used", newer.alias("newer"))
        own = F.sum("bytes_").over(Window.partitionBy("used", F.substring("key", 1, 2)).orderBy("key"))
        placed = sized.alias("s").join(before.alias("b"), F.col("s.used").eqNullSafe(F.col("b.used"))).select("s.*", "b.newer").withColumn("own", own)
        # Of responses used at one time the 256 parts of their keys share what room is left.
        kept = placed.filter(F.col("newer") + 256 * F.col("own") <= share).select(*rows.columns)
        whole = placed.groupBy("used").agg((F.max("newer") + F.sum("bytes_")).alias("end_")).filter(F.col("end_") <= share).select(F.col("used").alias("u_"))
        fits = placed.join(F.broadcast(whole), F.col("used").eqNullSafe(F.col("u_")), "left_semi").select(*rows.columns)
        files = max(1, cap >> 27)
        left = steps.keep(fits.unionByName(kept).dropDuplicates(["key"]))
        _put(left.repartition(files, "key"), store, "answers")
        _put(left.select("key").join(last, "key").repartition(files, "key"), store, "uses")
    for build in [*builds, *uses]:
        shared.remove(spark, build)


def clear(spark: SparkSession, store: str) -> None:
    shared.remove(spark, store)
