"""Checks of chunks as one long table: doc_id, check, status."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.splitting import measure

# Chunks a document may have, and categories it needs, by type.
COUNTS = {"MPC_minutes": (5, 40), "MPR": (20, 200), "FSR": (20, 250), "speech": (3, 40)}
REQUIRED = {"MPC_minutes": ["individual_statement", "voting"], "MPR": ["box_analysis"], "FSR": ["box_analysis"]}
MARKS = {"voting": r"\*\*Votes to", "individual_statement": r"(?m)^\*\*[A-Za-z][A-Za-z .'-]+:\*\*", "box_analysis": r"\[BOX START"}
SHORT_EXEMPT = ["voting", "individual_statement"]
MIN_CHARS, MOST, BOX_MOST, OVERLAP = 50, 1200, 2000, 50
MEDIAN, BALANCE, CORPUS_BALANCE = (150, 800), (0.85, 1.10), (0.90, 1.10)


def _by_type(pick, other) -> Column:
    return reduce(lambda rest, kind: F.when(F.col("document_type") == kind, F.lit(pick(kind))).otherwise(rest), COUNTS, F.lit(other))


def document_checks(chunks: DataFrame, docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, check, status) for each of ``docs`` (doc_id, text, document_type), chunks or none.

    All checks come from one aggregation of the chunks by document. Sizes are
    those that the chunks were made with: words, or tokens of a vocabulary file.
    """
    fail = lambda bad: F.count_if(bad)
    is_box = F.col("section_category") == "box_analysis"
    text = F.lower(F.col("text"))
    empty = reduce(lambda a, c: a | F.coalesce(F.col(c).cast("string"), F.lit("")).eqNullSafe(""), ["text", "document_type", "date", "section_category"], F.coalesce(F.col("chunk_id"), F.lit("")) == "")
    facts = chunks.groupBy("doc_id").agg(
        F.count("*").alias("n"),
        F.collect_set("section_category").alias("present"),
        fail((F.col("section_category") == "voting") & ~text.contains("vote") & ~text.contains("bank rate")).alias("bad_votes"),
        fail(is_box & ~F.col("text").contains("[BOX START") & ~F.col("text").contains("Box")).alias("bad_boxes"),
        fail(empty).alias("bad_fields"),
        fail((F.length("text") < MIN_CHARS) & ~F.col("section_category").isin(SHORT_EXEMPT)).alias("too_short"),
        fail((F.col("token_count") > BOX_MOST) | (~is_box & (F.col("token_count") > MOST))).alias("too_large"),
        F.median(F.when(~is_box, F.col("token_count"))).alias("median"),
        F.sum("token_count").alias("tokens"),
    )
    known = docs.select("doc_id", "text", "document_type").join(facts, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    low, high = _by_type(lambda k: COUNTS[k][0], 1), _by_type(lambda k: COUNTS[k][1], 500)
    required = reduce(lambda rest, k: F.when(F.col("document_type") == k, F.array(*map(F.lit, REQUIRED[k]))).otherwise(rest), REQUIRED, F.array().cast("array<string>"))
    missing = F.array_except(required, F.coalesce("present", F.array().cast("array<string>")))
    in_source = reduce(lambda a, k: a | (F.array_contains(missing, k) & F.coalesce(F.col("text"), F.lit("")).rlike(MARKS[k])), MARKS, F.lit(False))
    no = lambda c: F.when(F.coalesce(F.col(c), F.lit(0)) > 0, "fail").otherwise("pass")
    ratio = F.try_divide(F.col("tokens") - OVERLAP * (F.col("n") - 1), measure(vocabulary).count(F.col("text")))
    results = {
        "chunk_count": F.when(F.col("n") < low, "fail").when(F.col("n") > high, "warn").otherwise("pass"),
        "required_categories": F.when(F.size(missing) == 0, "pass").when(in_source, "fail").otherwise("warn"),
        "voting_keywords": no("bad_votes"),
        "box_markers": no("bad_boxes"),
        "required_fields": no("bad_fields"),
        "min_text_length": no("too_short"),
        "max_size": no("too_large"),
        "median_size": F.when(F.col("n") == 0, "fail").when(F.col("median").isNull() | F.col("median").between(*MEDIAN), "pass").otherwise("warn"),
        "token_balance": F.when(ratio.between(*BALANCE), "pass").otherwise("warn"),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("check"), v.alias("status")) for k, v in results.items()])
    return known.select("doc_id", F.explode(rows).alias("x")).select("doc_id", "x.*")


def corpus_checks(enhanced: DataFrame, baseline: DataFrame) -> DataFrame:
    """(check, status) of ids over both sets of chunks, and of their sizes against each other."""
    ids = enhanced.select("chunk_id").unionByName(baseline.select("chunk_id"))
    copies = ids.groupBy("chunk_id").count().agg(F.count_if(F.col("count") > 1).alias("copies"))
    own = enhanced.groupBy("doc_id").agg((F.sum("token_count") - OVERLAP * (F.count("*") - 1)).alias("t")).agg(F.sum("t").alias("t"))
    ratio = own.crossJoin(baseline.agg(F.sum("token_count").alias("b"))).select(F.try_divide("t", "b").alias("ratio"))
    unique = copies.select(F.lit("unique_chunk_ids").alias("check"), F.when(F.col("copies") > 0, "fail").otherwise("pass").alias("status"))
    return unique.unionByName(ratio.select(F.lit("corpus_token_balance").alias("check"), F.when(F.col("ratio").between(*CORPUS_BALANCE), "pass").otherwise("warn").alias("status")))


def report(checks: DataFrame) -> DataFrame:
    """Whether each document passed: no check failed."""
    return checks.groupBy("doc_id").agg(F.bool_and(F.col("status") != "fail").alias("passed"), F.count_if(F.col("status") == "warn").alias("n_warnings"))
