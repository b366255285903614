"""Marked-up documents to sections: one pass of windows over the lines of each document.

Lines that begin a section are ``## ``, ``### ``, ``**Votes to ...**``,
``**Name:** ...`` and ``[BOX START: ...]``; a box goes on to its ``[BOX END]``
whatever stands in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import category, word_count
from millrace.operators.folds import cut_at, merged_at

# The marks of sections.
H2, H3 = r"^## (.+)$", r"^### (.+)$"
PARAGRAPH = r"^(\d+)[:.]\s(.+)"
VOTE = r"^\*\*Votes to .+\*\*$"
MEMBER = r"^\*\*([A-Za-z .'-]+):\*\*\s*(.+)"
BOX_START, BOX_END = r"^\[BOX START: (.+)\]$", r"^\[BOX END\]$"

MERGE_BELOW = 150
APART = ["box_analysis", "voting", "individual_statement"]


def sections(docs: DataFrame) -> DataFrame:
    """The sections of ``docs`` (doc_id, text) in order of seq.

    Gives heading, section_type (h2, h3, box, vote, member, text), lines,
    paragraph_numbers, speaker, parent_h2 and parent_h3. Sections without a
    heading or any text are left out; a null text has none. doc_id must tell
    the documents apart.
    """
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).withColumn("line", F.regexp_replace("raw", r"\s+$", ""))
    order = Window.partitionBy("doc_id").orderBy("pos")
    before, so_far = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    edge = F.when(F.col("line").rlike(BOX_START), "start").when(F.col("line").rlike(BOX_END), "end")
    lines = lines.withColumn("edge", edge).withColumn("in_box", F.coalesce(F.last("edge", True).over(before) == "start", F.lit(False)))
    line = F.col("line")
    kind = (
        F.when(F.col("in_box"), None)
        .when(line.rlike(BOX_START), "box")
        .when(line.rlike(H2), "h2")
        .when(line.rlike(H3), "h3")
        .when(line.rlike(VOTE), "vote")
        .when(line.rlike(MEMBER), "member")
    )
    lines = lines.withColumn("kind", kind).withColumn("box_ended", F.coalesce(F.lag(F.col("in_box") & (F.col("edge") == "end")).over(order), F.lit(False)))
    marks = {"box": BOX_START, "h2": H2, "h3": H3, "member": MEMBER}
    heading = F.when(F.col("kind") == "vote", line)
    for name, mark in marks.items():
        heading = heading.when(F.col("kind") == name, F.regexp_extract("line", mark, 1))
    lines = lines.withColumn("heading", heading).withColumn("section", F.sum((F.col("kind").isNotNull() | F.col("box_ended")).cast("int")).over(so_far))
    title = F.when(F.col("kind").isin("h2", "h3"), F.struct("kind", "heading"))
    lines = lines.withColumn("h2", F.last(F.when(F.col("kind") == "h2", F.col("heading")), True).over(so_far)).withColumn("title", F.last(title, True).over(so_far))
    number = F.when(~F.col("in_box") & F.col("kind").isNull(), F.regexp_extract("line", PARAGRAPH, 1))
    lines = lines.withColumn("number", F.when(number != "", number.cast("int")))
    first = lambda c: F.min_by(c, "pos")
    found = lines.groupBy("doc_id", "section").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("lines"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("number").isNotNull(), F.struct("pos", "number")))), lambda x: x["number"]).alias("paragraph_numbers"),
        F.coalesce(first("kind"), F.lit("text")).alias("section_type"),
        F.coalesce(first("heading"), F.lit("")).alias("heading"),
        F.coalesce(first("h2"), F.lit("")).alias("h2"),
        first("title").alias("title"),
    )
    found = found.filter((F.col("heading") != "") | F.exists("lines", lambda x: F.trim(x) != ""))
    h3 = F.when(F.col("title.kind") == "h3", F.col("title.heading")).otherwise("")
    return found.select(
        "doc_id",
        F.row_number().over(Window.partitionBy("doc_id").orderBy("section")).alias("seq"),
        "heading",
        "section_type",
        "lines",
        "paragraph_numbers",
        F.when(F.col("section_type") == "member", F.col("heading")).alias("speaker"),
        F.when(F.col("section_type") == "h2", "").otherwise(F.col("h2")).alias("parent_h2"),
        F.when(F.col("section_type").isin("h2", "h3"), "").otherwise(h3).alias("parent_h3"),
    )


def body(lines: Column) -> Column:
    """The text of a section's lines without outer white space."""
    return F.regexp_replace(F.array_join(lines, "\n"), r"^\s+|\s+$", "")


def categorised(found: DataFrame, document_type: Column, count: Callable[[Column], Column] = word_count) -> DataFrame:
    return found.withColumn("category", category(F.col("heading"), F.col("section_type"), document_type)).withColumn("tokens", count(body(F.col("lines"))))


def merged(found: DataFrame) -> DataFrame:
    """Neighbouring small sections of one category joined.

    A section joins the one before it, with all that has joined that, if both
    are of the same category, which is not one of ``APART``, and both are
    below ``MERGE_BELOW`` words.
    """
    fields = ["heading", "section_type", "lines", "paragraph_numbers", "speaker", "parent_h2", "parent_h3", "category", "tokens"]
    listed = found.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", *fields))).alias("s"))
    facts = F.transform("s", lambda x: F.struct(F.when(~x["category"].isin(APART), x["category"]).alias("kind"), x["tokens"].alias("size")))

    def joined(run: Column) -> Column:
        first = lambda c: F.get(run, F.lit(0))[c]
        either = lambda c: F.coalesce(F.get(F.filter(F.transform(run, lambda x: x[c]), lambda v: v != ""), F.lit(0)), F.element_at(run, -1)[c])
        every = lambda c: F.flatten(F.transform(run, lambda x: x[c]))
        return F.struct(
            either("heading").alias("heading"), first("section_type").alias("section_type"), every("lines").alias("lines"), every("paragraph_numbers").alias("paragraph_numbers"), either("speaker").alias("speaker"),
            either("parent_h2").alias("parent_h2"), either("parent_h3").alias("parent_h3"), first("category").alias("category"), F.aggregate(run, F.lit(0).cast("long"), lambda t, x: t + x["tokens"]).alias("tokens"),
        )

    folded = listed.select("doc_id", F.posexplode(cut_at(F.col("s"), merged_at(facts, MERGE_BELOW), joined)).alias("seq", "x"))
    return folded.select("doc_id", (F.col("seq") + 1).alias("seq"), "x.*")
