"""From raw documents to packed sequences: rules, lines, copies, benchmarks, packing.

Each stage takes what the one before it kept, as a Parquet table, and all but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import materialise, table
from millrace.llm.decontaminate import decontaminated
from millrace.llm.linededup import deduplicated as without_lines
from millrace.llm.neardup import deduplicated as without_copies
from millrace.llm.packing import packed
from millrace.llm.quality import quality


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """``docs`` with clean_text as its text, and n_chars, if there is one, of that."""
    text = docs.withColumn("text", F.col("clean_text"))
    if "n_chars" in columns:
        text = text.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return text.select(*columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their host's boilerplate lines."""
    return _with_text(quality(docs).filter("kept"), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that ten documents hold; one of which nothing is left goes.

    A line that only copies of one single text hold stays: the next stage keeps
    one of them, which would otherwise have lost all its lines.
    """
    return _with_text(without_lines(docs, spare_single=True).filter("n_dropped < n_lines"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return without_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 1024 token ids."""
    return packed(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Signatures and token ids can't be told in SQL; the tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs)
    return docs
