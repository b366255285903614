"""Reading and writing manifests, texts, chunks, score records and results."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.text import HEADING_RULES, cache_name, clean, normalise_speaker, word_count
from millrace.sources.site import site_texts

MANIFEST = "filename string, document_type string, date string, title string, source_url string, word_count int, status string, speaker string"
SCORES = "pipeline string, query_id string, metric string, score double, skipped string, err string, ts string"
CHUNK = "chunk_id string, text string, token_count int, metadata struct<document_type:string,date:string,section_category:string,speaker:string,source_url:string,paragraph_range:string,title:string>"


def manifest(pages: DataFrame) -> DataFrame:
    """A manifest row for each of ``pages`` (filename, document_type, date, title, source_url, speaker, text, any error).

    Without a text it is missing; a blank title is the filename, a speaker is
    a first and a last name without titles, null for none. The error of a page
    that could not be read follows the fields of ``MANIFEST``, and then its
    page_id, if pages have one: pages may share an address, and so a filename.
    """
    status = F.when(F.col("text").isNull(), "missing").otherwise("ok")
    title = F.coalesce(clean(F.trim("title")), F.col("filename"))
    error = (F.col("error") if "error" in pages.columns else F.lit(None).cast("string")).alias("error")
    return pages.select("filename", "document_type", "date", title.alias("title"), "source_url", word_count(F.col("text")).cast("int").alias("word_count"), status.alias("status"), clean(normalise_speaker(F.col("speaker"))).alias("speaker"), error, *(["page_id"] if "page_id" in pages.columns else []))


def site_manifest(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The manifest and the texts (filename, text) of ``pages`` (page_id, url, html, document_type, date).

    Files are named by their pages' addresses; a page that can't be read is a
    missing row with its error.
    """
    found = site_texts(pages).join(pages.select("page_id", "url", "document_type", "date"), "page_id")
    named = found.withColumn("filename", F.regexp_replace(cache_name(F.col("url")), "html$", "txt")).withColumn("source_url", F.col("url"))
    return manifest(named), named.filter("text is not null").select("filename", "text")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest CSV; the speaker column may be missing."""
    raw = spark.read.csv(path, header=True, multiLine=True, escape='"')
    names = [x.split() for x in MANIFEST.split(", ")]
    return raw.select(*[(F.col(c) if c in raw.columns else F.lit(None)).cast(kind).alias(c) for c, kind in names])


def write_csv(df: DataFrame, path: str) -> None:
    """A report as CSV with a header; doubles with four places, null as nothing."""
    shown = [F.when(F.col(c).isNotNull(), F.format_string("%.4f", F.col(c))).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes]
    df.select(*shown).write.mode("overwrite").csv(path, header=True)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(filename, text) of whole text files."""
    return spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("filename"), F.col("value").alias("text"))


def to_chunk(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The manifest rows that can be chunked, with their texts: status ok, a known type, and a text."""
    return rows.filter((F.col("status") == "ok") & F.col("document_type").isin(list(HEADING_RULES))).join(texts, "filename")


def write_chunks(chunks: DataFrame, path: str) -> None:
    """One JSON object for each document: its facts, totals and chunks in order."""
    meta = ["document_type", "date", "section_category", "speaker", "source_url", "paragraph_range", "title"]
    facts = ["doc_id", "document_type", "date", "source_url", "title"]
    one = F.struct("chunk_no", "chunk_id", "text", F.struct(*meta).alias("metadata"), "token_count")
    listed = chunks.groupBy(*facts).agg(F.count("*").alias("total_chunks"), F.sum("token_count").alias("total_tokens"), F.array_sort(F.collect_list(one)).alias("x"))
    own = F.transform("x", lambda x: F.struct(*[x[c].alias(c) for c in ("chunk_id", "text", "metadata", "token_count")]))
    listed.select(F.col("doc_id").alias("document"), *facts[1:], "total_chunks", "total_tokens", own.alias("chunks")).write.mode("overwrite").json(path)


def write_baseline_chunks(chunks: DataFrame, path: str) -> None:
    """One JSON object for each document: totals and chunks of id, text and size only."""
    one = F.struct("chunk_no", "chunk_id", "text", "token_count")
    listed = chunks.groupBy("doc_id").agg(F.count("*").alias("total_chunks"), F.sum("token_count").alias("total_tokens"), F.array_sort(F.collect_list(one)).alias("x"))
    own = F.transform("x", lambda x: F.struct(*[x[c].alias(c) for c in ("chunk_id", "text", "token_count")]))
    listed.select(F.col("doc_id").alias("document"), "total_chunks", "total_tokens", own.alias("chunks")).write.mode("overwrite").json(path)


def read_chunks(spark: SparkSession, path: str, baseline: bool = False) -> DataFrame:
    """Index records of chunk JSON: id, text and, unless ``baseline``, metadata with an empty speaker for none."""
    kind = "chunk_id string, text string, token_count int" if baseline else CHUNK
    rows = spark.read.schema(f"document string, chunks array<struct<{_nested(kind)}>>").json(path, multiLine=False)
    rows = rows.select(F.explode("chunks").alias("c"))
    if baseline:
        return rows.select(F.col("c.chunk_id").alias("id"), "c.text")
    return rows.select(F.col("c.chunk_id").alias("id"), "c.text", F.col("c.metadata").withField("speaker", F.coalesce("c.metadata.speaker", F.lit(""))).alias("metadata"))


def _nested(ddl: str) -> str:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl).simpleString().removeprefix("struct<").removesuffix(">")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` with their numbers from 1 in the order in which they are read, from counts by partition."""
    placed = rows.withColumn("at_", F.monotonically_increasing_id()).withColumn("part_", F.shiftrightunsigned("at_", 33))
    counts = placed.groupBy("part_").agg(F.count("*").alias("n_"))
    before = F.coalesce(F.sum("n_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = F.broadcast(counts.select("part_", before.alias("before_")))
    own = F.col("at_") - F.shiftleft("part_", 33)
    return placed.join(bases, "part_").withColumn(name, F.col("before_") + own + 1).drop("at_", "part_", "before_")


def read_tests(spark: SparkSession, path: str) -> DataFrame:
    """A test-set CSV with question_id q01, q02, ... by the order of its rows."""
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    return numbered(rows, "number_").withColumn("question_id", F.format_string("q%02d", "number_")).drop("number_")


def fingerprint(tests: DataFrame, order: str = "question_id") -> DataFrame:
    """One row with test_set_hash: ``sha256:`` and the hash of a line of JSON for each row in order, keys sorted, values without outer white space.

    Rows are sorted in ranges; a hash reads its lines in order, so one task
    reads the ranges one after another, a batch at a time.
    """
    columns = [c for c in tests.columns if c != order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, first = hashlib.sha256(), True
        for batch in batches:
            for row in batch.to_pylist():
                told = {k: v.strip() if v is not None else None for k, v in row.items()}
                state.update(("" if first else "\n").encode() + json.dumps(told, sort_keys=True, ensure_ascii=False).encode())
                first = False
        yield pa.RecordBatch.from_pydict({"test_set_hash": [f"sha256:{state.hexdigest()}"]})

    lines = tests.orderBy(order).select(*(F.col(c).cast("string").alias(c) for c in columns))
    return lines.coalesce(1).mapInArrow(run, "test_set_hash string")


def read_scores(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Score records in order of their position; corrupt lines fail if ``strict`` and are passed over otherwise.

    position tells the order of lines, later files after earlier ones, so that
    the last record of a key can win.
    """
    at = F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line")
    lines = spark.read.text(path).select("value", *at).filter(F.trim("value") != "")
    parsed = lines.withColumn("r", F.from_json("value", SCORES, {"mode": "FAILFAST" if strict else "PERMISSIVE"}))
    return parsed.filter("r.query_id is not null").select("r.*", F.struct("time", "file", "line").alias("position"))


def append_scores(scores: DataFrame, path: str) -> None:
    scores.select(*[x.split()[0] for x in SCORES.split(", ")]).write.mode("append").json(path)


def read_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Pipeline results from a JSON object keyed by question: question_id and the fields of ``schema``."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.from_json("value", f"map<string,struct<{_nested(schema)}>>")).alias("question_id", "r")).select("question_id", "r.*")
