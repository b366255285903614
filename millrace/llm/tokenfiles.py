"""Token ids as Parquet list columns, written and read in tasks by pyarrow.

A file holds a range of doc_ids in order: doc_id and n_tokens delta-encoded,
ids as dictionary-encoded lists, in row groups of a bounded number of ids with
page indexes, so that a reader can take the metadata columns or single
documents only. Files are named anew by each attempt, and only those that the
manifest lists count, so that a lost or repeated task does no harm.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise, shared_dir, tidy
from millrace.llm.encoding import encoder, vocabulary
from millrace.llm.grid import slices

GROUP_IDS = 1 << 20
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
MANIFEST = "part int, file string, n_docs long, n_ids long, least long, most long"


def _write(path: str, folder: str, group_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, writer, name = TaskContext.get().partitionId(), None, ""
        docs = ids_written = 0
        least = most = None
        held, size = [], 0

        def flush() -> None:
            nonlocal held, size
            if held:
                writer.write_table(pa.Table.from_batches(held, SCHEMA), row_group_size=1 << 40)
                held, size = [], 0

        for batch in batches:
            for at, texts in slices(batch.column(1), 1 << 22):
                names = batch.column(0).slice(at, len(texts))
                rows = [x + bytes(4) for x in encoder(path).encode([x or "" for x in texts.to_pylist()])]
                if writer is None:
                    store, place = fs.FileSystem.from_uri(folder)
                    store.create_dir(place, recursive=True)
                    name = f"{folder}/ids-{part:08d}-{uuid.uuid4().hex}.parquet"
                    sink = store.open_output_stream(fs.FileSystem.from_uri(name)[1])
                    writer = pq.ParquetWriter(sink, SCHEMA, compression="zstd", compression_level=1, use_dictionary=["ids.list.element"], column_encoding={"doc_id": "DELTA_BINARY_PACKED", "n_tokens": "DELTA_BINARY_PACKED"}, write_page_index=True, data_page_version="2.0")
                counts = np.asarray([len(x) // 4 for x in rows], np.int64)
                ends = np.concatenate([[0], np.cumsum(counts)])
                flat = np.frombuffer(b"".join(rows), np.int32)
                known = names.drop_null()
                if len(known):
                    low, high = known[0].as_py(), known[-1].as_py()
                    least, most = low if least is None else least, high
                k = 0
                while k < len(rows):
                    to = max(k + 1, int(np.searchsorted(ends, ends[k] + group_ids - size, side="right")) - 1)
                    values = pa.array(flat[ends[k] : ends[to]])
                    lists = pa.ListArray.from_arrays(pa.array((ends[k : to + 1] - ends[k]).astype(np.int32)), values)
                    held.append(pa.RecordBatch.from_arrays([names.slice(k, to - k), pa.array(counts[k:to]), lists], schema=SCHEMA))
                    size += int(ends[to] - ends[k])
                    if size >= group_ids or to < len(rows):
                        flush()
                    k = to
                docs, ids_written = docs + len(rows), ids_written + int(ends[-1])
        if writer is not None:
            flush()
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pylist(
                [{"part": part, "file": name, "n_docs": docs, "n_ids": ids_written, "least": least, "most": most}],
                schema=pa.schema([("part", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("least", pa.int64()), ("most", pa.int64())]),
            )

    return tidy(run, lambda: encoder(path).forget())


def write(docs: DataFrame, folder: str | None = None, vocab: str = "byte_bpe_50k.json", group_ids: int = GROUP_IDS) -> DataFrame:
    """Write the ids of ``docs`` (doc_id, text) in ascending doc_id order; the manifest, a row a file in order of part.

    A document is the ids of its text and then id 0; a null or empty text is
    that id alone. Null doc_ids come first; rows with the same doc_id are
    ordered by their text. An empty table writes no file. The folder's file
    system must be one that pyarrow opens by URI from any executor.
    """
    tie = F.xxhash64("text")
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(F.asc_nulls_first("doc_id"), tie)
    ordered = ordered.sortWithinPartitions(F.asc_nulls_first("doc_id"), tie, "text")
    return materialise(ordered.mapInArrow(_write(vocabulary(vocab), folder or shared_dir(docs.sparkSession), group_ids), MANIFEST))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            store, place = fs.FileSystem.from_uri(row["file"])
            before = row["before"]
            with store.open_input_file(place) as source:
                for group in pq.ParquetFile(source).iter_batches(batch_size=4096):
                    counts = group.column(1).to_numpy(zero_copy_only=False)
                    lists = group.column(2)
                    ends = lists.offsets.to_numpy()
                    data = memoryview(lists.values.to_numpy()).cast("B")
                    sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
                    starts = before + np.cumsum(counts) - counts
                    before += int(counts.sum())
                    yield pa.RecordBatch.from_arrays([group.column(0), pa.array(starts), pa.array(counts), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(manifest: DataFrame) -> DataFrame:
    """Each document of the files: doc_id, start (ids of all before it), n_tokens, ids_crc32.

    Each file has a task of its own, which reads it by row groups. Where files
    start follows from the manifest, which has a row a file.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0).cast("long")).alias("before"))
    files = materialise(files)
    spread = files.repartition(max(1, files.count()))
    return spread.mapInArrow(tidy(_read), "doc_id long, start long, n_tokens long, ids_crc32 long")


def opened(manifest: DataFrame) -> DataFrame:
    """The files of ``manifest`` as a table (doc_id, n_tokens, ids) for selective reading; no row for an empty manifest.

    Spark reads the columns that are asked for only, so that counts cost no
    ids, and a filter on doc_id reaches the files, where statistics of row
    groups and page indexes pass over what it rules out. Files of attempts
    that failed, which the manifest lacks, are left out.
    """
    spark, schema = manifest.sparkSession, "doc_id long, n_tokens long, ids array<int>"
    first = manifest.select("file").first()
    if first is None:
        return spark.createDataFrame([], schema)
    names = manifest.select(F.substring_index("file", "/", -1).alias("name_"))
    rows = spark.read.schema(schema).parquet(first["file"].rsplit("/", 1)[0]).withColumn("name_", F.col("_metadata.file_name"))
    return rows.join(names, "name_", "left_semi").drop("name_")
