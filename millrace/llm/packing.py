"""Harmonic packing of documents' token ids into sequences of a fixed capacity.

A piece of length in (C / (j + 1), C / j] is of class j, and each sequence of
class j takes j pieces, whatever else there is. Pieces get their place in a
class from counts by task, so that every task fills its sequences on its own.
Documents are cut so that most pieces fill their share of a sequence exactly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise, tidy
from millrace.llm.encoding import encoder, vocabulary
from millrace.llm.grid import slices

CAPACITY, CLASSES = 1024, 128
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int, part int, rank long"


def class_of(length: int, capacity: int = CAPACITY, classes: int = CLASSES) -> int:
    return min(capacity // length, classes)


def cut(tokens: int, capacity: int = CAPACITY, classes: int = CLASSES, whole: bool = False) -> list[int]:
    """Lengths of the pieces of a document, in order.

    Each but the last is the largest reciprocal of the capacity that fits; what
    is left below an eighth of it stays whole, as little is lost in its class.
    If ``whole``, all that is left after full sequences stays whole.
    """
    out = [capacity] * (tokens // capacity)
    left = tokens % capacity
    while left > capacity // 8 and not whole:
        share = capacity // -(-capacity // left)
        out.append(share)
        left -= share
    return out + [left] * (left > 0)


def _pieces(path: str, capacity: int, classes: int, whole: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, int] = {}
        part = TaskContext.get().partitionId()
        for batch in batches:
            for at, texts in slices(batch.column(1), 1 << 22):
                names = batch.column(0).slice(at, len(texts)).to_pylist()
                rows = []
                for name, ids in zip(names, encoder(path).encode([x or "" for x in texts.to_pylist()]), strict=True):
                    ids = memoryview(ids + bytes(4))
                    start, total = 0, len(ids) // 4
                    for length in cut(total, capacity, classes, whole):
                        kind = class_of(length, capacity, classes)
                        rank = made.get(kind, 0)
                        made[kind] = rank + 1
                        rows.append((name, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, kind, part, rank))
                        start += length
                if rows:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                    columns = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "part", "rank")
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(columns))

    return tidy(run, lambda: encoder(path).forget())


def _tail(capacity: int, classes: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """First fit, longest first, of what the classes leave: less than one sequence of each."""
        rows = rows.sort_values(["length", "class", "bin", "rank"], ascending=[False, True, True, True], kind="stable")
        free: list[int] = []
        bins, offsets = [], []
        for length in rows["length"]:
            k = next((k for k, x in enumerate(free) if x >= length), len(free))
            if k == len(free):
                free.append(capacity)
            bins.append(k)
            offsets.append(capacity - free[k])
            free[k] -= length
        return rows.assign(sequence_id=np.asarray(bins, np.int64) * (classes + 1), offset=np.asarray(offsets, np.int64))[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def packed(docs: DataFrame, vocab: str = "byte_bpe_50k.json", capacity: int = CAPACITY, classes: int = CLASSES, whole: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their places in sequences of ``capacity`` ids.

    A document is the ids of its text and then id 0; a null or empty text is
    that id alone. Each id is in exactly one piece (doc_id, start, length,
    ids_crc32, doc_tokens, sequence_id, offset); the pieces of a sequence leave
    no gap. Rows with the same or no doc_id are packed each. Other columns of
    docs are not read. A sequence of class j > 0 has id bin * (classes + 1) + j; sequences
    of class 0 hold what the classes leave over, fewer than j pieces of each.

    Cutting what is left of a document to exact shares makes two to three
    pieces of it and leaves little padding. With ``whole`` a document that fits
    in a sequence is one piece, at the padding that its class leaves.
    """
    pieces = materialise(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(vocabulary(vocab), capacity, classes, whole), PIECES))
    counts = pieces.groupBy("class", "part").agg(F.max("rank").alias("top")).withColumn("n", F.col("top") + 1)
    before = Window.partitionBy("class").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    totals = counts.groupBy("class").agg(F.sum("n").alias("total"))
    bases = materialise(counts.select("class", "part", "base").join(totals, "class"))
    placed = pieces.join(bases, ["class", "part"]).withColumn("rank", F.col("base") + F.col("rank"))
    placed = placed.withColumn("bin", F.expr("rank div class")).withColumn("full", F.expr("bin < total div class"))
    place = Window.partitionBy("class", "bin").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    full = placed.filter("full").withColumn("sequence_id", F.col("bin") * (classes + 1) + F.col("class"))
    full = full.withColumn("offset", F.coalesce(F.sum("length").over(place), F.lit(0).cast("long"))).select(columns)
    tail = placed.filter("not full").withColumn("all_", F.lit(0)).groupBy("all_").applyInPandas(_tail(capacity, classes), full.schema)
    return full.union(tail)
