"""Hard negatives by Fagin's threshold algorithm over integer vectors.

A task holds its rows in blocks. A block has, for each dimension, its rows
sorted by that component. An anchor reads these lists from the end that its
own sign prefers, a stretch of all lists at a time; each row that turns up is
scored at once by its whole integer product. What has not turned up can't
score more than the threshold, the sum over the dimensions of the anchor's
component times the value reached in that list. Reading stops when the
threshold is strictly below the k-th score of every window, so ties are seen.

Anchors are a stated set, taken in blocks of a bounded number that go to all
tasks; the best of each block of rows meet by anchor.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise, shared_dir, tidy

#: Rows of a block with its lists; anchors that go to all tasks at once; rows of each list in the first stretch.
BLOCK_ROWS, ANCHORS, STRETCH = 8192, 2048, 16
SCALE, K = 256, 5
EXACT = 1 << 53


def valid(rows: DataFrame) -> DataFrame:
    """(vec_id, label, q) of the rows with an id, a label and a finite vector; q is floor(256 * x) of each component."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    known = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("x"))
    bad = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf"))))
    return known.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~bad).select("vec_id", "label", F.transform("x", lambda v: F.floor(v * SCALE).cast("long")).alias("q"))


def _matrix(q: pa.Array) -> np.ndarray:
    """The vectors as rows; shorter ones end in zeros."""
    sizes = q.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = q.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def widened(m: np.ndarray, width: int) -> np.ndarray:
    return m if m.shape[1] >= width else np.pad(m, ((0, 0), (0, width - m.shape[1])))


class Lists:
    """Rows with a list of places for each dimension, by rising component."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray):
        self.ids, self.labels, self.q = ids, labels, q
        self.order = np.ascontiguousarray(np.argsort(q, axis=0, kind="stable").T.astype(np.int32))
        self.largest = int(np.abs(q).max(initial=0))
        self.plain = q.astype(np.float64)
        self.read = 0

    def scores(self, places: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        """Integer products; by floating point where every partial sum is exact."""
        if self.largest * int(np.abs(anchor).max(initial=0)) * max(len(anchor), 1) < EXACT:
            return (self.plain[places] @ anchor.astype(np.float64)).astype(np.int64)
        return self.q[places] @ anchor

    def search(self, anchor: np.ndarray, wanted: Callable[[np.ndarray], np.ndarray], done: Callable[[np.ndarray, int], bool]) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the ``wanted`` rows that sorted access gives until ``done(scores, threshold)``."""
        n = len(self.ids)
        own = np.flatnonzero(anchor)
        seen = np.zeros(n, bool)
        places, scores = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        depth, stretch = 0, STRETCH
        while depth < n and len(own):
            reach = min(n, depth + stretch)
            lists = [self.order[d, n - reach : n - depth] if anchor[d] > 0 else self.order[d, depth:reach] for d in own]
            flags = np.zeros(n, bool)
            flags[np.concatenate(lists)] = True
            new = np.flatnonzero(flags & ~seen)
            seen |= flags
            new = new[wanted(new)]
            if len(new):
                places.append(new)
                scores.append(self.scores(new, anchor))
            depth, stretch = reach, stretch * 4
            edge = np.asarray([self.q[self.order[d, n - reach if anchor[d] > 0 else reach - 1], d] for d in own])
            self.read += len(own) * len(lists[0])
            if done(np.concatenate(scores), int(edge @ anchor[own])) or seen.all():
                return np.concatenate(places), np.concatenate(scores)
        rest = np.flatnonzero(~seen)
        rest = rest[wanted(rest)]
        return np.concatenate([*places, rest]), np.concatenate([*scores, self.scores(rest, anchor)])


def best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= least)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _kth_above(scores: np.ndarray, k: int, threshold: int) -> bool:
    return len(scores) >= k and np.count_nonzero(scores > threshold) >= k


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    kept, n = [], 0
    for batch in batches:
        if len(batch):
            kept.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2))))
            n += len(batch)
        if n >= BLOCK_ROWS:
            yield _stacked(kept)
            kept, n = [], 0
    if kept:
        yield _stacked(kept)


def _stacked(kept: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    width = max(x[2].shape[1] for x in kept)
    return np.concatenate([x[0] for x in kept]), np.concatenate([x[1] for x in kept]), np.concatenate([widened(x[2], width) for x in kept])


def _fitted(anchor: np.ndarray, width: int) -> np.ndarray:
    """An anchor in the width of a block; what is beyond a vector's end is zero."""
    return np.pad(anchor, (0, max(0, width - len(anchor))))[:width]


def _rows(found: list[tuple[np.ndarray, ...]], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*found, strict=True)], names=names)


FOUND = "anchor long, vec_id long, score long"


def _positives(sent, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, labels, vectors = sent.value
        for own, kinds, q in _blocks(batches):
            out = []
            for label in np.unique(kinds[np.isin(kinds, np.unique(labels))]):
                mine = kinds == label
                lists = Lists(own[mine], kinds[mine], q[mine])
                for i in np.flatnonzero(labels == label):
                    places, scores = lists.search(_fitted(vectors[i], q.shape[1]), lambda new, i=i, lists=lists: lists.ids[new] != ids[i], lambda s, t: _kth_above(s, k, t))
                    keep = best(lists.ids[places], scores, k)
                    out.append((np.full(len(keep), at[i]), lists.ids[places[keep]], scores[keep]))
            if out:
                yield _rows(out, ["anchor", "vec_id", "score"])

    return tidy(run)


def _negatives(sent, k: int, low: int, high: int):
    """For each window (anchor, top score) the k best rows of other labels with low * top <= 100 * score <= high * top."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, labels, vectors, tops = sent.value
        for own, kinds, q in _blocks(batches):
            lists, out = Lists(own, kinds, q), []
            for i in range(len(at)):

                def done(scores: np.ndarray, threshold: int, i=i) -> bool:
                    for top in tops[i]:
                        if 100 * threshold < low * top:
                            continue  # nothing unseen reaches the window
                        if not _kth_above(scores[100 * scores <= high * top], k, threshold):
                            return False
                    return True

                if not len(tops[i]):
                    continue
                places, scores = lists.search(_fitted(vectors[i], q.shape[1]), lambda new, i=i: kinds[new] != labels[i], done)
                for top in tops[i]:
                    inside = np.flatnonzero((low * top <= 100 * scores) & (100 * scores <= high * top))
                    keep = inside[best(own[places[inside]], scores[inside], k)]
                    out.append((np.full(len(keep), at[i]), np.full(len(keep), top), own[places[keep]], scores[keep]))
            if out:
                yield _rows(out, ["anchor", "top", "vec_id", "score"])

    return tidy(run)


def _first(found: DataFrame, by: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, is_anchor: Column, k: int = K, low: int = 80, high: int = 100, relabel: Callable[[DataFrame], DataFrame] | None = None, anchors_at_once: int = ANCHORS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of ``rows`` (vec_id, embedding, label) that are anchors.

    Scores are integer products of floor(256 * x); they must fit in 64 bits.
    An anchor's positives are the k best other rows of its label; for each,
    the k best rows of other labels with low * positive <= 100 * negative <=
    high * positive are returned, ties by smaller vec_id. Rows with a null
    vec_id, label or vector or any null or non-finite component take no part;
    shorter vectors end in zeros. Other rows are those with another vec_id;
    repeated rows are rows of their own, repeated anchors are asked once.
    Other columns are not read. ``relabel`` changes labels before all else.
    """
    spark = rows.sparkSession
    known = valid(rows)
    known = relabel(known) if relabel else known
    asked = known.filter(is_anchor).dropDuplicates(["vec_id", "label", "q"])
    blocks = max(1, -(-asked.count() // anchors_at_once))
    asked = materialise(asked.withColumn("anchor", F.monotonically_increasing_id()).withColumn("block", F.pmod(F.xxhash64("vec_id", "q"), F.lit(blocks))))
    folder = shared_dir(spark)
    for block in range(blocks):
        _one_block(spark, known, asked.filter(F.col("block") == block), k, low, high).write.mode("append").parquet(folder)
    return spark.read.schema("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long").parquet(folder)


def _one_block(spark: SparkSession, known: DataFrame, asked: DataFrame, k: int, low: int, high: int) -> DataFrame:
    own = asked.select("anchor", "vec_id", "label", "q").toArrow()
    ids, labels = own["vec_id"].to_numpy(), own["label"].to_numpy()
    at, vectors = own["anchor"].to_numpy(), [np.asarray(x, np.int64) for x in own["q"].to_pylist()]
    sent = spark.sparkContext.broadcast((at, ids, labels, vectors))
    positives = materialise(_first(known.mapInArrow(_positives(sent, k), FOUND), ["anchor"], k))
    tops: dict[int, set[int]] = {}
    for r in positives.select("anchor", "score").distinct().toArrow().to_pylist():  # at most k for each anchor of a block
        tops.setdefault(r["anchor"], set()).add(r["score"])
    asked_for = spark.sparkContext.broadcast((at, labels, vectors, [sorted(tops.get(int(a), ())) for a in at]))
    found = known.mapInArrow(_negatives(asked_for, k, low, high), "anchor long, top long, vec_id long, score long")
    negatives = materialise(_first(found, ["anchor", "top"], k))
    sent.destroy()
    asked_for.destroy()
    wanted = positives.select("anchor", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    chosen = negatives.select("anchor", F.col("top").alias("positive_score"), "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = asked.select("anchor", F.col("vec_id").alias("anchor_id"))
    return wanted.join(chosen, ["anchor", "positive_score"]).join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
