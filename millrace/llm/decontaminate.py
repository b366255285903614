"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max skipping.

Scores are shares of an item's score for its own text, so that one threshold
fits items of any length. The index is dealt to blocks of items. Of each item
the terms that most items have, whose shares together stay under half the
threshold, are its rest; the others are essential. For each term the index
holds the greatest share that it adds as an essential term to any item of a
block, for each block the greatest rest of its items. As the threshold is
fixed and passages come in columns, bounds are summed for many passages and
all blocks at once, instead of moving one passage's pivot along sorted lists
as WAND does: a passage reaches a block only if the block's shares of its
terms and the block's rest pass the threshold together. Only reached blocks
are scored, exactly, from lists by block, and five-word windows of the
question part and the answer part of the item confirm it.

Statistics of terms and lengths are those of all items, and a passage's length
follows from the item's own, so how items are dealt to indexes changes no hit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise, tidy
from millrace.llm.grid import Grid, U, slices, windows, words

#: Retrieval takes items of this share of their own score; a hit needs these shares of all windows, and of each part's.
SCORE, OVERLAP, PART_OVERLAP = 0.6, 0.5, 0.25
WIDTH, BLOCK, LEAST_WINDOW = 5, 8, 64
#: Bytes of item texts whose indexes go to all tasks at once, at about ten times as many; documents are scanned once for each.
MOST_BYTES = 1 << 25
K1, B = 1.2, 0.75
HITS = "item_id long, score double, overlap double, question_overlap double, answer_overlap double"


#: Postings of blocks whose bounds are summed at once.
CELLS = 1 << 21


@dataclass
class Index:
    item_ids: list
    vocab: np.ndarray  # sorted word hashes
    own_first: np.ndarray  # postings of block b: own_first[b]:own_first[b + 1]
    own_term: np.ndarray
    own_item: np.ndarray
    own_share: np.ndarray
    block_first: np.ndarray  # blocks in which term t is essential to an item: block_first[t]:block_first[t + 1]
    block: np.ndarray
    block_share: np.ndarray
    rest: np.ndarray  # by block: the most that an item's other terms add
    window_first: np.ndarray  # window hashes of item k: windows[window_first[k]:window_first[k + 1]]
    windows: np.ndarray
    step: int  # half the words of a passage, no less than those of any item
    width: np.ndarray  # words of an item's windows: WIDTH, or all of a shorter item

    def parts(self, item: int) -> tuple[np.ndarray, np.ndarray]:
        """Window hashes of an item's question and answer."""
        own = self.windows[self.window_first[item] : self.window_first[item + 1]]
        half = -(-len(own) // 2)
        return own[:half], own[half:]


@dataclass
class Statistics:
    """Of all items: how many, words of the mean item, and in how many a term is (by sorted word hashes)."""

    items: int
    mean: float
    terms: np.ndarray
    df: np.ndarray


def statistics(texts: list[str | None]) -> Statistics:
    """Those of a few items."""
    grid = words(pa.array([x or "" for x in texts], pa.string()), punctuation=True, fold=True)
    of, terms = grid.row, grid.hashes
    terms, df = np.unique(np.unique(np.stack([terms, of.astype(U)], 1), axis=0)[:, 0], return_counts=True)
    return Statistics(len(texts), float(grid.n_words.mean()) if texts else 0.0, terms, df)


def build(item_ids: list, texts: list[str | None], known: Statistics | None = None, step: int | None = None) -> Index:
    """The index of some items among those that ``known`` tells of; an item without words is never found."""
    known = known or statistics(texts)
    col = pa.array([x or "" for x in texts], pa.string())
    grid = words(col, punctuation=True, fold=True)
    n = len(texts)
    vocab, term = np.unique(grid.hashes, return_inverse=True)
    pair, tf = np.unique(grid.row * np.int64(max(len(vocab), 1)) + term, return_counts=True)
    item, term = pair // max(len(vocab), 1), pair % max(len(vocab), 1)
    df = known.df[np.searchsorted(known.terms, vocab)]
    idf = np.log(1 + (known.items - df + 0.5) / (df + 0.5))
    size = grid.n_words
    add = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[item] / max(known.mean, 1))) if n else np.zeros(0)
    share = add / np.bincount(item, add, n)[item] if n else add
    # Each item's terms from the most frequent on: its rest are those whose shares stay under half the threshold together.
    order = np.lexsort((term, -df[term], item))
    item, term, share = item[order], term[order], share[order]
    total = np.cumsum(share)
    begin = np.searchsorted(item, np.arange(n + 1))
    before = np.concatenate([[0.0], total])[begin[item]] if n else total
    essential = total - before > SCORE / 2
    n_blocks = max(1, -(-n // BLOCK))
    block = item // BLOCK
    key, back = np.unique(term[essential] * np.int64(n_blocks) + block[essential], return_inverse=True)
    top = np.zeros(len(key))
    np.maximum.at(top, back, share[essential])
    rest = np.zeros(n_blocks)
    np.maximum.at(rest, np.arange(n) // BLOCK, np.bincount(item[~essential], share[~essential], n))
    win = windows(grid, WIDTH)
    return Index(
        list(item_ids), vocab, np.searchsorted(block, np.arange(n_blocks + 1)), term.astype(np.int32), item.astype(np.int32), share,
        np.searchsorted(key // n_blocks, np.arange(len(vocab) + 1)), (key % n_blocks).astype(np.int32), top, rest,
        np.asarray(win.first), win.hashes, step or half_passage(int(size.max()) if n else 0), np.minimum(size, WIDTH),
    )


def half_passage(n_words: int) -> int:
    """The least power of two times ``LEAST_WINDOW`` that is no less than the words of an item."""
    step = LEAST_WINDOW
    while step < n_words:
        step *= 2
    return step


def _spread(first: np.ndarray, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each posting of the terms: which of them, and where."""
    n = first[terms + 1] - first[terms]
    of = np.repeat(np.arange(len(terms)), n)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + first[terms][of]


def search(index: Index, grid: Grid, score: float = SCORE) -> Iterator[tuple[int, int, float, float, float, float]]:
    """(row, item, score, overlap, question's, answer's) of all confirmed items of each row, the best passage of each.

    Passages are stretches of ``2 * index.step`` words that overlap by half, so
    every stretch as long as an item lies in one.
    """
    if not len(grid.hashes) or not len(index.vocab):
        return
    at = np.searchsorted(index.vocab, grid.hashes)
    at[at == len(index.vocab)] = 0
    term = np.where(index.vocab[at] == grid.hashes, at, -1)
    step = index.step
    row = grid.row
    place = np.arange(len(row)) - grid.first[row]
    n_windows = np.maximum(-(-grid.n_words // step), 1)
    base = np.concatenate([[0], np.cumsum(n_windows)])
    wanted = np.diff(index.block_first) > 0
    held = np.flatnonzero((term >= 0) & wanted[np.maximum(term, 0)])
    if not len(held):
        return
    window = base[row[held]] + place[held] // step
    key = window * np.int64(len(index.vocab)) + term[held]
    key = np.unique(np.concatenate([key, (key - len(index.vocab))[place[held] >= step]]))
    window, t = key // len(index.vocab), key % len(index.vocab)
    present = np.zeros(len(index.vocab), bool)
    best: dict[tuple[int, int], tuple] = {}
    for w, blocks in _reached(index, window, t, score):
        r = int(np.searchsorted(base, w, side="right")) - 1
        start = grid.first[r] + (w - base[r]) * step
        end = min(start + 2 * step, grid.first[r + 1])
        own = term[start:end]
        own = own[own >= 0]
        present[own] = True
        _, post = _spread(index.own_first, blocks)
        post = post[present[index.own_term[post]]]
        present[own] = False
        items, back = np.unique(index.own_item[post], return_inverse=True)
        total = np.bincount(back, index.own_share[post], len(items))
        found = np.flatnonzero(total >= score)
        if not len(found):
            continue
        passage, seen_by = Grid(grid.hashes[start:end], np.asarray([0, end - start])), {}
        for k in found.tolist():
            item = int(items[k])
            width = int(index.width[item])
            if width not in seen_by:
                seen_by[width] = windows(passage, width).hashes
            seen = seen_by[width]
            question, answer = index.parts(item)
            hit = [int(np.isin(x, seen).sum()) for x in (question, answer)]
            shares = [h / len(x) if len(x) else 1.0 for h, x in zip(hit, (question, answer), strict=True)]
            overlap = sum(hit) / max(len(question) + len(answer), 1)
            if overlap >= OVERLAP and min(shares) >= PART_OVERLAP:
                best[r, item] = max(best.get((r, item), ()), (overlap, float(total[k]), *shares))
    for (r, item), (overlap, total, q, a) in sorted(best.items()):
        yield r, item, total, overlap, q, a


def _reached(index: Index, window: np.ndarray, term: np.ndarray, score: float) -> Iterator[tuple[int, np.ndarray]]:
    """(passage, blocks that it reaches) from the different essential terms of passages, in order; bounds of about ``CELLS`` postings at a time."""
    n_blocks = len(index.rest)
    sizes = index.block_first[term + 1] - index.block_first[term]
    total = np.concatenate([[0], np.cumsum(sizes)])
    ends = np.append(np.flatnonzero(np.diff(window)) + 1, len(window))
    start = 0
    while start < len(window):
        # As many whole passages as fit, one at least.
        fits = np.searchsorted(total[ends], total[start] + CELLS, side="right") - 1
        end = int(ends[max(fits, np.searchsorted(ends, start, side="right"))])
        of, post = _spread(index.block_first, term[start:end])
        cell, back = np.unique(window[start:end][of] * np.int64(n_blocks) + index.block[post], return_inverse=True)
        reach = np.bincount(back, index.block_share[post], len(cell)) + index.rest[cell % n_blocks]
        cell = cell[reach >= score - 1e-9]
        passages = cell // n_blocks
        cuts = np.flatnonzero(np.diff(passages)) + 1
        for own in np.split(cell, cuts) if len(cell) else ():
            yield int(own[0] // n_blocks), own % n_blocks
        start = end


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with their word counts and different terms."""
    for batch in batches:
        for at, texts in slices(batch.column(1)):
            grid = words(texts, punctuation=True, fold=True)
            terms = [np.unique(grid.hashes[a:b]).view(np.int64) for a, b in zip(grid.first[:-1], grid.first[1:], strict=True)]
            own = batch.slice(at, len(texts))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(grid.n_words), pa.array(terms, pa.list_(pa.int64()))], names=["item_id", "text", "n", "terms"])


def indexes(benchmark: DataFrame, most_bytes: int = MOST_BYTES) -> Iterator[list[Index]]:
    """For each scan of the documents, the indexes of about ``most_bytes`` of items, one for each length of passages."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    items = materialise(items.mapInArrow(tidy(_described), "item_id long, text string, n long, terms array<long>"))
    total = items.agg(F.count("*").alias("items"), F.sum("n").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    if not total["n"]:
        return
    df = materialise(items.select(F.explode("terms").alias("term")).groupBy("term").count())
    scans = max(1, -(-total["bytes"] // most_bytes))
    for k in range(scans):
        own = items.filter(F.expr(f"n > 0 and pmod(xxhash64(item_id, text), {scans}) = {k}"))
        counts = df.join(own.select(F.explode("terms").alias("term")).distinct(), "term").toPandas() if scans > 1 else df.toPandas()
        terms = counts["term"].to_numpy(np.int64).view(U)
        order = np.argsort(terms)
        known = Statistics(total["items"], total["n"] / total["items"], terms[order], counts["count"].to_numpy()[order])
        rows: pd.DataFrame = own.select("item_id", "text", "n").orderBy("item_id", "text").toPandas()
        step = rows["n"].map(half_passage)
        found = []
        for size in sorted(step.unique()):
            some = rows[step == size]
            found.append(build([None if pd.isna(x) else int(x) for x in some["item_id"]], some["text"].tolist(), known, int(size)))
        yield found


def _hits(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), *[pa.float64()] * 4]
        names = ["doc_id", "item_id", "score", "overlap", "question_overlap", "answer_overlap"]
        for batch in batches:
            for at, texts in slices(batch.column(1)):
                grid = words(texts, punctuation=True, fold=True)
                doc = batch.column(0).slice(at, len(texts))
                ids = [(doc[r].as_py(), index.item_ids[i], *rest) for index in shared.value for r, i, *rest in search(index, grid)]
                if ids:
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*ids, strict=True), kinds, strict=True)], names=names)

    return tidy(run)


def leaks(docs: DataFrame, benchmark: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(doc_id, item_id, score, overlap, question_overlap, answer_overlap) of each row of docs and item that it holds.

    Words end at ASCII white space or punctuation, A to Z in any case. The
    question is the first half of an item's windows, the answer the rest. An
    item of fewer than five words is held where all of them follow each other. Null
    or empty texts hold nothing, null or empty items are never held; rows with
    the same or no doc_id each give their own rows. Other columns are not read.
    The rows are the same for any ``most_bytes``.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = docs.sparkSession.createDataFrame([], f"doc_id long, {HITS}")
    for k, found in enumerate(indexes(benchmark, most_bytes)):
        shared = docs.sparkSession.sparkContext.broadcast(found)
        held = ids.mapInArrow(_hits(shared), out.schema)
        out = out.union(held) if k else held
    return out


def _clean(shared, at_text: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(at_text)):
                grid = words(texts, punctuation=True, fold=True)
                held = {r for index in shared.value for r, *_ in search(index, grid)}
                keep = np.asarray([k not in held for k in range(len(texts))], bool)
                yield batch.slice(at, len(texts)).filter(pa.array(keep))

    return tidy(run)


def decontaminated(docs: DataFrame, benchmark: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The rows of ``docs`` (text, any more) that hold no item, as they are; nothing is shuffled."""
    for found in indexes(benchmark, most_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(found)
        docs = docs.mapInArrow(_clean(shared, docs.columns.index("text")), docs.schema)
    return docs
