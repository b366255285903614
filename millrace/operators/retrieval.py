"""Retrieval by shared words: the chunks with the most terms of a question, exactly, for any number of questions.

Questions go to the chunks, in blocks of a bounded number of questions and of
their terms. A task
looks its chunks' terms up in the block's vocabulary and counts, for a stretch
of chunks at a time, how many terms each question shares with each chunk, from
the block's lists of questions by term. Only the k best of a task for each
question leave it, so no term, however common, is a key of any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import clean
from millrace.sources.shared import Steps

#: Terms, and questions, that go to all tasks at once, and pairs of a chunk and a question that are counted at once.
BLOCK_TERMS, BLOCK_QUESTIONS, PAIRS = 1_000_000, 50_000, 1 << 21


def terms(text: Column) -> Column:
    """The different lower-case words of a text, without outer punctuation."""
    return F.array_distinct(F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), ""))


def share(of: Column, among: Column) -> Column:
    """The share of the terms of one text that are among another's; 0 for none."""
    mine = terms(of)
    return F.coalesce(F.try_divide(F.size(F.array_intersect(mine, terms(among))), F.size(mine)), F.lit(0.0))


@dataclass
class _Block:
    """Questions by term, and the value that each asks of each filter (-1: any)."""

    ids: pa.Array
    vocabulary: pa.Array
    first: np.ndarray
    who: np.ndarray
    values: list[pa.Array]
    wanted: np.ndarray


def _block(asked: pa.Table, filters: list[str]) -> _Block:
    listed = asked["terms"].combine_chunks()
    flat, owner = pc.list_flatten(listed), pc.list_parent_indices(listed).to_numpy()
    vocabulary = pc.unique(flat)
    at = pc.index_in(flat, value_set=vocabulary).to_numpy(zero_copy_only=False)
    order = np.argsort(at, kind="stable")
    first = np.concatenate([[0], np.cumsum(np.bincount(at, minlength=len(vocabulary)))]).astype(np.int64)
    values, wanted = [], np.full((len(filters), len(asked)), -1, np.int64)
    for k, c in enumerate(filters):
        own = asked[c].combine_chunks()
        values.append(pc.unique(own.drop_null()))
        wanted[k] = pc.fill_null(pc.index_in(own, value_set=values[k], skip_nulls=True), -1).to_numpy(zero_copy_only=False)
    return _Block(asked["question_id"].combine_chunks(), vocabulary, first, owner[order].astype(np.int64), values, wanted)


def _hits(owner: np.ndarray, term: np.ndarray, block: _Block, n: int) -> np.ndarray:
    """How many of these terms of ``n`` chunks each question has, from so many listed questions at a time: a common term is in most of them."""
    hits, n_q = np.zeros(n * len(block.ids), np.int64), len(block.ids)
    total = np.cumsum(block.first[term + 1] - block.first[term])
    a = 0
    while a < len(term):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + PAIRS, side="right")))
        own, at = owner[a:b], term[a:b]
        sizes = block.first[at + 1] - block.first[at]
        where = np.repeat(block.first[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        # The terms of a chunk lie together, so what is counted is a stretch of chunks.
        low, high = int(own[0]), int(own[-1]) + 1
        hits[low * n_q : high * n_q] += np.bincount((np.repeat(own, sizes) - low) * n_q + block.who[where], minlength=(high - low) * n_q)
        a = b
    return hits.reshape(n, n_q)


def _best(batch: pa.RecordBatch, block: _Block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of questions, places of chunks, hits) of the k best chunks of a batch for each question, ties by chunk_id."""
    n, n_q = len(batch), len(block.ids)
    listed = batch.column(1)
    found = pc.index_in(pc.list_flatten(listed), value_set=block.vocabulary)
    known = pc.is_valid(found).to_numpy(zero_copy_only=False)
    owner, term = pc.list_parent_indices(listed).to_numpy()[known].astype(np.int64), pc.drop_null(found).to_numpy(zero_copy_only=False)
    place = np.empty(n, np.int64)
    place[pc.sort_indices(batch.column(0)).to_numpy()] = np.arange(n)
    codes = [pc.fill_null(pc.index_in(batch.column(2 + i), value_set=v), -2).to_numpy(zero_copy_only=False) for i, v in enumerate(block.values)]
    best = np.zeros((k, n_q), np.int64)
    step = max(1, PAIRS // max(1, n_q))
    for start in range(0, n, step):
        end = min(n, start + step)
        a, b = np.searchsorted(owner, [start, end])
        hits = _hits(owner[a:b] - start, term[a:b], block, end - start)
        for i, code in enumerate(codes):
            hits[(block.wanted[i] != -1) & (block.wanted[i] != code[start:end, None])] = 0
        # The more hits the larger the key, and the smaller the place among the ids.
        keys = np.where(hits > 0, (hits << 32) | ((1 << 32) - 1 - place[start:end, None]), 0)
        best = np.sort(np.partition(np.concatenate([best, keys]), -k, axis=0)[-k:], axis=0)
    order = np.argsort(place)
    rows, who = np.nonzero(best)
    key = best[rows, who]
    return who, order[(1 << 32) - 1 - (key & ((1 << 32) - 1))], key >> 32


def _kept(found: list[pa.Table], k: int) -> pa.Table:
    """The k best chunks of each question among those of some batches, ties by chunk_id."""
    rows = pa.concat_tables(found).sort_by([("who", "ascending"), ("hits", "descending"), ("chunk_id", "ascending")])
    who = rows["who"].to_numpy()
    return rows.filter(pa.array(np.arange(len(who)) - np.searchsorted(who, who) < k))


def _counted(sent, k: int, kinds: tuple[pa.DataType, pa.DataType] | None = None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = sent.value
        found, least = [], 4 * k * max(1, len(block.ids))
        for batch in batches:
            if len(batch) and len(block.ids):
                who, chunk, hits = _best(batch, block, k)
                found.append(pa.table({"who": who, "chunk_id": batch.column(0).take(pa.array(chunk)), "hits": hits}))
                if sum(map(len, found)) > least:
                    found = [_kept(found, k)]
        if found:
            best = _kept(found, k)
            for out in pa.table({"question_id": block.ids.take(best["who"].combine_chunks()), "chunk_id": best["chunk_id"], "hits": best["hits"]}).combine_chunks().to_batches():
                yield out

    return run


def retrieve(questions: DataFrame, chunks: DataFrame, k: int, filters: list[str] | None = None, steps: Steps | None = None) -> DataFrame:
    """(question_id, chunk_id, text, score, rank): the k chunks with the most question terms, ties by chunk_id.

    ``questions`` has question_id, question and rewritten, whose terms take
    the question's place where it isn't null. Filters with a value must equal
    the chunk's. A score is the share of the question's terms. Chunks without
    any of its terms are not found. The chunks are scanned once for each
    ``BLOCK_TERMS`` terms of questions, or ``BLOCK_QUESTIONS`` of short ones,
    as a task holds the best of all questions of a block.
    """
    if steps is None:
        with Steps(questions.sparkSession) as own:
            return own.finish(retrieve(questions, chunks, k, filters, own))
    filters, spark = filters or [], questions.sparkSession
    asked = steps.keep(questions.select("question_id", terms(F.coalesce("rewritten", "question")).alias("terms"), *(clean(F.col(c).cast("string")).alias(c) for c in filters)))
    total, n = asked.agg(F.sum(F.size("terms")), F.count("*")).first()
    blocks = max(1, -(-(total or 0) // BLOCK_TERMS), -(-n // BLOCK_QUESTIONS))
    kinds = {c: t.simpleString() for c, t in ((f.name, f.dataType) for f in [questions.schema["question_id"], chunks.schema["chunk_id"]])}
    listed = chunks.select("chunk_id", terms(F.col("text")).alias("terms"), *(F.col(c).cast("string").alias(c) for c in filters))
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("hits"), "chunk_id"))
    best = None
    for block in range(blocks):
        sent = spark.sparkContext.broadcast(_block(asked.filter(F.pmod(F.xxhash64("question_id"), F.lit(blocks)) == block).toArrow(), filters))
        hits = listed.mapInArrow(_counted(sent, k), f"question_id {kinds['question_id']}, chunk_id {kinds['chunk_id']}, hits long")
        own = steps.keep(hits.withColumn("rank", rank).filter(F.col("rank") <= k))
        best = own if best is None else best.unionByName(own)
        sent.destroy()
    scored = best.join(asked.select("question_id", F.size("terms").alias("n_terms")), "question_id").withColumn("score", F.round(F.col("hits") / F.col("n_terms"), 4))
    return scored.join(chunks.select("chunk_id", "text"), "chunk_id").select("question_id", "chunk_id", "text", "score", "rank")


def _holding(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        ids, texts = sent.value
        found = ahocorasick.Automaton()
        for k, text in enumerate(texts):
            if text:
                found.add_word(text, [*found.get(text, []), k])
        found.make_automaton()
        always = [k for k, text in enumerate(texts) if text == ""]
        for batch in batches:
            docs, items = [], []
            for at, text in enumerate(batch.column(1).to_pylist()):
                if text is not None:
                    own = {k for _, ks in found.iter(text) for k in ks} if len(found) else set()
                    own |= set(always)
                    docs += [at] * len(own)
                    items += sorted(own)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(items, pa.int64())), batch.column(0).take(pa.array(docs, pa.int64()))], names=["item_id", "doc_id"])

    return run


#: Characters of the items that are looked for in one scan of the texts.
ITEM_CHARS = 8_000_000


def holders(items: DataFrame, docs: DataFrame) -> DataFrame:
    """(item_id, doc_id) of each of ``docs`` (doc_id, text) that holds an item of ``items`` (item_id, item), wherever in its text.

    All items of a block are looked for at once, in one pass over a text. An
    empty item is in every text; a null one, or a null text, is in none.
    """
    spark = items.sparkSession
    with Steps(spark) as steps:
        wanted = steps.keep(items.select("item_id", "item").filter("item is not null"))
        blocks = max(1, -(-(wanted.agg(F.sum(F.length("item"))).first()[0] or 0) // ITEM_CHARS))
        kinds = {"i": items.schema["item_id"].dataType.simpleString(), "d": docs.schema["doc_id"].dataType.simpleString()}
        found = None
        for block in range(blocks):
            own = wanted.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toArrow()
            sent = spark.sparkContext.broadcast((own["item_id"].combine_chunks(), own["item"].to_pylist()))
            part = steps.keep(docs.select("doc_id", "text").mapInArrow(_holding(sent), f"item_id {kinds['i']}, doc_id {kinds['d']}"))
            found = part if found is None else found.unionByName(part)
            sent.destroy()
        return steps.finish(found)
