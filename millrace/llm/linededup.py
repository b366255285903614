"""Removing lines that many documents hold, by a sharded minimal perfect hash over line hashes.

The index has one row a shard: a minimal perfect hash (levels of bit arrays,
each key at the first level where it is alone), and by its slot a 32-bit
fingerprint and the count of documents. Texts send their line hashes to the
shards and get back those that are frequent; no line is joined or moved.

A line is named by a 64-bit hash. A second hash tells whether two lines share
a name; such lines are named anew by both hashes.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise
from millrace.llm.grid import GOLDEN, U, mix

SPACES = "\t\n\x0b\x0c\r "
#: Keys a shard holds at most, by expectation, and the least number of shards.
SHARD_KEYS, SHARDS = 1_000_000, 64
#: Copies of a mean shard's arrays among which the texts are dealt. A shard with a line that most texts hold gets more in proportion, so that no task has much more than others.
SALTS = 8
GAMMA = 1.5


def build(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Serialised index of distinct 64-bit keys and their counts."""
    levels, left, level = [], keys, 0
    while len(left):
        size = max(64, int(np.ceil(len(left) * GAMMA / 64)) * 64)
        at = _at(left, level, size)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        left, level = left[~alone[at]], level + 1
    bits = [np.packbits(x, bitorder="little") for x in levels]
    head = struct.pack(f"<qq{len(levels)}q", len(keys), len(levels), *(len(x) for x in levels))
    body = b"".join(x.tobytes() for x in bits)
    slots = _slots(levels, keys)
    prints, held = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.int64)
    prints[slots], held[slots] = _prints(keys), counts
    return head + body + prints.tobytes() + held.tobytes()


def probe(blob: bytes, keys: np.ndarray) -> np.ndarray:
    """Counts of the keys; 0 for a key whose fingerprint differs."""
    n, n_levels = struct.unpack_from("<qq", blob)
    sizes = struct.unpack_from(f"<{n_levels}q", blob, 16)
    at, levels = 16 + 8 * n_levels, []
    for size in sizes:
        levels.append(np.unpackbits(np.frombuffer(blob, np.uint8, size // 8, at), bitorder="little").astype(bool))
        at += size // 8
    if not n:
        return np.zeros(len(keys), np.int64)
    prints, held = np.frombuffer(blob, np.uint32, n, at), np.frombuffer(blob, np.int64, n, at + 4 * n)
    slots = _slots(levels, keys)
    known = slots >= 0
    known[known] = prints[slots[known]] == _prints(keys[known])
    return np.where(known, held[np.where(known, slots, 0)], 0)


def _at(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((mix(keys.view(U) + U(level + 1) * GOLDEN) >> U(32)) * U(size) >> U(32)).astype(np.int64)


def _prints(keys: np.ndarray) -> np.ndarray:
    return (mix(keys.view(U) ^ GOLDEN) >> U(32)).astype(np.uint32)


def _slots(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The slot of each key; -1 for one that no level holds."""
    out, left, before = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for level, alone in enumerate(levels):
        at = _at(keys[left], level, len(alone))
        here = alone[at]
        out[left[here]] = before + (np.cumsum(alone) - 1)[at[here]]
        before += int(alone.sum())
        left = left[~here]
    return out


def line_key(line: Column) -> Column:
    """A line without outer white space, A to Z in lower case."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.trim(line, F.lit(SPACES)), upper, upper.lower())


def name(key: Column) -> Column:
    return F.xxhash64(key)


def check(key: Column) -> Column:
    """A second hash of a key, by another rule than its name."""
    return F.crc32(key)


def renamed(key: Column) -> Column:
    """The name of a key whose first name another key has, too."""
    return F.xxhash64(check(key), name(key), F.length(key))


def line_hashes(text: Column, least: int) -> Column:
    """Names, checks and second names of the different keys of at least ``least`` code points."""
    keys = F.filter(F.transform(F.split(text, "\n"), line_key), lambda k: F.length(k) >= least)
    return F.array_distinct(F.transform(keys, lambda k: F.struct(name(k).alias("h"), check(k).alias("g"), renamed(k).alias("other"))))


def shared_names(lines: DataFrame) -> DataFrame:
    """(h) of the names that keys with different checks have, one row each."""
    return lines.groupBy("h").agg(F.min("g").alias("low"), F.max("g").alias("high")).filter("low <> high").select("h")


def line_counts(docs: DataFrame, least: int = 1, copies: bool = True, spare_single: bool = False) -> tuple[DataFrame, DataFrame]:
    """(text_key, h) of each text's lines, and (h, n) with the documents that hold each.

    Copies count each time or once; with ``spare_single`` they count each time
    but where all are of one text, which then counts once.
    """
    lines = docs.filter("text is not null").select(F.xxhash64("text").alias("text_key"), F.explode(line_hashes(F.col("text"), least)).alias("x")).select("text_key", "x.*")
    lines = materialise(lines.groupBy("text_key", "h", "g").agg(F.count("*").alias("copies"), F.first("other").alias("other")))
    clashing = materialise(shared_names(lines).withColumn("clash", F.lit(True)))
    if clashing.limit(1).count():
        lines = materialise(lines.join(clashing, "h", "left").withColumn("h", F.when(F.col("clash"), F.col("other")).otherwise(F.col("h"))).drop("clash"))
    lines = lines.select("text_key", "h", "copies")
    each, once = F.sum("copies"), F.count("*")
    if spare_single:
        each = F.when(once == 1, F.lit(1).cast("long")).otherwise(each)
    return lines, lines.groupBy("h").agg((each if copies else once).alias("n"))


def _build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": [key[0]], "load": [rows["n"].sum()], "blob": [build(rows["h"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))]})


def index(counts: DataFrame, n_keys: int) -> tuple[DataFrame, int]:
    """(shard, load, blob), a row a shard, and the number of shards, which follows the number of keys."""
    shards = max(SHARDS, -(-n_keys // SHARD_KEYS))
    by_shard = counts.select(F.expr(f"pmod(h, {shards})").alias("shard"), "h", "n")
    return materialise(by_shard.groupBy("shard").applyInPandas(_build, "shard long, load long, blob binary")), shards


def _probe(least: int, _: tuple, lines: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
    if lines.empty or arrays.empty:
        return lines.iloc[:0][["text_key", "h"]]
    return lines.loc[probe(arrays["blob"].iloc[0], lines["h"].to_numpy(np.int64)) >= least, ["text_key", "h"]]


def frequent(lines: DataFrame, arrays: DataFrame, shards: int, documents: int) -> DataFrame:
    """(text_key, hs): each text's line hashes that ``documents`` or more hold."""
    total = arrays.agg(F.sum("load")).first()[0] or 1
    salts = materialise(arrays.select("shard", F.ceil(F.col("load") * shards * SALTS / total).alias("salts")))
    dealt = lines.withColumn("shard", F.expr(f"pmod(h, {shards})")).join(salts, "shard")
    dealt = dealt.select("shard", F.expr("pmod(xxhash64(text_key), salts)").alias("salt"), "text_key", "h")
    copies = arrays.join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), "blob")
    hits = dealt.groupBy("shard", "salt").cogroup(copies.groupBy("shard", "salt")).applyInPandas(partial(_probe, documents), "text_key long, h long")
    return hits.groupBy("text_key").agg(F.collect_list("h").alias("hs"))


def deduplicated(docs: DataFrame, documents: int = 10, least: int = 1, copies: bool = True, spare_single: bool = False) -> DataFrame:
    """``docs`` (text, any more) with n_lines, n_dropped and clean_text.

    Lines end at \\n only; the key of a line is the line without outer ASCII
    white space, with A to Z in lower case. Keys of ``least`` code points or
    more that ``documents`` or more rows hold lose all their lines, the others
    are joined again. A null text is one empty line: clean_text is then "".
    Repeated rows and copies of a text count each, or once without ``copies``;
    with ``spare_single`` a key counts once if only copies of one text hold it.
    Columns of docs named like results are replaced.
    """
    docs = docs.drop("n_lines", "n_dropped", "clean_text")
    lines, counts = line_counts(docs, least, copies, spare_single)
    counts = materialise(counts)
    arrays, shards = index(counts, counts.count())
    hits = materialise(frequent(lines, arrays, shards, documents))
    found = docs.withColumn("text_key_", F.when(F.col("text").isNotNull(), F.xxhash64("text"))).join(hits.select(F.col("text_key").alias("text_key_"), F.col("hs").alias("hits_")).hint("merge"), "text_key_", "left")
    split = F.split(F.coalesce("text", F.lit("")), "\n")
    kept = F.when(F.col("hits_").isNull(), split).otherwise(
        F.transform(F.array("hits_"), lambda hs: F.filter(split, lambda line: ~(F.array_contains(hs, name(line_key(line))) | F.array_contains(hs, renamed(line_key(line)))) | (F.length(line_key(line)) < least)))[0]
    )
    out = found.select(*docs.columns, F.size(split).cast("long").alias("n_lines"), kept.alias("kept_"))
    return out.select(*docs.columns, "n_lines", (F.col("n_lines") - F.size("kept_")).alias("n_dropped"), F.array_join("kept_", "\n").alias("clean_text"))
