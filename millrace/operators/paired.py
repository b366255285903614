"""Paired statistics by group: signed ranks and bootstrap intervals."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RESAMPLES, SEED, CONFIDENCE = 10_000, 42, 0.95
#: Different values in a block, by expectation, and resamples that a task draws at once.
BLOCK_VALUES, CHUNK = 4_096, 250


def differences(pairs: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """(group, d): b - a of the pairs that have both."""
    return pairs.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & ~F.isnan(a) & ~F.isnan(b)).select(group, (F.col(b) - F.col(a)).cast("double").alias("d"))


def signed_ranks(diffs: DataFrame, group: str) -> DataFrame:
    """(group, n, w, variance) of one-sided signed ranks; zeros are ranked and shared between the signs.

    Equal sizes are counted first, so ranks need only the different sizes of a
    group in order, not its pairs.
    """
    by_size = diffs.groupBy(group, F.abs("d").alias("size")).agg(F.count("*").alias("t"), F.count_if(F.col("d") < 0).alias("below"), F.count_if(F.col("d") == 0).alias("zero"))
    order = Window.partitionBy(group).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = by_size.withColumn("rank", F.coalesce(F.sum("t").over(order), F.lit(0)) + (F.col("t") + 1) / 2)
    found = ranked.groupBy(group).agg(
        F.sum("t").alias("n"), F.sum(F.col("rank") * (F.col("below") + F.col("zero") / 2)).alias("w"), F.sum(F.col("t") * F.col("t") * F.col("t") - F.col("t")).alias("ties")
    )
    n = F.col("n")
    return found.select(group, "n", "w", (n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48).alias("variance"))


def wilcoxon(diffs: DataFrame, group: str) -> DataFrame:
    """(group, n, w, p): the one-sided test that b is greater; p is null below two pairs."""
    ranked = signed_ranks(diffs, group)
    z = (F.col("w") - F.col("n") * (F.col("n") + 1) / 4) / F.sqrt("variance")

    @F.pandas_udf("double")
    def below(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if pd.isna(v) else 0.5 * math.erfc(-v / math.sqrt(2)))

    return ranked.select(group, "n", "w", F.when((F.col("n") >= 2) & (F.col("variance") > 0), below(z)).alias("p"))


def _ends(drawn: np.ndarray, mean: float, skew: float, confidence: float) -> tuple[float | None, float | None]:
    """The interval from the resamples' means and the acceleration; none if all means lie on one side."""
    normal = NormalDist()
    low = ((drawn < mean).sum() + (drawn <= mean).sum()) / (2 * len(drawn))
    if low in (0, 1):
        return None, None
    bias = normal.inv_cdf(low)
    ends = []
    for q in ((1 - confidence) / 2, (1 + confidence) / 2):
        z = bias + normal.inv_cdf(q)
        ends.append(float(np.quantile(drawn, normal.cdf(bias + z / (1 - skew * z)))))
    return ends[0], ends[1]


def _draw(seed: int, resamples: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                first = int(row.chunk) * CHUNK
                n = min(CHUNK, resamples - first)
                sizes = np.asarray([x["size"] for x in row.sizes], np.int64)
                at = [x["block"] for x in row.sizes].index(row.block)
                name = zlib.crc32(row.id.encode())
                # The same for all blocks of a group, so that the blocks' shares of a resample add up to its pairs.
                shares = np.random.default_rng([seed, name, int(row.chunk)]).multinomial(int(sizes.sum()), sizes / sizes.sum(), n)[:, at]
                t = np.asarray([x["t"] for x in row.own], np.int64)
                own = np.random.default_rng([seed, name, int(row.chunk), int(row.block) + 1])
                values = np.asarray([x["d"] for x in row.own], np.float64)
                part = [float(own.multinomial(m, t / t.sum()) @ values) for m in shares]
                yield pd.DataFrame({"id": row.id, "resample": np.arange(first, first + n), "part": part})

    return run


def bootstrap(diffs: DataFrame, group: str, resamples: int = RESAMPLES, seed: int = SEED, confidence: float = CONFIDENCE) -> DataFrame:
    """(group, n, low, high): the bias-corrected and accelerated bootstrap interval of each group's mean, from the counts of its different values.

    None below three pairs or without spread. A resample is a multinomial over
    blocks of values, and one over the values of each block, with random
    numbers by group, run of resamples and block; a group has as many blocks
    as its own different values ask for. So its interval is the same however
    the rows are dealt and whatever other groups there are. Blocks and runs go
    to tasks, and only a group's means of resamples come together.
    """
    values = diffs.groupBy(group, "d").agg(F.count("*").alias("t"))
    facts = values.groupBy(group).agg(F.sum("t").alias("n"), (F.sum(F.col("t") * F.col("d")) / F.sum("t")).alias("mean"), F.count("*").alias("different"))
    parts = F.ceil(F.col("f.different") / BLOCK_VALUES)
    same_group = F.col(f"v.{group}").eqNullSafe(F.col(f"f.{group}"))
    values = values.alias("v").join(facts.alias("f"), same_group).select("v.*", F.pmod(F.xxhash64("v.d"), parts).alias("block"))
    blocks = values.groupBy(group, "block").agg(F.sum("t").alias("size"), F.array_sort(F.collect_list(F.struct("d", "t"))).alias("own"))
    same = F.col(f"v.{group}").eqNullSafe(F.col(f"f.{group}"))
    off = F.col("v.d") - F.col("f.mean")
    power = lambda k: F.sum(F.col("v.t") * F.pow(off, k))
    skewed = values.alias("v").join(facts.alias("f"), same).groupBy(f"f.{group}", "f.n", "f.mean", "f.different").agg(power(3).alias("u3"), power(2).alias("u2"))
    skewed = skewed.withColumn("id", F.to_json(F.struct(group)))
    dealt = blocks.alias("v").join(blocks.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("block", "size"))).alias("sizes")).alias("f"), same)
    dealt = dealt.select(F.to_json(F.struct(f"v.{group}")).alias("id"), "v.block", "v.own", "f.sizes", F.explode(F.sequence(F.lit(0), F.lit(-(-resamples // CHUNK) - 1))).alias("chunk"))
    drawn = dealt.repartition("id", "block", "chunk").mapInPandas(_draw(seed, resamples), "id string, resample long, part double").groupBy("id", "resample").agg(F.sum("part").alias("total"))
    means = drawn.groupBy("id").agg(F.collect_list("total").alias("totals"))

    @F.pandas_udf("low double, high double")
    def ends(totals: pd.Series, n: pd.Series, mean: pd.Series, different: pd.Series, u3: pd.Series, u2: pd.Series) -> pd.DataFrame:
        out = []
        for x, k, m, kinds, a, b in zip(totals, n, mean, different, u3, u2, strict=True):
            out.append((None, None) if k < 3 or kinds < 2 else _ends(np.asarray(x) / k, m, a / k**3 / (6 * (b / k**2) ** 1.5), confidence))
        return pd.DataFrame(out, columns=["low", "high"], dtype="float64")

    found = skewed.join(means, "id").select(group, "n", ends("totals", "n", "mean", "different", "u3", "u2").alias("x"))
    return found.select(group, "n", "x.low", "x.high")
