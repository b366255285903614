"""Near-duplicate classes by BagMinHash signatures, bands and exact multiset overlap.

The weight of a five-word window in a text is how often it occurs there. Each
window owns independent Poisson processes over the dyadic rings (0, 1], (1, 2],
(2, 4], ... of the weight axis; a point counts for a text if the discretised
weight at which it lies is within the window's weight there. The first point of
each of the ``M`` components is the signature, so two texts agree on a component
with the probability of their weighted Jaccard similarity. Rings make the work
grow with the logarithm of a weight, and points beyond a bound on a text's
latest component are never generated.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialise, tidy
from millrace.llm.grid import GOLDEN, Grid, U, mix, slices, windows, words

WIDTH, SIMILARITY = 5, 0.8
M, ROWS = 128, 4
#: Differing bits of two 128-bit sketches beyond which texts aren't compared: at similarity 0.8, 13 are expected and more than 32 have odds under 1e-6.
MOST_BITS = 32
#: Texts and their windows in a block of a cluster; columns of a block's matrix, and bytes of text, that are in memory at a time.
BLOCK, BLOCK_WORDS, COLUMNS, SLICE = 1024, 1 << 18, 1 << 12, 1 << 18


def uid_of(seed: int):
    """A 64-bit name of a text; null for null."""
    return F.when(F.col("text").isNotNull(), F.xxhash64("text", F.lit(seed))).alias("uid")


def weights(grid: Grid) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and count of each distinct window."""
    row = grid.row
    order = np.lexsort((grid.hashes, row))
    row, x = row[order], grid.hashes[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return row[at], x[at], np.diff(at, append=len(x))


def bag_min_hash(row: np.ndarray, x: np.ndarray, w: np.ndarray, n_rows: int) -> np.ndarray:
    """Signatures (n_rows, M) as uint64; a row without windows has zeros."""
    total = np.bincount(row, w, n_rows)
    sig = np.zeros((n_rows, M), U)
    todo, slack = np.flatnonzero(total > 0), 2.0
    while len(todo):
        slot = np.full(n_rows, -1)
        slot[todo] = np.arange(len(todo))
        bound = M / total[todo] * (np.log(M) + slack)
        mine = slot[row] >= 0
        r, k, weight = slot[row[mine]], x[mine], w[mine]
        rings = np.ceil(np.log2(weight)).astype(np.int64) + 1
        of = np.repeat(np.arange(len(r)), rings)
        ring = np.arange(len(of)) - np.repeat(np.cumsum(rings) - rings, rings)
        r, weight = r[of], weight[of]
        low = np.where(ring > 0, 2.0 ** (ring - 1), 0.0)
        width = np.where(ring > 0, low, 1.0)
        with np.errstate(over="ignore"):
            state = mix(k[of] + ring.astype(U) * GOLDEN)
        t = np.zeros(len(r))
        cells, times, names = [], [], []
        while len(r):
            with np.errstate(over="ignore"):
                state = mix(state + GOLDEN)
            t = t - np.log((state >> U(11)).astype(np.float64) * 2.0**-53 + 2.0**-54) / width
            on = t <= bound[r]
            r, t, state, low, width, weight = r[on], t[on], state[on], low[on], width[on], weight[on]
            other = mix(state ^ U(0xD6E8FEB86659FD93))
            level = np.ceil(low + (other >> U(32)).astype(np.float64) * 2.0**-32 * width + 2.0**-33)
            ok = level <= weight
            cells.append(r[ok] * M + (other[ok] & U(M - 1)).astype(np.int64))
            times.append(t[ok])
            names.append(other[ok])
        cell, when, name = (np.concatenate(v) for v in (cells, times, names))
        first = np.full(len(todo) * M, np.inf)
        np.minimum.at(first, cell, when)
        is_first = when == first[cell]
        found = np.zeros(len(todo) * M, U)
        found[cell[is_first]] = mix(name[is_first] + U(1))
        full = np.isfinite(first).reshape(-1, M).all(1)
        sig[todo[full]] = found.reshape(-1, M)[full]
        todo, slack = todo[~full], slack * 2 + 1
    return sig


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ones = U(1) << np.arange(64, dtype=U)
    for batch in batches:
        both = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1)], 1)
        batch = batch.take(pa.array(np.sort(np.unique(both, axis=0, return_index=True)[1])))
        for at, col in slices(batch.column(2), SLICE):
            grid = windows(words(col), WIDTH)
            sig = bag_min_hash(*weights(grid), len(col))
            keep = np.flatnonzero(grid.n_words)
            sig = sig[keep]
            with np.errstate(over="ignore"):
                band = np.zeros((len(keep), M // ROWS), U)
                for k in range(ROWS):
                    band = mix(band + sig[:, k::ROWS])
                band = mix(band + np.arange(M // ROWS, dtype=U) * GOLDEN)
            bits = (sig >> U(17)) & U(1)
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(k).slice(at, len(col)).take(pa.array(keep)) for k in (0, 1)),
                    pa.array(grid.n_words[keep]),
                    *(pa.array((bits[:, h : h + 64] * ones).sum(1, dtype=U).view(np.int64)) for h in (0, 64)),
                    pa.ListArray.from_arrays(pa.array(np.arange(0, band.size + 1, M // ROWS, dtype=np.int32)), pa.array(band.ravel().view(np.int64))),
                ],
                names=["uid", "check", "n", "s1", "s2", "bands"],
            )


def overlap(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Multiset Jaccard similarity of the windows of a[k] and b[k]; 0 if either has none."""
    parts = [windows(words(v), WIDTH) for v in (a, b)]
    with np.errstate(over="ignore"):
        keys = [mix(g.hashes + g.row.astype(U) * GOLDEN) for g in parts]
    both, back = np.unique(np.concatenate(keys), return_inverse=True)
    n = len(keys[0])
    shared = np.minimum(np.bincount(back[:n], minlength=len(both)), np.bincount(back[n:], minlength=len(both)))
    pair = np.zeros(len(both), np.int64)
    pair[back] = np.concatenate([g.row for g in parts])
    common = np.bincount(pair, shared, len(a))
    return common / np.maximum(parts[0].n_words + parts[1].n_words - common, 1)


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, col in slices(batch.column(2), SLICE):
            own = batch.slice(at, len(col))
            yield own.filter(pa.array(overlap(col, own.column(3)) >= SIMILARITY)).select([0, 1])


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (a, b) whose texts reach the similarity."""
    sides = pairs.join(texts.select(F.col("uid").alias("a"), F.col("text").alias("ta")), "a")
    sides = sides.join(texts.select(F.col("uid").alias("b"), F.col("text").alias("tb")), "b")
    return sides.select("a", "b", "ta", "tb").mapInArrow(tidy(_verified), "a long, b long")


def alike(x: str, y: str):
    """Whether sketches and sizes of two texts allow the similarity."""
    bits = F.expr(f"bit_count({x}.s1 ^ {y}.s1) + bit_count({x}.s2 ^ {y}.s2)")
    low, high = F.least(f"{x}.n", f"{y}.n"), F.greatest(f"{x}.n", f"{y}.n")
    return (bits <= MOST_BITS) & (low >= SIMILARITY * high)


def components(edges: DataFrame) -> DataFrame:
    """(uid, comp) for each end of an edge; comp is the least uid that links lead to.

    Each round every node takes the least label of its neighbours, then the
    label of its label; the number of rounds is logarithmic for the shallow
    components that stars of links make. Only counts reach the driver.
    """
    both = materialise(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = materialise(both.groupBy(F.col("a").alias("uid")).agg(F.min("b").alias("b")).select("uid", F.least("uid", "b").alias("comp")))
    while True:
        heard = both.join(labels.withColumnRenamed("uid", "b"), "b").groupBy(F.col("a").alias("uid")).agg(F.min("comp").alias("near"))
        nearer = labels.join(heard, "uid").select("uid", F.col("comp").alias("old"), F.least("comp", "near").alias("comp"))
        jump = labels.select(F.col("uid").alias("comp"), F.col("comp").alias("next"))
        stepped = materialise(nearer.join(jump, "comp").select("uid", "old", F.least("comp", "next").alias("comp")))
        labels = stepped.select("uid", "comp")
        if not stepped.filter("comp <> old").limit(1).count():
            return labels


def _masses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, col in slices(batch.column(1), SLICE):
            row, x, w = weights(windows(words(col), WIDTH))
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(col)).take(pa.array(row)), pa.array(x.view(np.int64)), pa.array(w)], names=["uid", "x", "w"])


def own_mass(texts: DataFrame) -> DataFrame:
    """(uid, own): the weight of the windows that no other of these texts has."""
    found = texts.mapInArrow(tidy(_masses), "uid long, x long, w long")
    single = found.groupBy("x").agg(F.count("*").alias("texts"), F.max("uid").alias("uid"), F.max("w").alias("w")).filter("texts = 1")
    return single.groupBy("uid").agg(F.sum("w").alias("own"))


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as sets whose Jaccard similarity is that of the multisets: a window's k-th occurrence is an element."""
    for batch in batches:
        for at, col in slices(batch.column(1), SLICE):
            row, x, w = weights(windows(words(col), WIDTH))
            of = np.repeat(np.arange(len(row)), w)
            with np.errstate(over="ignore"):
                each = mix(x[of] + (np.arange(len(of)) - np.repeat(np.cumsum(w) - w, w)).astype(U) * GOLDEN)
            ends = np.concatenate([[0], np.cumsum(np.bincount(row, w, len(col)).astype(np.int64))])
            parts = [each[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(col)), pa.array(parts, pa.binary())], names=["uid", "elements"])


def _spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewest pairs that connect what the pairs (a, b) connect: each name with the least that it leads to."""
    names, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = back[: len(a)], back[len(a) :]
    least = np.arange(len(names))
    while True:
        now = least.copy()
        np.minimum.at(now, x, least[y])
        np.minimum.at(now, y, least[x])
        now = now[now]
        if (now == least).all():
            break
        least = now
    moved = np.flatnonzero(least != np.arange(len(names)))
    return names[moved], names[least[moved]]


def _block_links(rows: pd.DataFrame) -> pd.DataFrame:
    """Links between the components of the left and of the right texts of a block, no more than connect them."""
    sets = [np.frombuffer(x, U) for x in rows["elements"]]
    size = np.asarray([len(x) for x in sets])
    left, right = (np.flatnonzero(rows["side"].to_numpy() == k) for k in (0, 1))
    both, back = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), size)
    many = np.flatnonzero(np.bincount(back, minlength=len(both)) > 1)
    column = np.full(len(both), -1)
    column[many] = np.arange(len(many))
    column = column[back]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    slot = np.zeros(len(sets), np.int64)
    slot[left], slot[right] = np.arange(len(left)), np.arange(len(right))
    is_left = rows["side"].to_numpy() == 0
    for a in range(0, len(many), COLUMNS):
        own = slice(*np.searchsorted(column, [a, a + COLUMNS]))
        flags = [np.zeros((len(v), COLUMNS), np.float32) for v in (left, right)]
        o, c = owner[own], column[own] - a
        for k, on in enumerate((is_left[o], ~is_left[o])):
            flags[k][slot[o[on]], c[on]] = 1
        common += flags[0] @ flags[1].T
    alike = common >= SIMILARITY * (size[left][:, None] + size[right][None, :] - common)
    comp = rows["comp"].to_numpy()
    i, j = np.nonzero(alike & (comp[left][:, None] != comp[right][None, :]))
    a, b = _spanning(comp[left[i]], comp[right[j]])
    return pd.DataFrame({"a": a, "b": b})


def block_links(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b): links between components that hold texts of one ``cluster`` of ``members`` (cluster, uid, comp, n) which are alike.

    The texts outside a cluster's largest component are dealt to blocks of at
    most about ``BLOCK`` texts and ``BLOCK_WORDS`` windows, and meet each other
    and the blocks of that component; the latter never meet. A task holds two
    blocks, and only links that connect components leave it.
    """
    counts = members.groupBy("cluster", "comp").agg(F.count("*").alias("texts"), F.sum("n").alias("n"))
    largest = counts.groupBy("cluster").agg(F.max(F.struct("texts", "n", "comp")).alias("top"), F.sum("texts").alias("texts"), F.sum("n").alias("n"))
    blocks = lambda texts, n: f"greatest(1, ceil(({texts}) / {BLOCK}), ceil(({n}) / {BLOCK_WORDS}))"
    largest = largest.select("cluster", F.col("top.comp").alias("main"), F.expr(blocks("top.texts", "top.n")).alias("n_main"), F.expr(blocks("texts - top.texts", "n - top.n")).alias("n_rest"))
    known = members.select("cluster", "uid", "comp").join(largest, "cluster").withColumn("in_main", F.expr("comp = main"))
    known = known.withColumn("block", F.expr("pmod(xxhash64(uid), if(in_main, n_main, n_rest))"))
    zero = "cast(0 as bigint)"
    into = f"""if(in_main,
        transform(sequence({zero}, n_rest - 1), i -> struct(i as i, block as j, true as main, 1 as side)),
        concat(
            transform(sequence({zero}, n_main - 1), j -> struct(block as i, j as j, true as main, 0 as side)),
            transform(sequence(block, n_rest - 1), j -> struct(block as i, j as j, false as main, 0 as side)),
            transform(sequence({zero}, block), i -> struct(i as i, block as j, false as main, 1 as side))))"""
    elements = texts.select("uid", "text").mapInArrow(tidy(_elements), "uid long, elements binary")
    dealt = elements.join(known, "uid").select("cluster", "comp", "elements", F.explode(F.expr(into)).alias("to")).select("cluster", "comp", "elements", "to.*")
    return dealt.groupBy("cluster", "i", "j", "main").applyInPandas(_block_links, "a long, b long").distinct()


def mixed(texts: DataFrame) -> DataFrame:
    """Those of ``texts`` (uid, comp, n, keys) that share a bucket with another component, with such buckets only.

    least_n is the size of the smallest text in any of these buckets. A text
    is one row throughout.
    """
    rows = texts.select("uid", "comp", "n", F.explode("keys").alias("key"))
    several = rows.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("n").alias("least_n")).filter("low <> high")
    kept = rows.join(several.select("key", "least_n"), "key").groupBy("uid", "comp", "n")
    return materialise(kept.agg(F.collect_list("key").alias("keys"), F.min("least_n").alias("least_n")))


def linkable(live: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``live`` whose windows that another text has are enough for the similarity to any text of their buckets.

    Alike texts of n and m windows have at least n m-wise shares
    s / (1 + s) * (n + m) windows in common, and m is at least s * n.
    """
    while True:
        own = own_mass(texts.join(live.select("uid"), "uid", "left_semi"))
        least = SIMILARITY / (1 + SIMILARITY)
        room = live.join(own, "uid", "left").filter(f"n - coalesce(own, 0) >= {least} * (n + greatest(least_n, {SIMILARITY} * n)) - 1e-6")
        left = mixed(room)
        if 2 * left.count() >= live.count():
            return left
        live = left


def links(texts: DataFrame, sketches: DataFrame) -> DataFrame:
    """(uid, comp) of all texts in classes of several different texts.

    Each band's bucket first links to one member, chosen anew in each band, as
    a star. Of the buckets that still hold several components, only texts go
    on whose weight in windows of their own leaves room for the similarity.
    What is left is compared in full across components, in blocks inside
    tasks: components that share a bucket are a cluster, and each text of a
    cluster is dealt once for each block that it meets. No pair is lost, no
    rows are made for pairs, and from a block come only links that connect
    components.
    """
    keys = sketches.select("uid", F.explode("bands").alias("key"))
    turned = F.expr("uid ^ xxhash64(key)")
    buckets = keys.groupBy("key").agg(F.min(turned).alias("least"), F.count("*").alias("size")).filter("size > 1")
    shared = keys.join(buckets.select("key", F.expr("least ^ xxhash64(key)").alias("rep")), "key")
    shared = materialise(shared.groupBy("uid").agg(F.collect_list(F.struct("key", "rep")).alias("in_")))
    texts = materialise(texts.join(shared.select("uid").hint("merge"), "uid", "left_semi"))  # at any size alike
    star = shared.select("uid", F.explode(F.array_distinct("in_.rep")).alias("rep")).filter("uid <> rep")
    star = star.select(F.least("uid", "rep").alias("a"), F.greatest("uid", "rep").alias("b")).distinct()
    sizes = sketches.drop("bands")
    star = star.join(sizes.alias("x"), F.col("a") == F.col("x.uid")).join(sizes.alias("y"), F.col("b") == F.col("y.uid"))
    near = materialise(verified(star.filter(alike("x", "y")).select("a", "b"), texts))
    labels = components(near)
    known = shared.select("uid", F.col("in_.key").alias("keys")).join(sizes.select("uid", "n"), "uid").join(labels, "uid", "left")
    live = mixed(known.withColumn("comp", F.coalesce("comp", "uid")))
    live = linkable(live, texts)
    if not live.limit(1).count():
        return labels
    met = live.select("comp", F.explode("keys").alias("key")).distinct()
    least = met.groupBy("key").agg(F.min("comp").alias("b"))
    clusters = components(met.join(least, "key").select(F.col("comp").alias("a"), "b").filter("a <> b").distinct())
    members = materialise(live.join(clusters.select(F.col("uid").alias("comp"), F.col("comp").alias("cluster")), "comp"))
    return joined(labels, materialise(block_links(members, texts)))


def joined(labels: DataFrame, found: DataFrame) -> DataFrame:
    """The components of ``labels`` after more links (a, b) between components."""
    over = components(found)
    over = over.select(F.col("uid").alias("of"), F.col("comp").alias("top"))
    alone = over.join(labels, F.col("of") == F.col("uid"), "left_anti").select(F.col("of").alias("uid"), F.col("of").alias("comp"))
    every = labels.unionByName(alone).join(over, F.col("comp") == F.col("of"), "left")
    return materialise(every.select("uid", F.coalesce("top", "comp").alias("comp")))


def sketched(docs: DataFrame) -> tuple[int, DataFrame]:
    """The sketches of the different texts of ``docs`` (text) with a word, and the seed of the uids, which name these texts.

    A uid is a 64-bit hash of the text. A second hash tells whether two texts
    have the same uid; if so, all get others from the next seed.
    """
    for seed in itertools.count():
        texts = docs.filter("text is not null").select(uid_of(seed), F.hash(F.lit(7), F.length("text"), "text").alias("check"), "text")
        found = texts.mapInArrow(tidy(_sketches), "uid long, check int, n long, s1 long, s2 long, bands array<long>").groupBy("uid")
        found = materialise(found.agg(*(F.first(c).alias(c) for c in ("n", "s1", "s2", "bands")), F.min("check").alias("low"), F.max("check").alias("high")))
        if not found.filter("low <> high").limit(1).count():
            return seed, found.drop("low", "high")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, any more) with class_uid, class_id and n_texts.

    Texts whose five-word windows overlap by 0.8 or more, counted as multisets,
    are linked; classes are what links and exact copies connect. class_id is
    the least doc_id of the class, n_texts how many different texts it holds.
    A text of one to four words has one window, all its words. A null text or
    one without words is in no class: class_uid is null and class_id its own
    doc_id. Null doc_ids are passed over for class_id unless there is no other;
    repeated rows are copies. Columns of docs that are named like results are
    replaced by them.
    """
    docs = docs.drop("class_uid", "class_id", "n_texts")
    own = docs.select("doc_id", "text")
    seed, sketches = sketched(own)
    whole = own.filter("text is not null").select(uid_of(seed), "text").groupBy("uid").agg(F.first("text").alias("text"))
    labels = links(whole, sketches)
    uid = F.when(F.col("text").rlike("[^\\x20\\x09-\\x0D]"), uid_of(seed))
    firsts = own.withColumn("uid", uid).filter("uid is not null").groupBy("uid").agg(F.min("doc_id").alias("least"))
    firsts = materialise(firsts.join(labels, "uid", "left").select("uid", "least", F.coalesce("comp", "uid").alias("comp")))
    several = firsts.groupBy("comp").agg(F.min("least").alias("class_id"), F.count("*").alias("n_texts"))
    of_text = firsts.join(several, "comp").select("uid", "comp", "class_id", "n_texts").alias("c")
    out = docs.withColumn("uid_of_class_", uid).alias("d").join(of_text, F.col("d.uid_of_class_") == F.col("c.uid"), "left")
    return out.select(
        *(F.col(f"d.`{c}`") for c in docs.columns),
        F.col("c.comp").alias("class_uid"),
        F.when(F.col("c.comp").isNull(), F.col("d.doc_id")).otherwise(F.col("c.class_id")).alias("class_id"),
        F.coalesce("c.n_texts", F.lit(1)).alias("n_texts"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that with the class's least doc_id."""
    names = docs.columns
    firsts = near_duplicates(docs).filter("class_uid is null or doc_id <=> class_id")
    ties = firsts.filter("class_uid is not null").groupBy("class_uid").count().filter("count > 1").limit(1).count()
    if ties:
        firsts = firsts.filter("class_uid is null").unionByName(firsts.filter("class_uid is not null").dropDuplicates(["class_uid"]))
    return firsts.select(*names)
