"""Prefix trie of conversations by the Euler-tour technique.

A node is a sequence of first turns that some conversation begins with, named
by its smallest member and its depth. Each node has an arc that enters it and
one that leaves it; an arc's successor is known from the node's first child,
next sibling and parent, so all arcs form one list. The list is ranked in
tasks: runs of successors that lie in one slice are contracted there, then
neighbours are joined by coin flips until a bounded list is left, and places
are handed back the same way. Sums over a subtree are differences of prefix
sums at the places of its two arcs.

Nothing is grouped by a conversation, a parent or a text that many rows may
share: such tables are sorted in ranges over all tasks, and what crosses the
border of a range is carried in a table of a row or two for each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import materialise, tidy

#: Rows of a slice, by expectation; arcs of a run; arcs that one task ranks at the end; ids that are hashed in one row.
SLICE_ROWS, RUN, LAST, IDS = 500_000, 1024, 1 << 17, 4096


def sliced(df: DataFrame, keys: list[str], use: Callable[[pd.DataFrame, int], pd.DataFrame], schema: str, n_rows: int) -> DataFrame:
    """``use(rows, part)`` of each slice of ``df`` sorted by ``keys``, written to the shared folder.

    Slices are ranges of the keys with about as many rows each, numbered in order.
    """
    spark = df.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // SLICE_ROWS))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = [x for x in frames if len(x)]
        if rows:
            yield use(pd.concat(rows, ignore_index=True), TaskContext.get().partitionId())

    return materialise(df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).mapInPandas(tidy(run), schema))


def _starts(*columns: pd.Series) -> np.ndarray:
    """Whether each row begins a group of equal columns."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        v = c.to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return new


def _numbered(rows: pd.DataFrame, part: int) -> pd.DataFrame:
    new = _starts(rows["conv_id"])
    at = np.arange(len(rows))
    first = np.maximum.accumulate(np.where(new, at, 0))
    k = at - first
    last = np.r_[new[1:], True]
    border = (first == 0) | (first == first[-1])
    return pd.DataFrame({"conv_id": rows["conv_id"], "k": k, "digest": rows["digest"], "words": rows["words"], "part": part, "edge": last & border})


def _before(parts: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(conv_id, part, values over the earlier parts of the conversation) of the few conversations that a border cuts."""
    order = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return F.broadcast(parts.select("conv_id", "part", *(v.over(order).alias(c) for c, v in values.items())))


def ordered(conversations: DataFrame) -> DataFrame:
    """(conv_id, k, digest, words) of ``conversations`` (conv_id, turn, role, text): the turns of each from 0 by turn.

    A null turn comes first, equal turns go by the SHA-256 of role and text,
    a null role or text is empty. Rows without a conv_id take no part.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    told = F.concat(F.length(role).cast("string"), F.lit(":"), role, text)
    words = F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long")
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").isNotNull().alias("told"), "turn", F.sha2(told, 256).alias("digest"), words.alias("words"))
    found = sliced(rows, ["conv_id", "told", "turn", "digest"], _numbered, "conv_id long, k long, digest string, words long, part int, edge boolean", conversations.count())
    before = _before(found.filter("edge"), {"base": F.sum(F.col("k") + 1)})
    return materialise(found.join(before, ["conv_id", "part"], "left").select("conv_id", (F.col("k") + F.coalesce("base", F.lit(0))).alias("k"), "digest", "words"))


def branched(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations as branches: (conv_id, depth, digest, words) and their members (conv_id, n).

    Conversation c takes its first h turns from c - c % every (all if that has
    fewer, none if it is absent) and goes on with its own after its first h;
    h is the CRC-32 of its decimal id modulo ``most``. n is the number of turns it has then.
    """
    counts = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    base = F.col("conv_id") - F.col("conv_id") % every
    sized = counts.withColumn("base", base).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % most)
    roots = counts.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.col("own").alias("there"))
    facts = sized.join(roots, "base", "left").withColumn("taken", F.least("h", F.coalesce("there", F.lit(0))))
    facts = materialise(facts.select("conv_id", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n")))
    heads = turns.filter((F.col("conv_id") % every == 0) & (F.col("k") < most - 1)).withColumnRenamed("conv_id", "base")
    given = facts.filter("taken > 0").select("conv_id", "base", "taken").join(heads, "base").filter("k < taken").select("conv_id", (F.col("k") + 1).alias("depth"), "digest", "words")
    lacking = facts.filter("taken < h").select("conv_id", (F.col("h") - F.col("taken")).alias("lack"))
    own = turns.filter(F.col("k") >= F.crc32(F.col("conv_id").cast("string")) % most).join(lacking, "conv_id", "left")
    own = own.select("conv_id", (F.col("k") + 1 - F.coalesce("lack", F.lit(0))).alias("depth"), "digest", "words")
    return given.unionByName(own), facts.select("conv_id", "n")


def whole(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are, in the form of ``branched``."""
    return turns.select("conv_id", (F.col("k") + 1).alias("depth"), "digest", "words"), turns.groupBy("conv_id").agg(F.count("*").alias("n"))


def _prefixes(rows: pd.DataFrame, part: int) -> pd.DataFrame:
    new = _starts(rows["conv_id"])
    first = np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))
    last, border = np.r_[new[1:], True], (first == 0) | (first == first[-1])
    out = rows.drop(columns=[])
    for c in ("a", "b"):
        total = np.bitwise_xor.accumulate(rows[c].to_numpy())
        out[f"x{c}"] = total ^ np.where(first > 0, total[first - 1], 0)
    return out.assign(part=part, edge=last & border)


def _named(turns: DataFrame, n_rows: int) -> DataFrame:
    """Turns with the names (xa, xb) of the prefix that ends there: 120 bits of hashes of place and turn, joined by exclusive or."""
    mixed = F.sha2(F.concat_ws(":", F.col("depth").cast("string"), "digest"), 256)
    bits = lambda at: F.conv(F.substring(mixed, at, 15), 16, 10).cast("long")
    rows = turns.select("conv_id", "depth", "words", bits(1).alias("a"), bits(16).alias("b"))
    kind = "conv_id long, depth long, words long, a long, b long, xa long, xb long, part int, edge boolean"
    found = sliced(rows, ["conv_id", "depth"], _prefixes, kind, n_rows)
    before = _before(found.filter("edge"), {"ca": F.bit_xor("xa"), "cb": F.bit_xor("xb")})
    carried = found.join(before, ["conv_id", "part"], "left")
    return carried.select("conv_id", "depth", "words", "a", "b", *(F.col(f"x{c}").bitwiseXOR(F.coalesce(f"c{c}", F.lit(0).cast("long"))).alias(f"x{c}") for c in ("a", "b")))


NAME = ["depth", "xa", "xb"]


def _id_runs(rows: pd.DataFrame, part: int) -> pd.DataFrame:
    """Ascending ids of each node as texts of at most ``IDS`` ids."""
    new = _starts(*(rows[c] for c in NAME))
    at = np.arange(len(rows))
    first = np.maximum.accumulate(np.where(new, at, 0))
    begins = np.flatnonzero(new | ((at - first) % IDS == 0))
    ids = rows["conv_id"].tolist()
    ends = [*begins[1:].tolist(), len(ids)]
    out = rows.iloc[begins][[*NAME, "conv_id"]].rename(columns={"conv_id": "first"})
    return out.assign(ids=[",".join(map(str, ids[a:b])) for a, b in zip(begins.tolist(), ends, strict=True)])


def _digests(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The SHA-256 of each node's ids, whose runs come one after another."""
    name, state = None, hashlib.sha256()
    for frame in frames:
        out = []
        for *own, _, ids in frame.itertuples(index=False):
            if own == name:
                state.update(b"," + ids.encode())
                continue
            if name is not None:
                out.append((*name, state.hexdigest()))
            name, state = own, hashlib.sha256(ids.encode())
        yield pd.DataFrame(out, columns=[*NAME, "ends_sha256"])
    if name is not None:
        yield pd.DataFrame([(*name, state.hexdigest())], columns=[*NAME, "ends_sha256"])


def _ended(ends: DataFrame, n_rows: int) -> DataFrame:
    """(name, ends_sha256) of the nodes at which ``ends`` (name, conv_id) end; a hash reads its ids in order, so a node's runs meet in one task, a run at a time."""
    runs = sliced(ends, [*NAME, "conv_id"], _id_runs, "depth long, xa long, xb long, first long, ids string", n_rows)
    return runs.repartition(*NAME).sortWithinPartitions(*NAME, "first").mapInPandas(tidy(_digests), "depth long, xa long, xb long, ends_sha256 string")


def _siblings(rows: pd.DataFrame, part: int) -> pd.DataFrame:
    same = ~_starts(rows["parent_conv_id"], rows["depth"])
    following = np.r_[same[1:], False]
    sibling = pd.Series(rows["conv_id"]).shift(-1).where(following).astype("Int64")
    return pd.DataFrame({"conv_id": rows["conv_id"], "depth": rows["depth"], "parent_conv_id": rows["parent_conv_id"], "sibling": sibling, "part": part, "head": np.arange(len(rows)) == 0, "tail": np.arange(len(rows)) == len(rows) - 1})


def _with_siblings(children: DataFrame, n_rows: int) -> DataFrame:
    """``children`` (conv_id, depth, parent_conv_id) with the next child of their parent, by conv_id."""
    found = sliced(children, ["parent_conv_id", "depth", "conv_id"], _siblings, "conv_id long, depth long, parent_conv_id long, sibling long, part int, head boolean, tail boolean", n_rows)
    heads = found.filter("head").select("part", F.struct("parent_conv_id", "depth", "conv_id").alias("own"))
    after = heads.select(F.lag("part").over(Window.orderBy("part")).alias("part"), F.lit(True).alias("tail"), F.col("own").alias("after")).filter("part is not null")
    joined = found.join(F.broadcast(after), ["part", "tail"], "left")
    same = (F.col("after.parent_conv_id") == F.col("parent_conv_id")) & (F.col("after.depth") == F.col("depth"))
    return joined.select("conv_id", "depth", "parent_conv_id", F.coalesce("sibling", F.when(same, F.col("after.conv_id"))).alias("sibling"))


def _ends_of_runs(after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place of lists told by successors (-1: none), the last place of its list and the steps to it."""
    end = np.where(after >= 0, after, np.arange(len(after)))
    steps = (after >= 0).astype(np.int64)
    while True:
        further = end[end]
        if (further == end).all():
            return end, steps
        steps, end = steps + steps[end], further


def _contracted(rows: pd.DataFrame, part: int) -> pd.DataFrame:
    """Each arc with the run of this slice that it lies in and its place there; heads of runs with the run's length and successor."""
    conv, code = rows["conv_id"].to_numpy(np.int64), rows["code"].to_numpy(np.int64)
    kinds, at = np.unique(conv, return_inverse=True)
    width = int(max(code.max(), rows["next_code"].max(skipna=True) if rows["next_code"].notna().any() else 0)) + 1
    own = at * width + code
    has = rows["next_conv"].notna().to_numpy()
    to_conv, to_code = rows["next_conv"].fillna(0).to_numpy(np.int64), rows["next_code"].fillna(0).to_numpy(np.int64)
    place = np.minimum(np.searchsorted(kinds, to_conv), len(kinds) - 1)
    wanted = np.where(has & (kinds[place] == to_conv), place * width + to_code, -1)
    order = np.argsort(own, kind="stable")
    hit = order[np.minimum(np.searchsorted(own[order], wanted), len(own) - 1)]
    after = np.where(own[hit] == wanted, hit, -1)
    end, steps = _ends_of_runs(after)
    heads = np.ones(len(own), bool)
    heads[after[after >= 0]] = False
    head_of = np.zeros(len(own), np.int64)
    head_of[end[heads]] = np.flatnonzero(heads)
    offset = steps[head_of[end]] - steps
    # Long runs are cut, so that no run has more than RUN arcs.
    begins = offset % RUN == 0
    last = (after < 0) | begins[np.maximum(after, 0)]
    cut_end, cut_steps = _ends_of_runs(np.where(last, -1, after))
    cut_head = np.zeros(len(own), np.int64)
    cut_head[cut_end[begins]] = np.flatnonzero(begins)
    run = cut_head[cut_end]
    tail = cut_end
    out = rows[["conv_id", "code", "leaf", "saving"]].assign(run_conv=conv[run], run_code=code[run], offset=offset % RUN)
    out["size"] = pd.Series(np.where(begins, cut_steps + 1, 0), dtype="int64")
    out["next_conv"] = rows["next_conv"].to_numpy()[tail]
    out["next_code"] = rows["next_code"].to_numpy()[tail]
    return out.assign(head=begins)


def _joined(arcs: DataFrame, turn: int) -> DataFrame:
    """One round: an arc whose coin shows heads takes in its successor if that shows tails."""
    coin = lambda conv, code: F.pmod(F.xxhash64(F.lit(turn), conv, code), F.lit(2)) == 1
    joins = F.col("next_conv").isNotNull() & coin(F.col("conv_id"), F.col("code")) & ~coin(F.col("next_conv"), F.col("next_code"))
    keyed = arcs.select(F.when(joins, F.col("next_conv")).otherwise(F.col("conv_id")).alias("key_conv"), F.when(joins, F.col("next_code")).otherwise(F.col("code")).alias("key_code"), F.coalesce(joins, F.lit(False)).alias("ahead"), F.struct("conv_id", "code", "size", "next_conv", "next_code").alias("x"))
    both = keyed.groupBy("key_conv", "key_code").agg(F.max(F.when(F.col("ahead"), F.col("x"))).alias("front"), F.max(F.when(~F.col("ahead"), F.col("x"))).alias("back"))
    first = lambda c: F.coalesce(F.col(f"front.{c}"), F.col(f"back.{c}"))
    return both.select(
        first("conv_id").alias("conv_id"), first("code").alias("code"), (F.coalesce("front.size", F.lit(0)) + F.col("back.size")).alias("size"), F.col("back.next_conv").alias("next_conv"), F.col("back.next_code").alias("next_code"),
        F.when(F.col("front").isNotNull(), F.struct(F.col("back.conv_id").alias("conv_id"), F.col("back.code").alias("code"), F.col("front.size").alias("offset"))).alias("taken"),
    )


def _walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Places of the arcs of a whole list of bounded length."""
    rows = [x for x in frames if len(x)]
    if not rows:
        return
    rows = pd.concat(rows, ignore_index=True)
    where = {k: i for i, k in enumerate(zip(rows["conv_id"], rows["code"], strict=True))}
    after = np.asarray([-1 if pd.isna(c) else where[int(c), int(d)] for c, d in zip(rows["next_conv"], rows["next_code"], strict=True)], np.int64)
    _, steps = _ends_of_runs(after)
    order = np.argsort(-steps, kind="stable")
    sizes = rows["size"].to_numpy(np.int64)[order]
    place = np.empty(len(rows), np.int64)
    place[order] = np.cumsum(sizes) - sizes
    yield rows[["conv_id", "code"]].assign(pos=place)


def ranked(arcs: DataFrame, n_rows: int, last: int = LAST) -> DataFrame:
    """(conv_id, code, leaf, saving, pos) of ``arcs`` (conv_id, code, leaf, saving, next_conv, next_code), which are one list.

    Slices are ranges of conversations, where most successors lie together;
    wherever they lie, each round of coin flips joins a quarter of what is left.
    """
    kind = "conv_id long, code long, leaf long, saving long, run_conv long, run_code long, offset long, size long, next_conv long, next_code long, head boolean"
    cut = sliced(arcs, ["conv_id", "code"], _contracted, kind, n_rows)
    left = cut.filter("head").select("conv_id", "code", "size", "next_conv", "next_code")
    rounds: list[DataFrame] = []
    while left.count() > last:
        rounds.append(materialise(_joined(left, len(rounds))))
        left = rounds[-1].drop("taken")
    places = materialise(left.coalesce(1).mapInPandas(tidy(_walk), "conv_id long, code long, pos long"))
    for made in reversed(rounds):
        back = made.select("conv_id", "code", "taken").join(places, ["conv_id", "code"])
        own = F.array(F.struct("conv_id", "code", "pos"))
        more = F.array(F.struct(F.col("taken.conv_id").alias("conv_id"), F.col("taken.code").alias("code"), (F.col("pos") + F.col("taken.offset")).alias("pos")))
        places = materialise(back.select(F.explode(F.when(F.col("taken").isNull(), own).otherwise(F.concat(own, more))).alias("x")).select("x.*"))
    runs = places.select(F.col("conv_id").alias("run_conv"), F.col("code").alias("run_code"), "pos")
    return cut.join(runs, ["run_conv", "run_code"]).select("conv_id", "code", "leaf", "saving", (F.col("pos") + F.col("offset")).alias("pos"))


def _running(rows: pd.DataFrame, part: int) -> pd.DataFrame:
    return rows[["conv_id", "code", "leaf", "saving"]].assign(leaves=rows["leaf"].cumsum(), savings=rows["saving"].cumsum(), part=part, tail=np.arange(len(rows)) == len(rows) - 1)


def _sums(places: DataFrame, n_rows: int) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) from prefix sums at the places of the arcs."""
    found = sliced(places, ["pos"], _running, "conv_id long, code long, leaf long, saving long, leaves long, savings long, part int, tail boolean", n_rows)
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = found.filter("tail").select("part", F.coalesce(F.sum("leaves").over(order), F.lit(0)).alias("l"), F.coalesce(F.sum("savings").over(order), F.lit(0)).alias("s"))
    whole_ = found.join(F.broadcast(before), "part").select("conv_id", F.expr("code div 2").alias("depth"), "leaf", "saving", (F.col("leaves") + F.col("l")).alias("leaves"), (F.col("savings") + F.col("s")).alias("savings"))
    span = lambda total, own: F.max(total) - F.min(total) + F.sum(own)
    return whole_.groupBy("conv_id", "depth").agg(span("leaves", "leaf").alias("n_leaves"), span("savings", "saving").alias("saved_tokens"))


def trie(turns: DataFrame, members: DataFrame, last: int = LAST) -> DataFrame:
    """The nodes of the prefix trie of ``turns`` (conv_id, depth from 1, digest, words) and ``members`` (conv_id, n turns).

    Gives conv_id (smallest member), depth, parent_conv_id (null at the root),
    n_convs, n_children, n_leaves, saved_tokens and ends_sha256. No members
    give no node, not even a root. Members without turns end at the root.
    """
    n_rows = turns.count()
    named = materialise(_named(turns, n_rows).join(members, "conv_id"))
    all_ = members.agg(F.count("*").alias("n"), F.min("conv_id").alias("least")).first()
    zero = F.lit(0).cast("long")
    root = members.groupBy().agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select("conv_id", zero.alias("depth"), "n_convs", zero.alias("words"), zero.alias("xa"), zero.alias("xb"), zero.alias("pa"), zero.alias("pb"))
    parent = [F.first(F.col(f"x{c}").bitwiseXOR(F.col(c))).alias(f"p{c}") for c in ("a", "b")]
    made = named.groupBy(*NAME).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("words").alias("words"), *parent)
    nodes = materialise(made.select(root.columns).unionByName(root))
    n_nodes = nodes.count()
    ends = named.filter("depth = n").select(*NAME, "conv_id").unionByName(members.filter("n = 0").select(zero.alias("depth"), zero.alias("xa"), zero.alias("xb"), "conv_id"))
    ended = _ended(ends, all_["n"])

    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("xa").alias("pa"), F.col("xb").alias("pb"), F.col("conv_id").alias("parent_conv_id"))
    deep = nodes.filter("depth > 1").select("conv_id", "depth", "pa", "pb").join(above, ["depth", "pa", "pb"]).select("conv_id", "depth", "parent_conv_id")
    first = nodes.filter("depth = 1").select("conv_id", "depth", F.lit(all_["least"]).cast("long").alias("parent_conv_id"))
    children = materialise(_with_siblings(deep.unionByName(first), n_nodes))
    counted = children.groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"), F.min("conv_id").alias("child"))
    facts = nodes.join(counted, ["conv_id", "depth"], "left").join(children, ["conv_id", "depth"], "left").join(ended, NAME, "left")
    nothing = hashlib.sha256(b"").hexdigest()
    facts = materialise(facts.select("conv_id", "depth", "parent_conv_id", "sibling", "child", "n_convs", F.coalesce("n_children", zero).alias("n_children"), ((F.col("n_convs") - 1) * F.col("words")).alias("saving"), F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256")))

    depth, null = F.col("depth"), F.lit(None).cast("long")
    enter = F.struct(
        (2 * depth).alias("code"), (F.col("n_children") == 0).cast("long").alias("leaf"), F.col("saving"),
        F.coalesce("child", "conv_id").alias("next_conv"), F.when(F.col("child").isNotNull(), 2 * depth + 2).otherwise(2 * depth + 1).alias("next_code"),
    )
    leave = F.struct(
        (2 * depth + 1).alias("code"), zero.alias("leaf"), zero.alias("saving"),
        F.coalesce("sibling", "parent_conv_id").alias("next_conv"), F.when(F.col("sibling").isNotNull(), 2 * depth).when(depth > 0, 2 * depth - 1).otherwise(null).alias("next_code"),
    )
    arcs = facts.select("conv_id", F.explode(F.array(enter, leave)).alias("x")).select("conv_id", "x.*")
    sums = _sums(ranked(arcs, 2 * n_nodes, last), 2 * n_nodes)
    return facts.join(sums, ["conv_id", "depth"]).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame, branches: bool = False, last: int = LAST) -> DataFrame:
    """``trie`` of ``conversations`` (conv_id, turn, role, text, any more), as they are or as ``branches`` of one another.

    Rows without a conv_id take no part; a null turn comes first, a null role
    or text is empty; equal turns go by the SHA-256 of role and text, and
    repeated rows are turns of their own. Other columns are not read. An empty
    table gives no node.
    """
    turns = ordered(conversations)
    return trie(*(branched(turns) if branches else whole(turns)), last)
