"""Quality by a field over lines, prefix tries and hard negatives against plain versions, on tables and odd rows."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from millrace.llm import linecrf, negatives, trie
from millrace.llm import queries as Q
from tests.test_queries import SF

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TURNS = "conv_id long, turn long, role string, text string"


# --- prefix trie


def plain_trie(rows, branches):
    own = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            own.setdefault(c, []).append((t is not None, t or 0, hashlib.sha256(f"{len(r)}:{r}{x}".encode()).hexdigest(), r, x))
    own = {c: [y[3:] for y in sorted(v)] for c, v in own.items()}
    whole = dict(own)
    if branches:
        for c in own:
            h = zlib.crc32(str(c).encode()) % 4
            base = int(math.fmod(c, 20))
            whole[c] = own.get(c - base, [])[:h] + own[c][h:]
    members = {}
    for c, v in whole.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
    kids = {}
    for n in members:
        if n:
            kids.setdefault(n[:-1], []).append(n)
    out = set()

    def below(n):
        return [n, *(y for k in kids.get(n, []) for y in below(k))]

    for n, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(whole[c]) == len(n))))
        all_ = below(n)
        saved = sum((len(members[y]) - 1) * len(WORD.findall(y[-1][1])) for y in all_ if y)
        out.add((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(kids.get(n, [])), sum(y not in kids for y in all_), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def told(df):
    return [tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()]


def made_turns(seed=3):
    rng = random.Random(seed)
    rows = []
    for c in [*range(-25, 60), *range(200, 230)]:
        for t in range(rng.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "bot", None]), rng.choice(["a b", "c", "", None, "a  b\n"])))
    rows += [(300 + k, t, "user", f"same {t}") for k in range(40) for t in range(4)]
    rows += [(None, 1, "user", "lost"), (7, 0, "user", "again"), (7, 0, "user", "again")]
    return rows


@pytest.mark.parametrize("branches", [True, False])
def test_trie(spark, branches, monkeypatch):
    """Small slices, runs and last lists force borders, cuts and rounds of coin flips."""
    rows = made_turns()
    for name, value in (("SLICE_ROWS", 60), ("RUN", 3), ("IDS", 4)):
        monkeypatch.setattr(trie, name, value)
    df = spark.createDataFrame(rows, TURNS).withColumn("depth", F.lit("mine")).repartition(5)
    got = told(trie.prefix_trie(df, branches, last=40))
    assert len(got) == len(set(got)) and set(got) == plain_trie(rows, branches)


def test_trie_of_a_long_conversation(spark, monkeypatch):
    """One conversation holds most rows and crosses the borders of several slices."""
    monkeypatch.setattr(trie, "SLICE_ROWS", 100)
    rows = [(20, t, "user", f"turn {t}") for t in range(700)] + [(c, t, "user", f"turn {t}") for c in (21, 22) for t in range(3)] + [(40, 0, "user", "x")]
    got = told(trie.prefix_trie(spark.createDataFrame(rows, TURNS), False))
    by = {(r[0], r[1]): r for r in got}
    assert len(got) == 702 and by[20, 0][3:7] == (4, 2, 2, 2 * 2 * 3) and by[20, 3][3:6] == (3, 1, 1) and by[20, 700][3:7] == (1, 0, 1, 0)


def test_trie_of_nothing(spark):
    assert told(trie.prefix_trie(spark.createDataFrame([], TURNS), True)) == []
    (root,) = told(trie.prefix_trie(spark.createDataFrame([(1, 0, "user", "x")], TURNS).filter("conv_id = 1"), True))[:1] if zlib.crc32(b"1") % 4 else [None]
    assert root is None or root[:7] == (1, 0, None, 1, 0, 1, 0)


# --- hard negatives


def plain_negatives(rows, anchor, k=5):
    known = [(i, y, [math.floor(256 * float(x)) for x in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    score = lambda a, b: sum(x * y for x, y in zip(a, b, strict=False))
    for i, y, q in known:
        if not anchor(i):
            continue
        others = sorted((-score(q, w), j, z) for j, z, w in known if j != i)
        for s, p, _ in [x for x in others if x[2] == y][:k]:
            hits = [x for x in others if x[2] != y and 80 * -s <= 100 * -x[0] <= 100 * -s][:k]
            out |= {(i, p, r + 1, j, -s, -t) for r, (t, j, _) in enumerate(hits)}
    return out


VECTORS = "vec_id long, embedding array<float>, label int"


def asked(df):
    return {tuple(r) for r in df.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()}


@pytest.mark.parametrize("at_once", [2048, 3])
def test_negatives(spark, at_once, monkeypatch):
    """Ties, gaps, zero, short and repeated vectors, in several blocks of rows and of anchors."""
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(5)
    rows = [(k, [float(np.float32(x)) for x in rng.normal(size=6) + (k % 3)], int(k % 3)) for k in range(300)]
    rows += [(400 + k, rows[40][1], 1 + k % 2) for k in range(30)]
    rows += [(500, [0.0] * 6, 1), (520, None, 1), (540, [1.0, None, 0.0], 1), (560, [float("nan")] * 6, 1), (580, [float("inf")] * 6, 2), (600, [1.0, 2.0], 1), (None, rows[0][1], 1), (620, rows[1][1], None), (640, [], 2), (660, [-1.0] * 6, 2)]
    df = spark.createDataFrame(rows, VECTORS).withColumn("q", F.lit("mine")).repartition(3)
    got = asked(negatives.hard_negatives(df, F.col("vec_id") % 20 == 0, anchors_at_once=at_once))
    assert got == plain_negatives(rows, lambda i: i % 20 == 0) and len(got) > 100


def test_sorted_access_stops_early():
    """Where few rows stand out, a small part of the lists is read, and the rows are those of all products."""
    rng = np.random.default_rng(1)
    q = rng.integers(-20, 20, (4000, 8))
    q[:10] += 400
    lists = negatives.Lists(np.arange(4000), np.zeros(4000, int), q)
    anchor = np.full(8, 3)
    places, scores = lists.search(anchor, lambda new: np.ones(len(new), bool), lambda s, t: negatives._kth_above(s, 5, t))
    keep = negatives.best(places, scores, 5)
    assert lists.read < 0.02 * q.size and sorted(places[keep]) == sorted(np.lexsort((np.arange(4000), -(q @ anchor)))[:5])
    big = negatives.Lists(np.arange(3), np.zeros(3, int), np.asarray([[1 << 30, 1], [1 << 30, 2], [0, 0]]))
    assert big.scores(np.arange(3), np.asarray([1 << 30, 1])).tolist() == [(1 << 60) + 1, (1 << 60) + 2, 0]


def test_no_vectors(spark):
    assert asked(negatives.hard_negatives(spark.createDataFrame([], VECTORS), F.col("vec_id") % 100 == 0)) == set()
    assert asked(negatives.hard_negatives(spark.createDataFrame([(100, [1.0], 1)], VECTORS), F.col("vec_id") % 100 == 0)) == set()


# --- a field over lines


def test_chain_is_exact():
    """Marginals and partition against all labellings of chains of several lengths."""
    rng = np.random.default_rng(2)
    sizes, moves = np.asarray([3, 1, 6, 2]), rng.normal(size=(2, 2))
    node = rng.normal(size=sizes.sum())
    good, pair, logz = linecrf.chain(node, sizes, moves)
    at, pairs = 0, 0
    for k, n in enumerate(sizes):
        weights = {y: math.exp(sum(node[at + i] * y[i] for i in range(n)) + sum(moves[y[i], y[i + 1]] for i in range(n - 1))) for y in itertools.product((0, 1), repeat=int(n))}
        z = sum(weights.values())
        assert math.isclose(math.log(z), logz[k], rel_tol=1e-9)
        for i in range(n):
            assert math.isclose(sum(w for y, w in weights.items() if y[i]) / z, good[at + i], rel_tol=1e-9)
        for i in range(n - 1):
            assert math.isclose(sum(w for y, w in weights.items() if y[i] and not y[i + 1]) / z, pair[pairs + i][1, 0], rel_tol=1e-9)
        at, pairs = at + n, pairs + n - 1


def test_facts_of_lines(monkeypatch):
    texts = ["ABC DEF ghi\n\nx x x 12 $$", "", "one two three four one two three", "one two three four one two three\nβγ É"]
    n, chars, found = linecrf.facts(texts)
    assert n.tolist() == [3, 1, 1, 2] and chars.tolist() == [11, 0, 11, 0, 32, 32, 4]
    assert np.allclose(found[0, [0, 5]], [6 / 9, 2 / 3]) and found[2, 8] == pytest.approx(2 / 5) and found[2, 6] == pytest.approx(1 / 5) and found[2, 7] == pytest.approx(2 / 5)
    assert found[4, 9] == pytest.approx(3 / 7) and found[4, 10] == pytest.approx(1 / 7) and np.allclose(found[4], found[5])
    assert found[6, 0] == pytest.approx(1 / 3) and not found[1].any() | found[3].any()
    monkeypatch.setattr(linecrf, "PIECE", 16)
    assert all(np.allclose(a, b) for a, b in zip(linecrf.facts(texts), (n, chars, found), strict=True))


@pytest.mark.skipif(not SF, reason="no tables here")
def test_held_out_documents(spark):
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF.replace('0.001', '0.01')}/labels.parquet").to_pylist()}
    got = Q.op11_line_field(spark, SF.replace("0.001", "0.01")).collect()
    assert len(got) == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [(r.predicted, labels[r.doc_id]) for r in got if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in held) >= 0.95 * len(held) and sum(a == b == 0 for a, b in held) >= 0.8 * sum(b == 0 for _, b in held)


def test_field_on_odd_rows(spark):
    good = "the river runs past the old mill and on to the sea below the town\nwhere boats come in the evening with the tide"
    bad = "WIN!! $$$ NOW!! $$$ CLICK!! ### WIN!! $$$ NOW!!\nWIN!! $$$ NOW!! $$$ CLICK!!"
    rows = [(k, (bad if k % 4 == 0 else good) + f" {k}", "en") for k in range(80)] + [(None, good, "en"), (100, None, "en"), (101, "", "en"), (102, good * 3000, "en"), (103, "x\n" * 5000, None), (5, good, "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(80)] + [(None, 0), (3, None), (4, 7)], "doc_id long, quality int")
    field = linecrf.fit(docs, labels)
    out = linecrf.scored(docs, field)
    assert out.columns == ["doc_id", "text", "score", "n_lines", "n_bad_lines", "predicted"]
    got = [(r.doc_id, r.predicted, r.n_lines) for r in out.collect()]
    assert len(got) == len(rows) and all(p == int(i % 4 != 0) for i, p, _ in got if i is not None and i < 80)
    assert {n for i, _, n in got if i in (100, 101)} == {1} and [(p, n) for i, p, n in got if i == 102] == [(1, 3001)]
    mixed = linecrf.scored(spark.createDataFrame([(1, good + "\n" + bad)], "doc_id long, text string"), field).first()
    assert mixed.n_lines == 4 and mixed.n_bad_lines == 2
    none = linecrf.scored(docs, linecrf.fit(docs, labels.filter("quality = 1"))).collect()
    assert {r.score for r in none} == {0.5}
    assert linecrf.scored(docs.limit(0), field).collect() == []
