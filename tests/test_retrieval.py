"""Vectors, the two pipelines, the cache and the stream."""

import tempfile

from pyspark.sql import functions as F

from millrace.functions.text import ABSTAIN, NOTHING_FOUND
from millrace.operators import corrective as C
from millrace.operators import vectors
from millrace.operators.cache import cached

CHUNKS = [("c1", "the bank held rates at five\nsecond line", "MPR"), ("c2", "inflation fell in march. it rose later", "FSR"), ("c3", "the bank held rates", "MPR")]


def library(spark):
    return spark.createDataFrame(CHUNKS, "chunk_id string, text string, document_type string")


def asked(spark, *texts):
    return spark.createDataFrame([(f"q{k}", t) for k, t in enumerate(texts)], "question_id string, question string")


def run(spark, text, **models):
    return C.corrective(asked(spark, text), library(spark), C.Models(**models)).first()


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "a"), (3, [1.0, 0.0], "b"), (4, [1.0, 1.0], "b")], "vec_id long, embedding array<float>, kind string")
    assert [(r.vec_id, r.score) for r in vectors.nearest(rows, [2.0, 0.0], 3).collect()] == [(1, 1.0), (3, 1.0), (4, 0.7071)]
    assert [r.vec_id for r in vectors.nearest(rows, [1.0, 0.0], 3, {"kind": "b", "x": None}).collect()] == [3, 4]
    queries = spark.createDataFrame([(9, [0.0, 1.0], ""), (8, [0.0, 1.0], "b")], "query_id long, query_vector array<float>, kind string")
    found = vectors.nearest_batch(rows, queries, 2, ["kind"]).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id) for r in found] == [(8, 4), (8, 3), (9, 2), (9, 4)]
    new = spark.createDataFrame([(4, [0.0, 2.0], "c"), (5, [1.0, 1.0], "c")], rows.schema)
    assert sorted((r.vec_id, r.kind) for r in vectors.upsert(rows, new, "vec_id").collect()) == [(1, "a"), (2, "a"), (3, "b"), (4, "c"), (5, "c")]
    assert sorted(r.vec_id for r in vectors.changed(rows, new.union(rows.filter("vec_id = 1")), "vec_id", ["embedding", "kind"]).collect()) == [4, 5]
    assert not vectors.in_sync(rows, new)


def test_batches_across_partitions(spark):
    import random

    rng = random.Random(4)
    sizes = {k: rng.choice([0, 1, 40, 900, 900, 15_000, 40_000]) if k % 600 < 300 else rng.choice([0, 1, 2]) for k in range(1500)}
    rows = [("hot", k, "w " * n) for k, n in sizes.items()] + [(None, 1, "a b"), (None, 2, None), ("small", 1, "w " * 40_000), ("small", 2, "")]
    want, batch, words, records = [], -1, 0, 100
    for n in sizes.values():
        if words + n > 30_000 or records >= 100:
            batch, words, records = batch + 1, 0, 0
            want.append(None)
        words, records = words + n, records + 1
        want[batch] = (batch, records, words)
    frame = spark.createDataFrame(rows, "source string, doc_id long, text string")
    for run_rows in (40, 333):
        got = vectors.batches(frame, "source", "doc_id", "text", run_rows).collect()
        assert sorted((r.batch, r.records, r.words) for r in got if r.source == "hot") == want
        assert [(r.batch, r.records, r.words) for r in got if r.source is None] == [(0, 2, 2)]
        assert sorted((r.batch, r.records, r.words) for r in got if r.source == "small") == [(0, 1, 40_000), (1, 1, 0)]


def test_batches(spark):
    rows = spark.createDataFrame([("g", k, "w " * n) for k, n in enumerate([20_000, 15_000, 40_000, *[1] * 150])], "g string, k long, text string")
    assert [(r.records, r.words) for r in vectors.batches(rows, "g", "k", "text").orderBy("batch").collect()] == [(1, 20_000), (1, 15_000), (1, 40_000), (100, 100), (50, 50)]


def test_baseline(spark):
    found = {r.question_id: r for r in C.baseline(asked(spark, "bank rates", "zebra"), library(spark)).collect()}
    assert found["q0"].answer == "the bank held rates at five" and found["q0"].trace == ["retrieve", "generate"] and found["q0"].chunks_used == 2
    assert found["q1"].answer == NOTHING_FOUND and found["q1"].trace == ["retrieve"] and found["q1"].chunks_used == 0


def test_plain_path(spark):
    r = run(spark, "bank held rates five")
    assert r.trace == ["analyze_query", "retrieve", "grade_documents", "rerank", "generate", "check_hallucination"]
    assert r.is_grounded and r.failures == 0 and r.rewrites == 0 and r.chunks_retrieved == 2 and r.post_rerank_ids == ["c1", "c3"]


def test_out_of_scope(spark):
    r = run(spark, "bank rates", analyse=lambda q: q.withColumn("out_of_corpus", F.lit(True)).withColumn("document_type", F.lit("MPR")))
    assert r.answer == ABSTAIN and r.trace == ["analyze_query", "abstain_out_of_corpus"] and r.chunks_retrieved == 0 and r.is_grounded is None and r.filters is None


def test_rewrite_drops_filters(spark):
    r = run(spark, "inflation march", analyse=lambda q: q.withColumn("document_type", F.lit("MPR")))
    assert r.rewrites == 1 and r.is_grounded and r.post_rerank_ids == ["c2"] and "MPR" in r.filters
    assert r.trace[3:6] == ["rewrite_query", "retrieve", "grade_documents"]


def test_gives_up(spark):
    r = run(spark, "bank of the zebra island", relevant=lambda q, t: F.lit(False))
    assert r.answer == ABSTAIN and r.trace[-1] == "abstain" and r.rewrites == 1 and r.failures == 0 and r.chunks_used == 0


def test_regenerates_once(spark):
    made = lambda q, t, strict: F.lit("bank") if strict else F.lit("unheard of")
    r = run(spark, "bank rates", generate=made)
    assert r.answer == "bank" and r.failures == 1 and r.is_grounded and r.trace[-2:] == ["generate", "check_hallucination"]
    r = run(spark, "bank rates", generate=lambda q, t, strict: F.lit("unheard of"))
    assert r.failures == 2 and r.is_grounded is False


def test_cache(spark):
    store = tempfile.mkdtemp() + "/answers"
    runs = []

    def answer(q):
        runs.append(sorted(r.question for r in q.collect()))
        return q.withColumn("answer", F.upper("question"))

    first = cached(asked(spark, "a", "b", "a"), store, answer, "p", "m", "1").collect()
    assert sorted((r.question_id, r.answer) for r in first) == [("q0", "A"), ("q1", "B"), ("q2", "A")]
    cached(asked(spark, "b", "c"), store, answer, "p", "m", "1").collect()
    cached(asked(spark, "b"), store, answer, "p", "m", "2").collect()
    assert runs == [["a", "b"], ["c"], ["b"]]


def test_stream(spark):
    from millrace.streaming.ingest import chunk_stream, latest

    root = tempfile.mkdtemp()
    docs = lambda text: spark.createDataFrame([(1, text)], "doc_id long, text string").write.mode("append").parquet(f"{root}/in")
    for text in ("old text", "new text here"):
        docs(text)
        source = spark.readStream.schema("doc_id long, text string").parquet(f"{root}/in")
        chunk_stream(source, f"{root}/out", f"{root}/state").awaitTermination()
    assert [r.text for r in latest(spark.read.parquet(f"{root}/out")).collect()] == ["new text here"]


def test_ask(spark):
    import pytest

    from millrace.jobs.ask import ask, observed, run_facts, subset

    questions = asked(spark, "bank held rates five", " ", "x" * 2001)
    got, seen = observed(ask(questions, library(spark)), "answers")
    rows = {r.question_id: r for r in got.collect()}
    assert rows["q0"].answer and not rows["q0"].is_abstain and (rows["q1"].error, rows["q2"].error) == ("blank", "too long") and rows["q1"].answer is None
    assert seen.get == {"rows": 3, "errors": 2}
    assert [r.question_id for r in subset(questions, ["q1"]).collect()] == ["q1"] and subset(questions, first=2).count() == 2
    with pytest.raises(ValueError, match="q9"):
        subset(questions, ["q9"])
    one, other = (run_facts(spark, q, {"judge": "lexical"}).first() for q in (questions, questions.filter("question_id <> 'q1'")))
    assert (one.n_queries, other.n_queries, one.judge) == (3, 2, "lexical") and one.test_set_hash != other.test_set_hash


def test_retrieval_of_many_questions(spark, monkeypatch):
    """Thousands of questions with a term that all share, in several blocks, against counting by sets."""
    import random

    from millrace.operators import retrieval

    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(300)]
    chunks = [(f"c{k}", " ".join(["the", *rng.choices(vocabulary, k=rng.randrange(1, 30))]), rng.choice(["a", "b", None])) for k in range(150)] + [("empty", "", "a"), ("none", None, "a")]
    asked_ = [(k, " ".join(["The", *rng.choices(vocabulary, k=rng.randrange(0, 6))]), None if k % 3 else " ".join(rng.choices(vocabulary, k=4)), rng.choice(["a", "b", "", None, "zz"])) for k in range(3000)]
    monkeypatch.setattr(retrieval, "BLOCK_TERMS", 5000)
    monkeypatch.setattr(retrieval, "PAIRS", 20_000)
    questions = spark.createDataFrame(asked_, "question_id long, question string, rewritten string, kind string")
    got = retrieval.retrieve(questions, spark.createDataFrame(chunks, "chunk_id string, text string, kind string"), 3, ["kind"]).collect()
    bags = {c: set((t or "").lower().split()) for c, t, _ in chunks}
    kinds = {c: k for c, _, k in chunks}
    want = set()
    for i, q, other, kind in asked_:
        own = set((other if other is not None else q).lower().split())
        hits = sorted((-len(own & bags[c]), c) for c in bags if own & bags[c] and kind in (None, "", kinds[c]))[:3]
        want |= {(i, c, r + 1, round(-n / len(own), 4)) for r, (n, c) in enumerate(hits)}
    assert {(r.question_id, r.chunk_id, r["rank"], r.score) for r in got} == want and len(got) == len(want)


def test_prompted_models(spark):
    """One model that answers prompts takes all parts of the pipeline."""

    @F.pandas_udf("string")
    def reply(prompts):
        def one(p):
            if p.startswith("Does this passage"):
                return "Yes." if "rates" in p.split("Passage:")[1] else "no"
            if p.startswith("Is every statement"):
                return "yes indeed" if "held" in p.split("Answer:")[1] else "No"
            return "held at five" if "borne out" in p else "unknown"

        return prompts.map(one)

    found = {r.question_id: r for r in C.corrective(asked(spark, "bank rates", "inflation march"), library(spark), C.prompted(reply)).collect()}
    assert found["q0"].answer == "held at five" and found["q0"].failures == 1 and found["q0"].is_grounded and len(found["q0"].sources) == 2
    assert found["q1"].answer == ABSTAIN and found["q1"].sources == []


def test_near_in_cells(spark):
    """With all cells the neighbours are exact; copies tie by id wherever they lie; odd vectors are no one's."""
    import numpy as np

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 16)) * 4
    m = [[float(x) for x in centres[k % 12] + rng.normal(size=16)] for k in range(1500)]
    rows = [(k, v) for k, v in enumerate(m)] + [(2000 + k, m[7]) for k in range(40)] + [(3000, None), (3001, [0.0] * 16), (3002, [1.0]), (3003, [float("nan")] * 16)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    queries = frame.filter("vec_id % 50 = 7 or vec_id >= 3000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    exact = vectors.nearest_batch(frame, queries, 10)
    seven = [r.vec_id for r in exact.filter("query_id = 7").orderBy("rank").collect()]
    assert seven == [7, *range(2000, 2009)] and exact.filter("query_id >= 3000").count() == 0
    cells = vectors.fit_cells(frame, 12)
    stored = vectors.in_cells(frame, cells)
    assert stored.count() == len(rows) and stored.filter("cell = -1").count() == 4
    told = lambda df: sorted(tuple(r) for r in df.collect())
    assert told(vectors.nearest_in_cells(stored, cells, queries, 10, 12)) == told(exact)
    assert vectors.recall(vectors.nearest_in_cells(stored, cells, queries, 10, 3), exact) >= 0.9


def test_tests_in_order(spark, tmp_path):
    """Numbers and the fingerprint follow the rows' order, however many files and partitions there are."""
    import hashlib
    import json

    from millrace.sources import records

    (tmp_path / "t.csv").write_text('question,category\n" first, with\nbreak ",a\nsécond/2,\nthird "x",b\n')
    tests = records.read_tests(spark, f"file://{tmp_path}/t.csv")
    rows = [{"question": "first, with\nbreak", "category": "a"}, {"question": "sécond/2", "category": None}, {"question": 'third "x"', "category": "b"}]
    want = "sha256:" + hashlib.sha256("\n".join(json.dumps(r, sort_keys=True, ensure_ascii=False) for r in rows).encode()).hexdigest()
    assert [r.question_id for r in tests.orderBy("question_id").collect()] == ["q01", "q02", "q03"]
    assert records.fingerprint(tests).first().test_set_hash == want == records.fingerprint(tests.repartition(5)).first().test_set_hash
    many = records.numbered(spark.range(0, 1000, 1, 7).select((F.col("id") * 3).alias("x")), "n")
    assert sorted((r.n, r.x) for r in many.collect()) == [(k + 1, 3 * k) for k in range(1000)]


def test_cells_of_many_queries_in_little_memory():
    """Queries that look in most of many cells: what is allocated follows pairs of rows and queries, not their cells, and equal vectors cost no more."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    m, cells = rng.normal(size=(2000, 8)), vectors._units(rng.normal(size=(1024, 8)))
    m[500:] = m[500]
    listed = lambda x: pa.array(x.tolist(), pa.list_(pa.float64()))
    own = vectors._closest(vectors._units(m), cells, 1)[:, 0].astype(np.int32)
    own[7] = -1
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), listed(m), pa.array(own)], names=["vec_id", "embedding", "cell"])
    tracemalloc.start()
    q = vectors._asked(pa.table({"query_id": pa.array(range(600)), "query_vector": listed(m[:600])}), [], cells, 768)
    who, row, raw = vectors._near(batch, q, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
    units = vectors._units(m)
    for k in (0, 7, 499, 599):
        score = np.where(np.isin(own, vectors._closest(units[k : k + 1], cells, 768)[0]), units @ units[k], -np.inf)
        assert set(np.flatnonzero(score >= np.sort(score)[-3] - 1e-9)) == set(row[who == k])
        assert np.allclose(raw[who == k], score[row[who == k]])


def test_common_terms_in_little_memory():
    """Chunks of terms that all questions have: listed questions are counted so many at a time, and a task gives the k best of all its batches."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    from millrace.operators import retrieval

    common = [f"t{k}" for k in range(100)]
    asked = pa.table({"question_id": pa.array(range(2000)), "terms": pa.array([common[: 100 - k % 3] for k in range(2000)])})
    block = retrieval._block(asked, [])
    batches = [pa.RecordBatch.from_pydict({"chunk_id": [f"c{b}{k:03d}" for k in range(100)], "terms": [common[k % 7 :] for k in range(100)]}) for b in range(3)]
    tracemalloc.start()
    found = pa.Table.from_batches(list(retrieval._counted(SimpleNamespace(value=block), 2)(iter(batches)))).to_pydict()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300e6
    want = sorted((q, c, 100 - q % 3) for q in range(2000) for c in ("c0000", "c0007"))
    assert sorted(zip(found["question_id"], found["chunk_id"], found["hits"], strict=True)) == want


def test_short_questions_in_blocks(spark, monkeypatch):
    """Questions of one word each come to more blocks than their terms ask for, and none is lost."""
    from millrace.operators import retrieval

    sizes, make = [], retrieval._block
    monkeypatch.setattr(retrieval, "BLOCK_QUESTIONS", 500, raising=False)
    monkeypatch.setattr(retrieval, "_block", lambda own, filters: sizes.append(len(own)) or make(own, filters))
    questions = spark.range(2000).selectExpr("id as question_id", "concat('w', id % 40) as question", "cast(null as string) as rewritten")
    chunks = spark.createDataFrame([(f"c{k:02d}", f"w{k} w{k + 1}") for k in range(39)], "chunk_id string, text string")
    got = {(r.question_id, r.chunk_id, r["rank"]) for r in retrieval.retrieve(questions, chunks, 1).collect()}
    assert got == {(i, f"c{max(0, i % 40 - 1):02d}", 1) for i in range(2000)}
    assert sum(sizes) == 2000 and max(sizes) < 700
