"""Collections, runs over a test set, scores that are resumed, reports, and the files they read and write."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.functions.text import ABSTAIN
from millrace.jobs import evaluate
from millrace.operators import corrective as C
from millrace.operators import evaluation as E
from millrace.operators.collection import Collection, build_index
from millrace.sources import records as R

CHUNKS = "chunk_id string, text string, document_type string, speaker string"


def library(spark):
    rows = [("a", "rates rise in spring and fall in autumn", "MPR", None), ("b", "banks hold more capital this year", "FSR", None), ("c", "the committee voted to hold rates in spring", "MPC_minutes", "Ann Baker"), ("d", "wages grow", "MPR", None)]
    return spark.createDataFrame(rows, CHUNKS)


def test_collection(spark, tmp_path):
    store = Collection(spark, f"file://{tmp_path}/vectors")
    assert store.status() == {"ready": False, "records": 0} and store.read() is None
    rows = library(spark).withColumnRenamed("chunk_id", "id").withColumn("speaker", F.coalesce("speaker", F.lit("")))
    first, built = store.index(rows)
    assert built and first.count() == 4 and store.status() == {"ready": True, "records": 4}
    changed = rows.withColumn("text", F.when(F.col("id") == "d", "wages fall").otherwise(F.col("text")))
    assert store.index(changed)[1] is False and store.get(spark.createDataFrame([("d",)], "id string")).first()["text"] == "wages grow"
    seen = []
    counted = Collection(spark, store.path, lambda df: (seen.append(df.count()), store.embed(df))[1])
    counted.upsert(changed.union(spark.createDataFrame([("e", "new text here", "MPR", "")], rows.schema)))
    assert seen == [2] and store.count() == 5 and store.get(spark.createDataFrame([("d",)], "id string")).first()["text"] == "wages fall"
    assert store.delete(spark.createDataFrame([("e",), ("x",)], "id string")).count() == 4
    assert store.index(rows, force=True)[1] and store.get(spark.createDataFrame([("d",)], "id string")).first()["text"] == "wages grow"
    asked = spark.createDataFrame([(1, "hold rates in spring", None, ""), (2, "more capital for banks", None, "FSR"), (3, "rates in spring", None, "MPR")], "question_id long, question string, rewritten string, document_type string")
    best = {r.question_id: r.chunk_id for r in store.search(asked, 1, ["document_type"]).collect()}
    assert best == {1: "c", 2: "b", 3: "a"}
    assert build_index(spark, library(spark), library(spark).limit(3), f"file://{tmp_path}/both") == {"enhanced": 4, "baseline": 3}


def test_a_collection_grows_by_what_changes(spark, tmp_path):
    """A change of one in a hundred writes about that much; deltas merge once they are large; all reads equal a rewritten table."""
    store = Collection(spark, f"file://{tmp_path}/v", merge_at=0.05)
    rows = spark.range(2000).select(F.concat(F.lit("r"), "id").alias("id"), F.concat(F.lit("text of "), F.col("id") * 7).alias("text"))
    store.index(rows)
    names = lambda kind: [x.name for x in tmp_path.joinpath("v").iterdir() if x.name.startswith(kind)]
    size = lambda name: sum(p.stat().st_size for p in tmp_path.joinpath("v", name).rglob("*.parquet"))
    want = {r.id: r.text for r in rows.collect()}
    for turn in range(6):
        part = rows.filter(F.col("id").endswith(f"{turn}0")).withColumn("text", F.lit(f"turn {turn}"))
        store.upsert(part.unionByName(rows.filter("id = 'r1'")))
        want |= {r.id: r.text for r in part.collect()}
        if turn == 0:
            (delta,) = names("delta")
            assert size(delta) < 0.2 * size(names("base")[0]) and spark.read.parquet(f"{tmp_path}/v/{delta}").count() == part.count()
        gone = [f"r{turn}5", f"r{turn}6", "nothing"]
        store.delete(spark.createDataFrame([(x,) for x in gone], "id string"))
        want = {k: v for k, v in want.items() if k not in gone}
        assert {r.id: r.text for r in store.read().collect()} == want and store.count() == len(want)
    assert len(names("base")) == 2 and len(names("delta")) < 12
    again = store.upsert(rows.filter("id = 'r05' or id = 'r15'"))
    assert again.filter("id = 'r15'").first()["text"] == "text of 105"
    assert store.index(rows.limit(3), force=True)[0].count() == 3


def test_two_writers(spark, tmp_path):
    """Changes that began from the same state are both kept."""
    first, second = (Collection(spark, f"file://{tmp_path}/v") for _ in range(2))
    first.index(spark.createDataFrame([("a", "one"), ("b", "two")], "id string, text string"))
    row = lambda i, t: first.embedded(spark.createDataFrame([(i, t)], "id string, text string")).withColumn("gone", F.lit(False))
    first._put(row("c", "three"), "delta")
    second._put(row("d", "four"), "delta")
    assert sorted(r.id for r in second.read().collect()) == ["a", "b", "c", "d"]
    first.merge()
    assert sorted(r.id for r in second.read().collect()) == ["a", "b", "c", "d"]


def test_a_bounded_cache(spark, tmp_path):
    """Hits write no responses; beyond the cap the responses used longest ago go."""
    import time

    from millrace.operators import cache

    store, runs = f"file://{tmp_path}/answers", []

    def answer(q):
        runs.append(q.count())
        return q.withColumn("answer", F.repeat(F.sha2("question", 256), 40))

    ask_ = lambda *xs, cap=1 << 30: cache.cached(spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "question_id long, question string"), store, answer, "p", "m", "1", cap).collect()
    ask_("a", "b", "c")
    ask_("c", "b", "b")
    assert runs == [3] and len(cache._builds(spark, store, "answers")) == 1
    time.sleep(0.05)
    ask_("d", "b")
    held = cache.size(spark, store)
    time.sleep(0.05)
    ask_("e", cap=int(held * 0.95))
    assert len(cache._builds(spark, store, "answers")) == 1 and cache.size(spark, store) <= held * 0.95
    runs.clear()
    assert len(ask_("e", "d", "b")) == 3 and runs == []
    ask_("a")
    assert runs == [1]
    cache.clear(spark, store)
    assert cache.read(spark, store) is None


def test_pipelines_over_a_collection(spark, tmp_path):
    store = Collection(spark, f"file://{tmp_path}/vectors")
    store.index(library(spark).withColumnRenamed("chunk_id", "id"))
    asked = spark.createDataFrame([("q01", "hold rates in spring"), ("q02", "zebra quagga")], "question_id string, question string")
    plain = {r.question_id: r for r in C.baseline(asked, None, search=store.search).collect()}
    assert plain["q01"].answer == "the committee voted to hold rates in spring" and plain["q01"].chunks_used == 4
    from millrace.jobs.ask import ask

    said = {r.question_id: (r.answer, r.error) for r in ask(asked.union(spark.createDataFrame([("q03", " ")], asked.schema)), None, "corrective", search=store.search, filters=[]).collect()}
    assert said == {"q01": ("the committee voted to hold rates in spring", None), "q02": (ABSTAIN, None), "q03": (None, "blank")}
    found = {r.question_id: r for r in C.corrective(asked, None, search=store.search, filters=[]).collect()}
    assert found["q01"].post_rerank_ids[0] == "c" and found["q01"].is_grounded and found["q02"].trace[-1] == "abstain"


def test_failing_models_give_error_rows(spark):
    def model(question, texts, strict):
        if "capital" in question:
            raise RuntimeError("no reply")
        return texts[0] if strict else "made up words"

    asked = spark.createDataFrame([("q01", "rates in spring"), ("q02", "more capital for banks")], "question_id string, question string")
    for run in (C.baseline, C.corrective):
        found = {r.question_id: r for r in run(asked, library(spark), C.Models(generate=C.guarded(model))).collect()}
        bad = found["q02"]
        assert bad.answer == "[Pipeline error: RuntimeError: no reply]" and bad.trace == ["error"] and (bad.chunks_retrieved, bad.chunks_used, bad.is_grounded, bad.post_rerank_ids) == (0, 0, None, [])
    assert found["q01"].failures == 1 and found["q01"].is_grounded and found["q01"].trace[-2:] == ["generate", "check_hallucination"]
    assert E.run_counters(run(asked, library(spark), C.Models(generate=C.guarded(model)))).first()["errors"] == 1
    never = C.Models(generate=C.guarded(lambda q, t, strict: "made up words"))
    assert [(r.failures, r.is_grounded) for r in C.corrective(asked.limit(1), library(spark), never).collect()] == [(2, False)]


def test_scores_are_resumed(spark, tmp_path):
    rows = [("baseline", "q01", "when do rates rise", "rates rise in spring", ["rates rise in spring and fall", "other words"], "in spring"), ("baseline", "q02", "what", "nothing", [], "none"), ("corrective", "q01", "when", "", ["x"], "")]
    rows = spark.createDataFrame(rows, "pipeline string, question_id string, question string, answer string, contexts array<string>, reference string")
    calls = spark.sparkContext.accumulator(0)

    def judge(question, answer, contexts, reference):
        calls.add(1)
        if not answer:
            raise ValueError("x" * 900)
        return 0.5

    path = f"file://{tmp_path}/scores"
    metrics = {"faithfulness": E.Judge(judge), "context_recall": E.LEXICAL["context_recall"]}
    got = {(r.pipeline, r.question_id, r.metric): r for r in evaluate.run_scores(rows, path, metrics).collect()}
    assert len(got) == 6 and calls.value == 2 and got["baseline", "q01", "context_recall"].score == 1.0 and got["baseline", "q01", "faithfulness"].score == 0.5
    assert got["baseline", "q02", "faithfulness"].skipped == "abstain" and got["baseline", "q02", "context_recall"].score is None
    bad = got["corrective", "q01", "faithfulness"]
    assert bad.score is None and bad.err.startswith("ValueError: xxx") and len(bad.err) == 500 and got["corrective", "q01", "context_recall"].score is None
    evaluate.run_scores(rows, path, metrics)
    assert calls.value == 2
    evaluate.run_scores(rows, path, metrics, retry_errors=True)
    assert calls.value == 3
    assert evaluate.run_scores(rows, path, metrics, fresh=True).count() == 6 and calls.value == 5


def asked_rows(spark, n):
    rows = [("baseline", f"q{k:02d}", f"question {k}", "words", ["words of a chunk"], "words") for k in range(n)]
    return spark.createDataFrame(rows, "pipeline string, question_id string, question string, answer string, contexts array<string>, reference string")


def test_a_broken_run_goes_on(spark, tmp_path):
    """A run that is killed half way loses its open round only: the next one asks what is left."""
    calls = tmp_path / "calls"
    calls.mkdir()

    def judge(question, answer, contexts, reference, dies=True):
        import uuid

        (calls / f"{question}-{uuid.uuid4().hex}").touch()
        if dies and question == "question 31":
            raise KeyboardInterrupt  # not an error of the judge, but the end of its task
        return 0.5

    path, rows = f"file://{tmp_path}/scores", asked_rows(spark, 40)
    with pytest.raises(Exception, match="KeyboardInterrupt|exited|crashed|EOF"):
        evaluate.run_scores(rows, path, {"faithfulness": E.Judge(judge, calls=1, tasks=1)}, round_rows=8)
    kept = R.read_scores(spark, path).count()
    before = len(list(calls.iterdir()))
    assert 0 < kept < 40 and kept <= before
    got = evaluate.run_scores(rows, path, {"faithfulness": E.Judge(lambda *a: judge(*a, dies=False))}, round_rows=8)
    assert got.count() == 40 and got.filter("score = 0.5").count() == 40
    assert len(list(calls.iterdir())) - before == 40 - kept


def test_calls_at_once_are_bounded(spark, tmp_path):
    def judge(question, answer, contexts, reference):
        import os
        import time

        mine = f"{tmp_path}/{os.getpid()}-{time.monotonic_ns()}-{question[9:]}"
        open(mine, "w").close()
        time.sleep(0.05)
        n = len(os.listdir(tmp_path))
        os.remove(mine)
        return float(n)

    rows = asked_rows(spark, 30).withColumn("metric", F.lit("faithfulness"))
    most = max(r.score for r in E.Judge(judge, calls=3, tasks=2).scores(rows).collect())
    assert 3 < most <= 6


def test_a_whole_run(spark, tmp_path):
    tests = spark.createDataFrame([("q01", "hold rates in spring", "plain", "hold rates"), ("q02", "zebra quagga", "edge", "nothing")], "question_id string, question string, category string, expected_answer string")
    results, scores = evaluate.evaluated(tests, library(spark), f"file://{tmp_path}", should_abstain=tests.filter("category = 'edge'"))
    first = {r.question_id: r for r in results["corrective"].collect()}["q01"]
    assert [x.chunk_id for x in first.sources] == first.post_rerank_ids and first.sources[0].text == "the committee voted to hold rates in spring" and first.sources[0].score == 1.0
    got = {(r.pipeline, r.question_id, r.metric): r.score for r in scores.collect()}
    assert len(got) == 16 and got["corrective", "q01", "context_recall"] == 1.0 and got["baseline", "q01", "faithfulness"] == 1.0 and got["corrective", "q02", "faithfulness"] is None
    assert {p.name for p in (tmp_path / "reports").iterdir()} == {"aggregate", "comparison", "corrective_metrics", "per_category"}
    with_previews = results["baseline"].withColumn("sources", F.transform("sources", lambda x: F.struct(F.lit("").alias("text"), F.upper(x["text"]).alias("text_preview"))))
    shown = {r.question_id: r.contexts for r in E.samples(with_previews, tests).collect()}
    assert shown["q02"] == [] and shown["q01"][0] == "THE COMMITTEE VOTED TO HOLD RATES IN SPRING"


def test_invariant(spark):
    run_ = lambda **traces: spark.createDataFrame(list(traces.items()), "question_id string, trace array<string>")
    before, after = run_(a=["abstain"], b=["x"], c=["x"]), run_(a=["x"], b=["abstain_out_of_corpus"], c=["x"])
    want = before.filter("question_id = 'b'")
    assert E.abstain_invariant(before, after, want).first().asDict() == {"n_added": 1, "n_removed": 1, "n_missing": 0, "n_extra": 0, "holds": False}
    assert E.abstain_invariant(before, before, want.filter("false")).first().holds and not E.abstain_invariant(before, before, want).first().holds


def test_lexical_metrics(spark):
    rows = spark.createDataFrame([("a b c d", "a b x y", ["a b", "q", "c d"], "a b c d")], "q string, a string, c array<string>, r string")
    got = rows.select(*(f(*map(F.col, "qacr")).alias(k) for k, f in E.LEXICAL.items())).first().asDict()
    assert got == {"faithfulness": 0.5, "answer_relevancy": 0.5, "context_precision_with_reference": pytest.approx((1 + 2 / 3) / 2), "context_recall": 1.0}


def test_runs_and_reports(spark, tmp_path):
    asked = spark.createDataFrame([("q01", "hold rates in spring"), ("q02", "zebra quagga")], "question_id string, question string")
    out = evaluate.run_pipelines(asked, library(spark), f"file://{tmp_path}/results")
    assert {k: v.count() for k, v in out.items()} == {"baseline": 2, "corrective": 2}
    assert {r.question_id: r.trace[-1] for r in out["corrective"].collect()} == {"q01": "check_hallucination", "q02": "abstain"}
    scores = spark.createDataFrame([(p, q, m, s) for p, s in (("baseline", 0.4), ("corrective", 0.6)) for q in ("q01", "q02") for m in E.METRICS], "pipeline string, question_id string, metric string, score double")
    tests = spark.createDataFrame([("q01", "plain"), ("q02", "edge")], "question_id string, category string")
    evaluate.write_reports(scores, out["corrective"], tests, tests.filter("category = 'edge'"), f"file://{tmp_path}/reports")
    read = lambda name: [json.loads(x) for p in sorted((tmp_path / "reports" / name).glob("part-*")) for x in p.read_text().splitlines()]
    assert {r["metric"]: (r["mean_delta"], r["n_pairs"]) for r in read("aggregate")} == {m: (pytest.approx(0.2), 1) for m in E.METRICS}
    (rates,) = read("corrective_metrics")
    assert rates["abstain_rate"] == 0.5 and rates["abstain_precision"] == 1.0
    lines = [x for p in (tmp_path / "reports" / "per_category").glob("part-*") for x in p.read_text().splitlines()]
    assert "faithfulness/plain,1,0.4000,0.6000,0.2000" in lines
    chunks = spark.createDataFrame([("d", "c1", 5), ("d", "c2", 7), ("e", "c3", 1)], "doc_id string, chunk_id string, token_count long")
    assert evaluate.chunk_summary(chunks, chunks.limit(2)).first().asDict() == {"documents": 2, "enhanced_chunks": 3, "enhanced_tokens": 13, "baseline_chunks": 2, "baseline_tokens": 12}


def test_divergences_and_shifts(spark):
    rows = spark.createDataFrame([(f"q{k}", k / 10) for k in range(8)], "question_id string, diff double")
    assert [r.question_id for r in E.worst(rows, ["question_id"]).collect()] == ["q7", "q6", "q5", "q4", "q3"]
    a, b = ([("q1", ["x"]), ("q2", ["x", "y"])], [("q1", ["x", "z"]), ("q2", ["y", "x"])])
    kind = "question_id string, trace array<string>"
    assert [tuple(r) for r in E.trace_shifts(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), "question_id").collect()] == [("q1", 1, 2)]


def test_files(spark, tmp_path):
    at = f"file://{tmp_path}"
    plain = spark.createDataFrame([("d", 1, "baseline_d_001", "one", 1), ("d", 2, "baseline_d_002", "two words", 2)], "doc_id string, chunk_no int, chunk_id string, text string, token_count long")
    R.write_baseline_chunks(plain, f"{at}/plain")
    assert sorted(tuple(r) for r in R.read_chunks(spark, f"{at}/plain", baseline=True).collect()) == [("baseline_d_001", "one"), ("baseline_d_002", "two words")]
    (tmp_path / "tests.csv").write_text("question,category\n\"first, with\nbreak\",a\nsecond,b\n")
    assert [(r.question_id, r.question) for r in R.read_tests(spark, f"{at}/tests.csv").orderBy("question_id").collect()] == [("q01", "first, with\nbreak"), ("q02", "second")]
    (tmp_path / "results.json").write_text(json.dumps({"q01": {"answer": "x", "crag_rewrites": 1}, "q02": {"answer": "y", "crag_rewrites": 0}}))
    assert sorted(tuple(r) for r in R.read_results(spark, f"{at}/results.json", "answer string, crag_rewrites int").collect()) == [("q01", "x", 1), ("q02", "y", 0)]
    score = spark.createDataFrame([("baseline", "q01", "faithfulness", 0.1, None, None, "t1")], R.SCORES)
    R.append_scores(score, f"{at}/scores")
    R.append_scores(score.withColumn("score", F.lit(0.9)), f"{at}/scores")
    assert sorted(r.score for r in R.read_scores(spark, f"{at}/scores").collect()) == [0.1, 0.9]
    R.write_csv(spark.createDataFrame([("a", 0.5), ("b", None)], "k string, v double"), f"{at}/csv")
    assert {x for p in tmp_path.glob("csv/part-*") for x in p.read_text().splitlines()} == {"a,0.5000", "b,", "k,v"}


def test_deep_and_failing_pages(spark, monkeypatch):
    from millrace.sources import site

    rows = [(1, '<div id="output"><p>x' + "<div>" * 3000 + "<p>y", "MPR"), (2, '<div id="output"><p>z</p></div>', "MPR")]
    got = {r.page_id: (r.text, r.error) for r in site.site_texts(spark.createDataFrame(rows, "page_id long, html string, document_type string")).collect()}
    assert got == {1: ("x\n\ny", None), 2: ("z", None)}
    monkeypatch.setattr(site, "extract", lambda page, kind: 1 / 0)
    assert site.told_or_error("x", "MPR") == (None, "", "", "", "ZeroDivisionError: division by zero")
