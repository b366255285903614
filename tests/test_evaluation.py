"""Statistics against known values, and the comparison of runs."""

import math
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.operators import evaluation as E
from millrace.operators import paired
from millrace.sources import records


@pytest.mark.parametrize(("p", "want"), [([0.012, 0.02, 0.04, 0.05], [0.048, 0.06, 0.08, 0.08]), ([0.5, 0.01, 0.5, 0.5], [1, 0.04, 1, 1]), ([None, 0.03], [0.03])])
def test_holm(spark, p, want):
    rows = spark.createDataFrame([(f"t{k}", x) for k, x in enumerate(p)], "name string, p double")
    assert [r.adjusted for r in E.holm(rows, "name", "p").orderBy("name").collect()] == pytest.approx(want)


def pairs(spark, rows):
    return paired.differences(spark.createDataFrame([("g", *r) for r in rows], "g string, b double, e double"), "g", "b", "e")


def test_wilcoxon(spark):
    assert paired.wilcoxon(pairs(spark, [(0.1, 0.5)] * 10), "g").first().p < 0.01
    five = [(0.1, 0.2), (0.2, math.nan), (0.3, 0.2), (0.5, 0.9), (0.4, 0.4)]
    r = paired.wilcoxon(pairs(spark, five), "g").first()
    d = np.array([-0.1, 0.1, -0.4, 0.0])
    rank = {0.0: 1, 0.1: 2.5, 0.4: 4}
    w = sum(rank[abs(round(x, 6))] * (1 if x > 0 else 0.5 if x == 0 else 0) for x in d)
    assert r.n == 4 and r.w == pytest.approx(w, abs=1) and 0 < r.p < 1
    assert paired.wilcoxon(pairs(spark, [(0.1, 0.2)]), "g").first().p is None


def plain_interval(d, resamples=10_000, seed=7):
    """The interval by resampling pairs one by one."""
    n, rng = len(d), np.random.default_rng(seed)
    drawn = d[rng.integers(0, n, (resamples, n))].mean(1)
    u = (n - 1) * (((d.sum() - d) / (n - 1)).mean() - (d.sum() - d) / (n - 1))
    return paired._ends(drawn, d.mean(), (u**3).sum() / n**3 / (6 * ((u**2).sum() / n**2) ** 1.5), 0.95)


@pytest.mark.parametrize("n", [4, 30, 1000, 1001])
def test_bootstrap(spark, n):
    """One scheme at every size: near the interval of plain resampling, within a tenth of its length."""
    d = np.round(np.random.default_rng(n).normal(0.3, 0.1, n), 3)
    low, high = plain_interval(d)
    r = paired.bootstrap(pairs(spark, [(0.0, float(x)) for x in d]), "g").first()
    assert r.n == n and (r.low, r.high) == pytest.approx((low, high), abs=0.1 * (high - low))


def test_bootstrap_is_the_same_however_dealt(spark, monkeypatch):
    """Neither partitions nor other groups change a group's interval; blocks of values add up."""
    monkeypatch.setattr(paired, "BLOCK_VALUES", 50)
    d = np.round(np.random.default_rng(3).normal(0.3, 1, 700), 4)
    one = pairs(spark, [(0.0, float(x)) for x in d])
    want = paired.bootstrap(one, "g").first()
    more = one.unionByName(pairs(spark, [(0.0, float(x)) for x in range(300)]).withColumn("g", F.lit("h"))).repartition(7)
    got = {r.g: r for r in paired.bootstrap(more, "g").collect()}
    assert (got["g"].n, got["g"].low, got["g"].high) == (want.n, pytest.approx(want.low, rel=1e-12), pytest.approx(want.high, rel=1e-12)) and got["h"].n == 300
    low, high = plain_interval(d)
    assert (want.low, want.high) == pytest.approx((low, high), abs=0.1 * (high - low))
    few = {r.g: (r.n, r.low, r.high) for r in paired.bootstrap(pairs(spark, [(0.0, 1.0)] * 20).unionByName(pairs(spark, [(0.0, 1.0), (0.0, 2.0)]).withColumn("g", F.lit(None))), "g").collect()}
    assert few == {"g": (20, None, None), None: (2, None, None)}


RESULT = "question_id string, rewrites int, failures int, is_grounded boolean, filters string, chunks_retrieved int, chunks_used int, trace array<string>, pre_rerank_ids array<string>, post_rerank_ids array<string>, answer string"


def results(spark):
    rows = [
        ("a", 0, 0, True, "f", 10, 5, ["generate"], ["1", "2"], ["2", "1"], "x"),
        ("b", 1, 0, True, None, 10, 3, ["generate"], ["1"], ["1"], "x"),
        ("c", 0, 1, True, None, 10, 4, ["generate"], [], [], "x"),
        ("d", 1, 0, None, None, 0, 0, ["abstain"], [], [], "[Pipeline error: E: x]"),
    ]
    return spark.createDataFrame(rows, RESULT)


def test_corrective_rates(spark):
    none = results(spark).filter("false").select("question_id")
    r = E.corrective_rates(results(spark), none).first()
    assert (r.rewrite_trigger_rate, r.rewrite_recovery_rate, r.hallucination_flag_rate, r.hallucination_recovery_rate, r.filter_rate) == (0.5, 0.5, 0, 1, 0.25)
    assert (r.mean_chunks_retrieved, r.mean_chunks_used, r.rerank_top1_change_rate, r.abstain_rate, r.abstain_precision, r.abstain_recall) == (7.5, 3, 0.5, 0.25, 0, None)
    assert E.corrective_rates(results(spark).filter("false"), none).count() == 0
    assert tuple(E.run_counters(results(spark)).first()) == (1, 1, 2, 1)


def test_plan_resumes(spark):
    rows = spark.createDataFrame([("p", "q1", True), ("p", "q2", False)], "pipeline string, question_id string, has_context boolean")
    done = spark.createDataFrame([("p", "q1", "faithfulness", None), ("p", "q1", "context_recall", "boom")], "pipeline string, question_id string, metric string, err string")
    plan = {(r.question_id, r.metric): r.skipped for r in E.scoring_plan(rows, E.METRICS, done).collect()}
    assert len(plan) == 6 and plan["q2", "faithfulness"] == "abstain" and plan["q2", "answer_relevancy"] is None
    assert E.scoring_plan(rows, E.METRICS, done, retry_errors=True).count() == 7


def test_comparison(spark):
    a = spark.createDataFrame([("x", 1.0), ("x", None), ("y", 0.5), (None, 1.0)], "category string, score double")
    b = spark.createDataFrame([("x", 0.5), ("x", 0.0), ("z", 1.0)], "category string, score double")
    found = {r.category: (r.n, r.baseline, r.enhanced, r.delta) for r in E.category_comparison(a, b).collect()}
    assert found == {"x": (2, 1.0, 0.25, -0.75), "y": (1, 0.5, None, None), "z": (1, None, 1.0, None)}


def test_divergence(spark):
    a = spark.createDataFrame([("q", m, s) for m, s in zip("abcd", [0.1, 0.5, None, 0.9], strict=True)], "q string, m string, score double")
    b = spark.createDataFrame([("q", m, s) for m, s in zip("abcd", [0.2, 0.9, 0.1, 0.9], strict=True)], "q string, m string, score double")
    r = E.divergence_summary(E.judge_divergence(a, b, ["q", "m"])).first()
    assert (r.n, r.max_diff, r.median_diff, r.verdict) == (3, 0.4, 0.1, "material")


def test_records(spark):
    root = tempfile.mkdtemp()
    with open(f"{root}/s.jsonl", "w") as f:
        f.write('{"pipeline":"p","query_id":"q1","metric":"m","score":0.1}\nbroken\n\n{"pipeline":"p","query_id":"q1","metric":"m","score":0.7}\n')
    scores = records.read_scores(spark, f"{root}/s.jsonl")
    assert scores.count() == 2
    assert [r.score for r in E.last_write(scores, ["query_id", "metric"], "position").collect()] == [0.7]
    with open(f"{root}/m.csv", "w") as f:
        f.write("filename,document_type,date,title,source_url,word_count,status\na.txt,MPR,2025-01,T,u,3,ok\nb.txt,MPR,2025-01,T,u,0,missing\nc.txt,odd,2025-01,T,u,3,ok\n")
    rows = records.read_manifest(spark, f"{root}/m.csv")
    assert rows.first().speaker is None and rows.first().word_count == 3
    import os

    os.mkdir(f"{root}/t")
    for name in "abc":
        with open(f"{root}/t/{name}.txt", "w") as f:
            f.write("## Outlook\n" + "word " * 30)
    ready = records.to_chunk(rows, records.read_texts(spark, f"{root}/t"))
    assert [r.filename for r in ready.collect()] == ["a.txt"]
    from millrace.operators.chunks import chunk_documents

    made = chunk_documents(ready.withColumnRenamed("filename", "doc_id").drop("word_count", "status"))
    records.write_chunks(made, f"{root}/c")
    back = records.read_chunks(spark, f"{root}/c").collect()
    assert back[0].id == "a.txt_forward_guidance_001" and back[0].metadata.speaker == "" and back[0].metadata.document_type == "MPR"
