"""The pipeline's stages against plain versions, each on its own input."""

import numpy as np

import corpus_pipeline
from millrace.llm.common import materialise
from tests.llm.test_operators import SF, check_packing, classes, clashing, ends, odd, plain_leaks, plain_lines, rows_of


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    outs = []
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SF))
        outs.append(docs.collect())
    quality, lines, copies, clean, pieces = outs
    raw = {r["doc_id"]: r for r in rows_of("documents")}
    assert list(quality[0].asDict()) == columns and {r.doc_id for r in quality} <= set(raw) and all(r.n_chars == len(r.text) for r in quality)
    from millrace.llm.quality import quality as rules

    assert {r.doc_id for r in quality} == {r.doc_id for r in rules(spark.read.parquet(f"{SF}/documents.parquet")).filter("kept").collect()}
    left = plain_lines([r.text for r in quality], copies=False)
    changed = {r.doc_id: t for r, t in zip(quality, left, strict=True)}
    assert {r.doc_id: r.text for r in lines} == {d: t for d, t in changed.items() if t or not next(r for r in quality if r.doc_id == d).text}
    groups = classes([(r.doc_id, r.text) for r in lines])
    assert sorted(r.doc_id for r in copies) == sorted(d for d, c in groups if d == c) and list(copies[0].asDict()) == columns
    held = {d for d, _ in plain_leaks([(r.doc_id, r.text) for r in copies], [(r["item_id"], r["text"]) for r in rows_of("benchmark")])}
    assert {r.doc_id: r.text for r in clean} == {r.doc_id: r.text for r in copies if r.doc_id not in held}
    assert check_packing(pieces, {r.doc_id: x for r, x in zip(clean, ends([r.text for r in clean]), strict=True)}) < 0.05
    again = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.start, r.ids_crc32) for r in again) == sorted((r.doc_id, r.start, r.ids_crc32) for r in pieces)


def test_odd_rows(spark):
    docs = clashing(odd(spark), "kept", "clean_text", "class_id", "n_lines")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns or set(docs.columns) - set(out.columns) <= {"kept", "clean_text", "class_id", "n_lines"}
        docs = materialise(out)
    empty = odd(spark).filter("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0
    assert np.isfinite(docs.count())


def test_lines_of_copies(spark):
    passage = "a passage that is repeated"
    rows = [(k, f"{passage}\nown words of text {k % 2}", "en", "a", 0) for k in range(12)]
    rows += [(20 + k, "only copies of one text\nhold these two lines", "en", "a", 0) for k in range(12)]
    rows += [(40 + k, "Bare line" if k % 2 else "bare line", "en", "a", 0) for k in range(10)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, frame, SF).collect()}
    assert {d: t for d, t in got.items() if d >= 12} == {20 + k: rows[12 + k][1] for k in range(12)} and not any(d >= 40 for d in got)
    assert {d: t for d, t in got.items() if d < 12} == {k: f"own words of text {k % 2}" for k in range(12)}
