"""Sections, merging, chunks and their checks, on small marked-up documents."""

from pyspark.sql import functions as F

from millrace.functions.text import word_count
from millrace.operators import checks, chunks, sections

DOC = "doc_id string, text string, document_type string, date string, title string, source_url string, speaker string"


def docs(spark, text, kind="MPC_minutes", speaker=None):
    return spark.createDataFrame([("d", text, kind, "2025-11", "T", "u", speaker)], DOC)


def parsed(spark, text):
    return sections.sections(docs(spark, text)).orderBy("seq").collect()


def test_marks_and_parents(spark):
    text = "before\n## One\nx\n### Two\n1: first\n3. third\n**Votes to hold**\n**Ann Baker:** We agree.\nmore\n## Next\ny"
    found = parsed(spark, text)
    assert [(s.section_type, s.heading, s.parent_h2, s.parent_h3) for s in found] == [
        ("text", "", "", ""), ("h2", "One", "", ""), ("h3", "Two", "One", ""), ("vote", "**Votes to hold**", "One", "Two"), ("member", "Ann Baker", "One", "Two"), ("h2", "Next", "", ""),
    ]
    assert found[2].paragraph_numbers == [1, 3] and found[4].speaker == "Ann Baker" and found[4].lines[-1] == "more"


def test_boxes_are_whole(spark):
    text = "## A\n[BOX START: Box A - x]\n## not a heading\n[BOX START: inner]\n1: no paragraph\n[BOX END]\nafter\n[BOX START: open]\nlast"
    found = parsed(spark, text)
    assert [(s.section_type, s.heading) for s in found] == [("h2", "A"), ("box", "Box A - x"), ("text", ""), ("box", "open")]
    assert len(found[1].lines) == 5 and found[1].paragraph_numbers == [] and found[2].parent_h2 == "A" and found[3].lines == ["[BOX START: open]", "last"]


def test_no_text(spark):
    assert parsed(spark, None) == [] and parsed(spark, " \n\n") == []


def test_merge_is_a_fold(spark):
    """Small neighbours join until they are large together."""
    body = lambda n: " ".join(["w"] * n)
    text = f"### a\n{body(60)}\n### b\n{body(60)}\n### c\n{body(60)}\n### d\n{body(60)}"
    found = sections.merged(sections.categorised(sections.sections(docs(spark, text)), F.lit("MPC_minutes"))).orderBy("seq").collect()
    assert [s.heading for s in found] == ["a", "d"] and found[0].tokens == 186


def test_votes_do_not_merge(spark):
    found = sections.merged(sections.categorised(sections.sections(docs(spark, "**Votes to a**\n**Votes to b**")), F.lit("MPC_minutes"))).collect()
    assert len(found) == 2


def test_chunk_ids_and_ranges(spark):
    long = " ".join(["word"] * 20)
    text = f"### Talk\n2: {long}\n4: {long}\n**Votes to hold**\n**Cleo D Evans:** I agree.\n### Tiny\nx"
    found = chunks.chunk_documents(docs(spark, text)).orderBy("chunk_no").collect()
    assert [(c.chunk_id, c.paragraph_range, c.speaker) for c in found] == [
        ("d_policy_discussion_001", "2-4", None), ("d_voting_002", "Vote", None), ("d_individual_statement_003", "Cleo D Evans", "Cleo Evans"),
    ]


def test_report_and_speech(spark):
    long = " ".join(["word"] * 30)
    report = f"## 1: Economy\n### 1.1: Inflation\n{long}\n[BOX START: Box A - Costs]\n{long}\n[BOX END]"
    found = chunks.chunk_documents(docs(spark, report, "MPR")).orderBy("chunk_no").collect()
    assert [(c.section_category, c.paragraph_range) for c in found] == [("inflation", "Ch.1 s1.1"), ("box_analysis", "Box A")]
    found = chunks.chunk_documents(docs(spark, f"## Speech\n{long}\n### Outlook\n{long}", "speech", "Ann Baker")).orderBy("chunk_no").collect()
    assert [(c.paragraph_range, c.speaker, c.section_category) for c in found] == [("1", "Ann Baker", "speech_main"), ("2", "Ann Baker", "forward_guidance")]


def test_oversized(spark):
    part = " ".join(["p"] * 160)
    text = "## Outlook\n" + "\n\n".join([part] * 13)
    found = chunks.chunk_documents(docs(spark, text, "MPR")).orderBy("chunk_no").collect()
    assert len(found) == 2 and all(c.token_count <= 1200 for c in found) and found[1].paragraph_range == "pt2" or found[1].paragraph_range == "Outlook"
    assert found[1].text.split("\n\n")[0] == " ".join(["p"] * 50)
    found = chunks.chunk_documents(docs(spark, "## Outlook\n" + " ".join(["w"] * 1600), "MPR")).collect()
    assert len(found) == 2 and max(c.token_count for c in found) <= 1200
    box = "[BOX START: Box B]\n" + "\n\n".join([part] * 15) + "\n[BOX END]"
    found = chunks.chunk_documents(docs(spark, box, "MPR")).orderBy("chunk_no").collect()
    assert len(found) == 3 and all(c.text.startswith("[BOX START: Box B]") and c.token_count <= 1200 for c in found)
    kept = chunks.chunk_documents(docs(spark, "[BOX START: Box B]\n" + "\n\n".join([part] * 9) + "\n[BOX END]", "MPR")).collect()
    assert len(kept) == 1


def test_sizes_in_tokens(spark):
    """Oversized sections and boxes by tokens of a vocabulary: limits, leads, marks, and every word once beside the leads."""
    import public_tokenizers
    from tokenizers import Tokenizer

    vocabulary = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(vocabulary)
    size = lambda x: len(library.encode(x, add_special_tokens=False).ids)
    part = lambda k, n: " ".join(f"antidisestablished{k}x{j}" for j in range(n))
    body = "\n\n".join([part(1, 60), part(2, 60), part(3, 400), part(4, 20)])
    found = chunks.chunk_documents(docs(spark, f"## Outlook\n{body}", "MPR"), vocabulary).orderBy("chunk_no").collect()
    assert len(found) > 4 and all(c.token_count == size(c.text) <= 1200 for c in found)
    assert " ".join(c.text[c.lead :] for c in found).split() == f"## Outlook\n{body}".split()
    for before, after in zip(found, found[1:], strict=False):
        lead = after.text[: after.lead].removesuffix("\n\n")
        assert before.text.endswith(lead) and 40 <= size(lead) <= 51
    box = chunks.chunk_documents(docs(spark, f"[BOX START: Box B]\n{body}\n[BOX END]", "MPR"), vocabulary).orderBy("chunk_no").collect()
    mark = "[BOX START: Box B] (continued)\n\n"
    assert len(box) > 4 and all(c.text.startswith(mark) and c.lead == len(mark) for c in box[1:]) and box[0].lead == 0
    whole = chunks.chunk_documents(docs(spark, f"[BOX START: Box B]\n{part(1, 260)}\n[BOX END]", "MPR"), vocabulary).collect()
    assert len(whole) == 1 and 1200 < whole[0].token_count <= 2000
    assert checks.document_checks(chunks.chunk_documents(docs(spark, f"## Outlook\n{body}", "MPR"), vocabulary), docs(spark, f"## Outlook\n{body}", "MPR"), vocabulary).filter("check = 'max_size'").first()["status"] == "pass"
    assert chunks.chunk_documents(docs(spark, None, "MPR"), vocabulary).count() == 0


def test_pack(spark):
    units = F.split(F.col("t"), "/")
    row = spark.createDataFrame([("a b/c/d e f g h/i/",)], "t string")
    assert row.select(chunks.pack(units, word_count, 3, "+").alias("x")).first().x == ["a b+c", "d e f g h", "i+"]
    assert row.select(chunks.pack(units, word_count, 100, "+", 2).alias("x")).first().x == ["a b+c", "d e f g h+i", ""]
    assert row.select(chunks.word_slices(F.lit("a b c d e"), 2).alias("x")).first().x == ["a b", "c d", "e"]


def test_baseline(spark):
    lines = "\n".join([" ".join(["w"] * 300), " ".join(["w"] * 300), " ".join(["v"] * 1100)])
    found = chunks.baseline_chunks(docs(spark, lines)).orderBy("chunk_no").collect()
    assert [c.token_count for c in found] == [300, 300, 500, 500, 100] and found[0].chunk_id == "baseline_d_001"
    assert chunks.baseline_chunks(docs(spark, "")).count() == 0


def test_checks(spark):
    long = " ".join(["word"] * 20)
    source = docs(spark, f"### Talk\n{long}\n**Ann Baker:** We agree with this proposal for now and later.")
    status = {r.check: r.status for r in checks.document_checks(chunks.chunk_documents(source), source).collect()}
    assert status["chunk_count"] == "fail" and status["required_categories"] == "warn" and status["max_size"] == "pass" and status["required_fields"] == "pass" and status["median_size"] == "warn"
    with_votes = docs(spark, "**Votes to hold**")
    none = chunks.chunk_documents(with_votes).filter("false")
    status = {r.check: r.status for r in checks.document_checks(none, with_votes).collect()}
    assert status["chunk_count"] == "fail" and status["required_categories"] == "fail" and status["median_size"] == "fail"
    assert not checks.report(checks.document_checks(none, with_votes)).first().passed
    own = chunks.chunk_documents(source)
    assert {r.check: r.status for r in checks.corpus_checks(own, chunks.baseline_chunks(source)).collect()}["unique_chunk_ids"] == "pass"
    assert {r.check: r.status for r in checks.corpus_checks(own, own).collect()}["unique_chunk_ids"] == "fail"
