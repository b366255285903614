"""Pages of each kind, on inline HTML."""

from millrace.sources.site import extract, site_texts


def told(page, kind):
    return extract(page, kind)[0].split("\n\n")


def test_minutes():
    page = """<main><div class="page-content"><h2>Summary</h2></div><p>outside</p><div class="page-content"><h3>The outlook</h3><p>1: First.</p><ul><li><p>item one</p></li></ul>
    <p><strong>Votes to hold</strong></p><p><strong>Ann Baker:</strong> I <em>agree</em>.</p><p>open<p>next</div></main>"""
    assert told(page, "MPC_minutes") == ["## Summary", "### The outlook", "1: First.", "- item one", "**Votes to hold**", "**Ann Baker:** I agree.", "open", "next"]
    assert extract("<main></main>", "MPC_minutes")[-1] == "no content" and extract(None, "MPR")[0] is None


def test_report():
    page = """<div id="output"></div><main><div id="output"><h2>1: Economy</h2><ul><li><h3>in item</h3><p>point</p></li></ul><div class="img-block"><h3 class="img-title">Chart 1</h3><img></div>
    <div class="img-block"><h3 class="img-title">Table 1</h3><table><tr><th>a</th><th>b</th></tr><tr><td>1</td><td>2</td></tr></table></div>
    <div class="box-highlight"><h2>Box A</h2><p class="text-box-highlight">short</p><p>inside</p><ul><li><p>no</p></li></ul></div><p>after</p><nav class="nav-chapters"><p>no</p></nav></div></main>"""
    assert told(page, "MPR") == ["## 1: Economy", "- in item point", "[BOX START: Box A]", "[Summary: short]", "inside", "[BOX END]", "after", "[CHART: Chart 1]", "[TABLE: Table 1]\na | b\n1 | 2"]
    assert told(page, "FSR") == told(page, "MPR")


def test_speech():
    page = """<h1 itemprop="name">On rates</h1><div class="published-date">1
      May</div><div class="col3"><a class="med-block-cta"><h3>Professor Ann Baker</h3></a></div><div><div class="hero-paragraph"><span class="hero">In short.</span></div>
      <div id="output"><h1>Speech</h1><p>Text.</p><p>Source: someone</p><ul><li>(a) caption</li><li>kept</li></ul></div></div>"""
    text, title, speaker, published, error = extract(page, "speech")
    assert text.split("\n\n") == ["In short.", "## Speech", "Text.", "- kept"] and (title, speaker, published, error) == ("On rates", "Professor Ann Baker", "1 May", None)


def test_rows(spark):
    rows = [(1, '<div id="output"><p>a–b ﬁne footnote [3] x</p></div>', "MPR"), (2, None, "speech"), (3, "", "MPC_minutes")]
    got = {r.page_id: (r.text, r.error) for r in site_texts(spark.createDataFrame(rows, "page_id long, html string, document_type string")).collect()}
    assert got == {1: ("a-b fine x", None), 2: (None, "no content"), 3: (None, "no content")}


def test_floods_take_linear_time():
    """Runs of open, closed and mixed tags of some hundred kilobytes, each within seconds."""
    import time

    n = 40_000
    floods = ["<span>y" * n, "<b>" * n + "x", "<div>y" * n + "</p>" * n, "<p><li>" + "<span>y<p>" * n, "<table>" * 3000 + "<tr><td>z" * n, "<li>a" * n, "</div>" * n + "<p>q", "<ul><li>" * 20 + "<i>s</b>" * n]
    for flood in floods:
        began = time.time()
        extract(f'<div id="output"><p>start</p>{flood}', "speech")
        assert time.time() - began < 8, flood[:20]
    began = time.time()
    text = extract('<div id="output"><p>start</p>' + '<div class="img-block"><h3 class="img-title">T</h3><table><tr><td>c</td></tr></table></div>' * 8000, "MPR")[0]
    assert time.time() - began < 8 and text.count("[TABLE: T]") == 8000


def test_manifest_of_pages(spark):
    from millrace.sources.records import site_manifest

    page = '<h1 itemprop="name"> </h1><div class="col3"><a class="med-block-cta"><h3>Sir John A. Hill</h3></a></div><div id="output"><p>four words of text</p></div>'
    rows = spark.createDataFrame([(1, "https://x.org/a/b/c/", page, "speech", "2025-01"), (2, "https://x.org/a/b/d", "", "speech", "2025-02")], "page_id long, url string, html string, document_type string, date string")
    found, texts = site_manifest(rows)
    assert sorted((r.filename, r.title, r.word_count, r.status, r.speaker, r.error) for r in found.collect()) == [("a_b_c.txt", "a_b_c.txt", 4, "ok", "John Hill", None), ("a_b_d.txt", "a_b_d.txt", 0, "missing", None, "no content")]
    assert [tuple(r) for r in texts.collect()] == [("a_b_c.txt", "four words of text")]


def test_batches_of_pages_are_bounded(spark):
    """Whatever a session had set, pages and tables go to Python in batches of at most a thousand rows and four megabytes."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from millrace.jobs.registry import table

    def seen(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"rows": [len(b)], "bytes": [b.nbytes]})

    def largest():
        rows = spark.range(0, 3000, 1, 1).select("id", F.repeat(F.lit("x"), 8000).alias("html"))
        return tuple(rows.mapInArrow(seen, "rows long, bytes long").agg(F.max("rows"), F.max("bytes")).first())

    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": "10000", "spark.sql.execution.arrow.maxBytesPerBatch": "67108864b"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for use in (lambda: site_texts(spark.createDataFrame([(1, "", "MPR")], "page_id long, html string, document_type string")), lambda: table(spark, "/root/testdata/sf0.001", "pages")):
            for k, v in keys.items():
                spark.conf.set(k, v)
            use()
            rows, size = largest()
            assert rows <= 1000 and size < 5e6
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
