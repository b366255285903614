"""The queries over pages against their SQL, on a small table of odd pages."""

import pytest

from millrace.jobs import catalog, registry  # noqa: F401

PAGE = '<html><head><title>t</title></head><body><nav><p>no</p></nav><article><h1>{h1}</h1><p>{p}</p><p><b>more words<br><p>and more</p></article></body></html>'


def same(spark, tmp_path, name, rows):
    import duckdb

    spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    got = registry.QUERIES[name](spark, str(tmp_path))
    r = con.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(map(repr, map(tuple, got.select(*names).collect()))) == sorted(map(repr, r.fetchall()))


def test_pages_that_share_an_address(spark, tmp_path):
    """One address for two pages of each kind is two rows, each with its own page's facts."""
    rows = [(i, f"https://x.org/a/b/{i % 4}", PAGE.format(h1=f"Page {i}", p="word " * (i + 1))) for i in range(8)]
    same(spark, tmp_path, "page_manifest", rows)


@pytest.mark.parametrize("name", ["speech_texts", "report_texts", "minutes_texts", "page_manifest"])
def test_references_without_an_end(spark, tmp_path, name):
    """Titles and paragraphs that break off in a reference, or hold one that the SQL doesn't know."""
    rows = [(i, f"https://x.org/a/b/{i}", PAGE.format(h1=f"R&amp;D&amp;{x}", p=f"costs &lt; 3 &amp;amp; 4{x}")) for i, x in enumerate(["&amp", "&am", "&lt", "&quot", "&", "&#38;", "&copy"], 1)]
    same(spark, tmp_path, name, rows)
