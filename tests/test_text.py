"""Column functions, on inline rows."""

import pytest
from pyspark.sql import functions as F

from millrace.functions import text as T


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("a b", "a b"), ("‘x’ “y”", "'x' \"y\""), ("1–2—3", "1-2 - 3"), ("done footnote [12] here", "done here"), ("done Footnote[3]", "done"), (None, None), ("", "")],
)
def test_normalise_text(spark, raw, want):
    assert one(spark, T.normalise_text(F.col("t")), t=raw) == want


@pytest.mark.parametrize(
    ("raw", "want"),
    [("Professor Ann Baker", "Ann Baker"), ("Cleo D. Evans", "Cleo Evans"), ("Dr. Fox", "Fox"), ("  ", ""), (None, ""), ("Mrs", ""), ("Dame Gia van Hall", "Gia Hall")],
)
def test_normalise_speaker(spark, raw, want):
    assert one(spark, T.normalise_speaker(F.col("t")), t=raw) == want


@pytest.mark.parametrize(
    ("heading", "section", "kind", "want"),
    [
        ("Anything", "vote", "MPR", "voting"), ("Anything", "member", "FSR", "individual_statement"), ("Box A", "box", "speech", "box_analysis"),
        ("The Outlook for inflation", "h2", "MPR", "forward_guidance"), ("Wage inflation and employment", "h2", "MPR", "labour_market"), ("Inflation", "h3", "MPR", "inflation"),
        ("Global vulnerabilities", "h2", "FSR", "risk_assessment"), ("Global bank resilience", "h2", "FSR", "financial_stability"), ("Other", "h2", "FSR", "financial_stability"),
        ("Where next?", "h2", "speech", "forward_guidance"), ("Thanks", "h2", "speech", "speech_main"), ("Inflation", "h2", "MPC_minutes", "policy_discussion"), (None, "text", "MPR", "policy_discussion"),
    ],
)
def test_category(spark, heading, section, kind, want):
    assert one(spark, T.category(F.col("h"), F.col("s"), F.col("k")), h=heading, s=section, k=kind) == want


def test_labels(spark):
    def at(f, x):
        return one(spark, f(F.col("t")), t=x)

    assert at(T.box_label, "Box A - Costs: more") == "Box A" and at(T.box_label, "- x") == "- x"
    assert at(T.chapter_label, "1: Economy") == "Ch.1" and at(T.chapter_label, "Economy") == ""
    assert at(T.subsection_label, "1.2 : Prices") == "s1.2" and at(T.subsection_label, "1: Prices") == ""
    assert at(T.month_label, "2025-11") == "November 2025" and at(T.month_number, "March") == "03" and at(T.month_number, "x") is None
    assert at(T.speaker_slug, "Ann Baker") == "baker" and at(T.speaker_slug, "") == "unknown"
    assert at(T.cache_name, "https://a.example/x/y/z/") == "x_y_z.html" and at(T.cache_name, "a/b") == "a_b.html"


@pytest.mark.parametrize(("raw", "want"), [("Yes.", True), (" yes ", True), ("YES!", True), ("yes it is", True), ("Yes, because", False), ("no", False), ("", False)])
def test_says_yes(spark, raw, want):
    assert one(spark, T.says_yes(F.col("t")), t=raw) is want


def test_keys(spark):
    import hashlib

    key = one(spark, T.cache_key(F.lit("a"), F.lit("b"), F.lit("c"), F.col("t")), t="q")
    assert key == hashlib.sha256(b"a|b|c|q").hexdigest()
    assert one(spark, T.row_key("t", "u"), t=" x ", u="y") == hashlib.sha256(b'{"t":"x","u":"y"}').hexdigest()
    assert one(spark, T.word_count(F.col("t")), t="a b\n c") == 3 and one(spark, T.word_count(F.col("t")), t=None) == 0
