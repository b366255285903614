"""Column functions over document text: normalisation, names, labels, categories, keys."""

from __future__ import annotations

import unicodedata
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Titles that names are compared without.
HONORIFICS = ["professor", "prof", "dr", "doctor", "mr", "mrs", "ms", "sir", "dame"]

# The first key that a heading contains gives its category.
HEADING_RULES = {
    "MPR": [
        ("outlook", "forward_guidance"), ("projection", "forward_guidance"), ("scenario", "forward_guidance"), ("judgement", "forward_guidance"), ("risks", "forward_guidance"),
        ("labour", "labour_market"), ("employment", "labour_market"), ("unemployment", "labour_market"),
        ("inflation", "inflation"),
        ("global", "global_economy"), ("international", "global_economy"), ("world", "global_economy"), ("external", "global_economy"),
        ("activity", "demand_output"), ("demand", "demand_output"), ("consumption", "demand_output"), ("gdp", "demand_output"), ("household", "demand_output"),
    ],
    "FSR": [
        ("household", "financial_stability"), ("corporate", "financial_stability"), ("bank", "financial_stability"), ("stress test", "financial_stability"),
        ("resilience", "financial_stability"), ("capital", "financial_stability"), ("market-based", "financial_stability"), ("structural change", "financial_stability"),
        ("global", "risk_assessment"), ("financial market", "risk_assessment"), ("risk environment", "risk_assessment"), ("vulnerabilit", "risk_assessment"),
    ],
    "speech": [("outlook", "forward_guidance"), ("scenario", "forward_guidance"), ("where next", "forward_guidance"), ("forward", "forward_guidance")],
    "MPC_minutes": [],
}
HEADING_DEFAULTS = {"MPR": "policy_discussion", "FSR": "financial_stability", "speech": "speech_main", "MPC_minutes": "policy_discussion"}
STRUCTURE_CATEGORIES = {"vote": "voting", "member": "individual_statement", "box": "box_analysis"}
ABSTAIN = "I cannot answer this question from the available documents."
NOTHING_FOUND = "No relevant documents found."
CONTEXT_BREAK = "\n\n---\n\n"
PREVIEW = 200


def words(text: Column) -> Column:
    """The words of a text between Unicode white space; null for null."""
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def word_count(text: Column) -> Column:
    return F.size(words(F.coalesce(text, F.lit("")))).cast("long")


@F.arrow_udf(StringType())
def compatible(text: pa.Array) -> pa.Array:
    """A text in its compatible composed form (NFKC), a batch at a time."""
    form = lambda x: x if x is None or x.isascii() or unicodedata.is_normalized("NFKC", x) else unicodedata.normalize("NFKC", x)
    return pa.array(map(form, text.to_pylist()), pa.string())


def normalise_text(text: Column) -> Column:
    """Plain quotes, dashes and spaces, no inline footnote marks, and characters in their compatible form."""
    plain = F.translate(text, "\u00a0‘’“”–", " ''\"\"-")
    plain = F.replace(plain, F.lit("—"), F.lit(" - "))
    plain = F.regexp_replace(plain, r"(?i)\s*footnote\s*\[\d+\]", "")
    return compatible(plain)


def normalise_speaker(name: Column) -> Column:
    """First and last name without titles and initials; empty for none."""
    parts = F.filter(words(F.replace(F.coalesce(name, F.lit("")), F.lit("."), F.lit(""))), lambda p: ~F.lower(p).isin(HONORIFICS))
    return F.when(F.size(parts) == 0, "").when(F.size(parts) == 1, F.get(parts, F.lit(0))).otherwise(F.concat_ws(" ", F.get(parts, F.lit(0)), F.element_at(parts, -1)))


def category(heading: Column, section_type: Column, document_type: Column) -> Column:
    """A section's category: by its structure, else by its heading under its document type's rules, else that type's default."""
    lowered = F.lower(F.coalesce(heading, F.lit("")))

    def by_heading(kind: str) -> Column:
        return reduce(lambda rest, rule: F.when(F.contains(lowered, F.lit(rule[0])), rule[1]).otherwise(rest), reversed(HEADING_RULES[kind]), F.lit(HEADING_DEFAULTS[kind]))

    found = reduce(lambda rest, kind: F.when(document_type == kind, by_heading(kind)).otherwise(rest), HEADING_RULES, F.lit(None).cast("string"))
    return reduce(lambda rest, x: F.when(section_type == x[0], x[1]).otherwise(rest), STRUCTURE_CATEGORIES.items(), found)


def month_label(month: Column) -> Column:
    """``2025-11`` as ``November 2025``."""
    return F.date_format(F.to_date(F.concat(month, F.lit("-01"))), "MMMM yyyy")


def month_number(name: Column) -> Column:
    months = "january february march april may june july august september october november december".split()
    at = F.array_position(F.array(*map(F.lit, months)), F.lower(name))
    return F.when(at > 0, F.lpad(at.cast("string"), 2, "0"))


def speaker_slug(name: Column) -> Column:
    """The lower-case last name, ``unknown`` if there is none."""
    parts = words(F.coalesce(name, F.lit("")))
    return F.when(F.size(parts) == 0, "unknown").otherwise(F.lower(F.element_at(parts, -1)))


def box_label(heading: Column) -> Column:
    head = F.trim(F.split_part(F.split_part(heading, F.lit(":"), F.lit(1)), F.lit("-"), F.lit(1)))
    return F.when(head == "", heading).otherwise(head)


def chapter_label(heading: Column) -> Column:
    number = F.regexp_extract(heading, r"^(\d+)\s*:", 1)
    return F.when(number == "", "").otherwise(F.concat(F.lit("Ch."), number))


def subsection_label(heading: Column) -> Column:
    number = F.regexp_extract(heading, r"^(\d+\.\d+)\s*:", 1)
    return F.when(number == "", "").otherwise(F.concat(F.lit("s"), number))


def similarity(distance: Column) -> Column:
    return F.round(1 - distance, 4)


def says_yes(answer: Column) -> Column:
    """Whether a model's reply is a plain yes."""
    plain = F.regexp_replace(F.lower(F.trim(answer)), "[.!?,]+$", "")
    return (plain == "yes") | plain.startswith("yes ")


def is_abstain(answer: Column) -> Column:
    return F.trim(answer) == ABSTAIN


def context(texts: Column) -> Column:
    return F.array_join(texts, CONTEXT_BREAK)


def preview(text: Column) -> Column:
    return F.substring(text, 1, PREVIEW)


def cache_key(pipeline: Column, model: Column, version: Column, question: Column) -> Column:
    return F.sha2(F.concat_ws("|", pipeline, model, version, question), 256)


def cache_name(url: Column) -> Column:
    """The file name of a page: the last three parts of its address."""
    parts = F.split(F.rtrim(url, F.lit("/")), "/")
    return F.concat(F.array_join(F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), F.lit(3)), "_"), F.lit(".html"))


def row_key(*columns: str) -> Column:
    """SHA-256 of a row's trimmed values as JSON, keys in order."""
    return F.sha2(F.to_json(F.struct(*[F.trim(F.col(c).cast("string")).alias(c) for c in sorted(columns)])), 256)


def clean(value: Column) -> Column:
    """A filter value; an empty one is none."""
    return F.when(value != "", value)
