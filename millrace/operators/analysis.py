"""What a question asks for, from a model's structured reply that may fail or be odd."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import HEADING_RULES, clean, normalise_speaker

# The fields of a reply, the values that two of them may have, and the form of a month.
FILTERS = ["document_type", "date", "section_category", "speaker"]
CATEGORIES = ["global_economy", "inflation", "labour_market", "demand_output", "policy_discussion", "voting", "individual_statement", "box_analysis", "risk_assessment", "financial_stability", "forward_guidance", "speech_main"]
MONTH = r"^\d{4}-(0[1-9]|1[0-2])$"


def with_filters(questions: DataFrame, reply: Column, types: list[str] | None = None) -> DataFrame:
    """``questions`` with the filters and out_of_corpus of a reply, a JSON object of these fields.

    Each field is taken by itself: a value that it can't have is none. A
    speaker is a first and a last name without titles. A question out of the
    corpus has no filters. A reply that is null or no object leaves none, and
    the question is in the corpus.
    """
    told = F.from_json(reply, "struct<document_type:string,date:string,section_category:string,speaker:string,out_of_corpus:string>", {"mode": "PERMISSIVE"})
    rows = questions.drop(*FILTERS, "out_of_corpus").withColumn("told_", told)
    outside = F.lower(F.trim("told_.out_of_corpus")).eqNullSafe("true")
    field = lambda c: clean(F.trim(f"told_.{c}"))
    values = {
        "document_type": F.when(field("document_type").isin(types if types is not None else list(HEADING_RULES)), field("document_type")),
        "date": F.when(field("date").rlike(MONTH), field("date")),
        "section_category": F.when(field("section_category").isin(CATEGORIES), field("section_category")),
        "speaker": clean(normalise_speaker(field("speaker"))),
    }
    return rows.select("*", *(F.when(~outside, v).alias(c) for c, v in values.items()), outside.alias("out_of_corpus")).drop("told_")


def analyser(model: Callable[[str], dict | str | None], types: list[str] | None = None) -> Callable[[DataFrame], DataFrame]:
    """``Models.analyse`` by a Python model that replies to a question with a dict or JSON; an exception is no reply."""

    @F.pandas_udf("string")
    def replies(questions: pd.Series) -> pd.Series:
        def one(question: str) -> str | None:
            try:
                said = model(question)
                return said if said is None or isinstance(said, str) else json.dumps(said)
            except Exception:
                return None

        return questions.map(one).astype("object")

    return lambda asked: with_filters(asked, replies.asNondeterministic()("question"), types)
