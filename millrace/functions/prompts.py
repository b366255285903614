"""Prompts of the pipelines as column functions: templates whose places take columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

TEMPLATES = {
    "answer_plainly": "Use the passages below to answer. If they do not hold the answer, say so.\n\nPassages:\n{context}\n\nQuestion: {question}\nAnswer:",
    "analyse": "Name the document type, month, section and speaker that this question asks for, and leave out what it does not name. Say whether these documents can answer it at all.\n\nQuestion: {question}",
    "grade": "Does this passage help to answer the question? Reply yes or no.\n\nQuestion: {question}\n\nPassage:\n{passage}",
    "rewrite": "No passage was found for this question. Say it again in other words that such documents would use, in one line.\n\nQuestion: {question}",
    "answer": "Answer from the passages below only, and name the one that each statement comes from.\n\nPassages:\n{context}\n\nQuestion: {question}\nAnswer:",
    "answer_strictly": "An answer to this question was not borne out by its passages. Answer again with nothing but what the passages say word for word; leave out all else.\n\nPassages:\n{context}\n\nQuestion: {question}\nAnswer:",
    "check": "Is every statement of the answer borne out by the passages? Reply yes or no.\n\nPassages:\n{context}\n\nAnswer:\n{answer}",
}


def prompt(name: str, **places: Column) -> Column:
    """A template with columns in its places; a null is left empty. Braces in a column's text are text."""
    parts = re.split(r"\{(\w+)\}", TEMPLATES[name])
    lacking = set(parts[1::2]) ^ set(places)
    if lacking:
        raise ValueError(f"places that {name} and the call don't share: {sorted(lacking)}")
    return F.concat(*(F.lit(x) if k % 2 == 0 else F.coalesce(places[x], F.lit("")) for k, x in enumerate(parts)))
