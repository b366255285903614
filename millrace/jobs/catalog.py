"""Importing this module fills the register."""

from millrace.jobs import answers, collections, comparisons, documents, runs  # noqa: F401
