"""The two vocabularies of missing values: one for populated values, one for evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for a missing value, lower case.
NONE_WORDS = ("", "none", "null", "nan", "na", "n/a", "nil", "undefined", "empty", "<null>", "<none>", "<na>", "<nan>")
NULL_WORDS = ("", "null", "none", "nan", "undisclosed", "unspecified", "unknown", "n/a", "na", "n.a.", "na.", "n/a.", "not available", "not applicable")


def stripped(c: Column) -> Column:
    """Text without white space at its ends, in lower case."""
    return F.lower(F.regexp_replace(c.cast("string"), r"^\s+|\s+$", ""))


def is_none_value(c: Column) -> Column:
    """Whether a populated value is missing."""
    return c.isNull() | stripped(c).isin(*NONE_WORDS)


def is_null(c: Column) -> Column:
    """Whether a value is missing for evaluation."""
    return c.isNull() | stripped(c).isin(*NULL_WORDS)
