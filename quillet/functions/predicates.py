"""Predicates of the form ``attr op literal`` or ``attr op attr``, as Columns.

A comparison with a number compares as numbers (a value that is none fails); with a quoted literal it compares as
text; ``contains`` tests for a part of the text. Several predicates joined by ``;`` or ``and`` must all hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORM = re.compile(r"\s*(?P<attr>[\w. ()]+?)\s*(?P<op>==|!=|>=|<=|>|<|\bcontains\b)\s*(?P<value>.+?)\s*$")
_OPS = {"==": "__eq__", "!=": "__ne__", ">=": "__ge__", "<=": "__le__", ">": "__gt__", "<": "__lt__"}


def _number(c: Column) -> Column:
    return c.cast("string").try_cast("double")


def predicate(expr: str, columns: Iterable[str] | None = None) -> Column:
    """Column of one predicate; null and values that can't be compared give false. ``columns``: names that a bare right side may mean."""
    m = _FORM.match(expr)
    if not m:
        raise ValueError(f"not a predicate: {expr!r}")
    left, op, value = F.col(f"`{m['attr'].strip()}`"), m["op"], m["value"].strip()
    quoted = value[:1] in "'\"" and value[-1:] == value[:1]
    text = value[1:-1] if quoted else value
    if op == "contains":
        found = F.contains(left.cast("string"), F.lit(text))
    elif quoted:
        found = getattr(left.cast("string"), _OPS[op])(F.lit(text))
    elif re.fullmatch(r"[+-]?\d+(\.\d+)?", value):
        found = getattr(_number(left), _OPS[op])(F.lit(float(value)))
    elif columns is None or value in set(columns):
        found = getattr(_number(left), _OPS[op])(_number(F.col(f"`{value}`")))
    else:
        found = getattr(left.cast("string"), _OPS[op])(F.lit(value))
    return F.coalesce(found, F.lit(False))


def conjunction(expr: str, columns: Iterable[str] | None = None) -> Column:
    out = F.lit(True)
    for part in re.split(r"\s*;\s*|\s+and\s+", expr):
        out = out & predicate(part, columns)
    return out
