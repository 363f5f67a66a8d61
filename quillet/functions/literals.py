"""Objects in raw model responses: JSON or Python literals, fenced or in the middle of prose.

Every text is scanned a constant number of times. Fences are found by search; objects by one pass over the braces with a
stack of open places. Those with at most one level of objects inside come first, whatever quotes stand around their braces;
where none of them nor the whole text is an object, a second pass that knows strings finds objects of any depth.
"""

from __future__ import annotations

import ast
import json
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

FENCE = "```"
_JSON_FENCE = re.compile(r"```json", re.IGNORECASE)
_BRACE = re.compile(r"[{}]")
_STOP = re.compile(r"[{}\"']")
_STRING = {'"': re.compile(r'"(?:[^"\\]|\\.)*+"', re.DOTALL), "'": re.compile(r"'(?:[^'\\]|\\.)*+'", re.DOTALL)}


class _Number(str):
    """A number as it is written."""


def parse_object(text: str) -> dict | None:
    """The non-empty object that the whole text is, as JSON or else as a Python literal."""
    if not text.startswith("{"):
        return None
    try:
        found = json.loads(text, parse_int=_Number, parse_float=_Number)
    except (ValueError, RecursionError):
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                found = ast.literal_eval(text)
        except (ValueError, SyntaxError, TypeError, RecursionError, MemoryError):
            return None
    return found if isinstance(found, dict) and found else None


def _flat_objects(text: str) -> list[str]:
    """Objects with at most one level of objects inside that are in no other such object, in order."""
    open_, found = [], []
    for m in _BRACE.finditer(text):
        if m[0] == "{":
            open_.append([m.start(), 0])
        elif open_:
            start, depth = open_.pop()
            if open_:
                open_[-1][1] = max(open_[-1][1], depth + 1)
            if depth <= 1:
                while found and found[-1][0] > start:
                    found.pop()
                found.append((start, m.end()))
    return [text[a:b] for a, b in found]


def _whole_objects(text: str) -> Iterator[str]:
    """Outermost objects, braces inside strings left alone; a quote that nothing closes is an ordinary character."""
    at, depth, start, closes = 0, 0, 0, {'"': True, "'": True}
    while m := _STOP.search(text, at):
        at, c = m.end(), m[0]
        if c == "{":
            start = m.start() if not depth else start
            depth += 1
        elif c == "}":
            if depth == 1:
                yield text[start:at]
            depth = max(depth - 1, 0)
        elif depth and closes[c]:
            s = _STRING[c].match(text, m.start())
            closes[c] = s is not None
            at = s.end() if s else at


def _fenced(text: str) -> Iterator[str]:
    m = _JSON_FENCE.search(text)
    if m and (end := text.find(FENCE, m.end())) >= 0:
        yield text[m.end() : end].strip()
    start = text.find(FENCE)
    while start >= 0:
        body = text[start + 3 :].lstrip() if text[start + 3 : start + 4].isspace() else text[start + 3 :]
        if body.startswith("{"):
            end = body.find(FENCE)
            while end >= 0:
                inside = body[:end].rstrip()
                if inside.endswith("}"):
                    yield inside
                    return
                end = body.find(FENCE, end + 1)
            return
        start = text.find(FENCE, start + 1)


def first_object(text: str | None) -> dict | None:
    """First non-empty object: a fenced JSON block, a fenced object, an object in the text, the whole text."""
    if not text or "{" not in text:
        return None
    if FENCE in text:
        for part in _fenced(text):
            if found := parse_object(part):
                return found
    for part in _flat_objects(text):
        if found := parse_object(part):
            return found
    whole = text.strip()
    return parse_object(whole) or next((found for part in _whole_objects(text) if part != whole and (found := parse_object(part))), None)


def _json(v: object) -> str:
    if isinstance(v, dict):
        return "{" + ",".join(f"{json.dumps(_text(k) or 'null', ensure_ascii=False)}:{_json(x)}" for k, x in v.items()) + "}"
    if isinstance(v, list | tuple | set | frozenset):
        return "[" + ",".join(_json(x) for x in v) + "]"
    return json.dumps(v, ensure_ascii=False) if isinstance(v, str) and not isinstance(v, _Number) else _text(v) or "null"


def _text(v: object) -> str | None:
    """A value as text: strings and numbers as they are, true, false, null, and inner values as JSON."""
    if v is None or isinstance(v, str):
        return v if v is None else str(v)
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, dict | list | tuple | set | frozenset):
        return _json(v)
    return "NaN" if v != v else str(v)


def _map(text: str | None) -> list[tuple[str, str | None]] | None:
    found = first_object(text)
    if found is None:
        return None
    try:
        return list({str(_text(k)): _text(v) for k, v in found.items()}.items())
    except RecursionError:
        return None


def object_map(raw: Column) -> Column:
    """``first_object`` of each text as a map of texts, in Arrow batches; null where there is none."""

    @F.arrow_udf("map<string,string>")
    def extracted_object(texts: pa.Array) -> pa.Array:
        return pa.array([_map(t) for t in texts.to_pylist()], pa.map_(pa.string(), pa.string()))

    return extracted_object(raw)
