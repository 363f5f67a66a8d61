"""Objects in responses against json.loads and ast.literal_eval on generated cases."""

import ast
import json
import random
import time

import pytest
from pyspark.sql import functions as F

from quillet.functions.literals import first_object, parse_object
from quillet.operators import population


def value(rng, depth):
    kinds = ["text", "number", "word", "list", "dict", "tuple"][: 3 if depth > 2 else 6]
    kind = rng.choice(kinds)
    if kind == "text":
        return "".join(rng.choice(["a", " ", "None", "True", "{", "}", '"', "'", "\\", "é", ",", ":", "```"][: 8 if depth > 9 else 12]) for _ in range(rng.randint(0, 6)))
    if kind == "number":
        return rng.choice([0, -7, 3.5, 10**20])
    if kind == "word":
        return rng.choice([None, True, False])
    if kind == "dict":
        return {str(rng.randint(0, 9)): value(rng, depth + 1) for _ in range(rng.randint(0, 3))}
    items = [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return tuple(items) if kind == "tuple" else items


def plain(v):
    """Numbers compare by value, tuples as lists."""
    if isinstance(v, dict):
        return {str(k): plain(x) for k, x in v.items()}
    if isinstance(v, list | tuple):
        return [plain(x) for x in v]
    return float(v) if isinstance(v, int | float) and not isinstance(v, bool) or type(v).__name__ == "_Number" else v


def test_generated_objects():
    rng = random.Random(9)
    for n in range(1500):
        obj = {rng.choice(["res", "x y", "é"]) + str(i): value(rng, 0) for i in range(rng.randint(1, 4))}
        if n % 2:
            text = json.dumps(obj, ensure_ascii=bool(n % 4 == 1), indent=rng.choice([None, 2]))
            want = json.loads(text)
        else:
            text = repr(obj)
            text = text[:-1] + rng.choice(["", ",", " , "]) + "}"
            want = ast.literal_eval(text)
        assert plain(parse_object(text)) == plain(want)
        around = [text, f"```json\n{text}\n```" if "```" not in text else text, f"The answer: {text}. Done {{", f"It's {{}} this:\n{text}\n"]
        for t in around:
            got = first_object(t)
            assert got is not None
            if "{" not in text[1:] and "}" not in text[:-1]:
                assert plain(got) == plain(want)
        assert plain(first_object(text)) == plain(want) or "{" in text[1:]


CASES = [
    ("{'a': (1, 2)}", {"a": "[1,2]"}), ("{'a': 'b',}", {"a": "b"}), ("{1: 'x', None: 2}", {"1": "x", "None": "2"}), ("{'a': 'say None, ok: None, x'}", {"a": "say None, ok: None, x"}),
    ('{"a":NaN}', {"a": "NaN"}), ("{'a': None, 'b': True}", {"a": None, "b": "true"}), ('{"a": 1.50, "b": [1.0, {"c": null}]}', {"a": "1.50", "b": '[1.0,{"c":null}]'}), ("{}", None), ("[1]", None), ("", None), (None, None), ("no object", None),
    ('x {"a": "}"} y', {"a": "}"}), ('```\n{"a": 1}\n``` and {"b": 2}', {"a": "1"}), ('```json\n{bad}\n``` then {"b": 2}', {"b": "2"}), ("don't {'a': {'b': {'c': 1}}} won't", {"b": '{"c":1}'}), ("{ {'x': 1} {", {"x": "1"}), ('```JSON {"é": "ü"} ```', {"é": "ü"}),
    ('{"a": {"b": {"c": "}"}}}', {"a": '{"b":{"c":"}"}}'}), ("}} {'a': 'it''s'}", {"a": "its"}), ('{"a": {}, "a": "later"}', {"a": "later"}),
]


def test_cases(spark):
    d = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    got = {r.i: r.m for r in d.select("i", population.extract_json(F.col("t")).alias("m")).collect()}
    assert [got[i] for i in range(len(CASES))] == [w for _, w in CASES]


@pytest.mark.parametrize("text", ["{" * 300_000, "{'a': " * 50_000, "```" * 100_000 + "{", "``` {" * 50_000, "{\"'" * 100_000, "{x}" * 50_000, "``` " + "{ } " * 100_000, "{'a': [" + "1, " * 200_000 + "]", " " * 500_000 + "{", "{\"" + "\\" * 400_001])
def test_long_texts_take_linear_time(text):
    began = time.time()
    assert first_object(text) is None
    assert time.time() - began < 8
