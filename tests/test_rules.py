"""Banned patterns against all patterns one by one, schemas against rows for each kind of violation."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from gristmill.operators import banned, schema

RUNS = [("abc.*def", "abc"), (r"(?i)PASS\s*=", "pa"), ("a|bcd", ""), ("x(abc)+y", "abc"), (r"\bfoo\b bar", "foo bar"), ("(?:abc)?d", "d"), ("[ab]cde", "cde"), ("ab*c", "c"), ("(ab){2,}c", "ab"), ("(?i)é12", "12"), ("", ""), ("a(?=bcd)", "a"), ("(?i:abc)d", "d")]


@pytest.mark.parametrize("pattern,want", RUNS)
def test_required_runs(pattern, want):
    got = banned.required_run(pattern)
    assert len(got) == len(want) and (got == want or pattern in ("ab*c", "x(abc)+y"))


def test_as_all_patterns_one_by_one(spark):
    r = random.Random(3)
    bits = ["foo", "Bar", "k9", "é", "ß", "İ", "σς", " ", ".", r"\d", "[a-c]+", "(?:qux)?", "(zap|zip)", "x{2,3}", r"\s", "K", "ſ"]
    made = {f"p{i:03d}": ("(?i)" if r.random() < 0.4 else "") + "".join(r.choice(bits) for _ in range(r.randint(1, 5))) for i in range(400)}
    words = ["foo", "FOO", "bar", "Bar", "k9", "K9", "é", "É", "ß", "ẞ", "İ", "i̇", "σ", "ς", "Σ", " ", ".", "7", "abc", "qux", "zap", "xx", "K", "K", "s", "ſ", "\n"]
    texts = ["".join(r.choice(words) for _ in range(r.randint(0, 30))) for _ in range(300)] + ["", None, "foo " * 50_000]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, body string").repartition(3)
    got = {x["i"]: x["banned"] for x in banned.with_banned(rows, list(made.items())).collect()}
    for i, t in enumerate(texts):
        assert got[i] == sorted(n for n, p in made.items() if re.search(p, t or "")), t
    assert banned.with_banned(rows.where("false"), list(made.items())).count() == 0
    assert banned.with_banned(rows, []).where("size(banned) > 0").count() == 0


def test_bad_packs():
    with pytest.raises(ValueError, match="regular"):
        banned.with_banned(None, [("a", "(")])
    with pytest.raises(ValueError, match="one id"):
        banned.with_banned(None, [("a", "x"), ("a", "y")])


GOOD = {"severity": "low", "title": "t", "path": "p"}
ANSWERS = [
    ("[]", []), ("null", []), ("3", ["$: is not of type array or null"]), ("junk", ["$: is not JSON"]), ("", ["$: is not JSON"]), (None, ["$: is not JSON"]), ("[] []", ["$: is not JSON"]), ("[]], [[]", ["$: is not JSON"]), ('[{"a": 1, "a": 2}]', ["$: is not JSON"]),
    ("[1, null]", ["$[0]: is not of type object", "$[1]: is not of type object"]), ([{}], ["$[0].severity: is missing", "$[0].title: is missing", "$[0].path: is missing"]), ([GOOD], []), ([GOOD, GOOD | {"other": {"severity": 1}}], []),
    ([GOOD | {"severity": "dire"}], ["$[0].severity: is not one of low, medium, high"]), ([GOOD | {"severity": None}], ["$[0].severity: is not one of low, medium, high"]), ([GOOD | {"severity": 1}], ["$[0].severity: is not one of low, medium, high"]),
    ([GOOD | {"title": "", "message": 1}], ["$[0].title: has fewer characters than 1", "$[0].message: is not of type string"]), ([GOOD | {"confidence": -0.5}], ["$[0].confidence: is less than 0"]), ([GOOD | {"confidence": 2}], ["$[0].confidence: is more than 1"]), ([GOOD | {"confidence": 1}], []),
    ([GOOD | {"startLine": 1.5}], ["$[0].startLine: is not of type integer"]), ([GOOD, GOOD | {"tags": ["a", 1, ["b"]]}], ["$[1].tags[1]: is not of type string", "$[1].tags[2]: is not of type string"]), ([GOOD | {"tags": {"a": "b"}}], ["$[0].tags: is not of type array"]), ([GOOD | {"startLine": True}], ["$[0].startLine: is not of type integer"]),
]


def test_answers_under_their_schema(spark):
    texts = [(i, t if t is None or isinstance(t, str) else json.dumps(t)) for i, (t, _) in enumerate(ANSWERS)]
    got = {r["i"]: r["v"] for r in spark.createDataFrame(texts, "i int, t string").select("i", schema.violations(F.col("t"), schema.ANSWER).alias("v")).collect()}
    for i, (t, want) in enumerate(ANSWERS):
        assert got[i] == want, t


OWN = '{"type": "object", "additionalProperties": false, "properties": {"a": {"pattern": "^x"}, "b": {"minItems": 1, "maxItems": 2, "items": {"maxLength": 2}}}}'


@pytest.mark.parametrize("text,want", [('{"a": "xy"}', []), ('{"a": "y", "z": 1, "c": 2}', ["$.a: does not match ^x", "$.c: is not known", "$.z: is not known"]), ('{"b": []}', ["$.b: has fewer elements than 1"]), ('{"b": ["abc", "d", "e"]}', ["$.b: has more elements than 2", "$.b[0]: has more characters than 2"])])
def test_other_words(spark, text, want):
    assert spark.range(1).select(schema.violations(F.lit(text), OWN).alias("v")).first()["v"] == want


def test_unknown_words_are_errors(spark):
    with pytest.raises(ValueError, match="oneOf"):
        schema.violations(F.lit("1"), {"oneOf": []})
