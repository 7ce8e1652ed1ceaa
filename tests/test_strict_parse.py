"""The grammar of patterns, and what a strict parse finds in bundles."""

import json

import pytest

from lodestone.functions.pattern import comparisons_of
from lodestone.operators import validate

GOOD = [
    "[a:b = 'c']", "[file:hashes.'SHA-256' = 'x'] AND [url:value LIKE '%a%']", "[ipv4-addr:value IN ('1.2.3.4', '5.6.7.8') OR (a:b[*].c[0] NOT = 3 AND NOT a:d < 2.5)]", "([a:b = 1] FOLLOWEDBY [c:d != true]) WITHIN 5.5 SECONDS REPEATS 2 TIMES",
    "[EXISTS a:b]", "[a:b = t'2020-01-01T00:00:00Z'] START t'2020-01-01T00:00:00Z' STOP t'2020-01-02T00:00:00.5Z'", "[a:b = 'it\\'s \\\\ fine']", "[a:b MATCHES '^x$' AND a:c ISSUBSET '10.0.0.0/8']", "[x:y = h'ab01' OR x:y = b'YWI=']", "[ a:b='' ]",
]
BAD = ["", "garbage [", "[a:b = 'c'", "[a:b 'c']", "[a = 'c']", "[a:b = c]", "[a:b = 'x''y']", "[a:b = 'c'] AND", "[a:b > true]", "[a:b IN ()]", "[a:b = 1] WITHIN 0 SECONDS", "[a:b = 1] REPEATS 1.5 TIMES", "[a:b LIKE 3]", "[a:b = 'c'] START t'2020-01-02T00:00:00Z' STOP t'2020-01-01T00:00:00Z'", "[a:b = 'c']]", "(" * 500 + "[a:b = 1]" + ")" * 500, "[a:b = 'c\\d']", "[a:b == 1e5]", "[a:b = 'c'] within 5 seconds"]


@pytest.mark.parametrize("text", GOOD)
def test_patterns(text):
    assert comparisons_of(text)


@pytest.mark.parametrize("text", BAD)
def test_what_is_no_pattern(text):
    assert comparisons_of(text) is None


def test_comparisons_of_both_readers():
    assert comparisons_of("[file:hashes.'SHA-1' = 'b']") == [("file", "hashes.SHA-1", False, "=", "b")] == comparisons_of("[ file:hashes.'SHA-1' = 'b' ]")
    assert comparisons_of("[NOT a:b[2].c IN ('x', 3)]") == [("a", "b[2].c", True, "IN", "x,3")]


U = "8e2e2d2b-17d4-4cbf-938f-98ee46b3cd3f"
T = "2020-01-01T00:00:00.000Z"


def indicator(**changes):
    o = {"type": "indicator", "spec_version": "2.1", "id": f"indicator--{U}", "created": T, "modified": T, "valid_from": T, "pattern": "[a:b = 'c']", "pattern_type": "stix"} | changes
    return {k: v for k, v in o.items() if v != "-"}


CASES = [
    ({}, set()), ({"confidence": 50, "labels": ["x"], "revoked": False, "valid_until": "2021-01-01T00:00:00Z"}, set()), ({"confidence": "high"}, {("confidence", "bad_value")}), ({"confidence": 101}, {("confidence", "bad_value")}), ({"confidence": True}, {("confidence", "bad_value")}),
    ({"id": "x"}, {("id", "bad_value")}), ({"id": "indicator--zz"}, {("id", "bad_value")}), ({"id": f"report--{U}"}, {("id", "bad_value")}), ({"id": 5}, {("id", "bad_value")}), ({"valid_from": "t"}, {("valid_from", "bad_value")}), ({"valid_from": "2020-02-30T00:00:00Z"}, {("valid_from", "bad_value")}),
    ({"valid_from": None}, {("valid_from", "bad_value")}), ({"pattern": "garbage ["}, {("pattern", "bad_pattern")}), ({"pattern": "anything", "pattern_type": "snort"}, set()), ({"pattern": "-"}, {("pattern", "missing")}), ({"valid_until": T}, {("valid_until", "bad_order")}),
    ({"modified": "2019-01-01T00:00:00Z"}, {("modified", "bad_order")}), ({"x_own": 1}, {("x_own", "unknown_field")}), ({"type": "mutex"}, {("type", "unknown_type")}), ({"type": ["indicator"]}, {("type", "unknown_type")}), ({"labels": []}, {("labels", "bad_value")}), ({"labels": "x"}, {("labels", "bad_value")}),
    ({"kill_chain_phases": [{"phase_name": "x"}]}, {("kill_chain_phases", "bad_value")}), ({"external_references": [{"source_name": "x"}]}, {("external_references", "bad_value")}), ({"created_by_ref": "identity--1"}, {("created_by_ref", "bad_value")}), ({"spec_version": "2.0"}, {("spec_version", "bad_value")}),
]


def test_values_of_objects():
    known = validate._kinds()
    for changes, want in CASES:
        assert set(validate.object_problems(indicator(**changes), known)) == want, changes
    report = {"type": "report", "spec_version": "2.1", "id": f"report--{U}", "created": T, "modified": T, "published": T, "name": "n", "object_refs": "no"}
    assert list(validate.object_problems(report, known)) == [("object_refs", "bad_value")]
    relationship = {"type": "relationship", "spec_version": "2.1", "id": f"relationship--{U}", "created": T, "modified": T, "relationship_type": "indicates", "source_ref": f"indicator--{U}", "target_ref": "malware"}
    assert list(validate.object_problems(relationship, known)) == [("target_ref", "bad_value")]


def test_bundles(spark):
    whole = {"type": "bundle", "id": f"bundle--{U}", "objects": [indicator()]}
    texts = [json.dumps(whole), None, "", "[]", "null", "{" * 5000, json.dumps(whole | {"x": 1}), json.dumps(whole | {"id": "bundle--1"}), json.dumps(whole | {"objects": [1]}), json.dumps(whole)[:-1] + ',"type":"bundle"}', json.dumps(whole | {"objects": []}), json.dumps(whole | {"objects": [indicator(confidence=-1), indicator(pattern="[")]})]
    df = spark.createDataFrame([(i, f"b{i}", t) for i, t in enumerate(texts)], "doc_id long, bundle_id string, bundle_json string")
    got = sorted((r.doc_id, r.problem) for r in validate.parse_problems(df).collect())
    assert got == [(i, "no_bundle") for i in range(1, 10)] + [(11, "bad_pattern"), (11, "bad_value")]
    assert sorted(r.doc_id for r in validate.strict_parse(df).collect()) == [*range(1, 10), 11]
