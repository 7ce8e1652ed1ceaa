"""Trees of digests, units of work, exports and sketches."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import ingest, score, segments
from lodestone.sources import tables, writers

ROWS = "chain string, id long, a string, b int"


def test_any_change_is_found_and_little_is_read(spark):
    rng = random.Random(11)
    rows = [(c, i, f"v{rng.random()}", i % 7 or None) for c in ("x", "y", None) for i in range(-20, 700)]
    left = spark.createDataFrame(rows, ROWS)
    changed = {("x", 5): ("x", 5, "new", 5), ("y", -20): ("y", -20, None, -20 % 7), (None, 699): None, ("x", 350): ("x", 350, rows[370][2], None if rows[370][3] else 1)}
    right_rows = [changed.get(r[:2], r) for r in rows if changed.get(r[:2], r)] + [("x", 2000, "more", 1), ("new", 1, "", 1)]
    right = spark.createDataFrame(right_rows, ROWS)
    want = {("x", 5, "replace"), ("y", -20, "replace"), (None, 699, "remove"), ("x", 350, "replace"), ("x", 2000, "add"), ("new", 1, "add")}
    assert {tuple(r) for r in segments.differences(left, right, ["a", "b"], 8, 4).collect()} == want
    trees = [segments.tree(x, ["a", "b"], 8, 4) for x in (left, right)]
    leaves, read = segments.unequal(*trees, 4)
    assert leaves.count() == 6 and read < trees[0].count() / 3
    assert {tuple(r) for r in segments.differences(left, right, ["a", "b"], 8, 4, tuple(trees)).collect()} == want
    same, read = segments.unequal(trees[0], segments.tree(left.orderBy(F.rand(1)), ["a", "b"], 8, 4), 4)
    assert same.count() == 0 and read <= 6  # the roots alone
    assert segments.differences(left.limit(0), left.limit(0), ["a", "b"]).count() == 0


def test_appends_touch_new_segments_alone(spark):
    rows = [("x", i, f"v{i}", i) for i in range(100)]
    stored = segments.tree(spark.createDataFrame(rows[:70], ROWS), ["a", "b"], 8, 4)
    batch = lambda r: segments.appended(stored, spark.createDataFrame(r, ROWS), ["a", "b"], 8)
    good, bad = batch(rows[64:])
    assert sorted(r.node for r in good.collect()) == [8, 9, 10, 11, 12] and bad.count() == 0
    assert [r.node for r in batch([("x", 3, "changed", 3), *rows[64:]])[1].collect()] == [0]
    assert [r.node for r in batch([*rows[64:69], ("x", 69, "changed", 69)])[1].collect()] == [8]


def test_units_of_work(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS units")
    tables.create(spark, "units")
    rows = lambda *ids: spark.createDataFrame([(str(i), f"sha{i}") for i in ids], "id string, sha256 string")
    held = lambda: sorted(r.id for r in spark.table("units.documents").collect())
    with tables.Unit(spark, "one", "units") as unit:
        unit.stage(rows(1, 2), "documents")
        unit.stage(spark.createDataFrame([("c1", "1")], "id string, document_id string"), "chunks")
        assert held() == []
    assert held() == ["1", "2"] and spark.table("units.chunks").count() == 1
    with pytest.raises(Exception), tables.Unit(spark, "two", "units") as unit:  # noqa: B017
        unit.stage(rows(3), "documents")
        unit.stage(rows(4).withColumn("id", F.raise_error(F.lit("broken off")).cast("string")), "chunks")
    assert held() == ["1", "2"] and tables.Unit(spark, "two", "units").staged() == []
    again = tables.Unit(spark, "three", "units")
    again.stage(rows(2, 5), "documents")
    tables.append(rows(5), "documents", "units")  # as if the commit had been broken off after this table
    assert tables.Unit(spark, "three", "units").commit() == ["documents"] and held() == ["1", "2", "5"]
    with pytest.raises(KeyError):
        again.stage(rows(1), "nothing")


def test_exports(spark):
    iocs = spark.createDataFrame([(1, "ipv4", "8.8.8.8", ["e"]), (1, "asn", "AS7", ["e", "f"]), (2, "ipv4", "8.8.8.8", ["g"]), (2, "cve", "CVE-2024-1", ["h"])], "doc_id long, type string, normalized string, evidence_ids array<string>")
    docs = spark.createDataFrame([(1, None), (2, "T"), (3, "none")], "doc_id long, title string").withColumn("ingested_at", F.lit("2026-05-19").cast("timestamp"))
    events = {r.doc_id: json.loads(r.event_json)["Event"] for r in writers.misp_events(iocs, docs).collect()}
    assert sorted(events) == [1, 2] and events[1]["info"] == "Report 1" and events[2]["date"] == "2026-05-19"
    assert sorted((a["type"], a["value"], a["to_ids"]) for a in events[1]["Attribute"]) == [("AS", "7", False), ("ip-dst", "8.8.8.8", True)]
    assert sorted((r.field, r.value, r.confidence) for r in writers.elastic_documents(iocs).collect()) == [("threat.indicator.as.number", "7", "Medium"), ("threat.indicator.ip", "8.8.8.8", "High")]
    pages = writers.taxii_envelopes(spark.range(25).selectExpr("'c' AS collection", "timestamp_seconds(id * 40000) AS added", "string(id) AS id", "'{\"n\":' || id || '}' AS json"), 10).orderBy("page").collect()
    assert [(r.page, r.n, r.more) for r in pages] == [(0, 10, True), (1, 10, True), (2, 5, False)]
    assert [o["n"] for r in pages for o in json.loads(r.envelope_json)["objects"]] == list(range(25))


def test_sketches_and_sections_without_a_shuffle(spark):
    rows = spark.range(20_000).selectExpr("id % 2 AS g", "double(id * 7919 % 20000) AS v", "id % 5 AS day").union(spark.sql("SELECT 7L AS g, double(null) AS v, 0L AS day"))
    got = {r.g: r for r in score.merged_percentiles(score.daily_sketches(rows, "g", "v"), "g").collect()}
    assert all(abs(got[g][f"p{q}"] / 20_000 - q / 100) <= score.RANK_ERROR for g in (0, 1) for q in (50, 95, 99)) and got[7].p50 is None and got[7].n == 0
    docs = spark.createDataFrame([(1, "#x\n# A\n~~~\n# no\n"), (2, None), (3, "####### seven\n###### six ######")], "doc_id long, text string")
    cut = ingest.sections(docs)
    assert {tuple(r) for r in cut.collect()} == {(1, "A", 1, 3, 16), (3, "six", 6, 14, 31)}
    assert "Exchange" not in cut._jdf.queryExecution().executedPlan().toString()
