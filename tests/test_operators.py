"""Operators end to end: extraction in both lanes, bundles, issues, chains, ingestion, scores, sources, streams."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.operators import audit, extract, ingest, score, stix, validate
from lodestone.plans import report
from lodestone.sources import readers, writers
from lodestone.streaming import extract as stream


def chunk(spark, *texts, start=0):
    return spark.createDataFrame([(i, f"c-{i}", t, start) for i, t in enumerate(texts)], "doc_id long, chunk_id string, text string, char_start int")


def test_extraction_is_grounded(spark):
    rows = extract.matches(chunk(spark, "C2 at evil[.]example.com today.", start=1000)).collect()
    assert [(r.type, r.normalized, r.char_start, r.char_end, r.text_span) for r in rows] == [("domain", "evil.example.com", 1006, 1024, "evil[.]example.com")]
    assert rows[0].evidence_id == "e-" + hashlib.sha256(b"c-0|1006|1024|domain").hexdigest()[:32]
    found = extract.matches(chunk(spark, "evil.example.com seen, then evil.example.com again.", "see README.txt for notes", "internal at 192.168.1.1 only", "x", None, "IPv6 2001:DB8::5, and ::1 too"))
    iocs = extract.indicators(found).collect()
    assert [(r.doc_id, r.type, r.normalized, len(r.evidence_ids)) for r in sorted(iocs)] == [(0, "domain", "evil.example.com", 2), (5, "ipv6", "2001:db8::5", 1)]
    assert extract.evidence(found).count() == 3
    assert extract.indicators(extract.matches(chunk(spark, "a@a.aa " * 5000)), "doc_id").count() == 0


def test_values_that_are_too_long_are_set_apart(spark):
    found = extract.matches(chunk(spark, "https://a.com/" + "x" * 3000 + " 8.8.8.8")).collect()
    assert {(r.type, r.error_code) for r in found} == {("url", "value_too_long"), ("domain", None), ("ipv4", None)}


def test_lanes_agree(spark):
    rng = random.Random(1)
    parts = ["8.8.8.8", "10.0.0.1", "Evil.COM", "a.b@C.net", "https://X.org/a;b;?#", "http://y.io/q?1#f", "CVE-2021-44228", "AS0042", "d" * 32, "E" * 40, "f" * 64, "0" * 128, "exämple.com", "\U0001f600", ".", ",", "x", "AS1", "http://1.2.3.4:8/", "1.2.3", "e.g.", "As1", "a@b"]
    texts = [rng.choice(["", " "]).join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(300)]
    rows = chunk(spark, *texts)
    fast, exact = (sorted(map(tuple, extract.matches(rows, lane=lane).collect()), key=str) for lane in ("fast", "exact"))
    assert fast == exact and len(fast) > 300
    odd = chunk(spark, "AS\u0663\u0664 and AS\u0661", "\u0661.\u0662.\u0663.\u0664", "CVE-\u0662\u0660\u0662\u0664-\u0661\u0661\u0661\u0661", "plain words. And more", "see a\u200b.com", "x hxxp://e.com")
    assert {r.normalized for r in extract.matches(odd).where("type = 'asn'").collect()} == {"AS34", "AS1"}


def described(spark, *texts):
    rows = [(i, t, None if i % 2 else f"T{i}", f"file:///{i}") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, title string, source_uri string").withColumn("ingested_at", F.lit("2026-05-19 01:02:03").cast("timestamp"))


def test_bundles(spark):
    built = report.build(described(spark, "evil.com CVE-2024-1234", "only CVE-2024-1234", "http://a.com/x'y evil.com AS7", "evil.com CVE-2024-1234"))
    bundles = {r.doc_id: json.loads(r.bundle_json) for r in built.bundles.collect()}
    assert sorted(bundles) == [0, 2, 3] and [r.doc_id for r in built.unbuildable.collect()] == [1]
    assert [o["type"] for o in bundles[0]["objects"]] == ["report", "indicator"] and bundles[0]["objects"][0]["name"] == "T0"
    assert bundles[3]["objects"][0]["name"] == "Report 3"
    for r in built.bundles.collect():
        assert r.bundle_json == json.dumps(json.loads(r.bundle_json), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert r.bundle_hash == hashlib.sha256(r.bundle_json.encode()).hexdigest()
    patterns = [o["pattern"] for o in bundles[2]["objects"][1:]]
    assert patterns == ["[url:value = 'http://a.com/x']", "[domain-name:value = 'a.com']", "[domain-name:value = 'evil.com']", "[autonomous-system:number = 7]"]
    assert all(r.is_valid for r in built.summary.collect())
    again = report.build(described(spark, "evil.com CVE-2024-1234")).bundles.first()
    assert again.bundle_hash == next(r.bundle_hash for r in built.bundles.collect() if r.doc_id == 0)


def test_patterns(spark):
    rows = spark.createDataFrame([(k, "x'y" if k in ("url", "email") else "AS7" if k == "asn" else "v") for k in fixed.TYPES], "type string, normalized string")
    got = {r.type: r.p for r in rows.select("type", stix.pattern(F.col("type"), F.col("normalized")).alias("p")).collect()}
    assert got["url"] == "[url:value = 'x''y']" and got["sha1"] == "[file:hashes.'SHA-1' = 'v']" and got["asn"] == "[autonomous-system:number = 7]" and got["cve"] is None


def test_issues(spark):
    ev = spark.createDataFrame([(1, "c-1", "e-1"), (1, "c-9", "e-2")], "doc_id long, chunk_id string, evidence_id string")
    chunks = spark.createDataFrame([(1, "c-1")], "doc_id long, chunk_id string")
    iocs = spark.createDataFrame([(1, ["e-1", "e-9"])], "doc_id long, evidence_ids array<string>")
    refs = "array<struct<source_name:string,external_id:string>>"
    objects = spark.createDataFrame(
        [
            (1, "indicator--1", None, "p", None, [("mitre-attack", "T1059.001"), ("mitre-attack", "G0001"), ("x", "?")], [("mitre-attack", "impact"), ("mitre-attack", "chaos"), ("y", "z")]),
            (1, "report--1", ["indicator--1", "indicator--2"], None, None, None, None),
        ],
        f"doc_id long, id string, object_refs array<string>, pattern string, pattern_type string, external_references {refs}, kill_chain_phases array<struct<kill_chain_name:string,phase_name:string>>",
    )
    rels = spark.createDataFrame([(1, "r1", "indicator--1", "malware--1", "uses"), (1, "r2", "tool--1", "indicator--1", "anything")], "doc_id long, id string, source_ref string, target_ref string, relationship_type string")
    parts = [validate.evidence_closure(ev, chunks), validate.ioc_closure(iocs, ev), validate.report_closure(objects), validate.relationship_closure(rels, objects), validate.relationship_vocabulary(rels), validate.indicator_fields(objects), validate.attack_references(objects)]
    issues = parts[0]
    for p in parts[1:]:
        issues = issues.unionByName(p)
    assert sorted((r.code, r.target_id) for r in issues.collect()) == sorted([
        ("dangling_evidence_chunk", "e-2"), ("dangling_ioc_evidence", "e-9"), ("dangling_report_ref", "report--1"), ("dangling_rel_target", "r1"), ("dangling_rel_source", "r2"), ("invalid_relationship_type", "r1"),
        ("indicator_missing_pattern", "report--1"), ("indicator_missing_pattern_type", "indicator--1"), ("invalid_attack_external_id", "indicator--1"), ("invalid_attack_tactic", "indicator--1"),
    ][:6] + [("indicator_missing_pattern_type", "indicator--1"), ("invalid_attack_external_id", "indicator--1"), ("invalid_attack_tactic", "indicator--1")])
    s = validate.summary(spark.createDataFrame([(1,), (2,)], "doc_id long"), issues).collect()
    assert {(r.doc_id, r.pydantic_ok, r.semantic_ok, r.parse_ok, r.is_valid) for r in s} == {(1, False, False, True, False), (2, True, True, True, True)}
    bad = spark.createDataFrame([(1, "b", '{"id":"bundle--1","objects":[{"type":"indicator","x_custom":1}],"type":"bundle"}'), (2, "b", "nonsense"), (3, "b", '{"id":"bundle--1","objects":[],"type":"bundle"}')], "doc_id long, bundle_id string, bundle_json string")
    assert sorted(r.doc_id for r in validate.strict_parse(bad).collect())[:2] == [1, 2]


def test_constraints(spark):
    rows = spark.createDataFrame([("e-" + "0" * 16, "x", 10, 26), ("e-0", "x", 10, 10), ("e-" + "0" * 16, "", -1, 5)], "evidence_id string, text_span string, char_start int, char_end int")
    good, bad = validate.quarantine(rows, validate.evidence_rules())
    assert good.count() == 1 and sorted(r.errors for r in bad.collect()) == [["evidence_id", "window"], ["text_span", "char_start"]]
    chunks = spark.createDataFrame([("abc", 0, 3, None, 0), ("abc", 0, 4, 0, 0), ("", 5, 5, 1, 0)], "text string, char_start int, char_end int, page int, token_count int")
    assert sorted(map(str, (r.errors for r in validate.quarantine(chunks, validate.chunk_rules())[1].collect()))) == ["['page', 'length']", "['text', 'window']"]
    assert validate.quarantine(chunks, validate.chunk_rules(strict=False))[0].count() == 2


def test_audit(spark):
    rows = spark.createDataFrame([(c, i, json.dumps({"i": i}, separators=(",", ":"))) for c in ("a", "b") for i in (1, 2, 3)], "chain string, id long, payload string")
    chain = audit.build(rows)
    got = {(r.chain, r.id): r for r in chain.collect()}
    assert got["a", 1].prev_hash == fixed.GENESIS and got["a", 2].prev_hash == got["a", 1].hash == hashlib.sha256(f"{fixed.GENESIS}|{{\"i\":1}}".encode()).hexdigest()
    assert {(r.chain, r.ok, r.n_rows) for r in audit.verify(chain).collect()} == {("a", True, 3), ("b", True, 3)}
    changed = chain.withColumn("payload", F.when((F.col("chain") == "a") & (F.col("id") == 2), "{}").otherwise(F.col("payload")))
    assert {(r.chain, r.ok, r.first_bad_id) for r in audit.verify(changed).collect()} == {("a", False, 2), ("b", True, None)}
    more = audit.build(spark.createDataFrame([("a", 4, "{}")], "chain string, id long, payload string"), audit.heads(chain))
    assert more.first().prev_hash == got["a", 3].hash


def test_ingestion(spark):
    docs = spark.createDataFrame([(1, "# One\ntext\n```\n# not\n```\n## Two ##\nend"), (2, ""), (3, None), (4, "x" * 1401)], "doc_id long, text string")
    got = {(r.doc_id, r.name, r.level, r.char_start, r.char_end) for r in ingest.sections(docs).collect()}
    assert got == {(1, "One", 1, 0, 25), (1, "Two", 2, 25, 38)}
    chunks = ingest.chunk_windows(docs).where("doc_id = 4").orderBy("char_start").collect()
    assert [(r.char_start, r.char_end, r.chunk_id) for r in chunks] == [(0, 800, "c-4-0"), (600, 1400, "c-4-1"), (1200, 1401, "c-4-2")]
    spans = spark.createDataFrame([(1, 7), (1, 30), (9, 1)], "doc_id long, char_start long")
    assert {(r.doc_id, r.char_start, r.section) for r in ingest.enclosing(spans, ingest.sections(docs)).collect()} == {(1, 7, "One"), (1, 30, "Two"), (9, 1, None)}
    found = spark.createDataFrame([(4, 0, 5), (4, 790, 805), (4, 1390, 1401)], "doc_id long, char_start int, char_end int")
    assert sorted(r.chunk_id for r in ingest.assign_chunks(found).collect()) == ["c-4-0", "c-4-1", "c-4-2"]
    ocr = spark.createDataFrame([(1, 1, "b", 90.0, 5, 9), (1, 1, "a", 61.0, 5, 1), (1, 1, "z", 59.9, 0, 0)], "doc_id long, page int, word string, conf double, top int, left int")
    assert ingest.ocr_text(ocr).first().text == "a b"
    done = spark.createDataFrame([(1, "1", "2")], "doc_id long, pipeline_version string, extractor_version string")
    assert [r.doc_id for r in ingest.unprocessed(done.union(done.withColumn("doc_id", F.lit(5))), done).collect()] == [5]


def test_scores(spark):
    one = spark.range(1).select(score.confidence(extractor=F.lit(1.0), coverage=F.lit(0.5), agreement=F.lit(None)).alias("s")).first().s
    assert one == pytest.approx(0.35)
    assert [r.r for r in spark.createDataFrame([(0.1,), (0.4,), (0.55,)], "s double").select(score.route(F.col("s")).alias("r")).collect()] == ["reject", "review", "accept"]
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "source_ref string, target_ref string")
    assert {(r.node, r.hops) for r in score.reachable(spark, edges, "a", 3).collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.html").write_text("<nav>menu</nav><article>" + "word " * 60 + "</article>")
    (tmp_path / "in/b.md").write_text("# T\nevil.com")
    (tmp_path / "in/c.pdf").write_bytes(b"%PDF")
    (tmp_path / "in/d.html").write_text("<p>short</p>")
    got = {r.uri.rpartition("/")[2]: r for r in readers.documents(spark, str(tmp_path / "in")).collect()}
    assert [got[k].error_code for k in ("a.html", "b.md", "c.pdf", "d.html")] == [None, None, "unsupported_format", "article_too_short"]
    assert "menu" not in got["a.html"].text and got["b.md"].sha256 == hashlib.sha256(b"# T\nevil.com").hexdigest()
    (tmp_path / "tlds.txt").write_text("# list\nZIP\n\nmov\n")
    assert readers.tlds(spark, str(tmp_path / "none"), str(tmp_path / "tlds.txt")) == ("mov", "zip") and readers.tlds(spark) == fixed.TLDS
    built = report.build(described(spark, "evil.com", "8.8.8.8"))
    writers.bundles(built.bundles, str(tmp_path / "bundles"))
    assert {r.value for r in spark.read.text(str(tmp_path / "bundles")).collect()} == {r.bundle_json for r in built.bundles.collect()}
    writers.raw_store(described(spark, "x", "x", "y").select("doc_id", "text"), str(tmp_path / "raw"))
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 2
    row = spark.sql("SELECT named_struct('id', 'd', 'source_uri', 'u', 'sha256', repeat('a', 64), 'title', 'é', 'language', 'en', 'ingested_at', timestamp'2026-05-19', 'mime_type', string(null), 'source_format', 'pdf') AS document, '2026.05.18' AS version")
    writers.exchange(row, str(tmp_path / "json"))
    back = readers.exchange(spark, str(tmp_path / "json")).first()
    assert back.document == row.first().document and back.version == fixed.SCHEMA_VERSION and back.corrupt is None


def test_stream(spark, tmp_path):
    schema = "doc_id long, chunk_id string, text string, char_start int, ingested_at timestamp"
    rows = spark.createDataFrame([(1, "c-1-0", "evil.com evil[.]com"), (1, "c-1-1", "hxxp://evil.com/"), (2, "c-2-0", None)], "doc_id long, chunk_id string, text string")
    rows.select("*", F.lit(0).alias("char_start"), F.lit("2026-05-19").cast("timestamp").alias("ingested_at")).write.parquet(str(tmp_path / "in"))
    out = stream.indicators(stream.read_chunks(spark, str(tmp_path / "in")))
    q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
    q.awaitTermination(120)
    assert sorted((r.doc_id, r.type, r.normalized) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(1, "domain", "evil.com"), (1, "url", "http://evil.com/")]
    assert schema
