"""Queries over exports, redaction of addresses and digests of segments, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import extract, score, segments
from ..sources import writers
from .catalog import _DEDUP, _uuid5_sql, found, query, table


def _case(names: dict, place: int, kind: str = "type") -> str:
    return f"CASE {kind} " + " ".join(f"WHEN '{k}' THEN '{v[place]}'" for k, v in names.items()) + " END"


_VALUE = "CASE type WHEN 'asn' THEN substr(normalized, 3) ELSE normalized END"


@query(
    f"""{_DEDUP}
SELECT doc_id, {_uuid5_sql("doc_id || '|misp|' || type || '|' || normalized")} AS uuid, {_case(writers.MISP, 0)} AS type, {_case(writers.MISP, 1)} AS category, {_VALUE} AS value, type NOT IN ('cve', 'asn') AS to_ids, n_evidence || ' evidence span(s)' AS comment FROM i"""
)
def misp_attributes(spark, sf_dir):
    return writers.misp_attributes(extract.indicators(found(spark, sf_dir), "doc_id"))


@query(
    f"""{_DEDUP}
SELECT sha256(type || '|' || normalized) AS _id, {_case(writers.ELASTIC, 0)} AS indicator_type, 'threat.indicator.' || {_case(writers.ELASTIC, 1)} AS field, {_VALUE} AS value, CASE WHEN count(DISTINCT doc_id) > 1 THEN 'High' ELSE 'Medium' END AS confidence, count(DISTINCT doc_id) AS n_documents
FROM i WHERE type <> 'cve' GROUP BY type, normalized"""
)
def elastic_documents(spark, sf_dir):
    return writers.elastic_documents(extract.indicators(found(spark, sf_dir, tuple(writers.ELASTIC)), "doc_id"))


_OBJECT = "'{\"id\":\"o--' || event_id || '\"}'"


@query(
    f"""WITH r AS (SELECT event_type AS collection, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, 'o--' || event_id) - 1 AS place, count(*) OVER (PARTITION BY event_type) AS total FROM events)
SELECT collection, place // 100 AS page, cast(count(*) AS int) AS n, (place // 100 + 1) * 100 < total AS more,
  CASE WHEN (place // 100 + 1) * 100 < total THEN '{{"more":true,"next":"' || (place // 100 + 1) || '","objects":[' ELSE '{{"more":false,"objects":[' END || string_agg({_OBJECT}, ',' ORDER BY place) || ']}}' AS envelope_json
FROM r GROUP BY collection, place // 100, total"""
)
def taxii_envelopes(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("collection"), F.col("ts").alias("added"), F.concat(F.lit("o--"), F.col("event_id").cast("string")).alias("id"))
    return writers.taxii_envelopes(rows.withColumn("json", F.concat(F.lit('{"id":"'), "id", F.lit('"}'))))


@query(
    """SELECT event_id, 'from ' || CASE WHEN event_id % 3 = 0 THEN 'x' || to_hex(event_id * 7 % 65536) || ':0:A1:7f:0:1:2:' || to_hex(event_id % 4096) ELSE '[REDACTED_IPV6]' END || ', then ::1 or [REDACTED_IPV6] end' AS redacted,
  CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END AS n_redacted FROM events"""
)
def redact_ipv6(spark, sf_dir):
    """Full IPv6 addresses go, but not behind a letter; short forms aren't full."""
    e = F.col("event_id")
    address = F.concat(F.hex(e * 7 % 65536), F.lit(":0:A1:7f:0:1:2:"), F.hex(e % 4096))
    made = F.concat(F.lit("from "), F.when(e % 3 == 0, "x").otherwise(""), address, F.lit(", then ::1 or "), address, F.lit(" end"))
    rows = table(spark, sf_dir, "events").select("event_id", made.alias("text"))
    out, n = text.redact(F.col("text"))
    return rows.select("event_id", out.alias("redacted"), n.alias("n_redacted"))


@query(
    """WITH r AS (SELECT event_type AS chain, event_id AS id, event_id // 256 AS node, sha256(length(event_id::varchar) || ':' || event_id || '|' || coalesce(length(props) || ':' || props, '-')) AS d FROM events)
SELECT chain, node, count(*) AS n, sha256(string_agg(d, '' ORDER BY id)) AS digest FROM r GROUP BY chain, node"""
)
def segment_digests(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("chain"), F.col("event_id").alias("id"), "props")
    return segments.tree(rows, ["props"]).where("level = 0").select("chain", "node", "n", "digest")


@query("SELECT event_type AS chain, event_id AS id, CASE WHEN event_id % 1009 = 0 THEN 'replace' WHEN event_id % 1013 = 0 THEN 'remove' ELSE 'add' END AS op FROM events WHERE event_id % 1009 = 0 OR event_id % 1013 = 0 OR event_id % 1019 = 0")
def segment_differences(spark, sf_dir):
    """Two sides of one table, of which one lacks, adds and changes some rows, by descending into unequal nodes."""
    rows, e = table(spark, sf_dir, "events").select(F.col("event_type").alias("chain"), F.col("event_id").alias("id"), "props"), F.col("id")
    kept = (e % 1009 == 0) | (e % 1013 == 0)
    left = rows.where(kept | (e % 1019 != 0))
    right = rows.where((e % 1009 == 0) | (e % 1013 != 0)).withColumn("props", F.when(e % 1009 == 0, F.concat("props", F.lit(" "))).otherwise(F.col("props")))
    return segments.differences(left, right, ["props"])


@query("SELECT event_type, count(value) AS n, true AS p50_holds, true AS p95_holds, true AS p99_holds FROM events GROUP BY event_type")
def quantile_sketches(spark, sf_dir):
    """Percentiles of merged daily sketches, and whether the true ranks of what they say are within the stated error."""
    rows = table(spark, sf_dir, "events").select("event_type", "value", F.to_date("ts").alias("day"))
    told = score.merged_percentiles(score.daily_sketches(rows, "event_type", "value"), "event_type")
    below = lambda p: F.count(F.when(F.col("value") < F.col(p), 1)) / F.count("value")
    upto = lambda p: F.count(F.when(F.col("value") <= F.col(p), 1)) / F.count("value")
    checks = [((below(f"p{q}") <= q / 100 + score.RANK_ERROR) & (upto(f"p{q}") >= q / 100 - score.RANK_ERROR)).alias(f"p{q}_holds") for q in (50, 95, 99)]
    return rows.join(told, "event_type").groupBy("event_type").agg(F.count("value").alias("n"), *checks)
