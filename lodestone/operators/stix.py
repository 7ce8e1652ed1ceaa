"""STIX 2.1 objects as columns: patterns, deterministic ids, indicators, reports, bundles, canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import sorted_struct, uuid5

TIME = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"


def pattern(kind: Column, normalized: Column) -> Column:
    """The pattern of an indicator; null for a type that has none."""
    quoted = F.when(kind.isin("url", "email"), F.replace(normalized, F.lit("'"), F.lit("''"))).when(kind == "asn", F.regexp_replace(normalized, "^AS", "")).otherwise(normalized)
    out = None
    for k, template in fixed.STIX_PATTERNS.items():
        before, after = template.split("{n}")
        value = F.concat(F.lit(before), quoted, F.lit(after))
        out = F.when(kind == k, value) if out is None else out.when(kind == k, value)
    return out


def indicator_id(doc_id: Column, stix_pattern: Column) -> Column:
    return F.concat(F.lit("indicator--"), uuid5(F.concat_ws("|", doc_id.cast("string"), F.lit("stix"), stix_pattern)))


def report_id(doc_id: Column) -> Column:
    return F.concat(F.lit("report--"), uuid5(F.concat(doc_id.cast("string"), F.lit("|report"))))


def relationship_id(source: Column, kind: Column, target: Column) -> Column:
    return F.concat(F.lit("relationship--"), uuid5(F.concat_ws("|", source, kind, target)))


def bundle_id(ids: Column) -> Column:
    """Of the set of child ids, in any order."""
    return F.concat(F.lit("bundle--"), uuid5(F.concat_ws("|", F.array_sort(F.array_distinct(ids)))))


def relationships(rows: DataFrame) -> DataFrame:
    """Adds id to rows of source_ref, relationship_type, target_ref."""
    return rows.withColumn("id", relationship_id(F.col("source_ref"), F.col("relationship_type"), F.col("target_ref")))


def utc(ts: Column) -> Column:
    """A timestamp as STIX writes it; the session's time zone is UTC."""
    return F.date_format(ts.cast("timestamp"), TIME)


def indicators(iocs: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each indicator that has a pattern. iocs: doc_id, type, normalized, evidence_ids, confidence, extractor;
    documents: doc_id, ingested_at. A document's indicators share its ingest time."""
    p = iocs.withColumn("pattern", pattern(F.col("type"), F.col("normalized"))).where(F.col("pattern").isNotNull())
    return p.join(documents.select("doc_id", "ingested_at"), "doc_id").select(
        "doc_id", "type", *(c for c in ("ord", "first_start") if c in iocs.columns), "pattern",
        indicator_id(F.col("doc_id"), F.col("pattern")).alias("id"),
        F.concat_ws(": ", "type", "normalized").alias("name"),
        F.concat(F.lit("Extracted by "), F.col("extractor"), F.lit("; backed by "), F.size("evidence_ids").cast("string"), F.lit(" evidence span(s).")).alias("description"),
        F.bround(F.col("confidence").cast("double") * 100).cast("int").alias("confidence"),
        utc(F.col("ingested_at")).alias("valid_from"),
    )


def reports(indicators_: DataFrame, documents: DataFrame) -> DataFrame:
    """One row for each document with an indicator. documents: doc_id, title, source_uri, ingested_at."""
    order = F.struct(*(c for c in ("ord", "first_start", "id") if c in indicators_.columns))
    refs = indicators_.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["id"]).alias("object_refs"))
    return refs.join(documents, "doc_id").select(
        "doc_id", report_id(F.col("doc_id")).alias("id"),
        F.coalesce(F.nullif("title", F.lit("")), F.concat(F.lit("Report "), F.col("doc_id").cast("string"))).alias("name"),
        F.col("source_uri").alias("description"), utc(F.col("ingested_at")).alias("published"), "object_refs",
    )


def unbuildable(documents: DataFrame, indicators_: DataFrame) -> DataFrame:
    """Documents without any indicator, which make no bundle: doc_id and why."""
    return documents.select("doc_id").join(indicators_.select("doc_id").distinct(), "doc_id", "left_anti").withColumn("error_code", F.lit("no_buildable_indicators"))


def bundles(indicators_: DataFrame, reports_: DataFrame) -> DataFrame:
    """One row for each report: doc_id, bundle_id, bundle_json (canonical), bundle_hash.

    JSON has sorted keys, no spaces and non-ASCII as it is: every struct lists its fields alphabetically. The report
    stands first, then its indicators in the order of its references.
    """
    c = F.col
    one = sorted_struct(
        confidence=c("confidence"), created=c("valid_from"), description=c("description"), id=c("id"), indicator_types=F.array(F.lit("malicious-activity")), modified=c("valid_from"), name=c("name"),
        pattern=c("pattern"), pattern_type=F.lit("stix"), pattern_version=F.lit("2.1"), spec_version=F.lit("2.1"), type=F.lit("indicator"), valid_from=c("valid_from"),
    )
    head = sorted_struct(
        created=c("published"), description=c("description"), id=c("id"), modified=c("published"), name=c("name"), object_refs=c("object_refs"), published=c("published"),
        report_types=F.array(F.lit("threat-report")), spec_version=F.lit("2.1"), type=F.lit("report"),
    )
    order = F.struct(*(x for x in ("ord", "first_start", "id") if x in indicators_.columns), F.to_json(one).alias("json"))
    children = indicators_.select("doc_id", order.alias("o")).groupBy("doc_id").agg(F.array_sort(F.collect_list("o")).alias("o"))
    rows = reports_.select("doc_id", "id", F.to_json(head).alias("report")).join(children, "doc_id")
    bid = bundle_id(F.concat(F.array("id"), F.transform("o", lambda x: x["id"])))
    text = F.concat(
        F.lit('{"id":"'), c("bundle_id"), F.lit('","objects":['), F.concat_ws(",", F.concat(F.array("report"), F.transform("o", lambda x: x["json"]))), F.lit('],"type":"bundle"}'),
    )
    return rows.select("doc_id", bid.alias("bundle_id"), "report", "o").select("doc_id", "bundle_id", text.alias("bundle_json")).withColumn("bundle_hash", F.sha2("bundle_json", 256))
