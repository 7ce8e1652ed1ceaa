"""Constraints, closures and semantic checks: issues as rows, never as failed jobs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, pattern

ISSUE = ("layer", "code", "target_id")
TECHNIQUE = r"^T[0-9]{4}(\.[0-9]{3})?$"


def _issues(df: DataFrame, layer: str, code: str, target: Column) -> DataFrame:
    return df.select("doc_id", F.lit(layer).alias("layer"), F.lit(code).alias("code"), target.alias("target_id"))


def broken(**rules: Column) -> Column:
    """The names of rules that a row breaks, in the order given. A rule is true or null where it holds."""
    return F.array_compact(F.array(*(F.when(~rule, F.lit(name)) for name, rule in rules.items())))


def document_rules() -> dict[str, Column]:
    c = F.col
    return {
        "sha256": c("sha256").rlike("^[a-f0-9]{64}$"),
        "language": F.length("language").between(2, 5),
        "source_format": c("source_format").isin("pdf", "html", "md", "txt", "url"),
    }


def chunk_rules(strict: bool = True) -> dict[str, Column]:
    """A chunk reference may be empty; a chunk with text may not, and its text must fill its window."""
    c = F.col
    rules = {"char_start": c("char_start") >= 0, "char_end": c("char_end") >= 0, "page": c("page") >= 1, "token_count": c("token_count") >= 0}
    if strict:
        return rules | {"text": F.length("text") >= 1, "window": c("char_end") > c("char_start"), "length": c("char_end") - c("char_start") == F.length("text")}
    return rules | {"window": c("char_end") >= c("char_start")}


def section_rules() -> dict[str, Column]:
    c = F.col
    return {"name": F.length("name") >= 1, "char_start": c("char_start") >= 0, "window": c("char_end") >= c("char_start"), "level": c("level").between(1, 6)}


def evidence_rules() -> dict[str, Column]:
    c = F.col
    return {"evidence_id": c("evidence_id").rlike("^e-[0-9a-f]{16,}$"), "text_span": F.length("text_span").between(1, 8192), "char_start": c("char_start") >= 0, "window": c("char_end") > c("char_start")}


def ioc_rules() -> dict[str, Column]:
    c = F.col
    return {
        "type": c("type").isin(*fixed.TYPES), "value": F.length("value").between(1, 2048), "normalized": F.length("normalized").between(1, 2048), "evidence_ids": F.size("evidence_ids") >= 1,
        "confidence": c("confidence").between(0, 1), "extractor": c("extractor").rlike(r"^[a-z][a-z0-9_]*@[0-9]+\.[0-9]+\.[0-9]+$"),
    }


def run_rules() -> dict[str, Column]:
    c = F.col
    return {"version": c("version").rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$"), "config_hash": c("config_hash").rlike("^[a-f0-9]{64}$"), "order": c("ended_at") >= c("started_at")}


def quarantine(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows that keep all rules, other rows with `errors`)."""
    marked = df.withColumn("errors", broken(**rules))
    return marked.where(F.size("errors") == 0).drop("errors"), marked.where(F.size("errors") > 0)


def evidence_closure(evidence: DataFrame, chunks: DataFrame) -> DataFrame:
    """Evidence whose chunk its document doesn't have."""
    lost = evidence.join(chunks.select("doc_id", "chunk_id").distinct(), ["doc_id", "chunk_id"], "left_anti")
    return _issues(lost, "pydantic", "dangling_evidence_chunk", F.col("evidence_id"))


def ioc_closure(iocs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Evidence ids of indicators that their document doesn't have; target_id is the missing one."""
    named = iocs.select("doc_id", F.explode("evidence_ids").alias("evidence_id"))
    lost = named.join(evidence.select("doc_id", "evidence_id").distinct(), ["doc_id", "evidence_id"], "left_anti")
    return _issues(lost, "pydantic", "dangling_ioc_evidence", F.col("evidence_id"))


def _missing(refs: DataFrame, objects: DataFrame, code: str) -> DataFrame:
    """refs: doc_id, id, ref."""
    known = objects.select("doc_id", F.col("id").alias("ref")).distinct()
    return _issues(refs.where(F.col("ref").isNotNull()).join(known, ["doc_id", "ref"], "left_anti"), "semantic", code, F.col("id"))


def report_closure(objects: DataFrame) -> DataFrame:
    """Reports that refer to objects outside of their bundle. objects: doc_id, id, object_refs."""
    return _missing(objects.where(F.col("id").startswith("report--")).select("doc_id", "id", F.explode("object_refs").alias("ref")), objects, "dangling_report_ref")


def relationship_closure(relationships: DataFrame, objects: DataFrame) -> DataFrame:
    """Ends of relationships outside of their bundle. relationships: doc_id, id, source_ref, target_ref."""
    ends = [("source_ref", "dangling_rel_source"), ("target_ref", "dangling_rel_target")]
    parts = [_missing(relationships.select("doc_id", "id", F.coalesce(c, F.lit("")).alias("ref")), objects, code) for c, code in ends]
    return parts[0].unionByName(parts[1])


def relationship_vocabulary(relationships: DataFrame) -> DataFrame:
    """Relationships whose type isn't allowed between their ends' types; unlisted pairs allow any type."""
    kind = lambda c: F.substring_index(c, "--", 1)
    listed = (kind("source_ref") == "indicator") & kind("target_ref").isin(*fixed.INDICATES)
    return _issues(relationships.where(listed & (F.coalesce("relationship_type", F.lit("")) != "indicates")), "semantic", "invalid_relationship_type", F.col("id"))


def indicator_fields(objects: DataFrame) -> DataFrame:
    """Indicators without pattern or pattern type."""
    own = objects.where(F.col("id").startswith("indicator--"))
    absent = lambda c: F.coalesce(c, F.lit("")) == ""
    return _issues(own.where(absent("pattern")), "semantic", "indicator_missing_pattern", F.col("id")).unionByName(_issues(own.where(absent("pattern_type")), "semantic", "indicator_missing_pattern_type", F.col("id")))


def attack_references(objects: DataFrame) -> DataFrame:
    """External references to mitre-attack that aren't technique ids, and kill chain phases that aren't tactics.
    objects: doc_id, id, external_references ARRAY<STRUCT<source_name, external_id>>, kill_chain_phases
    ARRAY<STRUCT<kill_chain_name, phase_name>>."""
    refs = objects.select("doc_id", "id", F.explode("external_references").alias("r")).where(F.col("r.source_name") == "mitre-attack")
    phases = objects.select("doc_id", "id", F.explode("kill_chain_phases").alias("p")).where(F.col("p.kill_chain_name") == "mitre-attack")
    bad = _issues(refs.where(~F.coalesce(F.col("r.external_id"), F.lit("")).rlike(TECHNIQUE)), "semantic", "invalid_attack_external_id", F.col("id"))
    return bad.unionByName(_issues(phases.where(~F.coalesce(F.col("p.phase_name"), F.lit("")).isin(*fixed.TACTICS)), "semantic", "invalid_attack_tactic", F.col("id")))


# Properties of STIX 2.1 objects by kind. Those of every object come first; a star marks what must be there.
COMMON = {
    "string*": ("type",), "id*": ("id",), "version*": ("spec_version",), "time*": ("created", "modified"), "ref": ("created_by_ref",), "bool": ("revoked",), "strings": ("labels",), "percent": ("confidence",), "string": ("lang",),
    "references": ("external_references",), "refs": ("object_marking_refs",), "any": ("granular_markings", "extensions"),
}
PROPERTIES = {
    "indicator": {"string": ("name", "description", "pattern_version"), "strings": ("indicator_types",), "string*": ("pattern", "pattern_type"), "time*": ("valid_from",), "time": ("valid_until",), "phases": ("kill_chain_phases",)},
    "report": {"string*": ("name",), "string": ("description",), "strings": ("report_types",), "time*": ("published",), "refs*": ("object_refs",)},
    "relationship": {"string*": ("relationship_type",), "string": ("description",), "ref*": ("source_ref", "target_ref"), "time": ("start_time", "stop_time")},
    "malware": {"string": ("name", "description"), "bool*": ("is_family",), "strings": ("malware_types", "aliases", "architecture_execution_envs", "implementation_languages", "capabilities"), "time": ("first_seen", "last_seen"), "phases": ("kill_chain_phases",), "refs": ("operating_system_refs", "sample_refs")},
    "tool": {"string*": ("name",), "string": ("description", "tool_version"), "strings": ("tool_types", "aliases"), "phases": ("kill_chain_phases",)},
    "attack-pattern": {"string*": ("name",), "string": ("description",), "strings": ("aliases",), "phases": ("kill_chain_phases",)},
    "threat-actor": {"string*": ("name",), "string": ("description", "sophistication", "resource_level", "primary_motivation"), "strings": ("threat_actor_types", "aliases", "roles", "goals", "secondary_motivations", "personal_motivations"), "time": ("first_seen", "last_seen")},
    "intrusion-set": {"string*": ("name",), "string": ("description", "resource_level", "primary_motivation"), "strings": ("aliases", "goals", "secondary_motivations"), "time": ("first_seen", "last_seen")},
    "campaign": {"string*": ("name",), "string": ("description", "objective"), "strings": ("aliases",), "time": ("first_seen", "last_seen")},
    "infrastructure": {"string*": ("name",), "string": ("description",), "strings": ("infrastructure_types", "aliases"), "time": ("first_seen", "last_seen"), "phases": ("kill_chain_phases",)},
    "vulnerability": {"string*": ("name",), "string": ("description",)},
    "identity": {"string*": ("name",), "string": ("description", "identity_class", "contact_information"), "strings": ("roles", "sectors")},
}
#: Pairs of times whose second may not be before the first, and pairs where it must be after it.
NOT_BEFORE = (("created", "modified"), ("first_seen", "last_seen"))
AFTER = (("valid_from", "valid_until"), ("start_time", "stop_time"))
_UUID = "[0-9a-f]{8}-[0-9a-f]{4}-[1-5][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}"
_STAMP = re.compile(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d{1,6})?Z", re.ASCII)
_ID = re.compile(f"([a-z0-9-]+)--{_UUID}")


def _time(x) -> datetime | None:
    try:
        return datetime.fromisoformat(x) if isinstance(x, str) and _STAMP.fullmatch(x) else None
    except ValueError:
        return None


def _text(x) -> bool:
    return isinstance(x, str) and x != ""


def _each(test):
    """A list with one item at least, all of which pass."""
    return lambda x: isinstance(x, list) and len(x) > 0 and all(map(test, x))


def _ref(x) -> bool:
    return isinstance(x, str) and _ID.fullmatch(x) is not None


#: Whether a value is of a kind, as json.loads gives it. Whole numbers may be written as text, as STIX libraries read them.
KINDS = {
    "any": lambda x: x is not None,
    "string": _text,
    "bool": lambda x: isinstance(x, bool),
    "version": lambda x: x == "2.1",
    "time": lambda x: _time(x) is not None,
    "percent": lambda x: not isinstance(x, bool) and isinstance(x, (int, str)) and re.fullmatch(r"\d{1,3}", str(x), re.ASCII) is not None and int(x) <= 100,
    "ref": _ref,
    "refs": _each(_ref),
    "strings": _each(_text),
    "phases": _each(lambda p: isinstance(p, dict) and _text(p.get("kill_chain_name")) and _text(p.get("phase_name"))),
    "references": _each(lambda r: isinstance(r, dict) and _text(r.get("source_name")) and any(_text(r.get(k)) for k in ("description", "url", "external_id"))),
}


def _kinds() -> dict[str, dict[str, tuple]]:
    """Of each type its properties: (test, whether it must be there)."""
    return {t: {name: (kind.rstrip("*"), kind.endswith("*")) for group in (COMMON, own) for kind, names in group.items() for name in names} for t, own in PROPERTIES.items()}


def object_problems(o: dict, known: dict) -> Iterator[tuple[str, str]]:
    """(field, problem) of one object."""
    own = known.get(o.get("type")) if isinstance(o.get("type"), str) else None
    if own is None:
        yield "type", "unknown_type"
        return
    for name in o:
        if name not in own:
            yield name, "unknown_field"
    for name, (kind, required) in own.items():
        if name not in o:
            if required:
                yield name, "missing"
        elif not ((m := _ID.fullmatch(o[name])) and m[1] == o["type"] if kind == "id" and isinstance(o[name], str) else kind != "id" and KINDS[kind](o[name])):
            yield name, "bad_value"
    for pairs, strict in ((NOT_BEFORE, False), (AFTER, True)):
        for first, second in pairs:
            if first in o and second in o and first in own and second in own and (a := _time(o[first])) and (b := _time(o[second])) and (b <= a if strict else b < a):
                yield second, "bad_order"
    if o.get("pattern_type") == "stix" and _text(o.get("pattern")) and pattern.comparisons_of(o["pattern"]) is None:
        yield "pattern", "bad_pattern"


def _pairs_once(pairs: list[tuple]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key twice")
    return out


def bundle_problems(text: str | None, known: dict) -> Iterator[tuple[str | None, str | None, str]]:
    """(object id, field, problem) of one bundle's JSON."""
    try:
        b = json.loads(text or "", object_pairs_hook=_pairs_once)
    except (ValueError, RecursionError):
        b = None
    whole = isinstance(b, dict) and b.keys() == {"id", "objects", "type"} and b["type"] == "bundle" and _ref(b["id"]) and b["id"].startswith("bundle--") and isinstance(b["objects"], list)
    if not whole or not all(isinstance(o, dict) for o in b["objects"]):
        yield None, None, "no_bundle"
        return
    for o in b["objects"]:
        for field, problem in object_problems(o, known):
            yield o["id"] if isinstance(o.get("id"), str) else None, field, problem


def semantic(objects: DataFrame, relationships: DataFrame | None = None) -> DataFrame:
    """All semantic checks of bundled objects; columns that `objects` lacks hold nothing to check.

    What an object says of itself is checked where it stands, in one reading; only its references are joined.
    """
    wanted = {
        "object_refs": "array<string>", "pattern": "string", "pattern_type": "string",
        "external_references": "array<struct<source_name:string,external_id:string>>", "kill_chain_phases": "array<struct<kill_chain_name:string,phase_name:string>>",
    }
    whole = objects.select("doc_id", "id", *(F.col(c) if c in objects.columns else F.lit(None).cast(t).alias(c) for c, t in wanted.items()))
    own, absent = F.col("id").startswith("indicator--"), lambda c: F.coalesce(c, F.lit("")) == ""
    code = lambda name: lambda _: F.lit(name)
    references = F.filter("external_references", lambda r: (r["source_name"] == "mitre-attack") & ~F.coalesce(r["external_id"], F.lit("")).rlike(TECHNIQUE))
    phases = F.filter("kill_chain_phases", lambda p: (p["kill_chain_name"] == "mitre-attack") & ~F.coalesce(p["phase_name"], F.lit("")).isin(*fixed.TACTICS))
    none = F.array().cast("array<string>")
    codes = F.concat(
        F.array_compact(F.array(F.when(own & absent("pattern"), "indicator_missing_pattern"), F.when(own & absent("pattern_type"), "indicator_missing_pattern_type"))),
        F.coalesce(F.transform(references, code("invalid_attack_external_id")), none), F.coalesce(F.transform(phases, code("invalid_attack_tactic")), none),
    )
    told = whole.select("doc_id", "id", F.explode(codes).alias("code")).select("doc_id", F.lit("semantic").alias("layer"), "code", F.col("id").alias("target_id"))
    out = report_closure(whole).unionByName(told)
    if relationships is None:
        return out
    return out.unionByName(relationship_closure(relationships, whole)).unionByName(relationship_vocabulary(relationships))


def parse_problems(bundles: DataFrame) -> DataFrame:
    """What a strict parse finds wrong in bundles, a row for each problem: doc_id, bundle_id, object_id, field, problem.

    bundles: doc_id, bundle_id, bundle_json. Problems: no_bundle (text that isn't JSON, or not an object with exactly the
    fields of a bundle and an id of its kind), unknown_type, unknown_field, missing, bad_value (a value that isn't of the
    property's kind: ids, references, times, percentages, lists, phases), bad_order (times that run backwards) and
    bad_pattern (a `stix` pattern outside of the grammar). A null text is no bundle; a repeated key is no JSON. Each bundle
    is read once, in Arrow batches and without a shuffle.
    """
    import pyarrow as pa

    known = _kinds()

    def read(batches):
        for b in batches:
            at, rows = [], []
            for i, text in enumerate(b.column("bundle_json").to_pylist()):
                for row in bundle_problems(text, known):
                    at.append(i)
                    rows.append(row)
            told = zip(*rows, strict=True) if rows else ([], [], [])
            kept = b.drop_columns(["bundle_json"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, pa.string()) for c in told)], names=["doc_id", "bundle_id", "object_id", "field", "problem"])

    keys = bundles.select("doc_id", "bundle_id", "bundle_json")
    told = [T.StructField(c, T.StringType()) for c in ("object_id", "field", "problem")]
    return keys.mapInArrow(read, T.StructType([keys.schema["doc_id"], keys.schema["bundle_id"], *told]))


def strict_parse(bundles: DataFrame) -> DataFrame:
    """An issue for each bundle in which parse_problems finds any. bundles: doc_id, bundle_id, bundle_json."""
    bad = parse_problems(bundles).select("doc_id", "bundle_id").distinct()
    return _issues(bad, "parse", "stix_parse_error", F.col("bundle_id"))


def summary(documents: DataFrame, issues: DataFrame) -> DataFrame:
    """One row for each document: pydantic_ok, parse_ok, semantic_ok, is_valid, n_issues."""
    by = issues.groupBy("doc_id").agg(*(F.bool_and(F.col("layer") != layer).alias(f"{layer}_ok") for layer in ("pydantic", "parse", "semantic")), F.count("*").alias("n"))
    ok = [F.coalesce(f"{layer}_ok", F.lit(True)).alias(f"{layer}_ok") for layer in ("pydantic", "parse", "semantic")]
    out = documents.select("doc_id").join(by, "doc_id", "left").select("doc_id", *ok, F.coalesce("n", F.lit(0)).alias("n_issues"))
    return out.withColumn("is_valid", F.col("pydantic_ok") & F.col("parse_ok") & F.col("semantic_ok"))
