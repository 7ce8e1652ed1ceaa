"""Sources: raw files by kind, word lists, JSON exchange rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import ingest

EXCHANGE = """
  document struct<id:string,source_uri:string,sha256:string,title:string,language:string,ingested_at:timestamp,mime_type:string,source_format:string>,
  chunks array<struct<chunk_id:string,section:string,page:int,char_start:int,char_end:int,token_count:int>>,
  candidates struct<iocs:array<struct<type:string,value:string,normalized:string,evidence_ids:array<string>,confidence:double,extractor:string>>>,
  evidence array<struct<evidence_id:string,chunk_id:string,text_span:string,char_start:int,char_end:int>>,
  provenance struct<extractors:array<struct<name:string,version:string,model:string,started_at:timestamp,ended_at:timestamp,config_hash:string>>,pipeline_version:string,schema_version:string>,
  version string
"""


def source_format(path: Column, mime: Column | None = None) -> Column:
    """pdf, html, md, txt or url by MIME type, scheme or extension; null for others."""
    p = F.lower(path)
    by_name = F.when(p.rlike(r"\.pdf$"), "pdf").when(p.rlike(r"\.html?$"), "html").when(p.rlike(r"\.(md|markdown)$"), "md").when(p.rlike(r"\.(txt|log)$"), "txt").when(p.rlike("^https?://"), "url")
    if mime is None:
        return by_name
    m = F.lower(mime)
    return F.when(m.startswith("application/pdf"), "pdf").when(m.startswith("text/html"), "html").when(m.startswith("text/markdown"), "md").when(m.startswith("text/plain"), "txt").otherwise(by_name)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """All files under a path as documents: uri, sha256, source_format, text, error_code.

    Files are read by Spark as bytes. HTML becomes its main text; Markdown and plain text stay as they are; a PDF needs
    a parser that isn't here, so it is kept with an error code.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    text = F.decode("content", "UTF-8")
    kind = source_format(F.col("path"))
    return raw.select(F.col("path").alias("uri"), F.sha2("content", 256).alias("sha256"), kind.alias("source_format"), F.when(kind == "html", ingest.html_text(text)).when(kind.isin("md", "txt"), text).alias("text")).withColumn(
        "error_code", F.when(F.col("text").isNull(), "unsupported_format").when((F.col("source_format") == "html") & (F.length("text") < 200), "article_too_short")
    )


def tlds(spark: SparkSession, *paths: str) -> tuple[str, ...]:
    """Top-level domains of the first list that can be read: one a line, # begins a comment. Else the built-in ones.

    Such a list has about 1500 entries, and all of its lines count; it becomes a literal set in the plan.
    """
    from pyspark.errors import AnalysisException

    for path in paths:
        try:
            rows = spark.read.text(path).select(F.lower(F.trim("value")).alias("v")).where((F.col("v") != "") & ~F.col("v").startswith("#")).distinct().collect()
        except AnalysisException:
            continue
        if rows:
            return tuple(sorted(r.v for r in rows))
    return fixed.TLDS


def exchange(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of the exchange model; a line that doesn't fit has nulls and its text in `corrupt`."""
    return spark.read.schema(EXCHANGE + ", corrupt string").option("columnNameOfCorruptRecord", "corrupt").json(path)


SNAPSHOT = """
  objects array<struct<type:string,id:string,name:string,description:string,aliases:array<string>,x_mitre_aliases:array<string>,revoked:boolean,x_mitre_deprecated:boolean,
  external_references:array<struct<source_name:string,external_id:string>>,kill_chain_phases:array<struct<kill_chain_name:string,phase_name:string>>>>
"""
KINDS = {"attack-pattern": "technique", "x-mitre-tactic": "tactic", "intrusion-set": "group", "malware": "software", "tool": "software"}


def attack(spark: SparkSession, path: str) -> DataFrame:
    """Techniques, tactics, groups and software of ATT&CK bundles (JSON, one a file): attack_id, stix_id, kind, name,
    description, aliases, tactics, parent_id (of sub-techniques), active (neither revoked nor deprecated).

    Objects without an id of their own in ATT&CK are left out. A file is one bundle, so it is read in one task.
    """
    kind = F.coalesce(*(F.when(F.col("o.type") == t, F.lit(k)) for t, k in KINDS.items()))
    own = F.filter("o.external_references", lambda r: r["source_name"] == "mitre-attack")
    attack_id = F.try_element_at(own, F.lit(1))["external_id"]
    rows = spark.read.schema(SNAPSHOT).option("multiLine", True).json(path).select(F.explode("objects").alias("o")).select(attack_id.alias("attack_id"), F.col("o.id").alias("stix_id"), kind.alias("kind"), "o")
    lists = F.concat(F.coalesce("o.aliases", F.array().cast("array<string>")), F.coalesce("o.x_mitre_aliases", F.array().cast("array<string>")))
    tactics = F.transform(F.filter("o.kill_chain_phases", lambda p: p["kill_chain_name"] == "mitre-attack"), lambda p: p["phase_name"])
    parent = F.when((F.col("kind") == "technique") & F.contains("attack_id", F.lit(".")), F.substring_index("attack_id", ".", 1))
    return rows.where(F.col("kind").isNotNull() & F.col("attack_id").isNotNull()).select(
        "attack_id", "stix_id", "kind", F.col("o.name").alias("name"), F.col("o.description").alias("description"), F.array_sort(F.array_except(F.array_distinct(lists), F.array("o.name"))).alias("aliases"),
        F.array_sort(F.coalesce(tactics, F.array().cast("array<string>"))).alias("tactics"), parent.alias("parent_id"),
        (~(F.coalesce("o.revoked", F.lit(False)) | F.coalesce("o.x_mitre_deprecated", F.lit(False)))).alias("active"),
    )


def attack_names(snapshot: DataFrame) -> DataFrame:
    """Each name and other name of active groups and software, with its id: name, attack_id."""
    own = snapshot.where(F.col("active") & F.col("kind").isin("group", "software"))
    return own.select(F.explode(F.concat(F.array("name"), "aliases")).alias("name"), "attack_id").where(F.col("name").isNotNull()).distinct()
