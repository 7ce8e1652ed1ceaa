"""Provenance, object lookup, deletion along references, agreement of annotators, relaxed technique scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.text import sorted_struct

RUN = "struct<name:string,version:string,model:string,started_at:timestamp,ended_at:timestamp,config_hash:string>"


def config_hash(**settings) -> Column:
    """SHA-256 of the settings as canonical JSON; values are literals."""
    return F.sha2(F.to_json(sorted_struct(**{k: F.lit(v) for k, v in settings.items()})), 256)


def append_run(provenance: Column, run: Column) -> Column:
    """A provenance struct (extractors, pipeline_version, schema_version) with one more run; the input stays as it is."""
    held = F.coalesce(provenance["extractors"], F.array().cast(f"array<{RUN}>"))
    return F.struct(F.array_append(held, run).alias("extractors"), provenance["pipeline_version"].alias("pipeline_version"), F.coalesce(provenance["schema_version"], F.lit(fixed.SCHEMA_VERSION)).alias("schema_version"))


def by_id(objects: DataFrame) -> DataFrame:
    """One row for each (doc_id, id): where a bundle repeats an id, the object at the last position stands."""
    return objects.groupBy("doc_id", "id").agg(F.max_by(F.struct(*[c for c in objects.columns if c not in ("doc_id", "id")]), "position").alias("o")).select("doc_id", "id", "o.*")


def cascade(deleted: DataFrame, *children: tuple[DataFrame, str, str]) -> list[DataFrame]:
    """What is left of child tables after rows of the first parent go: each child is (table, own key, key of its parent).

    A child's parent is the table before it, so deletions run down the list; all are anti-joins.
    """
    gone, left = deleted.toDF("parent").distinct(), []
    for table, key, parent in children:
        lost = table.join(gone.withColumnRenamed("parent", parent), parent, "left_semi")
        left.append(table.join(gone.withColumnRenamed("parent", parent), parent, "left_anti").select(*table.columns))
        gone = lost.select(F.col(key).alias("parent")).distinct()
    return left


def krippendorff(ratings: DataFrame) -> DataFrame:
    """Krippendorff's alpha for nominal values: one row of alpha (6 digits) and n, the paired values.

    ratings: unit, rater, value. Units with one rating don't count; null if all values are equal. Coincidences are
    computed from counts by unit and value, so raters are never paired with each other.
    """
    counts = ratings.where(F.col("value").isNotNull()).groupBy("unit", "value").agg(F.count("*").alias("c"))
    units = counts.groupBy("unit").agg(F.sum("c").alias("m")).where("m > 1")
    paired = counts.join(units, "unit")
    # disagreeing pairs of a unit over m - 1, and values by category
    observed = paired.agg(F.sum(F.col("c") * (F.col("m") - F.col("c")) / (F.col("m") - 1)).alias("d"), F.sum("c").alias("n"))
    expected = paired.groupBy("value").agg(F.sum("c").alias("v")).agg(F.sum(F.col("v") * F.col("v")).alias("s"))
    n, d = F.col("n"), F.col("n") * F.col("n") - F.col("s")
    return observed.join(expected, F.lit(True)).select(F.round(1 - (n - 1) * F.col("d") / F.nullif(d.cast("double"), F.lit(0.0)), 6).alias("alpha"), n.alias("n"))


def relaxed_f1(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Exact and relaxed technique scores: one row each of mode, tp, fp, fn, f1. Relaxed compares parents (T1059.001 as T1059).

    Both sides: doc_id, technique.
    """
    parts = []
    for mode, f in (("exact", F.col("technique")), ("relaxed", F.substring_index("technique", ".", 1))):
        g = gold.select("doc_id", f.alias("t")).distinct().withColumn("g", F.lit(1))
        p = found.select("doc_id", f.alias("t")).distinct().withColumn("f", F.lit(1))
        n = g.join(p, ["doc_id", "t"], "full").agg(F.count(F.when(F.col("g").isNotNull() & F.col("f").isNotNull(), 1)).alias("tp"), F.count(F.when(F.col("g").isNull(), 1)).alias("fp"), F.count(F.when(F.col("f").isNull(), 1)).alias("fn"))
        parts.append(n.select(F.lit(mode).alias("mode"), "tp", "fp", "fn", F.round(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), 6).alias("f1")))
    return parts[0].unionByName(parts[1])


def aggregate_reports(iocs: DataFrame, least: int = 2) -> DataFrame:
    """Indicators that several reports share: type, normalized, n_reports, first and last doc_id."""
    return iocs.groupBy("type", "normalized").agg(F.count_distinct("doc_id").alias("n_reports"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).where(F.col("n_reports") >= least)
