"""Clusters of reports: those that rare indicators tie together, whatever common ones they share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import tables


def ties(found: DataFrame, most: int = 20) -> tuple[DataFrame, DataFrame]:
    """(doc_id, type, normalized, n_reports, weight) of each report's indicators that other reports have too, and the hubs: indicators
    of more than `most` reports, which tie nothing: type, normalized, n_reports. A tie weighs 1 / (n_reports - 1), so an indicator adds 1 to each of
    its reports at most, however many these are."""
    own = found.select("doc_id", "type", "normalized").where(F.col("doc_id").isNotNull() & F.col("normalized").isNotNull()).distinct()
    counts = own.groupBy("type", "normalized").agg(F.count("*").alias("n_reports")).where("n_reports > 1")
    rare = counts.where(F.col("n_reports") <= most).withColumn("weight", 1 / (F.col("n_reports") - 1))
    return own.join(rare, ["type", "normalized"]).select("doc_id", "type", "normalized", "n_reports", "weight"), counts.where(F.col("n_reports") > most)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of nodes that edges (a, b) connect; root is the smallest node of the component.

    Rounds of two steps, each a grouping by node: every node's larger neighbours go to its smallest one, then its smaller
    neighbours and itself do. Edges never grow in number, and the rounds are in the logarithm of the nodes; each is a table.
    """
    now = tables.written(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        far = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        far = tables.written(far)
        low = far.groupBy("a").agg(F.min("b").alias("m"))
        near = far.join(low, "a")
        step = near.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(near.select("a", F.col("m").alias("b"))).where(F.col("a") != F.col("b")).distinct()
        step = tables.written(step)
        if step.exceptAll(now).isEmpty() and now.exceptAll(step).isEmpty():
            return step.select(F.col("a").alias("node"), F.col("b").alias("root"))
        now = step


def report_clusters(docs: DataFrame, found: DataFrame, most: int = 20) -> DataFrame:
    """One row for each document: doc_id, cluster (the smallest doc_id that rare indicators tie it to, through any number of
    reports), n_ties (its indicators that tie), weight (6 digits).

    docs: doc_id; found: doc_id, type, normalized. An indicator ties its reports to the first of them, so its edges are as many as its reports and
    never their square. A report without ties is its own cluster with 0 ties; a null doc_id is left out.
    """
    tied = tables.written(ties(found, most)[0])
    first = tied.groupBy("type", "normalized").agg(F.min("doc_id").alias("b"))
    edges = tied.select("type", "normalized", F.col("doc_id").alias("a")).join(first, ["type", "normalized"]).select("a", "b")
    sums = tied.groupBy("doc_id").agg(F.count("*").alias("n_ties"), F.round(F.sum("weight"), 6).alias("weight"))
    out = docs.select("doc_id").where(F.col("doc_id").isNotNull()).distinct().join(sums, "doc_id", "left").join(components(edges).select(F.col("node").alias("doc_id"), "root"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("root", "doc_id").alias("cluster"), F.coalesce("n_ties", F.lit(0).cast("long")).alias("n_ties"), F.coalesce("weight", F.lit(0.0)).alias("weight"))
