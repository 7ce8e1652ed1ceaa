"""Records and tables: provenance, lookups, deletion, agreement, unique appends."""

from pyspark.sql import functions as F

from lodestone.operators import records
from lodestone.sources import tables


def test_cascade_and_lookup(spark):
    docs = spark.createDataFrame([(1,), (2,)], "id long")
    chunks = spark.createDataFrame([(10, 1), (20, 2)], "id long, document_id long")
    spans = spark.createDataFrame([(100, 10), (200, 20)], "id long, chunk_id long")
    left = records.cascade(docs.where("id = 1"), (chunks, "id", "document_id"), (spans, "id", "chunk_id"))
    assert [[tuple(r) for r in x.collect()] for x in left] == [[(20, 2)], [(200, 20)]]
    objects = spark.createDataFrame([(1, "a", 0, "old"), (1, "a", 3, "new"), (2, "a", 1, "x")], "doc_id long, id string, position int, json string")
    assert {(r.doc_id, r.json) for r in records.by_id(objects).collect()} == {(1, "new"), (2, "x")}


def test_alpha(spark):
    rows = [(u, r, v) for u, values in enumerate([("a", "a"), ("b", "b"), ("a", "b"), ("a", None)]) for r, v in enumerate(values)]
    got = records.krippendorff(spark.createDataFrame(rows, "unit int, rater int, value string")).first()
    # 6 paired values, 3 of each kind: observed 2 of 6 disagree, expected 18 of 30
    assert (got.alpha, got.n) == (round(1 - (2 / 6) / (18 / 30), 6), 6)
    same = records.krippendorff(spark.createDataFrame([(1, 1, "a"), (1, 2, "a")], "unit int, rater int, value string")).first()
    assert same.alpha is None


def test_tables_keep_their_keys(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS kept")
    try:
        tables.create(spark, "kept")
        rows = spark.createDataFrame([("2", "h1", "second"), ("1", "h1", "first"), ("3", "h2", "third")], "id string, sha256 string, title string").withColumn("status", F.lit("pending"))
        tables.append(rows, "documents", "kept")
        tables.append(rows.withColumn("id", F.concat(F.lit("9"), "id")).unionByName(rows.limit(1).withColumn("sha256", F.lit("h3"))), "documents", "kept")
        assert sorted((r.id, r.sha256, r.title) for r in spark.table("kept.documents").collect()) == [("1", "h1", "first"), ("2", "h3", "second"), ("3", "h2", "third")]
    finally:
        spark.sql("DROP DATABASE kept CASCADE")
