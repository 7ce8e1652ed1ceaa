"""How many rows and bytes a task gets, whatever files the rows come from."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestone.functions import fixed
from lodestone.operators import extract, gazetteer, score, vectors
from lodestone.plans import catalog
from lodestone.sources import tables


def largest(df):
    return df.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]


def test_rows_of_one_row_group_are_dealt_to_tasks(spark, tmp_path):
    """A row group goes to one split, however many splits its file has."""
    spark.range(0, 100_000, 1, 1).selectExpr("id AS event_id", "id % 7 AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(3).selectExpr("id AS doc_id", "cast(null AS string) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
    try:
        events = spark.read.parquet(f"{tmp_path}/events.parquet")
        assert events.rdd.getNumPartitions() > spark.sparkContext.defaultParallelism and largest(events) == 100_000
        assert largest(tables.spread(events)) < 1.1 * (1 << 14)
        made = catalog.corpus(spark, str(tmp_path))
        assert largest(made.where("doc_id >= 1000000000")) < 1.1 * (1 << 14) and made.count() == 100_003
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def shuffled(spark, run):
    """Records that the stages of a run write to shuffles."""
    sc = spark.sparkContext
    none = sc._gateway.new_array(sc._jvm.double, 0)
    store = sc._jsc.sc().statusStore()

    def total():
        sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        stages = store.stageList(None, False, False, none, None)
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    before = total()
    run()
    return total() - before


def test_names_are_asked_for_once_in_a_block(spark):
    """Names joined by equality: what is shuffled follows the distinct runs of words, not every place where one stands."""
    docs = spark.createDataFrame([(i, "cozy bear, fancy bear. " * 2000) for i in range(4)], "doc_id long, text string")
    names = spark.createDataFrame([("Cozy Bear", 1), ("bear", 2), ("fancy", 3)], "name string, entity_id long")
    got, before = [], spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for names that are many
    try:
        assert shuffled(spark, lambda: got.append(gazetteer.entity_mentions(docs, names, most_bytes=0).groupBy("entity_id").count().collect())) < 500
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {(r["entity_id"], r["count"]) for r in got[0]} == {(1, 8000), (2, 8000), (3, 8000)}


def test_neighbours_of_a_batch_are_not_held_together(spark, monkeypatch):
    """A batch of blocks and packs is read pair by pair; each output has the neighbours of one pair at most."""
    rng, run = np.random.default_rng(3), []
    rows = spark.createDataFrame([(i, rng.normal(size=4).tolist(), f"l{i % 2}") for i in range(40)], "vec_id long, embedding array<double>, label string")
    lists = vectors.build(rows, cells=2)
    kind = type(rows)
    whole = kind.mapInArrow
    with monkeypatch.context() as m:
        m.setattr(kind, "mapInArrow", lambda self, f, *a, **k: run.append(f) or whole(self, f, *a, **k))
        vectors.nearest(lists, rows, k=3)
    x, q = rng.normal(size=(10, 4)), rng.normal(size=(6, 4))
    pair = {"ids": list(range(10)), "corpora": ["a", None] * 5, "x": x.tobytes(), "query_ids": list(range(6)), "q": q.tobytes()}
    batch = pa.RecordBatch.from_pylist([pair] * 30, pa.schema([("ids", pa.list_(pa.int64())), ("corpora", pa.list_(pa.string())), ("x", pa.binary()), ("query_ids", pa.list_(pa.int64())), ("q", pa.binary())]))
    out = list(run[-1](iter([batch])))
    assert len(out) == 30 and {b.num_rows for b in out} == {6 * 2 * 3} and len({str(b.to_pylist()) for b in out}) == 1
    cos = np.round((x @ q.T) / np.linalg.norm(x, axis=1)[:, None] / np.linalg.norm(q, axis=1), 6)
    got = {(r["query_id"], r["corpus"], r["vec_id"], r["similarity"]) for r in out[0].to_pylist()}
    assert got == {(j, c, i, cos[i, j]) for j in range(6) for n, c in enumerate(("a", None)) for i in sorted(range(n, 10, 2), key=lambda i: -cos[i, j])[:3]}


def test_types_not_asked_for_are_not_looked_for(spark, tmp_path, monkeypatch):
    """A query of some types runs their patterns and no others, and gets the rows that it would have got of all."""
    line = "CVE-2024-11111 " + "a" * 32 + " " + "B" * 40 + " " + "c" * 64 + " " + "d" * 128 + " AS012 8.8.8.8 https://A.example.com/x (m@b.example.net) 2001:db8::5 evil[.]example.org"
    docs = spark.createDataFrame([(1, line), (2, None), (3, "nothing"), (4, "only 9.9.9.9"), (5, "١.8.8.8 AS٥")], "doc_id long, text string")
    chunks = extract.whole_documents(docs)
    for lane in ("exact", "fast"):
        every = set(map(tuple, extract.matches(chunks, lane=lane).collect()))
        for types in (*((k,) for k in fixed.TYPES), ("domain", "url"), ()):
            assert set(map(tuple, extract.matches(chunks, lane=lane, types=types).collect())) == {r for r in every if r[2] in types}, (lane, types)
    assert [k for _, k, _ in extract.Finder(fixed.TLDS, ("asn", "ipv4")).patterns] == ["ipv4", "asn"]
    with pytest.raises(ValueError):
        extract.matches(chunks, types=("ip",))

    spark.range(3).selectExpr("id AS event_id", "id AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    asked, whole = [], extract.found
    monkeypatch.setattr(extract, "found", lambda *a, **k: asked.append(a[3] if len(a) > 3 else k.get("types")) or whole(*a, **k))
    for name, types in (("ioc_ipv4", ["ipv4"]), ("ioc_domain", ["domain"]), ("ioc_sha512", ["sha512"]), ("ioc_asn", ["asn"]), ("detection_searches", ["ipv4", "domain", "url"])):
        catalog.QUERIES[name](spark, str(tmp_path))
        assert list(asked.pop()) == types, name


def test_scores_read_their_rows_once(spark, tmp_path):
    """Both sides of the scores come from one extraction; a row with a null key equals none of the other side."""
    spark.range(70).selectExpr("id AS event_id", "id AS user_id").write.parquet(f"{tmp_path}/events.parquet")
    spark.range(3).selectExpr("id AS doc_id", "cast(null AS string) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    plan = catalog.ioc_eval_prf(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan
    rows = "doc_id long, type string, normalized string"
    gold = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (2, "a", "y"), (None, "a", "z"), (5, "c", None)], rows)
    found = spark.createDataFrame([(1, "a", "x"), (3, "a", "y"), (None, "a", "z"), (4, "b", "w")], rows)
    assert {tuple(r)[:4] for r in score.prf(gold, found).collect()} == {("a", 1, 2, 2), ("b", 0, 1, 0), ("c", 0, 0, 1)}
    marked = spark.createDataFrame([(1, "a", "x", True, None), (1, "a", "x", None, True), (2, "b", "y", False, False), (3, "c", "z", None, None)], rows + ", gold boolean, found boolean")
    assert [tuple(r) for r in score.prf_marked(marked).collect()] == [("a", 1, 0, 0, 1.0, 1.0, 1.0)]
