"""Streams with state: any cut into batches gives what one batch gives, rows that come late, timers, and a restart."""

import datetime as dt
import random


from lodestone.operators import audit
from lodestone.streaming import state

START = dt.datetime(2026, 5, 19)


def run(spark, stream, out, checkpoint):
    q = stream.writeStream.format("parquet").option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start(str(out))
    q.awaitTermination(240)
    assert q.exception() is None


def source(spark, schema, path, files=1):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(str(path))


def put(spark, rows, schema, path, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(path / name))


CHAIN = "chain string, id long, payload string, at timestamp"


def test_chains_in_any_cut_and_after_a_restart(spark, tmp_path):
    state.use_rocksdb(spark)
    rng = random.Random(9)
    rows = [(c, i, f'{{"i":{i}}}', START + dt.timedelta(minutes=10 * i)) for c in ("a", "b") for i in range(24)]
    end = [("z", 0, "{}", START + dt.timedelta(days=9))]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for name, cut in (("one", 48), ("many", 16)):
            folder = tmp_path / name
            for k in range(0, len(rows), cut):
                # within the delay rows come in any order
                part = sorted(rows, key=lambda r: r[3])[k : k + cut]
                put(spark, rng.sample(part, len(part)), CHAIN, folder / "in", f"{k:03}")
            read = lambda folder=folder: state.chains(source(spark, CHAIN, f"{folder}/in/*"), "1 hour")
            run(spark, read(), folder / "out", folder / "cp")
            put(spark, end, CHAIN, folder / "in", "900")  # the query starts again from its checkpoint
            put(spark, [("a", 99, "late", START)] + [("z", 1, "{}", START + dt.timedelta(days=19))], CHAIN, folder / "in", "901")
            run(spark, read(), folder / "out", folder / "cp")
            got = {(r.chain, r.id, r.prev_hash, r.hash) for r in spark.read.parquet(f"{folder}/out").where("chain <> 'z'").collect()}
            want = audit.build(spark.createDataFrame(rows, CHAIN))
            assert got == {(r.chain, r.id, r.prev_hash, r.hash) for r in want.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_known_indicators_stay_known_until_a_document_is_silent(spark, tmp_path):
    state.use_rocksdb(spark)
    schema = "doc_id long, text string, ingested_at timestamp"
    at = lambda h: START + dt.timedelta(hours=h)
    batches = [[(1, "evil.com and evil[.]com", at(0)), (2, None, at(0))], [(1, "again evil.com and 8.8.8.8", at(5))], [(3, "x.org", at(100))], [(3, "none", at(101))], [(1, "evil.com", at(102))]]
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for k, rows in enumerate(batches):
            put(spark, rows, schema, tmp_path / "in", f"{k:03}")
            run(spark, state.known_indicators(source(spark, schema, f"{tmp_path}/in/*"), "1 hour", idle_ms=24 * 3_600_000), tmp_path / "out", tmp_path / "cp")
        got = sorted((r.doc_id, r.normalized, r.n, r.event) for r in spark.read.parquet(str(tmp_path / "out")).collect())
        new = [(d, v, 1, "new") for d, v in ((1, "evil.com"), (1, "8.8.8.8"), (1, "evil.com"), (3, "x.org"))]
        assert got == sorted([*new, (1, "evil.com", 3, "closed"), (1, "8.8.8.8", 1, "closed")])
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
