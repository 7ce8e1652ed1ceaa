"""The pipeline's stages, one after the other, on a small corpus with nulls, repeats, copies and leaks."""

import corpus_pipeline
import pytest

FILL = [
    "the quick brown fox jumps over the lazy dog while seven wise owls watch from an old oak tree near the river bank",
    "a small boat sails across the quiet bay as the evening sun paints long golden shadows over distant green hills",
]
ITEM = "which of these planets has the largest number of known moons according to the most recent survey"


@pytest.fixture
def folder(spark, tmp_path):
    body = lambda i: " ".join(f"{w}{chr(97 + i % 26)}{chr(97 + i // 26)}" if k % 4 == 0 else w for k, w in enumerate((FILL[i % 2] + " ").split() * 4))
    rows = [(i, "All rights reserved by nobody\n" + body(i), "en", "s", 1) for i in range(20)]
    rows += [(100, body(3).replace("river", "stream", 1), "en", None, None), (101, rows[4][1], None, "s", 3), (102, f"{body(7)} {ITEM.upper()}, {body(8)}", "en", "s", 4)]
    rows += [(103, None, "en", "s", 5), (104, "12 -- 34", None, None, 6), (None, body(55), None, None, None), (None, f"{body(57)} {ITEM}", None, None, None), (5, rows[5][1], "en", "s", 1), (5, body(60), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        kept.append(sorted(str(r.doc_id) for r in docs.select("doc_id").collect()))
        if k < 4:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
    everything = sorted([*map(str, range(20)), "100", "101", "102", "103", "104", "None", "None", "5", "5"])
    without = lambda rows, *gone: sorted([x for x in rows if x not in gone])
    assert kept[0] == without(everything, "103", "104")
    assert kept[1] == kept[0]
    lines = {(r.doc_id, r.text.startswith("All rights")) for r in spark.read.parquet(f"{folder}/1").collect()}
    assert (0, True) in lines and (7, False) in lines
    assert kept[2] == without(kept[1], "100", "101")
    assert kept[3] == sorted([*without(kept[2], "102", "None")])
    assert kept[4] == kept[3]


def test_run(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert len(rows) == 22 and all(r.n_tokens > 0 for r in rows)


@pytest.mark.parametrize("lang", [None, "und"])
def test_corpus_without_usable_labels_passes(spark, folder, lang):
    docs = spark.read.parquet(f"{folder}/documents.parquet").drop("lang").selectExpr("doc_id", "text", f"cast({repr(lang) if lang else 'null'} as string) lang", "source", "n_chars")
    kept = corpus_pipeline.identify(spark, docs, folder).collect()
    assert len(kept) == docs.count() - 2 and not {103, 104} & {r.doc_id for r in kept}


def test_empty_tables_and_extra_columns(spark, folder, tmp_path):
    """An empty corpus and an empty benchmark go through all stages; columns beside those of documents are left behind."""
    docs, items = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    for name, d, b in (("none", docs.limit(0), items), ("nothing", docs.limit(0), items.limit(0))):
        d.selectExpr("*", "1 AS block", "'x' AS carry0", "'y' AS kept").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        b.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        assert corpus_pipeline.run(spark, f"{tmp_path}/{name}").count() == 0
    more = docs.selectExpr("*", "1 AS block", "'x' AS carry0", "'y' AS kept")
    assert corpus_pipeline.identify(spark, more, folder).columns == list(corpus_pipeline.COLUMNS)
    bare = corpus_pipeline.decontaminated(spark, docs, f"{tmp_path}/nothing")
    assert bare.count() == docs.count()
