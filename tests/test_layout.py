"""Section-aware chunks, parsed documents as nested rows, and extraction as a table function."""

import random

from pyspark.sql import functions as F

from lodestone.operators import extract, ingest, layout


def made(rng):
    parts = []
    for _ in range(rng.randint(0, 12)):
        kind = rng.random()
        line = " ".join(rng.choices(["word", "longer-word", "é", "#", "|"], k=rng.randint(0, 30)))
        parts.append("#" * rng.randint(1, 6) + " head " + line[:40] if kind < 0.2 else "| " + line + " |" if kind < 0.4 else "```\n# no head\n" + line + "\n```" if kind < 0.6 else line)
    return "\n".join(parts)


def test_chunks_cover_and_keep_whole(spark):
    rng = random.Random(5)
    texts = [made(rng) for _ in range(300)] + ["", "```\nnever closed " + "x" * 500]
    for text in texts:
        sections, whole, starts = layout.outline(text)
        assert starts == [0, *(i + 1 for i, c in enumerate(text) if c == "\n")]
        for size, overlap in ((60, 15), (10, 9), (800, 200), (1, 0)):
            got = list(layout.pieces(text, size, overlap))
            covered = set()
            for name, i, j in got:
                covered.update(range(i, j))
                assert j > i and not any(a < c < b for a, b in whole for c in (i, j))
                assert j - i <= size or any(a <= i and j <= b for a, b in whole)
                inside = [s for s in sections if s[1] <= i < s[2]]
                assert [name] == ([s[0] for s in inside] or [None]) and all(j <= s[2] for s in inside)
            assert covered == set(range(len(text)))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {(r.doc_id, r.name, r.level, r.char_start, r.char_end) for r in ingest.sections(docs).collect()}
    assert got == {(i, n, v, s, e) for i, t in enumerate(texts) for n, s, e, v in layout.outline(t)[0]}


def test_plain_text_gets_plain_windows(spark):
    docs = spark.createDataFrame([(1, "a b " * 700, 0), (2, "", 0), (3, None, 0), (4, "x" * 800, 0), (None, "y", 0)], "doc_id long, text string, section int")
    columns = ["doc_id", "chunk_id", "text", "char_start", "char_end", "token_count"]
    got = sorted(layout.section_chunks(docs).where("section IS NULL").select(columns).collect(), key=str)
    assert got == sorted(ingest.chunk_windows(docs).select(columns).collect(), key=str) and len(got) == 7
    assert layout.section_chunks(docs.limit(0)).count() == 0


def test_parsed_rows(spark):
    docs = spark.createDataFrame([(1, "# A\nx", "md"), (2, "p\nq", "txt"), (3, "# t", "html"), (4, None, "md")], "doc_id long, text string, f string")
    got = {r.doc_id: r for r in layout.parsed(docs, F.col("f"), metadata=F.create_map(F.lit("title"), F.col("f"))).collect()}
    assert [tuple(s) for s in got[1].sections] == [("A", 0, 5, 1)] and [tuple(o) for o in got[2].offset_map] == [(0, None, 1), (2, None, 2)]
    assert got[3].sections == got[3].offset_map == got[4].offset_map == [] and got[4].text == "" and got[2].language == "en" and got[2].metadata == {"title": "txt"}


def test_table_function(spark):
    extract.register(spark)
    rows = spark.sql("SELECT * FROM extract_iocs('c-1', 'C2 at evil[.]example.com today.', 1000)").collect()
    assert [tuple(r) for r in rows] == [("c-1", "domain", "evil.example.com", "evil.example.com", "evil[.]example.com", 1006, 1024)]
    assert spark.sql("SELECT * FROM extract_iocs('c', CAST(NULL AS STRING), NULL)").count() == 0
