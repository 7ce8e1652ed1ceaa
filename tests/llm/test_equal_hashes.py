"""Words whose 64-bit hashes collide are told apart by every operator that hashes words; rows without an id are dealt."""

import random

import numpy as np

from lodestone.llm import common, decontamination, line_dedup
from lodestone.llm.near_dedup import near_dedup
from lodestone.llm.substring_dedup import substring_dedup

#: Two pairs of words of one hash each, found by trying.
PLAIN = ("jfemdxreumnthqvd", "aojiraiy567tpiw3")
MARKED = ("IK2,ck7,rw+Et7sD", 'hwPO7kfQ"~?NDj\\)')


def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_the_pairs_collide():
    for pair in (PLAIN, MARKED):
        assert np.unique(common.words([w.encode() for w in pair])[0]).size == 1


def test_told_apart_ranks_words_only_where_hashes_collide():
    rng = random.Random(1)
    words = [bytes(rng.choices(b"ab", k=rng.choice([0, 1, 7, 8, 9, 63, 64, 65, 200]))) for _ in range(300)]
    data = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = end - [len(w) for w in words]
    h = common.hash_words(data, start, end)
    assert common.told_apart(data, start, end, h) is h
    for few in (h & np.uint64(3), np.zeros(len(h), np.uint64)):
        own = common.told_apart(data, start, end, few)
        assert len(set(own.tolist())) == len(set(words)) == len(set(zip(own.tolist(), words, strict=True)))
        assert own.min() >= 2
    assert len(common.told_apart(b"", start[:0], end[:0], h[:0])) == 0


def test_near_dedup(spark):
    tail = " ".join(f"w{i}" for i in range(30))
    middle = " ".join(f"v{i}" for i in range(15))
    rows = [(i, f"{tail} {w} {middle}") for i, w in enumerate(PLAIN)]
    rows += [(10 + i, f"{w} b") for i, w in enumerate(PLAIN)] + [(20, rows[0][1] + " end")]
    for family in (1_000_000, 10):
        got = {r.doc_id: r.class_id for r in near_dedup(docs(spark, rows), threshold=0.85, family=family).collect()}
        assert got == {0: 0, 1: 1, 10: 10, 11: 11, 20: 0}


def test_decontamination(spark):
    items = spark.createDataFrame([(1, f"{PLAIN[0]} one two three"), (2, f"{PLAIN[1]} one two three")], "item_id long, text string")
    rows = [(k, f"some words before {w} one two three and after") for k, w in enumerate(PLAIN)] + [(2, "other one two three")]
    got = {(r.doc_id, r.item_id, r.edits) for r in decontamination.decontaminate(docs(spark, rows), items).collect()}
    assert got == {(0, 1, 0), (1, 2, 0)}


def test_line_dedup(spark):
    rows = [(i, f"own line {'abcd'[i]}\n{MARKED[i // 2]}") for i in range(4)]
    assert {r.doc_id for r in line_dedup.line_dedup(docs(spark, rows), least_blocks=2).collect() if r.n_removed} == set()
    rows += [(4, MARKED[1])]
    assert {r.doc_id for r in line_dedup.line_dedup(docs(spark, rows), least_blocks=2).collect() if r.n_removed} == {3, 4}


def test_lines_keep_their_identity_under_weak_hashes(monkeypatch):
    rng = random.Random(2)
    texts = ["\n".join(" ".join(rng.choices(["one", "two", "x1", "y22", "three"], k=rng.randint(0, 5))) for _ in range(30)).encode() for _ in range(5)]
    strong = line_dedup.Lines(texts, 3)
    hashed = common.hash_words
    monkeypatch.setattr(common, "hash_words", lambda *a: hashed(*a) & np.uint64(3))
    weak = line_dedup.Lines(texts, 3)
    both = set(zip(strong.key.tolist(), weak.key.tolist(), strict=True))
    assert len(both) == len(set(strong.key.tolist())) == len(set(weak.key.tolist()))
    assert np.array_equal(strong.token == 1, weak.token == 1)


def test_rows_without_id_are_dealt(spark):
    """10,000 rows without an id fill several blocks, and the results are those of any other id."""
    from pyspark.sql import functions as F

    from lodestone.llm.common import documents, in_blocks

    passage = " ".join(f"p{i}" for i in range(13))
    rows = [(None, f"{passage} own{i} " + "word " * (i % 7) + f"\nline of all\nlast {'abcdefghij'[i % 10]}") for i in range(10_000)]
    df = docs(spark, rows + [(1, f"{passage}\nline of all")])
    dealt, n = in_blocks(documents(df), 1 << 20, 8, apart=True)
    size = [r["count"] for r in dealt.groupBy("block").count().collect()]
    assert len(size) == n and max(size) < 2 * 10_000 / n
    got = substring_dedup(df, least_blocks=8).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("n_removed").alias("gone")).collect()
    assert {(r.doc_id, r.n, r.gone) for r in got} == {(1, 1, 0), (None, 10_000, 130_000)}
    lines = line_dedup.line_dedup(df, min_docs=2, least_blocks=8).groupBy("doc_id").agg(F.count("*").alias("n"), F.min("n_removed").alias("least")).collect()
    assert {(r.doc_id, r.n, r.least) for r in lines} == {(1, 1, 0), (None, 10_000, 1)}
    # a text far beyond a block stays whole
    long = docs(spark, [(1, "a b " * 400_000), (2, passage), (3, passage + " x")])
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(long, block_bytes=10_000, least_blocks=3).collect()} == {1: (800_000, 0), 2: (13, 0), 3: (14, 13)}
