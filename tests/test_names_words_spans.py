"""Names in text, the inverted index, enclosing spans and inverted lists, against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from lodestone.operators import gazetteer, index, intervals, score, vectors


def plain_mentions(docs, names):
    known = {}
    for name, entity in names:
        words = tuple(w.lower() for w in re.findall(r"[^\W_]+", name or ""))
        if words:
            known[words] = min(entity, known.get(words, entity))
    out = set()
    for doc, text in docs:
        found, at = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"[^\W_]+", text or "")], 0
        while at < len(found):
            fits = [k for k in range(1, 6) if at + k <= len(found) and tuple(w for w, _, _ in found[at : at + k]) in known]
            if fits:
                k = fits[-1]
                s, e = found[at][1], found[at + k - 1][2]
                out.add((doc, s, e, text[s:e], known[tuple(w for w, _, _ in found[at : at + k])]))
            at += fits[-1] if fits else 1
    return out


@pytest.mark.parametrize("most", [0, 1 << 20])
def test_mentions(spark, most):
    rng = random.Random(5)
    words = ["Lazarus", "Group", "APT", "28", "Ünï", "bear", "Cozy", "the", "C2", "x"]
    names = [(" ".join(rng.choices(words, k=rng.randint(1, 4))), i) for i in range(30)] + [(None, 90), ("", 91), ("--", 92), ("cozy-BEAR", 3), ("Cozy  Bear", 2), ("Fancy_Bear", 94)]
    docs = [(i, "".join(rng.choice(words) + rng.choice([" ", "\n", ", ", "_", "-", "", " \U0001f600 "]) for _ in range(rng.randint(0, 60)))) for i in range(80)]
    docs += [(200, None), (201, ""), (202, "Lazarusgroup apt28 FANCY BEAR!"), (203, "cozy—bear " * 5000)]
    got = gazetteer.entity_mentions(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(names, "name string, entity_id long"), most_bytes=most)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == plain_mentions(docs, names)
    none = spark.createDataFrame([], "name string, entity_id long")
    assert gazetteer.entity_mentions(got.selectExpr("doc_id", "mention AS text"), none, most_bytes=most).count() == 0


def plain_bm25(docs, queries, k):
    found = {d: re.findall("[a-z0-9]+", (t or "").lower()) for d, t in docs}
    tf, mean = {d: Counter(w) for d, w in found.items()}, sum(map(len, found.values())) / len(docs)
    df, out = Counter(t for c in tf.values() for t in c), set()
    for q in {q for q, _ in queries}:
        scores = []
        for d, c in tf.items():
            terms = {t for x, t in queries if x == q and c[t]}
            if terms:
                s = sum(math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5) + 1) * c[t] * (index.K1 + 1) / (c[t] + index.K1 * (1 - index.B + index.B * len(found[d]) / mean)) for t in terms)
                scores.append((-round(s, 6), d))
        out |= {(q, d, -s, r) for r, (s, d) in enumerate(sorted(scores)[:k], 1)}
    return out


def test_index_and_blocks_that_are_left_out(spark):
    rng = random.Random(6)
    docs = [(i * 7 - 300, " ".join(rng.choices(["a", "b", "c", "dd", "e1", "zeta", "Rare"], [40, 20, 10, 5, 3, 1, 0.1], k=rng.randint(1, 40)))) for i in range(600)] + [(90_001, None), (90_002, ""), (2**40, "zeta rare zeta")]
    queries = [(1, "a"), (1, "zeta"), (1, "zeta"), (2, "rare"), (3, "absent"), (3, "dd"), (4, "absent")]
    asked = spark.createDataFrame(queries, "query_id long, term string")
    built = index.build(spark.createDataFrame(docs, "doc_id long, text string"), width=64)
    rows = {(r.query_id, r.doc_id, r.score, r["rank"]) for r in index.bm25(built, asked, k=5, width=64).collect()}
    want = plain_bm25(docs, queries, 5)
    assert {(q, d, r) for q, d, _, r in rows} == {(q, d, r) for q, d, _, r in want}
    assert all(abs(a[2] - b[2]) < 2e-6 for a, b in zip(sorted(rows), sorted(want), strict=True))
    read, whole = (x.selectExpr("sum(n)").first()[0] for x in (index.needed(built, asked, k=5, width=64), index._asked(built, asked)))
    assert read < whole  # postings of blocks whose bound is too low aren't read
    assert built.blocks.where("term = 'a'").count() > 50  # a common term is many blocks
    empty = index.build(spark.createDataFrame([], "doc_id long, text string"))
    assert index.bm25(empty, asked).count() == 0


def test_coded_numbers():
    for top in (0, 255, 256, 70_000, 2**40):
        x = np.array([0, top, 1], np.int64)
        got, end = index.decoded(b"??" + index.coded(x), 3, 2)
        assert got.tolist() == x.tolist() and end == len(index.coded(x)) + 2


def test_enclosed_spans(spark):
    rng = random.Random(7)
    rows = [(d, f"s{i}", s := rng.randint(0, 300), s + rng.choice([0, 1, 5, 20, 200])) for d in range(4) for i in range(60)]
    rows += [(0, "twin1", 10, 20), (0, "twin2", 10, 20), (0, "odd", 9, 3), (0, None, 1, 2), (None, "x", 1, 2), (1, "null", None, 4)]
    df = spark.createDataFrame(rows, "doc_id long, id string, char_start int, char_end int")
    good = [r for r in rows if None not in r and r[3] >= r[2]]
    want = Counter((a[0], a[1], b[1]) for a in good for b in good if a[0] == b[0] and b[2] <= a[2] and b[3] >= a[3])
    for size in (7, 64, 1 << 16):
        assert Counter(map(tuple, intervals.enclosed(df, df, size).collect())) == want


def test_nested_sections(spark):
    flat = [(1, "A", 1, 0, 10), (1, "A.1", 2, 10, 20), (1, "A.1.x", 4, 20, 30), (1, "A.2", 2, 30, 40), (1, "B", 1, 40, 50), (2, "deep", 3, 5, 9), (2, "top", 1, 9, 30), (2, "end", 2, 30, 31)]
    got = {(r.doc_id, r.name): r.char_end for r in intervals.nested(spark.createDataFrame(flat, "doc_id long, name string, level int, char_start int, char_end int")).collect()}
    assert got == {(1, "A"): 40, (1, "A.1"): 30, (1, "A.1.x"): 30, (1, "A.2"): 40, (1, "B"): 50, (2, "deep"): 9, (2, "top"): 31, (2, "end"): 31}


def test_recall_of_inverted_lists(spark):
    rng = np.random.default_rng(8)
    heart = rng.normal(size=(20, 16))
    rows = [(i, [float(v) for v in heart[i % 20 if i % 3 else 0] + rng.normal(size=16) * 0.3], i % 2) for i in range(4000)] + [(9_000, None, 0), (9_001, [0.0] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    asked = df.where("vec_id % 100 = 0")
    exact = score.nearest_all(df, asked)
    lists = vectors.build(df)
    assert vectors.recall(vectors.nearest(lists, asked), exact) >= 0.9 and lists.probes < len(lists.centres) / 2
    every = vectors.nearest(lists, asked, probes=len(lists.centres))
    assert {tuple(r)[:3] for r in every.collect()} == {tuple(r)[:3] for r in exact.collect()}
    assert lists.blocks.selectExpr("sum(size(ids))").first()[0] == 4000
    tables = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    asked = tables.where("vec_id % 100 = 0")
    assert vectors.recall(vectors.nearest(vectors.build(tables), asked), score.nearest_all(tables, asked)) >= 0.9
