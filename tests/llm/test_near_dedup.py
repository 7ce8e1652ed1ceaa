"""Near-dedup against all pairs compared, and the alignment against plain dynamic programming."""

import random

import numpy as np

from lodestone.llm.near_dedup import Text, align, jaccard, linked, near_dedup


def test_alignment_has_fewest_edits():
    rng = random.Random(2)
    for _ in range(300):
        a = [rng.randrange(4) for _ in range(rng.randint(0, 25))]
        b = [x if rng.random() < 0.8 else rng.randrange(4) for x in a]
        for _ in range(rng.randint(0, 3)):
            b[rng.randint(0, len(b)) : rng.randint(0, len(b))] = [rng.randrange(4) for _ in range(rng.randint(0, 2))]
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
        edits, matched = align(np.array(a, np.uint64), np.array(b, np.uint64), 60)
        assert edits == row[-1] and 0 <= matched <= max(0, min(len(a), len(b)) - 4)
        assert a != b or matched == max(0, len(a) - 4)
        assert row[-1] == 0 or align(np.array(a, np.uint64), np.array(b, np.uint64), row[-1] - 1) is None


def test_against_all_pairs(spark):
    rng = random.Random(6)
    vocab = [f"v{i}" for i in range(400)]
    boiler = " ".join(rng.choices(vocab, k=30))
    rows, d = [], 0
    for _ in range(40):
        base = rng.choices(vocab, k=rng.randint(3, 160))
        for _ in range(rng.randint(1, 6)):
            w = list(base)
            for _ in range(rng.randint(0, len(w) // 25 + 1)):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], ["x"], [w[k], "y"]])
            base = w if rng.random() < 0.5 else base
            rows.append((d, " ".join(w) + (" " + boiler if rng.random() < 0.3 else "")))
            d += 1
    rows += [(1000, None), (1001, ""), (1002, " \n "), (1003, rows[3][1].replace(" ", "\n")), (None, rows[4][1]), (5, rows[5][1]), (1004, "a b"), (1005, "a b"), (1006, "b a")]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    read = [Text((t or "").encode()) for _, t in rows]
    for i in range(len(rows)):
        for j in range(i):
            if np.array_equal(read[i].words, read[j].words) or (jaccard(read[i], read[j]) >= 0.8 and linked(read[i], read[j], 0.8)):
                parent[root(i)] = root(j)
    big = (1 << 63) - 1
    key = [big if d is None else d for d, _ in rows]
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(least.get(root(i), big), key[i])
    want = sorted((key[i], least[root(i)]) for i in range(len(rows)))
    df = spark.createDataFrame([(*r, b"n", 1) for r in rows], "doc_id long, text string, node binary, key int")
    for family in (4_000_000, 20):
        out = near_dedup(df, family=family).collect()
        got = sorted((big if r.doc_id is None else r.doc_id, big if r.class_id is None else r.class_id) for r in out)
        assert got == want
    assert len({c for _, c in want}) < len(rows) - 30
    assert near_dedup(df.limit(0)).count() == 0


def test_unlike_texts_that_share_much_meet_in_few_rounds(spark, monkeypatch):
    """Texts of which half is the same share keys and aren't alike: with hubs alone, rounds grow with their logarithm."""
    from lodestone.llm import common

    rng = random.Random(9)
    shared = " ".join(f"s{rng.randrange(10**6)}" for _ in range(120))
    rows = [(i, shared + " " + " ".join(f"o{rng.randrange(10**6)}" for _ in range(70))) for i in range(30)]
    rows += [(100 + i, t + " z") for i, t in rows[:3]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    written = []
    cut = common.cut
    monkeypatch.setattr(common, "cut", lambda x: written.append(1) or cut(x))
    whole = {(r.doc_id, r.class_id) for r in near_dedup(df).collect()}
    assert whole == {(i, i) for i in range(30)} | {(100 + i, i) for i in range(3)}
    few = len(written)
    assert {(r.doc_id, r.class_id) for r in near_dedup(df, family=400).collect()} == whole
    assert len(written) - 2 * few < 6 * 4  # at most log4(33) rounds and one


def test_very_long_texts(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(5000)}" for _ in range(60_000)]
    other = [w if rng.random() < 0.98 else "x" for w in words]
    far = [w if rng.random() < 0.5 else "y" for w in words]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(far))], "doc_id long, text string")
    assert {(r.doc_id, r.class_id) for r in near_dedup(df).collect()} == {(1, 1), (2, 1), (3, 3)}
