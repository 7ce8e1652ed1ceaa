"""Exact, window and suffix-array dedup against brute force, with nulls, empty texts, ties and clashing columns."""

import hashlib
import random

import numpy as np
import pytest

from lodestone.llm.exact_dedup import CuckooIndex, exact_dedup
from lodestone.llm.substring_dedup import substring_dedup
from lodestone.llm.suffix_dedup import suffix_dedup

SCHEMA = "doc_id long, text string, block int, bucket int, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA)


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    vocab = ["alpha", "Beta", "gämma", "δ", "e", "ff", "ggg", "h h"]
    passages = [" ".join(rng.choices(vocab, k=30)) for _ in range(6)]
    out = [(0, None), (1, ""), (2, " \n\t "), (3, "aaaa " * 60), (4, "aaaa " * 61), (5, "aaaa " * 60), (6, "AAAA " * 60)]
    for i in range(7, 60):
        parts = [" ".join(rng.choices(vocab, k=rng.randint(1, 20))) if rng.random() < 0.6 else rng.choice(passages) for _ in range(rng.randint(1, 6))]
        out.append((i, rng.choice([" ", "\n", "  "]).join(parts)))
    out += [(100, out[10][1]), (101, out[10][1]), (102, "x" * 500), (-3, out[20][1]), (None, out[11][1])]
    return out


def test_index_grows_deletes_and_verifies():
    index = CuckooIndex(16)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    for i, k in enumerate(keys):
        index.put(k, i)
    assert len(index) == 5000 and all(index.get(k) == i for i, k in enumerate(keys))
    near = keys[0][:8] + b"\0" * 24  # the same fingerprint and bucket, other content
    assert near not in index
    assert all(index.delete(k) for k in keys[::2]) and not index.delete(keys[0])
    assert [k in index for k in keys[:4]] == [False, True, False, True]


def test_exact_dedup(spark, rows):
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(frame(spark, rows)).collect()}
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(low), []).append(d)
    most = lambda ids: None if None in ids else max(ids)
    want = {(d, most(ids), len(ids), d == most(ids), sha(t.encode())) for t, ids in groups.items() for d in ids}
    assert got == want


def test_substring_dedup(spark, rows):
    span = 13
    docs = [((1 << 63) - 1 if d is None else d, (t or "").encode().split()) for d, t in rows]
    least = {}
    for d, w in docs:
        for i in range(len(w) - span + 1):
            g = tuple(w[i : i + span])
            least[g] = min(least.get(g, d), d)
    want = {}
    for d, w in docs:
        gone = {j for i in range(len(w) - span + 1) if least[tuple(w[i : i + span])] < d for j in range(i, i + span)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        want[d] = (len(w), len(gone), sum(j - 1 not in gone for j in gone), sha(kept), kept.decode())
    got = {(1 << 63) - 1 if r.doc_id is None else r.doc_id: (r.n_words, r.n_removed, r.n_spans, r.kept_sha256, r.kept_text) for r in substring_dedup(frame(spark, rows), block_bytes=400, least_blocks=3).collect()}
    assert got == want


def thue_morse(n, one, other):
    return [(one, other)[i.bit_count() % 2] for i in range(n)]


def test_words_and_windows_that_a_polynomial_confuses(spark):
    """A Thue-Morse word of 1024 letters has the polynomial hash of its complement, modulo any power of 2 up to 64."""
    tail = " ".join(f"w{i}" for i in range(12))
    rows = [(1, "".join(thue_morse(2048, "a", "b")) + " " + tail), (2, "".join(thue_morse(2048, "b", "a")) + " " + tail)]
    rows += [(3, " ".join(thue_morse(16, "x", "y"))), (4, " ".join(thue_morse(16, "y", "x")))]
    got = {r.doc_id: r.n_removed for r in substring_dedup(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 0, 4: 0}


def test_windows_with_equal_hashes_are_told_apart(monkeypatch):
    """With a window hash of 3 bits windows collide, and the second hash still tells them apart."""
    import pyarrow as pa

    from lodestone.llm import common
    from lodestone.llm.substring_dedup import _Block

    keep = common.Rolling.of
    monkeypatch.setattr(common.Rolling, "of", lambda self, a, b: common.mix(keep(self, a, b) & np.uint64(7)))
    block = _Block(pa.table({"doc_id": [1, 2], "text": ["a b c d e f g h", "a b c d e x y z"]}), 3)
    some, h, other, first, place = block.compared(np.ones(len(block.distinct), bool))
    assert len(block.distinct) < 9 and len(some) == 12
    assert len(h) == len(set(other.tolist())) == 9
    assert (block.words[block.first[first[place]]] == block.words[block.first[some]]).all()


@pytest.mark.parametrize("hot", [3, 1024])
def test_suffix_dedup(spark, rows, hot):
    span = 100
    docs = sorted(((1 << 63) - 1 if d is None else d, (t or "").encode()) for d, t in rows)
    seen, want = set(), {}
    for d, t in docs:
        gone = set()
        for i in range(len(t) - span + 1):
            g = t[i : i + span]
            if g in seen:
                gone.update(range(i, i + span))
            seen.add(g)
        want[d] = (len(t), len(gone), sum(j - 1 not in gone for j in gone), sha(bytes(x for j, x in enumerate(t) if j not in gone)))
    got = {(1 << 63) - 1 if r.doc_id is None else r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup(frame(spark, rows), block_bytes=600, least_blocks=4, hot=hot).collect()}
    assert got == want


def test_empty_tables(spark):
    for op in (exact_dedup, substring_dedup, suffix_dedup):
        assert op(frame(spark, [])).count() == 0


#: Two words of one 64-bit hash, found by trying.
COLLIDE = ("IK2,ck7,rw+Et7sD", 'hwPO7kfQ"~?NDj\\)')


def test_words_of_equal_hashes_are_told_apart(spark):
    import numpy as np

    from lodestone.llm import common

    hashes, _ = common.words([w.encode() for w in COLLIDE])
    assert np.unique(hashes).size == 1
    tail = " ".join(f"w{i}" for i in range(1, 13))
    df = spark.createDataFrame([(1, f"{COLLIDE[0]} {tail}"), (2, f"{COLLIDE[1]} {tail}"), (3, f"x {COLLIDE[1]} {tail}")], "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup(df).collect()} == {1: (13, 0), 2: (13, 0), 3: (14, 13)}
