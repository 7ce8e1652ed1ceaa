"""Decontamination against brute force over every window, with planted edits."""

import random
import re

import pytest

from lodestone.llm import common, decontamination
from lodestone.llm.decontamination import Items, best_match, decontaminate, matches


def words(text):
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").lower().encode())


def least_edits(item, text):
    """Plain dynamic programming: the item against any run of the text."""
    row = list(range(len(item) + 1))
    best = row[-1]
    for w in text:
        last, row[0] = row[0], 0
        for i, x in enumerate(item, 1):
            last, row[i] = row[i], min(last + (x != w), row[i] + 1, row[i - 1] + 1)
        best = min(best, row[-1])
    return best


@pytest.fixture(scope="module")
def tables():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 20
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(3, 40)))) for i in range(40)]
    items += [(100, None), (101, ""), (102, "..."), (103, items[0][1].upper()), (None, "a lone item with no id at all")]
    docs = []
    for d in range(150):
        text = rng.choices(vocab, k=rng.randint(0, 200))
        if d % 2:
            w = items[rng.randrange(40)][1].split()
            for _ in range(rng.randint(0, max(1, len(w) // 4))):
                k = rng.randrange(len(w)) if w else 0
                edit = rng.random()
                w[k : k + 1] = [] if edit < 0.3 else ["new"] if edit < 0.6 else [*w[k : k + 1], "more"]
            at = rng.randint(0, len(text))
            text[at:at] = w
        docs.append((d, " ".join(x + rng.choice(["", "", ",", "."]) for x in text)))
    docs += [(200, None), (201, ""), (None, "x, " + items[3][1] + " y"), (7, docs[7][1]), (202, "A LONE item -- with no id, at all")]
    return docs, items


def test_best_match():
    rng = random.Random(4)
    for _ in range(300):
        item, text = rng.choices("abcd", k=rng.randint(1, 70)), rng.choices("abcd", k=rng.randint(0, 90))
        assert best_match(item, text) == least_edits(item, text)


def test_against_every_window(spark, tables):
    docs, items = tables
    want = []
    for d, t in docs:
        for i, b in items:
            item = words(b)
            edits = least_edits(item, words(t)) if item else 1 << 30
            if edits <= int(len(item) * 0.2 + 1e-9):
                want.append((str(d), str(i), edits))
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame([(*r, 0) for r in items], "item_id long, text string, doc_id int")
    for size in (8 << 20, 900):
        got = [(str(r.doc_id), str(r.item_id), r.edits) for r in decontaminate(d, b, item_bytes=size).collect()]
        assert len(set(got)) >= len(set(want)) * 0.99 and {g[:2] for g in got} <= {w[:2] for w in want}
        assert len(set(got) & set(want)) >= len(set(want)) * 0.98
    assert decontaminate(d.limit(0), b).count() == 0 and decontaminate(d, b.limit(0)).count() == 0


def test_templates_copies_and_long_items_stay_bounded(monkeypatch):
    """Items that share a template, copies of items and one very long item: the same matches in small parts as in large ones."""
    rng = random.Random(8)
    head = "which of the following is the best answer to the question about"
    rows = [(i, f"{head} {' '.join(rng.choices('abcdefgh', k=6))} x{i % 50}".encode(), 1) for i in range(300)]
    rows += [(1000 + i, rows[3][1], 1) for i in range(5)] + [(2000, rows[4][1], 3)]
    long = [f"u{rng.randrange(999)}" for _ in range(3000)]
    rows.append((3000, " ".join(long).encode(), 1))
    items = Items(rows, 0.8, 4, 16, 2)
    assert sum(map(len, items.ids)) == 300 + 5 + 3 + 1 and len(items.words) <= 301
    edited = long[:]
    for k in range(0, 3000, 60):
        edited[k] = "new"
    texts = [rows[3][1], b"yes " + rows[4][1] + b" no", " ".join(edited).encode(), b"", head.encode()]
    got = matches(texts, items)
    assert {i for d, j, e in got for i in items.ids[j] if d == 0 and e == 0} >= {3, *range(1000, 1005)}
    assert [i for d, j, e in got for i in items.ids[j] if d == 1 and e == 0].count(2000) == 3
    assert [(d, e) for d, j, e in got if items.ids[j] == [3000]] == [(2, 50)]
    for d, j, e in got:
        if d < 2:
            assert e == least_edits(items.words[j].tolist(), common.words([texts[d]], decontamination._SEPARATOR)[0].tolist())
    monkeypatch.setattr(decontamination._slices, "__defaults__", (64,))
    monkeypatch.setattr(decontamination._alike, "__defaults__", (4096,))
    assert matches(texts, items) == got
