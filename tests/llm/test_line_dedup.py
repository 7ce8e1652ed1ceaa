"""Line dedup against a plain version that parses all lines in one process."""

import hashlib
import random

from lodestone.llm.line_dedup import line_dedup


def plain(rows, min_docs=3, depth=3, alike=0.7):
    docs = sorted(((1 << 63) - 1 if d is None else d, t or "") for d, t in rows)
    mask = lambda line: tuple(None if any(c in "0123456789" for c in w) else w for w in line.encode().split() for w in [w.decode()])
    seen = {}
    for d, t in docs:
        for line in t.split("\n"):
            if m := mask(line):
                seen.setdefault(m, set()).add(d)
    leaves = {}
    for m in seen:
        leaves.setdefault((len(m), m[:depth]), []).append(m)
    drop = {}
    for lines in leaves.values():
        templates = []
        for m in sorted(lines, key=lambda m: (min(seen[m]), str(m))):
            share = [sum(a == b for a, b in zip(t["tokens"], m)) for t in templates]
            best = max(range(len(share)), key=lambda i: (share[i], -i), default=None)
            if best is not None and share[best] >= alike * len(m):
                t = templates[best]
                t["tokens"] = tuple(a if a == b else None for a, b in zip(t["tokens"], m))
            else:
                templates.append(t := {"tokens": m, "docs": set(), "lines": []})
            t["docs"] |= seen[m]
            t["lines"].append(m)
        for t in templates:
            if len(t["docs"]) >= min_docs:
                drop |= {m: min(t["docs"]) for m in t["lines"]}
    out = []
    for d, t in docs:
        lines = t.split("\n")
        kept = [x for x in lines if not (mask(x) in drop and drop[mask(x)] < d)]
        out.append((d, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def test_against_plain(spark):
    rng = random.Random(8)
    boiler = ["All rights reserved", "user {} logged in from {}", "Page {} of {} – über", "© 2024", "one"]
    rows = []
    for d in range(120):
        lines = []
        for _ in range(rng.randint(0, 12)):
            k = rng.random()
            if k < 0.3:
                lines.append(rng.choice(boiler).format(rng.randint(1, 999), rng.randint(1, 999)))
            elif k < 0.4:
                lines.append(rng.choice(["", "  ", "\t"]))
            else:
                lines.append(" ".join(f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(rng.randint(1, 9))))
        rows.append((d, "\n".join(lines)))
    rows += [(500, None), (501, ""), (None, "All rights reserved"), (3, "All rights reserved"), (502, rows[5][1]), (503, rows[5][1] + "\r\nall the same\x00")]
    df = spark.createDataFrame([(*r, 3, "b") for r in rows], "doc_id long, text string, block int, bucket string")
    got = sorted(((1 << 63) - 1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in line_dedup(df, block_bytes=500, least_blocks=5).collect())
    assert got == plain(rows)
    assert sum(r[2] for r in got) > 100


def test_crowded_leaf_of_one_template(spark):
    rows = [(d, "\n".join(f"event at site number {'abcdefghij'[d % 10]}{'klmnopqrst'[i]} was closed by the operator\nline of its own {d} " + "x" * d for i in range(4))) for d in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    small = {r.doc_id: (r.n_removed, r.kept_sha256) for r in line_dedup(df, least_blocks=4, crowd=5).collect()}
    large = {r.doc_id: (r.n_removed, r.kept_sha256) for r in line_dedup(df, least_blocks=4).collect()}
    assert small == large and all(n >= 4 for d, (n, _) in small.items() if d)
    assert line_dedup(df.limit(0)).count() == 0


def test_crowded_leaf_of_many_templates(spark):
    """One leaf of over 256 lines in a block, whose templates depend on the order of all its lines."""
    rng = random.Random(3)
    base = [[f"{a}{b}" for b in "klmnopq"] for a in "abcdefgh"]
    rows = []
    for d in range(1400):
        words = list(rng.choice(base))
        for k in rng.sample(range(7), rng.randint(0, 4)):
            words[k] = "x" + rng.choice("abcd") + rng.choice("abcd") if k < 5 else str(d)
        rows.append((d, "all the same " + " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = plain(rows)
    for crowd in (5, 256):
        got = sorted((r.doc_id, r.n_lines, r.n_removed, r.kept_sha256) for r in line_dedup(df, least_blocks=3, crowd=crowd).collect())
        assert got == want
    assert 100 < sum(r[2] for r in want) < 1400


def test_lines_of_fields_alone_are_compared_whole(spark):
    numbers = ["1.5 20 3", "2019 7 31", "a1 b2 c3", "4 5 6", "2019 7 31 4 5 6 7 8 9 1", "2019 7 31 4 5 6 7 8 9 2", "2019 7 31 4 5 6 7 8 9 3"]
    words = [f"{i} {w}" for i, w in enumerate("one two three four".split())] + [f"1 2 3 {w}" for w in "one two three four".split()]
    rows = [(i, t) for i, t in enumerate(numbers + words)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in line_dedup(df, least_blocks=2).collect() if r.n_removed} == set()
    again = [(100 + i, f"7 8\nown {'abc'[i]}") for i in range(3)] + [(200 + i, f"{i} 2 3 total") for i in range(3)]
    df = spark.createDataFrame(rows + again, "doc_id long, text string")
    assert {r.doc_id for r in line_dedup(df, least_blocks=2).collect() if r.n_removed} == {101, 102, 201, 202}
