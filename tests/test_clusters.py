"""Clusters of reports against union-find; hubs tie nothing."""

import random
from collections import defaultdict

from lodestone.operators import clusters


def plain(docs, found, most):
    own, root = defaultdict(set), {d: d for d in docs}
    for d, t, v in found:
        if d is not None and v is not None:
            own[t, v].add(d)

    def up(x):
        while root[x] != x:
            x = root[x]
        return x

    n, weight = defaultdict(int), defaultdict(float)
    for held in own.values():
        if 1 < len(held) <= most:
            for d in held:
                n[d] += 1
                weight[d] += 1 / (len(held) - 1)
                a, b = sorted((up(d), up(min(held))))
                root[b] = a
    return {(d, up(d), n[d], round(weight[d], 6)) for d in docs}


def test_clusters(spark):
    rng = random.Random(12)
    docs = list(range(-5, 300))
    found = [(rng.choice(docs), rng.choice("ab"), f"v{rng.randint(0, 400)}") for _ in range(420)] + [(d, "a", "hub") for d in docs] + [(None, "a", "v1"), (3, "a", None)]
    found += [(d, "chain", f"c{d // 2}") for d in range(200, 260)] + [(d, "chain", f"d{(d + 1) // 2}") for d in range(200, 260)] + found[:50]
    frame = spark.createDataFrame(found, "doc_id long, type string, normalized string")
    rows = spark.createDataFrame([(d,) for d in [*docs, docs[0], None]], "doc_id long")
    for most in (3, 20):
        got = [tuple(r) for r in clusters.report_clusters(rows, frame, most).collect()]
        want = plain(docs, found, most)
        assert len(got) == len(docs) and {r[:3] for r in got} == {r[:3] for r in want}
        assert all(abs(a[3] - b[3]) < 2e-6 for a, b in zip(sorted(got), sorted(want), strict=True))
    assert [(r.normalized, r.n_reports) for r in clusters.ties(frame, 20)[1].collect()] == [("hub", len(docs))]
    alone = clusters.report_clusters(rows, frame.limit(0))
    assert alone.where("cluster = doc_id AND n_ties = 0").count() == len(docs)
