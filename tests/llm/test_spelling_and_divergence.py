"""Spelling variants and source divergence against brute force."""

import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lodestone.llm import spelling_variants as sv
from lodestone.llm.source_divergence import divergence

DIR = "/root/testdata/sf0.001"
COLUMNS = "doc_id long, text string, lang string, source string"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_variants(rows):
    n = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(AZ)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += len(run) >= 7
    n = {w: k for w, k in n.items() if k >= 2}
    holes, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            holes[w[:i], w[i + 1 :]].add(w)
            if w[:i] + w[i + 1 :] in n:
                near[w].add(w[:i] + w[i + 1 :])
                near[w[:i] + w[i + 1 :]].add(w)
    for group in holes.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def variants(df, **k):
    return {tuple(r) for r in sv.spelling_variants(df, **k).select("word", "form", "root", "n", "n_near", "form_n").collect()}


def test_variants_of_the_corpus(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    want = plain_variants([(r.doc_id, r.text) for r in docs.collect()])
    assert variants(docs) == want and len(want) > 1000 and sum(x[4] for x in want) > 500


def test_crowded_segments_and_chains(spark):
    """Words that share halves are parted further, whatever the size at which that begins; forms are followed to the last."""
    import itertools

    words = ["prefixed" + "".join(x) for x in itertools.product("abc", repeat=4)] + ["".join(x) + "suffixed" for x in itertools.product("abç", repeat=3)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "aaabaaa"]
    rows = [(i, " ".join(words[i::3]), None, None) for i in range(3)] * 3
    rows += [(50 + i, "chainxy " * 400 + "chainxz " * 40 + "chainwz " * 4 + "chainwzz wordÀword WORDàword WORDÀWORD", None, None) for i in range(2)]
    rows += [(None, None, None, None), (9, "", None, None), (10, "x" * 50_000 + " " + "x" * 50_001, None, None), (10, "x" * 50_000 + " " + "x" * 50_001, None, None)]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("word", F.lit(1)).withColumn("n", F.lit(2))
    want = plain_variants([r[:2] for r in rows])
    assert any(w == "chainwz" and root == "chainxy" for w, _, root, *_ in want)
    assert variants(df) == want
    assert variants(df, crowd=5, shard_rows=50) == want
    assert variants(df.limit(0)) == set()


def plain_divergence(rows):
    terms = [(r[2] or "", r[3] or "", re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (r[1] or "").translate(AZ))) for r in rows]
    df = Counter((lang, t) for lang, _, ts in terms for t in set(ts))
    kept = defaultdict(list)
    for (lang, t), d in df.items():
        if d >= 10:
            kept[lang].append(t)
    n, groups = defaultdict(Counter), {(lang, s) for lang, s, _ in terms}
    for lang, s, ts in terms:
        for t in ts:
            if df[lang, t] >= 10:
                n[lang, s][t] += 1
                n[lang][t] += 1

    def prices(key, lang):
        total = sum(n[key].values())
        return {t: 1 + 10**9 * (n[key][t] + 2) // (total + 2 * len(kept[lang])) for t in kept[lang]}

    def f(p, q):
        return (p - q) ** 2 // (p + q)

    out = set()
    for lang, s in groups:
        p, q = prices((lang, s), lang), prices(lang, lang)
        pairs = []
        for x, other in groups:
            if x == lang and other != s:
                o = prices((lang, other), lang)
                pairs.append((sum(f(p[t], o[t]) for t in kept[lang]), other))
        own = [(f(p[t], q[t]), t) for t in kept[lang] if n[lang, s][t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", own)):
            ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, s, part, item, v, k) for k, (v, item) in enumerate(ranked, 1) if part == "pair" or k <= 10}
    return out


def test_divergence_of_the_corpus_and_edge_cases(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text", "lang", "source").collect()
    rows = [tuple(r) for r in docs] + [(1, None, None, None), (1, "Ünd 漢字 漢字 a1b 🎉x", None, "s"), (2, "", "zz", None), (3, "alone", "zz", "only")] + [(4, "tie Tie TIE knot 漢字", "yy", f"s{i % 3}") for i in range(12)]
    df = spark.createDataFrame(rows, COLUMNS).withColumn("term", F.lit(1)).withColumn("n", F.lit(2))
    got = [tuple(r) for r in divergence(df).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == plain_divergence(rows)
    assert ("zz", "", "pair", "only", 0, 1) in got
    assert divergence(df.limit(0)).count() == 0


def test_counts_of_terms_are_whole_however_often_they_are_sent(spark, monkeypatch):
    """Terms are summed where texts are read, and go on whenever a task holds many; each part counts once."""
    from lodestone.llm import source_divergence

    monkeypatch.setattr(source_divergence, "HELD", 3)
    texts = ["Ab aB, Äb\u0085x   a-b", "ab ab 12 c", "", "C d\x00E \U0001f600"] * 5
    docs = spark.createDataFrame([("l", f"s{i % 2}", t) for i, t in enumerate(texts)], "lang string, source string, text string")
    n, d = Counter(), Counter()
    for i, t in enumerate(texts):
        terms = ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t)]
        n.update((f"s{i % 2}", x) for x in terms)
        d.update((f"s{i % 2}", x) for x in set(terms))
    out = source_divergence.counted(docs)
    assert {((r.source, r.term), r.n, r.d) for r in out.collect()} == {(x, n[x], d[x]) for x in n}
    assert "MapInArrow" in out._jdf.queryExecution().executedPlan().toString()  # no row for each place of a term
