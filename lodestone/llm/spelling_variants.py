"""Spelling variant grouping: Aho-Corasick automata over the two halves of every word, in shards."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WORD = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RESULT = "word string, n_near long, best_n long, best string"


def lower_ascii(s: Column) -> Column:
    """A-Z in small letters, all else as it is."""
    return F.when(F.octet_length(s) == F.length(s), F.lower(s)).otherwise(F.translate(s, UPPER, LOWER))


def vocabulary(docs: DataFrame, least_length: int, least_n: int, noise: int) -> DataFrame:
    """(word, n): the words of all texts that are long enough and occur often enough, after the deletion that the
    checksum of a document and a run asks for. Runs are counted where they are read before they are shuffled."""
    run = lower_ascii(F.col("run"))
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("run")).where(F.length("run") >= least_length)
    named = runs.select(run.alias("run"), F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run)).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = named.select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _near(word: str, other: str, low: int, high: int) -> bool:
    """Whether exactly one edit parts the two, and the first place where they differ is in low..high-1."""
    if len(word) < len(other):
        word, other = other, word
    i, end = low, len(other)
    while i < end and word[i] == other[i]:
        i += 1
    return i < high and word[i + 1 :] == other[i + (len(word) == len(other)) :]


def _pairs(words: list[str], frame: int, a: int, b: int, most: int = 16):
    """Near pairs of words that share their first `a` and last `b` characters, where the longer has `frame` characters and
    the first difference lies between. Larger groups are halved again, so that not all pairs are looked at."""
    todo = [(words, a, b)]
    while todo:
        words, a, b = todo.pop()
        middle = frame - a - b
        if len(words) <= most or middle <= 1:
            for i, u in enumerate(words):
                for v in words[:i]:
                    if (len(u) == frame or len(v) == frame) and _near(u, v, a, frame - b):
                        yield u, v
            continue
        half = middle // 2
        for first, x, y in ((True, a + half, b), (False, a, b + middle - half)):
            parts = defaultdict(list)
            for w in words:
                parts[w[:x] if first else w[len(w) - y :]].append(w)
            todo.extend((p, x, y) for p in parts.values() if len(p) > 1)


def _grouped(words: set[str], keys: set[tuple[int, str, str]]) -> dict:
    """The words that hold each key's segments in place: one automaton over all segments, every word read through it once."""
    import ahocorasick

    segments = defaultdict(lambda: defaultdict(list))
    for frame, a, b in keys:
        first = len(a) >= len(b)
        segments[a if first else b][first, frame].append((a, b))
    automaton = ahocorasick.Automaton()
    for s, held in segments.items():
        automaton.add_word(s, (len(s), held))
    automaton.make_automaton()
    out = defaultdict(list)
    for w in words:
        n = len(w)
        for end, (size, held) in automaton.iter(w):
            for first, fits in ((True, end + 1 == size), (False, end + 1 == n)):
                for frame in (n, n + 1) if fits else ():
                    for a, b in held.get((first, frame), ()):
                        if len(a) + len(b) <= n and w.startswith(a) and w.endswith(b):
                            out[frame, a, b].append(w)
    return out


def near_words(vocab: DataFrame, shard_rows: int = 40_000, crowd: int = 20_000) -> DataFrame:
    """(word, n_near, best_n, best) of words that have a near word. vocab: word, n, each word once.

    A pair's longer word has `frame` characters, so a word joins the frames of its length and of one more. In a frame
    the edit leaves the first half or the last one whole: a word is sent to the shards of these two segments. A segment that
    more than `crowd` words share is no key: they go by it and either half of what lies between, as often as needed.
    """
    import pyarrow as pa

    n, frame, a, b = F.length("word"), F.col("frame"), F.col("a"), F.col("b")
    spark = vocab.sparkSession

    def keyed(rows: DataFrame) -> DataFrame:
        """Either half of the middle joins what is shared already."""
        half = F.floor((frame - a - b) / 2).cast("int")
        sides = F.array(F.struct((a + half).alias("a"), b.alias("b")), F.struct(a.alias("a"), (frame - a - half).alias("b")))
        out = rows.withColumn("side", F.explode(sides)).select("word", "n", "frame", F.col("side.a").alias("a"), F.col("side.b").alias("b"))
        return out.withColumn("key", F.xxhash64("frame", F.substring(F.col("word"), F.lit(1), a), F.lit("\0"), F.substring(F.col("word"), n - b + 1, b)))

    whole = vocab.select("word", "n", F.explode(F.array(n, n + 1)).alias("frame"), F.lit(0).alias("a"), F.lit(0).alias("b"))
    level, parts = keyed(whole), []
    while True:
        crowded = common.cut(level.groupBy("key").count().where((F.col("count") > crowd)).select("key"))
        if crowded.isEmpty():
            break
        splits = (frame - a - b) > 1
        parts.append(level.join(crowded, "key", "left_anti").unionByName(level.join(crowded, "key", "left_semi").where(~splits)))
        level = common.cut(keyed(level.join(crowded, "key", "left_semi").where(splits)))
    for p in parts:
        level = level.unionByName(p)
    shards = max(spark.sparkContext.defaultParallelism, -(-vocab.count() * 4 // shard_rows))

    def scan(table):
        columns = [table.column(c).to_pylist() for c in ("word", "n", "frame", "a", "b")]
        counts = dict(zip(columns[0], columns[1], strict=True))
        keys = {(f, w[:x], w[len(w) - y :]) for w, _, f, x, y in zip(*columns, strict=True)}
        near, best = defaultdict(int), {}
        for (f, x, y), words in _grouped(set(counts), keys).items():
            for u, v in _pairs(words, f, len(x), len(y)):
                for w, o in ((u, v), (v, u)):
                    near[w] += 1
                    place = (-counts[o], o)
                    if w not in best or place < best[w]:
                        best[w] = place
        rows = list(near)
        return pa.table({
            "word": pa.array(rows, pa.string()), "n_near": pa.array([near[w] for w in rows], pa.int64()),
            "best_n": pa.array([-best[w][0] for w in rows], pa.int64()), "best": pa.array([best[w][1] for w in rows], pa.string()),
        })

    sent = level.select(F.pmod("key", F.lit(shards)).cast("int").alias("shard"), "word", "n", "frame", "a", "b").repartition(shards, "shard")
    found = sent.groupBy("shard").applyInArrow(scan, RESULT)
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.max("best_n").alias("best_n"), F.min_by("best", F.struct(-F.col("best_n"), F.col("best"))).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows of (word, form): forms are followed to the last. Each round doubles the steps taken, and counts
    grow along a chain, so that a few rounds do."""
    reached = common.cut(forms.select("word", F.col("form").alias("root")))
    while True:
        step = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = common.cut(reached.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if further.where("moved").isEmpty():
            return further.select("word", "root")
        reached = further.select("word", "root")


def spelling_variants(docs: DataFrame, least_length: int = 7, least_n: int = 2, times: int = 10, noise: int = 31, shard_rows: int = 40_000, crowd: int = 20_000) -> DataFrame:
    """One row for each word: word, form, root, n, n_near, form_n.

    Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z in small letters; where `noise` divides the crc32 of
    `<doc_id>:<run>` the run loses the character at that checksum modulo its length. Words of at least `least_length`
    characters that occur `least_n` times stay. Two are near if one inserted, deleted or replaced character parts them;
    form is the most frequent near word (ties: the smallest), if it is `times` as frequent; root follows forms to the last.

    A null text has no words, a null id counts as an empty one, rows that repeat an id or text count each; other columns
    are ignored. An empty table has no rows. A very long run is one word.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    vocab = common.cut(vocabulary(rows, least_length, least_n, noise))
    near = near_words(vocab, shard_rows, crowd)
    holds = F.col("best_n") >= F.col("n") * times
    out = common.cut(
        vocab.join(near, "word", "left").select(
            "word", F.when(holds, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(holds, F.col("best_n")).alias("form_n")
        )
    )
    return out.join(roots(out.where(F.col("form").isNotNull())), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
