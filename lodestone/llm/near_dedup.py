"""MinHash near-dedup: Order MinHash sketches of word 5-mers, candidates verified by banded alignment."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_POS = np.uint64((1 << 24) - 1)
K = 5  #: words of a k-mer


def kmers(words: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's k-mers in text order, and the number before each text. A text of fewer words is one k-mer."""
    n = np.diff(before)
    count = np.where(n >= K, n - K + 1, (n > 0).astype(np.int64))
    cut = np.concatenate([[0], np.cumsum(count)])
    start = np.arange(cut[-1]) - np.repeat(cut[:-1], count) + np.repeat(before[:-1], count)
    return common.Rolling(words).of(start, start + np.repeat(np.minimum(n, K), count)), cut


def labelled(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Each k-mer with the number of times it has occurred in its text so far, as one hash."""
    order = np.lexsort((h, text))
    new = np.ones(len(h), bool)
    new[1:] = (h[order][1:] != h[order][:-1]) | (text[order][1:] != text[order][:-1])
    place = np.arange(len(h))
    nth = np.empty(len(h), np.uint64)
    nth[order] = place - np.maximum.accumulate(np.where(new, place, 0))
    return common.mix(h + nth * np.uint64(0xD6E8FEB86659FD93))


def sketches(h: np.ndarray, cut: np.ndarray, sketch: int, least: int) -> np.ndarray:
    """Order MinHash: a row of `sketch` keys for each text with k-mers. A key holds the `least` smallest labelled k-mers
    under its own hash function, in the order in which they stand in the text."""
    count = np.diff(cut)
    full = np.flatnonzero(count > 0)
    begin, count = cut[:-1][full], count[full]
    text = np.repeat(np.arange(len(full)), count)
    label = labelled(h, text)
    pos = np.minimum(np.arange(len(h)) - np.repeat(begin, count), int(_POS)).astype(np.uint64)
    out = np.zeros((len(full), sketch), np.uint64)
    seeds = common.mix(np.arange(1, sketch + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))
    for s, seed in enumerate(seeds):
        v = common.mix(label ^ seed) & ~_POS | pos
        found = np.zeros((least, len(full)), np.uint64)
        for i in range(least):
            found[i] = np.minimum.reduceat(v, begin)
            v[v == np.repeat(found[i], count)] = ~np.uint64(0)
        found = np.take_along_axis(found, np.argsort(found & _POS, axis=0), 0) & ~_POS
        key = np.full(len(full), s, np.uint64)
        for f in found:
            key = common.mix(key * np.uint64(3) + f)
        out[:, s] = key
    return out


def classed(keys: np.ndarray, count: np.ndarray, threshold: float) -> np.ndarray:
    """Each key with two neighbouring length classes. Texts at the threshold or above have numbers of k-mers within its
    ratio, so they are in one class or in neighbouring ones, and share a class."""
    low = np.floor(np.log(count) / -np.log(threshold) + 1e-9).astype(np.uint64)[:, None]
    return np.concatenate([common.mix(keys + (low + np.uint64(i)) * np.uint64(0x9FB21C651E98DF25)) for i in (0, 1)], 1)


def align(a: np.ndarray, b: np.ndarray, most: int) -> tuple[int, int] | None:
    """(edits, matched k-mers) along an alignment of fewest word edits, or None if it needs over `most`.

    Works edit by edit on the diagonals within `most` of the main one, always as far as words agree, and keeps for each
    diagonal only how far it has come and what it has matched: memory is the band.
    """
    la, lb = len(a), len(b)
    if abs(la - lb) > most:
        return None

    def slide(v: np.ndarray, k: np.ndarray) -> np.ndarray:
        """Each diagonal's place, moved on while words agree, with the k-mers of the run."""
        begin = v >> 32
        i = begin.copy()
        on = np.flatnonzero((i >= 0) & (i < la) & (i + k < lb) & (i + k >= 0))
        for _ in range(16):
            if not len(on):
                break
            on = on[a[i[on]] == b[i[on] + k[on]]]
            i[on] += 1
            on = on[(i[on] < la) & (i[on] + k[on] < lb)]
        for x in on.tolist():
            p, d, width = int(i[x]), int(k[x]), 64
            while p < la and p + d < lb:
                n = min(width, la - p, lb - d - p)
                unequal = a[p : p + n] != b[p + d : p + d + n]
                if unequal.any():
                    p += int(unequal.argmax())
                    break
                p, width = p + n, width * 2
            i[x] = p
        return v + ((i - begin) << 32) + np.maximum(i - begin - K + 1, 0)

    none = np.int64(-1) << 60
    low, v = 0, slide(np.zeros(1, np.int64), np.zeros(1, np.int64))
    for d in range(most + 1):
        if d:
            k = np.arange(max(-d, -la), min(d, lb) + 1)
            old = np.full(len(v) + 4, none)
            old[2:-2] = v
            at = k - low + 2
            step = np.int64(1) << 32
            steps = np.stack([old[at] + step, old[np.minimum(at + 1, len(old) - 1)] + step, old[np.maximum(at - 1, 0)]])
            ends = steps >> 32
            steps[(ends > la) | (ends + k > lb)] = none
            low, v = int(k[0]), slide(steps.max(0), k)
        x = lb - la - low
        if 0 <= x < len(v) and v[x] >> 32 >= la:
            return d, int(v[x] & 0xFFFFFFFF)
    return None


class Text:
    """A text ready to be compared."""

    def __init__(self, text: bytes):
        self.bytes = text
        self.words, _ = common.words([text])
        h, _ = kmers(self.words, np.array([0, len(self.words)]))
        self.kmers = np.sort(labelled(h, np.zeros(len(h), np.int64)))


def jaccard(a: Text, b: Text) -> float:
    """Similarity of the texts' labelled k-mers; one minus it is a metric."""
    if not len(a.kmers) or not len(b.kmers):
        return float(len(a.kmers) == len(b.kmers))
    both = np.sort(np.concatenate([a.kmers, b.kmers]))
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def linked(a: Text, b: Text, threshold: float) -> bool:
    """Whether an alignment of fewest edits matches k-mers to the threshold. Only called if all k-mers reach it.

    Words are compared as they are: equal hashes make texts more alike, never less, so they only propose pairs.
    """
    n = len(a.kmers) + len(b.kmers)
    number: dict[bytes, int] = {}
    one, other = (np.array([number.setdefault(w, len(number)) for w in t.bytes.split()], np.int64) for t in (a, b))
    if min(len(one), len(other)) < K:
        return np.array_equal(one, other)
    # of all k-mers at most this many are unmatched at the threshold, and a word edit leaves one at least
    found = align(one, other, n - 2 * int(threshold / (1 + threshold) * n) + 2 * K)
    return found is not None and found[1] >= (threshold - 1e-9) * (n - found[1])


def _slices(batch, size: int = 2 << 20):
    """(ids, texts) of parts of an Arrow batch of about `size` bytes."""
    ids, column = batch.column("doc_id"), batch.column("text")
    i = 0
    while i < batch.num_rows:
        part, held = [], 0
        while i + len(part) < batch.num_rows and held < size:
            part.append(column[i + len(part)].as_buffer().to_pybytes())
            held += len(part[-1])
        yield ids.slice(i, len(part)), part
        i += len(part)


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(b" ".join(text.split()), digest_size=16).digest()


def components(edges: DataFrame) -> DataFrame:
    """(node, label): one node of each component of the edges (a, b) as the label of all its nodes.

    Every node points to its least neighbour if that is smaller, and on to what this one points to. Then pointed-to
    nodes stand for the others, and only edges between different ones go on. At most half of the nodes remain each
    time, so there are few rounds and later ones are small.
    """
    both = common.cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = None
    while True:
        up = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("up"))
        up = common.cut(up.join(up.select(F.col("node").alias("up"), F.col("up").alias("next")), "up").select("node", F.col("next").alias("up")))
        if labels is None:
            labels = up.select("node", F.col("up").alias("label"))
        else:
            moved = up.select(F.col("node").alias("label"), "up")
            labels = common.cut(labels.join(moved, "label", "left").select("node", F.coalesce("up", "label").alias("label")))
        ends = both.join(up.select(F.col("node").alias("a"), F.col("up").alias("x")), "a").join(up.select(F.col("node").alias("b"), F.col("up").alias("y")), "b")
        both = common.cut(ends.where(F.col("x") != F.col("y")).select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
        if not both.limit(1).count():
            return labels


def near_dedup(docs: DataFrame, threshold: float = 0.8, sketch: int = 16, least: int = 3, family: int = 1_000_000) -> DataFrame:
    """One row per document: doc_id, class_id, kept, text_sha256 (of the text as it is).

    Two texts are linked if the Jaccard similarity of their word 5-mers, counted as far as an alignment matches them, is
    `threshold` or more; words are what white space separates. Classes are what links connect; class_id is the smallest
    id in the class and kept says whether the row has it. Texts of equal words are one text: null, empty and blank ones
    too. Rows that repeat an id are judged each; a null id counts as the largest; extra columns are ignored.

    Only texts that share a sketch key are compared, whatever the size of their group. A pair at similarity s shares one
    with probability near 1 - (1 - s**least)**sketch: 0.99999 at 0.8. Texts that keys connect form a family. One with up
    to `family` k-mers is solved in one task, where k-mers that only one text has bound what it can share: few texts
    remain to be compared, and none that others connect already. Larger ones are dealt key by key. Of a key with more
    than `family` k-mers all texts are verified against hubs among them. A text that is linked to a hub leaves the key,
    unless it is so far from the hub that it may match one that isn't linked (distances obey the triangle inequality);
    hubs leave too, and the rest meets again, with four times as many hubs, so rounds grow with the logarithm of a key's
    texts. `family` says how the work is dealt and changes no class. The similarity of all k-mers decides first;
    alignment can only confirm it.
    """
    import pyarrow as pa
    import zstandard

    rows = common.documents(docs)

    def sign(batches):
        for b in batches:
            for ids, texts in _slices(b):
                words, before = common.words(texts)
                h, cut = kmers(words, before)
                count = np.diff(cut)
                full = (count > 0).tolist()
                keys = iter(classed(sketches(h, cut, sketch, least), count[count > 0], threshold).view(np.int64).tolist() if len(h) else [])
                yield pa.RecordBatch.from_arrays([ids, pa.array([_digest(t) for t in texts], pa.binary()), pa.array([next(keys) if f else [] for f in full], pa.list_(pa.int64())), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()), pa.array(count, pa.int64())], names=["doc_id", "node", "keys", "sha", "size"])

    def pack(batches):
        for b in batches:
            for ids, texts in _slices(b):
                yield pa.RecordBatch.from_arrays([ids, pa.array([_digest(t) for t in texts], pa.binary()), pa.array([zstandard.compress(b" ".join(t.split()), 3) for t in texts], pa.binary())], names=["doc_id", "node", "packed"])

    def verify(batches):
        for b in batches:
            distance, link = [], []
            for left, right in zip(b.column("left").to_pylist(), b.column("right").to_pylist(), strict=True):
                one, other = Text(zstandard.decompress(left)), Text(zstandard.decompress(right))
                distance.append(1 - jaccard(one, other))
                link.append(distance[-1] <= far and linked(one, other, threshold))
            yield pa.RecordBatch.from_arrays([b.column("node"), b.column("hub"), pa.array(distance, pa.float64()), pa.array(link, pa.bool_())], names=["node", "hub", "distance", "link"])

    def solve(table):
        """Edges from each text of a family to the least one that links connect it to.

        A text's k-mers that no other one has can't be shared, so its other k-mers bound every overlap. Two texts are
        compared only if they share a key, that bound and their sizes allow the threshold and nothing connects them yet.
        """
        common.trim()
        rows = sorted(zip(*(table.column(c).to_pylist() for c in ("rep", "node", "packed", "keys")), strict=True))
        held = [set(r[3]) for r in rows]
        texts = [Text(zstandard.decompress(r[2])) for r in rows]
        n = np.array([len(t.kmers) for t in texts])
        every = np.concatenate([t.kmers for t in texts])
        order = np.argsort(every, kind="stable")
        ranked, shared = every[order], np.zeros(len(every), bool)
        same = ranked[1:] == ranked[:-1]
        shared[order[1:]] |= same
        shared[order[:-1]] |= same
        common_kmers = np.add.reduceat(shared, np.cumsum(n) - n).astype(np.int64)
        least = threshold / (1 + threshold)
        turn = np.argsort(-common_kmers, kind="stable")
        group = np.arange(len(rows))
        for k in range(1, len(turn)):
            i, before = turn[k], turn[:k]
            if common_kmers[i] < threshold * n[i] - 1e-9:
                continue
            overlap = np.minimum(common_kmers[before], common_kmers[i])
            near = before[(overlap >= least * (n[before] + n[i]) - 1e-9) & (group[before] != group[i])]
            while len(near):
                j, near = near[0], near[1:]
                if not held[i].isdisjoint(held[j]) and 1 - jaccard(texts[i], texts[j]) <= far and linked(texts[i], texts[j], threshold):
                    group[group == group[j]] = group[i]
                    near = near[group[near] != group[i]]
        least_node: dict[int, bytes] = {}
        for g, row in zip(group.tolist(), rows, strict=True):
            least_node[g] = min(row[1], least_node.get(g, row[1]))
        star = [(row[1], least_node[g]) for g, row in zip(group.tolist(), rows, strict=True) if row[1] != least_node[g]]
        return pa.table({"a": pa.array([x for x, _ in star], pa.binary()), "b": pa.array([x for _, x in star], pa.binary())})

    far = 1 - threshold + 1e-9
    signed = common.cut(rows.mapInArrow(sign, "doc_id long, node binary, keys array<long>, sha binary, size long"))
    nodes = signed.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("size").alias("size"))
    placed = nodes.select("node", "rep", "size", F.explode(F.array_distinct("keys")).alias("key"))

    def crowded(df: DataFrame, hubs: int) -> tuple[DataFrame, DataFrame]:
        """Rows of keys that more than one text has, with load, the k-mers of all a key's texts; and each key's hubs, up
        to so many: of each part of its texts the one with the most company in all its keys."""
        many = df.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("load")).where("n > 1")
        rows = common.cut(df.select("node", "rep", "size", "key").join(many, "key"))
        company = rows.groupBy("node").agg(F.sum("n").alias("company"))
        part = F.pmod(F.xxhash64("node"), F.lit(hubs)).alias("part")
        first = rows.join(company, "node").groupBy("key", part).agg(F.min(F.struct(-F.col("company"), "rep", "node")).alias("first"))
        return rows.drop("n"), common.cut(first.select("key", F.col("first.node").alias("hub")))

    active, hubs = crowded(placed, 1)
    wanted = active.select("node", "rep").distinct()
    texts = common.cut(rows.mapInArrow(pack, "doc_id long, node binary, packed binary").join(wanted.withColumnRenamed("rep", "doc_id"), ["node", "doc_id"]).groupBy("node").agg(F.first("packed").alias("packed")))
    links = []

    def solved(members: DataFrame, by: str) -> None:
        found = members.join(texts, "node").select(by, "rep", "node", "packed", "keys").groupBy(by).applyInArrow(solve, "a binary, b binary")
        links.append(common.cut(found))

    label = components(active.join(hubs, "key").where(F.col("node") != F.col("hub")).select(F.col("node").alias("a"), F.col("hub").alias("b")))
    held = active.groupBy("node", "rep").agg(F.first("size").alias("size"), F.collect_set("key").alias("keys"))
    load = label.join(held.select("node", "size"), "node").groupBy("label").agg(F.sum("size").alias("load"))
    sized = common.cut(label.join(load, "label").select("node", F.col("label").alias("family"), (F.col("load") <= family).alias("small")))
    solved(held.join(sized.where("small"), "node"), "family")
    active = common.cut(active.join(sized.where(~F.col("small")).select("node"), "node"))
    turn = 1
    while active.limit(1).count():
        solved(active.where(F.col("load") <= family).withColumn("keys", F.array("key")), "key")
        large = active.where(F.col("load") > family)
        met = large.join(hubs, "key").where(F.col("node") != F.col("hub"))
        read = met.select("node", "hub").distinct().join(texts.withColumnRenamed("packed", "left"), "node").join(texts.select(F.col("node").alias("hub"), F.col("packed").alias("right")), "hub")
        found = common.cut(read.select("node", "hub", "left", "right").mapInArrow(verify, "node binary, hub binary, distance double, link boolean"))
        links.append(found.where("link").select(F.col("node").alias("a"), F.col("hub").alias("b")))
        judged = met.select("key", "node", "hub").join(found, ["node", "hub"])
        nearest = judged.where(~F.col("link")).groupBy("key", "hub").agg(F.min("distance").alias("nearest"))
        near = judged.where("link").join(nearest, ["key", "hub"], "left").where(F.col("distance") < F.coalesce("nearest", F.lit(2.0)) - far)
        leaves = near.select("key", "node").unionByName(hubs.select("key", F.col("hub").alias("node"))).distinct()
        turn *= 4
        active, hubs = crowded(large.join(leaves, ["key", "node"], "left_anti"), turn)
    ids = nodes.select("node", "rep")
    joined = links[0]
    for x in links[1:]:
        joined = joined.unionByName(x)
    member = ids.join(components(joined), "node").select("node", "rep", "label")
    own = member.groupBy("label").agg(F.min("rep").alias("class_id"))
    classes = ids.join(member.join(own, "label").select("node", "class_id"), "node", "left").select("node", F.coalesce("class_id", "rep").alias("class_id"))
    return signed.select("doc_id", "node", "sha").join(classes, "node").select(
        common.own_id(), common.own_id("class_id"), (F.col("doc_id") == F.col("class_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )
