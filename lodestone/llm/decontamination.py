"""Benchmark decontamination: CGK random walks, bit-sampling LSH over item-sized windows, exact edit verification."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words are runs of ASCII letters, digits and all bytes of other characters.
_SEPARATOR = np.ones(256, bool)
_SEPARATOR[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def edits_allowed(n, similarity: float):
    """Word edits within which a window still has the similarity to an item of n words."""
    return np.floor(np.asarray(n) * (1 - similarity) + 1e-9).astype(int)


def best_match(item: list, text: list) -> int:
    """The least word edits that turn the item into some run of the text's words (Myers' bit vectors)."""
    masks: dict = {}
    for i, w in enumerate(item):
        masks[w] = masks.get(w, 0) | 1 << i
    n = len(item)
    full, top = (1 << n) - 1, 1 << (n - 1)
    up, down, score = full, 0, n
    best = n
    for w in text:
        eq = masks.get(w, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        ph, mh = down | ~(xh | up) & full, up & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph, mh = ph << 1 & full, mh << 1 & full
        up, down = mh | ~(xv | ph) & full, ph & xv
        if score < best:
            best = score
    return best


class Walks:
    """CGK embeddings: each step copies the word under the cursor and moves on if a random bit of (step, word) says so.

    Strings within few edits meet again after an edit, so their copies agree in most of the 3 n steps. `tables`
    samples of `sampled` steps from each of `repeats` walks are hashed to keys; one equal key retrieves.
    """

    def __init__(self, longest: int, repeats: int, tables: int, sampled: int, seed: int = 11):
        rng = random.Random(seed)
        self.steps = 3 * longest
        self.turns = np.array([[rng.getrandbits(64) | 1 for _ in range(self.steps)] for _ in range(repeats)], np.uint64)
        self.places = np.array([[[rng.random() for _ in range(sampled)] for _ in range(tables)] for _ in range(repeats)])

    def keys(self, words: np.ndarray, length: np.ndarray) -> np.ndarray:
        """A column of keys for each table. words: a row of each window's words, 0 after its end."""
        n = len(words)
        rows = np.arange(n)
        steps = 3 * int(length.max(initial=0))
        out = []
        for turn, place in zip(self.turns, self.places, strict=True):
            copied = np.zeros((n, steps), np.uint64)
            at = np.zeros(n, np.int64)
            for s in range(steps):
                w = words[rows, at]
                copied[:, s] = w
                at = np.minimum(at + (w * turn[s] >> np.uint64(63)).astype(np.int64), words.shape[1] - 1)
            for t, p in enumerate(place):
                key = np.full(n, len(out) + 1, np.uint64)
                for u in p:
                    key = common.mix(key ^ copied[rows, (u * 3 * length).astype(np.int64)]) + np.uint64(t)
                out.append(common.mix(key ^ length.astype(np.uint64)))
        return np.stack(out, 1)


def _alike(size: np.ndarray, cells: int = 1 << 21):
    """Indices in groups of sizes within a factor of two, whose walks hold about `cells` words at once."""
    order = np.argsort(size, kind="stable")
    ordered, i = size[order], 0
    while i < len(order):
        least = int(ordered[i])
        j = min(i + max(1, cells // (3 * least)), int(np.searchsorted(ordered, 2 * least, side="right")))
        yield order[i:j]
        i = j


def _slices(counts: np.ndarray, most: int = 1 << 20) -> list[np.ndarray]:
    """Indices in runs whose counts sum up to about `most`, or a single one with more."""
    part = np.cumsum(counts) // most
    return [x for x in np.split(np.arange(len(counts)), np.flatnonzero(np.diff(part)) + 1) if len(x)]


class Items:
    """Benchmark items ready to be looked for; items of the same words are one. rows: id, text, number of such rows."""

    def __init__(self, rows: list[tuple[int, bytes, int]], similarity: float, repeats: int, tables: int, sampled: int):
        rows = sorted(rows)
        hashes, before = common.words([t for _, t, _ in rows], _SEPARATOR)
        same: dict[bytes, tuple[np.ndarray, list[int]]] = {}
        for (i, t, n), low, high in zip(rows, before[:-1], before[1:], strict=True):
            if high > low:
                same.setdefault(b" ".join(_WORD.findall(t)), (hashes[low:high], []))[1].extend([i] * n)
        self.ids = [ids for _, ids in same.values()]
        self.words = [w for w, _ in same.values()]
        self.raw = [t.split(b" ") for t in same]  # what verifies; hashes only propose
        self.distinct = [frozenset(w) for w in self.raw]
        self.size = np.array([len(w) for w in self.words], np.int64)
        self.edits = edits_allowed(self.size, similarity)
        self.longest = int(self.size.max(initial=0))
        # within the allowed edits some run of this many words stays whole: n - e words in e + 1 runs
        whole = np.maximum(1, np.minimum(3, -(-(self.size - self.edits) // (self.edits + 1))))
        self.seeds = {}
        for q in sorted(set(whole.tolist())):
            own = np.flatnonzero(whole == q).tolist()
            at = [np.arange(self.size[i] - q + 1) for i in own]
            h = np.concatenate([common.Rolling(self.words[i]).of(a, a + q) for i, a in zip(own, at, strict=True)])
            at, size = np.concatenate(at), np.repeat(self.size[own], self.size[own] - q + 1)
            # many items may hold a run at the same place; it asks for one window of each size
            order = np.lexsort((size, at, h))
            h, at, size = h[order], at[order], size[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1]) | (size[1:] != size[:-1])
            self.seeds[q] = (h[new], at[new], size[new])
        self.walks = Walks(self.longest, repeats, tables, sampled)
        keys = np.zeros((len(self.words), repeats * tables), np.uint64)
        for group in _alike(self.size):
            padded = np.zeros((len(group), int(self.size[group].max()) + 1), np.uint64)
            for row, i in zip(padded, group.tolist(), strict=True):
                row[: self.size[i]] = self.words[i]
            keys[group] = self.walks.keys(padded, self.size[group])
        self.tables = []
        for t in range(keys.shape[1]):
            order = np.argsort(keys[:, t], kind="stable")
            self.tables.append((keys[order, t], order))


def _pairs(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of a range, entry in it), all of them."""
    n = high - low
    at = np.repeat(np.arange(len(n)), n)
    return at, np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _windows(hashes: np.ndarray, doc: np.ndarray, before: np.ndarray, items: Items):
    """(start, size) of item-sized windows around runs of words that an item within its edits must leave whole, in parts of
    bounded size. A size belongs to one length of run, so only parts that border on each other repeat a window."""
    for q, (h, at, size) in items.seeds.items():
        if len(hashes) < q:
            continue
        first = np.arange(len(hashes) - q + 1)
        first = first[doc[: len(first)] == doc[q - 1 :]]
        value = common.Rolling(hashes).of(first, first + q)
        low = np.searchsorted(h, value)
        near = np.flatnonzero(h[np.minimum(low, len(h) - 1)] == value)
        low, high = low[near], np.searchsorted(h, value[near], side="right")
        for part in _slices(high - low):
            p, s = _pairs(low[part], high[part])
            p = first[near[part]][p]
            start = np.maximum(p - at[s], before[:-1][doc[p]])
            both = np.unique(start * (items.longest + 1) + size[s])
            yield both // (items.longest + 1), both % (items.longest + 1)


def _retrieved(hashes: np.ndarray, end: np.ndarray, start: np.ndarray, size: np.ndarray, items: Items):
    """(window, item) pairs that share a key of some table, in parts of bounded size. end: of each window's document."""
    for group in _alike(size):
        reach = np.arange(int(size[group].max()) + 1)
        at = start[group][:, None] + reach
        inside = (reach < size[group][:, None]) & (at < end[group][:, None])
        keys = items.walks.keys(np.where(inside, hashes[np.minimum(at, len(hashes) - 1)], np.uint64(0)), size[group])
        low = np.stack([np.searchsorted(table, keys[:, t]) for t, (table, _) in enumerate(items.tables)], 1)
        high = np.stack([np.searchsorted(table, keys[:, t], side="right") for t, (table, _) in enumerate(items.tables)], 1)
        for part in _slices((high - low).sum(1)):
            got = []
            for t, (_, order) in enumerate(items.tables):
                w, i = _pairs(low[part, t], high[part, t])
                got.append(group[part[w]] * len(items.words) + order[i])
            both = np.unique(np.concatenate(got))
            yield from zip((both // len(items.words)).tolist(), (both % len(items.words)).tolist(), strict=True)


def matches(texts: list[bytes], items: Items) -> list[tuple[int, int, int]]:
    """(text, item, least edits) for each text that holds an item within its allowed edits, as the LSH retrieves them."""
    hashes, before = common.words(texts, _SEPARATOR)
    if not items.words or not len(hashes):
        return []
    doc = np.repeat(np.arange(len(texts)), np.diff(before))
    found: dict[tuple[int, int], int] = {}
    split: dict[int, list[bytes]] = {}
    for start, size in _windows(hashes, doc, before, items):
        for w, i in _retrieved(hashes, before[1:][doc[start]], start, size, items):
            d = int(doc[start[w]])
            e, key = int(items.edits[i]), (d, i)
            if found.get(key, e + 1) == 0:
                continue
            low, high = max(int(before[d]), int(start[w]) - e), min(int(before[d + 1]), int(start[w]) + int(items.size[i]) + e)
            if d not in split:
                split[d] = _WORD.findall(texts[d])
            text = split[d][low - int(before[d]) : high - int(before[d])]
            if len(items.distinct[i].difference(text)) > e:
                continue  # each word that the text lacks costs an edit
            edits = best_match(items.raw[i], text)
            if edits <= e and edits < found.get(key, e + 1):
                found[key] = edits
    return [(d, i, e) for (d, i), e in sorted(found.items())]


def decontaminate(docs: DataFrame, benchmark: DataFrame, similarity: float = 0.8, repeats: int = 4, tables: int = 16, sampled: int = 2, item_bytes: int = 8 << 20) -> DataFrame:
    """One row for each document and item it holds: doc_id, item_id, edits, similarity.

    Words are compared in lower case without punctuation. A document holds an item of n words if some run of its
    words is at most (1 - similarity) n word insertions, deletions and replacements away; similarity is
    1 - edits / n. Hashes only propose; the edits are counted between the words themselves. Item-sized windows are taken wherever a run of words stands that the allowed edits must leave
    whole (one in e + 1 parts), so no match is ruled out before the LSH; of windows that match, a key is equal in one
    of repeats * tables tables with probability above 0.99 if a fifth of the steps agree. Nulls and texts or items
    without words give no rows; repeated rows give rows each; null ids are kept; extra columns are ignored.

    Items are a query set that meets all documents in blocks: about `item_bytes` of distinct rows at a time are gathered
    and sent along with one pass over the documents, which are never shuffled. With several blocks each pass is written
    to the shared folder, so that the driver holds one block at a time.
    """
    small = common.documents(benchmark, "item_id").groupBy("doc_id", "text").count()
    size = small.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    n = max(-(-size // item_bytes), 1)
    dealt = small.withColumn("part", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)))
    rows = common.documents(docs)
    out = None
    for k in range(n):
        listed = [(r.doc_id, r.text.lower().encode(), r["count"]) for r in dealt.where(F.col("part") == k).collect()]
        one = rows.mapInArrow(_look(Items(listed, similarity, repeats, tables, sampled)), "doc_id long, item_id long, edits long, similarity double")
        one = common.cut(one) if n > 1 else one
        out = one if out is None else out.unionByName(one)
    return out.withColumn("doc_id", common.own_id()).withColumn("item_id", common.own_id("item_id"))


def _look(items: Items, text_bytes: int = 2 << 20, most: int = 50_000):
    """A pass over Arrow batches of documents: about text_bytes are searched at once, at most `most` rows are held."""
    import pyarrow as pa

    def batch(rows):
        doc, item, edits, similarity = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc, pa.int64()), pa.array(item, pa.int64()), pa.array(edits, pa.int64()), pa.array(similarity, pa.float64())],
            names=["doc_id", "item_id", "edits", "similarity"],
        )

    def look(batches):
        out = []
        for b in batches:
            ids, column, i = b.column("doc_id"), b.column("text"), 0
            while i < b.num_rows:
                part, size = [], 0
                while i + len(part) < b.num_rows and size < text_bytes:
                    part.append(column[i + len(part)].as_py().lower().encode())
                    size += len(part[-1])
                own = ids.slice(i, len(part)).to_pylist()
                for d, j, e in matches(part, items):
                    for item in items.ids[j]:
                        out.append((own[d], item, e, 1 - e / float(items.size[j])))
                        if len(out) == most:
                            yield batch(out)
                            out = []
                i += len(part)
        if out:
            yield batch(out)

    return look
