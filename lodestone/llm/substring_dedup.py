"""Substring dedup: Rabin-Karp hashes of every window of 13 words, counted over all documents."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


class _Block:
    """A block's documents in the order of their ids, and the Rabin-Karp hash of every window of their words."""

    def __init__(self, table, span: int):
        ids = table.column("doc_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        texts = common.utf8(table.column("text"))
        self.ids, self.texts, self.span = ids[order], [texts[i] for i in order], span
        self.words, self.before = common.words(self.texts)
        doc = np.repeat(np.arange(len(texts)), np.diff(self.before))
        first = np.arange(max(0, len(self.words) - span + 1))
        self.first = first[doc[: len(first)] == doc[len(doc) - len(first) :]]
        self.doc = doc[self.first]
        self.hash = common.Rolling(self.words).of(self.first, self.first + span)
        order = np.argsort(self.hash, kind="stable")
        ranked = self.hash[order]
        new = np.ones(len(order), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        self.place = np.empty(len(order), np.int64)
        self.place[order] = np.cumsum(new) - 1
        self.distinct, self.earliest = ranked[new], order[new]

    def cut(self, h: np.ndarray, n: int) -> np.ndarray:
        """Where each bucket begins among hashes in order."""
        return np.searchsorted(common.bucket_of(h, n), np.arange(n + 1))

    def several(self) -> np.ndarray:
        """Of each distinct hash whether documents of different ids have it here."""
        out = np.zeros(len(self.distinct), bool)
        out[self.place[self.ids[self.doc] != self.ids[self.doc[self.earliest]][self.place]]] = True
        return out

    def compared(self, twice: np.ndarray):
        """Of windows whose hash occurs twice: which they are, the distinct ones by a digest of their bytes (BLAKE2, 128 bits
        in two halves), the first window of each, and of every such window its place among the distinct ones."""
        some = np.flatnonzero(twice[self.place])
        split = [w for t in self.texts for w in t.split()]
        end = np.cumsum(np.fromiter((len(w) + 1 for w in split), np.int64, len(split))) - 1
        data, first = b" ".join(split), self.first[some]
        starts, stops = np.concatenate([[0], end + 1])[first].tolist(), end[first + self.span - 1].tolist()
        digest = b"".join([hashlib.blake2b(data[i:j], digest_size=16).digest() for i, j in zip(starts, stops, strict=True)])
        high, low = np.frombuffer(digest, "<u8").reshape(-1, 2).T
        order = np.lexsort((low, high))
        h, g = high[order], low[order]
        new = np.ones(len(order), bool)
        new[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        return some, h[new], g[new], some[order[new]], place


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows in the order of their keys, where each run of equal keys begins, and the runs' lengths."""
    order = np.lexsort(keys)
    new = np.ones(len(order), bool)
    new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    run = np.flatnonzero(new)
    return order, run, np.diff(run, append=len(order))


def substring_dedup(docs: DataFrame, span: int = 13, block_bytes: int = 4 << 20, least_blocks: int = 48) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, n_spans, kept_text.

    Words are runs of anything but ASCII white space. A word goes if a window of `span` words covers it whose
    words also start in a document with a smaller id; windows are judged on the input. n_spans counts maximal
    removed runs. A null or empty text has no words and an empty kept text; rows that repeat an id are judged
    each, and never against each other; a null id counts as the largest. Extra columns are ignored.

    Documents are hashed to blocks by id and text, so rows without an id, or with the same one, are spread too; a text is
    never split, so one beyond `block_bytes` is a block of its own. A block sends each distinct window hash once to the bucket of the hash, so a window
    held by a third of all documents sends one hash from each block, and buckets count in how many documents it
    occurs. Only windows that occur twice are sent again, as a digest of their bytes with the smallest id that has them in
    the block; buckets answer a bit for each, whether a smaller id has the same window elsewhere. Windows count as equal
    if BLAKE2 gives them the same 128 bits, so words whose 64-bit hashes collide are told apart.
    """
    import pyarrow as pa

    dealt, n_blocks = common.in_blocks(common.documents(docs), block_bytes, least_blocks, apart=True)
    n_buckets = -(-n_blocks // 4)

    def message(table, cut, **columns):
        full = [b for b in range(n_buckets) if cut[b] < cut[b + 1]]
        return pa.table({
            "bucket": pa.array(full, pa.int32()),
            "block": pa.array([table.column("block")[0].as_py()] * len(full) if full else [], pa.int32()),
            "sent": pa.array([common.pack(*(np.diff(v[cut[b] : cut[b + 1]], prepend=v.dtype.type(0)) if k == "hash" else v[cut[b] : cut[b + 1]] for k, v in columns.items())) for b in full], pa.binary()),
        })

    def answers(table, got, bit):
        cut = np.cumsum([0] + [len(g[0]) for g in got])
        return pa.table({
            "block": table.column("block"),
            "bucket": table.column("bucket"),
            "bits": pa.array([np.packbits(bit[cut[i] : cut[i + 1]]).tobytes() for i in range(len(got))], pa.binary()),
        })

    def answered(block, table, h, later):
        out = np.zeros(len(h), bool)
        cut = block.cut(h, n_buckets)
        for b, bits, own in zip(*(table.column(c).to_pylist() for c in ("bucket", "bits", "later")), strict=True):
            if own == later:
                out[cut[b] : cut[b + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=cut[b + 1] - cut[b])
        return out

    def send(table):
        block = _Block(table, span)
        return message(table, block.cut(block.distinct, n_buckets), hash=block.distinct, several=block.several())

    def count(table):
        got = [common.unpack(x, 2) for x in table.column("sent").to_pylist()]
        order, run, n = _runs(np.concatenate([np.cumsum(g[0]) for g in got]))
        twice = np.empty(len(order), bool)
        twice[order] = np.repeat((n > 1) | (np.add.reduceat(np.concatenate([g[1] for g in got])[order], run) > 0), n)
        return answers(table, got, twice)

    def send_again(left, right):
        block = _Block(left, span)
        _, h, other, first, _ = block.compared(answered(block, right, block.distinct, False))
        return message(left, block.cut(h, n_buckets), hash=h, other=other, doc=block.ids[block.doc[first]])

    def judge(table):
        got = [common.unpack(x, 3) for x in table.column("sent").to_pylist()]
        doc = np.concatenate([g[2].view(np.int64) for g in got])
        order, run, n = _runs(np.concatenate([g[1] for g in got]), np.concatenate([np.cumsum(g[0]) for g in got]))
        later = np.empty(len(doc), bool)
        later[order] = np.repeat(np.minimum.reduceat(doc[order], run), n) < doc[order]
        return answers(table, got, later)

    def apply(left, right):
        block = _Block(left, span)
        ids, texts, before = block.ids, block.texts, block.before
        some, h, _, first, place = block.compared(answered(block, right, block.distinct, False))
        later = answered(block, right, h, True)
        own = ids[block.doc]
        goes = block.first[some[later[place] | (own[some] > own[first][place])]]
        depth = np.zeros(before[-1] + 1, np.int32)
        depth += np.bincount(goes, minlength=len(depth)).astype(np.int32)
        depth -= np.bincount(goes + span, minlength=len(depth)).astype(np.int32)
        removed = np.cumsum(depth)[:-1] > 0
        kept, n_removed, n_spans = [], [], []
        for t, i, j in zip(texts, before[:-1], before[1:], strict=True):
            w, r = t.split(), removed[i:j]
            n_removed.append(int(r.sum()))
            n_spans.append(int(r[0]) + int((r[1:] & ~r[:-1]).sum()) if len(r) else 0)
            kept.append(b" ".join([x for x, gone in zip(w, r.tolist(), strict=True) if not gone] if n_removed[-1] else w))
        return pa.table({
            "doc_id": pa.array(ids),
            "n_words": pa.array(np.diff(before).astype(np.int64)),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
            "n_spans": pa.array(n_spans, pa.int64()),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
        })

    sent, answer = "bucket int, block int, sent binary", "block int, bucket int, bits binary"
    counted = dealt.groupBy("block").applyInArrow(send, sent).repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(count, answer).withColumn("later", F.lit(False))
    again = dealt.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(send_again, sent)
    judged = again.repartition(n_buckets, "bucket").groupBy("bucket").applyInArrow(judge, answer).withColumn("later", F.lit(True))
    return (
        dealt.groupBy("block")
        .cogroup(counted.unionByName(judged).groupBy("block"))
        .applyInArrow(apply, "doc_id long, n_words long, n_removed long, kept_sha256 string, n_spans long, kept_text string")
        .withColumn("doc_id", common.own_id())
    )
