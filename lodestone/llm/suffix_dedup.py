"""Suffix-array dedup: longest-previous-factor arrays find every byte that an earlier equal string covers."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_CHUNK = 1 << 20
_LOW = np.uint64((1 << 24) - 1)


def suffix_order(buf: np.ndarray, starts: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts' places in suffix order, compared over `cap` bytes with ties in the order given, and for each
    place the common prefix with the place before, of `cap` at most. Each start has `cap` bytes after it."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = np.lib.stride_tricks.sliding_window_view(buf, cap)[starts]
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{cap}").ravel(), kind="stable")
    rows = rows[order]
    equal = rows[1:] == rows[:-1]
    common_prefix = np.where(equal.all(1), cap, equal.argmin(1)) if len(equal) else np.zeros(0, np.int64)
    return order, np.concatenate([[0], common_prefix]).astype(np.int64)


def longest_previous(order: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """The longest-previous-factor array by the previous and next smaller positions in suffix order.

    order[r] is the position at place r (positions are 0..n-1 in text order), prefix[r] what places r-1 and r share.
    """
    out = np.zeros(len(order), np.int64)
    stack: list[tuple[int, int]] = []  # positions that grow upwards, and what each shares with the one below
    for pos, share in zip([*order.tolist(), -1], [*prefix.tolist(), 0], strict=True):
        while stack and stack[-1][0] > pos:
            top, below = stack.pop()
            out[top] = max(below, share)  # the previous smaller position against the next smaller one
            share = min(below, share)
        stack.append((pos, share))
    return out


def _ranges(buf: np.ndarray, starts: np.ndarray, most: int):
    """The starts in ranges of suffix order of about `most`, by their first 16 bytes; starts that share those with no other
    one stand in no repeat and are left out. Each start has 16 bytes after it."""
    raw = buf.tobytes()
    at = np.ndarray((max(0, len(raw) - 7),), ">u8", raw, strides=(1,))
    high, low = at[starts].astype(np.uint64), at[starts + 8].astype(np.uint64)
    order = np.lexsort((low, high))
    near = np.zeros(len(order), bool)
    near[1:] = (high[order][1:] == high[order][:-1]) & (low[order][1:] == low[order][:-1])
    new = np.flatnonzero(~near)
    near[:-1] |= near[1:]
    edge = np.concatenate([new[np.flatnonzero(np.diff(new // most, prepend=-1))], [len(order)]])
    for i, j in zip(edge[:-1], edge[1:], strict=True):
        some = order[i:j][near[i:j]]
        if len(some):
            yield some


class _Block:
    """A block's text with its anchors.

    Each start of a `span`-byte string belongs to the anchor that is the least hash among the `gram`-byte strings
    in it (the leftmost of equal ones), so equal strings have equal anchors at equal distances. Starts in a row
    with one anchor form a run.
    """

    def __init__(self, table, span: int, gram: int):
        ids = table.column("doc_id").to_numpy()
        texts = common.utf8(table.column("text"))
        order = sorted(range(len(ids)), key=lambda i: (ids[i], texts[i]))
        self.span = span
        self.ids = ids[order]
        self.texts = [texts[i] for i in order]
        self.bytes = b"".join(self.texts)
        self.buf = np.frombuffer(self.bytes, np.uint8)
        self.ends = np.cumsum([len(t) for t in self.texts], dtype=np.int64)
        self.begins = self.ends - [len(t) for t in self.texts]
        first = np.concatenate([[True], self.ids[1:] != self.ids[:-1]]) if len(ids) else np.zeros(0, bool)
        self.row = np.arange(len(ids)) - np.maximum.accumulate(np.where(first, np.arange(len(ids)), 0))
        self._anchors(gram)

    def _anchors(self, gram: int) -> None:
        width = self.span - gram + 1
        runs, keys = [], []
        for s in range(0, len(self.buf) - self.span + 1, _CHUNK):
            part = self.buf[s : s + _CHUNK + self.span - 1]
            at = np.arange(len(part) - gram + 1)
            h = common.Rolling(part).of(at, at + gram)
            low = h & ~_LOW | at.astype(np.uint64)
            size = 1
            while size * 2 <= width:
                low = np.minimum(low[:-size], low[size:])
                size *= 2
            if size < width:
                low = np.minimum(low[: size - width], low[width - size :])
            anchor = (low & _LOW).astype(np.int64)
            edge = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
            runs.append(np.stack([edge + s, np.diff(edge, append=len(anchor)), anchor[edge] + s], 1))
            keys.append(common.mix(h[anchor[edge]]))  # the least of many hashes are small: spread them over buckets again
        run = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
        key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
        # starts whose string leaves its document don't count: a run is cut at the document's last start
        doc = np.searchsorted(self.ends, run[:, 0], side="right")
        doc = np.minimum(doc, max(len(self.ends) - 1, 0))
        last = self.ends[doc] - self.span if len(run) else run[:, 0]
        tail = np.flatnonzero(run[:, 0] + run[:, 1] - 1 > last) if len(run) else np.zeros(0, np.int64)
        extra, extra_key, extra_doc = [], [], []
        for i in tail.tolist():  # a run that spans documents: its part in each later document
            stop = run[i, 0] + run[i, 1]
            d = int(doc[i]) + 1
            while d < len(self.ends) and self.begins[d] < stop:
                n = min(stop, self.ends[d] - self.span + 1) - self.begins[d]
                if n > 0:
                    extra.append((self.begins[d], n, run[i, 2]))
                    extra_key.append(key[i])
                    extra_doc.append(d)
                d += 1
        if len(run):
            run[:, 1] = np.minimum(run[:, 1], last + 1 - run[:, 0])
        if extra:
            run = np.concatenate([run, np.array(extra, np.int64)])
            key = np.concatenate([key, np.array(extra_key, np.uint64)])
            doc = np.concatenate([doc, np.array(extra_doc, np.int64)])
        good = run[:, 1] > 0
        order = np.flatnonzero(good)[np.argsort(run[good, 0], kind="stable")]
        self.start, self.count, self.doc, self.key = run[order, 0], run[order, 1], doc[order], key[order]

    def keys(self):
        """Distinct anchor hashes in order, how often each occurs, and each run's place among them."""
        return np.unique(self.key, return_inverse=True, return_counts=True)

    def contexts(self, wanted: np.ndarray, hot: np.ndarray):
        """Distinct strings of bytes around wanted runs: for each its key, first start, document and starts;
        and for each wanted run its string and its first start. A hot run is taken start by start."""
        start, count, key, doc = (x[wanted] for x in (self.start, self.count, self.key, self.doc))
        hot = hot[wanted]
        if hot.any():
            n = count[hot]
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(start[hot], n) + inner
            own = np.array([int.from_bytes(hashlib.blake2b(self.bytes[p : p + self.span], digest_size=8).digest(), "little") for p in at.tolist()], np.uint64)
            start, count, key, doc = (np.concatenate(x) for x in ((start[~hot], at), (count[~hot], np.ones(len(at), np.int64)), (key[~hot], own), (doc[~hot], np.repeat(doc[hot], n))))
            order = np.argsort(start, kind="stable")
            start, count, key, doc = start[order], count[order], key[order], doc[order]
        seen: dict[bytes, int] = {}
        extra = self.span - 1
        which = [seen.setdefault(self.bytes[p : p + n + extra], len(seen)) for p, n in zip(start.tolist(), count.tolist(), strict=True)]
        which = np.array(which, np.int64)
        _, first = np.unique(which, return_index=True)
        order = np.argsort(key[first], kind="stable")
        return list(seen), first[order], order, which, start, count, key, doc


def suffix_dedup(docs: DataFrame, span: int = 100, gram: int = 40, block_bytes: int = 4 << 20, least_blocks: int = 48, hot: int = 1024, most: int = 100_000) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_bytes.

    Texts count as UTF-8 bytes (null: empty). A byte goes if a `span`-byte string covers it that also starts
    earlier: in a document with a smaller id, or earlier in the same one; strings are judged on the input and
    never cross documents. n_spans counts maximal removed runs. Rows that repeat an id come in the order of
    their texts, as later parts of that document; a null id counts as the largest. Extra columns are ignored.

    First every block sends the hashes of its anchors, and buckets answer which occur twice. Then only the text
    around those goes to the bucket of its anchor, each distinct string once from a block with its first place.
    The bucket puts starts in suffix order, about `most` at a time, in ranges by their first 16 bytes, and finds their
    longest previous factors by the previous and next smaller positions. Factors are followed up to `span` bytes; where
    one reaches that, an earlier copy exists. An anchor that occurs `hot` times or more is dealt by its whole strings, so no bucket
    gathers all that surrounds one passage.
    """
    import pyarrow as pa
    import zstandard

    dealt, n_blocks = common.in_blocks(common.documents(docs), block_bytes, least_blocks)
    n_key_buckets = -(-n_blocks // 4)
    n_buckets = n_blocks

    def send_keys(table):
        key, _, count = _Block(table, span, gram).keys()
        cut = np.searchsorted(common.bucket_of(key, n_key_buckets), np.arange(n_key_buckets + 1))
        full = [b for b in range(n_key_buckets) if cut[b] < cut[b + 1]]
        return pa.table({
            "bucket": pa.array(full, pa.int32()),
            "block": pa.array([table.column("block")[0].as_py()] * len(full), pa.int32()),
            "keys": pa.array([common.pack(np.diff(key[cut[b] : cut[b + 1]], prepend=np.uint64(0)), count[cut[b] : cut[b + 1]]) for b in full], pa.binary()),
        })

    def count_keys(table):
        got = [common.unpack(k, 2) for k in table.column("keys").to_pylist()]
        key = np.concatenate([np.cumsum(g[0]) for g in got])
        count = np.concatenate([g[1] for g in got]).astype(np.int64)
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        run = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        total = np.empty(len(key), np.int64)
        total[order] = np.repeat(np.add.reduceat(count[order], run), np.diff(run, append=len(key)))
        cut = np.cumsum([0] + [len(g[0]) for g in got])
        bits = lambda x, i: np.packbits(x[cut[i] : cut[i + 1]]).tobytes()
        return pa.table({
            "block": table.column("block"),
            "bucket": table.column("bucket"),
            "bits": pa.array([bits(total > 1, i) for i in range(len(got))], pa.binary()),
            "hot": pa.array([bits(total >= hot, i) for i in range(len(got))], pa.binary()),
        })

    def chosen(block, right):
        """The block's contexts, by what came back for its anchors."""
        key, place, _ = block.keys()
        cut = np.searchsorted(common.bucket_of(key, n_key_buckets), np.arange(n_key_buckets + 1))
        twice, many = np.zeros(len(key), bool), np.zeros(len(key), bool)
        for b, one, other in zip(*(right.column(c).to_pylist() for c in ("bucket", "bits", "hot")), strict=True):
            if other is not None:
                twice[cut[b] : cut[b + 1]] = np.unpackbits(np.frombuffer(one, np.uint8), count=cut[b + 1] - cut[b])
                many[cut[b] : cut[b + 1]] = np.unpackbits(np.frombuffer(other, np.uint8), count=cut[b + 1] - cut[b])
        return block.contexts(twice[place], many[place])

    def send_texts(left, right):
        block = _Block(left, span, gram)
        texts, first, order, _, start, count, key, doc = chosen(block, right)
        cut = np.searchsorted(common.bucket_of(key[first], n_buckets), np.arange(n_buckets + 1))
        full = [b for b in range(n_buckets) if cut[b] < cut[b + 1]]
        rows = []
        for b in full:
            f = first[cut[b] : cut[b + 1]]
            at = start[f] - block.begins[doc[f]] + (block.row[doc[f]] << 40)
            rows.append((common.pack(count[f], block.ids[doc[f]], at), zstandard.compress(b"".join([texts[i] for i in order[cut[b] : cut[b + 1]]]), 3)))
        return pa.table({
            "bucket": pa.array(full, pa.int32()),
            "block": pa.array([left.column("block")[0].as_py()] * len(full) if len(left) else [], pa.int32()),
            "places": pa.array([r[0] for r in rows], pa.binary()),
            "texts": pa.array([r[1] for r in rows], pa.binary()),
        })

    def judge(table):
        got = [[x.view(np.int64) for x in common.unpack(p, 3)] for p in table.column("places").to_pylist()]
        raw = b"".join(zstandard.decompress(t) for t in table.column("texts").to_pylist())
        buf = np.frombuffer(raw, np.uint8)
        count, doc, at = (np.concatenate([g[k] for g in got]) for k in range(3))
        end = np.cumsum(count + span - 1)
        inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        context = np.repeat(np.arange(len(count), dtype=np.int32), count)
        starts = np.repeat(end - count - span + 1, count) + inner
        later = np.zeros(len(starts), bool)
        for part in _ranges(buf, starts, most):
            c = context[part]
            ranked = part[np.lexsort((at[c] + inner[part], doc[c]))]  # in text order
            later[ranked] = longest_previous(*suffix_order(buf, starts[ranked], span)) >= span
        cut = np.cumsum([0] + [int(g[0].sum()) for g in got])
        return pa.table({
            "block": table.column("block"),
            "bucket": table.column("bucket"),
            "bits": pa.array([np.packbits(later[cut[i] : cut[i + 1]]).tobytes() for i in range(len(got))], pa.binary()),
        })

    def apply(left, right):
        block = _Block(left, span, gram)
        texts, first, order, which, start, count, key, _ = chosen(block, right)
        cut = np.searchsorted(common.bucket_of(key[first], n_buckets), np.arange(n_buckets + 1))
        goes = [np.zeros(0, np.int64)]
        for b, bits, other in zip(*(right.column(c).to_pylist() for c in ("bucket", "bits", "hot")), strict=True):
            if other is None:
                f = first[cut[b] : cut[b + 1]]
                n = count[f]
                inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                goes.append((np.repeat(start[f], n) + inner)[np.unpackbits(np.frombuffer(bits, np.uint8), count=int(n.sum())).astype(bool)])
        again = np.ones(len(start), bool)
        again[first] = False  # an equal string stands earlier in this block
        n = count[again]
        goes.append(np.repeat(start[again], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        goes = np.concatenate(goes)
        depth = np.bincount(goes, minlength=len(block.buf) + 1) - np.bincount(goes + span, minlength=len(block.buf) + 1)
        removed = np.cumsum(depth)[: len(block.buf)] > 0
        kept, n_removed, n_spans = [], [], []
        for t, i, j in zip(block.texts, block.begins, block.ends, strict=True):
            r = removed[i:j]
            n_removed.append(int(r.sum()))
            n_spans.append(int(r[0]) + int((r[1:] & ~r[:-1]).sum()) if len(r) else 0)
            kept.append(block.buf[i:j][~r].tobytes() if n_removed[-1] else t)
        return pa.table({
            "doc_id": pa.array(block.ids),
            "n_bytes": pa.array((block.ends - block.begins).astype(np.int64)),
            "n_removed": pa.array(n_removed, pa.int64()),
            "n_spans": pa.array(n_spans, pa.int64()),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
            "kept_bytes": pa.array(kept, pa.binary()),
        })

    keys = dealt.groupBy("block").applyInArrow(send_keys, "bucket int, block int, keys binary")
    counted = keys.groupBy("bucket").applyInArrow(count_keys, "block int, bucket int, bits binary, hot binary")
    sent = dealt.groupBy("block").cogroup(counted.groupBy("block")).applyInArrow(send_texts, "bucket int, block int, places binary, texts binary")
    judged = sent.groupBy("bucket").applyInArrow(judge, "block int, bucket int, bits binary").withColumn("hot", F.lit(None).cast("binary"))
    return (
        dealt.groupBy("block")
        .cogroup(counted.unionByName(judged).groupBy("block"))
        .applyInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_bytes binary")
        .withColumn("doc_id", common.own_id())
    )
