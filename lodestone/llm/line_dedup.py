"""Line dedup by a log-template tree: token count and leading tokens lead to a leaf, whose templates generalise fields."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_FIELD = np.uint64(1)  #: the hash of a variable field
_MARK = b"\x00"  #: a variable field's text in what blocks send


class Lines:
    """All lines of some texts: their tokens' hashes, with tokens that hold a digit or a NUL as fields.

    A line of such tokens alone keeps their hashes and has a leaf of its own. `leaf` is a hash that is the same
    everywhere. Among these lines equal tokens and keys stand for equal bytes: where hashes collide, ranks replace them.
    """

    def __init__(self, texts: list[bytes], depth: int):
        self.bytes = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(self.bytes, np.uint8)
        self.end = np.flatnonzero(buf == 0x0A)
        self.start = np.concatenate([[0], self.end[:-1] + 1])
        gap = common._SPACE[buf]
        edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
        begin, stop = edge[::2], edge[1::2]
        token = common.hash_words(self.bytes, begin, stop)
        token[token == _FIELD] = np.uint64(2)
        own = common.told_apart(self.bytes, begin, stop, token)
        digits = np.concatenate([[0], np.cumsum(_DIGIT[buf] | (buf == 0), dtype=np.int32)])
        field = digits[stop] > digits[begin]
        self.first = np.searchsorted(begin, self.start)
        self.n = np.diff(self.first, append=len(begin))
        fields = np.concatenate([[0], np.cumsum(field, dtype=np.int32)])
        bare = (self.n > 0) & (fields[self.first + self.n] - fields[self.first] == self.n)  # these keep their tokens
        hidden = field & ~np.repeat(bare, self.n)
        collide = own is not token
        token[hidden] = _FIELD
        own[hidden] = _FIELD
        self.token, self.begin, self.stop, self.bare = own, begin, stop, bare
        place = (np.arange(len(token)) - np.repeat(self.first, self.n)).astype(np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix(token ^ common.mix(place + np.uint64(1))))])
        self.key = common.mix(sums[self.first + self.n] - sums[self.first] + self.n.astype(np.uint64))
        leaf = common.mix(self.n.astype(np.uint64))
        for i in range(depth):
            has = self.n > i
            leaf[has] = common.mix(leaf[has] * np.uint64(31) + token[self.first[has] + i])
        leaf[bare] = common.mix(self.key[bare])  # a leaf of its own for each
        self.leaf = leaf
        self.key = self._apart(collide)
        self.lead = [np.where(self.n > i, own[np.minimum(self.first + i, max(len(own) - 1, 0))], 0) if len(own) else self.n for i in range(depth)]
        self.doc = np.repeat(np.arange(len(texts)), [t.count(b"\n") + 1 for t in texts])

    def _apart(self, collide: bool) -> np.ndarray:
        """The keys, or ranks of the lines' tokens if these collide or two lines that differ have one key."""
        order = np.argsort(self.key)
        ranked = self.key[order]
        equal = ranked[1:] == ranked[:-1]
        a, b = order[1:][equal], order[:-1][equal]
        n = self.n[a]
        if not collide and (n == self.n[b]).all():
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            if (self.token[np.repeat(self.first[a], n) + inner] == self.token[np.repeat(self.first[b], n) + inner]).all():
                return self.key
        whole = [self.token[i : i + n].tobytes() for i, n in zip(self.first.tolist(), self.n.tolist(), strict=True)]
        rank = {w: i for i, w in enumerate(sorted(set(whole)))}
        return np.array([rank[w] for w in whole], np.uint64)

    def masked(self, i: int) -> bytes:
        """A line from its first to its last token; with fields its tokens joined by a space, fields as marks."""
        a, n = self.first[i], self.n[i]
        hidden = self.token[a : a + n] == _FIELD
        if not hidden.any():
            return self.bytes[self.begin[a] : self.stop[a + n - 1]]
        return b" ".join([_MARK if h else self.bytes[p:q] for h, p, q in zip(hidden.tolist(), self.begin[a : a + n].tolist(), self.stop[a : a + n].tolist(), strict=True)])


def grow(rows: np.ndarray, alike: float, depth: int = 0, crowd: int = 256) -> np.ndarray:
    """Templates of one leaf, line by line: the template of each line.

    A line joins the template that shares the most of its tokens, among those with which it shares a token that is no
    field, if that is the share `alike` at least; positions where they differ become fields. Else it begins a template.
    Beyond `crowd` templates only those are compared that
    share a token in one of so many places after the `depth` first that no other can be alike enough.
    """
    n = rows.shape[1]
    need = next(k for k in range(n + 1) if k >= alike * n)
    few = n - need + 1  # of any so many places an alike template shares one
    places = range(min(depth, n), n)
    held: list[dict[int, list[int]]] = []
    templates = np.empty_like(rows)
    count, own = 0, np.empty(len(rows), np.int64)

    def enter(template: int, at) -> None:
        for p in at:
            held[p - places.start].setdefault(int(templates[template, p]), []).append(template)

    for i, row in enumerate(rows):
        near = None
        if count > crowd and len(places) >= few:
            if not held:
                held = [{} for _ in places]
                for t in range(count):
                    enter(t, places)
            met = sorted((h.get(t, ()) for h, t in zip(held, row[places.start :].tolist(), strict=True)), key=len)
            near = np.array(sorted(set().union(*met[:few])), np.int64)
        some = templates[:count] if near is None else templates[near]
        if len(some):
            equal = some == row
            same = np.where(equal[:, row != _FIELD].any(1), equal.sum(1), 0)
            best = int(same.argmax())
            if same[best] >= max(need, 1):
                best = best if near is None else int(near[best])
                new = np.flatnonzero((templates[best] != row) & (templates[best] != _FIELD))
                templates[best][templates[best] != row] = _FIELD
                if held:
                    enter(best, new[new >= places.start].tolist())
                own[i] = best
                continue
        templates[count] = row
        own[i] = count
        if held:
            enter(count, places)
        count += 1
    return own


def _least_docs(group: np.ndarray, doc: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted (group, id) pairs with the `most` smallest different ids of each group."""
    order = np.lexsort((doc, group))
    group, doc = group[order], doc[order]
    new = np.ones(len(group), bool)
    new[1:] = (group[1:] != group[:-1]) | (doc[1:] != doc[:-1])
    group, doc = group[new], doc[new]
    begin = np.searchsorted(group, group)
    few = np.arange(len(group)) - begin < most
    return group[few], doc[few]


class _Block:
    """A block's lines as the entries it sends, all its distinct lines."""

    def __init__(self, table, depth: int, min_docs: int):
        ids = table.column("doc_id").to_numpy()
        self.order = order = np.argsort(ids, kind="stable")
        texts = common.utf8(table.column("text"))
        self.ids, self.texts = ids[order], [texts[i] for i in order]
        self.lines = x = Lines(self.texts, depth)
        full = np.flatnonzero(x.n > 0)
        _, at, place = np.unique(x.key[full], return_index=True, return_inverse=True)
        at = full[at]  # the first line of each distinct one
        order = np.argsort(x.leaf[at], kind="stable")
        rank = np.empty(len(at), np.int64)
        rank[order] = np.arange(len(at))
        self.entry_of = np.full(len(x.n), -1)
        self.entry_of[full] = rank[place]
        self.leaf = x.leaf[at][order]
        self.text = lambda i: x.masked(int(at[order[i]]))
        self.docs = lambda: _least_docs(self.entry_of[full], self.ids[x.doc[full]], min_docs)


def line_dedup(docs: DataFrame, min_docs: int = 3, depth: int = 3, alike: float = 0.7, block_bytes: int = 4 << 20, least_blocks: int = 48, crowd: int = 256, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_lines, n_removed, kept_sha256, kept_text, and the columns named in `carry`.

    Lines end at a newline; tokens are runs of anything but ASCII white space; a token with a digit or a NUL is a variable
    field. Lines with as many tokens and the same `depth` leading tokens share a leaf of the tree, whatever their
    fields. In a leaf, lines in the order of their smallest id join the template most like them, if the share
    `alike` of their tokens agrees and a constant one among them, and where they differ the template gets a field. So
    a template keeps a constant token; lines of fields alone are copies only if all their tokens are equal. A template that lines of
    `min_docs` different ids follow recurs: its lines go from every document but the one with the smallest id. Blank
    lines always stay. Null texts are empty; a null or empty text has one blank line; a null id counts as the largest;
    rows that repeat an id count as one document; extra columns are ignored.

    Tokens and lines are equal if their bytes are, whatever their hashes. Documents are hashed to blocks by id and text, so
    rows without an id are spread too; a text is never split, so one beyond `block_bytes` is a block of its own. A block sends each distinct line once, with its smallest ids, to the bucket of its
    leaf, at any size of the leaf. The bucket parses a leaf in one go, with an index over templates where they are more
    than `crowd`, which changes no result. It answers with the smallest id of each recurring template, and the block
    drops lines by that.
    """
    import pyarrow as pa
    import zstandard

    dealt, n_blocks = common.in_blocks(common.documents(docs, carry=carry), block_bytes, least_blocks, apart=True)
    n_buckets = n_blocks

    def send(table):
        block = _Block(table, depth, min_docs)
        common.trim()
        group, doc = block.docs()
        cut = np.searchsorted(common.bucket_of(block.leaf, n_buckets), np.arange(n_buckets + 1))
        part = np.searchsorted(group, cut)
        full = [b for b in range(n_buckets) if cut[b] < cut[b + 1]]
        return pa.table({
            "bucket": pa.array(full, pa.int32()),
            "block": pa.array([table.column("block")[0].as_py()] * len(full), pa.int32()),
            "lines": pa.array([zstandard.compress(b"\n".join([block.text(i) for i in range(cut[b], cut[b + 1])]), 1) for b in full], pa.binary()),
            "docs": pa.array([common.pack(np.diff(group[part[b] : part[b + 1]], prepend=cut[b]), doc[part[b] : part[b + 1]]) for b in full], pa.binary()),
        })

    def judge(table):
        common.trim()
        lines = Lines([zstandard.decompress(t) for t in table.column("lines").to_pylist()], depth)
        size = np.bincount(lines.doc, minlength=len(table))
        cut = np.cumsum([0, *size])
        group, doc = [], []
        for i, d in enumerate(table.column("docs").to_pylist()):
            step, ids = common.unpack(d, 2)
            group.append(np.cumsum(step.view(np.int64)) + cut[i])
            doc.append(ids.view(np.int64))
        _, at, key = np.unique(lines.key, return_index=True, return_inverse=True)
        group, doc = _least_docs(key[np.concatenate(group)], np.concatenate(doc), min_docs)
        first = doc[np.searchsorted(group, np.arange(len(at)))]
        template = np.arange(len(at))
        bare = lines.bare[at]
        leaf = [lines.leaf[at], lines.n[at], bare, np.where(bare, lines.key[at], 0), *(x[at] for x in lines.lead)]
        order = np.lexsort((lines.key[at], first, *leaf[::-1]))
        differs = np.any([x[order][1:] != x[order][:-1] for x in leaf], axis=0)
        edge = np.flatnonzero(np.concatenate([[True], differs, [True]]))
        for i in np.flatnonzero(np.diff(edge) > 1).tolist():
            own = order[edge[i] : edge[i + 1]]
            n = lines.n[at[own[0]]]
            found = grow(lines.token[lines.first[at[own]][:, None] + np.arange(n)], alike, depth, crowd)
            template[own] = own[np.unique(found, return_index=True)[1]][found]
        group, doc = _least_docs(template[group], doc, min_docs)
        recurs = np.full(len(at), -1)
        held, begin, n = np.unique(group, return_index=True, return_counts=True)
        least = np.full(len(at), 0)
        least[held] = doc[begin]
        recurs[held] = np.where(n >= min_docs, 1, -1)
        recurs, least = recurs[template][key], least[template][key]
        return pa.table({
            "block": table.column("block"),
            "bucket": table.column("bucket"),
            "firsts": pa.array([common.pack(recurs[cut[i] : cut[i + 1]] > 0, np.where(recurs > 0, least, 0)[cut[i] : cut[i + 1]]) for i in range(len(table))], pa.binary()),
        })

    def apply(left, right):
        block = _Block(left, depth, min_docs)
        x = block.lines
        common.trim()
        cut = np.searchsorted(common.bucket_of(block.leaf, n_buckets), np.arange(n_buckets + 1))
        recurs, least = np.zeros(len(block.leaf) + 1, bool), np.zeros(len(block.leaf) + 1, np.int64)
        for b, f in zip(right.column("bucket").to_pylist(), right.column("firsts").to_pylist(), strict=True):
            r, d = common.unpack(f, 2)
            recurs[cut[b] : cut[b + 1]], least[cut[b] : cut[b + 1]] = r > 0, d.view(np.int64)
        gone = recurs[block.entry_of] & (block.ids[x.doc] > least[block.entry_of]) & (block.entry_of >= 0)
        begin = np.searchsorted(x.doc, np.arange(len(block.texts) + 1))
        kept = []
        for t, i, j in zip(block.texts, begin[:-1], begin[1:], strict=True):
            g = gone[i:j]
            kept.append(b"\n".join([line for line, drop in zip(t.split(b"\n"), g.tolist(), strict=True) if not drop]) if g.any() else t)
        return pa.table({
            "doc_id": pa.array(block.ids),
            "n_lines": pa.array(np.diff(begin).astype(np.int64)),
            "n_removed": pa.array(np.add.reduceat(gone, begin[:-1]).astype(np.int64) if len(gone) else begin[:-1]),
            "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept]),
            "kept_text": pa.array(kept, pa.binary()).cast(pa.string()),
            **{f"carry{i}": left.column(f"carry{i}").take(pa.array(block.order)) for i in range(len(carry))},
        })

    schema = T.StructType([
        *(T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("n_lines", T.LongType()), ("n_removed", T.LongType()), ("kept_sha256", T.StringType()), ("kept_text", T.StringType()))),
        *(T.StructField(f"carry{i}", docs.schema[c].dataType) for i, c in enumerate(carry)),
    ])
    sent = dealt.groupBy("block").applyInArrow(send, "bucket int, block int, lines binary, docs binary")
    judged = sent.groupBy("bucket").applyInArrow(judge, "block int, bucket int, firsts binary")
    return (
        dealt.groupBy("block")
        .cogroup(judged.groupBy("block"))
        .applyInArrow(apply, schema)
        .select(common.own_id(), "n_lines", "n_removed", "kept_sha256", "kept_text", *(F.col(f"carry{i}").alias(c) for i, c in enumerate(carry)))
    )
