"""Exact duplicates of whole texts by a cuckoo-filter index over live digests."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

_SLOTS, _KICKS, _MASK = 4, 200, (1 << 64) - 1


class CuckooIndex:
    """Live digests of contents with a value each: a cuckoo filter over buckets of stored entries.

    The filter holds 16-bit fingerprints, four to a bucket, and most lookups of new contents end there. A hit is
    verified against the digests in the bucket, and the value stands beside them. Deleting frees the slot. Where no
    slot can be found, a filter of twice the size is built from the stored entries.
    """

    def __init__(self, capacity: int = 1024):
        self.size, self.count = 1 << max(4, (capacity // _SLOTS).bit_length()), 0
        self._clear()

    def _clear(self) -> None:
        self.prints: list[list[int]] = [[] for _ in range(self.size)]
        self.stored: list[list[tuple[bytes, object]]] = [[] for _ in range(self.size)]

    def _place(self, digest: bytes) -> tuple[int, int, int]:
        h = int.from_bytes(digest[:8], "little")
        mark = (h >> 48) or 1
        first = h & (self.size - 1)
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return bucket ^ (mark * 0x9E3779B97F4A7C15 & _MASK) >> 17 & (self.size - 1)

    def _find(self, digest: bytes) -> tuple[int, int] | None:
        mark, first, second = self._place(digest)
        for b in (first, second):
            if mark in self.prints[b]:
                for i, (d, _) in enumerate(self.stored[b]):
                    if d == digest:
                        return b, i
        return None

    def __contains__(self, digest: bytes) -> bool:
        return self._find(digest) is not None

    def __len__(self) -> int:
        return self.count

    def items(self) -> Iterator[tuple[bytes, object]]:
        """All live digests with their values, bucket by bucket."""
        return (entry for bucket in self.stored for entry in bucket)

    def get(self, digest: bytes):
        """What is stored for a live digest, or None."""
        at = self._find(digest)
        return None if at is None else self.stored[at[0]][at[1]][1]

    def put(self, digest: bytes, value) -> None:
        """Makes the digest live, or replaces what is stored for it."""
        at = self._find(digest)
        if at is not None:
            self.stored[at[0]][at[1]] = (digest, value)
            return
        self.count += 1
        if (homeless := self._add((digest, value))) is not None:
            self._grow(homeless)

    def delete(self, digest: bytes) -> bool:
        """Ends a live digest; False if it wasn't live."""
        at = self._find(digest)
        if at is None:
            return False
        b, i = at
        self.prints[b].pop(i)
        self.stored[b].pop(i)
        self.count -= 1
        return True

    def _add(self, entry: tuple[bytes, object]) -> tuple[bytes, object] | None:
        """Stores the entry; returns the one that is left without a slot, if any."""
        mark, first, second = self._place(entry[0])
        for b in (first, second):
            if len(self.prints[b]) < _SLOTS:
                self.prints[b].append(mark)
                self.stored[b].append(entry)
                return None
        b = second
        for k in range(_KICKS):
            i = k % _SLOTS
            mark, self.prints[b][i] = self.prints[b][i], mark
            entry, self.stored[b][i] = self.stored[b][i], entry
            b = self._other(b, mark)
            if len(self.prints[b]) < _SLOTS:
                self.prints[b].append(mark)
                self.stored[b].append(entry)
                return None
        return entry

    def _grow(self, homeless: tuple[bytes, object]) -> None:
        entries = [*self.items(), homeless]
        placed = False
        while not placed:
            self.size *= 2
            self._clear()
            placed = all(self._add(e) is None for e in entries)


def _merge(rows: Iterable[tuple[bytes, int, int]], most: int | None) -> Iterator[CuckooIndex]:
    """Indexes with an (id, count) for each digest; one that holds `most` digests is given out and a new one begun.

    A larger id ends the digest's entry and takes its place.
    """
    index = CuckooIndex()
    for digest, doc, n in rows:
        held = index.get(digest)
        if held is None:
            if len(index) == most:
                yield index
                index = CuckooIndex()
            index.put(digest, (doc, n))
        elif doc > held[0]:
            index.delete(digest)
            index.put(digest, (doc, n + held[1]))
        else:
            index.put(digest, (held[0], n + held[1]))
    yield index


def _index(batches, most: int | None = 200_000):
    """Merges a partition's rows."""
    from itertools import batched

    import pyarrow as pa

    rows = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for index in _merge(rows, most):
        for part in batched(index.items(), 20_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in part], pa.binary()), pa.array([v[0] for _, v in part], pa.int64()), pa.array([v[1] for _, v in part], pa.int64())],
                names=["digest", "keep_id", "group_size"],
            )


def _shard(batches):
    """All rows of a shard's digests are here, so nothing is given out before the end."""
    return _index(batches, most=None)


def groups(digests: DataFrame, shard_rows: int = 500_000) -> DataFrame:
    """(digest, keep_id, group_size) for rows (digest binary, doc_id).

    An index in each input partition merges copies first, so a hot text sends one row for each task; shards of
    the digests' hash then merge these in an index of their own. There are as many shards as it takes for about
    `shard_rows` rows in each, so an index stays within a worker's memory at any size of the input.
    """
    spark = digests.sparkSession
    schema = "digest binary, keep_id long, group_size long"
    part = digests.select("digest", "doc_id", F.lit(1).cast("long").alias("n")).mapInArrow(_index, schema)
    shards = max(spark.sparkContext.defaultParallelism, -(-digests.count() // shard_rows))
    return part.repartition(shards, "digest").mapInArrow(_shard, schema)


def exact_dedup(docs: DataFrame, shard_rows: int = 500_000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. The largest doc_id of equal
    texts stays. Null ids count as larger than all others and come back as null; rows that repeat an id are
    counted each, and all rows of the kept id have kept = true. An empty table gives no rows; extra columns are
    ignored. Equality rests on SHA-256 of the normalised text. Digests are worked out once and written as a table in
    the shared folder; the text isn't read again.
    """
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    rows = common.documents(docs).select("doc_id", F.unhex(F.sha2(F.encode(F.translate("text", upper, upper.lower()), "UTF-8"), 256)).alias("digest"))
    rows = common.cut(rows)
    return (
        rows.join(groups(rows, shard_rows), "digest")
        .select(
            common.own_id(),
            common.own_id("keep_id"),
            "group_size",
            (F.col("doc_id") == F.col("keep_id")).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )
