"""Shared by the operators: input columns, hashing over whole byte buffers, compact blobs, blocks of documents."""

from __future__ import annotations

import hashlib
import tempfile
import uuid

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Stands for a null id inside the operators, so that such a row orders after all others.
NULL_ID = (1 << 63) - 1

_B = 0x9E3779B97F4A7C15
_B_INV = pow(_B, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, text) only, so that extra columns can't clash; a null text is empty, a null id orders last.

    Columns to carry along are named carry0, carry1 and so on.
    """
    return df.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        *(F.col(c).alias(f"carry{i}") for i, c in enumerate(carry)),
    )


def shared_folder(spark) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Only a local session may have none:
    it gets a folder of its own. On a cluster that would lose data, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp()
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found


def cut(df: DataFrame) -> DataFrame:
    """The rows as a table in the shared folder: nothing before it is planned or run again."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def own_id(name: str = "doc_id") -> Column:
    """The id as it came in."""
    return F.nullif(F.col(name), F.lit(NULL_ID)).alias(name)


def in_blocks(docs: DataFrame, block_bytes: int = 4 << 20, least: int = 48, apart: bool = False) -> tuple[DataFrame, int]:
    """Documents dealt by a hash of their id to blocks of about block_bytes of text, and the number of blocks.

    The number follows the whole input's size, so a block fits in a task at any size of the input. With `apart` the text
    counts too: rows that share an id, or have none, come to different blocks, unless they are equal.
    """
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(least, -(-total // block_bytes))
    return docs.withColumn("block", F.pmod(F.xxhash64("doc_id", *(["text"] if apart else [])), F.lit(n)).cast("int")), n


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits, one to one."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Rabin-Karp hashes modulo 2**64 of any ranges of a sequence, from sums of its prefixes.

    Sequences of two values in a certain order collide from 1024 values on, so ranges should be short, or be compared.
    """

    def __init__(self, values: np.ndarray):
        self.inverse = powers(len(values) + 1, _B_INV)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(len(values), _B), out=self.sums[1:])

    def of(self, start, end) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])


_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def hash_words(data: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each range of bytes, eight bytes at a time, each step mixed over all bits; ranges over 64 bytes by
    BLAKE2. Each step can be inverted, so words that collide can be made: equal hashes only propose equal words."""
    size = end - start
    h = mix(size.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25) + np.uint64(1))
    at = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))
    some, k = np.flatnonzero((size > 0) & (size <= 64)), 0
    while len(some):
        left = size[some] - k
        h[some] = mix(h[some] ^ at[start[some] + k] & _KEPT[np.minimum(left, 8)])
        some, k = some[left > 8], k + 8
    for i in np.flatnonzero(size > 64).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]], digest_size=8).digest(), "little")
    return h


def told_apart(data: bytes, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The hashes of the ranges, or the ranks of their bytes from 2 on if two that differ have one hash."""
    order = np.argsort(h)
    ranked = h[order]
    equal = ranked[1:] == ranked[:-1]
    a, b = order[1:][equal], order[:-1][equal]  # each with the one before it
    size = (end - start)[a]
    same = bool((size == (end - start)[b]).all())
    at = np.ndarray((len(data) + 1,), "<u8", data + bytes(8), strides=(1,))
    some, k = np.flatnonzero(size <= 64), 0
    while same and len(some):
        left = np.minimum(size[some] - k, 8)
        same = not ((at[start[a[some]] + k] ^ at[start[b[some]] + k]) & _KEPT[left]).any()
        some, k = some[size[some] > k + 8], k + 8
    if same and all(data[start[a[i]] : end[a[i]]] == data[start[b[i]] : end[b[i]]] for i in np.flatnonzero(size > 64).tolist()):
        return h
    own = [data[i:j] for i, j in zip(start.tolist(), end.tolist(), strict=True)]
    rank = {w: i for i, w in enumerate(sorted(set(own)), 2)}
    return np.array([rank[w] for w in own], np.uint64)


def trim() -> None:
    """Gives freed memory back to the machine, so that workers that live on don't hold their largest task's."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        pass  # only glibc has it


def words(texts: list[bytes], separator: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash for each word of all texts, and the number of words before each text and after the last."""
    data = b"\n".join(texts) + b"\n"
    gap = separator[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(gap.view(np.int8), prepend=np.int8(1), append=np.int8(1)))
    start, end = edge[::2], edge[1::2]
    hashes = hash_words(data, start, end)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    return hashes, np.searchsorted(start, at)


def utf8(column) -> list[bytes]:
    """The UTF-8 bytes of an Arrow column of strings."""
    import pyarrow as pa

    return column.cast(pa.binary()).to_pylist()


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned or small integers of equal length as compressed byte planes."""
    planes = [np.int64(len(arrays[0])).tobytes()]
    for a in arrays:
        a = np.ascontiguousarray(a, "<u8")
        planes.append(a.view(np.uint8).reshape(-1, 8).T.tobytes())
    return zstandard.compress(b"".join(planes), 1)


def unpack(blob: bytes, count: int) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    planes = np.frombuffer(raw, np.uint8, offset=8).reshape(count, 8, n)
    return [np.ascontiguousarray(p.T).view("<u8").ravel() for p in planes]


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """A bucket for each hash, in the order of the hashes."""
    return (h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)
