"""Approximate vector search: inverted lists around centres, of which a query asks the nearest few."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Vectors that centres are fitted on, at most: those whose ids have the smallest hashes.
SAMPLE = 20_000
MOST_CELLS = 1024


@dataclass
class Lists:
    """Every vector in blocks by cell (cell, ids, corpora, x), the centres, and how many of them a query should ask."""

    blocks: DataFrame
    centres: np.ndarray
    probes: int
    corpus_type: T.DataType


def _unit(x: np.ndarray) -> np.ndarray:
    length = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(length > 0, length, 1)


def _sampled(vectors: DataFrame, corpora: str, sample: int) -> tuple[np.ndarray, list]:
    """Vectors of unit length and their corpora: those whose ids have the smallest hashes, so the same for the same rows."""
    rows = vectors.where(F.col("embedding").isNotNull()).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding", F.col(corpora).alias("corpus")).collect()
    return _unit(np.array([r.embedding for r in rows], np.float64)) if rows else np.zeros((0, 1)), [r.corpus for r in rows]


def centres(x: np.ndarray, cells: int, rounds: int = 12) -> np.ndarray:
    """Centres of cells by spherical k-means."""
    c = x[: min(cells, len(x))].copy() if len(x) else np.zeros((1, 1))
    for _ in range(rounds if len(x) else 0):
        own = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        some = np.bincount(own, minlength=len(c)) > 0
        c[some] = _unit(sums[some])
    return c


def probes_for(x: np.ndarray, corpora: list, c: np.ndarray, k: int, share: float, asked: int = 256) -> int:
    """How many of its nearest centres a query must ask so that `share` of the neighbours are met, as measured in the sample:
    its first `asked` vectors against all of it, k neighbours in each corpus."""
    own, places = (x @ c.T).argmax(1) if len(x) else np.zeros(0, int), []
    names = {n: np.array([i for i, m in enumerate(corpora) if m == n]) for n in dict.fromkeys(corpora)}
    for i in range(min(asked, len(x))):
        rank = np.empty(len(c), int)
        rank[np.argsort(-(x[i] @ c.T), kind="stable")] = np.arange(len(c))
        for at in names.values():
            at = at[at != i]
            places += rank[own[at[np.argsort(-(x[at] @ x[i]), kind="stable")[:k]]]].tolist()
    return int(np.quantile(places, share, method="higher")) + 1 if places else len(c)


def _matrix(column) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(n, -1) if n else np.zeros((0, 1))


def build(vectors: DataFrame, corpora: str = "label", cells: int | None = None, sample: int = SAMPLE, k: int = 5, share: float = 0.98) -> Lists:
    """The lists of all vectors (vec_id long, embedding, and the corpus column). cells: about the square root of their number,
    up to MOST_CELLS. Vectors that are null or without a length are left out, as they have no cosine.

    Centres are fitted on `sample` vectors at most, and the probes that find `share` of k neighbours are measured there too; every
    vector is assigned. Vectors without any structure need most of the lists; the better they cluster the fewer do.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    cells = cells or max(1, min(MOST_CELLS, int(vectors.count() ** 0.5)))
    x, names = _sampled(vectors, corpora, sample)
    c = centres(x, cells)
    probes = probes_for(x, names, c, k, share)
    kind = vectors.schema[corpora].dataType

    def deal(batches):
        """Blocks by cell of up to 32768 rows read one after the other."""
        held, n = [], 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n >= 1 << 15:
                yield packed(pa.Table.from_batches(held))
                held, n = [], 0
        if n:
            yield packed(pa.Table.from_batches(held))

    def packed(t):
        t = t.filter(pc.is_valid(t.column("embedding"))).combine_chunks()
        x = _matrix(t.column("embedding").combine_chunks()) if t.num_rows else np.zeros((0, c.shape[1]))
        some = np.flatnonzero((x * x).sum(1) > 0)
        own = (x[some] @ c.T).argmax(1)
        out: dict[str, list] = {"cell": [], "ids": [], "corpora": [], "x": []}
        ids, names = t.column("vec_id").to_pylist(), t.column("corpus").to_pylist()
        for cell in np.unique(own):
            at = some[own == cell]
            for k, v in zip(out, (int(cell), [ids[i] for i in at], [names[i] for i in at], x[at].tobytes()), strict=True):
                out[k].append(v)
        kinds = (pa.int32(), pa.list_(pa.int64()), pa.list_(t.schema.field("corpus").type), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True)], names=list(out))

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(corpora).alias("corpus"), "embedding")
    schema = T.StructType([T.StructField("cell", T.IntegerType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("corpora", T.ArrayType(kind)), T.StructField("x", T.BinaryType())])
    return Lists(rows.mapInArrow(deal, schema), c, probes, kind)


def nearest(lists: Lists, queries: DataFrame, k: int = 5, probes: int | None = None, block: int = 256) -> DataFrame:
    """As score.nearest_all, but a query (vec_id, embedding) is compared only with the lists of its `probes` nearest centres (those
    that build found to be enough, unless stated): query_id, corpus, vec_id, similarity, rank.

    Queries are packed by cell too; each pack meets each block of its cell in one matrix product, and only the k best of
    a corpus go on. A cell that holds much of all vectors is many blocks, which Spark deals out.
    """
    import pyarrow as pa

    c = lists.centres
    n = min(len(c), probes or lists.probes)

    def probe(batches):
        """Packs of `block` queries at most, those of a few cells at a time."""
        for b in batches:
            some = np.flatnonzero(b.column("embedding").is_valid())
            x = _matrix(b.column("embedding").take(pa.array(some)))
            long = (x * x).sum(1) > 0
            ids, x = b.column("vec_id").take(pa.array(some[long])).to_numpy(), x[long]
            for i in range(0, len(x), block):
                part, own = x[i : i + block], ids[i : i + block]
                cells = np.argsort(-(part @ c.T), axis=1, kind="stable")[:, :n]
                every = np.unique(cells)
                for few in np.array_split(every, -(-len(every) // 64)):
                    at = [np.flatnonzero((cells == cell).any(1)) for cell in few]
                    yield pa.RecordBatch.from_arrays([pa.array(few, pa.int32()), pa.array([own[j] for j in at], pa.list_(pa.int64())), pa.array([part[j].tobytes() for j in at], pa.binary())], names=["cell", "query_ids", "q"])

    def best(batches):
        """One pack with one block at a time: what is held doesn't follow the rows of a batch."""
        for b in batches:
            for i in range(b.num_rows):
                r = b.slice(i, 1)
                ids, asking = (r.column(x).flatten().to_numpy() for x in ("ids", "query_ids"))
                corpora = r.column("corpora").flatten().dictionary_encode(null_encoding="encode")
                v, q = (np.frombuffer(r.column(x)[0].as_py()).reshape(m, -1) for x, m in (("x", len(ids)), ("q", len(asking))))
                cos = np.round(_unit(v) @ _unit(q).T, 6)
                code, order = corpora.indices.to_numpy(), np.argsort(ids, kind="stable")
                tops = [own[np.argsort(-cos[own], axis=0, kind="stable")[:k]] for own in (order[code[order] == x] for x in range(len(corpora.dictionary)))]
                top = np.concatenate(tops)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.tile(asking, len(top))), corpora.dictionary.take(pa.array(code[top].ravel())), pa.array(ids[top].ravel()), pa.array(np.take_along_axis(cos, top, 0).ravel())],
                    names=["query_id", "corpus", "vec_id", "similarity"],
                )

    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").mapInArrow(probe, "cell int, query_ids array<long>, q binary")
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("corpus", lists.corpus_type), T.StructField("vec_id", T.LongType()), T.StructField("similarity", T.DoubleType())])
    met = lists.blocks.join(asked, "cell").select("ids", "corpora", "x", "query_ids", "q").mapInArrow(best, schema)
    w = Window.partitionBy("query_id", "corpus").orderBy(F.desc("similarity"), "vec_id")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall(approximate: DataFrame, exact: DataFrame) -> float:
    """The share of exact neighbours that the other rows have; both: query_id, corpus, vec_id."""
    keys = ["query_id", "corpus", "vec_id"]
    met, whole = approximate.select(*keys).join(exact.select(*keys), keys, "left_semi").count(), exact.count()
    return met / whole if whole else 1.0
