"""Confidence, routing, review, retrieval, evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources import tables

# Weights of the composite and thresholds of routing.
WEIGHTS = {"extractor": 0.25, "coverage": 0.20, "agreement": 0.20, "ontology": 0.20, "stix": 0.15}
REVIEW, REJECT = 0.55, 0.30


def confidence(**signals: Column) -> Column:
    """The weighted sum of five signals in [0, 1], rounded to 6 digits; a missing or null signal counts as 0."""
    total = F.lit(0.0)
    for name, weight in WEIGHTS.items():
        total = total + F.coalesce(signals.get(name, F.lit(None)).cast("double"), F.lit(0.0)) * weight
    return F.round(total, 6)


def route(score: Column) -> Column:
    return F.when(score < REJECT, "reject").when(score < REVIEW, "review").otherwise("accept")


def histogram(scores: DataFrame, bins: int = 10) -> DataFrame:
    """Rows of each bin of [0, 1]; 1 itself belongs to the last."""
    b = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    return scores.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def review_queue(items: DataFrame, page: int = 0, size: int = 50) -> DataFrame:
    """A page of the triage queue: confidence upwards, then novelty and priority downwards, then id.

    items: id, score, novelty, priority. Only the page's end is sorted for, so each task keeps (page + 1) * size rows.
    """
    order = [F.asc("score"), F.desc("novelty"), F.desc("priority"), F.asc("id")]
    top = items.orderBy(*order).limit((page + 1) * size)
    return top.withColumn("position", F.row_number().over(Window.orderBy(*order))).where(F.col("position") > page * size)


def chunk_page(chunks: DataFrame, page: int = 0, size: int = 20) -> DataFrame:
    """A page of each document's chunks in text order."""
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("char_start"))
    return chunks.withColumn("position", n).where(F.col("position").between(page * size + 1, (page + 1) * size))


def review_diff(auto: DataFrame, edited: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Differences from automatic to edited rows: keys, op (add, remove, replace), old, new."""
    both = auto.select(*keys, F.struct(value).alias("a")).join(edited.select(*keys, F.struct(value).alias("b")), keys, "full")
    old, new = F.col(f"a.{value}"), F.col(f"b.{value}")
    op = F.when(F.col("a").isNull(), "add").when(F.col("b").isNull(), "remove").when(~old.eqNullSafe(new), "replace")
    return both.select(*keys, op.alias("op"), old.alias("old"), new.alias("new")).where(F.col("op").isNotNull())


def prf(gold: DataFrame, found: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each type over distinct (doc_id, type, normalized); null where undefined."""
    side = lambda df, g: df.select("doc_id", "type", "normalized", F.lit(g).alias("gold"), F.lit(not g).alias("found"))
    return prf_marked(side(gold, True).unionByName(side(found, False)))


def prf_marked(rows: DataFrame) -> DataFrame:
    """The same of rows that say for themselves whether they are gold, found, or both: doc_id, type, normalized, and gold and found
    as booleans, of which a null is false. So rows that both sides take from one source are computed and shuffled once.

    A row with a null among its keys equals none of the other side.
    """
    keys = ["doc_id", "type", "normalized"]
    own = rows.where(F.col("gold") | F.col("found")).groupBy(*keys).agg(*(F.max(F.coalesce(c, F.lit(False))).alias(c) for c in ("gold", "found")))
    g, f = F.col("gold"), F.col("found")
    both = g & f & F.col("doc_id").isNotNull() & F.col("type").isNotNull() & F.col("normalized").isNotNull()
    n = own.groupBy("type").agg(F.count(F.when(both, 1)).alias("tp"), F.count(F.when(f & ~both, 1)).alias("fp"), F.count(F.when(g & ~both, 1)).alias("fn"))
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    return n.select("type", "tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * F.col("tp") / F.nullif(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(0)), 6).alias("f1"))


def roundtrip(local: DataFrame, remote: DataFrame) -> DataFrame:
    """References that one side has and the other lacks: ref, side (missing is absent remotely, extra locally)."""
    missing = local.select("ref").distinct().join(remote.select("ref").distinct(), "ref", "left_anti").withColumn("side", F.lit("missing"))
    extra = remote.select("ref").distinct().join(local.select("ref").distinct(), "ref", "left_anti").withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)


def agreement(claims: DataFrame) -> DataFrame:
    """How many extractors make each claim: doc_id, type, normalized, n_extractors."""
    return claims.groupBy("doc_id", "type", "normalized").agg(F.count_distinct("extractor").alias("n_extractors"))


def nearest(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int = 5, corpora: str = "label") -> DataFrame:
    """For each query the k most similar vectors of each corpus: query_id, corpus, vec_id, similarity (cosine, 6 digits), rank.

    vectors: vec_id, embedding, and the corpus column. Queries are a stated list of a request, so the vectors are
    scanned once beside them and never joined with each other.
    """
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    v = F.col("embedding")
    asked = F.array(*(F.struct(F.lit(i).alias("query_id"), F.array(*(F.lit(float(x)) for x in q)).alias("q")) for i, q in queries))
    rows = vectors.select("vec_id", F.col(corpora).alias("corpus"), "embedding", F.explode(asked).alias("a"))
    cos = F.round(dot(v, F.col("a.q")) / (F.sqrt(dot(v, v)) * F.sqrt(dot(F.col("a.q"), F.col("a.q")))), 6)
    w = Window.partitionBy("query_id", "corpus").orderBy(F.desc("similarity"), "vec_id")
    return rows.select(F.col("a.query_id").alias("query_id"), "corpus", "vec_id", cos.alias("similarity")).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest_all(vectors: DataFrame, queries: DataFrame, k: int = 5, corpora: str = "label", block: int = 512, side: int = 64 << 20) -> DataFrame:
    """As nearest, for a table of queries (vec_id, embedding) of any size.

    Both sides are packed into blocks of rows once, as tables, and dealt to a grid whose cells hold about `side` bytes of each.
    Blocks of a cell are joined by its place; each block of queries meets each block of vectors in one matrix product, and only
    the k best of a corpus in a pair of blocks go on. Vectors are sent once for each `side` bytes of queries. Vectors without a length have no similarity and no rank.
    """
    import numpy as np
    import pyarrow as pa

    kind = vectors.schema[corpora].dataType

    def packed(rows: DataFrame, size: int) -> DataFrame:
        def pack(batches):
            for b in batches:
                for i in range(0, b.num_rows, size):
                    part = b.slice(i, size)
                    part = part.filter(part.column("embedding").is_valid())
                    part = part.take(pa.compute.sort_indices(part.column("vec_id")))
                    x = part.column("embedding").flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(part.num_rows, -1) if part.num_rows else np.zeros((0, 0))
                    some = np.sqrt((x * x).sum(1)) > 0
                    if some.any():
                        kept = part.filter(pa.array(some))
                        lists = [pa.array([kept.column(c).to_pylist()], pa.list_(kept.schema.field(c).type)) for c in ("vec_id", "corpus")]
                        yield pa.RecordBatch.from_arrays([*lists, pa.array([x[some].tobytes()], pa.binary())], names=["ids", "corpora", "x"])

        import pyarrow.compute  # noqa: F401

        return rows.mapInArrow(pack, T.StructType([T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("corpora", T.ArrayType(kind)), T.StructField("x", T.BinaryType())]))

    def best(batches):
        for b in batches:
            for r in b.to_pylist():
                v, q = (np.frombuffer(r[c]).reshape(len(r[n]), -1) for c, n in (("x", "ids"), ("q", "query_ids")))
                cos = np.round((v @ q.T) / (np.sqrt((v * v).sum(1))[:, None] * np.sqrt((q * q).sum(1))), 6)
                out = []
                for c in dict.fromkeys(r["corpora"]):
                    own = np.array([i for i, x in enumerate(r["corpora"]) if x == c])
                    top = own[np.argsort(-cos[own], axis=0, kind="stable")[:k]]
                    out += [(i, c, r["ids"][t], float(cos[t, j])) for j, i in enumerate(r["query_ids"]) for t in top[:, j].tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), b.schema.field("corpora").type.value_type, pa.int64(), pa.float64()), strict=True)], names=["query_id", "corpus", "vec_id", "similarity"])

    asked = queries.select(F.col("vec_id").cast("long").alias("vec_id"), F.lit(None).cast(kind).alias("corpus"), "embedding")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(corpora).alias("corpus"), "embedding")
    held, sought = tables.written(packed(rows, 8 * block)), tables.written(packed(asked, block).select(F.col("ids").alias("query_ids"), F.col("x").alias("q")))
    across, down = (max(1, -(-(df.agg(F.sum(F.length(c))).first()[0] or 0) // side)) for df, c in ((held, "x"), (sought, "q")))
    place, every = (lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    cells = held.select("*", place("ids", across).alias("i"), every(down).alias("j"))
    pairs = cells.join(sought.select("*", every(across).alias("i"), place("query_ids", down).alias("j")), ["i", "j"]).drop("i", "j")
    schema = T.StructType([T.StructField("query_id", T.LongType()), T.StructField("corpus", kind), T.StructField("vec_id", T.LongType()), T.StructField("similarity", T.DoubleType())])
    w = Window.partitionBy("query_id", "corpus").orderBy(F.desc("similarity"), "vec_id")
    return pairs.mapInArrow(best, schema).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def lexical_search(docs: DataFrame, terms: list[str], k: int = 10) -> DataFrame:
    """The k documents with the most occurrences of the terms as whole lower-case words: doc_id, score, n_terms.

    Words are counted where they stand; only documents with a hit go on.
    """
    w = F.split(F.lower("text"), "[^a-z0-9]+")
    is_term = lambda t: lambda x: x == F.lit(t)
    counts = [F.size(F.filter(F.col("w"), is_term(t))) for t in terms]
    hits = docs.select("doc_id", w.alias("w")).select("doc_id", *(c.alias(f"t{i}") for i, c in enumerate(counts)))
    score, n = sum((F.col(f"t{i}") for i in range(len(terms))), F.lit(0)), sum(((F.col(f"t{i}") > 0).cast("int") for i in range(len(terms))), F.lit(0))
    return hits.select("doc_id", score.alias("score"), n.alias("n_terms")).where("score > 0").orderBy(F.desc("score"), F.desc("n_terms"), "doc_id").limit(k)


def resolve_aliases(mentions: DataFrame, aliases: DataFrame) -> DataFrame:
    """The entity of each mention by the first stage that finds one: exact alias, then its normal form.

    mentions: mention_id, name; aliases: alias, entity_id. Of several entities the smallest id counts. Names without a
    letter or digit have no normal form.
    """
    plain = lambda c: F.nullif(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", ""), F.lit(""))
    exact = aliases.groupBy(F.col("alias").alias("name")).agg(F.min("entity_id").alias("e1"))
    loose = aliases.groupBy(plain(F.col("alias")).alias("plain")).agg(F.min("entity_id").alias("e2"))
    out = mentions.withColumn("plain", plain(F.col("name"))).join(exact, "name", "left").join(loose, "plain", "left")
    return out.select("mention_id", F.coalesce("e1", "e2").alias("entity_id"), F.when(F.col("e1").isNotNull(), "exact").when(F.col("e2").isNotNull(), "normalised").alias("stage"))


def reachable(spark, edges: DataFrame, start: str, depth: int = 4) -> DataFrame:
    """Nodes within `depth` relations of a node, with the least number of them: node, hops.

    Every round keeps each node once, with its least hops, so walks don't multiply.
    """
    own = edges.select("source_ref", "target_ref").distinct()
    level = spark.createDataFrame([(start, 0)], "node string, hops int")
    for _ in range(depth):
        met = level.join(own, F.col("node") == F.col("source_ref"), "left")
        both = F.array(F.struct("node", "hops"), F.struct(F.col("target_ref").alias("node"), (F.col("hops") + 1).alias("hops")))
        level = met.select(F.explode(both).alias("n")).select("n.*").where(F.col("node").isNotNull()).groupBy("node").agg(F.min("hops").alias("hops"))
    return level


def latest(rows: DataFrame, by: str, order: str) -> DataFrame:
    """The last row of each group."""
    whole = F.struct(*rows.columns)
    return rows.groupBy(by).agg(F.max_by(whole, order).alias("r")).select("r.*")


def percentiles(rows: DataFrame, by: str, value: str) -> DataFrame:
    """p50, p95 and p99 of each group, interpolated, and the number of rows.

    Equal values are counted first. Values are then dealt by range, whole groups or parts of them; a part's running count goes on
    from the sum of the parts before it, so no task meets all values of a large group. Ranges are drawn from a sample, so what
    is dealt is written before it is read twice. Groups without a value have null percentiles.
    """
    counts = rows.groupBy(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).agg(F.count(value).alias("c"))
    dealt = tables.written(counts.repartitionByRange(F.asc_nulls_first("g"), F.asc_nulls_first("v")).withColumn("part", F.spark_partition_id()))
    whole = Window.partitionBy("g")
    parts = dealt.groupBy("g", "part").agg(F.sum("c").alias("c")).select(
        F.col("g").alias("of"), F.col("part").alias("at"), F.sum("c").over(whole).alias("n"), (F.sum("c").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("before")
    )
    upto = F.sum("c").over(Window.partitionBy("g", "part").orderBy(F.asc_nulls_first("v")).rowsBetween(Window.unboundedPreceding, 0))
    placed = dealt.join(parts, F.col("g").eqNullSafe(F.col("of")) & (F.col("part") == F.col("at"))).select("g", "v", (F.col("before") + upto).alias("upto"), "n")

    def at(q: float):
        place = (F.col("n") - 1) * F.lit(q)
        low, high = (F.min(F.when(F.col("upto") > f(place), F.col("v"))) for f in (F.floor, F.ceil))
        share = F.max(place - F.floor(place))
        return F.round(low + (high - low) * share, 6)

    return placed.groupBy(F.col("g").alias(by)).agg(*(at(q).alias(f"p{int(q * 100)}") for q in (0.5, 0.95, 0.99)), F.max("n").alias("n"))


#: Error of a rank, as a share of all rows, that sketches with SKETCH_K hold at 99 %.
SKETCH_K, RANK_ERROR = 400, 0.0075


def daily_sketches(rows: DataFrame, by: str, value: str, day: str = "day") -> DataFrame:
    """A KLL sketch of each group's values of a day: by, day, sketch, n. Null values don't count.

    Sketches are of bounded size and are merged where rows are read, so no group's values meet in a task. They may be stored
    and merged later, a day or an hour at a time.
    """
    return rows.groupBy(by, day).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(SKETCH_K)).alias("sketch"), F.count(value).alias("n"))


def merged_percentiles(sketches: DataFrame, by: str) -> DataFrame:
    """p50, p95 and p99 of each group over all its days, and the number of rows. What is said to be a percentile is one of the
    values, whose rank is off by RANK_ERROR at most (at 99 %). Groups without a value have null percentiles."""
    whole = sketches.groupBy(by).agg(F.kll_merge_agg_double("sketch", F.lit(SKETCH_K)).alias("sketch"), F.sum("n").alias("n"))
    at = lambda q: F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("sketch", F.lit(q)))
    return whole.select(by, at(0.5).alias("p50"), at(0.95).alias("p95"), at(0.99).alias("p99"), "n")
