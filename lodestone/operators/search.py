"""Search over several kinds of evidence, typed corpora, and names resolved to entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import score

# Fixed value: the constant of reciprocal rank fusion.
FUSION = 60


def plain_name(name: Column) -> Column:
    """The letters and digits of a name, in lower case; null if it has none."""
    return F.nullif(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def resolve_entities(mentions: DataFrame, aliases: DataFrame, references: DataFrame, least: float = 0.9) -> DataFrame:
    """The entity of each mention by the first of four stages that finds one: mention_id, entity_id, stage, similarity.

    mentions: mention_id long (unique), name, embedding; aliases: alias, entity_id long, embedding, attack_id;
    references: name, attack_id, such as a snapshot's groups and software with their other names. Stages: the alias
    itself, its normal form, the alias whose embedding has the highest cosine if that is `least` or more, and an entity
    with the attack id that a reference of that name has. Of several entities the smallest id counts. A null name has
    only the third stage, a null embedding doesn't have it; mentions that no stage finds stay, with nulls.

    Embeddings are compared in blocks, and only for mentions that the first two stages leave over.
    """
    name, entity = F.col("name"), F.min("entity_id")
    exact = aliases.where(F.col("alias").isNotNull()).groupBy(F.col("alias").alias("name")).agg(entity.alias("e1"))
    loose = aliases.select(plain_name(F.col("alias")).alias("plain"), "entity_id").where(F.col("plain").isNotNull()).groupBy("plain").agg(entity.alias("e2"))
    owner = aliases.where(F.col("attack_id").isNotNull()).groupBy("attack_id").agg(entity.alias("e4"))
    cross = references.select(plain_name(name).alias("plain"), "attack_id").where(F.col("plain").isNotNull()).join(owner, "attack_id").groupBy("plain").agg(F.min("e4").alias("e4"))
    rows = mentions.select("mention_id", "name", "embedding", plain_name(name).alias("plain")).join(exact, "name", "left").join(loose, "plain", "left").join(cross, "plain", "left")
    over = rows.where(F.coalesce("e1", "e2").isNull()).select(F.col("mention_id").alias("vec_id"), "embedding")
    known = aliases.select(F.col("entity_id").alias("vec_id"), "embedding", F.lit("alias").alias("corpus"))
    alike = score.nearest_all(known, over, k=1, corpora="corpus").where(F.col("similarity") >= least)
    out = rows.join(alike.select(F.col("query_id").alias("mention_id"), F.col("vec_id").alias("e3"), "similarity"), "mention_id", "left")
    stages = {"e1": "exact", "e2": "normalised", "e3": "embedding", "e4": "attack"}
    stage = F.coalesce(*(F.when(F.col(e).isNotNull(), F.lit(s)) for e, s in stages.items()))
    return out.select("mention_id", F.coalesce(*stages).alias("entity_id"), stage.alias("stage"), "similarity")


def corpora(**tables: DataFrame) -> DataFrame:
    """Tables of item_id long, text, source and embedding as one, with the name of each as `corpus`."""
    out = None
    for corpus, rows in tables.items():
        part = rows.select(F.lit(corpus).alias("corpus"), "item_id", "text", "source", "embedding")
        out = part if out is None else out.unionByName(part)
    return out


def context(items: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """For each query the k most similar items of each corpus, texts that several of them share once: query_id, corpus,
    item_id, text, source, similarity, rank within the corpus.

    items: as of corpora(), whose pairs of corpus and item_id are unique; queries: vec_id, embedding. Of equal texts the
    most similar item stays, then the one of the first corpus and smallest id. Texts join the winners alone.
    """
    best = score.nearest_all(items.withColumnRenamed("item_id", "vec_id"), queries, k=k, corpora="corpus").withColumnRenamed("vec_id", "item_id")
    told = best.join(items.select("corpus", "item_id", "text", "source"), ["corpus", "item_id"])
    one = Window.partitionBy("query_id", F.sha2(F.coalesce("text", F.lit("")), 256)).orderBy(F.desc("similarity"), "corpus", "item_id")
    return told.withColumn("nth", F.row_number().over(one)).where("nth = 1").select("query_id", "corpus", "item_id", "text", "source", "similarity", "rank")


def unified_search(
    spark: SparkSession, docs: DataFrame, vectors: DataFrame, edges: DataFrame, links: DataFrame, terms: list[str], vector: list[float], node: str, k: int = 10, depth: int = 100, hops: int = 4
) -> DataFrame:
    """The k best documents by words, vectors and graph together: doc_id, score, and the rank in each, null if none.

    docs: doc_id, text; vectors: doc_id, embedding; edges: source_ref, target_ref; links: doc_id, node. The three
    rankings go `depth` deep: by occurrences of the terms, by cosine, and by the number of relations between `node` and
    a node that the document has. A document's score is the sum of 1 / (60 + rank) over the rankings that have it.
    """
    words = score.lexical_search(docs, terms, depth).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.desc("n_terms"), "doc_id")))
    alike = score.nearest(vectors.select(F.col("doc_id").alias("vec_id"), "embedding", F.lit("all").alias("corpus")), [(0, vector)], depth, "corpus")
    near = links.join(score.reachable(spark, edges, node, hops), "node").groupBy("doc_id").agg(F.min("hops").alias("hops")).orderBy("hops", "doc_id").limit(depth)
    legs = {
        "lexical": words.select("doc_id", "rank"),
        "vector": alike.select(F.col("vec_id").alias("doc_id"), "rank"),
        "graph": near.select("doc_id", F.row_number().over(Window.orderBy("hops", "doc_id")).alias("rank")),
    }
    rows = None
    for leg, ranked in legs.items():
        part = ranked.withColumn("leg", F.lit(leg))
        rows = part if rows is None else rows.unionByName(part)
    ranks = rows.groupBy("doc_id").agg(*(F.min(F.when(F.col("leg") == leg, F.col("rank"))).alias(f"{leg}_rank") for leg in legs))
    total = F.lit(0.0)
    for leg in legs:
        total = total + F.coalesce(1.0 / (F.col(f"{leg}_rank") + FUSION), F.lit(0.0))
    return ranks.select("doc_id", F.round(total, 9).alias("score"), *(f"{leg}_rank" for leg in legs)).orderBy(F.desc("score"), "doc_id").limit(k)
