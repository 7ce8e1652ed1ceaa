"""Digests of ranges of rows, and trees over them: two tables are compared, and appended rows checked, without reading all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources import tables

#: Ids of a leaf, and nodes of a level that make one of the next.
WIDTH, FANOUT = 256, 16


def row_digest(*columns: str) -> Column:
    """Of the values of a row; a null differs from an empty text, and no two rows of other values have the same text."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("-")) for c in columns)), 256)


def _joined(order: str) -> Column:
    """The digest of a group's digests in order."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "digest"))), lambda x: x["digest"]), ""), 256)


def tree(rows: DataFrame, columns: list[str], width: int = WIDTH, fanout: int = FANOUT) -> DataFrame:
    """Nodes of the tree of each chain: chain, level, node, n (rows below), digest, as a table in the shared folder.

    rows: chain, id long (unique in its chain), and the columns that count. A leaf covers `width` ids, so a group holds no more rows
    than that however long a chain is; a node of the next level covers `fanout` nodes, up to one root at node 0 or the pair
    of -1 and 0 where ids are negative. A null chain is a chain of its own.
    """
    leaves = rows.select("chain", "id", F.floor(F.col("id") / width).alias("node"), row_digest("id", *columns).alias("digest"))
    level = tables.written(leaves.groupBy("chain", "node").agg(F.count("*").alias("n"), _joined("id").alias("digest")).withColumn("level", F.lit(0)))
    out, k = level, 0
    while not level.where((F.col("node") > 0) | (F.col("node") < -1)).isEmpty():
        k += 1
        up = level.withColumn("parent", F.floor(F.col("node") / fanout))
        level = tables.written(up.groupBy("chain", "parent").agg(F.sum("n").alias("n"), _joined("node").alias("digest")).select("chain", F.col("parent").alias("node"), "n", "digest", F.lit(k).alias("level")))
        out = out.unionByName(level)
    return out.select("chain", "level", "node", "n", "digest")


def unequal(left: DataFrame, right: DataFrame, fanout: int = FANOUT) -> tuple[DataFrame, int]:
    """(chain, node of the leaves that differ or that one side lacks; how many nodes were read) of two trees.

    From the roots down only children of unequal nodes are joined. A tree that is less high is compared from its own roots:
    what lies above them in the other has no counterpart and so differs.
    """
    tops = [x.agg(F.max("level")).first()[0] for x in (left, right)]
    top = max((t for t in tops if t is not None), default=0)
    open_, read = None, 0
    for k in range(top, -1, -1):
        sides = [x.where(F.col("level") == k).select("chain", "node", F.col("digest").alias(d)) for x, d in ((left, "a"), (right, "b"))]
        if open_ is not None:
            keep = open_.select(F.col("chain").alias("c"), F.col("node").alias("p"))
            sides = [s.join(keep, F.col("chain").eqNullSafe(F.col("c")) & (F.floor(F.col("node") / fanout) == F.col("p")), "left_semi") for s in sides]
        a, b = sides[0].alias("x"), sides[1].alias("y")
        both = a.join(b, F.col("x.chain").eqNullSafe(F.col("y.chain")) & (F.col("x.node") == F.col("y.node")), "full")
        met = tables.written(both.select(F.coalesce("x.chain", "y.chain").alias("chain"), F.coalesce("x.node", "y.node").alias("node"), "a", "b"))
        read += met.count()
        open_ = met.where(~F.col("a").eqNullSafe(F.col("b"))).select("chain", "node")
    return open_, read


def differences(left: DataFrame, right: DataFrame, columns: list[str], width: int = WIDTH, fanout: int = FANOUT, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Rows that differ: chain, id, op (add, remove, replace; from left to right). Rows of equal segments are never joined; with
    stored `trees` they aren't hashed again either."""
    a, b = trees or (tree(left, columns, width, fanout), tree(right, columns, width, fanout))
    leaves = unequal(a, b, fanout)[0].select(F.col("chain").alias("c"), F.col("node").alias("leaf"))
    own = lambda x, d: x.join(leaves, F.col("chain").eqNullSafe(F.col("c")) & (F.floor(F.col("id") / width) == F.col("leaf")), "left_semi").select("chain", "id", row_digest("id", *columns).alias(d))
    x, y = own(left, "a").alias("x"), own(right, "b").alias("y")
    both = x.join(y, F.col("x.chain").eqNullSafe(F.col("y.chain")) & (F.col("x.id") == F.col("y.id")), "full")
    op = F.when(F.col("a").isNull(), "add").when(F.col("b").isNull(), "remove").when(F.col("a") != F.col("b"), "replace")
    return both.select(F.coalesce("x.chain", "y.chain").alias("chain"), F.coalesce("x.id", "y.id").alias("id"), op.alias("op")).where(F.col("op").isNotNull())


def appended(known: DataFrame, rows: DataFrame, columns: list[str], width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(leaves of rows that come after what a stored tree covers, to be kept beside it; rows that change what it covers).

    known: a stored tree, of which the last leaf of a chain may be open; rows: a batch that should only append, with the
    open leaf's rows. Only the batch is hashed: a leaf that was full and a leaf with fewer rows than before are changes.
    """
    old = known.where("level = 0").select(F.col("chain").alias("c"), F.col("node").alias("k"), F.col("n").alias("before"), F.col("digest").alias("was"))
    last = old.groupBy("c").agg(F.max("k").alias("open")).withColumnRenamed("c", "o")
    fresh = tree(rows, columns, width).where("level = 0")
    met = fresh.join(old, F.col("chain").eqNullSafe(F.col("c")) & (F.col("node") == F.col("k")), "left").join(last, F.col("chain").eqNullSafe(F.col("o")), "left")
    changed = (F.col("was").isNotNull() & (F.col("digest") != F.col("was")) & ((F.col("node") < F.col("open")) | (F.col("n") <= F.col("before")))) | (F.col("was").isNull() & (F.col("node") < F.col("open")))
    judged = met.withColumn("changed", F.coalesce(changed, F.lit(False)))
    return judged.where("not changed").select("chain", "node", "n", "digest"), judged.where("changed").select("chain", "node", "n", "digest")
