"""Source divergence audit: how far the term frequencies of each source stand from those of the others and of the language."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Terms alone are left of UTF-8, in small letters; what stands between them becomes spaces.
_TERMS = bytes(c if c >= 0x80 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
#: Different terms of its groups that a task sums before it sends them on.
HELD = 1 << 18


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d): occurrences and documents, summed where texts are read before they are shuffled."""
    import pyarrow as pa

    def sent(held):
        keys = [(lang, source, term, own[term], n) for (lang, source), (every, own) in held.items() for term, n in every.items()]
        lang, source, term, d, n = zip(*keys, strict=True) if keys else [()] * 5
        columns = [pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "d"])

    def count(batches):
        held: dict[tuple, tuple[Counter, Counter]] = {}
        size = 0
        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), common.utf8(b.column("text")), strict=True):
                every, own = held.setdefault((lang, source), (Counter(), Counter()))
                terms = text.translate(_TERMS).split()
                size -= len(every)
                every.update(terms)
                own.update(set(terms))
                size += len(every)
                if size >= HELD:
                    yield sent(held)
                    held, size = {}, 0
        yield sent(held)

    rows = docs.select("lang", "source", "text").mapInArrow(count, "lang string, source string, term string, n long, d long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d"))


def price(n: Column, total: Column, v: Column) -> Column:
    """1 + floor(10^9 (n + 2) / (total + 2 v)), exact for counts of any size."""
    wide = "decimal(28,0)"
    top = (n.cast(wide) + F.lit(2).cast("decimal(1,0)")) * F.lit(10**9).cast("decimal(10,0)")
    return (F.lit(1) + F.call_function("div", top, (total + F.lit(2) * v).cast("decimal(20,0)"))).cast("long")


def gap(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q)); both are at most 10^9 + 1, so the square fits."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: for each (lang, source) group the other sources of the language (part `pair`) and its
    `top` own terms (part `term`).

    Terms are runs of letters and of all characters beyond ASCII, A-Z in small letters; a language keeps those that stand
    in at least `least_docs` of its documents. p is a kept term's smoothed share of the group in billionths. A pair's
    value is the sum of floor((p - q)^2 / (p + q)) over all kept terms, a term's is that against the whole language where
    the group has more. All terms are priced without being listed for each pair: histograms of a group's counts give
    what its terms cost where the other has none, joined postings correct the terms that both have, and the terms that
    neither has are a constant.

    Null text, lang and source are empty; a group without terms is a row of each pair all the same, with value 0 where
    the language keeps no term. Each row is a document, so repeated rows count; other columns are ignored.
    """
    c = F.col
    rows = docs.select(*(F.coalesce(x, F.lit("")).alias(x) for x in ("text", "lang", "source")))
    by_term = F.sum("d").over(_window("lang", "term"))
    kept = common.cut(
        counted(rows).withColumn("documents", by_term).withColumn("whole", F.sum("n").over(_window("lang", "term"))).where(c("documents") >= least_docs).select("lang", "source", "term", "n", "whole")
    )
    langs = kept.groupBy("lang", "term").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("all_n"))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("held"))
    zero = F.lit(0).cast("long")
    groups = (
        rows.select("lang", "source").distinct().join(langs, "lang", "left").join(sizes, ["lang", "source"], "left")
        .select("lang", "source", *(F.coalesce(x, zero).alias(x) for x in ("v", "all_n", "total", "held")))
    )
    groups = common.cut(groups.withColumn("none", F.when(c("v") > 0, price(zero, c("total"), c("v"))).otherwise(zero)))
    priced = common.cut(
        kept.join(groups.drop("held"), ["lang", "source"])
        .select("lang", "source", "term", "none", price(c("n"), c("total"), c("v")).alias("p"), price(c("whole"), c("all_n"), c("v")).alias("q"))
    )

    other = groups.select("lang", c("source").alias("item"), c("none").alias("other_none"), c("held").alias("other_held"))
    couples = groups.join(other, "lang").where(c("source") != c("item"))
    neither = couples.select("lang", "source", "item", F.when(c("v") > 0, (c("v") - c("held") - c("other_held")) * gap(c("none"), c("other_none"))).otherwise(zero).alias("value"))
    histogram = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    alone = histogram.join(other, "lang").where(c("source") != c("item")).select("lang", "source", "item", (c("terms") * gap(c("p"), c("other_none"))).alias("value"))
    alone = alone.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    right = priced.select("lang", "term", c("source").alias("item"), c("p").alias("other_p"), c("none").alias("other_none"))
    shared = priced.join(right, ["lang", "term"]).where(c("source") < c("item"))
    fix = gap(c("p"), c("other_p")) - gap(c("p"), c("other_none")) - gap(c("none"), c("other_p")) + gap(c("none"), c("other_none"))
    shared = shared.groupBy("lang", "source", "item").agg(F.sum(fix).alias("value"))

    def turned(x: DataFrame) -> DataFrame:
        """A pair's value is the same from either side."""
        return x.select("lang", c("item").alias("source"), c("source").alias("item"), "value")

    parts = neither.unionByName(alone).unionByName(turned(alone)).unionByName(shared).unionByName(turned(shared))
    pairs = parts.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    own = priced.where(c("p") > c("q")).select("lang", "source", c("term").alias("item"), gap(c("p"), c("q")).alias("value"), F.lit("term").alias("part"))
    order = _window("lang", "source").orderBy(c("value").desc(), c("item"))
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(own.withColumn("rank", F.row_number().over(order)).where(c("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def _window(*keys: str):
    from pyspark.sql import Window

    return Window.partitionBy(*keys)
