"""Which spans of a document enclose which: a sweep over sorted ends with the open spans as its only state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def enclosed(inner: DataFrame, outer: DataFrame, bin_chars: int = 1 << 16) -> DataFrame:
    """Pairs of a span and each span of the same document that encloses it: doc_id, inner_id, outer_id.

    Both: doc_id, id string, char_start, char_end. A span encloses another if it begins no later and ends no earlier; spans that
    are equal enclose each other, and a span of both sides encloses itself, so filter ids where that isn't wanted. A span
    that ends before it begins, or has a null, is in no pair.

    A span goes to the bin in which it begins, and as an outer one to each bin that it reaches into, so a document of any
    length is spread over tasks. Rows of a bin come in the order of their starts, outer ones first; those that are open stay
    in memory and no others, and no document is paired with itself.
    """
    import pyarrow as pa

    s, e = F.col("char_start").cast("long"), F.col("char_end").cast("long")
    whole = lambda df, side: df.where((e >= s) & F.col("id").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.col("id").cast("string").alias("id"), s.alias("s"), e.alias("e"), F.lit(side).alias("side"))
    bins = lambda c: F.floor(F.col(c) / bin_chars)
    outer_ = whole(outer, 0).withColumn("bin", F.explode(F.sequence(bins("s"), bins("e"))))
    rows = outer_.unionByName(whole(inner, 1).withColumn("bin", bins("s")))
    order = ["doc_id", "bin", "s", "side", "id"]
    dealt = rows.repartition("doc_id", "bin").sortWithinPartitions(*order)

    def sweep(batches):
        now, open_ = None, []
        for b in batches:
            at, inner_ids, outer_ids = [], [], []
            columns = [b.column(c).to_pylist() for c in ("doc_id", "bin", "s", "e", "side", "id")]
            for i, (doc, bin_, start, end, side, name) in enumerate(zip(*columns, strict=True)):
                if (doc, bin_) != now:
                    now, open_ = (doc, bin_), []
                if side == 0:
                    open_.append((end, name))
                    continue
                open_ = [x for x in open_ if x[0] >= start]
                for stop, other in open_:
                    if stop >= end:
                        at.append(i)
                        inner_ids.append(name)
                        outer_ids.append(other)
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(inner_ids, pa.string()), pa.array(outer_ids, pa.string())], names=["doc_id", "inner_id", "outer_id"])

    return dealt.mapInArrow(sweep, T.StructType([dealt.schema["doc_id"], T.StructField("inner_id", T.StringType()), T.StructField("outer_id", T.StringType())]))


def nested(sections: DataFrame) -> DataFrame:
    """Sections (doc_id, name, level, char_start, char_end) that reach over the deeper ones that follow them: char_end becomes the
    end of the last section before one of the same or a higher level."""
    import pyarrow as pa

    dealt = sections.select("doc_id", "name", "level", "char_start", "char_end").repartition("doc_id").sortWithinPartitions("doc_id", F.desc("char_start"))

    def reach(batches):
        now, later = None, []
        for b in batches:
            ends = []
            for doc, level, start, end in zip(*(b.column(c).to_pylist() for c in ("doc_id", "level", "char_start", "char_end")), strict=True):
                if doc != now:
                    now, later = doc, []  # sections after this one: (level, start), nearest last
                    last = end
                later = [x for x in later if x[0] <= level]
                ends.append(later[-1][1] if later else last)
                later.append((level, start))
            yield b.set_column(b.schema.get_field_index("char_end"), "char_end", pa.array(ends, b.schema.field("char_end").type))

    return dealt.mapInArrow(reach, dealt.schema)
