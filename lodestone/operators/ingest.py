"""Documents to text, sections, offset maps and chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window


def html_text(html: Column) -> Column:
    """The text of the main article: scripts, styles, comments, navigation, headers and footers go, then all tags."""
    main = F.regexp_extract(html, r"(?is)<(article|main)\b[^>]*>(.*?)</\1>", 2)
    out = F.when(main == "", html).otherwise(main)
    for p in (r"(?s)<!--.*?-->", r"(?is)<(script|style|nav|footer|aside|header|form|noscript)\b[^>]*>.*?</\1>"):
        out = F.regexp_replace(out, p, " ")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for name, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(name), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\n\x0B\f\r]+", " "))


def html_documents(pages: DataFrame, least: int = 200) -> DataFrame:
    """page_id, url, text, error_code: an article under `least` characters is rejected as too short."""
    return pages.select("page_id", "url", html_text(F.col("html")).alias("text")).withColumn("error_code", F.when(F.length("text") < least, "article_too_short"))


def sections(docs: DataFrame) -> DataFrame:
    """Markdown headings: doc_id, name, level, char_start, char_end (to the next heading or the end). Fenced code is no heading.

    A text is read where it is, in Arrow batches; no line is shuffled. A null text has no sections.
    """
    import pyarrow as pa

    from .layout import outline

    def read(batches):
        for b in batches:
            at, rows = [], []
            for i, s in enumerate(b.column("text").to_pylist()):
                for name, start, end, level in outline(s)[0] if s else ():
                    at.append(i)
                    rows.append((name, level, start, end))
            told = zip(*rows, strict=True) if rows else ((), (), (), ())
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(list(c), k) for c, k in zip(told, kinds, strict=True))], names=["doc_id", "name", "level", "char_start", "char_end"])

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("name string, level int, char_start long, char_end long").fields])
    return docs.select("doc_id", "text").mapInArrow(read, schema)


def lines(docs: DataFrame) -> DataFrame:
    """The offset map of plain text: doc_id, line (from 1), char_start, text; a line's newline isn't part of its text.

    Offsets are summed up where the document is, in Arrow batches, so no line is shuffled. A null text has no lines.
    """
    import pyarrow as pa

    def split(batches):
        import numpy as np

        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256).filter(b.slice(i, 256).column("text").is_valid())
                rows = [t.split("\n") for t in part.column("text").to_pylist()]
                n = np.array([len(r) for r in rows], np.int64)
                starts = [np.cumsum([0, *(len(x) + 1 for x in r[:-1])]) for r in rows]
                flat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(flat([np.arange(1, k + 1) for k in n]).astype(np.int32)), pa.array(flat(starts)), pa.array([x for r in rows for x in r], pa.string())],
                    names=["doc_id", "line", "char_start", "text"],
                )

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("line int, char_start long, text string").fields])
    return docs.select("doc_id", "text").mapInArrow(split, schema)


def lookup(queries: DataFrame, offsets: DataFrame, *values: str) -> DataFrame:
    """As-of: to each (doc_id, char_idx) of queries, the values of the offset entry at or nearest before it, else null.

    Both sides are merged in one sort by document and position, so a document's entries aren't paired with its queries.
    """
    q = queries.select("doc_id", "char_idx", F.lit(1).alias("side"), F.lit(None).alias("entry"))
    o = offsets.select("doc_id", F.col("char_start").alias("char_idx"), F.lit(0).alias("side"), F.struct(*values).alias("entry"))
    w = Window.partitionBy("doc_id").orderBy("char_idx", "side").rowsBetween(Window.unboundedPreceding, 0)
    both = o.unionByName(q.withColumn("entry", F.lit(None).cast(o.schema["entry"].dataType)))
    return both.withColumn("entry", F.last("entry", True).over(w)).where("side = 1").select("doc_id", "char_idx", *(F.col(f"entry.{v}").alias(v) for v in values))


def enclosing(spans: DataFrame, within: DataFrame) -> DataFrame:
    """Spans (doc_id, char_start) with the name of the innermost section that began last before them, if it reaches them."""
    found = lookup(spans.select("doc_id", F.col("char_start").alias("char_idx")), within, "name", "char_end")
    return found.select("doc_id", F.col("char_idx").alias("char_start"), F.when(F.col("char_end") > F.col("char_idx"), F.col("name")).alias("section"))


def chunk_windows(docs: DataFrame, size: int = 800, overlap: int = 200) -> DataFrame:
    """Overlapping windows of each text: doc_id, chunk_id, text, char_start, char_end, token_count.

    A window begins every size - overlap characters as long as text is left that the one before doesn't hold. An empty
    or null text has none.
    """
    step = size - overlap
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - size) / step).cast("int"))
    at = F.when(F.length("text") > 0, F.sequence(F.lit(0), last * step, F.lit(step)))
    rows = docs.select("doc_id", "text", F.posexplode_outer(at).alias("i", "char_start")).where(F.col("i").isNotNull())
    piece = F.substring("text", F.col("char_start") + 1, F.lit(size))
    return rows.select("doc_id", F.concat_ws("-", F.lit("c"), F.col("doc_id").cast("string"), F.col("i").cast("string")).alias("chunk_id"), piece.alias("text"), "char_start").select(
        "*", (F.col("char_start") + F.length("text")).alias("char_end"), F.size(F.array_remove(F.split("text", r"[ \t\n\x0B\f\r]+"), "")).alias("token_count")
    )


def assign_chunks(found: DataFrame, size: int = 800, overlap: int = 200) -> DataFrame:
    """Matches of whole documents with the id of the first window that holds them, or the one they begin in."""
    step = size - overlap
    i = F.greatest(F.lit(0), F.ceil((F.col("char_end") - size) / step).cast("int"))
    first = F.least(i, F.floor(F.col("char_start") / step).cast("int"))
    return found.withColumn("chunk_id", F.concat_ws("-", F.lit("c"), F.col("doc_id").cast("string"), first.cast("string")))


def language_gate(docs: DataFrame, language: str = "en", override: bool = False) -> DataFrame:
    """Documents in the language, or all of them; accepted and rejected rows carry error_code."""
    ok = F.lit(override) | (F.col("lang") == language)
    return docs.withColumn("error_code", F.when(~F.coalesce(ok, F.lit(False)), "unsupported_language"))


def ocr_needed(pages: DataFrame, least: int = 50) -> DataFrame:
    """Pages with an image and under `least` characters of text. pages: doc_id, page, text, n_images."""
    return pages.where((F.length(F.coalesce("text", F.lit(""))) < least) & (F.col("n_images") >= 1))


def ocr_text(words: DataFrame, least: float = 60.0) -> DataFrame:
    """Words of an OCR table with enough confidence, joined in reading order: doc_id, page, text."""
    good = words.where(F.col("conf") >= least)
    return good.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("top", "left", "word"))), lambda x: x["word"]), " ").alias("text"))


def raw_keys(docs: DataFrame) -> DataFrame:
    """Content addresses: doc_id, sha256, key raw/<two digits>/<sha256>."""
    h = F.sha2(F.col("text"), 256)
    return docs.select("doc_id", h.alias("sha256")).withColumn("key", F.concat_ws("/", F.lit("raw"), F.substring("sha256", 1, 2), "sha256"))


def distinct_documents(docs: DataFrame) -> DataFrame:
    """The smallest doc_id of each content: sha256, doc_id, n_copies."""
    return raw_keys(docs).groupBy("sha256").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"))


def unprocessed(docs: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("doc_id", "pipeline_version", "extractor_version")) -> DataFrame:
    """Documents that no finished run with the same versions has seen."""
    return docs.join(done.select(*keys).distinct(), list(keys), "left_anti")
