"""What a text's lines say about its parts: parsed documents as nested rows, and chunks that keep to sections."""

from __future__ import annotations

import re
from bisect import bisect_right

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_FENCE = re.compile(r"\s*(?:```|~~~)", re.ASCII)
_HEADING = re.compile(r"(#{1,6})\s+(?=\S)(.*?)\s*#*\s*\Z", re.ASCII | re.DOTALL)
_ROW = re.compile(r"\s*\|.*\|\s*\Z", re.ASCII | re.DOTALL)
SECTIONS = "array<struct<name:string,char_start:int,char_end:int,level:int>>"
OFFSETS = "array<struct<char_idx:int,page:int,line:int>>"
PARSED = f"sections {SECTIONS}, offset_map {OFFSETS}"


def outline(text: str) -> tuple[list[tuple[str, int, int, int]], list[tuple[int, int]], list[int]]:
    """Sections (name, start, end, level), spans that must stay whole (headings, fenced code, table rows) and line starts.

    Fenced code holds no headings; a fence that isn't closed reaches to the end.
    """
    heads, whole, starts, at, fence = [], [], [], 0, None
    for line in text.split("\n"):
        starts.append(at)
        end = at + len(line)
        if _FENCE.match(line):
            if fence is None:
                fence = at
            else:
                whole.append((fence, end))
                fence = None
        elif fence is None:
            if h := _HEADING.match(line):
                heads.append((h[2], at, len(h[1])))
                whole.append((at, end))
            elif _ROW.match(line):
                whole.append((at, end))
        at = end + 1
    if fence is not None:
        whole.append((fence, len(text)))
    ends = [*(h[1] for h in heads[1:]), len(text)][: len(heads)]
    return [(name, start, end, level) for (name, start, level), end in zip(heads, ends, strict=True)], whole, starts


def pieces(text: str, size: int, overlap: int):
    """(section, start, end) of each chunk: windows of at most `size` characters that keep to a section and begin `overlap`
    before the last one's end. One that would cut a span that must stay whole ends or begins at the span's edge instead;
    a longer span is a chunk of its own."""
    sections, whole, _ = outline(text)
    first = [w[0] for w in whole]

    def around(at: int) -> tuple[int, int] | None:
        k = bisect_right(first, at) - 1
        return whole[k] if k >= 0 and whole[k][0] < at < whole[k][1] else None

    parts = [(None, 0, sections[0][1] if sections else len(text))] + [s[:3] for s in sections]
    for name, start, last in parts:
        while start < last:
            end = min(start + size, last)
            if cut := around(end):
                end = cut[0] if cut[0] > start else cut[1]
            yield name, start, end
            if end >= last:
                break
            after = max(end - overlap, start + 1)
            if cut := around(after):
                after = cut[0] if cut[0] > start else cut[1]
            start = after


def section_chunks(docs: DataFrame, size: int = 800, overlap: int = 200) -> DataFrame:
    """Chunks that keep to sections: doc_id, chunk_id, section, text, char_start, char_end, token_count.

    Text before the first heading has no section name. Without headings, fences and table rows these are the plain
    windows. An empty or null text has none. Each document is cut where it is scanned, without a shuffle.
    """
    import pyarrow as pa

    if not 0 <= overlap < size:
        raise ValueError("overlap must be less than size")

    def cut(batches):
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                rows = [(k, n, name, text[s:e], s, e) for k, text in enumerate(part.column("text").to_pylist()) for n, (name, s, e) in enumerate(pieces(text or "", size, overlap))]
                at, number, name, piece, start, end = zip(*rows, strict=True) if rows else [()] * 6
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(at, pa.int64())), pa.array(number, pa.int32()), pa.array(name, pa.string()), pa.array(piece, pa.string()), pa.array(start, pa.int32()), pa.array(end, pa.int32())],
                    names=["doc_id", "number", "section", "text", "char_start", "char_end"],
                )

    schema = T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("number int, section string, text string, char_start int, char_end int").fields])
    rows = docs.select("doc_id", "text").mapInArrow(cut, schema)
    chunk = F.concat_ws("-", F.lit("c"), F.col("doc_id").cast("string"), F.col("number").cast("string"))
    tokens = F.size(F.array_remove(F.split("text", r"[ \t\n\x0B\f\r]+"), ""))
    return rows.select("doc_id", chunk.alias("chunk_id"), "section", "text", "char_start", "char_end", tokens.alias("token_count"))


def parsed(docs: DataFrame, source_format: Column, language: Column | None = None, metadata: Column | None = None) -> DataFrame:
    """A nested row for each document: doc_id, text, sections, offset_map, metadata, source_format, language.

    Markdown has sections; Markdown and plain text have an offset entry for each line; other formats have neither. A null
    text is empty, a null language is en.
    """

    def marks(batches):
        import pyarrow as pa

        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                sections, offsets = [], []
                for text, kind in zip(part.column("text").to_pylist(), part.column("source_format").to_pylist(), strict=True):
                    found, _, starts = outline(text)
                    sections.append([{"name": n, "char_start": s, "char_end": e, "level": v} for n, s, e, v in found] if kind == "md" else [])
                    offsets.append([{"char_idx": s, "page": None, "line": k} for k, s in enumerate(starts, 1)] if kind in ("md", "txt") and text else [])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(sections, section), pa.array(offsets, offset)], names=[*part.schema.names, "sections", "offset_map"])

    from pyspark.sql.pandas.types import to_arrow_type

    section, offset = (to_arrow_type(T._parse_datatype_string(t)) for t in (SECTIONS, OFFSETS))
    rows = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(metadata if metadata is not None else F.create_map().cast("map<string,string>"), F.create_map().cast("map<string,string>")).alias("metadata"),
        source_format.alias("source_format"), F.coalesce(language if language is not None else F.lit("en"), F.lit("en")).alias("language"),
    )
    out = rows.mapInArrow(marks, T.StructType([*rows.schema.fields, *T._parse_datatype_string(PARSED).fields]))
    return out.select("doc_id", "text", "sections", "offset_map", "metadata", "source_format", "language")
