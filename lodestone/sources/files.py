"""A data source for folders of report files of all kinds, for batches and streams."""

from __future__ import annotations

import posixpath
import time
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..operators import tagtree

SCHEMA = "uri string, byte_start long, byte_end long, source_format string, text string, error_code string"
#: Kinds of file by their suffix.
SUFFIXES = {".pdf": "pdf", ".html": "html", ".htm": "html", ".md": "md", ".markdown": "md", ".txt": "txt", ".log": "txt"}
#: What opening a file costs, in bytes, so that a partition of tiny files has an end.
OPENING = 1 << 16


class Ranges(InputPartition):
    """Ranges of files that one task reads: (path, start, end, size of the file)."""

    def __init__(self, ranges: list[tuple[str, int, int, int]]):
        super().__init__(ranges)


def _line_after(f, at: int, most: int, size: int) -> int | None:
    """Where the first line begins after the newline at `at` or beyond it; the size if the file ends first, None if neither
    comes before `most`."""
    f.seek(at)
    while at < min(most, size):
        part = f.read(min(1 << 16, most - at))
        if not part:
            return size
        k = part.find(b"\n")
        if k >= 0:
            return at + k + 1
        at += len(part)
    return size if at >= size else None


class _Files:
    """Listing, dealing and reading, as the batch and the stream reader share them."""

    def __init__(self, options):
        self.uri = options["path"]
        self.split = max(1, int(options.get("split_bytes", 32 << 20)))
        self.most = int(options.get("max_bytes", 256 << 20))
        self.settle = float(options.get("settle_seconds", 1))
        self.kinds = {k for k in options.get("formats", "").split(",") if k}

    def system(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri)

    def listed(self) -> list:
        """Files below the path; like Spark's own sources it passes over names that begin with _ or a dot."""
        from pyarrow import fs

        system, root = self.system()
        if system.get_file_info(root).type == fs.FileType.File:
            return [system.get_file_info(root)]
        infos = system.get_file_info(fs.FileSelector(root, recursive=True))
        seen = [i for i in infos if i.type == fs.FileType.File and not any(p[0] in "_." for p in i.path[len(root) :].strip("/").split("/"))]
        return [i for i in seen if not self.kinds or self.kind(i.path) in self.kinds]

    @staticmethod
    def kind(path: str) -> str | None:
        return SUFFIXES.get(posixpath.splitext(path)[1].lower())

    def dealt(self, infos) -> list[Ranges]:
        """Plain text in ranges of `split_bytes`, other files whole; small ones share a partition."""
        out, held, room = [], [], self.split
        for i in sorted(infos, key=lambda i: i.path):
            step = self.split if self.kind(i.path) == "txt" else max(1, i.size)
            for start in range(0, max(1, i.size), step):
                end = min(start + step, i.size)
                cost = end - start + min(OPENING, self.split)
                if held and cost > room:
                    out.append(Ranges(held))
                    held, room = [], self.split
                held.append((i.path, start, end, i.size))
                room -= cost
        return [*out, Ranges(held)] if held else out

    def rows(self, system, path: str, start: int, end: int, size: int) -> Iterator[tuple]:
        kind = self.kind(path)
        row = lambda a, b, text, error: (path, a, b, kind, text, error)
        if kind not in ("html", "md", "txt"):
            yield row(start, end, None, "unsupported_format")
            return
        if kind != "txt" and size > self.most:
            yield row(start, end, None, "file_too_large")
            return
        try:
            with system.open_input_file(path) as f:
                begin, lost = start, None
                if start:
                    begin = _line_after(f, start - 1, end, size)
                    if begin is None or begin >= end:
                        return
                stop = end if end >= size else _line_after(f, end - 1, end + self.most, size)
                f.seek(begin)
                data = f.read((end if stop is None else stop) - begin)
                if stop is None:
                    stop = begin + data.rfind(b"\n") + 1
                    data, lost = data[: stop - begin], row(stop, end, None, "line_too_long")
        except OSError:
            yield row(start, end, None, "unreadable")
            return
        if stop > begin or size == 0:
            try:
                yield row(begin, stop, data.decode("utf-8"), None)
            except UnicodeDecodeError:
                yield row(begin, stop, None, "not_utf8")
        if lost:
            yield lost

    def read(self, partition: Ranges):
        import pyarrow as pa

        names = [c.split()[0] for c in SCHEMA.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        system, _ = self.system()
        held, size = [], 0
        for one in partition.value:
            for row in self.rows(system, *one):
                held.append(row)
                size += len(row[4] or "")
                if size > 8 << 20 or len(held) >= 1000:
                    yield batch(held)
                    held, size = [], 0
        if held:
            yield batch(held)


class _Batch(_Files, DataSourceReader):
    def partitions(self):
        return self.dealt(self.listed())


class _Stream(_Files, DataSourceStreamReader):
    """Files in the order of (modification time, path); the offset is the last one read, so it doesn't grow with them.

    A file is taken `settle_seconds` after its last change. Files must be moved into the folder whole, with a time not before
    those already there.
    """

    def initialOffset(self):
        return {"time": -1, "path": ""}

    def latestOffset(self):
        now = time.time_ns() - int(self.settle * 1e9)
        at = max(((i.mtime_ns, i.path) for i in self.listed() if i.mtime_ns <= now), default=(-1, ""))
        return {"time": at[0], "path": at[1]}

    def partitions(self, start, end):
        after, until = ((o["time"], o["path"]) for o in (start, end))
        return self.dealt([i for i in self.listed() if after < (i.mtime_ns, i.path) <= until])


class ReportFiles(DataSource):
    """`report_files`: a row for each file, or for each range of lines of a plain text file that is longer than `split_bytes`.

    Parts of a file follow each other: their texts, in the order of byte_start, are the file. What can't be read is a row with
    an error code: unsupported_format (PDF and unknown kinds), file_too_large (not plain text and beyond `max_bytes`),
    line_too_long (a line beyond it; other lines stay), unreadable, not_utf8. An empty file is a row of empty text.
    Other options: `formats`, a list of kinds by commas; `settle_seconds`, of a stream.
    """

    @classmethod
    def name(cls):
        return "report_files"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """The files below a path, as ReportFiles has them."""
    spark.dataSource.register(ReportFiles)
    return spark.read.format("report_files").options(**options).load(path)


def read_stream(spark: SparkSession, path: str, **options) -> DataFrame:
    """The same rows as a stream: files that are there first, then new ones."""
    spark.dataSource.register(ReportFiles)
    return spark.readStream.format("report_files").options(**options).load(path)


def with_main_text(rows: DataFrame, least: int = 200) -> DataFrame:
    """HTML as its main text, by the tree of its elements; one under `least` characters gets the code article_too_short."""
    html = F.col("source_format") == "html"
    text = F.when(html, tagtree.tree_text(F.when(html, F.col("text")))).otherwise(F.col("text"))
    return rows.withColumn("text", text).withColumn("error_code", F.when(html & (F.length("text") < least), "article_too_short").otherwise(F.col("error_code")))
