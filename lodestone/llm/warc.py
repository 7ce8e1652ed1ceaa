"""WARC: crawls written as monolithic gzip, normalised to one gzip member a record with a sidecar offset index."""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

LEAST_REVISIT = 100


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record(headers: dict[str, str], http: bytes, payload: bytes) -> bytes:
    """A WARC/1.1 record. Header values lose control characters, which would end a line."""
    block = http + payload
    lines = [f"{k}: {''.join(c if c.isprintable() else '%%%02X' % ord(c) for c in v)}" for k, v in headers.items()]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {len(block)}"])
    return head.encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes | bytearray, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The first whole record's headers and block from `at` on, and where it ends; the end is `at` if data ends before it."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return {}, b"", at
    headers = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
    start, n = end + 4, int(headers["Content-Length"])
    if len(data) < start + n + 4:
        return {}, b"", at
    return headers, bytes(data[start : start + n]), start + n + 4


def records(stream, step: int = 1 << 20):
    """Headers and block of each record of one gzip stream, inflated once from front to back."""
    inflate, held = zlib.decompressobj(31), bytearray()
    while raw := stream.read(step):
        while raw:
            held += inflate.decompress(raw)
            raw = inflate.unused_data
            if raw:  # a member ended within these bytes
                inflate = zlib.decompressobj(31)
        used = 0
        while True:
            headers, block, end = parse(held, used)
            if end == used:
                break
            used = end
            yield headers, block
        del held[:used]
    if held:
        raise ValueError(f"the archive ends inside a record: {len(held)} bytes left")


def _headers(kind: str, page: int | None, url: str | None, digest: str, size: int) -> dict[str, str]:
    out = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>", "WARC-Date": "1970-01-01T00:00:00Z"}
    if url is not None:
        out["WARC-Target-URI"] = url
    return out | {"Content-Type": "application/http;msgtype=response", "WARC-Payload-Digest": f"sha256:{digest}", "X-Page-ID": str(page), "X-Payload-Length": str(size)}


def write_monolithic(pages: DataFrame, folder: str, archive_bytes: int) -> DataFrame:
    """Writes each partition's pages as archives of one gzip stream; a row for each record: file, seq, page_id, size, digest."""
    import pyarrow as pa

    def write(batches):
        fs, top = _fs(folder)
        fs.create_dir(top, recursive=True)
        sink = None
        for b in batches:
            rows = {"file": [], "seq": [], "page_id": [], "size": [], "digest": []}
            for page, url, html in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if sink is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    raw = fs.open_output_stream(f"{top}/{name}", compression=None)
                    sink, seq, written = gzip.GzipFile(fileobj=raw, mode="wb", compresslevel=1, mtime=0), 0, 0
                payload = html.encode()
                digest = hashlib.sha256(payload).hexdigest()
                http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
                sink.write(record(_headers("response", page, url, digest, len(payload)), http, payload))
                for k, v in zip(rows, (name, seq, page, len(payload), digest), strict=True):
                    rows[k].append(v)
                seq, written = seq + 1, written + len(payload)
                if written >= archive_bytes:
                    sink.close()
                    raw.close()
                    sink = None
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.string() if k in ("file", "digest") else pa.int64()) for k, v in rows.items()})
        if sink is not None:
            sink.close()
            raw.close()

    return pages.mapInArrow(write, "file string, seq long, page_id long, size long, digest string")


def normalise(decisions: DataFrame, source: str, target: str) -> DataFrame:
    """Rewrites each monolithic archive with one gzip member a record, and beside it a sidecar index of offsets.

    decisions: file, seq, page_id, refers_to (the page that a record revisits, else null). A row for each new file.
    Listings are small beside the archives, so tasks are dealt by the number of archives.
    """
    import pyarrow as pa

    def rewrite(table):
        name = table.column("file")[0].as_py()
        revisits = {s: r for s, r in zip(table.column("seq").to_pylist(), table.column("refers_to").to_pylist(), strict=True) if r is not None}
        source_fs, source_top = _fs(source)
        fs, top = _fs(target)
        fs.create_dir(top, recursive=True)
        out = f"{uuid.uuid4().hex}.warc.gz"
        offset, n = 0, 0
        with source_fs.open_input_stream(f"{source_top}/{name}", compression=None) as stream, fs.open_output_stream(f"{top}/{out}", compression=None) as sink, fs.open_output_stream(f"{top}/{out}.idx", compression=None) as index:
            for n, (headers, block) in enumerate(records(stream), 1):
                headers.pop("Content-Length")
                if n - 1 in revisits:
                    to = revisits[n - 1]
                    headers |= {"WARC-Type": "revisit", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{to}')}>", "X-Refers-To-Page": str(to)}
                    block = block[: block.find(b"\r\n\r\n") + 4]
                member = gzip.compress(record(headers, b"", block), 6, mtime=0)
                sink.write(member)
                index.write((json.dumps({"offset": offset, "length": len(member), "page": headers["X-Page-ID"], "url": headers.get("WARC-Target-URI")}) + "\n").encode())
                offset += len(member)
        if n != len(table):
            raise ValueError(f"{name} has {n} records, {len(table)} were written")
        return pa.table({"file": [out], "records": pa.array([n], pa.int64())})

    n = _tasks(decisions.sparkSession, decisions.select("file").distinct().count())
    return decisions.repartition(n, "file").groupBy("file").applyInArrow(rewrite, "file string, records long")


def _tasks(spark, files: int) -> int:
    """One archive a task as long as the cluster has cores for them, up to eight beyond."""
    return max(1, min(files, 4 * spark.sparkContext.defaultParallelism), files // 8)


def read_back(files: DataFrame, folder: str) -> DataFrame:
    """A row for each record of normalised archives, found through their sidecar indexes and read member by member."""
    import pyarrow as pa

    columns = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "file": pa.string(), "offset": pa.int64()}

    def read(batches):
        fs, top = _fs(folder)
        for name in (n for b in batches for n in b.column("file").to_pylist()):
            with fs.open_input_stream(f"{top}/{name}.idx", compression=None) as f:
                entries = [json.loads(x) for x in f.read().splitlines()]
            rows = []
            with fs.open_input_file(f"{top}/{name}") as f:
                for e in entries:
                    f.seek(e["offset"])
                    headers, block, _ = parse(gzip.decompress(f.read(e["length"])))
                    digest, size = headers["WARC-Payload-Digest"].removeprefix("sha256:"), int(headers["X-Payload-Length"])
                    if headers["WARC-Type"] == "response":
                        payload = block[block.find(b"\r\n\r\n") + 4 :]
                        if (hashlib.sha256(payload).hexdigest(), len(payload)) != (digest, size):
                            raise ValueError(f"{name} at {e['offset']}: the payload isn't what its header says")
                    rows.append((int(headers["X-Page-ID"]), size, digest, headers["WARC-Type"], int(headers["X-Refers-To-Page"]) if "X-Refers-To-Page" in headers else None, name, e["offset"]))
            for i in range(0, len(rows), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 10_000], strict=True), columns.values(), strict=True)], names=list(columns))

    return files.select("file").mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long")


def warc(pages: DataFrame, folder: str | None = None, archive_bytes: int = 16 << 20) -> DataFrame:
    """One row per page, as read back from the archives: page_id, payload_bytes, payload_digest, record_type,
    refers_to, file, offset. The archives and their .idx sidecars stay in `folder`/warc.

    The payload is the html in UTF-8 (null: empty). Of records with equal payloads of at least 100 bytes, that with
    the smallest page_id is the response (of rows that repeat it, the first written) and the others revisit it;
    smaller ones are all responses. Null ids count as the largest and come back as null; a null url writes no
    target URI. An empty table gives no rows; extra columns are ignored.

    `folder` must be one that executors share; by default a new one under spark.checkpoint.dir. What each step has
    written is listed in a table there before the next one starts, so a lost executor repeats no step's names.
    """
    spark = pages.sparkSession
    top = folder or f"{common.shared_folder(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    source = pages.select(F.coalesce(F.col("page_id").cast("long"), F.lit(common.NULL_ID)).alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    write_monolithic(source, f"{top}/crawl", archive_bytes).write.parquet(f"{top}/crawl-list")
    written = spark.read.parquet(f"{top}/crawl-list")
    first = written.where(F.col("size") >= LEAST_REVISIT).groupBy("digest", "size").agg(F.min(F.struct("page_id", "file", "seq")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    same = (F.col("first.file") == F.col("file")) & (F.col("first.seq") == F.col("seq"))
    decisions = written.join(first, ["digest", "size"], "left").select("file", "seq", "page_id", F.when(F.col("first").isNotNull() & ~same, F.col("first.page_id")).alias("refers_to"))
    normalise(decisions, f"{top}/crawl", f"{top}/warc").write.parquet(f"{top}/warc-list")
    fs, path = _fs(f"{top}/crawl")
    if fs.get_file_info(path).type.name == "Directory":
        fs.delete_dir(path)
    files = spark.read.parquet(f"{top}/warc-list")
    n = _tasks(spark, files.count())
    return read_back(files.repartition(n), f"{top}/warc").withColumn("page_id", common.own_id("page_id")).withColumn("refers_to", common.own_id("refers_to"))
