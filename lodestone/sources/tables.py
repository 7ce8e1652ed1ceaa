"""Relational tables of the library as managed Parquet tables, with the uniqueness that they promise."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_COMMON = "id STRING, created_at TIMESTAMP, updated_at TIMESTAMP"

#: Columns and unique keys of each table.
TABLES = {
    "documents": (f"{_COMMON}, source_uri STRING, sha256 STRING, title STRING, language STRING, mime_type STRING, source_format STRING, status STRING", ("sha256",)),
    "chunks": (f"{_COMMON}, document_id STRING, section STRING, page INT, text STRING, char_start INT, char_end INT, token_count INT", ("id",)),
    "evidence_spans": (f"{_COMMON}, chunk_id STRING, text_span STRING, char_start INT, char_end INT", ("id",)),
    "ioc_candidates": (f"{_COMMON}, document_id STRING, type STRING, value STRING, normalized STRING, evidence_ids ARRAY<STRING>, confidence DECIMAL(3,2), extractor STRING", ("document_id", "type", "normalized")),
    "stix_objects": (f"{_COMMON}, type STRING, stix_id STRING, document_id STRING, json STRING, hash STRING, version INT", ("stix_id",)),
    "stix_relationships": (f"{_COMMON}, source_ref STRING, target_ref STRING, relationship_type STRING, document_id STRING, json STRING", ("id",)),
    "model_runs": (f"{_COMMON}, document_id STRING, model STRING, version STRING, prompt_hash STRING, input_hash STRING, output_hash STRING, started_at TIMESTAMP, ended_at TIMESTAMP, cost_usd DECIMAL(10,6)", ("id",)),
    "exports": (f"{_COMMON}, target_system STRING, bundle_hash STRING, response STRING, exported_by STRING, status STRING", ("id",)),
    "audit_logs": ("id BIGINT, prev_hash STRING, hash STRING, actor STRING, action STRING, target_type STRING, target_id STRING, payload STRING", ("hash",)),
}


def create(spark: SparkSession, database: str = "default") -> None:
    for name, (columns, _) in TABLES.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}) USING parquet")


def append(rows: DataFrame, name: str, database: str = "default") -> None:
    """Appends rows whose unique key the table doesn't have yet; of rows that share a new key the smallest id goes in.

    Missing columns are null. The table is read before it is written to, and one writer at a time is assumed.
    """
    spark, (columns, key) = rows.sparkSession, TABLES[name]
    held = spark.table(f"{database}.{name}")
    known = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in held.schema.fields]
    whole = rows.select(*known)
    first = whole.groupBy(*key).agg(F.min_by(F.struct(*whole.columns), "id").alias("r")).select("r.*") if key != ("id",) else whole.dropDuplicates(["id"])
    first.join(held.select(*key), list(key), "left_anti").select(*held.columns).write.mode("append").insertInto(f"{database}.{name}")


class Unit:
    """A unit of work over several tables: rows are staged first, and go into the tables at the commit or not at all.

    A failure while rows are computed leaves every table as it was. A commit that is broken off is repeated with `commit` on a
    Unit of the same name: what is staged is still there, rows whose keys arrived stay single, and the staged rows go last.
    As a context it commits at the end, or rolls back if its block fails.
    """

    def __init__(self, spark: SparkSession, name: str, database: str = "default"):
        self.spark, self.database = spark, database
        self.path = f"{shared_folder(spark)}/unit-{name}"

    def _files(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def stage(self, rows: DataFrame, name: str) -> None:
        """Computes rows for a table and keeps them aside; staging a table again in the unit replaces its rows."""
        if name not in TABLES:
            raise KeyError(name)
        rows.write.mode("overwrite").parquet(f"{self.path}/{name}")

    def staged(self) -> list[str]:
        """Tables whose rows are whole, in the order of TABLES, in which those that others refer to come first."""
        files, path = self._files()
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return [n for n in TABLES if files.exists(done(f"{self.path}/{n}/_SUCCESS"))] if files.exists(path) else []

    def commit(self) -> list[str]:
        names = self.staged()
        for name in names:
            append(self.spark.read.parquet(f"{self.path}/{name}"), name, self.database)
        self.rollback()
        return names

    def rollback(self) -> None:
        """Forgets what is staged."""
        files, path = self._files()
        files.delete(path, True)

    def __enter__(self) -> Unit:
        return self

    def __exit__(self, kind, *_) -> None:
        self.commit() if kind is None else self.rollback()


def read_jdbc(spark: SparkSession, url: str, name: str, **options) -> DataFrame:
    """A table of a database, split by options as spark.read.jdbc takes them (column, lowerBound, upperBound, numPartitions)."""
    return spark.read.jdbc(url, name, **options)


def write_jdbc(rows: DataFrame, url: str, name: str, **properties) -> None:
    rows.write.mode("append").jdbc(url, name, properties=properties)


def spread(df: DataFrame, rows: int = 1 << 14) -> DataFrame:
    """The rows dealt anew, about `rows` of them to a partition, and to twice as many partitions as the cluster has cores at least.

    How many splits a file has doesn't say how its rows stand in them: a row group goes to one split whole, and narrow rows of which
    each becomes a text are few bytes. So rows are counted, and what is made of them grows with the number of tasks, not within one.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(max(2 * cores, -(-df.count() // rows)))


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as spark.checkpoint.dir names it. Only a local session gets one of its
    own where none is set; on a cluster that would lose data, so there it is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp()
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, by: str | None = None, deal: bool = False) -> DataFrame:
    """The rows as a table in the shared folder: what comes before is neither planned nor run again.

    With `by` the table is bucketed by that column, in as many buckets as shuffles have partitions, so that groupings and joins
    by it read the buckets and shuffle nothing. `deal` shuffles the rows to their buckets first; rows that stand by `by` already
    need that not.
    """
    spark, name = df.sparkSession, f"lodestone_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    if by is None:
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartition(n, by) if deal else df
    rows.write.bucketBy(n, by).format("parquet").option("path", path).saveAsTable(name)
    return spark.table(name)
