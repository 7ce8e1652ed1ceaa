"""Streams with state of their own: audit chains whose head is kept, and documents whose known indicators are kept.

Both need the RocksDB state store: set spark.sql.streaming.stateStore.providerClass, as `use_rocksdb` does.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..functions import fixed
from ..operators import extract

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LINKED = "chain string, id long, payload string, ms long, prev_hash string, hash string"
SEEN = "doc_id long, type string, normalized string, n int, event string"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


class _Chain(StatefulProcessor):
    """Keeps the head of a chain, and rows that wait until no earlier one can come."""

    def init(self, handle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "hash string")
        self.waiting = handle.getListState("waiting", "id long, payload string, at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        late = timerValues.getCurrentWatermarkInMs()
        due = set()
        for frame in rows:
            for i, payload, at in zip(frame["id"].tolist(), frame["payload"], frame["ms"].tolist(), strict=True):
                if at > late:
                    self.waiting.appendValue((i, payload, at))
                    due.add(at)
        for at in due:
            self.handle.registerTimer(at)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        import hashlib

        upto = expiredTimerInfo.getExpiryTimeInMs()
        rows = sorted(((at, i, p) for i, p, at in self.waiting.get()), key=lambda r: r[:2])
        ready, rest = [r for r in rows if r[0] <= upto], [r for r in rows if r[0] > upto]
        last, out = self.head.get()[0] if self.head.exists() else fixed.GENESIS, []
        for at, i, payload in ready:
            own = hashlib.sha256(f"{last}|{payload or '{}'}".encode()).hexdigest()
            out.append((key[0], i, payload, at, last, own))
            last = own
        if ready:
            self.head.update((last,))
            self.waiting.clear()
            if rest:
                self.waiting.put([(i, p, at) for at, i, p in rest])
            yield pd.DataFrame(out, columns=_names(LINKED))

    def close(self) -> None:
        pass


def chains(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of chain string, id long, payload (canonical JSON) and at timestamp as links of audit chains: prev_hash and hash too.

    A row waits until the watermark has passed its time, so rows that come in any order within `delay` are chained by time and
    id as audit.build chains them by id; later ones are dropped, for their place is taken. A chain goes on from its head
    after a restart from the checkpoint.
    """
    known = rows.select(F.col("chain").cast("string").alias("chain"), F.col("id").cast("long").alias("id"), "payload", "at", F.unix_millis("at").alias("ms")).withWatermark("at", delay)
    linked = known.groupBy("chain").transformWithStateInPandas(_Chain(), LINKED, "Append", "EventTime")
    return linked.select("chain", "id", "payload", F.timestamp_millis("ms").alias("at"), "prev_hash", "hash")


class _Known(StatefulProcessor):
    """Keeps how often a document's indicators were seen, and forgets a document that stays silent."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.counts = handle.getMapState("counts", "type string, normalized string", "n int")
        self.last = handle.getValueState("last", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        fresh, last = [], self.last.get()[0] if self.last.exists() else 0
        for frame in rows:
            for kind, value, at in zip(frame["type"], frame["normalized"], frame["ms"].tolist(), strict=True):
                if self.counts.containsKey((kind, value)):
                    self.counts.updateValue((kind, value), (self.counts.getValue((kind, value))[0] + 1,))
                else:
                    self.counts.updateValue((kind, value), (1,))
                    fresh.append((key[0], kind, value, 1, "new"))
                last = max(last, at)
        self.last.update((last,))
        self.handle.registerTimer(last + self.idle_ms)
        if fresh:
            yield pd.DataFrame(fresh, columns=_names(SEEN))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = []
        if self.last.exists() and self.last.get()[0] + self.idle_ms <= expiredTimerInfo.getExpiryTimeInMs():
            out = [(key[0], kind, value, n[0], "closed") for (kind, value), n in self.counts.iterator()]
            self.counts.clear()
            self.last.clear()
        if out:
            yield pd.DataFrame(sorted(out), columns=_names(SEEN))

    def close(self) -> None:
        pass


def known_indicators(chunks: DataFrame, delay: str = "1 hour", idle_ms: int = 86_400_000, tlds=fixed.TLDS) -> DataFrame:
    """A stream of chunks (doc_id long, text, ingested_at) as doc_id, type, normalized, n, event.

    An indicator of a document is `new` once, however far apart its chunks come. When the watermark says that a document
    has been silent for `idle_ms` it is `closed`: each of its indicators comes once more with how often it was seen, and
    is forgotten; what comes after that is new again.
    """
    rows = chunks.withWatermark("ingested_at", delay)
    found = extract.found(rows.select("doc_id", "ingested_at", "text"), tlds).select("doc_id", "ingested_at", F.unix_millis("ingested_at").alias("ms"), "type", "normalized")
    return found.groupBy("doc_id").transformWithStateInPandas(_Known(idle_ms), SEEN, "Append", "EventTime")
