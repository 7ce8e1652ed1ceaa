"""Mentions of known names in text: an automaton over all names, or a join by name where they are too many for one."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import cache
from zlib import crc32

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources import tables

_WORD = re.compile(r"[^\W_]+")
#: Bytes of names that one automaton may hold; beyond that names stay on the executors.
MOST_BYTES = 8 << 20
FILTER_BITS = 1 << 26
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(s: str) -> tuple[list[str], list[tuple[int, int]]]:
    """The words of a text in lower case, and where each stands."""
    found = [(m.group().lower(), m.span()) for m in _WORD.finditer(s)]
    return [w for w, _ in found], [p for _, p in found]


def normal_name(name: Column) -> Column:
    """The words of a name in lower case with a space between; null if it has none."""
    return F.nullif(F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " ")), F.lit(""))


def leftmost_longest(hits: list[tuple]) -> list[tuple]:
    """Of hits that begin with (start, end) those that stay where they overlap: the first to begin, the longest of these."""
    out, end = [], 0
    for hit in sorted(hits, key=lambda h: (h[0], -h[1])):
        if hit[0] >= end:
            out.append(hit)
            end = hit[1]
    return out


def _known(names: DataFrame) -> DataFrame:
    rows = names.select(normal_name(F.col("name")).alias("name"), "entity_id").where(F.col("name").isNotNull())
    return rows.groupBy("name").agg(F.min("entity_id").alias("entity_id"))


def _schema(docs: DataFrame, names: DataFrame) -> T.StructType:
    return T.StructType([docs.schema["doc_id"], *T._parse_datatype_string("char_start int, char_end int, mention string").fields, T.StructField("entity_id", names.schema["entity_id"].dataType)])


def _by_automaton(docs: DataFrame, known: DataFrame) -> DataFrame:
    names = {r.name: r.entity_id for r in known.collect()}  # at most MOST_BYTES, as entity_mentions has checked
    held = docs.sparkSession.sparkContext.broadcast(names)
    schema = _schema(docs, known)

    def spot(batches):
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for name, entity in held.value.items():
            automaton.add_word(f" {name} ", (name.count(" ") + 1, entity))
        automaton.make_automaton()
        for b in batches:
            at, rows = [], []
            for i, s in enumerate(b.column("text").to_pylist()):
                words, places = words_of(s or "")
                if not words or not held.value:
                    continue
                ends, n = [], 0
                for w in words:
                    n += len(w) + 1
                    ends.append(n)  # where the space after the word stands
                hits = []
                for end, (count, entity) in automaton.iter(f" {' '.join(words)} "):
                    last = bisect_left(ends, end)
                    hits.append((places[last - count + 1][0], places[last][1], entity))
                for start, stop, entity in leftmost_longest(hits):
                    at.append(i)
                    rows.append((start, stop, s[start:stop], entity))
            yield _batch(b, at, rows, schema)

    return docs.select("doc_id", "text").mapInArrow(spot, schema)


def _batch(b, at: list[int], rows: list[tuple], schema: T.StructType):
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    told = zip(*rows, strict=True) if rows else [()] * (len(schema.fields) - 1)
    kinds = [to_arrow_type(f.dataType) for f in schema.fields[1:]]
    return pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(at, pa.int64())), *(pa.array(list(c), k) for c, k in zip(told, kinds, strict=True))], names=schema.names)


@cache
def _letters() -> np.ndarray:
    """Whether a code point is part of words."""
    out = np.zeros(0x110000, bool)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for m in _WORD.finditer(every):
        i, j = (k + 0x800 * (k >= 0xD800) for k in m.span())
        out[i:j] = True
    out[0xD800:0xE000] = False
    return out


class Block:
    """The words of some texts: each as its number in `vocabulary`, the row and place where it stands, and which runs of them may be names."""

    def __init__(self, texts: list[str | None]):
        number: dict[str, int] = {}
        at = np.cumsum([0] + [len(s or "") + 1 for s in texts])
        whole = "\n".join(s or "" for s in texts) + "\n"
        letter = _letters()[np.frombuffer(whole.encode("utf-32-le"), np.uint32)]
        edge = np.flatnonzero(np.diff(letter.view(np.int8), prepend=np.int8(0)))
        start, end = edge[::2], edge[1::2]
        words = (whole[i:j].lower() for i, j in zip(start.tolist(), end.tolist(), strict=True))
        self.own = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(start))
        self.row = np.searchsorted(at, start, "right").astype(np.int32) - np.int32(1)
        self.start, self.end = (start - at[self.row]).astype(np.int32), (end - at[self.row]).astype(np.int32)
        self.number, self.vocabulary = number, list(number)

    def likely(self, sizes: list[int], held: np.ndarray):
        """For each number of words k: k, the places at which runs of k words begin that the filter lets through, and the runs as tuples."""
        codes = np.array([crc32(w.encode()) for w in self.vocabulary], np.uint64)
        words = codes[self.own] if len(codes) else np.zeros(0, np.uint64)
        h, known = np.zeros(len(words), np.uint64), set(sizes)
        for k in range(1, max(sizes, default=0) + 1):
            h = h[: max(0, len(words) - k + 1)] * _STEP + words[k - 1 :]
            if k in known:
                bit = _bit(h)
                fits = (held[bit >> 6] >> (bit & 63).astype(np.uint64) & np.uint64(1)).astype(bool)
                at = np.flatnonzero(fits & (self.row[: len(h)] == self.row[k - 1 :]))
                yield k, at, zip(*(self.own[at + j].tolist() for j in range(k)), strict=True)


def _bit(h: np.ndarray) -> np.ndarray:
    """The filter's bit for hashes of runs."""
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return ((h >> np.uint64(32)) % np.uint64(FILTER_BITS)).astype(np.int64)


def _filter(known: DataFrame) -> np.ndarray:
    """FILTER_BITS bits, those of all names set, in words of 64; its size doesn't follow the names'."""
    import pyarrow as pa

    def bits(batches):
        for b in batches:
            at = []
            for name in b.column("name").to_pylist():
                h = 0
                for w in name.split(" "):
                    h = (h * int(_STEP) + crc32(w.encode())) % (1 << 64)
                at.append(h)
            yield pa.RecordBatch.from_arrays([pa.array(_bit(np.array(at, np.uint64)))], names=["bit"])

    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("bit") % 64).cast("int"))
    slots = known.select("name").mapInArrow(bits, "bit long").groupBy(F.call_function("div", F.col("bit"), F.lit(64)).alias("slot")).agg(F.bit_or(bit).alias("bits")).toArrow()
    held = np.zeros(FILTER_BITS // 64, np.uint64)
    held[slots.column("slot").to_numpy()] = slots.column("bits").to_numpy().view(np.uint64)
    return held


def _by_join(docs: DataFrame, known: DataFrame, block_bytes: int = 8 << 20) -> DataFrame:
    """Documents are dealt to blocks of about `block_bytes` of text. A block sends each run of words that may be a name once, to where
    the names are, and gets back those that are names; what it sends is bounded by a filter of FILTER_BITS bits."""
    import pyarrow as pa

    spark, schema = docs.sparkSession, _schema(docs, known)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(2 * spark.sparkContext.defaultParallelism, -(-total // block_bytes))
    sizes = [r.n for r in known.select((F.size(F.split("name", " "))).alias("n")).distinct().orderBy("n").collect()]  # numbers of words
    held = spark.sparkContext.broadcast(_filter(known))
    dealt = docs.where(F.col("text").isNotNull()).select(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block"), "doc_id", "text")

    def ask(table):
        texts = Block(table.column("text").to_pylist())
        runs = {run for _, _, some in texts.likely(sizes, held.value) for run in some}
        names = pa.array([" ".join(texts.vocabulary[i] for i in run) for run in runs], pa.string())
        return pa.table([pa.array([table.column("block")[0].as_py()] * len(names), pa.int32()), names], names=["block", "name"])

    def answer(table, answers):
        rows = table.column("text").to_pylist()
        texts = Block(rows)
        entity = {tuple(texts.number[w] for w in name.split(" ")): i for i, name in enumerate(answers.column("name").to_pylist())}
        longest, which = np.zeros(len(texts.own), np.int32), np.zeros(len(texts.own), np.int64)
        for k, at, runs in texts.likely(sizes, held.value):  # longer runs come later and count
            met = np.fromiter((entity.get(run, -1) for run in runs), np.int64, len(at))
            some = at[met >= 0]
            longest[some], which[some] = k, met[met >= 0]
        picked, free = [], 0
        begins = np.flatnonzero(longest)
        for i, k in zip(begins.tolist(), longest[begins].tolist(), strict=True):
            if i >= free:  # the first to begin stays
                picked.append(i)
                free = i + k
        i = np.array(picked, np.int64)
        row, start, end = texts.row[i], texts.start[i], texts.end[i + longest[i] - 1]
        mentions = [rows[r][a:b] for r, a, b in zip(row.tolist(), start.tolist(), end.tolist(), strict=True)]
        columns = [table.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(end), pa.array(mentions, pa.string()), answers.column("entity_id").take(pa.array(which[i]))]
        return pa.table(columns, names=schema.names)

    asked = dealt.groupBy("block").applyInArrow(ask, "block int, name string")
    answers = asked.join(known, "name").select("block", "name", "entity_id")
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(answer, schema)


def entity_mentions(docs: DataFrame, names: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Where documents mention known names: doc_id, char_start, char_end, mention, entity_id.

    docs: doc_id (unique), text; names: name, entity_id, such as readers.attack_names or an alias table. A name is the words it
    has, whatever stands between them and in whatever case; it is met only where whole words are. Of several entities
    of a name the smallest counts. Where names overlap the first to begin stays, and of these the longest. Offsets count
    code points. A null text or name has none.

    Names of up to `most_bytes` go to every task as one Aho-Corasick automaton, and each text is read once. Beyond that runs of
    words are joined with the names by equality, each once for a block of documents, so that neither the driver nor a task holds all names.
    """
    known = tables.written(_known(names))
    size = known.agg(F.sum(F.octet_length("name") + 16)).first()[0] or 0
    return _by_automaton(docs, known) if size <= most_bytes else _by_join(docs, known)
