"""Language ID by string kernels: presence of byte n-grams, Nyström landmarks, one-versus-rest kernel ridge regression."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import common

_BITS = 16
_WORDLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether some character is a letter. Fractions, superscripts and the like count as word characters but are none."""
    return any(m.group().isalpha() for m in _WORDLIKE.finditer(text))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no classifier learns from: those whose crc32 of the id as text leaves 1 by 3."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def presence(texts: list[bytes], longest: int) -> np.ndarray:
    """A row of 2**16 bytes for each text: 1 where one of its n-grams of 1 to `longest` bytes is hashed to."""
    out = np.zeros((len(texts), 1 << _BITS), np.uint8)
    for row, t in zip(out, texts, strict=True):
        for s in range(0, max(1, len(t)), 1 << 22):
            a = np.frombuffer(t[s : s + (1 << 22) + longest - 1], np.uint8).astype(np.uint32)
            code = np.zeros(len(a), np.uint32)
            for n in range(min(longest, len(a))):
                code = (code[: len(a) - n] << np.uint32(8)) + a[n:]
                row[(code + np.uint32(n)) * np.uint32(2654435761) >> np.uint32(32 - _BITS)] = 1
    return out


@dataclass
class Model:
    """Landmarks over the n-grams they hold, the map to Nyström features, and a weight vector for each language."""

    languages: list[str]
    columns: np.ndarray
    landmarks: np.ndarray
    norms: np.ndarray
    weights: np.ndarray
    longest: int

    def kernel(self, bits: np.ndarray) -> np.ndarray:
        """Shared n-grams with each landmark, over the geometric mean of both sides' n-grams."""
        shared = bits[:, self.columns].astype(np.float32) @ self.landmarks
        return shared / np.sqrt(np.maximum(bits.sum(1, dtype=np.int64), 1))[:, None] / self.norms

    def decide(self, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The best language of each row, and (1 + its margin) / 2 within 0 and 1."""
        k = self.kernel(bits)
        f = np.concatenate([k, np.ones((len(k), 1), k.dtype)], 1) @ self.weights
        best = f.argmax(1)
        return best, np.clip((f[np.arange(len(f)), best] + 1) / 2, 0, 1).astype(float)


def fit(docs: DataFrame, per_language: int = 300, landmarks: int = 24, rows_in_all: int = 19_200, landmarks_in_all: int = 768, longest: int = 3, ridge: float = 1e-2) -> Model | None:
    """Learns every lang value of rows that aren't held out; None if there are none.

    The sample is bounded: of each language the `per_language` rows whose id and text hash smallest, or its equal share of
    `rows_in_all` if that is less, and one at least. Executors turn whole texts into 8 KB of n-gram bits each, and
    only those are gathered; they are unpacked a few at a time. `landmarks` of each language's rows, or its share of
    `landmarks_in_all`, are the Nyström landmarks.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    counts = common.cut(known.groupBy("lang").agg(F.count("*").alias("rows")))
    languages = counts.count()
    if not languages:
        return None
    per_language, landmarks = min(per_language, max(1, rows_in_all // languages)), min(landmarks, max(1, landmarks_in_all // languages))
    # the rows that hash smallest lie under this bar, with room to spare, so few rows of a language are dealt to rank them
    turn = F.xxhash64("doc_id", "text")
    bar = (F.lit(4.0) * per_language + 1000) / F.col("rows") * float(1 << 64) - float(1 << 63)
    near = known.join(F.broadcast(counts), "lang").where(turn.cast("double") <= bar).select("doc_id", "lang", "text", turn.alias("turn"))
    ranked = near.withColumn("n", F.row_number().over(Window.partitionBy("lang").orderBy("turn", "doc_id")))
    picked = ranked.where(F.col("n") <= per_language).select("doc_id", "lang", "text")

    import pyarrow as pa

    def bits(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                packed = np.packbits(presence([t.lower().encode() for t in part.column("text").to_pylist()], longest), axis=1)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("lang"), pa.array([p.tobytes() for p in packed], pa.binary())], names=["doc_id", "lang", "bits"])

    rows = picked.mapInArrow(bits, "doc_id long, lang string, bits binary").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r.lang, r.doc_id, r.bits))
    packed = np.frombuffer(b"".join(r.bits for r in rows), np.uint8).reshape(len(rows), -1)
    found = sorted({r.lang for r in rows})
    y = np.array([found.index(r.lang) for r in rows])
    chosen = np.concatenate([np.flatnonzero(y == k)[:: max(1, int((y == k).sum()) // landmarks)][:landmarks] for k in range(len(found))])
    z = np.unpackbits(packed[chosen], axis=1)
    columns = np.flatnonzero(z.any(0))
    model = Model(found, columns, z[:, columns].T.astype(np.float32), np.sqrt(np.maximum(z.sum(1, dtype=np.int64), 1)).astype(np.float32), np.zeros(0), longest)
    values, vectors = np.linalg.eigh(model.kernel(z).astype(float))
    keep = values > 1e-6 * values.max()
    nystrom = vectors[:, keep] / np.sqrt(values[keep])
    k = np.concatenate([model.kernel(np.unpackbits(packed[i : i + 256], axis=1)) for i in range(0, len(packed), 256)])
    phi = np.concatenate([k @ nystrom, np.ones((len(k), 1))], 1)
    target = np.where(y[:, None] == np.arange(len(found)), 1.0, -1.0)
    weight = len(rows) / (len(found) * np.bincount(y, minlength=len(found)))[y][:, None]  # languages count alike
    solved = np.linalg.solve(phi.T @ (weight * phi) + ridge * np.eye(phi.shape[1]), phi.T @ (weight * target))
    model.weights = np.concatenate([nystrom @ solved[:-1], solved[-1:]]).astype(np.float32)
    return model


def language_id(docs: DataFrame, model: Model | None = None, lettered: bool = False, **fitting) -> DataFrame:
    """Every row of docs with lang_pred (a learned value, or und), score (0 to 1) and held_out.

    und stands for a text that is null or has no letter, with score 0, and for all texts if nothing could be
    learned. Only text decides: whole, in lower case, as UTF-8. Repeated rows are predicted each; other columns
    pass through unless they have one of the three names. A null id is neither held out nor learned from. With
    `lettered`, rows whose text is null or has no letter are left out, whatever could be learned.
    """
    import pyarrow as pa

    model = model or fit(docs, **fitting)
    out = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "held_out")]

    def predict(batches):
        for b in batches:
            for i in range(0, b.num_rows, 64):
                part = b.slice(i, 64)
                texts = part.column("text").to_pylist()
                some = [k for k, t in enumerate(texts) if t and has_letter(t)]
                if lettered:
                    part, texts, some = part.take(pa.array(some, pa.int64())), [texts[k] for k in some], list(range(len(some)))
                lang, score = ["und"] * len(texts), [0.0] * len(texts)
                if some and model is not None:
                    best, margin = model.decide(presence([texts[k].lower().encode() for k in some], model.longest))
                    for k, m, s in zip(some, best.tolist(), margin.tolist(), strict=True):
                        lang[k], score[k] = model.languages[m], s
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang), pa.array(score, pa.float64())], names=[*part.schema.names, "lang_pred", "score"])

    schema = T.StructType([*out, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select(*[f"`{f.name}`" for f in out]).mapInArrow(predict, schema).withColumn("held_out", held_out())
