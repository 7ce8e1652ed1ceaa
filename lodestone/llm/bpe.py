"""BPE encoding and decoding with content-defined chunks that are encoded once and joined exactly."""

from __future__ import annotations

import hashlib
import random
import re
from array import array

import numpy as np
from pyspark.sql import DataFrame

from . import common

_LEAST, _MOST = 64, 8192
_REACH = 32  #: bytes under the rolling hash; a power of two
_MARK = b"|"  #: stands between what is encoded in one call; what holds it itself is encoded alone
_BYTES = np.array(random.Random(5).sample(range(1 << 32), 256), np.uint32)
#: Letters of Latin-1 between ASCII punctuation: the tokenizer splits there, whatever the word, and these letters have one
#: form only. No apostrophes (contractions) and no bars (special tokens).
_SHAPE = re.compile(r"([!-&(-/:-@\[-`{}~]*)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{}~]*)")
_SEEN = [*range(33, 127), *range(161, 173), *range(174, 256)]  #: bytes that byte-level tokenizers write as their own character
_LEVEL = {b: chr(b) for b in _SEEN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SEEN)}


def cut_points(texts: list[bytes], average: int) -> list[np.ndarray]:
    """For each text the places after which a rolling hash of the last 32 bytes ends a chunk.

    A place depends on those bytes alone, so equal passages are cut alike wherever they stand.
    """
    buf = np.frombuffer(b"".join(texts), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    if len(buf) <= _REACH:
        return [np.zeros(0, np.int64) for _ in texts]
    h, base, size = _BYTES[buf], np.uint32(0x9E3779B1), 1
    while size < _REACH:  # the hash of 2 n bytes from those of n
        h = h[:-size] * base + h[size:]
        base, size = np.uint32(int(base) ** 2 & 0xFFFFFFFF), 2 * size
    h *= np.uint32(0x85EBCA6B)
    at = np.flatnonzero(h < np.uint32((1 << 32) // average)) + _REACH
    at = at[(buf[np.minimum(at, len(buf) - 1)] & 0xC0) != 0x80]  # never inside a character
    return [at[np.searchsorted(at, e - n + _REACH) : np.searchsorted(at, e)] - (e - n) for e, n in zip(ends, map(len, texts), strict=True)]


def chunks(t: bytes, cuts: np.ndarray) -> list[bytes]:
    """The text in pieces that end at its cut points, none under 64 bytes but the last and none over 8 KB."""
    out, p = [], 0
    for q in [*cuts.tolist(), len(t)]:
        if q - p < _LEAST and q < len(t):
            continue
        while p < q:
            stop = min(q, p + _MOST)
            while stop < q and t[stop] & 0xC0 == 0x80:
                stop -= 1
            out.append(t[p:stop])
            p = stop
    return out


class Encoder:
    """Encodes texts chunk by chunk, exactly as the tokenizer does in one go.

    Words are what stands between ASCII white space, where this kind of tokenizer never joins tokens. A chunk keeps
    the ids of its whole words, and its first and last part-word. At a join the part-words of both sides are encoded
    again as one, between the whole words beside them. If those come out with the ids that their chunks keep, the join
    is repaired; if not, the whole text is encoded.

    Chunks are kept by digest with two bytes an id or so, `chunk_bytes` of them in each of two generations, and so are
    words; what a newer generation has met again stays.
    """

    def __init__(self, path: str, average: int = 1024, words: int = 300_000, chunk_bytes: int = 16 << 20):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.decoder is not None or "Removed" not in str(self.tokenizer.pre_tokenizer):
            raise ValueError("only tokenizers that drop white space and decode to tokens joined by a space can be joined at white space")
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.number = [str(i) for i in range(size)]
        self.token = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        (self.mark,) = self.tokenizer.encode(_MARK.decode(), add_special_tokens=False).ids
        odd = "aZñÈß"  # a tokenizer that normalises letters in another way gets no letters past it
        self.direct = [t.id for t in self.tokenizer.model.tokenize(odd.lower().encode().decode("latin-1").translate(_LEVEL))] == self.tokenizer.encode(odd, add_special_tokens=False).ids
        self.average, self.most_words, self.most_bytes = average, words, chunk_bytes
        self.words: dict[bytes, bytes] = {}
        self.old_words: dict[bytes, bytes] = {}
        self.signs: dict[str, bytes] = {}
        self.chunks: dict[bytes, tuple | None] = {}
        self.old_chunks: dict[bytes, tuple | None] = {}
        self.held = self.reused = self.encoded = self.widened = 0

    def _one(self, w: bytes) -> bytes:
        return np.array(self.tokenizer.encode(w.decode(), add_special_tokens=False).ids, self.dtype).tobytes()

    def _many(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece. All are encoded in one call, with a mark between them that none of them holds."""
        alone = {p: self._one(p) for p in pieces if _MARK in p}
        plain = [p for p in pieces if _MARK not in p]
        ids = np.array(self.tokenizer.encode((b" " + _MARK + b" ").join(plain).decode(), add_special_tokens=False).ids, self.dtype)
        raw, edge = ids.tobytes(), [-1, *np.flatnonzero(ids == self.mark).tolist(), len(ids)]
        if len(edge) != len(plain) + 1:
            return [self._one(p) for p in pieces]
        size = self.dtype.itemsize
        cut = iter([raw[(i + 1) * size : j * size] for i, j in zip(edge[:-1], edge[1:], strict=True)] if plain else [])
        return [alone[p] if p in alone else next(cut) for p in pieces]

    def _learn(self, words: set[bytes]) -> None:
        """Makes the ids of all these words known. Letters go to the model at once, all else through the whole tokenizer."""
        if len(self.words) > self.most_words:
            self.words, self.old_words = {}, self.words
        known, old, tokenize, code = self.words, self.old_words, self.tokenizer.model.tokenize, self.dtype.char
        rest = []
        for w in words - known.keys():
            got = old.get(w)
            if got is None and self.direct and (m := _SHAPE.fullmatch(w.decode())):
                lead, core, tail = m.groups()
                key = core.lower().encode()
                if (got := known.get(key) or old.get(key)) is None:
                    got = array(code, [t.id for t in tokenize(key.decode("latin-1").translate(_LEVEL))]).tobytes()
                if key != w:
                    known[key] = got
                    got = self._signs(lead) + got + self._signs(tail)
            if got is None:
                rest.append(w)
            else:
                known[w] = got
        known.update(zip(rest, self._many(rest), strict=True))

    def _signs(self, signs: str) -> bytes:
        """The ids of a run of punctuation."""
        if not signs:
            return b""
        if len(self.signs) > 10_000:
            self.signs = {}
        if signs not in self.signs:
            self.signs[signs] = self._one(signs.encode())
        return self.signs[signs]

    def _chunk(self, words: tuple) -> tuple:
        """What is kept of a chunk: the part-words at its ends, the ids of its words, and the first and the last of them."""
        head, inner, tail = words
        ids = [self.words[w] for w in inner]
        first, last = ((inner[0], len(ids[0])), (inner[-1], len(ids[-1]))) if inner else ((b"", 0), (b"", 0))
        return head, b"".join(ids), first, last, tail

    def _split(self, c: bytes) -> tuple | None:
        """(first part-word, whole words, last part-word), or None if there's no white space."""
        inner = c.split()
        head = inner.pop(0) if inner and not c[:1].isspace() else b""
        if head == c:
            return None
        tail = inner.pop() if inner and not c[-1:].isspace() else b""
        return head, inner, tail

    def texts(self, texts: list[bytes]) -> list[np.ndarray]:
        """The ids of each text."""
        if self.held > self.most_bytes:
            self.chunks, self.old_chunks, self.held = {}, self.chunks, 0
        parts, fresh, words = [], {}, set()
        for t, cuts in zip(texts, cut_points(texts, self.average), strict=True):
            row = [(hashlib.blake2b(c, digest_size=16).digest(), c) for c in chunks(t, cuts)]
            for d, c in row:
                if d in self.chunks or d in fresh:
                    self.reused += 1
                elif d in self.old_chunks:
                    self.reused += 1
                    self.chunks[d] = self.old_chunks[d]
                    self.held += len(c)
                else:
                    self.encoded += 1
                    fresh[d] = got = self._split(c)
                    self.held += len(c)
                    if got:
                        words.update(got[1])
            parts.append(row)
        self._learn(words)
        self.chunks.update((d, got and self._chunk(got)) for d, got in fresh.items())

        seams, rows = [], []
        for row in parts:
            out, open_word, left = [], [], (b"", b"")
            for d, c in [*row, (None, b"")]:
                got = self.chunks[d] if d else (b"", b"", (b"", 0), (b"", 0), b"")
                if got is None:
                    open_word.append(c)
                    continue
                head, ids, (first, m), (last, n), tail = got
                word = b"".join([*open_word, head])
                if word:
                    seams.append((left, word, (first, ids[:m])))
                    out.append(len(seams) - 1)
                out.append(ids)
                left, open_word = (last, ids[len(ids) - n :]) if last else (b"", b""), [tail]
            rows.append(out)
        repaired = []
        for ((_, before), _, (_, after)), got in zip(seams, self._many([b" ".join([left[0], word, right[0]]) for left, word, right in seams]), strict=True):
            agrees = len(got) >= len(before) + len(after) and got.startswith(before) and got.endswith(after)
            repaired.append(got[len(before) : len(got) - len(after)] if agrees else None)
        done = []
        for t, out in zip(texts, rows, strict=True):
            ids = [repaired[x] if isinstance(x, int) else x for x in out]
            if None in ids:
                self.widened += 1
                ids = [self._one(t)]
            done.append(np.frombuffer(b"".join(ids), self.dtype))
        return done

    def decimal(self, ids: np.ndarray) -> str:
        """The ids in decimal, joined by one space."""
        return " ".join(map(self.number.__getitem__, ids.tolist()))

    def decode(self, ids: np.ndarray) -> str:
        """What the tokenizer decodes: it has no decoder, so tokens are joined by one space."""
        return " ".join(map(self.token.__getitem__, ids.tolist()))


def bpe(docs: DataFrame, path: str | None = None, average: int = 1024, texts: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256; with texts also ids and decoded.

    ids are the tokenizer's ids of the whole text in decimal, joined by one space; decoded is what the tokenizer
    decodes from them. A null or empty text has no tokens. Repeated rows give a row each; null ids are kept; extra
    columns are ignored. `path` is a tokenizer file that executors can read (by default the word-level public one).

    Chunks end where a rolling hash says so and hold `average` bytes or so. A task encodes a chunk once and uses its ids
    in all documents that have it, as long as it is met again within 16 MB of other chunks. Nothing is shuffled: to deal
    all chunks of the corpus by their hash and join the ids back would send four times the text.
    """
    import pyarrow as pa

    def encode(batches):
        import public_tokenizers

        common.trim()
        encoder = Encoder(path or public_tokenizers.path("word_bpe_49k.json"), average)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for b in batches:
            ids, column = b.column("doc_id"), b.column("text")
            i = 0
            while i < b.num_rows:
                part, size = [], 0
                while i + len(part) < b.num_rows and size < 1 << 20:
                    t = column[i + len(part)].as_buffer()
                    part.append(t.to_pybytes())
                    size += t.size
                made = {"doc_id": ids.slice(i, len(part)), "n_tokens": [], "ids_sha256": [], "decoded_sha256": [], **({"ids": [], "decoded": []} if texts else {})}
                for got in encoder.texts(part):
                    decimal, decoded = encoder.decimal(got), encoder.decode(got)
                    made["n_tokens"].append(len(got))
                    made["ids_sha256"].append(sha(decimal))
                    made["decoded_sha256"].append(sha(decoded))
                    if texts:
                        made["ids"].append(decimal)
                        made["decoded"].append(decoded)
                kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64()}
                yield pa.RecordBatch.from_pydict({k: v if k == "doc_id" else pa.array(v, kinds.get(k, pa.string())) for k, v in made.items()})
                i += len(part)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids string, decoded string" * texts
    return common.documents(docs).mapInArrow(encode, schema).withColumn("doc_id", common.own_id())
