"""Indicators of compromise with evidence.

Texts go through Arrow batches, where plain looks for characters decide which types can occur, each pattern runs once, and
offsets survive each rewrite of defanged text. `_fast` gives the same rows by columns alone, for text without rewrites, IPv6
addresses and digits other than 0 to 9; it is five times slower, as every pattern runs twice there.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed, normal, text

VALUE_MOST, SPAN_MOST = 2048, 8192
MATCH = "type string, ord int, raw string, normalized string, text_span string, start int, end int"
FOUND = "array<struct<" + MATCH.replace(" ", ":").replace(",:", ",") + ">>"

#: What a text must hold for a type to occur in it, as Java and Python both read it.
NEEDS = {
    **dict.fromkeys(("sha512", "sha256", "sha1", "md5"), "[A-Fa-f0-9]{32}"), "ipv6": "::|[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:", "ipv4": r"\.\d", "url": "://", "email": "@", "domain": r"\.[A-Za-z0-9]", "cve": "(?i)cve-", "asn": r"AS\d",
}
_ZERO_WIDTH = "\u200b\u200c\u200d\ufeff"
_STOP = re.compile(f"[/\\])]|[{_ZERO_WIDTH}]")
#: By the last character of a token: the token in small letters, the pattern that ends in it, and what replaces it.
_TOKENS: dict[str, list] = {}
for _p, _new in fixed.DEFANG:
    if _new:
        _plain = _p.removeprefix("(?i)").removeprefix(r"\b").replace("\\", "")
        _TOKENS.setdefault(_plain[-1], []).append((_plain, re.compile(("(?i)" if _p.startswith("(?i)") else "") + f"(?:{_p.removeprefix('(?i)')})\\Z"), _new))
_LONGEST = 9  #: characters of the longest token and one before it


def refanged(s: str) -> tuple[str, list[int]]:
    """The text after all rewrites, and where each of its characters came from; the last entry is the length of `s`.

    What a rewrite puts in comes from where the rewritten part began. A token can end only where a slash, a bracket or
    a parenthesis stands, so the text is read once, and the end of what is written so far is looked at there, as often
    as a rewrite makes another one fit. Zero-width characters go last, in a second reading.
    """

    def read(s: str, origin: list[int], dropped: str) -> tuple[list[str], list[int]]:
        out, at, done = [], [], 0
        for m in _STOP.finditer(s):
            i = m.start()
            stop = i if m.group() in dropped else i + 1
            out.extend(s[done:stop])
            at.extend(origin[done:stop])
            done = i + 1
            fits = stop > i
            while fits:
                fits = False
                end = "".join(out[-_LONGEST:])
                small = end.casefold()
                for plain, token, new in _TOKENS.get(small[-1], ()):
                    if small.endswith(plain) and (hit := token.search(end)):
                        n = len(hit.group())
                        out[-n:] = new
                        at[-n:] = [at[-n]] * len(new)
                        fits = True
                        break
        out.extend(s[done:])
        at.extend(origin[done:])
        return out, at

    out, at = read(s, list(range(len(s))), "")
    if any(c in s for c in _ZERO_WIDTH):
        out, at = read("".join(out), at, _ZERO_WIDTH)
    return "".join(out), [*at, len(s)]


def resolve(places: list[int], start: int, end: int) -> tuple[int, int]:
    """Where a span of the rewritten text stands in the original: up to where what follows began. Empty spans stay."""
    if not (0 <= start < len(places) and end < len(places)):
        raise IndexError(f"{start}..{end} is outside of {len(places) - 1} characters")
    return (places[start], places[end]) if start < end else (start, start)


def _normal_text(kind: str, v: str, tlds: frozenset) -> str | None:
    """What the column functions give, for the exact lane."""
    import ipaddress
    from urllib.parse import urlsplit

    def host_name(h: str) -> str | None:
        h = h.lower().rstrip(".")
        labels = h.split(".")
        return h if len(labels) > 1 and all(labels) and labels[-1] in tlds else None

    def address(h: str) -> str | None:
        try:
            o = ipaddress.IPv4Address(h).packed
        except ValueError:
            return None
        bad = (
            o[0] in (0, 10, 127) or o[0] >= 224 or o[:2] in (b"\xa9\xfe", b"\xc0\xa8") or (o[0] == 172 and 16 <= o[1] <= 31)
            or (o[:3] == b"\xc0\0\0" and o[3] not in (9, 10)) or o[:3] in (b"\xc0\0\2", b"\xc6\x33\x64", b"\xcb\0\x71") or (o[0] == 198 and o[1] in (18, 19))
        )
        return None if bad else h

    v = v.strip()
    if kind == "ipv4":
        return address(v)
    if kind == "ipv6":
        return normal.ipv6_text(v)
    if kind == "domain":
        return host_name(v)
    if kind == "email":
        local, _, host = v.rpartition("@")
        host = host_name(host)
        return f"{local}@{host}" if local and host else None
    if kind == "cve":
        return v.upper()
    if kind == "asn":
        return f"AS{int(v[2:])}" if int(v[2:]) else None
    if kind == "url":
        try:
            u = urlsplit(v)
            name = u.hostname or ""
        except ValueError:
            return None
        if u.scheme not in ("http", "https") or not u.netloc or not (host_name(name) or address(name) or normal.ipv6_text(name)):
            return None
        path = u.path[:-1] if u.path.endswith(";") and ";" not in u.path.rpartition("/")[2][:-1] else u.path
        return u._replace(netloc=u.netloc.lower(), path=path).geturl()
    return v.lower()


class Finder:
    """All matches of all types in a text, or of those in `types`, each pattern run once and only where its type can occur."""

    def __init__(self, tlds, types=fixed.TYPES):
        self.tlds = frozenset(tlds)
        self.patterns = [(n, k, re.compile(p).finditer) for n, (k, p) in enumerate(fixed.PATTERNS.items()) if k in types]
        asked = lambda *kinds: any(k in types for k in kinds)
        hashes = ("sha512", "sha256", "sha1", "md5")
        self.rules = {k: re.compile(NEEDS[k]).search for k, of in (("md5", hashes), ("ipv6", ("ipv6",)), ("ipv4", ("ipv4",)), ("domain", ("domain",))) if asked(*of)}

    def _odd(self, s: str, small: str) -> bool:
        """Whether some rewrite may apply."""
        return "[" in s or "(.)" in s or "xp" in small or not s.isascii() and any(c in s for c in _ZERO_WIDTH)

    def _kinds(self, s: str, small: str) -> set[str]:
        """Types that may occur: plain looks for characters come before patterns."""
        rules, dot = self.rules, "." in s
        kinds = {"sha512", "sha256", "sha1", "md5"} if "md5" in rules and rules["md5"](s) else set()
        if "ipv6" in rules and ("::" in s or s.count(":") > 1 and rules["ipv6"](s)):
            kinds.add("ipv6")
        kinds.update(k for k in ("ipv4", "domain") if dot and k in rules and rules[k](s))
        kinds.update(k for k, x, t in (("url", "://", s), ("email", "@", s), ("cve", "cve-", small), ("asn", "AS", s)) if x in t)
        return kinds

    def __call__(self, s: str):
        """Rows of MATCH."""
        small = s.lower()
        view, places = refanged(s) if self._odd(s, small) else (s, None)
        kinds = self._kinds(view, small if places is None else view.lower())
        for n, kind, every in self.patterns if kinds else ():
            if kind not in kinds:
                continue
            for m in every(view):
                raw = m.group()
                value = _normal_text(kind, raw, self.tlds)
                if value is None:
                    continue
                i, j = m.span() if places is None else resolve(places, *m.span())
                if j > i:
                    yield kind, n, raw, value, s[i:j], i, j


def _exact(chunks: DataFrame, tlds, types) -> DataFrame:
    """A row for each match: the other columns of `chunks` and MATCH, in Python, through Arrow batches."""
    import pyarrow as pa

    kinds = [pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
    fields = T._parse_datatype_string(MATCH).fields
    known, asked = tuple(tlds), tuple(types)

    def find(batches):
        finder = Finder(known, asked)
        for b in batches:
            at, rows = [], []
            for i, s in enumerate(b.column("text").to_pylist()):
                if s is not None:
                    for row in finder(s):
                        at.append(i)
                        rows.append(row)
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)]
            others = b.drop_columns(["text"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*others.columns, *columns], names=[*others.schema.names, *(f.name for f in fields)])

    return chunks.mapInArrow(find, T.StructType([*(f for f in chunks.schema.fields if f.name != "text"), *fields]))


def _row(kind: str, n: int, norm):
    """What a match of the type becomes."""
    return lambda x: F.struct(
        F.lit(kind).alias("type"), F.lit(n).alias("ord"), x["raw"].alias("raw"), norm(x["raw"]).alias("normalized"), x["raw"].alias("text_span"),
        x["start"].alias("start"), (x["start"] + F.length(x["raw"])).alias("end"),
    )


def _fast(chunks: DataFrame, tlds, types) -> DataFrame:
    """The same rows by column functions, of text that doesn't need the exact lane."""
    t = F.col("text")
    parts = []
    for n, kind in enumerate(fixed.TYPES):
        if kind != "ipv6" and kind in types:
            row = _row(kind, n, normal.by_type(tlds)[kind])
            parts.append(F.when(t.rlike(text.java(NEEDS[kind])), F.filter(F.transform(text.spans(t, fixed.PATTERNS[kind]), row), lambda x: x["normalized"].isNotNull())).otherwise(F.array().cast(FOUND)))
    # an inner explode would have its condition, and so the search, evaluated twice
    found = chunks.withColumn("m", F.explode_outer(F.concat(F.array().cast(FOUND), *parts))).where(F.col("m").isNotNull())
    return found.select(*(c for c in chunks.columns if c != "text"), "m.*")


def found(chunks: DataFrame, tlds=fixed.TLDS, lane: str = "exact", types=fixed.TYPES) -> DataFrame:
    """A row for each accepted match of the types: the columns of `chunks` but its text, and MATCH. A null text has none.

    A type's matches don't depend on those of others, so patterns of types that aren't asked for are never run.
    """
    if unknown := set(types) - set(fixed.TYPES):
        raise ValueError(f"no types of indicators: {sorted(unknown)}")
    t = F.col("text")
    rows = chunks.where(t.isNotNull())
    if lane == "fast":
        return _fast(rows, tlds, types)
    return _exact(rows, tlds, types)


def matches(chunks: DataFrame, tlds=fixed.TLDS, lane: str = "exact", types=fixed.TYPES) -> DataFrame:
    """One row for each accepted match: doc_id, chunk_id, type, ord, value, normalized, text_span, char_start, char_end,
    evidence_id, error_code.

    chunks: doc_id, chunk_id, text, char_start. Offsets count code points of the document. error_code says why a match
    can't be an indicator (a value over 2048 or a span over 8192 characters); such rows are kept apart by the callers.
    A null text has no matches.
    """
    rows = chunks.select("doc_id", "chunk_id", F.col("text"), F.col("char_start").cast("int").alias("char_start"))
    start, end = F.col("char_start") + F.col("start"), F.col("char_start") + F.col("end")
    return found(rows, tlds, lane, types).select(
        "doc_id", "chunk_id", "type", "ord", F.col("text_span").alias("value"), "normalized", "text_span",
        start.alias("char_start"), end.alias("char_end"), evidence_id(F.col("chunk_id"), start, end, F.col("type")).alias("evidence_id"),
        F.when((F.length("text_span") > VALUE_MOST) | (F.length("normalized") > VALUE_MOST), "value_too_long").when(F.length("text_span") > SPAN_MOST, "span_too_long").alias("error_code"),
    )


def evidence_id(chunk_id: Column, start: Column, end: Column, kind: Column) -> Column:
    return F.concat(F.lit("e-"), F.substring(F.sha2(F.concat_ws("|", chunk_id, start.cast("string"), end.cast("string"), kind), 256), 1, 32))


def evidence(found: DataFrame) -> DataFrame:
    """One row for each span and type of a chunk; in a chunk of equal spans the first stands."""
    good = found.where(F.col("error_code").isNull())
    return good.select("doc_id", "chunk_id", "type", "text_span", "char_start", "char_end", "evidence_id").dropDuplicates(["doc_id", "chunk_id", "type", "char_start", "char_end"])


def indicators(found: DataFrame, by: str = "chunk_id") -> DataFrame:
    """Distinct (type, normalized) of each chunk, or of each document if by is doc_id: the first value, the evidence in
    text order, confidence 1.0 and the extractor."""
    good = found.where(F.col("error_code").isNull())
    keys = ["doc_id", "chunk_id"] if by == "chunk_id" else ["doc_id"]
    place = F.struct("char_start", "char_end", "evidence_id")
    return (
        good.groupBy(*keys, "type", "normalized")
        .agg(F.min_by("value", place).alias("value"), F.min("ord").alias("ord"), F.min("char_start").alias("first_start"), F.array_sort(F.collect_set(place)).alias("at"))
        .select(*keys, "type", "normalized", "value", F.array_distinct(F.col("at.evidence_id")).alias("evidence_ids"), F.lit(1.0).alias("confidence"), F.lit(fixed.EXTRACTOR).alias("extractor"), "ord", "first_start")
    )


def whole_documents(docs: DataFrame) -> DataFrame:
    """Each document as one chunk."""
    return docs.select("doc_id", whole_chunk_id(F.col("doc_id")).alias("chunk_id"), "text", F.lit(0).alias("char_start"))


def whole_chunk_id(doc_id: Column) -> Column:
    """The id of a document's one chunk."""
    return F.concat(F.lit("c-"), doc_id.cast("string"), F.lit("-0"))


def register(spark, tlds=fixed.TLDS, name: str = "extract_iocs") -> None:
    """Extraction as a table function for SQL: extract_iocs(chunk_id, text, char_start) gives a row for each match, with the
    columns chunk_id, type, value, normalized, text_span, char_start and char_end. A null text has none, a null char_start is 0."""
    known = tuple(tlds)

    class Matches:
        def __init__(self):
            self.find = Finder(known)

        def eval(self, chunk_id: str, text: str, char_start: int):
            for kind, _, raw, value, span, i, j in self.find(text) if text is not None else ():
                yield chunk_id, kind, raw, value, span, (char_start or 0) + i, (char_start or 0) + j

    columns = "chunk_id string, type string, value string, normalized string, text_span string, char_start int, char_end int"
    spark.udtf.register(name, F.udtf(Matches, returnType=columns))
