"""Column functions over text: all matches with offsets, refanging, redaction, canonical forms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

def java(pattern: str) -> str:
    """The pattern with Java's Unicode classes and boundaries, which are Python's."""
    return pattern.replace("(?i)", "(?iU)", 1) if pattern.startswith("(?i)") else f"(?U){pattern}"


def spans(text: Column, pattern: str) -> Column:
    """ARRAY<STRUCT<raw, start>> of all matches in text order; start counts code points."""
    p = F.lit(java(pattern))
    raw = F.regexp_extract_all(text, p, F.lit(0))

    def placed(pair: Column) -> Column:
        m, gap = pair["m"], pair["g"]
        step = F.transform(m, lambda x, i: F.struct(x.alias("raw"), F.length(F.get(gap, i)).alias("gap")))
        none = F.array().cast("array<struct<raw:string,start:int>>")
        return F.aggregate(
            step,
            F.struct(F.lit(0).alias("at"), none.alias("found")),
            lambda acc, x: F.struct(
                (acc["at"] + x["gap"] + F.length(x["raw"])).alias("at"),
                F.array_append(acc["found"], F.struct(x["raw"].alias("raw"), (acc["at"] + x["gap"]).alias("start"))).alias("found"),
            ),
            lambda acc: acc["found"],
        )

    both = F.array(F.struct(raw.alias("m"), F.split(text, p, -1).alias("g")))
    return F.get(F.transform(both, placed), F.lit(0))


def defanged(text: Column) -> Column:
    """Whether any rewrite applies."""
    return text.rlike("(?iU)hxxps?://|\\bfxp://|\\[://\\]|\\[\\.\\]|\\(\\.\\)|(?-i:\\[d\\])|\\[at\\]|\\[@\\]|[​‌‍﻿]")


def refang(text: Column) -> Column:
    """The text with all rewrites applied until none applies, however deep they nest.

    Only texts to which a rewrite applies go to Python, where each is read once. Offsets aren't kept: operators.extract keeps them.
    """

    @F.pandas_udf("string")
    def read(s: pd.Series) -> pd.Series:
        from ..operators.extract import refanged

        return pd.Series([None if x is None else refanged(x)[0] for x in s], dtype=object)

    return F.coalesce(read(F.when(defanged(text), text)), text)


def redact(text: Column) -> tuple[Column, Column]:
    """(redacted text, number of replacements); each rule sees what the ones before it left."""
    out, count = text, F.lit(0)
    for pattern, new in fixed.REDACTIONS:
        count = count + F.regexp_count(out, F.lit(java(pattern)))
        out = F.regexp_replace(out, java(pattern), new)
    return out, count


def uuid5(name: Column, namespace: str = fixed.NAMESPACE) -> Column:
    """A version 5 UUID of the name."""
    x = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(x, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(x, 1, 8), F.substring(x, 9, 4), F.concat(F.lit("5"), F.substring(x, 14, 3)), F.concat(variant, F.substring(x, 18, 3)), F.substring(x, 21, 12))


def canonical_json(payload: Column) -> Column:
    """Any JSON text with sorted keys, no spaces and non-ASCII left as it is; null for text that isn't JSON."""
    @F.pandas_udf("string")
    def canonical(s: pd.Series) -> pd.Series:
        import json

        def one(x):
            try:
                return None if x is None else json.dumps(json.loads(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
            except ValueError:
                return None

        return s.map(one)

    return canonical(payload)


def sorted_struct(**fields: Column) -> Column:
    """A struct whose fields stand in alphabetical order, so that its JSON is canonical."""
    return F.struct(*(fields[k].alias(k) for k in sorted(fields)))
