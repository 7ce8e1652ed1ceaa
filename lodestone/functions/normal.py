"""Canonical forms of indicators as columns; null stands for a rejected value."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed

_URL = r"(?s)^([A-Za-z]+)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"


def public_ipv4(v: Column) -> Column:
    """Whether a dotted quad is a public unicast address."""
    o = [F.try_element_at(F.split(v, r"\."), F.lit(i)).try_cast("int") for i in (1, 2, 3, 4)]
    bad = (
        o[0].isin(0, 10, 127)
        | (o[0] >= 224)
        | ((o[0] == 169) & (o[1] == 254))
        | ((o[0] == 172) & o[1].between(16, 31))
        | ((o[0] == 192) & (o[1] == 168))
        | ((o[0] == 192) & (o[1] == 0) & (o[2] == 0) & ~o[3].isin(9, 10))
        | ((o[0] == 192) & (o[1] == 0) & (o[2] == 2))
        | ((o[0] == 198) & o[1].isin(18, 19))
        | ((o[0] == 198) & (o[1] == 51) & (o[2] == 100))
        | ((o[0] == 203) & (o[1] == 0) & (o[2] == 113))
    )
    return v.rlike(r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?:\.(?!$)|$)){4}$") & ~bad


def ipv4(v: Column) -> Column:
    return F.when(public_ipv4(v), v)


def domain(v: Column, tlds=fixed.TLDS) -> Column:
    d = F.regexp_replace(F.lower(v), r"\.+$", "")
    ok = d.contains(".") & F.substring_index(d, ".", -1).isin(*tlds) & ~d.startswith(".") & ~d.contains("..")
    return F.when(ok, d)


def email(v: Column, tlds=fixed.TLDS) -> Column:
    host = domain(F.substring_index(v, "@", -1), tlds)
    local = F.regexp_extract(v, r"(?s)^(.*)@[^@]*$", 1)
    return F.when((local != "") & host.isNotNull(), F.concat(local, F.lit("@"), host))


def url(v: Column, tlds=fixed.TLDS) -> Column:
    """Scheme and authority in lower case; empty query, fragment and parameters go; the host must be acceptable."""
    part = lambda i: F.regexp_extract(v, _URL, i)
    scheme, netloc = F.lower(part(1)), F.lower(part(2))
    host = F.regexp_extract(F.substring_index(netloc, "@", -1), "^([^:]*)", 1)
    path = F.regexp_replace(part(3), r"(^|/)([^/;]*);$", "$1$2")
    query = F.when(part(4) == "?", "").otherwise(part(4))
    fragment = F.when(part(5) == "#", "").otherwise(part(5))
    ok = scheme.isin("http", "https") & ~netloc.contains("[") & (domain(host, tlds).isNotNull() | F.coalesce(public_ipv4(host), F.lit(False)))
    return F.when(ok, F.concat(scheme, F.lit("://"), netloc, path, query, fragment))


def hexadecimal(v: Column, length: int) -> Column:
    h = F.lower(v)
    return F.when(h.rlike(f"^[0-9a-f]{{{length}}}$"), h)


def cve(v: Column) -> Column:
    u = F.upper(v)
    return F.when(u.startswith("CVE-"), u)


def asn(v: Column) -> Column:
    n = F.regexp_extract(F.upper(v), "^AS([0-9]+)$", 1).try_cast("bigint")
    return F.when(n > 0, F.concat(F.lit("AS"), n.cast("string")))


def by_type(tlds=fixed.TLDS) -> dict:
    """The function of each type that columns can express; IPv6 needs the exact lane."""
    return {
        "ipv4": ipv4,
        "url": lambda v: url(v, tlds),
        "email": lambda v: email(v, tlds),
        "domain": lambda v: domain(v, tlds),
        "md5": lambda v: hexadecimal(v, 32),
        "sha1": lambda v: hexadecimal(v, 40),
        "sha256": lambda v: hexadecimal(v, 64),
        "sha512": lambda v: hexadecimal(v, 128),
        "cve": cve,
        "asn": asn,
    }


def normalize(kind: str, v: Column, tlds=fixed.TLDS) -> Column:
    """The canonical form of raw values of one type, with white space around them trimmed. IPv6 runs in an Arrow UDF."""
    raw = F.regexp_replace(v, r"(?U)^\s+|\s+$", "")
    if kind == "ipv6":
        return ipv6(raw)
    found = by_type(tlds)
    if kind not in found:
        raise ValueError(f"no normaliser for {kind}")
    return found[kind](raw)


def ipv6_text(v: str | None) -> str | None:
    """The compressed form of an address outside loopback, link-local, multicast and reserved space."""
    import ipaddress

    try:
        a = ipaddress.IPv6Address(v)
    except (ValueError, TypeError):
        return None
    top = int(a) >> 118
    # 2000::/3, fc00::/7 and fec0::/10 are what remains
    return a.compressed if top >> 7 == 1 or top >> 3 == 0b1111110 or top == 0b1111111011 else None


def ipv6(v: Column) -> Column:
    @F.pandas_udf("string")
    def compressed(s: pd.Series) -> pd.Series:
        return s.map(ipv6_text)

    return compressed(v)
