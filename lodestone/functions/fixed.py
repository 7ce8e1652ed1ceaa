"""Patterns, rules, word lists and formats that results depend on. Data only."""

# The types of indicators in the order in which they are looked for.
TYPES = ("sha512", "sha256", "sha1", "md5", "ipv6", "ipv4", "url", "email", "domain", "cve", "asn")

# The pattern of each type, as Java and Python both read it once their Unicode flags are set.
PATTERNS = {
    "sha512": r"(?<![A-Fa-f0-9])[a-fA-F0-9]{128}(?![A-Fa-f0-9])",
    "sha256": r"(?<![A-Fa-f0-9])[a-fA-F0-9]{64}(?![A-Fa-f0-9])",
    "sha1": r"(?<![A-Fa-f0-9])[a-fA-F0-9]{40}(?![A-Fa-f0-9])",
    "md5": r"(?<![A-Fa-f0-9])[a-fA-F0-9]{32}(?![A-Fa-f0-9])",
    "ipv6": r"(?<![:.\w])(?:"
    r"(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}"
    r"|(?:[A-Fa-f0-9]{1,4}:){1,7}:"
    r"|(?:[A-Fa-f0-9]{1,4}:){1,6}:[A-Fa-f0-9]{1,4}"
    r"|(?:[A-Fa-f0-9]{1,4}:){1,5}(?::[A-Fa-f0-9]{1,4}){1,2}"
    r"|(?:[A-Fa-f0-9]{1,4}:){1,4}(?::[A-Fa-f0-9]{1,4}){1,3}"
    r"|(?:[A-Fa-f0-9]{1,4}:){1,3}(?::[A-Fa-f0-9]{1,4}){1,4}"
    r"|(?:[A-Fa-f0-9]{1,4}:){1,2}(?::[A-Fa-f0-9]{1,4}){1,5}"
    r"|[A-Fa-f0-9]{1,4}:(?::[A-Fa-f0-9]{1,4}){1,6}"
    r"|::(?:[A-Fa-f0-9]{1,4}:){0,6}[A-Fa-f0-9]{1,4}"
    r"|::)(?![:.\w])",
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b",
    "url": r"(?i)https?://[^\s<>\"'`)\]}|]+",
    "email": r"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,24}\b",
    "domain": r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?\.){1,8}[a-zA-Z]{2,24}\b",
    "cve": r"(?i)\bCVE-\d{4}-\d{4,7}\b",
    "asn": r"\bAS\d{1,10}\b",
}

# Rewrites of defanged text, most specific first; the last drops zero-width characters.
DEFANG = (
    (r"(?i)hxxps://", "https://"),
    (r"(?i)hxxp://", "http://"),
    (r"(?i)\bfxp://", "ftp://"),
    (r"\[://\]", "://"),
    (r"\[\.\]", "."),
    (r"\(\.\)", "."),
    (r"\[d\]", "."),
    (r"(?i)\[at\]", "@"),
    (r"\[@\]", "@"),
    ("[​‌‍﻿]", ""),
)

# Top-level domains that are accepted where no list is given.
TLDS = (
    "com", "net", "org", "io", "co", "gov", "edu", "mil", "info", "biz", "us", "uk", "de", "fr", "ru", "cn", "jp", "br", "ca", "au", "in", "vn", "kr", "tw", "hk", "sg", "tk",
    "xyz", "online", "site", "store", "cloud", "tech", "app", "dev",
)

# Redaction rules in their order.
REDACTIONS = (
    (r"\bsk-[A-Za-z0-9]{20,}\b", "[REDACTED_OPENAI_KEY]"),
    (r"\bghp_[A-Za-z0-9]{30,}\b", "[REDACTED_GH_PAT]"),
    (r"\bxox[baprs]-[A-Za-z0-9-]+\b", "[REDACTED_SLACK_TOKEN]"),
    (r"\bAKIA[0-9A-Z]{16}\b", "[REDACTED_AWS_KEY]"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[REDACTED_EMAIL]"),
    (r"\b(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\b", "[REDACTED_IPV4]"),
    (r"(?<![:.\w])(?:[A-Fa-f0-9]{1,4}:){7}[A-Fa-f0-9]{1,4}(?![:.\w])", "[REDACTED_IPV6]"),
    (r"\b[\w-]+\.(?:internal|local|corp|lan|intranet)\b", "[REDACTED_INTERNAL_HOST]"),
)

# STIX patterns by type; {n} is the normalised value. A CVE has none.
STIX_PATTERNS = {
    "ipv4": "[ipv4-addr:value = '{n}']",
    "ipv6": "[ipv6-addr:value = '{n}']",
    "domain": "[domain-name:value = '{n}']",
    "url": "[url:value = '{n}']",
    "email": "[email-addr:value = '{n}']",
    "md5": "[file:hashes.MD5 = '{n}']",
    "sha1": "[file:hashes.'SHA-1' = '{n}']",
    "sha256": "[file:hashes.'SHA-256' = '{n}']",
    "sha512": "[file:hashes.'SHA-512' = '{n}']",
    "asn": "[autonomous-system:number = {n}]",
}

# The namespace of all object ids.
NAMESPACE = "a4d70b75-6f4a-5c66-8b6e-9c1f5d2a3e4f"

# Relationship types allowed from an indicator to these; other pairs allow any.
INDICATES = ("malware", "tool", "attack-pattern", "infrastructure", "threat-actor", "intrusion-set")

# Tactic names.
TACTICS = (
    "reconnaissance", "resource-development", "initial-access", "execution", "persistence", "privilege-escalation", "defense-evasion",
    "credential-access", "discovery", "lateral-movement", "collection", "command-and-control", "exfiltration", "impact",
)

EXTRACTOR = "regex_ioc@1.0.0"
SCHEMA_VERSION = "2026.05.18"
GENESIS = "0" * 64
