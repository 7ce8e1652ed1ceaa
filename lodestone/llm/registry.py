"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import warc

    return warc(table(spark, sf_dir, "pages")).drop("file", "offset")


OP9_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS f FROM p)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> f THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> f THEN f END AS refers_to
FROM q
"""


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_dedup

    return near_dedup(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontamination import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import suffix_dedup

    return suffix_dedup(table(spark, sf_dir, "documents")).drop("kept_bytes")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import bpe

    return bpe(table(spark, sf_dir, "documents"), texts=False)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import language_id

    return language_id(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .line_dedup import line_dedup

    return line_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents"))


def op7_sql() -> str:
    """Every window of every document against every notice, without retrieval."""
    from .license_scan import COVERS, NEAR, NOTICES, PIECE, SHINGLE, STEP, WINDOW

    quoted = ", ".join(f"({i}, '{a}', '{b.replace(chr(39), chr(39) * 2)}', '{c}')" for i, (a, b, c) in enumerate(NOTICES))
    span = WINDOW - SHINGLE + 1
    assert STEP == WINDOW - PIECE + 1
    grams = "list_transform(range(1, len({w}) - 1), lambda i: {w}[i] || ' ' || {w}[i + 1] || ' ' || {w}[i + 2])"
    own, other = grams.format(w="w"), grams.format(w="v")
    covers = ", ".join(f"('{a}', '{b}')" for a, b in COVERS.items())
    return rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS w FROM documents),
g AS (SELECT doc_id, {own} AS g FROM d WHERE len(w) >= 3),
n AS (SELECT template, license_id, list_distinct({own}) AS t, must FROM (
  SELECT *, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM (VALUES {quoted}) AS x(template, license_id, text, must))),
q AS (SELECT template, list_distinct(flatten(list({other}))) AS q FROM (
  SELECT template, regexp_extract_all(unnest(string_split(must, '/')), '[a-z0-9]+') AS v FROM n) GROUP BY template),
c AS (SELECT doc_id, g, license_id, t, q FROM g, n JOIN q USING (template) WHERE list_has_any(g, t)),
s AS (SELECT *, unnest(range(0, len(g), {STEP})) AS p FROM c),
a AS (SELECT doc_id, license_id, p, t, q, g[greatest(0, p - len(t)) + 1 : p + {span} + len(t)] AS a FROM s WHERE list_has_any(g[p + 1 : p + {span}], t)),
r AS (SELECT doc_id, license_id, p, max(len(list_intersect(t, a)) / len(t)) AS containment FROM a WHERE list_has_all(a, q) AND len(list_intersect(t, a)) / len(t) >= 0.8 GROUP BY ALL)
SELECT doc_id, license_id, max(containment) AS containment FROM r WHERE NOT EXISTS (SELECT 1 FROM (VALUES {covers}) AS k(first, second) JOIN r AS o ON o.license_id = k.first WHERE k.second = r.license_id AND o.doc_id = r.doc_id AND abs(o.p - r.p) <= {NEAR}) GROUP BY ALL
"""


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).drop("kept_text")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (
  SELECT doc_id, unnest(range(1, len(w) - 11)) AS p, w FROM d WHERE len(w) >= 13),
h AS (SELECT doc_id, p, array_to_string(w[p : p + 12], ' ') AS g FROM t),
f AS (SELECT g, min(doc_id) AS least FROM h GROUP BY g HAVING count(*) > 1),
r AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS q FROM h JOIN f USING (g) WHERE least < doc_id),
rs AS (SELECT doc_id, list(q ORDER BY q) AS q FROM r GROUP BY doc_id),
s AS (
  SELECT doc_id, len(w) AS n_words, coalesce(len(q), 0) AS n_removed,
         CASE WHEN q IS NULL THEN 0 ELSE len(list_filter(range(1, len(q) + 1), lambda i: i = 1 OR q[i] <> q[i - 1] + 1)) END AS n_spans,
         CASE WHEN q IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(q, i)), lambda i: w[i]) END AS kept
  FROM d LEFT JOIN rs USING (doc_id))
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256, n_spans FROM s
"""


OP10_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""


def op11_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extraction import extract_main

    return extract_main(table(spark, sf_dir, "pages"))


#: The markup of these pages is plain enough for SQL: one article without nested boxes, five references.
OP11_SQL = r"""
WITH p AS (SELECT page_id, url, regexp_extract(coalesce(html, ''), '<article>(.*)</article>', 1, 's') AS a FROM pages),
b AS (SELECT page_id, url, list_transform(string_split_regex(a, '</?(p|h1)>'), lambda x: regexp_replace(x, '<[^>]*>', ' ', 'g')) AS b FROM p),
d AS (SELECT page_id, url, list_transform(b, lambda x: regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g')) AS b FROM b),
t AS (SELECT page_id, url, array_to_string(list_filter(list_transform(b, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM d)
SELECT page_id, url, text, length(text) AS n_chars FROM t
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .spelling_variants import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .source_divergence import divergence

    return divergence(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, cast(count(*) AS hugeint) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 10),
l AS (SELECT lang, cast(count(*) AS hugeint) AS v, cast(sum(n) AS hugeint) AS n FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, cast(count(*) AS hugeint) AS n FROM t SEMI JOIN k USING (lang, term) GROUP BY ALL),
s AS (SELECT lang, source, cast(coalesce(sum(n), 0) AS hugeint) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY lang, source),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (s.n + 2 * l.v) AS p, 1 + (1000000000 * (k.n + 2)) // (l.n + 2 * l.v) AS q
      FROM s JOIN l USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
x AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
y AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, cast(coalesce(x.value, 0) AS bigint) AS value
      FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
z AS (SELECT lang, source, 'term' AS part, term AS item, cast(((p - q) * (p - q)) // (p + q) AS bigint) AS value FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, cast(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS int) AS rank FROM (SELECT * FROM y UNION ALL SELECT * FROM z))
SELECT * FROM r WHERE part = 'pair' OR rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_near_dedup, op2_decontamination, op3_suffix_dedup, op4_bpe, op5_language_id, op6_line_dedup, op7_license_scan, op8_substring_dedup, op9_warc, op10_exact_dedup, op11_html_extraction, op12_spelling_variants, op13_source_divergence)
    return {f.__name__: f for f in found}


def oracles() -> dict[str, str]:
    return {"op7_license_scan": op7_sql(), "op8_substring_dedup": OP8_SQL, "op9_warc": OP9_SQL, "op10_exact_dedup": OP10_SQL, "op11_html_extraction": OP11_SQL, "op13_source_divergence": OP13_SQL}
