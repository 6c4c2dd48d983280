"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, license_scan, near_dedup, packing, quality_classifier, quality_rules, token_count, token_file, url_filter, warc
from .common import shared_dir, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score(table(spark, sf_dir, "documents")).drop("host", "host_rate")


_WORD = r"[^\x20\x09-\x0D]+"
ORACLE_SQL["op1_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents),
windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM twice, range(0, 8) AS r(j) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)
          WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id),
m AS (SELECT doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
        (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
        coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEATED} * n_words AS base_failed FROM m),
hosts AS (SELECT source, count(*)::DOUBLE AS n, count_if(base_failed)::DOUBLE AS f FROM b GROUP BY source),
sums AS (SELECT count(*) AS h, sum(n) AS n, sum(f) AS f, sum(n * n) AS nn, sum(f * f / n) AS ffn FROM hosts),
rated AS (SELECT *, f / n AS m, f / n * (1 - f / n) AS chance, n - nn / n - (h - 1) AS room FROM sums),
shares AS (SELECT m, least(greatest(CASE WHEN chance > 0 AND room > 0
             THEN (ffn - n * m * m - chance * (h - 1)) / (chance * room) ELSE 0 END, 1e-4), 0.999) AS share FROM rated),
rates AS (SELECT source, (f + m * (1 / share - 1)) / (n + 1 / share - 1) AS rate FROM hosts, shares)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rate <= {quality_rules.MAX_HOST_RATE} AS kept
FROM b JOIN rates ON b.source IS NOT DISTINCT FROM rates.source
"""


#: Documents as files: the short ones are named as licence files of their source and language, and so is one in 64 of any length.
_PATH = """concat_ws('/', source, lang, CASE WHEN length(text) <= 120 THEN concat('LICENSE-', doc_id) WHEN doc_id % 64 = 1 THEN concat('COPYING-', doc_id)
  ELSE concat(doc_id % 16, '/', doc_id, '.txt') END)"""


@query
def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").withColumn("path", F.expr(_PATH)))


def _license_sql() -> str:
    every = [(0, *t) for t in license_scan.HEADERS] + [(1, *t) for t in license_scan.TEXTS]
    rows = ", ".join(f"('{k:05d} {n}', {w}, '{t}')" for k, (w, n, t) in enumerate(every))
    term, limit = license_scan.TERM, license_scan.THRESHOLD
    return rf"""
WITH f AS (SELECT doc_id, coalesce({_PATH}, '') AS path, text, md5(coalesce(text, '')) AS h FROM documents),
g AS (SELECT *, CASE WHEN strpos(path, '/') > 0 THEN regexp_replace(path, '/[^/]*$', '') ELSE '' END AS dir,
             regexp_matches(string_split(path, '/')[-1], '{license_scan.LICENSE_FILE}') AS holder FROM f),
templates(template, whole_only, t) AS (VALUES {rows}),
tt AS (SELECT template, whole_only, term, count(*) AS tf FROM (SELECT template, whole_only, unnest(regexp_extract_all(lower(t), '{term}')) AS term FROM templates) GROUP BY ALL),
df AS (SELECT term, count(*) AS n FROM (SELECT unnest(list_distinct(regexp_extract_all(lower(text), '{term}'))) AS term FROM f) GROUP BY term),
idf AS (SELECT v.term, ln((1 + (SELECT count(*) FROM f)) / (1 + coalesce(n, 0))) + 1 AS idf FROM (SELECT DISTINCT term FROM tt) v LEFT JOIN df USING (term)),
tw AS (SELECT template, whole_only, term, (1 + ln(tf)) * idf AS w, regexp_full_match(term, '{license_scan.VERSION}')::INT AS version FROM tt JOIN idf USING (term)),
tn AS (SELECT *, w / sqrt(sum(w * w) OVER (PARTITION BY template)) AS part, sum(version) OVER (PARTITION BY template) AS versions FROM tw),
units AS (SELECT DISTINCT * FROM (
  SELECT doc_id, path, h, generate_subscripts(l, 1)::INT - 1 AS line_no, unnest(l) AS unit FROM (SELECT doc_id, path, h, string_split(text, chr(10)) AS l FROM f)
  UNION ALL SELECT doc_id, path, h, -1, text FROM g WHERE holder)),
tf AS (SELECT doc_id, path, h, line_no, term, count(*) AS tf FROM (SELECT doc_id, path, h, line_no, unnest(regexp_extract_all(lower(unit), '{term}')) AS term FROM units) GROUP BY ALL),
s AS (SELECT tf.*, (1 + ln(tf)) * idf AS own FROM tf LEFT JOIN idf USING (term)),
norms AS (SELECT doc_id, path, h, line_no, sum(coalesce(own * own, 0)) AS known, coalesce(sum(tf) FILTER (own IS NULL), 0) AS others FROM s GROUP BY ALL),
dots AS (SELECT doc_id, path, h, line_no, template, sum(own * part) AS dot FROM s JOIN tn USING (term) WHERE whole_only = 0 OR line_no = -1
         GROUP BY ALL HAVING sum(version) = max(versions)),
near AS (SELECT dots.*, substr(template, 7) AS license,
           round(dot / sqrt(known + CASE WHEN others > 0 THEN (1 + ln(others)) ** 2 ELSE 0 END), 6) AS similarity
         FROM dots JOIN norms ON dots.doc_id IS NOT DISTINCT FROM norms.doc_id AND dots.path = norms.path AND dots.h = norms.h AND dots.line_no = norms.line_no),
own AS (SELECT * FROM near WHERE similarity >= {limit} QUALIFY row_number() OVER (PARTITION BY doc_id, path, h ORDER BY similarity DESC, license, line_no) = 1),
holders AS (SELECT dir, license FROM (SELECT DISTINCT own.*, dir FROM own JOIN g ON own.path = g.path WHERE holder)
            QUALIFY row_number() OVER (PARTITION BY dir ORDER BY similarity DESC, path, license) = 1),
asked AS (SELECT dir, unnest(range(0, len(parts) + 1)) AS depth, parts FROM (SELECT DISTINCT dir, CASE WHEN dir = '' THEN [] ELSE string_split(dir, '/') END AS parts FROM g)),
resolved AS (SELECT a.dir, max_by(h.license, depth) AS given, max_by(h.dir, depth) AS giver FROM asked a
             JOIN holders h ON h.dir = array_to_string(parts[1:depth], '/') GROUP BY a.dir)
SELECT g.doc_id, g.path, coalesce(own.license, given) AS license, similarity, line_no,
       CASE WHEN own.license IS NULL THEN giver END AS inherited_from
FROM g LEFT JOIN own ON g.doc_id IS NOT DISTINCT FROM own.doc_id AND g.path = own.path AND g.h = own.h LEFT JOIN resolved USING (dir)
"""


ORACLE_SQL["op2_license_scan"] = _license_sql()


@query
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "token-files")
    manifest = token_file.write(table(spark, sf_dir, "documents"), folder, tokenizer_path("word_bpe_49k.json"), end_id=1)
    return token_file.read(spark, manifest, folder)


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


@query
def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


@query
def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"), shingle=2)


#: An exact self-join of whole sets, and the closure of its links.
ORACLE_SQL["op10_minhash_near_dedup"] = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents),
shingles AS (SELECT DISTINCT doc_id, ws[i] || CASE WHEN len(ws) > 1 THEN ' ' || ws[i + 1] ELSE '' END AS s
             FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM d WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
sized AS (SELECT s, doc_id, n FROM shingles JOIN sizes USING (doc_id)),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS n_a, b.n AS n_b, count(*) AS shared FROM sized a
          JOIN sized b ON a.s = b.s AND a.doc_id < b.doc_id AND 100 * a.n >= {near_dedup.PERCENT} * b.n AND 100 * b.n >= {near_dedup.PERCENT} * a.n GROUP BY ALL),
links AS (SELECT a, b FROM pairs WHERE 100 * shared >= {near_dedup.PERCENT} * (n_a + n_b - shared)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached(doc_id, r) AS (SELECT doc_id, doc_id FROM d UNION SELECT doc_id, b FROM reached JOIN ways ON r = a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id, n
"""


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.page_records(warc.read(spark, folder, payload=False))


ORACLE_SQL["op8_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
hexed AS (SELECT page_id, html, octet_length(encode(html)) AS payload_bytes, sha1(html) AS h FROM p),
bits AS (SELECT *, list_transform(range(8), lambda k: ('0x' || substr(h, k * 5 + 1, 5))::BIGINT) AS groups,
         min(page_id) OVER (PARTITION BY html) AS original FROM hexed)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(groups, lambda g: array_to_string(list_transform([15, 10, 5, 0],
    lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((g >> s) & 31)::INT + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to
FROM bits
"""


#: The list rules of the contract: host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


@query
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.list_rule(*r) for r in URL_RULES] + url_filter.default_patterns()
    return url_filter.judge(table(spark, sf_dir, "pages"), rules)


ORACLE_SQL["op9_url_filter"] = rf"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), cut AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM parts
), urls AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM cut
), rules(h, p, v) AS (VALUES {", ".join(str(r) for r in URL_RULES)}
), fits AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS v
  FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id
), words(w) AS (VALUES {", ".join(f"('{w}')" for w in url_filter.BLOCKED_WORDS)}
), bad AS (
  SELECT page_id, max_by(w, struct_pack(n := length(w), t := w)) AS pattern FROM urls
  JOIN words ON list_contains(string_split(replace(host, '-', '.'), '.'), w) GROUP BY page_id
), shapes(r) AS (VALUES {", ".join(f"('{r}')" for r in url_filter.BLOCKED_PATHS)}
), worse AS (
  SELECT page_id, max_by(r, struct_pack(n := length(r), t := r)) AS pattern FROM urls JOIN shapes ON regexp_matches(path, r) GROUP BY page_id
)
SELECT u.page_id, host, path, rule, coalesce(v, CASE WHEN coalesce(w.pattern, b.pattern) IS NOT NULL THEN 'block' END, 'allow') AS verdict,
  CASE WHEN length(w.pattern) < length(b.pattern) THEN b.pattern ELSE coalesce(w.pattern, b.pattern) END AS pattern
FROM urls u LEFT JOIN fits USING (page_id) LEFT JOIN bad b USING (page_id) LEFT JOIN worse w USING (page_id)
"""
