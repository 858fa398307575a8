"""The registered queries of the corpus operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, collocations, decontam, langid, license_scan, line_dedup, pii, prefix_trie, quality, sharding, simhash, token_counts, warc
from .common import read_table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.digest(license_scan.scan_licenses(read_table(spark, sf_dir, "documents")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(bpe.encode_documents(read_table(spark, sf_dir, "documents")))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(spark, sf_dir)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(read_table(spark, sf_dir, "documents")))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(quality.assess(*(read_table(spark, sf_dir, t) for t in ("documents", "labels"))))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.document_counts(read_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.learn_and_identify(read_table(spark, sf_dir, "documents"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (read_table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontam.digest(decontam.decontaminate(docs, benchmark))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.digest(line_dedup.deduplicated(docs, line_dedup.keep_bitmaps(docs)))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(read_table(spark, sf_dir, "conversations"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


#: DuckDB SQL of the queries that SQL can express.
ORACLES: dict[str, str] = {}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op10_decontamination"] = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS s
        FROM b, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT m FROM win),
places AS (SELECT doc_id, k, m, array_to_string(w[k : k + m - 1], ' ') AS s
           FROM d, sizes, unnest(range(1, len(w) - m + 2)) AS t(k) WHERE len(w) >= m),
found AS (SELECT doc_id, k, places.m AS m, item_id FROM places JOIN win ON places.s = win.s AND places.m = win.m),
hit AS (SELECT doc_id, count(DISTINCT k + j) AS n_hit FROM found, unnest(range(0, m)) AS t(j) GROUP BY doc_id),
ids AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS h
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN ids ON d.doc_id = ids.doc_id
"""

ORACLES["op8_warc"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS top FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, h AS payload_digest,
       CASE WHEN n >= 1000 AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND top <> page_id THEN top END AS refers_to FROM g
"""

ORACLES["op11_collocations"] = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
f AS (SELECT lang, m, array_to_string(w[k : k + m - 1], ' ') AS phrase, count(*) AS a
      FROM w, unnest(range(1, 5)) AS s(m), unnest(range(1, len(w) - m + 2)) AS t(k) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, m, a, k, array_to_string(string_split(phrase, ' ')[1 : k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1 :], ' ') AS tail
      FROM f, unnest(range(1, m)) AS t(k)),
s AS (SELECT c.lang, c.phrase, c.m, c.a, x.a AS l, y.a AS r, k, CAST(CAST(c.a AS HUGEINT) * 2000000 // (CAST(x.a AS HUGEINT) + y.a) AS BIGINT) AS score
      FROM c JOIN f AS x ON x.lang = c.lang AND x.phrase = head JOIN f AS y ON y.lang = c.lang AND y.phrase = tail),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, a, array_to_string(string_split(phrase, ' ')[j : j + i - 1], ' ') AS part
      FROM f, unnest(range(2, m)) AS t(i), unnest(range(1, m - i + 2)) AS u(j)),
g AS (SELECT lang, part, max(a) AS longer FROM o GROUP BY lang, part)
SELECT b.lang AS lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM b JOIN n ON n.lang = b.lang LEFT JOIN g ON g.lang = b.lang AND g.part = b.phrase
WHERE longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a
QUALIFY rank <= 2000
"""

ORACLES["op12_line_dedup"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT r, doc_id, t.pos AS pos, t.line AS line, translate(trim(t.line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM d, unnest(string_split(text, chr(10))) WITH ORDINALITY AS t(line, pos)),
k AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
kept AS (SELECT r, pos, line, last IS NOT NULL AND doc_id IS DISTINCT FROM last AS gone FROM l LEFT JOIN k ON l.key = k.key)
SELECT any_value(d.doc_id) AS doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM kept JOIN d ON d.r = kept.r GROUP BY kept.r
"""

ORACLES["op13_prefix_trie"] = """
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS k
           FROM conversations WHERE conv_id IS NOT NULL),
own AS (SELECT c, list({'r': role, 't': text} ORDER BY k) AS turns FROM t GROUP BY c),
h AS (SELECT c, turns, CAST(xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
      lambda a, b: list_reduce(list_prepend(xor(a, b), CAST(range(8) AS BIGINT[])), lambda x, i: xor(x >> 1, 3988292384 * (x & 1))))) % 6 AS BIGINT) AS h FROM own),
w AS (SELECT h.c AS c, list_concat(coalesce(b.turns, [])[1 : h.h], h.turns[h.h + 1 :]) AS turns FROM h LEFT JOIN own AS b ON b.c = h.c - h.c % 100),
p AS (SELECT c, d, turns[1 : d] AS p, d = len(turns) AS ends FROM w, unnest(range(0, len(turns) + 1)) AS u(d)),
n AS (SELECT p, any_value(d) AS d, min(c) AS c, count(*) AS n_convs, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '') AS ids FROM p GROUP BY p),
s AS (SELECT n.*, up.c AS parent, (n.n_convs - 1) * length(CASE WHEN n.d > 0 THEN n.p[n.d].t ELSE '' END) AS v,
             (SELECT count(*) FROM n AS x WHERE x.d = n.d + 1 AND x.p[1 : n.d] = n.p) AS kids
      FROM n LEFT JOIN n AS up ON n.d > 0 AND up.d = n.d - 1 AND up.p = n.p[1 : n.d - 1])
SELECT a.c AS conv_id, a.d AS depth, a.parent AS parent_conv_id, any_value(a.n_convs) AS n_convs, any_value(a.kids) AS n_children,
       CAST(count(*) FILTER (b.kids = 0) AS BIGINT) AS n_leaves, CAST(sum(b.v) AS BIGINT) AS saved_tokens, any_value(sha256(a.ids)) AS ends_sha256
FROM s AS a JOIN s AS b ON b.d >= a.d AND b.p[1 : a.d] = a.p GROUP BY a.c, a.d, a.parent
"""
