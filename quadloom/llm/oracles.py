"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

#: A-Z only, as the operators do.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Levels that the SQL unrolls: of ranges within a segment, and of segments.
_WITHIN, _ABOVE = 6, 3


def _tree(side: str) -> str:
    """CTEs of the nodes of one side, level by level, as far up as the archive's size asks for."""
    out = [f"""{side}_0 AS (SELECT segment, "offset" // 65536 AS node, sha256(string_agg("offset" || ':' || length || ':' || digest, '|' ORDER BY "offset")) AS hash FROM {side} GROUP BY ALL)"""]
    for k in range(1, _WITHIN):
        out.append(f"""{side}_{k} AS (SELECT segment, node // 16 AS node, sha256(string_agg(node || ':' || hash, '|' ORDER BY node)) AS hash FROM {side}_{k - 1} GROUP BY segment, node // 16)""")
    # The roots of the segments stand on the level below which one node is left.
    tops = " UNION ALL ".join(f"SELECT segment, hash FROM {side}_{k} WHERE (SELECT depth FROM reach) = {k + 1}" for k in range(_WITHIN))
    out.append(f"{side}_top0 AS ({tops})")
    for k in range(1, _ABOVE + 1):
        out.append(f"""{side}_top{k} AS (SELECT segment // 16 AS segment, sha256(string_agg(segment || ':' || hash, '|' ORDER BY segment)) AS hash FROM {side}_top{k - 1} GROUP BY segment // 16)""")
    roots = " UNION ALL ".join(f"SELECT hash FROM {side}_top{k} WHERE (SELECT tops FROM reach) = {k}" for k in range(_ABOVE + 1))
    out.append(f"{side}_root AS ({roots})")
    return ",\n".join(out)


_CASES = lambda x, bits, n: "CASE " + " ".join(f"WHEN {x} < {1 << (bits * k)} THEN {k}" for k in range(n)) + f" ELSE {n} END"

_OP2 = f"""
WITH raw AS (
  SELECT page_id, url, encode('WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:uuid:'
    || regexp_replace(substr(sha256(coalesce(url, '') || chr(10) || coalesce(html, '')), 1, 32), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')
    || '>' || chr(13) || chr(10) || 'WARC-Date: 1970-01-01T00:00:00Z' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
    || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
    || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS record
  FROM pages),
base AS (
  SELECT page_id AS record_id, CAST(('0x' || substr(sha256(CAST(page_id AS VARCHAR) || '|' || url), 1, 8)) AS BIGINT) % greatest(1, (SELECT (count(*) + 4095) // 4096 FROM pages)) AS segment,
    CAST(octet_length(record) AS BIGINT) AS length, sha256(record) AS digest,
    CAST(octet_length(record) - (page_id % 97 = 3)::INT AS BIGINT) AS copy_length,
    CASE page_id % 97 WHEN 2 THEN sha256(from_hex(hex(record)[:2 * octet_length(record) - 10] || '00' || right(hex(record), 8)))
      WHEN 3 THEN sha256(from_hex(hex(record)[:2 * octet_length(record) - 2])) ELSE sha256(record) END AS copy_digest
  FROM raw),
laid AS (SELECT *, CAST(coalesce(sum(length) OVER (PARTITION BY segment ORDER BY record_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS "offset" FROM base),
a AS (SELECT record_id, segment, "offset", length, digest FROM laid),
b AS (
  SELECT record_id, segment, "offset", copy_length AS length, copy_digest AS digest FROM laid WHERE record_id % 97 <> 1
  UNION ALL SELECT record_id, segment, "offset" + 1, length, digest FROM laid WHERE record_id % 97 = 4),
reach AS (
  SELECT 1 + {_CASES('(o // 65536)', 4, 6)} AS depth, {_CASES('s', 4, 4)} AS tops
  FROM (SELECT max("offset") AS o, max(segment) AS s FROM (FROM a UNION ALL FROM b))),
{_tree('a')},
{_tree('b')}
SELECT coalesce(a.record_id, b.record_id) AS record_id, coalesce(a.segment, b.segment) AS segment, "offset", coalesce(a.length, b.length) AS length,
  CASE WHEN a.digest IS NULL THEN 'extra' WHEN b.digest IS NULL THEN 'missing' ELSE 'changed' END AS fault,
  CAST("offset" // 65536 * 65536 AS BIGINT) AS range_start, CAST(("offset" // 65536 + 1) * 65536 AS BIGINT) AS range_end,
  x.hash AS range_hash, y.hash AS other_range_hash, (SELECT hash FROM a_root) AS root, (SELECT hash FROM b_root) AS other_root
FROM a FULL JOIN b USING (segment, "offset")
  LEFT JOIN a_0 x ON x.segment = coalesce(a.segment, b.segment) AND x.node = "offset" // 65536 LEFT JOIN b_0 y ON y.segment = coalesce(a.segment, b.segment) AND y.node = "offset" // 65536
WHERE NOT (a.digest IS NOT DISTINCT FROM b.digest AND a.length IS NOT DISTINCT FROM b.length)
"""

_OP3 = f"""
WITH items AS (SELECT item_id, w FROM (SELECT item_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM benchmark) WHERE len(w) > 0),
windows AS (
  SELECT item_id, least(len(w), 10) AS n, list_aggregate(list_slice(w, s, s + least(len(w), 10) - 1), 'string_agg', ' ') AS body
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS s FROM items)),
docs AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORD}') AS w FROM documents),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS s FROM docs, sizes WHERE len(w) >= n),
met AS (
  SELECT p.doc_id, p.s, p.n, x.item_id
  FROM (SELECT doc_id, n, s, list_aggregate(list_slice(w, s, s + n - 1), 'string_agg', ' ') AS body FROM places) p JOIN windows x ON p.n = x.n AND p.body = x.body),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS pos FROM met) GROUP BY doc_id),
found AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM met GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_OP4 = r"""
WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS raw_at FROM documents WHERE text IS NOT NULL),
counted AS (SELECT *, len(list_filter(regexp_split_to_array(line, '[ \t\n\v\f\r]+'), lambda x: x <> '')) AS n FROM raw),
lines AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY raw_at) AS pos FROM counted WHERE n > 0),
listed AS (SELECT doc_id, list(line ORDER BY pos) AS ls, list(n ORDER BY pos) AS ns FROM lines GROUP BY doc_id),
spans AS (
  SELECT a.doc_id, ls, s, e FROM (SELECT doc_id, ls, ns, unnest(range(1, len(ls) + 1)) AS s FROM listed) a, (SELECT unnest(range(0, 5)) AS d) b, LATERAL (SELECT s + d AS e)
  WHERE s + d <= len(ls) AND list_sum(list_slice(ns, s, s + d)) >= 5
    AND (d = 0 OR list_sum(list_slice(ns, s, s + d - 1)) < 5 OR list_sum(list_slice(ns, s + 1, s + d)) < 5)),
keyed AS (SELECT doc_id, s, e, list_aggregate(list_slice(ls, s, e), 'string_agg', chr(10)) AS body FROM spans),
later AS (SELECT doc_id, s, e FROM (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, s) AS k FROM keyed) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS pos FROM later),
islands AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM gone) GROUP BY doc_id, g),
kept AS (
  SELECT r.doc_id, string_agg(r.line, chr(10) ORDER BY r.raw_at) AS body
  FROM raw r LEFT JOIN lines l ON r.doc_id = l.doc_id AND r.raw_at = l.raw_at LEFT JOIN gone g ON g.doc_id = r.doc_id AND g.pos = l.pos
  WHERE g.pos IS NULL GROUP BY r.doc_id),
counts AS (SELECT doc_id, count(*) AS n FROM lines GROUP BY doc_id),
lost AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id),
runs AS (SELECT doc_id, max(n) AS n FROM islands GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_lines, CAST(coalesce(x.n, 0) AS BIGINT) AS n_deleted, CAST(coalesce(u.n, 0) AS BIGINT) AS longest_run,
  CASE WHEN d.text IS NULL THEN NULL ELSE CAST(length(coalesce(k.body, '')) AS BIGINT) END AS kept_chars, CASE WHEN d.text IS NULL THEN NULL ELSE md5(coalesce(k.body, '')) END AS kept_md5
FROM documents d LEFT JOIN counts c USING (doc_id) LEFT JOIN lost x USING (doc_id) LEFT JOIN runs u USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

ORACLES: dict[str, str] = {"op2_merkle_audit": _OP2, "op3_benchmark_decontamination": _OP3, "op4_line_dedup": _OP4}
