"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .contamination import LEAST, UNITS, WINDOW

#: Signs of scripts that are written without spaces, and spaces beyond ASCII; both are spelled out anew here.
_SIGN = r"\x{E00}-\x{109F}\x{1780}-\x{17FF}\x{3040}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{2FFFF}"
_SPACE = r"\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_TOKENS = rf"len(regexp_extract_all(coalesce(text, ''), '[{_SIGN}]|[^ \t\n\r\f\x0b{_SPACE}{_SIGN}]+'))"

SQL_op1_mixing = f"""
WITH per AS (
  SELECT source, CAST(sum({_TOKENS}) AS BIGINT) AS n FROM documents GROUP BY source
), weighed AS (
  SELECT source, n, CASE WHEN n = 0 THEN 0.0::DOUBLE WHEN source = 'src0' THEN 3.0::DOUBLE WHEN source = 'src1' THEN 2.0::DOUBLE
         WHEN source = 'src2' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS w FROM per
), rates AS (
  SELECT source, CASE WHEN n > 0 THEN 1.0::DOUBLE * (SELECT sum(n) FROM weighed)::DOUBLE * w / (SELECT sum(w) FROM weighed) / n ELSE 0 END AS rate FROM weighed
), counted AS (
  SELECT d.*, CAST(floor(rate) AS BIGINT) + CASE WHEN CAST('0x' || substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE
         < rate - floor(rate) THEN 1 ELSE 0 END AS k
  FROM documents d JOIN rates r ON d.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, text, lang, source, n_chars, CAST(unnest(generate_series(1, k)) AS BIGINT) AS copy FROM counted WHERE k > 0
"""

_SIGNS = "[!-/:-@\\[-`{-~]"


def _words(table: str, key: str) -> str:
    units = ", ".join(f"'{u}'" for u in UNITS)
    return f"""
  SELECT id, list(lower(w) ORDER BY i) AS l, list(kind ORDER BY i) AS k, list(CASE WHEN kind > 0 THEN '<' || kind || '>' ELSE lower(w) END ORDER BY i) AS t FROM (
    SELECT *, CASE WHEN number THEN 1 WHEN quantity THEN 4 WHEN lower(w) IN ({units}) AND coalesce(lag(number) OVER (PARTITION BY id ORDER BY i), false) THEN 2
           WHEN regexp_matches(w, '^[A-ZÀ-ÖØ-Þ]') THEN 3 ELSE 0 END AS kind FROM (
      SELECT id, i, w, regexp_full_match(w, '[0-9.,:/-]*[0-9][0-9.,:/-]*') AS number,
             regexp_full_match(w, '[0-9]([0-9.,:/A-Za-z-]|[^\\x00-\\x7f])*([A-Za-z]|[^\\x00-\\x7f])') AS quantity FROM (
        SELECT id, generate_subscripts(ws, 1) AS i, unnest(ws) AS w FROM (
          SELECT DISTINCT {key} AS id, list_filter(list_transform(regexp_extract_all(text, '[{_SIGN}]|[^\\x00-\\x20{_SPACE}{_SIGN}]+'), lambda x: regexp_replace(x, '^{_SIGNS}+|{_SIGNS}+$', '', 'g')), lambda x: x <> '') AS ws
          FROM {table} WHERE {key} IS NOT NULL AND text IS NOT NULL)))) GROUP BY id"""


_FORMS = """array_to_string(l[i:i + n - 1], ' ') AS lh, array_to_string(t[i:i + n - 1], ' ') AS th, len(list_filter(k[i:i + n - 1], lambda x: x = 0)) AS plain"""

SQL_op10_contamination = f"""
WITH d AS MATERIALIZED ({_words("documents", "doc_id")}), b AS MATERIALIZED ({_words("benchmark", "item_id")}),
bw AS MATERIALIZED (
  SELECT id AS item_id, i AS q, n, {_FORMS}, l[i:i + n - 1] AS bl, len(l) - n + 1 AS windows FROM (
    SELECT *, unnest(generate_series(1, len(l) - n + 1)) AS i FROM (SELECT *, least(len(l), {WINDOW}) AS n FROM b WHERE len(l) > 0))
), dw AS MATERIALIZED (
  SELECT id AS doc_id, i AS p, n, {_FORMS}, l[i:i + n - 1] AS dl, k[i:i + n - 1] AS dk FROM (
    SELECT *, unnest(generate_series(1, len(l) - n + 1)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(l) >= n AND (n >= {LEAST} OR len(l) = n))
), hit AS MATERIALIZED (
  SELECT doc_id, item_id, p, p - q AS line, dl, dk, bl, n, windows, true AS literal, false AS weak FROM dw JOIN bw USING (lh, n)
  UNION ALL
  SELECT doc_id, item_id, p, p - q AS line, dl, dk, bl, n, windows, false AS literal, dw.plain < 0.6 * n AS weak FROM dw JOIN bw USING (th, n)
  WHERE dw.plain < n AND dw.plain >= 0.3 * n AND n >= {LEAST}
), pairs AS (
  SELECT DISTINCT doc_id, item_id, line, bl[j] AS bv, dl[j] AS dv FROM (SELECT *, unnest(generate_series(1, n)) AS j FROM hit WHERE NOT literal) WHERE dk[j] > 0
), bad AS (
  SELECT doc_id, item_id, line, count(*) <> count(DISTINCT bv) OR count(*) <> count(DISTINCT dv) AS bad, bool_and(bv = dv) AS same FROM pairs GROUP BY ALL
), counted AS (
  SELECT doc_id, item_id, line, count(DISTINCT p) AS every, count(DISTINCT p) FILTER (WHERE literal OR NOT weak) AS firm, count(DISTINCT p) FILTER (WHERE literal) AS literal,
         min(least(windows, 3)) AS need FROM hit GROUP BY ALL
), lines AS (
  SELECT doc_id, item_id, CASE WHEN coalesce(bad, false) THEN literal WHEN every >= need THEN every ELSE firm END AS n, coalesce(same, true) AS same
  FROM counted LEFT JOIN bad USING (doc_id, item_id, line)
)
SELECT doc_id, item_id, CAST(sum(n) AS BIGINT) AS windows, bool_or(same) AS exact FROM lines WHERE n > 0 GROUP BY doc_id, item_id
"""


def _canonical(url: str) -> str:
    from .urls import TRACKING

    u = f"regexp_replace(trim({url}), '#.*$', '')"
    part = lambda i: f"regexp_extract({u}, '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?]*)([^?]*)\\??(.*)$', {i})"
    names = ", ".join(f"'{t}'" for t in TRACKING)
    scheme = f"lower({part(1)})"
    port = f"CASE {scheme} WHEN 'http' THEN ':80' WHEN 'https' THEN ':443' ELSE ':' END"
    host = f"regexp_replace(lower({part(2)}), '^.*@', '')"
    host = f"CASE WHEN ends_with({host}, {port}) THEN left({host}, len({host}) - len({port})) ELSE {host} END"
    host = f"regexp_replace({host}, '^(www|m)\\.', '')"
    query = f"array_to_string(list_sort(list_filter(string_split({part(4)}, '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN ({names}) AND NOT starts_with(lower(p), 'utm_'))), '&')"
    return f"""CASE WHEN {host} <> '' THEN CASE WHEN {scheme} IN ('http', 'https') THEN 'http' ELSE {scheme} END || '://' || {host} || regexp_replace({part(3)}, '/+$', '')
      || CASE WHEN {query} <> '' THEN '?' || {query} ELSE '' END END"""


SQL_op3_urls = f"""
WITH p AS MATERIALIZED (SELECT page_id, url, {_canonical("url")} AS canonical_url FROM pages)
SELECT page_id, url, canonical_url FROM p
WHERE canonical_url IN (SELECT canonical_url FROM p WHERE (url LIKE '%cheap-pills%' OR page_id % 5 = 0) AND canonical_url IS NOT NULL)
"""

SQL_op5_revisits = f"""
WITH rec AS MATERIALIZED (
  SELECT CAST(page_id AS VARCHAR) || '-' || n AS record_id, n, url AS uri, {_canonical("url")} AS key,
         page_id * 10 + CASE n WHEN 1 THEN 0 WHEN 2 THEN 5 ELSE 4000 END AS ts,
         CASE WHEN n = 1 THEN CASE WHEN page_id % 7 = 0 THEN 404 ELSE 200 END ELSE 304 END AS status,
         CASE n WHEN 1 THEN CASE WHEN page_id % 11 <> 0 THEN '"' || substr(md5(html), 1, 12) || '"' END WHEN 2 THEN 'W/"' || substr(md5(html), 1, 12) || '"'
                ELSE '"' || substr(md5(html || CASE WHEN page_id % 5 = 0 THEN 'x' ELSE '' END), 1, 12) || '"' END AS etag,
         CASE WHEN n = 1 THEN md5(html) END AS payload_digest
  FROM pages, (VALUES (1), (2), (3)) v(n)
), pairs AS (
  SELECT r.record_id, r.uri, r.ts, r.etag, f.record_id AS refers_to, f.etag AS f_etag, f.payload_digest
  FROM rec r LEFT JOIN rec f ON f.n = 1 AND f.status = 200 AND f.key = r.key AND f.ts < r.ts
  WHERE r.n > 1
  QUALIFY row_number() OVER (PARTITION BY r.record_id ORDER BY f.ts DESC NULLS LAST, f.record_id DESC) = 1
), judged AS (
  SELECT *, refers_to IS NOT NULL AND coalesce(regexp_replace(etag, '^W/', '') = regexp_replace(f_etag, '^W/', ''), false) AS matched FROM pairs
)
SELECT record_id, uri, ts, refers_to, matched,
       CASE WHEN matched THEN 'content-type=text/html;date=' || ts || ';etag=' || etag END AS headers,
       CASE WHEN matched THEN payload_digest END AS payload_digest
FROM judged
"""
