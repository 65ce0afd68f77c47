"""DuckDB oracle SQL for ``catalog_text`` queries."""

from __future__ import annotations

from vigil.plans.oracle import ORACLE
from vigil.sources.html import BLOCK_TAGS


def STRIP(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def DECODE(x: str) -> str:
    e = x
    for a, b in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")]:
        e = f"replace({e}, '{a}', '{b}')"
    return e


ORACLE["block_segment"] = """
WITH l AS (SELECT conv_id AS doc, turn AS pos, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS line, role
           FROM conversations),
k AS (SELECT *, CASE WHEN role = 'system' THEN 'header' WHEN role = 'user' THEN 'code'
                     WHEN role = 'assistant' AND length(line) < 200 THEN 'date' ELSE 'content' END AS kind
      FROM l WHERE line IS NOT NULL AND line <> ''),
b AS (SELECT *,
        CAST(sum(CASE WHEN kind IN ('header', 'code') THEN 1 ELSE 0 END)
             OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS block,
        last_value(CASE WHEN kind = 'header' THEN line END IGNORE NULLS)
             OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS header
      FROM k),
g AS (SELECT doc, block, arg_min(kind, pos) AS open_kind, arg_min(line, pos) AS opener,
             arg_min_null(header, pos) AS header, max(CASE WHEN kind = 'date' THEN pos END) AS date,
             COALESCE(string_agg(CASE WHEN kind = 'content' THEN line END, chr(10) ORDER BY pos), '') AS content,
             count_if(kind = 'content') AS n_lines
      FROM b GROUP BY doc, block)
SELECT doc, block, opener, header, date, content, n_lines FROM g WHERE open_kind = 'code' AND header IS NOT NULL
"""

ORACLE["nearest_header"] = """
SELECT event_id,
       last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS)
         OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
         AS header_value
FROM events
"""

ORACLE["line_neighbors"] = f"""
WITH s AS (SELECT doc_id, string_split_regex(text, '\\r?\\n') AS arr FROM documents),
l0 AS (SELECT doc_id, generate_subscripts(arr, 1) - 1 AS pos, unnest(arr) AS raw FROM s),
l AS (SELECT doc_id AS doc, CAST(pos AS INTEGER) AS pos, {STRIP('raw')} AS line FROM l0),
a AS (SELECT doc, min(pos) AS ap FROM l WHERE length(line) < 60 AND pos > 0 AND line <> '' GROUP BY doc)
SELECT l.doc, min(a.ap) AS anchor_pos,
       max(CASE WHEN l.pos = a.ap THEN line END) AS anchor,
       max(CASE WHEN l.pos = a.ap - 1 THEN line END) AS above,
       COALESCE(string_agg(CASE WHEN l.pos > a.ap AND line <> '' THEN line END, ' ' ORDER BY l.pos), '') AS below,
       COALESCE(string_agg(CASE WHEN l.pos <> a.ap AND line <> '' THEN line END, ' ' ORDER BY l.pos), '')
         AS full_text
FROM l JOIN a ON l.doc = a.doc GROUP BY l.doc
"""

_HTML_TEXT = DECODE(
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, "
    "'(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', ' ', 'g'), "
    "'(?i)<h[1-6]\\b[^>]*>', chr(10) || chr(1), 'g'), "
    f"'(?i)</?({BLOCK_TAGS})\\b[^>]*>', chr(10), 'g'), "
    "'<[^>]*>', '', 'g')")

ORACLE["html_blocks"] = f"""
WITH t AS (SELECT page_id, {_HTML_TEXT} AS txt FROM pages),
s AS (SELECT page_id, string_split(txt, chr(10)) AS arr FROM t),
l0 AS (SELECT page_id, generate_subscripts(arr, 1) - 1 AS pos, unnest(arr) AS raw FROM s),
l1 AS (SELECT page_id, CAST(pos AS INTEGER) AS pos, {STRIP('raw')} AS raw FROM l0),
l2 AS (SELECT page_id, pos, CASE WHEN starts_with(raw, chr(1)) THEN 'heading' ELSE 'text' END AS kind,
              {STRIP("regexp_replace(raw, '^' || chr(1), '')")} AS line FROM l1)
SELECT * FROM l2 WHERE line <> ''
"""

_LINK = """'(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'"""
ORACLE["html_links"] = f"""
WITH x AS (SELECT page_id, regexp_extract(url, '^(https?://[^/]+)', 1) AS base,
                  regexp_extract_all(html, {_LINK}, 1) AS hs, regexp_extract_all(html, {_LINK}, 2) AS ts FROM pages),
l AS (SELECT page_id, base, CAST(generate_subscripts(hs, 1) - 1 AS INTEGER) AS link_pos,
             unnest(hs) AS href, unnest(ts) AS t FROM x)
SELECT page_id, link_pos, href,
       CASE WHEN regexp_matches(href, '^https?://') THEN href WHEN starts_with(href, '/') THEN base || href
            ELSE base || '/' || href END AS url,
       {STRIP(DECODE("regexp_replace(t, '<[^>]*>', '', 'g')"))} AS text
FROM l
"""

ORACLE["date_formats"] = """
WITH r AS (
  SELECT o_orderkey, o_orderpriority AS fmt, o_orderstatus,
         CASE o_orderpriority WHEN '1-URGENT' THEN strftime(o_orderdate, '%Y-%m-%d')
              WHEN '2-HIGH' THEN strftime(o_orderdate, '%Y.%m.%d')
              WHEN '3-MEDIUM' THEN strftime(o_orderdate, '%Y%m%d')
              WHEN '4-NOT SPECIFIED' THEN strftime(o_orderdate, '%d/%m/%Y')
              ELSE 'Published ' || strftime(o_orderdate, '%-m/%-d/%Y') || ' ok' END AS raw0
  FROM orders),
r2 AS (SELECT o_orderkey, fmt,
              CASE WHEN o_orderstatus = 'P' AND fmt IN ('1-URGENT', '3-MEDIUM') THEN raw0 || 'x' ELSE raw0 END AS raw
       FROM r),
p AS (SELECT o_orderkey, raw,
             CASE fmt WHEN '1-URGENT' THEN TRY_CAST(raw AS DATE)
                      WHEN '2-HIGH' THEN TRY_CAST(replace(raw, '.', '-') AS DATE)
                      WHEN '3-MEDIUM' THEN CASE WHEN length(raw) = 8 THEN CAST(try_strptime(raw, '%Y%m%d') AS DATE) END
                      WHEN '4-NOT SPECIFIED' THEN CAST(try_strptime(raw, '%d/%m/%Y') AS DATE)
                      ELSE CAST(try_strptime(NULLIF(regexp_extract(raw, '(\\d{1,2}/\\d{1,2}/\\d{4})', 1), ''),
                                             '%m/%d/%Y') AS DATE) END AS parsed
      FROM r2)
SELECT o_orderkey, raw, parsed, parsed IS NULL AS rejected FROM p
"""

# From the rules: the text between the "지역:" label and a dash or the end (letters and blanks only), else the
# word after "지역" and a colon or dash; blanks alone give the default.
ORACLE["origin_extract"] = """
WITH n AS (SELECT n_nationkey, array_to_string(list_transform(string_split(lower(n_name), ' '),
                  lambda w: upper(w[1]) || w[2:]), ' ') AS name FROM nation),
t AS (
  SELECT c_custkey, c_mktsegment AS seg, name,
         CASE c_mktsegment WHEN 'HOUSEHOLD' THEN '회수 -지역: ' || name || ' - 제품: 과자'
              WHEN 'MACHINERY' THEN '제품 과자 지역 : ' || name || ', 수입'
              WHEN 'BUILDING' THEN '지역:  ' || name WHEN 'FURNITURE' THEN '지역:   - 제품: 과자'
              ELSE '원산지: ' || name END AS t
  FROM customer JOIN n ON c_nationkey = n_nationkey)
SELECT c_custkey,
       CASE WHEN regexp_matches(t, '지역:\\s*[가-힣a-zA-Z\\s]+(-|$)')
            THEN COALESCE(NULLIF(trim(regexp_extract(t, '지역:\\s*([가-힣a-zA-Z\\s]+?)(?:\\s*-|$)', 1)), ''), 'Overseas')
            WHEN regexp_matches(t, '지역\\s*[:-]\\s*[가-힣a-zA-Z]')
            THEN regexp_extract(t, '지역\\s*[:-]\\s*([가-힣a-zA-Z]+)', 1)
            ELSE 'Overseas' END AS origin
FROM t
"""

ORACLE["json_envelope"] = """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
FROM events WHERE event_type NOT IN ('view', 'signup')
"""

ORACLE["append_all"] = """
SELECT o_orderkey, o_custkey, o_orderstatus,
       CASE WHEN o_orderdate < DATE '1995-01-01' THEN 'r1' ELSE 'r2' END AS run_id
FROM orders
"""
ORACLE["hub_load"] = "SELECT o_orderkey, o_totalprice FROM orders"
ORACLE["versioned_rewrite"] = ORACLE["pinned_merge"]

ORACLE["stream_append"] = """
SELECT DISTINCT event_type AS data_source, 'U-' || user_id AS source_detail,
       strftime(CAST(ts AS DATE), '%Y-%m-%d') AS registration_date
FROM events
"""

ORACLE["filtered_append"] = """
SELECT DISTINCT event_type, CAST(user_id AS VARCHAR) AS user_id, strftime(CAST(ts AS DATE), '%Y-%m-%d') AS day, CAST(0 AS INTEGER) AS added_again
FROM events
"""

ORACLE["map_rasff"] = """
WITH r AS (
  SELECT CASE WHEN o_orderstatus = 'P' THEN 'not a date' ELSE strftime(o_orderdate, '%d/%m/%Y') END AS date,
         CAST(o_orderkey AS VARCHAR) AS reference, n_name AS origin,
         o_orderpriority || ' in ' || c_name AS subject, c_mktsegment AS category
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT COALESCE(strftime(CAST(try_strptime(date, '%d/%m/%Y') AS DATE), '%Y-%m-%d'), '') AS registration_date,
       'RASFF' AS data_source, reference AS source_detail, category AS product_type,
       '' AS top_level_product_type, '' AS upper_product_type, subject AS product_name, origin AS origin_country,
       'EU Member States' AS notifying_country, 'Uncategorized' AS hazard_class_l, 'Uncategorized' AS hazard_class_m,
       subject AS hazard_item, '' AS full_text, false AS analyzable, false AS interest_item
FROM r
"""

ORACLE["run_log"] = """
SELECT 'r1' AS run_id, 'orders' AS source, count(*) AS n_rows FROM orders WHERE o_orderdate < DATE '1995-01-01'
UNION ALL
SELECT 'r2', 'orders', count(*) FROM orders WHERE o_orderdate >= DATE '1995-01-01'
"""

ORACLE["capped_listing"] = """
SELECT l_orderkey, l_linenumber, l_quantity,
       (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R') > 5000 AS limited
FROM lineitem WHERE l_returnflag = 'R' ORDER BY l_orderkey, l_linenumber LIMIT 5000
"""
