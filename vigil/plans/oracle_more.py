"""DuckDB oracle SQL for ``catalog_more``, written from the rules and not from the code."""

from __future__ import annotations

import vigil.plans.oracle_sources  # noqa: F401  (map_fda)
from vigil.plans.oracle import ORACLE, u15, ymd
from vigil.plans.oracle_match import _WD
from vigil.schema import DISPLAY_HEADERS, UNIFIED_COLUMNS
from vigil.sources.reference_data import INDUSTRY_CODES, SEED_RULES


def STRIP(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def values(rows: list, names: str) -> str:
    body = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in r) + f", {i})" for i, r in enumerate(rows))
    return f"(VALUES {body}) AS v({names}, ord)"


# The planted parts of the alert pages, by the page's length n.
_AP = """
ap AS (SELECT page_id, html, length(html) AS n,
              CAST(length(html) % 90 + 10 AS VARCHAR) || '-' || lpad(CAST(length(html) % 50 AS VARCHAR), 2, '0') AS no FROM pages)
"""
# Rows of the driver's own pages have no alert link; of the planted table only the first row has one.
ORACLE["index_rows"] = f"""
WITH {_AP}
SELECT page_id, CAST(0 AS INTEGER) AS row_pos, no AS alert_no,
       CASE WHEN n % 2 = 0 THEN 'DWPE' ELSE 'Unknown' END AS type,
       CASE WHEN n % 2 = 0 THEN '01/02/2024' WHEN n % 5 = 0 THEN '01/03/2024' ELSE 'Unknown' END AS date,
       CASE WHEN n % 2 = 0 THEN 'Fish & more' WHEN n % 5 = 0 THEN 'Tea' WHEN n % 3 <> 0 THEN 'Some title' ELSE 'Unknown' END AS title
FROM ap
"""
ORACLE["html_meta"] = f"""
WITH {_AP}
SELECT page_id,
       CASE WHEN n % 2 = 0 THEN 'OASIS charge code: FILTHY' ELSE 'N/A' END AS charge_code_line,
       CASE n % 3 WHEN 0 THEN 'All ' || rtrim(repeat('frozen fish ', 60)) WHEN 1 THEN 'dried fruit' ELSE 'N/A' END AS product_description,
       regexp_matches(html, '(?i)red\\s*list') AS has_red_list,
       n % 2 = 0 OR regexp_matches(html, '(?i)yellow\\s*list') AS has_yellow_list,
       n % 2 = 0 OR regexp_matches(html, '(?i)green\\s*list') AS has_green_list
FROM ap
"""
ORACLE["card_fields"] = f"""
WITH {_AP}
SELECT page_id, CAST(0 AS INTEGER) AS card, '차 ' || n AS name_kr, '중국' AS origin FROM ap
UNION ALL SELECT page_id, 1, '떡', NULL FROM ap
"""
_CELLS = """regexp_extract_all(tr, '(?is)<t[dh]\\b[^>]*>(.*?)</t[dh]>', 1)"""
ORACLE["listing_notices"] = f"""
WITH {_AP}, own AS (SELECT unnest(regexp_extract_all(html, '(?is)<tr\\b[^>]*>(.*?)</tr>', 1)) AS tr FROM pages),
r AS (SELECT '01/02/2024' AS date, 'R-' || n AS reference, 'China' AS origin, 'lead in tea' AS subject, 'tea' AS category FROM ap
      UNION ALL SELECT c[1], c[2], c[3], c[4], c[5] FROM (SELECT list_transform({_CELLS}, lambda x: {STRIP("regexp_replace(x, '<[^>]*>', '', 'g')")}) AS c FROM own) WHERE len(c) >= 5)
SELECT {u15(registration_date="strftime(CAST(try_strptime(date, '%d/%m/%Y') AS DATE), '%Y-%m-%d')", data_source="'RASFF'", source_detail='reference',
            product_type='category', product_name='subject', origin_country='origin', notifying_country="'EU Member States'",
            hazard_class_l="'Uncategorized'", hazard_class_m="'Uncategorized'", hazard_item='subject')}
FROM r
"""
ORACLE["industry_types"] = f"""
WITH p AS (SELECT p_partkey, p_name, p_type, lpad(CAST(p_size AS VARCHAR), 2, '0') AS ind FROM part)
SELECT p_partkey, ind || ' A - B 07' AS code,
       CASE WHEN p_type <> 'PROMO' AND length(trim(p_name)) >= 2 THEN trim(p_name) ELSE 'first content line' END AS name,
       COALESCE((SELECT arg_max(kor, ord) FROM {values(INDUSTRY_CODES, 'code, eng, kor')} WHERE code = ind), '기타(FDA Code ' || ind || ')') AS product_type
FROM p
"""
ORACLE["seed_rule_scan"] = f"""
WITH r AS (SELECT * FROM {values(SEED_RULES, 'keyword, item, m, l, scope')}),
d AS (SELECT doc_id, CASE WHEN source = 'src1' THEN 'MFDS' ELSE 'FDA' END AS src,
             text || CASE length(text) % 3 WHEN 0 THEN ' 무신고 salmonella' WHEN 1 THEN ' 알레르기' ELSE '' END AS t FROM documents),
m AS (SELECT doc_id, arg_min(ord, struct_pack(a := -length(keyword), b := ord)) AS ord
      FROM d JOIN r ON scope IN ('ALL', src) AND instr(lower(t), lower(keyword)) > 0 GROUP BY doc_id)
SELECT doc_id, item AS TESTITM_NM, r.m AS M_KOR_NM, l AS L_KOR_NM FROM m JOIN r USING (ord)
"""
ORACLE["country_master"] = """
SELECT n_name AS en, '국가' || n_nationkey AS ko, CASE WHEN n_nationkey % 2 = 0 THEN 'NA' ELSE '' END AS iso2 FROM nation
"""
ORACLE["rules_load"] = """
SELECT CAST(p_partkey AS VARCHAR) AS Alert_No, p_name AS keyword, CASE WHEN p_size < 20 THEN true WHEN p_size < 40 THEN false END AS IsCollect FROM part
"""
ORACLE["cp949_rules"] = "SELECT '수입-' || p_partkey AS Alert_No, p_name || ' 식품' AS keyword, p_size < 25 AS IsCollect FROM part"
ORACLE["bom_export"] = """
SELECT CAST(o_orderkey AS VARCHAR) AS source_detail, o_orderstatus AS product_type, o_orderpriority AS hazard_item, true AS marked FROM orders
"""
ORACLE["empty_start"] = f"""
SELECT {u15(registration_date=ymd('o_orderdate'), data_source='o_orderstatus', source_detail="'O-' || o_orderkey", hazard_item='o_orderpriority')}
FROM orders
"""
ORACLE["current_master"] = ORACLE["pinned_merge"]
ORACLE["snapshot_buckets"] = ORACLE["snapshot_diff"]
ORACLE["changed_alerts"] = f"SELECT * FROM ({ORACLE['change_detect']}) WHERE status <> 'unchanged'"
ORACLE["folded_audit"] = ORACLE["audit_missing"]
ORACLE["folded_sources"] = ORACLE["audit_sources"]
ORACLE["facet_cascade"] = """
SELECT 0 AS level, 'p_type' AS facet, p_type AS value, count(*) AS n FROM part WHERE p_type <> '' GROUP BY p_type
UNION ALL SELECT 1, 'p_size', CAST(p_size AS VARCHAR), count(*) FROM part WHERE p_type = 'SMALL' AND p_size IS NOT NULL GROUP BY p_size
UNION ALL SELECT 2, 'p_brand', p_brand, count(*) FROM part WHERE p_type = 'SMALL' AND p_size BETWEEN 1 AND 20 AND p_brand <> '' GROUP BY p_brand
"""
ORACLE["cleared_runs"] = """
SELECT 'filled' AS step, count(*) AS n_rows, min(o_orderkey) AS first_key FROM orders
UNION ALL SELECT 'cleared', 0, NULL
UNION ALL SELECT 'again', count(*), min(o_orderkey) FROM orders WHERE o_orderstatus = 'F'
"""
ORACLE["named_source"] = f"""
SELECT {u15(registration_date=ymd('o_orderdate'), data_source="'ORDERS'", source_detail="'O-' || o_orderkey", hazard_item='o_orderpriority',
            analyzable='o_totalprice > 200000')}
FROM orders
"""
ORACLE["work_list"] = """
WITH c AS (
  SELECT o_orderkey, o_orderstatus, o_orderpriority,
         CAST(o_orderdate AS DATE) + CASE WHEN o_orderstatus = 'P' THEN 3 ELSE 0 END AS pub FROM orders)
SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'new' ELSE 'updated' END AS status, CAST(pub AS DATE) AS Last_Updated_Date
FROM c WHERE o_orderstatus = 'O' OR (o_orderstatus = 'P' AND o_orderpriority <> '5-LOW')
"""
ORACLE["update_report"] = """
WITH c AS (SELECT p_partkey FROM part WHERE (p_size > 25) <> (p_retailprice > 1200))
SELECT count(*) AS n_changed, (SELECT string_agg(CAST(p_partkey AS VARCHAR), ',' ORDER BY p_partkey) FROM (SELECT p_partkey FROM c ORDER BY 1 LIMIT 5)) AS first_keys FROM c
"""
ORACLE["date_rejects"] = """
SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '?' || o_orderpriority ELSE strftime(o_orderdate, '%Y%m%d') END AS raw,
       CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderdate AS DATE) END AS day, o_orderstatus = 'P' AS rejected
FROM orders
"""
ORACLE["name_rows"] = "SELECT p_partkey, p_name, p_size FROM part WHERE p_type = 'PROMO'"
ORACLE["manual_insert"] = """
SELECT c_name AS KOR_NM, 'N' || c_nationkey AS category, CASE WHEN n_nationkey IS NOT NULL THEN 'N' || c_nationkey END AS HRNK_PRDLST_CD,
       'R' || n_regionkey AS HTRK_PRDLST_CD, sha256(c_name || chr(1) || 'N' || c_nationkey) AS row_key, true AS IS_MANUAL_FIXED, 'Y' AS USE_YN
FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
"""
ORACLE["keep_manual"] = f"""WITH {_WD},
t AS (SELECT ENG_NM AS term, row_ord, length(ENG_NM) AS tlen FROM wd WHERE length(ENG_NM) >= 4),
dd AS (SELECT doc_id, lower(text) AS q, CASE WHEN source = 'src0' THEN 'hand ' || lang END AS manual FROM documents),
k AS (SELECT DISTINCT doc_id, unnest(string_split_regex(q, '[^\\pL\\pN_]+')) AS tok FROM dd WHERE manual IS NULL),
m AS (SELECT doc_id, arg_min(row_ord, struct_pack(a := -tlen, b := row_ord)) AS row_ord FROM k JOIN t ON k.tok = t.term GROUP BY doc_id)
SELECT dd.doc_id, COALESCE(dd.manual, wd.KOR_NM) AS name FROM dd LEFT JOIN m ON dd.doc_id = m.doc_id LEFT JOIN wd ON m.row_ord = wd.row_ord
"""
# Name first: a known name decides the code; else a known code gives the name; what isn't found stays.
ORACLE["spec_fill"] = """
WITH dim AS (SELECT 'H' || n_nationkey AS code, n_name AS name FROM nation),
r AS (SELECT c_custkey, CASE WHEN c_mktsegment <> 'BUILDING' THEN 'H' || (c_nationkey + CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END) END AS code,
             CASE WHEN c_mktsegment <> 'HOUSEHOLD' THEN n_name END AS name
      FROM customer JOIN nation ON c_nationkey = n_nationkey),
f AS (SELECT c_custkey, CASE WHEN n.code IS NOT NULL THEN n.code ELSE r.code END AS code,
             CASE WHEN n.code IS NOT NULL THEN r.name ELSE COALESCE(k.name, r.name) END AS name
      FROM r LEFT JOIN dim n ON r.name = n.name LEFT JOIN dim k ON r.code = k.code)
SELECT f.c_custkey, f.code, f.name, r_name AS class_l, upper(n_name) AS class_m
FROM f LEFT JOIN nation ON f.name = n_name LEFT JOIN region ON n_regionkey = r_regionkey
"""
ORACLE["monitored"] = "SELECT o_orderkey, true AS IsCollect FROM orders WHERE o_orderpriority <> '5-LOW' AND o_totalprice > 200000"
ORACLE["default_columns"] = "SELECT s_suppkey, s_name AS USE_YN, false AS IS_MANUAL_FIXED, '' AS note FROM supplier"
ORACLE["map_fda_dated"] = f"SELECT * FROM ({ORACLE['map_fda']}) WHERE registration_date = '2024-01-03'"
_SHOWN = [c for c in UNIFIED_COLUMNS if not any(k in DISPLAY_HEADERS[c] for k in ("분류", "품목", "여부"))]
ORACLE["header_view"] = f"SELECT n_name AS origin_country, n_name AS full_text, {len(set(_SHOWN) | {'analyzable'})} AS n_columns FROM nation"
