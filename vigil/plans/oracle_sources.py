"""DuckDB oracle SQL for the source mappers (``catalog_sources``), composed of the matching stages' SQL."""

from __future__ import annotations

import vigil.plans.oracle_text  # noqa: F401  (block_segment)
from vigil.plans.oracle import _COUNTRIES, ORACLE, u15
from vigil.plans.oracle_match import _HD, _HT, NORM, exact_sql, fuzzy_sql, keyword_sql, scan_sql

_TREE = f"""
tree AS (
  SELECT concat('R', r_regionkey) AS cd, CAST(NULL AS VARCHAR) AS par, CAST(NULL AS VARCHAR) AS top,
         r_name AS kor, lower(r_name) AS eng, CAST(r_regionkey AS BIGINT) AS row_ord FROM region
  UNION ALL
  SELECT concat('N', n_nationkey), concat('R', n_regionkey), concat('R', n_regionkey),
         CASE WHEN n_name NOT LIKE '%3' THEN n_name END, lower(n_name), CAST(n_nationkey + 100 AS BIGINT) FROM nation
  UNION ALL
  SELECT concat('C', c_custkey), concat('N', c_nationkey), concat('R', n_regionkey), c_name, c_mktsegment,
         CAST(c_custkey + 1000 AS BIGINT)
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
nm AS (SELECT cd, arg_min(COALESCE(kor, eng), row_ord) AS nm FROM tree GROUP BY cd),
pt0 AS (SELECT {NORM('kor')} AS term, 0 AS col_rank, row_ord FROM tree WHERE kor IS NOT NULL
        UNION ALL SELECT {NORM('eng')}, 1, row_ord FROM tree WHERE eng IS NOT NULL),
pt1 AS (SELECT term, arg_min(col_rank, struct_pack(a := col_rank, b := row_ord)) AS col_rank,
               arg_min(row_ord, struct_pack(a := col_rank, b := row_ord)) AS row_ord FROM pt0
        WHERE length(term) >= 1 GROUP BY term),
pt AS (SELECT *, CAST(length(term) AS INTEGER) AS tlen FROM pt1)
"""
_HZ = f"""{_HD}, {_HT},
hz AS (SELECT *, upper(substr(ENG_NM, 1, 1)) AS M_KOR_NM, 'L' || length(ENG_NM) AS L_KOR_NM,
              length(KOR_NM) > 10 AS ANALYZABLE, ENG_NM < 'm' AS INTEREST_ITEM FROM hd),
rr AS (SELECT lower(ENG_NM) AS kw, 'item_' || row_ord AS item, CASE WHEN lower(ENG_NM) < 'm' THEN 'ALL' ELSE 'src3' END AS scope,
              CASE WHEN lower(ENG_NM) < 'm' THEN 'RULE-M' END AS rm, CASE WHEN lower(ENG_NM) < 'm' THEN 'RULE-L' END AS rl,
              row_ord AS rule_ord
       FROM hd WHERE length(ENG_NM) >= 2)
"""


def _rest(q: str, seen: str) -> str:
    return f"SELECT q FROM {q} WHERE q NOT IN (SELECT q FROM {seen})"


def product_ctes(rows: str, col: str) -> str:
    """CTEs up to ``pinfo(q, top, upper)`` for the product types ``col`` of ``rows``."""
    return f"""
p1 AS (SELECT DISTINCT {NORM(col)} AS q FROM {rows} WHERE {NORM(col)} <> ''),
pe AS ({exact_sql('p1')}), p2 AS ({_rest('p1', 'pe')}), pk AS ({keyword_sql('p2')}), p3 AS ({_rest('p2', 'pk')}),
pf AS ({fuzzy_sql('p3')}),
pm AS (SELECT q, row_ord FROM pe UNION ALL SELECT q, row_ord FROM pk UNION ALL SELECT q, row_ord FROM pf),
pinfo AS (SELECT q, t1.nm AS top, t2.nm AS upper FROM pm JOIN tree USING (row_ord)
          LEFT JOIN nm t1 ON tree.top = t1.cd LEFT JOIN nm t2 ON tree.par = t2.cd)"""


def hazard_ctes(rows: str, col: str) -> str:
    """CTEs up to ``hinfo(q, M_KOR_NM, L_KOR_NM, ANALYZABLE, INTEREST_ITEM)`` for the items ``col`` of ``rows``."""
    return f"""
h1 AS (SELECT DISTINCT {NORM(col)} AS q FROM {rows} WHERE {NORM(col)} <> ''),
hl AS (SELECT q FROM h1 WHERE length(q) > 30), hs AS (SELECT q FROM h1 WHERE length(q) <= 30),
ls AS ({scan_sql('hl', 'ht')}), l2 AS ({_rest('hl', 'ls')}), le AS ({exact_sql('l2', 'ht')}), l3 AS ({_rest('l2', 'le')}),
lk AS ({keyword_sql('l3', 'ht')}),
se AS ({exact_sql('hs', 'ht')}), s2 AS ({_rest('hs', 'se')}), sk AS ({keyword_sql('s2', 'ht')}), s3 AS ({_rest('s2', 'sk')}),
sf AS ({fuzzy_sql('s3', 'ht')}),
hm AS (SELECT q, row_ord FROM ls UNION ALL SELECT q, row_ord FROM le UNION ALL SELECT q, row_ord FROM lk
       UNION ALL SELECT q, row_ord FROM se UNION ALL SELECT q, row_ord FROM sk UNION ALL SELECT q, row_ord FROM sf),
hinfo AS (SELECT q, M_KOR_NM, L_KOR_NM, ANALYZABLE, INTEREST_ITEM FROM hm JOIN hz USING (row_ord))"""


def text_ctes(rows: str, source: str | None, fallback: str) -> str:
    """CTEs up to ``x``: ``rows`` (id, full_text, ...) plus hazard_item, rule_m and rule_l (no rules if no source)."""
    matched = f"""SELECT id, arg_min(rule_ord, struct_pack(a := -length(kw), b := rule_ord)) AS rule_ord
      FROM {rows} JOIN rr ON scope IN ('ALL', '{source}') AND instr(lower(full_text), kw) > 0
      WHERE {NORM('full_text')} <> '' GROUP BY id""" if source else "SELECT id, CAST(NULL AS BIGINT) AS rule_ord FROM " + rows + " WHERE false"
    return f"""
rs AS ({matched}),
t1 AS (SELECT DISTINCT {NORM('full_text')} AS q FROM {rows} WHERE {NORM('full_text')} <> ''),
ts AS ({scan_sql('t1', 'ht')}), t2 AS ({_rest('t1', 'ts')}), tf AS ({fuzzy_sql('t2', 'ht')}),
tm AS (SELECT q, row_ord FROM ts UNION ALL SELECT q, row_ord FROM tf),
x AS (SELECT {rows}.*, COALESCE(NULLIF(rr.item, ''), COALESCE(hz.KOR_NM, hz.ENG_NM, hz.TESTITM_NM), {fallback}) AS hazard_item,
             CASE WHEN rr.rm IS NOT NULL AND rr.rl IS NOT NULL THEN rr.rm END AS rule_m,
             CASE WHEN rr.rm IS NOT NULL AND rr.rl IS NOT NULL THEN rr.rl END AS rule_l
      FROM {rows} LEFT JOIN rs ON {rows}.id = rs.id LEFT JOIN rr ON rs.rule_ord = rr.rule_ord
      LEFT JOIN tm ON {NORM('full_text')} = tm.q LEFT JOIN hz ON tm.row_ord = hz.row_ord)"""


_CLASSES = dict(
    hazard_class_m="CASE WHEN rule_m IS NOT NULL THEN rule_m ELSE COALESCE(M_KOR_NM, NULLIF(hazard_item, '')) END",
    hazard_class_l="CASE WHEN rule_m IS NOT NULL THEN rule_l ELSE L_KOR_NM END",
    hazard_item="hazard_item", analyzable="ANALYZABLE", interest_item="INTEREST_ITEM")
_ORDERS = "orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"
_DAY = "CAST(DATE '2020-01-01' + CAST(n_chars // 10 AS INTEGER) AS DATE)"

ORACLE["map_i2620"] = f"""
WITH {_TREE}, {_HZ},
x AS (SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS day, c_name, o_orderpriority AS hazard_item,
             CASE WHEN o_orderstatus = 'F' THEN c_mktsegment ELSE n_name END AS ptype,
             CAST(NULL AS VARCHAR) AS rule_m, CAST(NULL AS VARCHAR) AS rule_l
      FROM {_ORDERS}),
{product_ctes('x', 'ptype')}, {hazard_ctes('x', 'hazard_item')}
SELECT {u15(registration_date='day', data_source="'MFDS'", source_detail="'국내식품 부적합-' || id", product_type='ptype',
            top_level_product_type='pinfo.top', upper_product_type='pinfo.upper', product_name='c_name',
            origin_country="'South Korea'", notifying_country="'South Korea'", **_CLASSES)}
FROM x LEFT JOIN pinfo ON {NORM('ptype')} = pinfo.q LEFT JOIN hinfo ON {NORM('hazard_item')} = hinfo.q
"""

ORACLE["map_i0490"] = f"""
WITH {_TREE}, {_HZ},
d AS (SELECT doc_id AS id, strftime({_DAY}, '%Y-%m-%d') AS day, 'doc ' || doc_id AS pname, lang AS ptype, text AS full_text
      FROM documents),
{text_ctes('d', 'MFDS', 'full_text')}, {product_ctes('x', 'ptype')}, {hazard_ctes('x', 'hazard_item')}
SELECT {u15(registration_date='day', data_source="'MFDS'", source_detail="'회수판매중지-' || id", product_type='ptype',
            top_level_product_type='pinfo.top', upper_product_type='pinfo.upper', product_name='pname',
            origin_country="'South Korea'", notifying_country="'South Korea'", full_text='full_text', **_CLASSES)}
FROM x LEFT JOIN pinfo ON {NORM('ptype')} = pinfo.q LEFT JOIN hinfo ON {NORM('hazard_item')} = hinfo.q
"""

ORACLE["map_i2810"] = f"""
WITH {_HZ},
d AS (SELECT doc_id AS id, strftime({_DAY}, '%Y-%m-%d') AS day, string_split(text, chr(10))[1] AS title, source, lang,
             regexp_replace(source || ' -지역: ' || lang || ' - ' || text, '^\\s+|\\s+$', '', 'g') AS full_text
      FROM documents),
{text_ctes('d', 'MFDS', 'source')}, {hazard_ctes('x', 'hazard_item')}
SELECT {u15(registration_date='day', data_source="'MFDS'", source_detail="'해외 위해식품 회수-' || id",
            product_type="'수입식품(해외회수)'", top_level_product_type="'수입식품'", upper_product_type="'위해회수'",
            product_name='title', origin_country='lang', notifying_country="'South Korea'", full_text='full_text', **_CLASSES)}
FROM x LEFT JOIN hinfo ON {NORM('hazard_item')} = hinfo.q
"""

ORACLE["map_impfood"] = f"""
WITH {_TREE}, {_HZ},
d AS (SELECT p_partkey AS id, strftime(CAST(DATE '2024-01-01' + CAST(p_size AS INTEGER) AS DATE), '%Y-%m-%d') AS day,
             CASE WHEN p_size > 25 THEN p_name || ' (' || p_brand || ')' ELSE p_name END AS pname, p_type AS ptype,
             p_type || ' ' || p_name AS full_text
      FROM part),
{text_ctes('d', None, 'full_text')}, {product_ctes('x', 'ptype')}, {hazard_ctes('x', 'hazard_item')}
SELECT {u15(registration_date='day', data_source="'ImpFood'", source_detail="'ImpFood-' || id", product_type='ptype',
            top_level_product_type='pinfo.top', upper_product_type='pinfo.upper', product_name='pname',
            origin_country="'NATION_1'", notifying_country="'South Korea'", full_text='full_text', **_CLASSES)}
FROM x LEFT JOIN pinfo ON {NORM('ptype')} = pinfo.q LEFT JOIN hinfo ON {NORM('hazard_item')} = hinfo.q
"""

_SEG = ORACLE["block_segment"].strip()
_CODE = "\\d{2}\\s+[A-Z0-9]\\s+[A-Z0-9-]\\s+[A-Z0-9-]\\s+\\d{2}"
ORACLE["map_fda"] = f"""
WITH {_HZ}, {_COUNTRIES},
seg AS ({_SEG}),
b AS (SELECT *, doc || '-' || block AS alert, regexp_extract(opener, '({_CODE})', 1) AS code,
             strftime(CAST(DATE '2024-01-01' + CAST(date AS INTEGER) AS DATE), '%Y-%m-%d') AS day,
             COALESCE(NULLIF(string_split(content, chr(10))[1], ''), opener) AS first_line FROM seg WHERE date IS NOT NULL),
d AS (SELECT alert AS id, alert, day,
             COALESCE((SELECT arg_min(en, ord) FROM c WHERE lower(trim(en)) = lower(trim(header))),
                      (SELECT arg_min(en, ord) FROM c WHERE lower(trim(ko)) = lower(trim(header))), header) AS country,
             CASE WHEN code <> '' THEN code ELSE string_split(opener, ' ')[1] END AS p_code,
             CASE WHEN code = '' THEN opener
                  WHEN length(trim(regexp_replace(substr(opener, instr(opener, code) + length(code)), '^[\\s\\-,]+', ''))) < 2
                  THEN first_line
                  ELSE trim(regexp_replace(substr(opener, instr(opener, code) + length(code)), '^[\\s\\-,]+', '')) END AS pname,
             CASE WHEN content = '' THEN opener ELSE opener || chr(10) || content END AS full_text
      FROM b),
{text_ctes('d', 'FDA', "''")}, {hazard_ctes('x', 'hazard_item')}
SELECT {u15(registration_date='day', data_source="'FDA'", source_detail="'FDA Import Alert_' || alert", product_type='p_code',
            product_name='pname', origin_country='country', notifying_country="'United States'", full_text='full_text',
            **_CLASSES)}
FROM x LEFT JOIN hinfo ON {NORM('hazard_item')} = hinfo.q
"""
