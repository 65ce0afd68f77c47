"""DuckDB oracle SQL for the query catalogue (same column names as Spark)."""

from __future__ import annotations

from vigil.schema import BOOL_COLUMNS, UNIFIED_COLUMNS

ORACLE: dict = {}


def u15(**exprs) -> str:
    """A 15-column unified select list; absent columns '' (strings) / false."""
    out = []
    for c in UNIFIED_COLUMNS:
        e = exprs.get(c)
        if e is None:
            e = "false" if c in BOOL_COLUMNS else "''"
        elif c in BOOL_COLUMNS:
            e = f"COALESCE({e}, false)"
        else:
            e = f"COALESCE(CAST({e} AS VARCHAR), '')"
        out.append(f"{e} AS {c}")
    return ", ".join(out)


def ymd(e: str) -> str:
    return f"strftime(CAST({e} AS DATE), '%Y-%m-%d')"


ORACLE["top_origin"] = """
SELECT n_name AS origin_country, count(*) AS n
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderstatus IN ('F', 'O') AND o_orderdate >= DATE '1995-01-01' AND o_orderdate < DATE '1997-01-01'
GROUP BY n_name ORDER BY n DESC, n_name LIMIT 10
"""

ORACLE["dash_filter"] = """
SELECT event_id, user_id, event_type, value FROM events
WHERE event_type IN ('click', 'purchase') AND ts >= DATE '2024-01-05' AND ts < DATE '2024-01-21'
"""

ORACLE["daily_trend"] = "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1"

ORACLE["dash_metrics"] = """
WITH per AS (
  SELECT user_id AS f, count(*) AS n,
         count_if(regexp_matches(event_type, '(?i)(purch|e.ror)')) AS r,
         min(CAST(ts AS DATE)) AS lo, max(CAST(ts AS DATE)) AS hi
  FROM events GROUP BY user_id)
SELECT CAST(sum(n) AS BIGINT) AS total, CAST(sum(r) AS BIGINT) AS risk_count,
       arg_min(f, struct_pack(a := -n, b := f)) FILTER (WHERE f IS NOT NULL) AS top_value,
       max(n) FILTER (WHERE f IS NOT NULL) AS top_count,
       min(lo) AS min_date, max(hi) AS max_date
FROM per
"""

ORACLE["class_share"] = """
SELECT p_type, count(*) AS n,
       round(CAST(count(*) AS DOUBLE) * 100.0 / sum(count(*)) OVER (), 2) AS pct
FROM part WHERE p_type IS NOT NULL AND p_type <> '' GROUP BY p_type
"""

ORACLE["facets"] = """
SELECT DISTINCT p_brand FROM part
WHERE p_type = 'SMALL' AND p_size BETWEEN 1 AND 20 AND p_brand IS NOT NULL AND p_brand <> ''
"""

ORACLE["recent_days"] = """
SELECT o_orderkey, CAST(o_orderdate AS DATE) AS order_date FROM orders
WHERE CAST(o_orderdate AS DATE) >= DATE '1998-08-02' - INTERVAL 30 DAY
"""

ORACLE["col_search"] = "SELECT p_partkey, p_name FROM part WHERE regexp_matches(p_name, '(?i)RED|ring$')"

ORACLE["any_search"] = """
SELECT c_custkey FROM customer WHERE
  regexp_matches(CAST(c_custkey AS VARCHAR), '(?i)machin|#0000000[1-3]')
  OR regexp_matches(c_name, '(?i)machin|#0000000[1-3]')
  OR regexp_matches(CAST(c_nationkey AS VARCHAR), '(?i)machin|#0000000[1-3]')
  OR regexp_matches(CAST(c_acctbal AS VARCHAR), '(?i)machin|#0000000[1-3]')
  OR regexp_matches(c_mktsegment, '(?i)machin|#0000000[1-3]')
"""

ORACLE["schema_enforce"] = f"""
SELECT {u15(registration_date=ymd('ts'), data_source='event_type', source_detail="'EV-' || event_id",
            product_name='props', hazard_item="CASE WHEN event_type = 'error' THEN props END",
            analyzable='value > 50')}
FROM events
"""

def _schema_check_sql() -> str:
    """By the rule: expected columns in order are missing or ok, others are extra; rows with a value counted."""
    given = dict(registration_date="CAST(ts AS DATE)", data_source="event_type", source_detail="'EV-' || event_id",
                 product_name="props", hazard_item="CASE WHEN event_type = 'error' THEN props END", analyzable="value > 50", user_id="user_id")
    parts = []
    for i, c in enumerate(UNIFIED_COLUMNS):
        e = f"count({given[c]})" if c in given else "count(NULL)"
        parts.append(f"SELECT '{c}' AS column_name, '{'ok' if c in given else 'missing'}' AS kind, {i} AS position, {e} AS present FROM events")
    parts.append("SELECT 'user_id', 'extra', 6, count(user_id) FROM events")
    return "\nUNION ALL\n".join(parts)


ORACLE["schema_check"] = _schema_check_sql()

ORACLE["export_view"] = """
SELECT strftime(o_orderdate, '%Y-%m-%d') AS "등록일자",
       replace(replace(replace(o_orderstatus, 'F', 'Finished'), 'O', 'Open'), 'P', 'Pending') AS "데이터소스",
       regexp_replace(o_orderpriority || '-' || o_orderkey, '-(\\d+|UNKNOWN).*', '') AS "상세출처",
       o_orderkey
FROM orders
"""

_ORD_NOTICE = f"""
SELECT {u15(registration_date=ymd('o_orderdate'), data_source='o_orderstatus',
            source_detail="'ORD-' || o_custkey", product_type='o_orderpriority', full_text='o_orderkey')},
       o_orderdate AS od
FROM orders
"""
ORACLE["hub_append"] = f"""
WITH a AS ({_ORD_NOTICE})
SELECT {", ".join(UNIFIED_COLUMNS)} FROM a i
WHERE i.od >= DATE '1995-01-01' AND NOT EXISTS (
  SELECT 1 FROM a h WHERE h.od < DATE '1996-01-01' AND h.data_source = i.data_source
    AND h.source_detail = i.source_detail AND h.registration_date = i.registration_date)
"""

ORACLE["hash_dedup"] = """
WITH n AS (SELECT doc_id, sha256(source || '::' || text) AS record_id, lang FROM documents)
SELECT doc_id, record_id FROM n WHERE lang = 'en'
UNION ALL
SELECT doc_id, record_id FROM n WHERE record_id NOT IN (SELECT record_id FROM n WHERE lang = 'en')
"""

ORACLE["first_per_key"] = """
SELECT min(doc_id) AS doc_id, arg_min(lang, doc_id) AS lang, arg_min(source, doc_id) AS source
FROM documents GROUP BY text
"""
ORACLE["last_per_key"] = """
SELECT max(doc_id) AS doc_id, arg_max(lang, doc_id) AS lang, arg_max(source, doc_id) AS source
FROM documents GROUP BY text
"""
ORACLE["row_distinct"] = "SELECT DISTINCT text, lang FROM documents"

ORACLE["pinned_merge"] = """
SELECT s_suppkey, s_name, s_acctbal, true AS IS_MANUAL_FIXED FROM supplier WHERE s_acctbal < 0
UNION ALL
SELECT s_suppkey, upper(s_name) AS s_name, s_acctbal + 1 AS s_acctbal, false AS IS_MANUAL_FIXED
FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
"""

ORACLE["change_detect"] = """
WITH old AS (
  SELECT o_orderkey, CAST(o_orderdate AS DATE) AS pub_date, o_orderpriority <> '5-LOW' AS IsCollect
  FROM orders WHERE o_orderdate < DATE '1997-01-01'),
new AS (
  SELECT o_orderkey,
         CASE WHEN o_orderstatus = 'P' THEN CAST(o_orderdate AS DATE) + 1 ELSE CAST(o_orderdate AS DATE) END
           AS pub_date,
         true AS IsCollect
  FROM orders),
j AS (
  SELECT n.o_orderkey, n.pub_date,
         CASE WHEN o.o_orderkey IS NOT NULL THEN o.IsCollect ELSE n.IsCollect END AS IsCollect,
         CASE WHEN o.o_orderkey IS NULL THEN 'new'
              WHEN n.pub_date IS DISTINCT FROM o.pub_date THEN 'updated' ELSE 'unchanged' END AS status
  FROM new n LEFT JOIN old o ON n.o_orderkey = o.o_orderkey)
SELECT *, status IN ('new', 'updated') AS Is_New_Or_Updated FROM j
"""

_CPATCH = """
p AS (SELECT c_custkey,
             CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal + 100 END AS pa,
             CASE WHEN c_acctbal > 5000 THEN upper(c_name) END AS pn
      FROM customer WHERE c_mktsegment = 'BUILDING')
"""
ORACLE["patch_non_null"] = f"""
WITH {_CPATCH}
SELECT c.c_custkey, COALESCE(p.pn, c.c_name) AS c_name, COALESCE(p.pa, c.c_acctbal) AS c_acctbal, c.c_mktsegment
FROM customer c LEFT JOIN p ON c.c_custkey = p.c_custkey
"""
ORACLE["patch_all"] = f"""
WITH {_CPATCH}
SELECT c.c_custkey,
       CASE WHEN p.c_custkey IS NOT NULL THEN p.pn ELSE c.c_name END AS c_name,
       CASE WHEN p.c_custkey IS NOT NULL THEN p.pa ELSE c.c_acctbal END AS c_acctbal,
       c.c_mktsegment,
       COALESCE(p.c_custkey IS NOT NULL AND (c.c_acctbal IS DISTINCT FROM p.pa OR c.c_name IS DISTINCT FROM p.pn),
                false) AS changed
FROM customer c LEFT JOIN p ON c.c_custkey = p.c_custkey
"""
ORACLE["snapshot_diff"] = f"""
WITH {_CPATCH},
b AS (
  SELECT c.c_custkey,
         CASE WHEN p.c_custkey IS NOT NULL THEN p.pn ELSE c.c_name END AS c_name,
         CASE WHEN p.c_custkey IS NOT NULL THEN p.pa ELSE c.c_acctbal END AS c_acctbal,
         c.c_mktsegment
  FROM customer c LEFT JOIN p ON c.c_custkey = p.c_custkey WHERE c.c_mktsegment <> 'FURNITURE'),
d AS (
  SELECT COALESCE(a.c_custkey, b.c_custkey) AS c_custkey,
         CASE WHEN a.c_custkey IS NULL THEN 'only_b' WHEN b.c_custkey IS NULL THEN 'only_a' ELSE 'both' END AS side,
         concat_ws(',',
           CASE WHEN a.c_name IS DISTINCT FROM b.c_name THEN 'c_name' END,
           CASE WHEN a.c_acctbal IS DISTINCT FROM b.c_acctbal THEN 'c_acctbal' END,
           CASE WHEN a.c_mktsegment IS DISTINCT FROM b.c_mktsegment THEN 'c_mktsegment' END) AS changed
  FROM customer a FULL JOIN b ON a.c_custkey = b.c_custkey)
SELECT * FROM d WHERE side <> 'both' OR changed <> ''
"""

ORACLE["crud_merge"] = """
SELECT s_suppkey, CASE WHEN s_nationkey = 1 THEN lower(s_name) ELSE s_name END AS s_name, s_nationkey,
       s_nationkey = 1 AS IS_MANUAL_FIXED
FROM supplier WHERE s_nationkey <> 0
UNION ALL
SELECT CAST(n_nationkey + 1000000 AS BIGINT), n_name, n_nationkey, true FROM nation
"""

ORACLE["union_sources"] = f"""
SELECT {u15(data_source="'CUST'", source_detail="'C-' || c_custkey", product_name='c_name',
            product_type='c_mktsegment')} FROM customer
UNION ALL
SELECT {u15(data_source="'SUPP'", source_detail="'S-' || s_suppkey", product_name='s_name')} FROM supplier
"""

ORACLE["dict_union"] = """
WITH u AS (
  SELECT p_name AS name, p_partkey AS ord, p_type AS grp FROM part
  UNION ALL
  SELECT lower(n_name), CAST(n_nationkey + 100000 AS BIGINT), 'NATION' FROM nation)
SELECT name, min(ord) AS ord, arg_min(grp, ord) AS grp FROM u GROUP BY name
"""

ORACLE["code_name"] = """
SELECT c_custkey, COALESCE(n.n_name, CAST(c_nationkey AS VARCHAR)) AS nation_name
FROM customer c LEFT JOIN (SELECT * FROM nation WHERE n_name NOT LIKE '%1') n ON c.c_nationkey = n.n_nationkey
"""

ORACLE["spec_enrich"] = """
SELECT l_orderkey, l_linenumber,
       COALESCE(p.p_name, CAST(l_partkey AS VARCHAR)) AS part_name,
       COALESCE(s.s_name, CAST(l_suppkey AS VARCHAR)) AS supp_name
FROM lineitem
LEFT JOIN (SELECT p_partkey, p_name FROM part WHERE p_type <> 'PROMO') p ON l_partkey = p.p_partkey
LEFT JOIN supplier s ON l_suppkey = s.s_suppkey
"""

ORACLE["name_join"] = """
SELECT p.p_partkey, f.canon_key, f.canon_brand FROM part p
LEFT JOIN (SELECT p_name AS nm, min(p_partkey) AS canon_key, arg_min(p_brand, p_partkey) AS canon_brand
           FROM part GROUP BY p_name) f ON p.p_name = f.nm
"""

ORACLE["hierarchy"] = """
WITH tree AS (
  SELECT concat('R', r_regionkey) AS cd, CAST(NULL AS VARCHAR) AS par, CAST(NULL AS VARCHAR) AS top,
         r_name AS kor, lower(r_name) AS eng, CAST(r_regionkey AS BIGINT) AS ord FROM region
  UNION ALL
  SELECT concat('N', n_nationkey), concat('R', n_regionkey), concat('R', n_regionkey),
         CASE WHEN n_name NOT LIKE '%3' THEN n_name END, lower(n_name), CAST(n_nationkey + 100 AS BIGINT) FROM nation
  UNION ALL
  SELECT concat('C', c_custkey), concat('N', c_nationkey), concat('R', n_regionkey), c_name, c_mktsegment,
         CAST(c_custkey + 1000 AS BIGINT)
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
d AS (SELECT cd, arg_min(COALESCE(kor, eng), ord) AS nm FROM tree GROUP BY cd)
SELECT t.cd AS code, COALESCE(dt.nm, t.eng) AS top_name, dp.nm AS parent_name
FROM tree t LEFT JOIN d dt ON t.top = dt.cd LEFT JOIN d dp ON t.par = dp.cd
"""

ORACLE["bidi_fill"] = """
WITH r AS (
  SELECT c_custkey, CASE WHEN c_mktsegment <> 'AUTOMOBILE' THEN c_nationkey END AS code,
         CASE WHEN c_mktsegment <> 'BUILDING' THEN n_name END AS name
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT r.c_custkey,
       CASE WHEN a.n_name IS NOT NULL THEN r.code ELSE COALESCE(b.n_nationkey, r.code) END AS code,
       COALESCE(a.n_name, r.name) AS name
FROM r LEFT JOIN nation a ON r.code = a.n_nationkey LEFT JOIN nation b ON r.name = b.n_name
"""

ORACLE["priority_type"] = """
WITH m AS (SELECT CAST(p_size AS VARCHAR) AS mc, arg_max(p_type, p_partkey) AS mn FROM part WHERE p_size <= 20 GROUP BY p_size)
SELECT p_partkey,
       COALESCE(m.mn, CASE WHEN p_retailprice > 1500 THEN NULLIF(trim(p_brand), '') END,
                '기타(FDA Code ' || CAST(p_size AS VARCHAR) || ')') AS product_type
FROM part LEFT JOIN m ON CAST(p_size AS VARCHAR) = m.mc
"""

_COUNTRIES = """
c AS (SELECT n_name AS en, r_name || '_' || n_nationkey AS ko, n_nationkey AS ord
      FROM nation JOIN region ON n_regionkey = r_regionkey)
"""
ORACLE["country_norm"] = f"""
WITH {_COUNTRIES},
raw AS (
  SELECT c_custkey,
         CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN lower(n_name)
              WHEN c_mktsegment = 'MACHINERY' THEN ' ' || r_name || '_' || n_nationkey || ' '
              WHEN c_mktsegment = 'BUILDING' THEN 'Atlantis' ELSE n_name END AS raw
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
e AS (SELECT lower(trim(en)) AS k1, arg_min(en, ord) AS v1 FROM c GROUP BY 1),
k AS (SELECT lower(trim(ko)) AS k2, arg_min(en, ord) AS v2 FROM c GROUP BY 1)
SELECT c_custkey, COALESCE(e.v1, k.v2, raw) AS country
FROM raw LEFT JOIN e ON lower(trim(raw)) = e.k1 LEFT JOIN k ON lower(trim(raw)) = k.k2
"""
ORACLE["country_prefix"] = f"""
WITH {_COUNTRIES},
raw AS (
  SELECT c_custkey,
         CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN r_name || '_' || n_nationkey
              WHEN c_mktsegment = 'MACHINERY' THEN substr(r_name, 1, 3)
              WHEN c_mktsegment = 'FURNITURE' THEN substr(r_name, 1, 1)
              WHEN c_mktsegment = 'BUILDING' THEN '' ELSE 'ZZ top' END AS raw
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
SELECT c_custkey,
       COALESCE((SELECT arg_max(en, ord) FROM c WHERE ko = raw),
                CASE WHEN raw <> '' THEN (SELECT arg_min(en, ord) FROM c WHERE starts_with(ko, substr(raw, 1, 2))) END,
                NULLIF(raw, ''), 'Overseas') AS country
FROM raw
"""

# ------------------------------------------------------------------ audit

_DOC_NOTICES = """
d AS (
  SELECT source AS data_source, 'D-' || doc_id AS source_detail, lang AS product_type,
         CASE WHEN quality = 1 THEN upper(lang) END AS top_level_product_type,
         CASE WHEN toxic IS NOT NULL THEN lang END AS upper_product_type,
         CASE WHEN n_chars > 500 THEN 'item' END AS hazard_item,
         CASE WHEN toxic = 1 THEN 'toxic' WHEN toxic = 0 THEN '' END AS hazard_class_m,
         CASE WHEN quality = 0 THEN 'None' END AS hazard_class_l,
         toxic = 1 AS analyzable
  FROM documents LEFT JOIN labels USING (doc_id))
"""
_DOC_COLS = ["data_source", "source_detail", "product_type", "top_level_product_type", "upper_product_type",
             "hazard_item", "hazard_class_m", "hazard_class_l", "analyzable"]


def _audit_missing_sql():
    aggs = ["count(*) AS t"]
    parts = []
    for i, c in enumerate(UNIFIED_COLUMNS):
        if c in _DOC_COLS:
            miss = f"{c} IS NULL" if c in BOOL_COLUMNS else f"({c} IS NULL OR CAST({c} AS VARCHAR) = '')"
            aggs.append(f"count_if({miss}) AS m{i}")
            pct = f"CASE WHEN t > 0 THEN round(CAST(m{i} AS DOUBLE) * 100.0 / t, 2) ELSE 0.0 END"
            status = (f"CASE WHEN {pct} = 0 THEN 'perfect' WHEN {pct} < 10 THEN 'minor' "
                      f"WHEN {pct} < 50 THEN 'moderate' ELSE 'critical' END")
            parts.append(f"SELECT '{c}' AS column_name, {i} AS position, m{i} AS missing, {pct} AS missing_pct, "
                         f"{status} AS status FROM agg")
        else:
            parts.append(f"SELECT '{c}' AS column_name, {i} AS position, CAST(NULL AS BIGINT) AS missing, "
                         f"CAST(NULL AS DOUBLE) AS missing_pct, 'absent' AS status FROM agg")
    return f"WITH {_DOC_NOTICES}, agg AS (SELECT {', '.join(aggs)} FROM d)\n" + "\nUNION ALL\n".join(parts)


ORACLE["audit_missing"] = _audit_missing_sql()


def _audit_mapping_sql():
    pairs = [("product_type", "top_level_product_type"), ("product_type", "upper_product_type"),
             ("hazard_item", "hazard_class_m"), ("hazard_item", "hazard_class_l")]

    def empty(c):
        return f"({c} IS NULL OR CAST({c} AS VARCHAR) = '' OR CAST({c} AS VARCHAR) = 'None')"

    aggs = ["count(*) AS t"] + [f"count_if(NOT {empty(a)} AND {empty(b)}) AS f{i}" for i, (a, b) in enumerate(pairs)]
    parts = [f"SELECT '{a}' AS raw_col, '{b}' AS derived_col, f{i} AS failures, "
             f"CASE WHEN t > 0 THEN round(CAST(f{i} AS DOUBLE) * 100.0 / t, 2) ELSE 0.0 END AS failure_pct, "
             f"CASE WHEN f{i} > 0 THEN 'critical' ELSE 'ok' END AS status FROM agg"
             for i, (a, b) in enumerate(pairs)]
    return f"WITH {_DOC_NOTICES}, agg AS (SELECT {', '.join(aggs)} FROM d)\n" + "\nUNION ALL\n".join(parts)


ORACLE["audit_mapping"] = _audit_mapping_sql()

ORACLE["audit_summary"] = f"""
WITH {_DOC_NOTICES}
SELECT count(*) AS total_rows, 15 AS expected_columns, {len(_DOC_COLS)} AS actual_columns,
       count(DISTINCT data_source) AS n_sources, false AS schema_ok, 'fail' AS verdict
FROM d
"""
ORACLE["audit_sources"] = f"WITH {_DOC_NOTICES} SELECT data_source AS source, count(*) AS n_rows FROM d WHERE data_source IS NOT NULL GROUP BY 1"


def _full_audit_sql() -> str:
    parts = []
    for i, c in enumerate(UNIFIED_COLUMNS):
        present = f"count({c})" if c in _DOC_COLS else "count(NULL)"
        common = [x for x in _DOC_COLS if x in UNIFIED_COLUMNS]
        place = [x for x in UNIFIED_COLUMNS if x in _DOC_COLS]
        kind = "missing" if c not in _DOC_COLS else "ok" if common.index(c) == place.index(c) else "order"
        parts.append(f"SELECT 'schema' AS part, '{c}' AS name, CAST({present} AS VARCHAR) AS value, '{kind}' AS status FROM d")
    parts += [f"SELECT 'schema', '{c}', CAST(count({c}) AS VARCHAR), 'extra' FROM d" for c in _DOC_COLS if c not in UNIFIED_COLUMNS]
    parts.append(f"SELECT 'missing', column_name, CAST(missing AS VARCHAR), status FROM ({ORACLE['audit_missing']})")
    parts.append(f"SELECT 'mapping', raw_col || '>' || derived_col, CAST(failures AS VARCHAR), status FROM ({ORACLE['audit_mapping']})")
    parts.append("SELECT 'summary', 'rows', CAST(count(*) AS VARCHAR), 'fail' FROM d")
    return f"WITH {_DOC_NOTICES}\n" + "\nUNION ALL\n".join(parts)


ORACLE["full_audit"] = _full_audit_sql()

# ------------------------------------------------------------------ funnel / flags

_IDX = """
idx AS (
  SELECT o_orderkey, o_orderstatus <> 'F' AS chg,
         CASE WHEN o_orderpriority = '5-LOW' THEN false WHEN o_orderpriority = '4-NOT SPECIFIED' THEN NULL
              ELSE true END AS col,
         o_totalprice > 250000 AS red,
         CASE WHEN o_totalprice > 100000 THEN true END AS yel
  FROM orders)
"""
ORACLE["funnel"] = f"""
WITH {_IDX},
f AS (SELECT NOT COALESCE(chg, true) AS unch, NOT COALESCE(col, true) AS off,
             NOT (COALESCE(red, false) OR COALESCE(yel, false)) AS nolist FROM idx)
SELECT count(*) AS total, count_if(unch) AS skipped_unchanged, count_if(NOT unch AND off) AS skipped_collect_off,
       count_if(NOT unch AND NOT off AND nolist) AS skipped_no_list,
       count_if(NOT unch AND NOT off AND NOT nolist) AS processed
FROM f
"""
ORACLE["funnel_work"] = f"""
WITH {_IDX}
SELECT o_orderkey FROM idx
WHERE COALESCE(col, true) AND (COALESCE(red, false) OR COALESCE(yel, false)) AND COALESCE(chg, true)
ORDER BY o_orderkey LIMIT 25
"""

ORACLE["flag_rules"] = """
WITH r AS (
  SELECT p_partkey, CAST(p_size AS VARCHAR) || '-' || CAST(length(p_name) AS VARCHAR) AS alert_no,
         p_size AS a, length(p_name) AS b, p_type = 'PROMO' AS green, p_type = 'LARGE' AS red,
         p_brand, p_type FROM part),
f AS (
  SELECT *, CASE WHEN ((a > 10 OR (a = 10 AND b >= 5)) AND (a < 20 OR (a = 20 AND b <= 9)))
                   OR (green AND NOT red) THEN false ELSE true END AS IsCollect FROM r)
SELECT p_partkey, alert_no, IsCollect,
       CASE WHEN IsCollect THEN p_brand END AS Manual_Hazard_Item,
       CASE WHEN IsCollect THEN p_type END AS Manual_Product_Type
FROM f
"""

ORACLE["seq_codes"] = """
SELECT o_orderkey, o_totalprice, 'Z-' || row_number() OVER (ORDER BY reverse(lpad(CAST(o_orderkey AS VARCHAR), 12, '0'))) AS code FROM orders
"""
