"""DuckDB oracle SQL for the matching queries (``catalog_match``)."""

from __future__ import annotations

from vigil.plans.oracle import ORACLE


def NORM(x: str) -> str:
    return f"lower(regexp_replace(COALESCE({x}, ''), '^\\s+|\\s+$', '', 'g'))"


_PD = """
pd AS (SELECT p_name AS KOR_NM, p_type AS ENG_NM, p_brand AS M_KOR_NM, p_type AS L_KOR_NM,
              p_size > 25 AS ANALYZABLE, p_retailprice > 1500 AS INTEREST_ITEM, p_partkey AS row_ord FROM part)
"""
_PT = f"""
pt0 AS (SELECT {NORM('KOR_NM')} AS term, 0 AS col_rank, row_ord FROM pd WHERE KOR_NM IS NOT NULL
        UNION ALL SELECT {NORM('ENG_NM')}, 1, row_ord FROM pd WHERE ENG_NM IS NOT NULL),
pt AS (SELECT term, col_rank, row_ord, CAST(length(term) AS INTEGER) AS tlen FROM pt0 WHERE length(term) >= 1)
"""
_TX = f"""
tx AS (SELECT ' ' || upper(p_name) || chr(9) AS t FROM part
       UNION ALL SELECT lower(p_type) FROM part
       UNION ALL SELECT string_split(p_name, ' ')[1] FROM part
       UNION ALL SELECT p_name || ' deluxe' FROM part
       UNION ALL SELECT substr(p_name, 1, 2) || substr(p_name, 4, 1000) FROM part
       UNION ALL SELECT c_mktsegment FROM customer),
q AS (SELECT DISTINCT {NORM('t')} AS q FROM tx WHERE {NORM('t')} <> '')
"""
_BASE = f"WITH {_PD}, {_PT}, {_TX}"


def exact_sql(qset: str, terms: str = "pt") -> str:
    return f"""SELECT q, arg_min(row_ord, struct_pack(a := col_rank, b := row_ord)) AS row_ord,
                      arg_min(col_rank, struct_pack(a := col_rank, b := row_ord)) AS col_rank
               FROM {qset} JOIN {terms} ON {qset}.q = {terms}.term GROUP BY q"""


def keyword_sql(qset: str, terms: str = "pt") -> str:
    return f"""SELECT q, arg_min(row_ord, o) AS row_ord, arg_min(col_rank, o) AS col_rank, arg_min(dir, o) AS dir
               FROM (SELECT q, row_ord, col_rank, dir, struct_pack(a := col_rank, b := dir, c := row_ord) AS o
                     FROM (SELECT q, row_ord, col_rank, 0 AS dir FROM {qset} JOIN {terms} ON instr(term, q) > 0
                           UNION ALL
                           SELECT q, row_ord, col_rank, 1 AS dir FROM {qset} JOIN {terms} ON instr(q, term) > 0))
               GROUP BY q"""


def _sorted(x: str) -> str:
    return f"array_to_string(list_sort(list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')), ' ')"


def fuzzy_sql(qset: str, terms: str = "pt", t: float = 80.0) -> str:
    def score(a: str, b: str) -> str:
        return f"(100.0 * (1.0 - levenshtein({a}, {b}) / greatest(length({a}), length({b}))))"

    def band(a: str, b: str) -> str:
        return f"length({a}) BETWEEN greatest(ceil(length({b}) * {t} / 100.0), 1) AND floor(length({b}) * 100.0 / {t})"

    return f"""SELECT q, arg_min(row_ord, o) AS row_ord, arg_min(col_rank, o) AS col_rank,
                      arg_min(score, o) AS score
               FROM (SELECT q, row_ord, col_rank, score, struct_pack(a := -score, b := col_rank, c := row_ord) AS o
                     FROM (SELECT q, row_ord, col_rank, greatest({score('q', 'term')}, 0.95 * {score('sq', 'st')}) AS score
                           FROM (SELECT q, {_sorted('q')} AS sq FROM {qset} WHERE length(q) <= (SELECT max(length(term)) * 2 FROM {terms}))
                           JOIN (SELECT *, {_sorted('term')} AS st FROM {terms}) ON {band('q', 'term')} OR {band('sq', 'st')})
                     WHERE score >= {t})
               GROUP BY q"""


def scan_sql(qset: str, terms: str) -> str:
    nxt = "substr(q, instr(q, term) + 1, 1)"
    ok = f"(tlen > 1 OR {nxt} = '' OR NOT regexp_matches({nxt}, '^[\\pL\\pN]'))"
    return f"""SELECT q, arg_min(row_ord, o) AS row_ord, arg_min(col_rank, o) AS col_rank, arg_min(tlen, o) AS tlen
               FROM (SELECT q, row_ord, col_rank, tlen, struct_pack(a := -tlen, b := col_rank, c := row_ord) AS o
                     FROM {qset} JOIN {terms} ON instr(q, term) > 0 WHERE {ok})
               GROUP BY q"""


ORACLE["exact_match"] = f"{_BASE} {exact_sql('q')}"
ORACLE["keyword_match"] = f"{_BASE} {keyword_sql('q')}"
ORACLE["fuzzy_top1"] = f"""{_BASE}, f AS ({fuzzy_sql('q')})
SELECT q, row_ord, col_rank, round(score, 4) AS score FROM f"""

ORACLE["cascade_product"] = f"""{_BASE},
e AS ({exact_sql('q')}),
q2 AS (SELECT q FROM q WHERE q NOT IN (SELECT q FROM e)),
k AS ({keyword_sql('q2')}),
q3 AS (SELECT q FROM q2 WHERE q NOT IN (SELECT q FROM k)),
f AS ({fuzzy_sql('q3')})
SELECT q, row_ord, 'exact' AS stage FROM e
UNION ALL SELECT q, row_ord, 'keyword' FROM k
UNION ALL SELECT q, row_ord, 'fuzzy' FROM f"""

ORACLE["cascade_hazard"] = f"""WITH {_PD}, {_PT}, {_TX},
qa AS (SELECT q FROM q UNION SELECT {NORM("p_name || ' was found in the shipment container'")} FROM part),
ql AS (SELECT q FROM qa WHERE length(q) > 30),
qs AS (SELECT q FROM qa WHERE length(q) <= 30),
ls AS ({scan_sql('ql', 'pt')}),
l2 AS (SELECT q FROM ql WHERE q NOT IN (SELECT q FROM ls)),
le AS ({exact_sql('l2')}),
l3 AS (SELECT q FROM l2 WHERE q NOT IN (SELECT q FROM le)),
lk AS ({keyword_sql('l3')}),
se AS ({exact_sql('qs')}),
s2 AS (SELECT q FROM qs WHERE q NOT IN (SELECT q FROM se)),
sk AS ({keyword_sql('s2')}),
s3 AS (SELECT q FROM s2 WHERE q NOT IN (SELECT q FROM sk)),
sf AS ({fuzzy_sql('s3')}),
m AS (SELECT q, row_ord, 'scan' AS stage FROM ls UNION ALL SELECT q, row_ord, 'exact' FROM le
      UNION ALL SELECT q, row_ord, 'keyword' FROM lk UNION ALL SELECT q, row_ord, 'exact' FROM se
      UNION ALL SELECT q, row_ord, 'keyword' FROM sk UNION ALL SELECT q, row_ord, 'fuzzy' FROM sf)
SELECT qa.q, m.stage, COALESCE(pd.M_KOR_NM, qa.q) AS class_m, pd.L_KOR_NM AS class_l,
       COALESCE(pd.ANALYZABLE, false) AS analyzable, COALESCE(pd.INTEREST_ITEM, false) AS interest
FROM qa LEFT JOIN m ON qa.q = m.q LEFT JOIN pd ON m.row_ord = pd.row_ord"""

_HD = """
hw AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
hg AS (SELECT item_id, w, unnest(range(0, (len(w) - 1) // 5 + 1)) AS g FROM hw),
hd AS (SELECT concat_ws(' ', w[5 * g + 1], w[5 * g + 2]) AS KOR_NM, w[5 * g + 3] AS ENG_NM,
              substr(w[5 * g + 4], 1, 1) AS ABRV, CAST(NULL AS VARCHAR) AS NCKNM, w[5 * g + 5] AS TESTITM_NM,
              item_id * 1000 + g AS row_ord
       FROM hg)
"""
_HT = f"""
ht0 AS (SELECT {NORM('KOR_NM')} AS term, 0 AS col_rank, row_ord FROM hd WHERE KOR_NM IS NOT NULL
        UNION ALL SELECT {NORM('ENG_NM')}, 1, row_ord FROM hd WHERE ENG_NM IS NOT NULL
        UNION ALL SELECT {NORM('ABRV')}, 2, row_ord FROM hd WHERE ABRV IS NOT NULL
        UNION ALL SELECT {NORM('NCKNM')}, 3, row_ord FROM hd WHERE NCKNM IS NOT NULL
        UNION ALL SELECT {NORM('TESTITM_NM')}, 4, row_ord FROM hd WHERE TESTITM_NM IS NOT NULL),
ht AS (SELECT term, col_rank, row_ord, CAST(length(term) AS INTEGER) AS tlen FROM ht0 WHERE length(term) >= 1)
"""
ORACLE["sentence_scan"] = f"""WITH {_HD}, {_HT},
dq AS (SELECT doc_id, {NORM('text')} AS q FROM documents),
q AS (SELECT DISTINCT q FROM dq WHERE q <> ''),
m AS ({scan_sql('q', 'ht')})
SELECT dq.doc_id, m.row_ord, m.col_rank, m.tlen FROM dq LEFT JOIN m ON dq.q = m.q"""

ORACLE["hazard_extract"] = f"""WITH {_HD}, {_HT},
dq AS (SELECT doc_id, {NORM('text')} AS q FROM documents),
q AS (SELECT DISTINCT q FROM dq WHERE q <> ''),
s AS ({scan_sql('q', 'ht')}),
q2 AS (SELECT q FROM q WHERE q NOT IN (SELECT q FROM s)),
f AS ({fuzzy_sql('q2', 'ht')}),
m AS (SELECT q, row_ord, 'scan' AS stage FROM s UNION ALL SELECT q, row_ord, 'fuzzy' FROM f)
SELECT dq.doc_id, m.stage, COALESCE(hd.KOR_NM, hd.ENG_NM, hd.TESTITM_NM) AS hazard
FROM dq LEFT JOIN m ON dq.q = m.q LEFT JOIN hd ON m.row_ord = hd.row_ord"""

ORACLE["rule_scan"] = f"""
WITH {_HD},
r AS (SELECT lower(ENG_NM) AS keyword, CASE WHEN lower(ENG_NM) < 'm' THEN 'ALL' ELSE 'src3' END AS scope,
             row_ord AS rule_ord FROM hd WHERE length(ENG_NM) >= 2)
SELECT d.doc_id, arg_min(r.rule_ord, struct_pack(a := -length(r.keyword), b := r.rule_ord)) AS rule_ord
FROM documents d JOIN r ON (r.scope = 'ALL' OR r.scope = d.source) AND instr(lower(d.text), r.keyword) > 0
GROUP BY d.doc_id
"""

_WD = """
wd0 AS (SELECT item_id, unnest(string_split(text, ' ')) AS w,
               generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM benchmark),
wd AS (SELECT upper(regexp_replace(lower(w), '[^a-z]', '', 'g')) AS KOR_NM,
              regexp_replace(lower(w), '[^a-z]', '', 'g') AS ENG_NM, item_id * 1000 + pos AS row_ord
       FROM wd0 WHERE regexp_replace(lower(w), '[^a-z]', '', 'g') <> ''),
ti AS (SELECT doc_id, text AS title FROM documents)
"""
ORACLE["dict_override"] = f"""WITH {_WD},
t AS (SELECT ENG_NM AS term, row_ord, length(ENG_NM) AS tlen FROM wd WHERE length(ENG_NM) >= 3),
tq AS (SELECT doc_id, lower(regexp_replace(title, '(?i)^(is|the|and|of|a)\\s+', '')) AS q FROM ti),
q AS (SELECT DISTINCT q FROM tq WHERE q <> ''),
m AS (SELECT q, arg_min(row_ord, struct_pack(a := -tlen, b := row_ord)) AS row_ord
      FROM q JOIN t ON instr(q, term) > 0 GROUP BY q)
SELECT tq.doc_id, COALESCE(wd.KOR_NM, wd.ENG_NM) AS name FROM tq JOIN m ON tq.q = m.q JOIN wd ON m.row_ord = wd.row_ord
"""
ORACLE["word_override"] = f"""WITH {_WD},
t AS (SELECT ENG_NM AS term, row_ord, length(ENG_NM) AS tlen FROM wd WHERE length(ENG_NM) >= 4),
tq AS (SELECT doc_id, lower(title) AS q FROM ti),
q AS (SELECT DISTINCT q FROM tq WHERE q <> ''),
k AS (SELECT DISTINCT q, unnest(string_split_regex(q, '[^\\pL\\pN_]+')) AS tok FROM q),
m AS (SELECT q, arg_min(row_ord, struct_pack(a := -tlen, b := row_ord)) AS row_ord
      FROM k JOIN t ON k.tok = t.term GROUP BY q)
SELECT tq.doc_id, wd.KOR_NM AS name FROM tq JOIN m ON tq.q = m.q JOIN wd ON m.row_ord = wd.row_ord
"""


def _toks(x: str) -> str:
    return f"list_distinct(string_split_regex({x}, '\\s+'))"


ORACLE["suggest"] = f"""
WITH cats AS (SELECT concat_ws(' ', string_split(p_name, ' ')[2], string_split(p_name, ' ')[1]) AS cat,
                     min(p_partkey) AS cat_ord FROM part GROUP BY 1),
names AS (SELECT p_name AS name FROM part
          UNION ALL SELECT concat_ws(' ', string_split(p_name, ' ')[2], string_split(p_name, ' ')[1]) FROM part
          UNION ALL SELECT c_mktsegment FROM customer),
q AS (SELECT DISTINCT lower(regexp_replace(name, '^\\s+|\\s+$', '', 'g')) AS q FROM names
      WHERE length(lower(regexp_replace(name, '^\\s+|\\s+$', '', 'g'))) >= 2),
c AS (SELECT lower(cat) AS term, cat_ord AS row_ord, length(lower(cat)) AS tlen FROM cats WHERE length(lower(cat)) >= 2),
sub AS (SELECT q, arg_min(row_ord, struct_pack(d := abs(length(q) - tlen), o := row_ord)) AS row_ord
        FROM q JOIN c ON instr(q, term) > 0 OR instr(term, q) > 0 GROUP BY q),
tq AS (SELECT q, unnest({_toks('q')}) AS a, len({_toks('q')}) AS nq FROM q WHERE q NOT IN (SELECT q FROM sub)),
tc AS (SELECT term, row_ord, unnest({_toks('term')}) AS b, len({_toks('term')}) AS nt FROM c),
ab AS (SELECT a, b FROM (SELECT DISTINCT a FROM tq) JOIN (SELECT DISTINCT b FROM tc)
       ON a <> '' AND b <> '' AND 100.0 * (1.0 - levenshtein(a, b) / greatest(length(a), length(b))) >= 80),
ts AS (SELECT q, row_ord, round(100.0 * least(count(DISTINCT tq.a), count(DISTINCT tc.b)) / greatest(nq, nt), 2) AS score
       FROM tq JOIN ab ON tq.a = ab.a JOIN tc ON tc.b = ab.b GROUP BY q, term, row_ord, nq, nt),
tok AS (SELECT q, arg_min(row_ord, struct_pack(s := -score, o := row_ord)) AS row_ord FROM ts WHERE score > 60
        GROUP BY q)
SELECT q, row_ord AS cat_ord, 'substring' AS how FROM sub
UNION ALL SELECT q, row_ord, 'token' FROM tok
"""

ORACLE["term_coverage"] = """
WITH t AS (SELECT DISTINCT term FROM (
             SELECT unnest(string_split(p_name, ' ')) AS term FROM part
             UNION ALL SELECT lower(p_type) FROM part UNION ALL SELECT lower(r_name) FROM region)
           WHERE length(lower(term)) > 0),
n AS (SELECT DISTINCT p_name AS name FROM part WHERE p_name IS NOT NULL),
p AS (SELECT t.term, n.name FROM t JOIN n ON instr(lower(n.name), lower(t.term)) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY length(name), name) AS rk FROM p),
a AS (SELECT term, bool_or(lower(name) = lower(term)) AS has_exact, count(*) AS n_names,
             string_agg(CASE WHEN rk <= 10 THEN name END, '|' ORDER BY length(name), name) AS examples
      FROM r GROUP BY term)
SELECT t.term, CASE WHEN a.has_exact THEN 'exact' WHEN a.n_names > 0 THEN 'partial' ELSE 'none' END AS coverage,
       COALESCE(a.n_names, 0) AS n_names, COALESCE(a.examples, '') AS examples
FROM t LEFT JOIN a ON t.term = a.term
"""

ORACLE["normalize_text"] = f"""
SELECT p_partkey, {NORM("' ' || chr(9) || upper(p_name) || chr(10) || ' '")} AS norm,
       {NORM("CASE WHEN p_type = 'PROMO' THEN NULL ELSE p_type END")} AS norm_type
FROM part
"""
