"""Query catalogue: each operator family exercised on the driver tables.

Every query reads whole tables (no id subsets, no row caps; the only limits
are top-k reports) and returns a DataFrame whose column names match the
DuckDB oracle SQL in ``vigil.plans.oracle``.  Gaps that the driver tables do
not have (nulls, unknown codes, typos) are planted by rules on content.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.functions import text as X
from vigil.operators import audit as A
from vigil.operators import flags as FL
from vigil.operators import lookup as L
from vigil.operators import merge as M
from vigil.operators import metrics as Q
from vigil.schema import enforce_schema, rename_columns


def T(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ===================================================================== dashboard

@query
def top_origin(spark, sf):
    """F1 + F2 + A3 + L2: top-10 customer nations of orders in a status set
    and date range."""
    o = T(spark, sf, "orders")
    o = Q.filter_in(o, "o_orderstatus", ["F", "O"])
    o = Q.filter_date_range(o, F.col("o_orderdate"), "1995-01-01", "1996-12-31")
    c = T(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = T(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("origin_country"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, F.col("c_nationkey") == n.n_nationkey)
    return Q.top_k(j, "origin_country", 10)


@query
def dash_filter(spark, sf):
    """F1 + F2: IN-list and inclusive date range."""
    e = T(spark, sf, "events")
    e = Q.filter_in(e, "event_type", ["click", "purchase"])
    e = Q.filter_date_range(e, F.col("ts"), "2024-01-05", "2024-01-20")
    return e.select("event_id", "user_id", "event_type", "value")


@query
def daily_trend(spark, sf):
    """A5: events per day."""
    return Q.daily_counts(T(spark, sf, "events"), F.to_date("ts"))


@query
def dash_metrics(spark, sf):
    """A1 + A2 + A4 + A7: total, regex keyword count, top user, date range."""
    e = T(spark, sf, "events")
    return Q.dash_metrics(e, "event_type", "user_id", F.to_date("ts"), keywords=["purch", "e.ror"])


@query
def class_share(spark, sf):
    """Share of parts per type."""
    return Q.class_share(T(spark, sf, "part"), "p_type")


@query
def facets(spark, sf):
    """F6 + F7 + A8: cascading facets, then distinct sorted brands."""
    p = T(spark, sf, "part")
    p = Q.facet_filter(p, [("p_type", "SMALL"), ("p_size", list(range(1, 21))), ("p_brand", Q.ALL)])
    return Q.facet_values(p, "p_brand")


@query
def recent_days(spark, sf):
    """orders within 30 days before a fixed as-of date."""
    o = T(spark, sf, "orders")
    o = Q.filter_recent(o, F.col("o_orderdate"), 30, "1998-08-02")  # raw column: the bound reaches the scan
    return o.select("o_orderkey", F.to_date("o_orderdate").alias("order_date"))


@query
def col_search(spark, sf):
    """one-column case-insensitive regex search."""
    return Q.filter_regex(T(spark, sf, "part"), "p_name", "RED|ring$").select("p_partkey", "p_name")


@query
def any_search(spark, sf):
    """any-column case-insensitive regex search."""
    c = T(spark, sf, "customer")
    return Q.filter_any_regex(c, "machin|#0000000[1-3]").select("c_custkey")


# ===================================================================== schema

def _events_as_notices(spark, sf):
    e = T(spark, sf, "events")
    return e.select(
        F.col("ts").alias("registration_date"),
        F.col("event_type").alias("data_source"),
        F.concat(F.lit("EV-"), F.col("event_id")).alias("source_detail"),
        F.col("props").alias("product_name"),
        F.when(F.col("event_type") == "error", F.col("props")).alias("hazard_item"),
        (F.col("value") > 50).alias("analyzable"),
        F.col("user_id"),
    )


@query
def schema_enforce(spark, sf):
    """P1 + S1: events mapped to the 15 columns, some absent, one extra."""
    return enforce_schema(_events_as_notices(spark, sf))


@query
def schema_check(spark, sf):
    """A12 + U6: schema conformance and filled rows of every column of the mapped events before enforcement."""
    return A.audit_schema(_events_as_notices(spark, sf))


@query
def export_view(spark, sf):
    """S12 + S13 + P3 + P4: display projection with Korean headers."""
    o = T(spark, sf, "orders")
    v = o.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("registration_date"),
        X.replace_literals(F.col("o_orderstatus"), [("F", "Finished"), ("O", "Open"), ("P", "Pending")])
        .alias("data_source"),
        X.strip_id_suffix(F.concat_ws("-", F.col("o_orderpriority"), F.col("o_orderkey"))).alias("source_detail"),
        F.col("o_orderkey"),
    )
    from vigil.schema import DISPLAY_HEADERS, select_columns
    v = select_columns(v, wanted=["registration_date", "data_source", "source_detail", "not_there"],
                       always_keep=["o_orderkey"])
    return rename_columns(v, DISPLAY_HEADERS)


# ===================================================================== merges

def _orders_as_notices(o):
    return enforce_schema(o.select(
        F.col("o_orderdate").alias("registration_date"),
        F.col("o_orderstatus").alias("data_source"),
        F.concat(F.lit("ORD-"), F.col("o_custkey")).alias("source_detail"),
        F.col("o_orderpriority").alias("product_type"),
        F.col("o_orderkey").cast("string").alias("full_text"),
    ))


@query
def hub_append(spark, sf):
    """J1 + U2: incoming notices whose (source, detail, date) key is new."""
    o = T(spark, sf, "orders")
    hub = _orders_as_notices(o.where(F.col("o_orderdate") < F.lit("1996-01-01").cast("timestamp_ntz")))
    inc = _orders_as_notices(o.where(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz")))
    return M.hub_append(inc, hub)


@query
def hash_dedup(spark, sf):
    """J2 + S17: existing (English docs) ∪ new docs with an unseen sha256(source::text)."""
    d = T(spark, sf, "documents").select("doc_id", "source", "text", "lang")
    out = M.hash_dedup(d.drop("lang"), d.where(F.col("lang") == "en").drop("lang"), "source", "text")
    return out.select("doc_id", "record_id")


@query
def first_per_key(spark, sf):
    """First document per text."""
    d = T(spark, sf, "documents").select("text", "doc_id", "lang", "source")
    return M.first_per_key(d, ["text"], "doc_id").select("doc_id", "lang", "source")


@query
def last_per_key(spark, sf):
    """Last document per text."""
    d = T(spark, sf, "documents").select("text", "doc_id", "lang", "source")
    return M.last_per_key(d, ["text"], "doc_id").select("doc_id", "lang", "source")


@query
def row_distinct(spark, sf):
    """Whole-row duplicates removed."""
    return M.row_distinct(T(spark, sf, "documents").select("text", "lang"))


@query
def pinned_merge(spark, sf):
    """J7 + P2: supplier master refresh keeping manually pinned rows."""
    s = T(spark, sf, "supplier")
    cur = s.withColumn("IS_MANUAL_FIXED", F.col("s_acctbal") < 0)
    new = s.select("s_suppkey", F.upper(F.col("s_name")).alias("s_name"), "s_nationkey",
                   (F.col("s_acctbal") + 1).alias("s_acctbal"))
    out = M.pinned_merge(new, cur, "s_suppkey")
    from vigil.schema import ensure_columns
    out = ensure_columns(out, {"IS_MANUAL_FIXED": False})
    return out.select("s_suppkey", "s_name", "s_acctbal", F.coalesce("IS_MANUAL_FIXED", F.lit(False))
                      .alias("IS_MANUAL_FIXED"))


@query
def change_detect(spark, sf):
    """J8 + T2: alert index snapshot comparison."""
    o = T(spark, sf, "orders")
    old = o.where(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz")).select(
        "o_orderkey", F.to_date("o_orderdate").alias("pub_date"),
        (F.col("o_orderpriority") != "5-LOW").alias("IsCollect"))
    new = o.select("o_orderkey",
                   F.when(F.col("o_orderstatus") == "P", F.date_add(F.to_date("o_orderdate"), 1))
                   .otherwise(F.to_date("o_orderdate")).alias("pub_date"),
                   F.lit(True).alias("IsCollect"))
    return M.change_detect(new, old, "o_orderkey", "pub_date", ["IsCollect"])


def _customer_patch(spark, sf):
    c = T(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment")
    p = c.where(F.col("c_mktsegment") == "BUILDING").select(
        "c_custkey",
        F.when(F.col("c_acctbal") < 0, F.lit(None)).otherwise(F.col("c_acctbal") + 100).alias("c_acctbal"),
        F.when(F.col("c_acctbal") > 5000, F.upper(F.col("c_name"))).alias("c_name"),
    )
    return c, p


@query
def patch_non_null(spark, sf):
    """Non-null patch values win."""
    c, p = _customer_patch(spark, sf)
    return M.patch_non_null(c, p, "c_custkey")


@query
def patch_all(spark, sf):
    """J10 + S18 + S19: all patch values win for listed columns; changed flag."""
    c, p = _customer_patch(spark, sf)
    p = p.withColumn("c_name", X.clean_cell(F.coalesce(F.col("c_name"), F.lit("none"))))
    return M.patch_all(c, p, "c_custkey", ["c_acctbal", "c_name"], changed_col="changed")


@query
def snapshot_diff(spark, sf):
    """Differences between the base and the patched copy."""
    c, p = _customer_patch(spark, sf)
    patched = M.patch_all(c, p, "c_custkey", ["c_acctbal", "c_name"], changed_col=None)
    patched = patched.where(F.col("c_mktsegment") != "FURNITURE")
    out = M.snapshot_diff(c, patched, "c_custkey", ["c_name", "c_acctbal", "c_mktsegment"])
    return out.select("c_custkey", "side", F.array_join("changed", ",").alias("changed"))


@query
def crud_merge(spark, sf):
    """U4 + U5 + J17: delete / update / insert change table on the supplier master."""
    s = T(spark, sf, "supplier").select("s_suppkey", "s_name", "s_nationkey") \
        .withColumn("IS_MANUAL_FIXED", F.lit(False))
    n = T(spark, sf, "nation")
    ch = s.where(F.col("s_nationkey") <= 1).select(
        "s_suppkey", F.when(F.col("s_nationkey") == 0, "delete").otherwise("update").alias("op"),
        F.lower("s_name").alias("s_name"), "s_nationkey", F.lit(False).alias("pin_edited"))
    ins = n.select((F.col("n_nationkey") + 1000000).cast("long").alias("s_suppkey"), F.lit("insert").alias("op"),
                   F.col("n_name").alias("s_name"), F.col("n_nationkey").alias("s_nationkey"),
                   F.lit(False).alias("pin_edited"))
    return M.crud_merge(s, ch.unionByName(ins), "s_suppkey", ["s_name", "s_nationkey"])


@query
def union_sources(spark, sf):
    """Per-source tables unioned by name, then schema enforcement."""
    c = T(spark, sf, "customer").select(F.lit("CUST").alias("data_source"),
                                        F.concat(F.lit("C-"), F.col("c_custkey")).alias("source_detail"),
                                        F.col("c_name").alias("product_name"),
                                        F.col("c_mktsegment").alias("product_type"))
    s = T(spark, sf, "supplier").select(F.lit("SUPP").alias("data_source"),
                                        F.concat(F.lit("S-"), F.col("s_suppkey")).alias("source_detail"),
                                        F.col("s_name").alias("product_name"))
    return enforce_schema(M.union_sources([c, s]))


@query
def dict_union(spark, sf):
    """U3 + W1 + L6: two dictionaries on common columns, first per name, sorted."""
    p = T(spark, sf, "part").select(F.col("p_name").alias("name"), F.col("p_partkey").alias("ord"),
                                    F.col("p_type").alias("grp"), F.col("p_size").alias("only_p"))
    n = T(spark, sf, "nation").select(F.lower(F.col("n_name")).alias("name"),
                                      (F.col("n_nationkey") + 100000).cast("long").alias("ord"),
                                      F.lit("NATION").alias("grp"))
    return M.dict_union(p, n, "name", "ord")


# ===================================================================== lookups

@query
def code_name(spark, sf):
    """Customer nation code -> name; unknown codes fall back to the code."""
    c = T(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = T(spark, sf, "nation").where(~F.col("n_name").endswith("1"))
    return L.code_to_name(c, "c_nationkey", n, "n_nationkey", "n_name", "n_nationkey", "nation_name") \
        .select("c_custkey", "nation_name")


@query
def spec_enrich(spark, sf):
    """Line items enriched with part and supplier names; fallback to code."""
    li = T(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    p = T(spark, sf, "part").where(F.col("p_type") != "PROMO")
    s = T(spark, sf, "supplier")
    out = L.code_to_name(li, "l_partkey", p, "p_partkey", "p_name", "p_partkey", "part_name")
    out = L.code_to_name(out, "l_suppkey", s, "s_suppkey", "s_name", "s_suppkey", "supp_name")
    return out.select("l_orderkey", "l_linenumber", "part_name", "supp_name")


@query
def name_join(spark, sf):
    """J6 + W1: each part joined to the first part row carrying its name."""
    p = T(spark, sf, "part")
    d = p.select(F.col("p_name").alias("nm"), F.col("p_partkey").alias("canon_key"),
                 F.col("p_brand").alias("canon_brand"))
    out = L.first_row_join(p.select("p_partkey", "p_name"), "p_name", d, "nm", "canon_key",
                           ["canon_key", "canon_brand"])
    return out.select("p_partkey", "canon_key", "canon_brand")


def _code_tree(spark, sf):
    r = T(spark, sf, "region")
    n = T(spark, sf, "nation")
    c = T(spark, sf, "customer")
    regions = r.select(F.concat(F.lit("R"), F.col("r_regionkey")).alias("PRDLST_CD"),
                       F.lit(None).cast("string").alias("HRNK_PRDLST_CD"),
                       F.lit(None).cast("string").alias("HTRK_PRDLST_CD"),
                       F.col("r_name").alias("KOR_NM"), F.lower("r_name").alias("ENG_NM"),
                       F.col("r_regionkey").cast("long").alias("row_ord"))
    nations = n.select(F.concat(F.lit("N"), F.col("n_nationkey")).alias("PRDLST_CD"),
                       F.concat(F.lit("R"), F.col("n_regionkey")).alias("HRNK_PRDLST_CD"),
                       F.concat(F.lit("R"), F.col("n_regionkey")).alias("HTRK_PRDLST_CD"),
                       F.when(~F.col("n_name").endswith("3"), F.col("n_name")).alias("KOR_NM"),
                       F.lower("n_name").alias("ENG_NM"),
                       (F.col("n_nationkey") + 100).cast("long").alias("row_ord"))
    custs = c.join(n, c.c_nationkey == n.n_nationkey).select(
        F.concat(F.lit("C"), F.col("c_custkey")).alias("PRDLST_CD"),
        F.concat(F.lit("N"), F.col("c_nationkey")).alias("HRNK_PRDLST_CD"),
        F.concat(F.lit("R"), F.col("n_regionkey")).alias("HTRK_PRDLST_CD"),
        F.col("c_name").alias("KOR_NM"), F.col("c_mktsegment").alias("ENG_NM"),
        (F.col("c_custkey") + 1000).cast("long").alias("row_ord"))
    return regions.unionByName(nations).unionByName(custs)


@query
def hierarchy(spark, sf):
    """J4 + J12 + L1: every code's top and parent names through the code tree."""
    tree = _code_tree(spark, sf)
    out = L.hierarchy_names(tree, "HTRK_PRDLST_CD", "HRNK_PRDLST_CD", tree, "PRDLST_CD", "KOR_NM", "ENG_NM",
                            "row_ord", top_fallback=["ENG_NM"], parent_fallback=[])
    return out.select(F.col("PRDLST_CD").alias("code"), "top_name", "parent_name") \
        .orderBy("top_name", "parent_name", "code")


@query
def bidi_fill(spark, sf):
    """(code, name) pairs with holes filled from the nation dictionary."""
    c = T(spark, sf, "customer")
    n = T(spark, sf, "nation")
    rows = c.join(n, c.c_nationkey == n.n_nationkey).select(
        "c_custkey",
        F.when(F.col("c_mktsegment") != "AUTOMOBILE", F.col("c_nationkey")).alias("code"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("n_name")).alias("name"))
    return L.bidi_fill(rows, "code", "name", n, "n_nationkey", "n_name", "n_nationkey")


@query
def priority_type(spark, sf):
    """J13 + S7: product type by code map, then manual value, then fallback."""
    p = T(spark, sf, "part")
    cmap = p.where(F.col("p_size") <= 20).select("p_size", F.col("p_type").alias("type_name"), F.col("p_partkey").alias("ord"))
    rows = p.select("p_partkey", F.col("p_size").cast("string").alias("industry"),
                    F.when(F.col("p_retailprice") > 1500, F.col("p_brand")).otherwise(F.lit(" ")).alias("manual"))
    out = L.priority_type(rows, "industry", "manual", cmap, "p_size", "type_name", "ord")
    return out.select("p_partkey", "product_type")


def _countries(spark, sf):
    n = T(spark, sf, "nation")
    r = T(spark, sf, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(
        F.col("n_name").alias("en"), F.concat(F.col("r_name"), F.lit("_"), F.col("n_nationkey")).alias("ko"),
        F.col("n_nationkey").alias("ord"))


@query
def country_norm(spark, sf):
    """Raw country -> English name by English or Korean name, else raw."""
    c = T(spark, sf, "customer")
    n = T(spark, sf, "nation")
    r = T(spark, sf, "region")
    raw = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        "c_custkey",
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.lower("n_name"))
        .when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit(" "), F.col("r_name"), F.lit("_"),
                                                              F.col("n_nationkey"), F.lit(" ")))
        .when(F.col("c_mktsegment") == "BUILDING", F.lit("Atlantis"))
        .otherwise(F.col("n_name")).alias("raw"))
    out = L.country_standardize(raw, "raw", _countries(spark, sf), "en", "ko", "ord")
    return out.select("c_custkey", "country")


@query
def country_prefix(spark, sf):
    """English name by Korean name: exact, else the first sharing the first
    two characters (or the only one), else raw / default."""
    c = T(spark, sf, "customer")
    n = T(spark, sf, "nation")
    r = T(spark, sf, "region")
    raw = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        "c_custkey",
        F.when(F.col("c_mktsegment") == "HOUSEHOLD", F.concat(F.col("r_name"), F.lit("_"), F.col("n_nationkey")))
        .when(F.col("c_mktsegment") == "MACHINERY", F.substring("r_name", 1, 3))
        .when(F.col("c_mktsegment") == "FURNITURE", F.substring("r_name", 1, 1))
        .when(F.col("c_mktsegment") == "BUILDING", F.lit(""))
        .otherwise(F.lit("ZZ top")).alias("raw"))
    out = L.country_by_prefix(raw, "raw", _countries(spark, sf), "ko", "en", "ord")
    return out.select("c_custkey", "country")


# ===================================================================== audit

def _doc_notices(spark, sf):
    d = T(spark, sf, "documents")
    lb = T(spark, sf, "labels")
    j = d.join(lb, on="doc_id", how="left")
    return j.select(
        F.col("source").alias("data_source"),
        F.concat(F.lit("D-"), F.col("doc_id")).alias("source_detail"),
        F.col("lang").alias("product_type"),
        F.when(F.col("quality") == 1, F.upper("lang")).alias("top_level_product_type"),
        F.when(F.col("toxic").isNotNull(), F.col("lang")).alias("upper_product_type"),
        F.when(F.col("n_chars") > 500, F.lit("item")).alias("hazard_item"),
        F.when(F.col("toxic") == 1, F.lit("toxic")).when(F.col("toxic") == 0, F.lit("")).alias("hazard_class_m"),
        F.when(F.col("quality") == 0, F.lit("None")).alias("hazard_class_l"),
        (F.col("toxic") == 1).alias("analyzable"),
    )


@query
def audit_missing(spark, sf):
    """A10: missing count / percent / status per unified column."""
    return A.audit_missing(_doc_notices(spark, sf))


@query
def audit_mapping(spark, sf):
    """Raw-present / derived-empty failures per pair."""
    return A.audit_mapping(_doc_notices(spark, sf))


@query
def audit_summary(spark, sf):
    """A9 + A13 + A14: rows, columns, distinct sources, verdict."""
    return A.audit_summary(_doc_notices(spark, sf))


# ===================================================================== funnel and flags

def _alert_index(spark, sf):
    o = T(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        (F.col("o_orderstatus") != "F").alias("Is_New_Or_Updated"),
        F.when(F.col("o_orderpriority") == "5-LOW", F.lit(False))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None)).otherwise(F.lit(True)).alias("IsCollect"),
        (F.col("o_totalprice") > 250000).alias("Has_Red_List"),
        F.when(F.col("o_totalprice") > 100000, F.lit(True)).alias("Has_Yellow_List"),
        (F.col("o_totalprice") <= 100000).alias("Has_Green_List"),
    )


@query
def funnel(spark, sf):
    """F8 + A15: eligibility funnel counters."""
    return Q.funnel_counts(_alert_index(spark, sf), "Is_New_Or_Updated", "IsCollect", "Has_Red_List",
                           "Has_Yellow_List", "Has_Green_List")


@query
def funnel_work(spark, sf):
    """F8 + L4 + P12: the first 25 eligible work items (limit after eligibility)."""
    idx = Q.with_defaults_projection(_alert_index(spark, sf), {"IsCollect": True, "Has_Red_List": False})
    return Q.eligible(idx, "Is_New_Or_Updated", "IsCollect", "Has_Red_List", "Has_Yellow_List",
                      limit=25, order_col="o_orderkey").select("o_orderkey")


@query
def flag_rules(spark, sf):
    """F9 + F10 + P11 + S22: composite-key range rule and green-only rule turn
    the collect flag off; overrides are cleared where the flag is off."""
    p = T(spark, sf, "part")
    rows = p.select("p_partkey",
                    F.concat(F.col("p_size").cast("string"), F.lit("-"), F.length("p_name").cast("string"))
                    .alias("alert_no"), F.col("p_type"), F.col("p_brand"))
    rows = rows.select("p_partkey", "alert_no",
                       (F.col("p_type") == "PROMO").alias("green"), (F.col("p_type") == "LARGE").alias("red"),
                       F.lit(False).alias("yellow"),
                       F.col("p_brand").alias("Manual_Hazard_Item"), F.col("p_type").alias("Manual_Product_Type"))
    off = FL.in_key_range(F.col("alert_no"), (10, 5), (20, 9)) | FL.green_only(F.col("green"), F.col("red"), F.col("yellow"))
    out = FL.clear_where_off(rows.withColumn("IsCollect", ~off), "IsCollect", ["Manual_Hazard_Item", "Manual_Product_Type"])
    return out.select("p_partkey", "alert_no", "IsCollect", "Manual_Hazard_Item", "Manual_Product_Type")


@query
def seq_codes(spark, sf):
    """Consecutive codes Z-1, Z-2, ... of wide rows in the order of a key that is spread over the file."""
    from vigil.operators.order import sequential_ids
    o = T(spark, sf, "orders").withColumn("row_key", F.reverse(F.lpad(F.col("o_orderkey").cast("string"), 12, "0")))
    return sequential_ids(o, "row_key", "seq").select("o_orderkey", "o_totalprice", F.concat(F.lit("Z-"), F.col("seq")).alias("code"))
