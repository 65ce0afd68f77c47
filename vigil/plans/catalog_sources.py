"""Query catalogue, part 4: the per-source mappers end to end on raw rows
derived from the driver tables (P5-P10), with reference dictionaries also
derived from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions import text as X
from vigil.operators import segment as S
from vigil.plans.catalog import T, _code_tree, _countries, query
from vigil.plans.catalog_match import hazard_dict, rules
from vigil.sources import mappers as MP


def references(spark, sf) -> MP.References:
    tree = _code_tree(spark, sf)
    h = hazard_dict(spark, sf)
    hz = h.select("*",
                  F.upper(F.substring("ENG_NM", 1, 1)).alias("M_KOR_NM"),
                  F.concat(F.lit("L"), F.length("ENG_NM")).alias("L_KOR_NM"),
                  (F.length("KOR_NM") > 10).alias("ANALYZABLE"),
                  (F.col("ENG_NM") < "m").alias("INTEREST_ITEM"))
    r = rules(spark, sf)
    rl = r.select("*", F.when(F.col("keyword") < "m", F.lit("RULE-M")).alias("M_KOR_NM"),
                  F.when(F.col("keyword") < "m", F.lit("RULE-L")).alias("L_KOR_NM"))
    return MP.References(products=tree, hazards=hz, rules=rl, countries=_countries(spark, sf))


def _customer_orders(spark, sf):
    o = T(spark, sf, "orders")
    c = T(spark, sf, "customer")
    n = T(spark, sf, "nation")
    return o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)


@query
def map_i2620(spark, sf):
    """P5: domestic non-conformance rows from orders: product type = the
    customer's nation (a dictionary name) or segment, hazard item = priority."""
    j = _customer_orders(spark, sf)
    raw = j.select(F.date_format("o_orderdate", "yyyy.MM.dd").alias("CRET_DTM"), F.col("c_name").alias("PRDTNM"),
                   F.when(F.col("o_orderstatus") == "F", F.col("c_mktsegment")).otherwise(F.col("n_name"))
                   .alias("PRDLST_CD_NM"),
                   F.col("o_orderpriority").alias("TEST_ITMNM"), F.col("o_orderkey").cast("string").alias("RTRVLDSUSE_SEQ"),
                   F.col("o_orderkey").alias("ord"))
    return MP.map_i2620(raw, references(spark, sf), order_col="ord")


def _doc_raw(spark, sf):
    d = T(spark, sf, "documents")
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("n_chars") / 10).cast("int"))
    return d.select("doc_id", "text", "lang", "source", day.alias("day"))


@query
def map_i0490(spark, sf):
    """P6 + M6 + M8 + M11: recalls whose reason is a whole document."""
    d = _doc_raw(spark, sf)
    raw = d.select(F.concat(F.date_format("day", "yyyy-MM-dd"), F.lit(" 10:00:00")).alias("CRET_DTM"),
                   F.concat(F.lit("doc "), F.col("doc_id")).alias("PRDTNM"), F.col("lang").alias("PRDLST_CD_NM"),
                   F.col("text").alias("RTRVLPRVNS"), F.col("doc_id").cast("string").alias("RTRVLDSUSE_SEQ"),
                   F.col("doc_id").alias("ord"))
    return MP.map_i0490(raw, references(spark, sf), order_col="ord", long_texts=True)


@query
def map_i2810(spark, sf):
    """P7 + S4 + S9 + S16: overseas recalls: title = first line, body = text."""
    d = _doc_raw(spark, sf)
    raw = d.select(F.date_format("day", "yyyyMMdd").alias("CRET_DTM"),
                   F.try_element_at(F.split("text", "\n"), F.lit(1)).alias("TITL"),
                   F.col("source").alias("DETECT_TITL"),
                   F.concat(F.lit("-지역: "), F.col("lang"), F.lit(" - "), F.col("text")).alias("BDT"),
                   F.col("doc_id").cast("string").alias("NTCTXT_NO"))
    return MP.map_i2810(raw, references(spark, sf), long_texts=True)


@query
def map_rasff(spark, sf):
    """P8 + S5: listing rows from orders."""
    j = _customer_orders(spark, sf)
    raw = j.select(F.when(F.col("o_orderstatus") == "P", F.lit("not a date"))
                   .otherwise(F.date_format("o_orderdate", "dd/MM/yyyy")).alias("date"),
                   F.col("o_orderkey").cast("string").alias("reference"), F.col("n_name").alias("origin"),
                   F.concat(F.col("o_orderpriority"), F.lit(" in "), F.col("c_name")).alias("subject"),
                   F.col("c_mktsegment").alias("category"))
    return MP.map_rasff(raw)


@query
def map_impfood(spark, sf):
    """P9 + S16: inspection cards from parts."""
    p = T(spark, sf, "part")
    raw = p.select(F.col("p_partkey").cast("string").alias("id"),
                   F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")), "yyyy-MM-dd")
                   .alias("date"),
                   F.col("p_name").alias("name_kr"),
                   F.when(F.col("p_size") > 25, F.col("p_brand")).otherwise(F.lit("")).alias("name_en"),
                   F.col("p_type").alias("product_type"), F.lit("NATION_1").alias("origin"),
                   F.concat(F.col("p_type"), F.lit(" "), F.col("p_name")).alias("reason"))
    return MP.map_impfood(raw, references(spark, sf))


def alert_blocks(spark, sf):
    """Conversations as alert blocks: system = country header, user = product line, short assistant = date line."""
    c = T(spark, sf, "conversations")
    lines = c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"),
                     X.strip_ws(F.col("text")).alias("line"), "role")
    is_date = (F.col("role") == "assistant") & (F.length("line") < 200)
    date_txt = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), F.col("pos").cast("int")), "M/d/yyyy")
    blocks = S.segment_blocks(lines, F.col("role") == "system", F.col("role") == "user", is_date, date_txt)
    return blocks.withColumn("alert_no", F.concat(F.col("doc").cast("string"), F.lit("-"), F.col("block").cast("string")))


@query
def map_fda(spark, sf):
    """P10 + W4 + F12: alert blocks mapped; blocks without a date are dropped."""
    return MP.map_fda(alert_blocks(spark, sf), references(spark, sf), force=True)
