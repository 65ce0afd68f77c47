"""Query catalogue, part 2: dictionary matching (M1-M15) on the driver tables.

Dictionaries are built from the tables themselves: the product dictionary is
``part`` (name and type columns, file order = part key), the hazard
dictionary is cut from ``benchmark`` passages, whose text also appears inside
``documents``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vigil.functions.text import normalize
from vigil.operators import match as MT
from vigil.plans.catalog import T, query


def product_dict(spark, sf):
    p = T(spark, sf, "part")
    return p.select(F.col("p_name").alias("KOR_NM"), F.col("p_type").alias("ENG_NM"),
                    F.col("p_brand").alias("M_KOR_NM"), F.col("p_type").alias("L_KOR_NM"),
                    (F.col("p_size") > 25).alias("ANALYZABLE"), (F.col("p_retailprice") > 1500).alias("INTEREST_ITEM"),
                    F.col("p_partkey").alias("row_ord"))


def product_terms(spark, sf):
    return MT.prepare_terms(product_dict(spark, sf), ["KOR_NM", "ENG_NM"])


def hazard_dict(spark, sf):
    """Every five words of the passages are one dictionary row."""
    b = T(spark, sf, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    g = b.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.expr("(size(w) - 1) div 5").cast("int"))).alias("g"))

    def word(k):
        return F.try_element_at("w", F.col("g") * 5 + k)

    return g.select(F.concat_ws(" ", word(1), word(2)).alias("KOR_NM"), word(3).alias("ENG_NM"),
                    F.substring(word(4), 1, 1).alias("ABRV"), F.lit(None).cast("string").alias("NCKNM"),
                    word(5).alias("TESTITM_NM"), (F.col("item_id") * 1000 + F.col("g")).alias("row_ord"))


def hazard_terms(spark, sf):
    return MT.prepare_terms(hazard_dict(spark, sf), MT.HAZARD_MATCH_COLUMNS)


def _typo(c):
    """A name with its third character removed."""
    return F.concat(F.substring(c, 1, 2), F.substring(c, 4, 1 << 30))


def product_texts(spark, sf):
    p = T(spark, sf, "part")
    c = T(spark, sf, "customer")
    return (p.select(F.concat(F.lit(" "), F.upper("p_name"), F.lit("\t")).alias("t"))
            .unionByName(p.select(F.lower("p_type").alias("t")))
            .unionByName(p.select(F.try_element_at(F.split("p_name", " "), F.lit(1)).alias("t")))
            .unionByName(p.select(F.concat(F.col("p_name"), F.lit(" deluxe")).alias("t")))
            .unionByName(p.select(_typo(F.col("p_name")).alias("t")))
            .unionByName(c.select(F.col("c_mktsegment").alias("t"))))


@query
def exact_match(spark, sf):
    """M1 + M2: normalised equality, first column then file order."""
    q = MT.distinct_queries(product_texts(spark, sf), "t")
    return MT.exact_match(q, product_terms(spark, sf))


@query
def keyword_match(spark, sf):
    """M3: containment in either direction, per column, forward first."""
    q = MT.distinct_queries(product_texts(spark, sf), "t")
    return MT.keyword_match(q, product_terms(spark, sf))


@query
def fuzzy_top1(spark, sf):
    """M5: best similarity >= 80 (length-blocked equi-join)."""
    q = MT.distinct_queries(product_texts(spark, sf), "t")
    out = MT.fuzzy_match(q, product_terms(spark, sf), 80)
    return out.withColumn("score", F.round("score", 4))


@query
def cascade_product(spark, sf):
    """M7: exact -> keyword -> fuzzy; first stage with a hit wins."""
    q = MT.distinct_queries(product_texts(spark, sf), "t")
    return MT.product_cascade(q, product_terms(spark, sf))


@query
def cascade_hazard(spark, sf):
    """M9 + M10: long texts scan first, short ones exact/keyword/fuzzy; class
    fallback to the raw item; flags false when unmatched."""
    p = T(spark, sf, "part")
    texts = product_texts(spark, sf).unionByName(
        p.select(F.concat(F.col("p_name"), F.lit(" was found in the shipment container")).alias("t")))
    q = MT.distinct_queries(texts, "t")
    m = MT.hazard_cascade(q, product_terms(spark, sf))
    d = product_dict(spark, sf).select("row_ord", "M_KOR_NM", "L_KOR_NM", "ANALYZABLE", "INTEREST_ITEM")
    j = q.join(m, on="q", how="left").join(d, on="row_ord", how="left")
    return j.select("q", "stage",
                    F.coalesce("M_KOR_NM", "q").alias("class_m"), F.col("L_KOR_NM").alias("class_l"),
                    F.coalesce("ANALYZABLE", F.lit(False)).alias("analyzable"),
                    F.coalesce("INTEREST_ITEM", F.lit(False)).alias("interest"))


@query
def sentence_scan(spark, sf):
    """M4: longest dictionary term inside each whole document."""
    d = T(spark, sf, "documents")
    q = d.select("doc_id", normalize(F.col("text")).alias("q"))
    m = MT.sentence_scan(q.where(F.col("q") != ""), hazard_terms(spark, sf), key="doc_id")
    return d.select("doc_id").join(m, on="doc_id", how="left").select("doc_id", "row_ord", "col_rank", "tlen")


@query
def hazard_extract(spark, sf):
    """M8: sentence scan then fuzzy over whole documents; KOR, else ENG, else
    test-item name of the winning row."""
    d = T(spark, sf, "documents")
    q = d.select("doc_id", normalize(F.col("text")).alias("q")).where(F.col("q") != "")
    m = MT.hazard_extract(q, hazard_terms(spark, sf), key="doc_id")
    names = hazard_dict(spark, sf).select("row_ord", F.coalesce("KOR_NM", "ENG_NM", "TESTITM_NM").alias("hazard"))
    return d.select("doc_id").join(m, on="doc_id", how="left").join(names, on="row_ord", how="left") \
        .select("doc_id", "stage", "hazard")


def rules(spark, sf):
    h = hazard_dict(spark, sf)
    kw = F.lower("ENG_NM")
    return h.select(kw.alias("keyword"), F.concat(F.lit("item_"), F.col("row_ord")).alias("TESTITM_NM"),
                    F.when(kw < "m", F.lit("ALL")).otherwise(F.lit("src3")).alias("source"),
                    F.col("row_ord").alias("rule_ord")).where(F.length("keyword") >= 2)


@query
def rule_scan(spark, sf):
    """M6 + F14: scoped keyword rules over whole documents; longest keyword
    wins, ties -> earliest rule."""
    d = T(spark, sf, "documents").select("doc_id", "text", "source")
    return MT.rule_scan(d, "text", "source", rules(spark, sf), key="doc_id").select("doc_id", "rule_ord")


def _titles(spark, sf):
    return T(spark, sf, "documents").select("doc_id", F.col("text").alias("title"))


def word_dict(spark, sf):
    b = T(spark, sf, "benchmark")
    w = b.select("item_id", F.posexplode(F.split("text", " ")).alias("pos", "w"))
    clean = F.regexp_replace(F.lower("w"), "[^a-z]", "")
    return w.select(F.upper(clean).alias("KOR_NM"), clean.alias("ENG_NM"),
                    (F.col("item_id") * 1000 + F.col("pos")).alias("row_ord")).where(F.col("ENG_NM") != "")


BOILERPLATE = r"^(is|the|and|of|a)\s+"


@query
def dict_override(spark, sf):
    """M12 + S14 + F13: boilerplate stripped from titles, longest English term
    (>= 3 characters) contained; KOR, else ENG name."""
    t = _titles(spark, sf)
    wd = word_dict(spark, sf)
    terms = MT.prepare_terms(wd, ["ENG_NM"], min_len=3)
    m = MT.override_hazard(t, "title", terms, BOILERPLATE, min_len=3, key="doc_id")
    names = wd.select("row_ord", F.coalesce("KOR_NM", "ENG_NM").alias("name"))
    return m.join(names, on="row_ord").select("doc_id", "name")


@query
def word_override(spark, sf):
    """Longest English term (>= 4) found as a whole word; KOR name."""
    t = _titles(spark, sf)
    wd = word_dict(spark, sf)
    terms = MT.prepare_terms(wd, ["ENG_NM"], min_len=4)
    m = MT.override_word(t, "title", terms, min_len=4, key="doc_id")
    names = wd.select("row_ord", F.col("KOR_NM").alias("name"))
    return m.join(names, on="row_ord").select("doc_id", "name")


@query
def suggest(spark, sf):
    """Nearest category by substring (smallest length difference), else
    token-set similarity > 60."""
    p = T(spark, sf, "part")
    c = T(spark, sf, "customer")
    w = F.split("p_name", " ")
    rev = F.concat_ws(" ", F.try_element_at(w, F.lit(2)), F.try_element_at(w, F.lit(1)))
    cats = p.groupBy(rev.alias("cat")).agg(F.min("p_partkey").alias("cat_ord"))
    names = p.select(F.col("p_name").alias("name")).unionByName(p.select(rev.alias("name"))) \
        .unionByName(c.select(F.col("c_mktsegment").alias("name")))
    out = MT.suggest_category(names, "name", cats, "cat", "cat_ord")
    return out.select("q", F.col("row_ord").alias("cat_ord"), "how")


@query
def term_coverage(spark, sf):
    """M15 + L5: per term exact/partial/none, count and 10 shortest names."""
    p = T(spark, sf, "part")
    r = T(spark, sf, "region")
    terms = p.select(F.explode(F.split("p_name", " ")).alias("term")) \
        .unionByName(p.select(F.lower("p_type").alias("term"))) \
        .unionByName(r.select(F.lower("r_name").alias("term"))).distinct()
    names = p.select(F.col("p_name").alias("name"))
    return MT.term_coverage(terms, "term", names, "name", 10)


@query
def normalize_text(spark, sf):
    """M1: null -> '', white space of every kind stripped at both ends, lower case."""
    p = T(spark, sf, "part")
    raw = F.concat(F.lit(" \t"), F.upper("p_name"), F.lit("\n "))
    return p.select("p_partkey", normalize(raw).alias("norm"),
                    normalize(F.when(F.col("p_type") == "PROMO", F.lit(None)).otherwise(F.col("p_type")))
                    .alias("norm_type"))
