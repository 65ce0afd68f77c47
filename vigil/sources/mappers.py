"""Per-source mappers onto the unified table (P5-P10, M10, M11) and the source
registry (extension surface).

Each mapper is a DataFrame -> DataFrame function over landed raw rows.  The
classification steps are joins against the reference dictionaries, computed
once per *distinct* raw value (types, hazard items) or per row id for long
texts, then joined back - never a per-row Python call.  ``enforce_schema``
(P1) is applied last, so every mapper returns exactly the 15 columns.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions import text as X
from vigil.operators import match as MT
from vigil.operators.lookup import country_standardize
from vigil.operators.merge import first_per_key
from vigil.schema import enforce_schema

# Literal labels written by the reference's collectors.
KOREA = "South Korea"
I2620_PREFIX = "국내식품 부적합"
I0490_PREFIX = "회수판매중지"
I2810_PREFIX = "해외 위해식품 회수"
I2810_PRODUCT = ("수입식품(해외회수)", "수입식품", "위해회수")
RASFF_NOTIFIER = "EU Member States"
RASFF_CLASS = "Uncategorized"
FDA_NOTIFIER = "United States"
FDA_DETAIL_PREFIX = "FDA Import Alert_"


@dataclass
class References:
    """Reference dictionaries used by the mappers.

    ``products``: PRDLST_CD, HRNK_PRDLST_CD, HTRK_PRDLST_CD, KOR_NM, ENG_NM
    (+ optional HTRK_PRDLST_NM, GR_NM, HRNK_PRDLST_NM, PRDLST_CL_NM), row_ord.
    ``hazards``: KOR_NM, ENG_NM, ABRV, NCKNM, TESTITM_NM, M_KOR_NM, L_KOR_NM,
    ANALYZABLE, INTEREST_ITEM, row_ord.  ``rules``: keyword, TESTITM_NM,
    M_KOR_NM, L_KOR_NM, source, rule_ord.  ``countries``: en, ko, ord."""
    products: DataFrame
    hazards: DataFrame
    rules: DataFrame | None = None
    countries: DataFrame | None = None
    similarity: float = MT.SIMILARITY_THRESHOLD
    long_text: int = MT.LONG_TEXT_THRESHOLD

    def product_terms(self) -> DataFrame:
        """Unpivoted, deduplicated product vocabulary, checkpointed once and
        shared by every lookup of a run (a small leaf in each plan)."""
        if not hasattr(self, "_pt"):
            self._pt = MT.materialize(MT.prepare_terms(self.products, MT.PRODUCT_MATCH_COLUMNS))
        return self._pt

    def hazard_terms(self) -> DataFrame:
        if not hasattr(self, "_ht"):
            self._ht = MT.materialize(MT.prepare_terms(self.hazards, MT.HAZARD_MATCH_COLUMNS))
        return self._ht


def _opt(df: DataFrame, c: str) -> Column:
    return F.col(c) if c in df.columns else F.lit(None).cast("string")


# ------------------------------------------------------------------ lookups

def product_lookup(df: DataFrame, type_col: str, refs: References) -> DataFrame:
    """M7 + J4: ``top_level_product_type``/``upper_product_type`` for the raw type.

    The matched row's top (HTRK) and parent (HRNK) codes are resolved to the
    first dictionary row with that code (KOR, else ENG name); when absent the
    row's stored names are used."""
    p = refs.products
    q = MT.distinct_queries(df, type_col)
    terms = refs.product_terms()
    m = MT.product_cascade(q, terms, refs.similarity)
    names = first_per_key(p.select(F.col("PRDLST_CD").alias("_c"), F.coalesce("KOR_NM", "ENG_NM").alias("_nm"),
                                   F.col("row_ord").alias("_o")).where(F.col("_c").isNotNull()), ["_c"], "_o") \
        .drop("_o")
    rows = p.select("row_ord", F.col("HTRK_PRDLST_CD").alias("_tc"), F.col("HRNK_PRDLST_CD").alias("_uc"),
                    F.coalesce(_opt(p, "HTRK_PRDLST_NM"), _opt(p, "GR_NM")).alias("_tf"),
                    F.coalesce(_opt(p, "HRNK_PRDLST_NM"), _opt(p, "PRDLST_CL_NM")).alias("_uf"))
    t = names.select(F.col("_c").alias("_tc"), F.col("_nm").alias("_tn"))
    u = names.select(F.col("_c").alias("_uc"), F.col("_nm").alias("_un"))
    info = m.join(rows, on="row_ord").join(t, on="_tc", how="left").join(u, on="_uc", how="left") \
        .select("q", F.coalesce("_tn", "_tf").alias("top_level_product_type"),
                F.coalesce("_un", "_uf").alias("upper_product_type"))
    return MT.attach(df, type_col, info)


def hazard_lookup(df: DataFrame, item_col: str, refs: References, fallback_to_item: bool = True,
                  prefix: str = "") -> DataFrame:
    """M9 + M10: class M/L and flags for a hazard item; unmatched items keep
    the raw item as middle class (option), flags false."""
    q = MT.distinct_queries(df, item_col)
    terms = refs.hazard_terms()
    m = MT.hazard_cascade(q, terms, refs.similarity, refs.long_text)
    h = refs.hazards.select("row_ord", "M_KOR_NM", "L_KOR_NM", "ANALYZABLE", "INTEREST_ITEM")
    info = m.join(h, on="row_ord").select("q", "M_KOR_NM", "L_KOR_NM", "ANALYZABLE", "INTEREST_ITEM")
    out = MT.attach(df, item_col, info)
    raw = F.nullif(F.col(item_col), F.lit(""))
    class_m = F.coalesce(F.col("M_KOR_NM"), raw) if fallback_to_item else F.col("M_KOR_NM")
    return out.withColumns({
        prefix + "class_m": class_m,
        prefix + "class_l": F.col("L_KOR_NM"),
        prefix + "analyzable": F.coalesce(F.col("ANALYZABLE").cast("boolean"), F.lit(False)),
        prefix + "interest": F.coalesce(F.col("INTEREST_ITEM").cast("boolean"), F.lit(False)),
    }).drop("M_KOR_NM", "L_KOR_NM", "ANALYZABLE", "INTEREST_ITEM")


def hazard_from_text(df: DataFrame, id_col: str, text_col: str, refs: References, source: str,
                     raw_fallback: Column | None = None, use_rules: bool = True,
                     long_texts: bool = False) -> DataFrame:
    """M6 + M8 + M11: hazard item from free text.

    Keyword rules in scope for ``source`` win (item and, when both given, the
    classes); else the dictionary scan (+ fuzzy) gives KOR, else ENG, else the
    test-item name; else ``raw_fallback``.  Adds ``hazard_item``,
    ``rule_class_m``, ``rule_class_l``.

    Short texts (recall reasons, card reasons) repeat a lot: they are matched
    once per distinct text.  With ``long_texts`` (whole documents) they are
    keyed by ``id_col`` instead, so they are never deduplicated or shuffled."""
    key = id_col if long_texts else text_col
    t = df.select(F.col(key).alias("_id"), X.normalize(F.col(text_col)).alias("q"), F.lit(source).alias("_src"),
                  F.col(text_col).alias("_raw")).where(F.col("q") != "")
    if not long_texts:
        t = t.distinct()
    id_col = key
    out = df
    if use_rules and refs.rules is not None:
        rr = refs.rules
        rs = MT.rule_scan(t, "_raw", "_src", rr, key="_id")
        rinfo = rs.join(rr.select("rule_ord", F.col("TESTITM_NM").alias("_ri"), F.col("M_KOR_NM").alias("_rm"),
                                  F.col("L_KOR_NM").alias("_rl")), on="rule_ord").drop("rule_ord")
        out = out.join(rinfo, out[id_col] == rinfo["_id"], "left").drop("_id")
    else:
        out = out.withColumns({"_ri": F.lit(None).cast("string"), "_rm": F.lit(None).cast("string"),
                               "_rl": F.lit(None).cast("string")})
    terms = refs.hazard_terms()
    ex = MT.hazard_extract(t.select("_id", "q"), terms, True, refs.similarity, key="_id")
    names = refs.hazards.select("row_ord", F.coalesce("KOR_NM", "ENG_NM", "TESTITM_NM").alias("_xi"))
    ex = ex.join(names, on="row_ord").select("_id", "_xi")
    out = out.join(ex, out[id_col] == ex["_id"], "left").drop("_id")
    fb = raw_fallback if raw_fallback is not None else F.lit(None).cast("string")
    return out.withColumns({
        "hazard_item": F.coalesce(F.nullif(F.col("_ri"), F.lit("")), F.col("_xi"), fb),
        "rule_class_m": F.when(F.col("_rm").isNotNull() & F.col("_rl").isNotNull(), F.col("_rm")),
        "rule_class_l": F.when(F.col("_rm").isNotNull() & F.col("_rl").isNotNull(), F.col("_rl")),
    }).drop("_ri", "_rm", "_rl", "_xi")


def _classes(df: DataFrame, refs: References) -> DataFrame:
    """Rule classes when both are given, flags always from the lookup."""
    d = hazard_lookup(df, "hazard_item", refs, prefix="_h_")
    has_rule = F.col("rule_class_m").isNotNull()
    return d.withColumns({
        "hazard_class_m": F.when(has_rule, F.col("rule_class_m")).otherwise(F.col("_h_class_m")),
        "hazard_class_l": F.when(has_rule, F.col("rule_class_l")).otherwise(F.col("_h_class_l")),
        "analyzable": F.col("_h_analyzable"),
        "interest_item": F.col("_h_interest"),
    })


# ------------------------------------------------------------------ mappers

def _order(raw: DataFrame, order_col: str | None) -> Column:
    """What "first row" goes by: the file order where there is one, else the
    rows' own values, so the choice is the same in every run."""
    return (F.col(order_col) if order_col else F.struct(*raw.columns)).alias("_ord")


def map_i2620(raw: DataFrame, refs: References, order_col: str | None = None) -> DataFrame:
    """P5: domestic non-conformance rows (CRET_DTM 'YYYY.MM.DD', PRDTNM,
    PRDLST_CD_NM, TEST_ITMNM, RTRVLDSUSE_SEQ); first row per source detail."""
    d = raw.select(
        X.dotted_to_dashed(F.col("CRET_DTM")).alias("registration_date"),
        F.lit("MFDS").alias("data_source"),
        X.prefixed_id(I2620_PREFIX, F.col("RTRVLDSUSE_SEQ")).alias("source_detail"),
        F.col("PRDLST_CD_NM").alias("product_type"),
        F.col("PRDTNM").alias("product_name"),
        F.lit(KOREA).alias("origin_country"), F.lit(KOREA).alias("notifying_country"),
        F.col("TEST_ITMNM").alias("hazard_item"),
        _order(raw, order_col),
    ).withColumns({"rule_class_m": F.lit(None).cast("string"), "rule_class_l": F.lit(None).cast("string")})
    d = MT.materialize(first_per_key(d, ["source_detail"], "_ord"))  # the types, the items and the rows are read from it
    return enforce_schema(_classes(product_lookup(d, "product_type", refs), refs))


def map_i0490(raw: DataFrame, refs: References, order_col: str | None = None, long_texts: bool = False) -> DataFrame:
    """Recalls; hazard from the reason text (rules, then dictionary scan,
    else the reason itself); first row per source detail."""
    d = raw.select(
        X.first10(F.col("CRET_DTM")).alias("registration_date"),
        F.lit("MFDS").alias("data_source"),
        X.prefixed_id(I0490_PREFIX, F.col("RTRVLDSUSE_SEQ")).alias("source_detail"),
        F.col("PRDLST_CD_NM").alias("product_type"),
        F.col("PRDTNM").alias("product_name"),
        F.lit(KOREA).alias("origin_country"), F.lit(KOREA).alias("notifying_country"),
        F.col("RTRVLPRVNS").alias("full_text"),
        _order(raw, order_col),
    )
    d = first_per_key(d, ["source_detail"], "_ord")
    d = MT.materialize(hazard_from_text(d, "source_detail", "full_text", refs, "MFDS", raw_fallback=F.col("full_text"),
                                        long_texts=long_texts))
    return enforce_schema(_classes(product_lookup(d, "product_type", refs), refs))


def map_i2810(raw: DataFrame, refs: References, long_texts: bool = False) -> DataFrame:
    """Overseas recalls; text = detected title + body, origin from the body,
    fixed product columns."""
    d = raw.select(
        F.date_format(X.compact_date(F.col("CRET_DTM")), "yyyy-MM-dd").alias("registration_date"),
        F.lit("MFDS").alias("data_source"),
        X.prefixed_id(I2810_PREFIX, F.col("NTCTXT_NO")).alias("source_detail"),
        F.lit(I2810_PRODUCT[0]).alias("product_type"),
        F.lit(I2810_PRODUCT[1]).alias("top_level_product_type"),
        F.lit(I2810_PRODUCT[2]).alias("upper_product_type"),
        F.col("TITL").alias("product_name"),
        X.origin_from_text(F.col("BDT")).alias("origin_country"),
        F.lit(KOREA).alias("notifying_country"),
        X.join_texts(F.col("DETECT_TITL"), F.col("BDT")).alias("full_text"),
        F.col("DETECT_TITL").alias("_detect"),
    ).withColumn("_row", F.md5(F.concat_ws("\u0001", "source_detail", "full_text")))
    d = MT.materialize(hazard_from_text(d, "_row", "full_text", refs, "MFDS", raw_fallback=F.col("_detect"),
                                        long_texts=long_texts))
    return enforce_schema(_classes(d, refs))


def map_rasff(raw: DataFrame) -> DataFrame:
    """Listing rows (date 'DD/MM/YYYY', reference, origin, subject,
    category); subject doubles as product name and hazard item.  An
    unparsable date stays empty (deterministic)."""
    return enforce_schema(raw.select(
        F.date_format(X.day_first_date(F.col("date")), "yyyy-MM-dd").alias("registration_date"),
        F.lit("RASFF").alias("data_source"),
        X.strip_ws(F.col("reference")).alias("source_detail"),
        X.strip_ws(F.col("category")).alias("product_type"),
        X.strip_ws(F.col("subject")).alias("product_name"),
        X.strip_ws(F.col("origin")).alias("origin_country"),
        F.lit(RASFF_NOTIFIER).alias("notifying_country"),
        F.lit(RASFF_CLASS).alias("hazard_class_l"), F.lit(RASFF_CLASS).alias("hazard_class_m"),
        X.strip_ws(F.col("subject")).alias("hazard_item"),
        F.lit(False).alias("analyzable"), F.lit(False).alias("interest_item"),
    ))


def map_impfood(raw: DataFrame, refs: References) -> DataFrame:
    """Import inspection cards (id, date, name_kr, name_en, product_type,
    origin, reason): 'kr (en)' names, hazard extracted from the reason."""
    d = raw.select(
        F.col("date").alias("registration_date"),
        F.lit("ImpFood").alias("data_source"),
        F.concat(F.lit("ImpFood-"), F.col("id")).alias("source_detail"),
        F.col("product_type"),
        X.bilingual(F.col("name_kr"), F.col("name_en")).alias("product_name"),
        F.col("origin").alias("origin_country"),
        F.lit(KOREA).alias("notifying_country"),
        F.col("reason").alias("full_text"),
    )
    d = MT.materialize(hazard_from_text(d, "source_detail", "full_text", refs, "ImpFood",
                                        raw_fallback=F.col("full_text"), use_rules=False))
    return enforce_schema(_classes(product_lookup(d, "product_type", refs), refs))


def map_fda(blocks: DataFrame, refs: References, overrides: DataFrame | None = None,
            alert_col: str = "alert_no", force: bool = False, target_date: str | None = None,
            block_col: str = "block") -> DataFrame:
    """P10 + F12 + T3 + J14: segmented alert blocks (``segment_blocks`` output
    plus the alert number) -> notices.

    Product code from the opening line (else its first token) and the name
    after it (the first content line when nothing is left); the full text is
    the product line and the content, and both are searched for hazards: by
    manual override, then FDA-scoped rules, then the dictionary scan; product
    type manual override else the code; country standardised; date 'M/D/YYYY'
    -> ISO.  Blocks without a parsable date are dropped; unless ``force``, only
    blocks dated ``target_date`` are kept.  A block is identified by alert
    number and block number."""
    b = blocks.withColumn("_code", X.product_code(F.col("opener")))
    if refs.countries is not None:
        b = country_standardize(b, "header", refs.countries, "en", "ko", "ord", "_country")
    else:
        b = b.withColumn("_country", F.col("header"))
    code = F.when(F.col("_code") != "", F.col("_code")).otherwise(F.split(F.col("opener"), " ").getItem(0))
    first_line = F.coalesce(F.nullif(F.split("content", "\n").getItem(0), F.lit("")), F.col("opener"))
    name = F.when(F.col("_code") != "", X.name_after_code(F.col("opener"), F.col("_code"), first_line)) \
        .otherwise(F.col("opener"))
    reg = F.try_to_date(F.col("date").cast("string"), "M/d/yyyy")
    full = F.concat_ws("\n", F.col("opener"), F.nullif(F.col("content"), F.lit("")))
    row = F.concat_ws("\u0001", F.col(alert_col).cast("string"), F.col(block_col).cast("string"))
    d = b.select(F.col(alert_col), F.col("_country").alias("origin_country"), code.alias("_p_code"),
                 name.alias("product_name"), reg.alias("_reg"), full.alias("full_text"), row.alias("_row"))
    d = d.where(F.col("_reg").isNotNull())
    if not force and target_date is not None:
        d = d.where(F.col("_reg") == F.lit(target_date).cast("date"))
    if overrides is not None:
        d = d.join(overrides, on=alert_col, how="left")
    for c in ["Manual_Hazard_Item", "Manual_Class_M", "Manual_Class_L", "Manual_Product_Type"]:
        if c not in d.columns:
            d = d.withColumn(c, F.lit(None).cast("string"))
    d = MT.materialize(hazard_from_text(d, "_row", "full_text", refs, "FDA", raw_fallback=F.lit(""), long_texts=True))
    manual = F.nullif(F.col("Manual_Hazard_Item"), F.lit(""))
    both = F.col("Manual_Class_M").isNotNull() & F.col("Manual_Class_L").isNotNull()
    d = d.withColumns({
        "rule_class_m": F.when(manual.isNotNull(), F.when(both, F.col("Manual_Class_M"))).otherwise(F.col("rule_class_m")),
        "rule_class_l": F.when(manual.isNotNull(), F.when(both, F.col("Manual_Class_L"))).otherwise(F.col("rule_class_l")),
        "hazard_item": F.coalesce(manual, F.col("hazard_item")),
    })
    d = _classes(d, refs).withColumns({
        "registration_date": F.date_format("_reg", "yyyy-MM-dd"),
        "data_source": F.lit("FDA"),
        "source_detail": F.concat(F.lit(FDA_DETAIL_PREFIX), F.col(alert_col)),
        "product_type": F.coalesce(F.nullif(F.col("Manual_Product_Type"), F.lit("")), F.col("_p_code")),
        "notifying_country": F.lit(FDA_NOTIFIER),
    })
    return enforce_schema(d)


# ------------------------------------------------------------------ registry

SOURCES: dict = {
    "I2620": map_i2620,
    "I0490": map_i0490,
    "I2810": map_i2810,
    "RASFF": lambda raw, refs=None: map_rasff(raw),
    "ImpFood": map_impfood,
    "FDA": map_fda,
}


def register_source(name: str, fn) -> None:
    """Extension point: a new source is a function ``(raw, refs) -> DataFrame``;
    its output is passed through ``enforce_schema`` by ``map_source``."""
    SOURCES[name] = fn


def map_source(name: str, raw: DataFrame, refs: References | None = None, **kw) -> DataFrame:
    return enforce_schema(SOURCES[name](raw, refs, **kw))
