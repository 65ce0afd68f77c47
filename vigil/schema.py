"""The unified 15-column notice table and schema operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.text import parse_date_multi

# The unified column list, in order.
UNIFIED_COLUMNS = [
    "registration_date",
    "data_source",
    "source_detail",
    "product_type",
    "top_level_product_type",
    "upper_product_type",
    "product_name",
    "origin_country",
    "notifying_country",
    "hazard_class_l",
    "hazard_class_m",
    "hazard_item",
    "full_text",
    "analyzable",
    "interest_item",
]
BOOL_COLUMNS = ["analyzable", "interest_item"]
STRING_COLUMNS = [c for c in UNIFIED_COLUMNS if c not in BOOL_COLUMNS]

UNIFIED_SCHEMA = T.StructType(
    [T.StructField(c, T.BooleanType() if c in BOOL_COLUMNS else T.StringType(), False)
     for c in UNIFIED_COLUMNS]
)

# Display headers (English column -> Korean header), a bijection.
DISPLAY_HEADERS = {
    "registration_date": "등록일자",
    "data_source": "데이터소스",
    "source_detail": "상세출처",
    "product_type": "품목유형",
    "top_level_product_type": "최상위품목유형",
    "upper_product_type": "상위품목유형",
    "product_name": "제품명",
    "origin_country": "원산지",
    "notifying_country": "통보국",
    "hazard_class_l": "시험분류(대분류)",
    "hazard_class_m": "시험분류(중분류)",
    "hazard_item": "시험항목",
    "full_text": "전문",
    "analyzable": "분석가능여부",
    "interest_item": "관심항목",
}
INVERSE_HEADERS = {v: k for k, v in DISPLAY_HEADERS.items()}


def empty_unified(spark: SparkSession) -> DataFrame:
    """IO12: an empty table with the unified schema."""
    return spark.createDataFrame([], UNIFIED_SCHEMA)


def enforce_schema(df: DataFrame, date_col: str = "registration_date") -> DataFrame:
    """Add missing columns, order, drop extras, normalise types.

    Dates become ``yyyy-MM-dd`` text (unparsable -> ``""``), booleans null ->
    false, strings null -> ``""``.  One projection; nothing is materialised.
    """
    present = set(df.columns)
    out = []
    for c in UNIFIED_COLUMNS:
        src = F.col(c) if c in present else F.lit(None)
        if c in BOOL_COLUMNS:
            e = F.coalesce(src.cast("boolean"), F.lit(False))
        elif c == date_col:
            e = F.coalesce(F.date_format(parse_date_multi(src.cast("string")), "yyyy-MM-dd"), F.lit(""))
        else:
            e = F.coalesce(src.cast("string"), F.lit(""))
        out.append(e.alias(c))
    return df.select(*out)


def ensure_columns(df: DataFrame, defaults: dict) -> DataFrame:
    """Add each missing column with its default value."""
    missing = {c: F.lit(v) for c, v in defaults.items() if c not in df.columns}
    return df.withColumns(missing) if missing else df


def rename_columns(df: DataFrame, mapping: dict, inverse: bool = False) -> DataFrame:
    """Rename by dictionary (or its inverse); unknown names are left alone."""
    m = {v: k for k, v in mapping.items()} if inverse else mapping
    m = {k: v for k, v in m.items() if k in df.columns}
    return df.withColumnsRenamed(m) if m else df


def select_columns(df: DataFrame, wanted: list | None = None, exclude_keywords: list | None = None,
                   header_map: dict | None = None, always_keep: list | None = None) -> DataFrame:
    """Fixed list intersected with existing columns, or every column whose
    display header contains none of ``exclude_keywords``; ``always_keep`` stays."""
    keep = list(always_keep or [])
    if wanted is not None:
        cols = [c for c in wanted if c in df.columns]
    else:
        hm = header_map or {}
        kws = exclude_keywords or []
        cols = [c for c in df.columns if not any(k in hm.get(c, c) for k in kws)]
    cols += [c for c in keep if c in df.columns and c not in cols]
    return df.select(*cols)
