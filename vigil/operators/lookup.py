"""Reference-data lookups.

Lookups are left equi-joins against dimension tables.  Dimensions are first
reduced to one row per key (``first``/``last`` per key, D14), so a join can
never fan out; the planner broadcasts them when their statistics are small
and shuffles otherwise (AQE re-plans at runtime from real sizes).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import strip_ws
from vigil.operators.merge import first_per_key, last_per_key


def code_dict(dim: DataFrame, code_col: str, name_col: str, order_col: str, keep: str = "last") -> DataFrame:
    """One ``(code, name)`` per code: ``keep='last'`` (dictionary build) or
    ``'first'`` (first row in file order)."""
    d = dim.select(F.col(code_col).alias("_code"), F.col(name_col).alias("_name"), F.col(order_col).alias("_ord")) \
        .where(F.col("_code").isNotNull())
    f = last_per_key if keep == "last" else first_per_key
    return f(d, ["_code"], "_ord").select("_code", "_name")


def code_to_name(df: DataFrame, code_col: str, dim: DataFrame, dim_code: str, dim_name: str, order_col: str,
                 out_col: str, fallback: str | Column | None = "code", keep: str = "last") -> DataFrame:
    """``out_col`` = name of ``code_col``; when unknown use the code itself
    (``fallback='code'``), a literal, or leave null (``fallback=None``)."""
    d = code_dict(dim, dim_code, dim_name, order_col, keep)
    j = df.join(d, df[code_col] == d["_code"], "left")
    if fallback == "code":
        fb = F.col(code_col).cast("string")
    elif fallback is None:
        fb = F.lit(None).cast("string")
    else:
        fb = fallback if isinstance(fallback, Column) else F.lit(fallback)
    return j.withColumn(out_col, F.coalesce(F.col("_name").cast("string"), fb)).drop("_code", "_name")


def hierarchy_names(df: DataFrame, top_code: str, parent_code: str, dim: DataFrame, code_col: str,
                    kor_col: str, eng_col: str, order_col: str, top_fallback: list, parent_fallback: list,
                    top_out: str = "top_name", parent_out: str = "parent_name") -> DataFrame:
    """Matched row -> name of its top code and of its parent code.

    Names: KOR, else ENG of the first dictionary row with that code; else the
    row's own stored name columns in order (``*_fallback``)."""
    d = first_per_key(dim.select(F.col(code_col).alias("_c"), F.col(kor_col).alias("_k"),
                                 F.col(eng_col).alias("_e"), F.col(order_col).alias("_o"))
                      .where(F.col("_c").isNotNull()), ["_c"], "_o")
    d = d.select("_c", F.coalesce("_k", "_e").alias("_n"))
    t = d.select(F.col("_c").alias("_tc"), F.col("_n").alias("_tn"))
    p = d.select(F.col("_c").alias("_pc"), F.col("_n").alias("_pn"))
    j = df.join(t, df[top_code] == t["_tc"], "left").join(p, df[parent_code] == p["_pc"], "left")
    tf = [F.col(c) for c in top_fallback if c in df.columns]
    pf = [F.col(c) for c in parent_fallback if c in df.columns]
    return (j.withColumn(top_out, F.coalesce(F.col("_tn"), *tf))
             .withColumn(parent_out, F.coalesce(F.col("_pn"), *pf))
             .drop("_tc", "_tn", "_pc", "_pn"))


def first_row_join(df: DataFrame, name_col: str, dim: DataFrame, dim_name: str, order_col: str,
                   cols: list) -> DataFrame:
    """Left join on name after keeping the first dictionary row per name
    (no fan-out)."""
    d = first_per_key(dim.select(F.col(dim_name).alias("_nm"), F.col(order_col).alias("_o"), *cols),
                      ["_nm"], "_o").drop("_o")
    return df.join(d, df[name_col] == d["_nm"], "left").drop("_nm")


def bidi_fill(df: DataFrame, code_col: str, name_col: str, dim: DataFrame, dim_code: str, dim_name: str,
              order_col: str, code_first: bool = True) -> DataFrame:
    """Fill a (code, name) pair from a dictionary in both directions.

    ``code_first``: if the code is known, the name is taken from it, else the
    code is looked up by name; otherwise name -> code first, then code -> name.
    Values already present are kept when nothing is found."""
    c2n = code_dict(dim, dim_code, dim_name, order_col, "last").select(F.col("_code").alias("_c1"),
                                                                     F.col("_name").alias("_n1"))
    n2c = code_dict(dim, dim_name, dim_code, order_col, "last").select(F.col("_code").alias("_n2"),
                                                                     F.col("_name").alias("_c2"))
    j = df.join(c2n, df[code_col] == c2n["_c1"], "left").join(n2c, df[name_col] == n2c["_n2"], "left")
    if code_first:
        code = F.when(F.col("_n1").isNotNull(), F.col(code_col)).otherwise(F.coalesce(F.col("_c2"), F.col(code_col)))
        name = F.coalesce(F.col("_n1"), F.col(name_col))
    else:
        code = F.coalesce(F.col("_c2"), F.col(code_col))
        name = F.when(F.col("_c2").isNotNull(), F.col(name_col)).otherwise(F.coalesce(F.col("_n1"), F.col(name_col)))
    return j.withColumn(code_col, code).withColumn(name_col, name).drop("_c1", "_n1", "_n2", "_c2")


def priority_type(df: DataFrame, industry_col: str, manual_col: str, code_map: DataFrame, map_code: str,
                  map_name: str, map_order: str, out_col: str = "product_type", other: str = "기타") -> DataFrame:
    """Product type by priority: industry code map -> manual value (non
    blank) -> ``other(FDA Code xx)`` when an industry code exists -> ``other``.
    A code listed twice takes its last name in ``map_order``."""
    m = code_dict(code_map.withColumn(map_code, F.col(map_code).cast("string")), map_code, map_name, map_order, "last") \
        .select(F.col("_code").alias("_mc"), F.col("_name").alias("_mn"))
    j = df.join(m, df[industry_col].cast("string") == m["_mc"], "left")
    manual = F.nullif(strip_ws(F.col(manual_col)), F.lit(""))
    ind = F.nullif(F.col(industry_col).cast("string"), F.lit(""))
    val = F.coalesce(F.col("_mn"), manual,
                     F.when(ind.isNotNull(), F.concat(F.lit(other + "(FDA Code "), ind, F.lit(")"))),
                     F.lit(other))
    return j.withColumn(out_col, val).drop("_mc", "_mn")


def country_standardize(df: DataFrame, raw_col: str, countries: DataFrame, en_col: str, ko_col: str,
                        order_col: str, out_col: str = "country") -> DataFrame:
    """Case-insensitive equality on the English name, then on the Korean
    name -> English name; otherwise the raw value.  Each name keeps its first
    row in file order."""
    key = F.lower(F.trim(F.col(raw_col)))
    en = first_per_key(countries.select(F.lower(F.trim(F.col(en_col))).alias("_k"), F.col(en_col).alias("_v1"),
                                        F.col(order_col).alias("_o")), ["_k"], "_o").drop("_o")
    ko = first_per_key(countries.select(F.lower(F.trim(F.col(ko_col))).alias("_k2"), F.col(en_col).alias("_v2"),
                                        F.col(order_col).alias("_o")), ["_k2"], "_o").drop("_o")
    j = df.withColumn("_key", key).join(en, F.col("_key") == en["_k"], "left") \
        .join(ko, F.col("_key") == ko["_k2"], "left")
    return j.withColumn(out_col, F.coalesce(F.col("_v1"), F.col("_v2"), F.col(raw_col))) \
        .drop("_key", "_k", "_v1", "_k2", "_v2")


def country_by_prefix(df: DataFrame, raw_col: str, countries: DataFrame, ko_col: str, en_col: str, order_col: str,
                      out_col: str = "country", default: str = "Overseas") -> DataFrame:
    """English name of the country whose Korean name equals the raw value,
    else of the first country whose Korean name starts with the raw value's
    first 2 characters (1, if it has no more), else the raw value (``default``
    if blank).  A Korean name listed twice keeps its first place and its last
    English name.

    The prefix step is an equi-join on the 1- or 2-character prefix with
    ``min_by`` over file order, so it never scans all country pairs."""
    raw = strip_ws(F.col(raw_col))
    ko = countries.where(F.col(ko_col).isNotNull()).groupBy(F.col(ko_col).alias("_e")).agg(
        F.max_by(F.col(en_col), F.col(order_col)).alias("_ev"), F.min(order_col).alias("_o"))
    pre = ko.withColumn("_p", F.explode(F.array_distinct(F.array(F.substring("_e", 1, 1), F.substring("_e", 1, 2))))) \
        .groupBy("_p").agg(F.min_by("_ev", "_o").alias("_pv"))
    j = df.withColumn("_raw", raw).join(ko.drop("_o"), F.col("_raw") == F.col("_e"), "left") \
        .join(pre, F.nullif(F.substring("_raw", 1, 2), F.lit("")) == pre["_p"], "left")
    val = F.coalesce(F.col("_ev"), F.col("_pv"), F.nullif(F.col("_raw"), F.lit("")), F.lit(default))
    return j.withColumn(out_col, val).drop("_raw", "_e", "_ev", "_p", "_pv")
