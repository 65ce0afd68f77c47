"""Data-quality audit.

Each audit is one aggregation pass (``count_if`` per column) followed by an
``unpivot`` of the single result row, so the cost is one scan regardless of
the number of checks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.schema import BOOL_COLUMNS, UNIFIED_COLUMNS

# Raw -> derived pairs checked for mapping failures.
MAPPING_PAIRS = [
    ("product_type", "top_level_product_type"),
    ("product_type", "upper_product_type"),
    ("hazard_item", "hazard_class_m"),
    ("hazard_item", "hazard_class_l"),
]


def _status_band(pct):
    return (F.when(pct == 0, F.lit("perfect"))
            .when(pct < 10, F.lit("minor"))
            .when(pct < 50, F.lit("moderate"))
            .otherwise(F.lit("critical")))


def _empty(c):
    """null, '' or the text 'None' counts as empty (mapping audit)."""
    s = F.col(c).cast("string")
    return s.isNull() | (s == "") | (s == "None")


def audit_missing(df: DataFrame, columns: list | None = None, bool_cols: list | None = None) -> DataFrame:
    """A10: per column ``(column_name, position, missing, missing_pct, status)``.

    '' counts as missing except for boolean columns; a column absent from the
    table gets null counts and status ``absent``."""
    cols = columns or UNIFIED_COLUMNS
    bools = set(bool_cols if bool_cols is not None else BOOL_COLUMNS)
    aggs = [F.count(F.lit(1)).alias("_total")]
    for i, c in enumerate(cols):
        if c not in df.columns:
            continue
        miss = F.col(c).isNull() if c in bools else (F.col(c).isNull() | (F.col(c).cast("string") == ""))
        aggs.append(F.count_if(miss).alias(f"m{i}"))
    one = df.agg(*aggs)
    stack = [F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"),
                      (F.col(f"m{i}") if c in df.columns else F.lit(None).cast("long")).alias("missing"))
             for i, c in enumerate(cols)]
    return _missing_report(one.select("_total", F.explode(F.array(*stack)).alias("s")).select("_total", "s.*"))


def _missing_report(rows: DataFrame) -> DataFrame:
    """Shares and status bands of ``(_total, column_name, position, missing)``."""
    pct = F.round(F.col("missing") * 100.0 / F.col("_total"), 2)
    pct = F.when(F.col("_total") > 0, pct).otherwise(F.lit(0.0))
    return rows.select(
        "column_name", "position", "missing",
        F.when(F.col("missing").isNull(), F.lit(None)).otherwise(pct).alias("missing_pct"),
        F.when(F.col("missing").isNull(), F.lit("absent")).otherwise(_status_band(pct)).alias("status"),
    )


def audit_mapping(df: DataFrame, pairs: list | None = None) -> DataFrame:
    """Per (raw, derived) pair, rows with the raw value present and the
    derived value empty: ``(raw_col, derived_col, failures, failure_pct, status)``.
    Pairs with a missing column are skipped."""
    ps = [(a, b) for a, b in (pairs or MAPPING_PAIRS) if a in df.columns and b in df.columns]
    aggs = [F.count(F.lit(1)).alias("_total")]
    for i, (a, b) in enumerate(ps):
        aggs.append(F.count_if(~_empty(a) & _empty(b)).alias(f"f{i}"))
    one = df.agg(*aggs)
    stack = [F.struct(F.lit(a).alias("raw_col"), F.lit(b).alias("derived_col"), F.col(f"f{i}").alias("failures"))
             for i, (a, b) in enumerate(ps)]
    if not stack:
        return one.select(F.lit(None).cast("string").alias("raw_col")).limit(0)
    rows = one.select("_total", F.explode(F.array(*stack)).alias("s")).select("_total", "s.*")
    pct = F.when(F.col("_total") > 0, F.round(F.col("failures") * 100.0 / F.col("_total"), 2)).otherwise(0.0)
    return rows.select("raw_col", "derived_col", "failures", pct.alias("failure_pct"),
                       F.when(F.col("failures") > 0, F.lit("critical")).otherwise(F.lit("ok")).alias("status"))


def audit_summary(df: DataFrame, source_col: str = "data_source", expected: list | None = None) -> DataFrame:
    """A9 + A13 + A14: one row ``(total_rows, expected_columns, actual_columns,
    n_sources, schema_ok, verdict)``; verdict is ``ok`` when the schema matches
    and the table has rows.  The sources themselves are ``audit_sources``."""
    exp = expected or UNIFIED_COLUMNS
    schema_ok = list(df.columns) == list(exp)
    src = F.col(source_col) if source_col in df.columns else F.lit(None).cast("string")
    out = df.agg(F.count(F.lit(1)).alias("total_rows"), F.count_distinct(src).alias("n_sources"))
    return out.select(
        "total_rows",
        F.lit(len(exp)).alias("expected_columns"),
        F.lit(len(df.columns)).alias("actual_columns"),
        "n_sources",
        F.lit(schema_ok).alias("schema_ok"),
        F.when(F.lit(schema_ok) & (F.col("total_rows") > 0), F.lit("ok")).otherwise(F.lit("fail")).alias("verdict"),
    )


def audit_sources(df: DataFrame, source_col: str = "data_source") -> DataFrame:
    """Every source with its rows."""
    return df.where(F.col(source_col).isNotNull()).groupBy(F.col(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n_rows"))


# ------------------------------------------------------------------ states that add up (A9, A10, A13 with T1)

def run_state(df: DataFrame, run_id: str, columns: list | None = None, bool_cols: list | None = None,
              source_col: str = "data_source", distinct_cols: list | None = None) -> DataFrame:
    """What the audits need to know of one run's rows: ``(run_id, check, name, value, sketch)``.

    Rows, missing values per column, rows per source and, for ``distinct_cols``, sketches of the distinct values.
    States of runs add up (``fold_states``), so the table is audited after each run without being read again."""
    cols, bools = columns or UNIFIED_COLUMNS, set(bool_cols if bool_cols is not None else BOOL_COLUMNS)
    there = [c for c in cols if c in df.columns]
    missing = [F.count_if(F.col(c).isNull() if c in bools else F.col(c).isNull() | (F.col(c).cast("string") == "")).alias(f"m{i}") for i, c in enumerate(there)]
    sketches = [F.hll_sketch_agg(F.col(c).cast("string")).alias(f"s{i}") for i, c in enumerate(distinct_cols or [])]
    one = df.agg(F.count(F.lit(1)).alias("rows"), *missing, *sketches)

    def cell(check: str, name: str, value=None, sketch=None):
        return F.struct(F.lit(check).alias("check"), F.lit(name).alias("name"), (value if value is not None else F.lit(None)).cast("long").alias("value"),
                        (sketch if sketch is not None else F.lit(None)).cast("binary").alias("sketch"))

    cells = [cell("rows", "", F.col("rows")), *[cell("missing", c, F.col(f"m{i}")) for i, c in enumerate(there)],
             *[cell("distinct", c, None, F.col(f"s{i}")) for i, c in enumerate(distinct_cols or [])]]
    state = one.select(F.inline(F.array(*cells)))
    if source_col in df.columns:
        sources = audit_sources(df, source_col).select(F.lit("source").alias("check"), F.col("source").alias("name"), F.col("n_rows").alias("value"), F.lit(None).cast("binary").alias("sketch"))
        state = state.unionByName(sources)
    return state.select(F.lit(run_id).alias("run_id"), "*")


def fold_states(states: DataFrame) -> DataFrame:
    """``(check, name, value, n_distinct)`` over all runs; a run that was written twice counts once."""
    once = states.groupBy("run_id", "check", "name").agg(F.max("value").alias("value"), F.max("sketch").alias("sketch"))
    out = once.groupBy("check", "name").agg(F.sum("value").alias("value"), F.hll_union_agg("sketch").alias("sketch"))
    return out.select("check", "name", "value", F.when(F.col("check") == "distinct", F.hll_sketch_estimate("sketch")).alias("n_distinct"))


def folded_missing(folded: DataFrame, columns: list | None = None) -> DataFrame:
    """A10 from folded states: as ``audit_missing`` over all rows."""
    cols = columns or UNIFIED_COLUMNS
    counts = folded.agg(F.max(F.when(F.col("check") == "rows", F.col("value"))).alias("_total"),
                        *[F.max(F.when((F.col("check") == "missing") & (F.col("name") == c), F.col("value"))).alias(f"m{i}") for i, c in enumerate(cols)])
    stack = [F.struct(F.lit(c).alias("column_name"), F.lit(i).alias("position"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(cols)]
    return _missing_report(counts.select(F.coalesce("_total", F.lit(0).cast("long")).alias("_total"), F.explode(F.array(*stack)).alias("s")).select("_total", "s.*"))


def folded_sources(folded: DataFrame) -> DataFrame:
    """A13 from folded states: as ``audit_sources`` over all rows."""
    return folded.where("check = 'source'").select(F.col("name").alias("source"), F.col("value").alias("n_rows"))


def audit_schema(df: DataFrame, expected: list | None = None) -> DataFrame:
    """Schema conformance and use of every column in one pass over the
    rows: ``(column_name, kind, position, present)``.

    kind is ``missing`` (expected, absent), ``extra`` (present, unexpected),
    ``order`` (expected, at another place among the expected ones) or ``ok``;
    ``present`` counts the rows that have a value there."""
    exp, act = expected or UNIFIED_COLUMNS, df.columns
    common_e, common_a = [c for c in exp if c in act], [c for c in act if c in exp]
    moved = {c for c, d in zip(common_a, common_e) if c != d}
    rows = [(c, "missing" if c not in act else "order" if c in moved else "ok", i) for i, c in enumerate(exp)]
    rows += [(c, "extra", i) for i, c in enumerate(act) if c not in exp]
    one = df.agg(*[F.count(F.col(c)).alias(f"c{i}") for i, c in enumerate(act)])
    cells = [F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("kind"), F.lit(i).alias("position"),
                      (F.col(f"c{act.index(c)}") if c in act else F.lit(0).cast("long")).alias("present")) for c, kind, i in rows]
    return one.select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def full_audit(df: DataFrame) -> DataFrame:
    """All audit outputs as rows ``(part, name, value, status)``."""
    text = lambda c: F.col(c).cast("string")
    parts = [
        audit_schema(df).select(F.lit("schema").alias("part"), F.col("column_name").alias("name"), text("present").alias("value"), F.col("kind").alias("status")),
        audit_missing(df).select(F.lit("missing"), "column_name", text("missing"), "status"),
        audit_mapping(df).select(F.lit("mapping"), F.concat_ws(">", "raw_col", "derived_col"), text("failures"), "status"),
        audit_summary(df).select(F.lit("summary"), F.lit("rows"), text("total_rows"), "verdict"),
    ]
    return reduce(lambda a, b: a.union(b), parts)
