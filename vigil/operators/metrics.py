"""Dashboard filters and aggregates.

Aggregates are single ``groupBy``/``agg`` passes: partial aggregation runs
before the shuffle, so a hot group (one country holding a third of the rows)
costs one partial row per task.  Top-k uses ``orderBy().limit()``, which
plans as ``TakeOrderedAndProject`` (per-task top-k, then a merge of k rows
per task) instead of a global sort.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


# Default critical-hazard keywords (regex alternation, '.' is any char).
RISK_KEYWORDS = ["salmonella", "listeria", "e.coli", "metal", "glass"]


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ------------------------------------------------------------------ filters

def filter_in(df: DataFrame, col: str, values) -> DataFrame:
    """IN-list filter; an empty or missing list means no filter."""
    return df.where(F.col(col).isin(list(values))) if values else df


def filter_date_range(df: DataFrame, date_expr, start: str | None, end: str | None) -> DataFrame:
    """inclusive range on a parsed date; unparsable dates are excluded.

    Pass a real date/timestamp column where possible: a cast of the literal
    (not of the column) keeps the predicate pushable into the scan."""
    d = _c(date_expr)
    if start is None and end is None:
        return df
    cond = d.isNotNull()
    if start is not None:
        cond = cond & (d >= F.lit(start).cast("date"))
    if end is not None:
        cond = cond & (d < F.date_add(F.lit(end).cast("date"), 1))
    return df.where(cond)


def filter_recent(df: DataFrame, date_expr, days: int, as_of: str) -> DataFrame:
    """rows dated within the last ``days`` days before ``as_of`` (inclusive)."""
    d = _c(date_expr)
    return df.where(d >= F.date_sub(F.lit(as_of).cast("date"), days))


def filter_regex(df: DataFrame, col: str, pattern: str) -> DataFrame:
    """one-column case-insensitive regex search."""
    return df.where(F.col(col).cast("string").rlike("(?i)" + pattern)) if pattern else df


def filter_any_regex(df: DataFrame, pattern: str, cols: list | None = None) -> DataFrame:
    """any-column case-insensitive regex search."""
    if not pattern:
        return df
    cs = cols or df.columns
    pred = reduce(lambda a, b: a | b,
                  [F.coalesce(F.col(c).cast("string").rlike("(?i)" + pattern), F.lit(False)) for c in cs])
    return df.where(pred)


ALL = "all"


def facet_filter(df: DataFrame, selections: list) -> DataFrame:
    """chained facet filters ``[(col, value_or_list_or_'all'), ...]``."""
    for col, v in selections:
        if v is None or v == ALL or (isinstance(v, (list, tuple)) and not v):
            continue
        df = df.where(F.col(col).isin(list(v))) if isinstance(v, (list, tuple)) else df.where(F.col(col) == v)
    return df


def facet_lists(df: DataFrame, selections: list) -> DataFrame:
    """F6 + A8: ``(level, facet, value, n)``, the value lists of all facets at once as a cascade shows them: a facet's
    values are those of the rows that the selections of the facets before it leave.

    One pass: a row gives its value to every facet that it reaches, and values are counted by (facet, value) before
    the shuffle.  Null and empty values are in no list."""
    reached, cells = F.lit(True), []
    for level, (col, chosen) in enumerate(selections):
        value = F.col(col).cast("string")
        cells.append(F.struct(F.lit(level).alias("level"), F.lit(col).alias("facet"), value.alias("value"),
                              (reached & F.coalesce(value != "", F.lit(False))).alias("shown")))
        if not (chosen is None or chosen == ALL or (isinstance(chosen, (list, tuple)) and not chosen)):
            among = F.col(col).isin(list(chosen)) if isinstance(chosen, (list, tuple)) else F.col(col) == chosen
            reached = reached & F.coalesce(among, F.lit(False))
    shown = df.select(F.inline(F.filter(F.array(*cells), lambda x: x["shown"])))
    return shown.groupBy("level", "facet", "value").agg(F.count(F.lit(1)).alias("n"))


def rows_of(df: DataFrame, col: str, value, columns: list) -> DataFrame:
    """all rows of one chosen value, selected columns (pushed to the scan)."""
    return df.where(F.col(col) == F.lit(value)).select(*columns)


def flag_filter(df: DataFrame, flag_col: str, only_flagged: bool) -> DataFrame:
    """show-only-flagged toggle (null flag counts as false)."""
    return df.where(F.coalesce(F.col(flag_col), F.lit(False))) if only_flagged else df


# ------------------------------------------------------------------ aggregates

def risk_pattern(keywords=None) -> str:
    return "|".join(keywords or RISK_KEYWORDS)


def dash_metrics(df: DataFrame, text_col: str, facet_col: str, date_col, keywords=None) -> DataFrame:
    """A1 + A2 + A4 + A7 as one two-level aggregation (no join).

    total rows, rows whose ``text_col`` matches the keyword alternation
    (case-insensitive, null false), most frequent ``facet_col`` value with its
    count (ties -> smallest value), and min/max date.  Level one groups by the
    facet (partial aggregation before the shuffle); level two folds the small
    per-facet result into one row."""
    pat = "(?i)(" + risk_pattern(keywords) + ")"
    d = _c(date_col)
    per = df.groupBy(F.col(facet_col).alias("_f")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.coalesce(F.col(text_col).rlike(pat), F.lit(False))).alias("r"),
        F.min(d).alias("lo"),
        F.max(d).alias("hi"),
    )
    has = F.col("_f").isNotNull()
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("total"),
        F.coalesce(F.sum("r"), F.lit(0)).cast("long").alias("risk_count"),
        F.min_by(F.col("_f"), F.when(has, F.struct(-F.col("n"), F.col("_f")))).alias("top_value"),
        F.max(F.when(has, F.col("n"))).alias("top_count"),
        F.min("lo").alias("min_date"),
        F.max("hi").alias("max_date"),
    )


def value_counts(df: DataFrame, col: str, drop_empty: bool = False) -> DataFrame:
    """A3: count per non-null value (``drop_empty`` also removes '')."""
    d = df.where(F.col(col).isNotNull())
    if drop_empty:
        d = d.where(F.col(col) != "")
    return d.groupBy(col).agg(F.count(F.lit(1)).alias("n"))


def top_k(df: DataFrame, col: str, k: int = 10, drop_empty: bool = True) -> DataFrame:
    """A3 + L2: top-k values by count; ties -> smaller value first.
    Empties are removed before the cut (so k rows are shown when they exist)."""
    return value_counts(df, col, drop_empty).orderBy(F.desc("n"), F.asc(col)).limit(k)


def daily_counts(df: DataFrame, date_expr) -> DataFrame:
    """A5: rows per day; unparsable dates dropped."""
    d = _c(date_expr)
    return df.select(d.cast("date").alias("day")).where(F.col("day").isNotNull()) \
        .groupBy("day").agg(F.count(F.lit(1)).alias("n"))


def class_share(df: DataFrame, col: str) -> DataFrame:
    """Count and percent of total per class, empties removed.

    The total is a scalar subquery, so the classes stay distributed."""
    vc = value_counts(df, col, drop_empty=True)
    return vc.withColumn("pct", F.round(F.col("n") * 100.0 / vc.agg(F.sum("n")).scalar(), 2))


def facet_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct sorted non-null, non-empty values."""
    return df.select(col).where(F.col(col).isNotNull() & (F.col(col).cast("string") != "")) \
        .distinct().orderBy(col)


def capped(df: DataFrame, cap: int = 5000, order_cols: list | None = None):
    """L3: display cap.  Returns ``(rows_df, limited)`` where ``limited`` tells
    whether more than ``cap`` rows exist (only ``cap + 1`` rows are pulled)."""
    limited = df.limit(cap + 1).count() > cap  # existence probe: no sort needed
    d = df.orderBy(*order_cols) if order_cols else df
    return d.limit(cap), limited


def funnel_counts(df: DataFrame, changed_col: str, collect_col: str, red: str, yellow: str, green: str,
                  force: bool = False) -> DataFrame:
    """F8 + A15: eligibility funnel counters in one pass.

    processed = eligible; skipped_unchanged; skipped_collect_off; skipped_no_list
    (neither red nor yellow)."""
    b = lambda c, d: F.coalesce(F.col(c).cast("boolean"), F.lit(d))
    unchanged = F.lit(False) if force else ~b(changed_col, True)
    off = ~b(collect_col, True)
    nolist = ~(b(red, False) | b(yellow, False))
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(unchanged).alias("skipped_unchanged"),
        F.count_if(~unchanged & off).alias("skipped_collect_off"),
        F.count_if(~unchanged & ~off & nolist).alias("skipped_no_list"),
        F.count_if(~unchanged & ~off & ~nolist).alias("processed"),
    )


def eligible(df: DataFrame, changed_col: str, collect_col: str, red: str, yellow: str,
             force: bool = False, limit: int | None = None, order_col: str | None = None) -> DataFrame:
    """F8 + L4: eligible work items; the limit applies after eligibility."""
    b = lambda c, d: F.coalesce(F.col(c).cast("boolean"), F.lit(d))
    cond = b(collect_col, True) & (b(red, False) | b(yellow, False))
    if not force:
        cond = cond & b(changed_col, True)
    out = df.where(cond)
    if limit is not None:
        out = out.orderBy(order_col).limit(limit)
    return out


def with_defaults_projection(df: DataFrame, defaults: dict) -> DataFrame:
    """Master row -> work item, ``coalesce(col, default)`` per column."""
    return df.withColumns({c: F.coalesce(F.col(c) if c in df.columns else F.lit(None), F.lit(v))
                           for c, v in defaults.items()})
