"""Consecutive numbering that scales past one task.

A global ``row_number()`` moves every row into one partition.  Here the order
column's range is cut into buckets by boundaries taken once from a sample, so a
row's bucket is a pure function of its order value; rows are numbered inside
their bucket, and a bucket starts where the counts of those before it end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Sampled order values for each boundary.
OVERSAMPLING = 50


def range_boundaries(df: DataFrame, order_col: str, buckets: int) -> list:
    """At most ``buckets - 1`` ascending order values that cut the rows into
    parts of similar size, from the ``buckets * OVERSAMPLING`` rows with the
    smallest hash (one small job; any boundaries give a right numbering)."""
    sample = df.select(F.col(order_col).alias("v")).where(F.col("v").isNotNull()) \
        .orderBy(F.xxhash64("v")).limit(buckets * OVERSAMPLING)
    rows = [r["v"] for r in sample.orderBy("v").collect()]
    return sorted({rows[len(rows) * i // buckets] for i in range(1, buckets)}) if rows else []


def sequential_ids(df: DataFrame, order_col: str, out_col: str = "seq", partitions: int | None = None) -> DataFrame:
    """Consecutive 1-based numbers in ``order_col`` order (nulls first), no
    single-task step.  ``order_col`` should be unique; ties are numbered in an
    arbitrary order."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = df.schema[order_col].dataType
    bounds = range_boundaries(df, order_col, n)
    if bounds:
        cuts = F.array(*[F.lit(b).cast(kind) for b in bounds])
        bucket = F.size(F.filter(cuts, lambda b: b <= F.coalesce(F.col(order_col), F.lit(bounds[0]).cast(kind))))
        bucket = F.when(F.col(order_col).isNull(), F.lit(0)).otherwise(bucket)
    else:
        bucket = F.lit(0)
    r = df.withColumn("_pid", bucket.cast("int"))
    counts = r.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.withColumn("_off", F.coalesce(F.sum("_n").over(
        Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_pid", "_off")
    local = r.withColumn("_ln", F.row_number().over(Window.partitionBy("_pid").orderBy(order_col)))
    return local.join(offs, on="_pid").withColumn(out_col, F.col("_off") + F.col("_ln")).drop("_pid", "_ln", "_off")
