"""Vectors in packed blocks: the unit that the vector searches join and hand to numpy.

A block is one row with up to a few thousand vectors in one binary column, so a search is a
join of query blocks with candidate blocks; no task holds more than two blocks, whatever
the size of a partition or of a group of equal vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v array<double>) of rows whose vector is not null and has finite components only."""
    v = F.col("embedding").cast("array<double>")
    return (embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
            .where("vec_id is not null and v is not null and size(v) > 0")
            .where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long vectors as a matrix."""
    return column.values.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def blocks(rows: DataFrame, group: list[str], size: int) -> DataFrame:
    """(group..., block, n, ids binary, data binary): the vectors of each group in blocks of about ``size``.

    A large group is dealt over as many blocks as it needs, so none grows with it."""
    counts = rows.groupBy(*group).count()
    dealt = rows.join(counts, group).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(7)), F.ceil(F.col("count") / size)).cast("int"))
    return dealt.groupBy(*group, "block").agg(F.sort_array(F.collect_list(F.struct("vec_id", "v"))).alias("rows"))


def unpack(cell: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    """(ids, vectors) of one block's ``rows`` cell."""
    own = cell.values
    ids = own.field(0).to_numpy()
    lists = own.field(1)
    return ids, lists.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def best(found: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query, ties to the smaller id, with their rank."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def top(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best (score, then smaller id) of one query."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= least)
    else:
        at = np.arange(len(scores))
    return at[np.lexsort((ids[at], -scores[at]))][:k]
