"""Key filters beside a partitioned hub (J1, T1): which partitions can hold a batch's keys.

Every append leaves, for each partition value it writes, a bitmap of at least ``BITS`` bits a key, in which each key sets
``HASHES`` places; a bitmap is stored in slices of 4 KB.  A key that some filter of its partition value lacks a place of
is certainly not in what that append wrote, so a batch reads only those hub partitions that can hold one of its keys, also
where the batch has rows of all days.  The anti join after it is exact: a filter never misses a key, and one that is
wrongly taken for held (about 2 in 10,000 keys an append) costs a partition's reading and no row.

Order of writing: the filter first, then the data.  A crash between the two leaves a filter that holds too much, which
is harmless.  All appends to the hub must go through here (one writer); ``refresh`` builds one filter for each
partition value from the hub as it is, for instance after rewriting it or when there are many appends.

Null keys hash like missing ones and are compared exactly like in ``hub_append``; empty batches and hubs give empty results.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.operators.match import materialize
from vigil.operators.merge import hub_append
from vigil.sources import io as IO

#: Least bits a key, and places a key sets.
BITS, HASHES = 32, 4
#: Bits in a slice of a bitmap (what ``bitmap_construct_agg`` makes).
SLICE = 8 * 4096
#: Most partition values (short strings) that are listed to prune a scan.
LISTED = 10_000


def _schema(part: str) -> str:
    return f"run string, size long, slice long, bits binary, {part} string"


def _places(keys: list, size: Column) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(1 << i).alias("which"), F.pmod(F.xxhash64(*keys, F.lit(i)), size).alias("place"))
                               for i in range(HASHES)]))


def filter_rows(rows: DataFrame, keys: list, part: str) -> DataFrame:
    """The filters of ``rows``, one for each value of ``part``: (run, size in bits, slice, bits, part)."""
    named = rows.select(*keys, F.col(part).alias("_part"))
    bits = F.greatest(F.count(F.lit(1)) * BITS, F.lit(SLICE))
    sizes = named.groupBy("_part").agg(F.expr("1L").alias("_one"), bits.alias("_bits")).select(
        "_part", F.expr("shiftleft(_one, cast(ceil(log2(_bits)) as int))").alias("size"))
    placed = named.join(sizes, "_part").select("_part", "size", _places(keys, F.col("size")).alias("p"))
    return (placed.groupBy("_part", "size", F.expr(f"p.place div {SLICE}").alias("slice"))
            .agg(F.bitmap_construct_agg(F.expr(f"p.place % {SLICE}")).alias("bits"))
            .select(F.lit(uuid.uuid4().hex).alias("run"), "size", "slice", "bits", F.col("_part").alias(part)))


def in_partitions(table: DataFrame, values: DataFrame, part: str) -> DataFrame:
    """Rows of ``table`` (stored by ``part``) in the partitions of ``values`` (distinct, already made), by a static partition
    filter; beyond ``LISTED`` values by a semi join, which reads all partitions."""
    some = [r[0] for r in values.select(part).limit(LISTED + 1).collect()]
    return table.where(F.col(part).isin(some)) if len(some) <= LISTED else table.join(values.select(part), part, "left_semi")


def may_hold(batch: DataFrame, filters: DataFrame, keys: list, part: str) -> DataFrame:
    """The distinct (part, keys) of ``batch`` that at least one filter holds all places of."""
    names = [part, *(k for k in keys if k != part)]
    own = batch.select(*names).distinct()
    near = in_partitions(filters, materialize(own.select(part).distinct()), part)
    made = near.select(part, "run", "size").distinct()
    probes = own.join(made, part).select(*names, "run", "size", _places(keys, F.col("size")).alias("p")).select(
        *names, "run", "size", "p.which", F.expr(f"p.place div {SLICE}").alias("slice"), F.expr(f"p.place % {SLICE}").alias("at"))
    there = F.expr("conv(hex(substring(bits, cast(shiftright(at, 3) as int) + 1, 1)), 16, 10) & shiftleft(1L, cast(at & 7 as int)) > 0")
    return (probes.join(near, [part, "run", "size", "slice"]).where(there).groupBy(*names, "run").agg(F.bit_or("which").alias("found"))
            .where(F.col("found") == (1 << HASHES) - 1).select(*names).distinct())


def unseen(batch: DataFrame, hub: DataFrame, filters: DataFrame, keys: list, part: str, dedup_batch: bool = True) -> DataFrame:
    """``hub_append`` that reads only the hub partitions which can hold a key of ``batch`` (already made)."""
    held = materialize(may_hold(batch, filters, keys, part).select(part).distinct())
    return hub_append(batch, in_partitions(hub, held, part), keys, dedup_batch)


def refresh(hub: DataFrame, root: str, keys: list, part: str) -> int:
    """Publish filters of the whole hub as the next version of ``root``; later appends count from there."""
    return IO.publish(filter_rows(hub, keys, part), root, partition_by=[part])


def read_filters(spark: SparkSession, root: str, part: str) -> DataFrame:
    """The current version's filters and those of the appends since."""
    version, _ = IO.current_version(spark, root)
    return IO.read_current(spark, root, _schema(part)).unionByName(IO.load_parquet(spark, f"{root}/appended/{version}", _schema(part)))


def append_unseen(batch: DataFrame, hub_path: str, schema, root: str, keys: list, part: str, dedup_batch: bool = True) -> int:
    """Append the rows of ``batch`` whose key is not in the hub at ``hub_path``; returns how many.

    A hub that has no filters under ``root`` yet gets them first."""
    spark = batch.sparkSession
    hub = IO.load_parquet(spark, hub_path, schema).na.fill("", keys)
    if IO.current_version(spark, root)[0] == 0:
        refresh(hub, root, keys, part)
    fresh = materialize(unseen(batch, hub, read_filters(spark, root, part), keys, part, dedup_batch))
    IO.append(filter_rows(fresh, keys, part), f"{root}/appended/{IO.current_version(spark, root)[0]}", [part])
    return IO.append(fresh, hub_path, [part])
