"""Operator 6: sharding by fixed virtual slots.

Every record hashes into one of ``SLOTS`` virtual slots (by its id, or its text's hash if
the id is null), the bytes of each slot are summed, and a versioned map says which shard
holds which slot.  The first version deals slots, largest first, to the lightest shard;
``rebalance`` makes the next version from the last one by moving as few slots as bring the
shards within ``tolerance`` of their mean, also when the number of shards changes.  The map
has ``SLOTS`` rows whatever the data, so it is made on the driver and broadcast; each
version is written to its own folder and never changed.

Law: ``bytes`` (sizes near equal).  A record larger than a shard's share can't be split, so
the shard that holds it may exceed the mean by that record.

Defined cases: null text has size 1 and the checksum of no bytes; equal ids and repeated
rows share a slot; extra columns are ignored; an empty table gives an empty result (the map
is still written).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigil.session import checkpoint_dir

SLOTS = 4096
#: Parts in which the rows of one slot are numbered.
PARTS = 16


def sized(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, virtual_slot) of every row."""
    body = F.coalesce(F.encode(F.col("text").cast("string"), "utf-8"), F.lit(b""))
    return docs.select(
        "doc_id", (F.length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.pmod(F.coalesce(F.xxhash64(F.col("doc_id").cast("string")), F.xxhash64(body)), F.lit(slots)).cast("int").alias("virtual_slot"))


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> list[int]:
    """Bytes by slot; ``slots`` numbers reach the driver."""
    out = [0] * slots
    for slot, n in records.groupBy("virtual_slot").agg(F.sum("size")).collect():
        out[slot] = n
    return out


def first_map(weights: list[int], shards: int) -> list[int]:
    """Shard of each slot: largest slots first, each to the lightest shard so far."""
    load, slots, owner = [0] * shards, [0] * shards, [0] * len(weights)
    for slot in sorted(range(len(weights)), key=lambda i: (-weights[i], i)):
        to = min(range(shards), key=lambda s: (load[s], slots[s], s))
        owner[slot], load[to], slots[to] = to, load[to] + weights[slot], slots[to] + 1
    return owner


def rebalance(owner: list[int], weights: list[int], shards: int, tolerance: float = 0.01) -> list[int]:
    """The next version of a map: slots of shards that are gone and of shards above the mean move, the
    fewest that bring each shard within ``tolerance`` of the mean; all other slots stay where they are."""
    owner, goal = list(owner), sum(weights) / shards
    load = [0] * shards
    homeless = [i for i, s in enumerate(owner) if s >= shards]
    for i, s in enumerate(owner):
        if s < shards:
            load[s] += weights[i]
    for s in range(shards):  # what a shard holds beyond its share, largest slots that fit the surplus first
        for i in sorted((i for i, o in enumerate(owner) if o == s), key=lambda i: (-weights[i], i)):
            if load[s] > goal and 0 < weights[i] <= load[s] - goal * (1 - tolerance):
                homeless.append(i)
                load[s] -= weights[i]
    for i in sorted(homeless, key=lambda i: (-weights[i], i)):
        owner[i] = min(range(shards), key=lambda s: (load[s], s))
        load[owner[i]] += weights[i]
    return owner


def write_map(spark: SparkSession, root: str, version: int, owner: list[int], weights: list[int]) -> str:
    """One version of the map as a table of its own; an existing version is never overwritten."""
    path = f"{root}/version={version}"
    spark.createDataFrame([(i, s, w) for i, (s, w) in enumerate(zip(owner, weights))], "virtual_slot int, shard int, bytes long").coalesce(1).write.mode("errorifexists").parquet(path)
    return path


def read_map(spark: SparkSession, root: str, version: int) -> DataFrame:
    return spark.read.schema("virtual_slot int, shard int, bytes long").parquet(f"{root}/version={version}")


def place(records: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``records`` with shard and slot: the place in the shard, gapless from 0.

    Rows are numbered in small parts of a virtual slot; a part's first place comes from the
    counts of the parts before it (shards x slots x parts rows at most)."""
    part = records.join(F.broadcast(slot_map.select("virtual_slot", "shard")), "virtual_slot").withColumn("_part", F.pmod(F.xxhash64("text_crc32", "doc_id", "size"), F.lit(PARTS)).cast("int"))
    counts = part.groupBy("shard", "virtual_slot", "_part").count()
    ahead = Window.partitionBy("shard").orderBy("virtual_slot", "_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("_before", F.coalesce(F.sum("count").over(ahead), F.lit(0))).drop("count")
    within = Window.partitionBy("shard", "virtual_slot", "_part").orderBy("doc_id", "text_crc32", "size")
    return (part.withColumn("_n", F.row_number().over(within) - 1)
            .join(offsets, ["shard", "virtual_slot", "_part"])
            .withColumn("slot", (F.col("_before") + F.col("_n")).cast("long")).drop("_part", "_n", "_before"))


def shard(docs: DataFrame, shards: int = 8, root: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version.

    ``root``: folder of the map's versions (a new one in the shared checkpoint folder if None)."""
    spark = docs.sparkSession
    root = root or f"{checkpoint_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    records = sized(docs)
    weights = slot_bytes(records)
    write_map(spark, root, 1, first_map(weights, shards), weights)
    return place(records, read_map(spark, root, 1)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(1).alias("map_version"))
