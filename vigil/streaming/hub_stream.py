"""Incremental hub append as a Structured Streaming job.

A landing directory of raw files is read as a stream; every micro-batch is
mapped onto the unified table, anti-joined against the hub on the hub key and
appended.  The hub table itself is the only state: a re-executed batch (after
a failure) or a re-run of the whole job adds nothing, because rows whose key is
already in the hub are dropped.  Progress lives in the checkpoint location.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.operators.key_filter import append_unseen
from vigil.operators.match import materialize
from vigil.operators.merge import HUB_KEYS, hub_append
from vigil.schema import UNIFIED_SCHEMA
from vigil.sources import io as IO


PARTITION = "registration_day"
NO_DATE = "none"


def registration_day(c: str = "registration_date") -> Column:
    """Partition value of a registration date: the day, or ``NO_DATE`` for anything that is no ISO date.

    Kept apart from ``registration_date``, which stays in the files as it is,
    so an empty or unparsable date is never turned into a null partition."""
    return F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.col(c)).otherwise(F.lit(NO_DATE))


def start_hub_stream(spark: SparkSession, stream: DataFrame, to_notices: Callable[[DataFrame], DataFrame],
                     hub_path: str, checkpoint_path: str, keys: list | None = None, dedup_batch: bool = True,
                     available_now: bool = True, processing_time: str | None = None, filter_path: str | None = None):
    """Start the streaming append; returns the ``StreamingQuery``.

    ``available_now`` processes everything landed so far and stops (batch-like
    scheduling, any job runner); otherwise ``processing_time`` (e.g. '1 hour')
    keeps it running.

    The hub is stored by ``registration_day``.  A micro-batch is mapped once
    (checkpointed into the shared folder), then its days restrict the hub
    partitions that the anti-join reads.  With ``filter_path`` key filters are
    kept there, and only partitions that can hold a key of the batch are read;
    all appends to the hub must then be made with it."""
    k = keys or HUB_KEYS
    hub_schema = T.StructType([*UNIFIED_SCHEMA.fields, T.StructField(PARTITION, T.StringType())])

    def upsert(batch: DataFrame, _batch_id: int) -> None:
        notices = materialize(to_notices(batch).na.fill("", k).withColumn(PARTITION, registration_day()))
        if filter_path:
            append_unseen(notices, hub_path, hub_schema, filter_path, k, PARTITION, dedup_batch)
            return
        current = IO.load_parquet(batch.sparkSession, hub_path, hub_schema).na.fill("", k)
        IO.append(hub_append(notices, current, k, dedup_batch, PARTITION), hub_path, [PARTITION])

    w = stream.writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint_path)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "1 hour")
    return w.start()
