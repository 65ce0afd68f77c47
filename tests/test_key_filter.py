"""Key filters beside the hub: exact appends, and partitions that can't hold a key are not read."""

import glob
import os
import random

from pyspark.sql import functions as F

from vigil.operators import key_filter
from vigil.operators.match import materialize
from vigil.sources import io as IO

KEYS, DDL = ["src", "ref", "day"], "src string, ref string, day string"


def _append(spark, rows, base):
    batch = materialize(spark.createDataFrame(rows, DDL))
    return key_filter.append_unseen(batch, base + "/hub", DDL, base + "/filters", KEYS, "day")


def _hub(spark, base):
    return sorted(map(tuple, IO.load_parquet(spark, base + "/hub", DDL).select(*KEYS).collect()))


def test_appends_equal_a_set(spark, tmp_dir):
    rng, base, seen = random.Random(5), os.path.join(tmp_dir, "a"), set()
    for _ in range(3):
        rows = [("s", str(rng.randrange(300)), rng.choice(["2024-01-01", "2024-01-02", "none"])) for _ in range(200)]
        assert _append(spark, rows, base) == len(set(rows) - seen)
        seen |= set(rows)
        assert _hub(spark, base) == sorted(seen)
    assert _append(spark, rows, base) == 0 and _append(spark, [], base) == 0


def test_partitions_without_the_keys_are_not_read(spark, tmp_dir):
    base = os.path.join(tmp_dir, "b")
    days = [f"2024-01-{d:02d}" for d in range(1, 9)]
    old = [("s", f"old{i}", d) for d in days for i in range(50)]
    _append(spark, old, base)
    batch = [("s", f"new{i}", d) for d in days for i in range(5)] + [("s", "old7", days[2])]
    frame = materialize(spark.createDataFrame(batch, DDL))
    filters = key_filter.read_filters(spark, base + "/filters", "day")
    held = [tuple(r) for r in key_filter.may_hold(frame, filters, KEYS, "day").collect()]
    assert [h[0] for h in held] == [days[2]]
    hub = IO.load_parquet(spark, base + "/hub", DDL)
    plan = key_filter.unseen(frame, hub, filters, KEYS, "day")._jdf.queryExecution().toString()
    scan = [p for p in plan.splitlines() if "FileScan" in p and "src" in p][-1]
    assert f"= {days[2]})" in scan.split("PartitionFilters")[1] and days[3] not in scan
    # unreadable files in all days but one: only a scan that leaves them out can succeed
    for d in days:
        if d != days[2]:
            for f in glob.glob(f"{base}/hub/day={d}/*.parquet"):
                os.remove(os.path.join(os.path.dirname(f), "." + os.path.basename(f) + ".crc"))
                with open(f, "wb") as out:
                    out.write(b"no parquet")
    assert _append(spark, batch, base) == len(batch) - 1


def test_a_hub_without_filters_gets_them(spark, tmp_dir):
    base = os.path.join(tmp_dir, "c")
    rows = [("s", str(i), "2024-01-01" if i % 3 else "none") for i in range(3000)]
    spark.createDataFrame(rows, DDL).write.partitionBy("day").parquet(base + "/hub")
    assert _append(spark, rows + [("s", "x", "2024-01-05")], base) == 1
    key_filter.refresh(IO.load_parquet(spark, base + "/hub", DDL), base + "/filters", KEYS, "day")
    assert _append(spark, rows + [("s", "x", "2024-01-05"), ("s", "y", "none")], base) == 1


def test_more_partitions_than_are_listed(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(key_filter, "LISTED", 2)
    base, rows = os.path.join(tmp_dir, "e"), [("s", str(i), f"2024-01-{i % 5 + 1:02d}") for i in range(50)]
    assert _append(spark, rows, base) == 50 and _append(spark, rows + [("s", "x", "2024-01-03")], base) == 1


def test_crash_between_filter_and_data_loses_nothing(spark, tmp_dir):
    base = os.path.join(tmp_dir, "d")
    _append(spark, [("s", "1", "2024-01-01")], base)
    lost = spark.createDataFrame([("s", "2", "2024-01-01")], DDL)
    IO.append(key_filter.filter_rows(lost, KEYS, "day"), base + "/filters/appended/1", ["day"])  # and then nothing
    assert _append(spark, [("s", "2", "2024-01-01"), ("s", "1", "2024-01-01")], base) == 1


def test_a_large_partition_has_several_slices(spark):
    rows = spark.range(20000).select(F.lit("s").alias("src"), F.col("id").cast("string").alias("ref"), F.lit("2024-01-01").alias("day"))
    filters = materialize(key_filter.filter_rows(rows, KEYS, "day"))
    assert filters.count() == 32 and filters.select("size").distinct().collect()[0][0] == 1 << 20
    assert key_filter.may_hold(rows, filters, KEYS, "day").count() == 20000
    others = rows.withColumn("ref", F.concat(F.lit("o"), "ref"))
    assert key_filter.may_hold(others, filters, KEYS, "day").count() < 40
