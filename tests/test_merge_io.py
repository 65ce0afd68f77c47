"""Merge semantics, sinks and sources."""

import hashlib
import os

import pytest

from pyspark.sql import functions as F

from vigil.operators import merge as M
from vigil.schema import UNIFIED_COLUMNS, enforce_schema
from vigil.sources import io as IO


def _notices(spark, rows):
    df = spark.createDataFrame(rows, "registration_date string, data_source string, source_detail string, "
                                     "product_name string, id string, legacy_field string")
    return enforce_schema(df)


def test_enforce_schema_drops_extras_and_fills(spark):
    out = _notices(spark, [("2024-01-05", "FDA", "A-1", "x", "1", "z"), ("bad", None, None, None, None, None)])
    assert out.columns == UNIFIED_COLUMNS
    rows = out.collect()
    assert rows[0]["registration_date"] == "2024-01-05" and rows[0]["analyzable"] is False
    assert rows[1]["registration_date"] == "" and rows[1]["data_source"] == ""


def test_hub_append_idempotent(spark, tmp_dir):
    hub = os.path.join(tmp_dir, "hub")
    batch = _notices(spark, [("2024-01-05", "FDA", "A-1", "x", None, None), ("2024-01-06", "FDA", "A-2", "y", None, None)])
    empty = IO.load_parquet(spark, hub, batch.schema)
    assert IO.append(M.hub_append(batch, empty), hub) == 2
    again = IO.load_hub(spark, hub)
    assert IO.append(M.hub_append(batch, again), hub) == 0          # re-run adds nothing
    more = _notices(spark, [("2024-01-05", "FDA", "A-1", "x", None, None), ("2024-01-07", "RASFF", "R-1", "z", None, None),
                            ("2024-01-07", "RASFF", "R-1", "z", None, None)])
    new = M.hub_append(more, IO.load_hub(spark, hub))
    assert new.count() == 2                                          # batch duplicates survive by default
    assert M.hub_append(more, IO.load_hub(spark, hub), dedup_batch=True).count() == 1
    IO.append(new, hub)
    assert IO.load_hub(spark, hub).count() == 4                      # new + existing = total


def test_record_id_matches_sha256(spark):
    df = spark.createDataFrame([("FDA", "99-01"), ("FDA", "")], "s string, r string")
    from vigil.functions.text import record_id
    got = [r[0] for r in df.select(record_id("s", "r")).collect()]
    assert got[0] == hashlib.sha256(b"FDA::99-01").hexdigest() and got[1] is None


def test_pinned_merge_and_patches(spark):
    cur = spark.createDataFrame([(1, "a", True), (2, "b", False), (3, "c", None)], "k int, v string, IS_MANUAL_FIXED boolean")
    new = spark.createDataFrame([(1, "A"), (2, "B"), (4, "D")], "k int, v string")
    out = {r["k"]: r["v"] for r in M.pinned_merge(new, cur, "k").collect()}
    assert out == {1: "a", 2: "B", 4: "D"}
    base = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, v string, x double")
    patch = spark.createDataFrame([(1, None, 5.0)], "k int, v string, x double")
    nn = {r["k"]: (r["v"], r["x"]) for r in M.patch_non_null(base, patch, "k").collect()}
    assert nn == {1: ("a", 5.0), 2: ("b", 2.0)}
    pa = {r["k"]: (r["v"], r["x"], r["_changed"]) for r in M.patch_all(base, patch, "k", ["v", "x"]).collect()}
    assert pa == {1: (None, 5.0, True), 2: ("b", 2.0, False)}


def test_crud_merge(spark):
    cur = spark.createDataFrame([(1, "a", False), (2, "b", False), (3, "c", True)], "k int, v string, IS_MANUAL_FIXED boolean")
    ch = spark.createDataFrame([(1, "delete", None, None), (2, "update", "B", False), (3, "update", "C", True),
                                (9, "insert", "new", None), (2, "insert", "dup", None)],
                               "k int, op string, v string, pin_edited boolean")
    ch = ch.withColumn("IS_MANUAL_FIXED", F.when(F.col("k") == 3, F.lit(False)))
    out = {r["k"]: (r["v"], r["IS_MANUAL_FIXED"]) for r in M.crud_merge(cur, ch, "k", ["v"]).collect()}
    assert out == {2: ("B", True), 3: ("C", False), 9: ("new", True)}


def test_change_detect(spark):
    old = spark.createDataFrame([(1, "2024-01-01", False), (2, "2024-01-01", True), (3, "2024-01-01", True)],
                                "k int, d string, IsCollect boolean")
    new = spark.createDataFrame([(1, "2024-01-01", True), (2, "2024-02-01", True), (4, "2024-02-01", True)],
                                "k int, d string, IsCollect boolean")
    out = {r["k"]: (r["status"], r["Is_New_Or_Updated"], r["IsCollect"])
           for r in M.change_detect(new, old, "k", "d", ["IsCollect"]).collect()}
    assert out == {1: ("unchanged", False, False), 2: ("updated", True, True), 4: ("new", True, True)}
    full = {r["k"]: r["status"] for r in M.change_detect(new, old, "k", "d", ["IsCollect"], removed=True).collect()}
    assert full[3] == "removed"


def test_versioned_rewrite_of_table_being_read(spark, tmp_dir):
    path = os.path.join(tmp_dir, "master")
    cur = spark.read.parquet(IO.rewrite(spark.range(5).withColumn("v", F.lit("a")), path + "/1"))
    got = spark.read.parquet(IO.rewrite(cur.withColumn("v", F.lit("b")), path + "/2")).collect()
    assert len(got) == 5 and {r["v"] for r in got} == {"b"} and {r["v"] for r in cur.collect()} == {"a"}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):   # a second writer of the same target
        IO.rewrite(cur, path + "/2")
    assert spark.read.parquet(IO.clear_table(spark, path + "/3", cur.schema)).count() == 0


def test_missing_path_is_empty(spark, tmp_dir):
    df = IO.load_parquet(spark, os.path.join(tmp_dir, "nope"), "a string")
    assert df.count() == 0 and df.columns == ["a"]


def test_csv_bom_export_and_reads(spark, tmp_dir):
    out = os.path.join(tmp_dir, "export")
    IO.export_csv_bom(spark.createDataFrame([("가", 1)], "`등록일자` string, n int"), out, single_file=True)
    part = [f for f in os.listdir(out) if f.startswith("part-")][0]
    data = open(os.path.join(out, part), "rb").read()
    assert data.startswith(b"\xef\xbb\xbf")
    back = IO.read_csv_strings(spark, out)
    assert back.columns == ["등록일자", "n"]
    tsv = os.path.join(tmp_dir, "c.tsv")
    with open(tsv, "w", encoding="utf-8") as f:
        f.write("English\tKorean\tISO2\tISO3\tNum\nNamibia\t나미비아\tNA\tNAM\t516\nChad\t차드\t\tTCD\t148\n")
    c = IO.read_tsv(spark, tsv, ["en", "ko", "iso2", "iso3", "num"]).collect()
    assert c[0]["iso2"] == "NA" and c[1]["iso2"] == ""


def test_envelope_pages(spark, tmp_dir):
    p = os.path.join(tmp_dir, "pages")
    os.makedirs(p)
    pages = ['{"I2620": {"row": [{"PRDTNM": "a"}, {"PRDTNM": "b"}]}, "RESULT": {"MSG": "ok"}}',
             '{"I2620": {"row": []}}', '{"RESULT": {"MSG": "no data"}}']
    for i, t in enumerate(pages):
        open(os.path.join(p, f"{i}.json"), "w").write(t)
    from pyspark.sql import types as T
    rows = IO.read_envelope(spark, p, "I2620", T.StructType([T.StructField("PRDTNM", T.StringType())])).collect()
    assert sorted(r["PRDTNM"] for r in rows) == ["a", "b"]


def test_csv_bom_every_part(spark, tmp_dir):
    out = os.path.join(tmp_dir, "export_parts")
    IO.export_csv_bom(spark.range(100).repartition(3).selectExpr("id AS `번호`"), out)
    parts = [f for f in os.listdir(out) if f.startswith("part-")]
    assert len(parts) == 3
    assert all(open(os.path.join(out, f), "rb").read().startswith(b"\xef\xbb\xbf") for f in parts)


def test_cp949_csv(spark, tmp_dir):
    p = os.path.join(tmp_dir, "cp949.csv")
    with open(p, "wb") as f:
        f.write("Alert_No,IsCollect\n99-01,true\n수입-02,no\n".encode("cp949"))
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        rows = IO.read_csv_strings(spark, p, encoding="x-windows-949").collect()
    finally:
        spark.conf.unset("spark.sql.legacy.javaCharsets")
    assert [(r["Alert_No"], r["IsCollect"]) for r in rows] == [("99-01", "true"), ("수입-02", "no")]


def test_hub_append_restricted_to_the_batch_partitions(spark, tmp_dir):
    hub = os.path.join(tmp_dir, "phub")
    rows = [(f"2024-01-0{d}", "FDA", f"A-{d}-{i}", None, None, None) for d in range(1, 6) for i in range(3)]
    IO.append(_notices(spark, rows).withColumn("day", F.col("registration_date")), hub, ["day"])
    batch = _notices(spark, [("2024-01-03", "FDA", "A-3-0", None, None, None), ("2024-01-03", "FDA", "new", None, None, None)])
    out = M.hub_append(batch.withColumn("day", F.col("registration_date")), spark.read.parquet(hub), partition_col="day")
    assert [r["source_detail"] for r in out.collect()] == ["new"]
    assert [r["source_detail"] for r in M.hub_append(batch, spark.read.parquet(hub)).collect()] == ["new"]


def _ids(spark, root):
    return sorted(r["id"] for r in IO.read_current(spark, root, "id long").collect())


def test_pointer_swaps_only_whole_versions(spark, tmp_dir, monkeypatch):
    root = os.path.join(tmp_dir, "master")
    assert IO.current_version(spark, root) == (0, None) and _ids(spark, root) == []
    assert IO.publish(spark.range(3), root) == 1 and _ids(spark, root) == [0, 1, 2]
    # a crash after the data is written and before the swap
    with monkeypatch.context() as m:
        m.setattr(IO, "rewrite", lambda *a: (_ for _ in ()).throw(RuntimeError("executor lost")))
        with pytest.raises(RuntimeError):
            IO.publish(spark.range(9), root)
    IO.rewrite(spark.range(9), f"{root}/data/orphan")
    assert IO.current_version(spark, root)[0] == 1 and _ids(spark, root) == [0, 1, 2]
    # a crash while the pointer is being written
    open(f"{root}/versions/2", "w").close()
    assert _ids(spark, root) == [0, 1, 2]
    # the next state may be computed from the current one
    assert IO.publish(IO.read_current(spark, root).where("id > 0"), root) == 3
    assert _ids(spark, root) == [1, 2] and IO.current_version(spark, root)[0] == 3


def test_second_of_two_writers_of_a_version_fails(spark, tmp_dir, monkeypatch):
    root = os.path.join(tmp_dir, "master")
    IO.publish(spark.range(1), root)
    real = IO.rewrite

    def slow(df, target, compression="snappy"):
        real(df, target, compression)
        monkeypatch.setattr(IO, "rewrite", real)
        IO.publish(spark.range(5), root)  # another writer, begun from the same version, is faster

    monkeypatch.setattr(IO, "rewrite", slow)
    with pytest.raises(IO.LostRace):
        IO.publish(spark.range(7), root)
    assert _ids(spark, root) == [0, 1, 2, 3, 4]


def _buckets_read(df):
    """Buckets whose files the rows come from: the filter is on the folders' column, so the others' aren't opened."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [_bucket" in plan or "PartitionFilters: [isnotnull(_bucket" in plan
    files = df.select(F.input_file_name().alias("f")).distinct().collect()
    return sorted({r["f"].split("_bucket=")[1].split("/")[0] for r in files})


def test_one_changed_row_reads_one_bucket(spark, tmp_dir):
    rows = [(i, f"n{i}" if i % 5 else None, None if i % 7 == 0 else "x") for i in range(500)]
    old = spark.createDataFrame(rows, "k long, a string, b string")
    paths = [os.path.join(tmp_dir, x) for x in ("old", "same", "one")]
    M.write_snapshot(old, paths[0], "k", ["a", "b"], 16)
    M.write_snapshot(old.orderBy(F.desc("k")).repartition(5), paths[1], "k", ["a", "b"], 16)
    changed = old.withColumn("b", F.when(F.col("k") == 78, F.lit(None).cast("string")).otherwise(F.col("b"))) \
        .withColumn("a", F.when(F.col("k") == 78, F.lit("x")).otherwise(F.col("a")))
    M.write_snapshot(changed, paths[2], "k", ["a", "b"], 16)
    same = M.snapshot_diff_stored(spark, paths[0], paths[1], "k", ["a", "b"])
    assert same.collect() == [] and M.differing_buckets(*(spark.read.parquet(f"{p}/digests") for p in paths[:2])) == []
    df = M.snapshot_diff_stored(spark, paths[0], paths[2], "k", ["a", "b"])
    assert [(r["k"], r["side"], r["changed"]) for r in df.collect()] == [(78, "both", ["a", "b"])]
    found = M.differing_buckets(spark.read.parquet(f"{paths[0]}/digests"), spark.read.parquet(f"{paths[2]}/digests"))
    assert len(found) == 1 and _buckets_read(M._rows_of(spark, paths[0], found)) == [str(found[0])]
    swapped = spark.createDataFrame([(1, None, "x")], "k long, a string, b string")
    assert M.differing_buckets(M.bucket_digests(swapped, "k", ["a", "b"]), M.bucket_digests(swapped.select("k", F.col("b").alias("a"), F.col("a").alias("b")), "k", ["a", "b"]))


def test_changes_since_a_stored_index(spark, tmp_dir):
    old = spark.createDataFrame([(i, "2024-01-01", i % 2 == 0) for i in range(100)], "k long, d string, keep boolean")
    path = M.write_snapshot(old, os.path.join(tmp_dir, "index"), "k", ["d"], 8)
    new = spark.createDataFrame([(i, "2024-02-01" if i == 3 else "2024-01-01", True) for i in range(1, 101)], "k long, d string, keep boolean")
    got = sorted((r["k"], r["status"], r["keep"]) for r in M.changes_since(new, path, "k", "d", ["keep"], 8, removed=True).collect())
    assert got == [(0, "removed", True), (3, "updated", False), (100, "new", True)]
