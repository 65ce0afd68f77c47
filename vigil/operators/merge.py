"""Key-based merges, deduplication and patches (J1, J2, J7-J10, J16, J17,
U1-U5, W1-W3).

All are joins on keys: Spark shuffles both sides by key (or broadcasts a side
whose size the planner knows to be small), so nothing funnels through the
driver or a single task.  ``first``/``last`` per key use ``min_by``/``max_by``
aggregates (partial aggregation before the shuffle, no sort, and a hot key
costs one partial row per task, not one huge window partition).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import record_id

HUB_KEYS = ["data_source", "source_detail", "registration_date"]


def _struct_of(cols):
    return F.struct(*[F.col(c) for c in cols])


# ------------------------------------------------------------------ W1-W3

def first_per_key(df: DataFrame, keys: list, order_col: str) -> DataFrame:
    """Keep the first row (smallest ``order_col``) per key."""
    rest = [c for c in df.columns if c not in keys]
    agg = F.min_by(_struct_of(rest), F.col(order_col)).alias("_w")
    return df.groupBy(*keys).agg(agg).select(*keys, "_w.*").select(*df.columns)


def last_per_key(df: DataFrame, keys: list, order_col: str) -> DataFrame:
    """Keep the last row (largest ``order_col``) per key."""
    rest = [c for c in df.columns if c not in keys]
    agg = F.max_by(_struct_of(rest), F.col(order_col)).alias("_w")
    return df.groupBy(*keys).agg(agg).select(*keys, "_w.*").select(*df.columns)


def row_distinct(df: DataFrame, cols: list | None = None) -> DataFrame:
    """Whole-row (or ``cols``) duplicates removed."""
    return df.dropDuplicates(cols) if cols else df.dropDuplicates()


# ------------------------------------------------------------------ J1, J2

def hub_append(incoming: DataFrame, hub: DataFrame, keys: list | None = None,
               dedup_batch: bool = False, partition_col: str | None = None) -> DataFrame:
    """Rows of ``incoming`` whose key is not in ``hub``.

    Keys are non-null after schema enforcement, so plain equality is exact.
    With ``dedup_batch`` duplicates inside the batch are also removed.  Only
    the key columns of the hub are read.  ``partition_col`` (a column of both
    sides that the key decides, by which the hub is stored) restricts the hub
    to the batch's partitions by a semi join, which prunes the scan at run
    time; nothing is collected while the plan is built."""
    k = keys or HUB_KEYS
    h = hub.select(*k, *([partition_col] if partition_col else []))
    if partition_col:
        h = h.join(incoming.select(partition_col).distinct(), on=partition_col, how="left_semi").drop(partition_col)
    new = incoming.join(h, on=k, how="left_anti")
    return new.dropDuplicates(k) if dedup_batch else new


def hash_dedup(new: DataFrame, existing: DataFrame, source_col: str, ref_col: str,
               id_col: str = "record_id") -> DataFrame:
    """J2 + U2: add ``record_id = sha256(source::ref)``; keep new rows whose id
    is unknown (null ids always count as new); return existing ∪ kept."""
    n = new.withColumn(id_col, record_id(source_col, ref_col))
    e = existing if id_col in existing.columns else existing.withColumn(id_col, record_id(source_col, ref_col))
    known = e.select(id_col).where(F.col(id_col).isNotNull()).distinct()
    fresh = n.join(known, on=id_col, how="left_anti")
    return e.unionByName(fresh, allowMissingColumns=True)


# ------------------------------------------------------------------ J7

def pinned_merge(new: DataFrame, current: DataFrame, key: str, pin_col: str = "IS_MANUAL_FIXED") -> DataFrame:
    """Keep manually pinned rows: ``pinned ∪ (new ▷ pinned on key)``.

    Without a pin column (or with no pinned row) the result is ``new``."""
    if pin_col not in current.columns:
        return new
    pinned = current.where(F.coalesce(F.col(pin_col).cast("boolean"), F.lit(False)))
    rest = new.join(pinned.select(key), on=key, how="left_anti")
    return pinned.unionByName(rest, allowMissingColumns=True)


# ------------------------------------------------------------------ J8 / T2

def change_detect(new: DataFrame, old: DataFrame, key: str, date_col: str,
                  keep_cols: list, flag_col: str = "Is_New_Or_Updated",
                  status_col: str = "status", removed: bool = False) -> DataFrame:
    """Compare a fresh index snapshot with the stored one.

    status = ``new`` (key unknown), ``updated`` (date changed) or
    ``unchanged``; ``flag_col`` = status != unchanged.  ``keep_cols`` (user
    columns such as collect flags and manual overrides) come from the old
    snapshot for known keys.  Keys gone from ``new`` vanish unless
    ``removed=True``, which adds them with status ``removed``."""
    o = old.select(key, F.col(date_col).alias("_old_date"),
                   *[F.col(c).alias(f"_old_{c}") for c in keep_cols if c in old.columns])
    how = "full" if removed else "left"
    o = o.withColumn("_known", F.lit(True))
    j = new.withColumn("_in_new", F.lit(True)).join(o, on=key, how=how)
    in_new = F.col("_in_new")
    known = F.coalesce(F.col("_known"), F.lit(False))
    status = (F.when(in_new.isNull(), F.lit("removed"))
              .when(~known, F.lit("new"))
              .when(~F.col(date_col).eqNullSafe(F.col("_old_date")), F.lit("updated"))
              .otherwise(F.lit("unchanged")))
    out = j.withColumn(status_col, status).withColumn(flag_col, F.col(status_col).isin("new", "updated"))
    for c in keep_cols:
        if c in old.columns:
            cur = F.col(c) if c in new.columns else F.lit(None)
            out = out.withColumn(c, F.when(known, F.col(f"_old_{c}")).otherwise(cur))
    drop = ["_in_new", "_known", "_old_date"] + [f"_old_{c}" for c in keep_cols if c in old.columns]
    return out.drop(*drop)


def work_list(changes: DataFrame, date_col: str, flag_col: str = "Is_New_Or_Updated", collect_col: str = "IsCollect") -> DataFrame:
    """What of ``change_detect``'s result needs detail work: new or updated
    and collectable (an unset flag collects), with ``Last_Updated_Date``."""
    return changes.where(F.col(flag_col) & F.coalesce(F.col(collect_col), F.lit(True))).withColumn("Last_Updated_Date", F.col(date_col))


def update_report(rows: DataFrame, key: str, changed_col: str, first: int = 5) -> DataFrame:
    """One row ``(n_changed, first_keys)``: how many rows an update has
    changed, and its ``first`` smallest keys (the limit is the feature)."""
    changed = rows.where(F.col(changed_col))
    keys = changed.select(key).orderBy(key).limit(first).agg(F.array_join(F.array_sort(F.collect_list(key)), ",").alias("first_keys"))
    return changed.agg(F.count(F.lit(1)).alias("n_changed")).select("n_changed", keys.scalar().alias("first_keys"))


# ------------------------------------------------------------------ J9, J10

def patch_non_null(base: DataFrame, patch: DataFrame, key: str, cols: list | None = None) -> DataFrame:
    """Update-join where non-null patch values win; base rows only."""
    pc = [c for c in (cols or patch.columns) if c != key and c in base.columns]
    p = patch.select(key, *[F.col(c).alias(f"_p_{c}") for c in pc])
    j = base.join(p, on=key, how="left")
    for c in pc:
        j = j.withColumn(c, F.coalesce(F.col(f"_p_{c}"), F.col(c)))
    return j.drop(*[f"_p_{c}" for c in pc]).select(*base.columns)


def patch_all(base: DataFrame, patch: DataFrame, key: str, cols: list,
              changed_col: str | None = "_changed") -> DataFrame:
    """For keys present in the patch, listed columns take the patch value
    even when it is null.  ``changed_col`` marks rows whose value changed
    (null-safe comparison); sum it for the count of changed rows."""
    pc = [c for c in cols if c != key and c in base.columns]
    p = patch.select(key, F.lit(True).alias("_hit"), *[F.col(c).alias(f"_p_{c}") for c in pc])
    j = base.join(p, on=key, how="left")
    hit = F.coalesce(F.col("_hit"), F.lit(False))
    diffs = [hit & ~F.col(c).eqNullSafe(F.col(f"_p_{c}").cast(base.schema[c].dataType)) for c in pc]
    if changed_col:
        j = j.withColumn(changed_col, reduce(lambda a, b: a | b, diffs) if diffs else F.lit(False))
    for c in pc:
        j = j.withColumn(c, F.when(hit, F.col(f"_p_{c}").cast(base.schema[c].dataType)).otherwise(F.col(c)))
    keep = base.columns + ([changed_col] if changed_col else [])
    return j.select(*keep)


# ------------------------------------------------------------------ J16

def snapshot_diff(a: DataFrame, b: DataFrame, key: str, cols: list) -> DataFrame:
    """Full outer comparison of two copies by key.

    One row per key that differs: ``side`` = only_a / only_b / both, and
    ``changed`` = array of column names whose values differ (null-safe)."""
    aa = a.select(key, F.lit(True).alias("_a"), *[F.col(c).alias(f"a_{c}") for c in cols])
    bb = b.select(key, F.lit(True).alias("_b"), *[F.col(c).alias(f"b_{c}") for c in cols])
    j = aa.join(bb, on=key, how="full")
    side = (F.when(F.col("_a").isNull(), F.lit("only_b"))
            .when(F.col("_b").isNull(), F.lit("only_a")).otherwise(F.lit("both")))
    changed = F.filter(
        F.array(*[F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), F.lit(c)) for c in cols]),
        lambda x: x.isNotNull())
    out = j.select(key, side.alias("side"), changed.alias("changed"))
    return out.where((F.col("side") != "both") | (F.size("changed") > 0))


# ------------------------------------------------------------------ J8, J16 by digests

#: Key buckets of a stored snapshot.
SNAPSHOT_BUCKETS = 256


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def bucket_digests(df: DataFrame, key: str, cols: list, buckets: int = SNAPSHOT_BUCKETS) -> DataFrame:
    """One row ``(_bucket, n, one, two)`` per key bucket: rows and two sums of row hashes over ``key`` and ``cols``,
    whatever the rows' order.  A null differs from every value."""
    parts = [x for c in (key, *cols) for x in (F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit("")))]
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *parts).cast("decimal(20,0)"))
    return _bucketed(df, key, buckets).groupBy("_bucket").agg(F.count(F.lit(1)).alias("n"), total(1).alias("one"), total(2).alias("two"))


def write_snapshot(df: DataFrame, path: str, key: str, cols: list, buckets: int = SNAPSHOT_BUCKETS) -> str:
    """Store a snapshot by key bucket, with its buckets' digests over ``cols`` beside it (written last)."""
    _bucketed(df, key, buckets).repartition("_bucket").write.mode("errorifexists").partitionBy("_bucket").parquet(f"{path}/rows")
    bucket_digests(df, key, cols, buckets).coalesce(1).write.mode("errorifexists").parquet(f"{path}/digests")
    return path


def differing_buckets(a: DataFrame, b: DataFrame) -> list[int]:
    """Buckets whose digests differ (at most as many as there are buckets)."""
    one, two = a.alias("a"), b.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("n", "one", "two")]
    rows = one.join(two, "_bucket", "full").where(~(same[0] & same[1] & same[2])).select("_bucket").collect()
    return sorted(r["_bucket"] for r in rows)


def _rows_of(spark, path: str, buckets: list[int]) -> DataFrame:
    return spark.read.parquet(f"{path}/rows").where(F.col("_bucket").isin(buckets)).drop("_bucket")


def snapshot_diff_stored(spark, a: str, b: str, key: str, cols: list) -> DataFrame:
    """J16 of two stored snapshots: digests first, then ``snapshot_diff`` of the differing buckets alone; the others
    are not read."""
    digests = [spark.read.parquet(f"{p}/digests") for p in (a, b)]
    buckets = differing_buckets(*digests)
    return snapshot_diff(_rows_of(spark, a, buckets), _rows_of(spark, b, buckets), key, cols)


def changes_since(new: DataFrame, stored: str, key: str, date_col: str, keep_cols: list, buckets: int = SNAPSHOT_BUCKETS, **kw) -> DataFrame:
    """J8 against a stored snapshot (digests over ``date_col``): ``change_detect`` of the rows that are new, updated
    or, with ``removed=True``, gone.  Of the stored snapshot only buckets whose digests differ are read and joined."""
    spark = new.sparkSession
    found = differing_buckets(spark.read.parquet(f"{stored}/digests"), bucket_digests(new, key, [date_col], buckets))
    fresh = _bucketed(new, key, buckets).where(F.col("_bucket").isin(found)).drop("_bucket")
    return change_detect(fresh, _rows_of(spark, stored, found), key, date_col, keep_cols, **kw).where("status <> 'unchanged'")


# ------------------------------------------------------------------ U1, U3

def union_sources(frames: list) -> DataFrame:
    """Union by name, missing columns null.  Empty inputs add nothing."""
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def dict_union(a: DataFrame, b: DataFrame, name_col: str, order_col: str) -> DataFrame:
    """U3 + W1 + L6: union on the common columns, first row per name, sorted."""
    common = [c for c in a.columns if c in b.columns]
    u = a.select(*common).unionByName(b.select(*common))
    return first_per_key(u, [name_col], order_col).orderBy(name_col)


# ------------------------------------------------------------------ U4, U5, J17

def crud_merge(current: DataFrame, changes: DataFrame, key: str, cols: list,
               pin_col: str = "IS_MANUAL_FIXED", insert_defaults: dict | None = None) -> DataFrame:
    """U4: apply a change table ``(key, op, cols..., pin_edited)``.

    * ``delete``: key removed (left anti join).
    * ``update``: listed columns take the change values (J10); the row is
      pinned unless the change itself set the pin column (``pin_edited``).
    * ``insert``: new rows, pinned, with ``insert_defaults`` for absent
      columns.  Inserts whose key exists are ignored (J17 semi/anti logic).

    Change rows per key are assumed unique (last edit per key; use
    ``last_per_key`` on an edit log first)."""
    dels = changes.where(F.col("op") == "delete").select(key)
    kept = current.join(dels, on=key, how="left_anti")

    upd = changes.where(F.col("op") == "update")
    upd_cols = [c for c in cols if c in current.columns and c != key]
    pin_val = F.when(F.coalesce(F.col("pin_edited"), F.lit(False)), F.col(pin_col)).otherwise(F.lit(True)) \
        if pin_col in changes.columns else F.lit(True)
    u = upd.select(key, *upd_cols, pin_val.alias(pin_col))
    updated = patch_all(kept, u, key, upd_cols + ([pin_col] if pin_col in kept.columns else []), changed_col=None)

    ins = changes.where(F.col("op") == "insert").join(current.select(key), on=key, how="left_anti")
    ins = ins.select(key, *[c for c in upd_cols if c in ins.columns]).withColumn(pin_col, F.lit(True))
    for c, v in (insert_defaults or {}).items():
        if c not in ins.columns:
            ins = ins.withColumn(c, F.lit(v))
    ins = ins.select(*[F.col(c) if c in ins.columns else F.lit(None).cast(current.schema[c].dataType).alias(c)
                       for c in current.columns])
    return updated.unionByName(ins)


def content_key(*cols) -> Column:
    """Deterministic key for a manually inserted row (SHA-256 of content)."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256)


def manual_rows(rows: DataFrame, category_col: str, master: DataFrame, code_col: str, codes: dict, content: list,
                key_col: str = "row_key") -> DataFrame:
    """Rows put in by hand, ready for ``crud_merge``: the codes of the
    chosen category (``codes``: master column -> new column), a key from the
    content, pinned and in use.  Unknown categories leave the codes null."""
    m = master.select(F.col(code_col).alias("_cat"), *[F.col(a).alias(b) for a, b in codes.items()]).dropDuplicates(["_cat"])
    return rows.join(m, rows[category_col] == m["_cat"], "left").drop("_cat").withColumns({
        key_col: content_key(*content), "IS_MANUAL_FIXED": F.lit(True), "USE_YN": F.lit("Y")})
