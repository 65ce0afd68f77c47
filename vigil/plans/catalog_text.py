"""Query catalogue, part 3: ordered text, HTML pages, date and origin parsing,
JSON envelopes, sinks and the incremental (streaming) append."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T_

from vigil.functions import text as X
from vigil.operators import merge as M
from vigil.operators import segment as S
from vigil.plans.catalog import T, query
from vigil.schema import UNIFIED_SCHEMA, enforce_schema
from vigil.session import scratch_path
from vigil.sources import html as H
from vigil.sources import io as IO
from vigil.streaming.hub_stream import start_hub_stream


# ===================================================================== ordered text

@query
def block_segment(spark, sf):
    """W4 + A16 + F12: conversations as record streams: system turns are
    headers, user turns open records, short assistant turns (< 200 characters) are date lines
    (last wins), other assistant turns are content."""
    c = T(spark, sf, "conversations")
    lines = c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("pos"),
                     X.strip_ws(F.col("text")).alias("line"), "role")
    is_date = (F.col("role") == "assistant") & (F.length("line") < 200)
    return S.segment_blocks(lines, F.col("role") == "system", F.col("role") == "user", is_date, F.col("pos"))


@query
def nearest_header(spark, sf):
    """Value of each user's latest signup at or before every event."""
    e = T(spark, sf, "events").select("event_id", "user_id", "ts", "event_type", "value")
    out = S.nearest_preceding(e, "user_id", "ts", "event_id", F.col("event_type") == "signup", F.col("value"),
                              F.to_date("ts"), slot=F.floor(F.expr("hour(ts) * 4 + minute(ts) / 15")))
    return out.select("event_id", "header_value")


@query
def line_neighbors(spark, sf):
    """Around the first short line of each document: the line above, the
    lines below and all lines but the anchor."""
    return S.line_neighbors(T(spark, sf, "documents"), "doc_id", "text",
                            lambda line, pos: (F.length(line) < 60) & (pos > 0) & (line != ""))


# ===================================================================== HTML

@query
def html_blocks(spark, sf):
    """IO8: pages to ordered text lines with heading marks."""
    return H.html_lines(T(spark, sf, "pages"), "page_id", "html")


@query
def html_links(spark, sf):
    """IO10 + S20: links of every page with absolute URLs."""
    return H.html_links(T(spark, sf, "pages"), "page_id", "html", "url")


# ===================================================================== scalar parsing

@query
def date_formats(spark, sf):
    """S1-S6 + F16: order dates rendered per source format (plus broken ones)
    and parsed back by the matching source parser; unparsable -> rejected."""
    o = T(spark, sf, "orders")
    pr = F.col("o_orderpriority")
    d = F.col("o_orderdate")
    raw = (F.when(pr == "1-URGENT", F.date_format(d, "yyyy-MM-dd"))
           .when(pr == "2-HIGH", F.date_format(d, "yyyy.MM.dd"))
           .when(pr == "3-MEDIUM", F.date_format(d, "yyyyMMdd"))
           .when(pr == "4-NOT SPECIFIED", F.date_format(d, "dd/MM/yyyy"))
           .otherwise(F.concat(F.lit("Published "), F.date_format(d, "M/d/yyyy"), F.lit(" ok"))))
    raw = F.when((F.col("o_orderstatus") == "P") & pr.isin("1-URGENT", "3-MEDIUM"), F.concat(raw, F.lit("x"))) \
        .otherwise(raw)
    r = o.select("o_orderkey", pr.alias("fmt"), raw.alias("raw"))
    f = F.col("fmt")
    parsed = (F.when(f == "1-URGENT", X.parse_date_multi(F.col("raw")))
              .when(f == "2-HIGH", X.parse_date_multi(X.dotted_to_dashed(F.col("raw"))))
              .when(f == "3-MEDIUM", X.compact_date(F.col("raw")))
              .when(f == "4-NOT SPECIFIED", X.day_first_date(F.col("raw")))
              .otherwise(X.us_date_in_text(F.col("raw"))))
    return r.select("o_orderkey", "raw", parsed.alias("parsed"), parsed.isNull().alias("rejected"))


@query
def origin_extract(spark, sf):
    """Origin country from free text by two patterns in order, default 'Overseas'."""
    c = T(spark, sf, "customer")
    n = T(spark, sf, "nation")
    seg = F.col("c_mktsegment")
    name = F.initcap("n_name")
    txt = (F.when(seg == "HOUSEHOLD", F.concat(F.lit("회수 -지역: "), name, F.lit(" - 제품: 과자")))
           .when(seg == "MACHINERY", F.concat(F.lit("제품 과자 지역 : "), name, F.lit(", 수입")))
           .when(seg == "BUILDING", F.concat(F.lit("지역:  "), name))
           .when(seg == "FURNITURE", F.lit("지역:   - 제품: 과자"))
           .otherwise(F.concat(F.lit("원산지: "), name)))
    j = c.join(n, c.c_nationkey == n.n_nationkey)
    return j.select("c_custkey", X.origin_from_text(txt).alias("origin"))


@query
def json_envelope(spark, sf):
    """IO7: API pages (one per event) in the service envelope; empty and
    "no data" pages give no rows."""
    e = T(spark, sf, "events")
    row = F.to_json(F.struct(F.col("event_id"), F.col("props").alias("PRDTNM")))
    page = (F.when(F.col("event_type") == "signup", F.lit('{"RESULT": {"MSG": "no data"}}'))
            .when(F.col("event_type") == "view", F.lit('{"I2620": {"row": []}, "RESULT": {"MSG": "ok"}}'))
            .otherwise(F.concat(F.lit('{"I2620": {"row": ['), row, F.lit(']}, "RESULT": {"MSG": "ok"}}'))))
    row_schema = T_.StructType([T_.StructField("event_id", T_.LongType()), T_.StructField("PRDTNM", T_.StringType())])
    env = T_.StructType([
        T_.StructField("I2620", T_.StructType([T_.StructField("row", T_.ArrayType(row_schema))])),
        T_.StructField("RESULT", T_.StructType([T_.StructField("MSG", T_.StringType())])),
    ])
    pages = e.select(F.from_json(page, env).alias("p")).select("p.*")
    rows = IO.explode_envelope(pages, "I2620")
    return rows.select("event_id", F.get_json_object("PRDTNM", "$.k").cast("long").alias("k"))


# ===================================================================== sinks


def _write_runs(spark, sf):
    o = T(spark, sf, "orders")
    path = scratch_path(spark, "runs")
    early = o.where(F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz"))
    late = o.where(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    IO.append(early.withColumn("run_id", F.lit("r1")), path, ["run_id"])
    IO.append(late.withColumn("run_id", F.lit("r2")), path, ["run_id"])
    return path


@query
def append_all(spark, sf):
    """IO13 + IO15: two appends into run-partitioned Parquet, read back whole."""
    path = _write_runs(spark, sf)
    return spark.read.parquet(path).select("o_orderkey", "o_custkey", "o_orderstatus", "run_id")


@query
def hub_load(spark, sf):
    """IO2: hub scan keeping the known columns that exist (pruned in the scan)."""
    path = _write_runs(spark, sf)
    return IO.load_hub(spark, path, ["o_orderkey", "o_totalprice", "not_a_column"])


@query
def versioned_rewrite(spark, sf):
    """IO14 + J7: a master table whose next state is computed from itself and written beside it."""
    s = T(spark, sf, "supplier")
    path = scratch_path(spark, "master")
    cur = spark.read.parquet(IO.rewrite(s.withColumn("IS_MANUAL_FIXED", F.col("s_acctbal") < 0), path + "/1"))
    new = s.select("s_suppkey", F.upper("s_name").alias("s_name"), "s_nationkey",
                   (F.col("s_acctbal") + 1).alias("s_acctbal"), F.lit(False).alias("IS_MANUAL_FIXED"))
    return spark.read.parquet(IO.rewrite(M.pinned_merge(new, cur, "s_suppkey"), path + "/2")).select("s_suppkey", "s_name", "s_acctbal", "IS_MANUAL_FIXED")


# ===================================================================== incremental

def _event_notices(df):
    return enforce_schema(df.select(F.col("day").alias("registration_date"), F.col("event_type").alias("data_source"),
                                    F.concat(F.lit("U-"), F.col("user_id")).alias("source_detail")))


@query
def stream_append(spark, sf):
    """Landed event files -> Structured Streaming (available-now trigger)
    -> per micro-batch anti-join against the hub and append.  Re-running adds
    nothing; the result equals the batch ``distinct`` of the keys."""
    base = scratch_path(spark, "stream")
    landing, hub, ckpt = base + "/landing", base + "/hub", base + "/checkpoint"
    e = T(spark, sf, "events").withColumn("day", F.to_date("ts"))
    e.write.partitionBy("day").parquet(landing)
    sch = T_.StructType(T(spark, sf, "events").schema.fields + [T_.StructField("day", T_.DateType())])
    src = spark.readStream.schema(sch).option("maxFilesPerTrigger", 16).parquet(landing)
    start_hub_stream(spark, src, _event_notices, hub, ckpt).awaitTermination()
    return IO.load_parquet(spark, hub, UNIFIED_SCHEMA).select("data_source", "source_detail", "registration_date")


@query
def filtered_append(spark, sf):
    """J1 + T1 with key filters: the events of the first half of users are the hub, all events arrive as a batch
    (every day is there already, half of the keys are), and once more as a replay that adds nothing."""
    from vigil.operators import key_filter
    from vigil.operators.match import materialize
    base = scratch_path(spark, "filtered")
    keys = ["event_type", "user_id", "day"]
    e = T(spark, sf, "events").select("event_type", F.col("user_id").cast("string").alias("user_id"), F.to_date("ts").cast("string").alias("day"))
    known = e.where("xxhash64(user_id) >= 0").distinct()
    known.write.partitionBy("day").parquet(base + "/hub")
    batch = materialize(e)
    first, again = (key_filter.append_unseen(batch, base + "/hub", e.schema, base + "/filters", keys, "day") for _ in range(2))
    return IO.load_parquet(spark, base + "/hub", e.schema).select(*keys).withColumn("added_again", F.lit(again))


@query
def run_log(spark, sf):
    """IO13 + IO17: row counts returned by two appends (observed while
    writing, no second scan), as run-report rows."""
    o = T(spark, sf, "orders")
    path = scratch_path(spark, "runlog")
    early = o.where(F.col("o_orderdate") < F.lit("1995-01-01").cast("timestamp_ntz"))
    late = o.where(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    reports = [IO.run_report(spark, "orders", IO.append(df, path), run_id=rid)
               for rid, df in (("r1", early), ("r2", late))]
    return reports[0].unionByName(reports[1]).select("run_id", "source", "n_rows")


@query
def capped_listing(spark, sf):
    """L3: display listing capped at 5,000 rows in key order, with the
    'limited' flag telling whether more rows exist (only cap + 1 rows are
    pulled for the test)."""
    from vigil.operators.metrics import capped
    li = T(spark, sf, "lineitem").where(F.col("l_returnflag") == "R")
    rows, limited = capped(li.select("l_orderkey", "l_linenumber", "l_quantity"), 5000,
                           ["l_orderkey", "l_linenumber"])
    return rows.withColumn("limited", F.lit(limited))
