"""Ordered-text operators (W4-W6, A16): lines as rows ``(doc, pos, text)``.

Windows hold a piece of a document or key at most, never
all rows.  The nearest-preceding-header operator over an open-ended key (a user
with a third of all events) cuts the key's rows by place into pieces, whose last
values are carried on through compact tables, so no window holds a hot key's rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.text import strip_ws


def to_lines(df: DataFrame, doc_col: str, text_col: str, sep: str = r"\r?\n") -> DataFrame:
    """Text -> ``(doc, pos, line)`` rows (``posexplode``), lines stripped."""
    return df.select(F.col(doc_col).alias("doc"), F.posexplode(F.split(F.col(text_col), sep)).alias("pos", "raw")) \
        .select("doc", "pos", strip_ws(F.col("raw")).alias("line"))


def ordered_join(values: Column, order: Column, sep: str = "\n") -> Column:
    """Aggregate - join values in ``order`` (nulls skipped)."""
    s = F.array_sort(F.collect_list(F.when(values.isNotNull(), F.struct(order.alias("o"), values.alias("v")))))
    return F.array_join(F.transform(s, lambda x: x["v"]), sep)


# Lines of a document that one window holds.
PIECE = 4096


def segment_blocks(lines: DataFrame, is_header: Column, is_code: Column, is_date: Column,
                   date_value: Column, doc: str = "doc", pos: str = "pos", text: str = "line", piece: int = PIECE) -> DataFrame:
    """Gaps-and-islands record segmentation.

    * a header line sets the current header (country) and closes any record;
    * a code line opens a record (code test has priority over the date test);
    * a date line sets the record's date (last one wins) and is not content;
    * other non-empty lines are content of the open record;
    * lines before the first code of a header section are dropped, and so is
      everything before the first header of a document.

    A document's lines are cut into pieces of ``piece`` places, so no window holds more and a very long
    document is spread over tasks; block numbers and headers are carried over the pieces through one row each.
    Content is joined per block.

    Returns ``(doc, block, header, opener, date, content, n_lines)``."""
    t = lines.where(F.col(text).isNotNull() & (F.col(text) != ""))
    kind = (F.when(is_header, F.lit("header")).when(is_code, F.lit("code"))
            .when(is_date, F.lit("date")).otherwise(F.lit("content")))
    t = t.withColumn("_kind", kind)
    t = t.withColumn("_piece", F.floor(F.col(pos) / piece))
    so_far = Window.partitionBy(doc, "_piece").orderBy(pos).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.when(F.col("_kind").isin("header", "code"), 1).otherwise(0)
    header = F.when(F.col("_kind") == "header", F.col(text))
    t = t.withColumn("_opened", F.sum(opens).over(so_far)).withColumn("_header", F.last(header, ignorenulls=True).over(so_far))
    # a piece's state, what it opens and its last header, is put behind the states of the pieces before it
    state = t.groupBy(doc, "_piece").agg(F.sum(opens).alias("_opens"), F.max_by(header, F.when(header.isNotNull(), F.col(pos))).alias("_last"))
    before = Window.partitionBy(doc).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    state = state.select(doc, "_piece", F.coalesce(F.sum("_opens").over(before), F.lit(0)).alias("_before"),
                         F.last("_last", ignorenulls=True).over(before).alias("_carried"))
    t = t.alias("t").join(state.alias("s"), F.col(f"t.{doc}").eqNullSafe(F.col(f"s.{doc}")) & (F.col("t._piece") == F.col("s._piece"))) \
        .select("t.*", "s._before", "s._carried")
    t = t.withColumn("block", F.col("_before") + F.col("_opened")).withColumn("header", F.coalesce("_header", "_carried"))
    g = t.groupBy(doc, "block").agg(
        F.min_by(F.col("_kind"), F.col(pos)).alias("_open_kind"),
        F.min_by(F.col(text), F.col(pos)).alias("opener"),
        F.min_by(F.col("header"), F.col(pos)).alias("header"),
        F.max_by(F.when(F.col("_kind") == "date", date_value), F.when(
            (F.col("_kind") == "date") & date_value.isNotNull(), F.col(pos))).alias("date"),
        ordered_join(F.when(F.col("_kind") == "content", F.col(text)), F.col(pos)).alias("content"),
        F.count_if(F.col("_kind") == "content").alias("n_lines"),
    )
    return g.where((F.col("_open_kind") == "code") & F.col("header").isNotNull()).drop("_open_kind")


def nearest_preceding(df: DataFrame, key: str, order_col: str, tie_col: str, is_header: Column,
                      value: Column, bucket: Column, out_col: str = "header_value", slot: Column | None = None) -> DataFrame:
    """For every row, ``value`` of the last header row at or before it
    (same ``key``, ordered by ``(order_col, tie_col)``).

    Segmented scan: a key's rows are cut by place into buckets (``bucket``, e.g. the day) and these into slots (``slot``,
    e.g. the quarter of an hour), both ascending with the order.  A piece is a (key, bucket, slot) and is the only thing a
    window holds, so a key's busiest bucket is spread over as many tasks as it has slots.  Each piece's last header is carried
    on to the slots behind it in its bucket, then each bucket's to the buckets behind it, through tables of one row a piece
    and one row a bucket; a row takes the last header of its piece so far, else its bucket's before the piece, else
    its key's before the bucket."""
    d = df.withColumn("_b", bucket).withColumn("_s", slot if slot is not None else F.lit(0)) \
        .withColumn("_h", F.when(is_header & value.isNotNull(), F.struct(value.alias("v"))))
    so_far = Window.partitionBy(key, "_b", "_s").orderBy(order_col, tie_col).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_in", F.last("_h", ignorenulls=True).over(so_far))
    before = Window.unboundedPreceding, -1
    place = F.struct(F.col(order_col), F.col(tie_col))
    pieces = d.groupBy(key, "_b", "_s").agg(F.max_by("_h", F.when(F.col("_h").isNotNull(), place)).alias("_last"))
    buckets = pieces.groupBy(key, "_b").agg(F.max_by("_last", F.when(F.col("_last").isNotNull(), F.col("_s"))).alias("_last"))
    of_bucket = F.last("_last", ignorenulls=True).over(Window.partitionBy(key).orderBy("_b").rowsBetween(*before))
    of_piece = F.last("_last", ignorenulls=True).over(Window.partitionBy(key, "_b").orderBy("_s").rowsBetween(*before))

    def same(left: str, right: str, *cols: str) -> Column:
        return reduce(lambda x, y: x & y, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in cols])

    carry = pieces.withColumn("_piece", of_piece).alias("p") \
        .join(buckets.withColumn("_bucket", of_bucket).alias("q"), same("p", "q", key, "_b")) \
        .select(f"p.{key}", "p._b", "p._s", F.coalesce("_piece", "_bucket").alias("_prev"))
    out = d.alias("d").join(carry.alias("c"), same("d", "c", key, "_b", "_s"), "left").select("d.*", "c._prev")
    return out.withColumn(out_col, F.coalesce("_in", "_prev")["v"]).drop("_b", "_s", "_h", "_in", "_prev")


def line_neighbors(df: DataFrame, doc_col: str, text_col: str, is_anchor, sep: str = r"\r?\n",
                   glue: str = " ") -> DataFrame:
    """Around the first anchor line of each document: the line above it
    (product), the non-empty lines below it joined by ``glue`` (description)
    and all non-empty lines but the anchor joined likewise (full text).

    Runs inside each row on the document's line array (``is_anchor(line,
    pos)`` -> Column), so no line is exploded or shuffled; documents without
    an anchor give no row."""
    arr = F.transform(F.split(F.col(text_col), sep), lambda x: strip_ws(x))
    hits = F.filter(F.transform("_l", lambda x, i: F.when(is_anchor(x, i), i)), lambda v: v.isNotNull())
    t = df.select(F.col(doc_col).alias("doc"), arr.alias("_l")).withColumn("_ap", F.try_element_at(hits, F.lit(1))) \
        .where(F.col("_ap").isNotNull())
    ap = F.col("_ap")

    def keep(pred):
        return F.array_join(F.filter(F.transform("_l", lambda x, i: F.when(pred(x, i) & (x != ""), x)),
                                     lambda v: v.isNotNull()), glue)

    return t.select(
        "doc",
        ap.alias("anchor_pos"),
        F.try_element_at("_l", ap + 1).alias("anchor"),
        F.when(ap > 0, F.try_element_at("_l", ap)).alias("above"),
        keep(lambda x, i: i > ap).alias("below"),
        keep(lambda x, i: i != ap).alias("full_text"),
    )
