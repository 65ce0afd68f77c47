"""Operator 12: Merkle manifest of a dataset by lag and lead windows.

Leaves are numbered within their group, and a group's nodes are cut into blocks of
``fanout ** levels`` places, so no window ever holds a whole group.  One climb takes a block
up by ``levels`` levels without moving a row: at each level a node is known by its first
row, its run's other nodes stand at fixed offsets before and behind it, and ``lag`` / ``lead``
columns, masked by the node's slot and its run's length, supply the siblings.  A run's first
row hashes the parent.  What is left of each block climbs again, until one node a group
remains; the groups' nodes make a tree of their own.  Siblings come down again by joins on
(group, block), so each leaf carries its whole proof, which is folded from its own digest.

Texts are hashed where they are read; only digests are shuffled.

Defined cases: a null in any column is ``-``; an empty text is ``0:``; any id may be null
(first) or repeat (ordered by the leaf's digest; equal leaves are interchangeable); a group
of one row is its own subroot and one group is the root; no rows give no rows; further
columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.common import written

FANOUT = 2
#: Rows of a block at most.
BLOCK = 4096
COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def part(value: Column) -> Column:
    """``-`` for null, else the UTF-8 byte count, ``:`` and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*texts: Column) -> Column:
    """Lowercase hex SHA-256 of the texts one after the other."""
    return F.sha2(F.concat(*texts), 256)


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``pos``, their place from 0 within group ``g`` by ``order``, and ``n``, the group's size.

    Rows are cut into ranges of (g, order), each range sorted by its own task; a group's places in a range start
    where its rows in the ranges before end.  The range of a row is stored with it, so nothing is cut twice."""
    cut = nodes.repartitionByRange("g", *order).sortWithinPartitions("g", *order)
    cut = written(cut.withColumn("_at", F.monotonically_increasing_id())).withColumn("_range", F.shiftright("_at", 33))
    runs = cut.groupBy("_range", "g").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    group = Window.partitionBy("g")  # one row for each range
    runs = runs.withColumn("n", F.sum("_rows").over(group)) \
        .withColumn("_before", F.sum("_rows").over(group.orderBy("_range")) - F.col("_rows"))
    return cut.join(runs, ["_range", "g"]).withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")) \
        .drop("_range", "_at", "_first", "_rows", "_before")


def climb(nodes: DataFrame, fanout: int, levels: int) -> DataFrame:
    """``nodes`` (g, pos, n, h) with ``block``, ``h`` replaced by the digest that the block's first row has after
    ``levels`` levels, and ``path``: what stands left and right of each node on the way there, bottom up."""
    block = Window.partitionBy("g", "block").orderBy("pos")
    df = nodes.withColumn("block", F.expr(f"pos div {fanout ** levels}"))
    others = range(1, fanout)
    sides = []
    for level in range(levels):
        step = fanout ** level
        df = df.withColumns({f"_lag{o}": F.lag("h", o * step).over(block) for o in others}
                            | {f"_lead{o}": F.lead("h", o * step).over(block) for o in others})
        node, count = F.expr(f"pos div {step}"), F.expr(f"(n + {step - 1}) div {step}")
        slot = node % fanout
        run = F.least(F.lit(fanout), count - node + slot)
        left = F.concat(*[F.when(slot >= o, F.col(f"_lag{o}")).otherwise("") for o in reversed(others)])
        right = F.concat(*[F.when(slot + o < run, F.col(f"_lead{o}")).otherwise("") for o in others])
        first, more = F.col("pos") % step == 0, F.col("n") > step
        df = df.withColumn(f"_side{level}", F.when(first & more, F.struct(left.alias("left"), right.alias("right"))))
        parent = F.when(more, digest(F.col("h"), F.col(f"_side{level}.right"))).otherwise(F.col("h"))
        df = df.withColumn("h", F.when(F.col("pos") % (step * fanout) == 0, parent)) \
            .drop(*[f"_lag{o}" for o in others], *[f"_lead{o}" for o in others])
        sides.append(f"_side{level}")
    # a node's first row is the last one before a leaf that has the node's siblings
    so_far = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = df.withColumns({s: F.last(s, ignorenulls=True).over(so_far) for s in sides})
    return df.withColumn("path", F.array_compact(F.array(*sides))).drop(*sides)


def ascend(nodes: DataFrame, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Every climb of the groups' trees, and (g, h): each group's last node."""
    levels = 1
    while fanout ** (levels + 1) <= BLOCK:
        levels += 1
    size, most, climbs = fanout ** levels, nodes.agg(F.max("n")).first()[0] or 1, []
    while True:
        climbs.append(climb(nodes, fanout, levels))
        top = climbs[-1].where(F.col("pos") % size == 0) \
            .select("g", F.col("block").alias("pos"), F.expr(f"(n + {size - 1}) div {size}").alias("n"), "h")
        if most <= size:
            return climbs, top.select("g", "h")
        nodes, most = written(top), -(-most // size)


def descend(climbs: list[DataFrame], above: DataFrame) -> DataFrame:
    """The lowest climb's rows with their whole ``path``, continued by that of ``above`` (g, path and what else the
    rows of a group are to carry)."""
    extra = [c for c in above.columns if c not in ("g", "path")]
    above = above.withColumn("block", F.lit(0).cast("long"))
    for k, rows in reversed(list(enumerate(climbs))):
        up = above.select("g", "block", F.col("path").alias("_up"), *extra)
        above = rows.drop("h").join(up, ["g", "block"]).withColumn("path", F.concat("path", "_up")).drop("_up", "block")
        if k:
            above = above.select("g", F.col("pos").alias("block"), "path", *extra)
    return above


def fold(start: Column, path: Column) -> Column:
    """The root that a leaf's digest and its siblings give."""
    return F.aggregate(path, start, lambda h, side: digest(side["left"], h, side["right"]))


def proof(path: Column) -> Column:
    """Digest of a path's siblings, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda side: F.concat(side["left"], side["right"])), ""), 256)


def manifest(docs: DataFrame, id_col: str, group_col: str, columns: list[str], carry: dict[str, Column] | None = None,
             fanout: int = FANOUT) -> DataFrame:
    """One row per row of ``docs``: ``id_col``, ``leaf``, ``subroot``, ``root``, ``path`` and the columns of ``carry``,
    which are computed where the texts are read.

    ``leaf`` hashes ``columns``; leaves ascend by ``id_col`` within ``group_col``, subroots by group (null first)."""
    if fanout < 2:
        raise ValueError("a run has two nodes at least")
    carry = carry or {}
    group = F.when(F.col(group_col).isNull(), "-").otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    leaves = written(docs.select(group.alias("g"), F.col(id_col).alias("_id"), digest(*[part(F.col(c)) for c in columns]).alias("h"),
                                 *[v.alias(f"_carry_{k}") for k, v in carry.items()], F.monotonically_increasing_id().alias("_row")))
    placed = numbered(leaves, ["_id", "h", "_row"])
    climbs, subroots = ascend(placed.withColumn("leaf", F.col("h")), fanout)
    groups = numbered(written(subroots.select(F.lit("").alias("g"), F.col("g").alias("_of"), "h")), ["_of"])
    group_climbs, roots = ascend(groups.withColumn("subroot", F.col("h")), fanout)
    whole = descend(group_climbs, roots.select("g", F.col("h").alias("root"), F.array().cast("array<struct<left:string,right:string>>").alias("path")))
    rows = descend(climbs, whole.select(F.col("_of").alias("g"), "path", "subroot", "root"))
    return rows.select(F.col("_id").alias(id_col), "leaf", "subroot", "root", "path", *[F.col(f"_carry_{k}").alias(k) for k in carry])


def tampered(docs: DataFrame) -> DataFrame:
    """The manifest of documents, checked after the ``n_chars`` of every row whose id's crc32 7 divides grew by 1."""
    changed = F.when(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    found = digest(*[part(changed if c == "n_chars" else F.col(c)) for c in COLUMNS])
    rows = manifest(docs, "doc_id", "lang", COLUMNS, {"found": found})
    folded = rows.withColumn("folded_root", fold(F.col("found"), F.col("path")))
    return folded.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), "folded_root",
                         (F.col("folded_root") == F.col("root")).alias("verified"))
