"""Operator 4: exact top-k search by inner product with a dual-tree walk over cover trees.

Vectors (floor(256 * x), whole numbers) are dealt into blocks by the nearest of ``CENTRES``
pivots, the first levels of a cover tree over everything; query blocks likewise.  In a task,
a cover tree is built over the block: a node covers its vectors within a radius, its
children, whose centres lie further apart than half of it, within half.  Query tree and
candidate tree are walked together; a pair of nodes is dropped when the largest inner
product that the centres and radii allow,

    <q, c> + r_c |q| + r_q |c| + r_q r_c,

is below the worst kth score among the node's queries.  Blocks are pruned the same way
before they are joined: a first round searches each query block's most promising block,
and its kth scores are the bounds of the second round.

Scores are exact: products of whole numbers in double precision as long as no sum can pass
2**53, else in Python integers.  A bound carries a margin for rounding, so no tie is lost.

Defined cases: vectors that are null, empty or hold null or non-finite components take no part;
equal vectors are ties, to the smaller id; equal ids are rows of their own; a query alone gets
no row; vectors of different lengths are an error, and so is a
score beyond 64 bits; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import cut
from vigil.llm.vectors import best, blocks, matrix, top, unpack, usable

CENTRES = 16
#: Rows the pivots are chosen from (those with the smallest hash of the id).
SAMPLE = 2048
QUERIES, CANDIDATES = 1024, 4096
#: Parts that the query blocks of one candidate block are dealt into.
DEALS = 4
#: Vectors under which a node is not divided further.
LEAF = 48
EXACT = float(1 << 53)


def whole(v: np.ndarray) -> np.ndarray:
    return np.floor(v * 256.0)


def far_first(x: np.ndarray, k: int) -> np.ndarray:
    """Up to k rows, each the one farthest from those before it."""
    chosen, far = [0], ((x - x[0]) ** 2).sum(1)
    while len(chosen) < k and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)


@dataclass
class Node:
    centre: np.ndarray
    radius: float
    at: np.ndarray
    norm: float
    children: list["Node"] = field(default_factory=list)


def away_from(x: np.ndarray, norms: np.ndarray, at: np.ndarray, centre: int) -> np.ndarray:
    """Distances of the rows ``at`` to one of them."""
    return np.sqrt(np.maximum(norms[at] + norms[centre] - 2 * (x[at] @ x[centre]), 0))


def cover_tree(x: np.ndarray, at: np.ndarray | None = None, centre: int | None = None, norms: np.ndarray | None = None) -> Node:
    """Cover tree of the rows ``at`` of x, the root's centre one of them."""
    at = np.arange(len(x)) if at is None else at
    norms = (x ** 2).sum(1) if norms is None else norms
    centre = int(at[0]) if centre is None else centre
    away = away_from(x, norms, at, centre)
    node = Node(x[centre], float(away.max(initial=0.0)), at, float(np.sqrt(norms[centre])))
    if len(at) <= LEAF or node.radius == 0:
        return node
    # a net at half the radius: centres further apart than that, every vector within it
    owner, near, heads, most = np.zeros(len(at), int), away, [centre], 2 * int(np.sqrt(len(at)))
    while near.max() > node.radius / 2:
        if len(heads) == most:
            return node  # the vectors lie too evenly for nodes to be worth while
        heads.append(int(at[near.argmax()]))
        d = away_from(x, norms, at, heads[-1])
        closer = d < near
        owner[closer], near = len(heads) - 1, np.minimum(near, d)
    node.children = [cover_tree(x, at[owner == i], h, norms) for i, h in enumerate(heads) if (owner == i).any()]
    return node


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    if len(q) and len(c) and np.abs(q).max() * np.abs(c).max() * q.shape[1] >= EXACT:
        return np.array([[sum(int(a) * int(b) for a, b in zip(u, w)) for w in c] for u in q], object)
    return q @ c.T


class Search:
    """Best k of candidate blocks for the queries of one block."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, bounds: np.ndarray | None = None):
        self.ids, self.x, self.k = ids, queries, k
        self.tree = cover_tree(queries)
        self.bound = np.full(len(ids), -np.inf) if bounds is None else bounds.astype(float)
        self.found: list[list[tuple]] = [[] for _ in ids]

    def add(self, ids: np.ndarray, x: np.ndarray, tree: Node) -> None:
        """Search the candidates (ids, x) by their cover tree."""
        stack = [(self.tree, tree)]
        while stack:
            q, c = stack.pop()
            ceiling = float(q.centre @ c.centre) + c.radius * q.norm + q.radius * c.norm + q.radius * c.radius
            if ceiling * (1 + np.sign(ceiling) * 1e-9) + 1e-6 < self.bound[q.at].min():
                continue
            if len(q.at) * len(c.at) <= 65536 or not (q.children or c.children):
                self._direct(q.at, ids[c.at], x[c.at])
            elif c.children and (not q.children or c.radius >= q.radius):
                # the most promising child is walked first, so it goes on the stack last
                stack += [(q, child) for child in sorted(c.children, key=lambda n: float(q.centre @ n.centre))]
            else:
                stack += [(child, c) for child in q.children]

    def _direct(self, at: np.ndarray, ids: np.ndarray, x: np.ndarray) -> None:
        scores = products(self.x[at], x)
        hopeful = np.flatnonzero((scores >= self.bound[at][:, None]).any(1)) if scores.size else []
        for r in hopeful:
            i, row = at[r], scores[r]
            ok = (row >= self.bound[i]) & (ids != self.ids[i])
            own, score = ids[ok], row[ok]
            pick = top(own, score, self.k)
            held = sorted(self.found[i] + [(-int(s), int(j)) for s, j in zip(score[pick], own[pick])])[:self.k]
            self.found[i] = held
            if len(held) == self.k:
                self.bound[i] = max(self.bound[i], float(-held[-1][0]) if abs(held[-1][0]) < EXACT else -np.inf)

    def rows(self) -> tuple[list, list, list]:
        flat = [(int(q), j, -s) for q, held in zip(self.ids, self.found) for s, j in held]
        return tuple(map(list, zip(*flat))) if flat else ([], [], [])


def _assigned(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` in whole numbers with the nearest pivot and the distance to it."""
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            x = whole(matrix(b.column("v")))
            d = (x ** 2).sum(1)[:, None] - 2 * x @ pivots.T + (pivots ** 2).sum(1)
            near = d.argmin(1)
            away = np.sqrt(((x - pivots[near]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id"), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel())), pa.array(near.astype(np.int32)), pa.array(away)],
                ["vec_id", "v", "pivot", "away"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, pivot int, away double")


def search(embeddings: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """query_id, rank, vec_id, score of every row whose id is divisible by ``every``."""
    spark = embeddings.sparkSession
    rows = usable(embeddings)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    schema = "query_id long, rank int, vec_id long, score long"
    if not len(sample):
        return spark.createDataFrame([], schema)
    x = whole(np.array(sample["v"].tolist()))
    pivots = x[far_first(x, CENTRES)]
    dealt = cut(_assigned(rows, pivots))
    radius = F.max("away").alias("radius")
    asked, given = dealt.where(f"vec_id % {every} = 0"), dealt
    # blocks of whole trees' subtrees; what is known of each is a pivot, a radius and a number
    cblocks = cut(blocks(given, ["pivot"], CANDIDATES).join(given.groupBy("pivot").agg(radius), "pivot").withColumnsRenamed({"pivot": "c_pivot", "block": "c_block", "radius": "c_radius", "rows": "c_rows"}))
    qblocks = cut(blocks(asked, ["pivot"], QUERIES).join(asked.groupBy("pivot").agg(radius), "pivot").withColumnsRenamed({"pivot": "q_pivot", "block": "q_block", "radius": "q_radius", "rows": "q_rows"}))
    inner, norm = pivots @ pivots.T, np.sqrt((pivots ** 2).sum(1))
    known = spark.createDataFrame([(i, j, float(inner[i, j]), float(norm[i]), float(norm[j])) for i in range(len(pivots)) for j in range(len(pivots))], "q_pivot int, c_pivot int, inner double, q_norm double, c_norm double")
    ceiling = F.expr("inner + c_radius * q_norm + q_radius * c_norm + q_radius * c_radius").alias("ceiling")
    # pairs of blocks (not of rows), by their pivots
    pairs = (qblocks.select("q_pivot", "q_block", "q_radius").join(F.broadcast(known), "q_pivot")
             .join(cblocks.select("c_pivot", "c_block", "c_radius"), "c_pivot").select("q_pivot", "q_block", "c_pivot", "c_block", ceiling))
    pairs = cut(pairs)
    first = pairs.groupBy("q_pivot", "q_block").agg(F.max_by(F.struct("c_pivot", "c_block"), F.struct("ceiling", "c_pivot", "c_block")).alias("c")).select("q_pivot", "q_block", "c.c_pivot", "c.c_block")

    def walk(chosen: DataFrame, bounded: DataFrame | None) -> DataFrame:
        full = chosen.join(qblocks, ["q_pivot", "q_block"]).join(cblocks, ["c_pivot", "c_block"])
        full = full.join(bounded, ["q_pivot", "q_block"], "left") if bounded is not None else full.withColumn("bounds", F.lit(None).cast("map<bigint,bigint>"))

        def run(batches):
            for b in batches:
                out, last, block = [[], [], [], [], []], None, None
                for i in range(b.num_rows):
                    name = b.column("c_pivot")[i].as_py(), b.column("c_block")[i].as_py()
                    if name != last:  # pairs are sorted by candidate block, whose tree is built once
                        cids, cx = unpack(b.column("c_rows")[i])
                        last, block = name, (cids, cx, cover_tree(cx))
                    ids, q = unpack(b.column("q_rows")[i])
                    known = dict(b.column("bounds")[i].as_py() or [])
                    bounds = np.array([known.get(int(j), -np.inf) for j in ids], float)
                    s = Search(ids, q, k, bounds)
                    s.add(*block)
                    got = s.rows()
                    for column, values in zip(out, ([b.column("q_pivot")[i].as_py()] * len(got[0]), [b.column("q_block")[i].as_py()] * len(got[0]), *got)):
                        column += values
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["q_pivot", "q_block", "query_id", "vec_id", "score"])

        # a candidate block's pairs lie together, dealt by groups of query blocks
        full = full.withColumn("_deal", F.pmod(F.xxhash64("q_pivot", "q_block"), F.lit(DEALS)))
        full = full.repartition("c_pivot", "c_block", "_deal").sortWithinPartitions("c_pivot", "c_block")
        return full.select("q_pivot", "q_block", "q_rows", "c_pivot", "c_block", "c_rows", "bounds").mapInArrow(run, "q_pivot int, q_block int, query_id long, vec_id long, score long")

    one = cut(walk(first, None))
    kth = one.groupBy("q_pivot", "q_block", "query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n")).withColumn("kth", F.when(F.col("n") >= k, F.col("kth")))
    # bounds of a block: a number for each of its queries; the worst of them prunes blocks, if all have one
    bounds = cut(kth.groupBy("q_pivot", "q_block").agg(F.map_from_entries(F.collect_list(F.when(F.col("kth").isNotNull(), F.struct("query_id", "kth")))).alias("bounds"), F.min("kth").alias("worst"), F.count("kth").alias("with")))
    size = qblocks.select("q_pivot", "q_block", F.size("q_rows").alias("size"))
    rest = (pairs.join(first, ["q_pivot", "q_block", "c_pivot", "c_block"], "left_anti").join(bounds.select("q_pivot", "q_block", "worst", "with"), ["q_pivot", "q_block"], "left")
            .join(size, ["q_pivot", "q_block"]).where("not coalesce(with = size and ceiling + abs(ceiling) * 1e-9 + 1e-6 < worst, false)").select("q_pivot", "q_block", "c_pivot", "c_block"))
    found = one.union(walk(rest, bounds)).select("query_id", "vec_id", "score")
    return best(found, k)
