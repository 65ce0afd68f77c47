"""Operator 9: approximate nearest neighbours by learned partitions.

Fit, on a bounded sample (``SAMPLE`` rows with the smallest hash of the id): the nearest-
neighbour graph of the sample is cut into ``PARTS`` balanced parts (seeds far apart, then
rounds in which a vector moves to the part of most of its neighbours as long as the sizes
stay within ``SLACK``), and a small network (one hidden layer) learns to tell a vector's part.

Index: every row goes to the ``SPILL`` parts that the network holds most probable; parts are
stored in blocks.  Search: a query goes to its ``PROBES`` most probable parts, whose blocks
are reranked by the exact cosine in double precision.  Recall against brute force is
measured in the tests (``recall``).

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no
part; equal vectors are ties, to the smaller id; a query alone gets no row; a part without
blocks adds nothing; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import cut
from vigil.llm.covertree import far_first
from vigil.llm.vectors import best, blocks, matrix, top, unpack, usable

SAMPLE = 4096
PARTS, PROBES, SPILL = 32, 24, 1
NEIGHBOURS, SLACK, HIDDEN = 10, 1.1, 64
QUERIES, CANDIDATES = 1024, 4096


def unit(v: np.ndarray) -> np.ndarray:
    big = np.abs(v).max(1, keepdims=True)
    v = v / np.where(big > 0, big, 1)
    return v / np.sqrt((v ** 2).sum(1, keepdims=True))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    near = x @ x.T
    np.fill_diagonal(near, -np.inf)
    return np.argpartition(-near, min(k, len(x) - 1) - 1, axis=1)[:, :k] if len(x) > 1 else np.zeros((len(x), 0), int)


def balanced_parts(x: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 15) -> np.ndarray:
    """Part of each vector: few graph edges between parts, sizes within ``SLACK`` of equal."""
    n = len(x)
    room = int(np.ceil(n / parts * SLACK))
    seeds = far_first(x, parts)
    part, size = np.full(n, -1), np.zeros(parts, int)
    wish = x @ x[seeds].T
    for i in np.argsort(-wish.max(1), kind="stable"):  # the clearest first
        for p in np.argsort(-wish[i], kind="stable"):
            if size[p] < room:
                part[i], size[p] = p, size[p] + 1
                break
    both = [set(g) for g in graph.tolist()]
    for i, g in enumerate(graph.tolist()):
        for j in g:
            both[j].add(i)
    lists = [np.fromiter(s, int, len(s)) for s in both]
    for _ in range(rounds):
        moved = 0
        for i in range(n):
            votes = np.bincount(part[lists[i]], minlength=parts)
            to = int(votes.argmax())
            if votes[to] > votes[part[i]] and size[to] < room:
                size[part[i]] -= 1
                size[to] += 1
                part[i], moved = to, moved + 1
        if not moved:
            break
    return part


class Router:
    """One hidden layer and a softmax over the parts, by full-batch Adam from fixed random weights."""

    def __init__(self, x: np.ndarray, part: np.ndarray, parts: int, steps: int = 150):
        rng = np.random.default_rng(9)
        shape = [(x.shape[1], HIDDEN), (HIDDEN,), (HIDDEN, parts), (parts,)]
        self.w = [rng.normal(size=s) * (1.5 / np.sqrt(s[0])) if len(s) > 1 else np.zeros(s) for s in shape]
        goal = np.eye(parts)[part]
        m, v = [np.zeros(s) for s in shape], [np.zeros(s) for s in shape]
        for t in range(1, steps + 1):
            hidden, p = self._run(x)
            d = (p - goal) / len(x)
            back = (d @ self.w[2].T) * (hidden > 0)
            for i, g in enumerate((x.T @ back + 1e-4 * self.w[0], back.sum(0), hidden.T @ d + 1e-4 * self.w[2], d.sum(0))):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                self.w[i] = self.w[i] - 0.03 * (m[i] / (1 - 0.9 ** t)) / (np.sqrt(v[i] / (1 - 0.999 ** t)) + 1e-8)

    def _run(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(x @ self.w[0] + self.w[1], 0)
        z = hidden @ self.w[2] + self.w[3]
        p = np.exp(z - z.max(1, keepdims=True))
        return hidden, p / p.sum(1, keepdims=True)

    def route(self, x: np.ndarray, n: int) -> np.ndarray:
        return np.argsort(-self._run(x)[1], axis=1, kind="stable")[:, :n]


def _routed(rows: DataFrame, router: Router, n: int) -> DataFrame:
    """A row for each vector and each of its n most probable parts."""
    def run(batches):
        for b in batches:
            if b.num_rows:
                to = router.route(unit(matrix(b.column("v"))), n).astype(np.int32)
                at = pa.array(np.repeat(np.arange(b.num_rows), to.shape[1]))
                yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), b.column("v").take(at), pa.array(to.ravel())], ["vec_id", "v", "part"])

    return rows.mapInArrow(run, "vec_id long, v array<double>, part int")


def cosines(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosine of one query with each candidate, summed alike for equal vectors."""
    return np.einsum("ij,j->i", c, q)


def search(embeddings: DataFrame, k: int = 5, every: int = 50, probes: int = PROBES) -> DataFrame:
    """query_id, rank, vec_id, score of every row whose id is divisible by ``every``."""
    rows = usable(embeddings).where(F.exists("v", lambda x: x != 0))
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()
    if not len(sample):
        return embeddings.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = np.unique(unit(np.array(sample["v"].tolist())), axis=0)  # copies would fill a part
    parts = min(PARTS, len(x))
    router = Router(x, balanced_parts(x, neighbour_graph(x, NEIGHBOURS), parts), parts)
    given = blocks(_routed(rows, router, SPILL), ["part"], CANDIDATES).withColumnsRenamed({"block": "c_block", "rows": "c_rows"})
    asked = blocks(_routed(rows.where(f"vec_id % {every} = 0"), router, probes), ["part"], QUERIES).withColumnsRenamed({"block": "q_block", "rows": "q_rows"})

    def run(batches):
        for b in batches:
            out = [[], [], []]
            for i in range(b.num_rows):
                qi, q = unpack(b.column("q_rows")[i])
                ci, c = unpack(b.column("c_rows")[i])
                c, q = unit(c), unit(q)
                rough = q @ c.T
                for j in range(len(qi)):
                    row = np.where(ci == qi[j], -np.inf, rough[j])
                    if len(row) > k:
                        least = np.partition(row, len(row) - k)[len(row) - k]
                        at = np.flatnonzero(row >= least - 1e-9)
                    else:
                        at = np.arange(len(row))
                    at = at[ci[at] != qi[j]]
                    exact = np.clip(cosines(q[j], c[at]), -1.0, 1.0)
                    pick = top(ci[at], exact, k)
                    out[0] += [int(qi[j])] * len(pick)
                    out[1] += ci[at][pick].tolist()
                    out[2] += exact[pick].tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], ["query_id", "vec_id", "score"])

    pairs = asked.join(given, "part").select("q_rows", "c_rows")
    found = pairs.mapInArrow(run, "query_id long, vec_id long, score double")
    return best(cut(found).distinct() if SPILL > 1 else found, k)
