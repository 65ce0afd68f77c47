"""Operators 4, 9 and 6 against brute force."""
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from vigil.llm import ann, covertree, sharding

SCHEMA = "vec_id long, embedding array<float>, label int"


def vectors(shipped, n=700, dim=12, seed=0, copies=200):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(6, dim))[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, dim))) * 0.3
    x[:copies] = x[0]
    x = x.astype(np.float32)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(5000, None, 0), (5050, [float("nan")] * dim, 1), (5100, [float("inf")] + [0.0] * (dim - 1), 1), (None, [0.1] * dim, 1), (5001, [None] * dim, 1), (5150, [], 1)]
    return shipped.createDataFrame(rows + odd, SCHEMA).selectExpr("*", "1 as pivot", "2 as v", "3 as score"), x.astype(float)


def test_cover_tree_search_equals_brute_force(shipped):
    frame, x = vectors(shipped)
    whole = np.floor(x * 256)
    want = []
    for q in range(0, len(x), 50):
        s = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:5]
        want += [(q, r + 1, i, int(s[i])) for r, i in enumerate(order)]
    assert sorted(map(tuple, covertree.search(frame).collect())) == sorted(want)


def test_cover_tree_covers_and_separates():
    x = np.random.default_rng(1).normal(size=(400, 3))
    nodes = [covertree.cover_tree(x)]
    assert nodes[0].children
    while nodes:
        n = nodes.pop()
        assert np.sqrt(((x[n.at] - n.centre) ** 2).sum(1)).max() <= n.radius + 1e-12
        if n.children:
            assert sorted(np.concatenate([c.at for c in n.children])) == sorted(n.at)
            assert all(c.radius <= n.radius / 2 + 1e-12 for c in n.children)
            far = [np.sqrt(((a.centre - b.centre) ** 2).sum()) for i, a in enumerate(n.children) for b in n.children[:i]]
            assert min(far) > n.radius / 2
        nodes += n.children


def test_large_numbers_stay_exact(shipped):
    rows = [(i, [float(2.0 ** 21 + i), -3.0], 0) for i in range(60)]
    got = covertree.search(shipped.createDataFrame(rows, "vec_id long, embedding array<double>, label int").where("vec_id < 3 or vec_id = 50"), every=50)
    a = [[int(np.floor(v * 256)) for v in r[1]] for r in rows]
    for r in got.collect():
        want = sum(p * q for p, q in zip(a[r.query_id], a[r.vec_id]))
        assert want > 2 ** 53 and r.score == want


@pytest.mark.parametrize("search", [covertree.search, ann.search])
def test_few_or_no_vectors(shipped, search):
    make = lambda rows: shipped.createDataFrame(rows, SCHEMA)
    assert search(make([])).collect() == []
    assert search(make([(0, [1.0, 2.0], 0)])).collect() == []
    assert [(r.query_id, r.rank, r.vec_id) for r in search(make([(0, [1.0, 2.0], 0), (3, [2.0, 1.0], 0)])).collect()] == [(0, 1, 3)]


def test_learned_partitions_recall_and_exact_scores(shipped):
    frame, x = vectors(shipped, n=3000, dim=24, copies=0)
    got = defaultdict(dict)
    for r in ann.search(frame).collect():
        got[r.query_id][r.vec_id] = (r.rank, r.score)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = []
    for q in range(0, len(x), 50):
        s = unit @ unit[q]
        s[q] = -9
        best = np.lexsort((np.arange(len(x)), -s))[:5]
        hit += [i in got[q] for i in best]
        assert all(abs(score - s[i]) < 1e-12 for i, (_, score) in got[q].items())
        assert [i for i, _ in sorted(got[q].items(), key=lambda z: (-z[1][1], z[0]))] == [i for i, _ in sorted(got[q].items(), key=lambda z: z[1][0])]
    assert np.mean(hit) >= 0.9


def test_equal_vectors_tie_to_the_smaller_id(shipped):
    frame, _ = vectors(shipped, n=600, copies=300)
    got = [r.vec_id for r in ann.search(frame).where("query_id = 50").orderBy("rank").collect()]
    assert got == [0, 1, 2, 3, 4]


def test_zero_vectors_take_no_part(shipped):
    rows = [(0, [0.0, 0.0], 0), (50, [1.0, 0.0], 0), (1, [1.0, 1.0], 0)]
    assert {(r.query_id, r.vec_id) for r in ann.search(shipped.createDataFrame(rows, SCHEMA)).collect()} == {(50, 1)}


def test_balanced_parts():
    x = ann.unit(np.random.default_rng(2).normal(size=(500, 8)))
    part = ann.balanced_parts(x, ann.neighbour_graph(x, 10), 8)
    size = np.bincount(part, minlength=8)
    assert size.sum() == 500 and size.max() <= np.ceil(500 / 8 * ann.SLACK)


def test_shards(docs, tmp_path, shipped):
    rng = np.random.default_rng(3)
    rows = [(i, "x" * int(rng.integers(0, 400))) for i in range(3000)] + [(9000, None), (9001, ""), (9002, "é" * 5), (9002, "é" * 5), (None, "n"), (None, None)]
    got = sharding.shard(docs(rows, "size slot shard virtual_slot"), root=str(tmp_path / "map")).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    slots, size = defaultdict(list), Counter()
    for r in got:
        slots[r.shard].append(r.slot)
        size[r.shard] += r.size
    assert set(slots) == set(range(8)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(size.values()) - min(size.values()) <= 401
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    assert sharding.read_map(shipped, str(tmp_path / "map"), 1).count() == sharding.SLOTS
    with pytest.raises(Exception):
        sharding.write_map(shipped, str(tmp_path / "map"), 1, [0], [0])


def test_rebalance_moves_little_and_keeps_balance():
    rng = np.random.default_rng(4)
    weights = rng.integers(0, 1000, 4096).tolist()
    first = sharding.first_map(weights, 8)
    grown = sharding.rebalance(first, weights, 9)
    moved = sum(w for a, b, w in zip(first, grown, weights) if a != b)
    load = [sum(w for s, w in zip(grown, weights) if s == k) for k in range(9)]
    goal = sum(weights) / 9
    assert max(load) < goal * 1.03 and min(load) > goal * 0.97 and moved < 1.2 * goal
    assert np.mean([b == 8 for a, b in zip(first, grown) if a != b]) > 0.95
    assert set(sharding.rebalance(first, weights, 7)) == set(range(7))


def test_empty_shards(docs, tmp_path):
    assert sharding.shard(docs([]), root=str(tmp_path / "m")).collect() == []
