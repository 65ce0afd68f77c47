"""Operators 1 and 10 against brute force."""
import hashlib
import random

import numpy as np

from vigil.llm import setjoin, suffix


def brute_repeats(rows, width=100):
    """id -> (bytes, removed, spans, digest) of documents in id order."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        data = (text or "").encode()
        mark = bytearray(len(data))
        for p in range(len(data) - width + 1):
            window = data[p:p + width]
            if window in seen:
                mark[p:p + width] = b"\1" * width
            seen.add(window)
        kept = bytes(b for b, m in zip(data, mark) if not m)
        spans = sum(1 for a, b in zip(b"\0" + mark, mark) if b and not a)
        out[i] = len(data), sum(mark), spans, hashlib.sha256(kept).hexdigest()
    return out


def passages(rng, n):
    words = ["".join(rng.choice("abcdeé ") for _ in range(rng.randint(2, 7))) for _ in range(40)]
    say = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [say(40) for _ in range(4)]
    rows = []
    for i in range(n):
        text = say(rng.randint(0, 40)) + rng.choice(["", *shared]) + say(rng.randint(0, 20)) + rng.choice(["", *shared])[rng.randint(0, 60):]
        rows.append((i * 3, text))
    return rows


def test_suffix_dedup_equals_brute_force(docs):
    rng = random.Random(4)
    rows = passages(rng, 60)
    rows += [(1000 + i, t) for i, t in enumerate([None, "", "x" * 99, "x" * 100, "x" * 101, "x" * 500, "ab" * 300, rows[3][1], rows[3][1], "\x00" * 250, "é" * 200, "=" * 150 + "q" + "=" * 150])]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.deduplicated(docs(rows, "doc key kept marks gram")).collect()}
    assert got == brute_repeats(rows)


def test_suffix_dedup_of_odd_ids(docs):
    rng = random.Random(1)
    long = "".join(rng.choice("abcdefgh ") for _ in range(400))
    got = [(r.doc_id, r.n_removed) for r in suffix.deduplicated(docs([(5, long), (5, long), (7, long), (None, long), (7, "short")])).collect()]
    assert sorted(got, key=str) == sorted([(5, 0), (5, 0), (7, 400), (None, 400), (7, 0)], key=str)
    assert suffix.deduplicated(docs([])).collect() == []


def test_hot_groups_are_split_by_their_windows(docs, monkeypatch):
    rng = random.Random(6)
    own = lambda: "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(90, 160)))
    passage = own() + own()
    rows = [(i, own() + passage + own()) for i in range(80)] + [(1000 + i, t) for i, t in passages(rng, 40)]
    rows += [(5000, rows[3][1]), (5001, "x" * 500 + passage), (5002, passage * 3), (5003, None)]
    sorted_at_once = []
    contexts = suffix._contexts

    def seen(*args):
        out = contexts(*args)
        sorted_at_once.append({r.gram: r.n for r in out.where("windows > 0").groupBy("gram").agg({"bytes": "count"}).withColumnRenamed("count(bytes)", "n").collect()})
        assert out.where("windows = 0").count() > 0
        return out

    monkeypatch.setattr(suffix, "HOT", 3000)
    monkeypatch.setattr(suffix, "_contexts", seen)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.deduplicated(docs(rows)).collect()}
    assert got == brute_repeats(rows)
    assert len(sorted_at_once) == 1 and max(sorted_at_once[0].values()) <= 30  # 100 bytes at least each


def test_cut_characters_are_dropped_from_the_text(docs):
    rng = random.Random(2)
    body = "".join(rng.choice("aé") for _ in range(200))
    rows = suffix.removed(docs([(1, "é" + body), (2, "è" + body)])).collect()
    second = next(r for r in rows if r.doc_id == 2)
    assert second.n_removed > 0 and second.kept_text == bytes(second.kept).decode("utf-8", "ignore")


def test_induced_sort_orders_windows_with_common_prefixes():
    rng = random.Random(7)
    for _ in range(120):
        cap, alphabet = rng.choice([3, 5, 8, 20]), rng.choice([b"ab", b"a", b"abc\x00\xff", b"abcdefgh"])
        text = []
        for _ in range(rng.randint(1, 8)):
            text += [rng.choice(alphabet) + 1 for _ in range(rng.randint(1, 50))] + [0]
        got = [*suffix.induced_sort(np.array(text, np.uint16), cap, block=rng.choice([1, 3, 1000]))]
        order, common = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        assert sorted(order) == list(range(len(text) - 1))
        windows = [tuple(text[i:i + cap]) for i in order]
        until = [w[:w.index(0) + 1] if 0 in w else w for w in windows]
        assert until == sorted(until)
        for a in range(1, len(order)):
            x, y = windows[a - 1], windows[a]
            n = next((k for k, (u, v) in enumerate(zip(x, y)) if u != v), min(len(x), len(y)))
            if 0 not in x[:n + 1] and 0 not in y[:n + 1]:
                assert common[a] == n


def test_disk_queues_keep_order():
    q = suffix.DiskQueues(3, block=2)
    for k in range(11):
        q.put(k % 3, np.array([k, k + 100]), np.array([k, 1], np.uint8))
    for b in range(3):
        suffixes = np.concatenate([s for s, _ in q.take(b)]).tolist()
        assert suffixes == [x for k in range(11) if k % 3 == b for x in (k, k + 100)]


def brute_components(rows, k, num, den):
    sets = {}
    for i, text in rows:
        words = (text or "").encode().lower().split()
        sets[i] = {tuple(words[j:j + k]) for j in range(max(1, len(words) - k + 1))} if words else set()
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            x, y = sets[a], sets[b]
            if x and y and den * len(x & y) >= num * len(x | y):
                u, v = root(a), root(b)
                parent[max(u, v)] = min(u, v)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_copies(rng, groups, size):
    words = ["w%d" % i for i in range(60)]
    rows = []
    for _ in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([2, 5, 12, 20, 35, 80, 200]))]
        for _ in range(rng.randint(1, size)):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
                own[rng.randrange(len(own))] = rng.choice(words)
            rows.append(" ".join(own) if rng.random() < 0.8 else "\n".join(w.upper() for w in own))
    rng.shuffle(rows)
    return [(7 * i + 1, t) for i, t in enumerate(rows)]


def test_join_equals_brute_force(docs):
    rng = random.Random(11)
    rows = near_copies(rng, 40, 8) + [(5000 + i, t) for i, t in enumerate([None, "", " \n", "one", "one", "One two", "é É", "a b c", "A b C"])]
    for k, num in ((3, 90), (5, 80), (1, 50)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.join(docs(rows, "n k1 member comp"), k, num, 100).collect()}
        assert got == brute_components(rows, k, num, 100), (k, num)


def test_join_of_a_large_group_and_odd_ids(docs):
    rng = random.Random(3)
    base = ["w%d" % rng.randrange(500) for _ in range(300)]
    rows = []
    for i in range(150):
        own = list(base)
        own[rng.randrange(300)] = "x%d" % i
        rows.append((i, " ".join(own)))
    got = setjoin.join(docs(rows + [(None, "q r s t"), (900, "q r s t"), (900, "q r s t"), (None, None)])).collect()
    want = brute_components(rows, 3, 90, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None and r.doc_id < 900} == want
    assert [(r.doc_id, r.component_id) for r in got if r.doc_id is None or r.doc_id == 900].count((900, 900)) == 2
    assert setjoin.join(docs([])).collect() == []


def test_equal_ids_with_different_texts_join_by_text(docs):
    text = " ".join("w%d" % i for i in range(60))
    got = setjoin.join(docs([(1, text), (1, "other words here"), (2, text + " z"), (3, text)])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 1, 1), (1, 58, 1), (2, 59, 1), (3, 58, 1)]


def test_pigeonhole_layouts_cover_every_difference():
    for num in (90, 80, 50):
        for b in range(1, 40):
            d, m, deletions = setjoin.layout(b, num, 100)
            lo, hi = setjoin.band(b)
            assert d == setjoin.difference(hi - 1, num, 100)
            assert d == 0 or (2 * m if deletions else m) >= d + 1
    for s in range(1, 200):  # the largest difference of similar sets, by trying every size and overlap
        for num in (90, 80):
            most = max((s + t - 2 * i for t in range(s, 2 * s + 1) for i in range(s, -1, -1) if 100 * i >= num * (s + t - i)), default=0)
            assert most <= setjoin.difference(s, num, 100)


def test_rows_without_an_id_link_and_bridge(docs):
    words = ["w%d" % i for i in range(200)]
    first, whole, last = " ".join(words[10:]), " ".join(words), " ".join(words[:-10])
    alone = " ".join("v%d" % i for i in range(50))
    rows = [(7, first), (4, last), (9, "a b c d"), (None, alone), (None, alone + " x")]
    assert {r.doc_id: r.component_id for r in setjoin.join(docs(rows)).collect() if r.doc_id} == {7: 7, 4: 4, 9: 9}
    got = sorted(((str(r.doc_id), r.component_id) for r in setjoin.join(docs(rows + [(None, whole), (None, whole)])).collect()), key=str)
    assert got == sorted([("7", 4), ("4", 4), ("9", 9), ("None", 4), ("None", 4), ("None", None), ("None", None)], key=str)
    # ids that repeat
    got = {(r.doc_id, r.component_id) for r in setjoin.join(docs([(7, first), (4, last), (4, "q r s t"), (None, whole)])).collect()}
    assert got == {(7, 4), (4, 4), (None, 4)}
