"""Operator 11: base scores against brute force; the network against finite differences, itself and held-out texts."""
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vigil.llm import gru


def words_of(text):
    lowered = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lowered), ""]


def brute(rows):
    teach = [words_of(t) for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 5 != 1]
    counts = Counter(w for t in teach for w in t)
    total, distinct = sum(counts.values()), len(counts)
    out = []
    for i, t in rows:
        w = words_of(t)
        base = sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w)
        out.append((i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, len(w), sum(counts[x] > 0 for x in w), total, base))
    return out


def check(frame, rows):
    got = sorted(frame.collect(), key=lambda r: (str(r.doc_id), r.n_tokens))
    want = sorted(brute(rows), key=lambda r: (str(r[0]), r[2]))
    assert [tuple(r)[:5] for r in got] == [w[:5] for w in want]
    assert [r.base_score for r in got] == pytest.approx([w[5] for w in want])
    assert all(math.isfinite(r.score) and r.score <= 1e-6 for r in got)
    return got


ODD = ["", "  ", "One two\x0bTHREE\x1c\x85　four É é", None, "x" * 50000, "a " * 30000, "same text", "same text"]


def test_odd_rows_equal_brute_force(docs):
    rng = random.Random(2)
    rows = list(enumerate(ODD + [" ".join(rng.choice(["the", "cat", "sat", "w%d" % rng.randrange(300)]) for _ in range(rng.randint(0, 40))) for _ in range(120)]))
    rows += [(None, "the cat"), (3, "the dog"), (None, None)]
    check(gru.likelihood(docs(rows, "chunk at h1 numbers ids number of held_out"), words=70), rows)


def test_without_rows_or_training_documents(docs):
    assert gru.likelihood(docs([])).collect() == []
    held = [(i, "a b c") for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:4]
    for r in check(gru.likelihood(docs(held)), held):
        assert (r.train_tokens, r.score) == (0, 0.0)


def test_beats_single_words_on_held_out_texts(docs):
    rng = random.Random(4)
    follow = {w: [rng.choice("abcdefghijklmnop") for _ in range(2)] for w in "abcdefghijklmnop"}

    def text():
        w, out = "a", []
        for _ in range(rng.randint(50, 200)):
            out.append(w)
            w = rng.choice(follow[w])
        return " ".join(out)

    rows = [(i, text()) for i in range(1500)]
    held = [r for r in check(gru.likelihood(docs(rows)), rows) if r.held_out]
    n = sum(r.n_tokens for r in held)
    assert sum(r.score for r in held) / n > 0.6 * sum(r.base_score for r in held) / n


def small(words=150):
    rng = np.random.default_rng(5)
    net = gru.Network(words, shares=np.full(words + 1, 1 / (words + 1)))
    for k, v in net.w.items():
        if k != "word_bias":
            v += rng.normal(0, 0.2, v.shape).astype("f4")
    return net


def test_probabilities_of_all_words_add_up():
    net = small()
    states = np.random.default_rng(1).normal(size=(5, gru.STATE)).astype("f4")
    for h in states:
        logs = net.log_probs(np.repeat(h[None], 151, 0), np.arange(151))
        assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)


def test_score_is_that_of_the_document_alone_whatever_the_lanes(monkeypatch):
    net, rng = small(), np.random.default_rng(3)
    lengths = np.array([1, 90, 7, 33, 2, 64, 1, 150])
    ids = rng.integers(0, 151, lengths.sum()).astype("i4")
    alone, starts = [], np.concatenate([[0], np.cumsum(lengths)])
    for a, b in zip(starts, starts[1:]):
        h, before, total = np.zeros((1, gru.STATE), "f4"), net.words + 1, 0.0
        for w in ids[a:b]:
            out, _ = net.run(h, np.array([[before]]), np.array([[0.0 if before == net.words + 1 else 1.0]], "f4"))
            h, before = out[-1], w
            total += float(net.log_probs(h, np.array([w]))[0])
        alone.append(total)
    for lanes, steps in ((2, 3), (1, 16), (256, 5)):
        monkeypatch.setattr(gru, "LANES", lanes), monkeypatch.setattr(gru, "WINDOW", steps)
        assert gru.score(net, ids, lengths) == pytest.approx(alone, rel=1e-4)


def test_gradients_equal_finite_differences():
    net, rng = small(70), np.random.default_rng(9)
    net.w = {k: v.astype("f8") for k, v in net.w.items()}
    given, target = rng.integers(0, 72, (4, 3)), rng.integers(0, 71, (4, 3))
    keep, valid = rng.integers(0, 2, (4, 3)).astype("f8"), np.array([1, 1, 1, 1, 0, 1, 1, 1, 1, 1, 0, 1], bool)
    start = rng.normal(size=(3, gru.STATE))

    def loss():
        states, kept = net.run(start, given, keep)
        logs = net.log_probs(states.reshape(-1, gru.STATE).astype("f8"), target.reshape(-1))
        return -logs[valid].mean(), states, kept

    _, states, kept = loss()
    found = net.gradients(states, kept, given, target, keep, valid)
    for k, v in net.w.items():
        scale = np.abs(found[k]).max()
        for at in [np.unravel_index(np.abs(found[k]).argmax(), v.shape), *[tuple(rng.integers(0, n) for n in v.shape) for _ in range(3)]]:
            if v[at] < -1e3:
                continue
            own = v[at]
            v[at] = own + 1e-3
            up = loss()[0]
            v[at] = own - 1e-3
            down = loss()[0]
            v[at] = own
            assert (up - down) / 2e-3 == pytest.approx(float(found[k][at]), abs=0.02 * float(scale) + 2e-5), k


def test_every_token_stands_in_one_window_once():
    lengths = np.array([3, 1, 10, 2, 2, 7])
    seen = Counter()
    for p, d, first, valid in gru.windows(lengths, 3, 4):
        seen.update(p[valid].tolist())
        starts = np.concatenate([[0], np.cumsum(lengths)])
        assert ((p >= starts[d]) & (p < starts[d + 1]))[valid].all() and (first == (p == starts[d])).all()
    assert seen == Counter(range(25))
    assert list(gru.windows(np.array([], int), 3, 4)) == []


def test_numbers_in_few_bytes():
    for n in (1, 1 << 16, (1 << 16) + 1, 1 << 24, (1 << 24) + 1):
        numbers = np.array([0, n - 1, n // 2], "i4")
        raw = gru._packed(numbers, n)
        assert len(raw) == 3 * gru._width(n) and gru._unpacked(raw, n).tolist() == numbers.tolist()
    assert len(gru._unpacked(b"", 5)) == 0


def test_texts_are_numbered_at_once():
    rng = random.Random(6)
    signs = [*map(chr, range(40)), *"abAB", "\x85", "\u3000", "\xa0", "\xc9", "\u0130", *[" "] * 20]
    texts = [*ODD, "Z", " Z\t", *["".join(rng.choice(signs) for _ in range(rng.randint(0, 30))) for _ in range(2000)]]
    for some in (texts, texts[:1], [None], ["a"], texts[5:9]):
        numbers, lengths, words = gru._numbered(pa.array(some, pa.string()))
        assert len(set(words)) == len(words)
        cuts = np.split(numbers, np.cumsum(lengths)[:-1])
        assert [[words[n].decode() for n in c] for c in cuts] == [words_of(t) for t in some]


def test_sums_by_word():
    rng = np.random.default_rng(8)
    for at in (rng.zipf(1.3, 900) % 70, np.zeros(500), np.arange(40), np.repeat(np.arange(9), gru.OFTEN - 1), [5]):
        at = np.asarray(at).astype("u2")
        rows = rng.normal(size=(len(at), 12))
        words, sums = gru._word_sums(rows, at, np.ones(len(at)))
        assert sorted(words) == sorted(set(at.tolist()))
        for w, s in zip(words, sums):
            assert s == pytest.approx(rows[at == w].sum(0))


def test_a_round_has_fewer_tasks_than_partitions_but_uses_all_cores():
    assert [gru._tasks(*x) for x in ((0, 6), (1, 6), (5, 6), (21, 6), (24, 4), (1260, 12))] == [1, 1, 5, 6, 6, 315]
