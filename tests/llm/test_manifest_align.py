"""Operators 12 and 13 against brute force."""
import hashlib
import random
import zlib
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigil.llm import align, merkle, queries

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes, fanout):
    """(root, for each node the (left, right) siblings of its ancestors)."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i:i + fanout] for i in range(0, len(nodes), fanout)]
        for p, path in enumerate(paths):
            run, slot = runs[at[p] // fanout], at[p] % fanout
            path.append(("".join(run[:slot]), "".join(run[slot + 1:])))
            at[p] //= fanout
        nodes = [H(*run) for run in runs]
    return nodes[0], paths


def brute_manifest(rows, fanout=2):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((leaf(r[0], r[3], r[2], r[4], r[1]), r))
    keys = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in keys:
        groups[g].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees[g] = climb([x for x, _ in groups[g]], fanout)
    root, above = climb([trees[g][0] for g in keys], fanout)
    out = []
    for g, up in zip(keys, above):
        for (own, r), path in zip(groups[g], trees[g][1]):
            whole = path + up
            n = r[4]
            if n is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0:
                n += 1
            h = leaf(r[0], r[3], g, n, r[1])
            for a, b in whole:
                h = H(a, h, b)
            out.append((r[0], own, trees[g][0], root, H(*(a + b for a, b in whole)), h, h == root))
    return sorted(out, key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("sizes,block", [((1,), 4096), ((1, 2, 3, 5, 40), 4096), ((37, 1, 8), 4), ((70,), 8)])
def test_manifest_equals_brute_force(shipped, monkeypatch, sizes, block):
    monkeypatch.setattr(merkle, "BLOCK", block)
    rows = [(100 * g + i, f"text {i}", [None, "de", "en", "éé", ""][g], "s", 7 * i) for g, n in enumerate(sizes) for i in range(n)]
    random.Random(1).shuffle(rows)
    got = sorted((tuple(r) for r in merkle.tampered(shipped.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == brute_manifest(rows)


def test_manifest_query_equals_its_sql(shipped):
    duckdb = pytest.importorskip("duckdb")
    con, sf = duckdb.connect(), "/root/testdata/sf0.001"
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{sf}/documents.parquet')")
    cur = con.execute(queries.ORACLE["op12_merkle_manifest"])
    df = queries.QUERIES["op12_merkle_manifest"](shipped, sf)
    assert df.columns == [d[0] for d in cur.description]
    assert sorted(map(tuple, df.collect())) == sorted(cur.fetchall())


def test_manifest_of_odd_rows(shipped):
    rows = [(None, "x", "en", None, None), (None, None, None, "s", 3), (5, "", "en", "s", 0), (5, "", "en", "s", 0), (5, "other", "en", "s", None),
            (-3, "日本 😀" * 30000, "en", "s", -1), (7, "y", None, "t", 2)] + [(i, "z", "fr", "s", i) for i in range(60)]
    frame = shipped.createDataFrame(rows, SCHEMA)
    for c in ("g", "pos", "n", "h", "leaf", "path", "block", "_id", "root", "found"):
        frame = frame.withColumn(c, F.lit("x"))
    got = sorted((tuple(r) for r in merkle.tampered(frame).collect()), key=str)
    assert got == brute_manifest(rows)
    assert merkle.tampered(frame.limit(0)).collect() == []


def test_manifest_with_longer_runs(shipped, monkeypatch):
    monkeypatch.setattr(merkle, "BLOCK", 9)
    rows = [(i, "t", "en" if i % 3 else "de", "s", 1) for i in range(50)]
    out = merkle.manifest(shipped.createDataFrame(rows, SCHEMA), "doc_id", "lang", merkle.COLUMNS, fanout=3)
    got = sorted((r.doc_id, r.leaf, r.subroot, r.root, r.proof) for r in out.withColumn("proof", merkle.proof(F.col("path"))).collect())
    assert got == sorted(x[:5] for x in brute_manifest(rows, 3))


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(BYTES)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PIECES)


def brute_alignment(texts, libraries):
    a, b = libraries
    own = align.load(BYTES, PIECES)
    found, counts = [], Counter()
    for t in texts:
        x = [(i, len(own.byte_table[i].as_py())) for i in a.encode(" " + t, add_special_tokens=False).ids] if t else []
        pieces = b.encode(t or "")
        raw = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in pieces]
        if not t or b"".join(raw) != (" " + t).encode() or b"".join(own.byte_table[i].as_py() for i, _ in x) != (" " + t).encode():
            found.append(([], [], [], []))
            continue
        spans = []
        for tokens in (x, [(i, len(r)) for i, r in zip(pieces, raw)]):
            at, out = 0, []
            for i, k in tokens:
                out.append((i, at, at + k))
                at += k
            spans.append(out)
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        links = [(p[0], q[0]) for p in spans[0] for q in spans[1] if p[1] < q[2] and q[1] < p[2]]
        groups, lo = [], 0
        for hi in cuts:
            groups.append("|".join(",".join(str(i) for i, s, _ in side if lo <= s < hi) for side in spans))
            lo = hi
        counts.update(links)
        found.append((spans[0], spans[1], groups, links))
    best = {}
    for (_, q), n in counts.items():
        best[q] = max(best.get(q, 0), n)
    return [(len(x), len(y), len(g), len(k), sum(counts[p] == best[p[1]] for p in k), sum(counts[p] for p in k),
             hashlib.sha256(";".join(g).encode()).hexdigest() if k else "") for x, y, g, k in found], counts, best


ODD = [None, "", " ", "a", "  two  spaces ", "A.\n\n  b\t", "<|endoftext|> and <s> <0x41>", "ÄÖ ß 日本語 😀 ½Ⅷ", "a" * 3000, "don't\x1c\x85　x", "a", "x▁y", "\x00 b", "é é"]


def test_alignment_equals_brute_force(shipped, docs, libraries, monkeypatch):
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice(["the ", "ing", "日", " ", "\n", "é", "tokenization ", "x1", "▁"] if k % 9 == 0 else ["the ", "ing", "日", " ", "\n", "é", "tokenization ", "x1"])
                           for _ in range(rng.randint(0, 50))) for k in range(150)]
    monkeypatch.setattr(align, "CHUNK", 700)
    want, counts, best = brute_alignment(texts, libraries)
    figures, pairs = align.align(docs(texts, "chunk at a b links n_a of"), BYTES, PIECES)
    got = {r.doc_id: tuple(r)[1:] for r in figures.collect()}
    assert [got[i] for i in range(len(texts))] == want
    assert {(r.a, r.b): (r.pair_count, r.pair_best) for r in pairs.collect()} == {p: (n, n == best[p[1]]) for p, n in counts.items()}


def test_alignment_of_no_rows_and_null_ids(shipped, docs):
    assert align.figures(docs([]), BYTES, PIECES).collect() == []
    rows = align.figures(docs([(None, "ab c"), (None, "ab c"), (1, None)]), BYTES, PIECES).collect()
    assert sorted((str(r.doc_id), r.n_a > 0) for r in rows) == [("1", False), ("None", True), ("None", True)]


def test_long_texts_are_cut_where_no_piece_spans(libraries, monkeypatch):
    model = align.load(BYTES, PIECES)
    assert model.cuts
    monkeypatch.setattr(align, "PIECE_TEXT", 20)
    rng = random.Random(8)
    for _ in range(300):
        text = "".join(rng.choice(["the ", "ing", " ", "  ", "日", "\n", "▁", "a"]) for _ in range(rng.randint(1, 80)))
        assert model.encode_pieces([text]) == [libraries[1].encode(text)], text
