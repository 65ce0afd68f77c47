"""Operators 7, 3 and 5 against the tokenizers library."""
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from vigil.llm import bpe, packing, unigram

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", "A.\n\n  b\t", "<|endoftext|>", "x<|endoftext|><|endoftext|> y", "ÄÖ ß 日本語 😀 ½Ⅷ", "ab" * 4000, "a" * 30000, "don't we'll\x1c\x85　x", "a"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def some_texts(n, seed=5):
    rng = random.Random(seed)
    letters = "ab e's'll 1２½Ⅷ_-ß\x1c\x85　 \n\t  éñ日本😀́the ing<|endoftext|>"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 60))) for _ in range(n)]


def test_ids_equal_the_library(library):
    model, fast = bpe.load(PATH), packing.library(PATH)
    for text in [t or "" for t in ODD] + some_texts(1500):
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(model.encode(text), "<u4").tolist() == ids
        assert fast.encode_to_numpy(text, allowed_special="all").tolist() == ids
        assert model.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_cuts_only_where_no_token_spans():
    model = bpe.load(PATH)
    data = "naïve日本\x00\x01zq".encode()
    parts = model.cuts(data)
    assert b"".join(parts) == data and len(parts) > 1
    for left, right in zip(parts, parts[1:]):
        assert not any(bytes([left[-1], right[0]]) in t for t in model.ids)


def test_merging_by_heap_equals_merging_by_scan():
    model = bpe.load(PATH)
    for text in ["a" * 39, "abcabcab" * 4, "thththeree", "ing" * 12]:
        parts = [model.byte_ids[b] for b in text.encode()]
        assert model._merge_short(list(parts)) == model._merge_long(list(parts))


def test_memory_forgets_without_changing_results():
    memory = bpe._Memory(str.upper, limit=700)
    for c in "abcdeabcde" * 3:
        assert memory[c] == c.upper() and len(memory) <= 3 and len(memory.older) <= 3
    assert memory["x" * 1000] == "X" * 1000 and "x" * 1000 not in memory


def test_round_trip_query(docs, library):
    rows = {r.doc_id: r for r in bpe.round_trip(docs(ODD, "n_tokens ids decoded"), PATH).collect()}
    assert len(rows) == len(ODD)
    for i, text in enumerate(ODD):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert rows[i].n_tokens == len(ids)
        assert rows[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_decimal_digest_by_steps():
    ids = np.arange(25, dtype="<u4")
    assert {bpe.decimal_digest(ids, step) for step in (1, 7, 25, 100)} == {hashlib.sha256(",".join(map(str, range(25))).encode()).hexdigest()}
    assert bpe.decimal_digest(ids[:0]) == hashlib.sha256(b"").hexdigest()


def check_packing(rows, texts, library, capacity=1024):
    by, seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
        seq[r.sequence_id].append((r.offset, r.length))
    total = 0
    for i, text in texts.items():
        ids = library.encode(text or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        own, at = sorted(by[i], key=lambda r: r.piece), 0
        assert [r.piece for r in own] == list(range(len(own))) and (len(own) == 1) == (len(ids) <= capacity)
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at:at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(ids) and all(r.length == capacity for r in own[1:])
    for places in seq.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(seq), total


def test_packing(docs, library):
    texts = ODD + some_texts(300, 9) + [" the cat" * n for n in (340, 341, 511, 1023, 2047, 5000)]
    rows = packing.pack_documents(docs(texts, "length offset piece sequence_id _rank"), PATH).collect()
    n, total = check_packing(rows, dict(enumerate(texts)), library)
    assert n <= -(-total // 1024) + 2


def test_packing_of_very_long_white_space(docs, library):
    texts = [" " * 2_000_000, "a" + "\n" * 1_200_000 + "b<|endoftext|>  c", "short"]
    rows = packing.pack_documents(docs(texts), PATH).collect()
    check_packing(rows, dict(enumerate(texts)), library)


def test_plan_places_every_item_once_and_is_best_fit():
    rng = random.Random(2)
    for _ in range(60):
        capacity = rng.randint(5, 40)
        counts = {rng.randint(1, capacity): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        runs = packing.plan(counts, capacity)
        taken = defaultdict(list)
        for length, lo, hi, first, offset in runs:
            for k in range(lo, hi + 1):
                taken[length].append(k)
                seq = first + k - lo
                taken["s", seq].append((offset, length))
        assert all(sorted(taken[x]) == list(range(c)) for x, c in counts.items())
        bins = [v for k, v in taken.items() if isinstance(k, tuple)]
        for places in bins:
            end = 0
            for offset, length in sorted(places):
                assert offset == end
                end += length
            assert end <= capacity
        # the same number as best-fit decreasing item by item
        plain = []
        for x in sorted((x for x, c in counts.items() for _ in range(c)), reverse=True):
            fits = [i for i, s in enumerate(plain) if s >= x]
            if fits:
                plain[min(fits, key=lambda i: plain[i])] -= x
            else:
                plain.append(capacity - x)
        assert len(bins) == len(plain)


def test_packing_of_nothing(docs):
    assert packing.pack_documents(docs([]), PATH).collect() == []
    assert bpe.round_trip(docs([]), PATH).collect() == []


def test_too_long_items_are_an_error(shipped):
    with pytest.raises(ValueError):
        packing.pack(shipped.createDataFrame([(1, 9)], "k long, length long"), ["k"], 8)


def unigram_library(pieces, unknown, fallback):
    t = Tokenizer(models.Unigram([*pieces], unk_id=unknown, byte_fallback=fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    return t


def test_viterbi_counts_equal_the_library():
    full, unknown = unigram.vocabulary(PIECES)
    plain = tuple(p for p in full if not unigram.BYTE.fullmatch(p[0]))
    ties = (("<unk>", 0.0), ("a", -1.0), ("aa", -2.0), ("ab", -2.0), ("b", -1.0), ("▁", -1.0), ("▁a", -2.0), ("aaa", -3.0))
    for pieces, fallback in ((full, True), (plain, False), (ties, False)):
        library, own = unigram_library(pieces, 0, fallback), unigram.Counter(pieces, 0)
        for text in some_texts(400, 3) + ["aaab" * 9, "", " ", "  a  ", "日本 x" * 5] + [t or "" for t in ODD[:8]]:
            assert own.text(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_token_count_query(docs):
    library = unigram_library(*unigram.vocabulary(PIECES), True)
    rows = {r.doc_id: r.n_tokens for r in unigram.count(docs(ODD, "n_tokens _text"), PIECES).collect()}
    assert rows == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(ODD)}
    assert unigram.count(docs([]), PIECES).collect() == []
