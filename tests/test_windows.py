"""Terms in texts by the windows of the texts' bytes."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.test_match import _joined_rows
from vigil.operators import match as MT
from vigil.operators import windows as W


def test_hits_are_all_places_of_all_terms(monkeypatch):
    monkeypatch.setattr(W, "BLOCK", 7)  # windows over the blocks' and the texts' ends
    rnd = random.Random(3)
    make = lambda n: "".join(rnd.choice("ab é납") for _ in range(rnd.randint(0, n)))
    texts, terms = [make(60).encode() for _ in range(40)], sorted({make(6).encode() for _ in range(60)} | {make(40).encode() for _ in range(5)} - {b""})
    terms = [t for t in terms if t]
    batch = pa.RecordBatch.from_arrays([pa.array(terms, pa.binary())], ["_t"])
    slots = np.concatenate([b.column(0).to_numpy() for b in W._term_slots(16)([batch])])
    bitmap = np.zeros(1 << 16, bool)
    bitmap[slots] = True
    for whole in (pa.array([b"left out", *texts], pa.binary()).slice(1), pa.array(texts, pa.binary())):
        offsets, data = W._binary(whole)
        found = {(i, bytes(data[p:p + n])) for n, (at, of) in W._hits(data, offsets[1:], W._classes(sorted({len(t) for t in terms})), bitmap, 16).items()
                 for p, i in zip(at, of)}
        want = {(i, t) for i, x in enumerate(texts) for t in terms if t in x}
        assert want <= found and all(t in texts[i] for i, t in found)
        assert len(found - want) <= 0.02 * len(want) + 5


def test_windows_once_a_text_with_the_next_character(spark):
    text = spark.createDataFrame([(1, "납a 납. 납"), (2, "xyxyxy"), (3, ""), (4, None), (None, "é")], "id long, _x string")
    terms = spark.createDataFrame([("납",), ("xy",), ("é",), ("y",), ("longer than any text",)], "_t string")
    got = sorted(((r["id"] or 0), bytes(r["_t"]).decode(), bytes(r["_after"]).decode()) for r in W.term_windows(text, terms, after=True).collect())
    assert got == [(0, "é", ""), (1, "납", "a"), (2, "xy", ""), (2, "y", "x")]
    assert W.term_windows(text, terms.limit(0)).count() == 0


def test_a_text_meets_a_term_in_one_row(spark):
    """A term in each of a text's 500 tokens is one row of the join, not one a token."""
    hay = spark.createDataFrame([(i, " ".join(f"{i}w{j}" for j in range(500))) for i in range(8)], "id long, q string")
    n = spark.createDataFrame([("w", 0), ("w1", 1), ("0w2 0w3", 2)], "term string, o int")
    out = MT.best_contained(hay, "q", n, "term", [-F.length("term"), F.col("o")], ["o"], ["id"])
    assert {r["id"]: r["o"] for r in out.collect()} == {i: 2 if i == 0 else 1 for i in range(8)}
    assert _joined_rows(out) <= 3 * 8


def test_both_ways_agree(spark):
    hay = spark.createDataFrame([(1, "a found e. coli o157 here"), (2, "colin x"), (3, "납 검출"), (4, "")], "id long, q string")
    n = spark.createDataFrame([("e. coli", 0), ("coli", 1), ("납", 2)], "term string, o int")
    for by_tokens in (False, True):
        out = MT.best_contained(hay, "q", n, "term", [-F.length("term")], ["o"], ["id"], by_tokens=by_tokens)
        assert {r["id"]: r["o"] for r in out.collect()} == {1: 0, 2: 1, 3: 2}


def test_one_character_rules_stand_alone(spark):
    rnd = random.Random(9)
    texts = ["".join(rnd.choice("xé& _1.납") for _ in range(rnd.randint(0, 8))) for _ in range(120)]
    rules = [("X", "ALL", 0), ("é", "FDA", 1), ("&", "ALL", 2), ("1", "MFDS", 3), ("𝒳", "ALL", 4)]
    rows = [(i, t, (None, "FDA", "MFDS")[i % 3]) for i, t in enumerate([*texts, "x𝒳", "𝒳x", "a 𝒳."])]
    word = lambda c: c.isalnum() or c == "_"
    stands = lambda t, k: any(c == k and not (i and word(t[i - 1])) and not (i + 1 < len(t) and word(t[i + 1])) for i, c in enumerate(t))
    want = {i: min(o for k, s, o in rules if (s == "ALL" or src is None or s == src) and stands(t, k.lower())) for i, t, src in rows
            if any((s == "ALL" or src is None or s == src) and stands(t, k.lower()) for k, s, o in rules)}
    r = spark.createDataFrame(rules, "keyword string, source string, rule_ord long")
    d = spark.createDataFrame(rows, "id long, t string, s string")
    assert {x["id"]: x["rule_ord"] for x in MT.rule_scan(d, "t", "s", r, key="id").collect()} == want
    # without such rules no text's letters are met
    assert _joined_rows(MT.rule_scan(d, "t", "s", r.withColumn("keyword", F.concat("keyword", F.lit("zz"))), key="id")) == 0


def test_sorted_words_of_spaced_out_texts_are_compared(spark):
    q = spark.createDataFrame([(1, "blue  " + " " * 300 + "\n ring"), (2, "ring blue"), (3, "ring " * 400)], "id long, q string")
    terms = MT.prepare_terms(spark.createDataFrame([("blue ring", 0)], "n string, row_ord long"), ["n"])
    assert {r["id"]: r["row_ord"] for r in MT.fuzzy_match(q, terms, key="id").collect()} == {1: 0, 2: 0}
