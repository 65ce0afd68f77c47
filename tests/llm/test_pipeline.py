"""The pipeline's stages against brute force on the smallest table, and their filters on planted rows."""
import random

import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm.test_dedup import brute_components, brute_repeats
from tests.llm.test_tokens import check_packing

SF = "/root/testdata/sf0.001"
STAGE = dict(corpus_pipeline.STAGES)


def test_stages_keep_the_columns_and_work_on_what_is_left(shipped):
    docs = shipped.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    docs = STAGE["language"](shipped, STAGE["toxicity"](shipped, docs, SF), SF)
    assert docs.columns == columns
    before = {r.doc_id: r.text for r in docs.collect()}
    near = STAGE["near_duplicates"](shipped, docs, SF)
    group = brute_components(list(before.items()), 5, 80, 100)
    kept = sorted(r.doc_id for r in near.collect())
    assert near.columns == columns and kept == sorted(i for i, (_, c) in group.items() if i == c)
    cut = STAGE["passages"](shipped, near, SF)
    want = brute_repeats([(i, before[i]) for i in kept])
    rows = {r.doc_id: r for r in cut.collect()}
    assert cut.columns == columns and sorted(rows) == kept
    for i, r in rows.items():
        assert len(before[i].encode()) - len(r.text.encode()) in range(want[i][1], want[i][1] + 6 * want[i][2] + 1) and r.n_chars == len(r.text)
    packed = STAGE["packing"](shipped, cut, SF).collect()
    check_packing(packed, {i: r.text for i, r in rows.items()}, Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")))


def test_near_duplicates_of_odd_rows(shipped, docs):
    text = " ".join("w%d" % i for i in range(50))
    rows = docs([(1, text), (1, text), (2, text), (3, None), (4, ""), (None, "alone here"), (5, text + " z")])
    got = sorted(((r.doc_id, r.text) for r in STAGE["near_duplicates"](shipped, rows, SF).collect()), key=str)
    assert got == sorted([(1, text), (3, None), (4, ""), (None, "alone here")], key=str)


def test_one_id_with_several_texts_and_rows_without_id(shipped, docs):
    one, other, third = (" ".join(f"{x}{i}" for i in range(50)) for x in "abc")
    rows = docs([(0, one), (1, other), (1, one + " z"), (7, third), (7, third + " z"), (7, third), (None, third.upper()),
                 (None, other + " y"), (None, "only without an id here"), (None, "only without an id here"), (9, ""), (9, "")])
    got = sorted(((r.doc_id, r.text) for r in STAGE["near_duplicates"](shipped, rows, SF).collect()), key=str)
    seventh = [(7, t) for t in (third, third + " z") if (7, t) in got]
    assert len(seventh) == 1
    assert got == sorted([(0, one), (1, other), *seventh, (None, "only without an id here"), (9, ""), (9, "")], key=str)


CLASHES = """score predicted held_out features lang_pred n_languages _text row doc key kept kept_text marks lo hi stays
    copies digest _id _digest _copies _row k1 k2 n rep comp member bucket n_bytes n_removed n_spans piece start length ids sequence_id offset _part"""


def test_clashing_extra_columns_pass_every_stage_unchanged(shipped, docs):
    rng = random.Random(3)
    said = [" ".join(rng.choice(["the", "and", "with", "from", "house", "river"]) for _ in range(40)) for _ in range(30)]
    rows = [*enumerate(said), (40, said[3]), (41, said[4] + " end")]
    plain, clashing = docs(rows), docs(rows, CLASHES)
    clashing = clashing.withColumn("odd name.with, signs", clashing["n"])
    for name in STAGE:
        a, b = STAGE[name](shipped, plain, SF), STAGE[name](shipped, clashing, SF)
        if name == "packing":
            key = ["doc_id", "piece", "start", "length", "ids_crc32"]
            assert sorted(map(tuple, a.select(key).collect())) == sorted(map(tuple, b.select(key).collect()))
            continue
        assert b.columns == clashing.columns
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*plain.columns).collect()))
        assert all(set(r[len(plain.columns):]) == {"x"} for r in b.collect())


def test_language_stage_drops_what_has_none(shipped, docs):
    rng = random.Random(1)
    rows = docs([(i, " ".join(rng.choice(["the", "and", "with", "from"]) for _ in range(20)), "en") for i in range(30)] + [(50, None, "en"), (51, "12 34", "en")])
    assert sorted(r.doc_id for r in STAGE["language"](shipped, rows, SF).collect()) == list(range(30))


def test_language_stage_keeps_short_texts(shipped, docs):
    rng = random.Random(1)
    rows = docs([(i, " ".join(rng.choice(["the", "and", "with", "from"]) for _ in range(20)), "en") for i in range(30)] + [(50 + i, t, None) for i, t in enumerate(["a", "ok", "A.", "中文", "..", None])])
    assert sorted(r.doc_id for r in STAGE["language"](shipped, rows, SF).collect()) == [*range(30), 50, 51, 52, 53]


def test_empty_tables_pass_every_stage(shipped, docs):
    for name in ("toxicity", "language", "near_duplicates", "passages", "packing"):
        assert STAGE[name](shipped, docs([]), SF).count() == 0
