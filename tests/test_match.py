"""Matching semantics on the reference's mock dictionaries (expectations of
its unit tests), plus brute-force equivalence of the containment strategies."""

import random

import pytest
from pyspark.sql import functions as F

from vigil.operators import match as MT

PRODUCTS = [
    ("새우", "Shrimp", "수산물", "갑각류"),
    ("냉이", "Shepherd's Purse", "농산물", "채소류"),
    ("연어", "Salmon", "수산물", "어류"),
    ("초콜릿", "Chocolate", "가공식품", "과자류"),
]
HAZARDS = [
    ("살모넬라", "Salmonella", "SAL", "살모넬라균", "살모넬라", "미생물", True, True),
    ("아플라톡신", "Aflatoxin", "AFL", "곰팡이독소", "아플라톡신", "곰팡이독소", True, True),
    ("펜디메탈린", "Pendimethalin", "PEN", "농약", "펜디메탈린", "잔류농약", True, False),
    ("대장균", "E. coli", "EC", "대장균", "대장균", "미생물", True, True),
]


@pytest.fixture(scope="module")
def product_df(spark):
    rows = [(k, e, t, u, i) for i, (k, e, t, u) in enumerate(PRODUCTS)]
    return spark.createDataFrame(rows, "KOR_NM string, ENG_NM string, top string, upper string, row_ord long")


@pytest.fixture(scope="module")
def hazard_df(spark):
    rows = [h + (i,) for i, h in enumerate(HAZARDS)]
    return spark.createDataFrame(rows, "KOR_NM string, ENG_NM string, ABRV string, NCKNM string, TESTITM_NM string, "
                                       "M_KOR_NM string, ANALYZABLE boolean, INTEREST_ITEM boolean, row_ord long")


def _product(spark, product_df, texts, threshold=80):
    q = MT.distinct_queries(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    terms = MT.prepare_terms(product_df, MT.PRODUCT_MATCH_COLUMNS)
    m = MT.cascade(q, [("exact", lambda d: MT.exact_match(d, terms)),
                       ("keyword", lambda d: MT.keyword_match(d, terms)),
                       ("fuzzy", lambda d: MT.fuzzy_match(d, terms, threshold))])
    res = {r["q"]: r["row_ord"] for r in m.collect()}
    return res


@pytest.mark.parametrize("text,expected_upper", [
    ("새우", "갑각류"), ("Shrimp", "갑각류"), ("SHRIMP", "갑각류"), ("shrimp", "갑각류"),
    ("Frozen Shrimp", "갑각류"), ("냉동 새우", "갑각류"), ("Salmn", "어류"), ("Chocolat", "과자류"),
    ("  Shrimp  ", "갑각류"), ("\tSalmon\n", "어류"),
])
def test_product_cascade(spark, product_df, text, expected_upper):
    res = _product(spark, product_df, [text])
    q = text.strip().lower()
    assert q in res
    assert PRODUCTS[res[q]][3] == expected_upper


def test_product_threshold_and_misses(spark, product_df):
    assert _product(spark, product_df, ["Shmp"], 80) == {}
    assert _product(spark, product_df, ["Shmp"], 50)["shmp"] == 0
    assert _product(spark, product_df, ["", "CompletelyUnknownProduct"]) == {}


def _hazard(spark, hazard_df, texts):
    q = MT.distinct_queries(spark.createDataFrame([(t,) for t in texts], "t string"), "t")
    terms = MT.prepare_terms(hazard_df, MT.HAZARD_MATCH_COLUMNS)
    m = MT.hazard_cascade(q, terms)
    return {r["q"]: (HAZARDS[r["row_ord"]][5], r["stage"]) for r in m.collect()}


def test_hazard_cascade(spark, hazard_df):
    texts = {
        "살모넬라": "미생물", "Salmonella": "미생물", "SAL": "미생물", "PEN": "잔류농약",
        "Aflatoxin B1": "곰팡이독소", "Salmonnella": "미생물", "Pendimetalin": "잔류농약",
        "Found E. coli": "미생물",
        "The sample analysis revealed high levels of Aflatoxin B1 in the product batch imported from China":
            "곰팡이독소",
        "Laboratory tests detected contamination with Salmonella bacteria in multiple samples from the facility":
            "미생물",
    }
    res = _hazard(spark, hazard_df, list(texts))
    for t, cls in texts.items():
        assert res[t.strip().lower()][0] == cls, t
    long_t = "the sample analysis revealed high levels of aflatoxin b1 in the product batch imported from china"
    assert res[long_t][1] == "scan"


def test_sentence_scan_prefers_longer_and_single_char_rule(spark):
    d = spark.createDataFrame([("e. coli", 0), ("e. coli o157", 1), ("황", 2), ("납", 3)], "ENG_NM string, row_ord long")
    terms = MT.prepare_terms(d, ["ENG_NM"])
    q = spark.createDataFrame([("found e. coli o157 in water",), ("황색포도상구균 검출",), ("납 검출",)], "q string")
    res = {r["q"]: r["row_ord"] for r in MT.sentence_scan(q, terms).collect()}
    assert res["found e. coli o157 in water"] == 1
    assert "황색포도상구균 검출" not in res   # one-character term followed by a letter
    assert res["납 검출"] == 3


def test_rule_scan_longest_scoped(spark):
    rules = spark.createDataFrame([
        ("lead", "ALL", 0), ("lead poisoning", "FDA", 1), ("x", "ALL", 2), ("mold", "RASFF", 3)],
        "keyword string, source string, rule_ord long")
    texts = spark.createDataFrame([
        ("Lead poisoning risk", "FDA"), ("Lead poisoning risk", "MFDS"), ("mold found", "FDA"),
        ("type x hazard", "FDA"), ("box found", "FDA")], "t string, s string")
    res = {(r["qt"], r["qs"]): r["rule_ord"] for r in MT.rule_scan(texts, "t", "s", rules).collect()}
    assert res[("lead poisoning risk", "FDA")] == 1
    assert res[("lead poisoning risk", "MFDS")] == 0
    assert ("mold found", "FDA") not in res
    assert res[("type x hazard", "FDA")] == 2
    assert ("box found", "FDA") not in res       # 'x' inside a word is not a whole word


def _brute_contains(texts, terms):
    return sorted((t, n) for t in texts for n in terms if n in t)


def test_containment_strategies_agree_with_brute_force(spark):
    rnd = random.Random(7)
    alpha = "abcde é"
    texts = sorted({"".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 40))) for _ in range(200)} - {""})
    terms = sorted({"".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 5))) for _ in range(80)})
    h = spark.createDataFrame([(t,) for t in texts], "q string")
    n = spark.createDataFrame([(t,) for t in terms], "term string")
    expected = _brute_contains(texts, terms)
    got = sorted(tuple(r) for r in MT.contains_pairs(h, "q", n, "term").select("q", "term").collect())
    assert got == expected
    # the dictionary searched for the texts, and rows identified by an id instead of the text
    rev = sorted((r["q"], r["term"]) for r in MT.contains_pairs(h, "q", n, "term", dict_side="hay").collect())
    assert rev == expected
    ids = spark.createDataFrame([(i, t) for i, t in enumerate(texts + texts)], "id long, q string")
    keyed = sorted((r["id"], r["term"]) for r in MT.contains_pairs(ids, "q", n, "term", key="id").collect())
    assert keyed == sorted((i, x) for i, t in enumerate(texts + texts) for x in terms if x in t)


def test_similarity_agrees_with_brute_force(spark):
    rnd = random.Random(3)
    word = lambda: "".join(rnd.choice("abc ") for _ in range(rnd.randint(1, 24)))
    names = sorted({word().strip() or "a" for _ in range(150)})
    texts = set()
    for t in names:
        own = list(t)
        for _ in range(rnd.randint(0, 5)):
            i = rnd.randrange(len(own) + 1)
            own[i:i + rnd.choice([0, 1])] = rnd.choice(["", "b", "c"])
        texts.add("".join(own) or "x")

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    terms = MT.prepare_terms(spark.createDataFrame([(t, i) for i, t in enumerate(names)], "n string, row_ord long"), ["n"],
                             normalizer=lambda c: c)
    q = spark.createDataFrame([(t,) for t in sorted(texts)], "q string")
    for threshold in (80, 60, 90):
        want = {}
        for t in texts:
            def score(x):
                u, v = " ".join(sorted(t.split())), " ".join(sorted(x.split()))
                words = 0.95 * (100.0 * (1.0 - edits(u, v) / max(len(u), len(v)))) if u and v else 0.0
                return max(100.0 * (1.0 - edits(t, x) / max(len(t), len(x))), words)

            best = min((-score(x), i) for i, x in enumerate(names))
            if -best[0] >= threshold:
                want[t] = best[1]
        got = [(r["q"], r["row_ord"]) for r in MT.fuzzy_match(q, terms, threshold).collect()]
        assert sorted(got) == sorted(want.items()), threshold


def test_whole_word_pairs_unicode(spark):
    h = spark.createDataFrame([("vieux enenretionré x",), ("a lead-free b",), ("plomb",)], "q string")
    n = spark.createDataFrame([("enenretionr",), ("lead",), ("x",), ("lead-free",), ("plomb",)], "term string")
    got = sorted(tuple(r) for r in MT.word_pairs(h, "q", n, "term").select("q", "term").collect())
    assert got == [("a lead-free b", "lead"), ("a lead-free b", "lead-free"), ("plomb", "plomb"),
                   ("vieux enenretionré x", "x")]


def test_fuzzy_scores(spark):
    q = spark.createDataFrame([("salmn",), ("salmonnella",), ("pendimetalin",), ("shmp",)], "q string")
    d = spark.createDataFrame([("salmon", 0), ("salmonella", 1), ("pendimethalin", 2), ("shrimp", 3)],
                              "ENG_NM string, row_ord long")
    terms = MT.prepare_terms(d, ["ENG_NM"])
    res = {r["q"]: (r["row_ord"], round(r["score"], 1)) for r in MT.fuzzy_match(q, terms, 80).collect()}
    assert res == {"salmn": (0, 83.3), "salmonnella": (1, 90.9), "pendimetalin": (2, 92.3)}


def test_fuzzy_of_swapped_words(spark):
    q = spark.createDataFrame([("frozen fish fillet",)], "q string")
    terms = MT.prepare_terms(spark.createDataFrame([("fillet fish frozen", 0), ("frozen meat", 1)], "n string, row_ord long"), ["n"])
    r = MT.fuzzy_match(q, terms, 80).collect()
    assert [(x["row_ord"], x["score"]) for x in r] == [(0, 95.0)]


def test_suggest_by_nearly_equal_tokens(spark):
    names = spark.createDataFrame([("frozen fishs",), ("dried tea leaf",)], "name string")
    cats = spark.createDataFrame([("fish frozen", 0), ("tea", 1), ("dryed leaf teas mix", 2)], "cat string, o long")
    got = {r["q"]: (r["row_ord"], r["how"]) for r in MT.suggest_category(names, "name", cats, "cat", "o").collect()}
    assert got == {"frozen fishs": (0, "token"), "dried tea leaf": (1, "substring")}


def test_term_coverage_and_suggest(spark):
    names = spark.createDataFrame([("red ring",), ("ring",), ("blue bolt",)], "name string")
    terms = spark.createDataFrame([("ring",), ("bolt",), ("gear",)], "term string")
    cov = {r["term"]: (r["coverage"], r["n_names"], r["examples"])
           for r in MT.term_coverage(terms, "term", names, "name").collect()}
    assert cov == {"ring": ("exact", 2, "ring|red ring"), "bolt": ("partial", 1, "blue bolt"), "gear": ("none", 0, "")}
    cats = spark.createDataFrame([("ring", 0), ("bolt blue", 1)], "cat string, o long")
    sug = {r["q"]: (r["row_ord"], r["how"]) for r in MT.suggest_category(names, "name", cats, "cat", "o").collect()}
    assert sug == {"red ring": (0, "substring"), "ring": (0, "substring"), "blue bolt": (1, "token")}


def _first(pairs):
    best = {}
    for k, w in pairs:
        best[k] = min(best.get(k, w), w)
    return best


def test_longest_term_agrees_with_brute_force(spark):
    """Terms with and without spaces, at both ends of tokens, over several tokens, in long tokens and with scopes."""
    rnd = random.Random(11)
    alpha = "abc é\n"
    texts = sorted({"".join(rnd.choice(alpha) for _ in range(rnd.randint(0, 60))) for _ in range(150)} | {"abcab" * 40, "a" * 70 + " b c", "  ", "a  b", ""})
    terms = sorted({"".join(rnd.choice(alpha) for _ in range(rnd.randint(1, 9))) for _ in range(250)} | {" a", "b ", "a  b", " ", "abcab" * 14})
    rows = [(i, t, rnd.choice(["s1", "s2", None])) for i, t in enumerate(texts + texts)]
    dictionary = [(t, i % 7, i, rnd.choice(["ALL", "s1", "s2"])) for i, t in enumerate(terms + terms[:50])]
    hay = spark.createDataFrame(rows, "id long, q string, src string")
    n = spark.createDataFrame(dictionary, "term string, rank int, o long, scope string").withColumn("tlen", F.length("term"))
    order, keep = [-F.col("tlen"), F.col("rank"), F.col("o")], ["o", "tlen"]
    got = {r["id"]: r["o"] for r in MT.best_contained(hay, "q", n, "term", order, keep, ["id"], min_len=2).collect()}
    want = _first((i, (-len(t), k, o)) for i, q, _ in rows for t, k, o, _ in dictionary if len(t) >= 2 and t in q)
    assert got == {i: w[2] for i, w in want.items()}
    scoped = {r["id"]: r["o"] for r in MT.best_contained(hay, "q", n, "term", order, keep, ["id"], ("src", "scope")).collect()}
    want = _first((i, (-len(t), k, o)) for i, q, s in rows for t, k, o, c in dictionary if t in q and (c == "ALL" or s is None or c == s))
    assert scoped == {i: w[2] for i, w in want.items()}


def test_text_meets_no_term_twice(spark):
    """What a text costs is its distinct tokens, not its terms: 2,000 places and 300 terms in every text, one row a token."""
    tokens = [f"w{i}salmonella{i}" for i in range(20)]
    vocabulary = spark.createDataFrame([(t,) for t in tokens], "_tok string")
    terms = [f"{a}{b}" for a in "wsalmonel" for b in "salmonel"] + ["salmonella"]
    n = spark.createDataFrame([(t, "ALL", (-len(t), i)) for i, t in enumerate(terms)], "_t string, _to string, _w struct<a:int,b:int>")
    pairs = MT._token_pairs_by_gram(vocabulary, n)
    assert pairs.count() == sum(t in k for t in terms for k in tokens)  # a pair once, whatever its places in the token
    key = ["id"]
    text = spark.createDataFrame([(i, " ".join(tokens * 100), None) for i in range(30)], "id long, _x string, _of string")
    assert MT._in_tokens(text, n, key).count() == 30 * len(tokens)
    assert MT._in_windows(text, n.where(F.col("_t").contains(" ")), key).count() == 0
    spaced = spark.createDataFrame([("la0 w1", "ALL", (0, 0)), ("a1 w2sal", "ALL", (0, 1)), ("x1 w2sal", "ALL", (0, 2))], n.schema)
    assert MT._in_windows(text.limit(1), spaced, key).count() == 100 + 100


def test_one_character_terms_look_behind_their_first_place(spark):
    q = spark.createDataFrame([("xa a",), ("a. ab",), ("납 검출",), ("납검출 납",), ("b",)], "q string")
    terms = MT.prepare_terms(spark.createDataFrame([("a", 0), ("납", 1), ("b", 2)], "n string, row_ord long"), ["n"])
    got = {r["q"]: r["row_ord"] for r in MT.sentence_scan(q, terms).collect()}
    assert got == {"xa a": 0, "a. ab": 0, "납 검출": 1, "b": 2}


def test_keyword_match_agrees_with_brute_force(spark):
    rnd = random.Random(5)
    make = lambda n: {"".join(rnd.choice("ab é") for _ in range(rnd.randint(1, n))).strip() for _ in range(150)} - {""}
    terms, texts = sorted(make(12)), sorted(make(7) | {"a", "b", "ab", "é"})
    t = spark.createDataFrame([(x, i % 3, i) for i, x in enumerate(terms)], "term string, col_rank int, row_ord int").withColumn("tlen", F.length("term"))
    q = spark.createDataFrame([(x,) for x in texts], "q string")
    want = _first([(x, (i % 3, 0, i)) for x in texts for i, y in enumerate(terms) if x in y] + [(x, (i % 3, 1, i)) for x in texts for i, y in enumerate(terms) if y in x])
    got = {r["q"]: (r["col_rank"], r["dir"], r["row_ord"]) for r in MT.keyword_match(q, t).collect()}
    assert got == want
    ids = spark.createDataFrame([(i, x) for i, x in enumerate(texts + texts)], "id long, q string")
    got = {r["id"]: (r["col_rank"], r["dir"], r["row_ord"]) for r in MT.keyword_match(ids, t, key="id").collect()}
    assert got == {i: want[x] for i, x in enumerate(texts + texts) if x in want}


def _joined_rows(df):
    """Most rows that any join of the plan gave out, after it has run."""
    df.collect()
    most, todo = 0, [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        if "Join" in name and node.metrics().contains("numOutputRows"):
            most = max(most, node.metrics().apply("numOutputRows").value())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return most


def test_one_letter_text_meets_one_row(spark):
    terms = spark.createDataFrame([(f"xa {i}", 0, i) for i in range(3000)], "term string, col_rank int, row_ord int").withColumn("tlen", F.length("term"))
    q = spark.createDataFrame([("a",), ("xa",)], "q string")
    df = MT.first_containing(q, "q", terms, "term", [F.col("col_rank"), F.col("row_ord")], ["row_ord"], ["q"])
    assert _joined_rows(df) <= 10
    assert sorted(map(tuple, df.collect())) == [("a", 0), ("xa", 0)]


def test_token_in_every_name_makes_no_pairs_of_all(spark):
    names = spark.createDataFrame([(f"frozen kind{i:04d}xyz",) for i in range(400)], "q string")
    cats = spark.createDataFrame([(f"sort{i:04d}abc frozen", i) for i in range(400)] + [("kind0007xyz frozen", 500), ("kind0008xyy frozen", 501)], "term string, row_ord int")
    df = MT._token_set_pairs(names, cats, 60.0, 95.0)
    assert _joined_rows(df) < 4000  # 160,000 pairs share the token
    assert sorted((r["q"], r["row_ord"], r["score"]) for r in df.collect()) == [("frozen kind0007xyz", 500, 100.0)]


def test_token_sets_agree_with_brute_force(spark):
    rnd = random.Random(6)
    word = lambda: rnd.choice(["fish", "fishs", "frozen", "frozn", "tea", "teas", "red", "leaf", "leafs", "mix"])
    make = lambda: " ".join(word() for _ in range(rnd.randint(1, 5)))
    names, cats = sorted({make() for _ in range(80)}), sorted({make() for _ in range(60)})
    near = lambda a, b: 100.0 * (1 - _edits(a, b) / max(len(a), len(b))) >= 80
    want = {}
    for x in names:
        for i, y in enumerate(cats):
            a, b = set(x.split()), set(y.split())
            s = round(100.0 * min(sum(any(near(u, v) for v in b) for u in a), sum(any(near(u, v) for u in a) for v in b)) / max(len(a), len(b)), 2)
            if s > 60:
                want[x, i] = s
    q = spark.createDataFrame([(x,) for x in names], "q string")
    c = spark.createDataFrame([(y, i) for i, y in enumerate(cats)], "term string, row_ord int")
    assert {(r["q"], r["row_ord"]): r["score"] for r in MT._token_set_pairs(q, c, 60.0, 80.0).collect()} == want


def _edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]
