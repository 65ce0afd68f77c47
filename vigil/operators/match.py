"""Text-to-dictionary matching joins.

Model: the dictionary is unpivoted into ``terms(term, col_rank, row_ord, tlen)``
(one row per non-empty normalised name per match column).  Texts are
normalised and deduplicated to ``q`` before matching, matches are computed on
distinct ``q`` only and joined back to the rows by ``q``.  Every strategy is a
join producing candidate pairs followed by one ``groupBy(q)`` with ``min_by``
over the strategy's ordering key (ties always end in ``row_ord``, the
dictionary's file order).

"Contains" is not an equi-join, so it is answered by one gram index join
(``contains_pairs``): the searched side emits ``(id, gram)`` only, never its
text, and meets the needles' rarest gram in an equi-join; the candidates are
reduced to distinct ``(id, needle)``, the text is joined back once and
``instr`` verifies.  Similarity is an equi-join on term pieces
(``fuzzy_match``).  Nothing is counted, collected or forced to be broadcast
while a plan is built: sizes known at run time decide how a join is executed,
and no strategy depends on them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.text import normalize, starts_alnum, strip_pattern, strip_ws
from vigil.operators.windows import term_windows

# The reference's default thresholds.
SIMILARITY_THRESHOLD = 80
LONG_TEXT_THRESHOLD = 30
PRODUCT_MATCH_COLUMNS = ["KOR_NM", "ENG_NM"]
HAZARD_MATCH_COLUMNS = ["KOR_NM", "ENG_NM", "ABRV", "NCKNM", "TESTITM_NM"]


# ------------------------------------------------------------------ inputs

def prepare_terms(dictionary: DataFrame, cols: list, row_ord: str = "row_ord",
                  min_len: int = 1, normalizer=normalize, dedupe: bool = True) -> DataFrame:
    """Unpivot dictionary columns to ``(term, col_rank, row_ord, tlen)``.

    Null and empty names are dropped (null never matches).  With ``dedupe``
    each distinct term keeps only its smallest ``(col_rank, row_ord)``: every
    strategy's match test and score depend on the term text alone and ties end
    in ``(col_rank, row_ord)``, so the winner is unchanged while the join
    shrinks to the distinct vocabulary."""
    present = [c for c in cols if c in dictionary.columns]
    parts = [dictionary.where(F.col(c).isNotNull())
             .select(normalizer(F.col(c)).alias("term"), F.lit(i).alias("col_rank"), F.col(row_ord).alias("row_ord"))
             for i, c in enumerate(present)]
    t = reduce(lambda a, b: a.unionByName(b), parts)
    t = t.where(F.length("term") >= F.lit(max(min_len, 1)))
    if dedupe:
        t = t.groupBy("term").agg(F.min(F.struct("col_rank", "row_ord")).alias("_m")) \
            .select("term", "_m.col_rank", "_m.row_ord")
    return t.withColumn("tlen", F.length("term"))


def distinct_queries(texts: DataFrame, text_col: str, normalizer=normalize) -> DataFrame:
    """Distinct non-empty normalised texts ``q`` (partial aggregation first)."""
    return texts.select(normalizer(F.col(text_col)).alias("q")).where(F.col("q") != "").distinct()


GRAM = 3


def _distinct_grams(c: Column, k: int = GRAM) -> Column:
    """Distinct k-grams of a text (array, one regex pass with a look-ahead
    capture, then an in-row hash set; no shuffle).  Texts shorter than k give
    none."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(f"(?s)(?=(.{{{k}}}))"), 1))


def _rarest_gram(needles: DataFrame, grams_in: DataFrame | None = None) -> DataFrame:
    """``needles`` (``_n``, at least GRAM characters) with ``_g``, the rarest of
    their grams: by the needles' own grams, or by those of ``grams_in``
    (column ``_g``), where a gram that is missing there rules the needle out.
    Any choice keeps the join exact; the rarest one keeps the candidates few."""
    ex = needles.select("_n", F.explode(_distinct_grams(F.col("_n"))).alias("_g"))
    stats = (ex if grams_in is None else grams_in).groupBy("_g").agg(F.count(F.lit(1)).alias("_df"))
    counted = ex.join(stats, on="_g", how="inner" if grams_in is None else "left")
    pick = counted.groupBy("_n").agg(F.min_by("_g", F.struct(F.coalesce("_df", F.lit(0)), F.col("_g"))).alias("_g"),
                                     F.count("_df").alias("_known"), F.count(F.lit(1)).alias("_all"))
    return pick.where(F.col("_known") == F.col("_all")).select("_n", "_g")


def _row_id(key: str | None, text_col: str) -> Column:
    """What stands for a row in a shuffle: its key, or two hashes of its text."""
    own = F.col(key) if key and key != text_col else F.struct(F.xxhash64(text_col), F.hash(text_col))
    return own.alias("_h")


def contains_pairs(hay: DataFrame, hay_col: str, needles: DataFrame, needle_col: str,
                   key: str | None = None, dict_side: str = "needles") -> DataFrame:
    """All pairs ``hay ⋈ needles`` with ``hay_col`` containing ``needle_col``.

    ``key`` identifies a hay row (default: the text itself, by a hash); only it
    and the grams are shuffled, and the rows join back once per candidate.  Needles
    of at least 3 characters are indexed by their rarest 3-gram, shorter ones
    are contained exactly when they equal one of the text's 1- or 2-grams.
    ``dict_side`` says which side's grams measure rarity: the dictionary's.
    Exact, since a contained needle's grams all occur in the text; rows of one
    key or hash only add candidates, which the texts decide."""
    hid = _row_id(key, hay_col)
    n = needles.select(F.col(needle_col).alias("_n")).where(F.length("_n") > 0).distinct()
    grams = hay.select(hid, F.explode(_distinct_grams(F.col(hay_col))).alias("_g"))
    long_n = _rarest_gram(n.where(F.length("_n") >= GRAM), grams if dict_side == "hay" else None)
    short_n = n.where(F.length("_n") < GRAM).withColumn("_g", F.col("_n"))
    short_grams = hay.select(hid, F.explode(F.array_union(_distinct_grams(F.col(hay_col), 1),
                                                          _distinct_grams(F.col(hay_col), 2))).alias("_g"))
    candidates = grams.join(long_n, on="_g").unionByName(short_grams.join(short_n, on="_g")) \
        .select("_h", "_n").distinct()
    found = hay.withColumn("_h", hid).join(candidates, on="_h") \
        .where(F.instr(F.col(hay_col), F.col("_n")) > 0).drop("_h")
    return found.join(needles, found["_n"] == needles[needle_col]).drop("_n")


# Characters of a token that is copied for each of its grams.
SHORT_TOKEN = 64
# How many characters beside a space a term and a text's window are joined by.
BESIDE = 2


def best_contained(hay: DataFrame, hay_col: str, needles: DataFrame, needle_col: str, order: list, keep: list, key: list,
                   scope: tuple | None = None, min_len: int = 1, by_tokens: bool = False) -> DataFrame:
    """``(key, keep)``: for each text of ``hay`` the first by ``order`` of the ``needles`` that it contains.

    No pair of a text and a needle is made unless the needle has a place in the text.  A text's windows that may be needles
    (``term_windows``) meet them in an equi-join; one pass over a text, and what comes out of it is about a row for each needle
    in it.  With ``by_tokens``, for many millions of needles, the texts' tokens meet them.  Cut at single spaces, a text is a list of tokens, and
    a needle without a space lies inside one token.  So the distinct tokens of all texts are searched, once each, with
    ``contains_pairs``, only the first needle of each token is kept, and a text takes the first of its tokens' needles: a join
    of one row per distinct token.  A needle with ``j`` spaces lies in ``j + 1`` tokens in a row: its inner tokens are whole,
    its first part ends a token and its last part starts one.  Windows of the text meet it by the inner tokens and up to
    ``BESIDE`` characters on both outer sides; the two outer tokens decide.

    ``scope`` = (column of hay, column of needles): a needle counts where its scope is 'ALL' or equals the text's, and
    everywhere where the text has none.  Needles shorter than ``min_len`` take no part."""
    of, to = scope or (None, None)
    n = needles.where(F.length(needle_col) >= max(min_len, 1)) \
        .select(F.col(needle_col).alias("_t"), (F.col(to) if to else F.lit("ALL")).alias("_to"),
                F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *keep).alias("_w")) \
        .groupBy("_t", "_to").agg(F.min("_w").alias("_w"))
    text = hay.select(*key, F.col(hay_col).alias("_x"), (F.col(of) if of else F.lit(None).cast("string")).alias("_of"))
    if by_tokens:
        found = _in_tokens(text, n.where(~F.col("_t").contains(" ")), key) \
            .unionByName(_in_windows(text, n.where(F.col("_t").contains(" ")), key))
    else:
        found = term_windows(text, n.select("_t")).join(n.withColumn("_t", F.col("_t").cast("binary")), "_t").select(*key, "_of", "_to", "_w")
    if scope:
        found = found.where((F.col("_to") == "ALL") | F.col("_of").isNull() | (F.col("_to") == F.col("_of")))
    return found.groupBy(*key).agg(F.min("_w").alias("_w")).select(*key, *[f"_w.{c}" for c in keep])


def _in_tokens(text: DataFrame, n: DataFrame, key: list) -> DataFrame:
    """Texts with the first needle (and scope) of each of their tokens; needles have no space."""
    tokens = text.select(*key, "_of", F.explode(F.array_distinct(F.split("_x", " "))).alias("_tok")).where("_tok != ''")
    vocabulary = tokens.select("_tok").distinct()
    # short tokens go with each of their grams; a long one, such as a text without spaces, joins back
    long = contains_pairs(vocabulary.where(F.length("_tok") > SHORT_TOKEN), "_tok", n, "_t").select("_tok", "_to", "_w")
    pairs = _token_pairs_by_gram(vocabulary.where(F.length("_tok") <= SHORT_TOKEN), n).unionByName(long)
    return tokens.join(pairs.groupBy("_tok", "_to").agg(F.min("_w").alias("_w")), "_tok").select(*key, "_of", "_to", "_w")


def _token_pairs_by_gram(vocabulary: DataFrame, n: DataFrame) -> DataFrame:
    """``(_tok, _to, _w)`` of the tokens and the needles in them.  A needle has one gram, its rarest one, or is itself one of
    the token's 1- or 2-grams, so each pair comes up once."""
    long_n, short_n = n.where(F.length("_t") >= GRAM), n.where(F.length("_t") < GRAM)
    by_gram = long_n.join(_rarest_gram(long_n.select(F.col("_t").alias("_n")).distinct()).withColumnRenamed("_n", "_t"), "_t")
    grams = vocabulary.select("_tok", F.explode(_distinct_grams(F.col("_tok"))).alias("_g"))
    some = vocabulary.select("_tok", F.explode(F.array_union(_distinct_grams(F.col("_tok"), 1), _distinct_grams(F.col("_tok"), 2))).alias("_t"))
    found = grams.join(by_gram, "_g").where((F.length("_t") <= F.length("_tok")) & F.contains("_tok", "_t"))
    return found.select("_tok", "_to", "_w").unionByName(some.join(short_n, "_t").select("_tok", "_to", "_w"))


def _in_windows(text: DataFrame, n: DataFrame, key: list) -> DataFrame:
    """Texts with the needles that lie across their spaces."""
    def ends(tokens: Column, j: Column, a: Column, b: Column, at: Column) -> Column:
        """What a window of ``j + 1`` tokens is joined by: ``a`` last characters, the inner tokens, ``b`` first ones."""
        return F.concat_ws(" ", F.right(F.get(tokens, at), a), F.slice(tokens, at + 2, j - 1), F.left(F.get(tokens, at + j), b))

    parts = F.split("_t", " ")
    n = n.withColumn("_p", parts).withColumn("_j", F.size("_p") - 1).withColumn("_head", F.get("_p", F.lit(0))) \
        .withColumn("_tail", F.get("_p", F.col("_j"))).withColumn("_a", F.least(F.length("_head"), F.lit(BESIDE))) \
        .withColumn("_b", F.least(F.length("_tail"), F.lit(BESIDE)))
    n = n.withColumn("_k", ends(F.col("_p"), F.col("_j"), F.col("_a"), F.col("_b"), F.lit(0)))
    # the shapes that occur: few, as they are numbers of spaces and of at most BESIDE characters
    shapes = n.select(F.struct(F.col("_j").alias("j"), F.col("_a").alias("a"), F.col("_b").alias("b")).alias("s")).agg(F.collect_set("s")).scalar()

    shaped = text.withColumn("_shapes", shapes)
    # two tokens in a row: all pairs of neighbours at once, then what each shape takes of them
    one = F.split("_x", " ")
    pairs = shaped.where(F.exists("_shapes", lambda s: s["j"] == 1)) \
        .select(*key, "_of", F.filter("_shapes", lambda s: s["j"] == 1).alias("_shapes"),
                F.inline(F.arrays_zip(one.alias("_first"), F.slice(one, F.lit(2), F.size(one)).alias("_last")))) \
        .where(F.col("_last").isNotNull()).select(*key, "_of", "_first", "_last", F.inline("_shapes")) \
        .select(*key, "_of", F.col("j").alias("_j"), F.col("a").alias("_a"), F.col("b").alias("_b"),
                F.concat_ws(" ", F.right("_first", F.col("a")), F.left("_last", F.col("b"))).alias("_k"), "_first", "_last")

    def windows(tokens: Column, s: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(tokens) - 1 - s["j"])
        return F.when(F.size(tokens) > s["j"], F.transform(at, lambda i: F.struct(
            s["j"].alias("_j"), s["a"].alias("_a"), s["b"].alias("_b"), ends(tokens, s["j"], s["a"], s["b"], i).alias("_k"),
            F.get(tokens, i).alias("_first"), F.get(tokens, i + s["j"]).alias("_last")))).otherwise(F.array())

    # more tokens: they are bound to a variable, so they are made once per text
    every = F.flatten(F.transform(F.array(F.split("_x", " ")), lambda t: windows(t, F.col("_s"))))
    more = shaped.withColumn("_s", F.explode(F.filter("_shapes", lambda s: s["j"] > 1))).select(*key, "_of", F.inline(every))
    w = pairs.unionByName(more)
    return w.join(n, ["_j", "_a", "_b", "_k"]).where(F.endswith("_first", F.col("_head")) & F.startswith("_last", F.col("_tail"))) \
        .select(*key, "_of", "_to", "_w")


def token_pairs(hay: DataFrame, hay_col: str, needles: DataFrame, needle_col: str, key: str | None = None) -> DataFrame:
    """Pairs where a single-token needle occurs in the text as a whole word.

    Tokens are maximal runs of letters, digits and underscore (any script); a
    single-token needle is a whole word of the text exactly when it equals one
    of the text's tokens, so this is an equi-join on distinct tokens.  Only
    tokens and the row's key are shuffled; ``key`` must identify a row
    (default: the text itself, by 96 bits of hashes)."""
    hid = _row_id(key, hay_col)
    tokens = F.array_distinct(F.regexp_extract_all(F.col(hay_col), F.lit(r"[\p{L}\p{N}_]+"), 0))
    n = needles.select(F.col(needle_col).alias("_n")).distinct()
    candidates = hay.select(hid, F.explode(tokens).alias("_n")).join(n, on="_n").select("_h", "_n").distinct()
    found = hay.withColumn("_h", hid).join(candidates, on="_h").drop("_h")
    return found.join(needles, found["_n"] == needles[needle_col]).drop("_n")


SINGLE_TOKEN = r"^[\p{L}\p{N}_]+$"


def word_pairs(hay: DataFrame, hay_col: str, needles: DataFrame, needle_col: str, key: str | None = None) -> DataFrame:
    """Pairs where the needle occurs as a whole word (Unicode boundaries):
    token equi-join for single-token needles, contains + boundary regex for
    the rest."""
    single = needles.where(F.col(needle_col).rlike(SINGLE_TOKEN))
    multi = needles.where(~F.col(needle_col).rlike(SINGLE_TOKEN))
    a = token_pairs(hay, hay_col, single, needle_col, key)
    b = contains_pairs(hay, hay_col, multi, needle_col, key).where(whole_word(F.col(hay_col), F.col(needle_col)))
    return a.unionByName(b)


def _best(pairs: DataFrame, order: list, keep: list, by: str = "q") -> DataFrame:
    """One winner per ``by``: ``min_by`` over the ordering struct."""
    return _best_of(pairs, order, keep, [by])


def _best_of(pairs: DataFrame, order: list, keep: list, by: list) -> DataFrame:
    w = F.min_by(F.struct(*[F.col(c) for c in keep]), F.struct(*order)).alias("_w")
    return pairs.groupBy(*by).agg(w).select(*by, "_w.*")


# ------------------------------------------------------------------ strategies

def exact_match(q: DataFrame, terms: DataFrame, key: str = "q") -> DataFrame:
    """M2: term equals the text; winner = (col_rank, row_ord).  Equi-join.

    Every strategy takes texts as column ``q`` and returns one winner per
    ``key`` (``q`` itself for deduplicated short texts, or a row id such as a
    document id for long texts, which are then never shuffled)."""
    p = q.join(terms, q["q"] == terms["term"], "inner")
    return _best(p, [F.col("col_rank"), F.col("row_ord")], ["row_ord", "col_rank"], key)


def keyword_match(q: DataFrame, terms: DataFrame, key: str = "q") -> DataFrame:
    """M3: per column, a term containing the text (direction 0) beats a term
    contained in the text (direction 1); winner = (col_rank, direction, row_ord)."""
    fwd = first_containing(q, "q", terms, "term", [F.col("col_rank"), F.col("row_ord")], ["row_ord", "col_rank"], list(dict.fromkeys([key, "q"]))) \
        .withColumn("dir", F.lit(0))
    rev = best_contained(q, "q", terms, "term", [F.col("col_rank"), F.col("row_ord")], ["row_ord", "col_rank"], [key]).withColumn("dir", F.lit(1))
    return _best(fwd.select(key, "row_ord", "col_rank", "dir").unionByName(rev), [F.col("col_rank"), F.col("dir"), F.col("row_ord")], ["row_ord", "col_rank", "dir"], key)


def first_containing(needles: DataFrame, needle_col: str, hay: DataFrame, hay_col: str, order: list, keep: list, key: list) -> DataFrame:
    """``(key, keep)``: for each text of ``needles`` the first by ``order`` of the ``hay`` terms that contain it.

    A text of up to ``GRAM`` characters is a gram, and each gram has its first term in a table made by one aggregation: a
    one-letter text meets one row, however many terms have the letter.  A longer text without spaces lies inside one token, and
    of the terms with a token only the first matters; what has a space is searched for in the distinct terms."""
    first = hay.select(F.col(hay_col).alias("_x"), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], *keep).alias("_w")) \
        .groupBy("_x").agg(F.min("_w").alias("_w"))
    n = needles.select(*key, F.col(needle_col).alias("_n")).where(F.length("_n") > 0)
    grams = F.flatten(F.array(*[_distinct_grams(F.col("_x"), k) for k in range(1, GRAM + 1)]))
    table = first.select(F.explode(grams).alias("_n"), "_w").groupBy("_n").agg(F.min("_w").alias("_w"))
    short = n.where(F.length("_n") <= GRAM).join(table, "_n")
    tokens = first.select(F.explode(F.array_distinct(F.split("_x", " "))).alias("_x"), "_w").groupBy("_x").agg(F.min("_w").alias("_w"))
    one = n.where((F.length("_n") > GRAM) & ~F.contains("_n", F.lit(" ")))
    more = n.where((F.length("_n") > GRAM) & F.contains("_n", F.lit(" ")))
    pairs = [contains_pairs(where, "_x", what.select(F.col("_n").alias("_t")).distinct(), "_t", dict_side="hay")
             .groupBy(F.col("_t").alias("_n")).agg(F.min("_w").alias("_w")).join(what, "_n") for where, what in ((tokens, one), (first, more))]
    found = short.select(*key, "_w").unionByName(pairs[0].select(*key, "_w")).unionByName(pairs[1].select(*key, "_w"))
    return found.groupBy(*key).agg(F.min("_w").alias("_w")).select(*key, *[f"_w.{c}" for c in keep])


def whole_word(text: Column, term: Column) -> Column:
    """``term`` occurs in ``text`` as a whole word: not preceded or followed by
    a letter, digit or underscore of any script (Unicode word boundary; the
    JDK's ``\\b`` differs between versions, so it is spelled out)."""
    pat = F.concat(F.lit("(?<![\\p{L}\\p{N}_])\\Q"), term, F.lit("\\E(?![\\p{L}\\p{N}_])"))
    return F.regexp(text, pat)


def sentence_scan(q: DataFrame, terms: DataFrame, key: str = "q") -> DataFrame:
    """M4: longest term contained in the text (one-character terms need a
    non-alphanumeric next character); winner = (-tlen, col_rank, row_ord)."""
    order, keep = [-F.col("tlen"), F.col("col_rank"), F.col("row_ord")], ["row_ord", "col_rank", "tlen"]
    windows = term_windows(q.select(key, F.col("q").alias("_x")), terms.select(F.col("term").alias("_t")), after=True)
    own = terms.select(F.col("term").cast("binary").alias("_t"), *keep)
    after = F.col("_after").cast("string")
    found = windows.join(own, "_t").where((F.col("tlen") > 1) | (after == "") | ~starts_alnum(after))
    return _best(found, order, keep, key)


# Weight of the similarity of the sorted words against that of the text as it stands.
TOKEN_WEIGHT = 0.95


def sorted_words(c: Column) -> Column:
    """White-space tokens in order, joined by one space."""
    return F.array_join(F.array_sort(F.filter(F.split(c, r"\s+"), lambda x: x != "")), " ")


def _similar(texts: DataFrame, names: DataFrame, t: float, key: str) -> DataFrame:
    """``(key, term, score)`` of all pairs of ``texts`` (key, s) and ``names``
    (term, n) with ``100 (1 - levenshtein(s, n) / longer length) >= t``.

    Exact segment equi-join.  The score bounds the text's length to a band
    around the name's length L and the edits to ``k = floor(L (100 - t) / t)``.
    Cut into ``k + 1`` pieces, a name keeps one piece unedited, which the text
    has at most as far away as the edits before and after it allow.  Texts
    emit these substrings for the lengths that the names have in their band,
    names their pieces; the bounded ``levenshtein`` decides.  Texts outside
    every band, such as whole documents, emit nothing."""
    k_of = F.floor(F.col("tlen") * ((100.0 - t) / t) + 1e-9).cast("int")

    def cut(df: DataFrame) -> DataFrame:
        """Pieces of a length: number ``pi``, start ``ps`` (from 0) and length ``pl``; the last ones take the rest."""
        rest = (F.col("k") + 1) - F.pmod(F.col("tlen"), F.col("k") + 1)
        return df.withColumn("k", k_of).withColumn("pi", F.explode(F.sequence(F.lit(0), F.col("k")))) \
            .withColumn("_b", F.floor(F.col("tlen") / (F.col("k") + 1)).cast("int")) \
            .withColumn("ps", F.col("pi") * F.col("_b") + F.greatest(F.lit(0), F.col("pi") - rest)) \
            .withColumn("pl", F.col("_b") + F.when(F.col("pi") >= rest, 1).otherwise(0)).drop("_b")

    names = names.select("term", "n", F.length("n").alias("tlen")).where("tlen > 0").distinct()
    pieces = cut(names).select("tlen", "pi", F.substring("n", F.col("ps") + 1, F.col("pl")).alias("piece"), "term", "n")
    lo = F.greatest(F.ceil(F.col("tlen") * t / 100.0 - 1e-9), F.lit(1)).cast("int")
    hi = F.floor(F.col("tlen") * 100.0 / t + 1e-9).cast("int")
    lengths = cut(names.select("tlen").distinct().withColumn("qlen", F.explode(F.sequence(lo, hi))))
    banded = texts.withColumn("qlen", F.length("s")).join(lengths, on="qlen")
    d = F.col("qlen") - F.col("tlen")
    left = F.greatest(F.lit(0), F.col("ps") - F.col("pi"), F.col("ps") + d - (F.col("k") - F.col("pi")))
    right = F.least(F.col("qlen") - F.col("pl"), F.col("ps") + F.col("pi"), F.col("ps") + d + (F.col("k") - F.col("pi")))
    parts = banded.withColumn("at", F.explode(F.when(left <= right, F.sequence(left, right)))) \
        .select(key, "s", "tlen", "pi", F.substring("s", F.col("at") + 1, F.col("pl")).alias("piece"))
    near = parts.distinct().join(pieces, on=["tlen", "pi", "piece"]).select(key, "s", "term", "n").distinct()
    return near.withColumn("_m", F.greatest(F.length("s"), F.length("n"))) \
        .withColumn("_e", F.expr(f"levenshtein(s, n, cast(floor(_m * {100.0 - t} / 100 + 1e-9) as int))")).where("_e >= 0") \
        .select(key, "term", (100.0 * (1.0 - F.col("_e") / F.col("_m"))).alias("score"))


def fuzzy_match(q: DataFrame, terms: DataFrame, threshold: float = SIMILARITY_THRESHOLD, key: str = "q") -> DataFrame:
    """M5: best similarity >= threshold (over 0); winner = (-score, col_rank, row_ord).

    The similarity is ``100 (1 - levenshtein / longer length)`` of the texts as
    they stand or, if that is more, ``TOKEN_WEIGHT`` times that of their sorted
    words (declared substitute for a third-party weighted ratio)."""
    t = float(threshold)
    if t <= 0:
        raise ValueError("the threshold must be over 0")
    scored = _similar(q.select(key, F.col("q").alias("s")), terms.select("term", F.col("term").alias("n")), t, key)
    if t <= 100.0 * TOKEN_WEIGHT:
        of_words = t / TOKEN_WEIGHT - 1e-9
        # no text's words are sorted if those at its start alone are longer than any name's band
        longest = (F.lit(100.0 / of_words) * terms.agg(F.max(F.length("term"))).scalar() + 1).cast("int")
        near = q.where(F.length(F.regexp_replace(F.left("q", longest * 4 + 64), r"\s+", "")) <= longest)
        words = _similar(near.select(key, sorted_words(F.col("q")).alias("s")), terms.select("term", sorted_words(F.col("term")).alias("n")), of_words, key)
        scored = scored.unionByName(words.withColumn("score", TOKEN_WEIGHT * F.col("score")))
    best = scored.where(F.col("score") >= F.lit(t)).groupBy(key, "term").agg(F.max("score").alias("score"))
    return _best(best.join(terms, on="term"), [-F.col("score"), F.col("col_rank"), F.col("row_ord")], ["row_ord", "col_rank", "score"], key)


def materialize(df: DataFrame) -> DataFrame:
    """Cut lineage: reliable checkpoint into the session's shared checkpoint
    folder (``spark.checkpoint.dir``).  Used for the small per-stage results of
    cascades, whose plans would otherwise nest every earlier stage."""
    from vigil.session import checkpoint_dir

    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cascade(q: DataFrame, stages: list, key: str = "q", materialize_input: bool = True) -> DataFrame:
    """M7/M9: the first stage with a hit wins.  ``stages`` = [(name, fn)],
    each ``fn(q_df) -> (key, row_ord, ...)`` with one winner per key.

    With ``materialize_input`` (distinct short texts, e.g. the product types of
    a notice table) the texts are checkpointed, and so is each stage's result;
    the next stage sees only the texts that no stage has matched.  This keeps
    the dearest stage last and smallest.  Long texts keyed by a row id pass
    ``False``: their stages run on the whole input, whose texts are read and
    not written, and the first stage's winner is taken per key."""
    if not materialize_input:
        parts = [fn(q).select(key, "row_ord").withColumns({"stage": F.lit(name), "_rank": F.lit(i)})
                 for i, (name, fn) in enumerate(stages)]
        u = reduce(lambda a, b: a.unionByName(b), parts)
        return u.groupBy(key).agg(F.min_by(F.struct("row_ord", "stage"), F.col("_rank")).alias("_w")) \
            .select(key, "_w.row_ord", "_w.stage")
    rest, found = materialize(q), []
    for i, (name, fn) in enumerate(stages):
        hits = materialize(fn(rest).select(key, "row_ord").withColumn("stage", F.lit(name)))
        found.append(hits)
        if i + 1 < len(stages):
            rest = rest.join(hits.select(key), on=key, how="left_anti")
    return reduce(lambda a, b: a.unionByName(b), found)


def attach(rows: DataFrame, text_col: str, matches: DataFrame, normalizer=normalize) -> DataFrame:
    """Join per-``q`` matches back to the original rows (left join by q)."""
    return rows.withColumn("q", normalizer(F.col(text_col))).join(matches, on="q", how="left").drop("q")


# ------------------------------------------------------------------ cascades

def product_cascade(q: DataFrame, terms: DataFrame, threshold: float = SIMILARITY_THRESHOLD) -> DataFrame:
    """M7: exact -> keyword -> fuzzy."""
    return cascade(q, [("exact", lambda d: exact_match(d, terms)),
                       ("keyword", lambda d: keyword_match(d, terms)),
                       ("fuzzy", lambda d: fuzzy_match(d, terms, threshold))])


def hazard_cascade(q: DataFrame, terms: DataFrame, threshold: float = SIMILARITY_THRESHOLD,
                   long_text: int = LONG_TEXT_THRESHOLD) -> DataFrame:
    """M9: long texts (> ``long_text`` characters): scan -> exact -> keyword;
    short texts: exact -> keyword -> fuzzy."""
    long_q = q.where(F.length("q") > long_text)
    short_q = q.where(F.length("q") <= long_text)
    a = cascade(long_q, [("scan", lambda d: sentence_scan(d, terms)),
                         ("exact", lambda d: exact_match(d, terms)),
                         ("keyword", lambda d: keyword_match(d, terms))])
    b = cascade(short_q, [("exact", lambda d: exact_match(d, terms)),
                          ("keyword", lambda d: keyword_match(d, terms)),
                          ("fuzzy", lambda d: fuzzy_match(d, terms, threshold))])
    return a.unionByName(b)


def hazard_extract(q: DataFrame, terms: DataFrame, enable_fuzzy: bool = True,
                   threshold: float = SIMILARITY_THRESHOLD, key: str = "q") -> DataFrame:
    """M8: sentence scan, then (optionally) fuzzy."""
    st = [("scan", lambda d: sentence_scan(d, terms, key=key))]
    if enable_fuzzy:
        st.append(("fuzzy", lambda d: fuzzy_match(d, terms, threshold, key=key)))
    return cascade(q, st, key, materialize_input=(key == "q"))


# ------------------------------------------------------------------ rules (M6)

# Words, and other characters that stand as whole words (``whole_word``).
LONE_CHARACTER = r"(?s)[\p{L}\p{N}_]+|(?<![\p{L}\p{N}_]).(?![\p{L}\p{N}_])"


def rule_scan(texts: DataFrame, text_col: str, source_col: str | None, rules: DataFrame,
              keyword_col: str = "keyword", scope_col: str = "source", rule_ord: str = "rule_ord",
              key: str | None = None) -> DataFrame:
    """M6: rules in scope (scope 'ALL' or the text's source); keywords shorter
    than 2 characters must stand as whole words, longer ones are substrings;
    all case-insensitive.  Longest keyword wins, ties -> earliest rule.

    Without ``key``: one result per distinct (lowered text, source), columns
    ``(qt, qs, rule_ord)``.  With ``key`` (a row id, for long texts): one per
    key, columns ``(key, rule_ord)``; texts are then never deduplicated or
    shuffled."""
    src = F.col(source_col) if source_col else F.lit(None).cast("string")
    q = texts.select(*([F.col(key)] if key else []), F.lower(F.col(text_col)).alias("qt"), src.alias("qs")) \
        .where(F.col("qt").isNotNull())
    if not key:
        q = q.distinct()
    by = [key] if key else ["qt", "qs"]
    r = rules.select(F.lower(F.col(keyword_col)).alias("kw"), F.col(scope_col).alias("scope"),
                     F.col(rule_ord).alias("rule_ord")).where(F.length("kw") > 0).withColumn("klen", F.length("kw"))
    in_scope = (F.col("scope") == "ALL") | F.col("qs").isNull() | (F.col("scope") == F.col("qs"))
    order = [-F.col("klen"), F.col("rule_ord")]
    sub = best_contained(q, "qt", r, "kw", order, ["rule_ord", "klen"], by, ("qs", "scope"), min_len=2)
    letters = r.where(F.col("klen") < 2)
    alone = F.explode(F.array_distinct(F.regexp_extract_all("qt", F.lit(LONE_CHARACTER), 0)))
    lone = q.where(letters.agg(F.count(F.lit(1))).scalar() > 0).select(*dict.fromkeys([*by, "qs"]), alone.alias("kw"))
    word = _best_of(lone.join(letters, "kw").where(in_scope), order, ["rule_ord", "klen"], by)
    return _best_of(sub.unionByName(word), order, ["rule_ord"], by)


# ------------------------------------------------------------------ M12-M15

def override_hazard(titles: DataFrame, title_col: str, terms: DataFrame, boilerplate: str,
                    min_len: int = 3, key: str | None = None) -> DataFrame:
    """Strip boilerplate from the title, then the longest term (>= min_len)
    contained in it; ties -> earliest row.  Returns ``(q, row_ord)`` of the
    distinct titles, or ``(key, row_ord)`` of every row (long texts)."""
    q = titles.select(*([key] if key else []), F.lower(strip_pattern(F.col(title_col), boilerplate)).alias("q")) \
        .where(F.col("q") != "")
    return best_contained(q if key else q.distinct(), "q", terms, "term", [-F.col("tlen"), F.col("row_ord")], ["row_ord", "tlen"],
                          [key or "q"], min_len=min_len)


def override_word(titles: DataFrame, title_col: str, terms: DataFrame, min_len: int = 4, key: str | None = None) -> DataFrame:
    """The longest term (>= min_len) found as a whole word
    (case-insensitive); result as of ``override_hazard``."""
    q = titles.select(*([key] if key else []), F.lower(F.col(title_col)).alias("q")).where(F.col("q") != "")
    t = terms.where(F.col("tlen") >= min_len)
    p = word_pairs(q if key else q.distinct(), "q", t, "term", key)
    return _best(p, [-F.col("tlen"), F.col("row_ord")], ["row_ord", "tlen"], key or "q")


def suggest_category(names: DataFrame, name_col: str, cats: DataFrame, cat_col: str, cat_ord: str,
                     min_len: int = 2, token_threshold: float = 60.0, near: float = 80.0) -> DataFrame:
    """For each name, the category related by substring (either way) with
    the smallest length difference (ties -> earliest category); else the best
    token-set score above ``token_threshold``: tokens that have an equal or
    nearly equal one (similarity >= ``near``) on the other side, over the larger
    token set.  Returns ``(q, cat_ord, how)``; substring pairs come from the
    contains join, token pairs from the segment join on tokens."""
    q = names.select(F.lower(strip_ws(F.col(name_col))).alias("q")) \
        .where(F.length("q") >= min_len).distinct()
    c = cats.select(F.lower(F.col(cat_col)).alias("term"), F.col(cat_ord).alias("row_ord")) \
        .where(F.length("term") >= min_len).withColumn("tlen", F.length("term"))
    fwd = contains_pairs(q, "q", c, "term")
    rev = contains_pairs(c, "term", q.withColumnRenamed("q", "q2"), "q2", dict_side="hay") \
        .withColumnRenamed("q2", "q")
    cols = ["q", "term", "row_ord", "tlen"]
    p = fwd.select(*cols).unionByName(rev.select(*cols))
    sub = _best(p.withColumn("d", F.abs(F.length("q") - F.col("tlen"))),
                [F.col("d"), F.col("row_ord")], ["row_ord"]).withColumn("how", F.lit("substring"))
    rest = q.join(sub.select("q"), on="q", how="left_anti")
    tok = _best(_token_set_pairs(rest, c, token_threshold, near), [-F.col("score"), F.col("row_ord")], ["row_ord"])
    return sub.unionByName(tok.withColumn("how", F.lit("token")))


def _words(c: Column) -> Column:
    return F.array_distinct(F.filter(F.split(c, r"\s+"), lambda x: x != ""))


def _token_set_pairs(q: DataFrame, c: DataFrame, threshold: float, near: float) -> DataFrame:
    """``(q, term, row_ord, score)`` of all pairs whose token-set score is over ``threshold``: tokens that have a nearly equal one
    on the other side, the fewer of both sides, over the larger set.

    Set-similarity join: a score over ``threshold`` takes more than that share of each side's tokens.  So of a category's
    ``n`` tokens, in a global order by how many categories have them, one of the rarest ``n`` less those needed plus one is
    matched in every such pair, and only these are indexed: a token of all categories joins nothing but the categories that
    have no other.  The sizes of both sets bound each other before a pair is made, and a pair is then scored in its own row."""
    share = threshold / 100.0 + 1e-12
    names = q.select("q", _words(F.col("q")).alias("_a")).withColumn("nq", F.size("_a")).where("nq > 0")
    cats = c.select("term", "row_ord", _words(F.col("term")).alias("_b")).withColumn("nt", F.size("_b")).where("nt > 0")
    each = cats.select("term", "row_ord", "nt", F.explode("_b").alias("_ct"))
    often = each.groupBy("_ct").agg(F.count(F.lit(1)).alias("_df"))
    by_rarity = each.join(often, "_ct").groupBy("term", "row_ord", "nt").agg(F.array_sort(F.collect_list(F.struct("_df", "_ct"))).alias("_b"))
    needed = (F.floor(F.col("nt") * share) + 1).cast("int")
    cats = by_rarity.withColumn("_b", F.transform("_b", lambda x: x["_ct"]))
    index = cats.where(needed <= F.col("nt")).select("term", "row_ord", "nt", "_b", F.explode(F.slice("_b", F.lit(1), F.col("nt") - needed + 1)).alias("_ct"))
    tokens = names.select("q", "nq", "_a", F.explode("_a").alias("tok"))
    close = _similar(tokens.select("tok", F.col("tok").alias("s")).distinct(), index.select(F.col("_ct").alias("term"), F.col("_ct").alias("n")).distinct(), near, "tok") \
        .select("tok", F.col("term").alias("_ct"))
    candidates = tokens.join(close, "tok").join(index, "_ct").where(F.least("nq", "nt") > F.greatest("nq", "nt") * share) \
        .dropDuplicates(["q", "term", "row_ord"])

    def like(x: Column, y: Column) -> Column:
        return 100.0 * (1.0 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))) >= near - 1e-9

    def met(x: str, y: str) -> Column:
        return F.size(F.filter(x, lambda i: F.exists(y, lambda j: like(i, j))))

    scored = candidates.withColumn("score", F.round(100.0 * F.least(met("_a", "_b"), met("_b", "_a")) / F.greatest("nq", "nt"), 2))
    return scored.where(F.col("score") > threshold).select("q", "term", "row_ord", "score")


def term_coverage(terms: DataFrame, term_col: str, names: DataFrame, name_col: str,
                  examples: int = 10) -> DataFrame:
    """M15 + L5: per term ``coverage`` = exact / partial / none, the number of
    names containing it, and up to ``examples`` shortest such names (ties by
    name).  Examples come from a per-term top-k (window over the matches of one
    term, bounded by the number of names containing it)."""
    t = terms.select(F.col(term_col).alias("t"), F.lower(F.col(term_col)).alias("tl")).where(F.length("tl") > 0)
    n = names.select(F.col(name_col).alias("name"), F.lower(F.col(name_col)).alias("nl")).where(
        F.col("nl").isNotNull()).distinct()
    p = contains_pairs(n, "nl", t, "tl")
    top = top_k_per_group(p.withColumn("nlen", F.length("name")), ["t"], ["nlen", "name"], examples)
    agg = p.groupBy("t").agg(
        F.max(F.col("nl") == F.col("tl")).alias("has_exact"),
        F.count(F.lit(1)).alias("n_names"))
    ex = top.groupBy("t").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nlen", "name"))),
                                 lambda s: s["name"]), "|").alias("examples"))
    agg = agg.join(ex, on="t", how="left")
    out = t.select("t").distinct().join(agg, on="t", how="left")
    cov = (F.when(F.col("has_exact"), F.lit("exact"))
           .when(F.col("n_names") > 0, F.lit("partial")).otherwise(F.lit("none")))
    return out.select(F.col("t").alias(term_col), cov.alias("coverage"),
                      F.coalesce(F.col("n_names"), F.lit(0)).alias("n_names"),
                      F.coalesce(F.col("examples"), F.lit("")).alias("examples"))


def top_k_per_group(df: DataFrame, group_cols: list, order_cols: list, k: int, salt_buckets: int = 32) -> DataFrame:
    """Top ``k`` rows per group by ``order_cols`` (ascending), safe for hot
    groups: rank inside (group, salt) first, keep k per salt, then rank the at
    most ``k * salt_buckets`` survivors per group.  No window ever holds a
    whole hot group."""
    from pyspark.sql import Window

    order = [F.col(c) for c in order_cols]
    salted = df.withColumn("_salt", F.abs(F.hash(*[F.col(c) for c in order_cols])) % salt_buckets)
    w1 = Window.partitionBy(*group_cols, "_salt").orderBy(*order)
    stage1 = salted.withColumn("_rk", F.row_number().over(w1)).where(F.col("_rk") <= k).drop("_rk", "_salt")
    w2 = Window.partitionBy(*group_cols).orderBy(*order)
    return stage1.withColumn("_rk", F.row_number().over(w2)).where(F.col("_rk") <= k).drop("_rk")
