"""Operator 8: toxicity by misspelling-tolerant lexicon matching and context windows.

Lexicon: words, and stems that many words share, that documents labelled toxic have far more
often than others.  A word of a text is matched by running its Levenshtein automaton
(bit-parallel states, one mask for each number of edits) along the lexicon's trie; branches
whose masks are empty are cut.  Short terms take one edit, long ones two, terms under four
letters none; two swapped neighbours count as one edit.  Stems match as exact beginnings.

Every hit is then read in a window of ``WINDOW`` words: quotation marks around it or a
reporting word near it make it a quotation, an address ("you") makes it abuse.  A logistic
regression on the counts gives the score.

The lexicon and the regression are fitted on at most ``FIT_ROWS`` labelled rows (those with
the smallest hash of the id; for the lexicon, one of each group of copies); everything else
covers every row and every word.

Defined cases: null and empty texts have no hit and get the score of that; without labels of
both kinds the lexicon is empty and the prior weights hold; labels that are null, or
whose document is missing, are not learned from; repeated rows count as often as they occur;
extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from vigil.llm.common import chunks, fold, texts, with_text

FIT_ROWS = 20_000
WINDOW = 6
#: Minimum hashes of which copies share one.
COPIES = 4
CHUNK = 8 << 20
MEMORY = 500_000
THRESHOLD = 0.3
#: Log-likelihood ratio (chi-squared, one degree of freedom) that a term needs.
EVIDENCE = 28.0
STEM = (4, 5, 6, 7)

REPORTED = frozenset("said says quote quoted quotes wrote word words term called dit dites mot sagte sagt wort dijo dice palabra".split())
ADDRESSED = frozenset("you your you're youre u ur du dich dir euch vous tu te toi usted ustedes vosotros".split())
OPEN, CLOSE = "\"'“‘«„‹", "\"'”’»“›"
_CLOSING = frozenset(CLOSE)
#: Weights before any label is seen, which the fit is pulled to: intercept and the features below.
PRIOR = np.array([-3.0, 2.0, 1.0, -0.3, 0.5, 0.5, 0.5])
FEATURES = ("direct hits", "misspelled direct hits", "quoted hits", "hits near an address", "different terms", "hits in 100 words")


def edits(term: str) -> int:
    return 0 if len(term) < 4 else 1 if len(term) < 10 else 2


class Lexicon:
    """Trie of terms and stems, matched by Levenshtein automata."""

    def __init__(self, words: list[str], stems: list[str]):
        self.words, self.stems = frozenset(words), tuple(stems)
        self.trie: dict = {}
        for w in words:
            node = self.trie
            for c in w:
                node = node.setdefault(c, {})
            node[""] = w
        self.long = min((len(w) - 2 for w in words if edits(w) == 2), default=1 << 30)
        self.swappable = {w[:i] + w[i + 1] + w[i] + w[i + 2:]: w for w in sorted(words, reverse=True) if edits(w) for i in range(len(w) - 1)}
        # one edit leaves one half in its place (moved by one at most), two edits one third
        self.heads: dict[str, int] = {}
        self.tails: dict[str, int] = {}
        for w in words:  # half -> lengths (bits) of the words it points to
            if edits(w) == 1:
                for halves, half in ((self.heads, w[:len(w) // 2]), (self.tails, w[len(w) // 2:])):
                    halves[half] = halves.get(half, 0) | 7 << (len(w) - 1)
        self.head_cuts, self.tail_cuts = sorted(set(map(len, self.heads))), sorted(set(map(len, self.tails)))
        third = {re.escape(x) for w in words if edits(w) == 2 for x in (w[:len(w) // 3], w[len(w) // 3:2 * len(w) // 3], w[2 * len(w) // 3:])}
        self.third = re.compile("|".join(sorted(third))).search if third else lambda w: None
        self.sizes = range(min(map(len, self.swappable), default=0) - 2, max(map(len, self.swappable), default=-9) + 3)

    def match(self, word: str) -> tuple[str, int] | None:
        """(term, edits) of the nearest term within its allowed edits; ties to the smaller term."""
        if word in self.words:
            return word, 0
        if self.stems and word.startswith(self.stems):
            return max((s for s in self.stems if word.startswith(s)), key=len), 0
        if len(word) not in self.sizes:
            return None
        if word in self.swappable:
            return self.swappable[word], 1
        return self._nearest(word) if self._maybe(word) else None

    def _maybe(self, word: str) -> bool:
        n = len(word)
        for k in self.head_cuts:
            if (self.heads.get(word[:k], 0) | self.heads.get(word[1:k + 1], 0)) >> n & 1:
                return True
        for k in self.tail_cuts:
            if (self.tails.get(word[n - k:], 0) | self.tails.get(word[n - 1 - k:n - 1], 0)) >> n & 1:
                return True
        return n >= self.long and self.third(word) is not None

    def _nearest(self, word: str) -> tuple[str, int] | None:
        n = len(word)
        two = n >= self.long
        mask: dict[str, int] = {}
        for i, c in enumerate(word):
            mask[c] = mask.get(c, 0) | 1 << i
        full, room, best = 1 << n, (2 << n) - 1, None
        # bit i of the e-th number: some way with e edits has read i letters of the word
        stack = [(self.trie, 1, 3 & room, 7 & room if two else 0)]
        while stack:
            node, s0, s1, s2 = stack.pop()
            if "" in node and (s0 | s1 | s2) & full:
                e, term = 0 if s0 & full else 1 if s1 & full else 2, node[""]
                if e <= edits(term) and (best is None or (e, term) < best):
                    best = e, term
            for c, below in node.items():
                if c:
                    m = mask.get(c, 0)
                    n0 = (s0 & m) << 1
                    n1 = ((s1 & m) << 1 | s0 | s0 << 1 | n0 << 1) & room  # a letter extra in the term, another, extra in the word
                    n2 = ((s2 & m) << 1 | s1 | s1 << 1 | n1 << 1) & room if two else 0
                    if n0 or n1 or n2:
                        stack.append((below, n0, n1, n2))
        return (best[1], best[0]) if best else None


class _Chunks(dict):
    """White-space delimited string -> None or (term, edits), remembered."""

    def __init__(self, lexicon: Lexicon):
        super().__init__()
        self.lexicon = lexicon

    def __missing__(self, chunk: str):
        if len(self) >= MEMORY:
            self.clear()
        core = chunk.strip("#$%&*!?.,;:|()[]{}<>/\\-_=+~^`" + OPEN + CLOSE)
        found = self.lexicon.match(core)
        if found is None and core and not core.isalnum():  # parts joined by punctuation
            hits = [m for m in map(self.lexicon.match, re.findall(r"\w+", core)) if m]
            found = min(hits, key=lambda m: m[1]) if hits else None
        self[chunk] = found
        return found


def _closes(word: str) -> bool:
    return word.rstrip(".,;:!?")[-1:] in _CLOSING


def _quoted(words: list[str], i: int) -> bool:
    """A quotation that opens at or before word i, within the window, is still open there and closes after it."""
    open_ = False
    for w in words[max(0, i - WINDOW):i]:
        open_ = (open_ or w[0] in OPEN) and not (len(w) > 1 and _closes(w))
    if not open_ and words[i][0] not in OPEN:
        return False
    return any(_closes(w) for w in words[i:i + WINDOW + 1])


def features(text: str, memory: _Chunks) -> list[float]:
    words = text.lower().split()
    found = [*map(memory.__getitem__, words)]
    at = [i for i, m in enumerate(found) if m]
    if not at:
        return [0.0] * len(FEATURES)
    direct = fuzzy = quoted = addressed = 0
    terms = set()
    for i in at:
        if _quoted(words, i) or not REPORTED.isdisjoint(words[max(0, i - WINDOW):i]):
            quoted += 1
            continue
        if found[i][1]:
            fuzzy += 1
        else:
            direct += 1
            terms.add(found[i][0])
        addressed += not ADDRESSED.isdisjoint(words[max(0, i - WINDOW):i + WINDOW + 1])
    return [*np.log1p([direct, fuzzy, quoted, addressed, len(terms), 100 * (direct + fuzzy) / len(words)]).tolist()]


def fit(x: np.ndarray, y: np.ndarray, pull: float = 0.5) -> np.ndarray:
    """Logistic regression by Newton steps, ridge towards the prior weights."""
    x, w = np.hstack([np.ones((len(x), 1)), x]), PRIOR.copy()
    for _ in range(30 if len(x) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), x.T @ (p - y) + pull * (w - PRIOR))
        w = w - np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Words and stems that rows with toxic = 1 have far more often than those with 0."""
    def run(batches):
        count: dict[str, list[int]] = {}
        for b in batches:
            for t, y in zip(texts(b.column("text")), b.column("toxic").to_pylist()):
                own = set(re.findall(r"\w{3,}", t.lower()))
                for w in own:
                    count.setdefault("w" + w, [0, 0])[y] += 1
                    if y:
                        for k in STEM:
                            if len(w) > k:
                                count.setdefault("c" + w[:k] + " " + w, [0, 0])[1] += 1
                for s in {w[:k] for w in own for k in STEM if len(w) > k}:
                    count.setdefault("s" + s, [0, 0])[y] += 1
                count.setdefault("n", [0, 0])[y] += 1
        yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array([c[0] for c in count.values()], pa.int64()), pa.array([c[1] for c in count.values()], pa.int64())], ["k", "clean", "toxic"])

    counts = sample.mapInArrow(run, "k string, clean long, toxic long").groupBy("k").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).persist()
    try:
        all_ = counts.where("k = 'n'").collect()
        if not all_ or not all_[0].clean or not all_[0].toxic:
            return Lexicon([], [])
        clean, toxic = all_[0].clean, all_[0].toxic
        least = max(3, round(0.004 * toxic))
        share = toxic / (toxic + clean)
        # much more frequent, and not by chance: twice the log-likelihood gained by a rate of its own
        telling = F.expr(f"toxic >= {least} and toxic / {toxic} >= 20 * (clean + 0.5) / {clean} and "
                         f"2 * (toxic * ln(toxic / ((toxic + clean) * {share})) + clean * ln(greatest(clean, 1) / ((toxic + clean) * {1 - share}))) >= {EVIDENCE}")
        of = counts.where("k like 'c%'").groupBy(F.expr("substring_index(substring(k, 2), ' ', 1)").alias("stem")).agg(F.countDistinct("k").alias("forms"))
        stems = counts.where("k like 's%'").where(telling).withColumn("stem", F.expr("substring(k, 2)")).join(of.where("forms >= 4"), "stem").orderBy(F.desc("toxic"), "stem").toPandas()
        words = counts.where("k like 'w%'").where(telling).orderBy(F.desc("toxic"), "k").toPandas()
    finally:
        counts.unpersist()
    toxic_of = dict(zip(stems["stem"], stems["toxic"]))
    longer_by: dict[str, list[str]] = {}
    for t in toxic_of:
        longer_by.setdefault(t[:-1], []).append(t)
    kept: list[str] = []
    for s in sorted(toxic_of, key=lambda s: (len(s), s)):  # the shortest telling beginnings ...
        if not s.startswith(tuple(kept)):
            # ... lengthened as long as nearly all of their documents still have them
            while longer := [t for t in longer_by.get(s, []) if toxic_of[t] >= 0.9 * toxic_of[s]]:
                s = longer[0]
            kept.append(s)
    return Lexicon([k[1:] for k in words["k"] if not k[1:].startswith(tuple(kept))], kept)


def distinct_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` of rows that share none of ``COPIES`` minimum hashes of their word pairs: one row of each
    group of copies and near copies, so that a text which is there a thousand times speaks once."""
    def run(batches):
        for b in batches:
            out = []
            for t in texts(b.column("text")):
                words = np.array([zlib.crc32(w) for w in t.encode().lower().split()], np.uint64)
                with np.errstate(over="ignore"):
                    pairs = (words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:]) if len(words) > 1 else words
                    mixed = [pairs * np.uint64(0xD6E8FEB86659FD93 + 2 * k) ^ (pairs >> np.uint64(17 + k)) for k in range(COPIES)]
                    out.append([int((m * np.uint64(0xC2B2AE3D27D4EB4F)).min().view(np.int64)) if len(m) else 0 for m in mixed])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array([o[k] for o in out], pa.int64()) for k in range(COPIES))], ["doc_id", *(f"m{k}" for k in range(COPIES))])

    kind = docs.schema["doc_id"].dataType.simpleString()
    hashes = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"m{k} long" for k in range(COPIES)))
    for k in range(COPIES):
        hashes = hashes.groupBy(f"m{k}").agg(F.min(F.struct("doc_id", *(f"m{j}" for j in range(COPIES) if j != k))).alias("s")).select("s.*", f"m{k}")
    return hashes.select("doc_id").distinct()


def with_features(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """``keep`` columns and the features (array<double>) of every row's text."""
    sent = docs.sparkSession.sparkContext.broadcast(([*lexicon.words], [*lexicon.stems]))

    def run(batches):
        memory = _Chunks(Lexicon(*sent.value))
        for b in chunks(batches, source, CHUNK):
            f = np.array([features(t, memory) for t in texts(b.column(source))])
            values = pa.ListArray.from_arrays(pa.array(np.arange(0, f.size + 1, f.shape[1]), pa.int32()), pa.array(f.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), values], [*keep, "features"])

    df, source, schema = with_text(docs, keep)
    return df.mapInArrow(run, schema.add("features", ArrayType(DoubleType())))


def score(docs: DataFrame, labels: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id if None), held_out, score, predicted of every row."""
    keep = keep or ["doc_id"]
    held = F.coalesce(fold(F.col("doc_id"), 4) == 2, F.lit(False))
    chosen = (labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)").where(~held)
              .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(FIT_ROWS))
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # FIT_ROWS small rows
    once = sample.join(F.broadcast(distinct_texts(sample)), "doc_id")  # at most as many ids
    lexicon = learn_lexicon(once.select("text", "toxic"))
    fitted = with_features(sample.select("text", "toxic"), lexicon, ["toxic"]).toPandas() if lexicon.words or lexicon.stems else None
    weights = fit(np.array(fitted["features"].tolist()), fitted["toxic"].to_numpy(float)) if fitted is not None and len(fitted) else PRIOR
    logit = F.lit(float(weights[0]))
    for i, w in enumerate(weights[1:]):
        logit = logit + F.col("features")[i] * float(w)
    return (with_features(docs.withColumn("held_out", held), lexicon, [*keep, "held_out"])
            .withColumn("score", 1 / (1 + F.exp(-logit))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")).drop("features"))
