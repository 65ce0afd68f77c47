"""Operator 10: n-gram Jaccard join by universe partition and the pigeonhole principle.

A document is the set of its word shingles (64-bit hashes).  Documents with equal sets form
a class; the join runs on classes.  Classes are put into size bands.  If two sets are
similar enough and the smaller has s elements, they differ in at most D(s) elements.  A band
cuts the universe of hashes into m segments; by the pigeonhole principle two similar sets
agree on some segment as a whole, or, for segments that get an allocation of two, up to one
element.  Every class is indexed under the signature of each segment in its own band and in
each lower band that a similar smaller set can be in; segments with an allocation of two
are indexed with their one-deletion neighbourhood as well.  ``layout`` picks segments and
allocations of a band by cost: index entries against the chance of segments so small that
unrelated sets agree on them.  Empty segments tell nothing; a class leaves them out if it
keeps more segments than can differ, which loses no pair as either side then finds a
non-empty segment in common.

Classes that share a signature are a bucket.  Buckets are never expanded into all pairs:
each member is first compared with one centre, the links are joined to components, and only
pairs that a bucket holds across different components are compared afterwards (parity
sketches, whose difference can't exceed that of the sets, sort out most without a text).
Every comparison that counts is exact, on the whole texts.  Pairs of one component are not
compared again, as they can't change it.

Defined cases: null or empty text, or text without words: empty set, linked with nothing;
fewer words than a shingle: the whole sequence is one shingle; documents with equal sets
(also equal or null ids) are one class, and a component's id is the smallest id that is not
null; rows without an id link and bridge like others; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import chunks, cut, lean, sweep

CHUNK = 2 << 20
#: Words a worker remembers the hash of.
MEMORY = 200_000
#: Index entries that one segment of at most one element (two with deletions) is held to cost.
SMALL_SEGMENT = 8
#: Bits of a parity sketch.
SKETCH = 2048
#: Index entries in a partition of the index.
PART = 1_000_000
BAND = 1.25
#: Edges in a partition of the component steps.
EDGES = 200_000
#: Members in a block of sketches.
BLOCK = 1024
#: Rounds of comparisons with centres.
STARS = 2
U = np.uint64


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMORY:
            self.clear()
        value = self[word] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        return value


_WORDS = _Words()


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def shingles(text: bytes, k: int) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; A-Z lower-cased, words between ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    with np.errstate(over="ignore"):
        out = np.full(n, min(len(h), k), np.uint64)
        for i in range(min(k, len(h))):
            out = mix(out * U(0x9E3779B97F4A7C15) + h[i:i + n])
    return np.unique(out)


def difference(size: int, num: int, den: int) -> int:
    """Most elements in which a set of ``size`` and a larger one of similarity num/den or more differ."""
    return size * (den - num) // num


@lru_cache(maxsize=4096)
def band(b: int) -> tuple[int, int]:
    """Sizes of band b: from, up to but not including."""
    lo = 1
    for _ in range(b):
        lo = max(lo + 1, int(lo * BAND))
    return lo, max(lo + 1, int(lo * BAND))


@lru_cache(maxsize=65536)
def band_of(size: int) -> int:
    b = 0
    while band(b)[1] <= size:
        b += 1
    return b


@lru_cache(maxsize=4096)
def layout(b: int, num: int, den: int) -> tuple[int, int, bool]:
    """(D, segments, whether with deletions) of band b, the cheaper of two allocations."""
    lo, hi = band(b)
    d = difference(hi - 1, num, den)
    if d == 0:
        return 0, 0, False  # similar sets of this band are equal

    def small(m: int, most: int) -> float:
        mean = lo / m
        return m * math.exp(-mean) * sum(mean ** i / math.factorial(i) for i in range(most + 1))

    exact = d + 1
    while exact - exact * math.exp(-lo / exact) - 1.5 * math.sqrt(exact * math.exp(-lo / exact)) < d + 1 and exact < 2 * d + 4:
        exact += 1  # room for empty segments
    twice = d // 2 + 1  # 2 * twice >= d + 1
    if twice + hi + SMALL_SEGMENT * small(twice, 2) < exact + SMALL_SEGMENT * small(exact, 1):
        return d, twice, True
    return d, exact, False


def signatures(h: np.ndarray, num: int, den: int) -> np.ndarray:
    """Index entries of a set (sorted hashes)."""
    n, out = len(h), []
    with np.errstate(over="ignore"):
        value = mix(h + U(0x9E3779B97F4A7C15))
        sums = np.append(U(0), np.cumsum(value, dtype=np.uint64))
        for b in range(band_of(-(-n * num // den)), band_of(n) + 1):
            d, m, deletions = layout(b, num, den)
            if not m:
                continue
            bounds = (np.arange(1, m, dtype=np.float64) * (2.0 ** 64 / m)).astype(np.uint64)
            cuts = np.concatenate([[0], np.searchsorted(h, bounds), [n]])
            seg = mix(np.arange(m, dtype=np.uint64) + U(b << 32))
            sig = mix(sums[cuts[1:]] - sums[cuts[:-1]] + seg)
            if deletions:
                of = np.repeat(np.arange(m), np.diff(cuts))
                out += [sig, mix((sums[cuts[1:]] - sums[cuts[:-1]] + seg)[of] - value)]
            else:
                full = np.diff(cuts) > 0
                out.append(sig[full] if np.count_nonzero(full) > d else sig)
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def key(h: np.ndarray) -> tuple[int, int]:
    """128-bit name of a set as two signed numbers."""
    a, b = np.frombuffer(hashlib.blake2b(h.tobytes(), digest_size=16).digest(), "<i8")
    return int(a), int(b)


def _bytes(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def sets(docs: DataFrame, k: int, digest: Column | None = None) -> DataFrame:
    """(doc_id, n, k1, k2): size and name of every document's set; ``digest``, if given, travels along under that name."""
    def run(batches):
        for b in chunks(batches, "text", CHUNK):
            got = [shingles(t, k) for t in _bytes(b.column("text"))]
            names = [key(h) for h in got]
            own = [b.column("doc_id"), pa.array([len(h) for h in got], pa.int64()), pa.array([a for a, _ in names], pa.int64()), pa.array([c for _, c in names], pa.int64())]
            yield pa.RecordBatch.from_arrays([*own, *b.columns[2:]], ["doc_id", "n", "k1", "k2", *b.schema.names[2:]])

    more = [] if digest is None else [digest.alias("digest")]
    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)
            .mapInArrow(lean(run, _WORDS), "doc_id long, n long, k1 long, k2 long" + (", digest binary" if more else "")))


def _index(docs: DataFrame, k: int, num: int, den: int, parts: int) -> DataFrame:
    """(part, names, counts, entries): each task's index entries of a partition in one packed row."""
    def run(batches):
        for b in chunks(batches, "text", CHUNK):
            seen, names, owner, entries = set(), [], [], []
            for t in _bytes(b.column("text")):
                h = shingles(t, k)
                if not len(h) or (name := key(h)[0]) in seen:
                    continue
                seen.add(name)
                sig = np.unique(signatures(h, num, den))
                owner.append(np.full(len(sig), len(names), np.uint32)), entries.append(sig), names.append(name)
            if not entries or not sum(map(len, entries)):
                continue
            own, sig, names = np.concatenate(owner), np.concatenate(entries), np.array(names, np.int64)
            part = ((sig >> U(32)) % U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            own, sig, part = own[order], sig[order], part[order]
            ends = np.flatnonzero(np.append(part[1:] != part[:-1], True)) + 1
            rows = []
            for lo, hi in zip(np.append(0, ends[:-1]), ends):
                who, count = np.unique(own[lo:hi], return_counts=True)  # ascending, as the entries are
                rows.append((int(part[lo]), names[who].tobytes(), count.astype("<u4").tobytes(), sig[lo:hi].view(np.uint8).reshape(-1, 8)[:, :6].tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["part", "names", "counts", "entries"])

    schema = "part long, names binary, counts binary, entries binary"
    return docs.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(run, _WORDS), schema)


def _grouped(sig: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, member) of all signatures with two different members or more; equal buckets once."""
    order = np.lexsort((name, sig))
    sig, name = sig[order], name[order]
    keep = np.append(True, (sig[1:] != sig[:-1]) | (name[1:] != name[:-1]))
    sig, name = sig[keep], name[keep]
    start = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
    size = np.diff(np.append(start, len(sig)))
    with np.errstate(over="ignore"):
        whole = mix(np.add.reduceat(mix(name.view(np.uint64)), start) + size.astype(np.uint64))
    many = np.flatnonzero(size > 1)
    _, first = np.unique(whole[many], return_index=True)
    chosen = many[first]
    at = np.repeat(start[chosen] - np.append(0, np.cumsum(size[chosen])[:-1]), size[chosen]) + np.arange(size[chosen].sum())
    return np.repeat(whole[chosen].view(np.int64), size[chosen]), name[at]


def buckets(docs: DataFrame, k: int, num: int, den: int, parts: int) -> DataFrame:
    """(bucket, member): classes that share a signature."""
    def run(batches):
        held: dict[int, list] = {}

        def out(lists):
            name = np.concatenate([np.repeat(np.frombuffer(a, "<i8"), np.frombuffer(c, "<u4")) for a, c, _ in lists])
            raw = np.zeros((len(name), 8), np.uint8)
            raw[:, :6] = np.frombuffer(b"".join(e for _, _, e in lists), np.uint8).reshape(-1, 6)
            bucket, member = _grouped(raw.view("<u8").ravel(), name)
            for lo in range(0, len(bucket), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(bucket[lo:lo + 100_000]), pa.array(member[lo:lo + 100_000])], ["bucket", "member"])

        last = None
        for b in batches:
            for part, *row in zip(*(c.to_pylist() for c in b.columns)):
                if part != last and last is not None:
                    yield from out(held.pop(last))
                last = part
                held.setdefault(part, []).append(row)
        for lists in held.values():
            yield from out(lists)

    return (_index(docs, k, num, den, parts).repartition(parts, "part").sortWithinPartitions("part")
            .mapInArrow(lean(run), "bucket long, member long").distinct())


def components(links: DataFrame) -> DataFrame:
    """(node, comp): smallest node that each node of ``links`` (a, b) reaches, by alternating
    large-star and small-star steps; every step is an aggregation and a join."""
    edges = links.select("a", "b").where("a <> b")
    state, parts = None, max(1, math.ceil(edges.count() / EDGES))
    while True:
        edges = edges.coalesce(parts)  # few edges need few tasks and files
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(parts).distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").coalesce(parts)
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").coalesce(parts).distinct()
        edges = cut(small.coalesce(parts))
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).union(edges.select(F.col("b"), F.col("b"))).distinct()


def parity(h: np.ndarray) -> bytes:
    bits = np.bincount((h >> U(20)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
    return np.packbits(bits.astype(np.uint8)).tobytes()


def _sketched(rows: DataFrame, k: int) -> DataFrame:
    """(member, n, text) plus the sketch."""
    def run(batches):
        for b in batches:
            made = [parity(shingles(t, k)) for t in _bytes(b.column("text"))]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.binary())], ["member", "n", "text", "sketch"])

    return rows.select("member", "n", "text").mapInArrow(lean(run, _WORDS), "member long, n long, text string, sketch binary")


def _close(mixed: DataFrame, members: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b) of different components in one bucket, a from outside its largest one, whose sketches differ in no
    more places than similar sets can.

    Members travel in blocks with their sketches, and blocks of a bucket are compared as matrices,
    so neither a bucket of many members nor its pairs become rows."""
    rows = mixed.join(members.select("member", "n", "sketch"), "member")
    counts = mixed.groupBy("bucket").count()
    dealt = rows.join(counts, "bucket").withColumn("_block", F.pmod(F.xxhash64("member", F.lit(3)), F.ceil(F.col("count") / BLOCK)))
    packed = dealt.groupBy("bucket", "_block").agg(
        F.collect_list(F.struct("member", "comp", "n", "sketch", (F.col("comp") != F.col("major")).alias("outside"))).alias("block"),
        F.bool_or(F.col("comp") != F.col("major")).alias("some"))

    def unpacked(cell) -> tuple:
        own = cell.values
        member, comp, n = (own.field(i).to_numpy() for i in range(3))
        sketch = np.frombuffer(b"".join(own.field(3).to_pylist()), np.uint64).reshape(len(member), -1)
        return member, comp, n, sketch, own.field(4).to_numpy(zero_copy_only=False)

    def run(batches):
        for batch in batches:
            a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
            for one, other in zip(*batch.columns):
                *x, outside = unpacked(one)
                xm, xc, xn, xs = (v[outside] for v in x)
                ym, yc, yn, ys, _ = unpacked(other)
                for lo in range(0, len(xm), 32):
                    part = slice(lo, lo + 32)
                    least, most = np.minimum(xn[part, None], yn), np.maximum(xn[part, None], yn)
                    may = (xc[part, None] != yc) & (den * least >= num * most)
                    i, j = np.nonzero(may)
                    far = np.bitwise_count(xs[part][i] ^ ys[j]).sum(1, dtype=np.int64)
                    near = far <= least[i, j] * (den - num) // num
                    u, v = xm[part][i[near]], ym[j[near]]
                    a.append(np.maximum(u, v)), b.append(np.minimum(u, v))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    left, right = packed.where("some").select("bucket", F.col("block").alias("one")), packed.select("bucket", F.col("block").alias("other"))
    return left.join(right, "bucket").select("one", "other").mapInArrow(lean(run), "a long, b long").distinct()


def _verified(pairs: DataFrame, members: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The (a, b) whose sets are similar enough, by exact comparison of the whole texts."""
    def run(batches):
        last, x = None, None
        for batch in batches:
            a, b, ta, tb = (c for c in batch.columns)
            ok = []
            ids, own, other = a.to_pylist(), _bytes(ta), _bytes(tb)
            for i, t, u in zip(ids, own, other):
                if i != last:
                    last, x = i, shingles(t, k)
                y = shingles(u, k)
                both = np.concatenate([x, y])
                both.sort()
                same = int(np.count_nonzero(both[1:] == both[:-1]))
                ok.append(den * same >= num * (len(both) - same))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(keep), b.filter(keep)], ["a", "b"])

    left, right = (members.select(F.col("member").alias(x), F.col("text").alias("t" + x)) for x in "ab")
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "ta", "tb").mapInArrow(lean(run, _WORDS), "a long, b long")


def join(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: documents link when
    den * intersection >= num * union of their k-word shingle sets."""
    named, of = linked(docs, cut(sets(docs, k)), k, num, den)
    least = of.groupBy("comp").agg(F.min("rep").alias("component_id"))
    final = of.join(least, "comp").select("k1", "k2", "component_id")
    return (named.join(final, ["k1", "k2"], "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")))


def one_of_each(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The rows of ``docs`` (any columns but ``_id``, ``_digest`` and ``_copies``) without near copies: of each component
    of linked rows one stays, that of the smallest id that is not null, at equal ids that of the smallest digest of its text; rows
    without words all stay.

    A row is told by its id and its text, so rows of one id with different texts are judged each by its own text,
    and of rows with equal id and text one stays."""
    text = F.col("text").cast("string")
    digest = F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    named = cut(sets(docs, k, digest))
    _, of = linked(docs, named, k, num, den)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest"))
    rows = named.where("n > 0").join(of.select("k1", "k2", "comp"), ["k1", "k2"])
    stays = rows.groupBy("comp").agg(first.alias("s")).select("s.doc_id", "s.digest", F.lit(True).alias("stays"))
    copies = rows.groupBy("doc_id", "digest").agg(F.count("*").alias("copies"))
    same = copies["doc_id"].eqNullSafe(stays["doc_id"]) & (copies["digest"] == stays["digest"])
    told = cut(copies.join(stays, same, "left").where("stays is null or copies > 1")
               .select(copies["doc_id"].alias("_id"), copies["digest"].alias("_digest"), F.when(F.col("stays"), F.col("copies")).alias("_copies")))
    keyed = docs.withColumn("_row", digest)
    here = keyed["doc_id"].cast("long").eqNullSafe(F.col("_id")) & (keyed["_row"] == F.col("_digest"))
    kept = keyed.join(told, here, "left_anti").select(*docs.columns)
    again = told.where("_copies > 1")  # rows that stay and are there several times
    if again.limit(1).count() == 0:  # nothing to add, and no second reading of the texts
        return kept
    return kept.unionByName(keyed.join(again, here, "left_semi").dropDuplicates(["doc_id", "_row"]).select(*docs.columns))


def linked(docs: DataFrame, named: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """``named`` (the ``sets`` of ``docs``), and (k1, k2, rep, comp): component and smallest id of every class."""
    spark: SparkSession = docs.sparkSession
    total = named.agg(F.sum("n")).first()[0] or 0
    classes = named.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"))
    parts = max(1, math.ceil(2.5 * total * (den - num) / num / PART), math.ceil(2.5 * named.count() / PART))
    found = cut(buckets(docs, k, num, den, parts))
    sweep(spark)

    # texts and sketches of the classes that are in a bucket, once
    wanted = found.select(F.col("member").alias("k1")).distinct().join(classes, "k1")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text"))
    # equal ids may stand for other texts: the name of the text's set decides
    own = texts.join(wanted.select("rep", "k1", "n"), "rep")
    own = own.select(F.col("k1").alias("member"), "n", "text") if _unique_ids(named) else _checked(own, k)
    # classes that stand in rows without an id alone
    members = cut(_sketched(own.unionByName(_nameless(texts, wanted, k)), k))

    sweep(spark)

    def sized(pairs: DataFrame) -> DataFrame:
        side = [members.select(F.col("member").alias(x), F.col("n").alias("n" + x)) for x in "ab"]
        return pairs.join(side[0], "a").join(side[1], "b").where(f"least(na, nb) * {den} >= greatest(na, nb) * {num}")

    # first each member with one centre: of each bucket the member that is in most company, of a member's
    # buckets the centre that most of them have; then the same for what is not in a bucket's largest component
    weight = cut(found.join(found.groupBy("bucket").count(), "bucket").groupBy("member").agg(F.sum("count").alias("weight")))
    held = found.join(weight, "member")
    links, comp = None, None
    for _ in range(STARS):
        centre = held.groupBy("bucket").agg(F.max_by("member", F.struct("weight", "member")).alias("b"))
        stars = held.withColumnRenamed("member", "a").join(centre, "bucket").where("a <> b").groupBy("a", "b").count()
        best = stars.groupBy("a").agg(F.max_by("b", F.struct("count", F.col("b"))).alias("b"))
        more = _verified(sized(best), members, k, num, den)
        links = cut(more if links is None else links.union(more))
        comp = components(links)
        placed = found.join(comp.withColumnRenamed("node", "member"), "member", "left").select("bucket", "member", F.coalesce("comp", "member").alias("comp"))
        per = placed.groupBy("bucket", "comp").count().groupBy("bucket").agg(F.max_by("comp", F.struct("count", "comp")).alias("major"), F.count("*").alias("comps")).where("comps > 1")
        mixed = cut(placed.join(per, "bucket").select("bucket", "member", "comp", "major"))
        held = mixed.where("comp <> major").join(weight, "member")

    # then whatever a bucket still holds across components, from outside its largest component
    close = _close(mixed, members, num, den)
    sweep(spark)
    more = cut(_verified(sized(close), members, k, num, den))
    comp = cut(components(links.union(more)))
    sweep(spark)

    # components of the classes
    return named, classes.join(comp.withColumnRenamed("node", "k1"), "k1", "left").select("k1", "k2", "rep", F.coalesce("comp", "k1").alias("comp"))


def _unique_ids(named: DataFrame) -> bool:
    return named.groupBy("doc_id").count().where("count > 1").limit(1).count() == 0


def _nameless(texts: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(member, n, text) of the classes without an id, found by the sets of the rows without one."""
    rows = cut(texts.where("rep is null").select(F.monotonically_increasing_id().alias("doc_id"), "text"))
    names = sets(rows, k).select("doc_id", "k1", "k2").join(wanted.where("rep is null").select("k1", "k2", "n"), ["k1", "k2"])
    return rows.join(names, "doc_id").select(F.col("k1").alias("member"), "n", "text").dropDuplicates(["member"])


def _checked(own: DataFrame, k: int) -> DataFrame:
    """Rows whose text has the set that its class is named after, one for each class."""
    got = own.withColumn("doc_id", F.monotonically_increasing_id())
    rows = cut(got)
    names = sets(rows.select("doc_id", "text"), k).select("doc_id", F.col("k1").alias("own"))
    return rows.join(names, "doc_id").where("own = k1").select(F.col("k1").alias("member"), "n", "text").dropDuplicates(["member"])
