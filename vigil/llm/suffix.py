"""Operator 1: removal of repeated passages by external suffix sorting.

Which strings of ``width`` bytes occur earlier (in a document with a smaller id, or before in
the same one) is decided by a suffix array with common-prefix values, built by induced sorting:

1. Partition.  Every window of ``width`` bytes has a minimizer: the rightmost position whose
   ``GRAM``-byte string hashes lowest.  Equal windows have equal minimizers, so windows
   are grouped by the hash of that string, and a group can be sorted alone.  A stretch of
   neighbouring windows with one minimizer is an occurrence; its bytes are its context.
   Groups of one occurrence are done.  Occurrences with equal contexts (two independent 64-bit
   hashes) are collapsed first, in each task and then by group: all but the earliest are repeats as a whole.  That makes a
   passage which a third of all documents share one string of the sort.  A group that is
   still larger than ``HOT`` bytes is split by its windows: equal windows (two independent 64-bit
   hashes of the whole window) meet, those of one chunk of texts are collapsed before, and the
   earliest of each comes first in Spark's external sort, so nothing of the group is held in memory.
2. Sort.  Groups with different contexts are laid out as texts of a bounded shard, and their
   suffixes are sorted by recursive induction (``induced_sort``): the leftmost suffixes
   of each descent (LMS) are sorted through their named substrings, level by level; from them
   the larger and then the smaller types are induced, bucket by bucket.  The tuples wait in
   ``DiskQueues``: one queue for each first byte, filled in induction order and emptied in bucket
   order, which is a priority queue whose ties are first come, first served.  A queue keeps a
   bounded block in memory and the rest in a temporary file; each tuple carries its common-prefix
   value with the one before it.  The text of a shard, the order of its LMS suffixes and the sorted
   tuples are in memory; that is bounded, as a shard has ``HOT`` bytes at most.
3. Mark.  Neighbours with a common prefix of ``width`` bytes or more hold equal windows; all
   but the earliest in the corpus are removed.  Marked windows are united by document.

Defined cases: null text is empty; texts shorter than ``width`` keep everything; rows with
equal id and equal text are one document and get equal results; rows with equal id and
different texts are ordered by the texts' digests; null ids come last; extra columns are ignored; an
empty table gives an empty result.  Matches never cross documents.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from vigil.llm.common import chunks, sweep, written

WIDTH = 100
GRAM = 32
CHUNK = 1 << 20
#: Bytes of contexts that are sorted at once, unless one group is larger.
SHARD = 2 << 20
#: Bytes of contexts from which a group is split by its windows, so no shard is larger.
HOT = 2 * SHARD
#: Tuples of a queue that stay in memory.
BLOCK = 1 << 18
U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    return x ^ (x >> U(29))


def _words(data: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """The 8 bytes from every position (or the given ones) as a number; ``data`` has 8 bytes to spare."""
    view = np.lib.stride_tricks.as_strided(data.view(np.uint8), (len(data) - 7, 8), (1, 1))
    return np.ascontiguousarray(view if at is None else view[at]).view(np.uint64).ravel()


def occurrences(data: np.ndarray, width: int, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, minimizer) of each stretch of windows with one minimizer, in texts of
    the given sizes that lie one after another."""
    n, w = len(data) - width + 1, width - GRAM + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3
    padded = np.append(data, np.zeros(8, np.uint8))
    grams = len(data) - GRAM + 1
    best = np.empty(n, np.uint64)
    step = w * 512
    with np.errstate(over="ignore"):
        for lo in range(0, n, step):  # a block that stays in the cache
            hi = min(n, lo + step)
            m = min(grams, hi + w - 1) - lo
            x = _words(padded[lo:lo + m + GRAM])
            h = _mix(x[:m] * U(0x9E3779B97F4A7C15) + x[8:8 + m]) * U(0xA0761D6478BD642F) + _mix(x[16:16 + m] * U(0xE7037ED1A0B428DB) + x[24:24 + m])
            h = (_mix(h) & U(0xFFFFFFFF00000000)) | (U(0xFFFFFFFF) - np.arange(lo, lo + m, dtype=np.uint64))
            rows = -(-m // w)
            full = np.full(rows * w, U(0xFFFFFFFFFFFFFFFF))
            full[:m] = h
            full = full.reshape(rows, w)
            left = np.minimum.accumulate(full, axis=1).ravel()
            right = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
            best[lo:hi] = np.minimum(right[:hi - lo], left[w - 1:w - 1 + hi - lo])
    at = (U(0xFFFFFFFF) - (best & U(0xFFFFFFFF))).astype(np.int64)
    ends = np.cumsum(size)
    step_ = np.zeros(n + 1, np.int32)  # windows inside one text, and a new stretch where a text begins
    whole = size >= width
    np.add.at(step_, (ends - size)[whole], 1)
    np.add.at(step_, np.minimum((ends - width + 1)[whole], n), -1)
    inside = np.cumsum(step_[:-1]) > 0
    new = np.append(True, at[1:] != at[:-1])
    new[(ends - size)[whole]] = True
    new[1:] |= inside[1:] != inside[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, n - 1)
    keep = inside[first]
    return first[keep], last[keep], at[first[keep]]


def _hash_at(padded: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each start."""
    out = size.astype(np.uint64) * U(0x9E3779B97F4A7C15) + U(seed)
    with np.errstate(over="ignore"):
        for k in range(0, int(size.max(initial=0)), 8):
            left = size - k
            go = left > 0
            x = _words(padded, start[go] + k)
            part = left[go]
            x = np.where(part >= 8, x, x & ((U(1) << (U(8) * np.minimum(part, 7).astype(np.uint64))) - U(1)))
            out[go] = _mix((out[go] ^ x) * U(0x9FB21C651E98DF25 + 2 * seed))
    return out


def find_occurrences(docs: DataFrame, width: int) -> DataFrame:
    """(doc, key, gram, context, stretch) of every (doc, key, text): a stretch's first window and how many follow
    it (8 bits). A negative stretch is a mark: bytes from -1 - stretch to ``context`` occur earlier."""
    def run(batches):
        for b in chunks(batches, "text", CHUNK):
            raw = [x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()]
            size = np.array([len(x) for x in raw], np.int64)
            data = np.frombuffer(b"".join(raw), np.uint8)
            first, last, at = occurrences(data, width, size)
            if not len(first):
                continue
            padded = np.append(data, np.zeros(8, np.uint8))
            ends = np.cumsum(size)
            of = np.searchsorted(ends, first, side="right")
            base = (ends - size)[of]
            doc, key = (b.column(c).to_numpy()[of] for c in ("doc", "key"))
            gram = _hash_at(padded, at, np.full(len(at), GRAM), 1).view(np.int64)
            context = _hash_at(padded, first, last - first + width, 7).view(np.int64)
            start, windows = first - base, last - first
            # of equal contexts in this chunk only the earliest goes on; the others are marks already
            by = np.lexsort((start, key, doc, context, gram))
            again = np.append(False, (gram[by][1:] == gram[by][:-1]) & (context[by][1:] == context[by][:-1]))
            copies, once = np.sort(by[again]), by[~again]
            if len(copies):
                same = np.append(False, (of[copies][1:] == of[copies][:-1]) & (start[copies][1:] <= (start + windows)[copies][:-1] + width))
                lo = np.flatnonzero(~same)
                hi = np.append(lo[1:] - 1, len(copies) - 1)
                ends_at = (start + windows)[copies][hi] + width
                spread = (start[copies][lo] * 0x9E3779B1) ^ doc[copies][lo]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (doc[copies][lo], key[copies][lo], spread, ends_at, -1 - start[copies][lo])], ["doc", "key", "gram", "context", "stretch"])
            yield pa.RecordBatch.from_arrays([pa.array(x[once]) for x in (doc, key, gram, context, start << 8 | windows)], ["doc", "key", "gram", "context", "stretch"])

    return docs.select("doc", "key", "text").mapInArrow(run, "doc long, key long, gram long, context long, stretch long")


class DiskQueues:
    """First-in-first-out queues of tuples (suffix, common prefix with the tuple before), one for each bucket.

    Emptied in bucket order they form a priority queue over (bucket, arrival)."""

    def __init__(self, buckets: int, block: int = BLOCK):
        self.block = block
        self.memory: list[list] = [[] for _ in range(buckets)]
        self.held = [0] * buckets
        self.files: dict[int, list] = {}

    def put(self, bucket: int, suffix: np.ndarray, common: np.ndarray) -> None:
        self.memory[bucket].append((suffix, common))
        self.held[bucket] += len(suffix)
        if self.held[bucket] > self.block:
            self._spill(bucket)

    def _spill(self, bucket: int) -> None:
        if bucket not in self.files:
            self.files[bucket] = [tempfile.TemporaryFile(), []]
        file, sizes = self.files[bucket]
        suffix, common = (np.concatenate(x) for x in zip(*self.memory[bucket]))
        file.write(suffix.astype(np.int32).tobytes())
        file.write(common.astype(np.uint8).tobytes())
        sizes.append(len(suffix))
        self.memory[bucket], self.held[bucket] = [], 0

    def take(self, bucket: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All tuples of a bucket in order of arrival, block by block; what arrives meanwhile comes next."""
        if bucket in self.files:
            if self.memory[bucket]:
                self._spill(bucket)
            file, sizes = self.files.pop(bucket)
            file.seek(0)
            for n in sizes:
                yield np.frombuffer(file.read(4 * n), np.int32).astype(np.int64), np.frombuffer(file.read(n), np.uint8)
            file.close()
        while self.memory[bucket] or bucket in self.files:
            if bucket in self.files:
                yield from self.take(bucket)
                return
            mine, self.memory[bucket], self.held[bucket] = self.memory[bucket], [], 0
            yield tuple(np.concatenate(x) for x in zip(*mine))


class _Before:
    """Common-prefix values of induced tuples: one more than the least value between the two inducing
    tuples, kept for each bucket across blocks."""

    def __init__(self, cap: int):
        self.cap, self.least, self.seen = cap, np.full(257, 255, np.int64), np.zeros(257, bool)

    def induce(self, char: np.ndarray, source: np.ndarray, common: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(bucket, members, values) for tuples at positions ``source`` of a block with ``common`` values."""
        n = len(common)
        levels = [common]  # sparse table of range minima
        while (1 << len(levels)) <= n:
            half = 1 << (len(levels) - 1)
            levels.append(np.minimum(levels[-1][:-half], levels[-1][half:]))
        order = np.argsort(char, kind="stable")
        char, source = char[order], source[order]
        start = np.flatnonzero(np.append(True, char[1:] != char[:-1])) if len(char) else np.empty(0, int)
        total = np.minimum(self.least, int(common.min(initial=255)))
        for lo, hi in zip(start, np.append(start[1:], len(char))):
            c, at = int(char[lo]), source[lo:hi]
            value = np.empty(hi - lo, np.int64)
            if hi - lo > 1:
                a, b = at[:-1] + 1, at[1:] + 1
                level = np.frexp((b - a).astype(float))[1] - 1
                gap = np.empty(hi - lo - 1, np.int64)
                for k in np.unique(level):
                    own = level == k
                    gap[own] = np.minimum(levels[k][a[own]], levels[k][b[own] - (1 << k)])
                value[1:] = gap + 1
            value[0] = min(int(self.least[c]), int(common[:at[0] + 1].min())) + 1 if self.seen[c] else 0
            self.seen[c] = True
            total[c] = int(common[at[-1] + 1:].min(initial=255))
            yield c, order[lo:hi], np.minimum(value, self.cap).astype(np.uint8)
        self.least = total


def _ranks(text: np.ndarray, lms: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of the LMS suffixes to ``depth`` bytes: names of their substrings, then the same on
    the names, two by two as long as names are shared (each level covers twice the bytes)."""
    size = np.diff(np.append(lms, len(text) - 1)) + 1
    padded = np.append(text, np.zeros(depth + 8, np.uint16)).astype(np.uint16)
    name = np.zeros(len(lms), np.int64)
    # LMS substrings seven letters at a time; where one is a beginning of another it is the larger
    for k in range(0, min(int(size.max(initial=0)), depth), 7):
        x = np.zeros(len(lms), np.int64)
        for j in range(k, k + 7):
            x = x << 9 | np.where(j < size, padded[np.minimum(lms + j, len(padded) - 1)], 511).astype(np.int64)
        go = np.unique(x, return_inverse=True)[1]
        name = np.unique(name * (int(go.max(initial=0)) + 1) + go, return_inverse=True)[1] if k else go
    covered, reach = 1, depth // 2 + 1
    while covered < reach and len(lms) and int(name.max()) < len(lms) - 1:
        other = np.zeros(len(lms), np.int64)
        other[:-covered or None] = name[covered:] + 1 if covered < len(lms) else 0
        name = np.unique(name * (len(lms) + 2) + other, return_inverse=True)[1]
        covered *= 2
    order = np.argsort(name, kind="stable")
    return order, name[order]


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Common prefix of the suffixes at a and b, to ``cap``."""
    padded = np.append(text, np.zeros(cap + 8, text.dtype))
    out, live = np.zeros(len(a), np.int64), np.arange(len(a))
    for k in range(cap):
        live = live[padded[a[live] + k] == padded[b[live] + k]]
        if not len(live):
            break
        out[live] = k + 1
    return out


def induced_sort(text: np.ndarray, cap: int, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of ``text`` (values 0..256; its last value 0) in order of their first ``cap`` values, with
    the common prefix of each and the one before it (to ``cap``), block by block."""
    n = len(text)
    nxt = np.append(text[1:], 0)
    # S type: smaller than the next suffix
    differs = text != nxt
    differs[-1] = True
    run = np.flatnonzero(differs)
    is_s = np.repeat(text[run] < nxt[run], np.diff(np.append(-1, run)))
    is_s[-1] = True
    length = np.repeat(run, np.diff(np.append(-1, run))) - np.arange(n) + 1  # of the run of one value

    def join(a: int, b: int) -> int:
        """Common prefix of an L and an S type suffix of one bucket."""
        return min(int(length[a]), int(length[b]), cap)

    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    order, _ = _ranks(text, lms, cap)
    seeds = lms[order]
    seed_common = np.append(0, _common(text, seeds[:-1], seeds[1:], cap)) if len(seeds) else np.empty(0, np.int64)
    before = np.append(0, text[:-1]).astype(np.int64)

    # L types, in ascending order of the suffix they precede
    queue, values = DiskQueues(257, block), _Before(cap)
    kept = DiskQueues(257, block)
    first = text[seeds] if len(seeds) else np.empty(0, text.dtype)
    edge = np.searchsorted(first, np.arange(258))

    def larger(suffix: np.ndarray, common: np.ndarray) -> None:
        go = np.flatnonzero((suffix > 0) & ~is_s[suffix - 1])
        for c, at, value in values.induce(before[suffix[go]], go, common):
            queue.put(c, suffix[go][at] - 1, value)

    for c in range(257):
        end = -1
        for suffix, common in queue.take(c):
            kept.put(c, suffix, common)
            larger(suffix, common)
            end = suffix[-1]
        lo, hi = edge[c], edge[c + 1]
        if hi > lo:
            common = np.minimum(seed_common[lo:hi], cap).astype(np.uint8)
            common[0] = join(end, seeds[lo]) if end >= 0 else 0
            larger(seeds[lo:hi], common)

    # S types, in descending order; what is taken comes from the largest down
    queue, values = DiskQueues(257, block), _Before(cap)
    done: list[tuple[int, list, list]] = []

    def smaller(suffix: np.ndarray, common: np.ndarray) -> None:
        go = np.flatnonzero((suffix > 0) & is_s[suffix - 1])
        for c, at, value in values.induce(before[suffix[go]], go, common):
            queue.put(c, suffix[go][at] - 1, value)

    for c in range(256, -1, -1):
        ups, downs = [], [*kept.take(c)]
        for suffix, common in queue.take(c):  # S types of a bucket lie above its L types
            ups.append((suffix, common))
            smaller(suffix, common)
        if downs:
            suffix, common = (np.concatenate(x) for x in zip(*downs))
            # in descending order a value belongs to the one before, so they move by one
            back = np.append(join(ups[-1][0][-1], suffix[-1]) if ups else 0, common[::-1][:-1]).astype(np.uint8)
            smaller(suffix[::-1], back)
        done.append((c, downs, ups))
    # ascending: the L types of a bucket, then its S types; single letters meet where they join
    for c, downs, ups in reversed(done):
        if downs:
            yield tuple(np.concatenate(x) for x in zip(*downs))
        if ups:
            suffix, common = (np.concatenate(x) for x in zip(*ups))
            suffix = suffix[::-1]
            yield suffix, np.append(join(downs[-1][0][-1], suffix[0]) if downs else 0, common[::-1][:-1]).astype(np.uint8)


def repeated_windows(contexts: list[bytes], windows: np.ndarray, order: np.ndarray, start: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, offset) of the first ``windows`` windows of each context that occur earlier; ``order`` ranks the
    contexts' documents, ``start`` is where a context begins there."""
    size = np.array([len(c) + 1 for c in contexts], np.int64)
    text = np.frombuffer(b"\0".join(contexts) + b"\0", np.uint8).astype(np.uint16)
    ends = np.cumsum(size)
    text += 1
    text[ends - 1] = 0
    of = np.repeat(np.arange(len(contexts)), size)
    offset = np.arange(len(text)) - (ends - size)[of]
    valid = offset < windows[of]
    place = start[of] + offset
    suffixes, commons = (np.concatenate(x) for x in zip(*induced_sort(text, width)))
    group = np.cumsum(commons < width)
    keep = valid[suffixes]
    suffix, group = suffixes[keep], group[keep]
    if not len(suffix):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    by = np.lexsort((place[suffix], order[of[suffix]], group))
    suffix, group = suffix[by], group[by]
    again = np.append(False, group[1:] == group[:-1])
    return of[suffix[again]], offset[suffix[again]]


def _sorted_marks(contexts: DataFrame, width: int) -> DataFrame:
    """(doc, key, lo, hi) of repeated bytes from ``_contexts`` rows, sorted by gram, more and place."""
    def flush(rows):
        docs = sorted({(r[1], r[2]) for r in rows})
        rank = {d: i for i, d in enumerate(docs)}
        windows, order, start = (np.array(x, np.int64) for x in ([r[4] for r in rows], [rank[r[1], r[2]] for r in rows], [r[3] for r in rows]))
        context, offset = repeated_windows([r[5] for r in rows], windows, order, start, width)
        if not len(context):
            return
        place = start[context] + offset
        by = np.lexsort((place, order[context]))
        doc, place = order[context][by], place[by]
        new = np.append(True, (doc[1:] != doc[:-1]) | (place[1:] > place[:-1] + width))
        first = np.flatnonzero(new)
        last = np.append(first[1:] - 1, len(place) - 1)
        who = [docs[i] for i in doc[first]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([d for d, _ in who], pa.int64()), pa.array([k for _, k in who], pa.int64()), pa.array(place[first]), pa.array(place[last] + width)],
            ["doc", "key", "lo", "hi"])

    def marked(doc, key, lo, hi):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (doc, key, lo, hi)], ["doc", "key", "lo", "hi"])

    def run(batches):
        rows, held, group, size, last = [], 0, [], 0, None
        for b in batches:
            gram, more, doc, key, start, windows = (b.column(i).to_numpy() for i in range(6))
            own = windows < 0
            if own.any():
                yield marked(doc[own], key[own], start[own], start[own] - windows[own])
            own = np.flatnonzero(windows == 0)
            if len(own):  # windows of a split group, the earliest of equal ones first
                one, two = gram[own], more[own]
                again = own[np.append((one[0], two[0]) == last, (one[1:] == one[:-1]) & (two[1:] == two[:-1]))]
                last = one[-1], two[-1]
                yield marked(doc[again], key[again], start[again], start[again] + width)
            rest = b.filter(pa.array(windows > 0)).drop_columns(["more"])
            for row in zip(*(c.to_pylist() for c in rest.columns)):
                if group and row[0] != group[-1][0]:
                    if rows and held + size > SHARD:
                        yield from flush(rows)
                        rows, held = [], 0
                    rows.extend(group)
                    held, group, size = held + size, [], 0
                group.append(row)
                size += len(row[5])
        if rows and held + size > SHARD:
            yield from flush(rows)
            rows = []
        if rows or group:
            yield from flush(rows + group)

    return contexts.select("gram", "more", "doc", "key", "start", "windows", "bytes").mapInArrow(run, "doc long, key long, lo long, hi long")


def _wanted(first: DataFrame, width: int) -> DataFrame:
    """(doc, key, gram, stretch, hot) of the stretches (doc, key, gram, lo, hi) of groups of several; hot: the group is split."""
    several = (first.groupBy("gram").agg(F.count("*").alias("n"), F.sum(F.col("hi") - F.col("lo")).alias("size"))
               .where("n > 1").select("gram", (F.col("size") > HOT).alias("hot")))
    return first.join(several, "gram").select("doc", "key", "gram", F.expr(f"shiftleft(lo, 8) | (hi - lo - {width})").alias("stretch"), "hot")


def _split(raw: list[bytes], doc: np.ndarray, key: np.ndarray, hot: list[tuple[int, int, int]], width: int) -> Iterator[tuple]:
    """(hash, second hash, doc, key, start, 0) of the windows of (text, start, windows) stretches; of equal ones
    the earliest, the others as marks (spread, 0, doc, key, start, -bytes)."""
    text, at, n = (np.array(x, np.int64) for x in zip(*hot))
    size = np.array([len(x) for x in raw], np.int64)
    padded = np.append(np.frombuffer(b"".join(raw), np.uint8), np.zeros(8, np.uint8))
    of = np.repeat(text, n)
    start = np.repeat(at - (np.cumsum(n) - n), n) + np.arange(n.sum())
    place, whole = (np.cumsum(size) - size)[of] + start, np.full(len(start), width)
    one, two = (_hash_at(padded, place, whole, seed).view(np.int64) for seed in (11, 23))
    doc, key = doc[of], key[of]
    by = np.lexsort((start, key, doc, two, one))
    again = np.append(False, (one[by][1:] == one[by][:-1]) & (two[by][1:] == two[by][:-1]))
    once, copies = by[~again], by[again]
    yield one[once], two[once], doc[once], key[once], start[once], np.zeros(len(once), np.int64)
    if len(copies):
        copies = copies[np.argsort(place[copies])]
        new = np.append(True, (of[copies][1:] != of[copies][:-1]) | (start[copies][1:] > start[copies][:-1] + width))
        lo = np.flatnonzero(new)
        hi = np.append(lo[1:] - 1, len(copies) - 1)
        lo, hi = copies[lo], copies[hi]
        yield (start[lo] * 0x9E3779B1) ^ doc[lo], np.zeros(len(lo), np.int64), doc[lo], key[lo], start[lo], start[lo] - start[hi] - width


def _contexts(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(gram, more, doc, key, start, windows, bytes): the bytes of the wanted stretches, or ``_split`` rows without bytes."""
    names = ["gram", "more", "doc", "key", "start", "windows", "bytes"]
    listed = wanted.groupBy("doc", "key").agg(F.collect_list(F.struct("gram", "stretch", "hot")).alias("want"))

    def run(batches):
        for b in chunks(batches, "text", CHUNK):
            rows, split = [], []
            raw = [x or b"" for x in b.column("text").cast(pa.binary()).to_pylist()]
            for i, (doc, key, text, want) in enumerate(zip(b.column("doc").to_pylist(), b.column("key").to_pylist(), raw, b.column("want"))):
                gram, stretch, hot = (want.values.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                for g, at, n, h in zip(gram.tolist(), (stretch >> 8).tolist(), (stretch & 255).tolist(), hot.tolist()):
                    if h:
                        split.append((i, at, n + 1))
                    else:
                        rows.append((g, 0, doc, key, at, n + 1, text[at:at + n + width]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)
            if split:
                for part in _split(raw, b.column("doc").to_numpy(), b.column("key").to_numpy(), split, width):
                    yield pa.RecordBatch.from_arrays([*map(pa.array, part), pa.array([b""] * len(part[0]), pa.binary())], names)

    return (docs.select("doc", "key", "text").join(listed, ["doc", "key"]).select("doc", "key", "text", "want")
            .mapInArrow(run, "gram long, more long, doc long, key long, start long, windows long, bytes binary"))


def prepared(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with doc (the id, null ids last) and key (0, or the text's digest if ids repeat or are
    null); whether they do."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    odd = ids.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count() > 0
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    frame = docs.withColumns({"doc": F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)), "key": F.xxhash64(text) if odd else F.lit(0).cast("long")})
    return frame, odd


def repeats(docs: DataFrame, odd: bool, width: int = WIDTH) -> DataFrame:
    """(doc, key, marks): the byte ranges of every document of ``prepared`` rows that occur earlier."""
    if not GRAM < width < 256:
        raise ValueError("the width must be between the gram's length and 255")
    rows = docs.select("doc", "key", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    if odd:  # equal rows are one document
        rows = rows.dropDuplicates(["doc", "key"])
    within = Window.partitionBy("gram").orderBy("context", "doc", "key", "stretch")
    mark = F.col("stretch") < 0
    copy = F.coalesce((F.lag("context").over(within) == F.col("context")) & (F.lag("stretch").over(within) >= 0) & ~mark, F.lit(False))
    other = (F.lead("stretch").over(within) >= 0) | (F.lag("stretch").over(within) >= 0)
    found = (find_occurrences(rows, width).withColumns({"_copy": copy, "_more": F.coalesce(other, F.lit(False))}).where(mark | F.col("_more"))
             .select("doc", "key", F.when(~mark & ~F.col("_copy"), F.col("gram")).alias("gram"),
                     F.when(mark, -1 - F.col("stretch")).otherwise(F.expr("shiftright(stretch, 8)")).alias("lo"),
                     F.when(mark, F.col("context")).otherwise(F.expr(f"shiftright(stretch, 8) + (stretch & 255) + {width}")).alias("hi")))
    found = written(found)
    sweep(docs.sparkSession)
    earlier = found.where("gram is null").select("doc", "key", "lo", "hi")
    spread = _contexts(rows, _wanted(found.where("gram is not null"), width), width)
    marks = _sorted_marks(spread.repartition("gram").sortWithinPartitions("gram", "more", "doc", "key", "start"), width)
    return (earlier.union(marks).groupBy("doc", "key").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("marks")))


def deduplicated(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """The contract's digest of ``removed``: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    return removed(docs, width).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def removed(docs: DataFrame, width: int = WIDTH, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id if None), n_bytes, n_removed, n_spans, kept (the bytes left) and kept_text
    (their text, without characters that a cut has split) of every row."""
    keep = keep or ["doc_id"]
    ready, odd = prepared(docs)
    rows = ready.select(*keep, "doc", "key", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    joined = rows.join(repeats(ready, odd, width), ["doc", "key"], "left").select(*keep, "_text", "marks")

    def run(batches):
        for b in chunks(batches, "_text", CHUNK):
            n, gone, spans, kept = [], [], [], []
            for raw, marks in zip(b.column("_text").cast(pa.binary()).to_pylist(), b.column("marks")):
                ranges, pieces, end = [], [], 0
                if marks.is_valid:
                    lo, hi = (marks.values.field(i).to_pylist() for i in range(2))
                    for x, y in zip(lo, hi):
                        if ranges and x <= ranges[-1][1]:
                            ranges[-1][1] = max(ranges[-1][1], y)
                        else:
                            ranges.append([x, y])
                for x, y in ranges:
                    pieces.append(raw[end:x])
                    end = y
                pieces.append(raw[end:])
                n.append(len(raw)), gone.append(sum(y - x for x, y in ranges)), spans.append(len(ranges)), kept.append(b"".join(pieces))
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(keep))), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(kept, pa.binary()), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string())],
                [*keep, "n_bytes", "n_removed", "n_spans", "kept", "kept_text"])

    schema = StructType([f for f in rows.schema if f.name in keep])
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept", "binary"), ("kept_text", "string")):
        schema = schema.add(name, kind)
    return joined.mapInArrow(run, schema)
