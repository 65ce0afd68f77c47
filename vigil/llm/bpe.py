"""Operator 7: byte-level BPE encoding and decoding with forced-boundary splitting.

A text is split by the byte-level pre-tokenisation rule.  Inside a pre-token, two
neighbouring bytes that are adjacent in no vocabulary token can never end up in one
token, so every such place is a certain cut.  The fragments between the cuts are merged
independently and their ids concatenated, so a very long pre-token costs the sum of its
fragments.  Pre-tokens repeat a lot; each Python worker remembers the ids
of some of them within a bound in bytes (results don't depend on it).

Defined cases: null or empty text gives no ids (decoded: empty text); a special token's
string in the text becomes its id, as in the library; repeated rows are encoded each;
extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import sys
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import chunks, texts

#: Bytes of new pre-tokens after which a worker forgets those it hasn't met again; so twice as much at most is held.
MEMORY = 40 << 20
#: Characters of the longest pre-token that is remembered.
LONGEST = 200
#: Bytes of text handled at once.
CHUNK = 4 << 20
WHITE = "\t-\r \x85\xa0  -     　"


beyond_latin = re.compile("[^\x00-\xff]").search


def _ranges(kind: str, end: int) -> str:
    """Character-class body of the code points below ``end`` whose general category starts with ``kind``."""
    out, start = [], None
    for c in range(end + 1):
        inside = c < end and unicodedata.category(chr(c))[0] == kind
        if inside and start is None:
            start = c
        elif not inside and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


def _rule(end: int) -> re.Pattern:
    letter, number = _ranges("L", end), _ranges("N", end)
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letter}]+| ?[{number}]+| ?[^{WHITE}{letter}{number}]+"
                      f"|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


@functools.cache
def pretoken_pattern() -> re.Pattern:
    """The byte-level pre-tokenisation rule, with letters, numbers and white space spelled out."""
    return _rule(sys.maxunicode + 1)


@functools.cache
def latin_pattern() -> re.Pattern:
    """The same for texts of code points below 256, whose small classes are faster to test."""
    return _rule(256)


def _byte_letters() -> dict[str, int]:
    """Letter that stands for each byte in byte-level vocabularies (printable Latin-1 stands for itself)."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class _Memory(dict):
    """Remembers ``make(key)`` of short keys; when ``limit`` bytes are new, those not met since the last time go."""

    def __init__(self, make, limit: int = MEMORY):
        super().__init__()
        self.make, self.limit, self.older, self.size = make, limit, {}, 0

    def __missing__(self, key):
        if len(key) > LONGEST:
            return self.make(key)
        if self.size >= self.limit:
            self.older = dict(self)
            self.clear()
            self.size = 0
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        self.size += 240 + 2 * len(key) + len(value)  # both objects and their place in the two tables
        return value


class ByteBPE:
    """A byte-level BPE vocabulary file (tokenizers JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.bytes_of = {i: t for t, i in ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.byte_ids = [ids[bytes([b])] for b in range(256)]
        pairs = [[raw(x) for x in (m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        #: id of the left << 20 | id of the right -> rank; rank -> id of both
        self.merges = {ids[a] << 20 | ids[b]: n for n, (a, b) in enumerate(pairs)}
        self.merged = [ids[a + b] for a, b in pairs]
        self.ids = ids
        self.adjacent = frozenset(p for t in ids for p in zip(t, t[1:]))
        self.pretokens = _Memory(self._pretoken)
        self.parts = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None

    def cuts(self, data: bytes) -> list[bytes]:
        """``data`` split wherever no vocabulary token can span."""
        if self.adjacent.issuperset(zip(data, data[1:])):
            return [data]
        places = [i for i, p in enumerate(zip(data, data[1:]), 1) if p not in self.adjacent]
        return [data[a:b] for a, b in zip([0, *places], [*places, len(data)])]

    def _pretoken(self, piece: str) -> bytes:
        ids: list[int] = []
        for fragment in self.cuts(piece.encode()):
            parts = [self.byte_ids[b] for b in fragment]
            ids += self._merge_short(parts) if len(parts) <= 40 else self._merge_long(parts)
        return array("I", ids).tobytes()

    def _merge_short(self, parts: list[int]) -> list[int]:
        rank, merged, none = self.merges.get, self.merged, len(self.merged)
        ranks = [rank(a << 20 | b, none) for a, b in zip(parts, parts[1:])]
        while ranks and (best := min(ranks)) < none:
            i = ranks.index(best)
            new = parts[i] = merged[best]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(new << 20 | parts[i + 1], none)
            if i:
                ranks[i - 1] = rank(parts[i - 1] << 20 | new, none)
        return parts

    def _merge_long(self, parts: list[int]) -> list[int]:
        """Lowest merge first, leftmost among equals, by a heap over a linked list."""
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int]] = []

        def rank(i: int) -> int | None:
            return self.merges.get(parts[i] << 20 | parts[after[i]]) if after[i] < n else None

        def offer(i: int) -> None:
            if i >= 0 and (r := rank(i)) is not None:
                heapq.heappush(heap, (r, i))

        for i in range(n):
            offer(i)
        while heap:
            r, i = heapq.heappop(heap)
            if parts[i] < 0 or rank(i) != r:
                continue  # one of the two has been merged meanwhile
            j = after[i]
            parts[i], parts[j], after[i] = self.merged[r], -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p >= 0]

    def find(self, text: str) -> list[str]:
        """The pre-tokens of a text."""
        return (pretoken_pattern if beyond_latin(text) else latin_pattern)().findall(text)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if self.special and any(s in text for s in self.special):
            return b"".join(array("I", [self.special[x]]).tobytes() if x in self.special else b"".join(map(self.pretokens.__getitem__, self.find(x))) for x in self.parts(text))
        return b"".join(map(self.pretokens.__getitem__, self.find(text)))

    def decode(self, ids) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def load(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>) of every row."""
    def run(batches):
        model = load(path)
        for b in chunks(batches, "text", CHUNK):
            found = [model.encode(t) for t in texts(b.column("text"))]
            ends = np.cumsum([0, *map(len, found)]) // 4
            ids = np.frombuffer(b"".join(found), "<i4")
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))], ["id", "ids"])

    df = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = df.schema["id"].dataType.simpleString()
    return df.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """The frame with ``ids_col`` replaced by the decoded text in ``out_col`` (null ids: empty)."""
    keep = [c for c in encoded.columns if c not in (ids_col, out_col)]

    def run(batches):
        model = load(path)
        for b in batches:
            out = []
            for i in range(b.num_rows):
                ids = b.column(len(keep))[i].values
                out.append(model.decode(ids.to_numpy(zero_copy_only=False).tolist()) if ids is not None else "")
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), pa.array(out, pa.string())], [*keep, out_col])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name in keep)
    return encoded.select(*[F.col(f"`{c}`") for c in keep], ids_col).mapInArrow(run, f"{schema}, `{out_col}` string")


def decimal_digest(ids: np.ndarray, step: int = 1 << 20) -> str:
    """SHA-256 of the decimal ids joined by commas, some at a time."""
    digest = hashlib.sha256()
    for lo in range(0, len(ids), step):
        digest.update(("," if lo else "").encode() + ",".join(map(str, ids[lo:lo + step].tolist())).encode())
    return digest.hexdigest()


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, digest of the decimal ids, digest of the decoded text.

    One pass in one Python node: texts come in once, digests go out."""
    def run(batches):
        model = load(path)
        for b in chunks(batches, "text", CHUNK):
            found = [model.encode(t) for t in texts(b.column("text"))]
            ends = np.cumsum([0, *map(len, found)]) // 4
            ids = np.frombuffer(b"".join(found), "<u4")
            own = [ids[lo:hi] for lo, hi in zip(ends, ends[1:])]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(np.diff(ends), pa.int64()), pa.array([decimal_digest(i) for i in own], pa.string()),
                 pa.array([hashlib.sha256(model.decode(i.tolist()).encode()).hexdigest() for i in own], pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    df = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    return df.mapInArrow(run, f"doc_id {df.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
