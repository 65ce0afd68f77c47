"""Terms of a dictionary found in texts by the windows of the texts' bytes.

A text holds a term exactly when one of its windows is the term's bytes.  A rolling hash gives the hashes of a text's windows
of one length with a few numpy operations, and a bitmap, made by Spark from the hashes of the terms, rules out nearly all of
them.  What is left are the windows that may be terms, once or a few times a text; an equi-join with the terms decides.  So
what meets the dictionary is about one row for each term of a text, whatever its tokens, and no text is shuffled.

The bitmap has 2 ** ``BITS`` bits, whatever the dictionary: a scalar subquery of the plan, which the first row of each task
carries.  Up to some two million terms it rules out most windows; beyond, more of them reach the join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StructField, StructType

from vigil.llm.common import lean, ship

#: Bits of the bitmap as it is made, in logarithm to base 2; a task folds it to what its terms need.
BITS = 25
#: Bytes of text that are hashed at once.
BLOCK = 1 << 15
#: An odd number and its inverse modulo 2 ** 64; odd factors that spread the hashes of prefixes and of whole windows.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
PREFIX, WHOLE = 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F
_WORD = 1 << 15


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, "u8")
    out[0] = 1
    return np.cumprod(out, dtype="u8")


def _sums(raw: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Sums of the bytes before each place, each byte times its power: windows' hashes are differences of them."""
    out = np.zeros(len(raw) + 1, "u8")
    np.cumsum(raw * powers[:len(raw)], out=out[1:])
    return out


def _slots(hashes: np.ndarray, length: int, factor: int, bits: int) -> np.ndarray:
    hashes *= np.uint64(factor * (2 * length + 1) % (1 << 64))
    hashes >>= np.uint64(64 - bits)
    return hashes


def _binary(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of an Arrow binary column."""
    column = column.cast(pa.binary())
    _, offsets, raw = column.buffers()
    at = np.frombuffer(offsets, "i4")[column.offset:column.offset + len(column) + 1].astype("i8")
    data = np.frombuffer(raw, "u1")[at[0]:at[-1]] if raw is not None else np.empty(0, "u1")
    return at - at[0], data


def _classes(lengths: list[int]) -> dict[int, list[int]]:
    """Lengths by the largest power of two in them: that long a prefix of a window is looked up first."""
    out: dict[int, list[int]] = {}
    for n in lengths:
        out.setdefault(1 << (n.bit_length() - 1), []).append(n)
    return out


def _term_slots(bits: int):
    def run(batches):
        for b in batches:
            at, data = _binary(b.column(0))
            found = []
            powers = _powers(BASE, int(np.diff(at).max(initial=1)) + 1)
            for lo, hi in zip(at[:-1], at[1:]):
                n = int(hi - lo)
                sums, first = _sums(data[lo:hi], powers), 1 << (n.bit_length() - 1)
                found += [_slots(sums[first:first + 1].copy(), first, PREFIX, bits), _slots(sums[n:n + 1].copy(), n, WHOLE, bits)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)).astype("i8"))], ["slot"])

    return run


def _hits(data: np.ndarray, ends: np.ndarray, classes: dict[int, list[int]], bitmap: np.ndarray, bits: int) -> dict[int, tuple]:
    """By length, the places of the texts' windows that may be terms, ascending, and their texts."""
    longest = max(n for c in classes.values() for n in c)
    size = min(BLOCK, len(data)) + longest
    powers, back = _powers(BASE, size), _powers(INVERSE, size)
    found: dict[int, list] = {n: [] for c in classes.values() for n in c}
    for lo in range(0, len(data), BLOCK):
        raw = data[lo:lo + BLOCK + longest - 1]
        sums, starts = _sums(raw, powers), min(BLOCK, len(raw))
        sums = np.concatenate([sums, np.repeat(sums[-1:], longest)])  # windows beyond the last text go with those across two texts
        for first, lengths in classes.items():
            h = sums[first:first + starts] - sums[:starts]
            h *= back[:starts]
            at = np.flatnonzero(bitmap[_slots(h, first, PREFIX, bits)])
            before, own = sums[at], back[at]
            for length in lengths:
                h = sums[at + length] - before
                h *= own
                found[length].append(at[bitmap[_slots(h, length, WHOLE, bits)]] + lo)
    out = {}
    for length, parts in found.items():
        at = np.concatenate([np.empty(0, "i8"), *parts])
        of = np.searchsorted(ends, at, side="right")
        own = np.flatnonzero(at + length <= ends[of]) if len(at) else at
        out[length] = at[own], of[own]
    return out


def _once(data: np.ndarray, at: np.ndarray, of: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The first place of each window of up to eight bytes in its text; longer ones, which are few, as they are."""
    if length > 8 or len(at) == 0:
        return at, of
    value = np.zeros(len(at), "u8")
    for k in range(length):
        value |= data[at + k].astype("u8") << np.uint64(8 * k)
    if length > 4:
        value = np.unique(value, return_inverse=True)[1].astype("u8")
    _, first = np.unique(of.astype("u8") << np.uint64(32) | value, return_index=True)
    return at[first], of[first]


def _taken(data: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """The bytes at places as an Arrow binary array."""
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    index = np.repeat(at - bounds[:-1], lengths) + np.arange(bounds[-1])
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(bounds.astype("i4")), pa.py_buffer(np.ascontiguousarray(data[index]))])


def _char_bytes(lead: np.ndarray) -> np.ndarray:
    """Bytes of the UTF-8 character that starts with a byte."""
    return 1 + (lead >= 0xC0).astype("i8") + (lead >= 0xE0) + (lead >= 0xF0)


def _bitmap(words: list[dict], count: int) -> tuple[np.ndarray, int]:
    """The bitmap of its words, folded to 64 places a term, and the logarithm of its places."""
    packed = np.zeros((1 << BITS) // 8, "u1")
    for w in words:
        at = w["word"] * (_WORD // 8)
        packed[at:at + _WORD // 8] = np.frombuffer(w["set"], "u1")
    bits = min(BITS, max(16, (64 * count).bit_length()))
    return np.unpackbits(packed, bitorder="little").reshape(1 << bits, -1).any(axis=1), bits


def _windows(after: bool):
    def run(batches):
        bitmap, bits, classes = None, 0, {}
        for b in batches:
            if b.num_rows == 0:
                continue
            if bitmap is None:
                terms = b.column("_terms")[0].as_py()
                bitmap, bits = _bitmap(terms["words"], terms["count"])
                classes = _classes(sorted(terms["lengths"]))
            offsets, data = _binary(b.column("_x"))
            ends = offsets[1:]
            places, texts, sizes = [np.empty(0, "i8")], [np.empty(0, "i8")], [np.empty(0, "i8")]
            for n, (at, of) in (_hits(data, ends, classes, bitmap, bits) if classes else {}).items():
                at, of = _once(data, at, of, n)
                places.append(at), texts.append(of), sizes.append(np.full(len(at), n))
            at, of, size = np.concatenate(places), np.concatenate(texts), np.concatenate(sizes)
            order = np.argsort(of, kind="stable")
            at, of, size = at[order], of[order], size[order]
            fields = [_taken(data, at, size)]
            if after:  # the next character, of windows that are a character
                end = at + size
                inside = (end < ends[of]) & (_char_bytes(data[at]) == size)
                following = _char_bytes(data[np.minimum(end, len(data) - 1)]) if len(end) else end
                fields.append(_taken(data, end, np.where(inside, following, 0)))
            rows = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=b.num_rows))]).astype("i4")
            found = pa.ListArray.from_arrays(pa.array(rows), pa.StructArray.from_arrays(fields, ["_t", "_after"][:len(fields)]))
            keep = [i for i, c in enumerate(b.schema.names) if c not in ("_x", "_terms")]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in keep], found], [*[b.schema.names[i] for i in keep], "_found"])

    return run


def term_windows(text: DataFrame, terms: DataFrame, after: bool = False) -> DataFrame:
    """The rows of ``text``, without its text ``_x``, with ``_t``: the windows that may be one of the ``terms`` (column ``_t``),
    both as bytes; all terms in the text are among them.  With ``after``, a window of one character comes from its first place
    in the text, and ``_after`` is the character that follows there, '' at the text's end."""
    ship(text.sparkSession)
    terms = terms.select(F.col("_t").cast("binary").alias("_t")).where(F.octet_length("_t") > 0).distinct()
    words = terms.mapInArrow(_term_slots(BITS), "slot long").groupBy((F.col("slot") / _WORD).cast("int").alias("word")) \
        .agg(F.bitmap_construct_agg(F.pmod("slot", F.lit(_WORD))).alias("set")).agg(F.collect_list(F.struct("word", "set"))).scalar()
    by_length = terms.groupBy(F.octet_length("_t").alias("n")).agg(F.count(F.lit(1)).alias("k"))
    lengths, count = by_length.agg(F.collect_list("n")).scalar(), by_length.agg(F.coalesce(F.sum("k"), F.lit(0))).scalar()
    first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of a task's rows
    kept = [f for f in text.schema.fields if f.name != "_x"]
    names = [f"`{f.name}`" for f in kept]
    rows = text.where("_x is not null").select(*names, F.col("_x").cast("binary").alias("_x"), F.when(
        first, F.struct(words.alias("words"), lengths.alias("lengths"), count.alias("count"))).alias("_terms"))
    found = [StructField("_t", BinaryType())] + ([StructField("_after", BinaryType())] if after else [])
    schema = StructType([*kept, StructField("_found", ArrayType(StructType(found)))])
    return rows.mapInArrow(lean(_windows(after)), schema).select(*names, F.inline("_found"))
