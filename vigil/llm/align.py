"""Operator 13: alignment of two tokenizers' tokens over a corpus, in Arrow.

Tasks take documents in chunks of bounded bytes.  In a chunk both encodings are list arrays: flattened ids with
their parent indices, whose byte lengths give each token's end by a cumulative sum within its document.  A full
outer hash join (Acero) of both sides on (document, end) lists all ends; an end of both sides closes a group, and
between two neighbouring ends lies exactly one overlapping pair, a link, so filling the missing ids backward gives
every link.  ``Table.group_by`` counts a chunk's pairs; Spark adds the chunks' counts up to the corpus's.

Counts come back by chunk, not by document: a document keeps its links as numbers into its chunk's distinct pairs,
so only those pairs, far fewer than links, meet the corpus-wide counts in a join.  A chunk's documents and its
pairs' counts then meet in one group, whose size the chunk's bytes bound.

Defined cases: a text that is null, empty or not given back exactly by either tokenizer has no tokens (zeros and
an empty string); special tokens' strings are plain text; repeated rows count each; an id may be null or repeat; a
text longer than a chunk is a chunk alone; no rows give no rows; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import bpe
from vigil.llm.common import chunks, written

#: Bytes of text of a chunk.
CHUNK = 2 << 20
#: Characters of a text that the piece tokenizer takes at once.
PIECE_TEXT = 1 << 18
SPACE = "▁"


class Pair:
    """A byte-level vocabulary (tokenizers JSON) and a piece model, with the bytes of their tokens."""

    def __init__(self, byte_path: str, piece_path: str):
        self.bytes = bpe.ByteBPE(byte_path)
        self.fast = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=self.bytes.ids, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        own = self.bytes.bytes_of
        self.byte_table = pa.array([own.get(i, b"") for i in range(max(own) + 1)], pa.binary())
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.piece_table = pa.array([bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace(SPACE, " ").encode()
                                     for i, p in enumerate(names)], pa.binary())
        #: whether no piece has a space behind something else, so that a text may be cut there
        self.cuts = not any(x != SPACE and y == SPACE for p in names for x, y in zip(p, p[1:]))

    def encode_bytes(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text).astype("<i4")
        except ValueError:  # white space too long for the library's regular expression
            ids = b"".join(map(self.bytes.pretokens.__getitem__, self.bytes.find(text)))
            self.bytes.pretokens.clear()
            return np.frombuffer(ids, "<i4")

    def fragments(self, text: str) -> list[str]:
        """A long text cut before spaces that follow something else: no piece spans such a place, and the space that
        the tokenizer puts in front of each fragment stands for the one that is left out there."""
        out, lo = [], 0
        while self.cuts and len(text) - lo > PIECE_TEXT:
            at = text.find(" ", lo + PIECE_TEXT)
            while at > 0 and (text[at - 1] in (" ", SPACE) or at + 1 == len(text)):
                at = text.find(" ", at + 1)
            if at < 0:
                break
            out.append(text[lo:at])
            lo = at + 1
        return [*out, text[lo:]]

    def encode_pieces(self, texts: list[str]) -> list[list[int]]:
        if all(len(t) <= PIECE_TEXT for t in texts):
            return self.pieces.encode(texts, num_threads=1)
        return [[i for f in self.fragments(t) for i in self.pieces.encode(f)] for t in texts]


@functools.lru_cache(maxsize=1)
def load(byte_path: str, piece_path: str) -> Pair:
    return Pair(byte_path, piece_path)


def _lists(ids: list) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)], dtype="i4")
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, "i4"), *ids]).astype("i4")))


def _exact(ids: pa.ListArray, table: pa.Array, wanted: list[bytes]) -> np.ndarray:
    """Whether each document's token bytes make up the wanted bytes."""
    tokens = table.take(ids.flatten())
    ends = pc.cumulative_sum(pc.binary_length(tokens).cast(pa.int64())).to_numpy(zero_copy_only=False)
    bounds = np.concatenate([[0], ends])[np.asarray(ids.offsets)]
    data = memoryview(tokens.buffers()[2] or b"").cast("B")
    return np.array([data[a:b] == w for a, b, w in zip(bounds, bounds[1:], wanted)], bool)


def _ends(ids: pa.ListArray, table: pa.Array, name: str) -> pa.Table:
    """(doc, end, id, number) of all tokens: the byte at which each ends in its document."""
    flat, doc = pc.list_flatten(ids), pc.list_parent_indices(ids).cast(pa.int32())
    total = pc.cumulative_sum(pc.binary_length(table.take(flat)).cast(pa.int64()))
    start = pa.concat_arrays([pa.array([0], pa.int64()), total]).take(ids.offsets[:-1])
    return pa.table({"doc": doc, "end": pc.subtract(total, start.take(doc)), name: flat, f"{name}_at": pa.array(np.arange(len(flat), dtype="i4"))})


def _column(table: pa.Table, name: str) -> pa.Array:
    found = table[name].combine_chunks()
    return found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found


def _joined(flat: pa.Array, last: pa.Array) -> pa.Array:
    """Decimal ids of each group, joined by commas; ``last``: the number of each group's last token."""
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), pc.add(last, pa.scalar(1, pa.int32()))])
    return pc.binary_join(pa.ListArray.from_arrays(offsets, flat.cast(pa.string())), ",")


def _per_doc(doc: pa.Array, n: int) -> np.ndarray:
    return np.bincount(np.asarray(doc), minlength=n).astype("i8")


def aligned(model: Pair, texts: list[str]) -> dict:
    """Per document the counts, the groups as text and the links; the chunk's distinct pairs with their counts."""
    wanted = [(" " + t).encode() if t else b"" for t in texts]
    none = np.empty(0, "i4")
    a = _lists([model.encode_bytes(" " + t) if t else none for t in texts])
    b = _lists([np.array(x, "i4") for x in model.encode_pieces([t or "" for t in texts])])
    good = _exact(a, model.byte_table, wanted) & _exact(b, model.piece_table, wanted)
    if not good.all():
        a, b = (_lists([np.asarray(x.values) if ok else none for x, ok in zip(ids, good)]) for ids in (a, b))
    n = len(texts)
    ta, tb = _ends(a, model.byte_table, "a"), _ends(b, model.piece_table, "b")
    ends = ta.join(tb, ["doc", "end"], join_type="full outer", use_threads=False).sort_by([("doc", "ascending"), ("end", "ascending")])
    common = ends.filter(pc.and_(ends["a"].is_valid(), ends["b"].is_valid()))
    doc, left, right = _column(ends, "doc"), pc.fill_null_backward(_column(ends, "a")), pc.fill_null_backward(_column(ends, "b"))
    groups = pc.binary_join_element_wise(_joined(a.flatten(), _column(common, "a_at")), _joined(b.flatten(), _column(common, "b_at")), "|")
    n_groups = _per_doc(_column(common, "doc"), n)
    by_doc = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n_groups)]).astype("i4")), groups), ";")
    pair = pc.add(pc.shift_left(left.cast(pa.int64()), pa.scalar(32, pa.int64())), right.cast(pa.int64())).dictionary_encode()
    counts = pa.table({"at": pair.indices}).group_by("at", use_threads=False).aggregate([([], "count_all")])
    return {"n_a": np.diff(np.asarray(a.offsets)), "n_b": np.diff(np.asarray(b.offsets)), "n_groups": n_groups, "n_links": _per_doc(doc, n),
            "groups": by_doc, "links": np.asarray(pair.indices), "pairs": pair.dictionary.take(_column(counts, "at")), "at": _column(counts, "at"),
            "counts": _column(counts, "count_all")}


_DOC = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"
_PAIR = "at int, a int, b int, links_here long"


def _chunk_rows(batches, byte_path: str, piece_path: str):
    """A chunk's documents, then its distinct pairs, as rows of one table."""
    model, task, number = load(byte_path, piece_path), TaskContext.get().partitionId(), 0
    for batch in chunks(batches, "text", CHUNK):
        texts = batch.column("text").to_pylist()
        found, n = aligned(model, texts), batch.num_rows
        key = task << 32 | number
        number += 1
        bounds = np.concatenate([[0], np.cumsum(found["n_links"])])
        # the fewest bytes that hold every number
        links = found["links"].astype("<u2" if len(found["pairs"]) <= 1 << 16 else "<u4")
        digests = [hashlib.sha256(g.as_buffer()).hexdigest() if k else "" for g, k in zip(found["groups"], found["n_links"])]
        docs = [pa.array(np.asarray(found[c]).astype("i8")) for c in ("n_a", "n_b", "n_groups", "n_links")]
        docs += [pa.array(digests, pa.string()), pa.array([links[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())]
        p = np.asarray(found["pairs"])
        pairs = [found["at"].cast(pa.int32()), pa.array((p >> 32).astype("i4")), pa.array((p & 0xFFFFFFFF).astype("i4")), found["counts"].cast(pa.int64())]
        names = ["chunk", "doc_id", *[f.split()[0] for f in f"{_DOC}, {_PAIR}".split(", ")]]
        nulls = lambda like, k: [pa.nulls(k, x.type) for x in like]
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, key)), batch.column("doc_id"), *docs, *nulls(pairs, n)], names)
        k = len(p)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, key)), pa.nulls(k, batch.column("doc_id").type), *nulls(docs, k), *pairs], names)


def _weighed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """A chunk's documents with the sums over their links of the corpus-wide counts."""
    n = docs.num_rows
    order = np.asarray(_column(pairs, "at"))
    count, best = np.zeros(len(order), "i8"), np.zeros(len(order), "i8")
    count[order], best[order] = np.asarray(_column(pairs, "pair_count")), np.asarray(_column(pairs, "pair_best"))
    kind = "<u2" if len(order) <= 1 << 16 else "<u4"
    sizes = np.asarray(_column(docs, "n_links"))
    links = np.frombuffer(b"".join(x.as_buffer() for x in docs["links"]), kind)
    of = pa.table({"doc": np.repeat(np.arange(n), sizes), "n_best": best[links], "count_sum": count[links]})
    sums = of.group_by("doc", use_threads=False).aggregate([("n_best", "sum"), ("count_sum", "sum")])
    total = {c: np.zeros(n, "i8") for c in ("n_best", "count_sum")}
    for c, out in total.items():
        out[np.asarray(_column(sums, "doc"))] = np.asarray(_column(sums, f"{c}_sum"))
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    for c, v in total.items():
        out = out.append_column(c, pa.array(v))
    return out.append_column("groups_sha256", docs["groups_sha256"])


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Per document the figures, and per linked (a, b) its corpus-wide count and whether it is b's highest."""
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    rows = written(texts.mapInArrow(lambda batches: _chunk_rows(batches, byte_path, piece_path), f"chunk long, doc_id {kind}, {_DOC}, {_PAIR}"))
    figures = rows.where("at is null").select("chunk", "doc_id", *[f.split()[0] for f in _DOC.split(", ")])
    here = rows.where("at is not null").select("chunk", *[f.split()[0] for f in _PAIR.split(", ")])
    counts = here.groupBy("a", "b").agg(F.sum("links_here").alias("pair_count"))
    highest = counts.groupBy("b").agg(F.max("pair_count").alias("_highest"))  # as many rows as piece ids at most
    counts = counts.join(highest, "b").withColumn("pair_best", F.col("pair_count") == F.col("_highest")).drop("_highest")
    known = here.join(counts, ["a", "b"]).select(F.col("chunk").alias("of"), "at", "pair_count", F.col("pair_best").cast("int").alias("pair_best"))
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    out = figures.groupBy("chunk").cogroup(known.groupBy("of")).applyInArrow(_weighed, schema)
    return out.withColumnRenamed("doc_id", id_col), counts


def figures(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    return align(docs, byte_path, piece_path)[0]
