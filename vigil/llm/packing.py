"""Operator 3: best-fit packing planned on a histogram of lengths.

The lengths 1..``capacity`` are counted (``capacity`` numbers at most reach the driver,
whatever the number of documents).  Best-fit decreasing then runs over the counts: all
items of a length go, in runs, to the fullest open sequences that still take them, and a
whole run of equal sequences is handled at once.  The plan is a small table of runs
"ranks a..b of length L take sequences from s on, at offset o"; each item gets its rank
within its length and joins its run.

Defined cases: null text is an empty text and gives the single end token; repeated rows
and ties are items of their own (their ranks are interchangeable); no rows: no result;
extra columns are ignored; items of length 0 or null take no part, longer ones are an error.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict, deque
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.llm.bpe import load
from vigil.llm.common import chunks, cut, texts

#: Bytes of text handled at once.
CHUNK = 4 << 20
#: Parts in which the ranks of one length are counted, so that a length of very many items is split.
PARTS = 64


@lru_cache(maxsize=2)
def library(path: str) -> tiktoken.Encoding:
    """The vocabulary file (tokenizers JSON) in the fastest library that gives the same ids."""
    model = load(path)
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=model.ids, special_tokens=model.special)


def encode(path: str, text: str) -> bytes:
    """Ids as little-endian 32-bit numbers. The library's regular expression gives up on white space of about a
    million characters; operator 7's encoder takes such texts."""
    try:
        return library(path).encode_to_numpy(text, allowed_special="all").tobytes()
    except ValueError:
        model = load(path)
        ids = model.encode(text)
        model.pretokens.clear()  # pre-tokens that long are not kept
        return ids


def pieces(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids): token ids of each text with the end id, cut into pieces
    of ``capacity`` if longer (the first piece takes the rest). ``ids``: little-endian 32-bit."""
    tail = np.array([end_id], "<u4").tobytes()

    def run(batches):
        for b in chunks(batches, "text", CHUNK):
            rows, piece, start, length, ids = [], [], [], [], []
            for i, t in enumerate(texts(b.column("text"))):
                data = encode(path, t) + tail
                first = len(data) // 4 % capacity or capacity
                bounds = [0, *range(4 * first, len(data) + 1, 4 * capacity)]
                for k, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
                    part = data[lo:hi]
                    rows.append(i), piece.append(k), start.append(lo // 4), length.append(len(part) // 4), ids.append(part)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(ids, pa.binary())],
                ["doc_id", "piece", "start", "length", "ids"])

    df = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = df.schema["doc_id"].dataType.simpleString()
    return df.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Runs (length, first rank, last rank, first sequence, offset) of best-fit decreasing over counts."""
    runs, made = [], 0
    spaces: list[int] = []  # free spaces that occur, ascending
    open_: dict[int, deque] = defaultdict(deque)  # free space -> runs of sequences (first, how many)

    def put(space: int, first: int, n: int) -> None:
        if space:
            if not open_[space]:
                insort(spaces, space)
            open_[space].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(spaces, length)
            if at == len(spaces):  # new sequences, each filled with as many as fit
                n, each = divmod(left, capacity // length)[0], capacity // length
                for groups, per in ((n, each), (1, left - n * each)):
                    if groups and per:
                        for k in range(per):
                            runs.append((length, rank, rank + groups - 1, made, k * length))
                            rank += groups
                        put(capacity - per * length, made, groups)
                        made += groups
                left = 0
                continue
            space = spaces[at]
            first, n = open_[space].popleft()
            take = min(n, left)
            if take < n:
                open_[space].appendleft((first + take, n - take))
            elif not open_[space]:
                spaces.pop(at)
            runs.append((length, rank, rank + take - 1, first, capacity - space))
            put(space - length, first, take)
            rank, left = rank + take, left - take
    return runs


def pack(items: DataFrame, key: list[str], capacity: int = 1024) -> DataFrame:
    """``items`` (with a ``length`` column) plus sequence_id and offset; ``key`` orders items of a length."""
    spark = items.sparkSession
    items = items.where("length > 0").withColumn("_part", F.pmod(F.xxhash64(*key), F.lit(PARTS)).cast("int"))
    sizes = items.groupBy("length", "_part").count().toPandas()  # capacity * PARTS rows at most
    if len(sizes) and sizes["length"].max() > capacity:
        raise ValueError("an item is longer than the capacity")
    sizes = sizes.sort_values(["length", "_part"])
    sizes["_before"] = sizes.groupby("length")["count"].cumsum() - sizes["count"]
    runs = plan({int(k): int(v) for k, v in sizes.groupby("length")["count"].sum().items()}, capacity)
    before = spark.createDataFrame([(int(a), int(p), int(n)) for a, p, n in zip(sizes["length"], sizes["_part"], sizes["_before"])], "length long, _part int, _before long")
    planned = spark.createDataFrame(runs, "length long, _lo long, _hi long, _first long, _offset long")
    within = Window.partitionBy("length", "_part").orderBy(*key)
    ranked = (items.withColumn("_n", F.row_number().over(within) - 1)
              .join(F.broadcast(before), ["length", "_part"]).withColumn("_rank", F.col("_before") + F.col("_n")))
    # the plan's size depends on the capacity alone, so it is broadcast; ranks find their run by range
    return (ranked.join(F.broadcast(planned), (ranked["length"] == planned["length"]) & F.col("_rank").between(F.col("_lo"), F.col("_hi")))
            .drop(planned["length"])
            .withColumn("sequence_id", F.expr("_first + _rank - _lo")).withColumn("offset", F.col("_offset"))
            .drop("_part", "_n", "_before", "_rank", "_lo", "_hi", "_first", "_offset"))


def pack_documents(docs: DataFrame, path: str, capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """Every piece of every document with its sequence and place."""
    cut_pieces = cut(pieces(docs, path, capacity, end_id).withColumn("ids_crc32", F.crc32("ids")).drop("ids"))
    return pack(cut_pieces, ["doc_id", "piece", "start", "ids_crc32"], capacity).select(
        "doc_id", "piece", "start", "length", "ids_crc32", F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))
