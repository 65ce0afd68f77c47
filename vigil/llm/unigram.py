"""Operator 5: token counts of a unigram tokenizer without making the tokens (count-only Viterbi).

The vocabulary's pieces are found by an Aho-Corasick automaton; the dynamic programme keeps, for
each position, only the best score and the number of tokens on the best way to it, the
same choice as the library's:

* a way from an earlier start wins a tie (a later one must score strictly more), scores being
  summed from left to right in double precision;
* a character that is no piece itself may be passed as unknown at the least score of the
  vocabulary less 10; neighbouring unknown characters on the best way count as one token, or, if the
  vocabulary has the 256 byte pieces, as one token for each UTF-8 byte.

Texts are split before each space (which the pieces write as U+2581), as the library's
space-marking pre-tokenizer does, so equal words are counted once a worker.

The vocabulary file (sentencepiece) is public; its merge order gives the scores, as
frequencies by Zipf's law: the log of 1 / (rank + 1), normalised.

Defined cases: null and empty texts have no token; runs of spaces, unknown and very long words are
counted like the library does; repeated rows are counted each; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import chunks, texts

SPACE = "▁"
CHUNK = 4 << 20
#: Words a worker remembers the count of.
MEMORY = 500_000
BYTE = re.compile(r"<0x[0-9A-F]{2}>")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[tuple[tuple[str, float], ...], int]:
    """(piece, score) in the file's order, and the place of the unknown piece."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    size = model.get_piece_size()
    norm = math.log(sum(1 / (i + 1) for i in range(size)))
    return tuple((model.id_to_piece(i), -math.log(i + 1) - norm) for i in range(size)), model.unk_id()


class Counter(dict):
    """Word (with its space mark) -> number of tokens."""

    def __init__(self, pieces: tuple[tuple[str, float], ...], unknown: int):
        super().__init__()
        self.matcher = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(pieces):
            if i != unknown:
                self.matcher.add_word(piece, (len(piece), score))
        self.matcher.make_automaton()
        self.unknown = min(s for _, s in pieces) - 10.0
        self.bytes = sum(bool(BYTE.fullmatch(p)) for p, _ in pieces) == 256

    def __missing__(self, word: str) -> int:
        if len(self) >= MEMORY:
            self.clear()
        value = self[word] = self.viterbi(word)
        return value

    def viterbi(self, word: str) -> int:
        n = len(word)
        # best[i]: score, tokens, length in bytes of the run of unknown characters that ends at i (0: none)
        score, count, run = [0.0] + [-math.inf] * n, [0] * (n + 1), [0] * (n + 1)
        ends: list[list] = [[] for _ in range(n)]
        for end, match in self.matcher.iter(word):
            ends[end].append(match)
        for i in range(1, n + 1):
            best, single = -math.inf, False
            for length, s in sorted(ends[i - 1], reverse=True):  # the earliest start first
                single |= length == 1
                if (new := score[i - length] + s) > best:
                    best, count[i], run[i] = new, count[i - length] + 1, 0
            if not single and (new := score[i - 1] + self.unknown) > best:
                size = len(word[i - 1].encode("utf-8", "surrogatepass"))
                best, run[i] = new, run[i - 1] + size
                count[i] = count[i - 1] + (size if self.bytes else 0 if run[i - 1] else 1)
            score[i] = best
        return count[n]

    def text(self, text: str) -> int:
        if not text:
            return 0
        marked = text.replace(" ", SPACE)
        head, *rest = (marked if marked[0] == SPACE else SPACE + marked)[1:].split(SPACE)
        return self[SPACE + head] + sum(map(self.__getitem__, map(SPACE.__add__, rest)))


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(*vocabulary(path))


def count(docs: DataFrame, path: str, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (doc_id if None) and n_tokens of every row."""
    keep = keep or ["doc_id"]

    def run(batches):
        model = counter(path)
        for b in chunks(batches, "_text", CHUNK):
            n = np.array([model.text(t) for t in texts(b.column("_text"))], np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(n)], [*keep, "n_tokens"])

    df = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "_text")
    return df.mapInArrow(run, f"{schema}, n_tokens long")
