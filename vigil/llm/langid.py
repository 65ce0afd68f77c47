"""Operator 2: language identification as multilingual mixture inference.

Model: for each language, smoothed frequencies of letter trigrams (lower-cased code points,
everything that is no letter read as one space, a space at both ends), hashed into ``BUCKETS`` numbers, counted
over all labelled rows.  A document's trigrams are a mixture of the languages' models:
expectation-maximisation estimates the proportions, first over all languages; then the
smallest language is dropped as long as the likelihood loses less than the penalty
``PENALTY * log(trigrams)`` (a language must pay for itself).  The prediction is the largest
proportion of the languages left, the score that proportion.

Memory: ``BUCKETS`` x languages numbers on the driver and in each worker, a chunk of texts at
a time in a task.  Documents are independent, so no key or source can become hot.

Defined cases: null text or no letter: ``und`` with score 0; letters but no label to learn
from: ``und`` too; equal proportions go to the alphabetically first language; null ids,
sources and labels are allowed (rows without label are not learned from); repeated rows are
predicted alike; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm.common import chunks, fold, texts, with_text

BUCKETS = 1 << 15
CHUNK = 2 << 20
PENALTY = 2.0
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Code point -> code point of a letter, or a space."""
    out = np.arange(0x110000, dtype=np.uint32)
    out[[i for i in range(0x110000) if not chr(i).isalpha()]] = 32
    return out


def trigrams(found: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document number, bucket, count) of all texts, sorted by both, and which texts have a letter."""
    found = [f" {x.lower()} " for x in found]  # so one letter alone is a trigram
    size = np.array([len(t) for t in found], np.int64)
    code = _letters()[np.frombuffer("".join(found).encode("utf-32-le", "surrogatepass"), "<u4")]
    doc = np.repeat(np.arange(len(found)), size)
    has = np.bincount(doc, weights=code != 32, minlength=len(found)) > 0
    if len(code) < 3:
        code, doc = np.append(code, [32, 32, 32]).astype(np.uint32), np.append(doc, [-1, -2, -3])
    # runs of what is no letter count once
    keep = np.append(True, (code[1:] != 32) | (code[:-1] != 32) | (doc[1:] != doc[:-1]))
    code, doc = code[keep], doc[keep]
    a, b, c = code[:-2], code[1:-1], code[2:]
    ok = (doc[:-2] == doc[2:]) & ((a != 32) | (b != 32) | (c != 32))
    h = (a * np.uint32(0x9E3779B1)) ^ (b * np.uint32(0x85EBCA77)) ^ (c * np.uint32(0xC2B2AE3D))
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x27D4EB2F)
    key = np.sort(doc[:-2][ok] * BUCKETS + (h[ok] >> np.uint32(17)).astype(np.int64))
    if not len(key):
        return key, key, key, has
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[first] // BUCKETS, key[first] % BUCKETS, np.diff(np.append(first, len(key))), has


def learn(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their bucket probabilities (buckets x languages) from (text, lang) rows."""
    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in chunks(batches, "text", CHUNK):
            lang = np.array(b.column("lang").to_pylist(), object)
            doc, bucket, n, _ = trigrams(texts(b.column("text")))
            for x in sorted(set(lang)):
                own = (lang == x)[doc]
                if x not in sums:
                    sums[x] = np.zeros(BUCKETS)
                sums[x] += np.bincount(bucket[own], weights=n[own], minlength=BUCKETS)
        for x, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([x] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(v[at].astype(np.int64))], ["lang", "bucket", "n"])

    rows = (labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
            .where("lang is not null and text is not null").mapInArrow(run, "lang string, bucket int, n long")
            .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())  # buckets x languages at most
    langs = sorted(rows["lang"].unique())
    count = np.zeros((BUCKETS, len(langs)))
    count[rows["bucket"], rows["lang"].map({x: i for i, x in enumerate(langs)})] = rows["n"]
    return langs, (count + 0.5) / (count.sum(0) + 0.5 * BUCKETS)


def infer(model: np.ndarray, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (texts x languages; all 0 where there is nothing to go by) and which texts have a letter."""
    doc, bucket, n, has = trigrams(found)
    out = np.zeros((len(found), model.shape[1]))
    if not len(doc) or not model.shape[1]:
        return out, has
    there, start, of = np.unique(doc, return_index=True, return_inverse=True)
    p, weight = model[bucket], n.astype(float)
    total = np.add.reduceat(weight, start)

    def em(share: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(rounds):
            mix = np.einsum("ij,ij->i", p, share[of])
            share = share * np.add.reduceat(p * (weight / mix)[:, None], start) / total[:, None]
        mix = np.einsum("ij,ij->i", p, share[of])
        return share, np.add.reduceat(weight * np.log(mix), start)

    share, fit = em(np.full((len(there), p.shape[1]), 1.0 / p.shape[1]), 8)
    for _ in range(p.shape[1] - 1):
        least = np.where(share > 0, share, np.inf).argmin(1)
        fewer = share.copy()
        fewer[np.arange(len(there)), least] = 0
        rest = fewer.sum(1, keepdims=True)
        alone = rest[:, 0] <= 0
        fewer = np.where(alone[:, None], share, fewer / np.where(rest > 0, rest, 1))
        fewer, less = em(fewer, 4)
        better = ~alone & (less >= fit - PENALTY * np.log(total + 1))
        share, fit = np.where(better[:, None], fewer, share), np.where(better, less, fit)
        if not better.any():
            break
    out[there] = share
    return out, has


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, keep: list[str]) -> DataFrame:
    """``keep`` columns with lang_pred, score and n_languages (the size of the selected set)."""
    sent = docs.sparkSession.sparkContext.broadcast((langs, model))

    def run(batches):
        names, p = sent.value
        for b in chunks(batches, source, CHUNK):
            share, has = infer(p, texts(b.column(source)))
            best = share.argmax(1) if p.shape[1] else np.zeros(len(has), int)
            score = share.max(1) if p.shape[1] else np.zeros(len(has))
            known = has & (score > 0)
            pred = [names[i] if k else UNDETERMINED for i, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(keep))), pa.array(pred, pa.string()), pa.array(np.where(known, np.minimum(score, 1.0), 0.0)), pa.array((share > 1e-6).sum(1).astype(np.int32))],
                [*keep, "lang_pred", "score", "n_languages"])

    df, source, schema = with_text(docs, keep)
    return df.mapInArrow(run, schema.add("lang_pred", "string").add("score", "double").add("n_languages", "integer"))


def identify(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Learn on the rows outside the held-out fold and predict every row."""
    held = F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False))
    langs, model = learn(docs.where(~held))
    keep = keep or ["doc_id"]
    return predict(docs.withColumn("held_out", held), langs, model, [*keep, "held_out"])
