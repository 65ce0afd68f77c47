"""The operators' queries on the driver tables."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from vigil.llm import align, ann, bpe, covertree, gru, langid, merkle, packing, setjoin, sharding, suffix, toxicity, unigram
from vigil.llm.common import ship, table

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.deduplicated(table(spark, sf_dir, "documents"))


def op2_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "n_languages")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op4_cover_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.search(table(spark, sf_dir, "embeddings"))


def op5_viterbi_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.count(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op6_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op7_forced_boundary_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op8_toxic_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")


def op9_learned_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return setjoin.join(table(spark, sf_dir, "documents"), 3, 90, 100)


def op11_gated_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gru.likelihood(table(spark, sf_dir, "documents"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tampered(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.figures(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), public_tokenizers.path(PIECES))


def _shipped(query):
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


QUERIES = {f.__name__: _shipped(f) for f in (
    op1_suffix_dedup, op2_language_mixture, op3_best_fit_packing, op4_cover_tree_topk, op5_viterbi_token_count, op6_virtual_slots,
    op7_forced_boundary_bpe, op8_toxic_lexicon, op9_learned_partitions, op10_ngram_jaccard_join, op11_gated_recurrent_lm, op12_merkle_manifest, op13_token_alignment)}
ORACLE: dict[str, str] = {"op12_merkle_manifest": """
WITH RECURSIVE
crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(256) r(i))),
leaves AS (
  SELECT doc_id, lang, source, n_chars, text,
    sha256(concat(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(doc_id::VARCHAR), ':', doc_id) END,
                  CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END,
                  CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END,
                  CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen(n_chars::VARCHAR), ':', n_chars) END,
                  CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END)) AS leaf,
    sha256(concat(CASE WHEN doc_id IS NULL THEN '-' ELSE concat(strlen(doc_id::VARCHAR), ':', doc_id) END,
                  CASE WHEN source IS NULL THEN '-' ELSE concat(strlen(source), ':', source) END,
                  CASE WHEN lang IS NULL THEN '-' ELSE concat(strlen(lang), ':', lang) END,
                  CASE WHEN n_chars IS NULL THEN '-' ELSE concat(strlen((n_chars + 1)::VARCHAR), ':', n_chars + 1) END,
                  CASE WHEN text IS NULL THEN '-' ELSE concat(strlen(text), ':', text) END)) AS altered,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
                    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 7 = 0 AS changed
  FROM documents, crc_table),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM leaves),
tree AS (
  SELECT lang, 0 AS lvl, pos, n, leaf AS h FROM placed
  UNION ALL
  SELECT lang, lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tree WHERE n > 1 GROUP BY lang, lvl, pos // 2, n),
subroots AS (
  SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM tree WHERE n = 1),
top AS (
  SELECT 0 AS lvl, pos, n, subroot AS h FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 2, n),
walk AS (
  SELECT doc_id, lang, leaf, 0 AS lvl, pos, n, '' AS proof, CASE WHEN changed THEN altered ELSE leaf END AS h, pos AS start FROM placed
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf, w.lvl + 1, w.pos // 2, (w.n + 1) // 2, w.proof || coalesce(s.h, ''),
         sha256(CASE WHEN w.pos % 2 = 0 THEN w.h || coalesce(s.h, '') ELSE s.h || w.h END), w.start
  FROM walk w LEFT JOIN tree s ON s.lang IS NOT DISTINCT FROM w.lang AND s.lvl = w.lvl AND s.pos = xor(w.pos, 1::BIGINT)
  WHERE w.n > 1),
up AS (
  SELECT w.doc_id, w.leaf, r.subroot, 0 AS lvl, r.pos, r.n, w.proof, w.h, w.lang, w.start
  FROM walk w JOIN subroots r ON w.lang IS NOT DISTINCT FROM r.lang WHERE w.n = 1
  UNION ALL
  SELECT u.doc_id, u.leaf, u.subroot, u.lvl + 1, u.pos // 2, (u.n + 1) // 2, u.proof || coalesce(s.h, ''),
         sha256(CASE WHEN u.pos % 2 = 0 THEN u.h || coalesce(s.h, '') ELSE s.h || u.h END), u.lang, u.start
  FROM up u LEFT JOIN top s ON s.lvl = u.lvl AND s.pos = xor(u.pos, 1::BIGINT) WHERE u.n > 1)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, h AS folded_root, h = root AS verified
FROM up, (SELECT h AS root FROM top WHERE n = 1) WHERE n = 1
"""}
