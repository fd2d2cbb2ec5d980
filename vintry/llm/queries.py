"""Queries that apply the operators to the given tables with production parameters.

Their SQL counterparts stand beside them where SQL can express the operator.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vintry.llm import (
    byte_bpe, hnsw, licenses, merkle, packing, quality, repair, simhash, stream_bpe, token_counts,
    topk, toxicity, url_cascade,
)

BYTE_RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORD_VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "documents").select("doc_id", "text")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    return quality.classified(_texts(spark, sf_dir), labels).select(
        "doc_id", "held_out", "score", "predicted"
    )


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_texts(spark, sf_dir)).select(
        "doc_id",
        F.array_join(F.array_sort("licences"), "|").alias("licences"),
        F.size("licences").cast("bigint").alias("n_licences"),
        F.size("sentence_ids").cast("bigint").alias("n_sentences"),
        F.col("unmatched").cast("bigint").alias("n_unmatched"),
    )


def op3_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hnsw.near_duplicates(_table(spark, sf_dir, "embeddings")).drop("label")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_texts(spark, sf_dir))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.round_trip(_texts(spark, sf_dir), BYTE_RANKS, public_tokenizers.PATTERN)
    ids = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_texts(spark, sf_dir), WORD_VOCABULARY).drop("text")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_texts(spark, sf_dir), WORD_VOCABULARY, with_ids=False).drop("bucket")


# The rules of the query.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]


def op9_url_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    return url_cascade.judge(pages, URL_RULES).drop("url")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _table(spark, sf_dir, "labels")
    return toxicity.scored(_texts(spark, sf_dir), labels).select(
        "doc_id", "held_out", "score", "predicted"
    )


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.conversations_summary(repair.damaged(_table(spark, sf_dir, "conversations")))


def op12_stream_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = stream_bpe.round_trip(_texts(spark, sf_dir), WORD_VOCABULARY)
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A wider type than the column's, so that one more always fits.
    n_chars = F.col("n_chars").cast("decimal(20,0)")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    claimed = {"n_chars": F.when(tampered, n_chars + 1).otherwise(n_chars)}
    return merkle.manifest(_table(spark, sf_dir, "documents"), claimed).select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(F.array_join("proof.sibling", ""), 256).alias("proof_sha256"),
        F.col("claimed_root").alias("folded_root"),
        (F.col("claimed_root") == F.col("root")).alias("verified"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_quality, op2_licenses, op3_hnsw, op4_topk, op5_simhash, op6_byte_bpe,
        op7_token_counts, op8_packing, op9_url_cascade, op10_toxicity, op11_repair,
        op12_stream_bpe, op13_merkle,
    )
    return {query.__name__: query for query in own}


# The given documents hold four licence notes and one notice that names no licence, each on
# a line of its own.
_LICENCES = """
WITH known(sentence, licence) AS (VALUES
  ('Licensed under CC BY-NC 4.0.', 'CC-BY-NC-4.0'),
  ('This work is licensed under the GNU General Public License, version 3.', 'GPL-3'),
  ('Licensed under the Apache License, Version 2.0.', 'Apache-2.0'),
  ('Released under the MIT License.', 'MIT'),
  ('All rights reserved.', NULL)
), rows_ AS (
  SELECT row_number() OVER () AS n, doc_id, coalesce(text, '') AS text FROM documents
), found AS (
  SELECT n, licence FROM (SELECT n, unnest(string_split(text, chr(10))) AS line FROM rows_)
  JOIN known ON trim(line) = sentence
), summed AS (
  SELECT n, string_agg(DISTINCT licence, '|' ORDER BY licence) AS licences,
    count(DISTINCT licence) AS n_licences, count(*) AS n_sentences,
    count(*) FILTER (WHERE licence IS NULL) AS n_unmatched
  FROM found GROUP BY n
)
SELECT doc_id, coalesce(licences, '') AS licences, coalesce(n_licences, 0) AS n_licences,
  coalesce(n_sentences, 0) AS n_sentences, coalesce(n_unmatched, 0) AS n_unmatched
FROM rows_ LEFT JOIN summed USING (n)
"""

_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scored
)
SELECT query_id, r::INTEGER AS rank, vec_id, score FROM ranked WHERE r <= 20
"""

_LINKS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id
  AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
), lowest AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
FROM lowest LEFT JOIN counts USING (vec_id)
"""

_URLS = """
WITH parts AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
  FROM pages
), split AS (
  SELECT page_id,
    translate(regexp_extract(rest, '^([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1, 's') AS path
  FROM parts
), rules(verdict, h, p) AS (VALUES
  ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
  ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), fits AS (
  SELECT page_id, h || p AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS r
  FROM split JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT split.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM split LEFT JOIN fits ON split.page_id = fits.page_id AND r = 1
"""


def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text, bit by bit."""
    return f"""xor(list_reduce(
      flatten(list_transform(string_split({text}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x)
                        WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END,
      4294967295::BIGINT), 4294967295)"""


_REPAIR = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS place
  FROM conversations
), kinds AS (SELECT *, {_crc32('place')} % 20 AS kind FROM keyed),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS pos
  FROM damaged
), judged AS (
  SELECT *, left(role, 1) AS initial, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS unended,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before
  FROM placed
), faults AS (
  SELECT *, NOT blank AND seen AS duplicate, NOT blank AND NOT seen AND unended AS truncated FROM judged
), counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
    count(*) FILTER (WHERE truncated) AS truncated,
    count(*) FILTER (WHERE before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    max(pos) AS rows_
  FROM faults GROUP BY conv_id
), fills(src, dst, n, lines) AS (VALUES
  (0, 0, 0, []::VARCHAR[]), (1, 1, 0, []), (2, 2, 0, []), (3, 3, 0, []),
  (0, 2, 1, ['user:']), (1, 2, 1, ['user:']), (2, 3, 1, ['assistant:']), (3, 2, 1, ['user:']),
  (0, 3, 2, ['user:', 'assistant:']), (1, 3, 2, ['user:', 'assistant:']),
  (2, 2, 2, ['assistant:', 'user:']), (3, 3, 2, ['user:', 'assistant:'])
), takes(src, dst, letter, given) AS (VALUES
  (0, 1, 's', ''), (0, 2, 'u', 'user'), (1, 2, 'u', 'user'), (2, 3, 'a', 'assistant'), (3, 2, 'u', 'user')
), moves AS (
  SELECT f.src, f.dst, n, lines, 'D' AS edit, '' AS letter, '' AS given FROM fills f
  UNION ALL SELECT f.src, t.dst, n, lines, 'K', letter, '' FROM fills f JOIN takes t ON f.dst = t.src
  UNION ALL SELECT f.src, t.dst, n, lines, 'R', '', given FROM fills f JOIN takes t ON f.dst = t.src
  WHERE given <> ''
), states AS (
  SELECT DISTINCT conv_id, 0::BIGINT AS pos, 0 AS place, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS body
  FROM conversations
  UNION ALL
  SELECT conv_id, pos, dst, cost, audit, body FROM (
    SELECT s.conv_id, f.pos, m.dst,
      s.cost + 5 * n + CASE edit WHEN 'D' THEN 2 WHEN 'K' THEN 0 ELSE 1 END
        + CASE WHEN truncated AND edit <> 'D' THEN 5 ELSE 0 END AS cost,
      s.audit || repeat('I', n) || edit AS audit,
      list_concat(s.body, lines, CASE edit WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text]
        ELSE [given || ':' || text] END) AS body,
      row_number() OVER (PARTITION BY s.conv_id, dst ORDER BY
        s.cost + 5 * n + CASE edit WHEN 'D' THEN 2 WHEN 'K' THEN 0 ELSE 1 END
          + CASE WHEN truncated AND edit <> 'D' THEN 5 ELSE 0 END,
        s.audit || repeat('I', n) || edit) AS r
    FROM states s JOIN faults f ON s.conv_id IS NOT DISTINCT FROM f.conv_id AND f.pos = s.pos + 1
    JOIN moves m ON m.src = s.place
      AND (edit = 'D' OR NOT (blank OR duplicate)) AND (edit <> 'K' OR letter = initial)
  ) WHERE r = 1
), ended AS (
  SELECT s.conv_id, s.cost + 5 * n AS cost, s.audit || repeat('I', n) AS audit,
    list_concat(s.body, lines) AS body,
    row_number() OVER (PARTITION BY s.conv_id ORDER BY s.cost + 5 * n, s.audit || repeat('I', n)) AS r
  FROM states s LEFT JOIN counts c ON s.conv_id IS NOT DISTINCT FROM c.conv_id
  JOIN fills f ON f.src = s.place AND f.dst IN (0, 3)
  WHERE s.pos = coalesce(rows_, 0)
)
SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit,
  sha256(array_to_string(body, chr(10))) AS repaired_sha256
FROM ended e LEFT JOIN counts c ON e.conv_id IS NOT DISTINCT FROM c.conv_id WHERE r = 1
"""


def _framed(*fields: str) -> str:
    parts = [f"coalesce(strlen({f}::VARCHAR) || ':' || {f}::VARCHAR, '-')" for f in fields]
    return f"sha256({' || '.join(parts)})"


def _climb(level: str, tree: str) -> str:
    """All levels of the trees whose leaves ``level`` holds, by a recursive table."""
    return f"""
  SELECT {tree}, 0 AS depth, i, size, h FROM {level}
  UNION ALL
  SELECT {tree}, depth + 1, i // 2, (size + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes_of_{level}
  WHERE size > 1 GROUP BY {tree}, depth, i // 2, size
"""


_MERKLE = f"""
WITH RECURSIVE raw_rows AS (
  SELECT *, n_chars + CASE WHEN {_crc32('doc_id::VARCHAR')} % 7 = 0 THEN 1 ELSE 0 END AS changed
  FROM documents
), hashed AS (
  SELECT doc_id, lang, {_framed('doc_id', 'source', 'lang', 'n_chars', 'text')} AS h,
    {_framed('doc_id', 'source', 'lang', 'coalesce(changed, n_chars)', 'text')} AS claim
  FROM raw_rows
), low AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS i,
    count(*) OVER (PARTITION BY lang) AS size FROM hashed
), nodes_of_low AS ({_climb('low', 'lang')}),
subroots AS (SELECT lang, h, depth FROM nodes_of_low WHERE size = 1),
high AS (
  SELECT 0 AS top, lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS size
  FROM subroots
), nodes_of_high AS ({_climb('high', 'top')}),
root AS (SELECT h, depth FROM nodes_of_high WHERE size = 1),
walk AS (
  SELECT doc_id, lang, h AS leaf, i AS place, 0 AS depth, i, claim AS node, '' AS proof FROM low
  UNION ALL
  SELECT w.doc_id, w.lang, w.leaf, w.place, w.depth + 1, w.i // 2,
    sha256(CASE WHEN w.i % 2 = 1 THEN n.h || w.node ELSE w.node || coalesce(n.h, '') END),
    w.proof || coalesce(n.h, '')
  FROM walk w JOIN subroots s ON w.lang IS NOT DISTINCT FROM s.lang AND w.depth < s.depth
  LEFT JOIN nodes_of_low n ON n.lang IS NOT DISTINCT FROM w.lang AND n.depth = w.depth AND n.i = xor(w.i, 1)
), climbed AS (
  SELECT w.doc_id, w.leaf, w.place, s.h AS subroot, 0 AS depth, high.i, w.node, w.proof
  FROM walk w JOIN subroots s ON w.lang IS NOT DISTINCT FROM s.lang AND w.depth = s.depth
  JOIN high ON high.lang IS NOT DISTINCT FROM w.lang
  UNION ALL
  SELECT c.doc_id, c.leaf, c.place, c.subroot, c.depth + 1, c.i // 2,
    sha256(CASE WHEN c.i % 2 = 1 THEN n.h || c.node ELSE c.node || coalesce(n.h, '') END),
    c.proof || coalesce(n.h, '')
  FROM climbed c JOIN root ON c.depth < root.depth
  LEFT JOIN nodes_of_high n ON n.depth = c.depth AND n.i = xor(c.i, 1)
)
SELECT doc_id, leaf, subroot, root.h AS root, sha256(proof) AS proof_sha256, node AS folded_root,
  node = root.h AS verified
FROM climbed JOIN root ON climbed.depth = root.depth
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op2_licenses": _LICENCES, "op3_hnsw": _LINKS, "op4_topk": _TOP_K,
        "op9_url_cascade": _URLS, "op11_repair": _REPAIR, "op13_merkle": _MERKLE,
    }
