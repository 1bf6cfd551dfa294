"""The corpus queries, one for each operator, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import byte_bpe, edit_fingerprint, lattice_lm, license_scan, near_dedup, quality, substring_dedup, toxicity
from .common import table
from .exact_dedup import exact_dedup
from .mixing import BLOCK_WORDS, BUCKETS, FACTOR, FACTOR2, PRIME, ROUNDS, SEED, SHARD_SLOTS, mix_report


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), similarity=85)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(byte_bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN))


def op5_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice_lm.lm_score(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.report(substring_dedup.substring_dedup(table(spark, sf_dir, "documents")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_report(license_scan.scan_licenses(table(spark, sf_dir, "documents")))


def op8_edit_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edit_fingerprint.report(edit_fingerprint.fingerprint(table(spark, sf_dir, "documents")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_exact_dedup, op3_near_dedup, op4_byte_bpe, op5_lattice_lm, op6_substring_dedup, op7_license_scan, op8_edit_fingerprint, op9_mixing, op10_toxicity)}

def _linear_sql(x: str, key: str) -> str:
    return f"((({x}) % {PRIME}) * {FACTOR} + (({x}) // {PRIME}) * {FACTOR2} + ({key})) % {PRIME}"


def _uniform_sql(x: str) -> str:
    """A CTE's columns p and q after two squarings, from draws."""
    sides = ", ".join(f"{_linear_sql(x, str(key * 7919))} AS {side}" for side, key in (("p", SEED), ("q", SEED + 1)))
    steps = f"SELECT id, {sides} FROM ids"
    for step in (1, 2):
        steps = f"SELECT id, (p * p + {step * SEED}) % {PRIME} AS p, (q * q + {step * (SEED + 1)}) % {PRIME} AS q FROM ({steps})"
    return steps


#: The whole draw in SQL: targets by water level, shards' draws and their correction, the permutation, blocks joined by index.
MIXING_SQL = rf"""
    WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    o AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k FROM s),
    w AS (SELECT *, CASE k % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, source_size * 2.0::DOUBLE AS cap FROM o),
    r AS (SELECT *, cap / w AS ratio FROM w),
    l AS (SELECT *, sum(source_size) OVER () AS words, sum(w) OVER () AS w_all, coalesce(sum(cap) OVER b, 0) AS full_before, coalesce(sum(w) OVER b, 0) AS w_before
          FROM r WINDOW b AS (ORDER BY ratio, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    v AS (SELECT *, (1.5::DOUBLE * words - full_before) / nullif(w_all - w_before, 0) AS level FROM l),
    t AS (SELECT k, source, source_size, least(cap, coalesce(max(CASE WHEN level <= ratio THEN level END) OVER (), ratio) * w) AS target FROM v),
    n AS (SELECT *, (source_size + {BLOCK_WORDS - 1}) // {BLOCK_WORDS} AS blocks, ('0x' || left(md5(coalesce('s' || source, 'n') || '#{SEED}'), 7))::BIGINT AS seed FROM t WHERE source_size > 0),
    c AS (SELECT *, CAST(floor(target * blocks / source_size + 0.5::DOUBLE) AS BIGINT) AS slots FROM n),
    iv AS (SELECT k, CAST(sum(slots) OVER (ORDER BY k) AS BIGINT) AS hi, CAST(sum(slots) OVER (ORDER BY k) AS BIGINT) - slots AS lo FROM c),
    ids AS (SELECT unnest(range((SELECT CAST(coalesce(sum(slots), 0) AS BIGINT) FROM c))) AS id),
    u AS (SELECT id // {SHARD_SLOTS} AS shard, (p * {PRIME} + q) % (SELECT CAST(sum(slots) AS BIGINT) FROM c) AS u FROM ({_uniform_sql('id')})),
    g AS (SELECT k, shard, count(*) AS n FROM u JOIN iv ON u >= lo AND u < hi GROUP BY k, shard),
    h AS (SELECT g.*, slots, coalesce(sum(n) OVER (PARTITION BY k ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM g JOIN c USING (k)),
    q AS (SELECT k, shard, n, least(n, greatest(slots - before, 0)) AS kept FROM h),
    over AS (SELECT shard, n - kept AS n, sum(n - kept) OVER (ORDER BY k, shard) AS hi FROM q WHERE n > kept),
    short AS (SELECT k, n, sum(n) OVER (ORDER BY k) AS hi FROM (SELECT c.k, slots - coalesce(drawn, 0) AS n FROM c LEFT JOIN (SELECT k, sum(n) AS drawn FROM g GROUP BY k) x USING (k)) WHERE n > 0),
    f AS (SELECT short.k, over.shard, count(*) AS n FROM (SELECT shard, unnest(range(CAST(hi - n AS BIGINT), CAST(hi AS BIGINT))) AS unit FROM over) over
          JOIN (SELECT k, unnest(range(CAST(hi - n AS BIGINT), CAST(hi AS BIGINT))) AS unit FROM short) short USING (unit) GROUP BY ALL),
    m AS (SELECT k, shard, CAST(sum(n) AS BIGINT) AS n FROM (SELECT k, shard, kept AS n FROM q WHERE kept > 0 UNION ALL SELECT * FROM f) GROUP BY k, shard),
    b AS (SELECT k, shard, n, CAST(coalesce(sum(n) OVER (PARTITION BY k ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM m),
    slot AS (SELECT k, shard, unnest(range(before, before + n)) AS slot FROM b),
    perm AS (
      SELECT k, shard, blocks, seed, slot % blocks AS x, CAST(1 AS BIGINT) AS r FROM slot JOIN c USING (k)
      UNION ALL
      SELECT k, shard, blocks, seed, CASE WHEN (y * y) % {PRIME} % 2 = 1 THEN mirror ELSE x END, r + 1 FROM (
        SELECT *, {_linear_sql('greatest(x, mirror)', 'key')} AS y FROM (
          SELECT *, (key * {FACTOR2} + r - x) % blocks + CASE WHEN (key * {FACTOR2} + r - x) % blocks < 0 THEN blocks ELSE 0 END AS mirror FROM (
            SELECT *, (seed * (r + 2) * 104729 + r * 15485863) % {PRIME} AS key FROM perm WHERE r <= {ROUNDS})))),
    drawn AS (SELECT k, x AS block, count(*) AS times, min(shard) AS shard FROM perm WHERE r = {ROUNDS + 1} GROUP BY k, x),
    laid AS (SELECT d.*, k, source_size, target, coalesce(sum(size) OVER (PARTITION BY k ORDER BY ('0x' || left(md5(coalesce(doc_id::VARCHAR, 'n') || '#{SEED}'), 7))::BIGINT % {BUCKETS}, doc_id, size
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    piece AS (SELECT k, doc_id, start, size, unnest(range(start // {BLOCK_WORDS}, (start + size - 1) // {BLOCK_WORDS} + 1)) AS block FROM laid WHERE size > 0),
    taken AS (SELECT k, doc_id, start, sum(times * (least((block + 1) * {BLOCK_WORDS}, start + size) - greatest(block * {BLOCK_WORDS}, start))) AS taken, min(shard) AS first_shard FROM piece JOIN drawn USING (k, block) GROUP BY ALL)
    SELECT laid.doc_id, laid.size, laid.source_size, laid.target, CAST(coalesce(taken, 0) AS BIGINT) AS taken, first_shard
    FROM laid LEFT JOIN taken ON laid.doc_id = taken.doc_id AND laid.k = taken.k AND laid.start = taken.start AND laid.size > 0"""

ORACLES = {
    "op9_mixing": MIXING_SQL,
    "op2_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM t""",
    "op3_near_dedup": r"""
        WITH RECURSIVE w AS (
          SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        s AS (
          SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
            ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS g FROM w),
        n AS (SELECT doc_id, count(*) AS k FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 85 * (a.k + b.k - c)),
        e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
        r AS (SELECT doc_id AS u, doc_id AS v FROM documents UNION SELECT r.u, e.y FROM r JOIN e ON r.v = e.x),
        m AS (SELECT u, min(v) AS component_id FROM r GROUP BY u)
        SELECT d.doc_id, coalesce(n.k, 0) AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN m ON m.u = d.doc_id""",
    "op6_substring_dedup": r"""
        WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        x AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
        m AS (SELECT h, min(doc_id) AS lo FROM x GROUP BY h),
        c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM x JOIN m USING (h) WHERE lo < doc_id),
        v AS (SELECT w.doc_id, q.p, w.ws[q.p] AS word, c.p IS NOT NULL AS gone
              FROM w, LATERAL (SELECT unnest(range(1, len(w.ws) + 1)) AS p) q LEFT JOIN c ON c.doc_id = w.doc_id AND c.p = q.p),
        k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY p) FILTER (NOT gone), '') AS kept FROM v GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id""",
}
