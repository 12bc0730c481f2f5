"""The queries of this subpackage, each over the whole of its table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .angular import hard_negatives
from .ftrl import quality_scores
from .grace import grace_dedup
from .hmm import hmm_scores
from .lemp import lexical_search
from .licences import scan_licences
from .lsh_forest import ngram_join
from .mixing import mix_sources
from .packing import pack_documents
from .repetition import quality_rules
from .simple8b import read_tokens, write_tokens
from .toxicity import toxicity
from .trie_counts import token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            ORACLE[name] = sql
        return run

    return register


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query(
    "op5_mix_sources",
    r"""
    WITH sized AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
    summed AS (
      SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
             row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM sized GROUP BY source),
    rated AS (
      SELECT *, (source_no - 1) % 3 + 1 AS weight FROM summed),
    roomed AS (
      SELECT *, CAST(3 * source_size AS DOUBLE) / weight AS room FROM rated),
    levelled AS (
      SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER before, 0) AS DOUBLE)
                / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
      FROM roomed WINDOW before AS (ORDER BY room, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    chosen AS (SELECT level FROM levelled WHERE level <= room ORDER BY room, source_no LIMIT 1),
    targets AS (
      SELECT r.*, least(CAST(3 * source_size AS DOUBLE), chosen.level * weight) AS target FROM roomed r, chosen),
    needed AS (
      SELECT *, least(3 * source_size, CAST(floor(target + 0.5) AS BIGINT)) AS need FROM targets),
    placed AS (
      SELECT d.doc_id, d.size, t.source_no, t.source_size, t.target, t.need,
             CAST(sum(d.size) OVER (PARTITION BY t.source_no ORDER BY md5(CAST(d.doc_id AS VARCHAR)), d.doc_id, d.size
                                    ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS start
      FROM sized d JOIN needed t ON d.source IS NOT DISTINCT FROM t.source),
    owners AS (
      SELECT source_no, (need + 255) // 256 AS blocks, CAST(sum((need + 255) // 256) OVER (ORDER BY source_no) AS BIGINT) AS hi
      FROM needed WHERE need > 0),
    points AS (
      SELECT i, floor(CAST(((i + 1)::HUGEINT * 10872568911861) % 17592186044416 AS DOUBLE) / 17592186044416.0::DOUBLE * total) AS cell
      FROM (SELECT CAST(sum(blocks) AS BIGINT) AS total FROM owners) t, range(0, 3 * t.total) r(i)),
    ranked AS (
      SELECT i, source_no, blocks, row_number() OVER (PARTITION BY source_no ORDER BY i) - 1 AS block
      FROM points JOIN owners ON hi - blocks <= cell AND cell < hi),
    schedule AS (
      SELECT source_no, block, row_number() OVER (ORDER BY i) - 1 AS slot FROM ranked WHERE block < blocks),
    walked AS (
      SELECT *, p * source_size + start AS came FROM placed, range(0, 3) t(p) WHERE size > 0 AND p * source_size + start < need),
    pieces AS (
      SELECT source_no, start, unnest(range(came // 256, (least(came + size, need) - 1) // 256 + 1)) AS block FROM walked),
    used AS (
      SELECT source_no, start, min(slot) AS first_slot, count(DISTINCT slot) AS n_slots
      FROM pieces JOIN schedule USING (source_no, block) GROUP BY source_no, start)
    SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
           CAST(greatest(0, least(size, need - start))
              + greatest(0, least(size, need - start - source_size))
              + greatest(0, least(size, need - start - 2 * source_size)) AS BIGINT) AS taken,
           CASE WHEN size > 0 THEN first_slot END AS first_slot,
           CASE WHEN size > 0 THEN coalesce(n_slots, 0) ELSE 0 END AS n_slots
    FROM placed LEFT JOIN used USING (source_no, start)
    """,
)
def op5_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    taken = mix_sources(documents(spark, folder)).taken()
    return taken.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "first_slot", "n_slots")


@query(
    "op6_grace_dedup",
    """
    SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
           doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
    """,
)
def op6_grace_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return grace_dedup(documents(spark, folder)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@query(
    "op9_suffix_repetition",
    r"""
    WITH cut AS (
      SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    at8 AS (
      SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i,
             unnest(list_transform(range(1, len(ws) - 6), lambda i: hash(ws[i:i + 7]))) AS h FROM cut),
    again AS (
      SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, h) AS c FROM at8) WHERE c > 1),
    places AS (SELECT DISTINCT doc_id, i + k AS p FROM again, range(0, 8) t(k)),
    covered AS (
      SELECT doc_id, count(*) AS n_repeat_words, sum(length(ws[p])) AS repeat_chars FROM places JOIN cut USING (doc_id) GROUP BY doc_id),
    at101 AS (
      SELECT doc_id, unnest(list_transform(range(1, len(ws) - 99), lambda i: hash(ws[i:i + 100]))) AS h FROM cut),
    long AS (
      SELECT DISTINCT doc_id FROM at101 GROUP BY doc_id, h HAVING count(*) > 1),
    lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM cut),
    dup AS (
      SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
    measured AS (
      SELECT cut.doc_id, CAST(len(ws) AS BIGINT) AS n_words,
             CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
             CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
             coalesce(repeat_chars, 0) AS repeat_chars, long.doc_id IS NOT NULL AS too_long
      FROM cut LEFT JOIN covered USING (doc_id) LEFT JOIN dup USING (doc_id) LEFT JOIN long USING (doc_id))
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
           n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
           NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words)
             AND repeat_chars / greatest(word_chars, 1) <= 0.3 AND NOT too_long AS kept
    FROM measured
    """,
)
def op9_suffix_repetition(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(documents(spark, folder)).drop("longest_repeat", "repeat_fraction", "spans")


@query("op10_license_rules")
def op10_license_rules(spark: SparkSession, folder: str) -> DataFrame:
    return scan_licences(documents(spark, folder)).drop("n_found", "found")


@query("op3_ngram_join")
def op3_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join(documents(spark, folder))


@query("op4_simple8b_tokens")
def op4_simple8b_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return read_tokens(write_tokens(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json")), with_ids=False)


@query("op7_pattern_packing")
def op7_pattern_packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack_documents(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


@query("op8_deobfuscated_toxicity")
def op8_deobfuscated_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@query("op1_hmm_scores")
def op1_hmm_scores(spark: SparkSession, folder: str) -> DataFrame:
    return hmm_scores(documents(spark, folder))


@query("op2_trie_token_counts")
def op2_trie_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts(documents(spark, folder), public_tokenizers.path("piece_bpe_32k.model"))


@query(
    "op11_hard_negatives",
    """
    WITH usable AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
      FROM embeddings
      WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
    scored AS (
      SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    positives AS (
      SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
    negatives AS (
      SELECT p.anchor_id, p.positive_id,
             row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS rank,
             s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
      FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
      WHERE 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
    FROM negatives WHERE rank <= 5
    """,
)
def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{folder}/embeddings.parquet"))


@query(
    "op12_lexical_search",
    r"""
    WITH tokens AS (
      SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
    counted AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY doc_id, term),
    sized AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counted GROUP BY doc_id),
    corpus AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM sized),
    asked AS (
      SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    weighed AS (
      SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
      FROM counted, corpus GROUP BY term, docs),
    scored AS (
      SELECT item_id, doc_id,
             CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words)))) AS BIGINT) AS score
      FROM asked JOIN weighed USING (term) JOIN counted USING (term) JOIN sized USING (doc_id), corpus
      GROUP BY item_id, doc_id)
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scored WHERE score > 0
    QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 10
    """,
)
def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return lexical_search(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@query("op13_quality_classifier")
def op13_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))
