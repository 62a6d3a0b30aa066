"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, context_tree, decontam, licenses, lines, ngram_join, quality, sentencepiece_scan, sharding, substrings
from ._common import flat, table


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    decoded = sentencepiece_scan.decode(sentencepiece_scan.encode(docs))
    return decoded.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.size("ids").cast("long").alias("n_pieces"),
        "ids",
        (F.col("decoded") == F.col("text")).alias("round_trip"),
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_tree.score(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return flat(licenses.scan_licenses(docs), "license", ["doc_id"]).select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lines.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_deleted", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256")
    )


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.dedup_substrings(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", substrings.text_digest().alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = quality.judge(docs, ["doc_id"])
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sharding.shard(docs, 40).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return flat(found.withColumn("contaminated", decontam.contaminated()), "hits", ["doc_id", "contaminated"]).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link_classes(table(spark, sf_dir, "documents"))


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    formatted = chat.format_chat(table(spark, sf_dir, "conversations"))
    return formatted.select(
        "conv_id", "turn", "role", "kind", "call_id", "status", "linked_turn", "valid", "order_turn", "level", "json"
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_lm_score": op2_lm_score,
    "op3_license_scan": op3_license_scan,
    "op4_line_dedup": op4_line_dedup,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_sharding": op7_sharding,
    "op8_decontamination": op8_decontamination,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_chat_format": op10_chat_format,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"regexp_split_to_array({0}, '[\x20\x09-\x0D]+')"
_ALNUM = rf"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""

_OP6 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), m AS (
  SELECT rid, doc_id, host, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols,
    CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines FROM w
), win AS (
  SELECT rid, i, array_to_string(ws[i : i + 7], ' ') AS g FROM (
    SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) > 8)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1
), covered AS (
  SELECT rid, CAST(count(DISTINCT i + k) AS BIGINT) AS c FROM twice, range(8) AS r(k) GROUP BY rid
), a AS (
  SELECT m.*, coalesce(c, 0) AS n_repeat_words FROM m LEFT JOIN covered USING (rid)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    100 * n_symbols > 10 * word_chars OR 100 * n_dup_lines > 30 * n_lines
      OR word_chars < 2 * n_words OR word_chars > 14 * n_words AS soft_failed FROM a
), h AS (
  SELECT host, count(*) AS n, count(*) FILTER (base_failed OR soft_failed) AS f FROM b GROUP BY host
), p AS (
  SELECT count(*) AS k, sum(1000000 * f // n) / (1e6 * count(*)) AS mean,
    sum((1000000 * f // n) * (1000000 * f // n)) / (1e12 * count(*)) AS square FROM h
), q AS (
  SELECT mean, CASE WHEN square - mean * mean > 0 THEN mean * (1 - mean) / (square - mean * mean) - 1 ELSE 0 END AS strength FROM p
), v AS (
  SELECT host, (f + greatest(mean * strength, 0)) / (n + greatest(mean * strength, 0) + greatest((1 - mean) * strength, 0)) >= 0.5 AS host_bad
  FROM h, q
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (soft_failed AND host_bad) AS kept FROM b JOIN v USING (host)
"""

_OP8 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_ALNUM} AS ws FROM documents),
b AS (SELECT item_id, {_ALNUM} AS ws FROM benchmark),
pats AS (
  SELECT DISTINCT item_id, size, array_to_string(ws[i : i + size - 1], ' ') AS g FROM (
    SELECT item_id, ws, least(13, len(ws)) AS size, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM b WHERE len(ws) > 0)
), sizes AS (SELECT DISTINCT size FROM pats),
win AS (
  SELECT rid, size, i, array_to_string(ws[i : i + size - 1], ' ') AS g FROM (
    SELECT rid, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, sizes WHERE len(ws) >= size)
), hit AS (SELECT rid, i, win.size, item_id FROM win JOIN pats ON win.size = pats.size AND win.g = pats.g),
words AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + size)) AS p FROM hit) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (
    SELECT DISTINCT rid, CAST(item_id AS VARCHAR) AS item_id FROM hit) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)
"""

_LABELS = "\n    ".join(
    f"+ CASE WHEN regexp_matches(line, '{licenses.as_regex(t)}') THEN ['{label}'] ELSE [] END"
    for label, t in licenses.TEMPLATES.items()
)
_BASE = "\n    ".join(
    f"+ CASE WHEN contains(line, ' {phrase} ') THEN ['{label}'] ELSE [] END" for phrase, label in licenses.PHRASES.items()
)
_PHRASES = ", ".join(f"'{p}'" for p in licenses.PHRASES)

_OP3 = rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, {_ALNUM} AS ws FROM documents),
d AS (SELECT *, ' ' || array_to_string(ws, ' ') || ' ' AS line FROM w),
p AS (SELECT unnest([{_PHRASES}]) AS phrase),
hits AS (
  SELECT rid, count(*) AS n, min(i) AS lo, max(i) AS hi FROM (
    SELECT rid, ws, phrase, unnest(range(len(ws))) AS i FROM d, p WHERE contains(line, ' ' || phrase || ' '))
  WHERE array_to_string(ws[i + 1 : i + len(string_split(phrase, ' '))], ' ') = phrase GROUP BY rid),
l AS (
  SELECT rid, CAST([] AS VARCHAR[])
    {_BASE} AS base, CAST([] AS VARCHAR[])
    {_LABELS} AS own FROM d)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base,
  CAST(lo AS BIGINT) AS first_word, CAST(hi AS BIGINT) AS last_word,
  array_to_string(list_sort(list_distinct(base)), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(base + own)), ',') AS labels,
  CASE WHEN len(own) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END :: DOUBLE AS score
FROM d JOIN l USING (rid) LEFT JOIN hits USING (rid)
"""

_OP4 = r"""
WITH l AS (
  SELECT doc_id, pos, line, CASE WHEN regexp_matches(line, '[^\x20\x09-\x0D]')
      THEN array_to_string(list_filter(regexp_split_to_array(line, '[\x20\x09-\x0D]+'), lambda x: x <> ''), ' ') END AS norm
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)
), worded AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM l WHERE norm IS NOT NULL
), win AS (
  SELECT doc_id, k, norm || chr(10) || lead(norm) OVER o || chr(10) || lead(norm, 2) OVER o AS g
  FROM worded WINDOW o AS (PARTITION BY doc_id ORDER BY k)
), repeated AS (
  SELECT doc_id, k FROM (
    SELECT doc_id, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) AS r FROM win WHERE g IS NOT NULL)
  WHERE r > 1
), gone AS (SELECT DISTINCT doc_id, k + j AS k FROM repeated, range(3) AS r(j)),
marked AS (
  SELECT l.doc_id, l.pos, l.line, w.k, g.k AS gk FROM l LEFT JOIN worded w ON l.doc_id = w.doc_id AND l.pos = w.pos
  LEFT JOIN gone g ON g.doc_id = w.doc_id AND g.k = w.k
), kept AS (
  SELECT doc_id, CAST(count(k) AS BIGINT) AS n_lines, CAST(count(gk) AS BIGINT) AS n_deleted,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (gk IS NULL), '')) AS kept_sha256
  FROM marked GROUP BY doc_id
)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_deleted, 0) AS n_deleted,
  CASE WHEN text IS NOT NULL THEN kept_sha256 END AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)
"""

_OP10 = r"""
WITH m AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, role, coalesce(text, '') AS text,
    CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind FROM conversations
), n AS (
  SELECT *, CASE kind WHEN 'call' THEN 'turn-' || turn WHEN 'result' THEN 'turn-' || (turn - 1) END AS call_id FROM m
), calls AS (SELECT conv_id, call_id, min(turn) AS call_turn FROM n WHERE kind = 'call' GROUP BY ALL),
answers AS (SELECT conv_id, call_id, min(turn) AS answer_turn FROM n WHERE kind = 'result' GROUP BY ALL)
SELECT n.conv_id, turn, role, kind, n.call_id,
  CASE WHEN kind = 'message' THEN 'message' WHEN kind = 'call' AND answer_turn IS NULL THEN 'unanswered'
    WHEN kind = 'result' AND call_turn IS NULL THEN 'orphan' ELSE 'linked' END AS status,
  CASE kind WHEN 'call' THEN answer_turn WHEN 'result' THEN call_turn END AS linked_turn,
  kind <> 'call' OR text <> '' AS valid, turn AS order_turn,
  CAST(CASE WHEN kind = 'result' AND call_turn IS NOT NULL THEN 1 ELSE 0 END AS INTEGER) AS level,
  CAST(CASE kind
    WHEN 'call' THEN json_object('arguments', json_object('text', text), 'id', n.call_id, 'name', 'reply', 'role', role)
    WHEN 'result' THEN json_object('content', text, 'role', role, 'tool_call_id', n.call_id)
    ELSE json_object('content', text, 'role', role) END AS VARCHAR) AS json
FROM n LEFT JOIN calls USING (conv_id, call_id) LEFT JOIN answers USING (conv_id, call_id)
"""

_OP5 = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(ws[i : i + 19], ' ') AS g FROM (
    SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d WHERE len(ws) >= 20)
), repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win) WHERE r > 1
), gone AS (SELECT DISTINCT doc_id, i + k AS i FROM repeated, range(20) AS r(k)),
kept AS (
  SELECT w.doc_id, count(gone.i) AS n_removed, sha256(coalesce(string_agg(w.word, ' ' ORDER BY w.i) FILTER (gone.i IS NULL), '')) AS kept_sha256
  FROM (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d) w
  LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.i = w.i GROUP BY w.doc_id
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)
"""

ORACLES: dict[str, str] = {
    "op3_license_scan": _OP3,
    "op4_line_dedup": _OP4,
    "op5_substring_dedup": _OP5,
    "op6_quality_rules": _OP6,
    "op8_decontamination": _OP8,
    "op10_chat_format": _OP10,
}
