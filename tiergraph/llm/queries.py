"""Registered queries of the corpus operators: thin selections over the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import public_tokenizers

from tiergraph.llm import binary, chat, decontaminate, extract, jaccard, licenses, mixing, packing, quality, secrets
from tiergraph.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "p_quality")


@_query
def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_main(table(spark, sf_dir, "pages"), keep=["page_id", "url"]).select("page_id", "url", "text", "n_chars")


@_query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return marked.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


#: Alphabets for lower-casing A-Z alone, and words of the two kinds, in SQL.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES["op3_decontamination"] = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM_WORDS} AS ws FROM documents),
b AS (SELECT item_id, {_ALNUM_WORDS} AS ws FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(ws), 10) AS l, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS g
       FROM b, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS u(i) WHERE len(ws) > 0),
sizes AS (SELECT DISTINCT l FROM iw),
dw AS (SELECT r, p, l, array_to_string(ws[p:p + l - 1], ' ') AS g
       FROM (SELECT r, ws, l, unnest(range(1, len(ws) - l + 2)) AS p FROM d, sizes WHERE len(ws) >= l)),
h AS (SELECT dw.r, dw.p, dw.l, iw.item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.l = iw.l),
hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + l)) AS q FROM h) GROUP BY r),
it AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
       FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM h) GROUP BY r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)
"""


@_query
def op5_binary_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = binary.write_ids(table(spark, sf_dir, "documents"), binary.new_path(spark), public_tokenizers.path("word_bpe_49k.json"), "dropped", end_id=1)
    return binary.read_ids(spark, path)


@_query
def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), "spaced", end_id=0)


@_query
def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = secrets.scan_secrets(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return scanned.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


@_query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@_query
def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.lm_scores(table(spark, sf_dir, "documents"))


@_query
def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


ORACLES["op7_chat_formatting"] = """
WITH c AS (SELECT conv_id, list({'role': role, 'text': text} ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS l, count(*) AS n FROM conversations GROUP BY conv_id),
s AS (SELECT l, min(n) AS n, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY l),
p AS (SELECT DISTINCT l[1:k] AS l FROM (SELECT l, unnest(range(1, n)) AS k FROM c))
SELECT conv_id, n AS n_turns, n_copies,
       array_to_string([concat('<|im_start|>', coalesce(x.role, 'unknown'), chr(10), coalesce(x.text, ''), '<|im_end|>', chr(10)) FOR x IN l], '') AS rendered
FROM s WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.l IS NOT DISTINCT FROM s.l)
"""


@_query
def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))
