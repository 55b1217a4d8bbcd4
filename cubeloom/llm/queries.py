"""The queries ``opN_<name>`` over whole tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubeloom.llm import bpe, decontamination, exact_dedup, html_text, quality, secrets, simhash, token_records, url_rules, warc
from cubeloom.llm.common import shared_dir, table

#: Vocabulary file of the byte-level BPE; found beside the public tokenizers where the package is installed.
VOCABULARY = "byte_bpe_50k.json"


def vocabulary(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.grouped(table(spark, sf_dir, "documents"))
    return groups.withColumn("fingerprint", simhash.hexadecimal(F.col("fingerprint")))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, vocabulary(), keep_text=False)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.annotate(table(spark, sf_dir, "documents"))
    return rows.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.scan(docs, keep_text=False)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), out)
    return warc.read(spark, out)


def op7_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shared_dir(spark, "token-records")
    token_records.write(table(spark, sf_dir, "documents"), out, vocabulary())
    return token_records.index(spark, out).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.assess(docs, table(spark, sf_dir, "labels"), keep_text=False)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    judged = url_rules.judge(pages)
    named = F.when(F.col("rule_priority") >= 1, F.col("rule"))
    return judged.select("page_id", "host", "path", named.alias("rule"), "verdict")


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_simhash": op2_simhash,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_secrets": op5_secrets,
    "op6_warc": op6_warc,
    "op7_token_records": op7_token_records,
    "op8_quality": op8_quality,
    "op9_url_filter": op9_url_filter,
    "op10_main_text": op10_main_text,
}

_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": f"""
        WITH t AS (SELECT doc_id, {_FOLD} AS body FROM documents),
        g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY body)
        SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.body) AS text_sha256
        FROM t JOIN g ON t.body = g.body""",
    "op6_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
        g AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest,
                max(page_id) OVER (PARTITION BY body) AS keep FROM p)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 1000 AND keep <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN payload_bytes >= 1000 AND keep <> page_id THEN keep END AS refers_to
        FROM g""",
    "op9_url_filter": r"""
        WITH a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        b AS (SELECT page_id,
                translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
        c AS (SELECT *, CASE
                WHEN (host = 'example.net' OR suffix(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN (host = 'example.com' OR suffix(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN (host = 'org' OR suffix(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN (host = 'net' OR suffix(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM b)
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
            WHEN rule IS NOT NULL THEN 'block'
            WHEN regexp_matches(host || path, '^([^/]*\.)?(cheap-pills|spam-farm)\.') THEN 'block'
            WHEN regexp_matches(host || path, '/docs/ads/') THEN 'allow'
            WHEN regexp_matches(host || path, '^([^/]*\.)?casino\.|/ads/|/banner/.*/click([^A-Za-z0-9_.%-]|$)|/tracking/pixel\.') THEN 'block'
            ELSE 'allow' END AS verdict
        FROM c""",
}
