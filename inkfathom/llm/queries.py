"""The corpus operators as queries over whole tables, with production parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from . import caps, exact_dedup, html_text, language, mixing, near_dedup, packing, pseudonyms, secrets, warc
from .common import SPACE


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = warc.archived_captures(_table(spark, sf_dir, "pages"))
    return merged.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(_table(spark, sf_dir, "documents"), words=4)


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(_table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op8_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed by inkfathom.pseudonym.key. A session without one gets a random key of its own: such pseudonyms cannot be
    turned back, and link documents within the session only."""
    key = spark.conf.get("inkfathom.pseudonym.key", None)
    if not key:
        key = uuid.uuid4().hex + uuid.uuid4().hex
        spark.conf.set("inkfathom.pseudonym.key", key)
    return pseudonyms.pseudonyms(_table(spark, sf_dir, "documents"), key)


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return caps.near_vectors(_table(spark, sf_dir, "embeddings"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_packing": op1_packing,
    "op2_warc": op2_warc,
    "op3_mixing": op3_mixing,
    "op4_html_text": op4_html_text,
    "op5_near_dedup": op5_near_dedup,
    "op6_secrets": op6_secrets,
    "op7_language": op7_language,
    "op8_pseudonyms": op8_pseudonyms,
    "op9_near_vectors": op9_near_vectors,
    "op10_exact_dedup": op10_exact_dedup,
}

_WARC_SQL = """
WITH p AS (SELECT page_id, lower(coalesce(url, '')) AS low, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
k AS (SELECT *, regexp_replace(low, '^[a-z][a-z0-9+.-]*://|#.*$', '', 'g') AS u FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM k)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to,
  array_to_string(list_reverse(string_split(regexp_replace(regexp_extract(u, '^([^/?]*)', 1), '^www\\.|:(80|443)$', '', 'g'), '.')), ',') || ')' || regexp_extract(u, '^[^/?]*(.*)$', 1) AS url_key,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(coalesce(page_id, 0)), '%Y-%m-%dT%H:%M:%SZ') AS ts
FROM f"""

_EXACT_SQL = f"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{SPACE}', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id IS NOT DISTINCT FROM min(doc_id) OVER same AS kept, sha256(norm) AS text_sha256
FROM n WINDOW same AS (PARTITION BY norm)"""

_NEAR_SQL = """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i+3], ' ')) END) AS sh FROM w),
n AS (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM e x JOIN e y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * shared >= 80 * (na.n + nb.n - shared)),
r(doc_id, other) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.other)
SELECT doc_id, any_value(n.n) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept FROM r JOIN n USING (doc_id) GROUP BY doc_id"""

_VECTOR_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS x, len(embedding) AS d FROM embeddings),
ok AS (SELECT vec_id, label, x, d FROM v WHERE label IS NOT NULL AND vec_id IS NOT NULL AND d > 0 AND len(list_filter(x, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
l AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.label = q.label AND p.d = q.d AND p.vec_id <> q.vec_id WHERE list_cosine_similarity(p.x, q.x) >= 0.98),
r(vec_id, other) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.vec_id, l.b FROM r JOIN l ON l.a = r.other),
c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id),
k AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT vec_id, coalesce(k.n, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM c LEFT JOIN k USING (vec_id)"""

#: Packing, mixing, extraction, language and pseudonyms have none: random draws, trained models, tokenizers and keyed
#: hashes are beyond SQL; tests/llm holds them against round trips, brute force and held-out accuracy.
ORACLE_SQL = {
    "op2_warc": _WARC_SQL,
    "op5_near_dedup": _NEAR_SQL,
    "op6_secrets": secrets.spans_sql(),
    "op9_near_vectors": _VECTOR_SQL,
    "op10_exact_dedup": _EXACT_SQL,
}
