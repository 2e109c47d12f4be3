"""The registered queries of the corpus operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.llm import byte_pieces, divergence, language, near_vectors, quality, simhash, toxicity, vector_codes
from segmill.llm.block_search import nearest
from segmill.llm.common import table
from segmill.llm.packing import pack_documents
from segmill.llm.pieces import digest_documents
from segmill.llm.url_filter import Entry, judge_urls
from segmill.llm.warc import archive_pages

Query = Callable[[SparkSession, str], DataFrame]

URL_ENTRIES = [
    Entry("com", "/", "allow"),
    Entry("example.com", "/en/", "block"),
    Entry("www.example.com", "/en/", "allow"),
    Entry("net", "/es/", "block"),
    Entry("net", "/fr/", "block"),
]


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_hex(F.col("fp")).alias("fingerprint"), "component_id")


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), URL_ENTRIES).drop("url")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op11_byte_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_pieces.digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


OP2_SQL = """
WITH sized AS (SELECT page_id, encode(coalesce(html, '')) AS payload, sha1(coalesce(html, '')) AS hex FROM pages),
grouped AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS largest FROM sized)
SELECT page_id, octet_length(payload) AS payload_bytes,
       list_aggregate(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
           1 + CAST(((CAST('0x' || hex[1 + 5 * (i // 4) : 5 + 5 * (i // 4)] AS BIGINT)) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT)]),
           'string_agg', '') AS payload_digest,
       CASE WHEN page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < largest THEN largest END AS refers_to
FROM grouped
"""

OP3_SQL = """
WITH RECURSIVE pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b
  FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.93),
reached AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reached r JOIN pairs p ON r.b = p.a)
SELECT e.vec_id, (SELECT count(*) FROM pairs WHERE a = e.vec_id) AS n_links,
       least(e.vec_id, coalesce((SELECT min(b) FROM reached WHERE a = e.vec_id), e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce((SELECT min(b) FROM reached WHERE a = e.vec_id), e.vec_id)) AS kept
FROM embeddings e
"""

OP5_SQL = """
WITH scored AS (
  SELECT q.vec_id AS query_id, e.vec_id,
         list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS score
  FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""

OP7_SQL = r"""
WITH parts AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
judged AS (
  SELECT *, CASE
      WHEN ('.' || host) LIKE '%.www.example.com' AND starts_with(path, '/en/') THEN 'www.example.com/en/'
      WHEN ('.' || host) LIKE '%.example.com' AND starts_with(path, '/en/') THEN 'example.com/en/'
      WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/es/') THEN 'net/es/'
      WHEN ('.' || host) LIKE '%.net' AND starts_with(path, '/fr/') THEN 'net/fr/'
      WHEN ('.' || host) LIKE '%.com' AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

OP12_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS row_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT row_id, lang, source,
         translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT row_id) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
counts AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM words w JOIN kept k ON k.lang = w.lang AND k.term = w.term GROUP BY ALL),
totals AS (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source),
sources AS (SELECT DISTINCT lang, source FROM docs),
grid AS MATERIALIZED (
  SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n,
         CAST(1 + (CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2)) // CAST(coalesce(t.total, 0) + 2 * l.v AS HUGEINT) AS BIGINT) AS p,
         CAST(1 + (CAST(1000000000 AS HUGEINT) * (k.n + 2)) // CAST(l.total + 2 * l.v AS HUGEINT) AS BIGINT) AS q
  FROM sources s JOIN kept k ON k.lang = s.lang JOIN langs l ON l.lang = s.lang
  LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term
  LEFT JOIN totals t ON t.lang = s.lang AND t.source = s.source),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM grid a JOIN grid b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
told AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM sources a JOIN sources b ON b.lang = a.lang AND b.source <> a.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, CAST(((p - q) * (p - q)) // (p + q) AS BIGINT) FROM grid WHERE n > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM told)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""


def _op13_sql(rounds: int = 4) -> str:
    """A common table expression for the assignment and the new codebooks of each round."""
    ctes = [
        """vectors AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        "parts AS MATERIALIZED (SELECT vec_id, label, p, v[1 + p * (len(v) // 4) : (p + 1) * (len(v) // 4)] AS x FROM vectors, (SELECT unnest(range(4)) AS p))",
        "firsts AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT vec_id FROM vectors ORDER BY vec_id LIMIT 256))",
        "book0 AS MATERIALIZED (SELECT p, e, x AS c FROM parts JOIN firsts USING (vec_id))",
    ]
    for r in range(rounds + 1):
        ctes.append(f"""near{r} AS MATERIALIZED (
  SELECT vec_id, any_value(label) AS label, p, any_value(x) AS x, min(d * 256 + e) % 256 AS e, min(d * 256 + e) // 256 AS d
  FROM (SELECT vec_id, label, a.p, x, e, CAST(list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c) AS BIGINT) AS d
        FROM parts a JOIN book{r} b ON b.p = a.p) GROUP BY vec_id, p)""")
        if r < rounds:
            ctes.append(f"""book{r + 1} AS MATERIALIZED (
  SELECT b.p, b.e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN (
    SELECT p, e, list(mean ORDER BY i) AS c FROM (
      SELECT p, e, i, floor(sum(x[i]) / count(*)) AS mean FROM (SELECT p, e, x, unnest(range(1, len(x) + 1)) AS i FROM near{r}) GROUP BY p, e, i)
    GROUP BY p, e) m ON m.p = b.p AND m.e = b.e)""")
    return (
        "WITH " + ",\n".join(ctes) + f""",
coded AS (SELECT vec_id, any_value(label) AS label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{rounds} GROUP BY vec_id),
listed AS (SELECT string_agg(array_to_string(list_transform(c, lambda x: CAST(CAST(x AS BIGINT) AS VARCHAR)), ','), ',' ORDER BY p, e) AS s FROM book{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(s) FROM listed) AS codebooks_sha256 FROM coded
"""
    )


OP13_SQL = _op13_sql()


QUERIES = (op1_simhash, op2_warc, op3_near_vectors, op4_packing, op5_block_search, op6_pieces, op7_url_filter, op8_quality, op9_toxicity, op10_language, op11_byte_pieces, op12_divergence, op13_vector_codes)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (*QUERIES, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": OP2_SQL, "op3_near_vectors": OP3_SQL, "op5_block_search": OP5_SQL, "op7_url_filter": OP7_SQL, "op12_divergence": OP12_SQL, "op13_vector_codes": OP13_SQL}
