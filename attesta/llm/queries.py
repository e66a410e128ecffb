"""Thin queries over the driver's tables, one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from attesta.llm import bpe, caps, mixing, repair, repeats, secrets, simhash, token_counts, token_file, topk, toxicity, urls, whitening
from attesta.llm.common import new_path
from attesta.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


@query("op1_toxicity")
def toxicity_query(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.score(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op2_token_file")
def token_file_query(spark: SparkSession, folder: str) -> DataFrame:
    out = new_path(spark, "token-files")
    token_file.write_token_files(table(spark, folder, "documents"), out, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_file.checksums(token_file.read_token_files(spark, out))


@query("op3_simhash")
def simhash_query(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), shingle=3, radius=3)
    return found.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


@query("op4_topk", """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
         s AS (SELECT q.vec_id AS query_id, v.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.w, v.w), lambda p: p[1] * p[2])) AS BIGINT) AS score
               FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0),
         r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""")
def topk_query(spark: SparkSession, folder: str) -> DataFrame:
    return topk.search(table(spark, folder, "embeddings"), k=10, every=100, scale=1024)


@query("op5_url_filter", r"""
    WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
         p AS (SELECT page_id, regexp_extract(rest, '^([^/?#]*)', 1) AS h, regexp_extract(rest, '^([^?#]*)', 1) AS b FROM u),
         q AS (SELECT page_id, lower(h) AS host, substr(b, length(h) + 1) AS path FROM p),
         r(verdict, rule) AS (VALUES ('block', 'net/'), ('allow', 'example.net/en/'), ('block', 'example.com/de/'), ('allow', 'org/fr/')),
         f AS (SELECT page_id, host, path, rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, rule) AS n
               FROM q LEFT JOIN r ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
                                 AND starts_with(path, substr(rule, strpos(rule, '/'))))
    SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM f WHERE n = 1""")
def url_query(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"), urls.RULES, default="allow")


@query("op6_repeats")
def repeats_query(spark: SparkSession, folder: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, folder, "documents"), width=50)
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_mixing", """
    WITH RECURSIVE ids AS (SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY md5(CAST(doc_id AS VARCHAR))) - 1) // 8 AS block FROM documents),
    sizes AS (SELECT source, max(block) + 1 AS n FROM ids GROUP BY source),
    exact AS (SELECT source, n, pow(n, 0.7) / sum(pow(n, 0.7)) OVER () * 1000 AS x FROM sizes),
    floors AS (SELECT *, greatest(1, floor(x)) AS f FROM exact),
    share AS (SELECT source, n, CAST(f + CASE WHEN row_number() OVER (ORDER BY f - x, source) <= 1000 - sum(f) OVER () THEN 1 ELSE 0 END AS BIGINT) AS m FROM floors),
    lists AS (SELECT list(source ORDER BY source) AS names, list(m ORDER BY source) AS m FROM share),
    edf(slot, done, pick) AS (
        SELECT -1, list_transform(m, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM lists
        UNION ALL
        SELECT slot + 1, list_transform(done, lambda d, i: d + CASE WHEN i = p THEN 1 ELSE 0 END), p FROM (
            SELECT slot, done, list_position(keys, list_min(keys)) AS p FROM (
                SELECT slot, done, list_transform(done, lambda d, i: CASE WHEN d < m[i] AND d * 1000 // m[i] <= slot + 1 THEN (((d + 1) * 1000 + m[i] - 1) // m[i]) * 10000 + i END) AS keys
                FROM edf, lists WHERE slot < 999))),
    plan AS (SELECT names[pick] AS source, slot, row_number() OVER (PARTITION BY pick ORDER BY slot) - 1 AS k FROM edf, lists WHERE slot >= 0),
    ends AS (SELECT min((n // m) * 1000 + slot) AS horizon FROM share JOIN plan USING (source) WHERE k = n % m)
    SELECT ids.source, doc_id, block, CAST((block // m) * 1000 + slot AS BIGINT) AS slot, CAST(block * 1000 // m AS BIGINT) AS release,
           CAST(((block + 1) * 1000 + m - 1) // m AS BIGINT) AS deadline, (block // m) * 1000 + slot < horizon AS mixed
    FROM ids JOIN share USING (source) JOIN plan ON plan.source = ids.source AND plan.k = block % m, ends""")
def mixing_query(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.schedule(table(spark, folder, "documents")).withColumnRenamed("id", "doc_id")


@query("op8_caps", """
    WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v AS a JOIN v AS b ON a.label = b.label AND a.vec_id <> b.vec_id
              WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
    reach(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM reach AS r JOIN links AS l ON l.a = r.b)
    SELECT v.vec_id, (SELECT count(*) FROM links WHERE links.a = v.vec_id) AS n_links, min(reach.b) AS component_id, v.vec_id = min(reach.b) AS kept
    FROM v JOIN reach ON reach.a = v.vec_id GROUP BY v.vec_id""")
def caps_query(spark: SparkSession, folder: str) -> DataFrame:
    return caps.near_vectors(table(spark, folder, "embeddings"), least=0.98)


@query("op9_token_counts")
def token_count_query(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


@query("op10_bpe")
def bpe_query(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return digests(bpe.round_trip(table(spark, folder, "documents"), path, public_tokenizers.PATTERN))


@query("op11_whitening")
def whitening_query(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"), keep=16, scale=64, offset=1_000_000)


@query("op12_repair")
def repair_query(spark: SparkSession, folder: str) -> DataFrame:
    rows = repair.damaged(table(spark, folder, "conversations"))
    return repair.repaired_conversations(rows, repair.plan(rows))


@query("op13_secrets")
def secrets_query(spark: SparkSession, folder: str) -> DataFrame:
    found, hits = secrets.find_secrets(table(spark, folder, "documents")), F.col("hits")
    base = [r.kind for r in secrets.BASE]
    return found.select(
        "doc_id", *[secrets.count_of(hits, k).alias(f"n_{k}") for k in base],
        F.sha2(secrets.spans_of(hits, base), 256).alias("base_sha256"), secrets.spans_of(hits).alias("spans"))


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "n_tokens", F.sha2("ids_text", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
