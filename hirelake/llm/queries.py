"""The registered queries of the training-data operators, with DuckDB SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, fingerprints, html, language, maxent, quality, resampling, sentencepieces, sharding, simhash, vectors, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op1_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"), k=4, radius=4)
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


@query
def op7_embedding_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.embedding_components(table(spark, sf_dir, "embeddings"), threshold=0.95)


SHARD_NAMES = [f"shard-{i:03d}" for i in range(sharding.SHARDS)]


@query
def op3_shard_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    return sharding.place(docs, ["doc_id"], SHARD_NAMES).select("doc_id", "slot", "shard")


def _op3_sql() -> str:
    owners = ",".join(map(str, sharding.lookup_table(SHARD_NAMES)))
    return f"""
        WITH hashed AS (
            SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '\\N')), 1, {sharding.HEX_DIGITS}) AS BIGINT) % {sharding.TABLE_PRIME} AS slot
            FROM documents),
        owners AS (
            SELECT CAST(unnest(range({sharding.TABLE_PRIME})) AS BIGINT) AS slot, CAST(unnest(string_split('{owners}', ',')) AS INTEGER) AS shard)
        SELECT doc_id, slot, shard FROM hashed JOIN owners USING (slot)"""


ORACLE["op3_shard_placement"] = _op3_sql()


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def tokens(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    done = sentencepieces.encode_decode(docs.select("doc_id", "text"), model_path)
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return done.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), *(["ids"] if with_ids else []))


@query
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = warc.round_trip(table(spark, sf_dir, "pages"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE["op8_warc"] = """
    WITH p AS (
        SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
    first AS (SELECT digest, min(page_id) AS least FROM p WHERE n >= 100 GROUP BY digest)
    SELECT page_id, n AS payload_bytes, digest AS payload_digest,
        CASE WHEN n >= 100 AND page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
        CASE WHEN n >= 100 AND page_id > least THEN least END AS refers_to
    FROM p LEFT JOIN first USING (digest)"""


@query
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(table(spark, sf_dir, "pages"))


@query
def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent.score_documents(table(spark, sf_dir, "documents"))


@query
def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=25, least_words=20, longest=2, buckets=10_000, seed=7)
    return found.select("doc_id", "n_features", "weight", "score", "rank")


ORACLE["op11_resampling"] = r"""
    WITH crc AS MATERIALIZED (
        SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) r(b)),
    texts AS (
        SELECT 0 AS kind, row_number() OVER () AS row, text, doc_id FROM documents UNION ALL SELECT 1, row_number() OVER (), text, NULL FROM benchmark),
    worded AS MATERIALIZED (
        SELECT kind, row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
        FROM texts),
    features AS (
        SELECT kind, row, unnest(w) AS f FROM worded
        UNION ALL
        SELECT kind, row, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM worded WHERE len(w) > 1),
    counted AS MATERIALIZED (SELECT kind, row, f, count(*) AS n FROM features GROUP BY ALL),
    coded AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM counted)),
    hashed AS MATERIALIZED (
        SELECT f, xor(list_reduce(list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS INT), 2) AS BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
        FROM coded, crc),
    buckets AS (
        SELECT r.b AS bucket, coalesce(sum(n) FILTER (kind = 0), 0) AS s, coalesce(sum(n) FILTER (kind = 1), 0) AS t
        FROM range(10000) r(b) LEFT JOIN (SELECT kind, n, bucket FROM counted JOIN hashed USING (f)) ON bucket = r.b GROUP BY r.b),
    gained AS (
        SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (CAST(sum(s) OVER () AS DOUBLE) + 10000) / ((CAST(s AS DOUBLE) + 1) * (CAST(sum(t) OVER () AS DOUBLE) + 10000)))) AS BIGINT) AS gain
        FROM buckets),
    weighed AS (
        SELECT row, CAST(floor(sum(n * gain) / sum(n)) AS BIGINT) AS weight, CAST(sum(n) AS BIGINT) AS n_features
        FROM counted JOIN hashed USING (f) JOIN gained USING (bucket) WHERE kind = 0 GROUP BY row),
    scored AS (
        SELECT doc_id, len(w) >= 20 AS fit, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
            coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '\N')), 1, 8) AS BIGINT) + 0.5) / 4294967296))) AS BIGINT) AS score
        FROM worded LEFT JOIN weighed USING (row) WHERE kind = 0),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY fit ORDER BY score DESC, doc_id, n_features DESC) AS place, count(*) FILTER (fit) OVER () AS n FROM scored)
    SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= 25 * n // 100 THEN place END AS rank FROM ranked"""


@query
def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_by_next(table(spark, sf_dir, "documents"))


@query
def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), least_docs=30, top=50)


ORACLE["op13_source_divergence"] = r"""
    WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    t AS (
        SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS MATERIALIZED (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 30),
    counts AS MATERIALIZED (SELECT t.lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
    langs AS (SELECT lang, sum(n) + 5 * count(*) AS size FROM kept GROUP BY lang),
    groups AS (
        SELECT g.lang, g.source, coalesce(n, 0) + 5 * v AS size FROM (SELECT DISTINCT lang, source FROM d) g
        JOIN (SELECT lang, count(term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN kept USING (lang) GROUP BY lang) USING (lang)
        LEFT JOIN (SELECT lang, source, sum(n) AS n FROM counts GROUP BY ALL) c ON c.lang = g.lang AND c.source = g.source),
    shares AS MATERIALIZED (
        SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 5) // size AS p
        FROM groups g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    pairs AS (
        SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v, 0) AS value
        FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
        LEFT JOIN (SELECT x.lang, x.source AS s, y.source AS o, sum(abs(x.p - y.p)) AS v FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) z
            ON z.lang = a.lang AND s = a.source AND o = b.source),
    terms AS (
        SELECT s.lang, source, 'term' AS part, term AS item, p - (1 + CAST(1000000000 AS HUGEINT) * (k.n + 5) // size) AS value
        FROM shares s JOIN kept k USING (lang, term) JOIN langs USING (lang) WHERE s.n > 0),
    ranked AS (
        SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
        FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms WHERE value > 0))
    SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= 50"""
