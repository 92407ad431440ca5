"""The registered query of each corpus operator, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encoded
from .decontaminate import contamination
from .exponion import clustered
from .language import identified
from .main_text import extracted
from .passages import repeated_passages
from .quality_model import scored
from .quality_rules import COUNTS, judged
from .resample import resampled
from . import personal_data, token_store, url_rules
from .simhash import near_duplicates


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.found(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(_table(spark, sf_dir, "documents"))
    return found.withColumnsRenamed({"id": "doc_id", "first_id": "first_doc_id"})


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    store = token_store.write(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, vocabulary_size=49_408)
    return store.lookup(docs, "doc_id").select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_rules.rule_table(spark, [*url_rules.SITES, *url_rules.OTHERS])
    return url_rules.judged(_table(spark, sf_dir, "pages"), rules).withColumnRenamed("id", "page_id")


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.withColumnRenamed("id", "doc_id")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).withColumnRenamed("id", "doc_id")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identified(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encoded(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return found.withColumnRenamed("id", "doc_id")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judged(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), *COUNTS, "base_failed", "kept", "p_quality")


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampled(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), longest=1, buckets=10_000, seed="2024", least_words=20, percent=10)
    return found.withColumnRenamed("id", "doc_id")


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(_table(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clustered(_table(spark, sf_dir, "embeddings"), clusters=8, rounds=10, seed="3", dims=64)
    return found.withColumnRenamed("id", "vec_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_near_dedup, op2_personal_data, op3_repeated_passages, op4_token_store, op5_url_filter, op6_benchmark_decontamination, op7_quality_classifier, op8_byte_bpe, op9_language_id, op10_quality_rules, op11_importance_resampling, op12_html_extraction, op13_centroid_clustering)}


_WORDS6 = r"list_filter(string_split_regex(translate(coalesce({t}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

_OP6 = f"""
WITH i AS (SELECT item_id, {_WORDS6.format(t="text")} AS w FROM benchmark),
iw AS (SELECT item_id, least(13, len(w)) AS n, unnest(list_transform(generate_series(1, len(w) - least(13, len(w)) + 1), lambda k: array_to_string(w[k:k + least(13, len(w)) - 1], ' '))) AS win FROM i WHERE len(w) > 0),
d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS6.format(t="text")} AS w FROM documents),
places AS (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS k FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n),
hits AS (SELECT r, k, places.n, item_id FROM places JOIN iw ON places.n = iw.n AND array_to_string(w[k:k + places.n - 1], ' ') = win),
covered AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(generate_series(k, k + n - 1)) AS p FROM hits) GROUP BY r),
named AS (SELECT r, count(*) AS n_items, sha256(string_agg(i, ',' ORDER BY i)) AS items_sha256 FROM (SELECT DISTINCT r, CAST(item_id AS varchar) AS i FROM hits) GROUP BY r)
SELECT doc_id, CAST(len(w) AS bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (r) LEFT JOIN named USING (r)
"""


_OP5 = """
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path, row_number() OVER () AS r FROM pages),
s(rule, host, path, verdict) AS (VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'),
  ('net/de/', 'net', '/de/', 'allow'), ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')),
fit AS (SELECT r, arg_max(s.rule, length(s.rule)) AS rule, arg_max(s.verdict, length(s.rule)) AS verdict FROM p JOIN s
  ON (p.host = s.host OR ends_with(p.host, '.' || s.host)) AND starts_with(p.path, s.path) GROUP BY r)
SELECT page_id, p.host, p.path, fit.rule, coalesce(fit.verdict, CASE WHEN regexp_matches(p.host || '|', '(^|[.])(cheap-pills|spam-farm)[.]')
  OR regexp_matches(p.host || '|' || p.path, '(?i)(^|[^a-z0-9])(casino|viagra|torrent|xxx|porn)([^a-z0-9]|$)') THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN fit USING (r)
"""


def _crc_table() -> list[int]:
    """What each byte does to a CRC-32."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = c >> 1 ^ 0xEDB88320 * (c & 1)
        out.append(c)
    return out


_OP11 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS6.format(t="text")} AS w FROM documents),
b AS (SELECT {_WORDS6.format(t="text")} AS w FROM benchmark),
s_words AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM d) GROUP BY word),
t_words AS (SELECT word, count(*) AS n FROM (SELECT unnest(w) AS word FROM b) GROUP BY word),
hashed AS (SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(generate_series(1, octet_length(encode(word))), lambda k: ('0x' || substr(hex(word), 2 * k - 1, 2))::BIGINT)),
  lambda c, x: xor(c >> 8, crc[1 + (xor(c, x) & 255)])), 4294967295::BIGINT) % 10000 AS bucket
  FROM (SELECT word FROM s_words UNION SELECT word FROM t_words), (SELECT {_crc_table()}::BIGINT[] AS crc)),
s AS (SELECT bucket, sum(n)::DOUBLE AS n FROM s_words JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::DOUBLE AS n FROM t_words JOIN hashed USING (word) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM s) + 10000) / ((coalesce(s.n, 0) + 1) * ((SELECT coalesce(sum(n), 0) FROM t) + 10000)))) AS BIGINT) AS g FROM s FULL JOIN t USING (bucket)),
weights AS (SELECT r, CAST(floor(sum(g) / count(*)) AS BIGINT) AS weight FROM (SELECT r, unnest(w) AS word FROM d) JOIN hashed USING (word) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT doc_id, r, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM d LEFT JOIN weights USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features, r) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM ranked) * 10 // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
"""


def _op13() -> str:
    steps = [
        "kept AS (SELECT vec_id, row_number() OVER () AS r, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        "c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('3:' || vec_id), vec_id, v) - 1 AS INTEGER) AS cluster, v AS c FROM kept QUALIFY cluster < 8)",
    ]
    for k in range(11):
        nearest = "list_sum(list_transform(generate_series(1, 64), lambda i: (v[i] - c[i]) * (v[i] - c[i])))"
        steps.append(f"a{k} AS MATERIALIZED (SELECT r, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (SELECT r, cluster, {nearest} AS d FROM kept, c{k}) GROUP BY r)")
        if k < 10:
            means = f"SELECT cluster, list(m ORDER BY i) AS c FROM (SELECT cluster, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS m FROM kept JOIN a{k} USING (r), (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY cluster, i) GROUP BY cluster"
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT cluster, coalesce(n.c, o.c) AS c FROM c{k} o LEFT JOIN ({means}) n USING (cluster))")
    return "WITH " + ",\n".join(steps) + """
SELECT vec_id, cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM kept JOIN a10 USING (r) JOIN c10 USING (cluster)"""


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": _OP5, "op6_benchmark_decontamination": _OP6, "op11_importance_resampling": _OP11, "op13_centroid_clustering": _op13()}
