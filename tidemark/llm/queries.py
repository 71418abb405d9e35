"""The registered queries of this subpackage, each one operator over its whole table, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import ann, fingerprints, hard_negatives, mixing, near_dup, packing, pii, piece_codec, quality, sharding, token_counts, url_rules, whitening
from tidemark.llm.common import documents


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: The fixed rules that every URL is judged by first.
URL_RULES = (
    url_rules.host_path_rule("allow", "org"), url_rules.host_path_rule("block", "example.org", "/es/"), url_rules.host_path_rule("block", "example.org", "/en/1"),
    url_rules.host_path_rule("allow", "com", "/fr/"), url_rules.host_path_rule("block", "com", "/de/"),
)


def op1_spotsigs(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.compare_with_next(documents(spark, folder))


def op2_virtual_slots(spark: SparkSession, folder: str) -> DataFrame:
    dealt = sharding.shard_records(documents(spark, folder), shards=40)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot")


def op3_rule_ensemble(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = quality.fit(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    return quality.score_documents(docs, model).withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def op4_candidate_boosting(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    return pii.find_personal_data(docs, pii.fit(docs))


def op5_dimension_scan(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest_neighbours(spark.read.parquet(f"{folder}/embeddings.parquet"), lambda key: key % 50 == 0)


def op6_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return url_rules.judge_urls(spark.read.parquet(f"{folder}/pages.parquet"), URL_RULES + url_rules.OWN_RULES)


def op7_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    counted = token_counts.count_tokens(documents(spark, folder), _vocabulary("byte_bpe_50k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > 1024)


def op8_bottom_k(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, folder))


def op9_sum_of_squares(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack_documents(documents(spark, folder), _vocabulary("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op10_prefix_table(spark: SparkSession, folder: str) -> DataFrame:
    return piece_codec.round_trip(documents(spark, folder), _vocabulary("piece_bpe_32k.model"))


def op11_jacobi_whitening(spark: SparkSession, folder: str) -> DataFrame:
    white = whitening.whiten(spark.read.parquet(f"{folder}/embeddings.parquet"))
    return white.withColumn("deviation", F.col("deviation").try_cast("long"))  # null only where a long cannot hold it


def op12_spanning_tree(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.hard_negatives(spark.read.parquet(f"{folder}/embeddings.parquet"), lambda key: key % 100 == 0)


def op13_van_der_corput(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix_counts(documents(spark, folder))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_spotsigs, op2_virtual_slots, op3_rule_ensemble, op4_candidate_boosting, op5_dimension_scan, op6_url_rules, op7_token_counts, op8_bottom_k, op9_sum_of_squares,
        op10_prefix_table, op11_jacobi_whitening, op12_spanning_tree, op13_van_der_corput,
    )
}

_OWN = " OR ".join(f"regexp_matches(host || path, '{r.pattern}')".replace(r"\Z", "$") for r in url_rules.OWN_RULES)

SQL: dict[str, str] = {
    "op6_url_rules": rf"""
WITH rest AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
cut AS (SELECT page_id, lower(regexp_extract(r, '^[^/?#]*')) AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fixed(verdict, h, p) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
fit AS (
  SELECT page_id, arg_max(h || p, length(h || p)) AS rule, arg_max(verdict, length(h || p)) AS verdict
  FROM cut JOIN fixed ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(fit.verdict, CASE WHEN {_OWN} THEN 'block' ELSE 'allow' END) AS verdict
FROM cut LEFT JOIN fit USING (page_id)""",
    "op8_bottom_k": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w : w <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i : array_to_string(w[i:i + 4], ' '))) END AS s FROM words),
sizes AS (SELECT doc_id, len(s) AS n FROM sets),
spread AS (SELECT doc_id, md5_number(s) AS h FROM (SELECT doc_id, unnest(s) AS s FROM sets)),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM spread x JOIN spread y ON x.h = y.h AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * k >= 75 * (p.n + q.n - k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM sizes JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)""",
    "op12_spanning_tree": """
WITH rows AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x : floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x : x IS NOT NULL AND isfinite(x))) = len(embedding)),
scored AS (
  SELECT a.id AS anchor_id, r.id AS other, a.label = r.label AS same, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS score FROM rows a JOIN rows r ON a.id % 100 = 0 AND a.id <> r.id),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
mined AS (
  SELECT p.anchor_id, positive_id, other AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS rank
  FROM positives p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM mined WHERE rank <= 5""",
    "op13_van_der_corput": r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(concat_ws('/', '13', CAST(doc_id AS VARCHAR), text)) AS h FROM documents),
totals AS (
  SELECT source, sum(size) AS n, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM sized GROUP BY source),
tried AS (
  SELECT *, 3 * sum(n) OVER () AS shared, coalesce(sum(4 * n) OVER before, 0) AS used, sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS weights FROM totals
  WINDOW before AS (ORDER BY n * (10 // w), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
stopped AS (SELECT *, (shared - used) * w >= 4 * n * weights AS stops FROM tried),
targets AS (
  SELECT source, n, CASE WHEN stops THEN CAST(2 * n AS DOUBLE)
    ELSE CAST((shared - coalesce(sum(4 * n) FILTER (stops) OVER (), 0)) * w AS DOUBLE) / CAST(2 * sum(w) FILTER (NOT stops) OVER () AS DOUBLE) END AS target FROM stopped),
placed AS (
  SELECT doc_id, size, n, target, coalesce(sum(size) OVER (PARTITION BY sized.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(n AS BIGINT) AS source_size, target,
  CAST(CASE WHEN n = 0 THEN 0 ELSE size * (CAST(floor(target) AS HUGEINT) // n) + greatest(0, least(size, CAST(floor(target) AS HUGEINT) % n - start)) END AS BIGINT) AS taken
FROM placed""",
}
