"""The operators over the driver's tables, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe_codec, embedding_pq, exact_dedup, filter_audit, hard_negatives, language_id, minhash_forest, mixture, packing, personal_data, suffix_merge, token_ledger, toxicity
from quarry.scratch import joined, read_table, staged


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_merge.remove_repeats(read_table(spark, sf_dir, "documents"))


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.find(read_table(spark, sf_dir, "documents")).drop("span_list")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_pq.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_forest.near_duplicates(read_table(spark, sf_dir, "documents"))


def op6_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of ``documents`` after three batches: all of them come in; those labelled toxic are taken out; those
    labelled of low quality, and not toxic, are revised to their text in lower case."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    labels = read_table(spark, sf_dir, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    labels = staged(labels.where("toxic = 1 or quality = 0"), "ledger-labels")
    ledger = token_ledger.TokenLedger(spark)
    ledger.commit("documents", token_ledger.signed(inserts=docs))
    marked = staged(joined(docs, labels, ["doc_id"], "inner", token_ledger.MOST_SENT), "ledger-marked")
    ledger.commit("toxic", token_ledger.signed(deletes=marked.where("toxic = 1")))
    old = marked.where("coalesce(toxic, 0) <> 1")
    ledger.commit("low-quality", token_ledger.signed(revisions=(old, old.withColumn("text", F.lower("text")))))
    ledger.fold()
    return ledger.totals()


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(read_table(spark, sf_dir, "documents")).drop("locator")


def op8_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture.report(read_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(read_table(spark, sf_dir, "documents"))


def op11_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe_codec.round_trip(read_table(spark, sf_dir, "documents"))
    return rows.selectExpr("doc_id", "n_tokens", "sha2(ids, 256) as ids_sha256", "sha2(decoded, 256) as decoded_sha256")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(hard_negatives.rotated(read_table(spark, sf_dir, "embeddings")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_personal_data, op3_embedding_dedup, op4_toxicity, op5_minhash_forest, op6_token_rollup, op7_exact_dedup, op8_mixture, op9_packing, op10_language_id, op11_bpe_codec, op12_filter_audit, op13_hard_negatives, pipeline)
}

ORACLE_SQL: dict[str, str] = {
    "op7_exact_dedup": """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS body FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY body) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY body) AS kept, sha256(body) AS text_sha256
FROM n
""",
    "op8_mixture": r"""
WITH s AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, sha256(coalesce(text, '')) AS digest,
           row_number() OVER (PARTITION BY doc_id, source, coalesce(text, '')) - 1 AS number FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM s GROUP BY source),
w AS (SELECT source, source_size, CAST(CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM t),
f AS (SELECT *, 2.0::DOUBLE * source_size AS most, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS total, sum(weight) OVER () AS weights FROM w),
g AS (SELECT *, row_number() OVER (ORDER BY most / weight, source NULLS LAST) AS rank,
             sum(most) OVER (ORDER BY most / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - most AS most_before,
             sum(weight) OVER (ORDER BY most / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING) - weight AS weight_before FROM f),
o AS (SELECT *, (total - most_before) / (weights - weight_before) AS own FROM g),
l AS (SELECT own FROM o WHERE own * weight <= most ORDER BY rank LIMIT 1),
r AS (SELECT source, source_size, least(most, coalesce((SELECT own FROM l) * weight, most)) AS target FROM o),
c AS (SELECT s.doc_id, s.size, s.digest, s.number, r.source_size, r.target, CASE WHEN r.source_size > 0 THEN r.target / r.source_size ELSE 0 END AS rate
      FROM s JOIN r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       size * (CAST(floor(rate) AS BIGINT) + CASE WHEN CAST(('0x' || substr(sha256(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), digest, number, 'mix-1')), 1, 13))::BIGINT AS DOUBLE) / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM c
""",
    "op12_filter_audit": r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
k AS (SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, FALSE) AS good, coalesce(toxic, FALSE) AS toxic, len(words) < 200 AS a, 100 * len(list_distinct(words)) < 50 * len(words) AS b,
             100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) AS c, regexp_matches(body, '[#$%&*|]') AS d, coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY body), FALSE) AS e
      FROM d LEFT JOIN k ON d.doc_id = k.doc_id),
g AS (SELECT part, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic, a, b, c, d, e FROM f GROUP BY part, a, b, c, d, e),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order FROM l p, l q, l r, l s, l t WHERE len(list_distinct([p.x, q.x, r.x, s.x, t.x])) = 5),
m AS (SELECT part, n, good, toxic, concat(CASE WHEN a THEN 'A' ELSE '' END, CASE WHEN b THEN 'B' ELSE '' END, CASE WHEN c THEN 'C' ELSE '' END, CASE WHEN d THEN 'D' ELSE '' END, CASE WHEN e THEN 'E' ELSE '' END) AS failing FROM g),
z AS (SELECT part, n, good, toxic, failing, filter_order, step, substr(filter_order, CAST(step AS INT), 1) AS filter,
             len(translate(substr(filter_order, 1, CAST(step AS INT) - 1), failing, '')) = step - 1 AS arrives FROM m, o, generate_series(1, 5) AS w(step)),
y AS (SELECT part, filter_order, step, filter, CAST(coalesce(sum(n) FILTER (arrives AND NOT contains(failing, filter)), 0) AS BIGINT) AS kept,
             CAST(coalesce(sum(n) FILTER (arrives AND contains(failing, filter)), 0) AS BIGINT) AS removed,
             CAST(coalesce(sum(n) FILTER (NOT arrives AND contains(failing, filter)), 0) AS BIGINT) AS redundant,
             CAST(coalesce(sum(n) FILTER (failing = filter), 0) AS BIGINT) AS unique_fails,
             CAST(coalesce(sum(good) FILTER (arrives AND contains(failing, filter)), 0) AS BIGINT) AS good_lost,
             CAST(coalesce(sum(toxic) FILTER (arrives AND contains(failing, filter)), 0) AS BIGINT) AS toxic_lost FROM z GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, CAST(step AS INT) AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM y
""",
    "op13_hard_negatives": """
WITH v AS (SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS alike, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INT) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT alike AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) QUALIFY row_number() OVER w <= 5
""",
}
