"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, exactdedup, flac, hardneg, licenses, lmscore, mixing, pii, recompression, simhash, toxicity, whitening
from .common import read_table

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    """Where the public vocabulary files lie on this machine."""
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's exact unigram base score and its score under the Bloom-filter model."""
    return lmscore.score_texts(read_table(spark, sf_dir, "documents"))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's FLAC stream, written to the shared folder, read back and described by what is decoded from it."""
    return flac.features(flac.written(read_table(spark, sf_dir, "documents")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's license notices: how many blocks were looked at, which licenses were found, where, and how their wording differs."""
    found = licenses.scan(read_table(spark, sf_dir, "documents"))
    names = F.array_join(F.array_sort(F.array_distinct(F.col("findings.license"))), ",")
    spans = F.array_join(F.transform("findings", lambda f: F.concat_ws("-", f["start"].cast("string"), f["stop"].cast("string"))), ",")
    differences = F.array_join(F.flatten("findings.differences"), " ")
    return found.select("doc_id", "candidates", F.size("findings").cast("long").alias("n_notices"), names.alias("licenses"), spans.alias("spans"), differences.alias("differences"))


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and near-duplicate class."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity score and prediction."""
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with surrogates for its personal data, and how many mentions of which kinds were replaced."""
    out = pii.replace(read_table(spark, sf_dir, "documents"))
    kinds = F.array_join(F.array_sort(F.array_distinct(F.transform("entities", lambda e: F.substring_index(e["kind"], ":", 1)))), ",")
    return out.select(F.col("row.doc_id").cast("long").alias("doc_id"), "text", F.size("entities").cast("long").alias("n_entities"), kinds.alias("kinds"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that an earlier document has too."""
    return recompression.digests(recompression.remove_repeats(read_table(spark, sf_dir, "documents")))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents and epochs that the default plan's token budget takes."""
    taken = mixing.mixed(read_table(spark, sf_dir, "documents"))
    return taken.select(F.col("row.doc_id").cast("long").alias("doc_id"), "domain", "lang", "source", "epoch", "n_tokens", "take_tokens", "leaf_tokens")


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest found of every hundredth vector."""
    return ann.nearest(read_table(spark, sf_dir, "embeddings"))


def op10_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and the text decoded from them, as digests."""
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of every fiftieth vector; the labels of every seventh are moved by one first."""
    moved = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label").cast("long") + 1, F.lit(10))).otherwise(F.col("label"))
    return hardneg.mine(read_table(spark, sf_dir, "embeddings").withColumn("label", moved))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's group of equal texts and the row of it that stays."""
    return exactdedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first sixteen whitened components of every vector."""
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_lm_scoring, op2_media_columns, op3_license_scan, op4_simhash_near_dedup, op5_toxicity, op6_pii_surrogates, op7_substring_dedup, op8_mixing, op9_nearest_neighbours, op10_bpe_encode_decode, op11_hard_negatives, op12_exact_dedup, op13_embedding_whitening)}
ORACLE: dict[str, str] = {
    "op11_hard_negatives": r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_sum([z[1] * z[2] FOR z IN list_zip(a.q, c.q)]) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INT) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""",
    "op12_exact_dedup": r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS own FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, CAST(count(*) OVER (PARTITION BY own) AS BIGINT) AS group_size, row_number() OVER w = 1 AS kept, sha256(own) AS text_sha256
FROM d WINDOW w AS (PARTITION BY own ORDER BY points DESC, doc_id NULLS LAST)""",
    "op7_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS s FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT s, min(doc_id) AS m FROM k GROUP BY s),
c AS (SELECT DISTINCT k.doc_id, k.i + r.j AS p FROM k JOIN f USING (s) CROSS JOIN (SELECT unnest(generate_series(0, 12)) AS j) r WHERE f.m < k.doc_id),
t AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS p FROM d),
g AS (SELECT t.doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY p) AS kept FROM t ANTI JOIN c USING (doc_id, p) GROUP BY t.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)""",
    "op8_mixing": r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
o AS (SELECT *, 'domain' || (coalesce(TRY_CAST(regexp_extract(source, '([0-9]{1,6})$', 1) AS INT), 0) % 4) AS domain FROM d),
s AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS BIGINT) AS tokens, CAST(sum(n_tokens) * 2 AS BIGINT) AS cap FROM o GROUP BY ALL),
a1 AS (SELECT domain, CAST(sum(cap) AS BIGINT) AS cap, CAST(sum(sum(tokens)) OVER () AS BIGINT) * 9 // 10 AS budget,
  CAST(CASE domain WHEN 'domain0' THEN 4 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END AS BIGINT) AS w FROM s GROUP BY domain),
a2 AS (SELECT *, cap * sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= (budget - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS sat FROM a1),
a3 AS (SELECT *, CAST(budget - coalesce(sum(cap) FILTER (sat) OVER (), 0) AS BIGINT) AS rest, CAST(sum(w) FILTER (NOT sat) OVER () AS BIGINT) AS ow, row_number() OVER (PARTITION BY sat ORDER BY domain) AS rn FROM a2),
a AS (SELECT domain, CASE WHEN sat THEN cap ELSE rest * w // ow + CASE WHEN rn <= rest - sum(rest * w // ow) FILTER (NOT sat) OVER () THEN 1 ELSE 0 END END AS budget FROM a3),
b1 AS (SELECT domain, lang, budget, CAST(sum(cap) AS BIGINT) AS cap, CAST(CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS BIGINT) AS w
  FROM s JOIN a USING (domain) GROUP BY domain, lang, budget),
b2 AS (SELECT *, cap * sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= (budget - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS sat FROM b1),
b3 AS (SELECT *, CAST(budget - coalesce(sum(cap) FILTER (sat) OVER (PARTITION BY domain), 0) AS BIGINT) AS rest, CAST(sum(w) FILTER (NOT sat) OVER (PARTITION BY domain) AS BIGINT) AS ow, row_number() OVER (PARTITION BY domain, sat ORDER BY lang) AS rn FROM b2),
b AS (SELECT domain, lang, CASE WHEN sat THEN cap ELSE rest * w // ow + CASE WHEN rn <= rest - sum(rest * w // ow) FILTER (NOT sat) OVER (PARTITION BY domain) THEN 1 ELSE 0 END END AS budget FROM b3),
c1 AS (SELECT s.*, budget, CAST(1 AS BIGINT) AS w FROM s JOIN b USING (domain, lang)),
c2 AS (SELECT *, cap * sum(w) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= (budget - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * w AS sat FROM c1),
c3 AS (SELECT *, CAST(budget - coalesce(sum(cap) FILTER (sat) OVER (PARTITION BY domain, lang), 0) AS BIGINT) AS rest, CAST(sum(w) FILTER (NOT sat) OVER (PARTITION BY domain, lang) AS BIGINT) AS ow, row_number() OVER (PARTITION BY domain, lang, sat ORDER BY source) AS rn FROM c2),
c AS (SELECT domain, lang, source, tokens, CAST(CASE WHEN sat THEN cap ELSE rest * w // ow + CASE WHEN rn <= rest - sum(rest * w // ow) FILTER (NOT sat) OVER (PARTITION BY domain, lang) THEN 1 ELSE 0 END END AS BIGINT) AS own FROM c3),
e AS (SELECT o.*, c.tokens, c.own, r.epoch, least(own - (r.epoch - 1) * tokens, tokens) AS need FROM o JOIN c USING (domain, lang, source) CROSS JOIN (SELECT unnest([1, 2]) AS epoch) r WHERE tokens > 0 AND own > (r.epoch - 1) * tokens),
k AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('17|' || epoch || '|' || coalesce(CAST(doc_id AS VARCHAR), '')), n_tokens ROWS UNBOUNDED PRECEDING) - n_tokens AS start FROM e)
SELECT doc_id, domain, lang, source, CAST(epoch AS INT) AS epoch, n_tokens, CAST(CASE WHEN need = tokens THEN n_tokens ELSE least(n_tokens, need - start) END AS BIGINT) AS take_tokens, CAST(own AS BIGINT) AS leaf_tokens
FROM k WHERE need = tokens OR start < need""",
}
