"""The queries of this subpackage: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import media, mixing, neardup, neighbours, packing, pii, quality, token_files, tokens, toxicity
from tessera.llm.common import read_table, stage


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return pii.find_pii(docs, pii.train(docs))


def op2_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.quality_scores(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = stage(media.text_images(read_table(spark, sf_dir, "documents")), "images")
    return media.media_digest(images)


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read_table(spark, sf_dir, "documents"), _tokenizer("word_bpe_49k.json"))


def op7_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return neighbours.search(vectors, vectors.filter("vec_id % 20 = 0"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.toxicity_scores(docs, toxicity.train(docs, read_table(spark, sf_dir, "labels")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = mixing.mixing_report(read_table(spark, sf_dir, "documents"))
    return report.select("doc_id", "size", "source_size", "target", "taken")


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = token_files.write_token_files(read_table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"))
    return token_files.read_token_files(files).drop("ids")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_skip_chain_pii": op1_skip_chain_pii,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_quality_classifier": op3_quality_classifier,
    "op4_media_columns": op4_media_columns,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_token_counts": op6_token_counts,
    "op7_collision_counting": op7_collision_counting,
    "op8_toxicity": op8_toxicity,
    "op9_mixing": op9_mixing,
    "op10_token_files": op10_token_files,
}

#: The mix: sizes by regular expression, targets by filling to a common level, draws by the digest of seed and id.
MIXING_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS k
  FROM documents),
by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w
  FROM sized GROUP BY source),
running AS (
  SELECT *, source_size * 2.0::DOUBLE AS most,
         row_number() OVER o AS pos,
         (sum(CAST(source_size AS DOUBLE)) OVER () * 1.5::DOUBLE
          - coalesce(sum(source_size * 2.0::DOUBLE) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM by_source WINDOW o AS (ORDER BY source_size * 2.0::DOUBLE / w, source NULLS LAST)),
first_free AS (SELECT min(pos) AS f FROM running WHERE most >= level * w),
plan AS (
  SELECT r.source, r.source_size,
         CASE WHEN f IS NULL OR r.pos < f THEN r.most ELSE least(x.level * r.w, r.most) END AS target
  FROM running r CROSS JOIN first_free LEFT JOIN running x ON x.pos = f),
drawn AS (
  SELECT s.doc_id, CAST(s.size AS BIGINT) AS size, p.source_size, p.target,
         CASE WHEN p.source_size > 0 THEN p.target / p.source_size ELSE 0 END AS rate,
         CAST(CAST('0x' || substr(md5('mix:' || s.k), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn
"""

def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES["pipeline"] = pipeline

ORACLE_SQL: dict[str, str] = {"op9_mixing": MIXING_SQL}
