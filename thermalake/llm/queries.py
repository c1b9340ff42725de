"""The queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermalake.llm import ann, brownlm, embdedup, langid, linededup, mining, mixing, nbsvm, packing, pii, simhash, suffixes, whitening
from thermalake.llm.common import documents, embeddings, fold_of


def op1_pii_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_personal_data(documents(spark, sf_dir)))


def op2_line_dedup_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_repeated_lines(documents(spark, sf_dir), min_chars=40, min_docs=5)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, l,
         translate(trim(l, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(s) AS l, generate_subscripts(s, 1) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents))),
common AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines,
       count(*) FILTER (WHERE keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE keeper IS NULL OR keeper = doc_id), ''))
         AS kept_sha256
FROM lines LEFT JOIN common USING (k) GROUP BY doc_id
"""


def op3_packing_sum_of_squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digest(packing.pack_documents(documents(spark, sf_dir), size=2048, end_id=1))


def op4_simhash_pivot_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(simhash.near_duplicates(documents(spark, sf_dir), shingle=3, max_bits=2))


def op5_mixing_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.mix_sources(documents(spark, sf_dir), weights=(5.0, 2.0, 1.0), share=1.5, most=2.0)
    return mix.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_embedding_dedup_int8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embdedup.near_duplicates(embeddings(spark, sf_dir), threshold=0.93)


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b
    ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_inner_product(a.e, b.e) / (sqrt(list_inner_product(a.e, a.e)) * sqrt(list_inner_product(b.e, b.e))) >= 0.93),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
low AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
n AS (SELECT x, count(*) AS n_links FROM links GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings e JOIN low ON e.vec_id = low.x LEFT JOIN n ON e.vec_id = n.x
"""


def op7_ann_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(embeddings(spark, sf_dir), F.col("vec_id") % 20 == 0, k=20)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([x FOR x IN embedding IF x <> 0]) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op8_langid_word_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = fold_of("doc_id", 4) == 2
    model = langid.learn(docs.filter(~held_out).select("doc_id", "text", "lang"))
    return langid.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op9_lm_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brownlm.held_out_scores(documents(spark, sf_dir), folds=5, held_out=1)


def op10_quality_nbsvm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = fold_of("doc_id", 3) == 1
    model = nbsvm.learn(docs, labels.filter(~held_out))
    return nbsvm.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.drop_repeated_passages(documents(spark, sf_dir)))


def op12_hard_negatives_distance_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mining.hard_negatives(embeddings(spark, sf_dir), F.col("vec_id") % 50 == 0, positives=5, negatives=3, least=50, most=95)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * x::DOUBLE) FOR x IN embedding] AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.e, c.e)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
n AS (SELECT p.anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)::INTEGER AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3
"""


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(embeddings(spark, sf_dir), scale=64, most=16)


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_pii_anchor_expansion,
            op2_line_dedup_bitmaps,
            op3_packing_sum_of_squares,
            op4_simhash_pivot_tables,
            op5_mixing_cube,
            op6_embedding_dedup_int8,
            op7_ann_block_join,
            op8_langid_word_backoff,
            op9_lm_brown_classes,
            op10_quality_nbsvm,
            op11_suffix_array_dedup,
            op12_hard_negatives_distance_keys,
            op13_embedding_whitening,
        )
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_line_dedup_bitmaps": OP2_SQL,
        "op6_embedding_dedup_int8": OP6_SQL,
        "op7_ann_block_join": OP7_SQL,
        "op12_hard_negatives_distance_keys": OP12_SQL,
    }
