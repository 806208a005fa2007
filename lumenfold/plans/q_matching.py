"""Matching queries over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.config import MatchConfig
from lumenfold.operators import vector
from lumenfold.session import table


def vectors(spark, sf_dir):
    """Sources are the rows from vec_id 100 on, targets those below it, in the order of vec_id."""
    e = table(spark, sf_dir, "embeddings")
    sources = e.where("vec_id >= 100").select(F.col("vec_id").alias("source_id"), F.col("embedding").alias("vector"), F.when(F.col("label") % 2 == 0, "even").otherwise("odd").alias("source"))
    targets = e.where("vec_id < 100").select(F.col("vec_id").alias("target_id"), F.col("vec_id").alias("target_ord"), F.col("embedding").alias("vector"))
    return sources, targets


def match_topk(spark, sf_dir, cfg=MatchConfig(), engine="arrow"):
    s, t = vectors(spark, sf_dir)
    return vector.match(s, t, cfg, engine).select("source_id", "target_id", "rank", F.round("raw_cosine", 6).alias("raw_cosine"), F.round("relative_score", 6).alias("relative_score"))


def match_sql(power=5.5, threshold=0.68, k=10):
    return f"""
WITH p AS (SELECT s.vec_id source_id, t.vec_id target_id, list_dot_product(s.embedding::DOUBLE[], t.embedding::DOUBLE[]) c
           FROM embeddings s, embeddings t WHERE s.vec_id >= 100 AND t.vec_id < 100),
r AS (SELECT *, pow(greatest(c, 0), {power}) sh, max(pow(greatest(c, 0), {power})) OVER (PARTITION BY source_id) mx FROM p),
f AS (SELECT source_id, target_id, c, CASE WHEN mx > 0 THEN sh / mx ELSE 0 END rel FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY rel DESC, target_id) rank FROM f WHERE rel >= {threshold} AND rel > 0)
SELECT source_id, target_id, CAST(rank AS INT) rank, round(c, 6) raw_cosine, round(rel, 6) relative_score FROM k WHERE rank <= {k}"""


WIDE = MatchConfig(power=1.0, threshold=0.30)

QUERIES = {
    "match_topk": match_topk,
    "match_topk_wide": lambda spark, d: match_topk(spark, d, WIDE),
    "match_topk_sql": lambda spark, d: match_topk(spark, d, engine="sql"),
}
ORACLE_SQL = {"match_topk": match_sql(), "match_topk_wide": match_sql(1.0, 0.30), "match_topk_sql": match_sql()}
