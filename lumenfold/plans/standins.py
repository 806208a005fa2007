"""The candidate tables of the analyses, made from the driver's tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.config import MatchConfig
from lumenfold.functions.hierarchy import parent_or_null
from lumenfold.operators import vector
from lumenfold.plans.q_matching import vectors
from lumenfold.session import table

WIDE = MatchConfig(power=1.0, threshold=0.30)


def targets(spark, sf_dir) -> DataFrame:
    """Target dimension: even ids are parents (SR), odd ids enhancements (RE) of the id before; an SR names itself as its raw parent."""
    e = table(spark, sf_dir, "embeddings").where("vec_id < 100")
    return e.select(
        F.col("vec_id").alias("target_id"),
        F.when(F.col("vec_id") % 2 == 0, "SR").otherwise("RE").alias("target_type"),
        (F.col("vec_id") - F.col("vec_id") % 2).alias("raw_parent"),
        (F.col("vec_id") % 7 + 1).cast("int").alias("fr"),
    ).withColumn("parent_sr", parent_or_null(F.col("raw_parent"), F.col("target_id"))).drop("raw_parent")


def rules(spark, sf_dir) -> DataFrame:
    return vectors(spark, sf_dir)[0].select("source", "source_id")


def with_unmatched(rules: DataFrame) -> DataFrame:
    """The rules and as many without candidates, under negative ids."""
    return rules.unionAll(rules.select("source", -F.col("source_id")))


def candidates(spark, sf_dir, cfg: MatchConfig = WIDE) -> DataFrame:
    """Matches joined to both dimensions: source, source_id, rank, target_id, its attributes, scores and a verdict."""
    s, t = vectors(spark, sf_dir)
    found = vector.match(s, t, cfg).drop("target_ord")
    verdict = F.pmod(F.col("source_id") * 7 + F.col("target_id") * 3, F.lit(10))
    out = found.join(s.select("source_id", "source"), "source_id").join(targets(spark, sf_dir), "target_id")
    return out.withColumn("verdict", F.when(verdict == 0, "YES").when(verdict <= 2, "MAYBE").otherwise("NO"))


#: with_unmatched in DuckDB.
UNMATCHED = "(SELECT source, source_id FROM rules UNION ALL SELECT source, -source_id FROM rules)"
#: WITH clauses that give the same tables in DuckDB: rules, targets, cand.
CTE = """WITH rules AS (SELECT CASE WHEN label % 2 = 0 THEN 'even' ELSE 'odd' END source, vec_id source_id FROM embeddings WHERE vec_id >= 100),
targets AS (SELECT vec_id target_id, CASE WHEN vec_id % 2 = 0 THEN 'SR' ELSE 'RE' END target_type, (vec_id % 7 + 1)::INT fr,
            CASE WHEN vec_id % 2 = 0 THEN NULL ELSE vec_id - 1 END parent_sr FROM embeddings WHERE vec_id < 100),
pairs AS (SELECT s.vec_id source_id, t.vec_id target_id, list_dot_product(s.embedding::DOUBLE[], t.embedding::DOUBLE[]) raw_cosine
          FROM embeddings s, embeddings t WHERE s.vec_id >= 100 AND t.vec_id < 100),
relative AS (SELECT *, CASE WHEN max(greatest(raw_cosine, 0)) OVER (PARTITION BY source_id) > 0 THEN greatest(raw_cosine, 0) / max(greatest(raw_cosine, 0)) OVER (PARTITION BY source_id) ELSE 0 END relative_score FROM pairs),
kept AS (SELECT *, CAST(row_number() OVER (PARTITION BY source_id ORDER BY relative_score DESC, target_id) AS INT) AS rank FROM relative WHERE relative_score >= 0.3 AND relative_score > 0),
cand AS (SELECT r.source, k.source_id, k.rank, k.target_id, t.target_type, t.fr, t.parent_sr, k.raw_cosine, k.relative_score,
         CASE (k.source_id * 7 + k.target_id * 3) % 10 WHEN 0 THEN 'YES' WHEN 1 THEN 'MAYBE' WHEN 2 THEN 'MAYBE' ELSE 'NO' END verdict
         FROM kept k JOIN rules r USING (source_id) JOIN targets t USING (target_id) WHERE k.rank <= 10)
"""
