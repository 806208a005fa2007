"""Requirement extraction queries over stand-ins made from part and benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import requirements as R
from lumenfold.operators import vector
from lumenfold.plans.q_distribution import rounded
from lumenfold.plans.q_matching import vectors
from lumenfold.session import table


def raw(spark, sf_dir):
    """Extracted records: ids in loose spelling, some broken, some texts empty."""
    k = F.col("p_partkey")
    key = F.when(k % 10 == 0, "XR 1").when(k % 2 == 0, F.concat(F.lit("sr "), k % 7 + 1, F.lit("."), k % 13)).otherwise(F.concat(F.lit("SR"), k % 7 + 1, F.lit("."), k % 13, F.lit(" re"), k % 4 + 1))
    text = F.when(k % 11 == 0, "void").otherwise(F.concat("p_name", F.lit("  Void "), "p_brand"))
    return table(spark, sf_dir, "part").select(key.alias("id"), text.alias("text"), F.lit("SR").alias("type"), (k % 50).alias("block_id"), k.alias("k"))


def blocks(spark, sf_dir):
    r = raw(spark, sf_dir)
    g = r.groupBy("block_id").agg(F.array_sort(F.collect_list(F.struct("k", "id", "text"))).alias("requirements"))
    return R.collect_candidates(g).groupBy("block_id").agg(F.count("*").alias("records"), F.max("place").alias("last"), F.sum("k").alias("k"))


def sanitized(spark, sf_dir):
    return R.sanitize(raw(spark, sf_dir)).select("k", "id", "text", "type", "fr", "parent_sr")


def problems(spark, sf_dir):
    r = R.sanitize(raw(spark, sf_dir)).where("k % 13 <> 0").withColumn("type", F.when(F.col("k") % 17 == 0, "RE").otherwise(F.col("type")))
    return R.dataset_problems(r).groupBy("problem").agg(F.count("*").alias("n"))


def rationale_rows(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark")
    whole = b.select((F.col("item_id") % 20).alias("id"), "text", F.col("item_id").alias("block_id"), F.array((F.col("item_id") % 3).cast("int"), (F.col("item_id") % 5).cast("int")).alias("source_pages"), (F.col("item_id") % 4 / 4).alias("confidence"))
    return whole.unionByName(whole.where("id < 10").withColumn("text", F.left("text", F.lit(30))).withColumn("block_id", F.col("block_id") + 1000))


def valid_rationales(spark, sf_dir):
    known = spark.range(3, 16).select("id")
    out = R.validate_rationales(rationale_rows(spark, sf_dir), known, ["THE A"], least=40)
    return out.select("id", "block_id", "text", F.array_join(F.transform("source_pages", lambda p: p.cast("string")), ",").alias("pages"))


def rationales(spark, sf_dir):
    out = R.consolidate_rationales(rationale_rows(spark, sf_dir))
    return out.select("id", F.size("blocks").alias("blocks"), F.array_join(F.transform("source_pages", lambda p: p.cast("string")), ",").alias("pages"), "mean_confidence", "occurrences", F.length("longest").alias("longest"), F.sha2("text", 256).alias("digest"))


def merged(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    results = p.select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, "YES").otherwise("NO").alias("verdict"), (F.col("p_partkey") % 5 + 1).cast("int").alias("confidence"))
    return R.merge_results(p, results, "p_partkey", ["verdict", "confidence"])


def last_first(spark, sf_dir):
    """The full ranking with ties in reverse target order; clamped scores tie at 0."""
    s, t = vectors(spark, sf_dir)
    return rounded(vector.ranked(vector.score_pairs(s, t), 1.0, last_first=True).select("source_id", "target_id", "rank", "relative_score"))


QUERIES = {"nested_candidates": blocks, "sanitized_requirements": sanitized, "dataset_problems": problems, "valid_rationales": valid_rationales, "consolidated_rationales": rationales, "merged_results": merged, "reverse_tie_ranking": last_first}

RAW = """WITH r AS (SELECT p_partkey k, p_partkey % 7 + 1 a, p_partkey % 13 b, p_partkey % 4 + 1 c, p_partkey % 2 odd, p_name || ' ' || p_brand AS text FROM part WHERE p_partkey % 10 <> 0 AND p_partkey % 11 <> 0),
s AS (SELECT k, 'SR ' || a || '.' || b parent, 'SR ' || a || '.' || b || CASE WHEN odd = 1 THEN ' RE ' || c ELSE '' END id, text, CASE WHEN odd = 1 THEN 'RE' ELSE 'SR' END AS type, a::INT fr FROM r)
"""
RATIONALES = """WITH w AS (SELECT item_id % 20 id, text, item_id block_id, [item_id % 3, item_id % 5] p, (item_id % 4) / 4 confidence FROM benchmark),
x AS (SELECT * FROM w UNION ALL SELECT id, left(text, 30), block_id + 1000, p, confidence FROM w WHERE id < 10)
"""
ORACLE_SQL = {
    "nested_candidates": "SELECT p_partkey % 50 block_id, count(*) records, (count(*) - 1)::INT AS last, sum(p_partkey)::BIGINT k FROM part GROUP BY 1",
    "sanitized_requirements": RAW + "SELECT k, id, text, type, fr, parent parent_sr FROM s",
    "dataset_problems": RAW + """, d AS (SELECT *, CASE WHEN k % 17 = 0 THEN 'RE' ELSE type END t2 FROM s WHERE k % 13 <> 0), e AS (SELECT *, count(*) OVER (PARTITION BY id) n FROM d),
q AS (SELECT DISTINCT id, unnest(list_filter([CASE WHEN n > 1 THEN 'repeated' END, CASE WHEN type <> t2 THEN 'type' END, CASE WHEN type = 'RE' AND parent NOT IN (SELECT id FROM d WHERE t2 = 'SR') THEN 'parent' END], lambda i: i IS NOT NULL)) problem FROM e)
SELECT problem, count(*) n FROM q GROUP BY 1""",
    "valid_rationales": RATIONALES + r", y AS (SELECT id, block_id, p, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM x) SELECT id, block_id, text, array_to_string(list_sort(list_distinct(list_filter(p, lambda i: i > 0))), ',') pages FROM y WHERE id BETWEEN 3 AND 15 AND len(text) >= 40 AND NOT contains(lower(text), 'the a')",
    # No text of benchmark goes on where another ends, so merging joins what is not contained in another text.
    "consolidated_rationales": RATIONALES + r""", o AS (SELECT id, text, min(block_id) b FROM x GROUP BY 1, 2), k AS (SELECT id, sha256(string_agg(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ' ORDER BY b)) digest FROM o WHERE NOT EXISTS (SELECT 1 FROM o q WHERE q.id = o.id AND len(q.text) > len(o.text) AND contains(q.text, o.text)) GROUP BY 1)
SELECT id, count(DISTINCT block_id)::INT blocks, array_to_string(list_sort(list_distinct(flatten(list(p)))), ',') pages, round(avg(confidence), 6) mean_confidence, count(*) occurrences, max(len(text))::INT longest, min(digest) digest FROM x JOIN k USING (id) GROUP BY 1""",
    "merged_results": "SELECT p_partkey, p_brand, CASE WHEN p_partkey % 3 = 0 THEN 'YES' ELSE 'NO' END llm_verdict, (p_partkey % 5 + 1)::INT llm_confidence FROM part",
    "reverse_tie_ranking": """WITH p AS (SELECT s.vec_id source_id, t.vec_id target_id, greatest(list_dot_product(s.embedding::DOUBLE[], t.embedding::DOUBLE[]), 0) c FROM embeddings s, embeddings t WHERE s.vec_id >= 100 AND t.vec_id < 100),
q AS (SELECT *, CASE WHEN max(c) OVER (PARTITION BY source_id) > 0 THEN c / max(c) OVER (PARTITION BY source_id) ELSE 0 END r FROM p)
SELECT source_id, target_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY r DESC, target_id DESC) AS INT) AS rank, round(r, 6) relative_score FROM q""",
}
