"""Audit queries: requirement records, vector sets, manifests and whole mappings over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import audit as A
from lumenfold.operators import batches as B
from lumenfold.operators import distribution as D
from lumenfold.operators import record_checks as R
from lumenfold.plans.q_distribution import rounded
from lumenfold.plans.standins import CTE, UNMATCHED, candidates, rules, with_unmatched
from lumenfold.session import table

def records(spark, sf_dir):
    """A record for each part: even ones are parents, odd ones enhancements of the one before; some are broken in one way or another."""
    k = F.col("k")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("int").alias("k"), "p_name", "p_brand")
    own = F.concat(F.lit("SR "), (k - k % 2) % 7 + 1, F.lit("."), k - k % 2)
    text = F.when(k % 31 == 0, "").when(k % 5 == 0, F.col("p_name")).when(k % 37 == 0, F.concat(F.lit("The system shall keep "), "p_name", F.lit(" copyright void"))).when(k % 33 == 0, "It shall do").otherwise(F.concat(F.lit("The system shall keep "), "p_name"))
    return p.select(
        F.when(k % 17 == 0, F.concat(F.lit("XR "), k)).otherwise(F.concat(own, F.when(k % 2 == 1, " RE 1").otherwise(""))).alias("id"),
        F.when(k % 19 == 0, F.lit(None)).when((k % 2 == 1) != (k % 23 == 0), "RE").otherwise("SR").alias("type"), F.when(k % 29 == 0, " ").otherwise(F.col("p_brand")).alias("title"), text.alias("text"),
        F.when(k % 41 == 0, "SR 9.9").otherwise(own).alias("parent_sr"), F.when(k % 43 == 0, 0).otherwise(((k - k % 2) % 7 + 1)).cast("int").alias("foundational_requirement"), "k")


def audited(spark, sf_dir):
    r, k = records(spark, sf_dir), F.col("k")
    half = F.substring("text", 1, F.floor(F.length("text") / 2).cast("int"))
    first = r.where("k % 11 <> 0").select("id", "title", "text")
    second = r.where("k % 11 <> 0").select("id", F.when(k % 6 == 1, "Other").otherwise(F.col("title")).alias("title"), F.when(k % 3 == 0, half).otherwise(F.col("text")).alias("text"))
    whole = r.where("k % 8 <> 3").select("id", F.when(k % 10 == 4, F.concat("text", F.lit(" x"))).otherwise(F.col("text")).alias("text"))
    return R.audit_records(r, first.unionAll(second), whole)


def requirement_audit(spark, sf_dir):
    return audited(spark, sf_dir).select("id", "status", "score", "word_count", F.array_join("issues", ",").alias("issues"), F.array_join("warnings", ",").alias("warnings"), F.col("candidates.occurrences").alias("occurrences"))


def requirement_dataset(spark, sf_dir):
    return R.audit_dataset(audited(spark, sf_dir))


def requirement_groups(spark, sf_dir):
    return R.group_distribution(records(spark, sf_dir))


def vector_set(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<float>").alias("v"))
    i = F.col("id")
    v = F.when(i % 40 == 7, F.lit(None)).when(i % 44 == 9, F.slice("v", 1, 10)).when(i % 55 == 11, F.transform("v", lambda x: (x * 2).cast("float"))).otherwise(F.col("v"))
    found = e.where("id % 50 <> 3").withColumn("c", F.explode(F.when(i % 60 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    found = found.select("id", F.when(i % 70 == 2, i + 1).otherwise(i).alias("ord"), v.alias("vector"))
    return A.vector_set_problems(found, e.where("id % 90 <> 5").select("id", i.alias("ord")), 64)


def manifest_problems(spark, sf_dir):
    """A pair manifest and its batches of seven, some of which were tampered with."""
    c = candidates(spark, sf_dir).select("source_id", "rank", F.concat_ws(":", "source_id", "rank").alias("pair_id"))
    pairs = B.pair_manifest(c, ["source_id", "rank"])
    b = B.batch_manifest(pairs, 7, "pair_id")
    told = F.when(F.col("batch_index") % 10 == 3, F.lit("0")).otherwise(F.col("membership_sha256"))
    return B.manifest_problems(pairs, b.withColumn("membership_sha256", told).where("batch_index % 20 <> 5"), 7).groupBy("code").agg(F.count("*").alias("n"))


def mapping(spark, sf_dir):
    return rounded(D.mapping_analysis(with_unmatched(rules(spark, sf_dir)), candidates(spark, sf_dir)))


QUERIES = {"requirement_audit": requirement_audit, "requirement_dataset": requirement_dataset, "requirement_groups": requirement_groups, "vector_set": vector_set, "manifest_problems": manifest_problems, "mapping_analysis": mapping}

RECORDS = """WITH p AS (SELECT p_partkey::INT k, p_name, p_brand, k - k % 2 e, e % 7 + 1 fr, 'SR ' || fr || '.' || e own FROM part),
r AS (SELECT k, own, fr, CASE WHEN k % 17 = 0 THEN 'XR ' || k ELSE own || CASE WHEN k % 2 = 1 THEN ' RE 1' ELSE '' END END id, CASE WHEN k % 2 = 1 THEN 'RE' ELSE 'SR' END kind,
      CASE WHEN k % 19 = 0 THEN NULL WHEN (k % 2 = 1) <> (k % 23 = 0) THEN 'RE' ELSE 'SR' END AS type, CASE WHEN k % 29 = 0 THEN ' ' ELSE p_brand END title,
      CASE WHEN k % 31 = 0 THEN '' WHEN k % 5 = 0 THEN p_name WHEN k % 37 = 0 THEN 'The system shall keep ' || p_name || ' copyright void' WHEN k % 33 = 0 THEN 'It shall do' ELSE 'The system shall keep ' || p_name END AS text,
      CASE WHEN k % 41 = 0 THEN 'SR 9.9' ELSE own END parent_sr, CASE WHEN k % 43 = 0 THEN 0 ELSE fr END declared FROM p)"""
AUDIT = RECORDS + """, s AS (SELECT *, k % 17 <> 0 known, len(text) n, len(rtrim(substr(text, 1, len(text) // 2))) h, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END words, k % 37 = 0 AND k % 5 <> 0 AND k % 31 <> 0 dirty,
      contains(' ' || lower(text) || ' ', ' shall ') normative, k % 11 <> 0 seen, k % 3 = 0 AND text <> '' halved, k % 17 <> 0 AND parent_sr = own same_parent FROM r),
t AS (SELECT *, same_parent AND type = 'RE' AND own NOT IN (SELECT id FROM r) orphan, seen AND halved AND round(CASE WHEN n + h > 0 THEN 2 * h / (n + h) ELSE 1 END, 4) < 0.7 unlike FROM s),
u AS (SELECT *, list_filter([CASE WHEN known AND declared <> fr THEN 'foundational_requirement_mismatch' END, CASE WHEN known AND type <> kind THEN 'id_type_mismatch' END, CASE WHEN type IS NULL THEN 'invalid_or_missing_type' END, CASE WHEN NOT same_parent THEN 'invalid_parent_sr' END,
      CASE WHEN NOT known THEN 'invalid_requirement_id' END, CASE WHEN orphan THEN 'missing_parent_sr' END, CASE WHEN text = '' THEN 'missing_text' END, CASE WHEN title = ' ' THEN 'missing_title' END], lambda x: x IS NOT NULL) critical,
      list_filter([CASE WHEN text = '' THEN 'empty_text' END, CASE WHEN k % 8 <> 3 AND k % 10 = 4 THEN 'clean_text_differs_from_debug_consolidation' END, CASE WHEN seen AND halved THEN 'prefix_or_truncation_variant_detected' END, CASE WHEN unlike THEN 'low_similarity_candidate_variant' END,
      CASE WHEN k % 8 = 3 THEN 'missing_debug_consolidation_entry' END, CASE WHEN seen AND halved THEN 'multiple_text_variants' END, CASE WHEN seen AND k % 6 = 1 THEN 'multiple_title_variants' END, CASE WHEN text <> '' AND NOT normative THEN 'no_shall_detected' END,
      CASE WHEN NOT seen THEN 'not_found_in_debug_blocks' END, CASE WHEN words < 5 THEN 'suspiciously_short_text' END], lambda x: x IS NOT NULL) told FROM t),
v AS (SELECT *, known::INT + (type IS NOT NULL)::INT + (title <> ' ')::INT + (text <> '')::INT + (same_parent AND type IS NOT NULL AND NOT coalesce(orphan, false))::INT + (known AND declared = fr)::INT + normative::INT + (NOT dirty)::INT + (seen AND NOT halved AND k % 6 <> 1)::INT score FROM u),
a AS (SELECT *, CASE WHEN len(critical) > 0 THEN 'fail' WHEN dirty THEN 'review' WHEN score = 9 AND len(told) = 0 THEN 'approved' ELSE 'warning' END status FROM v)"""
ORACLE_SQL = {
    "requirement_audit": AUDIT + " SELECT id, status, score, words::INT word_count, array_to_string(list_sort(CASE WHEN dirty THEN list_concat(critical, ['possible_text_contamination:copyright_notice', 'possible_text_contamination:void_artifact']) ELSE critical END), ',') issues, array_to_string(list_sort(told), ',') warnings, (CASE WHEN seen THEN 2 ELSE 0 END)::BIGINT occurrences FROM a",
    "requirement_dataset": AUDIT + """, x AS (SELECT 'SR ' || fr || '.' || unnest(range(1, n + 1)) id FROM (VALUES (1, 13), (2, 12), (3, 9), (4, 3), (5, 4), (6, 2), (7, 8)) e(fr, n)),
o AS (SELECT count(*) FILTER (type = 'SR') sr, count(*) FILTER (type = 'RE') re, (SELECT count(*) FROM x WHERE id NOT IN (SELECT id FROM a WHERE type = 'SR')) missing, count(*) FILTER (type = 'SR' AND id NOT IN (SELECT id FROM x)) extra FROM a)
SELECT count(*) total_entries, min(sr) sr_count, min(re) re_count, count(*) FILTER (status = 'approved') approved, count(*) FILTER (status = 'warning') warning, count(*) FILTER (status = 'review') review, count(*) FILTER (status = 'fail') fail,
count(*) FILTER (NOT seen) missing_from_blocks, count(*) FILTER (k % 8 = 3) missing_from_consolidation, 0::BIGINT duplicate_ids, min(missing) missing_srs, min(extra) unexpected_srs,
(SELECT count(*) FROM (SELECT lower(text) FROM a WHERE text <> '' GROUP BY 1 HAVING count(*) > 1)) duplicate_text_groups, count(*) = 100 AND min(sr) = 51 AND min(re) = 49 AND min(missing) = 0 AND min(extra) = 0 structural_pass FROM a, o""",
    "requirement_groups": RECORDS + " SELECT e.fr::INT foundational_requirement, e.n::BIGINT expected_sr_count, count(*) FILTER (type = 'SR') sr_count, count(*) FILTER (type = 'RE') re_count, count(*) FILTER (type = 'SR') = e.n matches FROM (VALUES (1, 13), (2, 12), (3, 9), (4, 3), (5, 4), (6, 2), (7, 8)) e(fr, n) LEFT JOIN r ON r.declared = e.fr GROUP BY e.fr, e.n",
    "vector_set": """WITH e AS (SELECT vec_id id, embedding v, sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))) n FROM embeddings), f AS (SELECT *, CASE WHEN id % 60 = 1 THEN 2 ELSE 1 END c FROM e WHERE id % 50 <> 3),
b AS (SELECT id, CASE WHEN id % 40 = 7 THEN 'missing' WHEN id % 44 = 9 THEN 'dimension' END code, c FROM f UNION ALL SELECT id, 'norm', c FROM f WHERE id % 40 <> 7 AND CASE WHEN id % 44 = 9 THEN abs(sqrt(list_sum(list_transform(v[1:10]::DOUBLE[], lambda x: x * x))) - 1) > 1e-5 WHEN id % 55 = 11 THEN abs(2 * n - 1) > 1e-5 ELSE abs(n - 1) > 1e-5 END)
SELECT code, id::VARCHAR AS error FROM (SELECT id, code, unnest(range(c)) FROM b WHERE code IS NOT NULL) UNION ALL
SELECT code, id::VARCHAR FROM (SELECT id, CASE WHEN id % 50 = 3 AND id % 90 <> 5 THEN 'missing_id' WHEN id % 50 = 3 THEN NULL WHEN id % 90 = 5 THEN 'extra_id' WHEN id % 60 = 1 THEN 'repeated_id' WHEN id % 70 = 2 THEN 'order' END code FROM e) WHERE code IS NOT NULL""",
    "manifest_problems": CTE + """, m AS (SELECT (row_number() OVER (ORDER BY source_id, rank) - 1) // 7 b FROM cand), x AS (SELECT b, count(*) n FROM m GROUP BY 1)
SELECT code, n::BIGINT n FROM (SELECT 'batch_digest' code, count(*) n FROM x WHERE b % 10 = 3 AND b % 20 <> 5 UNION ALL SELECT 'batch_member', sum(n) FROM x WHERE b % 20 = 5 UNION ALL SELECT 'batch_count', 1) WHERE n > 0""",
    "mapping_analysis": CTE + """, c AS (SELECT * FROM cand), o AS (SELECT source, source_id, count(*) n, count(DISTINCT CASE WHEN target_type = 'SR' THEN target_id ELSE parent_sr END) parents FROM c GROUP BY 1, 2),
per AS (SELECT r.source, r.source_id, coalesce(n, 0) n, coalesce(parents, 0) parents FROM """ + UNMATCHED + """ r LEFT JOIN o USING (source, source_id)),
x AS (SELECT source, 'candidates_per_rule' section, n::DOUBLE v FROM per UNION ALL SELECT source, 'distinct_parents_per_rule', parents FROM per UNION ALL SELECT source, 'relative_score', relative_score FROM c UNION ALL SELECT source, 'raw_cosine', raw_cosine FROM c),
s AS (SELECT source, section, {'mean': avg(v), 'median': median(v), 'min': min(v), 'max': max(v), 'stdev': CASE WHEN count(v) = 1 THEN 0 ELSE stddev_samp(v) END, 'p25': quantile_cont(v, 0.25), 'p50': quantile_cont(v, 0.5), 'p75': quantile_cont(v, 0.75), 'p90': quantile_cont(v, 0.9), 'p95': quantile_cont(v, 0.95), 'p99': quantile_cont(v, 0.99)} q FROM x GROUP BY 1, 2),
u AS (SELECT source, section, unnest(map_entries(MAP {'mean': q.mean, 'median': q.median, 'min': q.min, 'max': q.max, 'stdev': q.stdev, 'p25': q.p25, 'p50': q.p50, 'p75': q.p75, 'p90': q.p90, 'p95': q.p95, 'p99': q.p99})) e FROM s),
k AS (SELECT source, {'rules': count(*), 'with_candidates': count(*) FILTER (n > 0), 'without_candidates': count(*) FILTER (n = 0), 'candidates': sum(n)} q FROM per GROUP BY 1),
w AS (SELECT source, unnest(map_entries(MAP {'rules': q.rules::DOUBLE, 'with_candidates': q.with_candidates, 'without_candidates': q.without_candidates, 'candidates': q.candidates::DOUBLE})) e FROM k),
t AS (SELECT source, target_id, count(*) n, min({'s': source_id, 'r': rank}) seen FROM c GROUP BY 1, 2),
l AS (SELECT source, 'top_targets' section, target_id name, row_number() OVER (PARTITION BY source ORDER BY n DESC, seen) p, n FROM t UNION ALL SELECT source, 'top_rules', source_id, row_number() OVER (PARTITION BY source ORDER BY n DESC, source_id), n FROM per
      UNION ALL SELECT source, 'top_rules_by_parents', source_id, row_number() OVER (PARTITION BY source ORDER BY parents DESC, source_id), parents FROM per)
SELECT source, section, e.key AS name, NULL::INT AS position, NULL::BIGINT n, round(e.value, 6) AS value FROM u UNION ALL SELECT source, 'counts', e.key, NULL, NULL, e.value FROM w
UNION ALL SELECT source, 'target_type', target_type, NULL, count(*), NULL FROM c GROUP BY 1, 3 UNION ALL SELECT source, 'parent', parent_sr::VARCHAR, NULL, count(*), NULL FROM c WHERE parent_sr IS NOT NULL GROUP BY 1, 3
UNION ALL SELECT source, section, name::VARCHAR, p::INT, n, NULL FROM l WHERE p <= 20""",
}
