"""Verdict, annotation and rule-class queries over the stand-in candidates."""

from __future__ import annotations

from pyspark.sql import functions as F

from lumenfold.operators import labels as L
from lumenfold.plans.q_distribution import rounded
from lumenfold.plans.standins import CTE, UNMATCHED, candidates, rules, targets, with_unmatched
from lumenfold.session import table

CLASSES = ["security_related", "non_security", "uncertain"]


def classes(spark, sf_dir):
    """Rule classes from the label table: quality and toxic marks by id, unmatched ids are uncertain; every second rule has no candidates."""
    lab = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("source_id"), "quality", "toxic")
    label = F.when(F.col("toxic") == 1, "security_related").when(F.col("quality") == 1, "non_security").otherwise("uncertain")
    own = with_unmatched(rules(spark, sf_dir)).withColumn("_id", F.abs("source_id"))
    return own.join(lab.withColumnRenamed("source_id", "_id"), "_id", "left").select("source", "source_id", label.alias("label"))


def annotations(spark, sf_dir):
    """New records without labels, and old ones of which some carry a valid label."""
    new = candidates(spark, sf_dir).select("source", "source_id", "rank", "target_id").withColumn("human_label", F.lit(None).cast("string")).withColumn("human_notes", F.lit("").cast("string"))
    k = F.pmod(F.col("source_id") + F.col("target_id"), F.lit(4))
    old = new.where("source_id % 3 <> 0").withColumn("human_label", F.when(k == 0, "YES").when(k == 1, "NO").when(k == 2, "unknown")).withColumn("human_notes", F.concat(F.lit("n"), F.col("target_id")))
    return new, old


def transferred(spark, sf_dir):
    new, old = annotations(spark, sf_dir)
    return L.transfer_annotations(new, old, ["source", "source_id", "rank", "target_id"], ["human_label", "human_notes"], ["YES", "MAYBE", "NO"])


def rollup(spark, sf_dir):
    return L.rule_rollup(classes(spark, sf_dir), candidates(spark, sf_dir))


def groups(spark, sf_dir):
    return L.class_groups(rollup(spark, sf_dir), CLASSES)


def sample_counts(spark, sf_dir):
    out = L.stratified_sample(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", 75, "p_partkey")
    return out.groupBy("p_brand").agg(F.count("*").alias("n"))


CLASS_SQL = CTE + """, cls AS (SELECT r.source, r.source_id, CASE WHEN toxic = 1 THEN 'security_related' WHEN quality = 1 THEN 'non_security' ELSE 'uncertain' END AS label FROM """ + UNMATCHED + """ r LEFT JOIN labels l ON l.doc_id = abs(r.source_id)),
pr AS (SELECT * FROM cand),
ru AS (SELECT c.source, c.source_id, c.label, count(p.rank) candidates, count(*) FILTER (verdict = 'YES') yes_count, count(*) FILTER (verdict = 'MAYBE') maybe_count, count(*) FILTER (verdict = 'NO') no_count,
       count(*) FILTER (verdict IN ('YES', 'MAYBE')) positive_count, CASE WHEN count(p.rank) = 0 THEN 0 ELSE round(count(*) FILTER (verdict IN ('YES', 'MAYBE')) / count(p.rank), 6) END positive_rate
       FROM cls c LEFT JOIN pr p USING (source, source_id) GROUP BY 1, 2, 3),
gr AS (SELECT k.label, count(r.source) rules, count(*) FILTER (r.candidates > 0) with_candidates, count(*) FILTER (r.positive_count > 0) positive_rules, coalesce(sum(r.candidates), 0)::BIGINT pairs, coalesce(sum(r.yes_count), 0)::BIGINT yes_pairs,
       round(coalesce(100.0 * count(*) FILTER (r.positive_count > 0) / nullif(count(r.source), 0), 0), 6) coverage, round(coalesce(avg(positive_rate) FILTER (candidates > 0), 0), 6) mean_rate, round(coalesce(median(positive_rate) FILTER (candidates > 0), 0), 6) median_rate
       FROM (VALUES ('security_related'), ('non_security'), ('uncertain')) k(label) LEFT JOIN ru r ON r.label = k.label GROUP BY 1)
"""
ANNOT_SQL = CTE + """, old AS (SELECT source, source_id, rank, target_id, CASE (source_id + target_id) % 4 WHEN 0 THEN 'YES' WHEN 1 THEN 'NO' WHEN 2 THEN 'unknown' END l, 'n' || target_id n FROM cand WHERE source_id % 3 <> 0),
tr AS (SELECT c.source, c.source_id, c.rank, c.target_id, CASE WHEN o.l IN ('YES', 'MAYBE', 'NO') THEN o.l END human_label, CASE WHEN o.l IN ('YES', 'MAYBE', 'NO') THEN o.n ELSE '' END human_notes FROM cand c LEFT JOIN old o USING (source, source_id, rank, target_id))
"""

QUERIES = {
    "rule_summary": lambda s, p: L.rule_summary(candidates(s, p)),
    "top_targets": lambda s, p: L.top_targets(candidates(s, p), ["YES", "MAYBE"], ["even", "odd"]),
    "audit_by_source_and_type": lambda s, p: rounded(L.verdicts_by(candidates(s, p), [["source"], ["target_type"], ["source", "target_type"], []])).na.fill("ALL", ["source", "target_type"]),
    "rule_rollup": lambda s, p: rounded(rollup(s, p)),
    "class_groups": lambda s, p: rounded(groups(s, p)),
    "group_ratios": lambda s, p: rounded(L.group_ratios(groups(s, p), "security_related", "non_security")),
    "relevance_by_verdict": lambda s, p: L.cross_analysis(candidates(s, p), classes(s, p)),
    "classified_pairs": lambda s, p: candidates(s, p).join(classes(s, p).where("label = 'security_related'"), ["source", "source_id"], "left_semi").select("source", "source_id", "target_id", "verdict"),
    "annotation_transfer": transferred,
    "annotation_statistics": lambda s, p: L.annotation_statistics(transferred(s, p), "human_label", ["YES", "MAYBE", "NO"]),
    "targets_with_parents": lambda s, p: targets(s, p).alias("t").join(targets(s, p).alias("q"), F.col("t.parent_sr") == F.col("q.target_id"), "left").select("t.target_id", F.coalesce(F.col("q.fr"), F.lit(0)).alias("parent_fr")),
    "stratified_sample_counts": sample_counts,
    "stratified_sample": lambda s, p: L.stratified_sample(table(s, p, "part").select("p_partkey", "p_brand"), "p_brand", 75, "p_partkey"),
}
ORACLE_SQL = {
    "stratified_sample_counts": """WITH c AS (SELECT p_brand, count(*) n, sum(count(*)) OVER () total FROM part GROUP BY 1), t AS (SELECT *, CASE WHEN 75 >= total THEN n ELSE least(n, round_even(75 * n / total, 0))::BIGINT END take FROM c),
d AS (SELECT 75 - sum(take) AS d FROM t WHERE total > 75), up AS (SELECT p_brand, n - take - unnest(range(n - take)) v FROM t), down AS (SELECT p_brand, take - unnest(range(take)) v FROM t),
m AS (SELECT p_brand, 1 s FROM (SELECT *, row_number() OVER (ORDER BY v DESC, p_brand) r FROM up) WHERE r <= (SELECT d FROM d) UNION ALL SELECT p_brand, -1 FROM (SELECT *, row_number() OVER (ORDER BY v DESC, p_brand) r FROM down) WHERE r <= -(SELECT d FROM d))
SELECT p_brand, (take + coalesce((SELECT sum(s) FROM m WHERE m.p_brand = t.p_brand), 0))::BIGINT n FROM t WHERE take + coalesce((SELECT sum(s) FROM m WHERE m.p_brand = t.p_brand), 0) > 0""",
    "rule_summary": CTE + """SELECT source, source_id, count(*) candidates, count(*) FILTER (verdict = 'YES') yes_count, count(*) FILTER (verdict = 'MAYBE') maybe_count, count(*) FILTER (verdict = 'NO') no_count, count(*) FILTER (verdict <> 'NO') positive_count,
bool_or(verdict = 'YES') has_yes, bool_or(verdict = 'MAYBE') has_maybe, bool_and(verdict = 'NO') all_no, min_by(verdict, rank) top1_verdict, min_by(target_id, rank) top1_target_id, min_by(target_type, rank) top1_target_type FROM cand GROUP BY 1, 2""",
    "top_targets": CTE + "SELECT target_id, count(*) pairs, count(DISTINCT source || source_id) rules, count(*) FILTER (source = 'even') pairs_even, count(*) FILTER (source = 'odd') pairs_odd FROM cand WHERE verdict IN ('YES', 'MAYBE') GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 30",
    "audit_by_source_and_type": CTE + """SELECT coalesce(source, 'ALL') source, coalesce(target_type, 'ALL') target_type, count(*) pairs, count(*) FILTER (verdict = 'YES') yes_count, count(*) FILTER (verdict = 'MAYBE') maybe_count, count(*) FILTER (verdict = 'NO') no_count,
count(*) FILTER (verdict <> 'NO') positive_count, round(100.0 * count(*) FILTER (verdict <> 'NO') / count(*), 4) positive_pct FROM cand GROUP BY GROUPING SETS ((cand.source), (cand.target_type), (cand.source, cand.target_type), ())""",
    "rule_rollup": CLASS_SQL + "SELECT * FROM ru",
    "class_groups": CLASS_SQL + "SELECT * FROM gr",
    "group_ratios": CLASS_SQL + """SELECT CASE WHEN a.coverage <> 0 AND b.coverage <> 0 THEN round(a.coverage / b.coverage, 6) END coverage_ratio, CASE WHEN a.mean_rate <> 0 AND b.mean_rate <> 0 THEN round(a.mean_rate / b.mean_rate, 6) END mean_rate_ratio,
round((a.yes_pairs / nullif(a.pairs, 0)) / nullif(b.yes_pairs / nullif(b.pairs, 0), 0), 6) yes_ratio FROM gr a, gr b WHERE a.label = 'security_related' AND b.label = 'non_security'""",
    "relevance_by_verdict": CLASS_SQL + "SELECT label, verdict, count(*) pairs, count(DISTINCT source || source_id) rules FROM pr JOIN cls USING (source, source_id) GROUP BY 1, 2",
    "classified_pairs": CLASS_SQL + "SELECT source, source_id, target_id, verdict FROM pr WHERE source_id IN (SELECT source_id FROM cls WHERE label = 'security_related')",
    "annotation_transfer": ANNOT_SQL + "SELECT * FROM tr",
    "annotation_statistics": ANNOT_SQL + "SELECT source, source_id, count(*) candidates, count(human_label) labelled, bool_and(human_label IS NOT NULL) decided, CASE WHEN bool_and(human_label IS NOT NULL) THEN 'completed' WHEN count(human_label) > 0 THEN 'in_progress' ELSE 'unreviewed' END status FROM tr GROUP BY 1, 2",
    "targets_with_parents": CTE + "SELECT t.target_id, coalesce(q.fr, 0) parent_fr FROM targets t LEFT JOIN targets q ON t.parent_sr = q.target_id",
}
