"""Distribution, concentration, quality and sweep queries over the stand-in candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenfold.config import MatchConfig
from lumenfold.functions import measures as m
from lumenfold.functions.hierarchy import effective_parent, effective_parent_by_type
from lumenfold.operators import distribution as d
from lumenfold.operators import sweep, vector
from lumenfold.operators.percentiles import with_percentiles
from lumenfold.plans.q_matching import vectors
from lumenfold.plans.standins import CTE, candidates, rules, targets
from lumenfold.session import table

THRESHOLDS = [0.30, 0.40, 0.50, 0.60, 0.70, 0.80]
KS = [3, 5, 10]
POWERS = [1.0, 2.5, 5.5, 10.0, 20.0]


def rounded(df, digits=6):
    """Doubles are compared after rounding."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def ranked(spark, sf_dir, power=1.0):
    s, t = vectors(spark, sf_dir)
    return vector.ranked(vector.score_pairs(s, t, MatchConfig()), power).drop("target_ord")


def ranked_full(spark, sf_dir):
    return rounded(ranked(spark, sf_dir).withColumn("best", F.col("rank") == 1)).select("source_id", "target_id", "rank", "raw_cosine", "relative_score", "best")


def threshold_topk(spark, sf_dir):
    r = ranked(spark, sf_dir).join(rules(spark, sf_dir), "source_id").join(targets(spark, sf_dir), "target_id")
    return rounded(sweep.threshold_topk(r, rules(spark, sf_dir), THRESHOLDS, KS))


def mp_diversity(spark, sf_dir):
    s, t = vectors(spark, sf_dir)
    return rounded(sweep.diversity(vector.score_pairs(s, t), POWERS))


def multi_framework(spark, sf_dir):
    """Three target sets: the key of maximum, threshold and rank is (framework, source)."""
    s, t = vectors(spark, sf_dir)
    pairs = vector.score_pairs(s, t).withColumn("framework", F.concat(F.lit("f"), F.col("target_id") % 3))
    keys = ("framework", "source_id")
    out = vector.select_matches(vector.relative_scores(pairs, 1.0, keys), MatchConfig(power=1.0, threshold=0.5, top_k=5), keys)
    return rounded(out.select("framework", "source_id", "target_id", "rank", "relative_score"))


def per_rule(spark, sf_dir):
    return d.candidate_counts(rules(spark, sf_dir), candidates(spark, sf_dir))


def score_stats(spark, sf_dir):
    rel, raw = F.col("relative_score"), F.col("raw_cosine")
    own = [*m.describe(rel, "rel", ranks=False), *m.quartiles(raw, "raw", ranks=False), m.sample_stdev(raw).alias("raw_stdev")]
    return rounded(with_percentiles(candidates(spark, sf_dir), ["source"], own, {"rel": (rel, m.DESCRIBED), "raw": (raw, m.QUARTERS)}))


def order_price_quartiles(spark, sf_dir):
    x = F.col("o_totalprice")
    return rounded(with_percentiles(table(spark, sf_dir, "orders"), ["o_orderpriority"], m.quartiles(x, "price", 2, ranks=False), {"price": (x, m.QUARTERS)}, 2), 2)


def scores_by_verdict(spark, sf_dir):
    c = candidates(spark, sf_dir).groupingSets([["verdict"], []], "verdict")
    return rounded(c.agg(*m.quartiles(F.col("relative_score"), "rel")).withColumn("verdict", F.coalesce("verdict", F.lit("ALL"))))


def ranking_sql(key, group="source", extra=""):
    return CTE + f""", c AS (SELECT {group}, {key} AS key, count(*) n, avg(relative_score) mr, avg(raw_cosine) mc, count(DISTINCT target_id) dt FROM cand GROUP BY ALL),
o AS (SELECT *, 100.0 * n / sum(n) OVER (PARTITION BY {group}) pct, CAST(row_number() OVER (PARTITION BY {group} ORDER BY n DESC, key) AS INT) AS position FROM c)
SELECT {group}, key, n, round(mr, 6) mean_relative, round(mc, 6) mean_cosine, dt distinct_targets, round(pct, 6) pct, position FROM o WHERE position <= 20"""


def bins_sql(bins, x, source, group):
    values = ", ".join(f"({i}, '{b[0]}', {b[1]}::DOUBLE, {'NULL' if b[2] is None else b[2]}::DOUBLE)" for i, b in enumerate(bins))
    return CTE + f""", cnt AS (SELECT r.source, r.source_id, count(c.rank) n FROM rules r LEFT JOIN cand c USING (source, source_id) GROUP BY ALL),
bins(ord, bin, lo, hi) AS (VALUES {values}), g AS (SELECT DISTINCT {group} FROM {source})
SELECT {group}, ord, bin, (SELECT count(*) FROM {source} s WHERE s.{group} = g.{group} AND s.{x} >= lo AND (hi IS NULL OR s.{x} < hi)) n FROM g, bins"""


STATS = "min mean median p90 p95 max".split()


def describe_sql(x, p, empty="0"):
    f = {"min": f"min({x})", "mean": f"avg({x})", "median": f"median({x})", "p90": f"quantile_cont({x}, 0.9)", "p95": f"quantile_cont({x}, 0.95)", "max": f"max({x})"}
    return ", ".join(f"round(coalesce(({v})::DOUBLE, {empty}), 6) {p}_{k}" for k, v in f.items())


def quartile_sql(x, p):
    f = {"min": f"min({x})", "q25": f"quantile_cont({x}, 0.25)", "median": f"median({x})", "mean": f"avg({x})", "q75": f"quantile_cont({x}, 0.75)", "max": f"max({x})", "std": f"stddev_samp({x})"}
    return f"count({x}) {p}_n, " + ", ".join(f"round(({v})::DOUBLE, 6) {p}_{k}" for k, v in f.items())


COUNTERS_SQL = CTE + """, long AS (SELECT source, 'target' dimension, target_id::VARCHAR AS key FROM cand UNION ALL SELECT source, 'parent', coalesce(parent_sr, target_id)::VARCHAR FROM cand
UNION ALL SELECT source, 'type', target_type FROM cand UNION ALL SELECT source, 'fr', fr::VARCHAR FROM cand),
counted AS (SELECT dimension, source, key, count(*) n FROM long GROUP BY GROUPING SETS ((dimension, key), (dimension, key, source)))"""

QUERIES = {
    "ranked_full": ranked_full,
    "threshold_topk_sweep": threshold_topk,
    "mp_diversity": mp_diversity,
    "multi_framework_matching": multi_framework,
    "topk_then_thresholds": lambda s, p: sweep.topk_then_thresholds(ranked(s, p), 10, [0.6, 0.7, 0.8, 0.9]).withColumn("score", F.round("score", 4)),
    "rounded_threshold": lambda s, p: rounded(sweep.rounded_threshold(ranked(s, p))).select("source_id", "target_id", "rank", "score", "best", "diagnostic_top10"),
    "candidate_table": lambda s, p: rounded(candidates(s, p)).withColumn("parent_sr", F.coalesce(F.col("parent_sr").cast("string"), F.lit(""))),
    "candidates_per_rule": per_rule,
    "candidate_histogram": lambda s, p: d.histogram(per_rule(s, p)),
    "observed_counts": lambda s, p: d.observed_counts(per_rule(s, p), candidates(s, p)),
    "score_stats": score_stats,
    "scores_by_verdict": scores_by_verdict,
    "verdict_distribution": lambda s, p: d.value_distribution(candidates(s, p), "verdict"),
    "verdict_by_source": lambda s, p: d.value_distribution(candidates(s, p), "verdict", "source"),
    "parent_distribution": lambda s, p: d.value_distribution(candidates(s, p), "parent_sr"),
    "count_bins": lambda s, p: d.binned(per_rule(s, p), F.col("n"), d.COUNT_BINS, ["source"]),
    "relative_bins": lambda s, p: d.binned(candidates(s, p), F.col("relative_score"), d.RELATIVE_BINS, ["source"]),
    "raw_bins": lambda s, p: d.binned(candidates(s, p), F.col("raw_cosine"), d.RAW_BINS, ["source"]),
    "counters": lambda s, p: d.counters(candidates(s, p)),
    "concentration": lambda s, p: rounded(d.concentration(d.counters(candidates(s, p)))),
    "target_ranking": lambda s, p: rounded(d.ranking(candidates(s, p), F.col("target_id"))),
    "parent_ranking": lambda s, p: rounded(d.ranking(candidates(s, p), effective_parent(F.col("parent_sr"), F.col("target_id")))),
    "parent_by_type_ranking": lambda s, p: rounded(d.ranking(candidates(s, p), effective_parent_by_type(F.col("target_type"), F.col("parent_sr"), F.col("target_id")))),
    "first_seen_ranking": lambda s, p: d.first_seen_ranking(table(s, p, "part"), "p_brand", "p_partkey"),
    "source_target_matrix": lambda s, p: d.count_matrix(candidates(s, p), rules(s, p), targets(s, p)),
    "rule_quality": lambda s, p: rounded(d.rule_quality(candidates(s, p)).select("source", "source_id", "n", "top1", "top2", "gap", "distinct_parents", F.array_join(F.transform("parents", lambda x: x.cast("string")), ",").alias("parents"))),
    "source_quality": lambda s, p: rounded(d.source_quality(rules(s, p), d.rule_quality(candidates(s, p)))),
    "source_comparison": lambda s, p: rounded(d.compare_sources(d.source_quality(rules(s, p), d.rule_quality(candidates(s, p))), ["even", "odd"], ["rules", "covered", "coverage", "candidates_mean", "gap_mean"])),
    "target_type_counts": lambda s, p: candidates(s, p).groupBy("source", "target_type").agg(F.count("*").alias("n"), F.round(m.percent(F.count("*"), F.sum(F.count("*")).over(Window.partitionBy("source"))), 6).alias("pct")),
    "order_price_quartiles": order_price_quartiles,
}

SWEEP_SQL = CTE + f""", rk AS (SELECT p.*, r.source, t.parent_sr, row_number() OVER (PARTITION BY p.source_id ORDER BY relative_score DESC, target_id) AS rank FROM relative p JOIN rules r USING (source_id) JOIN targets t USING (target_id)),
grid AS (SELECT * FROM (VALUES {", ".join(f"({t}::DOUBLE)" for t in THRESHOLDS)}) a(threshold), (VALUES {", ".join(f"({k})" for k in KS)}) b(k)),
per AS (SELECT threshold, k, source, source_id, count(*) n, count(DISTINCT coalesce(parent_sr, target_id)) parents, sum(relative_score) s FROM rk JOIN grid ON relative_score >= threshold AND rank <= k GROUP BY ALL),
tot AS (SELECT source, count(*) rules FROM rules GROUP BY 1)
SELECT g.threshold, g.k, t.source, t.rules, count(p.n) covered, coalesce(sum(p.n), 0)::BIGINT pairs, round(100.0 * count(p.n) / t.rules, 6) coverage,
       {describe_sql('p.n', 'candidates')}, {describe_sql('p.parents', 'parents')}, round(coalesce(sum(s) / sum(p.n), 0), 6) mean_score
FROM grid g CROSS JOIN tot t LEFT JOIN per p ON p.threshold = g.threshold AND p.k = g.k AND p.source = t.source GROUP BY g.threshold, g.k, t.source, t.rules"""

QUALITY_SQL = CTE + """, q AS (SELECT source, source_id, count(*) n, max(relative_score) FILTER (rank = 1) top1, max(relative_score) FILTER (rank = 2) top2,
max(relative_score) FILTER (rank = 1) - max(relative_score) FILTER (rank = 2) gap, CAST(count(DISTINCT coalesce(parent_sr, target_id)) AS INT) distinct_parents,
array_to_string(list_sort(list(DISTINCT coalesce(parent_sr, target_id))), ',') parents FROM cand GROUP BY 1, 2)"""

SOURCE_QUALITY_SQL = QUALITY_SQL + f""", sq AS (SELECT r.source, count(*) rules, count(q.n) covered, round(100.0 * count(q.n) / count(*), 6) coverage, 100.0::DOUBLE presence,
{describe_sql('coalesce(q.n, 0)', 'candidates')}, {describe_sql('gap', 'gap')}, {describe_sql('distinct_parents', 'parents')} FROM rules r LEFT JOIN q USING (source, source_id) GROUP BY 1)"""

ORACLE_SQL = {
    "ranked_full": CTE + "SELECT source_id, target_id, CAST(row_number() OVER (PARTITION BY source_id ORDER BY relative_score DESC, target_id) AS INT) AS rank, round(raw_cosine, 6) raw_cosine, round(relative_score, 6) relative_score, row_number() OVER (PARTITION BY source_id ORDER BY relative_score DESC, target_id) = 1 AS best FROM relative",
    "threshold_topk_sweep": SWEEP_SQL,
    "mp_diversity": CTE + f", b AS (SELECT target_id, max(relative_score) r FROM relative GROUP BY 1) SELECT p, round(avg(pow(r, p)), 6) m FROM b, (VALUES {', '.join(f'({p}::DOUBLE)' for p in POWERS)}) v(p) GROUP BY p",
    "multi_framework_matching": CTE + """, f AS (SELECT 'f' || (target_id % 3) framework, source_id, target_id, greatest(raw_cosine, 0) c, max(greatest(raw_cosine, 0)) OVER (PARTITION BY target_id % 3, source_id) mx FROM pairs),
g AS (SELECT framework, source_id, target_id, CASE WHEN mx > 0 THEN c / mx ELSE 0 END rel FROM f), h AS (SELECT *, CAST(row_number() OVER (PARTITION BY framework, source_id ORDER BY rel DESC, target_id) AS INT) AS rank FROM g WHERE rel >= 0.5 AND rel > 0)
SELECT framework, source_id, target_id, rank, round(rel, 6) relative_score FROM h WHERE rank <= 5""",
    "topk_then_thresholds": CTE + ", rk AS (SELECT source_id, target_id, relative_score, CAST(row_number() OVER (PARTITION BY source_id ORDER BY relative_score DESC, target_id) AS INT) AS rank FROM relative) SELECT source_id, target_id, rank, round(relative_score, 4) score, threshold FROM rk, (VALUES (0.6::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE), (0.9::DOUBLE)) v(threshold) WHERE rank <= 10 AND round(relative_score, 4) >= threshold",
    "rounded_threshold": CTE + ", rk AS (SELECT source_id, target_id, round(relative_score, 6) score, CAST(row_number() OVER (PARTITION BY source_id ORDER BY relative_score DESC, target_id) AS INT) AS rank FROM relative) SELECT source_id, target_id, rank, score, rank = 1 AS best, rank <= 10 AS diagnostic_top10 FROM rk WHERE score >= 0.6",
    "candidate_table": CTE + "SELECT source, source_id, rank, target_id, target_type, fr, coalesce(parent_sr::VARCHAR, '') parent_sr, round(raw_cosine, 6) raw_cosine, round(relative_score, 6) relative_score, verdict FROM cand",
    "candidates_per_rule": CTE + "SELECT r.source, r.source_id, count(c.rank) n FROM rules r LEFT JOIN cand c USING (source, source_id) GROUP BY ALL",
    "candidate_histogram": CTE + "SELECT n, count(*) rules FROM (SELECT r.source_id, count(c.rank) n FROM rules r LEFT JOIN cand c USING (source, source_id) GROUP BY ALL) GROUP BY n",
    "observed_counts": CTE + "SELECT (SELECT count(*) FROM rules) rules, count(*) pairs, (SELECT count(*) FROM rules WHERE source_id NOT IN (SELECT source_id FROM cand)) zero_candidate_rules, count(*) FILTER (target_type = 'SR') sr_pairs, count(*) FILTER (target_type = 'RE') re_pairs FROM cand",
    "score_stats": CTE + f"SELECT source, {describe_sql('relative_score', 'rel')}, {quartile_sql('raw_cosine', 'raw')}, round(CASE WHEN count(*) = 1 THEN 0 ELSE stddev_samp(raw_cosine) END, 6) raw_stdev FROM cand GROUP BY source",
    "scores_by_verdict": CTE + f"SELECT coalesce(verdict, 'ALL') verdict, {quartile_sql('relative_score', 'rel')} FROM cand GROUP BY GROUPING SETS ((cand.verdict), ())",
    "verdict_distribution": CTE + "SELECT verdict, count(*) n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) pct FROM cand GROUP BY 1",
    "verdict_by_source": CTE + "SELECT source, verdict, count(*) n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY source), 4) pct FROM cand GROUP BY 1, 2",
    "parent_distribution": CTE + "SELECT coalesce(parent_sr::VARCHAR, '(blank)') parent_sr, count(*) n, round(100.0 * count(*) / sum(count(*)) OVER (), 4) pct FROM cand GROUP BY 1",
    "count_bins": bins_sql(d.COUNT_BINS, "n", "cnt", "source").replace("SELECT source, ord", "SELECT source, CAST(ord AS INT) ord"),
    "relative_bins": bins_sql(d.RELATIVE_BINS, "relative_score", "cand", "source"),
    "raw_bins": bins_sql(d.RAW_BINS, "raw_cosine", "cand", "source"),
    "counters": COUNTERS_SQL + " SELECT dimension, source, key, n FROM counted",
    "concentration": COUNTERS_SQL + """, p AS (SELECT *, n / sum(n) OVER w p, sum(n) OVER w total, row_number() OVER (PARTITION BY dimension, source ORDER BY n, key) a, row_number() OVER (PARTITION BY dimension, source ORDER BY n DESC, key) b FROM counted WINDOW w AS (PARTITION BY dimension, source))
SELECT dimension, source, count(*) AS keys, sum(n)::BIGINT total, round(sum(p * p), 6) hhi, round(CASE WHEN count(*) <= 1 THEN 0 ELSE -sum(p * log2(p)) END, 6) entropy,
round(CASE WHEN count(*) <= 1 THEN 0 ELSE -sum(p * log2(p)) / log2(count(*)) END, 6) normalized_entropy, round(2.0 * sum(a * n) / (count(*) * sum(n)) - (count(*) + 1.0) / count(*), 6) gini,
round(100.0 * sum(n) FILTER (b <= 1) / sum(n), 6) top1_share, round(100.0 * sum(n) FILTER (b <= 5) / sum(n), 6) top5_share, round(100.0 * sum(n) FILTER (b <= 10) / sum(n), 6) top10_share FROM p GROUP BY dimension, source""",
    "target_ranking": ranking_sql("target_id"),
    "parent_ranking": ranking_sql("coalesce(parent_sr, target_id)"),
    "parent_by_type_ranking": ranking_sql("CASE target_type WHEN 'SR' THEN target_id WHEN 'RE' THEN parent_sr END"),
    "first_seen_ranking": "SELECT p_brand, count(*) n, min(p_partkey) first_seen, CAST(row_number() OVER (ORDER BY count(*) DESC, min(p_partkey)) AS INT) AS position FROM part GROUP BY 1",
    "source_target_matrix": CTE + "SELECT s.source, t.target_id, count(c.rank) n FROM (SELECT DISTINCT source FROM rules) s CROSS JOIN targets t LEFT JOIN cand c ON c.source = s.source AND c.target_id = t.target_id GROUP BY 1, 2",
    "rule_quality": QUALITY_SQL + " SELECT source, source_id, n, round(top1, 6) top1, round(top2, 6) top2, round(gap, 6) gap, distinct_parents, parents FROM q",
    "source_quality": SOURCE_QUALITY_SQL + " SELECT * FROM sq",
    "source_comparison": SOURCE_QUALITY_SQL + """, l AS (UNPIVOT (SELECT source, rules::DOUBLE rules, covered::DOUBLE covered, coverage, candidates_mean, gap_mean FROM sq) ON rules, covered, coverage, candidates_mean, gap_mean INTO NAME measure VALUE v)
SELECT measure, max(v) FILTER (source = 'even') even, max(v) FILTER (source = 'odd') odd FROM l GROUP BY 1""",
    "target_type_counts": CTE + "SELECT source, target_type, count(*) n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY source), 6) pct FROM cand GROUP BY 1, 2",
    "order_price_quartiles": "SELECT o_orderpriority, " + quartile_sql("o_totalprice", "price").replace(", 6)", ", 2)") + " FROM orders GROUP BY 1",
}
