"""Parameter sweeps over scores that are computed and ranked once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import measures as m
from lumenfold.functions.hierarchy import effective_parent


def threshold_topk(ranked: DataFrame, rules: DataFrame, thresholds: Sequence[float], ks: Sequence[int]) -> DataFrame:
    """(threshold, k, source): coverage and statistics of candidates, distinct parents and scores.

    ranked: source, source_id, target_id, parent_sr, relative_score, rank of all scored pairs. Each
    row meets only the parameter pairs that keep it, so the grid multiplies survivors alone.
    """
    kept = ranked.where((F.col("relative_score") >= min(thresholds)) & (F.col("rank") <= max(ks)))
    grid = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(int(k)).alias("k")) for t in thresholds for k in ks])
    held = F.filter(grid, lambda g: (F.col("relative_score") >= g["threshold"]) & (F.col("rank") <= g["k"]))
    each = kept.withColumn("ep", effective_parent(F.col("parent_sr"), F.col("target_id"))).select("source", "source_id", "ep", "relative_score", F.explode(held).alias("g"))
    per_rule = each.groupBy("g.threshold", "g.k", "source", "source_id").agg(F.count("*").alias("n"), F.count_distinct("ep").alias("parents"), F.sum("relative_score").alias("s"))
    total = rules.groupBy("source").agg(F.count("*").alias("rules")).select("source", "rules", F.explode(grid).alias("g")).select("source", "rules", "g.*")
    out = per_rule.groupBy("threshold", "k", "source").agg(F.count("*").alias("covered"), F.sum("n").alias("pairs"), *m.describe(F.col("n"), "candidates"), *m.describe(F.col("parents"), "parents"), F.sum("s").alias("_s"))
    j = total.join(out, ["threshold", "k", "source"], "left")
    stats = [F.coalesce(c, F.lit(0.0)).alias(c) for c in out.columns if c.startswith(("candidates_", "parents_"))]
    return j.select("threshold", "k", "source", "rules", F.coalesce("covered", F.lit(0)).cast("long").alias("covered"), F.coalesce("pairs", F.lit(0)).cast("long").alias("pairs"),
                    m.percent(F.coalesce("covered", F.lit(0)), F.col("rules")).alias("coverage"), *stats, F.coalesce(F.col("_s") / F.col("pairs"), F.lit(0.0)).alias("mean_score"))


def diversity(pairs: DataFrame, powers: Sequence[float]) -> DataFrame:
    """(p, m): mean over targets of the highest row-normalised cosine to the power p that any source gives the target.

    Normalising a row divides by its largest clamped cosine, so x^p normalised is (x / largest)^p:
    one window gives the ratio for every power.
    """
    top = F.max(F.greatest(F.col("raw_cosine"), F.lit(0.0))).over(Window.partitionBy("source_id"))
    ratio = pairs.withColumn("top", top).withColumn("r", F.when(F.col("top") > 0, F.greatest(F.col("raw_cosine"), F.lit(0.0)) / F.col("top")).otherwise(F.lit(0.0)))
    best = ratio.groupBy("target_id").agg(F.max("r").alias("r"))  # powers keep order: the highest ratio gives the highest power
    return best.select("r", F.explode(F.array(*[F.lit(float(p)) for p in powers])).alias("p")).groupBy("p").agg(F.avg(F.pow("r", "p")).alias("m"))


def topk_then_thresholds(ranked: DataFrame, k: int, thresholds: Sequence[float], digits: int = 4) -> DataFrame:
    """K first, then each threshold on the rounded score."""
    first = ranked.where(F.col("rank") <= k).withColumn("score", F.round("relative_score", digits))
    held = F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: F.col("score") >= t)
    return first.select("source_id", "target_id", "rank", "score", F.explode(held).alias("threshold"))


def rounded_threshold(ranked: DataFrame, threshold: float = 0.60, digits: int = 6) -> DataFrame:
    """All pairs whose rounded score reaches the threshold; the best match and the first ten are marked, not cut."""
    r = F.round("relative_score", digits)
    return ranked.where(r >= threshold).withColumn("score", r).withColumn("best", F.col("rank") == 1).withColumn("diagnostic_top10", F.col("rank") <= 10)
