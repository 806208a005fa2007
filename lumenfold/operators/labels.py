"""Verdicts, annotations and rule classes joined to candidates."""

from __future__ import annotations

import heapq
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions import measures as m

KEYS = ("source", "source_id")
POSITIVE = ("YES", "MAYBE")


def verdict_counts(v: Column, verdicts: Sequence[str] = ("YES", "MAYBE", "NO")) -> list[Column]:
    return [*(F.count_if(v == x).alias(f"{x.lower()}_count") for x in verdicts), F.count_if(v.isin(*POSITIVE)).alias("positive_count")]


def rule_summary(pairs: DataFrame, title: str | None = None) -> DataFrame:
    """Per rule: counts by verdict, has_yes, has_maybe, all_no (every verdict is NO), what its first candidate is, and its first title that isn't null."""
    v = F.col("verdict")
    first = [F.min_by(c, "rank").alias(f"top1_{c}") for c in ("verdict", "target_id", "target_type")]
    name = [F.min_by(F.col(title), F.when(F.col(title).isNotNull(), F.col("rank"))).alias(title)] if title else []
    return pairs.groupBy(*KEYS).agg(F.count("*").alias("candidates"), *verdict_counts(v), F.bool_or(v == "YES").alias("has_yes"), F.bool_or(v == "MAYBE").alias("has_maybe"), F.every(F.coalesce(v == "NO", F.lit(False))).alias("all_no"), *first, *name)


def top_targets(pairs: DataFrame, verdicts: Sequence[str], sources: Sequence[str], limit: int = 30) -> DataFrame:
    """Targets with the most pairs of these verdicts: pairs, distinct rules, pairs by source; by pairs, rules, id."""
    some = pairs.where(F.col("verdict").isin(*verdicts))
    by = [F.count_if(F.col("source") == s).alias(f"pairs_{s}") for s in sources]
    c = some.groupBy("target_id").agg(F.count("*").alias("pairs"), F.count_distinct("source", "source_id").alias("rules"), *by)
    return c.orderBy(F.desc("pairs"), F.desc("rules"), "target_id").limit(limit)


def verdicts_by(pairs: DataFrame, sets: Sequence[Sequence[str]]) -> DataFrame:
    """Verdict counts and positive percentage over several groupings at once (null: all)."""
    columns = sorted({c for s in sets for c in s})
    g = pairs.groupingSets([list(s) for s in sets], *columns)
    return g.agg(F.count("*").alias("pairs"), *verdict_counts(F.col("verdict")), m.percent(F.count_if(F.col("verdict").isin(*POSITIVE)), F.count("*"), 4).alias("positive_pct"))


def rule_rollup(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every classified rule with its counts and positive rate (6 digits; 0 without candidates)."""
    agg = pairs.groupBy(*KEYS).agg(F.count("*").alias("candidates"), *verdict_counts(F.col("verdict")))
    j = classes.join(agg, list(KEYS), "left").na.fill(0, ["candidates", "yes_count", "maybe_count", "no_count", "positive_count"])
    return j.withColumn("positive_rate", F.round(F.coalesce(F.try_divide(F.col("positive_count").cast("double"), F.col("candidates")), F.lit(0.0)), 6))


def class_groups(rollup: DataFrame, classes: Sequence[str], label: str = "label") -> DataFrame:
    """A row for every class, occurring or not: rates over the rules that have candidates, coverage over all rules."""
    r = F.when(F.col("candidates") > 0, F.col("positive_rate"))
    covered = F.count_if(F.col("positive_count") > 0)
    g = rollup.groupBy(label).agg(F.count("*").alias("rules"), F.count_if(F.col("candidates") > 0).alias("with_candidates"), covered.alias("positive_rules"), F.sum("candidates").alias("pairs"), F.sum("yes_count").alias("yes_pairs"),
                                  m.percent(covered, F.count("*"), 6).alias("coverage"), F.round(F.avg(r), 6).alias("mean_rate"), F.round(F.median(r), 6).alias("median_rate"))
    frame = rollup.sparkSession.createDataFrame([(c,) for c in classes], f"{label} string")
    counts = ["rules", "with_candidates", "positive_rules", "pairs", "yes_pairs"]
    return frame.join(g, label, "left").na.fill(0, counts).na.fill(0.0, ["coverage", "mean_rate", "median_rate"])


def group_ratios(groups: DataFrame, above: str, below: str, label: str = "label") -> DataFrame:
    """Coverage and mean-rate ratios of two classes, from rounded inputs, null if either side is 0; the YES-rate ratio, from raw rates, null only if the lower side is 0."""
    def pick(column: Column, name: str) -> Column:
        return F.max(F.when(F.col(label) == name, column))

    yes = F.try_divide(F.col("yes_pairs").cast("double"), F.col("pairs"))
    g = groups.agg(*[pick(F.col(c), n).alias(f"{k}_{c}") for c in ("coverage", "mean_rate") for k, n in (("a", above), ("b", below))], pick(yes, above).alias("a_yes"), pick(yes, below).alias("b_yes"))

    def ratio(c: str) -> Column:
        a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
        return F.when((a != 0) & (b != 0), F.round(a / b, 6)).alias(f"{c}_ratio")

    return g.select(ratio("coverage"), ratio("mean_rate"), F.round(F.try_divide(F.col("a_yes"), F.col("b_yes")), 6).alias("yes_ratio"))


def cross_analysis(pairs: DataFrame, classes: DataFrame, label: str = "label") -> DataFrame:
    """(class, verdict): pairs and distinct rules."""
    j = pairs.join(classes.select(*KEYS, label), list(KEYS))
    return j.groupBy(label, "verdict").agg(F.count("*").alias("pairs"), F.count_distinct(*KEYS).alias("rules"))


def transfer_annotations(new: DataFrame, old: DataFrame, keys: Sequence[str], fields: Sequence[str], valid: Sequence[str]) -> DataFrame:
    """Old annotations on new records by key; only those whose label is valid are taken over."""
    o = old.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields], F.lit(True).alias("_found"))
    good = F.coalesce(F.col("_found") & F.col(f"_{fields[0]}").isin(*valid), F.lit(False))
    j = new.join(o, list(keys), "left")
    return j.select(*[F.when(good, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in fields else F.col(c) for c in new.columns])


def annotation_statistics(records: DataFrame, label: str, valid: Sequence[str]) -> DataFrame:
    """Per rule: candidates, labelled ones, whether it is decided (all labelled), status."""
    ok = F.coalesce(F.col(label).isin(*valid), F.lit(False))
    g = records.groupBy(*KEYS).agg(F.count("*").alias("candidates"), F.count_if(ok).alias("labelled"), F.every(ok).alias("decided"))
    return g.withColumn("status", F.when(F.col("decided"), "completed").when(F.col("labelled") > 0, "in_progress").otherwise("unreviewed"))


def stratified_sample(rules: DataFrame, stratum: str, size: int, key: str, seed: int = 42, most_strata: int = 10_000) -> DataFrame:
    """A proportional sample of `size` rules: shares are rounded, then corrected one by one at the strata with most room (too few) or most rules (too many).

    Members are the rules of smallest seeded hash in each stratum, so a run repeats and strata are
    ranked where they lie; only the counts of at most most_strata strata come to the driver (more are an error).
    """
    found = rules.groupBy(stratum).agg(F.count("*").alias("n")).limit(most_strata + 1).collect()
    if len(found) > most_strata:
        raise ValueError(f"more than {most_strata} strata")
    take = allocation({r[stratum]: r["n"] for r in found}, size)
    shares = rules.sparkSession.createDataFrame(list(take.items()), T.StructType([T.StructField("_stratum", rules.schema[stratum].dataType), T.StructField("_take", T.LongType())]))
    w = Window.partitionBy(stratum).orderBy(F.xxhash64(F.col(key), F.lit(seed)), key)
    ranked = rules.withColumn("_n", F.row_number().over(w))
    return ranked.join(F.broadcast(shares), ranked[stratum].eqNullSafe(shares["_stratum"])).where(F.col("_n") <= F.col("_take")).select(*rules.columns)


def allocation(counts: dict, size: int) -> dict:
    """How many of each stratum: at most what it has, `size` in all (or everything)."""
    total = sum(counts.values())
    if size >= total:
        return dict(counts)
    take = {s: min(n, round(size * n / total)) for s, n in counts.items()}
    over = sum(take.values()) - size
    step = -1 if over > 0 else 1
    room = (lambda s: take[s]) if over > 0 else (lambda s: counts[s] - take[s])
    heap = [(-room(s), i, s) for i, s in enumerate(sorted(counts, key=str))]  # of equals the first by name
    heapq.heapify(heap)
    for _ in range(abs(over)):
        _, i, s = heap[0]
        take[s] += step
        heapq.heapreplace(heap, (-room(s), i, s))
    return take
