"""Distribution analytics of a candidate table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions import measures as m
from lumenfold.functions.hierarchy import effective_parent, effective_parent_by_type
from lumenfold.operators.numbering import numbered
from lumenfold.operators.percentiles import with_percentiles

#: Bins of candidate counts, of relative and of raw scores (name, low, high; low inclusive, high exclusive).
COUNT_BINS = [("0", 0, 1), ("1-5", 1, 6), ("6-10", 6, 11), ("11-20", 11, 21), ("21-50", 21, 51), (">50", 51, None)]
RELATIVE_BINS = [("0.60-0.70", 0.60, 0.70), ("0.70-0.80", 0.70, 0.80), ("0.80-0.90", 0.80, 0.90), ("0.90-1.00", 0.90, 0.999999), ("1.00", 0.999999, None)]
RAW_BINS = [(f"{i / 10:.1f}-{(i + 1) / 10:.1f}", i / 10, (i + 1) / 10 if i < 9 else None) for i in range(10)]


def value_distribution(df: DataFrame, value: str, group: str | None = None, blank: str = "(blank)", digits: int = 4) -> DataFrame:
    """Count and percentage of each value, within the group if there is one; null is `blank`."""
    keys = [group] if group else []
    v = F.coalesce(F.col(value).cast("string"), F.lit(blank)).alias(value)
    counted = df.select(*keys, v).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counted.withColumn("pct", m.percent(F.col("n"), F.sum("n").over(Window.partitionBy(*keys)), digits))


def binned(df: DataFrame, x: Column, bins: Sequence[tuple], groups: Sequence[str] = ()) -> DataFrame:
    """(groups, ord, bin, n) for every bin, those without a row included; values outside all bins are not counted.

    The bin table and the list of groups are small dimensions; the rows are counted before they meet them.
    """
    case = None
    for i, (_, low, high) in enumerate(bins):
        inside = (x >= low) & (x < high) if high is not None else x >= low
        case = F.when(inside, i) if case is None else case.when(inside, i)
    counted = df.withColumn("ord", case).where("ord is not null").groupBy(*groups, "ord").agg(F.count("*").alias("n"))
    named = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(b[0]).alias("bin")) for i, b in enumerate(bins)])).alias("b")
    base = df.select(*groups).distinct() if groups else df.sparkSession.range(1).select()
    frame = base.select(*groups, named).select(*groups, "b.ord", "b.bin")
    return frame.join(counted, [*groups, "ord"], "left").select(*groups, "ord", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def candidate_counts(rules: DataFrame, candidates: DataFrame, keys: Sequence[str] = ("source", "source_id")) -> DataFrame:
    """Candidates of every rule, 0 for those without."""
    n = candidates.groupBy(*keys).agg(F.count("*").alias("n"))
    return rules.select(*keys).join(n, list(keys), "left").select(*keys, F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def histogram(counts: DataFrame) -> DataFrame:
    """Rules by number of candidates."""
    return counts.groupBy("n").agg(F.count("*").alias("rules"))


def observed_counts(counts: DataFrame, candidates: DataFrame) -> DataFrame:
    """One row: rules, pairs, pairs by target type, rules without candidates."""
    a = counts.agg(F.count("*").alias("rules"), F.sum("n").alias("pairs"), F.count_if(F.col("n") == 0).alias("zero_candidate_rules"))
    b = candidates.agg(F.count_if(F.col("target_type") == "SR").alias("sr_pairs"), F.count_if(F.col("target_type") == "RE").alias("re_pairs"))
    return a.crossJoin(F.broadcast(b))  # one row each


def counters(candidates: DataFrame) -> DataFrame:
    """All counters of the concentration analysis in one pass: dimension, source (null: all), key, n."""
    c = candidates.select("source", F.struct(
        F.col("target_id").cast("string").alias("target"), effective_parent(F.col("parent_sr"), F.col("target_id")).cast("string").alias("parent"),
        F.col("target_type").alias("type"), F.col("fr").cast("string").alias("fr")).alias("k"))
    each = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(f"k.{d}").alias("key")) for d in ("target", "parent", "type", "fr")])).alias("e")
    long = c.select("source", each).select("source", "e.dimension", "e.key")
    return long.groupingSets([["dimension", "key"], ["dimension", "key", "source"]], "dimension", "key", "source").agg(F.count("*").alias("n")).select("dimension", "source", "key", "n")


def concentration(counted: DataFrame, groups: Sequence[str] = ("dimension", "source")) -> DataFrame:
    """Keys, total, HHI, entropy, normalised entropy, Gini and top-1/5/10 shares (in percent) of every group of counters."""
    w = Window.partitionBy(*groups)
    ranked = counted.withColumn("total", F.sum("n").over(w)).withColumn("p", m.share(F.col("n"), F.col("total")))
    ranked = ranked.withColumn("asc", F.row_number().over(w.orderBy("n", "key"))).withColumn("desc", F.row_number().over(w.orderBy(F.desc("n"), "key")))
    top = [m.percent(F.coalesce(F.sum(F.when(F.col("desc") <= k, F.col("n"))), F.lit(0)), F.max("total")).alias(f"top{k}_share") for k in (1, 5, 10)]
    return ranked.groupBy(*groups).agg(
        F.count("*").alias("keys"), F.sum("n").alias("total"), m.herfindahl(F.col("p")).alias("hhi"), m.entropy(F.col("p")).alias("entropy"),
        m.normalized_entropy(F.col("p")).alias("normalized_entropy"), m.gini(F.col("n"), F.col("asc")).alias("gini"), *top)


def ranking(candidates: DataFrame, key: Column, groups: Sequence[str] = ("source",), top: int | None = 20) -> DataFrame:
    """Keys by count (ties by key): position, share of the group, mean scores, distinct targets; the `top` first."""
    w = Window.partitionBy(*groups)
    counted = candidates.withColumn("key", key).groupBy(*groups, "key").agg(
        F.count("*").alias("n"), F.coalesce(F.avg("relative_score"), F.lit(0.0)).alias("mean_relative"), F.coalesce(F.avg("raw_cosine"), F.lit(0.0)).alias("mean_cosine"), F.count_distinct("target_id").alias("distinct_targets"))
    out = counted.withColumn("pct", m.percent(F.col("n"), F.sum("n").over(w))).withColumn("position", F.row_number().over(w.orderBy(F.desc("n"), "key")))
    return out if top is None else out.where(F.col("position") <= top)


def first_seen_ranking(df: DataFrame, key: str, order: str) -> DataFrame:
    """Keys by count; ties in the order in which they were first seen."""
    c = df.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first_seen"))
    return numbered(c, [F.desc("n"), F.asc("first_seen")]).withColumn("position", (F.col("index") + 1).cast("int")).drop("index")


def count_matrix(candidates: DataFrame, sources: DataFrame, targets: DataFrame, most_sources: int = 1000) -> DataFrame:
    """Every (source, target) with its count, 0 included. Sources are the names of a few datasets: more than most_sources of them are an error."""
    n = candidates.groupBy("source", "target_id").agg(F.count("*").alias("n"))
    names = [r[0] for r in sources.select("source").distinct().limit(most_sources + 1).collect()]
    if len(names) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    grid = targets.select("target_id", F.explode(F.array(*[F.lit(x) for x in sorted(names)])).alias("source"))
    return grid.join(n, ["source", "target_id"], "left").select("source", "target_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def rule_quality(candidates: DataFrame, keys: Sequence[str] = ("source", "source_id")) -> DataFrame:
    """Per rule: count, top two scores, their gap, distinct effective parents (count and sorted list), scores in rank order."""
    parent = effective_parent(F.col("parent_sr"), F.col("target_id"))
    g = candidates.withColumn("ep", parent).groupBy(*keys).agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "relative_score"))).alias("s"), F.array_sort(F.collect_set("ep")).alias("parents"))
    top1, top2 = F.get("s", F.lit(0))["relative_score"], F.get("s", F.lit(1))["relative_score"]
    return g.select(*keys, "n", top1.alias("top1"), top2.alias("top2"), (top1 - top2).alias("gap"), F.size("parents").alias("distinct_parents"), "parents", F.transform("s", lambda x: x["relative_score"]).alias("scores"))


def source_quality(rules: DataFrame, quality: DataFrame) -> DataFrame:
    """Per source: rules, coverage by rules with at least one candidate and by rules present, statistics of counts and gaps."""
    j = rules.select("source", "source_id").join(quality.select("source", "source_id", "n", "top1", "gap", "distinct_parents"), ["source", "source_id"], "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    return j.groupBy("source").agg(
        F.count("*").alias("rules"), F.count("n").alias("covered"), m.percent(F.count("n"), F.count("*")).alias("coverage"), m.percent(F.count("source_id"), F.count("*")).alias("presence"),
        *m.describe(n, "candidates"), *m.describe(F.col("gap"), "gap"), *m.describe(F.col("distinct_parents"), "parents"))


def compare_sources(summary: DataFrame, names: Sequence[str], measures: Sequence[str]) -> DataFrame:
    """One row per measure with a column for each source."""
    long = summary.select("source", F.explode(F.array(*[F.struct(F.lit(x).alias("measure"), F.col(x).cast("double").alias("value")) for x in measures])).alias("m"))
    return long.select("source", "m.*").groupBy("measure").pivot("source", list(names)).agg(F.first("value"))


def mapping_analysis(rules: DataFrame, candidates: DataFrame, top: int = 20) -> DataFrame:
    """The whole analysis of a mapping as (source, section, name, position, n, value).

    rules: source, source_id. Sections: counts (rules, with and without candidates, candidates);
    statistics and percentiles of candidates_per_rule, distinct_parents_per_rule, relative_score and raw_cosine; target_type and
    parent distributions; top_targets (ties in the order in which they were first seen),
    top_rules and top_rules_by_parents (ties by id), the `top` first of each.
    """
    keys = ["source", "source_id"]
    owner = effective_parent_by_type(F.col("target_type"), F.col("parent_sr"), F.col("target_id"))
    own = candidates.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(owner).alias("parents"))
    per = rules.select(*keys).distinct().join(own, keys, "left").na.fill(0, ["n", "parents"])
    null = F.lit(None)

    def rows(df, section, name, position=null, n=null, value=null):
        return df.select("source", F.lit(section).alias("section"), name.cast("string").alias("name"), position.cast("int").alias("position"), n.cast("long").alias("n"), value.cast("double").alias("value"))

    def unpivoted(df, measure):
        return rows(df.select("source", F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in df.columns if c != "source"]), F.array(*[F.col(c).cast("double") for c in df.columns if c != "source"]))).alias("k", "v")), measure, F.col("k"), value=F.col("v"))

    def spread(df, x, measure):
        own = {"mean": F.avg(x), "min": F.min(x), "max": F.max(x), "stdev": m.sample_stdev(x)}
        qs = {"median": 0.5, **{f"p{int(q * 100)}": q for q in (0.25, 0.5, 0.75, 0.9, 0.95, 0.99)}}
        found = with_percentiles(df, ["source"], [v.alias(k) for k, v in own.items()], {"q": (x, qs)})
        named = {**{k: F.col(k) for k in own}, **{k: F.col(f"q_{k}") for k in qs}}
        return unpivoted(found.select("source", *[F.round(F.coalesce(v.cast("double"), F.lit(0.0)), 6).alias(k) for k, v in named.items()]), measure)

    def first(df, section, name, order, n):
        position = F.row_number().over(Window.partitionBy("source").orderBy(*order))
        return rows(df.withColumn("_at", position).where(F.col("_at") <= top), section, F.col(name), F.col("_at"), F.col(n))

    targets = candidates.groupBy("source", "target_id").agg(F.count("*").alias("n"), F.min(F.struct("source_id", "rank")).alias("seen"))
    parts = [
        unpivoted(per.groupBy("source").agg(F.count("*").alias("rules"), F.count_if(F.col("n") > 0).alias("with_candidates"), F.count_if(F.col("n") == 0).alias("without_candidates"), F.sum("n").alias("candidates")), "counts"),
        spread(per, F.col("n"), "candidates_per_rule"), spread(per, F.col("parents"), "distinct_parents_per_rule"), spread(candidates, F.col("relative_score"), "relative_score"), spread(candidates, F.col("raw_cosine"), "raw_cosine"),
        rows(candidates.groupBy("source", "target_type").agg(F.count("*").alias("n")), "target_type", F.col("target_type"), n=F.col("n")),
        rows(candidates.where("parent_sr is not null").groupBy("source", "parent_sr").agg(F.count("*").alias("n")), "parent", F.col("parent_sr"), n=F.col("n")),
        first(targets, "top_targets", "target_id", [F.desc("n"), F.asc("seen")], "n"),
        first(per, "top_rules", "source_id", [F.desc("n"), F.asc("source_id")], "n"), first(per, "top_rules_by_parents", "source_id", [F.desc("parents"), F.asc("source_id")], "parents"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out
