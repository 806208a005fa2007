"""Exact percentiles of large groups by refining histograms.

A percentile lies between two order statistics. For each group and each rank that is asked for, an
interval of values holds the rank; a round counts the interval's rows in equal bins, together with the
least and largest value of each bin, and goes on with the one bin that holds the rank. It is found when a
bin's values are equal. A round is one aggregation with partial sums, so a group of any size
is spread over all tasks, and no task ever holds a group's values.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.session import durable


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in keys], F.lit(True))


def order_statistics(rows: DataFrame, keys: list[str], ranks: DataFrame, bins: int = 1024, most_broadcast: int = 100_000) -> DataFrame:
    """(keys, rank, value): the value of each rank (from 0, by size) of ranks (keys, rank, lo, hi: bounds of the group's values), among rows (keys, x).

    A round divides an interval's width by `bins`, or ends it; intervals are broadcast up to most_broadcast of them.
    """
    found, open_ = None, ranks.withColumn("left", F.col("rank").cast("long"))
    while True:
        open_ = durable(open_)
        ready = open_.where("lo = hi").select(*keys, "rank", F.col("lo").alias("value"))
        found = ready if found is None else found.unionByName(ready)
        open_ = open_.where("lo < hi")
        n = open_.count()
        if not n:
            return found
        side = F.broadcast(open_.alias("r")) if n <= most_broadcast else open_.alias("r")
        met = rows.alias("l").join(side, _same(keys)).where(F.col("x").between(F.col("lo"), F.col("hi")))
        x, lo, hi = F.col("x"), F.col("lo"), F.col("hi")
        part = F.when(hi - lo < F.lit(float("inf")), (x - lo) / (hi - lo)).otherwise((x / 2 - lo / 2) / (hi / 2 - lo / 2))  # the width of two doubles need not be one
        bin_ = F.least(F.floor(part * bins), F.lit(bins - 1))
        by = [*[F.col(f"r.{k}").alias(k) for k in keys], "rank", "left", bin_.alias("bin")]
        counted = met.groupBy(*by).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy(*keys, "rank").orderBy("bin"))  # at most `bins` rows of a rank
        cum = counted.withColumn("upto", upto).where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("n") <= F.col("left")))
        open_ = cum.select(*keys, "rank", "lo", "hi", (F.col("left") - F.col("upto") + F.col("n")).alias("left"))


def percentiles(df: DataFrame, keys: list[str], x: Column, qs: dict[str, float], bins: int = 1024) -> DataFrame:
    """(keys, a column for each of qs): exact percentiles with linear interpolation, as Spark's own `percentile` gives them.

    Null and NaN values take no part; a group of them alone gives null. Null keys form a group; without keys there is
    one group. An infinite value is a value like any other only at the ends: it is returned, but a group that holds
    both finite and infinite values is refined among the finite ones.
    """
    marks = [f"_k{i}" for i in range(len(keys))]
    value = F.when(~F.isnan(x.cast("double")), x.cast("double") + 0.0)
    rows = durable(df.select(*[F.col(f"`{k}`").alias(m) for k, m in zip(keys, marks, strict=True)], value.alias("x")))
    low, high = F.lit(float("-inf")), F.lit(float("inf"))
    finite = F.when((F.col("x") > low) & (F.col("x") < high), F.col("x"))
    groups = durable(rows.groupBy(*marks).agg(F.count("x").alias("n"), F.count_if(F.col("x") == low).alias("under"), F.count(finite).alias("inside"), F.min(finite).alias("lo"), F.max(finite).alias("hi")))
    at = {name: (F.col("n") - 1) * F.lit(float(q)) for name, q in qs.items()}
    wanted = F.array_distinct(F.concat(*[F.array(F.floor(p), F.ceil(p)) for p in at.values()]))
    ranks = groups.where("n > 0").select("*", F.explode(wanted).alias("rank"))
    ends = ranks.where("rank < under or rank >= under + inside").select(*marks, "rank", F.when(F.col("rank") < F.col("under"), low).otherwise(high).alias("value"))
    inner = ranks.where("rank >= under and rank < under + inside")
    inside = order_statistics(rows.where((F.col("x") > low) & (F.col("x") < high)), marks, inner.select(*marks, (F.col("rank") - F.col("under")).alias("rank"), "lo", "hi"), bins)
    back = inside.alias("l").join(groups.select(*marks, "under").alias("r"), _same(marks)).select(*[F.col(f"l.{m}").alias(m) for m in marks], (F.col("rank") + F.col("under")).alias("rank"), "value")
    held = ends.unionByName(back).groupBy(*marks).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("values"))  # two ranks at most of each percentile
    j = groups.alias("l").join(held.alias("r"), _same(marks), "left").select("l.*", "r.values")

    def between(p: Column) -> Column:
        a, b = F.try_element_at("values", F.floor(p)), F.try_element_at("values", F.ceil(p))
        return F.when(a == b, a).otherwise((F.ceil(p) - p) * a + (p - F.floor(p)) * b)

    return j.select(*[F.col(m).alias(k) for k, m in zip(keys, marks, strict=True)], *[F.when(F.col("n") > 0, between(p)).alias(name) for name, p in at.items()])


def with_percentiles(df: DataFrame, keys: list[str], aggregates: list[Column], of: dict[str, tuple[Column, dict[str, float]]], digits: int | None = None) -> DataFrame:
    """Per group: the aggregates, and for each prefix of `of` the percentiles {name: q} of its column as prefix_name."""
    out = df.groupBy(*keys).agg(*aggregates)
    for prefix, (x, qs) in of.items():
        p = percentiles(df, keys, x, {f"{prefix}_{k}": q for k, q in qs.items()})
        if digits is not None:
            p = p.select(*keys, *[F.round(f"{prefix}_{k}", digits).alias(f"{prefix}_{k}") for k in qs])
        names = [c for c in [*out.columns, *p.columns[len(keys) :]]]
        out = out.alias("l").join(p.alias("r"), _same(keys)).select(*[F.col(f"l.{c}") if c in out.columns else F.col(f"r.{c}") for c in names])
    return out
